"""Incremental storage: deduplication by hash, page change plans, parents across runs, seeds, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def dedupe(incoming: DataFrame, stored: DataFrame, key: str = "source_hash", order: str = "id") -> DataFrame:
    """Get or create by hash: incoming rows with document_id (the first of their hash, stored ones before new) and created."""
    old = stored.groupBy(key).agg(F.min(order).alias("old_id"))
    first = incoming.groupBy(key).agg(F.min(order).alias("new_id"))
    joined = incoming.join(first, key).join(old, key, "left")
    return joined.select(*incoming.columns, F.coalesce("old_id", "new_id").alias("document_id"), (F.col("old_id").isNull() & (F.col(order) == F.col("new_id"))).alias("created"))


def insert_missing(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """table with those of rows whose key it lacks; of equal keys in rows one."""
    return table.unionByName(rows.dropDuplicates(key).join(table.select(*key), key, "left_anti").select(*table.columns))


def change_plan(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """document_id, page_number, action: skip (same hash), replace, insert, or gone."""
    s, f = stored.select("document_id", "page_number", F.col("page_hash").alias("old_hash")), fresh.select("document_id", "page_number", F.col("page_hash").alias("new_hash"))
    joined = s.join(f, ["document_id", "page_number"], "full_outer")
    action = F.when(F.col("old_hash").isNull(), "insert").when(F.col("new_hash").isNull(), "gone").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "skip").otherwise("replace")
    return joined.select("document_id", "page_number", action.alias("action"))


def apply_plan(stored: DataFrame, fresh: DataFrame, plan: DataFrame) -> DataFrame:
    """Element rows after the plan: stored ones of skipped pages, fresh ones of the others."""
    keys = ["document_id", "page_number"]
    skipped = plan.where("action = 'skip'").select(*keys)
    changed = plan.where("action in ('insert', 'replace')").select(*keys)
    return stored.join(skipped, keys, "left_semi").unionByName(fresh.join(changed, keys, "left_semi"))


def store_summary(plan: DataFrame, elements: DataFrame) -> DataFrame:
    """document_id, pages_stored, pages_skipped, elements_stored, crops_stored: of stored pages the elements, and the figures and icons with a box. elements: document_id, page_number, element_type, bbox."""
    stored = F.col("action").isin("insert", "replace")
    pages = plan.groupBy("document_id").agg(F.count_if(stored).alias("pages_stored"), F.count_if(F.col("action") == "skip").alias("pages_skipped"))
    kept = elements.join(plan.where(stored).select("document_id", "page_number"), ["document_id", "page_number"], "left_semi")
    counts = kept.groupBy("document_id").agg(F.count(F.lit(1)).alias("elements_stored"), F.count_if(crop_eligible(F.col("element_type"), F.col("bbox"))).alias("crops_stored"))
    return pages.join(counts, "document_id", "left").fillna(0, ["elements_stored", "crops_stored"])


def running_total(counts: DataFrame, key: str, n: str, bucket: Column) -> DataFrame:
    """counts with before: the sum of n over all smaller keys. bucket rises with the key and takes a bounded number of values, so that no task holds all keys."""
    rows = counts.withColumn("_bucket", bucket)
    totals = rows.groupBy("_bucket").agg(F.sum(n).alias("_total"))
    base = totals.select("_bucket", (F.sum("_total").over(Window.orderBy("_bucket")) - F.col("_total")).alias("_base"))
    own = Window.partitionBy("_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(F.broadcast(base), "_bucket").withColumn("before", F.col("_base") + F.sum(n).over(own) - F.col(n)).drop("_bucket", "_base")


def stored_drafts(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Stored elements as drafts, for a second extraction: local ids are the stored ones, missing paths are empty, a missing method is the parser's, in the order (page_number, id).

    elements: id, document_id, page_id, element_type, text, parent_id, section_path,
    extraction_method, extraction_confidence, visual_description; pages: id, page_number.
    """
    rows = elements.join(pages.select(F.col("id").alias("page_id"), "page_number"), "page_id")
    seen = F.col("visual_description")
    empty = F.array().cast("array<string>")
    return rows.select(
        "document_id", F.col("id").alias("element_id"), "page_number", "element_type", "text", F.col("parent_id").alias("parent_local_id"), F.coalesce("section_path", empty).alias("section_path"),
        F.coalesce(F.nullif("extraction_method", F.lit("")), F.lit("docling")).alias("extraction_method"), F.col("extraction_confidence").alias("confidence"),
        F.coalesce(seen["components"], empty).alias("components"), F.coalesce(seen["connections"], empty).alias("connections"), seen["description"].alias("description"),
        F.when(seen.isNotNull(), F.struct(F.lit("visual_description").alias("task_type"), F.lit("kg_candidate_reextraction").alias("reason"))).alias("cascade_result"),
    )


def look_up(wanted: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """wanted keys with the row that each has, and missing where there is none."""
    found = table.withColumn("_found", F.lit(True))
    return wanted.join(found, key, "left").withColumn("missing", F.col("_found").isNull()).drop("_found")


def require_none(rows: DataFrame, what: str) -> int:
    """0, or an error that names how many rows stand against it: a guard before a delete."""
    n = rows.count()
    if n:
        raise ValueError(f"{n} {what}")
    return n


def assign_ids(drafts: DataFrame, after: int = 0) -> DataFrame:
    """Database ids in reading order and parents by them; a parent must stand before its child. Parents on unchanged pages resolve too."""
    per = Window.partitionBy("document_id").orderBy("local_id")
    counts = drafts.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    base = running_total(counts, "document_id", "n", F.shiftright(F.col("document_id").cast("bigint"), 12)).select("document_id", F.col("before").alias("base"))
    numbered = drafts.join(base, "document_id").withColumn("id", F.row_number().over(per) + F.col("base") + after).drop("base")
    parents = numbered.select("document_id", F.col("local_id").alias("parent_local_id"), F.col("id").alias("parent_id"))
    joined = numbered.join(parents, ["document_id", "parent_local_id"], "left")
    return joined.withColumn("parent_id", F.when(F.col("parent_local_id") < F.col("local_id"), F.col("parent_id")))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Rows of child whose reference is not in parent: foreign keys as a query."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def crop_eligible(kind: Column, bbox: Column) -> Column:
    return kind.isin("figure", "icon") & bbox.isNotNull()
