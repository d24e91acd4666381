"""Structure of a parsed document: kinds, confidence, heading paths, icon and caption parents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labels of the parser and the element types they stand for. Fixed values.
LABELS = {
    "title": "heading", "section_header": "heading", "text": "paragraph", "paragraph": "paragraph", "footnote": "paragraph", "page_header": "paragraph", "page_footer": "paragraph",
    "formula": "paragraph", "code": "paragraph", "list_item": "list", "table": "table", "picture": "figure", "chart": "figure", "caption": "figure_caption",
}
ICON_RATIO, ICON_SIDE = 0.02, 80.0
TEXT_KINDS = ("paragraph", "list", "heading")


def element_type(label: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[label], F.lit("paragraph"))


def box_size(bbox: Column) -> Column:
    w, h = F.abs(bbox["r"] - bbox["l"]), F.abs(bbox["t"] - bbox["b"])
    return F.struct(w.alias("width"), h.alias("height"), (w * h).alias("area"))


def first_box(provenance: Column) -> Column:
    """struct(bbox, page_number): the box and page of the first provenance (l, t, r, b, page_no); no box and page 1 without one."""
    p = F.get(provenance, F.lit(0))
    box = F.struct(*[p[c].cast("double").alias(c) for c in "ltrb"])
    return F.struct(F.when(p.isNotNull(), box).alias("bbox"), F.coalesce(p["page_no"], F.lit(1)).cast("bigint").alias("page_number"))


def is_icon(width: Column, height: Column, page_width: Column, page_height: Column, ratio: float = ICON_RATIO, side: float = ICON_SIDE) -> Column:
    """Small against its page and in both sides; never where the page size is unknown."""
    page = F.nullif(page_width * page_height, F.lit(0.0))
    return F.coalesce((width * height / page < ratio) & (width < side) & (height < side), F.lit(False))


def clean_score(score: Column) -> Column:
    return F.when(~F.isnan(score), score)


def dense_pages(documents: DataFrame, scores: DataFrame) -> DataFrame:
    """A row for each page 1..page_count of each document; scores null where none are known."""
    pages = documents.where("page_count >= 1").select("document_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("page_count").cast("bigint"))).alias("page_number"))
    return pages.join(scores, ["document_id", "page_number"], "left")


def confidence(kind: Column, table: Column, layout: Column, parse: Column, mean: Column) -> Column:
    own = F.when(kind == "table", table).when(kind.isin("figure", "icon", "figure_caption"), layout).otherwise(parse)
    return F.coalesce(own, mean)


def heading_paths(elements: DataFrame) -> DataFrame:
    """Each element's heading path: a heading with text cuts the path to its level - 1 and adds itself, for all that follow.

    One shuffle: the elements of a document stream by in order, with the present path alone held.
    """
    elements = elements.drop("section_path")
    head = (F.col("element_type") == "heading") & (F.coalesce("text", F.lit("")) != "")
    keep = F.greatest(F.coalesce(F.nullif("level", F.lit(0)), F.lit(1)) - 1, F.lit(0)).cast("int")
    names, n = elements.columns, len(elements.columns)
    ordered = elements.withColumn("_keep", F.when(head, keep)).repartition("document_id").sortWithinPartitions("document_id", "seq")
    at, text = names.index("document_id"), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, path = None, []
        for batch in batches:
            documents, keeps = batch.column(at).to_pylist(), batch.column(n).to_pylist()
            texts, paths, places = batch.column(text), [path], []
            for i, (document, cut) in enumerate(zip(documents, keeps, strict=True)):
                if document != now:
                    now, path = document, []
                    paths.append(path)
                if cut is not None:
                    path = [*path[:cut], texts[i].as_py()]
                    paths.append(path)
                places.append(len(paths) - 1)
            own = pa.array(paths, pa.list_(pa.string())).take(pa.array(places, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], own], names=[*names, "section_path"])

    return ordered.mapInArrow(run, T.StructType([*elements.schema.fields, T.StructField("section_path", T.ArrayType(T.StringType()))]))


def icon_parents(elements: DataFrame) -> DataFrame:
    """Icons' parents: the last text element before on the page, else before in the document."""
    mine = F.when(F.col("element_type").isin(*TEXT_KINDS), F.col("element_id"))
    page = Window.partitionBy("document_id", "page_number").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    doc = Window.partitionBy("document_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.coalesce(F.last(mine, ignorenulls=True).over(page), F.last(mine, ignorenulls=True).over(doc))
    return elements.withColumn("parent_id", F.when(F.col("element_type") == "icon", parent))


def retag_captions(elements: DataFrame, captions: DataFrame) -> DataFrame:
    """Elements that an owner names as its caption become figure_caption with that parent; of several owners the last by seq.

    captions: document_id, owner_id, owner_seq, caption_id.
    """
    owner = captions.groupBy("document_id", F.col("caption_id").alias("element_id")).agg(F.max_by("owner_id", "owner_seq").alias("owner_id"))
    joined = elements.join(owner, ["document_id", "element_id"], "left")
    named = F.col("owner_id").isNotNull()
    columns = [F.when(named, F.lit("figure_caption")).otherwise(F.col(c)).alias(c) if c == "element_type" else F.coalesce("owner_id", c).alias(c) if c == "parent_id" else F.col(c) for c in elements.columns]
    return joined.select(*columns, *([] if "parent_id" in elements.columns else [F.col("owner_id").alias("parent_id")]))


def number(elements: DataFrame) -> DataFrame:
    """local_id 1..n in reading order within each document."""
    return elements.withColumn("local_id", F.row_number().over(Window.partitionBy("document_id").orderBy("seq")))
