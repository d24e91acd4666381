"""The cascade: which elements and pages need a costly second reading, and what it overrides."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled
from ..schemas import TASK_TYPES

TABLE_THRESHOLD, TEXT_THRESHOLD = 0.90, 0.60


def below(score: Column, threshold: float) -> Column:
    """Strictly below, or unknown."""
    return F.coalesce(score < threshold, F.lit(True))


def shown(score: Column) -> Column:
    return F.when(score.isNotNull(), F.format_string("%.4f", score)).otherwise(F.lit("None"))


def plan(elements: DataFrame, probed: DataFrame, table_threshold: float = TABLE_THRESHOLD, text_threshold: float = TEXT_THRESHOLD) -> DataFrame:
    """document_id, task_type, page_number, element_id, reason."""
    tables = elements.where((F.col("element_type") == "table") & below(F.col("confidence"), table_threshold)).select(
        "document_id", F.lit("table_reparse").alias("task_type"), "page_number", "element_id",
        F.concat(F.lit("table_score "), shown(F.col("confidence")), F.lit(f" < {table_threshold:.4f}")).alias("reason"),
    )
    wanted = F.filter(F.array(F.lit("vector_diagram"), F.lit("raster_image")), lambda x: F.array_contains(F.col("flags"), x))
    regions = (
        elements.where(F.col("element_type").isin("figure", "icon")).join(probed.select("document_id", "page_number", "flags"), ["document_id", "page_number"])
        .where(F.size(wanted) > 0)
        .select("document_id", F.lit("visual_description").alias("task_type"), "page_number", "element_id", F.concat(F.lit("page flags: "), F.array_join(wanted, ", ")).alias("reason"))
    )
    pages = probed.where(below(F.col("parse_score"), text_threshold)).select(
        "document_id", F.lit("full_page_ocr").alias("task_type"), "page_number", F.lit(None).cast("bigint").alias("element_id"),
        F.concat(F.lit("parse_score "), shown(F.col("parse_score")), F.lit(f" < {text_threshold:.4f}")).alias("reason"),
    )
    return tables.unionByName(regions).unionByName(pages)


def of_type(tasks: DataFrame, task_type: str) -> DataFrame:
    return tasks.where(F.col("task_type") == task_type)


def first_tasks(tasks: DataFrame, n: int) -> DataFrame:
    """The first n tasks in the order of the plan: by document, kind (tables, regions, pages), page and element."""
    kind = F.array_position(F.array(*[F.lit(t) for t in TASK_TYPES]), F.col("task_type"))
    return tasks.orderBy("document_id", kind, "page_number", "element_id").limit(n)


def task_counts(tasks: DataFrame) -> DataFrame:
    counted = tasks.groupBy("task_type").count()
    names = tasks.sparkSession.createDataFrame([(t,) for t in TASK_TYPES], "task_type string")
    return names.join(counted, "task_type", "left").select("task_type", F.coalesce("count", F.lit(0)).cast("bigint").alias("n"))


def latest_results(results: DataFrame) -> DataFrame:
    """One result for each element: the last by task_order."""
    last = F.max_by(F.struct(*[c for c in results.columns if c not in ("document_id", "element_id")]), "task_order").alias("r")
    return results.where("element_id is not null").groupBy("document_id", "element_id").agg(last).select("document_id", "element_id", "r.*")


def override(elements: DataFrame, results: DataFrame) -> DataFrame:
    """Elements with the last result written over text and method; of two kinds of result the visual one names the method."""
    r = latest_results(results)
    joined = elements.join(r, ["document_id", "element_id"], "left")
    table, visual = F.col("table_markdown").isNotNull(), F.col("visual_text").isNotNull()
    return joined.select(
        *[F.coalesce(filled(F.col("table_markdown")), F.col("text")).alias("text") if c == "text" else F.col(c) for c in elements.columns],
        F.when(visual, F.lit("paddle_vlm")).when(table, F.lit("docling+paddle_table")).otherwise(F.lit("docling")).alias("extraction_method"),
        F.col("visual_text").alias("visual_description"),
    )


def crop_rectangle(bbox: Column, page_height: Column, dpi: int = 200) -> Column:
    """The pixel rectangle of a bottom-left box on a page, top-left origin; null (the full page) without a box."""
    zoom = dpi / 72
    return F.when(bbox.isNotNull(), F.struct((bbox["l"] * zoom).alias("x0"), ((page_height - bbox["t"]) * zoom).alias("y0"), (bbox["r"] * zoom).alias("x1"), ((page_height - bbox["b"]) * zoom).alias("y1")))


def run_tasks(tasks: DataFrame, elements: DataFrame, make_client: Callable[[], object], retries: int = 1, pages: DataFrame | None = None) -> DataFrame:
    """Execute tasks with a client made once for each Python worker batch stream.

    A row has the task, the element's text and, where elements have a bbox and pages
    (document_id, page_number, height) are given, its crop rectangle; no crop is the full page.

    The client has describe_figure(row), reparse_table(row) and ocr_page(row), each
    returning text. ConnectionError and TimeoutError are tried again up to `retries`
    times; other errors end the job. Unknown task types give no row.
    """
    boxed = pages is not None and "bbox" in elements.columns
    rows = tasks.join(elements.select("document_id", "element_id", "text", *(["bbox"] if boxed else [])), ["document_id", "element_id"], "left")
    if boxed:
        rows = rows.join(pages.select("document_id", "page_number", F.col("height").alias("_height")), ["document_id", "page_number"], "left")
        rows = rows.withColumn("crop", crop_rectangle(F.col("bbox"), F.col("_height"))).drop("bbox", "_height")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        by_type = {"visual_description": client.describe_figure, "table_reparse": client.reparse_table, "full_page_ocr": client.ocr_page}
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                call = by_type.get(row["task_type"])
                if call is None:
                    continue
                for attempt in range(retries + 1):
                    try:
                        out.append((row["document_id"], row["element_id"], row["page_number"], row["task_type"], call(row) or ""))
                        break
                    except (ConnectionError, TimeoutError):
                        if attempt == retries:
                            raise
            frame = pd.DataFrame(out, columns=["document_id", "element_id", "page_number", "task_type", "result"])
            frame["element_id"] = frame["element_id"].astype("Int64")
            yield frame

    return rows.mapInPandas(run, "document_id bigint, element_id bigint, page_number bigint, task_type string, result string")


def parse_response(body: Column) -> Column:
    """A describe/reparse/ocr JSON response with its defaults: empty lists and strings."""
    r = F.from_json(body, "figure_type string, components array<string>, connections array<string>, description string, markdown string, text string")
    empty = F.array().cast("array<string>")
    return F.struct(
        r["figure_type"].alias("figure_type"), F.coalesce(r["components"], empty).alias("components"), F.coalesce(r["connections"], empty).alias("connections"),
        F.coalesce(r["description"], F.lit("")).alias("description"), F.coalesce(r["markdown"], F.lit("")).alias("markdown"), F.coalesce(r["text"], F.lit("")).alias("text"),
    )


def markdown_text(prediction: Column) -> Column:
    """The text of a prediction in JSON: markdown itself where it is a string; else the first of markdown.markdown_texts, markdown.text and text that is not empty."""
    kind = F.get_json_object(prediction, "$.markdown")
    plain = F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json(prediction), "$.markdown", "variant")) == "STRING", kind)
    return F.coalesce(
        plain, filled(F.get_json_object(prediction, "$.markdown.markdown_texts")), filled(F.get_json_object(prediction, "$.markdown.text")),
        filled(F.get_json_object(prediction, "$.text")), F.lit(""),
    )
