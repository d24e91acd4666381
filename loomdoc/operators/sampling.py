"""Page classes and a capped sample in two passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
PER_CATEGORY, PER_DOCUMENT, MIN_DRAWINGS, MIN_PAGE = 10, 3, 300, 50
TROUBLE = "troubleshooting|malfunction|error code|check code|symptom|abnormal"
PROCEDURE = "cause|remedy|countermeasure|corrective action"


def page_class(text: Column, page: Column, flags: Column, drawings: Column, has_table: Column, strict: bool, min_page: int = MIN_PAGE, min_drawings: int = MIN_DRAWINGS) -> Column:
    """The first class that fits, or null."""
    trouble = text.rlike("(?iU)" + TROUBLE)
    if strict:
        trouble = trouble & (page >= min_page) & text.rlike("(?iU)" + PROCEDURE)
    has = lambda f: F.array_contains(flags, f)
    plain = has("text_normal") & ~has("vector_diagram") & ~has("raster_image") & ~has("low_text_confidence")
    return F.when(trouble, "troubleshooting").when(has("vector_diagram") & (drawings >= min_drawings), "electrical_diagram").when(has("raster_image"), "screenshot_ui").when(plain & has_table, "table").when(plain, "text_normal")


def first_of(classed: DataFrame, quota: DataFrame | None, per_category: int, per_document: int) -> DataFrame:
    """Of each category the first pages by (document, page) under both caps.

    The cap of a document holds among pages in order; the category's cap then takes the
    first of what is left. quota: category, document_id, used (by document), total (by category).
    """
    doc = Window.partitionBy("category", "document_id").orderBy("page_number")
    cat = Window.partitionBy("category").orderBy("document_id", "page_number")
    if quota is None:
        classed = classed.withColumn("used", F.lit(0)).withColumn("total", F.lit(0))
    else:
        per_doc = quota.groupBy("category", "document_id").agg(F.count(F.lit(1)).alias("used"))
        per_cat = quota.groupBy("category").agg(F.count(F.lit(1)).alias("total"))
        classed = classed.join(per_doc, ["category", "document_id"], "left").join(per_cat, "category", "left").fillna(0, ["used", "total"])
    # the plain caps come first: they keep a few rows of each task before any shuffle by category
    kept = classed.withColumn("in_doc", F.row_number().over(doc)).where(F.col("in_doc") <= per_document).where(F.col("in_doc") + F.col("used") <= per_document)
    kept = kept.withColumn("in_cat", F.row_number().over(cat)).where(F.col("in_cat") <= per_category).where(F.col("in_cat") + F.col("total") <= per_category)
    return kept.select("category", "document_id", "page_number")


def sample(pages: DataFrame, per_category: int = PER_CATEGORY, per_document: int = PER_DOCUMENT, min_page: int = MIN_PAGE, min_drawings: int = MIN_DRAWINGS) -> DataFrame:
    """category, document_id, page_number, pass: a strict pass, then a relaxed one over the pages left.

    pages: document_id, page_number, text, flags, drawings, has_table.
    """
    of = lambda strict: page_class(F.col("text"), F.col("page_number"), F.col("flags"), F.col("drawings"), F.col("has_table"), strict, min_page, min_drawings)
    strict = first_of(pages.withColumn("category", of(True)).where("category is not null"), None, per_category, per_document)
    left = pages.join(strict, ["document_id", "page_number"], "left_anti").withColumn("category", of(False)).where("category is not null")
    relaxed = first_of(left, strict, per_category, per_document)
    return strict.withColumn("pass", F.lit("strict")).unionByName(relaxed.withColumn("pass", F.lit("relaxed")))
