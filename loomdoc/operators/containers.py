"""Container chunks: what stands above a document's chunks in its tree of sections, under a budget of size.

Sizes go up the tree, each chunk adding to every section on its path. A section whose whole text fits the budget is a
container of it; the widest fitting sections are returned to a reader who finds one of their chunks, so that context
grows to what still fits and no further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUDGET = 8000


def ancestors(path: str) -> Column:
    """The sections on a path, the root's first, down to the path itself."""
    return F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.slice(path, F.lit(1), n))


def sections(chunks: DataFrame, budget: int = BUDGET) -> DataFrame:
    """document_id, section_path, parent_path (null at the root), level, n_chunks, n_chars, fits: every section with the chunks of its whole subtree. Chunks without a path stand in none."""
    own = chunks.where(F.size("section_path") > 0).select("document_id", F.length("content_text").alias("size"), F.explode(ancestors("section_path")).alias("section_path"))
    rows = own.groupBy("document_id", "section_path").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("size").alias("n_chars"))
    level = F.size("section_path")
    parent = F.when(level > 1, F.slice("section_path", F.lit(1), level - 1))
    return rows.select("document_id", "section_path", parent.alias("parent_path"), level.alias("level"), "n_chunks", "n_chars", (F.col("n_chars") <= budget).alias("fits"))


def assigned(chunks: DataFrame, tree: DataFrame) -> DataFrame:
    """document_id, chunk_no, container_path: the widest section around each chunk that fits; null where none does. A section within one that fits always fits."""
    own = chunks.select("document_id", "chunk_no", F.explode_outer(ancestors_or_none("section_path")).alias("section_path"))
    fit = tree.where("fits").select("document_id", "section_path", "level")
    found = own.join(fit, ["document_id", "section_path"], "left")
    return found.groupBy("document_id", "chunk_no").agg(F.min_by("section_path", "level").alias("container_path"))


def ancestors_or_none(path: str) -> Column:
    return F.when(F.size(path) > 0, ancestors(path))


def containers(chunks: DataFrame, tree: DataFrame) -> DataFrame:
    """document_id, section_path, chunk_nos, content_text of the widest sections that fit: BUDGET bounds each."""
    own = assigned(chunks, tree).where("container_path is not null").join(chunks.select("document_id", "chunk_no", "content_text"), ["document_id", "chunk_no"])
    g = own.groupBy("document_id", F.col("container_path").alias("section_path")).agg(F.array_sort(F.collect_list(F.struct("chunk_no", "content_text"))).alias("x"))
    return g.select("document_id", "section_path", F.transform("x", lambda c: c["chunk_no"]).alias("chunk_nos"), F.array_join(F.transform("x", lambda c: c["content_text"]), "\n").alias("content_text"))
