"""The document structure graph: nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import element_label


def document_node(d: Column) -> Column:
    return F.concat(F.lit("document:"), d.cast("string"))


def page_node(d: Column, n: Column) -> Column:
    return F.concat(F.lit("page:"), d.cast("string"), F.lit(":"), n.cast("string"))


def section_node(d: Column, path: Column) -> Column:
    return F.concat(F.lit("section:"), d.cast("string"), F.lit(":"), F.to_json(path))


def element_node(i: Column) -> Column:
    return F.concat(F.lit("element:"), i.cast("string"))


def sections(elements: DataFrame) -> DataFrame:
    """document_id, path: every distinct prefix of a section path."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size("section_path")), lambda n: F.slice("section_path", F.lit(1), n))
    return elements.where(F.size("section_path") > 0).select("document_id", "section_path").distinct().select("document_id", F.explode(prefixes).alias("path")).distinct()


def section_order(elements: DataFrame) -> DataFrame:
    """document_id, path, place: sections numbered from 1 in the order in which a document first names them, upper ones first."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size("section_path")), lambda n: F.slice("section_path", F.lit(1), n))
    seen = elements.where(F.size("section_path") > 0).groupBy("document_id", "section_path").agg(F.min("seq").alias("seq"))
    first = seen.select("document_id", "seq", F.explode(prefixes).alias("path")).groupBy("document_id", "path").agg(F.min("seq").alias("seq"))
    return first.select("document_id", "path", F.row_number().over(Window.partitionBy("document_id").orderBy("seq", F.size("path"))).alias("place"))


def nodes(documents: DataFrame, elements: DataFrame) -> DataFrame:
    """node_id, node_type, label, document_id, page_number, element_type, element_id. documents: document_id, title, page_count."""
    text, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    row = lambda i, kind, label, page=number, element_type=text, element=number: (i.alias("node_id"), F.lit(kind).alias("node_type"), label.alias("label"), F.col("document_id"), page.cast("bigint").alias("page_number"), element_type.alias("element_type"), element.alias("element_id"))
    d = F.col("document_id")
    pages = numbered_pages(documents)
    parts = [
        documents.select(*row(document_node(d), "Document", F.col("title"))),
        pages.select(*row(page_node(d, F.col("page_number")), "Page", F.concat(F.lit("Page "), F.col("page_number").cast("string")), F.col("page_number"))),
        sections(elements).select(*row(section_node(d, F.col("path")), "Section", F.element_at("path", -1))),
        elements.select(*row(element_node(F.col("element_id")), "Element", element_label(F.col("text"), F.col("element_type")), F.col("page_number"), F.col("element_type"), F.col("element_id"))),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def numbered_pages(documents: DataFrame) -> DataFrame:
    return documents.where("page_count >= 1").select("document_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("page_count").cast("bigint"))).alias("page_number"))


def edges(documents: DataFrame, elements: DataFrame) -> DataFrame:
    """relation, from_node_id, to_node_id."""
    d = F.col("document_id")
    row = lambda kind, a, b: (F.lit(kind).alias("relation"), a.alias("from_node_id"), b.alias("to_node_id"))
    s = sections(elements)
    deep = F.size("path") > 1
    up = F.slice("path", F.lit(1), F.size("path") - 1)
    e = elements.join(documents.select("document_id", "page_count"), "document_id")
    own = F.when(F.size("section_path") > 0, section_node(d, F.col("section_path"))).when(F.col("page_number").between(1, F.col("page_count")), page_node(d, F.col("page_number")))
    child, parent = elements.alias("c"), elements.select("document_id", F.col("element_id").alias("pid"), F.col("seq").alias("pseq")).alias("p")
    family = child.where("parent_id is not null").join(parent, (F.col("c.document_id") == F.col("p.document_id")) & (F.col("c.parent_id") == F.col("p.pid")) & (F.col("p.pseq") < F.col("c.seq")))
    parts = [
        numbered_pages(documents).select(*row("HAS_PAGE", document_node(d), page_node(d, F.col("page_number")))),
        s.where(~deep).select(*row("HAS_SECTION", document_node(d), section_node(d, F.col("path")))),
        s.where(deep).select(*row("HAS_SUBSECTION", section_node(d, up), section_node(d, F.col("path")))),
        e.withColumn("own", own).where("own is not null").select(*row("CONTAINS_ELEMENT", F.col("own"), element_node(F.col("element_id")))),
        family.select(*row("HAS_CHILD", element_node(F.col("c.parent_id")), element_node(F.col("c.element_id")))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON object for each row."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))
