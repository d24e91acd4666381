"""String functions with the reference semantics of Python strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """White space of any script off both ends."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def filled(c: Column) -> Column:
    """The string, or null where it is null or empty."""
    return F.nullif(c, F.lit(""))


def element_label(text: Column, kind: Column) -> Column:
    """Stripped text on one line, cut after 80 characters with '...'; '[kind]' where there is none."""
    flat = F.replace(strip(text), F.lit("\n"), F.lit(" "))
    short = F.concat(F.regexp_replace(F.substring(flat, 1, 80), "(?U)\\s+$", ""), F.lit("..."))
    return F.when(filled(text).isNull(), F.concat(F.lit("["), kind, F.lit("]"))).when(F.length(flat) > 80, short).otherwise(flat)


def splitlines(c: Column) -> Column:
    """Lines by any line separator; a last empty one does not count."""
    parts = F.split(c, "\\R|[\\x1c-\\x1e]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def csv_list(c: Column) -> Column:
    """Trimmed non-empty parts of a comma-separated string; null for a blank one."""
    parts = F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts)


def parse_uri(uri: Column) -> Column:
    """struct(scheme, bucket, key) of s3://bucket/key or file://key; anything else raises."""
    s3 = uri.rlike("^s3://[^/]+/.+")
    file = uri.rlike("^file://.+")
    bad = F.raise_error(F.concat(F.lit("not an object URI: "), uri)).cast("string")
    return F.struct(
        F.when(s3, F.lit("s3")).when(file, F.lit("file")).otherwise(bad).alias("scheme"),
        F.when(s3, F.regexp_extract(uri, "^s3://([^/]+)/(.+)$", 1)).alias("bucket"),
        F.when(s3, F.regexp_extract(uri, "^s3://([^/]+)/(.+)$", 2)).when(file, F.regexp_extract(uri, "^file://(.+)$", 1)).alias("key"),
    )


def page_object_key(document_id: Column, page_number: Column, suffix: str) -> Column:
    return F.concat(F.lit("documents/"), document_id.cast("string"), F.lit("/pages/"), page_number.cast("string"), F.lit("/" + suffix))


def source_object_key(document_id: Column) -> Column:
    return F.concat(F.lit("documents/"), document_id.cast("string"), F.lit("/source.pdf"))


def chunk_hash(chunk_type: Column, path: Column, text: Column, ids: Column) -> Column:
    """sha256 of type|path joined by >|text|ids joined by ,"""
    return F.sha2(F.concat_ws("|", chunk_type, F.array_join(path, ">"), F.coalesce(text, F.lit("")), F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")), 256)


def page_hash(text: Column, drawings: Column, images: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(text, F.lit("")), drawings.cast("string"), images.cast("string")), 256)


def element_hash(kind: Column, text: Column, path: Column, page: Column, method: Column) -> Column:
    """Equal content, equal hash; identities have no part in it."""
    return F.sha2(F.to_json(F.struct(kind.alias("a"), text.alias("b"), path.alias("c"), page.alias("d"), method.alias("e")), {"ignoreNullFields": "false"}), 256)


def strict_zip(*arrays: Column) -> Column:
    """arrays_zip of arrays of one length; an error where lengths differ."""
    sizes = [F.size(a) for a in arrays]
    same = F.array_min(F.array(*sizes)) == F.array_max(F.array(*sizes))
    said = F.concat(F.lit("arrays of different lengths: "), F.array_join(F.array(*[n.cast("string") for n in sizes]), ", "))
    return F.when(same, F.arrays_zip(*arrays)).otherwise(F.raise_error(said))
