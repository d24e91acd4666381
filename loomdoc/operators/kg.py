"""Knowledge-graph candidates: identifiers, keywords, connections, confidence tiers and agreement of sources.

One projection gives each element an array of candidates; one explode, one window and
one aggregation do the rest. The patterns run over Arrow batches, each text read once for
all of them, with Unicode classes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schemas import ENTITY

#: Patterns, keywords and confidences. Fixed values.
SENSOR_TH = r"\bTH[\s-]?\d{1,3}\b"
SENSOR_RT = r"\bR[\s-]?\d{1,2}T\b"
CONNECTOR = r"\bCN[\s-]?\d{2,4}\b"
TERMINAL = r"\bX[\s-]?\d{1,2}M\b"
ERROR_MAIN = r"\b([PEULFHACJ](?:\d{1,3}|[AHJ]))\b"
ERROR_SUB = r"\b([PEULFHACJ](?:\d{1,3}|[AHJ]))\s*-\s*(\d{1,2})\b"
ANCHOR = r"\b(?:error code|check code|malfunction|abnormal)\b"
CONNECTION = r"\s*(?:->|-{1,2}>|\bto\b)\s*"
KEYWORDS = {
    "compressor": "Component", "condenser": "Component", "evaporator": "Component", "expansion valve": "Component", "solenoid valve": "Component", "fan motor": "Component",
    "accumulator": "Component", "four-way valve": "Component", "four way valve": "Component", "reversing valve": "Component", "check valve": "Component", "strainer": "Component",
    "muffler": "Component", "oil separator": "Component", "pcb": "PCB", "printed circuit board": "PCB", "inverter pcb": "PCB", "thermistor": "Sensor", "pressure sensor": "Sensor",
    "pressure switch": "Sensor", "high pressure switch": "Sensor", "low pressure switch": "Sensor", "terminal block": "Terminal",
}
GLOSSARY_OVER = 5
CONFIDENCE = {"keyword": 0.5, "glossary": 0.2, "identifier": 0.7, "error_table": 0.75, "error_anchored": 0.6, "error": 0.3, "vlm_component": 0.6, "vlm_connection": 0.5}

#: What the patterns find: the fields of a candidate that its text alone gives.
FOUND = "name string, entity_type string, confidence double, extraction_method string, justification_span array<int>, context_anchor_matched boolean"


class Words:
    """A dictionary of keywords and their entity types, and its stamp: equal dictionaries have equal stamps."""

    def __init__(self, types: dict[str, str]):
        self.types = dict(types)
        self.patterns = {k: re.compile(rf"\b{k}\b", re.IGNORECASE) for k in self.types}
        self.some = re.compile("|".join(self.types) or "(?!)", re.IGNORECASE)
        #: Where all keywords are plain, an ASCII text in lower case tells which of them can match.
        self.plain = all(re.fullmatch("[a-z0-9 -]+", k) for k in self.types)
        rules = [PATTERNS_VERSION, *sorted(f"{k}={t}" for k, t in self.types.items())]
        self.stamp = hashlib.sha256("\n".join(rules).encode()).hexdigest()

    def first_matches(self, text: str) -> list[tuple[str, re.Match]]:
        """Each keyword that the text has, and where it has it first."""
        if self.plain and text.isascii():
            low = text.lower()
            return [(k, m) for k, p in self.patterns.items() if k in low and (m := p.search(text))]
        return [(k, m) for k, p in self.patterns.items() if (m := p.search(text))] if self.some.search(text) else []

    def changed(self, before: Words) -> list[str]:
        """The keywords that one of two dictionaries has and the other has not, or has as another type."""
        return sorted(k for k in {*self.types, *before.types} if self.types.get(k) != before.types.get(k))


#: Goes up when a pattern or a confidence changes: all elements are then stale.
PATTERNS_VERSION = "1"
WORDS = Words(KEYWORDS)
#: With what each match holds for certain: texts without it need not be matched.
_IDENTIFIERS = tuple(
    (re.compile(pattern), kind, method, parts)
    for pattern, kind, method, parts in (
        (SENSOR_TH, "Sensor", "regex_sensor_id", ("TH",)), (SENSOR_RT, "Sensor", "regex_sensor_id_daikin", ("R", "T")), (CONNECTOR, "Connector", "regex_connector_id", ("CN",)), (TERMINAL, "Terminal", "regex_terminal_id", ("X", "M")),
    )
)
#: What every main code begins with.
_CODE = re.compile(r"[PEULFHACJ][\dAHJ]")
_ANCHORS = re.findall(r"[a-z ]{2,}", ANCHOR)
_ANCHOR, _MAIN, _SUB = re.compile(ANCHOR, re.IGNORECASE), re.compile(ERROR_MAIN), re.compile(ERROR_SUB)


def anchored(text: str) -> bool:
    if text.isascii() and not any(a in text.lower() for a in _ANCHORS):
        return False
    return bool(_ANCHOR.search(text))


def found_in(text: str | None, kind: str | None, path: list | None, vlm: bool, words: Words = WORDS) -> Iterator[tuple]:
    """The candidates of one text in emission order: keywords, TH, R#T, CN, X#M, main codes, sub-codes. VLM texts have no spans.

    A keyword's name is the dictionary's spelling, its span that of its first match.
    """
    if not text:
        return
    suffix = "_vlm_description" if vlm else ""

    def span(m: re.Match) -> list[int] | None:
        return None if vlm else [m.start(), m.end()]

    hits = words.first_matches(text)
    base = CONFIDENCE["glossary" if len(hits) > GLOSSARY_OVER else "keyword"]
    for k, m in hits:
        yield k, words.types[k], base, "dict_keyword" + suffix, span(m), None
    for pattern, entity_type, method, parts in _IDENTIFIERS:
        if not all(part in text for part in parts):
            continue
        for m in pattern.finditer(text):
            yield m[0], entity_type, CONFIDENCE["identifier"], method + suffix, span(m), None
    codes = list(_MAIN.finditer(text)) if _CODE.search(text) else []
    if codes:
        anchor = anchored(" ".join((text, *(path or ()))))
        tier = CONFIDENCE["error" if not anchor else "error_table" if kind == "table" else "error_anchored"]
        for m in codes:
            yield m[1], "ErrorCode", tier, "regex_error_code" + suffix, span(m), anchor
        for m in _SUB.finditer(text):
            yield f"{m[1]}-{m[2]}", "ErrorCode", tier, "regex_error_code_subcode" + suffix, span(m), anchor


def found_type() -> pa.DataType:
    return pa.list_(pa.struct([("name", pa.string()), ("entity_type", pa.string()), ("confidence", pa.float64()), ("extraction_method", pa.string()), ("justification_span", pa.list_(pa.int32())), ("context_anchor_matched", pa.bool_())]))


def finder(words: Words) -> Callable[..., pa.Array]:
    """The candidates of a column of texts, as columns."""

    def find_all(kinds: pa.Array, texts: pa.Array, descriptions: pa.Array, paths: pa.Array) -> pa.Array:
        ends, rows = [0], []
        for k, t, d, p in zip(*(c.to_pylist() for c in (kinds, texts, descriptions, paths)), strict=True):
            rows += found_in(d, k, p, True, words)
            rows += found_in(t, k, p, False, words)
            ends.append(len(rows))
        fields = list(found_type().value_type)
        columns = zip(*rows, strict=True) if rows else [()] * len(fields)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields))

    return find_all


def connections(listed: Column) -> Column:
    """array of (subject, object) of connection strings; those with an empty side are dropped."""
    parts = F.transform(listed, lambda c: F.split(c, "(?iU)" + CONNECTION, 2))
    pairs = F.transform(F.filter(parts, lambda p: F.size(p) == 2), lambda p: F.struct(strip(F.get(p, F.lit(0))).alias("subject"), strip(F.get(p, F.lit(1))).alias("object")))
    return F.filter(pairs, lambda p: (p["subject"] != "") & (p["object"] != ""))


def extract(elements: DataFrame, words: Words = WORDS) -> DataFrame:
    """Elements with entities and relations (arrays, empty where there are none); candidates() leaves out elements with neither.

    Visual candidates come first. elements: document_id, element_id, page_number,
    element_type, text, section_path, components, connections, description.
    """
    empty = F.array().cast("array<string>")
    none, element, page = F.lit(None), F.col("element_id").cast("bigint"), F.col("page_number").cast("bigint")
    # made here, not at import: workers import this module without a session
    found = F.arrow_udf(finder(words), f"array<struct<{FOUND.replace(' ', ':').replace(',:', ',')}>>")
    found = found(F.col("element_type"), F.col("text"), F.col("description"), F.coalesce("section_path", empty))

    def whole(name: Column, kind: Column, confidence: Column, method: Column, span: Column, anchor: Column) -> Column:
        return F.struct(
            name.alias("name"), kind.alias("entity_type"), confidence.cast("double").alias("confidence"), element.alias("element_id"), page.alias("page"), method.alias("extraction_method"),
            span.cast("array<int>").alias("justification_span"), anchor.cast("boolean").alias("context_anchor_matched"), F.lit(False).alias("cross_source_corroborated"), F.lit(0).cast("bigint").alias("corroboration_count"),
        )

    parts = F.transform(F.coalesce("components", empty), lambda c: whole(c, F.lit("Component"), F.lit(CONFIDENCE["vlm_component"]), F.lit("vlm_component"), none, none))
    texts = F.transform(F.col("_found"), lambda x: whole(x["name"], x["entity_type"], x["confidence"], x["extraction_method"], x["justification_span"], x["context_anchor_matched"]))
    relations = F.transform(
        connections(F.coalesce("connections", empty)),
        lambda p: F.struct(p["subject"].alias("subject"), F.lit("CONNECTED_TO").alias("predicate"), p["object"].alias("object"), F.lit(CONFIDENCE["vlm_connection"]).alias("confidence"), element.alias("element_id"), page.alias("page"), F.lit("vlm_connection").alias("extraction_method")),
    )
    rows = elements.withColumn("_found", found)
    return rows.withColumn("entities", F.concat(parts, texts).cast(f"array<{ENTITY}>")).withColumn("relations", relations).drop("_found")


def candidates(extracted: DataFrame) -> DataFrame:
    return extracted.where((F.size("entities") > 0) | (F.size("relations") > 0))


def is_vlm(method: Column) -> Column:
    return method.startswith("vlm_") | method.endswith("_vlm_description")


def exploded(extracted: DataFrame) -> DataFrame:
    """document_id and the fields of each entity, in order."""
    # the outer form: else a filter on the array's size is derived and evaluates all patterns once more
    return extracted.select("document_id", F.posexplode_outer("entities").alias("no", "e")).where("no is not null").select("document_id", "no", "e.*")


def agree(entities: DataFrame) -> DataFrame:
    """Entities with the number of same-named ones of the other mechanism on their page."""
    same = Window.partitionBy("document_id", "page", "entity_type", F.lower(strip(F.col("name"))))
    vlm = is_vlm(F.col("extraction_method"))
    seen, read = F.sum(vlm.cast("bigint")).over(same), F.sum((~vlm).cast("bigint")).over(same)
    other = F.when(vlm, read).otherwise(seen)
    return entities.withColumn("corroboration_count", other).withColumn("cross_source_corroborated", F.col("corroboration_count") > 0)


def regroup(elements: DataFrame, entities: DataFrame, extracted: DataFrame) -> DataFrame:
    """Every element with its candidates, full replacement: empty arrays where there are none."""
    fields = [c for c in entities.columns if c not in ("document_id", "no")]
    grouped = entities.groupBy("document_id", "element_id").agg(F.array_sort(F.collect_list(F.struct("no", F.struct(*fields).alias("e")))).alias("x")).select("document_id", "element_id", F.transform("x", lambda x: x["e"]).alias("kg_candidate_entities"))
    rel = extracted.select("document_id", "element_id", F.col("relations").alias("kg_candidate_relations"))
    return elements.join(grouped, ["document_id", "element_id"], "left").join(rel, ["document_id", "element_id"], "left")


def reextract_summary(extracted: DataFrame, elements: DataFrame) -> DataFrame:
    """n_elements, n_with_candidates, n_entities, n_relations by document."""
    n = elements.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_elements"))
    either = (F.size("entities") > 0) | (F.size("relations") > 0)
    c = extracted.groupBy("document_id").agg(F.count_if(either).alias("w"), F.sum(F.size("entities")).alias("e"), F.sum(F.size("relations")).alias("r"))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("bigint")
    return n.join(c, "document_id", "left").select("document_id", "n_elements", zero("w").alias("n_with_candidates"), zero("e").alias("n_entities"), zero("r").alias("n_relations"))


def rollup(entities: DataFrame) -> DataFrame:
    """One row for each (document, name, type): counts, pages, elements, best confidence and the chunk text."""
    g = entities.groupBy("document_id", "name", "entity_type").agg(
        F.count(F.lit(1)).alias("occurrences"), F.array_sort(F.collect_set("page")).alias("pages"), F.array_sort(F.collect_set("element_id")).alias("element_ids"), F.max("confidence").alias("confidence")
    )
    pages = F.array_join(F.transform("pages", lambda p: p.cast("string")), ", ")
    return g.withColumn("content_text", F.concat("name", F.lit(" ("), "entity_type", F.lit(") — referenced on page(s) "), pages, F.lit("."))).withColumn("page_start", F.element_at("pages", 1)).withColumn("page_end", F.element_at("pages", -1))


def stale(stored: DataFrame, words: Words, known: list[Words]) -> Column:
    """Whether an element's stored candidates may differ under words: those without a stamp or with an unknown one, and those in whose text or description a changed keyword stands. stored: text, description, kg_stamp; known: the dictionaries of earlier runs."""
    flag = ~F.coalesce(F.col("kg_stamp").isin(words.stamp, *(w.stamp for w in known)), F.lit(False))
    for before in known:
        if changed := words.changed(before):
            pattern = "(?iU)\\b(?:" + "|".join(changed) + ")\\b"
            hit = F.coalesce(F.col("text").rlike(pattern), F.lit(False)) | F.coalesce(F.col("description").rlike(pattern), F.lit(False))
            flag |= (F.col("kg_stamp") == before.stamp) & hit
    return F.coalesce(flag, F.lit(True))


def reextract(stored: DataFrame, words: Words, known: list[Words]) -> DataFrame:
    """stored with the candidates of stale elements made anew and `extracted` telling which; all others keep theirs, and take the new stamp. stored: what extract() takes, with entities, relations and kg_stamp."""
    rows = stored.withColumn("_stale", stale(stored, words, known))
    kept = rows.where(~F.col("_stale")).drop("_stale").withColumn("extracted", F.lit(False))
    again = extract(rows.where("_stale").drop("_stale", "entities", "relations"), words).withColumn("extracted", F.lit(True))
    return kept.unionByName(again).withColumn("kg_stamp", F.lit(words.stamp))
