"""The whole ingest as one plan over all documents: no loop over documents, and only writes cut it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import cascade, chunking, kg, probe, structure
from ..sources import runs


@dataclass
class Ingested:
    pages: DataFrame
    tasks: DataFrame
    elements: DataFrame
    entities: DataFrame
    chunks: DataFrame
    #: All of it again, where each table goes through a function of its name and plan before later ones are derived from it.
    again: Callable[[Callable[[str, DataFrame], DataFrame]], Ingested]


def ingest(drafts: DataFrame, pages: DataFrame, results: DataFrame | None = None) -> Ingested:
    """Probe, plan, override, structure, candidates, chunks.

    drafts: element rows with level, confidence and the visual columns; pages: page facts
    with parse_score; results: cascade results (document_id, element_id, task_order,
    table_markdown, visual_text), if a cascade has run.
    """
    return derived(drafts, pages, results, lambda name, df: df)


def derived(drafts: DataFrame, pages: DataFrame, results: DataFrame | None, held: Callable[[str, DataFrame], DataFrame]) -> Ingested:
    probed = held("pages", probe.probe(pages))
    tasks = held("tasks", cascade.plan(drafts, probed))
    elements = drafts
    if results is not None:
        seen = cascade.override(drafts, results)
        elements = seen.withColumn("description", F.coalesce("visual_description", "description")).drop("visual_description")
    elements = held("elements", structure.icon_parents(structure.heading_paths(elements)))
    entities = held("entities", kg.agree(kg.exploded(kg.extract(elements))))
    chunks = held("chunks", chunking.all_chunks(chunking.build(elements), chunking.entity_chunks(kg.rollup(entities))))
    return Ingested(probed, tasks, elements, entities, chunks, lambda other: derived(drafts, pages, results, other))


def summary(x: Ingested) -> DataFrame:
    """document_id, n_elements, n_tasks, n_entities, n_chunks."""
    count = lambda df, name: df.groupBy("document_id").agg(F.count(F.lit(1)).alias(name))
    out = count(x.elements, "n_elements")
    for df, name in ((x.tasks, "n_tasks"), (x.entities, "n_entities"), (x.chunks, "n_chunks")):
        out = out.join(count(df, name), "document_id", "left").fillna(0, [name])
    return out


#: What is measured of each table as it is written.
MEASURES = {"pages": "parse_score", "tasks": None, "elements": "confidence", "entities": "confidence", "chunks": "length(content_text)"}


def write(x: Ingested, root: str) -> dict[str, dict]:
    """Write the tables below root and return for each n, least, mean and most of its measure, observed in the write's own scan. Later tables are derived from the written ones."""
    out = {}

    def written(name: str, rows: DataFrame) -> DataFrame:
        seen, measure = Observation(), MEASURES[name]
        m = F.expr(measure).cast("double") if measure else F.lit(None).cast("double")
        runs.write(rows.observe(seen, F.count(F.lit(1)).alias("n"), F.min(m).alias("least"), F.avg(m).alias("mean"), F.max(m).alias("most")), f"{root}/{name}")
        out[name] = seen.get
        return rows.sparkSession.read.schema(rows.schema).parquet(f"{root}/{name}")

    x.again(written)
    return out
