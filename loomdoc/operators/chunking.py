"""Hierarchical chunks: an ordered fold over a document's elements, and entity chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import chunk_hash
from ..schemas import CHUNK, STEPS
from ..sources import runs
from . import tables

SOFT_LIMIT = 2000
TEXT_KINDS = frozenset(("paragraph", "heading", "warning", "note"))
ATTACHED = frozenset(("icon", "figure_caption"))


@dataclass
class Chunk:
    kind: str
    path: tuple
    page: int
    parts: list = field(default_factory=list)
    size: int = 0
    ids: list = field(default_factory=list)
    end: int = 0
    steps: list = field(default_factory=list)
    own_text: str | None = None
    image_uri: str | None = None
    description: str | None = None

    def begin(self, text: str) -> None:
        """The text of a chunk that stands alone, as it is."""
        self.parts = [text] if text else []

    def add(self, element_id: int, page: int, text: str | None) -> None:
        """One element more; white space goes from both ends of what has gathered, at every step."""
        if text:
            if len(self.parts) == 1:
                self.parts = [self.parts[0].strip()] if self.parts[0].strip() else []
            more = text.rstrip() if self.parts else text.strip()
            if more:
                self.size += len(more) + bool(self.parts)
                self.parts.append(more)
        self.ids.append(element_id)
        self.end = page

    @property
    def text(self) -> str:
        return "\n".join(self.parts)


def fold(rows: list[dict]) -> list[Chunk]:
    """The chunks of one document's elements in reading order.

    Icons and captions join their parent's chunk and change nothing else. Tables and
    figures stand alone and close what is open. Lists gather into procedures, text kinds
    into text chunks of one section path until they have SOFT_LIMIT characters; each
    closes the other. Any other kind stands alone and closes nothing.
    """
    chunks: list[Chunk] = []
    home: dict[int, Chunk] = {}
    text: Chunk | None = None
    procedure: Chunk | None = None

    def begin(kind: str, path: tuple, page: int) -> Chunk:
        chunks.append(Chunk(kind, path, page))
        return chunks[-1]

    for r in rows:
        kind, path, page, own = r["element_type"], tuple(r["section_path"]), r["page_number"], r["text"]
        if kind in ATTACHED and r["parent_id"] in home:
            chunk = home[r["parent_id"]]
        elif kind in ("table", "figure"):
            # alone in its chunk, so its text stays as it is
            chunk, text, procedure = begin(kind, path, page), None, None
            chunk.begin(own or (r["description"] if kind == "figure" else "") or "")
            chunk.own_text, chunk.image_uri, chunk.description = own, r.get("image_uri"), r["description"]
            own = None
        elif kind == "list":
            if procedure is None or procedure.path != path:
                procedure = begin("procedure", path, page)
            chunk, text = procedure, None
            chunk.steps.append({"step_number": len(chunk.steps) + 1, "step_text": own or "", "element_id": r["element_id"]})
        elif kind in TEXT_KINDS:
            if text is None or text.path != path or text.size >= SOFT_LIMIT:
                text = begin("text", path, page)
            chunk, procedure = text, None
        else:
            chunk = begin("text", path, page)
        chunk.add(r["element_id"], page, own)
        home[r["element_id"]] = chunk
    return chunks


NEEDED = ("document_id", "element_id", "seq", "element_type", "text", "page_number", "section_path", "parent_id", "description")
BUCKETS = 256


def build(elements: DataFrame) -> DataFrame:
    """Structural chunks of every document. Elements stream by in order; one document's (a manual has some thousand) are held at a time."""
    schema = to_arrow_schema(T.StructType.fromDDL(CHUNK))

    def made(document: int, rows: list[dict]) -> list[tuple]:
        return [(document, i, c.kind, list(c.path), c.page, c.end, c.text, c.ids, len(c.steps), c.steps, c.own_text, c.image_uri, c.description) for i, c in enumerate(fold(rows))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        for batch in batches:
            names = batch.schema.names
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = dict(zip(names, values, strict=True))
                if r["document_id"] != now:
                    out += made(now, rows) if rows else []
                    now, rows = r["document_id"], []
                    if len(out) > 2000:
                        yield to_batch(out, schema)
                        out = []
                rows.append(r)
        out += made(now, rows) if rows else []
        if out:
            yield to_batch(out, schema)

    image = F.col("image_uri") if "image_uri" in elements.columns else F.lit(None).cast("string")
    ordered = elements.select(*NEEDED, image.alias("image_uri")).repartition("document_id").sortWithinPartitions("document_id", "seq")
    return ordered.mapInArrow(run, CHUNK)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def hashed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("content_hash", chunk_hash(F.col("chunk_type"), F.col("section_path"), F.col("content_text"), F.col("element_ids")))


def with_content(chunks: DataFrame) -> DataFrame:
    """chunks with content_structured: a table's text and rows, a figure's image and description, a procedure's steps; null for other kinds."""
    kind, table = F.col("chunk_type"), F.when(F.col("chunk_type") == "table", F.col("own_text"))
    content = F.struct(
        table.alias("markdown"), F.when(kind == "table", tables.parsed(table)).alias("rows"), F.when(kind == "figure", F.col("image_uri")).alias("image_uri"),
        F.when(kind == "figure", F.col("description")).alias("description"), F.when(kind == "procedure", F.col("steps")).alias("steps"),
    )
    return chunks.withColumn("content_structured", F.when(kind.isin("table", "figure", "procedure"), content)).drop("own_text", "image_uri", "description", "steps")


def steps(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """document_id, chunk_no, step_number, element_id, step_text of procedure chunks; attached elements are no steps."""
    ids = chunks.where(F.col("chunk_type") == "procedure").select("document_id", "chunk_no", F.posexplode("element_ids").alias("at", "element_id"))
    listed = elements.where(F.col("element_type") == "list").select("document_id", "element_id", F.coalesce("text", F.lit("")).alias("step_text"))
    number = F.row_number().over(Window.partitionBy("document_id", "chunk_no").orderBy("at"))
    return ids.join(listed, ["document_id", "element_id"]).withColumn("step_number", number).select("document_id", "chunk_no", "step_number", "element_id", "step_text")


def entity_chunks(rolled: DataFrame) -> DataFrame:
    """Chunks of rolled-up entities, numbered by (name, type) within their document."""
    no = F.row_number().over(Window.partitionBy("document_id").orderBy("name", "entity_type")) - 1
    return rolled.select("document_id", no.cast("int").alias("chunk_no"), F.lit("entity").alias("chunk_type"), F.array().cast("array<string>").alias("section_path"), "page_start", "page_end", "content_text", "element_ids", F.lit(0).alias("n_steps"), F.lit(None).cast(STEPS).alias("steps"), *[F.lit(None).cast("string").alias(c) for c in ("own_text", "image_uri", "description")])


def all_chunks(structural: DataFrame, entity: DataFrame) -> DataFrame:
    """Structural chunks first, then entity chunks."""
    return structural.withColumn("part", F.lit(0)).unionByName(entity.withColumn("part", F.lit(1)))


def store(chunks: DataFrame, path: str) -> None:
    """Replace the chunks of the documents in `chunks`, leaving other documents' as they are. Documents lie in BUCKETS folders by a hash; folders that change are written anew."""
    spark = chunks.sparkSession
    bucket = F.pmod(F.xxhash64("document_id"), F.lit(BUCKETS)).cast("int")
    out = hashed(with_content(chunks)).withColumn("embedding_status", F.lit("pending")).withColumn("vector_id", F.lit(None).cast("string")).withColumn("bucket", bucket)
    aside = None
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as e:  # the first store finds no table
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        touched = out.select("bucket").distinct()
        kept = stored.join(F.broadcast(touched), "bucket", "left_semi").join(out.select("document_id").distinct(), "document_id", "left_anti")  # BUCKETS rows at most
        # a folder cannot be read while it is written: what stays is kept aside first, in a folder of this call's own
        aside = runs.workspace(spark, "chunks-kept")
        runs.write(kept, aside)
        out = out.unionByName(spark.read.schema(stored.schema).parquet(aside).select(*out.columns))
    # a folder's rows are written by one task, so that few files come of it
    out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    if aside:
        runs.remove(spark, aside)
