"""The canonical store on files: a row for each page with its elements nested in it, so that a page and its elements change in one write.

Pages lie in buckets by a hash of their document. A run writes anew the buckets in which a page
is new or has another hash, and no others; each bucket is read from the last complete run
that holds it. Until a run is complete, readers see the old buckets; a killed run leaves nothing
that is read, and the same call again finds the same changes. A run without changes writes nothing.

    <root>/pages-<buckets>/run=<n>/bucket=<b>/*.parquet

One writer at a time, as in a transaction that holds the document. Readers that have begun keep their
files until vacuum().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import runs
from . import store

KEYS = ("document_id", "page_number")
ID = "id"


class CanonicalStore:
    """Pages and elements below one root on any storage that Spark writes."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256):
        self.spark, self.buckets = spark, buckets
        self.root = f"{root.rstrip('/')}/pages-{buckets}"

    def bucket(self, document_id: str = "document_id") -> Column:
        return F.pmod(F.xxhash64(F.col(document_id).cast("bigint")), F.lit(self.buckets)).cast("int")

    def current(self) -> dict[int, str]:
        """bucket -> folder, of the last complete run that holds it."""
        out: dict[int, str] = {}
        for path in runs.complete(self.spark, self.root, "run").values():
            out |= runs.folders(self.spark, path, "bucket")
        return out

    def pages(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The stored pages with their elements, stored_run and bucket; of some buckets only; None before the first run."""
        own = {b: p for b, p in self.current().items() if buckets is None or b in buckets}
        if not own:
            return None
        # folders of several runs: their names do not make one partitioned table, so the bucket is computed
        return self.spark.read.parquet(*own.values()).withColumn("bucket", self.bucket())

    def document(self, document_id: int) -> DataFrame | None:
        """A document's pages, from its bucket alone."""
        number = self.spark.range(1).select(F.lit(document_id).cast("bigint").alias("document_id")).select(self.bucket()).first()[0]
        own = self.pages([number])
        return own and own.where(F.col("document_id") == document_id)

    def elements(self) -> DataFrame | None:
        """A row for each stored element, with its page's keys and run."""
        pages = self.pages()
        return pages and pages.select(*KEYS, "stored_run", F.explode("elements").alias("e")).select(*KEYS, "stored_run", "e.*")

    def nested(self, pages: DataFrame, elements: DataFrame) -> DataFrame:
        """pages with elements, an array of the element rows of each page in the order of their ids."""
        own = [c for c in elements.columns if c not in KEYS]
        e = elements.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(ID, *[c for c in own if c != ID]))).alias("elements"))
        return pages.join(e, list(KEYS), "left").withColumn("elements", F.coalesce("elements", F.array().cast(e.schema["elements"].dataType)))

    def store(self, pages: DataFrame, elements: DataFrame) -> DataFrame:
        """Write the pages that are new or whose page_hash differs, with their elements; return document_id, pages_stored, pages_skipped, elements_stored, crops_stored.

        pages: document_id, page_number, page_hash and more; elements: document_id, page_number, id, element_type, bbox
        and more. Pages that the call does not name stay as they are.
        """
        run = max(runs.folders(self.spark, self.root, "run"), default=0) + 1
        fresh = pages.withColumn("bucket", self.bucket())
        held = self.pages()
        # keys and hashes alone are read of what is stored
        known = held.select(*KEYS, F.col("page_hash").alias("stored_hash"), F.lit(True).alias("stored")) if held is not None else None
        plan = fresh.join(known, list(KEYS), "left") if known is not None else fresh.withColumn("stored_hash", F.lit(None).cast("string")).withColumn("stored", F.lit(None).cast("boolean"))
        skip = F.coalesce("stored", F.lit(False)) & F.col("stored_hash").eqNullSafe(F.col("page_hash"))
        plan = plan.withColumn("action", F.when(skip, "skip").otherwise("replace")).drop("stored", "stored_hash")
        staged_at = runs.workspace(self.spark, "canonical-plan")
        # planned once: skipped pages carry no elements
        runs.write(self.nested(plan.where("action = 'replace'"), elements).unionByName(plan.where("action = 'skip'"), allowMissingColumns=True), staged_at)
        staged = self.spark.read.parquet(staged_at)
        changed = staged.where("action = 'replace'").drop("action")
        touched = [r.bucket for r in changed.select("bucket").distinct().collect()]  # as many as buckets
        if touched:
            out = changed.withColumn("stored_run", F.lit(run).cast("bigint"))
            old = self.pages(touched)
            if old is not None:
                out = out.unionByName(old.join(changed.select(*KEYS), list(KEYS), "left_anti"), allowMissingColumns=True)
            # a bucket larger than a task should be is split, small ones are written together
            runs.write(out.hint("rebalance", "bucket"), f"{self.root}/run={run}", "bucket")
        e = changed.select(*KEYS, F.explode("elements").alias("e")).select(*KEYS, "e.element_type", "e.bbox")
        return store.store_summary(staged.select(*KEYS, "action"), e)

    def vacuum(self) -> None:
        """Remove what no reader that begins now would read: replaced buckets and runs that never became complete."""
        live = set(self.current().values())
        done = runs.complete(self.spark, self.root, "run")
        for n, path in runs.folders(self.spark, self.root, "run").items():
            own = runs.folders(self.spark, path, "bucket").values()
            if n not in done or not live & set(own):
                runs.remove(self.spark, path)
            else:
                runs.remove(self.spark, *(p for p in own if p not in live))
