"""Quality rules with host verdicts.

Every whole text gets counts and rule failures. Failures are summed by host, the
hosts' failure rates are shrunk towards a beta prior fitted to all hosts by moments, and
a host is judged against that prior: it is bad if, by its posterior, its rate is all but
surely (SURE standard deviations of the posterior) above the prior's mean by a standard
deviation of the prior. The verdict goes back to the host's documents: in a bad host the
soft rules apply with half of their bounds. One document says next to nothing about its
host, and hosts that differ by no more than chance are all good.

Nulls: a null text has no words (and fails the word count); a null host is a host of
its own; a null doc_id is kept. Repeated rows are judged each by itself. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, gram_hashes, map_rows, row_key, stash, unused

#: A document fails below so many words, or with more than so many percent of its words in repeated windows.
MIN_WORDS, MAX_REPEAT = 20, 30
#: The soft rules: most symbols a character of words, repeated lines a line, upper-case words a word.
MAX_SYMBOLS, MAX_DUP_LINES, MAX_UPPER = 0.10, 0.50, 0.60
#: Standard deviations of the posterior for a bad host (a one-sided 95 %), and the most documents that the prior stands for.
SURE, MAX_STRENGTH = 1.645, 1e6

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words")


def text_counts(text: str | None, window: int = 8) -> tuple[int, ...]:
    """The counts named in COUNTS of one whole text."""
    if not text:
        return (0,) * len(COUNTS)
    words = WORD.findall(text)
    seen: set[str] = set()
    lines = again = 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            lines += 1
            again += line in seen
            seen.add(line)
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        again,
        repeated_words(words, window),
        lines,
        sum(map(str.isupper, words)),
    )


def repeated_words(words: list[str], window: int) -> int:
    """Words in windows that are found twice or more, the first included."""
    n = len(words)
    if n <= window:
        return 0
    # hash() is stable within one process, and windows are compared within one text only
    h = gram_hashes(np.fromiter(map(hash, words), np.int64, n).view(np.uint64), window)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    found = np.zeros(h.size, bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    edge[: h.size] += found
    edge[window : window + h.size] -= found
    return int((np.cumsum(edge)[:n] > 0).sum())


def count_rows(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """key (of doc_id, text and host), doc_id, host and the counts of each row of docs."""
    names = ("key", "doc_id", "host", *COUNTS)
    schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("host", pa.string()), *((c, pa.int64()) for c in COUNTS)])

    def make(keys: list, ids: list, hosts: list, texts: list) -> Iterator[tuple]:
        for key, i, host_, text_ in zip(keys, ids, hosts, texts, strict=True):
            yield (key, i, host_, *text_counts(text_))

    kinds = ["binary", "bigint", "string", *["bigint"] * len(COUNTS)]
    return map_rows(docs.select(row_key(doc_id, text, host), F.col(doc_id).cast("bigint"), F.col(host).cast("string"), F.col(text)), schema, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)), make)


def failures(strict: float = 1.0) -> Column:
    """How many of the soft rules fail; strict scales their bounds."""
    return (
        (F.col("n_symbols") > strict * MAX_SYMBOLS * F.col("word_chars")).cast("int")
        + (F.col("n_dup_lines") > strict * MAX_DUP_LINES * F.col("n_lines")).cast("int")
        + (F.col("n_upper_words") > strict * MAX_UPPER * F.col("n_words")).cast("int")
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def host_rates(rows: DataFrame) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate (the mean of the host's posterior under the beta prior of all hosts), host_bad."""
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum((base_failed() | (failures() > 0)).cast("bigint")).alias("n_failed"))
    # hosts weigh as their documents; what chance alone adds to the spread of the rates is taken off
    n, f = F.col("n_docs"), F.col("n_failed")
    total = hosts.agg(F.count(F.lit(1)).alias("h"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("q"))
    m = F.col("f") / F.col("n")
    total = total.select("h", "n", m.alias("m"), (F.col("q") - F.col("n") * m * m).alias("spread"))
    chance = F.col("m") * (1 - F.col("m"))
    v = F.greatest((F.col("spread") - F.col("h") * chance) / F.col("n"), F.lit(0.0))
    strength = F.when(v > 0, F.least(F.greatest(chance / F.nullif(v, F.lit(0.0)) - 1, F.lit(1.0)), F.lit(MAX_STRENGTH))).otherwise(MAX_STRENGTH)
    prior = total.select("m", v.alias("v"), strength.alias("k"))
    # one row: the join is a scalar look-up
    out = hosts.crossJoin(F.broadcast(prior)).withColumn("shrunk_rate", (f + F.col("m") * F.col("k")) / (n + F.col("k")))
    rate = F.col("shrunk_rate")
    least = rate - SURE * F.sqrt(rate * (1 - rate) / (n + F.col("k") + 1))
    return out.select("host", "n_docs", "n_failed", "shrunk_rate", (least > F.col("m") + F.sqrt("v")).alias("host_bad"))


def verdict() -> Column:
    """How many soft rules fail, by the host's verdict."""
    return F.when(F.col("host_bad"), failures(0.5)).otherwise(failures())


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """key, doc_id, the counts, base_failed, n_rules_failed, host_rate, host_bad, kept.

    kept is false if base_failed, or if a soft rule fails; in a bad host the soft rules
    apply with half of their bounds.
    """
    rows = stash(count_rows(docs, doc_id, text, host), "quality-counts")
    hosts = host_rates(rows).withColumnRenamed("host", "rated_host")
    joined = rows.join(hosts, F.col("host").eqNullSafe(F.col("rated_host")), "left")
    return joined.select(
        "key", "doc_id", *COUNTS[:5], base_failed().alias("base_failed"), verdict().cast("bigint").alias("n_rules_failed"),
        F.round("shrunk_rate", 9).alias("host_rate"), "host_bad", (~base_failed() & (verdict() == 0)).alias("kept"),
    )


def keep(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns. A copy in a bad host is judged by that host, whatever becomes of its twins."""
    (key,) = unused(docs, "row_key")
    kept = judge(docs, doc_id, text, host).where("kept").select(F.col("key").alias(key))
    return docs.withColumn(key, row_key(doc_id, text, host)).join(kept, key, "left_semi").drop(key)
