"""Document quality from a linear-chain CRF over lines.

Every line of a text is good (1) or bad (0). Its features are the line's own, the
neighbouring lines' and a bias; transitions tie neighbours. A labelled document's lines
all carry its label in training, as labels are of documents: lines of both kinds side by
side are never seen there, only in scoring. A document's score is the mean of its lines'
forward-backward marginals for "good", weighted by length.

Training takes at most MAX_TRAIN labelled documents (chosen by a hash of doc_id) with
crc32(doc_id as text) mod 3 other than 1, and of each all lines of the whole text. Tasks
turn them into OWN numbers a line, so the driver gets those of MAX_TRAIN documents. The
likelihood is that of pieces of PIECE lines, whose features still see the neighbours across
a seam: long texts need no wide padding, and only the tie over each seam is left out.
Scoring takes the whole chain of all lines of all documents. Only the text is an input of
a score.

Nulls: a null or empty text, or one without a word, gets the training sample's share of
good documents; a null doc_id is not held out and not trained on. Labels that are null
are left out; of several labels of a doc_id the largest counts, of several texts the least. Without any usable label
every score is 0.5. Repeated rows give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Documents of the training sample; lines of a piece in training; steps and damping of the fit.
MAX_TRAIN, PIECE, STEPS, L2 = 3000, 40, 150, 1e-4
SIGNS = "#*$%&|<>!"
OWN = 9
#: own features, those of the line before and after, whether there is one, bias
WIDTH = 3 * OWN + 3


def own_features(line: str, words: list[str], again: bool) -> list[float]:
    n, size = len(words), len(line)
    upper = sum(map(str.isupper, words))
    return [
        math.log1p(n) / 5,
        sum(map(line.count, SIGNS)) / size,
        line.count("!") / n,
        upper / n,
        1 - len(set(words)) / n,
        min(size / n, 40) / 10,
        line.count("|") / n,
        sum(line[-1:] == c for c in ".!?:") * 1.0,
        1.0 * again,
    ]


def own_lines(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x OWN features, line lengths) of the lines that have a word."""
    own, sizes = [], []
    seen: set[str] = set()
    for line in text.split("\n") if text else ():
        words = line.split()
        if words:
            own.append(own_features(line, words, line in seen))
            seen.add(line)
            sizes.append(len(line))
    return np.array(own).reshape(-1, OWN), np.array(sizes, float)


def with_neighbours(o: np.ndarray) -> np.ndarray:
    """lines x WIDTH features from the lines' own."""
    x = np.zeros((len(o), WIDTH))
    x[:, :OWN] = o
    x[1:, OWN : 2 * OWN], x[1:, 3 * OWN] = o[:-1], 1
    x[:-1, 2 * OWN : 3 * OWN], x[:-1, 3 * OWN + 1] = o[1:], 1
    x[:, -1] = 1
    return x


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x WIDTH features, line lengths) of the lines that have a word."""
    own, sizes = own_lines(text)
    return with_neighbours(own), sizes


def marginals(scores: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """P(good) of each line. scores: how much better good is than bad, by line; pair: 2 x 2 scores of neighbours."""
    n = scores.size
    e = np.exp(np.clip(scores, -30, 30)).tolist()
    p = np.exp(pair)
    p00, p01, p10, p11 = p.ravel().tolist()
    # forward messages, and backward messages, as odds of good: ratios, so nothing under- or overflows
    ahead, back = [1.0] * n, [1.0] * n
    for t in range(1, n):
        r = ahead[t - 1] * e[t - 1]
        ahead[t] = (p01 + r * p11) / (p00 + r * p10)
    for t in range(n - 2, -1, -1):
        r = back[t + 1] * e[t + 1]
        back[t] = (p10 + r * p11) / (p00 + r * p01)
    odds = np.array(ahead) * np.array(e) * np.array(back)
    return odds / (1 + odds)


def gradient(x: np.ndarray, mask: np.ndarray, y: np.ndarray, w: np.ndarray, pair: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted log-likelihood of chains whose lines all have label y, and its gradient. x: chains x lines x WIDTH, padded; mask: chains x lines; weight: of each chain, or their mean a line."""
    d, n, _ = x.shape
    s = x @ w
    node = np.stack([np.zeros_like(s), s], -1)
    logsum = np.logaddexp
    a = np.empty((d, n, 2))
    a[:, 0] = node[:, 0]
    for t in range(1, n):
        m = logsum(a[:, t - 1, :1] + pair[0], a[:, t - 1, 1:] + pair[1]) + node[:, t]
        a[:, t] = np.where(mask[:, t, None], m, a[:, t - 1])
    b = np.zeros((d, n, 2))
    for t in range(n - 2, -1, -1):
        v = node[:, t + 1] + b[:, t + 1]
        m = np.stack([logsum(pair[0, 0] + v[:, 0], pair[0, 1] + v[:, 1]), logsum(pair[1, 0] + v[:, 0], pair[1, 1] + v[:, 1])], -1)
        b[:, t] = np.where(mask[:, t + 1, None], m, 0)
    z = logsum(a[:, -1, 0], a[:, -1, 1])
    good = np.exp(a[:, :, 1] + b[:, :, 1] - z[:, None]) * mask
    steps = mask[:, 1:].sum(1)
    own = np.where(y == 1, (s * mask).sum(1), 0) + steps * pair[y, y]
    per = 1 / mask.sum(1) / d if weight is None else weight
    dw = np.einsum("dn,dnk->k", (y[:, None] * mask - good) * per[:, None], x)
    dp = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            both = np.exp(a[:, :-1, i] + pair[i, j] + node[:, 1:, j] + b[:, 1:, j] - z[:, None]) * mask[:, 1:]
            dp[i, j] = ((np.where((y == i) & (y == j), steps, 0) - both.sum(1)) * per).sum()
    return float(((own - z) * per).sum()), dw, dp


def pieces(chains: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pieces x lines x WIDTH features, padded; which lines are there; the chain of each piece; its weight) of all lines of the chains, each of which counts once however long it is."""
    at = [(i, k) for i, o in enumerate(chains) for k in range(0, len(o), PIECE)]
    n = min(PIECE, max(map(len, chains)))
    x, mask = np.zeros((len(at), n, WIDTH)), np.zeros((len(at), n), bool)
    whole, last = np.empty((0, WIDTH)), -1
    for j, (i, k) in enumerate(at):
        if i != last:
            whole, last = with_neighbours(chains[i]), i
        part = whole[k : k + PIECE]
        x[j, : len(part)], mask[j, : len(part)] = part, True
    chain = np.array([i for i, _ in at])
    return x, mask, chain, 1 / (np.array([len(o) for o in chains])[chain] * len(chains))


def train(chains: list[np.ndarray], labels: list[int]) -> dict:
    """Weights, transitions and the share of good documents, by Adam on the pieces of the chains (lines x OWN); runs agree."""
    share = float(np.mean(labels)) if labels else 0.5
    docs = [(o, y) for o, y in zip(chains, labels, strict=True) if len(o)]
    if len({y for _, y in docs}) < 2:
        return {"w": np.zeros(WIDTH), "pair": np.zeros((2, 2)), "share": share, "prior": share}
    x, mask, chain, weight = pieces([o for o, _ in docs])
    y = np.array([y for _, y in docs])[chain]
    theta = np.zeros(WIDTH + 4)
    m = v = np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        _, dw, dp = gradient(x, mask, y, theta[:WIDTH], theta[WIDTH:].reshape(2, 2), weight)
        g = np.concatenate([dw, dp.ravel()]) - L2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return {"w": theta[:WIDTH], "pair": theta[WIDTH:].reshape(2, 2), "share": share, "prior": None}


def score(text: str | None, model: dict) -> tuple[float, int]:
    """The score of a text and the number of its lines with a word."""
    x, sizes = line_features(text)
    if model["prior"] is not None or not sizes.size:
        return (model["share"] if model["prior"] is None else model["prior"]), sizes.size
    return float((marginals(x @ model["w"], model["pair"]) * sizes).sum() / sizes.sum()), sizes.size


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> dict:
    """Train on a bounded sample of the labelled rows of the two training folds."""
    own = labels.select(F.col(doc_id).cast("bigint").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(fold(F.col("id")) != 1)
    own = own.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(MAX_TRAIN)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(own), "id")
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    schema = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("x", pa.list_(pa.float64()))])

    def make(ids: list, texts: list, ys: list) -> Iterator[tuple]:
        for i, t, y in zip(ids, texts, ys, strict=True):
            yield i, y, own_lines(t)[0].ravel()

    found = map_rows(rows.select("id", "text", "y"), schema, "id bigint, y int, x array<double>", make).toArrow().sort_by("id")
    return train([np.array(x.as_py()).reshape(-1, OWN) for x in found.column("x")], found.column("y").to_pylist())


def score_documents(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_lines of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH + 6 numbers
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_lines", pa.int64())])

    def make(ids: list, texts: list) -> Iterator[tuple]:
        for i, t in zip(ids, texts, strict=True):
            yield i, *score(t, shared.value)

    rows = map_rows(docs.select(F.col(doc_id).cast("bigint"), F.col(text)), schema, "doc_id bigint, score double, n_lines bigint", make)
    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines")
