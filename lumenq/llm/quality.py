"""Operator 1: quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic regression gives each document's own evidence: shape features for quality, words for toxicity. It is fitted
on labelled rows, at most `most` of them, the first by a hash of their id; that bound and the hash are parameters. All
else covers all documents: evidence is summed by host and by path, a site's mean is drawn towards the mean above it by
a weight that the spread between sites gives (method of moments), so a site of few documents says little. A document's
posterior is its own log odds moved by what its path's posterior differs from the global mean; its own share is left
out of its site's sums.

A table of documents without URLs takes `source` as host and source and language as path.

Defined results: a null text has the features of an empty one; null hosts or paths are sites of their own; repeated rows
count each; without labelled rows of both kinds the evidence is one half everywhere (toxicity zero); an empty table gives
no rows; no input columns are carried along. Columns of labels beyond id, quality and toxic are ignored.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.llm.common import cut, returning, text_of, utf8_rows

LABELLED_ROWS = 6000
SPLIT = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(128)) + bytes(range(128, 256))
SHAPES = 9
KEEP_FROM = 0.5
#: Words count for toxicity that are in so many labelled rows, and in toxic ones so many standard deviations too often.
SEEN, EXCESS = 3, 4.0
STEM = 5


def shape(text: bytes, words: list[bytes], distinct: int) -> list[float]:
    """Ratios that tell prose from junk, each about one at most."""
    n = max(1, len(words))
    size = max(1, len(text))
    tokens = text.split()
    same = sum(map(bytes.__eq__, tokens, tokens[1:]))
    marks = sum(text.count(c) for c in b"#*$%&|<>")
    return [
        1.0,
        min(1.0, math.log1p(len(words)) / 8),
        min(2.0, len(text) / n / 10),
        min(3.0, marks / max(1, len(tokens)) * 3),
        min(3.0, text.count(b"!") / max(1, len(tokens)) * 3),
        min(3.0, 3 * same / max(1, len(tokens))),
        distinct / n,
        3 * sum(text.count(c) for c in b"0123456789") / size,
        1.0 if len(tokens) < 10 else 0.0,
    ]


def hashed(words: set[bytes], memo: dict[bytes, int]) -> list[int]:
    out = []
    for w in words:
        h = memo.get(w)
        if h is None:
            if len(memo) > 500_000:
                memo.clear()
            h = memo[w] = zlib.crc32(w)
        out.append(h)
    return out


def features(text: bytes, memo: dict[bytes, int]) -> tuple[list[float], list[int]]:
    words = text.translate(SPLIT).lower().split()
    distinct = set(words)
    stems = {b"^" + w[:STEM] for w in distinct if len(w) > STEM}
    return shape(text, words, len(distinct)), hashed(distinct | stems, memo)


@dataclass
class Model:
    """Weights of shape features for quality; of telling words, and a constant, for toxicity."""

    quality: np.ndarray
    toxic: dict[int, float]
    constant: float

    def scores(self, shapes: np.ndarray, words: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-np.clip(shapes @ self.quality, -30, 30)))
        known = self.toxic
        z = np.array([self.constant + sum([known[h] for h in w if h in known]) for w in words])
        return q, 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    """Adam, from zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(shapes: np.ndarray, words: list[list[int]], quality: np.ndarray, toxic: np.ndarray) -> Model:
    model = Model(np.zeros(SHAPES), {}, -30.0)
    n = len(quality)
    if n and 0 < quality.sum() < n:
        model.quality = _descend(lambda w: shapes.T @ (1 / (1 + np.exp(-np.clip(shapes @ w, -30, 30))) - quality) / n + 1e-4 * w, SHAPES, 400, 0.1)
    if n and 0 < toxic.sum() < n:
        rows = np.repeat(np.arange(n), [len(w) for w in words])
        flat = np.array([h for w in words for h in w], np.int64)
        used, flat = np.unique(flat, return_inverse=True)
        share, seen = toxic.mean(), np.bincount(flat)
        excess = (np.bincount(flat, toxic[rows]) - seen * share) / np.sqrt(seen * share * (1 - share))
        telling = (seen >= SEEN) & (excess >= EXCESS)  # other words would only be learnt by heart
        rows, flat = rows[telling[flat]], (np.cumsum(telling) - 1)[flat[telling[flat]]]
        used = used[telling]
        k = len(used)

        def gradient(w):
            z = np.bincount(rows, w[flat], n) + w[-1]
            r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) / n
            return np.append(np.bincount(flat, r[rows], k), r.sum()) + 1e-5 * w

        w = _descend(gradient, k + 1, 300, 0.1)
        model.toxic, model.constant = dict(zip(used.tolist(), w[:-1].tolist())), float(w[-1])
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> Model:
    """docs: _id, _text; labels: _id, quality, toxic. Fits on the `most` labelled rows of least hash."""
    chosen = labels.where("quality IS NOT NULL").orderBy(F.xxhash64("_id"), "_id", "quality", "toxic").limit(most)
    rows = docs.join(F.broadcast(chosen), "_id")  # at most `most` rows of three numbers

    def run(batches):
        memo: dict[bytes, int] = {}
        for batch in batches:
            raw, offsets = utf8_rows(batch.column(1))
            raw, edge = raw.tobytes(), offsets.tolist()
            found = [features(raw[a:b], memo) for a, b in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.list_(pa.float64())), pa.array([f[1] for f in found], pa.list_(pa.int64())), batch.column(2), batch.column(3)], names=["_id", "shape", "words", "quality", "toxic"])

    schema = "_id long, shape array<double>, words array<bigint>, quality int, toxic int"
    sample = rows.select("_id", "_text", F.col("quality").cast("int"), F.coalesce("toxic", F.lit(0)).cast("int").alias("toxic")).mapInArrow(returning(run), schema).toArrow()
    sample = sample.sort_by([("_id", "ascending")])
    shapes = np.array(sample.column("shape").to_pylist(), float).reshape(-1, SHAPES)
    return fit(shapes, sample.column("words").to_pylist(), sample.column("quality").to_numpy().astype(float), sample.column("toxic").to_numpy().astype(float))


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """docs: _id, _text, host, path; (_id, host, path, n_words, q, t) for each row."""

    def run(batches):
        memo: dict[bytes, int] = {}
        for batch in batches:
            raw, offsets = utf8_rows(batch.column(1))
            raw, edge = raw.tobytes(), offsets.tolist()
            q, t = [np.empty(0)], [np.empty(0)]
            for k in range(0, len(edge) - 1, 512):
                found = [features(raw[a:b], memo) for a, b in zip(edge[k : k + 512], edge[k + 1 : k + 513])]
                x, y = model.scores(np.array([f[0] for f in found]), [f[1] for f in found])
                q.append(x)
                t.append(y)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(np.concatenate(q)), pa.array(np.concatenate(t))], names=["_id", "host", "path", "q", "t"])

    return docs.select("_id", "_text", "host", "path").mapInArrow(returning(run), "_id long, host string, path string, q double, t double")


def _strength(groups: DataFrame, mean: Column, n: Column, above: Column) -> tuple[float, float]:
    """(the overall mean, the weight of the mean above) by the method of moments; one row comes to the driver."""
    total, s, within, between, m = groups.agg(
        F.sum(n), F.sum(n * mean), F.sum(n * mean * (1 - mean)), F.sum(n * (mean - above) * (mean - above)), F.count(F.lit(1))
    ).first()
    if not total:
        return 0.5, 1.0
    noise = within / total  # variance of one document about its site's mean, at most
    spread = max(between / total - noise * m / total, 1e-9)  # of the sites' means, without what noise adds
    return s / total, min(max(noise / spread, 1.0), 1e6)


def posteriors(scored: DataFrame) -> DataFrame:
    """Adds site_quality (the path's posterior mean without the document) and quality to _id, host, path, q, t."""
    path = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pn"), F.sum("q").alias("ps"))
    path = cut(path)
    host = cut(path.groupBy("host").agg(F.sum("pn").alias("hn"), F.sum("ps").alias("hs")))
    mean, k_host = _strength(host.select((F.col("hs") / F.col("hn")).alias("m"), "hn"), F.col("m"), F.col("hn"), F.lit(0.0))
    _, k_host = _strength(host.select((F.col("hs") / F.col("hn")).alias("m"), "hn"), F.col("m"), F.col("hn"), F.lit(mean))
    both = path.join(host, path["host"].eqNullSafe(host["host"])).select(path["host"], "path", "pn", "ps", "hn", "hs")
    _, k_path = _strength(both.select((F.col("ps") / F.col("pn")).alias("m"), "pn", (F.col("hs") / F.col("hn")).alias("h")), F.col("m"), F.col("pn"), F.col("h"))
    sites = both.withColumnsRenamed({"host": "_h", "path": "_p"})
    rows = scored.join(sites, scored["host"].eqNullSafe(F.col("_h")) & scored["path"].eqNullSafe(F.col("_p")))
    of_host = (F.col("hs") - F.col("q") + k_host * mean) / (F.col("hn") - 1 + k_host)
    of_path = (F.col("ps") - F.col("q") + k_path * of_host) / (F.col("pn") - 1 + k_path)

    def odds(p: Column) -> Column:
        p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
        return F.log(p / (1 - p))

    z = odds(F.col("q")) + odds(of_path) - odds(F.lit(mean))
    return rows.select("_id", "host", "path", "q", "t", of_path.alias("site_quality"), (1 / (1 + F.exp(-z))).alias("quality"))


def classify(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", host: Column | None = None, path: Column | None = None, most: int = LABELLED_ROWS, keep_from: float = KEEP_FROM) -> DataFrame:
    """(id_column, evidence, site_quality, quality, toxicity, kept) for each row."""
    host = df["source"] if host is None else host
    path = F.concat_ws("/", df["source"], df["lang"]) if path is None else path
    docs = df.select(F.col(id_column).cast("bigint").alias("_id"), text_of(df, text_column).alias("_text"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    marks = labels.select(F.col(id_column).cast("bigint").alias("_id"), "quality", "toxic")
    scored = cut(evidence(docs, train(docs.select("_id", "_text"), marks, most)))
    rounded = lambda c: F.round(c, 6)
    return posteriors(scored).select(
        F.col("_id").alias(id_column),
        rounded("q").alias("evidence"),
        rounded("site_quality").alias("site_quality"),
        rounded("quality").alias("quality"),
        rounded("t").alias("toxicity"),
        ((F.col("quality") >= keep_from) & (F.col("t") < 0.5)).alias("kept"),
    )
