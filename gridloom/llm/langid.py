"""Language identification by sparse multinomial logistic regression (operator 10).

Features are character n-grams of one to three letters of the lower-case text, everything but
letters counting as one space; they are hashed to `BUCKETS` columns, weighted by (1 + ln tf) * idf
and brought to unit length.  The weights are learned by follow-the-regularised-leader with
per-coordinate rates and elastic-net penalties, so most are exactly zero.  A temperature, fitted on
sampled rows that the weights have not seen, calibrates the probabilities.

Fitting uses at most `per_language` distinct labelled rows of each of at most `most_languages` languages, chosen by a
hash (documented bounds; all classifier statistics, idf included, belong to this sample).  Prediction
reads every whole text.

Defined results: a text that is null or has no letter gives `und` with score 0; null labels and
null ids are not learned from; without any labelled row every text gives `und` with score 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import crc_remainder, released, settle

BITS = 16
BUCKETS = 1 << BITS
UNKNOWN = "und"
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether a code point is a letter, for all of Unicode."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Bucket numbers and counts of a text's n-grams; None where it has no letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    keep = letters()[points]
    if not keep.any():
        return None
    x = np.where(keep, points, np.uint32(32)).astype(np.uint64)
    # One space for a run of anything but letters, and one at either end.
    run = np.ones(len(x), bool)
    run[1:] = keep[1:] | keep[:-1]
    x = np.concatenate([[np.uint64(32)], x[run], [np.uint64(32)]])
    m = np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - BITS)
    two = x[:-1] * np.uint64(0x1F0001) + x[1:] + np.uint64(1 << 45)
    three = two[:-1] * np.uint64(0x1F0001) + x[2:] + np.uint64(1 << 46)
    hashed = np.concatenate([(x[1:-1] * m) >> shift, (two * m) >> shift, (three * m) >> shift]).astype(np.int64)
    if len(hashed) < 2000:
        return np.unique(hashed, return_counts=True)
    counts = np.bincount(hashed, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass(frozen=True)
class Model:
    """Languages, idf, the non-zero rows of the weights, bias and temperature."""

    languages: list[str]
    idf: np.ndarray
    rows: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def dense(self) -> np.ndarray:
        w = np.zeros((BUCKETS, len(self.languages)), np.float32)
        w[self.rows] = self.weights
        return w * self.idf[:, None].astype(np.float32)

    def predictor(self):
        """A function from a text to (language, probability)."""
        if not self.languages:
            return lambda _: (UNKNOWN, 0.0)
        weights, idf = self.dense(), self.idf

        def predict(text: str | None) -> tuple[str, float]:
            found = grams(text)
            if found is None:
                return UNKNOWN, 0.0
            at, n = found
            tf = 1 + np.log(n)
            length = np.sqrt(np.dot(tf * tf, idf[at] ** 2)) or 1.0
            z = ((tf.astype(np.float32) @ weights[at]).astype(float) / length + self.bias) / self.temperature
            p = np.exp(z - z.max())
            k = int(p.argmax())
            return self.languages[k], float(p[k] / p.sum())

        return predict


def ftrl(xs: list[tuple[np.ndarray, np.ndarray]], ys: list[int], k: int, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader, proximal, on softmax loss: weights (with a last row of biases, unpenalised)."""
    z, n = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def lead(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n)) / alpha + l2)

    order = np.random.default_rng(20240607)
    for _ in range(epochs):
        for i in order.permutation(len(xs)):
            at, v = xs[i]
            w, b = lead(z[at], n[at], l1), lead(zb, nb, 0.0)
            s = v @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[ys[i]] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha * b
            nb += p * p
    return lead(z, n, l1), lead(zb, nb, 0.0)


def temperature(logits: np.ndarray, ys: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(ys):
        return 1.0

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(ys)), ys]).mean())

    a, b, r = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit_rows(rows: list[tuple[str, bool, np.ndarray, np.ndarray]]) -> Model:
    """Fit on (language, calibrates, buckets, counts)."""
    languages = sorted({r[0] for r in rows})
    learn, held = [r for r in rows if not r[1]], [r for r in rows if r[1]]
    seen = np.zeros(BUCKETS)
    for _, _, at, _ in learn:
        seen[at] += 1
    idf = np.log((1 + len(learn)) / (1 + seen)) + 1

    def unit(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = (1 + np.log(n)) * idf[at]
        return at, v / (np.linalg.norm(v) or 1.0)

    index = {x: i for i, x in enumerate(languages)}
    if not languages:
        return Model([], idf, np.zeros(0, int), np.zeros((0, 0)), np.zeros(0), 1.0)
    weights, bias = ftrl([unit(at, n) for _, _, at, n in learn], [index[r[0]] for r in learn], len(languages))
    logits = np.array([v @ weights[at] + bias for at, v in (unit(r[2], r[3]) for r in held)])
    t = temperature(logits, np.array([index[r[0]] for r in held], int))
    used = np.flatnonzero(weights.any(1))
    return Model(languages, idf, used, weights[used], bias, t)


def fit(docs: DataFrame, per_language: int = 400, most_languages: int = 500) -> Model:
    """Learn from labelled texts outside the held-out fold: `per_language` distinct (id, text) rows of each language at most.

    Languages are the `most_languages` of the most distinct rows, ties by name: a language is a column of the weights, so
    a label column that holds something else can't fill the driver.  A hash picks the rows; texts move only for those picked.
    """
    keyed = docs.select("doc_id", "lang", "text", F.xxhash64(F.lit("language"), "doc_id", "text").alias("pick"))
    allowed = keyed.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (crc_remainder("doc_id", 4) != 2))
    sizes = settle(allowed.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages").orderBy(F.desc("n"), "lang").limit(most_languages)
    # About twice as many rows as are wanted of each language by their hashes, then exactly as many by rank.
    share = (F.pmod(F.xxhash64("pick"), F.lit(1 << 30)) * F.col("n") < F.lit((2 * per_language + 200) * (1 << 30))) | (F.col("n") <= 2 * per_language)
    near = allowed.select("lang", "doc_id", "pick").join(F.broadcast(sizes), "lang").filter(share).groupBy("lang", "pick").agg(F.min("doc_id").alias("doc_id"))
    ranked = near.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("pick"))).filter(F.col("at") <= per_language)
    chosen = settle(ranked.select("lang", "doc_id", "pick"), "language-rows")
    texts = allowed.join(F.broadcast(chosen), ["lang", "doc_id", "pick"]).dropDuplicates(["lang", "pick"])
    chosen = texts.select("lang", (F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5)) == 0).alias("held"), "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, held, ats, ns = [], [], [], []
            for lang, h, text in zip(*(batch.column(i) for i in range(3))):
                found = grams(text.as_py())
                if found is not None:
                    langs.append(lang.as_py())
                    held.append(h.as_py())
                    ats.append(found[0].astype(np.uint32).tobytes())
                    ns.append(found[1].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(held, pa.bool_()), pa.array(ats, pa.binary()), pa.array(ns, pa.binary())], ["lang", "held", "at", "n"])

    rows = chosen.mapInArrow(counted, "lang string, held boolean, at binary, n binary").collect()
    rows = sorted((r["lang"], r["held"], bytes(r["at"]), bytes(r["n"])) for r in rows)
    return fit_rows([(x, h, np.frombuffer(a, np.uint32).astype(np.int64), np.frombuffer(n, np.uint32)) for x, h, a, n in rows])


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with the columns lang_pred and score, which replace columns of those names."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema) + ", lang_pred string, score double"
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = model.predictor()
        for batch in batches:
            found = [predictor(t.as_py()) for t in batch.column(at)]
            more = [pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*kept, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(released(run), schema)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    rows = docs.select("doc_id", (crc_remainder("doc_id", 4) == 2).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
