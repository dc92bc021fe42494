"""Toxicity by compression distance (operator 5).

A text is cut into windows of `WINDOW` words: raw letters, in lower case, without the punctuation around words.
Zstandard dictionaries are trained straight on such windows, separate ones on toxic and on ordinary
text, `PAIRS` of each from disjoint parts of the labelled documents.  A window is compressed with the dictionaries of
both kinds; by how many bytes the toxic ones make it shorter, on average over the pairs, is its
distance.  Random prose matches one dictionary or another by chance; what is left in the average over
pairs that have seen different documents is what toxic texts have in common.  Each pair's savings are taken less
their mean over ordinary calibrating windows.

Pairs are asked one after the other: a window whose mean saving so far is under `LOOK` bytes counts as 0 and is
not asked further, everywhere alike.  The toxic dictionary is asked first: as no frame is longer than the window
stored plainly, it often shows alone that a window can't reach LOOK.  A text's measures are the shares of its windows that save at
least each of `STEPS` bytes, the largest saving, and the sum of the savings of at least a calibrated
threshold; a logistic curve, fitted on labelled documents that no dictionary has seen, turns them into the score.

Fitting uses at most `max_rows` distinct labelled (id, text) rows of each class, chosen by a hash, less near copies
of one another; nothing else is bounded.  Dictionaries are trained by tasks, one each, and only they, three hashes
a row and the measures of calibrating rows reach the driver.  Texts are scored in the order of their beginnings, as copies and
near copies have most windows in common and a window is compressed once a chunk; no score depends on that order.

Defined results: null and empty texts have no windows and get the score of a text that saves nothing; a null id
counts as the empty text for the fold; null labels are not learned from; an id with several labels is toxic if one says so;
without labels of both classes every score is the share of toxic labels, or 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import crc_remainder, settle

WINDOW = 4
PAIRS = 8
LOOK = 1.0
SIZE, SEGMENT, DMER = 65536, 64, 8
STEPS = (1.0, 1.5, 2.0, 2.5, 3.0, 4.0)
LEAST_GAINS = tuple(x / 4 for x in range(2, 24))
OUTER = ".,;:!?%*&$#\"'()[]{}|-_<>/\\"
CHUNK, CHUNK_CHARS = 100_000, 1 << 24
BEGINNING = 32


def windows(text: str | None) -> list[bytes]:
    """The windows of a whole text, a space before, between and after their words."""
    words = [w.strip(OUTER) or w for w in (text or "").lower().split()]
    return [f" {' '.join(words[i : i + WINDOW])} ".encode("utf-8", "replace") for i in range(0, len(words), WINDOW)]


def trained(samples: list[bytes], size: int = SIZE) -> bytes:
    """A Zstandard dictionary of the distinct samples, or these themselves where they are too few to train on.

    In the order of their hashes: repeated or sorted samples make the training stop early.
    """
    samples = sorted(set(samples), key=xxhash.xxh64_intdigest)
    try:
        return zs.train_dictionary(size, samples, k=SEGMENT, d=DMER).as_bytes()
    except (zs.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def sizes(dictionary: bytes) -> Callable[[list[bytes]], np.ndarray]:
    """A function from windows to the bytes of each when it is compressed, by itself, with the dictionary."""
    params = zs.ZstdCompressionParameters(
        strategy=zs.STRATEGY_BTOPT, window_log=20, hash_log=15, chain_log=17, search_log=4, min_match=3, target_length=64,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zs.FORMAT_ZSTD1_MAGICLESS,
    )
    held = zs.ZstdCompressionDict(dictionary)
    held.precompute_compress(compression_params=params)
    frames = zs.ZstdCompressor(dict_data=held, compression_params=params).multi_compress_to_buffer

    def asked(found: list[bytes]) -> np.ndarray:
        if not found:
            return np.zeros(0, np.int64)
        n = np.fromiter(map(len, found), np.uint64, len(found))
        places = np.column_stack([np.cumsum(n) - n, n])
        return np.fromiter(map(len, frames(zs.BufferWithSegments(b"".join(found), places.tobytes()))), np.int64, len(found))

    return asked


def longest(found: list[bytes]) -> np.ndarray:
    """The most bytes that each window's frame can have: stored plainly in one block, or the library's bound where blocks may be several."""
    n = np.fromiter(map(len, found), np.int64, len(found))
    return np.where(n <= 1024, n + 5, n + (n >> 8) + 64)


@dataclass(frozen=True)
class Pair:
    """Two dictionaries, and what the toxic one saves in an ordinary window on average."""

    ordinary: bytes
    toxic: bytes
    bias: float = 0.0

    def difference(self) -> Callable[[list[bytes]], np.ndarray]:
        """A function from windows to the bytes that the toxic dictionary makes each shorter."""
        ordinary, toxic = sizes(self.ordinary), sizes(self.toxic)
        return lambda found: ordinary(found) - toxic(found)


def saver(pairs: tuple[Pair, ...]) -> Callable[[list[bytes]], np.ndarray]:
    """A function from windows to what the toxic dictionaries save in each, in bytes a pair."""
    if not pairs:
        return lambda found: np.zeros(len(found))
    steps = [(sizes(p.toxic), sizes(p.ordinary), p.bias, LOOK * k) for k, p in enumerate(pairs, 1)]

    def gains(found: list[bytes]) -> np.ndarray:
        # One dictionary at a time over all windows: its tables fit a core's cache, those of several don't.
        index: dict[bytes, int] = {}
        at = [index.setdefault(w, len(index)) for w in found]
        left, asked, saved = list(index), np.arange(len(index)), np.zeros(len(index))
        for toxic, ordinary, bias, least in steps:
            most, short, so_far = longest(left), toxic(left), saved[asked]
            saved[asked] = 0.0
            hope = so_far + (most - short) - bias >= least
            left, asked = list(compress(left, hope.tolist())), asked[hope]
            so_far = so_far[hope] + (ordinary(left) - short[hope]) - bias
            enough = so_far >= least
            left, asked = list(compress(left, enough.tolist())), asked[enough]
            saved[asked] = so_far[enough]
        return saved[at] / len(steps)

    return gains


def each(gains: Callable[[list[bytes]], np.ndarray], texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The savings of every text's windows, looked up for about CHUNK windows, or CHUNK_CHARS characters, at once."""
    held: list[bytes] = []
    ends: list[int] = []
    chars = 0

    def flush() -> Iterator[np.ndarray]:
        yield from np.split(gains(held), ends)[:-1]
        held.clear()
        ends.clear()

    for text in texts:
        held += windows(text)
        ends.append(len(held))
        chars += len(text or "")
        if len(held) >= CHUNK or chars >= CHUNK_CHARS:
            yield from flush()
            chars = 0
    yield from flush()


def measures(gains: np.ndarray, least_gains: tuple[float, ...] = LEAST_GAINS) -> list[float]:
    """Shares of windows that save STEPS, the largest saving, then the sums over each of `least_gains`."""
    n = max(len(gains), 1)
    x = gains[gains > 0]  # nothing else counts in any measure
    most = float(x.max()) if len(x) else 0.0
    return [math.sqrt(float((x >= s).sum()) / n) for s in STEPS] + [math.log1p(most)] + [math.log1p(float(x[x >= least].sum())) for least in least_gains]


@dataclass(frozen=True)
class Model:
    """What fitting leaves: half a MB, sent to the executors with the task."""

    pairs: tuple[Pair, ...]
    threshold: int
    slopes: tuple[float, ...]
    offset: float

    def score(self, gains: np.ndarray) -> float:
        """A text's score between 0 and 1 from its windows' savings."""
        if not self.pairs:
            return self.offset
        z = sum(a * v for a, v in zip(self.slopes, measures(gains, LEAST_GAINS[self.threshold : self.threshold + 1]))) + self.offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Slopes, then the offset, of a weighted logistic fit by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (weight * p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def calibrated(pairs: tuple[Pair, ...], held: list[tuple[int, list[float]]], share: float, totals: tuple[int, int] | None = None) -> Model:
    """The threshold of least loss, and its logistic curve, from (label, measures); a model that says `share` where it can't be had.

    totals: ordinary and toxic labels behind the rows, where these are an uneven sample of them.
    """
    if not pairs or len({t for t, _ in held}) < 2:
        return Model((), 0, (), share)
    every = np.array([x for _, x in held])
    y = np.array([t for t, _ in held], float)
    of = (len(y) - y.sum(), y.sum())
    shares = totals or of
    weight = np.where(y > 0, shares[1] / of[1], shares[0] / of[0])
    weight *= len(y) / weight.sum()
    fixed, best = len(STEPS) + 1, None
    for k in range(len(LEAST_GAINS)):
        x = every[:, [*range(fixed), fixed + k]]
        *slopes, offset = map(float, logistic(x, y, weight))
        z = np.clip(x @ np.array(slopes) + offset, -30, 30)
        loss = float(np.mean(weight * (np.logaddexp(0, z) - y * z)))
        if best is None or loss < best[0]:
            best = (loss, k, tuple(slopes), offset)
    return Model(pairs, *best[1:])


def sketch(text: str | None) -> list[int]:
    """Three min-hashes of a text's word triples."""
    words = (text or "").lower().split()
    grams = [xxhash.xxh3_64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))]
    h = np.array(grams, np.uint64)
    return [int((h * np.uint64(m)).min() >> np.uint64(1)) for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def fresh(rows: Iterable[tuple[int, int, list[int]]]) -> list[int]:
    """Keys of the rows (key, label, sketch) without near copies: those that share a min-hash with an earlier one of their class."""
    seen: set[tuple[int, int, int]] = set()
    out = []
    for key, label, found in rows:
        marks = [(label, k, x) for k, x in enumerate(found)]
        if seen.isdisjoint(marks):
            out.append(key)
        seen.update(marks)
    return out


def sampled(docs: DataFrame, labels: DataFrame, max_rows: int) -> tuple[DataFrame, tuple[int, int]]:
    """Labelled rows to fit on (key, toxic, part, pair, text), at most `max_rows` distinct ones a class, and how many there are of each class."""
    allowed = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_remainder("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    keyed = docs.select("doc_id", F.col("text").alias("text"), F.xxhash64(F.lit("toxicity"), "doc_id", "text").alias("key"))
    known = settle(keyed.select("doc_id", "key").join(allowed, "doc_id").groupBy("doc_id", "key").agg(F.max("toxic").alias("toxic")), "labels")
    sums = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = [known.filter(F.col("toxic") == t).orderBy("key", "doc_id").limit(max_rows) for t in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * max_rows rows of three numbers
    rows = keyed.join(chosen, ["doc_id", "key"]).filter(F.col("text").isNotNull()).dropDuplicates(["doc_id", "key"])
    rows = rows.select("key", "toxic", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(4)).cast("int").alias("part"), F.pmod(F.xxhash64(F.lit("pair"), "doc_id"), F.lit(PAIRS)).cast("int").alias("pair"), "text")
    return settle(rows, "labelled"), (sums.get(0, 0), sums.get(1, 0))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4000) -> Model:
    """Learn from labelled rows outside the held-out fold; at most `max_rows` distinct rows of each class."""
    rows, totals = sampled(docs, labels, max_rows)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sketch(t.as_py()) for t in batch.column(2)], pa.list_(pa.int64()))], ["key", "toxic", "sketch"])

    found = rows.select("key", "toxic", "text").mapInArrow(sketched, "key bigint, toxic int, sketch array<bigint>").collect()
    kept = fresh(sorted((r["key"], r["toxic"], list(r["sketch"])) for r in found))
    share = sum(r["toxic"] for r in found) / len(found) if found else 0.0
    rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in kept], "key bigint")), "key")

    def train(key, group: pd.DataFrame) -> pd.DataFrame:
        samples = [w for text in group.sort_values("key")["text"] for w in windows(text)]
        return pd.DataFrame({"toxic": [key[0]], "pair": [key[1]], "dictionary": [trained(samples)]})

    made = rows.filter("part <> 3").select("key", "toxic", "pair", "text").repartition(2 * PAIRS, "toxic", "pair").groupBy("toxic", "pair").applyInPandas(train, "toxic int, pair int, dictionary binary").collect()
    of = {(r["toxic"], r["pair"]): bytes(r["dictionary"]) for r in made}
    pairs = tuple(Pair(of[0, k], of[1, k]) for k in range(PAIRS) if of.get((0, k)) and of.get((1, k)))
    held = rows.filter("part = 3").select("toxic", "text").repartition(rows.sparkSession.sparkContext.defaultParallelism)

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [p.difference() for p in pairs]
        for batch in batches:
            found = [w for text in batch.column(0) for w in windows(text.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([len(found)], pa.int64()), pa.array([[int(d(found).sum()) for d in asked]], pa.list_(pa.int64()))], ["n", "sums"])

    sums = held.filter("toxic = 0").select("text").mapInArrow(differences, "n bigint, sums array<bigint>").collect()
    n = sum(r["n"] for r in sums)
    if n:
        pairs = tuple(Pair(p.ordinary, p.toxic, sum(r["sums"][k] for r in sums) / n) for k, p in enumerate(pairs))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = saver(pairs)
        for batch in batches:
            values = [measures(g) for g in each(gains, (text.as_py() for text in batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))], ["toxic", "measures"])

    found = held.mapInArrow(measured, "toxic int, measures array<double>").collect()
    return calibrated(pairs, sorted((int(r["toxic"]), list(r["measures"])) for r in found), share, totals)


def together(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows in the order of their texts' beginnings; by ranges with the id's hash behind, so many copies of one text are dealt to several tasks."""
    beginning = F.substring(text_col, 1, BEGINNING)
    return rows.repartitionByRange(beginning, F.xxhash64(id_col)).sortWithinPartitions(beginning)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, held_out, score and predicted for every row of `docs`."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = saver(model.pairs)
        for batch in batches:
            values = [model.score(g) for g in each(gains, (t.as_py() for t in batch.column(2)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())], [id_col, "held_out", "score"])

    rows = docs.select(id_col, (crc_remainder(id_col, 5) == 0).alias("held_out"), text_col)
    if model.pairs:
        rows = together(rows, id_col, text_col)
    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
