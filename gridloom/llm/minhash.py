"""MinHash near-dedup by a multi-index Hamming join (operator 8).

A document's set is its distinct word shingles.  Its signature has `POSITIONS` min-hashes of b = 16
bits; the distance of two signatures is the number of positions where they differ.  Two sets of
Jaccard similarity 0.75 differ in a quarter of the positions on average, and in more than
`DISTANCE` of 48 about once in six thousand pairs.

Signatures within the distance are all found: split into m = 12 chunks of 4 positions, two of them
at distance 23 or less have, by the pigeonhole principle, a chunk with at most floor(23 / 12) = 1
differing position.  So every chunk is entered once for each position that may be wrong, with that
position left out: 48 keys of three values, exact in 64 bits.

Equal sets are one class from the start.  Classes that share a key meet in three steps, none of which
makes the pairs of a group: every class is checked against the nearest of its keys' smallest members;
links are contracted; then members of a key that are still apart are compared by signature, in
blocks that hand on a spanning forest of the pairs within the distance; the trees of these forests
are families.  In families of more than a block, every member is checked against a leader of the family's largest
component, `LED` times over; what still is apart is checked in blocks, skipping what is joined by then.  Every
check is exact, on the full sets of 64-bit shingle hashes.

Defined results: words are what is left of a lower-cased text (A-Z only) between ASCII white space;
fewer than five words make one shingle, none makes an empty set, linked with nothing; repeated rows
are equal sets; rows with a null id are linked like others, but only ids name a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import released, settle
from gridloom.llm.graph import compare, components, forest, in_blocks

SHINGLE = 5
POSITIONS, CHUNK = 48, 4
CHUNKS = POSITIONS // CHUNK
ERRORS = 1
DISTANCE = (ERRORS + 1) * CHUNKS - 1
NUMERATOR, DENOMINATOR = 75, 100
BLOCK, TEXT_BLOCK = 1024, 256
LED, SALTS = 1, 16
CACHE_MAX = 150_000
#: Odd multipliers and offsets of the min-hashes.
_rng = np.random.default_rng(8)
FACTORS = _rng.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """64-bit hashes of words, kept for up to CACHE_MAX words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_MAX:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = Words()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    x = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        x = (x ^ h[i : len(h) - n + 1 + i]) * MIX
        x ^= x >> np.uint64(29)
    return np.unique(x)


def signature(s: np.ndarray) -> np.ndarray:
    """POSITIONS min-hashes of 16 bits."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        part = s[at : at + 4096]
        np.minimum(least, (part[None, :] * FACTORS[:, None] + OFFSETS[:, None]).min(1), out=least)
    return ((least * MIX) >> np.uint64(48)).astype(np.uint16)


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """The 64-bit keys of signatures (rows): chunk and position left out, then the other three values."""
    x = signatures.astype(np.int64)
    out = []
    for chunk in range(CHUNKS):
        for left_out in range(CHUNK):
            a, b, c = (x[:, chunk * CHUNK + i] for i in range(CHUNK) if i != left_out)
            out.append((np.int64(chunk * CHUNK + left_out) << 48) | (a << 32) | (b << 16) | c)
    return np.stack(out, 1)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches the limit, exactly."""
    if not len(a) or not len(b) or min(len(a), len(b)) * DENOMINATOR < max(len(a), len(b)) * NUMERATOR:
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = len(a) - 1
    both = int(np.count_nonzero(a[at] == b))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def row_hashes(id_col: str, text_col: str) -> list[Column]:
    """h1 and h2: 128 bits that stand for a row's id and text."""
    return [F.xxhash64(id_col, text_col).alias("h1"), F.xxhash64(F.lit("second"), id_col, text_col).alias("h2")]


def sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a document: doc, h1, h2 (hashes of id and text), n, f1, f2 (a 128-bit fingerprint of its set), sig."""
    rows = docs.select(F.col(id_col).alias("doc"), *row_hashes(id_col, text_col), F.col(text_col).alias("text"))
    doc_type = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, sig = [], [], [], []
            for text in batch.column(3):
                s = shingles(text.as_py())
                whole = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                f1.append((whole >> 64) - (1 << 63))
                f2.append((whole & ((1 << 64) - 1)) - (1 << 63))
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())], ["doc", "h1", "h2", "n", "f1", "f2", "sig"])

    return rows.mapInArrow(released(run), f"doc {doc_type}, h1 bigint, h2 bigint, n bigint, f1 bigint, f2 bigint, sig binary")


def buckets(classes: DataFrame) -> DataFrame:
    """key, node, leader for every key that classes share; leader is the key's smallest node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = keys_of(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, POSITIONS))
                nodes = np.repeat(batch.column(0).to_numpy(), POSITIONS)
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(nodes)], ["key", "node"])

    entered = classes.select("node", "sig").mapInArrow(released(run), "key bigint, node bigint")
    shared = entered.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader <> last").drop("last")
    return entered.join(shared, "key")


def near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """`pairs` (a, b) with their signatures' distance, those within DISTANCE and of sizes that allow a link."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("n_a", "n_b") * DENOMINATOR >= F.greatest("n_a", "n_b") * NUMERATOR).select("a", "b", "sig_a", "sig_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, POSITIONS) for i in (2, 3))
                d = (x != y).sum(1)
                keep = pa.array(d <= DISTANCE)
                part = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d.astype(np.int32))], ["a", "b", "distance"])
                yield part.filter(keep)

    return rows.mapInArrow(released(run), "a bigint, b bigint, distance int")


def checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links, by the full sets of their texts (node, text)."""
    rows = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            keep = []
            for b, ta, tb in zip(batch.column("b").to_pylist(), batch.column("text_a"), batch.column("text_b")):
                if b != last:
                    last, held = b, shingles(tb.as_py())
                keep.append(similar(shingles(ta.as_py()), held))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(released(run), "a bigint, b bigint")


def apart(shared: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """A spanning forest (a, b) of the pairs that share a key, are within the distance, and are in different components."""
    placed = shared.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    split = placed.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("n")).filter("r1 <> r2").select("key", "n")
    payload = classes.select("node", F.col("n").alias("size"), "sig")
    dealt = in_blocks(placed.join(split, "key").join(payload, "node"), "node", BLOCK)

    def kernel(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        node = group.column("node").to_numpy()
        linked = np.zeros((len(node), len(node)), bool)
        for i, js in candidates(group):
            linked[i, js] = linked[js, i] = True
        a, b = forest(linked, node)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return compare(dealt, ["node", "root", "size", "sig"], kernel, "a bigint, b bigint")


def candidates(group: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Rows i of block p with the rows of block q that are within the distance, of a fitting size and in another component."""
    p, q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
    own, root, size = (group.column(c).to_numpy() for c in ("own", "root", "size"))
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(-1, POSITIONS)
    left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
    for i in left:
        js = right[right > i] if p == q else right
        js = js[(root[js] != root[i]) & (np.minimum(size[js], size[i]) * DENOMINATOR >= np.maximum(size[js], size[i]) * NUMERATOR)]
        if len(js):
            js = js[(sig[js] != sig[i]).sum(1) <= DISTANCE]
        if len(js):
            yield int(i), js


def unsettled(families: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node, root (its component) and n of the members of families (node, root: the family) that hold several components; key is the family."""
    placed = families.select("node", F.col("root").alias("key")).join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    more = placed.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("n")).filter("r1 <> r2").select("key", "n")
    return placed.join(more, "key")


def led(members: DataFrame, classes: DataFrame, texts: DataFrame, turn: int) -> DataFrame:
    """Links (a, b) of `members` (key, node, root) to a leader of their family's largest component: linear in the members.

    A leader's text goes to SALTS keys, over which a family's members are dealt.
    """
    parts = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node")).alias("x"))
    top = parts.groupBy("key").agg(F.max(F.struct("m", "root", F.col("x.node").alias("b"))).alias("top")).select("key", F.col("top.root").alias("led"), F.col("top.b").alias("b"))
    payload = classes.select("node", "n", "sig").join(texts, "node")
    leaders = top.join(payload.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"), F.col("text").alias("text_b")), "b")
    leaders = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = members.select("key", "node", "root", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")).join(payload, "node")
    rows = own.join(leaders, ["key", "salt"]).filter("root <> led").filter(F.least("n", "n_b") * DENOMINATOR >= F.greatest("n", "n_b") * NUMERATOR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            keep = []
            for b, sa, sb, ta, tb in zip(batch.column("b").to_pylist(), *(batch.column(c) for c in ("sig", "sig_b", "text", "text_b"))):
                near_ = (np.frombuffer(sa.as_py(), np.uint16) != np.frombuffer(sb.as_py(), np.uint16)).sum() <= DISTANCE
                if near_ and b != last:
                    last, held = b, shingles(tb.as_py())
                keep.append(bool(near_) and similar(shingles(ta.as_py()), held))
            yield batch.select(["node", "b"]).rename_columns(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.select("node", "b", "sig", "sig_b", "text", "text_b").sortWithinPartitions("b").mapInArrow(released(run), "a bigint, b bigint")


def resolved(members: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between different components of the same family, enough to connect all that are linked; `members` as of `unsettled`.

    A family's members are compared in blocks; within a block, sets are checked exactly, and a pair
    that links found before have joined already is skipped.
    """
    members = members.join(classes.select("node", F.col("n").alias("size"), "sig"), "node").join(texts, "node")
    dealt = in_blocks(members, "node", TEXT_BLOCK)

    def kernel(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        node, size = group.column("node").to_numpy(), group.column("size").to_numpy()
        label = group.column("root").to_numpy().copy()
        held = [shingles(t.as_py()) for t in group.column("text")]
        _, ids = np.unique(np.concatenate(held), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        own = np.zeros(int(ids.max()) + 1, bool)
        a, b = [], []
        for i, js in candidates(group):
            if not (label[js] != label[i]).any():
                continue
            mine = ids[starts[i] : starts[i] + size[i]]
            own[mine] = True
            both = np.add.reduceat(own[ids], starts)[js]
            own[mine] = False
            for j in js[DENOMINATOR * both >= NUMERATOR * (size[i] + size[js] - both)]:
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    a.append(int(node[i]))
                    b.append(int(node[j]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return compare(dealt, ["node", "root", "size", "sig", "text"], kernel, "a bigint, b bigint")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: `id_col`, n_shingles, component_id (the smallest id reachable), keeper, kept, h1 and h2 (`row_hashes`).

    kept: the id is the component's; keeper: the same for a row, also where ids are null or repeated.
    """
    rows = settle(sets(docs, id_col, text_col), "sets")
    # A class is named by its place in the table written here: unlike a hash, no two are the same.
    grouped = rows.filter("n > 0").groupBy("f1", "f2").agg(F.min(F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "h1", "h2")).alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = settle(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    shared = settle(buckets(classes), "buckets")
    stars = settle(near(shared.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), classes), "stars")
    involved = classes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "least.h1", "least.h2")
    texts = docs.select(*row_hashes(id_col, text_col), F.col(text_col).alias("text")).join(involved, ["h1", "h2"]).select("node", "text").dropDuplicates(["node"])
    texts = settle(texts, "texts")
    nearest = stars.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("best")).select("a", "best.b")
    links = settle(checked(nearest, texts), "links")
    roots = components(links)
    families = components(apart(shared, roots, classes))
    open_ = settle(unsettled(families, roots), "members")
    for turn in range(LED):
        large = open_.filter(F.col("n") > TEXT_BLOCK)
        if large.isEmpty():
            break
        links = links.unionByName(settle(led(large, classes, texts, turn), "links"))
        roots = components(links)
        open_ = settle(unsettled(families, roots), "members")
    if not open_.isEmpty():
        roots = components(links.unionByName(settle(resolved(open_, classes, texts), "links")))
    classes_in = classes.join(roots, "node", "left").select("f1", "f2", "least", F.coalesce("root", "node").alias("root"))
    first = classes_in.groupBy("root").agg(F.min("least").alias("first"))
    found = classes_in.join(first, "root").select("f1", "f2", F.col("first.doc").alias("component_id"), F.col("first.h1").alias("k1"), F.col("first.h2").alias("k2"))
    whole = rows.select("doc", "h1", "h2", "n", "f1", "f2").join(found, ["f1", "f2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc"))
    keeper = (F.col("n") == 0) | ((F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    out = whole.select("doc", F.col("n").alias("n_shingles"), component.alias("component_id"), keeper.alias("keeper"), F.coalesce(F.col("doc") == component, F.lit(False)).alias("kept"), "h1", "h2")
    return out.withColumnRenamed("doc", id_col)
