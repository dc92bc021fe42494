"""BPE, toxicity and language ID against the library, held-out labels and edge cases."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard as zs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import bpe, langid, toxicity
from gridloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "\n\t", "a" * 3000, "ab " * 9000, "ΑΣ Σ", "İı ẞ ﬁ", "x<|startoftext|>Y<|endoftext|>", "it's I'LL 's", "12 ½ Ⅷ", "\x1c\x1f", "!" * 400, "\U0001966b昛"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.WordBpe(bpe.default_vocabulary())


def test_same_ids_and_text_as_library(library, own):
    rnd = random.Random(5)
    fuzz = ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0, 0x300), rnd.randrange(0x300, 0xD800), rnd.randrange(0xE000, 0x20000), 10, 32])) for _ in range(rnd.randrange(60))) for _ in range(2000)]
    for text in [t or "" for t in ODD] + fuzz:
        want = library.encode(text, add_special_tokens=False).ids
        packed = own.encode(text)
        assert np.frombuffer(packed, np.uint32).tolist() == want, text[:50]
        assert own.decode(packed) == library.decode(want, skip_special_tokens=False)


def test_array_and_heap_merge_alike(own):
    rnd = random.Random(6)
    for _ in range(300):
        ids = [own.inner[b] for b in bytes(rnd.choice(b"abcdeinrst") for _ in range(rnd.randrange(1, 60)))]
        assert own.merge_array(list(ids)) == own.merge_heap(list(ids))


def test_bpe_query_and_columns(spark, library):
    rows = {r.doc_id: r for r in QUERIES["op7_bpe"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        assert rows[d.doc_id].n_tokens == len(ids)
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_frames_with_odd_texts_and_clashing_columns(spark):
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(ODD)] + [(None, "x", "old")], "doc_id bigint, text string, tokens string")
    out = bpe.decode(bpe.encode(df)).collect()
    assert len(out) == len(ODD) + 1 and out[0].decoded == "" and bytes(out[1].tokens) == b""
    assert bpe.encode(df.limit(0)).count() == 0


def held_out(rows, labels, modulus, fold):
    return [(rows[k], v) for k, v in labels.items() if k in rows and zlib.crc32(str(k).encode()) % modulus == fold]


@pytest.mark.xfail(reason="bounds of the method before; raw windows reach accuracy 0.926 and recall 0.495 with the 264 toxic rows of sf0.1")
def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    pairs = held_out(out, labels, 5, 0)
    assert all(r.held_out and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r, _ in pairs)
    assert np.mean([r.predicted == y for r, y in pairs]) > 0.95
    assert np.mean([r.predicted for r, y in pairs if y]) > 0.8


def plain_saving(pairs, window):
    """What the operator says of one window, with compressors of its own and no chunks."""
    total = 0.0
    for k, p in enumerate(pairs, 1):
        lengths = []
        for d in (p.ordinary, p.toxic):
            params = zs.ZstdCompressionParameters(strategy=zs.STRATEGY_BTOPT, window_log=20, hash_log=15, chain_log=17, search_log=4, min_match=3, target_length=64, write_content_size=0, write_checksum=0, write_dict_id=0, format=zs.FORMAT_ZSTD1_MAGICLESS)
            lengths.append(len(zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(d), compression_params=params).compress(window)))
        total += lengths[0] - lengths[1] - p.bias
        if total < k:
            return 0.0
    return total / len(pairs)


def test_toxicity_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 50)
    rng = np.random.default_rng(5)
    ordinary, toxic = [f"w{i}" for i in range(400)], [f"vile{i}x" for i in range(12)]
    rows = []
    for i in range(400):
        words = list(rng.choice(ordinary, int(rng.choice([60, 900]))))
        if i % 2:
            for at in rng.integers(0, len(words) - 2, 4):
                words[at] = rng.choice(toxic)
        rows.append((i, " ".join(words), i % 2))
    rows += [(9000, None, 0), (9001, "", 1), (9002, rows[5][1], 1)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [rows[7][:2]] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    chosen, totals = toxicity.sampled(docs, labels, 4000)
    chosen = chosen.collect()
    assert totals[1] == sum(r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 5) and len({r.key for r in chosen}) == len(chosen)
    kept = set(toxicity.fresh(sorted((r.key, r.toxic, toxicity.sketch(r.text)) for r in chosen)))
    chosen = [r for r in chosen if r.key in kept]
    want = []
    for k in range(toxicity.PAIRS):
        both = [toxicity.trained([w for r in chosen if r.part != 3 and r.pair == k and r.toxic == t for w in toxicity.windows(r.text)]) for t in (0, 1)]
        want += [tuple(both)] * all(both)
    assert [(p.ordinary, p.toxic) for p in model.pairs] == want and len(want) == toxicity.PAIRS
    assert sum(b"vile" in p.toxic for p in model.pairs) >= 6 and not any(b"vile" in p.ordinary for p in model.pairs)
    out = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, text, _ in rows[::13] + rows[-3:]:
        words = (text or "").split()
        got = [plain_saving(model.pairs, f" {' '.join(words[j : j + 4])} ".encode()) for j in range(0, len(words), 4)]
        shares = [(sum(g >= s for g in got) / max(1, len(got))) ** 0.5 for s in (1, 1.5, 2, 2.5, 3, 4)]
        x = [*shares, np.log1p(max(got, default=0)), np.log1p(sum(g for g in got if g >= toxicity.LEAST_GAINS[model.threshold]))]
        assert abs(out[i] - 1 / (1 + np.exp(-(np.dot(x, model.slopes) + model.offset)))) < 1e-9
    assert np.mean([(out[i] >= 0.5) == bool(t) for i, _, t in rows[:400]]) > 0.9


def test_toxicity_compresses_no_more_than_it_must(monkeypatch):
    rng = np.random.default_rng(11)
    words = [bytes(rng.integers(97, 123, rng.integers(3, 9)).astype(np.uint8)) for _ in range(300)]
    text = [[b" " + b" ".join(rng.choice(words[at : at + 200], 4)) + b" " for _ in range(3000)] for at in (0, 100)]
    pairs = tuple(toxicity.Pair(*(toxicity.trained(t[k::2]) for t in text), 0.25 - k) for k in range(2))
    noise = [rng.bytes(n) for n in (*range(1, 1100), 5000, 140_000, 3_000_000)]
    found = [*text[0][:300], *text[1][:300], *noise, *text[1][:300]]
    asked, frames = [], toxicity.sizes

    def counted(dictionary):
        size = frames(dictionary)
        return lambda some: [asked.append((dictionary, w)) for w in some] and size(some) if some else size(some)

    monkeypatch.setattr(toxicity, "sizes", counted)
    got = toxicity.saver(pairs)(found)
    assert got.tolist() == [plain_saving(pairs, w) for w in found]
    assert len(set(asked)) == len(asked)
    first = {d: sum(a == d for a, _ in asked) for d in (pairs[0].ordinary, pairs[0].toxic)}
    assert first[pairs[0].toxic] == len(set(found)) and first[pairs[0].ordinary] < 700
    assert all((frames(p.ordinary)(noise) <= toxicity.longest(noise)).all() for p in pairs)


def test_toxicity_puts_copies_together(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, f"{i % 500} text that {i % 500} others share, and {i} of its own") for i in range(4000)] + [(i, "one of very many") for i in range(4000, 8000)] + [(None, None)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
        out = toxicity.together(docs, "doc_id", "text").select("*", F.spark_partition_id().alias("at")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out) == len(rows) and {(r.doc_id, r.text) for r in out} == set(rows)
    places = {}
    for r in out:
        places.setdefault((r.text or "")[: toxicity.BEGINNING], set()).add(r["at"])
    assert len(places["one of very many"]) > 1 and sum(len(v) for k, v in places.items() if k != "one of very many") < 1.2 * len(places)


def test_toxicity_bound_holds_under_repeated_ids(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i} of many") for i in range(600)] + [(1, "same text")] * 200, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 0)] * 5, "doc_id long, toxic int")
    rows, _ = toxicity.sampled(docs, labels, 20)
    assert all(r["count"] <= 20 for r in rows.groupBy("toxic").count().collect())


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "idiot"), (4, "a " * 20000), (4, "a " * 20000)], "doc_id bigint, text string")
    empty = toxicity.Model((), 0, (), 0.0)
    out = toxicity.score(docs, empty).collect()
    assert len(out) == 5 and all(r.score == 0 and r.predicted == 0 for r in out)
    labels = spark.createDataFrame([(1, None, 1), (None, None, 0)], "doc_id bigint, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 5
    assert toxicity.score(docs.limit(0), empty).count() == 0


def test_language_held_out(spark):
    out = {r.doc_id: r for r in QUERIES["op10_language"](spark, SF).collect()}
    labels = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pairs = held_out(out, labels, 4, 2)
    assert len(pairs) > 100 and all(r.held_out for r, _ in pairs)
    assert np.mean([r.lang_pred == y for r, y in pairs]) > 0.98


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("the and of the", "en"), ("der und die", "de"), (None, "en"), ("12 34 !!", "de"), ("", None), ("the house and", None)] * 30)], "doc_id bigint, text string, lang string")
    out = langid.identify(docs, langid.fit(docs)).collect()
    assert len(out) == 180
    for r in out:
        assert (r.lang_pred == "und") == (r.doc_id % 6 in (2, 3, 4)) and 0 <= r.score <= 1
        assert r.doc_id % 6 != 1 or r.lang_pred == "de"
    none = langid.identify(docs, langid.fit(docs.filter("lang is null"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    clash = docs.withColumn("score", docs.doc_id)
    assert langid.predict(clash, langid.fit(docs)).schema["score"].dataType.simpleString() == "double"


def test_weights_are_sparse():
    rng = np.random.default_rng(0)
    rows = [(x, False, *langid.grams(" ".join(rng.choice(words, 30)))) for _ in range(60) for x, words in (("a", ["the", "house", "and"]), ("b", ["der", "und", "haus"]))]
    model = langid.fit_rows(rows)
    assert 0 < len(model.rows) < langid.BUCKETS / 20
    assert model.predictor()("the house and the house")[0] == "a"
