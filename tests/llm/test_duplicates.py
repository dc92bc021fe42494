"""Mixing, embeddings, MinHash and line dedup against brute force, with nulls, ties, repeats and hot groups."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import embeddings, graph, linedup, minhash, mixing
from gridloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_minhash(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    shared = {(a, b) for m in index.values() if len(m) > 1 for a in m for b in m if a < b}
    links = [(a, b) for a, b in shared if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, components(sets, links)


def family(rnd, words, n, changes):
    base = [rnd.choice(words) for _ in range(120)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rnd.randrange(changes)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        out.append(" ".join(t))
    return out


def test_minhash_brute_force(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    texts = ["A b C d e", "a B c D e", "x", "X", "", None, "one two", "a b c d e f"]
    passage = " ".join(rnd.choice(words) for _ in range(30))
    for _ in range(12):
        texts += family(rnd, words, 12, 9)
    texts += [passage + " " + " ".join(rnd.choice(words) for _ in range(40)) for _ in range(60)]
    texts += family(rnd, words, 150, 14)
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    want_sets, want = brute_minhash(rows)
    assert len(set(want.values())) > 60
    out = {r.doc_id: r for r in minhash.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, _ in rows:
        assert (out[i].n_shingles, out[i].component_id, out[i].kept) == (len(want_sets[i]), want[i], want[i] == i)
        assert out[i].keeper == out[i].kept


def test_minhash_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sets, want = brute_minhash(rows)
    out = {r.doc_id: r for r in QUERIES["op8_minhash"](spark, SF).collect()}
    assert {i: r.component_id for i, r in out.items()} == want and all(out[i].n_shingles == len(s) for i, s in sets.items())


def test_minhash_pigeonhole():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, minhash.POSITIONS, dtype=np.uint16)
        b = a.copy()
        at = rng.choice(minhash.POSITIONS, minhash.DISTANCE, replace=False)
        b[at] ^= 1
        assert (minhash.keys_of(a[None]) == minhash.keys_of(b[None])).any()


def test_minhash_edges(spark):
    rows = [(None, "p q r s t u v w"), (None, "p q r s t u v w"), (3, "p q r s t u v w"), (7, "only null ids next"), (None, "lone text without any id here"), (9, None), (9, None), (11, "word " * 30000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, node string")
    out = minhash.dedup(df).collect()
    assert len(out) == len(rows)
    assert sorted(str(r.component_id) for r in out) == sorted(map(str, [3, 3, 3, 7, None, 9, 9, 11]))
    assert sum(r.keeper for r in out) == 6
    assert minhash.dedup(df.limit(0)).count() == 0


def test_components_long_chain_and_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, j) for j in range(1001, 1300)] + [(5000, 5000)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[j] == 1000 for j in range(1000, 1300)) and 5000 not in got


def brute_vectors(rows):
    ok = {}
    for i, v in rows:
        if v and all(x is not None for x in v) and np.isfinite(v).all() and np.any(v):
            x = np.array(v, float)
            ok[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.9]
    return links, components([i for i, _ in rows], links)


def test_embeddings_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(12):
        base = rng.standard_normal(32)
        rows += [base + rng.standard_normal(32) * s for s in (0, 0, 0.05, 0.2, 0.3)]
    hot = rng.standard_normal(32)
    rows += [hot + rng.standard_normal(32) * 0.1 for _ in range(150)] + [hot] * 40
    rows = [list(map(float, np.float32(r))) for r in rows]
    rows += [None, [], [0.0] * 32, [1.0, None] * 16, [float("nan")] + [1.0] * 31, [float("inf")] * 32, [3.0, 4.0], [6.0, 8.0]]
    rows = list(enumerate(rows))
    links, want = brute_vectors(rows)
    out = {r.vec_id: r for r in embeddings.link(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert sum(r.n_links for r in out.values()) >= 0.98 * sum(degree.values())
    for i, _ in rows:
        assert out[i].n_links <= degree[i]
    assert np.mean([out[i].component_id == want[i] for i, _ in rows]) > 0.99
    assert all(r.kept == (r.component_id == i) for i, r in out.items())


def test_embeddings_edges(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (5, None, 2)], "vec_id bigint, embedding array<double>, node int")
    out = embeddings.link(df).collect()
    assert sorted((r.n_links, str(r.component_id)) for r in out) == [(0, "5")] + [(3, "4")] * 4
    assert embeddings.link(df.limit(0)).count() == 0


def test_embeddings_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(9)
    hot = rng.standard_normal(16)
    rows = [(i, list(map(float, hot + rng.standard_normal(16) * 0.2))) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    whole = sorted(embeddings.link(df).collect())
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    assert sorted(embeddings.link(df).collect()) == whole


def brute_lines(rows):
    first, later = {}, defaultdict(set)
    for i, t in sorted(rows):
        l = t.split("\n") if t else []
        for k in range(len(l) - 2):
            w = "\n".join(l[k : k + 3])
            if not w.strip():
                continue
            if w in first:
                later[i] |= {k, k + 1, k + 2}
            else:
                first[w] = (i, k)
    out = {}
    for i, t in rows:
        l = t.split("\n") if t is not None else []
        out[i] = (None if t is None else "\n".join(x for k, x in enumerate(l) if k not in later[i]), len(l), len(later[i]))
    return out


def test_line_dedup_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, "\n".join(rnd.choice("abcd") for _ in range(rnd.randrange(12)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "\n\n\n\n"), (203, "a\nb"), (204, "z\n" * 50), (205, "line\n" + "x" * 100_000 + "\nend")] + [(300 + i, "hot one\nhot two\nhot three\nown %d" % i) for i in range(60)]
    out = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out == brute_lines(rows)


def test_line_dedup_edges(spark):
    text = "a\nb\nc\nd"
    rows = [(1, text, 5), (1, text, 5), (None, text, 5), (None, text, 5), (2, "q", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_lines int")
    out = sorted(((str(r.doc_id), r.text, r.n_lines) for r in linedup.dedup(df).collect()))
    assert out == [("1", "", 4), ("1", "", 4), ("2", "q", 1), ("None", text, 4), ("None", text, 4)]
    assert linedup.dedup(df.limit(0)).count() == 0


def test_mixing_targets(spark):
    sizes = [("b", 1000), ("a", 10), (None, 7), ("c", 0), ("d", 500)]
    t = {r.source: r for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size bigint")).collect()}
    assert {k: r.weight for k, r in t.items()} == {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    assert abs(sum(r.target for r in t.values()) - 1517) < 1e-6
    assert all(r.target <= 3 * r.source_size + 1e-9 for r in t.values())
    assert t["a"].target == 30 and t[None].target == 21 and t["c"].target == 0
    assert abs(t["d"].target / t["b"].target - 2.5) < 1e-9


@pytest.mark.parametrize("small", [True, False])
def test_mixing_takes_near_target(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", -1)
    rnd = random.Random(7)
    rows = [(i, "w " * rnd.randrange(1, 40), f"s{min(int(rnd.expovariate(0.7)), 5)}", 1) for i in range(4000)] + [(None, None, None, 1), (None, "x y", None, 1), (9, "", "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, mix_size int")
    plan = mixing.plan(docs).collect()
    assert len(plan) == len(rows)
    taken, target, size = defaultdict(int), {}, {}
    for r in plan:
        assert 0 <= r.mix_copies <= 3 and r.mix_size == len((r.text or "").split())
        taken[r.source] += r.mix_size * r.mix_copies
        target[r.source], size[r.source] = r.mix_target, r.mix_source_size
    for s in taken:
        if s is not None:
            assert abs(taken[s] - target[s]) < 0.12 * target[s] + 60
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.mix_copies for r in plan)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_draw_is_md5():
    assert int(hashlib.md5(b"gridloom-mix-1:17").hexdigest()[:13], 16) / (1 << 52) < 1


@pytest.mark.parametrize("at_once", [graph.AT_ONCE, 0])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, at_once):
    """The search in one task and the rounds give the same components; no edges, loops and repeats included."""
    rng = random.Random(3)
    links = [(rng.randrange(-500, 500) * 7, rng.randrange(-500, 500) * 7) for _ in range(420)]
    links += links[:30] + [(b, a) for a, b in links[30:60]] + [(21, 21)] + [(10**12 + i, 10**12 + i + 1) for i in range(60)]
    monkeypatch.setattr(graph, "AT_ONCE", at_once)
    got = graph.components(spark.createDataFrame(links, "a bigint, b bigint").repartition(7)).collect()
    expected = components({n for link in links if link[0] != link[1] for n in link}, [x for x in links if x[0] != x[1]])
    assert {r.node: r.root for r in got} == expected and len(got) == len(expected)
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_of_few_edges_take_few_jobs(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(300)], "a bigint, b bigint")
    spark.sparkContext.setJobGroup("components", "")
    graph.components(links).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("components")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) <= 12
