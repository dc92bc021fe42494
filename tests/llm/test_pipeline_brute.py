"""The whole pipeline against plain Python, stage by stage from the documents on."""

import hashlib
import math

import numpy as np
import public_tokenizers
from test_duplicates import brute_lines, brute_minhash
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import langid

SF = "/root/testdata/sf0.001"


def brute_targets(sizes, weights=(5, 2, 1), ceiling=3):
    """Shares by weight; what lies above a ceiling is shared again among the rest until nothing does."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, rest = set(sizes), {}, float(sum(sizes.values()))
    while left:
        level = rest / sum(w[s] for s in left)
        over = {s for s in left if level * w[s] > ceiling * sizes[s]}
        if not over:
            return out | {s: level * w[s] if sizes[s] else 0.0 for s in left}
        out |= {s: float(ceiling * sizes[s]) for s in over}
        rest -= sum(out[s] for s in over)
        left -= over
    return out


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    predict = langid.fit(docs).predictor()
    kept = {i: r.text for i, r in rows.items() if (p := predict(r.text))[0] != "und" and p[1] >= corpus_pipeline.MIN_LANGUAGE}
    lines = brute_lines(list(kept.items()))
    kept = {i: t for i, (t, _, gone) in lines.items() if not gone or t.strip()}
    sets, root = brute_minhash(list(kept.items()))
    kept = {i: t for i, t in kept.items() if not sets[i] or root[i] == i}
    sizes = {}
    for i, t in kept.items():
        sizes[rows[i].source] = sizes.get(rows[i].source, 0) + len(t.encode().split())
    target = brute_targets(sizes)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    want = []
    for i, t in kept.items():
        s = rows[i].source
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        draw = int(hashlib.md5(f"gridloom-mix-1:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        copies = math.floor(rate) + (draw < rate - math.floor(rate))
        ids = np.array(tok.encode(t, add_special_tokens=False).ids, "<u4")
        want += [(i, s, len(ids), ids.tobytes())] * copies
    got = [(r.doc_id, r.source, r.n_tokens, bytes(r.tokens)) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want) and len(want) > 50
