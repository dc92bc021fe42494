"""Personal data: base spans by plain patterns, and bootstrapping by a plain reimplementation."""

import hashlib
import random
import re

from gridloom.llm import pii
from gridloom.llm.queries import QUERIES

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for k, p in BASE.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return ",".join(out)


def check(rows, out):
    for i, t in rows:
        base, r = plain(t or ""), out[i]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (t or "")[:80]
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in base.split(",")) for k in pii.KINDS]


def test_base_fuzz(spark):
    rnd = random.Random(8)
    alphabet = "0123456789012345678901234567890123456789..@@--  ++()abé_%\n"
    rows = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(80)))) for i in range(1500)]
    rows += [(5000, "a@b.com@c.de.f x@y@z.org"), (5001, "1.2.3.4.5.6.7.8 001.002.003.004 256.1.1.1 1.1.1.256.1"), (5002, "4111 1111 1111 1111 4111-1111-1111-1112"), (5003, "1 " * 20000), (5004, "9" * 50000), (5005, "a" * 20000), (5006, "+1" * 300 + "+49 (30) 1234-5678"), (5007, None), (5008, ""), (5009, "😀 me@x.io 😀"), (5010, "1.1" * 5000)]
    out = {r.doc_id: r for r in pii.report(pii.extract(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    check(rows, out)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, {r.doc_id: r for r in QUERIES["op6_pii"](spark, sf).collect()})


def test_contexts_find_unseen_identifiers(spark):
    rnd = random.Random(2)
    rows = [(i, f"some words here reach me at user{i}@mail.example.com today and more") for i in range(8)]
    rows += [(100, "as before reach me at someone@localhost today, number 4"), (101, "the bus at 1234567 left reach me at noon"), (102, "unrelated tag someone@otherhost ends")]
    out = {r.doc_id: r.spans for r in pii.report(pii.extract(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    at = rows[8][1].index("someone")
    assert out[100] == f"email:{at}:{at + len('someone@localhost')}"
    assert out[101] == "" and out[102] == ""
    assert rnd is not None


def test_edges(spark):
    rows = [(None, "me@x.io", "z"), (None, None, "z"), (3, "me@x.io", "z"), (3, "me@x.io", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    out = pii.report(pii.extract(df)).collect()
    assert sorted((str(r.doc_id), r.n_email, r.spans) for r in out) == [("3", 1, "email:0:7"), ("3", 1, "email:0:7"), ("None", 0, ""), ("None", 1, "email:0:7")]
    assert pii.report(pii.extract(df.limit(0))).count() == 0


def brute_spans(rows):
    """The bootstrap in plain Python: spans of every row, base and found."""
    import math

    import regex

    loose = [lambda v: "@" in v[1:-1], lambda v: re.fullmatch(r"[0-9]+(\.[0-9]+){2,}", v), lambda v: re.fullmatch(r"[0-9]([ -]?[0-9]){11,18}", v), lambda v: re.fullmatch(r"\+?[0-9(]([(). -]{0,2}[0-9]){6,14}", v)]
    spots, bases = [], {}
    for i, text in rows:
        base = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in plain(text).split(",") if s)]
        bases[i] = base
        found = [(k, a, b, text[a:b]) for k, a, b in base]
        unknown = []
        for m in re.finditer(r"\S+", text):
            lead = len(re.match(r"[^A-Za-z0-9+@]*", m[0])[0])
            core = re.sub(r"^[^A-Za-z0-9+@]+|[^A-Za-z0-9]+$", "", m[0])
            if re.search("[0-9@]", m[0]) and core:
                unknown.append((m.start() + lead, core))
        for m in re.finditer(r"(?<!\S)\+?\(?[0-9][0-9().-]*( \(?[0-9][0-9().-]*)+", text):
            core = re.sub(r"[^0-9]+$", "", m[0])
            if loose[2](core) or loose[3](core):
                unknown.append((m.start(), core))
        found += [(None, a, a + len(v), v) for a, v in unknown if not any(x < a + len(v) and a < y for _, x, y in base)]
        for k, a, b, v in found:
            word = lambda w: regex.sub(r"[^\p{L}\p{N}=:]", "", w).lower()
            own = re.search(r"\S*$", text[:a])[0]
            before = [word(w) for w in text[: a - len(own)].split()[-2:]]
            before = ["", "", *before, word(own)] if word(own) else ["", "", *before]
            w1, w2 = before[-1], before[-2]
            r1 = next(iter(map(word, re.sub(r"^\S*", "", text[b:]).split()[:1])), "")
            for p in ([f"l2 {w2} {w1}"] if w1 and w2 else []) + ([f"lr {w1} {r1}"] if w1 and r1 else []) + ([f"l1 {w1}"] if w1 else []):
                spots.append((i, a, b, k, v.lower(), p))
    seed, members = {}, {}
    for _, _, _, k, v, p in spots:
        members.setdefault(p, set()).add(v)
        if k is not None:
            seed[v] = min(k, seed.get(v, k))
    values = {v for _, _, _, _, v, _ in spots}
    allowed = {(v, k) for v in values - set(seed) for k in range(4) if loose[k](v)}
    support = {(p, k) for p, vs in members.items() for k in range(4) if sum(seed.get(v) == k for v in vs) >= pii.SUPPORT}
    score = {(v, k): 1.0 for v, k in seed.items()}
    confident, accepted = {}, {}
    for _ in range(pii.ROUNDS):
        confident = {(p, k): c for p, k in support if (c := round(sum(score.get((v, k), 0) for v in members[p]) / (len(members[p]) + 1), 9)) >= pii.CONFIDENT}
        doubt = {}
        for (p, k), c in confident.items():
            for v in members[p]:
                if (v, k) in allowed:
                    doubt[v, k] = doubt.get((v, k), 0) + math.log(1 - min(c, 0.999))
        accepted = {x: s for x, d in doubt.items() if (s := round(1 - math.exp(d), 9)) >= pii.CONFIDENT}
        score = {(v, k): 1.0 for v, k in seed.items()} | accepted
    out = {i: set(b) for i, b in bases.items()}
    for i, a, b, k, v, p in spots:
        if k is None:
            out[i] |= {(kind, a, b) for kind in range(4) if (p, kind) in confident and (v, kind) in accepted}
    return {i: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(s)) for i, s in out.items()}


def test_bootstrap_brute_force(spark):
    rnd = random.Random(11)
    cues = [("write to", lambda: f"u{rnd.randrange(30)}@mail.example.com"), ("write to", lambda: f"u{rnd.randrange(9)}@localhost"), ("call me", lambda: f"+1 (20{rnd.randrange(9)}) 555-01{rnd.randrange(10, 99)}"), ("call me", lambda: f"55501{rnd.randrange(10, 16)}"), ("host is", lambda: f"10.0.{rnd.randrange(300)}.{rnd.randrange(9)}"), ("host is", lambda: f"10.{rnd.randrange(20)}.7"), ("call me", lambda: f"(20{rnd.randrange(3)}) 555 0{rnd.randrange(100, 103)}"), ("card no", lambda: "4111 1111 1111 1111"), ("card no", lambda: f"4{rnd.randrange(100, 400)}-1111 1111 1111"), ("card no", lambda: rnd.choice(["4012888888881881", "5105105105105100", "5555555555554444", "378282246310005"])), ("see page", lambda: str(rnd.randrange(1000, 1020)))]
    rows = []
    for i in range(300):
        parts = []
        for _ in range(rnd.randrange(4)):
            cue, make = rnd.choice(cues)
            parts.append(f"{rnd.choice(['so', 'then', 'now'])} {cue if rnd.random() < 0.8 else 'odd'} {make()}{rnd.choice(['', ',', '.'])} {rnd.choice(['please', 'today', 'soon'])}")
        rows.append((i, "\n".join(parts)))
    want = brute_spans(rows)
    out = {r.doc_id: r.spans for r in pii.report(pii.extract(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    assert out == want
    spaced = [(i, m.start()) for i, t in rows for m in re.finditer(r"\(20.\) 555 0", t)]
    assert any(f"phone:{a}:" in out[i] for i, a in spaced)
    assert sum(len(w.split(",")) for w in want.values() if w) > sum(len(plain(t).split(",")) for _, t in rows if plain(t))
