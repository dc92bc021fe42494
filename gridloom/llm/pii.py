"""Personal data by bootstrapped contextual extraction (operator 6), in SQL functions only.

Base entities (e-mail, IP address, card number, phone number) are found by patterns and are the
seeds.  Every word with a digit or an @ is an instance too, without the punctuation around it, and every run of digit
groups between single spaces that has a loose shape, unless a base span overlaps it.  The words around an instance are its
lexical patterns: two words to the left, one to the left and one to the right, one to the left; what stands before it in
its own word counts as a word.
Patterns and values form a graph.  A pattern's confidence in a kind is the sum of its values' scores
over one more than their number; an unknown value's score for a kind whose loose shape it has is one
minus the product of its patterns' doubts.  `ROUNDS` rounds pass scores along the distinct edges; then unknown
values that confident patterns, each with at least `SUPPORT` seeds, hold to be of a kind become spans of that kind.

Positions are code points.  A match's place follows from the lengths of the matches and gaps before
it, so that time is linear in the text.  The patterns' repeats are possessive and guarded by a look behind where that changes no match, so they take
linear time and no stack on very long texts.

Defined results: a null text is the empty text; its row has no spans and the hash of the empty
string; equal rows get equal results; a null id is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import settle

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SUPPORT = 3
CONFIDENT = 0.6
# The base patterns, with possessive repeats; what a match must be beyond them.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARDS = {"email": "contains(text, '@')", "ip": "text rlike r'[0-9]\\.[0-9]'", "card": "text rlike r'[0-9]'", "phone": "contains(text, '+')"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
DIGITS = "regexp_replace(x.v, r'[^0-9]', '')"
DIGIT = f"cast(substring({DIGITS}, -i, 1) as bigint)"
LUHN = f"aggregate(sequence(1, length({DIGITS})), 0L, (t, i) -> t + if(i % 2 = 1, {DIGIT}, (2 * {DIGIT}) div 10 + (2 * {DIGIT}) % 10)) % 10 = 0"
PASSES = {
    "email": "true",
    "ip": rf"x.v rlike r'^{OCTET}(?:\.{OCTET}){{3}}$'",
    "card": f"length({DIGITS}) between 13 and 19 and {LUHN}",
    "phone": f"length({DIGITS}) between 9 and 15",
}
#: Two or more groups of digits with single spaces between: how cards and phones are written in parts.
RUN = r"(?<!\S)\+?\(?[0-9][0-9().-]*+(?:\x20\(?[0-9][0-9().-]*+)++"
#: The loose shapes that a context may turn into a kind.
LOOSE = {
    "email": "value like '%_@_%'",
    "ip": r"value rlike r'^[0-9]+(?:\.[0-9]+){2,}$'",
    "card": r"value rlike r'^[0-9](?:[\x20-]?[0-9]){11,18}$'",
    "phone": r"value rlike r'^\+?[0-9(](?:[().\x20-]{0,2}[0-9]){6,14}$'",
}
CHUNK = 64
NOTHING = "cast(array() as array<struct<s:bigint,e:bigint,v:string,wi:int,we:int>>)"
PART = "cast(array() as array<struct<v:string,g:bigint,m:bigint,c:int,d:int>>)"


def placed(rows: DataFrame, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """`rows` (with text) and, for each name of `patterns` (pattern, guard), its matches: start, end, value, first and last word (by white space before).

    Places are running sums over the gaps and matches before, summed CHUNK at a time, so that no array
    is rebuilt for every match: linear in the text up to millions of matches.
    """
    kept = rows.columns
    parts = lambda p: f"zip_with(regexp_extract_all(text, r'{p}', 0), split(text, r'{p}', -1), (x, y) -> named_struct('v', x, 'g', cast(length(y) as bigint), 'm', cast(coalesce(length(x), 0) as bigint), 'c', regexp_count(y, r'\\s+'), 'd', coalesce(regexp_count(x, r'\\s+'), 0)))"
    rows = rows.select(*kept, *(F.expr(f"if({guard}, {parts(p)}, {PART})").alias(f"p_{k}") for k, (p, guard) in patterns.items()))
    chunks = lambda k: f"if(size(p_{k}) = 0, array({PART}), transform(sequence(0, (size(p_{k}) - 1) div {CHUNK}), i -> slice(p_{k}, cast(i as int) * {CHUNK} + 1, {CHUNK})))"
    rows = rows.select(*kept, *(F.expr(chunks(k)).alias(f"c_{k}") for k in patterns))
    sums = "aggregate(c, 0L, (t, x) -> t + x.g + x.m)", "aggregate(c, 0, (t, x) -> t + x.c + x.d)"
    starts = lambda k: f"aggregate(c_{k}, named_struct('at', 0L, 'w', 0, 'out', cast(array() as array<struct<at:bigint,w:int>>)), (a, c) -> named_struct('at', a.at + {sums[0]}, 'w', a.w + {sums[1]}, 'out', array_append(a.out, named_struct('at', a.at, 'w', a.w))), a -> a.out)"
    rows = rows.select(*kept, *(f"c_{k}" for k in patterns), *(F.expr(starts(k)).alias(f"s_{k}") for k in patterns))
    step = "named_struct('at', a.at + x.g + x.m, 'w', a.w + x.c + x.d, 'out', if(x.v is null, a.out, array_append(a.out, named_struct('s', a.at + x.g, 'e', a.at + x.g + x.m, 'v', x.v, 'wi', a.w + x.c, 'we', a.w + x.c + x.d))))"
    done = lambda k: f"flatten(zip_with(c_{k}, s_{k}, (c, z) -> aggregate(c, named_struct('at', z.at, 'w', z.w, 'out', {NOTHING}), (a, x) -> {step}, a -> a.out)))"
    return rows.select(*kept, *(F.expr(done(k)).alias(k) for k in patterns))


def word(found: str) -> str:
    return rf"lower(regexp_replace(coalesce({found}, ''), r'[^\p{{L}}\p{{N}}=:]', ''))"


def found_in(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, base (spans with kind) and instances (with kind or null, place, value and the words around) of every row."""
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    some = "text rlike r'[0-9@]'"
    rows = placed(rows, {k: (PATTERNS[k], GUARDS[k]) for k in KINDS} | {"run": (RUN, r"text rlike r'[0-9]\x20\(?[0-9]|\)\x20\(?[0-9]|[.-]\x20\(?[0-9]'"), "gap": (r"\s+", some)})
    base = ", ".join(f"transform(filter({k}, x -> {PASSES[k]}), x -> named_struct('k', {i}, 's', x.s, 'e', x.e, 'v', x.v, 'wi', x.wi, 'we', x.we))" for i, k in enumerate(KINDS))
    rows = rows.select("doc", F.expr(f"concat({base})").alias("base"), "run", F.expr(rf"if({some}, split(text, r'\s+', -1), cast(array() as array<string>))").alias("words"), F.expr("concat(array(0L), transform(gap, x -> x.e))").alias("starts"))
    # A word without the punctuation around it, and a run of digit groups without what follows its last digit.
    lead, core = "length(regexp_extract(x.v, r'^[^A-Za-z0-9+@]*', 0))", "regexp_replace(x.v, r'^[^A-Za-z0-9+@]+|[^A-Za-z0-9]+$', '')"
    tokens = f"transform(filter(transform(words, (v, i) -> named_struct('v', v, 'i', i)), x -> x.v rlike r'[0-9@]'), x -> named_struct('k', cast(null as int), 's', starts[x.i] + {lead}, 'e', starts[x.i] + {lead} + length({core}), 'v', {core}, 'wi', x.i, 'we', x.i))"
    whole = "transform(run, x -> named_struct('k', cast(null as int), 's', x.s, 'e', x.s + length(regexp_replace(x.v, r'[^0-9]+$', '')), 'v', regexp_replace(x.v, r'[^0-9]+$', ''), 'wi', x.wi, 'we', x.we))"
    shaped = " or ".join(LOOSE[k].replace("value", "x.v", 1) for k in ("card", "phone"))
    rows = rows.select("doc", "base", "words", "starts", F.expr(f"concat(base, filter({tokens}, x -> x.v <> ''), filter({whole}, x -> {shaped}))").alias("all"))
    around = "transform(all, x -> named_struct('k', x.k, 's', x.s, 'e', x.e, 'v', x.v, 'wi', x.wi, 'we', x.we, 'f', substring(words[x.wi], 1, cast(x.s - starts[x.wi] as int)), 'p', get(words, x.wi - 1), 'q', get(words, x.wi - 2), 'r', get(words, x.we + 1)))"
    return rows.select("doc", F.expr("transform(base, b -> named_struct('k', b.k, 's', b.s, 'e', b.e))").alias("base"), F.expr(around).alias("instances"))


def occurrences(found: DataFrame) -> DataFrame:
    """One row an instance and lexical pattern: node, s, e, kind (null: unknown), value, pattern.

    Unknown instances that a base span overlaps are left out: both are joined by the words they stand in.
    """
    one = found.filter("size(instances) > 0").select("node", F.explode("instances").alias("x")).select("node", "x.*")
    at = lambda which: one.filter(which).select("node", "s", "e", F.explode(F.sequence("wi", "we")).alias("w"))
    taken = at("k is not null").withColumnsRenamed({"s": "bs", "e": "be"})
    over = at("k is null").join(taken, ["node", "w"]).filter("bs < e and s < be").select("node", "s", "e").distinct()
    left = one.filter("k is not null").unionByName(one.filter("k is null").join(over, ["node", "s", "e"], "left_anti"))
    words = left.selectExpr("node", "s", "e", "k as kind", "lower(v) as value", f"{word('f')} as f", f"{word('p')} as p", f"{word('q')} as q", f"{word('r')} as r1")
    words = words.selectExpr("node", "s", "e", "kind", "value", "if(f <> '', f, p) as w1", "if(f <> '', p, q) as w2", "r1")
    patterns = "filter(array(if(w1 <> '' and w2 <> '', concat('l2 ', w2, ' ', w1), null), if(w1 <> '' and r1 <> '', concat('lr ', w1, ' ', r1), null), if(w1 <> '', concat('l1 ', w1), null)), p -> p is not null)"
    return words.selectExpr("node", "s", "e", "kind", "value", f"explode({patterns}) as pattern")


def bootstrap(spots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confident (pattern, kind, confidence) and accepted (value, kind, score), by rounds over the distinct edges."""
    edges = settle(spots.groupBy("pattern", "value").agg(F.min("kind").alias("seed")), "edges")
    sizes = settle(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size")), "sizes")
    seeds = edges.filter("seed is not null").groupBy("value").agg(F.min("seed").alias("kind"))
    unknown = edges.join(seeds, "value", "left_anti").select("value").distinct()
    shapes = F.array_compact(F.array(*(F.when(F.expr(LOOSE[k]), F.lit(i)) for i, k in enumerate(KINDS))))
    open_values = settle(unknown.select("value", F.explode(shapes).alias("kind")), "open")
    support = edges.select("pattern", "value").join(seeds, "value").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds")).filter(F.col("seeds") >= SUPPORT)
    support = settle(support.join(sizes, "pattern"), "support")
    scores = seeds.select("value", "kind", F.lit(1.0).alias("score"))
    confident = accepted = None
    for _ in range(ROUNDS):
        sums = edges.select("pattern", "value").join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("total"))
        confident = settle(support.join(sums, ["pattern", "kind"]).select("pattern", "kind", F.round(F.col("total") / (F.col("size") + 1), 9).alias("confidence")).filter(F.col("confidence") >= CONFIDENT), "patterns")
        doubts = edges.select("pattern", "value").join(confident, "pattern").join(open_values, ["value", "kind"]).groupBy("value", "kind").agg(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))).alias("doubt"))
        accepted = settle(doubts.select("value", "kind", F.round(1 - F.exp("doubt"), 9).alias("score")).filter(F.col("score") >= CONFIDENT), "values")
        scores = seeds.select("value", "kind", F.lit(1.0).alias("score")).unionByName(accepted)
    return confident, accepted


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: `id_col`, base and spans (arrays of kind number, start, end, by kind, then start)."""
    # A row is named by its place in the table written here.
    found = settle(found_in(docs, id_col, text_col).withColumn("node", F.monotonically_increasing_id()), "entities")
    spots = settle(occurrences(found), "spots")
    confident, accepted = bootstrap(spots)
    new = spots.filter("kind is null").select("node", "s", "e", "value", "pattern").join(confident.select("pattern", "kind"), "pattern").join(accepted.select("value", "kind"), ["value", "kind"])
    added = new.groupBy("node").agg(F.collect_set(F.struct(F.col("kind").alias("k"), "s", "e")).alias("added"))
    spans = "array_sort(array_union(base, coalesce(added, cast(array() as array<struct<k:int,s:bigint,e:bigint>>))))"
    return found.select("doc", "node", "base").join(added, "node", "left").selectExpr(f"doc as `{id_col}`", "array_sort(base) as base", f"{spans} as spans")


def written(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans, written as kind:start:end."""
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(id_col, *counts, F.expr(f"sha2(cast({written('base')} as binary), 256)").alias("base_sha256"), F.expr(written("spans")).alias("spans"))
