"""User columns with the names that operators use inside come back as they were, and change nothing."""

import struct

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import langid, linedup, mixing, ogg

NAMES = """mix_size mix_source_size mix_target mix_copies mix_draw mix_source mix_of mix_copy mix_salt mix_row_salt doc copy place weight
starts line_doc line_key line_key_of n_lines n_removed at hash first w c0 c1 lang_pred score held pick n of_lang keeper keeper_node node node2 h1 h2
own_0 own_5 key root a b n_tokens tokens decoded""".split()
ROWS = [(i, f"the house and the tree {i}\nline of many words here {i % 7}\nand another one\nthe same for all\nof them" if i % 9 else None, "en" if i % 2 else None, f"s{i % 3}", 10 + i) for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS + ROWS[:3], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *(F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in NAMES))


def own_columns_are_whole(df, names):
    bad = [n for n in names if df.filter(~F.col(n).eqNullSafe(F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")))).count()]
    assert not bad


def same(a, b, names):
    assert sorted(map(str, a.select(*names).collect())) == sorted(map(str, b.select(*names).collect()))


def test_mixing(docs, clashing):
    out = mixing.mix(clashing).cache()
    assert out.columns == clashing.columns
    own_columns_are_whole(out, NAMES)
    same(out, mixing.mix(docs), docs.columns)
    plan = mixing.plan(clashing)
    same(plan, mixing.plan(docs), [*docs.columns, *mixing.OUTPUTS])


def test_line_dedup(docs, clashing):
    out = linedup.dedup(clashing).cache()
    own_columns_are_whole(out, [n for n in NAMES if n not in ("n_lines", "n_removed")])
    same(out, linedup.dedup(docs), [*docs.columns, "n_lines", "n_removed"])


def test_stages(spark, docs, clashing):
    plain, odd = docs, clashing
    for name, stage in corpus_pipeline.STAGES:
        plain, odd = stage(spark, plain, ""), stage(spark, odd, "")
        if name != "bpe_encoding":
            assert odd.columns == clashing.columns
            odd = odd.cache()
            own_columns_are_whole(odd, NAMES)
        same(plain, odd, plain.columns)


def test_languages_are_bounded(spark):
    rows = [(i, f"word {i} of many", f"x{i}") for i in range(300)] + [(1000 + i, "the and of", "en") for i in range(50)] + [(7, f"again {i}", "en") for i in range(900)] + [(7, "again 1", "en")] * 300
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), per_language=30, most_languages=5)
    assert len(model.languages) == 5 and "en" in model.languages


def test_ogg_packets_of_foreign_streams(spark):
    header = struct.pack(">8sHHIIBBHI", b"PCM     ", 0, 0, 1, 0, 8, 1, 960, 0)
    streams = [
        ogg.page(ogg.PCM, 0, 2, 0, bytes([len(header)]), header),
        ogg.page(ogg.PCM, 0, 2, 0, bytes([9]), b"PCM     x"),
        ogg.write(b" " * 192) + ogg.page(ogg.INDEX, 9, 0, 0, b"\x01", b"z"),
        ogg.page(77, 0, 2, (1 << 64) - 5, b"\x03", b"abc"),
    ]
    df = spark.createDataFrame([(i, s, "p") for i, s in enumerate(streams)], "granule bigint, media binary, serial string")
    assert not any(r.sound for r in ogg.load(df).collect()[1:3])
    out = ogg.packets(df.withColumnRenamed("granule", "doc_id"), "doc_id").collect()
    assert [r.granule for r in out if r.serial == 77] == [-5]
