"""Line dedup by overlapping three-line windows (operator 9).

Every three consecutive lines of a document make a window, known by a 128-bit hash of its exact
text.  A window that occurs again, in the same document or a later one (by id, then position), is a
repeat; a repeat's lines are removed, overlapping repeats covering the union of their positions.
The first occurrence stays.  A document is rewritten from the lines that are left.

Counts and first places are partial aggregates by hash before they are shuffled, so a window that a
third of all documents share is one row a task there; where repeats are picked out, only 48-byte
rows move, on a join whose large partitions Spark splits.

Defined results: windows of nothing but white space don't count; documents of fewer than three
lines have no window and stay as they are, as do null and empty texts; equal rows with the same id
are one document given several times, and stay; null ids come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import released, schema_of, settle

SPAN = 3


def window_hashes(text: str | None) -> tuple[list[int], list[bytes]]:
    """First lines and hashes of a text's windows."""
    lines = text.split("\n") if text else []
    at, out = [], []
    for i in range(len(lines) - SPAN + 1):
        joined = "\n".join(lines[i : i + SPAN])
        if not joined.isspace() and joined:
            at.append(i)
            out.append(xxhash.xxh3_128_digest(joined.encode("utf-8", "replace")))
    return at, out


def without(text: str, starts: list[int]) -> tuple[str, int, int]:
    """The text without the lines that windows at `starts` cover; its lines before, and how many went."""
    lines = text.split("\n")
    gone = bytearray(len(lines))
    for i in starts:
        gone[i : i + SPAN] = b"\1" * len(gone[i : i + SPAN])
    return "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents (line_doc, line_key) that hold repeated windows, and where those start: `starts`."""
    keyed = docs.select(F.col(id_col).alias("line_doc"), F.xxhash64(text_col).alias("line_key"), F.col(text_col).alias("text")).filter(F.col("text").contains("\n"))
    id_type = keyed.schema["line_doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [window_hashes(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.binary()))], ["line_doc", "line_key", "at", "hash"])

    windows = keyed.mapInArrow(released(run), f"line_doc {id_type}, line_key bigint, at array<int>, hash array<binary>")
    windows = windows.select("line_doc", "line_key", F.explode(F.arrays_zip("at", "hash")).alias("w")).select("line_doc", "line_key", "w.at", "w.hash")
    windows = settle(windows, "line-windows")
    place = F.struct("line_doc", "line_key", "at")
    again = windows.groupBy("hash").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = windows.join(again, "hash").filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("line_doc", "line_key").agg(F.collect_set("at").alias("starts"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the text rewritten, and the columns n_lines and n_removed, which replace columns of those names."""
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    found = repeats(docs, id_col, text_col)
    # Columns go by numbers inside, so that no name of the user's meets one of ours.
    numbered = docs.select(*(F.col(f"`{c}`") for c in kept)).toDF(*(f"c{i}" for i in range(len(kept))))
    names = list(numbered.columns)
    the_id, the_text, at = F.col(f"c{kept.index(id_col)}"), F.col(f"c{kept.index(text_col)}"), kept.index(text_col)
    joined = numbered.join(found, the_id.eqNullSafe(F.col("line_doc")) & (F.xxhash64(the_text) == F.col("line_key")), "left").select(*numbered.columns, "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, removed = [], [], []
            for text, starts in zip(batch.column(at), batch.column(len(kept))):
                value = text.as_py()
                new, n, gone = without(value, starts.as_py() or []) if value is not None else (None, 0, 0)
                texts.append(new)
                lines.append(n)
                removed.append(gone)
            columns = list(batch.columns[: len(kept)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_lines", "n_removed"])

    schema = schema_of(numbered, numbered.columns) + ", n_lines bigint, n_removed bigint"
    return joined.mapInArrow(released(run), schema).toDF(*kept, "n_lines", "n_removed")
