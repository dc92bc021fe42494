"""BPE encoding and decoding with a contiguous rank array (operator 7).

A text is cut at special tokens, brought to NFC and lower case, split into words by the
vocabulary's pattern, and each word's UTF-8 bytes become one symbol each, the last one with the
word-end mark.  A short word is merged on two parallel arrays, the part boundaries and the rank
of every adjacent pair: find the least rank, delete the boundary between the two parts, look up
the two ranks beside it, repeat.  That is quadratic in the word's length, so words of more than
`ARRAY_MAX` symbols use a heap over the same ranks; the merges are the same, leftmost least rank
first.

Defined results: null and empty texts have no tokens; repeated rows give repeated results; the other
columns of the input stay, and are replaced only where an output column has their name.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridloom.llm.common import released

ARRAY_MAX = 96
CACHE_MAX = 300_000
NONE = 1 << 60

# The split pattern of the vocabulary file, with Unicode's White_Space written out.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where Latin-1 prints it, else the next code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A vocabulary file of the `tokenizers` library of the word-end kind, read without that library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in {**self.vocab, **self.special}.items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.final = [self.vocab[s + self.suffix] for s in symbols]
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.cache: dict[str, bytes] = {}
        self.library = None
        self.spec = spec

    # -- encoding -------------------------------------------------------------------------

    def merge_array(self, ids: list[int]) -> list[int]:
        """The rank array: ranks[i] is that of the parts that start at i and at the next boundary."""
        look, none = self.ranks.get, (NONE, -1)
        ranks = [look(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best is none or best[0] == NONE:
                break
            i = ranks.index(best)
            ids[i] = best[1]
            del ids[i + 1]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = look((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = look((ids[i - 1], ids[i]), none)
        return ids

    def merge_heap(self, ids: list[int]) -> list[int]:
        """The same merges for long words, by a heap and a doubly linked list."""
        n, look = len(ids), self.ranks.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := look((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if r := look((new, ids[after[j]])):
                    heapq.heappush(heap, (r[0], i, new, ids[after[j]], r[1]))
            if (h := before[i]) >= 0 and (r := look((ids[h], new))):
                heapq.heappush(heap, (r[0], h, ids[h], new, r[1]))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> bytes:
        """The ids of one word as little-endian unsigned 32-bit integers."""
        raw = word.encode("utf-8", "replace")
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        ids = self.merge_array(ids) if len(ids) <= ARRAY_MAX else self.merge_heap(ids)
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens.

        Beyond ASCII the library's normaliser is used, whose tables are of another Unicode version
        than Python's, and for code points that Python doesn't know its split as well.
        """
        if text.isascii():
            return self.split.findall(text.lower())
        if self.library is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            pattern = self.spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            self.library = (Tokenizer.from_str(json.dumps(self.spec)).normalizer, pre_tokenizers.Split(Regex(pattern), "removed", invert=True))
        normal = self.library[0].normalize_str(text)
        if any(unicodedata.category(c) == "Cn" for c in set(normal)):
            return [w for w, _ in self.library[1].pre_tokenize_str(normal)]
        return self.split.findall(normal)

    def encode(self, text: str | None) -> bytes:
        """All ids of a text, packed as `word` packs them."""
        if not text:
            return b""
        cache, out = self.cache, []
        parts = self.cut.split(text) if "<|" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            words = self.words(part)
            new = [w for w in set(words) if w not in cache]
            if len(cache) + len(new) > CACHE_MAX:
                cache.clear()
                new = set(words)
            for w in new:
                cache[w] = self.word(w)
            out.extend(map(cache.__getitem__, words))
        return b"".join(out)

    # -- decoding -------------------------------------------------------------------------

    def decode(self, packed: bytes) -> str:
        """The tokens of packed ids, joined by spaces: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, memoryview(packed).cast("I")))


_loaded: dict[str, WordBpe] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def loaded(path: str | None) -> WordBpe:
    """One vocabulary a worker process and file."""
    path = path or default_vocabulary()
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def mapped(df: DataFrame, source: str, outs: dict[str, str], keep: bool, work: Callable[[WordBpe], Callable], vocabulary: str | None) -> DataFrame:
    """`df` with the columns `outs` (name: type) made of the column `source`, which stays if `keep`.

    A map over Arrow batches runs once, whatever is built on it.  The words that a worker remembers are those of its task.
    """
    kept = [c for c in df.columns if c not in outs and (keep or c != source)]
    read = [*(c for c in kept if c != source), source]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema), *(f"`{c}` {t}" for c, t in outs.items())])
    types = [{"binary": pa.binary(), "string": pa.string()}[t] for t in outs.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        one = work(bpe)
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, 1024):  # what is made of a batch is larger than the batch
                    part = batch.slice(start, 1024)
                    made = [one(x.as_py()) for x in part.column(len(read) - 1)]
                    more = [pa.array([m[k] for m in made], t) for k, t in enumerate(types)]
                    yield pa.RecordBatch.from_arrays([*(part.column(read.index(c)) for c in kept), *more], [*kept, *outs])
        finally:
            bpe.cache.clear()

    return df.select(*read).mapInArrow(released(run), schema)


def encode(df: DataFrame, text_col: str = "text", vocabulary: str | None = None, out: str = "tokens", keep: bool = True) -> DataFrame:
    """`df` with the column `out`: the ids of `text_col`, packed as little-endian unsigned 32-bit integers.

    `vocabulary`: path of the file as the executors see it; None: the installed public one.
    `keep`: whether the texts stay.
    """
    return mapped(df, text_col, {out: "binary"}, keep, lambda bpe: lambda text: (bpe.encode(text),), vocabulary)


def decode(df: DataFrame, tokens_col: str = "tokens", vocabulary: str | None = None, out: str = "decoded", keep: bool = True) -> DataFrame:
    """`df` with the column `out`: the text of the ids that `encode` packed; null ids give an empty text."""
    return mapped(df, tokens_col, {out: "string"}, keep, lambda bpe: lambda ids: (bpe.decode(ids) if ids else "",), vocabulary)


def round_trip(df: DataFrame, text_col: str = "text", vocabulary: str | None = None, out: str = "tokens", decoded: str = "decoded", keep: bool = True) -> DataFrame:
    """`df` with `encode`'s column and the text that `decode` makes of its packed ids, by one worker that holds one vocabulary."""

    def work(bpe: WordBpe) -> Callable:
        def both(text: str | None) -> tuple[bytes, str]:
            ids = bpe.encode(text)
            return ids, bpe.decode(ids) if ids else ""

        return both

    return mapped(df, text_col, {out: "binary", decoded: "string"}, keep, work, vocabulary)
