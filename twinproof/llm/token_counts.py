"""Token counts at every prefix of a text, by dynamic programming over the last token.

For a byte-pair vocabulary the encoding of a prefix ends in exactly one token t such that t and the last token of the
prefix before it stand unmerged side by side. So count[i] = count[i - len(t)] + 1, and every prefix has its exact count after
one pass; truncation to a budget is a look-up. Texts are cut where the tokenizer's own word pattern always cuts
(before a space that a visible character follows), and what a unit gives is kept for its next occurrence. The count at every
character prefix of every text is stored as a table, a step a character; totals and budget questions are read from it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinproof.llm.common import Remembered, map_arrow, saved, slices, utf8

# The word pattern of byte-level BPE vocabularies, with white space as Unicode defines it.
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_UNIT = regex.compile(r" (?=\P{White_Space})")
_BLANKS = regex.compile(r"\p{White_Space}+")
_CONTRACTION = regex.compile(r"'(?:re|ve|ll)")
#: Runs of white space, which may be cut otherwise at a prefix's end than inside a text.
_RUNS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}")
#: A space before more white space or at the end: units can't be cut at every space.
_ODD = re.compile(
    rb" (?:[\t-\r ]|\Z|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)"
)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    """Exact counts for a byte-level BPE vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str, limit: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_letters()
        self.ids = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.bytes = {i: t for t, i in self.ids.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {tuple(bytes(byte[c] for c in t) for t in m): i for i, m in enumerate(pairs)}
        self.longest = max(map(len, self.ids))
        self.specials = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.cut = re.compile(b"|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.limit = limit
        self.apart: dict[int, bool] = {}
        self.totals: dict[bytes, int] = {}  # of pretokens
        self.units = Remembered(lambda w: self._unit(b" " + w), limit)  # totals of units after a space
        self.pretokens = Remembered(self._pretoken_steps, limit)
        self.unit_steps = Remembered(lambda w: self._unit_steps(b" " + w), limit)

    def _stand(self, left: int | None, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens."""
        key = right if left is None else (left + 1) << 24 | right
        if (known := self.apart.get(key)) is None:
            want = [self.bytes[right]] if left is None else [self.bytes[left], self.bytes[right]]
            parts = [bytes([b]) for b in b"".join(want)]
            while len(parts) > 1:
                rank, i = min((self.rank.get(p, 1 << 40), i) for i, p in enumerate(zip(parts, parts[1:])))
                if rank == 1 << 40:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            known = parts == want
            if len(self.apart) > self.limit:
                self.apart.clear()
            self.apart[key] = known
        return known

    def pretoken(self, b: bytes) -> list[int]:
        """count[i] of the first i bytes of a pretoken, i from 0."""
        find, apart, longest = self.ids.get, self.apart, self.longest
        n = len(b)
        last, count = [0] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for j in range(i - longest if i > longest else 0, i):
                t = find(b[j:i])
                if t is None:
                    continue
                left = last[j] if j else None
                stand = apart.get(t if left is None else (left + 1) << 24 | t)
                if stand or stand is None and self._stand(left, t):
                    last[i], count[i] = t, count[j] + 1
                    break
            else:
                raise ValueError("a byte is not in the vocabulary")
        return count

    def _total(self, b: bytes) -> int:
        if (known := self.totals.get(b)) is None:
            if len(self.totals) > self.limit:
                self.totals.clear()
            known = self.totals[b] = self.pretoken(b)[-1]
        return known

    def _unit(self, unit: bytes) -> int:
        return sum(self._total(w.encode()) for w in WORDS.findall(unit.decode()))

    def _units_of(self, data: bytes) -> np.ndarray:
        """Tokens of each unit of a text without special strings."""
        if not data:
            return np.zeros(0, np.int32)
        if _ODD.search(data):
            first, *rest = [p.encode() for p in _UNIT.split(data.decode())]
        else:
            first, *rest = data.split(b" ")
        out = np.zeros(len(rest) + 1, np.int32)
        if first:
            out[0] = self._unit(first)
        out[1:] = np.fromiter(map(self.units.__getitem__, rest), np.int32, len(rest))
        self.units.trim()
        return out

    def count(self, data: bytes) -> int:
        """Count at the last prefix: the whole text's."""
        own = self.boundaries(data)
        return int(own[-1]) if len(own) else 0

    def boundaries(self, data: bytes) -> np.ndarray:
        """Counts at the prefixes that end with a unit or a special string, in order; the last one is the whole text's. Empty for no text."""
        if self.cut is None or not self.cut.search(data):
            own = self._units_of(data)
        else:
            parts, at = [], 0
            for m in self.cut.finditer(data):
                parts += [self._units_of(data[at : m.start()]), np.ones(1, np.int32)]
                at = m.end()
            own = np.concatenate([*parts, self._units_of(data[at:])])
        return np.cumsum(own, dtype=np.int32)

    def _pretoken_steps(self, word: str) -> bytes | None:
        """Change of the count with each character of a pretoken, one signed byte each; none if a change is larger."""
        data = word.encode()
        count = self.pretoken(data)
        if len(data) > len(word):
            at = np.cumsum([0, *(len(c.encode()) for c in word)])
            count = [count[i] for i in at]
        if _CONTRACTION.fullmatch(word):  # its first letters are no contraction yet
            count[2] = count[1] + self.pretoken(word[1].encode())[-1]
        steps = np.diff(count)
        return steps.astype(np.int8).tobytes() if -128 <= steps.min() and steps.max() <= 127 else None

    def _unit_steps(self, unit: bytes) -> bytes | None:
        parts = [self.pretokens[w] for w in WORDS.findall(unit.decode())]
        return None if None in parts else b"".join(parts)

    def _steps_of(self, data: bytes) -> np.ndarray:
        """Change of the count with each character of a text without special strings."""
        text = data.decode()
        if _ODD.search(data):
            first, *rest = [p.encode() for p in _UNIT.split(text)]
        else:
            first, *rest = data.split(b" ")
        parts = [self._unit_steps(first), *map(self.unit_steps.__getitem__, rest)]
        self.pretokens.trim()
        self.unit_steps.trim()
        if None in parts:
            return np.diff(self._inside(text))
        steps = np.frombuffer(b"".join(parts), np.int8)
        if runs := [(m.span(), m.group()) for m in _RUNS.finditer(text)]:
            steps = steps.astype(np.int32)
            for (s, e), run in runs:  # white space at a prefix's end is one pretoken
                count = self.pretoken(run.encode())
                own = np.diff([count[i] for i in np.cumsum([0, *(len(c.encode()) for c in run)])])
                if e < len(text):
                    steps[e] += steps[s:e].sum() - own.sum()
                steps[s:e] = own
        return steps

    def steps(self, data: bytes) -> bytes:
        """Change of the count with each character of a text, as signed bytes, or as 32-bit integers if one doesn't fit."""
        if self.cut is None or not self.cut.search(data):
            out = self._steps_of(data)
        else:
            parts, done = [], 0
            for m in self.cut.finditer(data):
                inside = self._steps_of(data[done : m.start()])
                longer = self._steps_of(data[done : m.end()])  # until its last character, a special string is ordinary text
                parts += [inside, longer[len(inside) : -1], [1 - longer[len(inside) : -1].sum(dtype=np.int64)]]
                done = m.end()
            out = np.concatenate([*parts, self._steps_of(data[done:])])
        if out.dtype != np.int8:
            out = out.astype(np.int8 if not len(out) or -128 <= out.min() and out.max() <= 127 else "<i4")
        return out.tobytes()

    def prefixes(self, text: str) -> np.ndarray:
        """Exact count of the first i characters, for every i from 0 to the length."""
        out, base, done = [np.zeros(1, np.int32)], 0, 0
        spans = [m.span() for m in regex.finditer("|".join(map(regex.escape, (s.decode() for s in self.specials))), text)] if self.specials else []
        for a, b in [*spans, (len(text), len(text))]:
            inside = self._inside(text[done:a])
            out.append(base + inside[1:])
            base += int(inside[-1])
            if b > a:  # until its last character, a special string is ordinary text
                longer = self._inside(text[done:b])
                out.append(base - int(inside[-1]) + longer[a - done + 1 : -1])
                base += 1
                out.append(np.array([base], np.int32))
            done = b
        return np.concatenate(out)

    def _inside(self, text: str) -> np.ndarray:
        """The same for a text without special strings."""
        count = np.zeros(len(text) + 1, np.int32)
        for m in WORDS.finditer(text):
            s, e = m.span()
            word = m.group()
            own = np.array(self.pretoken(word.encode()), np.int32)
            lengths = np.cumsum([len(c.encode()) for c in word])
            count[s + 1 : e + 1] = count[s] + own[lengths]
            if _CONTRACTION.fullmatch(word):  # its first letters are no contraction yet
                count[s + 2] = count[s + 1] + self.pretoken(word[1].encode())[-1]
        for m in _BLANKS.finditer(text):  # white space at a prefix's end is one pretoken
            s, e = m.span()
            own = np.array(self.pretoken(m.group().encode()), np.int32)
            lengths = np.cumsum([len(c.encode()) for c in m.group()])
            count[s + 1 : e + 1] = count[s] + own[lengths]
        return count


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix that has at most ``budget`` tokens."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) if len(fits) else 0


_counters: dict[str, PrefixCounter] = {}


def _counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def boundary_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes and the exact counts at every prefix that ends with a unit (a word and what clings to it) of every text, in order.

    The programme's own array holds a count for every byte; kept are those at unit ends, a few for each, so the table is smaller
    than the texts. Null or empty: no bytes, no counts. Repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boundaries = _counter(path).boundaries
        for batch in batches:
            texts = utf8(batch.column(1))
            for i, j in slices(texts):
                found = [boundaries(t) for t in texts[i:j]]
                at = np.append(0, np.cumsum([len(f) for f in found])).astype(np.int32)
                counts = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(map(len, texts[i:j]), pa.int64()), counts], ["doc_id", "n_bytes", "prefix_counts"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_bytes long, prefix_counts array<int>")


def step_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_chars and the change of the exact count with each character of every text, which give the count at every prefix.

    A step is one signed byte, in a text with a larger one 32 bits; so the table is about as large as the texts before compression. Null or
    empty: no bytes, no steps. Repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = _counter(path).steps
        for batch in batches:
            texts = utf8(batch.column(1))
            chars = pc.utf8_length(batch.column(1).fill_null("")).cast(pa.int64())
            for i, j in slices(texts):
                sizes = pa.array(map(len, texts[i:j]), pa.int64())
                found = pa.array(map(steps, texts[i:j]), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), sizes, chars.slice(i, j - i), found], ["doc_id", "n_bytes", "n_chars", "steps"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_bytes long, n_chars long, steps binary")


def prefix_counts(steps: bytes | pa.Buffer, n_chars: int) -> np.ndarray:
    """The count at every prefix, from the empty one on, of a row of ``step_table``."""
    size = memoryview(steps).nbytes
    return np.append(0, np.cumsum(np.frombuffer(steps, np.int8 if size == n_chars else "<i4"), dtype=np.int64))


def fitting(stored: DataFrame, budget: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens and kept_chars of every row of ``step_table``: the whole text's count, and the characters of its longest
    prefix of at most ``budget`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, kept = [], []
            for n, s in zip(batch.column(2).to_pylist(), batch.column(3)):
                counts = prefix_counts(s.as_buffer(), n)  # of one text at a time
                tokens.append(int(counts[-1]))
                kept.append(longest_prefix(counts, budget))
            columns = [batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(kept, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "kept_chars"])

    return map_arrow(stored.select("doc_id", "n_bytes", "n_chars", "steps"), run, "doc_id long, n_bytes long, n_tokens long, kept_chars long")


def token_counts(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and kept_chars (what ``limit`` tokens leave) of every text, read from the stored counts at every
    prefix. Null or empty: no bytes, no tokens."""
    stored = saved(step_table(docs, path), "prefix-steps")
    return fitting(stored, limit).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "kept_chars")


def within_budget(stored: DataFrame, budget: int) -> DataFrame:
    """doc_id and units_kept: how many leading units of each text have at most ``budget`` tokens together, from ``boundary_table`` alone."""
    return stored.select("doc_id", F.size(F.filter("prefix_counts", lambda c: c <= budget)).alias("units_kept"))


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text_hash and the count at every character prefix, as an array from the empty prefix on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                counts = pa.array([counter.prefixes(text or "")], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(2).slice(i, 1), counts], ["doc_id", "text_hash", "prefix_counts"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _text_hash())
    return map_arrow(rows, run, "doc_id long, text_hash long, prefix_counts array<int>")


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string")).alias("text_hash")


def truncated(docs: DataFrame, prefixes: DataFrame, budget: int) -> DataFrame:
    """Each text cut to its longest prefix of at most ``budget`` tokens, from the stored counts alone. Every row stays, once: rows of
    one doc_id go by their own text, a null doc_id is an id like others, a null text stays null."""
    fit = F.expr(f"coalesce(array_max(filter(transform(prefix_counts, (c, i) -> IF(c <= {int(budget)}, i, NULL)), i -> i IS NOT NULL)), 0)")
    cut = prefixes.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), fit.alias("_fit")).dropDuplicates(["_id", "_hash"])
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (_text_hash() == F.col("_hash"))
    kept = [F.expr("substring(text, 1, _fit)").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return docs.join(cut, same, "left").select(*kept)
