"""Best-two-fit packing of tokenized documents into sequences of limited length.

Greedy fill: a bin takes the largest document that still fits, again and again. Then its smallest document gives
way to the two unpacked documents that fit the expanded gap most tightly, if they fill more.

Only lengths matter for this, and there are at most ``capacity`` of them. So the plan is made on the histogram of
lengths, whole runs of equal bins at a time, and documents find their place by their number within their length.
A run ends when a length has too few documents left for the same bin, so the plan's size is bounded by
capacity * log(capacity) whatever the number of documents.
"""

from __future__ import annotations

import gc
import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.llm.common import BATCH, SLICE, flat, gapless, map_arrow, saved, slices, utf8
from twinproof.llm.token_counts import _byte_letters

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Code points from here on may compose, or change otherwise than one by one in lower case.
PLAIN = 0x130
_BLANK, _LETTER, _NUMBER, _OTHER = range(4)


def _kind(c: str) -> int:
    return _BLANK if c in "\t\n\x0b\x0c\r \x85\xa0" else {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(c)[0], _OTHER)


KIND = np.array([_kind(chr(c)) for c in range(PLAIN)], np.uint8)
LOWERED = np.array([ord(chr(c).lower()) for c in range(PLAIN)], np.uint16)
# The same for bytes; a byte of a longer character is replaced later, if at all.
BYTE_KIND = np.where(np.arange(256) < 128, KIND[:256], _LETTER).astype(np.uint8)
BYTE_LOWERED = np.where(np.arange(256) < 128, LOWERED[:256], np.arange(256)).astype(np.uint8)


def spaced_parts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts in lower case with a space between any two parts, and where each begins (one more entry for the end).

    ``data`` holds UTF-8 texts which a blank ends, ``at`` where they begin and the end. The parts are the matches of
    ``'s|'t|'re|'ve|'m|'ll|'d|[letters]+|[number]|[other but white space]+``. A word with a character from PLAIN on or with ``<|`` stays as it is.
    """
    kind, low = BYTE_KIND[data], BYTE_LOWERED[data]
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xC5))
    code = (data[lead].astype(np.uint16) & 0x1F) << 6 | data[lead + 1] & 0x3F
    odd = data >= 0xC5
    odd[lead[code >= PLAIN]] = True
    odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    lead, code = lead[code < PLAIN], code[code < PLAIN]
    kind[lead] = kind[lead + 1] = KIND[code]
    low[lead], low[lead + 1] = LOWERED[code] >> 6 | 0xC0, LOWERED[code] & 0x3F | 0x80
    blank = kind == _BLANK
    low[blank] = 32
    cut = np.zeros(len(data), bool)
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    cut[lead + 1] = False
    # Short forms: an apostrophe that no other sign stands before, and what follows it.
    short = np.flatnonzero((data[1:-2] == ord("'")) & (kind[:-3] != _OTHER)) + 1
    if len(data) > 2 and data[0] == ord("'"):
        short = np.append(short, 0)
    one, two = low[short + 1], low[short + 2]
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for these, n in ((short[np.isin(one, [*b"stmd"])], 2), (short[long], 3)):
        cut[these + 1] = False
        cut[np.minimum(these + n, len(data) - 1)] = True
    if odd.any():
        word = np.cumsum(BYTE_KIND[data] == _BLANK, dtype=np.int32)
        whole = np.zeros(int(word[-1]) + 1, bool)
        whole[word[odd]] = True
        whole = whole[word] & (BYTE_KIND[data] != _BLANK)
        blank &= ~whole
        cut[1:] &= ~(whole[1:] & whole[:-1])
        low[whole] = data[whole]
    cut &= ~blank
    cut[1:] &= ~blank[:-1]
    cuts = np.flatnonzero(cut)
    text = np.ones(len(data) + len(cuts), bool)
    text[cuts + np.arange(len(cuts))] = False
    out = np.full(len(text), 32, np.uint8)
    out[text] = low
    return out, at + np.searchsorted(cuts, at)


class WordIds:
    """Token ids of texts, kept as little-endian bytes.

    For a byte-level BPE with word ends that lower-cases, composes (NFC) and drops white space, and whose word pattern is that of
    ``spaced_parts``. Its normalizer and pattern cost more than its merges, so texts are cut into parts as arrays, and the parts that are new in some
    texts go to the model in few calls: there a token with a word end ends a part. Words whose characters may compose, and those that may
    hold a special string, go through the whole library.
    """

    def __init__(self, path: str, limit: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use the cores
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.library = Tokenizer.from_file(path)
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = Split(" ", "removed")
        self.last = np.zeros(self.library.get_vocab_size(), bool)
        self.last[[i for t, i in self.library.get_vocab().items() if t.endswith(self.library.model.end_of_word_suffix)]] = True
        self.letters = str.maketrans({chr(b): c for c, b in _byte_letters().items() if b != 32})
        # Ids by part in two generations, so that what is in use stays.
        self.limit, self.parts, self.older = limit, {}, {}

    def learn(self, parts: list[bytes]) -> None:
        """Make sure that the ids of these parts are known."""
        if len(self.parts) > self.limit:
            self.parts, self.older = {}, self.parts
        known, before, new, odd = self.parts, self.older.get, [], []
        known[b""] = b""
        for p in filterfalse(known.__contains__, parts):
            if (ids := before(p)) is not None:
                known[p] = ids
            elif b"<|" in p or not p.isascii() and max(p.decode()) >= chr(PLAIN):
                odd.append(p)
            else:
                new.append(p)
        for i in range(0, len(new), 2000):
            self.learn_plain(new[i : i + 2000])
        for i in range(0, len(odd), 1000):
            some = odd[i : i + 1000]
            found = self.library.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)
            known.update(zip(some, (np.asarray(f.ids, "<u4").tobytes() for f in found)))

    def learn_plain(self, parts: list[bytes]) -> None:
        shown = b" ".join(parts).decode("latin-1").translate(self.letters)
        [found] = self.model.encode_batch_fast([shown], add_special_tokens=False)
        ids = np.asarray(found.ids, "<u4")
        ends = 4 * np.flatnonzero(self.last[ids]) + 4
        if len(ends) != len(parts):
            raise ValueError("parts and their last tokens do not agree")
        at, data = [0, *ends.tolist()], ids.tobytes()
        self.parts.update(zip(parts, map(data.__getitem__, map(slice, at, at[1:]))))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text. Parts are told apart and put together as arrays; Python sees each one of a slice once."""
        out: list[bytes] = []
        for i, j in slices(texts, BATCH):
            out += self._slice_ids(texts[i:j])
        return out

    def _slice_ids(self, texts: list[bytes]) -> list[bytes]:
        data, at = spaced_parts(*flat([t + b" " for t in texts]))
        shown = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
        parts = pc.split_pattern(shown, b" ")
        every = parts.flatten().dictionary_encode()
        distinct = every.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(distinct)
        found = pa.array(list(map(self.parts.__getitem__, distinct)), pa.large_binary()).take(every.indices)
        begins = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, 8 * found.offset)
        ids = memoryview(found.buffers()[2] or b"")
        ends = begins[np.cumsum([0, *pc.list_value_length(parts).to_pylist()])].tolist()
        return [bytes(ids[begin:end]) for begin, end in zip(ends, ends[1:])]


_encoders: dict[str, WordIds] = {}


def _encoder(path: str) -> WordIds:
    """The worker's own, which its next task finds again; a task's function would carry a copy of ``_encoders``."""
    if path not in _encoders:
        _encoders[path] = WordIds(path, 500_000)
    return _encoders[path]


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``capacity`` ids; with ``keep_ids`` the ids too, as little-endian bytes.

    A null or empty text has the end id alone. Only documents longer than ``capacity`` are cut; the last
    piece may be shorter. ``path`` names a tokenizer that drops white space.
    """
    end = np.asarray([end_id], "<u4").tobytes()
    step, most = 4 * capacity, SLICE if keep_ids else BATCH  # in a pipeline, earlier stages' memory is still there

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds(path) if keep_ids else _encoder(path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            for i, j in slices(texts, most):
                rows = []
                for doc, tokens in zip(ids[i:j], encoder.ids(texts[i:j])):
                    tokens += end
                    for k, at in enumerate(range(0, len(tokens), step)):
                        part = tokens[at : at + step]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part))
                columns = list(zip(*rows))[: 5 + keep_ids]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names[: len(columns)])
        if keep_ids:  # in a pipeline, the worker's next task is another stage's: it needs the memory, not the words
            del encoder
            gc.collect()

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PIECES + ", ids binary" * keep_ids)


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as runs: (how many, [(length, copies)]), lengths in falling order. ``counts[l]``: documents of length l."""
    left = [int(c) for c in counts]
    below = list(range(len(left)))  # largest length up to l that may be left

    def largest(x: int, used: dict[int, int]) -> int:
        while x > 0:
            root = x
            while below[root] != root:
                root = below[root]
            while below[x] != root:
                below[x], x = root, below[x]
            x = root
            if left[x] == 0 and x > 0:
                below[x] = x - 1
                x -= 1
            elif left[x] > used.get(x, 0):
                return x
            else:
                x -= 1
        return 0

    runs = []
    while first := largest(capacity, {}):
        used: dict[int, int] = {}
        gap, l = capacity, first
        while l:
            take = min(gap // l, left[l] - used.get(l, 0))
            used[l] = used.get(l, 0) + take
            gap -= take * l
            l = largest(min(gap, l), used)
        smallest = min(used)
        out = 0
        if gap:
            room, best = gap + smallest, (smallest, 0, 0)
            a = largest(room - 1, used)
            while a and 2 * a > best[0] and best[0] < room:
                used[a] = used.get(a, 0) + 1
                b = largest(min(a, room - a), used)
                used[a] -= 1
                if b and a + b > best[0]:
                    best = (a + b, a, b)
                a = largest(a - 1, used)
            if best[1]:
                out = smallest
                used[out] -= 1
                for x in best[1:]:
                    used[x] = used.get(x, 0) + 1
        used = {x: m for x, m in used.items() if m}
        times = min(left[x] // m for x, m in used.items())
        if out in used:  # the document that gave way must be there each time
            times = max(1, min(times, (left[out] - used[out] - 1) // used[out] + 1))
        for x, m in used.items():
            left[x] -= m * times
        runs.append((times, sorted(used.items(), reverse=True)))
    return runs


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Give every piece ``sequence_id`` and ``offset``. Columns needed: doc_id, piece, length; the rest stays,
    but for columns that are named like those two or ``_nth``, which go.

    Pieces must be a stored table: it is read twice. No piece gives no rows. Repeated rows are separate pieces.
    """
    pieces = pieces.drop("sequence_id", "offset", "_nth")
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r[0]] = r[1]
    shift, number, places = 1 << 44, 0, []
    done = np.zeros(capacity + 1, np.int64)
    for times, bin_ in best_two_fit(counts, capacity):
        at = 0
        for l, m in bin_:
            places.append((l * shift + int(done[l]), m, number, at))
            done[l] += times * m
            at += l * m
        number += times
    key, copies, first, base = (np.array(c, np.int64) for c in (zip(*sorted(places)) if places else [[]] * 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            nth = batch.column("_nth").to_numpy(zero_copy_only=False)
            i = np.searchsorted(key, length * shift + nth, "right") - 1
            nth = length * shift + nth - key[i]
            kept = batch.drop_columns(["_nth"])
            seq, off = first[i] + nth // copies[i], base[i] + nth % copies[i] * length
            out = pa.RecordBatch.from_arrays([*kept.columns, pa.array(seq), pa.array(off)], [*kept.schema.names, "sequence_id", "offset"])
            del batch, kept
            yield out
            del out

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    tell_apart = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    numbered = gapless(pieces, ["length"], tell_apart, "_nth", int(counts.sum())).select(*pieces.columns, "_nth")
    return map_arrow(numbered, run, own + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack; one row per piece. With ``keep_ids`` each row has its ids (little-endian unsigned 32-bit) as ``ids``, so that the rows
    of one sequence_id in the order of offset are the sequence; they travel through one shuffle with their piece."""
    return pack(saved(token_pieces(docs, path, capacity, end_id, keep_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids of every sequence, from ``pack_documents(..., keep_ids=True)``. A sequence has at most its capacity of
    ids, so a group is bounded. No piece gives no rows."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("_parts"))
    joined = F.aggregate("_parts", F.lit(b""), lambda ids, part: F.concat(ids, part["ids"]))
    return whole.select("sequence_id", "length", joined.alias("ids"))
