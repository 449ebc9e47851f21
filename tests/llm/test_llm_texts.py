"""The text operators against plain versions: odd inputs, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from twinproof.llm import class_lm, common, components, decontamination, jaccard_join, packing, quality_classifier, quality_rules, queries, token_counts
from twinproof.llm.common import table

WORD = re.compile("[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, block string, n long, token string, kept int"
LABELS = "doc_id long, quality int, toxic int"


def lower(t: str | None) -> str:
    return (t or "").translate(UPPER)


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names operators use themselves."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, None, None, None, 0.5, "x", 7, "y", None) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " \n\t", "a", "A b", "a b", "a b c", "A B C", "x " * 60_000, "é è\x0bü\x1c z", "# $ | <", "same line\nsame line\n", "日本語 テキスト", "I'm <|endoftext|> here", "a b c"]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r.doc_id: r.text for r in table(spark, data, "documents").collect()}


# -- words -------------------------------------------------------------------------------------------


@given(st.lists(st.text(alphabet="aAé \n\x0b\x1c\x00日", max_size=12), max_size=8), st.integers(1, 9), st.booleans())
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_the_rule(parts, cut, low):
    old, common.SLICE = common.SLICE, cut
    try:
        data, at = common.flat([p.encode() for p in parts])
        h, s, e = common.word_hashes(data, at, low)
    finally:
        common.SLICE = old
    got = [bytes(data[a:b]).decode() for a, b in zip(s, e)]
    want = [w for p in parts for w in WORD.findall(p)]
    assert got == want
    names = [lower(w) if low else w for w in want]
    assert len(set(h.tolist())) == len(set(names)) and len(set(zip(h.tolist(), names))) == len(set(names))


# -- packing -----------------------------------------------------------------------------------------


def one_bin_at_a_time(lengths, capacity):
    """The method, document by document."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        now, gap = [], capacity
        for x in list(left):
            if x <= gap:
                now.append(x)
                left.remove(x)
                gap -= x
        small = now[-1]
        best = max(((left[i] + left[j], left[i], left[j]) for i in range(len(left)) for j in range(i + 1, len(left)) if small < left[i] + left[j] <= gap + small), default=None)
        if best and gap:
            now.remove(small)
            left.append(small)
            for x in best[1:]:
                now.append(x)
                left.remove(x)
            left.sort(reverse=True)
        bins.append(tuple(sorted(now, reverse=True)))
    return sorted(bins)


@given(st.lists(st.integers(1, 20), max_size=30))
@settings(max_examples=300, deadline=None)
def test_packing_in_runs_is_packing_bin_by_bin(lengths):
    runs = packing.best_two_fit(np.bincount(lengths, minlength=21), 20)
    got = sorted(tuple(l for l, m in b for _ in range(m)) for times, b in runs for _ in range(times))
    assert got == one_bin_at_a_time(lengths, 20)


def check_packing(rows, texts, capacity=4096):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_odd_texts(odd, none, spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    check_packing(packing.pack_documents(odd, path).collect(), list(enumerate(ODD)))
    twice = frame(spark, ["a b", "a b", None], [1, 1, None])
    check_packing(packing.pack_documents(twice, path).collect(), [(1, "a b"), (1, "a b"), (None, None)])
    assert packing.pack_documents(none, path).collect() == []


def test_packing_documents(spark, data, texts):
    rows = queries.op1_best_fit_packing(spark, data).collect()
    bins = check_packing(rows, list(texts.items()))
    assert bins <= math.ceil(sum(r.length for r in rows) / 4096) + 1


# -- token counts ------------------------------------------------------------------------------------

PARTS = [" ", "  ", "\n", "\t", "\xa0", "\u2003", "a", "don't", "we're", "'", "'ve", "<|endoftext|>", "<|endo", "12", "!?", "é", "日本", "🙂", "\x1c", "\x85", "the"]


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"), limit=50)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@given(st.lists(st.sampled_from(PARTS), max_size=10))
@settings(max_examples=300, deadline=None)
def test_every_prefix_has_the_library_s_count(counter, library, parts):
    t = "".join(parts)
    want = [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
    assert counter.prefixes(t).tolist() == want
    assert counter.count(t.encode()) == want[-1]


def test_token_counts_of_documents(spark, data, texts, library, odd, none):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op7_token_counts(spark, data).collect()}
    want = {i: (len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in texts.items()}
    assert got == want
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(odd, path, 9).collect()} == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(ODD)}
    assert token_counts.token_counts(none, path, 9).collect() == []


def test_truncation_from_stored_counts(spark, odd, library):
    path = public_tokenizers.path("byte_bpe_50k.json")
    short = odd.filter("length(text) < 100")
    for r in token_counts.truncated(short, token_counts.prefix_table(short, path), 3).collect():
        full = ODD[r.doc_id]
        fits = [i for i in range(len(full) + 1) if len(library.encode(full[:i], add_special_tokens=False).ids) <= 3]
        assert r.text == full[: max(fits)]


# -- near duplicates ---------------------------------------------------------------------------------


def groups_by_brute_force(texts):
    """(n_shingles, component) per (id, text), every pair compared."""
    sets = []
    for _, t in texts:
        w = WORD.findall(lower(t))
        sets.append(frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)] if w else []))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(texts):
        r = find(k)
        least[r] = i if r not in least else min(least[r], i)
    return collections.Counter((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(texts))


def copies(seed: int):
    """Groups with a base and copies of it that are like the base but not like each other, chains, and copies without base."""
    rnd = random.Random(seed)

    def words(n):
        return [f"w{rnd.randint(0, 400)}" for _ in range(n)]

    out = ["", None, "one", "one", "One", "one two", "a b c"]
    passage = words(30)
    for size in (12, 60, 110, 200):
        base = words(size)
        out.append(" ".join(base))
        for k in range(12):
            copy = list(base)
            for _ in range(1 if size < 100 else 2):
                copy[rnd.randrange(size)] = f"edit{k}"
            out.append(" ".join(copy) if k % 3 else " ".join(copy).upper())
        chain = list(base)
        for k in range(8):
            chain[(k * 23) % size] = f"link{k}"
            out.append(" ".join(chain))
    for _ in range(25):
        out.append(" ".join(words(10) + passage + words(20)))
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 3)])
def test_jaccard_groups(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    texts = list(enumerate(copies(seed)))
    got = jaccard_join.jaccard_components(frame(spark, [t for _, t in texts])).collect()
    assert collections.Counter(map(tuple, got)) == groups_by_brute_force(texts)


def test_jaccard_odd_texts(spark, odd, none):
    texts = list(enumerate(ODD))
    assert collections.Counter(map(tuple, jaccard_join.jaccard_components(odd).collect())) == groups_by_brute_force(texts)
    twice = [(5, "a b c d"), (5, "a b c d"), (3, "A b c d")]
    rows = jaccard_join.jaccard_components(frame(spark, [t for _, t in twice], [i for i, _ in twice])).collect()
    assert sorted(map(tuple, rows)) == [(3, 2, 3), (5, 2, 3), (5, 2, 3)]
    assert jaccard_join.jaccard_components(none).collect() == []


def test_heaps_of_near_copies_are_not_shipped_for_every_pair(spark, monkeypatch):
    """Twelve copies of a text, each with one word of its own: what the search reads is a few times all shingles, not a set for each pair."""
    rnd = random.Random(5)
    texts = []
    for g in range(8):
        base = [f"g{g}w{rnd.randint(0, 10**6)}" for _ in range(120)]
        for k in range(12):
            copy = list(base)
            copy[9 * k + 5] = f"edit{k}of{g}"
            texts.append(" ".join(copy))
    texts = list(enumerate(texts))
    read, search = [], jaccard_join.search_cells

    def spy(rows, keys, percent):
        read.append(rows.agg(F.sum(F.length("tokens"))).first()[0] or 0)
        return search(rows, keys, percent)

    monkeypatch.setattr(jaccard_join, "search_cells", spy)
    got = jaccard_join.jaccard_components(frame(spark, [t for _, t in texts])).collect()
    assert collections.Counter(map(tuple, got)) == groups_by_brute_force(texts)
    assert sum(read) <= 4 * 8 * sum(r.n_shingles for r in got)


def test_components_in_driver_and_in_jobs(spark, monkeypatch):
    """A path, a star, loops and repeats: the smallest node either way, and few edges take no more jobs than their tables."""
    edges = [(k, k + 1) for k in range(100, 140)] + [(-5, k) for k in range(20)] + [(7, 7), (3, -5), (2**62, -(2**62)), (9_000, 9_000)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {**{k: 100 for k in range(100, 141)}, **{k: -5 for k in (-5, *range(20))}, 2**62: -(2**62), -(2**62): -(2**62)}
    few = components.components(df, "a", "b")
    assert {tuple(r) for r in few.collect()} == set(want.items()) and few.count() == len(want)
    monkeypatch.setattr(components, "LOCAL", 0)
    assert {tuple(r) for r in components.components(df, "a", "b").collect()} == set(want.items())
    assert components.components(df.limit(0), "a", "b").count() == 0


def test_jaccard_groups_in_many_rounds(spark, monkeypatch):
    """Rounds of a few sets each, cells for nearly all buckets, and records with more partners than a block gives at first."""
    monkeypatch.setattr(components, "LOCAL", 0)
    for name, value in (("ROUND", 20_000), ("ROUND_PARTS", 10**6), ("SMALL", 2), ("BLOCK", 40), ("PARTNERS", 1)):
        monkeypatch.setattr(jaccard_join, name, value)
    texts = list(enumerate(copies(3)))
    got = jaccard_join.jaccard_components(frame(spark, [t for _, t in texts])).collect()
    assert collections.Counter(map(tuple, got)) == groups_by_brute_force(texts)


@given(st.integers(0, 2**32), st.sampled_from([50, 80, 90]))
@settings(max_examples=100, deadline=None)
def test_sketches_rule_out_no_match(seed, percent):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, rng.choice([1, 2, 30, 64, 65, 300]), np.uint64)
    sets = [np.unique(np.append(base[rng.random(len(base)) < 0.97], rng.integers(0, 2**64, rng.integers(0, 4), np.uint64))) for _ in range(12)]
    sets = [x for x in sets if len(x)] + [np.unique(rng.integers(0, 2**64, 200, np.uint64))]
    matches = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))}
    sizes, sketches = [len(x) for x in sets], [jaccard_join.sketch(x) for x in sets]
    left, right = np.triu_indices(len(sets), 1)
    n = np.array(sizes, np.int64)
    ok = jaccard_join.can_match(n[left], n[right], [sketches[i] for i in left], [sketches[i] for i in right], percent)
    allowed = set(zip(left[ok].tolist(), right[ok].tolist()))
    cell = jaccard_join.Sketches(sizes, list(range(len(sets))), [True] * len(sets), sketches)
    found = [tuple(sorted((q, r))) for q, r, more in cell.pairs(percent, 100) if not more]
    assert matches <= allowed and sorted(found) == sorted(allowed)
    assert percent < 90 or all((i, len(sets) - 1) not in allowed for i in range(len(sets) - 1))
    partners = collections.Counter(q for q, _, _ in cell.pairs(percent, 100))
    assert [(q, more) for q, _, more in cell.pairs(percent, 1)] == [(q, k > 1) for q, k in partners.items()]


@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=25, unique=True), min_size=2, max_size=12), st.sampled_from([50, 80, 90]))
@settings(max_examples=200, deadline=None)
def test_search_in_a_cell(sets, percent):
    cell = jaccard_join.Cell([np.array(sorted(s), np.uint64) for s in sets], list(range(len(sets))))
    cell.search(list(range(len(sets))), percent)
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            a, b = set(sets[i]), set(sets[j])
            if 100 * len(a & b) >= percent * len(a | b):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    assert len(set(zip(root, cell.root.tolist()))) == len(set(root)) == len(set(cell.root.tolist()))


# -- class language model ----------------------------------------------------------------------------


def plain_base(texts):
    words = [(i, [*WORD.findall(lower(t)), None]) for i, t in texts]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in words}
    c = collections.Counter(w for i, ws in words if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in words}


SMALL = class_lm.Settings(head=200, tail=64, classes=6, sweeps=2, block_bytes=100_000)


def test_class_model_base_columns_and_gain(spark, data, texts):
    rows = class_lm.score_documents(table(spark, data, "documents"), SMALL).collect()
    want = plain_base(list(texts.items()))
    assert len(rows) == len(want)
    for r in rows:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_class_model_odd_texts(spark, odd, none):
    rows = class_lm.score_documents(odd, SMALL).collect()
    want = plain_base(list(enumerate(ODD)))
    assert {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in rows} == {i: w[:4] for i, w in want.items()}
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert class_lm.score_documents(none, SMALL).collect() == []


def test_class_model_is_a_distribution():
    """Over the next word, probabilities of all known words and of each unit's unknown word sum to one."""
    rnd = np.random.default_rng(0)
    head, tail, k = 5, 7, 4
    n = 1 + head + tail
    classes = np.append(0, 1 + rnd.integers(0, k - 1, n - 1))
    counts = {u: rnd.integers(1, 6, 1 if u <= head else 4) for u in range(n)}
    size, kinds = np.array([c.sum() for c in counts.values()]), np.array([len(c) for c in counts.values()])
    mass = size + 1.0
    transition = rnd.random((k, k))
    model = class_lm.Model(
        class_lm.Units(np.zeros(0, np.uint64), np.zeros(0, np.int32), head), classes,
        np.log10(transition / transition.sum(1, keepdims=True)), np.log10(mass / np.bincount(classes, mass, k)[classes]), size, kinds, 0.6, int(size.sum()), int(kinds.sum()),
    )
    present = np.unique(classes)
    for before in range(k):
        total = 0.0
        for u, c in counts.items():
            every = c if u <= head else np.append(c, 0)
            p = class_lm.word_log(model, np.full(len(every), u), every)
            total += 10 ** (model.transition[before, classes[u]] + model.unit[u]) * (10**p).sum()
        assert total == pytest.approx((10 ** model.transition[before, present]).sum())


def test_every_training_word_has_its_own_class(spark):
    """Rare words with one ending that stand in different places get different classes; no word is left to its ending."""
    rnd = random.Random(3)
    texts = []
    for i in range(400):
        a, b = (f"a{rnd.randrange(150)}xyz" for _ in range(2)), (f"b{rnd.randrange(150)}xyz" for _ in range(2))
        texts.append(" ".join(w for pair in zip(a, ["to"] * 2, b, ["of"] * 2) for w in pair))
    conf = class_lm.Settings(head=40, tail=64, classes=6, sweeps=2, block_bytes=3_000)
    docs = frame(spark, texts).select("doc_id", "text").withColumns({"training": F.lit(True), "block": F.col("doc_id").cast("int") % 3})
    stored = common.saved(class_lm.block_words(docs, conf), "test-words")
    listed, parts = stored.filter("id IS NOT NULL"), stored.filter("id IS NULL")
    known = common.saved(listed.groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("c")), "test-known")
    classes, bigrams = class_lm.word_classes(docs, listed, parts, known, conf)
    got = {r.word: r.cls for r in classes.collect()}
    names = sorted({w for t in texts for w in t.split()})
    hashes = class_lm.tokens([w.encode() for w in names], 64).hashes
    of = dict(zip(names, (got[h] for h in hashes[hashes != class_lm.END].view(np.int64).tolist())))
    first, second = ({c for w, c in of.items() if w[0] == x and w.endswith("xyz")} for x in "ab")
    assert first and second and not first & second
    assert len(got) == len(names) + 1 and got[int(class_lm.END.view(np.int64)[0])] == 0
    # The table of class pairs is that of these classes.
    want = np.zeros((6, 6))
    for t in texts:
        c = [0, *(of[w] for w in t.split()), 0]
        np.add.at(want, (c[:-1], c[1:]), 1)
    assert (bigrams == want).all()


def test_a_word_moves_as_in_the_exchange():
    rnd = np.random.default_rng(5)
    k = 5
    classes = np.append(0, rnd.integers(1, k, 30))
    chain = rnd.integers(0, 31, 3000)
    after, before = np.zeros((31, k)), np.zeros((31, k))
    np.add.at(after, (chain[:-1], classes[chain[1:]]), 1)
    np.add.at(before, (chain[1:], classes[chain[:-1]]), 1)
    bigrams = np.zeros((k, k))
    np.add.at(bigrams, classes, after)
    got = class_lm.best_classes(after, before, classes, bigrams)
    largest = int(np.argsort(-after.sum(1), kind="stable")[0]) or int(np.argsort(-after.sum(1), kind="stable")[1])
    for u in {largest}:
        assert class_lm.exchange(after, before, classes, k)[u] == got[u]


def test_unknown_words_complete_the_distribution(spark):
    """All known words of a class and its endings' unknown words sum to one."""
    conf = class_lm.Settings(tail=16, classes=4)
    rows = [(w, w % 16, 1 + w % 5, 1 + w % 3) for w in range(60)] + [(int(class_lm.END.view(np.int64)[0]), 0, 7, 0)]
    known = spark.createDataFrame(rows, "word long, ending int, c long, cls int")
    model = class_lm.train(np.ones((4, 4)), known, conf)
    word, ending, c, cls = (np.array(x) for x in zip(*rows))
    word, ending = np.append(word, np.full(16, -1)), np.append(ending, np.arange(16))
    c, cls = np.append(c, np.zeros(16, int)), np.append(cls, np.zeros(16, int))
    of, _, log = class_lm.word_scores(model, word, ending, c, cls)
    assert np.bincount(of, 10**log, 4) == pytest.approx(np.ones(4))


def test_exchange_finds_alternating_classes():
    """Two kinds of words that always alternate end up in two classes."""
    words = 10
    chain = [2 * random.Random(i).randrange(words // 2) + i % 2 for i in range(4000)]
    classes = np.append(0, 1 + np.arange(words) // 5)
    for _ in range(6):
        after, before = np.zeros((words + 1, 3)), np.zeros((words + 1, 3))
        for a, b in zip(chain, chain[1:]):
            after[a + 1, classes[b + 1]] += 1
            before[b + 1, classes[a + 1]] += 1
        classes = class_lm.exchange(after, before, classes, 3)
    assert len(set(classes[1::2])) == 1 and len(set(classes[2::2])) == 1 and classes[1] != classes[2]


# -- quality rules -----------------------------------------------------------------------------------


def plain_stats(t):
    t = t or ""
    w = WORD.findall(t)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def check_rules(rows, texts):
    want = collections.Counter()
    for i, t in texts:
        s = plain_stats(t)
        want[i, *s, s[0] < 50 or 100 * s[4] > 50 * s[0]] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert not any(r.kept and r.base_failed for r in rows)


def test_rule_measures(spark, data, texts, odd, none):
    check_rules(queries.op6_quality_rules(spark, data).collect(), list(texts.items()))
    labels = spark.createDataFrame([(0, 1, None), (1, None, 1), (None, 0, 0), (0, 1, 0)], LABELS)
    check_rules(quality_rules.apply_rules(odd, labels).collect(), list(enumerate(ODD)))
    assert quality_rules.apply_rules(none, labels).collect() == []
    assert quality_rules.apply_rules(odd, labels.limit(0)).count() == len(ODD)


@given(st.integers(1, 60), st.integers(0, 60), st.sampled_from([0.01, 0.1, 0.5]))
@settings(deadline=None)
def test_binomial_tail_is_exact(n, k, p):
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(k, n) + 1))
    assert quality_rules.binomial_tail(k, n, p) == pytest.approx(want)


def test_certified_cutoffs_keep_the_promise():
    """Over many holdouts drawn at a loss just above the limit, a cutoff is certified no more often than the level."""
    rng = np.random.default_rng(5)
    wrong = sum(quality_rules.certified(np.array([k, 1000 - k]), 0.05, 0.05) for k in rng.binomial(1000, 0.0501, 4000))
    assert wrong / 4000 < 0.065
    assert quality_rules.certified(np.array([0, 0, 50, 5000]), 0.05, 0.01) == 3
    assert quality_rules.certified(np.array([0, 0, 900, 5000]), 0.05, 0.01) == 2
    assert quality_rules.certified(np.array([0, 0, 3]), 0.05, 0.01) == 0


def test_rules_reject_junk_and_spare_the_good(spark):
    rnd = random.Random(4)
    good = [" ".join(f"word{rnd.randint(0, 9999)}" for _ in range(120)) for _ in range(1500)]
    bad = [" ".join(f"w{rnd.randint(0, 9999)}%%##" for _ in range(120)) for _ in range(300)]
    docs = frame(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 1500), 0) for i in range(1800)], LABELS)
    kept = {r.doc_id for r in quality_rules.keep_good(docs, labels).collect()}
    assert kept == set(range(1500))


# -- quality classifier ------------------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    label = {r.doc_id: r.quality for r in table(spark, folder, "labels").collect()}
    rows = queries.op9_quality_classifier(spark, folder).collect()
    assert len(rows) == table(spark, folder, "documents").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.75
    assert np.mean([g >= 0.3 for g in good]) > 0.95


def test_classifier_odd_texts(spark, odd, none):
    conf = quality_classifier.Settings(bits=8)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(ODD))] + [(3, None, 0), (None, 1, 1), (4, 7, 0)], LABELS)
    rows = quality_classifier.classify(odd, labels, conf).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    scores = {r.doc_id: r.score for r in rows}
    assert scores[0] == scores[1] == scores[2]
    assert quality_classifier.classify(none, labels, conf).collect() == []
    assert {r.score for r in quality_classifier.classify(odd, labels.limit(0), conf).collect()} == {0.5}
    assert quality_classifier.keep_good(odd, labels.limit(0), conf).columns == odd.columns


# -- decontamination ---------------------------------------------------------------------------------


def plain_hits(docs, items, n=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ITEM_WORD.findall(lower(t))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    out = collections.Counter()
    for d, t in docs:
        w, hit, found = ITEM_WORD.findall(lower(t)), set(), set()
        for s in {len(x) for x in windows}:
            for k in range(len(w) - s + 1):
                if x := windows.get(tuple(w[k : k + s])):
                    hit |= set(range(k, k + s))
                    found |= x
        out[d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.mark.parametrize("block", [1 << 24, 60])
def test_windows_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    rnd = random.Random(8)
    items = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.choice([0, 1, 2, 3, 4, 6, 8])))) for i in range(12)] + [(3, "b b a a b"), (50, None), (51, "z,z")]
    docs = list(enumerate([" ".join(rnd.choice(["a", "b", "A", ",", "c"]) for _ in range(rnd.randint(0, 25))) for _ in range(120)] + ODD))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_contamination(frame(spark, [t for _, t in docs]), bench, 4)
    assert collections.Counter(map(tuple, decontamination.summary(found).collect())) == plain_hits(docs, items, 4)
    clean = decontamination.keep_clean(frame(spark, [t for _, t in docs]), bench, 4)
    assert {r.doc_id for r in clean.collect()} == {k[0] for k in plain_hits(docs, items, 4) if not k[-1]}


def test_decontamination_of_nothing(spark, odd, none):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontamination.summary(decontamination.find_contamination(none, bench)).collect() == []
    assert {r.n_hit for r in decontamination.summary(decontamination.find_contamination(odd, bench.limit(0))).collect()} == {0}
    assert decontamination.keep_clean(odd, bench).columns == odd.columns


# -- stored prefix counts, whole sequences -------------------------------------------------------------


@given(st.lists(st.sampled_from(PARTS), max_size=12))
@settings(max_examples=200, deadline=None)
def test_stored_counts_are_counts_of_prefixes(counter, library, parts):
    t = "".join(parts)
    stored, every = counter.boundaries(t.encode()).tolist(), counter.prefixes(t).tolist()
    assert set(stored) <= set(every) and stored == sorted(stored)
    assert (stored[-1] if stored else 0) == len(library.encode(t, add_special_tokens=False).ids)


def test_budget_from_stored_counts(spark, library):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = frame(spark, ["the old stone bridge", "", None, "a b"], [5, 6, None, 5])
    stored = token_counts.boundary_table(docs, path)
    assert stored.count() == 4
    n = [len(library.encode("the old stone bridge"[:k], add_special_tokens=False).ids) for k in (3, 7, 13, 20)]
    got = [(r.doc_id, r.units_kept) for r in token_counts.within_budget(stored, n[2]).collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (6, 0), (None, 0), (5, 2)], key=str)


def test_truncation_keeps_every_row(spark):
    """Null ids, one id on two texts, repeated rows, null texts."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = frame(spark, ["the old stone bridge", "the old stone bridge", "river and a hill", None, "the same words", ""], [1, 1, 1, 2, None, 3])
    got = token_counts.truncated(docs, token_counts.prefix_table(docs, path), 2)
    assert got.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=str) == sorted(
        [(1, "the old"), (1, "the old"), (1, "river and"), (2, None), (None, "the same"), (3, "")], key=str
    )


def test_sequences_hold_the_documents_ids(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    packed = packing.pack_documents(odd, path, 16, keep_ids=True)
    rows = packed.collect()
    whole = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4") for r in packing.sequences(packed).collect()}
    assert set(whole) == {r.sequence_id for r in rows} and all(len(w) <= 16 for w in whole.values())
    docs = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        docs.setdefault(r.doc_id, []).extend(whole[r.sequence_id][r.offset : r.offset + r.length].tolist())
    assert docs == {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(ODD)}


# -- counts at every prefix ----------------------------------------------------------------------------


@given(st.lists(st.sampled_from([*PARTS, "\r\n", "\n ", "ing", "x" * 40]), max_size=12))
@settings(max_examples=300, deadline=None)
def test_steps_give_the_count_of_every_prefix(counter, library, parts):
    t = "".join(parts)
    got = token_counts.prefix_counts(counter.steps(t.encode()), len(t)).tolist()
    assert got == [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]


def test_large_steps_are_kept(counter, library, monkeypatch):
    """A text with a step that no byte holds has 32-bit steps."""
    t = "a b\n\nc"
    monkeypatch.setattr(counter, "_steps_of", lambda data: np.array([300, -300, 0, 1, 0, 0, 2], np.int32))
    assert token_counts.prefix_counts(counter.steps(t.encode()), len(t)).tolist() == [0, 300, 0, 0, 1, 1, 1, 3]


def test_query_reads_every_prefix(spark, odd, library, tmp_path):
    """The budget's cut falls inside a word, between unit ends: only counts at every position find it."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = {r.doc_id: (r.n_tokens, r.kept_chars) for r in token_counts.token_counts(odd.filter("length(text) < 100"), path, 3).collect()}
    for i, (n, kept) in got.items():
        counts = [len(library.encode(ODD[i][:k], add_special_tokens=False).ids) for k in range(len(ODD[i]) + 1)]
        assert n == counts[-1] and kept == max(k for k, c in enumerate(counts) if c <= 3)
    word = "antidisestablishmentarianisms"
    [row] = token_counts.token_counts(frame(spark, [word], [1]), path, 2).collect()
    assert row.over_limit and 0 < row.kept_chars < len(word)
    stored = token_counts.step_table(frame(spark, ["the old", None], [1, None]), path).collect()
    assert [(r.doc_id, r.n_chars, len(r.steps)) for r in stored] == [(1, 7, 7), (None, 0, 0)]


# -- what finished phases leave ------------------------------------------------------------------------


def test_join_drops_tables_of_finished_phases(spark, odd, monkeypatch, tmp_path):
    """Only what the result reads is left in the shared folder: rows, set roots and the last edges of each search for components."""
    monkeypatch.setattr(common, "shared_dir", lambda spark, label: f"{tmp_path}/{label}/{len(list(tmp_path.glob(label + '/*')))}")
    out = jaccard_join.jaccard_components(odd)
    left = {p.name for p in tmp_path.iterdir() if p.name.split("-")[0] != "edges" and list(p.rglob("*.parquet"))}
    assert left == {"rows", "set-roots"}
    assert len(list(tmp_path.glob("edges-*/*/_SUCCESS"))) <= 3
    assert out.count() == odd.count()


def test_frequent_hashes_without_all_of_them_in_the_driver(spark, tmp_path):
    """Never more than asked for; whatever is left out is no more frequent than what is kept, up to a band."""
    rows = [(1, i * 2**53 - 2**62, n) for i, n in enumerate([4] * 300 + [9] * 40 + [1000] * 10 + [3] * 50)]
    prints = spark.createDataFrame(rows, "kind int, id long, n long")
    scratch = common.Scratch(spark)
    assert sorted(jaccard_join.frequent(prints, 1, 4, 1000, scratch).often.tolist()) == [4] * 300 + [9] * 40 + [1000] * 10
    some = jaccard_join.frequent(prints, 1, 4, 50, scratch)
    assert sorted(some.often.tolist())[-50:] == [9] * 40 + [1000] * 10 and len(some.hashes) == 50
    assert (np.diff(some.hashes.astype(object)) > 0).all()
    few = jaccard_join.frequent(prints, 1, 4, 30, scratch)
    assert 10 <= len(few.hashes) <= 30 and set(few.often.tolist()) <= {9, 1000} and (few.often == 1000).sum() == 10
    assert len(jaccard_join.frequent(prints, 2, 4, 30, scratch).hashes) == 0


def test_class_model_frees_each_phase(spark, data, monkeypatch):
    """Shuffle files of a finished phase are asked for before the next one writes its own."""
    asked = []
    monkeypatch.setattr(common, "forget", lambda spark: asked.append("deleted"))
    monkeypatch.setattr(class_lm, "forget", lambda spark: asked.append("phase"))
    class_lm.score_documents(table(spark, data, "documents"))
    assert asked[:3] == ["phase", "phase", "phase"] and asked[-1] == "phase" and asked.count("deleted") >= 1


# -- memory of a task ----------------------------------------------------------------------------------


def test_batches_have_limited_bytes(spark):
    """A task gets long rows in several batches; rows stay whole, and a limit that the session has is kept."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    def batches():
        rows = common.map_arrow(spark.range(0, 2000, 1, 1).selectExpr("id", "repeat('0123456789', 1000) AS text"), sizes, "n long, bytes long").collect()
        assert sum(r.n for r in rows) == 2000
        return [r.bytes for r in rows]

    old = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        assert max(batches()) < 8 << 20
        spark.conf.set(key, str(1 << 20))
        assert max(batches()) < 2 << 20
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


# -- words of packing ----------------------------------------------------------------------------------

WORD_PARTS = [*PARTS, "'", "s", "'LL", "A", "É", "×", "¼", "\xaa", "Į", "İ", "ŉ", "Å", "H̱", "Σ", "’", "<", "|", "<|ENDOFTEXT|>", "\x00", "\xad", "</w>", "x" * 40]


@pytest.fixture(scope="module")
def word_ids():
    return packing.WordIds(public_tokenizers.path("word_bpe_49k.json"), 50)


@given(st.lists(st.lists(st.sampled_from(WORD_PARTS), max_size=9).map("".join), max_size=4))
@settings(max_examples=500, deadline=None)
def test_word_ids_are_the_librarys(word_ids, some):
    want = [np.asarray(word_ids.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]
    assert word_ids.ids([t.encode() for t in some]) == want


def test_packing_looks_up_each_part_once():
    """Repeated parts cost one look-up in Python; words that differ in case, signs or white space share theirs."""

    class Counting(dict):
        asked = 0

        def __getitem__(self, key):
            Counting.asked += 1
            return super().__getitem__(key)

    encoder = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    encoder.parts = Counting()
    text = "The old river, the OLD (river)!\nit's 3,4 " * 200
    assert encoder.ids([text.encode()]) == [np.asarray(encoder.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert 0 < Counting.asked < 50


def test_packing_tasks_find_the_workers_words(spark):
    """The words that a task has learned stay in its worker for the next task."""

    def known(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(packing._encoders)])], ["n"])

    packing.token_pieces(frame(spark, ["a b c"] * 16), public_tokenizers.path("word_bpe_49k.json"), 4096, 1).collect()
    assert sum(r.n for r in common.map_arrow(spark.range(0, 64, 1, 16), known, "n long").collect()) > 0
