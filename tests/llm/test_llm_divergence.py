"""Source divergence, whitening and the id store against plain versions, and on odd rows."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import public_tokenizers
import pytest

from twinproof.llm import divergence, id_store, queries, whitening
from twinproof.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# -- source divergence ---------------------------------------------------------------------------------


def plain_audit(rows, min_docs, top):
    """Every share of every kept term, one by one."""
    rows = [(t or "", lang or "", s or "") for t, lang, s in rows]
    counts, has = defaultdict(Counter), defaultdict(Counter)
    for t, lang, s in rows:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t)]
        counts[lang, s].update(words)
        has[lang].update(set(words))
    out = []
    for lang in {r[1] for r in rows}:
        kept = [t for t, n in has[lang].items() if n >= min_docs]
        sources = sorted({r[2] for r in rows if r[1] == lang})

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        own = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(own[s][t] - own[o][t]) for t in kept), o) for o in sources if o != s]
            over = [(own[s][t] - whole[t], t) for t in kept if counts[lang, s][t] > 0 and own[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", over, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ranked)]
    return sorted(out)


def audited(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_of_documents(spark, data):
    docs = table(spark, data, "documents")
    rows = [tuple(r) for r in docs.select("text", "lang", "source").collect()]
    assert audited(divergence.audit(docs, 5, 7)) == plain_audit(rows, 5, 7)


def test_audit_matches_sql(spark, data, con):
    assert oracle.compare(queries.op13_source_divergence_audit(spark, data), con, queries.ORACLES["op13_source_divergence_audit"]) == []


def test_audit_of_odd_rows(spark):
    rows = [
        ("Éa ÉA b9b the", "en", "s1"), (None, "en", "s2"), ("", None, None), ("the The THE \U0001f600x", "en", None), ("x " * 60_000, "en", "s1"),
        ("the", "en", ""), ("the", "en", ""), ("ünï\tcode\x00z", "de", "s1"), ("only", "fr", "a"), ("only", "fr", "b"), (None, "xx", "a"), (None, "xx", "b"),
    ]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n int, rank string")
    for least, top in ((1, 50), (2, 1), (100, 5)):
        assert audited(divergence.audit(docs, least, top)) == plain_audit(rows, least, top)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_audit_with_many_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(" ".join(f"w{chr(97 + i)}{chr(97 + j)}" for i, j in rng.integers(0, 9, (40, 2))), "en", f"s{int(k) % 3}") for k in rng.integers(0, 9, 60)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(13)
    assert audited(divergence.audit(docs, 1, 4)) == plain_audit(rows, 1, 4)


def test_skyband_keeps_what_fewer_than_k_dominate():
    rng = np.random.default_rng(1)
    n, total = rng.integers(1, 9, 300), rng.integers(1, 12, 300)
    term = np.array([b"%03d" % i for i in rng.permutation(300)], object)
    for k in (1, 3, 10):
        beaten = [sum(n[j] >= n[i] and total[j] <= total[i] and term[j] < term[i] for j in range(300)) for i in range(300)]
        assert sorted(divergence.skyband(n, total, term, k)) == [i for i in range(300) if beaten[i] < k]


def test_term_counts_pass_on_early_without_loss(spark):
    docs = spark.createDataFrame([(f"a b{'xyz'[i % 3]} c", "en", "s") for i in range(50)], "text string, lang string, source string")
    small = {tuple(r) for r in divergence.term_counts(docs, most=2).collect()}
    assert small == {tuple(r) for r in divergence.term_counts(docs).collect()} and ("en", "s", "a", 50, 50) in small


# -- whitening -----------------------------------------------------------------------------------------


def plain_whitening(rows, k):
    """Dense covariance and numpy's eigenvectors."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in good], float)).astype(int) + 1_000_000
    n, s = len(x), x.sum(0)
    whole = n * x - s
    y = whole / n
    values, u = np.linalg.eigh(y.T @ y / n)
    values, u = values[::-1], u[:, ::-1]
    return [i for i, _ in good], (whole.astype(object) ** 2).sum(1), y @ u[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check_whitening(df, rows, k):
    ids, deviation, z, explained = plain_whitening(rows, k)
    got = df.toPandas()
    assert len(got) == len(ids) * k and set(got.n) == {len(ids)}
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    sign = np.sign((wide * z).sum(0))
    assert np.abs(wide * sign - z).max() < 1e-8
    assert dict(zip(got.vec_id, got.deviation)) == dict(zip(ids, deviation))
    first = got.drop_duplicates("component").sort_values("component")
    assert list(first.component) == list(range(1, k + 1)) and np.allclose(first.explained, explained, rtol=1e-9)
    assert 0 <= got.identity_error.max() < 1e-10


def test_whitening_of_embeddings(spark, data):
    rows = [tuple(r) for r in table(spark, data, "embeddings").select("vec_id", "embedding").collect()]
    check_whitening(queries.op11_embedding_whitening(spark, data), rows, 32)


def test_whitening_drops_bad_vectors_and_keeps_repeats(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(5) * [1, 2, 3, 4, 5] + 1000).tolist()) for i in range(300)]
    odd = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [float("nan")] * 5), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 1.0) for r in rows + odd], "vec_id long, embedding array<double>, n int, whitened double").repartition(7)
    check_whitening(whitening.whiten(df, 32), rows, 5)
    assert whitening.whiten(df, 2).filter("component > 2").count() == 0
    assert whitening.whiten(df.limit(0)).count() == 0
    twice = whitening.whiten(df.unionAll(df)).filter("component = 1")
    assert twice.count() == 600 and twice.filter("n <> 600").count() == 0


def test_whitening_without_variance_and_with_odd_shapes(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    one = whitening.whiten(make([(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, None), (2, 0, None, 0.0, None)]
    line = whitening.whiten(make([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (None, [3.0])])).collect()
    assert {r.component for r in line if r.whitened is None} == set() and len(line) == 6
    flat = whitening.whiten(make([(1, [1.0, 2.0]), (2, [2.0, 2.0])])).collect()
    assert {r.component for r in flat if r.whitened is None} == {2}
    huge = whitening.whiten(make([(1, [3e38, 0.0]), (2, [-3e38, 1.0])])).collect()
    want = 2 * (2 * whitening.LARGEST // 1) ** 2 // 2 + 64**2
    assert all(r.deviation is None and int(r.digits) == want for r in huge)
    assert whitening.whiten(make([(1, [])])).count() == 0


@pytest.mark.parametrize("d", [10, 45, 200])
def test_jacobi_davidson_finds_the_leading_pairs(d):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    values = np.sort(np.concatenate([rng.random(d - 3) + 1, [1.5, 1.5, 40.0]]))[::-1]
    a = (q * values) @ q.T
    passes = []
    theta, u, norm = whitening.leading_pairs(lambda b: passes.append(1) or a @ b, d, 32)
    k = min(32, d)
    assert np.allclose(theta, values[:k], rtol=1e-13) and np.abs(u.T @ u - np.eye(k)).max() < 1e-12
    assert norm.max() < 1e-12 * 40 and np.abs(a @ u - u * theta).max() < 1e-12 * 40


def test_partial_sums_are_merged_level_by_level(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(4) * [1, 2, 3, 4]).tolist()) for i in range(200)]
    stored = whitening.packed(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(20), "vec_id", "embedding")
    got = whitening.measured(stored)
    x = np.floor(64 * np.array([v for _, v in rows])).astype(int)
    assert got.parts == 20 and got.n == 200 and got.sums == x.sum(0).tolist() and got.largest == np.abs(x).max()


# -- id store ------------------------------------------------------------------------------------------


def library_ids(texts):
    from tokenizers import Tokenizer

    return [[*e.ids, 0] for e in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]


def check_store(rows, texts):
    """Order, gapless starts, and every id."""
    at = 0
    by_doc = defaultdict(Counter)
    for (doc, _), ids in zip(texts, library_ids([t or "" for _, t in texts])):
        by_doc[doc][np.asarray(ids, "<u4").tobytes()] += 1
    got = defaultdict(Counter)
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        got[r.doc_id][bytes(r.ids)] += 1
        at += r.n_tokens
    assert got == by_doc
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d))


def test_store_of_documents(spark, data):
    docs = table(spark, data, "documents")
    store = id_store.open_store(spark, id_store.write_store(docs, TOKENIZER).path)
    assert len(store.dictionary) > 0 and store.width == 2
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rows = id_store.read_store(spark, store).collect()
    check_store(rows, texts)
    facts = {r.doc_id: r for r in queries.op12_token_id_output(spark, data).collect()}
    assert all((r.start, r.n_tokens, zlib.crc32(r.ids)) == (facts[r.doc_id].start, facts[r.doc_id].n_tokens, facts[r.doc_id].ids_crc32) for r in rows)
    some = [texts[0][0], texts[7][0], -5]
    found = {r.doc_id: (r.start, bytes(r.ids)) for r in id_store.read_documents(spark, store, some).collect()}
    assert found == {r.doc_id: (r.start, bytes(r.ids)) for r in rows if r.doc_id in some}


def test_store_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(id_store, "BLOCK_BYTES", 200)
    odd = ["", None, " ", "a  b\n\n c\t d ", "<|endoftext|> x <|endoftext|>", "don't we'll", "　x   y", "naïve ÉÉ 日本語", "word " * 30_000, "z" * 20_000, "a" * 50 + " b"]
    texts = [(i % 7 - 3, t) for i, t in enumerate(odd * 3)] + [(None, "null id"), (None, None)] + [(5, "same words again")] * 40
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in texts], "doc_id long, text string, n int, frame string").repartition(6)
    store = id_store.write_store(docs, TOKENIZER)
    rows = id_store.read_store(spark, store).collect()
    check_store(rows, texts)
    assert spark.read.parquet(f"{store.path}/blocks").count() > 3
    empty = id_store.write_store(docs.limit(0), TOKENIZER)
    assert empty.dictionary == b"" and id_store.read_store(spark, id_store.open_store(spark, empty.path)).count() == 0


def test_store_refuses_another_dictionary(spark, data):
    store = id_store.write_store(table(spark, data, "documents"), TOKENIZER)
    other = id_store.Store(store.path, store.dictionary[:-1] + b"x", store.width)
    with pytest.raises(Exception, match="another dictionary"):
        id_store.read_store(spark, other).collect()


def test_dictionary_makes_short_frames_smaller(spark, data):
    docs = table(spark, data, "documents").filter("length(text) < 600")
    store = id_store.write_store(docs, TOKENIZER)
    with_it = spark.read.parquet(f"{store.path}/blocks").selectExpr("sum(length(frames)) AS n").first().n
    plain = id_store.write_store(docs, TOKENIZER, samples=1)
    assert plain.dictionary == b"" and with_it < spark.read.parquet(f"{plain.path}/blocks").selectExpr("sum(length(frames)) AS n").first().n
