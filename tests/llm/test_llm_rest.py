"""Sharding, archive, URL filter, the registered SQL and the pipeline."""

from __future__ import annotations

import collections
import gzip
import zlib

import numpy as np
import oracle
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pyspark.sql import functions as F

from twinproof.llm import decontamination, id_store, jaccard_join, packing, quality_classifier, quality_rules, queries, sharding, url_filter, warc
from twinproof.llm.common import table


# -- sharding ----------------------------------------------------------------------------------------


def scalar_jump(key: int, shards: int) -> int:
    """The published loop, on one mixed key."""
    state = int(sharding.mix(np.array([key], np.int64).view(np.uint64))[0])
    shard, jump = -1, 0
    while jump < shards:
        shard = jump
        state = (state * 2862933555777941757 + 1) % (1 << 64)
        jump = int((shard + 1) * (float(1 << 31) / ((state >> 33) + 1)))
    return shard


def test_jump_hash_is_the_published_one():
    keys = np.array([*range(-20, 200), 2**62, -(2**63)])
    for n in (1, 2, 24, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [scalar_jump(int(k), n) for k in keys]


def test_growth_moves_only_into_the_new_shard():
    keys = np.arange(50_000)
    a, b = sharding.jump_hash(keys, 24), sharding.jump_hash(keys, 25)
    assert set(b[a != b]) == {24} and abs((a != b).mean() - 1 / 25) < 0.005
    assert np.bincount(a).max() < 1.1 * len(keys) / 24


def check_shards(rows, texts):
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_documents(spark, data):
    check_shards(queries.op5_sharding(spark, data).collect(), [(r.doc_id, r.text) for r in table(spark, data, "documents").collect()])


def test_shards_of_odd_rows(spark, monkeypatch):
    rows = [(1, "é"), (1, "é"), (None, None), (None, ""), (2, "x" * 100_000)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, shard string, slot int")
    check_shards(sharding.shard_documents(df).collect(), rows)
    assert sharding.shard_documents(df.limit(0)).collect() == []


# -- archive -----------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, address string, header int"


def test_archive_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "SALT_ROWS", 2)
    big, other = "<p>ü</p>" * 200, "x" * 1000
    rows = [(i, f"http://h/{i}\r\nX: y", t) for i, t in enumerate([big, None, "", "small", "small", other, big, big, other, big, big * 50])] + [(9, None, big), (None, "u", big), (2**62, "v", "x" * 999)]
    archive = warc.write_archive(spark.createDataFrame([(*r, "a", 1) for r in rows], PAGES))
    stored = archive.payloads.collect()
    assert len({r.address for r in stored}) == len(stored) == len({t or "" for _, _, t in rows})
    assert {gzip.decompress(r.stored).decode() for r in stored} == {t or "" for _, _, t in rows}
    records = warc.read_records(archive)
    assert collections.Counter((r.page_id, bytes(r.payload)) for r in records.collect()) == collections.Counter((i, (t or "").encode()) for i, _, t in rows)
    facts = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in warc.record_facts(records).collect())
    want = collections.Counter()
    for i, _, t in rows:
        last = max(j for j, _, s in rows if j is not None and (s or "") == (t or ""))
        revisit = len((t or "").encode()) >= 1000 and i != last
        want[i, "revisit" if revisit else "response", last if revisit else None] += 1
    assert facts == want
    for r in archive.headers.collect():
        fields = warc.parse_header(bytes(r.header))
        assert bytes(r.header).endswith(b"\r\n\r\n") and fields["WARC-Payload-Digest"].startswith("sha1:")


def test_archive_of_nothing(spark):
    assert warc.record_facts(warc.read_records(warc.write_archive(spark.createDataFrame([], PAGES)))).collect() == []


def test_damage_is_noticed(spark):
    archive = warc.write_archive(spark.createDataFrame([(1, "u", "text", None, 1)], PAGES))
    bad = warc.Archive(archive.headers, archive.payloads.selectExpr("address", "parts", f"unhex('{gzip.compress(b'other').hex()}') AS stored"))
    with pytest.raises(Exception, match="does not match"):
        warc.read_records(bad).collect()


# -- URL filter --------------------------------------------------------------------------------------


def plain_url(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = [
    None, "", "nothing", "http://", "HTTP://A.Example.ORG/es/x", "x://example.org/en/12?q#f", "x://example.org/en/2", "x://notexample.org/es/", "x://org", "x://org/", "x://a.com/de/x", "x://a.com/fr/../de",
    "x://a.com?u=/fr/", "x://com/fr/", "x://ü.example.org/es/é", "x://u:p@a.com:80/de/", "a://b://c/d", "x://\n.com/fr/\n", "x:///path", "http://www.casino-win.example.com/en/3", "http://free-bets.example.net/", "http://library.example.net/en/5",
    "x://" + "a" * 50_000 + ".com/de/" + "b" * 50_000,
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "r", "v", 1) for i, u in enumerate([*URLS, URLS[4]])], "page_id long, url string, rule string, verdict string, host int")
    out = url_filter.filter_urls(df, queries.RULES, url_filter.labelled_table(spark))
    got = {r.page_id: r for r in out.collect()}
    for i, u in enumerate([*URLS, URLS[4]]):
        host, path, rule, verdict = plain_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if rule else got[i].verdict in ("allow", "block")
    assert [got[i].verdict for i in range(19, 22)] == ["block", "block", "allow"]
    assert got[0].verdict == "allow"
    assert url_filter.filter_urls(df.limit(0), queries.RULES, url_filter.labelled_table(spark)).collect() == []
    assert url_filter.filter_urls(df, [], url_filter.labelled_table(spark).limit(0)).count() == len(URLS) + 1


def test_url_plan_is_native(spark, data):
    plan = queries.op10_url_filters(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan


def test_url_model_separates_unseen_hosts(spark):
    hosts = {"best-casino.example.net": "block", "bets-free.example.net": "block", "pills-cheap.example.com": "block", "mountain-notes.example.net": "allow", "city-library.example.com": "allow", "kitchen-history.net": "allow"}
    df = spark.createDataFrame([(i, f"http://{h}/en/77") for i, h in enumerate(hosts)], "page_id long, url string")
    got = {r.host: r.verdict for r in url_filter.filter_urls(df, [], url_filter.labelled_table(spark)).collect()}
    assert got == hosts


# -- registration and pipeline -----------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_registered_sql(spark, data, con, name):
    assert oracle.compare(queries.QUERIES[name](spark, data), con, queries.ORACLES[name]) == []


def test_every_operator_is_registered():
    names = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert {f"op{n}" for n in range(1, 11)} <= names and "pipeline" in entry.queries()


def test_pipeline_stages_take_effect(spark, data):
    docs = table(spark, data, "documents")
    columns, ids, label = docs.columns, {r.doc_id for r in docs.collect()}, {r.doc_id: r.quality for r in table(spark, data, "labels").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        left = {r.doc_id for r in out.select("doc_id").collect()}
        assert left <= ids
        if k == len(corpus_pipeline.STAGES) - 1:
            assert left == ids
            break
        assert out.columns == columns
        if k == 2:
            groups = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
            assert left == {i for i in ids if groups[i] == i}
        if k == 3:
            hit = {r.doc_id for r in queries.decontamination.summary(queries.decontamination.find_contamination(docs, table(spark, data, "benchmark"))).collect() if r.contaminated}
            assert left == ids - hit
        docs, ids = spark.createDataFrame(out.collect(), out.schema), left
    rows = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id for r in rows} == left
    assert sum(label.get(i) == 0 for i in left) < sum(q == 0 for q in label.values())


def test_pipeline_of_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    rows = [(1, None, None, None, None, "a"), (None, "word " * 60, None, None, None, "b"), (2, "", "en", "s", 0, "c"), (3, " ".join(f"w{i}" for i in range(80)), "en", "s", 1, None)]
    rows += [rows[-1], (4, " ".join(f"w{i}" for i in range(80)), "en", "s", 1, None), (5, " ".join(f"v{i}" for i in range(30_000)), None, "s", 1, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "never seen before here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {3, 5}
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_packing_is_planned_on_lengths_only(spark):
    """A million documents of few lengths need few runs."""
    counts = np.zeros(4097, np.int64)
    counts[[3, 500, 1000, 3900, 4096]] = [10**9, 10**6, 10**6, 10**5, 10**5]
    runs = packing.best_two_fit(counts, 4096)
    assert len(runs) < 50 and sum(t * m for t, b in runs for _, m in b) == counts.sum()


# -- names that clash, repeated ids, the header's fields ------------------------------------------------


def test_headers_have_the_mandatory_fields(spark):
    rows = [(1, "u", "x" * 1000, "2024-05-06 07:08:09"), (1, "u", "x" * 1000, None), (2, "v", "x" * 1000, None), (2, "v", "x" * 1000, None), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, seen string").withColumn("seen", F.col("seen").cast("timestamp"))
    archive = warc.write_archive(pages, date="seen")
    found = [warc.parse_header(bytes(r.header)) for r in archive.headers.collect()]
    for fields in found:
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(fields)
        assert ("WARC-Refers-To" in fields) == ("WARC-Profile" in fields) == (fields["WARC-Type"] == "revisit")
    ids = [f["WARC-Record-ID"] for f in found]
    assert len(set(ids)) == len(rows)
    assert sorted(f["WARC-Date"] for f in found) == [warc.NO_DATE] * 4 + ["2024-05-06T07:08:09Z"]
    responses = {f["WARC-Record-ID"] for f in found if f["WARC-Type"] == "response"}
    assert {f["WARC-Refers-To"] for f in found if f["WARC-Type"] == "revisit"} <= responses


def test_keeping_stages_leave_any_column_alone(spark):
    names = ["_text", "_n_words", "_spans", "_items", "_llm_score", "_llm_row", "_llm_n_words", "kept", "n_words", "quality", "a b"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names)
    docs = spark.createDataFrame([(i, "some plain words about a river and its old stone bridge " * 9, *range(len(names))) for i in range(3)], schema)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    bench = spark.createDataFrame([("q", "nothing that occurs in any of these texts at all today")], "item_id string, text string")
    for kept in (decontamination.keep_clean(docs, bench), quality_classifier.keep_good(docs, labels, threshold=0.0), quality_rules.keep_good(docs, labels.limit(0))):
        assert kept.columns == docs.columns
        for r in kept.collect():
            assert tuple(r)[2:] == tuple(range(len(names)))
    assert decontamination.keep_clean(docs, bench).count() == 3


def test_packing_replaces_columns_of_its_own_names(spark):
    pieces = spark.createDataFrame([(1, 0, 3, "a", "b", "c"), (2, 0, 2, "d", "e", "f")], "doc_id long, piece int, length long, sequence_id string, offset string, _nth string")
    out = {(r.doc_id, r.sequence_id, r.offset) for r in packing.pack(pieces, 5).collect()}
    assert {s for _, s, _ in out} == {0} and {o for _, _, o in out} in ({0, 3}, {0, 2})


def test_training_reads_one_row_an_id_and_no_contradiction(spark):
    conf = quality_classifier.Settings()
    docs = [(i, f"good calm words {i} of a story" if i % 2 else f"buy now !!! {i} $$$") for i in range(60)]
    labels = [(i, i % 2) for i in range(60)]
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    plain = quality_classifier.train(make(docs, "doc_id long, text string"), make(labels, "doc_id long, quality int"), conf)
    more = quality_classifier.train(make(docs + [docs[7]] * 500, "doc_id long, text string"), make(labels + labels[:5] + [(100, 0), (100, 1)], "doc_id long, quality int"), conf)
    assert (plain.weights == more.weights).all() and plain.bias == more.bias


def test_repeated_benchmark_items_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "z")], "doc_id long, text string")
    item = [("q", "b c d e f g h i j k")]
    one, many = (spark.createDataFrame(item * n, "item_id string, text string") for n in (1, 400))
    monkeypatch.setattr(decontamination, "build", lambda items, window, _build=decontamination.build: _build(items, window) if len(items) <= 1 else pytest.fail("repeated rows"))
    found = [sorted(tuple(r) for r in decontamination.summary(decontamination.find_contamination(docs, b)).collect()) for b in (one, many)]
    assert found[0] == found[1] and found[0][0][2] == 10


def test_url_verdict_equals_a_plain_score(spark, data):
    """Weights taken as trained; the score in plain Python over the buckets that a projection gives."""
    import math

    table = url_filter.labelled_table(spark)
    weights = url_filter.train(table, (3, 4), 8192, 300, 20.0, 1e-4)
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, [], table).collect()}
    host, path = url_filter.split_url(F.col("url"))
    for r in pages.select("page_id", host.alias("h"), url_filter.buckets(host, path, (3, 4), 8192).alias("x")).collect():
        z = sum(weights[b] for b in r.x) / math.sqrt(len(r.x)) + weights[-1]
        if abs(z) > 1e-9:
            assert got[r.page_id] == ("block" if r.h and z >= 0 else "allow")


def test_ids_look_up_each_unit_once():
    """Repeated units of a slice cost one look-up in Python; ids are the library's, whatever the white space."""

    class Counting(dict):
        asked = 0

        def __getitem__(self, key):
            Counting.asked += 1
            return super().__getitem__(key)

    encoder = id_store.UnitIds(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.units = Counting()
    texts = ["x " + "the old river " * 200 + "end", "", " ", " a", "a  b c", "a ", "x<|endoftext|> y", "é ü　c it's 3,4", "\n a\n"]
    want = [np.asarray(encoder.library.encode(t, add_special_tokens=False).ids, encoder.kind).tobytes() for t in texts]
    assert encoder.ids([t.encode() for t in texts]) == want
    assert Counting.asked < 50 and encoder.ids([]) == []
