"""The operators' registered queries: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from twinproof.llm import class_lm, decontamination, divergence, id_store, jaccard_join, packing, quality_classifier, quality_rules, sharding, token_counts, url_filter, warc, whitening
from twinproof.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to a content-addressed archive and read back."""
    return warc.record_facts(warc.read_records(warc.write_archive(table(spark, sf_dir, "pages"))))


ORACLES["op4_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (
  SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest,
         max(page_id) OVER (PARTITION BY body) AS response
  FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN response END AS refers_to
FROM q
"""


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt into 24 shards by jump hash of doc_id."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


#: The contract's rules: host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), RULES, url_filter.labelled_table(spark))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document by certified cutoffs."""
    out = quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontamination.summary(decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-model score of every document."""
    return class_lm.score_documents(table(spark, sf_dir, "documents"))


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that links of 0.9 similarity connect."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), 90)


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their 32 leading components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 32)


@query
def op12_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to a compressed store and read back."""
    store = id_store.write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return id_store.id_facts(id_store.read_store(spark, id_store.open_store(spark, store.path)))


@query
def op13_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of sources and overused terms in all documents."""
    return divergence.audit(table(spark, sf_dir, "documents"), 30, 50)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op13_source_divergence_audit"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT w.lang, w.source, w.term, CAST(count(*) AS HUGEINT) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY 1, 2, 3),
l AS (SELECT lang, count(*) AS v, sum(total) AS lang_sum FROM k GROUP BY lang),
o AS (SELECT lang, source, sum(n) AS own_sum FROM c GROUP BY lang, source),
g AS (
  SELECT s.lang, s.source, coalesce(l.v, 0) AS v, coalesce(l.lang_sum, 0) AS lang_sum, coalesce(o.own_sum, 0) AS own_sum
  FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN l ON l.lang = s.lang LEFT JOIN o ON o.lang = s.lang AND o.source = s.source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + CAST(1000000000 * (coalesce(c.n, 0) + 5) AS HUGEINT) // CAST(g.own_sum + 5 * g.v AS HUGEINT) AS p,
         1 + CAST(1000000000 * (k.total + 5) AS HUGEINT) // CAST(g.lang_sum + 5 * g.v AS HUGEINT) AS q
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3),
x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
y AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM y WHERE part = 'pair' OR rank <= 50
"""

ORACLES["op2_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS k FROM w WHERE len(ws) > 0),
e AS (SELECT DISTINCT doc_id, array_to_string(ws[k : k + 2], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
p AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.doc_id)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

ORACLES["op8_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM benchmark),
bi AS (SELECT item, ws, least(len(ws), 10) AS l, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item, l, array_to_string(ws[k : k + l - 1], ' ') AS g FROM bi),
di AS (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS k FROM d, (SELECT DISTINCT l FROM bw) WHERE len(ws) >= l),
o AS (SELECT doc_id, k, bw.l, item FROM (SELECT doc_id, k, l, array_to_string(ws[k : k + l - 1], ' ') AS g FROM di) x JOIN bw ON bw.g = x.g AND bw.l = x.l),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + l)) AS p FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
