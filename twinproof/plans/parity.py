"""Parity queries: a source table against a target with lost, corrupted and extra rows.

The fault rates below only shape the target; every query reads both tables whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinproof.functions.canon import bucket, key_text, row_hash
from twinproof.operators import reconcile as R
from twinproof.operators.changes import orphan_rows
from twinproof.operators.faults import skewed_copy
from twinproof.operators.profile import diff_profiles, profile_report, table_profile, table_sizes
from twinproof.plans.registry import Derived, query, with_ctes
from twinproof.session import shared_dir
from twinproof.sources.ledger import append_ledger, parse_ledger, read_ledger
from twinproof.sources.reports import read_report, write_report
from twinproof.sources.tables import TablePair, load

LOST, CORRUPT, EXTRA = 97, 101, 211

# Types that render alike in every engine, for the hashes that DuckDB recomputes.
ORDER_CASTS = {"o_totalprice": "decimal(15,2)", "o_orderdate": "date"}


def orders_pair(spark: SparkSession, folder: str) -> TablePair:
    source = load(spark, folder, "orders")
    k = F.col("o_orderkey")
    target = skewed_copy(source, "o_orderkey", "o_orderpriority", k % LOST == 0, k % CORRUPT == 0, k % EXTRA == 0)
    return TablePair("orders", source, target, ["o_orderkey"], casts=ORDER_CASTS)


def lineitem_pair(spark: SparkSession, folder: str) -> TablePair:
    """A table without a key; its order and line number repeat."""
    source = load(spark, folder, "lineitem")
    k = F.col("l_partkey") * 7 + F.col("l_linenumber")
    target = skewed_copy(source, "l_partkey", "l_returnflag", k % LOST == 0, k % CORRUPT == 0, k % EXTRA == 0)
    return TablePair("lineitem", source, target)


def customer_pair(spark: SparkSession, folder: str) -> TablePair:
    """Two copies that were written apart, in another order and number of files."""
    source = load(spark, folder, "customer")
    path = shared_dir(spark, "customer-copy")
    source.repartitionByRange(4, "c_name").write.parquet(path)
    return TablePair("customer", source, spark.read.parquet(path), ["c_custkey"])


def turns_pair(spark: SparkSession, folder: str) -> TablePair:
    """Composite key."""
    source = load(spark, folder, "conversations")
    k = F.col("conv_id") * 31 + F.col("turn")
    target = skewed_copy(source, "conv_id", "text", k % 19 == 0, k % 23 == 0, k % 29 == 0)
    return TablePair("conversations", source, target, ["conv_id", "turn"])


_ORDERS_TARGET = f"""orders_t AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
         o_orderpriority || CASE WHEN o_orderkey % {CORRUPT} = 0 THEN '_corrupted' ELSE '' END AS o_orderpriority
  FROM orders WHERE o_orderkey % {LOST} <> 0
  UNION ALL
  SELECT -1 - o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % {EXTRA} = 0)"""

_LK = "(l_partkey * 7 + l_linenumber)"
_LCOLS = "l_orderkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, l_shipdate"
_LROWS = f"SELECT {_LCOLS}, l_partkey, l_returnflag FROM"
_LINEITEM_TARGET = f"""lineitem_t AS (
  SELECT {_LCOLS}, l_partkey, l_returnflag || CASE WHEN {_LK} % {CORRUPT} = 0 THEN '_corrupted' ELSE '' END AS l_returnflag
  FROM lineitem WHERE {_LK} % {LOST} <> 0
  UNION ALL
  SELECT {_LCOLS}, -1 - l_partkey, l_returnflag FROM lineitem WHERE {_LK} % {EXTRA} = 0)"""

_TK = "(conv_id * 31 + turn)"
_TURNS_TARGET = f"""turns_t AS (
  SELECT conv_id, turn, role, text || CASE WHEN {_TK} % 23 = 0 THEN '_corrupted' ELSE '' END AS text
  FROM conversations WHERE {_TK} % 19 <> 0
  UNION ALL
  SELECT -1 - conv_id, turn, role, text FROM conversations WHERE {_TK} % 29 = 0)"""

_MD5 = "CAST('0x' || substr(md5(CAST(to_json({0}) AS VARCHAR)), 1, 15) AS BIGINT)"
_KEY_HASH = _MD5.format("[CAST(o_orderkey AS VARCHAR)]")
_ROW_HASH = _MD5.format(
    "[CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, "
    "CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR), CAST(CAST(o_orderdate AS DATE) AS VARCHAR), o_orderpriority]"
)
_PRINTS = f"""{_ORDERS_TARGET}, prints AS (
  SELECT true AS s, o_orderkey AS pk, {_KEY_HASH} % 256 AS b, {_ROW_HASH} AS h FROM orders
  UNION ALL
  SELECT false, o_orderkey, {_KEY_HASH} % 256, {_ROW_HASH} FROM orders_t)"""
_BUCKETS = f"""{_PRINTS}, buckets AS (
  SELECT b, count(*) FILTER (WHERE s) AS source_rows, count(*) FILTER (WHERE NOT s) AS target_rows,
         coalesce(sum(h) FILTER (WHERE s), 0) AS source_sum, coalesce(sum(h) FILTER (WHERE NOT s), 0) AS target_sum
  FROM prints GROUP BY b)"""
_MATCH = "(source_rows = target_rows AND source_sum = target_sum)"
_KIND = """CASE WHEN t.o_orderkey IS NULL THEN 'missing_on_target' WHEN s.o_orderkey IS NULL THEN 'extra_on_target'
  WHEN s.o_orderpriority <> t.o_orderpriority THEN 'hash_diff' END"""
_DIFF = f"""diffs AS (
  SELECT coalesce(s.o_orderkey, t.o_orderkey) AS key, {_KIND} AS kind
  FROM orders s FULL JOIN orders_t t ON s.o_orderkey = t.o_orderkey)"""


@query(
    "scan_pair",
    f"""WITH {_ORDERS_TARGET}
    SELECT 'source' AS side, o_orderkey, o_orderpriority FROM orders
    UNION ALL SELECT 'target', o_orderkey, o_orderpriority FROM orders_t""",
)
def scan_pair(spark: SparkSession, folder: str) -> DataFrame:
    """Both sides of a pair, narrowed to key and one compared column."""
    pair = orders_pair(spark, folder)
    cols = ["o_orderkey", "o_orderpriority"]
    return pair.source.select(F.lit("source").alias("side"), *cols).unionByName(
        pair.target.select(F.lit("target").alias("side"), *cols)
    )


@query(
    "row_fingerprint",
    f"""SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS pk, {_ROW_HASH} AS h, {_KEY_HASH} % 256 AS b FROM orders""",
)
def row_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    source, _ = orders_pair(spark, folder).sides()
    kh = row_hash(source.schema, ["o_orderkey"], portable=True)
    return source.select(
        "o_orderkey",
        key_text(["o_orderkey"], source.schema).alias("pk"),
        row_hash(source.schema, source.columns, portable=True).alias("h"),
        bucket(kh, R.BUCKETS).alias("b"),
    )


@query(
    "reconcile_full",
    f"""WITH {_PRINTS}, f AS (SELECT count(*) FILTER (WHERE s) AS source_rows, count(*) FILTER (WHERE NOT s) AS target_rows,
      coalesce(sum(h) FILTER (WHERE s), 0) AS source_sum, coalesce(sum(h) FILTER (WHERE NOT s), 0) AS target_sum FROM prints)
    SELECT 'orders' AS "table", source_rows, target_rows, CAST(source_sum AS VARCHAR) AS source_sum,
      CAST(target_sum AS VARCHAR) AS target_sum, CASE WHEN {_MATCH} THEN '' ELSE '0' END AS mismatched_buckets,
      {_MATCH} AS match FROM f""",
)
def reconcile_full(spark: SparkSession, folder: str) -> DataFrame:
    out = R.full_report(orders_pair(spark, folder), portable=True)
    sums = {c: F.col(c).cast("string") for c in ("source_sum", "target_sum")}
    listed = F.array_join(F.col("mismatched_buckets").cast("array<string>"), ",")
    return out.withColumns({**sums, "mismatched_buckets": listed})


@query(
    "reconcile_buckets",
    f"""WITH {_BUCKETS} SELECT b, source_rows, target_rows, CAST(source_sum AS VARCHAR) AS source_sum,
      CAST(target_sum AS VARCHAR) AS target_sum, {_MATCH} AS match FROM buckets""",
)
def reconcile_buckets(spark: SparkSession, folder: str) -> DataFrame:
    out = R.bucket_report(orders_pair(spark, folder), portable=True)
    return out.withColumns({c: F.col(c).cast("string") for c in ("source_sum", "target_sum")})


_LEDGER_MISSING = f"""(SELECT count(*) FROM orders o WHERE o.o_orderkey % {LOST} = 0)"""


@query(
    "reconcile_summary",
    f"""WITH {_BUCKETS}, {_LINEITEM_TARGET}, rep AS (
      SELECT 'orders' AS "table", CAST(sum(source_rows) AS BIGINT) AS source_rows,
        CAST(sum(target_rows) AS BIGINT) AS target_rows, bool_and({_MATCH}) AS match FROM buckets
      UNION ALL
      SELECT 'lineitem', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM lineitem_t),
        (SELECT count(*) FROM (({_LROWS} lineitem EXCEPT ALL {_LROWS} lineitem_t) UNION ALL ({_LROWS} lineitem_t EXCEPT ALL {_LROWS} lineitem))) = 0
      UNION ALL
      SELECT 'customer', count(*), count(*), (SELECT count(*) FROM (SELECT * FROM customer EXCEPT ALL SELECT * FROM customer)) = 0 FROM customer)
    SELECT "table", source_rows, target_rows, match, {_LEDGER_MISSING} = 0 AS ledger_ok,
      (SELECT max(event_id) - max(event_id) FILTER (WHERE event_type <> 'error') FROM events) AS lag,
      bool_and(match) OVER () AND {_LEDGER_MISSING} = 0 AS all_match FROM rep""",
)
def reconcile_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: bucketed parity of three tables, the ledger proof and the change lag."""
    orders = orders_pair(spark, folder)
    missing = R.ledger_missing(_ledger(spark, folder), orders.target, "o_orderkey")
    # The stream has applied everything up to the newest change that is not an error event.
    lag = load(spark, folder, "events").agg(
        (F.max("event_id") - F.max(F.when(F.col("event_type") != "error", F.col("event_id")))).alias("lag")
    )
    pairs = [orders, lineitem_pair(spark, folder), customer_pair(spark, folder)]
    return R.summary(pairs, missing, lag).drop("buckets", "mismatched_buckets")


@query(
    "reconcile_drill",
    f"""WITH {_ORDERS_TARGET}, {_DIFF} SELECT 'orders' AS "table", CAST(key AS VARCHAR) AS pk, kind
      FROM diffs WHERE kind IS NOT NULL""",
)
def reconcile_drill(spark: SparkSession, folder: str) -> DataFrame:
    return R.drill(orders_pair(spark, folder)).select("table", "pk", "kind")


def _job(spark: SparkSession, folder: str) -> R.Reconciliation:
    return R.reconcile(spark, [orders_pair(spark, folder), turns_pair(spark, folder)])


_TURN_DIFF = """turn_diff AS (SELECT coalesce(s.conv_id, t.conv_id) || ',' || coalesce(s.turn, t.turn) AS pk,
      CASE WHEN t.conv_id IS NULL THEN 'missing_on_target' WHEN s.conv_id IS NULL THEN 'extra_on_target' ELSE 'hash_diff' END AS kind
      FROM conversations s FULL JOIN turns_t t ON s.conv_id = t.conv_id AND s.turn = t.turn
      WHERE s.conv_id IS NULL OR t.conv_id IS NULL OR s.text <> t.text)"""


@query(
    "reconcile_job",
    f"""WITH {_ORDERS_TARGET}, {_DIFF}, {_TURNS_TARGET}, {_TURN_DIFF}
    SELECT 'orders' AS "table", CAST(key AS VARCHAR) AS pk, kind FROM diffs WHERE kind IS NOT NULL
    UNION ALL SELECT 'conversations', pk, kind FROM turn_diff""",
)
def reconcile_job(spark: SparkSession, folder: str) -> DataFrame:
    """The one-call job over two tables: every differing row."""
    return _job(spark, folder).rows.select("table", "pk", "kind")


@query(
    "reconcile_job_examples",
    f"""WITH {_ORDERS_TARGET}, {_DIFF}, {_TURNS_TARGET}, {_TURN_DIFF},
    a AS (SELECT 'orders' AS t, kind FROM diffs WHERE kind IS NOT NULL UNION ALL SELECT 'conversations', kind FROM turn_diff)
    SELECT t AS "table", least(count(*), 20) AS examples, CAST((SELECT count(*) FROM a x WHERE x.t = a.t) AS BIGINT) AS differing FROM a GROUP BY t""",
)
def reconcile_job_examples(spark: SparkSession, folder: str) -> DataFrame:
    """How many examples the job shows per table, beside all its differing rows."""
    job = _job(spark, folder)
    shown = job.examples.groupBy("table").agg(F.count("*").alias("examples"))
    return shown.join(job.rows.groupBy("table").agg(F.count("*").alias("differing")), "table")


@query(
    "reconcile_widened",
    """SELECT 'orders' AS "table", count(*) AS source_rows, count(*) AS target_rows,
      count(*) = count(CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS DECIMAL(20,4))) AND bool_and(CAST(CAST(o_orderkey AS DECIMAL(25,3)) AS BIGINT) = o_orderkey)
      AND bool_and(CAST(CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS DECIMAL(20,4)) AS DECIMAL(15,2)) = CAST(o_totalprice AS DECIMAL(15,2))) AS match FROM orders""",
)
def reconcile_widened(spark: SparkSession, folder: str) -> DataFrame:
    """Orders against a copy in wider types, with a map inside a struct built in another key order."""
    price = F.col("o_totalprice").cast("decimal(15,2)")
    base = load(spark, folder, "orders").select("o_orderkey", price.alias("price"), "o_orderstatus", "o_orderpriority")
    a, b = F.create_map(F.lit("s"), "o_orderstatus", F.lit("p"), "o_orderpriority"), F.create_map(F.lit("p"), "o_orderpriority", F.lit("s"), "o_orderstatus")
    source = base.select("o_orderkey", "price", F.struct(a.alias("m")).alias("nested"))
    target = base.select(F.col("o_orderkey").cast("decimal(25,3)").alias("o_orderkey"), F.col("price").cast("decimal(20,4)").alias("price"), F.struct(b.alias("m")).alias("nested"))
    return R.summary([TablePair("orders", source, target, ["o_orderkey"])]).select("table", "source_rows", "target_rows", "match")


@query(
    "reconcile_refine",
    f"""WITH {_TURNS_TARGET} SELECT coalesce(s.conv_id, t.conv_id) || ',' || coalesce(s.turn, t.turn) AS pk,
      CASE WHEN t.conv_id IS NULL THEN 'missing_on_target' WHEN s.conv_id IS NULL THEN 'extra_on_target' ELSE 'hash_diff' END AS kind
      FROM conversations s FULL JOIN turns_t t ON s.conv_id = t.conv_id AND s.turn = t.turn
      WHERE s.conv_id IS NULL OR t.conv_id IS NULL OR s.text <> t.text""",
)
def reconcile_refine(spark: SparkSession, folder: str) -> DataFrame:
    """Composite key, and a second checksum pass before rows are compared."""
    pair = turns_pair(spark, folder)
    prints = R.persist_fingerprints(spark, pair)
    suspects = R.suspect_keys(R.refine(prints, R.bucket_sums(prints), 64, R.BUCKETS))
    return R.classify(R.fingerprints(pair, suspects=suspects)).select("pk", "kind")


@query(
    "reconcile_drill_keyless",
    f"""WITH {_LINEITEM_TARGET}, u AS (
      SELECT {_LCOLS}, l_partkey, l_returnflag, 1 AS n FROM lineitem
      UNION ALL SELECT {_LCOLS}, l_partkey, l_returnflag, -1 FROM lineitem_t),
    g AS (SELECT {_LCOLS}, l_partkey, l_returnflag, sum(n) AS surplus FROM u GROUP BY ALL HAVING sum(n) <> 0)
    SELECT CASE WHEN surplus > 0 THEN 'missing_on_target' ELSE 'extra_on_target' END AS kind, count(*) AS rows FROM g GROUP BY 1""",
)
def reconcile_drill_keyless(spark: SparkSession, folder: str) -> DataFrame:
    """The bucketed drill on a table without a key."""
    return R.drill(lineitem_pair(spark, folder)).groupBy("kind").agg(F.count("*").alias("rows"))


@query(
    "reconcile_examples",
    f"""WITH {_ORDERS_TARGET}, {_DIFF}, found AS (
      SELECT kind, CAST(key AS VARCHAR) AS pk, {_MD5.format("[CAST(key AS VARCHAR)]")} % 256 AS bucket
      FROM diffs WHERE kind IS NOT NULL)
    SELECT 'orders' AS "table", bucket, pk, kind, CAST(rank AS BIGINT) AS rank FROM (
      SELECT *, row_number() OVER (ORDER BY bucket, CASE WHEN kind = 'extra_on_target' THEN 1 ELSE 0 END, pk) AS rank
      FROM found) WHERE rank <= 20""",
)
def reconcile_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Top-20 report of differing rows; the whole list is ``reconcile_drill``."""
    return R.examples(R.drill(orders_pair(spark, folder), portable=True)).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "reconcile_multiset",
    f"""WITH {_LINEITEM_TARGET}, u AS (
      SELECT {_LCOLS}, l_partkey, l_returnflag, 1 AS n FROM lineitem
      UNION ALL SELECT {_LCOLS}, l_partkey, l_returnflag, -1 FROM lineitem_t),
    g AS (SELECT {_LCOLS}, l_partkey, l_returnflag, sum(n) AS surplus FROM u GROUP BY ALL HAVING sum(n) <> 0)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus,
      CASE WHEN surplus > 0 THEN 'missing_on_target' ELSE 'extra_on_target' END AS kind,
      CAST(abs(surplus) AS BIGINT) AS copies FROM g""",
)
def reconcile_multiset(spark: SparkSession, folder: str) -> DataFrame:
    return R.multiset_diff(lineitem_pair(spark, folder)).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "kind", "copies"
    )


@query(
    "count_convergence",
    f"""WITH {_ORDERS_TARGET}, {_LINEITEM_TARGET}, c AS (
      SELECT 'orders' AS "table", (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM orders_t) AS target_rows
      UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM lineitem_t)
      UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer))
    SELECT *, source_rows = target_rows AS converged, bool_and(source_rows = target_rows) OVER () AS all_converged FROM c""",
)
def count_convergence(spark: SparkSession, folder: str) -> DataFrame:
    return R.count_convergence([f(spark, folder) for f in (orders_pair, lineitem_pair, customer_pair)])


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger lines of every written order: padded ids, and a blank line after each."""
    ids = load(spark, folder, "orders").select(
        F.explode(F.array(F.concat(F.lit("  "), F.col("o_orderkey").cast("string"), F.lit(" ")), F.lit("  "))).alias("value")
    )
    return parse_ledger(ids)


@query(
    "ledger_missing",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % {LOST} = 0""",
)
def ledger_missing(spark: SparkSession, folder: str) -> DataFrame:
    return R.ledger_missing(_ledger(spark, folder), orders_pair(spark, folder).target, "o_orderkey")


@query(
    "ledger_round_trip",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % {LOST} = 0""",
)
def ledger_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The same proof with the ledger appended to and read from text files."""
    path = shared_dir(spark, "ledger")
    append_ledger(load(spark, folder, "orders"), "o_orderkey", path)
    return R.ledger_missing(read_ledger(spark, path), orders_pair(spark, folder).target, "o_orderkey")


_D6 = "CAST(CAST({0} AS DECIMAL(38,6)) AS VARCHAR)"
_NUM = "sum", "min", "max"


def _profile_sql(name: str, relation: str, ints, doubles, texts, others) -> str:
    """Long-form profile in SQL, one SELECT per cell."""
    rows = [f"SELECT '{name}' AS \"table\", NULL AS \"column\", 'row_count' AS metric, CAST(count(*) AS VARCHAR) AS value FROM {relation}"]

    def cell(col: str, metric: str, expr: str) -> None:
        rows.append(f"SELECT '{name}', '{col}', '{metric}', {expr} FROM {relation}")

    for c in [*ints, *doubles, *texts, *others]:
        cell(c, "non_null", f"CAST(count({c}) AS VARCHAR)")
    for c in ints:
        for m in _NUM:
            cell(c, m, f"CAST({m}({c}) AS VARCHAR)")
    for c in doubles:
        cell(c, "sum", f"CAST(sum(CAST({c} AS DECIMAL(38,6))) AS VARCHAR)")
        for m in ("min", "max"):
            cell(c, m, _D6.format(f"{m}({c})"))
        plain = f"((abs({c}) < 9e12 AND round({c} * 1e6) / 1e6 = {c}) OR abs({c}) BETWEEN 9e12 AND 1e20)"
        cell(c, "rest", f"CASE WHEN count({c}) FILTER (WHERE NOT {plain}) = 0 THEN '0:0' END")
    for c in texts:
        cell(c, "char_len_sum", f"CAST(sum(length({c})) AS VARCHAR)")
    return " UNION ALL ".join(rows)


_LINE_CLASSES = (
    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
    ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    ["l_returnflag", "l_linestatus"],
    ["l_shipdate"],
)


@query(
    "table_profile",
    _profile_sql("lineitem", "lineitem", *_LINE_CLASSES)
    + " UNION ALL "
    + _profile_sql("documents", "documents", ["doc_id", "n_chars"], [], ["text", "lang", "source"], []),
)
def profile(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        table_profile(load(spark, folder, t)).withColumn("table", F.lit(t)) for t in ("lineitem", "documents")
    ]
    return parts[0].unionByName(parts[1]).select("table", "column", "metric", "value")


_OC = (["o_orderkey", "o_custkey"], ["o_totalprice"], ["o_orderstatus", "o_orderpriority"], ["o_orderdate"])


_EXTREMES = Derived(
    "extremes",
    "orders",
    {
        "o_orderkey": "o_orderkey",
        "tiny": "o_orderkey * CAST(1e-9 AS DOUBLE)",
        "huge": "CAST(o_orderkey AS DOUBLE) * CAST(1e31 AS DOUBLE)",
        "odd": "CASE o_orderkey % 4 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) WHEN 2 THEN CAST('-Infinity' AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END",
        "fine": "CAST(CAST(o_orderkey AS DECIMAL(11,0)) / 100000000 AS DECIMAL(20,8))",
        "wide": "CAST(o_orderkey AS DECIMAL(38,0)) * CAST(10000000000000000000000000 AS DECIMAL(26,0))",
    },
)


@query(
    "profile_extremes",
    with_ctes(_EXTREMES)
    + """, m AS (SELECT min(o_orderkey) AS k FROM orders),
    t AS (SELECT o_orderkey, tiny + CAST(1e-9 AS DOUBLE) AS tiny, huge + CAST(1e31 AS DOUBLE) AS huge, CASE WHEN odd = 0.5 THEN 0.25 ELSE 0.5 END AS odd,
      fine + CAST(0.00000001 AS DECIMAL(9,8)) AS fine, wide + 1 AS wide FROM extremes, m WHERE o_orderkey = k),
    d AS (SELECT s.o_orderkey IS DISTINCT FROM t.o_orderkey AS o_orderkey, s.tiny IS DISTINCT FROM t.tiny AS tiny, s.huge IS DISTINCT FROM t.huge AS huge,
      s.odd IS DISTINCT FROM t.odd AS odd, s.fine IS DISTINCT FROM t.fine AS fine, s.wide IS DISTINCT FROM t.wide AS wide FROM extremes s JOIN t USING (o_orderkey))
    UNPIVOT d ON o_orderkey, tiny, huge, odd, fine, wide INTO NAME "column" VALUE differs""",
)
def profile_extremes(spark: SparkSession, folder: str) -> DataFrame:
    """One row's value changes in each column, far below, above or outside what six decimals hold."""
    rows = _EXTREMES.df(spark, folder)
    first = load(spark, folder, "orders").agg(F.min("o_orderkey").alias("k")).scalar()
    hit = F.col("o_orderkey") == first
    swapped = {"tiny": F.col("tiny") + 1e-9, "huge": F.col("huge") + 1e31, "odd": F.when(F.col("odd") == 0.5, F.lit(0.25)).otherwise(F.lit(0.5))}
    swapped |= {"fine": F.col("fine") + F.expr("CAST(0.00000001 AS DECIMAL(9,8))"), "wide": F.col("wide") + 1}
    target = rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)).cast(rows.schema[c].dataType) for c, v in swapped.items()})
    found = diff_profiles(table_profile(rows), table_profile(target)).select("column").distinct().withColumn("d", F.lit(True))
    names = table_profile(rows).filter("column IS NOT NULL").select("column").distinct()
    return names.join(found, "column", "left").select("column", F.coalesce("d", F.lit(False)).alias("differs"))


@query(
    "profile_diff",
    f"""WITH {_ORDERS_TARGET}, s AS ({_profile_sql("orders", "orders", *_OC)}), t AS ({_profile_sql("orders", "orders_t", *_OC)})
    SELECT CASE WHEN s.metric = 'row_count' THEN 'row_count' ELSE 'column_metric' END AS kind, s."column", s.metric,
      s.value AS source, t.value AS target, CAST(NULL AS VARCHAR) AS side
    FROM s JOIN t ON s.metric = t.metric AND s."column" IS NOT DISTINCT FROM t."column"
    WHERE s.value IS DISTINCT FROM t.value
    UNION ALL SELECT 'column_missing', 'o_comment', NULL, NULL, NULL, 'source'""",
)
def profile_diff(spark: SparkSession, folder: str) -> DataFrame:
    pair = orders_pair(spark, folder)
    target = pair.target.withColumn("o_comment", F.col("o_orderpriority"))
    return diff_profiles(table_profile(pair.source), table_profile(target))


@query(
    "profile_report",
    f"""WITH {_ORDERS_TARGET}, s AS ({_profile_sql("orders", "orders", *_OC)}), t AS ({_profile_sql("orders", "orders_t", *_OC)})
    SELECT 'orders' AS "table", (SELECT value FROM s WHERE metric = 'row_count') AS source_rows,
      (SELECT value FROM t WHERE metric = 'row_count') AS target_rows, count(*) AS mismatches, count(*) = 0 AS match
    FROM s JOIN t ON s.metric = t.metric AND s."column" IS NOT DISTINCT FROM t."column" WHERE s.value IS DISTINCT FROM t.value""",
)
def profile_summary(spark: SparkSession, folder: str) -> DataFrame:
    pair = orders_pair(spark, folder)
    return profile_report("orders", pair.source, pair.target).drop("caveat")


@query(
    "table_sizes",
    """SELECT 'documents' AS "table", count(*) AS rows, CAST(sum(strlen(text) + strlen(lang) + strlen(source)) AS BIGINT) AS payload_bytes FROM documents
    UNION ALL SELECT 'orders', count(*), CAST(sum(strlen(o_orderstatus) + strlen(o_orderpriority)) AS BIGINT) FROM orders""",
)
def sizes(spark: SparkSession, folder: str) -> DataFrame:
    parts = [table_sizes(load(spark, folder, t)).withColumn("table", F.lit(t)) for t in ("documents", "orders")]
    return parts[0].unionByName(parts[1])


@query(
    "orphan_rows",
    f"""WITH {_ORDERS_TARGET} SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem
    WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders_t)""",
)
def orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose order did not arrive on the target."""
    pair = orders_pair(spark, folder)
    lines = load(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return orphan_rows(lines, pair.target, {"l_orderkey": "o_orderkey"})


@query(
    "report_sink",
    f"""WITH {_BUCKETS} SELECT b, source_rows, target_rows, CAST(source_sum AS VARCHAR) AS source_sum,
      CAST(target_sum AS VARCHAR) AS target_sum, {_MATCH} AS match FROM buckets""",
)
def report_sink(spark: SparkSession, folder: str) -> DataFrame:
    """The bucket report as JSON lines, read back with its schema."""
    report = R.bucket_report(orders_pair(spark, folder), portable=True)
    path = write_report(report, shared_dir(spark, "report"))
    out = read_report(spark, path, report.schema)
    return out.withColumns({c: F.col(c).cast("string") for c in ("source_sum", "target_sum")})
