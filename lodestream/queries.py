"""Registered queries for the table and geometry kernels, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from lodestream.operators import coverage as V
from lodestream.operators import crs as C
from lodestream.operators import fuzzy as Y
from lodestream.operators import geo as G
from lodestream.operators import hull as H
from lodestream.operators import linework as L
from lodestream.operators import neighbours as N
from lodestream.operators import outlines as U
from lodestream.operators import overlay as O
from lodestream.operators import shapes as P
from lodestream.operators import spatial as S
from lodestream.operators import table as T

QUERIES: dict = {}
ORACLE: dict = {}


def kernel(sql: str | None = None):
    """Registers f(t), where t(name) reads a table, under the function's name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def simple(name: str, table: str, sql: str | None, f) -> None:
    """A one-table query."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))

    QUERIES[name] = run
    if sql:
        ORACLE[name] = sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by flag and status of ``lineitem``."""
    return QUERIES["table_aggregate"](spark, sf_dir)


c, lit = F.col, F.lit
#: A column with nulls by rule.
_NULLED = "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END"


def _nulled(df: DataFrame) -> DataFrame:
    return df.withColumn("seg", F.expr(_NULLED))


simple("table_select_columns", "customer", "SELECT c_name, c_custkey FROM customer", lambda d: T.select_columns(d, ["c_name", "c_custkey"]))
simple("table_drop_columns", "customer", "SELECT * EXCLUDE (c_name) FROM customer", lambda d: T.drop_columns(d, ["c_name"]))
simple("table_rename", "nation", "SELECT n_nationkey AS id, n_name AS name, n_regionkey FROM nation", lambda d: T.rename(d, {"n_nationkey": "id", "n_name": "name"}))
simple("table_reorder_columns", "nation", "SELECT n_name, n_nationkey, n_regionkey FROM nation", lambda d: T.reorder_columns(d, ["n_name"]))
simple("table_add_row_number", "orders", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders", lambda d: T.add_row_number(d, "rn", ["o_orderkey"]).select("o_orderkey", "rn"))
simple("table_concat_columns", "customer", "SELECT c_custkey, concat_ws('|', CAST(c_custkey AS VARCHAR), c_name, c_mktsegment) AS joined FROM customer", lambda d: T.concat_columns(d, ["c_custkey", "c_name", "c_mktsegment"], "joined", "|").select("c_custkey", "joined"))
simple("table_split_column_merge", "orders", "SELECT o_orderkey, string_split(o_orderpriority, '-')[1] AS a, CASE WHEN contains(o_orderpriority, '-') THEN substr(o_orderpriority, strpos(o_orderpriority, '-') + 1) END AS b FROM orders", lambda d: T.split_column(d, "o_orderpriority", "-", ["a", "b"], extra="merge").select("o_orderkey", "a", "b"))
simple("table_split_column", "customer", "SELECT c_custkey, string_split(c_name, '#')[1] AS a, string_split(c_name, '#')[2] AS b, string_split(c_name, '#')[3] AS z FROM customer", lambda d: T.split_column(d, "c_name", "#", ["a", "b", "z"]).select("c_custkey", "a", "b", "z"))
simple("table_coalesce", "customer", f"SELECT c_custkey, coalesce({_NULLED}, c_name) AS v FROM customer", lambda d: T.coalesce(_nulled(d), ["seg", "c_name"], "v").select("c_custkey", "v"))
simple("table_conditional", "customer", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS band FROM customer", lambda d: T.conditional(d, [(c("c_acctbal") < 0, "debt"), (c("c_acctbal") < 1000, "low")], "high", "band").select("c_custkey", "band"))
simple("table_formula", "lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem", lambda d: T.formula(d, "net", c("l_extendedprice") * (1 - c("l_discount"))).select("l_orderkey", "l_linenumber", "net"))
simple("table_expression", "part", "SELECT p_partkey, p_size * 2 AS dbl, upper(p_brand) AS brand, p_size > 25 AS big FROM part", lambda d: T.expression(d, {"dbl": c("p_size") * 2, "brand": F.upper("p_brand"), "big": c("p_size") > 25}).select("p_partkey", "dbl", "brand", "big"))
simple("table_type_cast", "customer", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, TRY_CAST(c_name AS BIGINT) AS c_name FROM customer", lambda d: T.type_cast(d, {"c_custkey": "string", "c_name": "bigint"}, "null").select("c_custkey", "c_name"))
simple("table_align_schema", "nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(NULL AS DOUBLE) AS area FROM nation", lambda d: T.align_schema(d, StructType([StructField("n_nationkey", LongType()), StructField("n_name", StringType()), StructField("area", DoubleType())])))
simple("table_filter", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R'", lambda d: T.filter(d, (c("l_quantity") > 30) & (c("l_returnflag") == "R")).select("l_orderkey", "l_linenumber"))
simple("table_sort", "customer", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey", lambda d: T.sort(d, [("c_acctbal", "desc"), "c_custkey"]).select("c_custkey", "c_acctbal"))
simple("table_limit", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 10", lambda d: T.limit(T.sort(d, ["o_orderkey"]).select("o_orderkey"), 50, 10))
simple("table_top_n_ties", "lineitem", "SELECT l_orderkey, l_quantity, l_discount FROM lineitem QUALIFY rank() OVER (ORDER BY l_quantity DESC, l_discount) <= 100", lambda d: T.top_n(d, 100, [("l_quantity", "desc"), "l_discount"], ties="rank").select("l_orderkey", "l_quantity", "l_discount"))
simple("table_top_n_dense", "lineitem", "SELECT l_orderkey, l_quantity FROM lineitem QUALIFY dense_rank() OVER (ORDER BY l_quantity DESC) <= 3", lambda d: T.top_n(d, 3, [("l_quantity", "desc")], ties="dense").select("l_orderkey", "l_quantity"))
simple("table_top_n", "orders", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3", lambda d: T.top_n(d, 3, [("o_totalprice", "desc"), "o_orderkey"], ["o_custkey"]).select("o_custkey", "o_orderkey", "o_totalprice"))
simple("table_sample", "orders", "SELECT o_orderkey FROM orders WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '-7'), 1, 8) AS BIGINT) < 429496729", lambda d: T.sample(d, 0.1, 7, "o_orderkey").select("o_orderkey"))


@kernel("SELECT n_nationkey AS k, c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def table_join(t):
    return T.join(t("customer").withColumnRenamed("c_nationkey", "k"), t("nation").withColumnRenamed("n_nationkey", "k"), "k").select("k", "c_custkey", "n_name")


@kernel("SELECT r_name, n_name FROM region CROSS JOIN nation")
def table_cross_join(t):
    return T.cross_join(t("region").select("r_name"), t("nation").select("n_name"))


#: Not every customer has an urgent order.
_URGENT = "SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'"


def _urgent(t):
    return t("orders").where("o_orderpriority = '1-URGENT'").select(c("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")


@kernel(f"SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM ({_URGENT}))")
def table_semi_join(t):
    return T.semi_join(t("customer"), _urgent(t), "c_custkey").select("c_custkey")


@kernel(f"SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM ({_URGENT}) WHERE o_custkey = c_custkey)")
def table_anti_join(t):
    return T.anti_join(t("customer"), _urgent(t), "c_custkey").select("c_custkey")


@kernel(f"SELECT c_custkey, coalesce(v, -1.0) AS o_totalprice FROM customer LEFT JOIN (SELECT o_custkey, min_by(o_totalprice, o_orderkey) AS v FROM ({_URGENT}) GROUP BY 1) ON o_custkey = c_custkey")
def table_lookup(t):
    return T.lookup(t("customer").select("c_custkey"), _urgent(t), "c_custkey", ["o_totalprice"], -1.0, "o_orderkey")


@kernel("SELECT c_custkey, o_totalprice, o_orderstatus FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_custkey % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_totalprice) = 1) ON o_custkey = c_custkey")
def table_lookup_whole_rows(t):
    orders = t("orders").where("o_custkey % 5 <> 0").withColumnRenamed("o_custkey", "c_custkey")
    return T.lookup(t("customer").select("c_custkey"), orders, "c_custkey", ["o_orderstatus", "o_totalprice"]).select("c_custkey", "o_totalprice", "o_orderstatus")


@kernel("SELECT l.event_id, l.user_id, r.value AS price, r.ts AS pts_matched FROM (SELECT * FROM events WHERE event_type = 'view') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND l.ts >= r.ts")
def table_asof_join(t):
    e = t("events")
    left, right = e.where("event_type = 'view'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", c("ts").alias("pts"), c("value").alias("price"))
    return T.asof_join(left, right, "ts", "pts", ["user_id"], ["price"]).select("event_id", "user_id", "price", "pts_matched")


@kernel("SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS distance FROM nation a JOIN nation b ON levenshtein(a.n_name, b.n_name) <= 3")
def table_fuzzy_join(t):
    n = t("nation")
    return T.fuzzy_join(n.select(c("n_name").alias("a")), n.select(c("n_name").alias("b")), "a", "b", 3).withColumn("distance", c("distance").cast("long"))


# words and letters of part names: each name with its like, and with its two likest
_NAMES = "SELECT DISTINCT p_name AS a, list_distinct(regexp_extract_all(lower(p_name), '[a-z]+')) AS s FROM part"
_GRAMS = "SELECT DISTINCT s_name AS a, list_distinct([s_name[k : k + 2] FOR k IN range(1, len(s_name) - 1)]) AS s FROM supplier"
_LIKE = "SELECT x.a, y.a AS b, len(list_intersect(x.s, y.s))::DOUBLE / len(list_distinct(x.s || y.s)) AS similarity FROM n x, n y"


@kernel(f"WITH n AS ({_NAMES}), p AS ({_LIKE}) SELECT p_partkey, b, round(similarity, 6) AS similarity FROM p JOIN part ON p_name = a WHERE similarity >= 0.3")
def table_fuzzy_join_jaccard(t):
    n = t("part").select("p_partkey", c("p_name").alias("a"))
    return Y.similar_sets(n, n.select(c("a").alias("b")).distinct(), "a", "b", 0.3).select("p_partkey", "b", F.round("similarity", 6).alias("similarity"))


@kernel(f"WITH n AS ({_GRAMS}), p AS ({_LIKE}) SELECT a, b, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.7 QUALIFY row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) <= 3")
def table_fuzzy_join_nearest_grams(t):
    n = t("supplier").select(c("s_name").alias("a")).distinct()
    return Y.similar_sets(n, n.select(c("a").alias("b")), "a", "b", 0.7, tokens=Y.grams(3), k=3).select("a", "b", F.round("similarity", 6).alias("similarity"))


@kernel("SELECT x.p_name AS a, y.p_name AS b, round(jaro_winkler_similarity(x.p_name, y.p_name), 6) AS similarity FROM (SELECT DISTINCT p_name FROM part) x, (SELECT DISTINCT p_name FROM part) y WHERE split_part(x.p_name, ' ', 1) = split_part(y.p_name, ' ', 1) AND jaro_winkler_similarity(x.p_name, y.p_name) >= 0.85")
def table_fuzzy_join_jaro_winkler(t):
    n = t("part").select(c("p_name").alias("a")).distinct()
    return Y.jaro_winkler_join(n, n.select(c("a").alias("b")), "a", "b", 0.85, block=lambda v: F.split_part(v, lit(" "), lit(1))).select("a", "b", F.round("similarity", 6).alias("similarity"))


simple("table_aggregate", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT l_suppkey) AS suppliers, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY ALL",
       lambda d: T.aggregate(d, ["l_returnflag", "l_linestatus"], [("count", lit(1), "n"), ("sum", c("l_extendedprice") * (1 - c("l_discount")), "revenue"), ("count_distinct", "l_suppkey", "suppliers"), ("min", "l_quantity", "lo"), ("max", "l_quantity", "hi")]).withColumn("revenue", F.round("revenue", 2)))
_STAT = "SELECT '{0}' AS \"column\", count({0}) AS count, CAST(count(*) - count({0}) AS BIGINT) AS nulls, CAST(min({0}) AS DOUBLE) AS min, CAST(max({0}) AS DOUBLE) AS max, round(avg({0}), 4) AS mean, round(stddev_samp({0}), 4) AS std FROM lineitem"
simple("table_statistics", "lineitem", " UNION ALL ".join(_STAT.format(x) for x in ("l_quantity", "l_discount", "l_tax")), lambda d: T.statistics(d, ["l_quantity", "l_discount", "l_tax"]).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)}))
simple("table_bin", "part", "SELECT p_partkey, CASE WHEN p_size >= 1 AND p_size < 10 THEN 0 WHEN p_size >= 10 AND p_size < 30 THEN 1 WHEN p_size >= 30 AND p_size < 45 THEN 2 END AS bin FROM part", lambda d: T.bin(d, "p_size", [1, 10, 30, 45], "bin").select("p_partkey", "bin"))
simple("table_pivot", "orders", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1", lambda d: T.pivot(d, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], F.count(lit(1))).fillna(0))
#: A later state of the customers: debtors are gone, one segment got a bonus, another has branches under new keys.
_CHANGED = "SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT -c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'MACHINERY'"
_CUST = "SELECT c_custkey, c_name, c_acctbal FROM customer"
_DIFF = f"SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'left_only' WHEN a.c_custkey IS NULL THEN 'right_only' WHEN a.c_acctbal = b.c_acctbal THEN 'matched' ELSE 'changed' END AS status FROM ({_CUST}) a FULL JOIN ({_CHANGED}) b ON a.c_custkey = b.c_custkey"


def _two(t):
    d = t("customer")
    changed = d.where("c_acctbal >= 0").withColumn("c_acctbal", F.when(c("c_mktsegment") == "BUILDING", c("c_acctbal") + lit(1.0)).otherwise(c("c_acctbal")))
    branches = d.where("c_mktsegment = 'MACHINERY'").withColumn("c_custkey", -c("c_custkey"))
    return d.select("c_custkey", "c_name", "c_acctbal"), changed.union(branches).select("c_custkey", "c_name", "c_acctbal")


@kernel(f"SELECT status, count(*) AS n FROM ({_DIFF}) GROUP BY 1")
def table_reconcile(t):
    return T.reconcile(*_two(t), ["c_custkey"], ["c_name", "c_acctbal"])


@kernel(f"SELECT c_custkey, status, CASE WHEN status = 'changed' THEN 'c_acctbal' END AS changed_columns FROM ({_DIFF})")
def table_table_diff(t):
    return T.table_diff(*_two(t), ["c_custkey"], ["c_name", "c_acctbal"])


simple("table_window_function", "orders", "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders", lambda d: T.window_function(d, F.lag("o_totalprice"), "prev", ["o_custkey"], ["o_orderkey"]).select("o_orderkey", "prev"))
simple("table_rolling_window", "orders", "SELECT o_orderkey, CASE WHEN count(o_totalprice) OVER w >= 2 THEN max(o_totalprice) OVER w END AS top FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", lambda d: T.rolling_window(d, "o_totalprice", "max", 3, "top", ["o_custkey"], ["o_orderkey"], 2).select("o_orderkey", "top"))


@kernel(f"{_CUST} UNION ALL ({_CHANGED})")
def table_concat(t):
    return T.concat(_two(t))


@kernel("SELECT c_custkey, c_name, c_acctbal, CAST(NULL AS VARCHAR) AS tag FROM customer UNION ALL SELECT s_suppkey, CAST(NULL AS VARCHAR), s_acctbal, 's' FROM supplier")
def table_concat_by_name(t):
    return T.concat_by_name([_two(t)[0], t("supplier").select(c("s_suppkey").alias("c_custkey"), c("s_acctbal").alias("c_acctbal"), lit("s").alias("tag"))])


@kernel(f"{_CUST} UNION ({_CHANGED})")
def table_union_distinct(t):
    return T.union_distinct(_two(t))


@kernel(f"{_CUST} INTERSECT ({_CHANGED})")
def table_intersect(t):
    return T.intersect(*_two(t))


@kernel(f"{_CUST} EXCEPT ({_CHANGED})")
def table_except(t):
    return T.except_(*_two(t))


simple("table_distinct", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", lambda d: T.distinct(d, ["l_returnflag", "l_linestatus"]))
simple("table_dedup_advanced_last_descending", "orders", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey DESC) = 1", lambda d: T.dedup_advanced(d, ["o_custkey"], [("o_totalprice", "desc"), "o_orderkey"], "last").select("o_custkey", "o_orderkey"))
simple("table_dedup_advanced_flagged", "orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 AS is_duplicate FROM orders", lambda d: T.dedup_advanced(d, ["o_custkey"], ["o_orderkey"], "all_flagged").select("o_orderkey", "is_duplicate"))
simple("table_dedup_advanced", "orders", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1", lambda d: T.dedup_advanced(d, ["o_custkey"], ["o_orderkey"], "last").select("o_custkey", "o_orderkey"))
simple("table_melt", "part", "SELECT p_partkey, 'p_brand' AS variable, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part", lambda d: T.melt(d, ["p_partkey"], ["p_brand", "p_type"]))
simple("table_transpose", "region", "SELECT 'r_regionkey' AS key, " + ", ".join(f"max(CASE WHEN r_regionkey = {k} THEN r_regionkey END) AS r{k}" for k in range(5)) + " FROM region", lambda d: T.transpose(d.select(F.concat(lit("r"), c("r_regionkey").cast("string")).alias("name"), "r_regionkey"), "name"))
simple("table_explode", "embeddings", "SELECT vec_id, unnest(embedding) AS x FROM embeddings", lambda d: T.explode(d.select("vec_id", "embedding"), "embedding", "x"))
simple("table_unnest", "events", "SELECT event_id, user_id AS s_user_id, value AS s_value FROM events", lambda d: T.unnest(d.select("event_id", F.struct("user_id", "value").alias("s")), "s", "s_"))
simple("table_flatten_json", "events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS p_k FROM events", lambda d: T.flatten_json(d.select("event_id", "props"), "props", "k bigint", "p_"))
simple("table_string_extract", "part", "SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '([0-9])') THEN regexp_extract(p_brand, '([0-9])', 1) END AS d FROM part", lambda d: T.string_extract(d, "p_brand", "([0-9])", 1, "d").select("p_partkey", "d"))
simple("table_string_length", "documents", "SELECT doc_id, CAST(length(text) AS INT) AS n FROM documents", lambda d: T.string_length(d, "text", "n").select("doc_id", "n"))
simple("table_string_pad", "nation", "SELECT n_nationkey, CASE WHEN length(n_name) < 10 THEN lpad(n_name, 10, '*') ELSE n_name END AS n_name FROM nation", lambda d: T.string_pad(d, "n_name", 10, "*").select("n_nationkey", "n_name"))
simple("table_text_normalize_strip_punct", "documents", r"SELECT doc_id, regexp_replace(text, '[\p{P}\p{S}]', '', 'g') AS text FROM documents", lambda d: T.text_normalize(d, "text", ["strip_punct"]).select("doc_id", "text"))
simple("table_text_normalize_forms", "documents", "SELECT doc_id, strip_accents(nfc_normalize(text)) AS text FROM documents", lambda d: T.text_normalize(d, "text", ["nfc", "strip_accents"]).select("doc_id", "text"))
simple("table_text_normalize", "pages", r"SELECT page_id, regexp_replace(lower(trim(html)), '\s+', ' ', 'g') AS html FROM pages", lambda d: T.text_normalize(d, "html", ["trim", "lower", "collapse_ws"]).select("page_id", "html"))
simple("table_replace", "orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders", lambda d: T.replace(d, "o_orderstatus", {"F": "done", "O": "open"}).select("o_orderkey", "o_orderstatus"))
simple("table_date_extract", "orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS o_orderdate_year, CAST(quarter(o_orderdate) AS INT) AS o_orderdate_quarter, CAST(week(o_orderdate) AS INT) AS o_orderdate_week, CAST(isodow(o_orderdate) AS INT) AS o_orderdate_dow FROM orders", lambda d: T.date_extract(d, "o_orderdate", ["year", "quarter", "week", "dow"]).select("o_orderkey", "o_orderdate_year", "o_orderdate_quarter", "o_orderdate_week", "o_orderdate_dow"))
simple("table_date_add", "orders", "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS due FROM orders", lambda d: T.date_add(d, "o_orderdate", 1, "month", "due").select("o_orderkey", "due"))
simple("table_date_diff", "orders", "SELECT o_orderkey, date_sub('day', o_orderdate, TIMESTAMP '2000-01-01') AS days FROM orders", lambda d: T.date_diff(d.withColumn("e", F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'")), "o_orderdate", "e", "day", "days").select("o_orderkey", "days"))
simple("table_date_format", "orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS day FROM orders", lambda d: T.date_format(d, "o_orderdate", "yyyy/MM/dd", "day").select("o_orderkey", "day"))
simple("table_timezone_convert", "events", "SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS local FROM events", lambda d: T.timezone_convert(d, "ts", "UTC", "America/New_York", "local").select("event_id", "local"))
simple("table_fill_na", "customer", f"SELECT c_custkey, coalesce({_NULLED}, 'none') AS seg FROM customer", lambda d: T.fill_na(_nulled(d), {"seg": "none"}).select("c_custkey", "seg"))
simple("table_md5_hash", "customer", "SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR) || chr(31) || c_name) AS h FROM customer", lambda d: T.md5_hash(d, ["c_custkey", "c_name"], "h").select("c_custkey", "h"))
simple("table_sha256_hash", "customer", f"SELECT c_custkey, sha256(c_name || chr(31) || coalesce({_NULLED}, '\\N')) AS h FROM customer", lambda d: T.sha256_hash(_nulled(d), ["c_name", "seg"], "h").select("c_custkey", "h"))
_PADS = tuple(bytes(b ^ pad for b in b"key".ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
simple("table_hmac_sha256", "customer", f"SELECT c_custkey, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(c_name)))) AS h FROM customer", lambda d: T.hmac_sha256(d, ["c_name"], b"key", "h").select("c_custkey", "h"))
_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', h[17]), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"
simple("table_uuid_generator", "customer", f"SELECT c_custkey, {_UUID} AS id FROM (SELECT c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(c_name)) AS h FROM customer)", lambda d: T.uuid_generator(d, "id", ["c_name"]).select("c_custkey", "id"))
simple("table_mask_data", "customer", "SELECT c_custkey, substr(c_name, 1, 2) || repeat('*', length(c_name) - 5) || right(c_name, 3) AS c_name FROM customer", lambda d: T.mask_data(d, "c_name", 2, 3).select("c_custkey", "c_name"))
_ENCODED = " || ".join(f"'{t}:' || strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) || ';'" for x, t in (("c_custkey", "bigint"), ("c_name", "string")))
simple("table_stable_fingerprint", "customer", f"SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(sha256({_ENCODED}), 1, 15) AS HUGEINT)) AS VARCHAR) AS fingerprint FROM customer", lambda d: T.stable_fingerprint(d, ["c_name", "c_custkey"]))
simple("table_assert_not_null", "customer", f"SELECT CAST(count(*) FILTER (({_NULLED}) IS NULL) AS BIGINT) AS violations, count(*) AS rows FROM customer", lambda d: T.assert_not_null(_nulled(d), ["seg"]))
simple("table_assert_range", "lineitem", "SELECT count(*) FILTER (NOT l_quantity BETWEEN 2 AND 40) AS violations, count(*) AS rows FROM lineitem", lambda d: T.assert_range(d, "l_quantity", 2, 40))
simple("table_assert_regex", "part", "SELECT count(*) FILTER (NOT regexp_full_match(p_brand, 'Brand#[1-3][0-9]*')) AS violations, count(*) AS rows FROM part", lambda d: T.assert_regex(d, "p_brand", "Brand#[1-3][0-9]*"))
simple("table_assert_unique", "lineitem", "SELECT count(*) AS repeated_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_of_repeated_keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)", lambda d: T.assert_unique(d, ["l_orderkey", "l_linenumber"]))
simple("table_assert_cardinality", "orders", "SELECT count(DISTINCT o_orderpriority) AS n, count(DISTINCT o_orderpriority) BETWEEN 1 AND 10 AS holds FROM orders", lambda d: T.assert_cardinality(d, ["o_orderpriority"], 1, 10))
simple("table_assert_schema", "region", "SELECT * FROM region", lambda d: T.assert_schema(d, {"r_name": StringType()}))
simple("table_assert_metadata", "region", "SELECT r_regionkey FROM region", lambda d: T.assert_metadata(d.select(c("r_regionkey").alias("r_regionkey", metadata={"field_id": "0"})), "r_regionkey", {"field_id": "0"}))
simple("table_validate_rules", "lineitem", "SELECT 'cheap' AS rule, count(*) FILTER (NOT l_discount <= 0.09) AS violations, count(*) FILTER (NOT l_discount <= 0.09) = 0 AS passed FROM lineitem UNION ALL SELECT 'positive', count(*) FILTER (NOT l_quantity > 0), count(*) FILTER (NOT l_quantity > 0) = 0 FROM lineitem", lambda d: T.validate_rules(d, {"cheap": c("l_discount") <= 0.09, "positive": c("l_quantity") > 0}))


@kernel(f"SELECT count(*) AS orphans FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM ({_URGENT}))")
def table_assert_foreign_key(t):
    return T.assert_foreign_key(t("customer"), _urgent(t), "c_custkey")


# --- geometry: rectangles and points by rule, so that plain arithmetic is the expected result
_X, _Y = "((c_custkey * 37) % 3600) / CAST(10 AS DOUBLE) - 180", "((c_custkey * 17) % 1700) / CAST(10 AS DOUBLE) - 85"
_RX, _RY = "((p_partkey * 37) % 3600) / CAST(10 AS DOUBLE) - 180", "((p_partkey * 17) % 1700) / CAST(10 AS DOUBLE) - 85"
_PTS = f"(SELECT c_custkey, {_X} AS x, {_Y} AS y FROM customer)"
_RECTS = f"(SELECT p_partkey, {_RX} AS x0, {_RY} AS y0, 1 + p_size % 10 AS w, 1 + p_partkey % 7 AS h FROM part)"


def _dealt(d: DataFrame, *columns: str) -> DataFrame:
    """Rows of few bytes and much work: a file of some MB is one task's input, so they are dealt to all cores."""
    return d.select(*columns).repartition(4 * d.sparkSession.sparkContext.defaultParallelism)


def _pts(d: DataFrame) -> DataFrame:
    return d.select("c_custkey", G.point(F.expr(_X), F.expr(_Y)).alias("p"))


def _rects(d: DataFrame) -> DataFrame:
    d = _dealt(d, "p_partkey", "p_size").select("p_partkey", F.expr(_RX).alias("x0"), F.expr(_RY).alias("y0"), (1 + c("p_size") % 10).alias("w"), (1 + c("p_partkey") % 7).alias("h"))
    return d.withColumn("ring", G.rectangle(c("x0"), c("y0"), c("x0") + c("w"), c("y0") + c("h")))


def _rect_query(name: str, sql: str, columns) -> None:
    simple(name, "part", f"SELECT p_partkey, {sql} FROM {_RECTS}", lambda d: _rects(d).select("p_partkey", *columns()))


simple("geo_from_coords", "customer", f"SELECT c_custkey, x, y FROM {_PTS}", lambda d: _pts(d).select("c_custkey", "p.x", "p.y"))
simple("geo_to_wkt", "region", "SELECT r_regionkey, 'POINT (' || CAST(CAST(r_regionkey AS DOUBLE) AS VARCHAR) || ' 0.5)' AS wkt FROM region", lambda d: d.select("r_regionkey", G.point_wkt(G.point("r_regionkey", lit(0.5))).alias("wkt")))
simple("geo_from_wkt", "customer", f"SELECT c_custkey, x, y FROM {_PTS}", lambda d: _pts(d).select("c_custkey", F.get(G.path_from_wkt(G.point_wkt(c("p"))), 0).alias("q")).select("c_custkey", "q.x", "q.y"))
_rect_query("geo_geometry_accessors", "5 AS num_points, true AS is_closed, x0 AS start_x", lambda: [G.accessors(c("ring"))["num_points"].alias("num_points"), G.accessors(c("ring"))["is_closed"].alias("is_closed"), G.accessors(c("ring"))["start_x"].alias("start_x")])


# shapes with holes and parts, by rule: a frame around a hole of half its sides for odd keys, and for every third key a second part, a square of 1 beside it
_HOLE = f"(SELECT *, p_partkey % 2 = 1 AS holed, p_partkey % 3 = 0 AS two FROM {_RECTS})"


def _wkt_ring(x0, y0, x1, y1):
    return F.concat(lit("("), F.array_join(F.array(*(F.concat_ws(" ", x.cast("string"), y.cast("string")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)))), ", "), lit(")"))


def _texts(d: DataFrame) -> DataFrame:
    """WKT of such shapes."""
    d = _rects(d).withColumns({"x1": c("x0") + c("w"), "y1": c("y0") + c("h")})
    hole = _wkt_ring(c("x0") + c("w") / 4, c("y0") + c("h") / 4, c("x0") + 3 * c("w") / 4, c("y0") + 3 * c("h") / 4)
    body = F.concat(lit("("), _wkt_ring(c("x0"), c("y0"), c("x1"), c("y1")), F.when(c("p_partkey") % 2 == 1, F.concat(lit(", "), hole)).otherwise(""), lit(")"))
    beside = F.concat(lit("("), _wkt_ring(c("x1") + 1, c("y0"), c("x1") + 2, c("y0") + 1), lit(")"))
    return d.withColumn("wkt", F.when(c("p_partkey") % 3 == 0, F.concat(lit("MULTIPOLYGON ("), body, lit(", "), beside, lit(")"))).otherwise(F.concat(lit("POLYGON "), body)))


def _holed(d: DataFrame) -> DataFrame:
    return _texts(d).select("p_partkey", P.from_wkt(c("wkt")).alias("shape"))


def _holed_query(name: str, sql: str, columns) -> None:
    simple(name, "part", f"SELECT p_partkey, {sql} FROM {_HOLE}", lambda d: _holed(d).select("p_partkey", *columns()))


_holed_query("geo_area_holes", "round(w * h * (CASE WHEN holed THEN 0.75 ELSE 1 END) + (CASE WHEN two THEN 1 ELSE 0 END), 6)::DOUBLE AS area", lambda: [F.round(P.area(c("shape")), 6).alias("area")])
_holed_query("geo_perimeter_holes", "round(2 * (w + h) * (CASE WHEN holed THEN 1.5 ELSE 1 END) + (CASE WHEN two THEN 4 ELSE 0 END), 6)::DOUBLE AS perimeter", lambda: [F.round(P.perimeter(c("shape")), 6).alias("perimeter")])
_holed_query("geo_geometry_accessors_parts", "CASE WHEN two THEN 'MULTIPOLYGON' ELSE 'POLYGON' END AS type, 2 AS dim, 5 + holed::INT * 5 + two::INT * 5 AS num_points, 1 + two::INT AS num_parts, holed::INT AS num_holes", lambda: [P.accessors(c("shape"))[k].alias(k) for k in ("type", "dim", "num_points", "num_parts", "num_holes")])
_holed_query("geo_boundary_holes", "CASE WHEN holed OR two THEN 'MULTILINESTRING' ELSE 'LINESTRING' END AS kind, round(2 * (w + h) * (CASE WHEN holed THEN 1.5 ELSE 1 END) + (CASE WHEN two THEN 4 ELSE 0 END), 6)::DOUBLE AS length", lambda: [P.boundary(c("shape"))["kind"].alias("kind"), F.round(P.length(P.boundary(c("shape"))), 6).alias("length")])
_holed_query("geo_predicate_contains_holes", "x0 <= 0 AND x0 + w >= 0 AND y0 <= 0 AND y0 + h >= 0 AND NOT (holed AND x0 + w / 4.0 < 0 AND x0 + 3 * w / 4.0 > 0 AND y0 + h / 4.0 < 0 AND y0 + 3 * h / 4.0 > 0) OR (two AND x0 + w + 1 <= 0 AND x0 + w + 2 >= 0 AND y0 <= 0 AND y0 + 1 >= 0) AS hit", lambda: [P.contains_point(c("shape"), G.point(lit(0.0), lit(0.0))).alias("hit")])
simple("geo_explode_parts", "part", f"SELECT p_partkey, k::INT AS k, round(CASE WHEN k = 1 THEN 1 ELSE w * h * (CASE WHEN holed THEN 0.75 ELSE 1 END) END, 6)::DOUBLE AS area FROM {_HOLE}, range(2) r(k) WHERE k = 0 OR two", lambda d: P.explode_parts(_holed(d), "shape", "part", "k").select("p_partkey", "k", F.round(P.area(c("part")), 6).alias("area")))
simple("geo_collect_parts", "part", f"SELECT p_size, CASE WHEN bool_or(two) THEN 'GEOMETRYCOLLECTION' ELSE 'MULTIPOLYGON' END AS kind, CAST(sum(1 + two::INT) AS INT) AS n FROM {_HOLE} JOIN (SELECT p_partkey, p_size FROM part) USING (p_partkey) GROUP BY 1", lambda d: P.collected(_holed(d).join(d.select("p_partkey", "p_size"), "p_partkey"), ["p_size"], "shape").select("p_size", c("shape.kind").alias("kind"), F.size(P.parts(c("shape"))).alias("n")))
# the text of every fifth key lacks its last parenthesis, that of every seventh is no geometry
_BROKEN = "CASE WHEN p_partkey % 5 = 0 THEN 'bad nesting' WHEN p_partkey % 7 = 0 THEN 'unknown kind' END"
simple("geo_from_wkt_reasons", "part", f"SELECT p_partkey, {_BROKEN} AS reason, CASE WHEN {_BROKEN} IS NULL THEN 1 + two::INT END AS parts FROM {_HOLE}", lambda d: _texts(d).withColumn("r", P.read_wkt(F.when(c("p_partkey") % 5 == 0, F.regexp_replace("wkt", r"\)\)$", ") )))")).when(c("p_partkey") % 7 == 0, lit("no shape")).otherwise(c("wkt")))).select("p_partkey", "r.reason", F.when(c("r.shape").isNotNull(), F.size(P.parts(c("r.shape")))).alias("parts")))
simple("geo_to_wkt_parts", "part", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'POINT Z (' || p_partkey || ' 0.5 ' || p_size || ')' WHEN 1 THEN 'MULTIPOINT ((' || p_partkey || ' 1), (2 ' || p_size || '))' WHEN 2 THEN 'POLYGON ((0 0, ' || p_size || ' 0, ' || p_size || ' 9.25, 0 0))' ELSE 'GEOMETRYCOLLECTION (POINT (' || p_partkey || ' 1), LINESTRING EMPTY)' END AS wkt FROM part", lambda d: d.select("p_partkey", P.to_wkt(P.from_wkt(F.expr("CASE p_partkey % 4 WHEN 0 THEN 'point z(' || p_partkey || '.0 .5 ' || p_size || ')' WHEN 1 THEN 'MULTIPOINT(' || p_partkey || ' 1,2 ' || p_size || ')' WHEN 2 THEN 'Polygon (( 0 0,' || p_size || '.00 0,' || p_size || ' 9.250, 0 0))' ELSE 'GEOMETRYCOLLECTION(POINT(' || p_partkey || ' 1),LINESTRING EMPTY)' END"))).alias("wkt")))

_rect_query("geo_bounds_extractor", "x0 AS minx, y0 AS miny, x0 + w AS maxx, y0 + h AS maxy", lambda: [*(G.bounds(c("ring"))[k].alias(k) for k in ("minx", "miny", "maxx", "maxy"))])
_rect_query("geo_envelope", "round(CAST(w * h AS DOUBLE), 6) AS area", lambda: [F.round(G.area(G.envelope(c("ring"))), 6).alias("area")])
_rect_query("geo_vertex_count", "CAST(2 * w + 2 * h + 1 AS INT) AS n", lambda: [G.vertex_count(G.densify(G.translate(c("ring"), -c("x0"), -c("y0")), 1.0)).alias("n")])
_rect_query("geo_area", "round(CAST(w * h AS DOUBLE), 6) AS area", lambda: [F.round(G.area(c("ring")), 6).alias("area")])
_rect_query("geo_perimeter", "round(CAST(2 * (w + h) AS DOUBLE), 6) AS perimeter", lambda: [F.round(G.perimeter(c("ring")), 6).alias("perimeter")])
_rect_query("geo_length", "round(CAST(w + h AS DOUBLE), 6) AS length", lambda: [F.round(G.length(F.slice(c("ring"), 1, 3)), 6).alias("length")])
_rect_query("geo_centroid", "round(x0 + w / 2.0, 4) AS x, round(y0 + h / 2.0, 4) AS y", lambda: [F.round(G.centroid(c("ring"))["x"], 4).alias("x"), F.round(G.centroid(c("ring"))["y"], 4).alias("y")])
_rect_query("geo_translate", "x0 + 1.5 AS x, y0 - 2.5 AS y", lambda: [F.get(G.translate(c("ring"), 1.5, -2.5), 0)["x"].alias("x"), F.get(G.translate(c("ring"), 1.5, -2.5), 0)["y"].alias("y")])
_rect_query("geo_scale", "round(CAST(w * h * 6 AS DOUBLE), 6) AS area", lambda: [F.round(G.area(G.scale(c("ring"), 2.0, 3.0)), 6).alias("area")])
_rect_query("geo_rotate", "round(-y0, 6) + 0.0 AS x, round(x0, 6) + 0.0 AS y", lambda: [(F.round(F.get(G.rotate(c("ring"), 90.0), 0)["x"], 6) + 0.0).alias("x"), (F.round(F.get(G.rotate(c("ring"), 90.0), 0)["y"], 6) + 0.0).alias("y")])
_rect_query("geo_affine_transform", "round(2 * x0 + y0 + 1, 6) AS x, round(3 * y0 - x0, 6) AS y", lambda: [F.round(F.get(G.affine_transform(c("ring"), 2.0, 1.0, -1.0, 3.0, 1.0, 0.0), 0)["x"], 6).alias("x"), F.round(F.get(G.affine_transform(c("ring"), 2.0, 1.0, -1.0, 3.0, 1.0, 0.0), 0)["y"], 6).alias("y")])
_rect_query("geo_snap_to_grid", "floor(x0 / 0.5 + 0.5) * 0.5 AS x, floor(y0 / 0.5 + 0.5) * 0.5 AS y", lambda: [F.get(G.snap_to_grid(c("ring"), 0.5), 0)["x"].alias("x"), F.get(G.snap_to_grid(c("ring"), 0.5), 0)["y"].alias("y")])
_rect_query("geo_densify", "CAST(2 * w + 2 * h + 1 AS INT) AS n", lambda: [F.size(G.densify(G.translate(c("ring"), -c("x0"), -c("y0")), 1.0)).alias("n")])
_rect_query("geo_line_interpolate_point", "round(x0 + least(w, 1.5), 6) AS x", lambda: [F.round(G.line_interpolate_point(F.slice(c("ring"), 1, 2), lit(1.5))["x"], 6).alias("x")])
_rect_query("geo_line_locate_point", "round(w / 2.0, 6) AS at", lambda: [F.round(G.line_locate_point(F.slice(c("ring"), 1, 2), G.point(c("x0") + c("w") / 2, c("y0") + 9.0)), 6).alias("at")])
_rect_query("geo_hausdorff_distance", "round(CAST(h AS DOUBLE), 6) AS d", lambda: [F.round(G.hausdorff_distance(F.slice(c("ring"), 1, 2), G.translate(F.slice(c("ring"), 1, 2), 0.0, c("h"))), 6).alias("d")])
_rect_query("geo_predicate_covers", "x0 + w / 2.0 <= 0 AND x0 + w >= 0 AND y0 <= 0 AND y0 + h >= 0 OR (x0 <= 0 AND x0 + w >= 0 AND y0 <= 0 AND y0 + h >= 0) AS hit", lambda: [G.covers_point(c("ring"), G.point(lit(0.0), lit(0.0))).alias("hit")])
_rect_query("geo_predicate_contains", "x0 < 5 AND x0 + w > 5 AND y0 < 5 AND y0 + h > 5 AS hit", lambda: [G.covers_point(c("ring"), G.point(lit(5.0), lit(5.0)), boundary=False).alias("hit")])
_rect_query("geo_predicate_within", "p_partkey % 9 + 0.5 <= h AS hit", lambda: [G.covers_point(c("ring"), G.point(c("x0") + c("w") / 2, c("y0") + c("p_partkey") % 9 + 0.5)).alias("hit")])
_PAIR = f"SELECT a.c_custkey, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM {_PTS} a JOIN {_PTS} b ON b.c_custkey = a.c_custkey + 1"


def _pairs(d: DataFrame) -> DataFrame:
    a = _pts(d)
    return a.join(a.select((c("c_custkey") - 1).alias("c_custkey"), c("p").alias("q")), "c_custkey")


def _ll() -> tuple:
    return c("p.x"), c("p.y"), c("q.x"), c("q.y")


simple("geo_distance", "customer", f"SELECT c_custkey, round(sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2), 6) AS d FROM ({_PAIR})", lambda d: _pairs(d).select("c_custkey", F.round(G.distance(c("p"), c("q")), 6).alias("d")))
simple("geo_haversine_distance", "customer", f"SELECT c_custkey, round(2 * 6371008.8 * asin(sqrt(least(1.0, sin(radians(y2 - y1) / 2) ** 2 + cos(radians(y1)) * cos(radians(y2)) * sin(radians(x2 - x1) / 2) ** 2))), 2) AS d FROM ({_PAIR})", lambda d: _pairs(d).select("c_custkey", F.round(G.haversine(*_ll()), 2).alias("d")))
simple("geo_bearing", "customer", f"SELECT c_custkey, round(fmod(degrees(atan2(sin(radians(x2 - x1)) * cos(radians(y2)), cos(radians(y1)) * sin(radians(y2)) - sin(radians(y1)) * cos(radians(y2)) * cos(radians(x2 - x1)))) + 360, 360), 5) AS b FROM ({_PAIR})", lambda d: _pairs(d).select("c_custkey", F.round(G.bearing(*_ll()), 5).alias("b")))
simple("geo_line_builder", "events", "SELECT user_id, CAST(count(*) AS INT) AS n FROM events GROUP BY 1 HAVING count(*) >= 2", lambda d: G.line_builder(d.withColumn("m", c("event_id") % 100), ["user_id"], "ts", "value", "m").where("path IS NOT NULL").select("user_id", F.size("path").alias("n")))
simple("geo_polygon_builder", "events", "SELECT user_id, CAST(count(*) + 1 AS INT) AS n FROM events GROUP BY 1 HAVING count(*) >= 3", lambda d: G.polygon_builder(d.withColumn("m", c("event_id") % 100), ["user_id"], "ts", "value", "m").where("ring IS NOT NULL").select("user_id", F.size("ring").alias("n")))
simple("geo_generate_grid", "part", f"SELECT col, row, 64.0::DOUBLE AS area FROM (SELECT unnest(range(floor(min(x0) / 8)::BIGINT, floor(max(x0 + w) / 8)::BIGINT + 1)) AS col FROM {_RECTS}), (SELECT unnest(range(floor(min(y0) / 8)::BIGINT, floor(max(y0 + h) / 8)::BIGINT + 1)) AS row FROM {_RECTS})", lambda d: G.grid_over(_rects(d), "ring", 8.0).select("col", "row", G.area(c("ring")).alias("area")))
_IN = "x BETWEEN x0 AND x0 + w AND y BETWEEN y0 AND y0 + h"


@kernel(f"SELECT p_partkey, count(x) AS n FROM {_RECTS} LEFT JOIN {_PTS} ON {_IN} GROUP BY 1")
def geo_count_points_in_polygons(t):
    return G.count_points_in_polygons(_rects(t("part")).select("p_partkey", "ring"), _pts(t("customer")), "p_partkey", "ring", "p", 5.0).select("p_partkey", "n")


@kernel(f"SELECT p_partkey, c_custkey FROM {_RECTS} JOIN {_PTS} ON {_IN}")
def geo_sjoin(t):
    return G.sjoin_points(_rects(t("part")).select("p_partkey", "ring"), _pts(t("customer")), "ring", "p", 5.0).select("p_partkey", "c_custkey")


_SUP = "(SELECT s_suppkey, ((s_suppkey * 37) % 3600) / CAST(10 AS DOUBLE) - 180 AS sx, ((s_suppkey * 17) % 1700) / CAST(10 AS DOUBLE) - 85 AS sy FROM supplier)"


@kernel(f"SELECT c_custkey, arg_min(s_suppkey, (d, s_suppkey)) AS s_suppkey, round(min(d), 6) AS distance FROM (SELECT c_custkey, s_suppkey, sqrt((x - sx) ** 2 + (y - sy) ** 2) AS d FROM {_PTS}, {_SUP}) WHERE d <= 20 GROUP BY 1")
def geo_nearest(t):
    s = t("supplier").select("s_suppkey", G.point(F.expr("((s_suppkey * 37) % 3600) / CAST(10 AS DOUBLE) - 180"), F.expr("((s_suppkey * 17) % 1700) / CAST(10 AS DOUBLE) - 85")).alias("q"))
    return G.nearest(_pts(t("customer")), s, "c_custkey", "s_suppkey", "p", "q", 20.0).withColumn("distance", F.round("distance", 6))


def _suppliers(t) -> DataFrame:
    return t("supplier").select("s_suppkey", G.point(F.expr("((s_suppkey * 37) % 3600) / CAST(10 AS DOUBLE) - 180"), F.expr("((s_suppkey * 17) % 1700) / CAST(10 AS DOUBLE) - 85")).alias("q"))


_NEAREST = f"SELECT c_custkey, s_suppkey, round(d, 6) AS distance, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) AS n FROM (SELECT c_custkey, s_suppkey, sqrt((x * 9 - sx) ** 2 + (y * 9 - sy) ** 2) AS d FROM {_PTS}, {_SUP}))"


def _outlying(t) -> DataFrame:
    """Customers far outside the suppliers' extent too."""
    return _pts(t("customer")).select("c_custkey", G.point(c("p.x") * 9, c("p.y") * 9).alias("p"))


@kernel(f"{_NEAREST} WHERE n <= 1")
def geo_nearest_unlimited(t):
    return N.nearest(_outlying(t), _suppliers(t), "c_custkey", "s_suppkey", "p", "q").withColumn("distance", F.round("distance", 6))


@kernel(f"{_NEAREST} WHERE n <= 4")
def geo_nearest_k(t):
    return N.nearest(_outlying(t), _suppliers(t), "c_custkey", "s_suppkey", "p", "q", 4).withColumn("distance", F.round("distance", 6))


# rectangles of parts against those of suppliers, 1 x 2: the gaps along both axes give the distance
_SRECTS = f"(SELECT s_suppkey, sx, sy FROM {_SUP})"
_GAP = "sqrt(greatest(x0 - sx - 1, sx - x0 - w, 0) ** 2 + greatest(y0 - sy - 2, sy - y0 - h, 0) ** 2)"
_GAPS = f"SELECT p_partkey, s_suppkey, round({_GAP}, 6) AS distance FROM {_RECTS} JOIN {_SRECTS} ON {_GAP} <= 3.05"


def _dwithin(t, how: str) -> DataFrame:
    boxes = _suppliers(t).select("s_suppkey", G.rectangle(c("q.x"), c("q.y"), c("q.x") + 1, c("q.y") + 2).alias("box"))
    return N.sjoin(_rects(t("part")).select("p_partkey", "ring"), boxes, "ring", "box", 8.0, within=3.05, how=how, key="p_partkey")


@kernel(_GAPS)
def geo_sjoin_dwithin(t):
    return _dwithin(t, "inner").select("p_partkey", "s_suppkey", F.round("distance", 6).alias("distance"))


@kernel(f"SELECT p_partkey, s_suppkey, distance FROM part LEFT JOIN ({_GAPS}) USING (p_partkey)")
def geo_sjoin_dwithin_left(t):
    return _dwithin(t, "left").select("p_partkey", "s_suppkey", F.round("distance", 6).alias("distance"))


@kernel(f"SELECT p_partkey FROM part SEMI JOIN ({_GAPS}) USING (p_partkey)")
def geo_sjoin_dwithin_semi(t):
    return _dwithin(t, "semi").select("p_partkey")


@kernel(f"SELECT p_partkey FROM part ANTI JOIN ({_GAPS}) USING (p_partkey)")
def geo_sjoin_dwithin_anti(t):
    return _dwithin(t, "anti").select("p_partkey")


@kernel(f"SELECT a.p_partkey, round(sqrt(greatest(a.x0 - b.x0 - b.w, b.x0 - a.x0 - a.w, 0) ** 2 + greatest(a.y0 - b.y0 - b.h, b.y0 - a.y0 - a.h, 0) ** 2), 6) AS d FROM {_RECTS} a JOIN {_RECTS} b ON b.p_partkey = a.p_partkey + 1")
def geo_distance_shapes(t):
    a = _rects(t("part")).select("p_partkey", "ring")
    both = a.join(a.select((c("p_partkey") - 1).alias("p_partkey"), c("ring").alias("other")), "p_partkey")
    return both.select("p_partkey", F.round(N.shape_distance(c("ring"), c("other")), 6).alias("d"))


def _square_ell(d: DataFrame) -> DataFrame:
    """The outline of an L in a square, with points a quarter of the square's side apart."""
    quarters = F.array(*(F.struct(lit(x).alias("x"), lit(y).alias("y")) for x, y in ((0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (4, 1), (4, 2), (3, 2), (2, 2), (2, 3), (2, 4), (1, 4), (0, 4), (0, 3), (0, 2), (0, 1))))
    return d.withColumn("points", F.transform(quarters, lambda q: G.point(c("x0") + q["x"] * c("w") / 4, c("y0") + q["y"] * c("w") / 4)))


simple("geo_concave_hull", "part", f"SELECT p_partkey, CAST(w * w * 0.75 AS DOUBLE) AS area, 17 AS points FROM {_RECTS}", lambda d: _square_ell(_rects(d)).withColumn("hull", H.concave_hull(c("points"), ratio=0.15)).select("p_partkey", F.round(G.area(c("hull")), 6).alias("area"), F.size("hull").alias("points")))
simple("geo_collect", "customer", "SELECT c_nationkey, CAST(count(*) AS INT) AS n FROM customer GROUP BY 1", lambda d: G.collect(d.select("c_nationkey", G.point(F.expr(_X), F.expr(_Y)).alias("p")), ["c_nationkey"], "p").select("c_nationkey", F.size("points").alias("n")))
simple("geo_explode", "part", "SELECT p_partkey, unnest(range(5)) AS k FROM part", lambda d: _rects(d).select("p_partkey", F.posexplode("ring").alias("k", "v")).select("p_partkey", c("k").cast("long").alias("k")))


# --- predicates and overlays: each rectangle against the next one, or against a shape made from itself
# Every other shape is an L: its upper right quarter is cut out. Areas follow from boxes: an L is its box less that quarter.
_COVER = "greatest(0, least({0}.x1, {1}.x1) - greatest({0}.x0, {1}.x0)) * greatest(0, least({0}.y1, {1}.y1) - greatest({0}.y0, {1}.y0))"
_ELLS = f"(SELECT p_partkey, x0, y0, x0 + w AS x1, y0 + h AS y1, p_partkey % 2 = 1 AS ell, w, h FROM {_RECTS})"
_SHIFTED = "(SELECT p_partkey, x0 + w * 0.4 AS x0, y0 + h * 0.3 AS y0, x1 + w * 0.4 AS x1, y1 + h * 0.3 AS y1, p_partkey % 3 <> 0 AS ell, w, h FROM " + _ELLS + ")"
_NOTCH = "(SELECT p_partkey, x0 + w / 2.0 AS x0, y0 + h / 2.0 AS y0, x1, y1, ell FROM {})"
_CUT = "(CASE WHEN {} THEN {} ELSE 0 END)"
_BOTH = f"({_COVER.format('a', 'b')} - {_CUT.format('a.ell', _COVER.format('m', 'b'))} - {_CUT.format('b.ell', _COVER.format('a', 'n'))} + {_CUT.format('a.ell AND b.ell', _COVER.format('m', 'n'))})"
_RPAIR = f"(SELECT a.p_partkey, a.w * a.h * (CASE WHEN a.ell THEN 0.75 ELSE 1 END) AS own, b.w * b.h * (CASE WHEN b.ell THEN 0.75 ELSE 1 END) AS its, {_BOTH} AS both_ FROM {_ELLS} a JOIN {_SHIFTED} b USING (p_partkey) JOIN {_NOTCH.format(_ELLS)} m USING (p_partkey) JOIN {_NOTCH.format(_SHIFTED)} n USING (p_partkey))"
_OVERLAY = "geo_intersection", "geo_difference", "geo_union", "geo_symmetric_difference", "geo_predicate_overlaps"
# the predicates that ask whether boxes meet compare each rectangle with the next one
_RNEXT = f"(SELECT p_partkey, x0 <= u0 + w2 AND u0 <= x0 + w AND y0 <= v0 + h2 AND v0 <= y0 + h AS meet FROM (SELECT a.*, b.x0 AS u0, b.y0 AS v0, b.w AS w2, b.h AS h2 FROM {_RECTS} a JOIN {_RECTS} b ON b.p_partkey = a.p_partkey + 1))"


def _ell(shift_x: float, shift_y: float, ell):
    """The own rectangle, moved by parts of its sides, or the L that is left of it."""
    x0, y0 = c("x0") + c("w") * shift_x, c("y0") + c("h") * shift_y
    x1, y1 = x0 + c("w"), y0 + c("h")
    xm, ym = x0 + c("w") / 2, y0 + c("h") / 2
    return F.when(ell, F.array(*(G.point(x, y) for x, y in ((x0, y0), (x1, y0), (x1, ym), (xm, ym), (xm, y1), (x0, y1), (x0, y0))))).otherwise(G.rectangle(x0, y0, x1, y1))


def _pair_query(name: str, sql: str, output: str, column) -> None:
    def f(d: DataFrame) -> DataFrame:
        a = _rects(d)
        if name in _OVERLAY:
            shapes = a.select("p_partkey", _ell(0.0, 0.0, c("p_partkey") % 2 == 1).alias("ring"), _ell(0.4, 0.3, c("p_partkey") % 3 != 0).alias("other"))
            return shapes.select("p_partkey", column(c("ring"), c("other")).alias(output))
        both = a.join(a.select((c("p_partkey") - 1).alias("p_partkey"), c("ring").alias("other")), "p_partkey")
        return both.select("p_partkey", column(c("ring"), c("other")).alias(output))

    simple(name, "part", f"SELECT p_partkey, {sql} AS {output} FROM {_RPAIR if name in _OVERLAY else _RNEXT}", f)


_rounded = lambda v: F.round(v, 6)
_pair_query("geo_intersection", "round(CAST(both_ AS DOUBLE), 6)", "area", lambda a, b: _rounded(O.areas(O.intersection(a, b))))
_pair_query("geo_difference", "round(CAST(own - both_ AS DOUBLE), 6)", "area", lambda a, b: _rounded(O.areas(O.difference(a, b))))
_pair_query("geo_union", "round(CAST(own + its - both_ AS DOUBLE), 6)", "area", lambda a, b: _rounded(O.areas(O.union(a, b))))
_pair_query("geo_symmetric_difference", "round(CAST(own + its - 2 * both_ AS DOUBLE), 6)", "area", lambda a, b: _rounded(O.areas(O.symmetric_difference(a, b))))
_pair_query("geo_predicate_intersects", "meet", "hit", O.intersects)
_pair_query("geo_predicate_disjoint", "NOT meet", "hit", O.disjoint)
_pair_query("geo_predicate_overlaps", "both_ > 1e-9 AND both_ < least(own, its) - 1e-9", "hit", O.overlaps)


def _box(dx0: float, dy0: float, dx1: float, dy1: float):
    """A rectangle around the own lower left corner."""
    return G.rectangle(c("x0") + dx0, c("y0") + dy0, c("x0") + dx1, c("y0") + dy1)


def _corners(*order: int):
    return F.array(*(F.get(c("ring"), k) for k in order))


def _path(*points):
    return F.array(*(G.point(x, y) for x, y in points))


_rect_query("geo_predicate_covered_by", "w <= 5 AND h <= 5 AS hit", lambda: [O.covered_by(c("ring"), _box(-1, -1, 5, 5)).alias("hit")])
_rect_query("geo_predicate_contains_properly", "w < 5 AND h < 5 AS hit", lambda: [O.contains_properly(_box(-1, -1, 5, 5), c("ring")).alias("hit")])
_rect_query("geo_predicate_equals_topo", "p_partkey % 2 = 0 AS hit", lambda: [O.equals_topo(c("ring"), F.when(c("p_partkey") % 2 == 0, _corners(2, 1, 0, 3, 2)).otherwise(G.translate(c("ring"), 1.0, 0.0))).alias("hit")])
_rect_query("geo_predicate_touches", "p_partkey % 2 = 0 AS hit", lambda: [O.touches(c("ring"), G.translate(c("ring"), c("w") + c("p_partkey") % 2, 0.0)).alias("hit")])
_rect_query("geo_predicate_crosses", "w < 5 AS hit", lambda: [O.crosses(_path((c("x0") + 0.5, c("y0") + 0.5), (c("x0") + 5, c("y0") + 0.5)), c("ring")).alias("hit")])
_rect_query("geo_boundary", "x0 AS x, y0 + h AS y", lambda: [F.get(O.boundary(F.slice(c("ring"), 1, 3)), 0)["x"].alias("x"), F.get(O.boundary(F.slice(c("ring"), 1, 3)), 1)["y"].alias("y")])
_rect_query("geo_buffer", "round(w * h + 2 * (w + h) + 16 * sin(pi() / 16), 6) AS area", lambda: [_rounded(O.areas(O.buffer(c("ring"), 1.0))).alias("area")])
_rect_query("geo_convex_hull", "round(CAST(w * h AS DOUBLE), 6) AS area", lambda: [_rounded(G.area(O.convex_hull(F.concat(c("ring"), F.array(G.centroid(c("ring"))))))).alias("area")])
_rect_query("geo_point_on_surface", "round(x0 + w / 2.0, 4) AS x, round(y0 + h / 2.0, 4) AS y", lambda: [F.round(O.point_on_surface(c("ring"))[k], 4).alias(k) for k in ("x", "y")])
_rect_query("geo_clean_topology", "CASE WHEN p_partkey % 2 = 1 THEN 7 ELSE 5 END AS n", lambda: [F.size(O.clean_topology(G.densify(_ell(0.0, 0.0, c("p_partkey") % 2 == 1), 1.0))).alias("n")])
_rect_query("geo_simplify", "CASE WHEN p_partkey % 2 = 1 THEN 7 ELSE 5 END AS n", lambda: [F.size(O.simplify(G.densify(_ell(0.0, 0.0, c("p_partkey") % 2 == 1), 1.0), 0.01)).alias("n")])
_rect_query("geo_geometry_diagnostics", "p_partkey % 2 = 0 AS is_valid, CASE WHEN p_partkey % 2 <> 0 THEN 'crosses itself' END AS reason", lambda: [O.diagnostics(F.when(c("p_partkey") % 2 == 0, c("ring")).otherwise(_corners(0, 2, 1, 3, 0)))[k].alias(k) for k in ("is_valid", "reason")])
_rect_query("geo_snap", "x0 + CAST(0.05 AS DOUBLE) AS x", lambda: [F.get(O.snap(c("ring"), _path((c("x0") + 0.05, c("y0"))), 0.1), 0)["x"].alias("x")])
_rect_query("geo_split", "round(w * h / CAST(4 AS DOUBLE), 6) AS lo, round(3 * w * h / CAST(4 AS DOUBLE), 6) AS hi", lambda: [_rounded(f(F.transform(O.split(c("ring"), G.point(c("x0") + c("w") / 4, c("y0")), G.point(c("x0") + c("w") / 4, c("y0") + 1)), G.area))).alias(k) for k, f in (("lo", F.array_min), ("hi", F.array_max))])
_OWN = "w * h * (CASE WHEN p_partkey % 2 = 1 THEN 0.75 ELSE 1 END)"


def _split_corner(d: DataFrame) -> DataFrame:
    """Each rectangle or L cut by a line that turns in its middle: its lower left half by a quarter comes off."""
    d = _rects(d)
    blade = _path((c("x0") - 1, c("y0") + c("h") / 4), (c("x0") + c("w") / 2, c("y0") + c("h") / 4), (c("x0") + c("w") / 2, c("y0") - 1))
    shapes = d.select("p_partkey", P.polygon_shape(_ell(0.0, 0.0, c("p_partkey") % 2 == 1)).alias("s"), P.line_shape(blade).alias("b"))
    return U.split(shapes, "p_partkey", "s", "b", 8.0).select("p_partkey", F.round(P.area(c("shape")), 5).alias("area"))


simple("geo_split_by_line", "part", f"SELECT p_partkey, round(unnest([w * h / 8.0, {_OWN} - w * h / 8.0]), 5)::DOUBLE AS area FROM {_RECTS}", _split_corner)
_rect_query("geo_shared_paths", "round(w - CAST(0.5 AS DOUBLE), 6) AS length, false AS forward", lambda: [_rounded(G.distance(z["p"], z["q"])).alias("length") for z in [F.get(O.shared_paths(F.slice(c("ring"), 1, 2), _path((c("x0") + c("w"), c("y0")), (c("x0") + 0.5, c("y0")))), 0)]] + [F.get(O.shared_paths(F.slice(c("ring"), 1, 2), _path((c("x0") + c("w"), c("y0")), (c("x0") + 0.5, c("y0")))), 0)["forward"].alias("forward")])
_rect_query("geo_line_substring", "round(w / 2.0, 6)::DOUBLE AS length", lambda: [_rounded(G.length(O.line_substring(F.slice(c("ring"), 1, 3), lit(0.5), 0.5 + c("w") / 2))).alias("length")])
_rect_query("geo_frechet_distance", "CAST(h AS DOUBLE) AS d", lambda: [_rounded(O.frechet_distance(F.slice(c("ring"), 1, 3), G.translate(F.slice(c("ring"), 1, 3), 0.0, c("h")))).alias("d")])
_rect_query("geo_geodesic_distance", "round(6378137 * radians(w), 3) AS d", lambda: [F.round(O.geodesic_distance(G.point(c("x0"), lit(0.0)), G.point(c("x0") + c("w"), lit(0.0))), 3).alias("d")])
_rect_query("geo_geodesic_line_length", "round(6378137 * radians(w + h), 3) AS length", lambda: [F.round(O.geodesic_line_length(_path((c("x0"), lit(0.0)), (c("x0") + c("w"), lit(0.0)), (c("x0") + c("w") + c("h"), lit(0.0)))), 3).alias("length")])
simple("geo_geodesic_area", "part", None, lambda d: _rects(d).select("p_partkey", F.round(O.geodesic_area(G.scale(c("ring"), 0.9, 0.9)), 0).alias("area")))
# odd keys: along a meridian, whose length Simpson's rule gives; even keys: antipodes, half a meridian ellipse apart
_RADIUS = "6378137 * (1 - e2) / (1 - e2 * sin(t) ** 2) ** 1.5"
_ARC = f"SELECT c_custkey, sum((CASE WHEN k IN (0, 1000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * {_RADIUS} * abs(radians(z) - radians(y)) / 3000) AS d FROM (SELECT c_custkey, y, z, k, radians(y) + (radians(z) - radians(y)) * k / 1000 AS t, (2 - 1 / 298.257223563::DOUBLE) / 298.257223563::DOUBLE AS e2 FROM (SELECT c_custkey, y, 30 - y / 2 AS z FROM {_PTS}), range(1001) r(k)) GROUP BY 1"
simple("geo_geodesic_distance_everywhere", "customer", f"SELECT c_custkey, round(CASE WHEN c_custkey % 2 = 1 THEN d ELSE 20003931.458625::DOUBLE END, 2) AS d FROM ({_ARC})", lambda d: _pts(d).select("c_custkey", F.round(O.geodesic_distance(c("p"), F.when(c("c_custkey") % 2 == 1, G.point(c("p.x"), 30 - c("p.y") / 2)).otherwise(G.point(c("p.x") + 180, -c("p.y")))), 2).alias("d")))
_rect_query("geo_geodesic_area_to_the_pole", "round(510065621.724088::DOUBLE * w / 720, 1) AS area", lambda: [F.round(O.geodesic_area(_path((c("x0"), lit(0.0)), (c("x0") + c("w"), lit(0.0)), (c("x0"), lit(90.0)), (c("x0"), lit(0.0)))) / 1e6, 1).alias("area")])
simple("geo_reproject", "customer", f"SELECT c_custkey, round(6378137 * radians(x), 3) AS x, round(6378137 * ln(tan(pi() / 4 + radians(y) / 2)), 3) AS y FROM {_PTS}", lambda d: _pts(d).select("c_custkey", F.get(O.to_web_mercator(F.array("p")), 0).alias("q")).select("c_custkey", F.round("q.x", 3).alias("x"), F.round("q.y", 3).alias("y")))
# zone 32 and the conic of France, each there and back
_UTM = f"""WITH p AS (SELECT c_custkey, radians(x / 60) AS l, radians(y * 0.9) AS phi, 1 / 298.257223563::DOUBLE AS f FROM {_PTS}),
e AS (SELECT *, sqrt(f * (2 - f)) AS e, f / (2 - f) AS n FROM p),
t AS (SELECT *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS t FROM e),
s AS (SELECT *, 2 * atan2(t, cos(l)) AS u, 2 * asinh(sin(l) / sqrt(t * t + cos(l) ** 2)) AS v, n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180 AS a, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440 AS b, 61 * n ** 3 / 240 - 103 * n ** 4 / 140 AS c, 49561 * n ** 4 / 161280 AS d, 0.9996::DOUBLE * 6378137 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS r FROM t)
SELECT c_custkey, round(500000 + r * (v / 2 + a * cos(u) * sinh(v) + b * cos(2 * u) * sinh(2 * v) + c * cos(3 * u) * sinh(3 * v) + d * cos(4 * u) * sinh(4 * v)), 3) AS x, round(r * (u / 2 + a * sin(u) * cosh(v) + b * sin(2 * u) * cosh(2 * v) + c * sin(3 * u) * cosh(3 * v) + d * sin(4 * u) * cosh(4 * v)), 3) AS y, round(9 + degrees(l), 8) AS lon, round(degrees(phi), 8) AS lat FROM s"""
_CONIC = f"""WITH p AS (SELECT c_custkey, x / 20 AS l, 46.5 + y / 20 AS lat, sqrt(1 / 298.257222101::DOUBLE * (2 - 1 / 298.257222101::DOUBLE)) AS e FROM {_PTS}),
q AS (SELECT *, [radians(lat), radians(44), radians(49), radians(46.5)] AS a FROM p),
r AS (SELECT *, [atanh(sin(z)) - e * atanh(e * sin(z)) FOR z IN a] AS i, [cos(z) / sqrt(1 - (e * sin(z)) ** 2) FOR z IN a] AS m FROM q),
s AS (SELECT *, ln(m[2] / m[3]) / (i[3] - i[2]) AS n FROM r)
SELECT c_custkey, round(700000 + 6378137 * m[2] / n * exp(n * (i[2] - i[1])) * sin(n * radians(l)), 3) AS x, round(6600000 + 6378137 * m[2] / n * (exp(n * (i[2] - i[4])) - exp(n * (i[2] - i[1])) * cos(n * radians(l))), 3) AS y, round(3 + l, 8) AS lon, round(lat, 8) AS lat FROM s"""


def _there_and_back(d: DataFrame, point, code: str) -> DataFrame:
    d = d.select("c_custkey", F.array(point).alias("p")).withColumn("q", C.reproject(c("p"), "EPSG:4326", code)).withColumn("back", C.reproject(c("q"), code, "EPSG:4326"))
    q, back = F.get("q", lit(0)), F.get("back", lit(0))
    return d.select("c_custkey", F.round(q["x"], 3).alias("x"), F.round(q["y"], 3).alias("y"), F.round(back["x"], 8).alias("lon"), F.round(back["y"], 8).alias("lat"))


simple("geo_reproject_utm", "customer", _UTM, lambda d: _there_and_back(_pts(d), G.point(9 + c("p.x") / 60, c("p.y") * 0.9), "EPSG:32632"))
simple("geo_reproject_conic", "customer", _CONIC, lambda d: _there_and_back(_pts(d), G.point(3 + c("p.x") / 20, 46.5 + c("p.y") / 20), "EPSG:2154"))

# --- whole tables
_WORLD = (-180.0, -85.0, 180.0, 85.0)


def _grid(t, size: float) -> DataFrame:
    return G.generate_grid(t("region").sparkSession, *_WORLD, size)


def _sites(t) -> DataFrame:
    return t("supplier").select("s_suppkey", G.point(F.expr("((s_suppkey * 37) % 3600) / CAST(10 AS DOUBLE) - 180"), F.expr("((s_suppkey * 17) % 1700) / CAST(10 AS DOUBLE) - 85")).alias("p"))


@kernel(f"SELECT p_partkey FROM {_RECTS} WHERE x0 >= -90 AND x0 + w <= 90 AND y0 >= -45 AND y0 + h <= 45")
def geo_within(t):
    return S.within(_rects(t("part")), "ring", G.rectangle(lit(-90.0), lit(-45.0), lit(90.0), lit(45.0))).select("p_partkey")


@kernel(f"SELECT p_partkey, round((least(x0 + w, 180) - x0) * (least(y0 + h, 85) - y0), 5) AS area FROM {_RECTS}")
def geo_clip(t):
    cut = S.clip(_rects(t("part")).select("p_partkey", "ring"), _grid(t, 10.0), "ring", "ring", 10.0)
    return cut.groupBy("p_partkey").agg(F.round(F.sum(G.area(c("ring"))), 5).alias("area"))


@kernel(f"SELECT p_partkey, round((x1 - x0) * (least(y1, 40) - greatest(y0, -40)), 5) AS area FROM (SELECT p_partkey, greatest(x0, -120) AS x0, least(x0 + w, 120) AS x1, y0, y0 + h AS y1 FROM {_RECTS}) WHERE x1 - x0 > 1e-6 AND least(y1, 40) - greatest(y0, -40) > 1e-6")
def geo_clip_overlapping_masks(t):
    # one mask a region, each overlapping the next ones; together from -120 to 120 and -40 to 40
    x = c("r_regionkey") * 40 - 120
    masks = t("region").select(G.rectangle(x, lit(-40.0), x + 80, lit(40.0)).alias("mask"))
    cut = S.clip(_rects(t("part")).select("p_partkey", "ring"), masks, "ring", "mask", 20.0)
    return cut.groupBy("p_partkey").agg(F.round(F.sum(G.area(c("ring"))), 5).alias("area"))


@kernel(f"SELECT p_partkey, c_custkey FROM {_RECTS} LEFT JOIN {_PTS} ON {_IN}")
def geo_sjoin_left(t):
    return G.sjoin_points(_rects(t("part")).select("p_partkey", "ring"), _pts(t("customer")), "ring", "p", 5.0, how="left").select("p_partkey", "c_custkey")


@kernel(f"SELECT p_partkey, round(CAST(w * h AS DOUBLE), 5) AS area FROM {_RECTS}")
def geo_overlay(t):
    cut = S.overlay(_rects(t("part")), _grid(t, 10.0).withColumn("cell", c("col") * 17 + c("row")), "p_partkey", "cell", "ring", "ring", 10.0, "identity")
    return cut.groupBy("p_partkey").agg(F.round(F.sum(G.area(c("ring"))), 5).alias("area"))


@kernel(f"SELECT a.p_partkey, b.p_partkey AS other, round(greatest(0, least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0)) * greatest(0, least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0)), 6) AS common FROM {_RECTS} a JOIN {_RECTS} b ON a.p_partkey < b.p_partkey AND least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0) > 1e-6 AND least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0) > 1e-6")
def geo_coverage_validate(t):
    # F.round goes through text, which takes longer than finding a pair does
    return S.coverage_validate(_rects(t("part")), "p_partkey", "ring", 5.0).withColumn("common", F.floor(c("common") * 1e6 + 0.5) / 1e6)


# plots of 1 x 1, 50 to a row: some are missing, some too wide, some have one vertex more, and odd ones a hole
_FLAWED = "(SELECT p_partkey AS k, p_partkey % 50 AS i, p_partkey // 50 AS j, CASE WHEN p_partkey % 31 = 0 THEN 1.25::DOUBLE ELSE 1::DOUBLE END AS w FROM part WHERE p_partkey % 37 <> 0)"
_CORNERS = f"(SELECT k, unnest([{{'x': i::DOUBLE, 'y': j::DOUBLE}}, {{'x': i + w, 'y': j::DOUBLE}}, {{'x': i + w, 'y': j + 1::DOUBLE}}, {{'x': i::DOUBLE, 'y': j + 1::DOUBLE}}] || CASE WHEN k % 29 = 0 THEN [{{'x': i::DOUBLE, 'y': j + 0.5::DOUBLE}}] ELSE [] END) AS p FROM {_FLAWED})"


def _flawed(t, holes: bool = False) -> DataFrame:
    k = c("p_partkey")
    x, y = k % 50, F.floor(k / 50)
    end = x + F.when(k % 31 == 0, 1.25).otherwise(1.0)
    more = F.when(k % 29 == 0, F.array(G.point(x, y + 0.5))).otherwise(F.array().cast(G.PATH))
    shell = F.concat(F.array(G.point(x, y), G.point(end, y), G.point(end, y + 1), G.point(x, y + 1)), more, F.array(G.point(x, y)))
    hole = F.when(k % 2 == 1, F.array(G.rectangle(x + 0.05, y + 0.25, x + 0.15, y + 0.75))) if holes else None
    return _dealt(t("part"), "p_partkey").where(k % 37 != 0).select(k.alias("k"), P.polygon_shape(shell, hole).alias("shape"))


@kernel(f"SELECT a.k AS key, b.k AS other, CASE WHEN b.k % 2 = 1 THEN 0.2::DOUBLE ELSE 0.25::DOUBLE END AS area FROM {_FLAWED} a JOIN {_FLAWED} b ON b.k = a.k + 1 AND b.j = a.j AND a.w > 1")
def geo_coverage_overlaps(t):
    return V.overlaps(_flawed(t, True), "k", "shape", 1.0).withColumn("area", F.round("area", 6))


@kernel(f"SELECT m.i + l.w - 1 AS x, m.j::DOUBLE AS y, 2 - l.w AS area FROM (SELECT p_partkey AS k, p_partkey % 50 AS i, p_partkey // 50 AS j FROM part WHERE p_partkey % 37 = 0) m JOIN {_FLAWED} l ON l.k = m.k - 1 AND l.j = m.j JOIN {_FLAWED} r ON r.k = m.k + 1 AND r.j = m.j JOIN {_FLAWED} u ON u.k = m.k + 50 JOIN {_FLAWED} d ON d.k = m.k - 50")
def geo_coverage_gaps(t):
    place = lambda axis: F.array_min(F.transform("ring", lambda p: p[axis]))
    return V.gaps(_flawed(t), "shape", 2.0).select(place("x").alias("x"), place("y").alias("y"), F.round("area", 6).alias("area"))


@kernel(f"SELECT DISTINCT e.k AS key, v.k AS other, v.p.x AS x, v.p.y AS y FROM {_CORNERS} v JOIN {_FLAWED} e ON v.k <> e.k AND v.p.x BETWEEN e.i AND e.i + e.w AND v.p.y BETWEEN e.j AND e.j + 1 AND (v.p.x IN (e.i, e.i + e.w) OR v.p.y IN (e.j, e.j + 1)) WHERE NOT EXISTS (SELECT 1 FROM {_CORNERS} o WHERE o.k = e.k AND o.p = v.p)")
def geo_coverage_unmatched(t):
    return V.unmatched(_flawed(t), "k", "shape", 1.0).select("key", "other", "place.x", "place.y")


# plots of 1 x 1, 50 to a row; the border to the right of every third bends by 0.25, of the others by 0.05
@kernel("SELECT p_partkey AS k, 1::DOUBLE + CASE WHEN p_partkey % 3 = 0 THEN 0.125 ELSE 0 END - CASE WHEN p_partkey % 3 = 1 THEN 0.125 ELSE 0 END AS area, 5 + CASE WHEN p_partkey % 3 = 2 THEN 0 ELSE 1 END AS places FROM part")
def geo_simplify_coverage(t):
    k = c("p_partkey")
    x, y = k % 50, F.floor(k / 50)
    bend = lambda x, third: G.point(x + F.when(third, 0.25).otherwise(0.05), y + 0.5)
    shell = F.array(G.point(x, y), G.point(x + 1, y), bend(x + 1, k % 3 == 0), G.point(x + 1, y + 1), G.point(x, y + 1), bend(x, k % 3 == 1), G.point(x, y))
    found = V.simplify(_dealt(t("part"), "p_partkey").select(k.alias("k"), P.polygon_shape(shell, None).alias("shape")), "k", "shape", 1.5, 0.1)
    return found.select("k", F.round(P.area(c("shape")), 6).alias("area"), F.size(P.path_of(c("shape"))).alias("places"))


# a plot of 1 x 1 for each part, 50 to a row, of the group of its size; plots of a group that share a side lose it
_PLOTS = "(SELECT p_partkey, p_size % 5 AS g, p_partkey % 50 AS i, p_partkey // 50 AS j FROM part)"


@kernel(f"SELECT a.g, CAST(count(*) AS DOUBLE) AS area, count(*) AS n, CAST(sum(4 - (SELECT count(*) FROM {_PLOTS} b WHERE b.g = a.g AND abs(a.i - b.i) + abs(a.j - b.j) = 1)) AS DOUBLE) AS perimeter FROM {_PLOTS} a GROUP BY 1")
def geo_dissolve(t):
    x, y = c("p_partkey") % 50, F.floor(c("p_partkey") / 50)
    plots = t("part").select((c("p_size") % 5).alias("g"), G.rectangle(x, y, x + 1, y + 1).alias("ring"))
    return S.dissolve(plots, ["g"], "ring", F.count("*").alias("n"))


# six shapes a group, on whole coordinates so that their unit cells can be counted: rectangles, and for odd keys frames of them
_SHAPES6 = "(SELECT p_partkey // 6 AS g, p_partkey % 7 AS x0, p_partkey % 5 AS y0, 2 + p_size % 6 AS w, 2 + p_partkey % 4 AS h, p_partkey % 2 = 1 AS frame FROM part)"
_CELLS6 = f"(SELECT DISTINCT g, x0 + i AS i, y0 + j AS j FROM {_SHAPES6}, range(8) a(i), range(6) b(j) WHERE i < w AND j < h AND NOT (frame AND i > 0 AND j > 0 AND i < w - 1 AND j < h - 1))"
_OUTLINE6 = f"SELECT a.g, CAST(count(*) AS DOUBLE) AS area, CAST(sum(4 - (SELECT count(*) FROM {_CELLS6} b WHERE b.g = a.g AND abs(a.i - b.i) + abs(a.j - b.j) = 1)) AS DOUBLE) AS perimeter FROM {_CELLS6} a GROUP BY 1"


def _shapes6(t) -> DataFrame:
    k = c("p_partkey")
    x0, y0, w, h = k % 7, k % 5, 2 + c("p_size") % 6, 2 + k % 4
    hole = F.when((k % 2 == 1) & (w > 2) & (h > 2), F.array(G.rectangle(x0 + 1, y0 + 1, x0 + w - 1, y0 + h - 1)))
    return _dealt(t("part"), "p_partkey", "p_size").select(F.floor(k / 6).alias("g"), P.polygon_shape(G.rectangle(x0, y0, x0 + w, y0 + h), hole).alias("shape"))


@kernel(_OUTLINE6)
def geo_union_of_groups(t):
    found = U.union(_shapes6(t), ["g"], "shape", 4.0)
    return found.select("g", F.round(P.area(c("shape")), 6).alias("area"), F.round(P.perimeter(c("shape")), 6).alias("perimeter"))


@kernel(f"SELECT g, n, area FROM ({_OUTLINE6}) JOIN (SELECT g, count(*) AS n FROM {_SHAPES6} GROUP BY 1) USING (g)")
def geo_dissolve_outlines(t):
    found = U.dissolve(_shapes6(t), ["g"], "shape", 4.0, F.count("*").alias("n"))
    return found.select("g", "n", F.round(P.area(c("shape")), 6).alias("area"))


def _overlay_outline(how: str, area: str) -> None:
    def f(d: DataFrame) -> DataFrame:
        shapes = _rects(d).select("p_partkey", P.polygon_shape(_ell(0.0, 0.0, c("p_partkey") % 2 == 1)).alias("a"), P.polygon_shape(_ell(0.4, 0.3, c("p_partkey") % 3 != 0)).alias("b"))
        return U.overlay(shapes, "p_partkey", "a", "b", how, 8.0).select("p_partkey", F.round(P.area(c("shape")), 5).alias("area"))

    simple(f"geo_{how}_outline", "part", f"SELECT p_partkey, round(CAST({area} AS DOUBLE), 5) AS area FROM {_RPAIR} WHERE {area} > 1e-6", f)


for _how, _area in (("intersection", "both_"), ("difference", "own - both_"), ("union", "own + its - both_"), ("symmetric_difference", "own + its - 2 * both_")):
    _overlay_outline(_how, _area)


@kernel(f"SELECT p_partkey, round(CAST(w * h AS DOUBLE), 5) AS area FROM {_RECTS}")
def geo_subdivide(t):
    return S.subdivide(_rects(t("part")).select("p_partkey", "ring"), "ring", 4.0).groupBy("p_partkey").agg(F.round(F.sum(G.area(c("ring"))), 5).alias("area"))


_NEAR = f"SELECT a.c_custkey AS a, b.c_custkey AS b FROM {_PTS} a JOIN {_PTS} b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 4.1"
_REACHED = "SELECT k AS node, k AS label FROM core UNION SELECT b, label FROM reached JOIN near ON a = node JOIN core ON k = b"


@kernel(f"WITH RECURSIVE near AS ({_NEAR}), core AS (SELECT a AS k FROM near GROUP BY a HAVING count(*) >= 3), reached AS ({_REACHED}), named AS (SELECT node, min(label) AS label FROM reached GROUP BY node) SELECT c_custkey, min(label) AS cluster FROM customer LEFT JOIN near ON a = c_custkey LEFT JOIN named ON node = b GROUP BY c_custkey")
def geo_cluster_dbscan(t):
    return S.cluster_dbscan(_pts(t("customer")), "c_custkey", "p", 4.1, 3)


@kernel()
def geo_voronoi(t):
    return S.voronoi(_sites(t), "s_suppkey", "p", _WORLD, 10.0).select("s_suppkey", F.round(G.area(c("cell")), 5).alias("area"))


@kernel()
def geo_delaunay(t):
    return S.delaunay_edges(_sites(t), "s_suppkey", "p", _WORLD, 10.0).select("s_suppkey", c("q.x").alias("x"), c("q.y").alias("y"))


@kernel("SELECT p_partkey // 10 AS chain, min(p_partkey) AS p_partkey, CAST(count(*) AS DOUBLE) AS length FROM part GROUP BY 1")
def geo_line_merge(t):
    k, chain = c("p_partkey"), F.floor(c("p_partkey") / 10)
    d = t("part").select("p_partkey", chain.alias("chain"), F.when(k % 2 == 0, _path((k, chain), (k + 1, chain))).otherwise(_path((k + 1, chain), (k, chain))).alias("path"))
    return L.line_merge(d, ["chain"], "p_partkey", "path").select("chain", "p_partkey", G.length(c("path")).alias("length"))


@kernel("SELECT r_regionkey, CAST(i AS DOUBLE) AS x, CAST(j AS DOUBLE) AS y, CAST(1 AS DOUBLE) AS area FROM region, range(3) a(i), range(2) b(j)")
def geo_polygonize(t):
    n = F.explode(F.sequence(lit(0), lit(3))).alias
    at = t("region").select("r_regionkey", n("i")).select("r_regionkey", "i", n("j"))
    across, up = _path((c("i"), c("j")), (c("i") + 1, c("j"))), _path((c("i"), c("j")), (c("i"), c("j") + 1))
    lines = at.where("i < 3 AND j < 3").select("r_regionkey", (c("i") * 8 + c("j") * 2).alias("k"), across.alias("path")).union(at.where("j < 2").select("r_regionkey", (c("i") * 8 + c("j") * 2 + 1).alias("k"), up.alias("path")))
    b = G.bounds(c("ring"))
    return L.polygonize(lines, ["r_regionkey"], "k", "path").select("r_regionkey", b["minx"].alias("x"), b["miny"].alias("y"), G.area(c("ring")).alias("area"))


@kernel(f"SELECT p_partkey, CAST(2 AS BIGINT) AS n, round(w * h / CAST(2 AS DOUBLE), 5) AS area FROM {_RECTS}")
def geo_make_valid(t):
    bow = _rects(t("part")).select("p_partkey", _corners(0, 2, 1, 3, 0).alias("ring"))
    return L.make_valid(bow, "p_partkey", "ring").groupBy("p_partkey").agg(F.count("*").alias("n"), F.round(F.sum(G.area(c("ring"))), 5).alias("area"))
