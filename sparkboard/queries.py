"""Named queries over the test tables, each with its equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import dates, entities, numbers, risk, text
from .functions.formula import compile_formula
from .operators import classify, knowledge, lookup, memory, reports, retrieval
from .plans import edit, request, resolve
from .plans.oplog import live_rows, undone
from .plans.profile import auto_board, profile
from .plans.spec import Chart, Filter, Kpi
from .sources import sinks, web
from .streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = "2001-01-01"


def query(name: str, table: str, sql: str | None = None) -> Callable:
    """Registers a function of one table as query ``name``."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in table.split()])
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def day(value: str) -> Column:
    return F.lit(value).cast("date")


def two(c: Column | str) -> Column:
    return F.round(c, 2)


# ---- filters -----------------------------------------------------------------------------

query("filter_contains", "part", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an')")(lambda t: resolve.filtered(t, Filter("p_name", "contains", "AN")).select("p_partkey", "p_name"))
query("filter_eq_ci", "customer", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")(lambda t: resolve.filtered(t, Filter("C_MktSegment", "eq", "Building")).select("c_custkey"))
query("filter_neq_blank", "orders", "SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders) WHERE coalesce(lower(s), '') <> 'f'")(lambda t: resolve.filtered(t.withColumn("s", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus"))), Filter("s", "neq", "F")).select("o_orderkey"))
query("filter_gt", "orders", "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders WHERE o_totalprice > 300000")(lambda t: resolve.filtered(t, Filter("o_totalprice", "gt", 300000)).select("o_orderkey", two("o_totalprice").alias("price")))
query("filter_lt", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 5")(lambda t: resolve.filtered(t, Filter("l_quantity", "lt", 5)).select("l_orderkey", "l_linenumber"))
query("filter_and", "orders", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 1000 AND lower(o_orderstatus) = 'o'")(lambda t: resolve.filtered(t, [Filter("o_totalprice", "gt", 1000), Filter("o_orderstatus", "eq", "o")]).agg(F.count("*").alias("n")))

# ---- indicators --------------------------------------------------------------------------

query("kpi_count", "lineitem", "SELECT CAST(count(*) AS DOUBLE) AS value FROM lineitem")(lambda t: resolve.kpi(t, Kpi("count")))
for _agg in ("sum", "avg", "min", "max"):
    query(f"kpi_{_agg}", "lineitem", f"SELECT round({_agg}(l_extendedprice), 2) AS value FROM lineitem WHERE lower(l_returnflag) = 'r'")(lambda t, a=_agg: resolve.kpi(t, Kpi(a, "l_extendedprice", Filter("l_returnflag", "eq", "R"))).select(two("value").alias("value")))
query("kpi_last_delta", "orders", "SELECT round(max(o_totalprice) FILTER (r = 1), 2) AS value, round(max(o_totalprice) FILTER (r = 1) - max(o_totalprice) FILTER (r = 2), 2) AS delta FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)")(lambda t: resolve.kpi(t, Kpi("last", "o_totalprice", delta_prev=True, order_by=("o_orderdate", "o_orderkey"))).select(two("value").alias("value"), two("delta").alias("delta")))
query("kpi_spark12", "orders", "SELECT p, round(v, 2) AS v FROM (SELECT o_totalprice AS v, 13 - row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS p FROM orders) WHERE p >= 1")(lambda t: resolve.kpi(t, Kpi("last", "o_totalprice", order_by=("o_orderdate", "o_orderkey"))).select(F.posexplode("spark").alias("p", "v")).select((F.col("p") + 1).cast("long").alias("p"), two("v").alias("v")))
query("kpi_validity", "lineitem", f"SELECT CAST(count(*) FILTER (CAST(l_shipdate AS DATE) < DATE '{AS_OF}') AS DOUBLE) AS value FROM lineitem")(lambda t: resolve.kpi(t, Kpi(validity="l_shipdate", status="vencido"), day(AS_OF)))
query("kpi_fused", "lineitem", f"SELECT CAST(count(*) AS DOUBLE) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount, round(max(l_extendedprice) FILTER (lower(l_returnflag) = 'r'), 2) AS top_returned, CAST(count(*) FILTER (CAST(l_shipdate AS DATE) > DATE '{AS_OF}' + 30) AS DOUBLE) AS current FROM lineitem")(
    lambda t: resolve.kpis(t, {"n": Kpi("count"), "quantity": Kpi("sum", "l_quantity"), "discount": Kpi("avg", "l_discount"), "top_returned": Kpi("max", "l_extendedprice", Filter("l_returnflag", "eq", "R")), "current": Kpi(validity="l_shipdate", status="em_dia")}, day(AS_OF)).select("n", two("quantity").alias("quantity"), F.round("discount", 6).alias("discount"), two("top_returned").alias("top_returned"), "current")
)

# ---- charts ------------------------------------------------------------------------------

_STATUS = f"CASE WHEN CAST(l_shipdate AS DATE) < DATE '{AS_OF}' THEN 'vencido' WHEN CAST(l_shipdate AS DATE) <= DATE '{AS_OF}' + 30 THEN 'a_vencer' ELSE 'em_dia' END"
query("chart_validity", "lineitem", f"SELECT s.position, s.label, coalesce(n.v1, 0.0)::DOUBLE AS v1 FROM (VALUES (1, 'vencido'), (2, 'a_vencer'), (3, 'em_dia')) s(position, label) LEFT JOIN (SELECT {_STATUS} AS label, count(*) AS v1 FROM lineitem GROUP BY 1) n USING (label)")(lambda t: resolve.chart(t, Chart(validity="l_shipdate"), day(AS_OF)))
query("table_validity", "lineitem", f"SELECT l_orderkey, l_linenumber, {_STATUS} AS situacao FROM lineitem")(lambda t: resolve.with_validity(t, "l_shipdate", day(AS_OF), "situacao").select("l_orderkey", "l_linenumber", "situacao"))
query("chart_group_count", "orders", "SELECT o_orderpriority AS label, count(*)::DOUBLE AS v1, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS position FROM orders GROUP BY 1")(lambda t: resolve.chart(t, Chart("o_orderpriority", agg="count")))
query("chart_group_sum", "lineitem", "SELECT l_returnflag AS label, round(sum(l_quantity), 2) AS v1, row_number() OVER (ORDER BY sum(l_quantity) DESC, l_returnflag) AS position FROM lineitem GROUP BY 1")(lambda t: resolve.chart(t, Chart("l_returnflag", ("l_quantity",))).withColumn("v1", two("v1")))
query("chart_multi_series", "lineitem", "SELECT l_linestatus AS label, round(sum(l_quantity), 2) AS v1, round(sum(l_extendedprice), 0) AS v2, row_number() OVER (ORDER BY sum(l_quantity) DESC, l_linestatus) AS position FROM lineitem GROUP BY 1")(lambda t: resolve.chart(t, Chart("l_linestatus", ("l_quantity", "no_such_column", "l_extendedprice"))).withColumn("v1", two("v1")).withColumn("v2", F.round("v2", 0)))
_MONTHS = "WITH g AS (SELECT date_trunc('month', o_orderdate)::DATE AS m, {v} AS v1 FROM orders GROUP BY 1), s AS (SELECT unnest(generate_series((SELECT min(m) FROM g)::TIMESTAMP, (SELECT max(m) FROM g)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m) SELECT strftime(s.m, '%Y-%m') AS month, (['jan','fev','mar','abr','mai','jun','jul','ago','set','out','nov','dez'])[month(s.m)] || '/' || strftime(s.m, '%y') AS label, round(coalesce(g.v1, 0), 0)::DOUBLE AS v1, (year(s.m) * 12 + month(s.m))::INT AS position FROM s LEFT JOIN g USING (m)"
query("chart_month_fill", "orders", _MONTHS.format(v="count(*)"))(lambda t: resolve.chart(t, Chart("o_orderdate", agg="count", group_date="month"), day(AS_OF)))
query("chart_month_sum", "orders", _MONTHS.format(v="sum(o_totalprice)"))(lambda t: resolve.chart(t, Chart("o_orderdate", ("o_totalprice",), group_date="month"), day(AS_OF)).withColumn("v1", F.round("v1", 0)))
query(
    "chart_topn_outros",
    "events",
    "WITH g AS (SELECT CAST(user_id AS VARCHAR) AS label, count(*)::DOUBLE AS v1 FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY v1 DESC, label) AS position FROM g) SELECT label, v1, position FROM r WHERE position < 12 UNION ALL SELECT 'Outros', sum(v1), 12 FROM r WHERE position >= 12",
)(lambda t: resolve.chart(t, Chart("user_id", agg="count", top=12)))
query(
    "chart_donut_fold",
    "customer nation",
    "WITH g AS (SELECT n_name AS label, count(*)::DOUBLE AS v1 FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY v1 DESC, label) AS p, sum(v1) OVER () AS t FROM g), f AS (SELECT label, v1, t FROM r WHERE p < 6 UNION ALL SELECT 'Outros', sum(v1), max(t) FROM r WHERE p >= 6) SELECT label, v1, floor(v1 * 100 / t + 0.5)::INT AS share FROM f",
)(lambda c, n: resolve.donut(resolve.grouped(lookup.with_lookup(c.withColumnRenamed("c_nationkey", "n_nationkey"), n, ["n_nationkey"]), Chart("n_name", agg="count"))))
query("chart_raw80", "orders", "SELECT CAST(o_orderkey AS VARCHAR) AS label, round(o_totalprice, 2) AS v1 FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 80")(lambda t: resolve.chart(t, Chart("o_orderkey", ("o_totalprice",), agg="none", order_by=("o_orderdate", "o_orderkey"))).withColumn("v1", two("v1")))
query("chart_share", "orders", "SELECT o_orderstatus AS label, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 8) AS share FROM orders GROUP BY 1")(lambda t: t.groupBy(F.col("o_orderstatus").alias("label")).agg(F.sum("o_totalprice").alias("v")).select("label", F.round(F.col("v") / F.sum("v").over(Window.partitionBy()), 8).alias("share")))

# ---- counters, progress, formulas, tables ------------------------------------------------

query("counter_days", "events", "SELECT max(CAST(ts AS DATE)) AS since, greatest(0, date_diff('day', max(CAST(ts AS DATE)), DATE '2024-02-01'))::INT AS days FROM events WHERE lower(event_type) = 'error'")(lambda t: resolve.counter(t, "ts", day("2024-02-01"), Filter("event_type", "eq", "error")))
query("progress_pct", "orders", "SELECT o_orderstatus, round(least(100, greatest(0, count(*) FILTER (o_totalprice > 100000) * 100.0 / count(*))), 6)::DOUBLE AS pct FROM orders GROUP BY 1")(lambda t: t.groupBy("o_orderstatus").agg(F.round(resolve.progress(F.count_if(F.col("o_totalprice") > 100000).cast("double"), F.count("*")), 6).alias("pct")))
query("calc_rate", "orders", "SELECT year(o_orderdate)::INT AS y, round(count(*) FILTER (o_orderstatus = 'F') * 1e6 / (count(*) * 160.0), 6)::DOUBLE AS rate FROM orders GROUP BY 1")(lambda t: t.groupBy(F.year("o_orderdate").alias("y")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), (F.count("*") * 160.0).alias("h")).select("y", F.round(risk.frequency_rate(F.col("a"), F.col("h")), 6).alias("rate")))
query("calc_formula", "lineitem", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax) + least(l_quantity, 10) ^ 2, 6) AS charge FROM lineitem")(
    lambda t: t.select("l_orderkey", "l_linenumber", F.round(compile_formula("PRICE * (1 - D) * (1 + T) + min(Q, 10) ^ 2", {"PRICE": F.col("l_extendedprice"), "D": F.col("l_discount"), "T": F.col("l_tax"), "Q": F.col("l_quantity")}), 6).alias("charge"))
)
query("calc_precedence", "part", "SELECT p_partkey, CAST(pow(-CAST(p_size AS DOUBLE), 2) AS DOUBLE) AS squared, CAST(p_size % 7 AS DOUBLE) AS rest FROM part")(lambda t: t.select("p_partkey", compile_formula("-s ^ 2", {"s": F.col("p_size")}).alias("squared"), compile_formula("s % 7", {"s": F.col("p_size")}).alias("rest")))
query("table_search", "customer", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '00012') OR contains(CAST(c_custkey AS VARCHAR), '00012') OR contains(lower(c_mktsegment), '00012') OR contains(CAST(c_nationkey AS VARCHAR), '00012') OR contains(CAST(c_acctbal AS VARCHAR), '00012')")(lambda t: resolve.search(t, "00012").select("c_custkey"))
query("table_sort", "part", "SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_name, p_partkey")(lambda t: t.orderBy(*resolve.sort_keys(t, "p_name", day(AS_OF)), "p_partkey").select("p_partkey", "p_name"))
query("table_page", "customer", "SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 200 OFFSET 100")(lambda t: resolve.page(t, [F.desc("c_acctbal"), F.asc("c_custkey")], 1).select("c_custkey", two("c_acctbal").alias("c_acctbal")))
query("timeline40", "events", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 40")(lambda t: resolve.timeline(t, "ts", ["event_id"]).select("event_id", "event_type"))
query("checklist_ratio", "orders", "SELECT count(*) FILTER (o_orderstatus = 'F') AS done, count(*) AS total FROM orders")(lambda t: resolve.checklist(t, F.col("o_orderstatus") == "F"))
query("schema_reshape", "region", "SELECT r_name, '' AS note, r_regionkey FROM region")(lambda t: resolve.reshaped(t, ["r_name", "note", "r_regionkey"]))
query("delta_tone", "events", "SELECT event_type, CASE WHEN sum(value) = 0 THEN 'neutral' WHEN sum(value) < 0 THEN 'good' ELSE 'bad' END AS tone FROM events GROUP BY 1")(lambda t: t.groupBy("event_type").agg(F.sum("value").alias("d")).select("event_type", resolve.delta_tone(F.col("d"), "down").alias("tone")))
query("cell_dates", "orders", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS shown, (['jan','fev','mar','abr','mai','jun','jul','ago','set','out','nov','dez'])[month(o_orderdate)] || '/' || strftime(o_orderdate, '%y') AS month FROM orders")(lambda t: t.select("o_orderkey", dates.short_date(F.col("o_orderdate")).alias("shown"), dates.month_label(F.col("o_orderdate")).alias("month")))

# ---- profiles ----------------------------------------------------------------------------

query("profile_numeric", "customer", "SELECT 'c_acctbal' AS name, count(c_acctbal) AS filled, round(sum(c_acctbal), 0) AS total, round(min(c_acctbal), 2) AS low, round(max(c_acctbal), 2) AS high FROM customer")(lambda t: profile(t, day(AS_OF)).where("name = 'c_acctbal'").select("name", "filled", F.round("sum", 0).alias("total"), two("min").alias("low"), two("max").alias("high")))
query("profile_distinct", "part", "SELECT 'p_brand' AS name, count(DISTINCT p_brand) AS n FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part UNION ALL SELECT 'p_size', count(DISTINCT p_size) FROM part")(lambda t: profile(t.select("p_brand", "p_type", "p_size"), day(AS_OF)).select("name", F.col("unique").alias("n")))
query("profile_types", "events", "SELECT * FROM (VALUES ('event_id', 'number'), ('ts', 'date'), ('user_id', 'number'), ('event_type', 'category'), ('value', 'number'), ('props', 'text')) t(name, type)")(lambda t: profile(t, day(AS_OF)).select("name", "type"))


@query("auto_board", "orders")
def _auto_board(t: DataFrame) -> DataFrame:
    import json

    rows = [x.asDict() for x in profile(t, day(AS_OF)).orderBy("position").collect()]  # one row for each column
    plan = auto_board(rows, "orders", 9)
    return t.sparkSession.createDataFrame([(k, w["type"], w["title"], json.dumps(w["props"], ensure_ascii=False, sort_keys=True)) for k, w in enumerate(plan)], "position int, type string, title string, props string")


# ---- set operations and lookups ----------------------------------------------------------

query("set_union", "orders lineitem", "SELECT o_orderkey AS k FROM orders UNION SELECT l_orderkey FROM lineitem")(lambda o, i: o.select(F.col("o_orderkey").alias("k")).union(i.select("l_orderkey")).distinct())
query("set_union_all", "orders lineitem", "SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders UNION ALL SELECT l_orderkey FROM lineitem)")(lambda o, i: o.select(F.col("o_orderkey").alias("k")).unionByName(i.select(F.col("l_orderkey").alias("k"))).agg(F.count("*").alias("n")))
query("set_intersect", "orders lineitem", "SELECT o_custkey AS k FROM orders INTERSECT SELECT l_suppkey FROM lineitem")(lambda o, i: o.select(F.col("o_custkey").alias("k")).intersect(i.select("l_suppkey")))
query("set_except", "customer orders", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")(lambda c, o: c.select(F.col("c_custkey").alias("k")).exceptAll(o.select("o_custkey").distinct()))
query("set_distinct", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")(lambda t: t.select("l_returnflag", "l_linestatus").distinct())
query("keep_first", "events", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")(lambda t: lookup.keep_first(t, ["event_type"], ["ts", "event_id"]).select("event_type", "event_id"))
query("join_lookup", "customer nation", "SELECT c_custkey, coalesce(n_name, '?') AS n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")(lambda c, n: lookup.with_lookup(c.select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), n.select("n_nationkey", "n_name"), ["n_nationkey"], {"n_name": F.lit("?")}).select("c_custkey", "n_name"))
_WORDS = "regexp_extract_all({t}, '[a-z0-9]+(?:-[a-z0-9]+)*')"
_NORM = "trim(regexp_replace(lower(strip_accents({c})), '[\\s]+', ' ', 'g'))"
_DOC_WORDS = "SELECT doc_id, unnest(" + _WORDS.format(t=_NORM.format(c="text")) + ") AS token FROM documents"
_STOP = ", ".join(f"'{w}'" for w in sorted(text.STOPWORDS))
query("join_anti_stopwords", "documents", f"SELECT token, count(*) AS n FROM ({_DOC_WORDS}) WHERE token NOT IN ({_STOP}) AND len(token) > 1 GROUP BY 1")(lambda t: t.select(F.explode(text.content_words(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")))
query("join_asof_page", "documents", "WITH b AS (SELECT doc_id, n_chars, unnest(generate_series(1000, greatest(n_chars, 1000), 1000)) AS o FROM documents) SELECT d.doc_id, d.n_chars // 2 AS \"offset\", count(b.o) + 1 AS page FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND b.o <= d.n_chars // 2 GROUP BY 1, 2")(
    lambda t: lookup.as_of_page(t.select("doc_id", F.floor(F.col("n_chars") / 2).alias("offset")), t.select("doc_id", F.explode(F.expr("sequence(1000L, greatest(n_chars, 1000L), 1000L)")).alias("offset")), "doc_id")
)
query("join_fuzzy_vocab", "part", "WITH v AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS token FROM part), q AS (SELECT token AS query, substr(token, 1, 1) || substr(token, 3) AS token FROM v WHERE len(token) >= 6), u AS (SELECT * FROM q WHERE token NOT IN (SELECT token FROM v)), n AS (SELECT u.query, v.token, 0.7::DOUBLE AS weight FROM u JOIN v ON substr(u.token, 1, 1) = substr(v.token, 1, 1) AND abs(len(u.token) - len(v.token)) <= 2 AND levenshtein(u.token, v.token) <= CASE WHEN len(u.token) < 8 THEN 1 ELSE 2 END) SELECT query, token, max(weight) AS weight FROM (SELECT * FROM n UNION ALL SELECT query, token, 1.0::DOUBLE FROM q WHERE token IN (SELECT token FROM v)) GROUP BY 1, 2")(
    lambda t: (lambda v: retrieval.expand_terms(v.where(F.length("token") >= 6).select(F.col("token").alias("query"), F.concat(F.substring("token", 1, 1), F.substring("token", 3, 99)).alias("token")), v.withColumn("df", F.lit(1))))(t.select(F.explode(F.split(F.lower("p_name"), " ")).alias("token")).distinct())
)
query("join_coverage", "documents benchmark", f"WITH d AS (SELECT DISTINCT * FROM ({_DOC_WORDS})), q AS (SELECT DISTINCT item_id, unnest({_WORDS.format(t=_NORM.format(c='text'))}) AS token FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1) SELECT q.item_id, d.doc_id, round(count(*) / max(n.n), 6) AS coverage FROM q JOIN d USING (token) JOIN n USING (item_id) GROUP BY 1, 2 HAVING count(*) / max(n.n) >= 0.8")(
    lambda d, b: lookup.covered(b.select("item_id", text.words(F.col("text")).alias("w")), "item_id", "w", d.select("doc_id", text.words(F.col("text")).alias("w")), "doc_id", "w").select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"), F.round("coverage", 6).alias("coverage"))
)
query("dictionary_hits", "documents", f"WITH w AS ({_DOC_WORDS}) SELECT doc_id AS doc, token AS term, count(*) AS hits FROM w WHERE token IN ('the', 'and', 'que', 'der', 'los') GROUP BY 1, 2")(lambda t: lookup.dictionary_hits(t, "doc_id", "text", t.sparkSession.createDataFrame([(x,) for x in ("the", "and", "que", "der", "los")], "term string"), "term", 1))

# ---- logs --------------------------------------------------------------------------------

_LOG = "SELECT event_type, user_id AS dataset, event_id AS seq, CASE event_type WHEN 'signup' THEN 'set_rows' WHEN 'view' THEN 'add_rows' WHEN 'click' THEN 'add_rows' ELSE 'update_widget' END AS op FROM events"
_LIVE = "WITH l AS ({log}), m AS (SELECT dataset, max(seq) AS s FROM l WHERE op = 'set_rows' GROUP BY 1) SELECT l.dataset, l.seq FROM l JOIN m USING (dataset) WHERE l.op IN ('set_rows', 'add_rows') AND (l.seq = m.s OR (l.op = 'add_rows' AND l.seq > m.s))"


def _log(t: DataFrame) -> DataFrame:
    return t.select(F.col("user_id").alias("dataset"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "set_rows").when(F.col("event_type").isin("view", "click"), "add_rows").otherwise("update_widget").alias("op"))


query("replay_rows", "events", _LIVE.format(log=_LOG))(lambda t: live_rows(_log(t)).select("dataset", "seq"))
query("undo_last", "events", _LIVE.format(log=f"SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY dataset ORDER BY seq DESC) AS r FROM ({_LOG})) WHERE r > 1"))(lambda t: live_rows(undone(_log(t))).select("dataset", "seq"))
query("counters_by_type", "events", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")(state.counters)

# ---- retrieval ---------------------------------------------------------------------------

query("tf", "benchmark", f"SELECT item_id AS doc, token, count(*) AS tf FROM (SELECT item_id, unnest({_WORDS.format(t=_NORM.format(c='text'))}) AS token FROM benchmark) GROUP BY 1, 2")(lambda t: retrieval.build_index(t, "item_id", "text", stems=False).postings.select("doc", "token", "tf"))
query("df", "documents", f"SELECT token, count(DISTINCT doc_id) AS df FROM ({_DOC_WORDS}) GROUP BY 1")(lambda t: retrieval.build_index(t, "doc_id", "text", stems=False).vocabulary)
_BM25 = f"""WITH t AS (SELECT doc_id, token FROM ({_DOC_WORDS})), p AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY 1, 2), l AS (SELECT d.doc_id, greatest(count(t.token), 1) AS len FROM documents d LEFT JOIN t USING (doc_id) GROUP BY 1), g AS (SELECT count(*) AS n, avg(len) AS m FROM l), v AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest({_WORDS.format(t=_NORM.format(c='text'))}) AS token FROM benchmark), k AS (SELECT q.* FROM q JOIN v USING (token)), c AS (SELECT item_id, count(*) AS n FROM k GROUP BY 1),
s AS (SELECT k.item_id AS query, p.doc_id AS doc, sum(ln(1 + (g.n - v.df + 0.5) / (v.df + 0.5)) * p.tf * 2.4 / (p.tf + 1.4 * (0.28 + 0.72 * l.len / g.m))) AS score, count(*) AS hit FROM k JOIN p USING (token) JOIN v USING (token) JOIN l ON l.doc_id = p.doc_id, g GROUP BY 1, 2)
SELECT query, doc, round(score, 6) AS score, round(hit / c.n, 6) AS coverage FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS r FROM s WHERE score > 0.01) x JOIN c ON c.item_id = x.query WHERE r <= 5"""


def _bm25(d: DataFrame, b: DataFrame) -> DataFrame:
    found = retrieval.bm25_best(d, "doc_id", "text", b, "item_id", "text", k=5)
    return found.select("query", "doc", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"))


query("bm25_top", "documents benchmark", _BM25)(_bm25)
query("bm25_stemmed", "documents benchmark")(lambda d, b: retrieval.bm25_best(d, "doc_id", "text", b, "item_id", "text", k=3, fuzzy=True, stems=True))
query("chat_search", "conversations")(lambda t: retrieval.conversation_search(t, "the and of"))
query("doc_answer", "documents")(lambda t: retrieval.answer(t, "doc_id", "text", "the and of", k=3))
query("jaccard_pairs", "benchmark", f"WITH w AS (SELECT item_id, list_distinct({_WORDS.format(t=_NORM.format(c='text'))}) AS w FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS j FROM w a JOIN w b ON b.item_id = a.item_id + 1")(
    lambda t: (lambda w: w.select(F.col("item_id").alias("a"), F.col("w").alias("x")).join(w.select(F.col("item_id").alias("b"), (F.col("item_id") - 1).alias("a"), F.col("w").alias("y")), "a").select("a", "b", F.round(text.jaccard(F.col("x"), F.col("y")), 6).alias("j")))(t.select("item_id", F.array_distinct(text.words(F.col("text"))).alias("w")))
)
query("dice_names", "part", "WITH p AS (SELECT p_partkey, lower(p_name) AS n FROM part), b AS (SELECT p_partkey, unnest(list_transform(range(1, len(n)), lambda i: substr(n, i, 2))) AS g FROM p), c AS (SELECT p_partkey, g, count(*) AS k FROM b GROUP BY 1, 2), i AS (SELECT x.p_partkey, sum(least(x.k, y.k)) AS m FROM c x JOIN c y ON y.p_partkey = x.p_partkey + 1 AND x.g = y.g GROUP BY 1) SELECT a.p_partkey AS a, round(CASE WHEN a.n = b.n THEN 1 ELSE 2 * coalesce(i.m, 0) / (len(a.n) + len(b.n) - 2) END, 6)::DOUBLE AS d FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1 LEFT JOIN i ON i.p_partkey = a.p_partkey")(
    lambda t: t.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x")).join(t.select((F.col("p_partkey") - 1).alias("a"), F.col("p_name").alias("y")), "a").select("a", F.round(text.dice(F.col("x"), F.col("y")), 6).alias("d"))
)
query("edit_distance", "customer", "SELECT a.c_custkey AS a, least(levenshtein(a.c_name, b.c_name), 3)::INT AS d FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1")(lambda t: t.select(F.col("c_custkey").alias("a"), F.col("c_name").alias("x")).join(t.select((F.col("c_custkey") - 1).alias("a"), F.col("c_name").alias("y")), "a").select("a", text.edit_distance(F.col("x"), F.col("y")).alias("d")))
query("nearest_name", "nation", "WITH q AS (SELECT n_name AS name, lower(n_name) AS x FROM nation) SELECT name, name AS candidate, 1.0::DOUBLE AS score FROM q")(lambda t: lookup.nearest_name(t, "n_name", t, "n_name"))
query("keywords_top", "documents")(lambda t: retrieval.keywords(t, "doc_id", "text"))
query("summary_sentences", "documents")(lambda t: retrieval.summaries(t, "doc_id", "text"))
query("sentences", "documents")(lambda t: retrieval.sentences(t, "doc_id", "text"))
query("chunks", "documents")(lambda t: retrieval.chunked(t, "doc_id", "text"))
query("key_numbers", "documents")(lambda t: retrieval.per_text(t, "doc_id", "text", retrieval.key_numbers, "value double, raw string, label string", ["value", "raw", "label"]))

# ---- scalars and entities ----------------------------------------------------------------

query("norm_text", "documents", f"SELECT doc_id, md5({_NORM.format(c='text')}) AS h FROM documents")(lambda t: t.select("doc_id", F.md5(text.norm(F.col("text")).cast("binary")).alias("h")))
query("slugs", "part", "SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) AS s FROM part")(lambda t: t.select("p_partkey", text.slug(F.col("p_name")).alias("s")))
query("lenient_numbers", "orders", "SELECT o_orderkey, round(o_totalprice, 2) AS v FROM orders")(lambda t: t.select("o_orderkey", two(numbers.parse_number(F.concat(F.lit("R$ "), numbers.format_number(F.col("o_totalprice"), 2)))).alias("v")))
query("lenient_dates", "orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")(lambda t: t.select("o_orderkey", dates.parse_date(F.concat(F.lit("em "), dates.long_date(F.col("o_orderdate"))), day(AS_OF)).alias("d")))
query("recency_bucket", "orders", "SELECT b, count(*) AS n FROM (SELECT CASE WHEN d <= 0 THEN 'Hoje' WHEN d = 1 THEN 'Ontem' WHEN d <= 7 THEN 'Últimos 7 dias' ELSE 'Mais antigas' END AS b FROM (SELECT date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-01-01') AS d FROM orders)) GROUP BY 1")(lambda t: t.select(dates.recency(F.col("o_orderdate"), day(AS_OF)).alias("b")).groupBy("b").agg(F.count("*").alias("n")))
query("entities_emails", "documents", r"SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '[\w.+-]+@[\w-]+\.[\w.-]+'))) AS found FROM documents WHERE contains(text, '@')")(lambda t: t.where(F.contains("text", F.lit("@"))).select("doc_id", F.array_sort(entities.entities(F.col("text"), "emails")).alias("found")))
query("entities_numbers", "documents", r"SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[0-9]{1,3}(?:[.,][0-9]+)? ?%'))) AS n FROM documents")(lambda t: t.select("doc_id", F.size(entities.found(F.col("text"), r"[0-9]{1,3}(?:[.,][0-9]+)? ?%")).cast("long").alias("n")))
query("entities_all", "documents")(lambda t: t.select("doc_id", *[entities.entities(F.col("text"), k).alias(k) for k in entities.PATTERNS], entities.norm_ids(F.col("text")).alias("norms"), entities.certificate_ids(F.col("text")).alias("certificates")))
query("text_quality", "documents", r"SELECT doc_id, round(len(regexp_extract_all(text, '[A-Za-zÀ-ÿ0-9\s.,;:!?()\-/%]')) / greatest(len(text), 1), 6) AS q FROM documents")(lambda t: t.select("doc_id", F.round(text.text_quality(F.col("text")), 6).alias("q")))

# ---- classification and risk -------------------------------------------------------------

_TYPES = (classify.DocType("english", ("the", "and", "of"), ("licensed under",)), classify.DocType("german", ("der", "und", "die")), classify.DocType("french", ("le", "et", "les")), classify.DocType("spanish", ("los", "y", "que")))
_COUNT = "least(4, len(regexp_extract_all(t, '\\b{k}\\b')))"
query("doc_type_score", "documents", "WITH d AS (SELECT doc_id, ' ' || " + _NORM.format(c="text") + " || ' ' AS t, " + _NORM.format(c="substr(text, 1, 1500)") + " AS h FROM documents) " + " UNION ALL ".join(f"SELECT doc_id AS doc, '{x.name}' AS type, ({' + '.join(_COUNT.format(k=k) for k in x.keywords)}{''.join(f''' + CASE WHEN contains(h, '{s}') THEN 12 WHEN contains(t, '{s}') THEN 5 ELSE 0 END''' for s in x.strong)})::INT AS score FROM d" for x in _TYPES))(lambda t: classify.doc_type_scores(t, "doc_id", "text", _TYPES))
_RANK = ", ".join(f"'{x.name}'" for x in _TYPES)
query("doc_type", "documents", f"WITH s AS ({ORACLE_SQL['doc_type_score']}) SELECT doc, CASE WHEN score < 5 THEN 'documento' ELSE type END AS type, score FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, list_position([{_RANK}], type)) AS r FROM s) WHERE r = 1")(lambda t: classify.doc_type(classify.doc_type_scores(t, "doc_id", "text", _TYPES), [x.name for x in _TYPES]))
query("intent_rules", "conversations")(lambda t: t.select("conv_id", "turn", classify.intent(F.col("text")).alias("intent"), classify.wanted_format(F.col("text")).alias("format")))
query("risk_matrix", "part", "SELECT p_partkey, CASE WHEN p * s >= 20 THEN 'Crítico' WHEN p * s >= 10 THEN 'Alto' WHEN p * s >= 5 THEN 'Moderado' ELSE 'Baixo' END AS level, greatest(1, p - CASE WHEN s >= 5 THEN 2 ELSE 1 END)::INT AS residual FROM (SELECT p_partkey, p_size % 5 + 1 AS p, p_size // 5 % 5 + 1 AS s FROM part)")(
    lambda t: (lambda p, s: t.select("p_partkey", risk.risk_level(p, s).alias("level"), risk.residual_probability(p, s).cast("int").alias("residual")))(F.col("p_size") % 5 + 1, F.floor(F.col("p_size") / 5) % 5 + 1)
)
query("hazard_topk", "part", "SELECT p_brand, p_partkey, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY (p_size % 5 + 1) * (p_size // 5 % 5 + 1) DESC, p_partkey) AS r FROM part) WHERE r <= 3")(lambda t: lookup.top_per_group(t, ["p_brand"], [((F.col("p_size") % 5 + 1) * (F.floor(F.col("p_size") / 5) % 5 + 1)).desc(), F.asc("p_partkey")], 3).select("p_brand", "p_partkey", "rank"))
query("noise_minutes", "part", "SELECT p_partkey, CASE WHEN l < 85 THEN NULL WHEN l = 97 THEN floor(480 / pow(2, (97 - 85) / 5) + 0.5) ELSE 480 END::DOUBLE AS m FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 80 WHEN 1 THEN 85 ELSE 97 END AS l FROM part)")(lambda t: t.select("p_partkey", risk.noise_minutes(F.when(F.col("p_size") % 3 == 0, 80.0).when(F.col("p_size") % 3 == 1, 85.0).otherwise(97.0)).alias("m")))



def _hazards(t: DataFrame) -> DataFrame:
    """Hazards made of parts: brand as activity, type as stage, name as hazard."""
    return t.select(F.col("p_brand").alias("activity"), F.col("p_type").alias("stage"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("hazard"), (F.col("p_size") % 5 + 1).alias("p"), (F.floor(F.col("p_size") / 5) % 5 + 1).alias("s"), F.split("p_name", " ").alias("controls"))


_HAZARDS = "(SELECT p_brand AS activity, p_type AS stage, p_name || ' ' || p_partkey AS hazard, p_size % 5 + 1 AS p, p_size // 5 % 5 + 1 AS s FROM part)"
query("report_analysis", "part", f"SELECT hazard, (p * s)::INT AS score, (greatest(1, p - CASE WHEN s >= 5 THEN 2 ELSE 1 END) * s)::INT AS residual FROM {_HAZARDS} WHERE p * s >= 10")(lambda t: reports.risk_analysis(_hazards(t), short=True).select("hazard", F.col("score").cast("int").alias("score"), F.col("residual").cast("int").alias("residual")))
query("report_permit", "part", f"SELECT activity, hazard, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY activity ORDER BY p * s DESC, hazard) AS r FROM {_HAZARDS} WHERE p * s >= 8) WHERE r <= 8")(lambda t: reports.top_hazards(_hazards(t), 8, 8).select("activity", "hazard", "rank"))
query("report_plan", "part", f"SELECT activity, hazard, r::INT AS rank, CASE WHEN p * s >= 20 THEN 1 ELSE 7 END AS days FROM (SELECT *, row_number() OVER (PARTITION BY activity ORDER BY p * s DESC, hazard) AS r FROM {_HAZARDS} WHERE p * s >= 10) WHERE r <= 10")(lambda t: reports.action_plan(_hazards(t)).select("activity", "hazard", "rank", "days"))
query("report_procedure", "part", "WITH e AS (SELECT p_brand AS activity, p_type AS stage, (p_size % 5 + 1) * (p_size // 5 % 5 + 1) AS score, unnest(string_split(p_name, ' ')) AS control, unnest(range(len(string_split(p_name, ' ')))) AS k FROM part), b AS (SELECT *, row_number() OVER (PARTITION BY activity, stage, control ORDER BY score DESC, k) AS r FROM e), f AS (SELECT activity, stage, control, row_number() OVER (PARTITION BY activity, stage ORDER BY score DESC, k, control) AS position FROM b WHERE r = 1) SELECT activity, stage, position::INT AS position, control FROM f WHERE position <= 3")(lambda t: reports.procedure(_hazards(t)))
_KIND = "CASE " + " ".join(f"WHEN regexp_matches({_NORM.format(c='h.hazard')}, '{r.pattern}') THEN '{r.result}'" for r in reports.HAZARD_CLASSES) + " ELSE 'acidente' END"
query("report_inventory", "part", f"SELECT h.activity, h.hazard, {_KIND} AS kind, CASE WHEN p * s >= 20 THEN 'Crítico' WHEN p * s >= 10 THEN 'Alto' WHEN p * s >= 5 THEN 'Moderado' ELSE 'Baixo' END AS level FROM {_HAZARDS} h JOIN (SELECT DISTINCT p_brand AS activity FROM part) a ON a.activity = h.activity")(lambda t: reports.inventory(t.select(F.col("p_brand").alias("activity")).distinct(), _hazards(t)))

_ACTIVITIES = (("english", ("the", "and")), ("french", ("les", "est")), ("german", ("der", "und")), ("spanish", ("los", "que")))
_FOUND = " UNION ALL ".join(f"SELECT doc, '{a}' AS activity, greatest({', '.join(f"CASE WHEN contains(t, ' {w} ') THEN {len(w)} ELSE 0 END" for w in terms)}) AS score FROM p" for a, terms in _ACTIVITIES)
query("activities_found", "documents", f"WITH p AS (SELECT doc_id AS doc, ' ' || trim(regexp_replace({_NORM.format(c='text')}, '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents), f AS ({_FOUND}), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, activity) AS rank, max(score) OVER (PARTITION BY doc) AS top FROM f WHERE score > 0) SELECT doc, rank::INT AS rank, activity, score::INT AS score FROM r WHERE (rank = 1 OR score >= least(6, top * 0.5)) AND rank <= 3")(
    lambda t: knowledge.find_activities(t, "doc_id", "text", t.sparkSession.createDataFrame([(a, "activity of " + a, list(w)) for a, w in _ACTIVITIES], "activity string, name string, terms array<string>"))
)
query("dates_found", "documents")(lambda t: t.select("doc_id", F.explode(entities.dates_in(F.col("text"), day(AS_OF))).alias("d")).select("doc_id", "d.date", "d.raw", "d.context"))
query("widgets_asked", "conversations")(lambda t: t.select("conv_id", "turn", request.widget(F.col("text"), day(AS_OF)).alias("w")).select("conv_id", "turn", "w.type", "w.kind", "w.by", "w.value"))

# ---- web pages ---------------------------------------------------------------------------

query("html_main", "pages")(lambda t: web.main_content(t, "page_id", "html"))
query("html_links", "pages", r"""SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a [^>]*href="([^"]+)"', 1))) AS n FROM pages""")(lambda t: web.links(t, "page_id", "html").groupBy("page_id").agg(F.count_distinct("href").alias("n")).join(t.select("page_id"), "page_id", "right").select("page_id", F.coalesce("n", F.lit(0)).alias("n")))
query("html_tables", "pages")(lambda t: web.tables(t, "page_id", "html"))

# ---- event time --------------------------------------------------------------------------

query("stream_tumbling", "events", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")(lambda t: state.tumbling(t).withColumn("total", F.round("total", 4)))
query("stream_sliding", "events", "SELECT s AS start, s + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM (SELECT ts, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 5 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS s FROM events) GROUP BY 1")(state.sliding)
query("stream_session", "events", "WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")(state.sessions)
query("stream_dedup", "events", "SELECT event_id FROM events GROUP BY 1")(lambda t: state.without_repeats(t).select("event_id"))

# ---- memory, changes, refreshes, exports --------------------------------------------------

query("kpi_fixed", "region", "SELECT 42.5::DOUBLE AS value, 'dias' AS unit, -1.5::DOUBLE AS delta")(lambda t: resolve.fixed_kpi(t.sparkSession, 42.5, "dias", -1.5))
query("bar_kind", "part", "SELECT CASE WHEN count(*) > 8 AND max(len(label)) > 10 THEN 'hbar' ELSE 'bar' END AS kind FROM (SELECT DISTINCT p_type AS label FROM part)")(lambda t: resolve.bar_kind(t.groupBy(F.col("p_type").alias("label")).agg(F.count("*").alias("v1"))))
query("refreshed_rows", "nation customer", 'SELECT n_name AS dataset, c_custkey AS "row", c_name AS name, c_mktsegment AS segment, \'\' AS lacking FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_custkey > 0')(
    lambda n, c: web.refreshed_rows(n.select(F.col("n_name").alias("dataset"), F.col("n_nationkey").alias("source"), F.lit(0).alias("tbl"), F.lit(3).alias("width")), c.select(F.col("c_nationkey").alias("source"), F.lit(0).alias("tbl"), F.col("c_custkey").alias("row"), F.array("c_name", "c_mktsegment").alias("cells"))).select("dataset", "row", *[F.col("cells")[k].alias(x) for k, x in enumerate(("name", "segment", "lacking"))])
)
query("preferred", "events", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2) WHERE r = 1 AND n >= 2")(lambda t: memory.preferred(t, "user_id", "event_type"))
query("preferred_detail", "events", "SELECT user_id, CASE WHEN s >= 3 AND s > f * 1.5 THEN 'view' WHEN f >= 3 AND f > s * 1.5 THEN 'click' END AS event_type FROM (SELECT user_id, count(*) FILTER (event_type = 'view') AS s, count(*) FILTER (event_type = 'click') AS f FROM events GROUP BY 1)")(lambda t: memory.preferred_detail(t, "user_id", "event_type", "view", "click"))
_SAID = _WORDS.format(t=_NORM.format(c="text"))
query("disliked", "conversations", f"WITH a AS (SELECT conv_id, turn, role, list_distinct({_SAID}) AS w FROM conversations), n AS (SELECT role, list_distinct({_SAID}) AS b FROM (SELECT * FROM conversations ORDER BY turn DESC, text, role LIMIT 200)) SELECT conv_id, turn FROM a WHERE EXISTS (SELECT 1 FROM n WHERE n.role = a.role AND len(list_intersect(a.w, n.b)) > 0.8 * (len(a.w) + len(n.b) - len(list_intersect(a.w, n.b))))")(
    lambda t: memory.disliked(t.withColumnRenamed("role", "intent"), t.select(F.col("role").alias("intent"), "text", F.col("turn").alias("at"))).select("conv_id", "turn")
)
query("facts_recalled", "benchmark conversations")(lambda b, c: memory.recalled(b, "item_id", "text", c.select(F.concat_ws("-", "conv_id", "turn").alias("said"), "text"), "said", "text"))
query("edits_asked", "conversations")(lambda t: t.select("conv_id", "turn", edit.edit(F.col("text")).alias("e")).select("conv_id", "turn", "e.*"))
query("conversation_markdown", "conversations", "SELECT conv_id, string_agg(line, chr(10) || chr(10) ORDER BY turn, line) AS markdown FROM (SELECT conv_id, turn, '## ' || coalesce(role, '?') || chr(10) || chr(10) || coalesce(text, '') AS line FROM conversations) GROUP BY 1")(sinks.conversation_markdown)
query("state_round_trip", "customer", "SELECT c_custkey, c_name, c_mktsegment, 'pt' AS language FROM customer")(lambda t: sinks.import_state(sinks.export_state(t.select("c_custkey", "c_name", "c_mktsegment")), "c_custkey long, c_name string, c_mktsegment string, language string", {"language": "pt"}))


from . import queries_guide, queries_live  # noqa: E402, F401 - register further queries
