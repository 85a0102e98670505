"""Named queries over changing data, totals, order and sketches, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import catalog
from .operators import locale, order, sketch
from .plans import ask, oplog, totals
from .plans.spec import Chart, Filter, Kpi
from .queries import AS_OF, day, query
from .scratch import shared_folder
from .sources import sinks
from .sources.fetch import fetched, from_table
from .streaming import joins, quiet, views
from .streaming.kv import KeyValue

# ---- widgets that follow changes ----------------------------------------------------------
# Orders come in two batches: all of them, then each of status P goes and comes again at twice its price as status F.

_VIEWS = {
    "total": views.View("orders", Kpi("sum", "o_totalprice")),
    "open": views.View("orders", Kpi("count", filter=Filter("o_orderstatus", "eq", "O"))),
    "average": views.View("orders", Kpi("avg", "o_totalprice")),
    "largest": views.View("orders", Kpi("max", "o_totalprice")),
    "smallest": views.View("orders", Kpi("min", "o_totalprice", Filter("o_orderstatus", "eq", "F"))),
    "status": views.View("orders", Chart("o_orderstatus", ("o_totalprice",))),
    "months": views.View("orders", Chart("o_orderdate", ("o_totalprice",), group_date="month")),
    "priority": views.View("orders", Chart("o_orderpriority", agg="count", top=3)),
}
_NOW = "(SELECT o_orderdate, o_orderpriority, CASE o_orderstatus WHEN 'P' THEN 'F' ELSE o_orderstatus END AS s, CASE o_orderstatus WHEN 'P' THEN 2 ELSE 1 END * o_totalprice AS p FROM orders)"


def _changed(orders: DataFrame) -> DataFrame:
    """Partial aggregates of all orders, brought up to date by the batch of changes."""
    turned = orders.where("o_orderstatus = 'P'")
    again = turned.withColumn("o_totalprice", F.col("o_totalprice") * 2).withColumn("o_orderstatus", F.lit("F"))
    delta = turned.withColumn(views.SIGN, F.lit(-1)).unionByName(again.withColumn(views.SIGN, F.lit(1)))
    return views.merged(views.partials(orders, _VIEWS, day(AS_OF)), views.partials(delta, _VIEWS, day(AS_OF)))


@query(
    "live_kpis",
    "orders",
    f"""SELECT 'total' AS name, round(sum(p), 2) AS value FROM {_NOW} UNION ALL SELECT 'open', count(*) FILTER (s = 'O') FROM {_NOW}
    UNION ALL SELECT 'average', round(avg(p), 2) FROM {_NOW} UNION ALL SELECT 'largest', round(max(p), 2) FROM {_NOW}
    UNION ALL SELECT 'smallest', round(min(p) FILTER (s = 'F'), 2) FROM {_NOW}""",
)
def _live_kpis(t: DataFrame) -> DataFrame:
    now, out = _changed(t), None
    for name in ("total", "open", "average", "largest", "smallest"):
        row = views.shown(now, name, _VIEWS[name]).select(F.lit(name).alias("name"), F.round("value", 2).alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


query(
    "live_chart",
    "orders",
    f"SELECT s AS label, round(sum(p), 2) AS v1, row_number() OVER (ORDER BY sum(p) DESC)::INT AS position FROM {_NOW} GROUP BY 1",
)(lambda t: views.shown(_changed(t), "status", _VIEWS["status"]).withColumn("v1", F.round("v1", 2)))
query("live_months", "orders", f"SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum(p), 2) AS v1 FROM {_NOW} GROUP BY 1")(
    lambda t: views.shown(_changed(t), "months", _VIEWS["months"]).select("month", F.round("v1", 2).alias("v1"))
)
query(
    "live_top",
    "orders",
    """WITH g AS (SELECT o_orderpriority AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY 1)
    SELECT CASE WHEN r <= 2 THEN label ELSE 'Outros' END AS label, sum(n)::DOUBLE AS v1, min(r)::INT AS position FROM g GROUP BY 1""",
)(lambda t: views.shown(_changed(t), "priority", _VIEWS["priority"]))

# ---- bursts, streams joined, late rows ----------------------------------------------------

query(
    "bursts",
    "events",
    """WITH g AS (SELECT user_id, ts, event_type, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT CAST(user_id AS VARCHAR) AS key, min(ts) AS first, max(ts) AS last, count(*) AS n, arg_max(event_type, (ts, event_type)) AS newest FROM s GROUP BY user_id, k""",
)(lambda t: quiet.debounced(t, "user_id", "ts", "event_type", "6 hours"))
query(
    "joined_in_time",
    "events",
    """SELECT a.event_id AS viewed, b.event_id AS clicked FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click'
    AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 DAY""",
)(
    lambda t: joins.joined_in_time(t.where("event_type = 'view'"), t.where("event_type = 'click'"), "user_id", "ts", "1 day").select(
        F.col("event_id").alias("viewed"), F.col("right_event_id").alias("clicked")
    )
)
query(
    "late_rows",
    "events",
    """WITH e AS (SELECT event_id, ts, (event_id * 7919) % 97 AS b FROM events), m AS (SELECT b, max(ts) AS x FROM e GROUP BY 1), p AS (SELECT b, max(x) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM m)
    SELECT event_id, coalesce(ts < mark - INTERVAL 10 DAY, false) AS is_late FROM e JOIN p USING (b)""",
)(lambda t: joins.by_arrival(t.withColumn("b", (F.col("event_id") * 7919) % 97), "b", "ts", "10 days").select("event_id", "is_late"))

# ---- global order -------------------------------------------------------------------------

_PLACES = "ORDER BY o_totalprice, o_orderkey"
query(
    "order_places",
    "orders",
    f"""SELECT o_orderkey, row_number() OVER w AS row_number, ntile(10) OVER w AS ntile, round(percent_rank() OVER w, 9) AS percent_rank, round(cume_dist() OVER w, 9) AS cume_dist
    FROM orders WINDOW w AS ({_PLACES})""",
)(
    lambda t: order.placed_among(t.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], tiles=10).select(
        "o_orderkey", "row_number", "ntile", F.round("percent_rank", 9).alias("percent_rank"), F.round("cume_dist", 9).alias("cume_dist")
    )
)
query(
    "order_ranks",
    "lineitem",
    "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) AS rank FROM lineitem",
)(lambda t: order.ranked(t.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), [("l_quantity", "desc")], ["l_returnflag"], ties=True).drop("l_returnflag", "l_quantity"))
query(
    "range_frames",
    "orders",
    """SELECT o_orderkey, count(*) OVER w AS n, round(sum(o_totalprice) OVER w, 2) AS total, round(first_value(d) OVER w, 0) AS first FROM
    (SELECT *, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE))::DOUBLE AS d FROM orders) WINDOW w AS (ORDER BY d RANGE BETWEEN 7 PRECEDING AND CURRENT ROW)""",
)(
    lambda t: order.over_range(
        t.select("o_orderkey", "o_totalprice", F.datediff(F.col("o_orderdate").cast("date"), day("1990-01-01")).cast("double").alias("d")),
        "d",
        7,
        {"n": "count(*)", "total": "sum(o_totalprice)", "first": "first_value(d)"},
    ).select("o_orderkey", "n", F.round("total", 2).alias("total"), "first")
)

# ---- totals and cross tables --------------------------------------------------------------

_SUMS = "grouping_id({k})::BIGINT AS level, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem"
_SHOW = ", ".join(f"CASE WHEN grouping({c}) = 1 THEN 'Total' ELSE CAST({c} AS VARCHAR) END AS {c}" for c in ("l_returnflag", "l_linestatus", "l_linenumber"))
_KEYS = "l_returnflag, l_linestatus, l_linenumber"


def _measures() -> dict:
    return {"n": F.count("*"), "total": F.round(F.sum("l_extendedprice"), 2)}


query("totals_rollup", "lineitem", f"SELECT {_SHOW}, {_SUMS.format(k=_KEYS)} GROUP BY ROLLUP ({_KEYS})")(lambda t: totals.with_totals(t, _KEYS.split(", "), _measures()))
query("totals_cube", "lineitem", f"SELECT {_SHOW}, {_SUMS.format(k=_KEYS)} GROUP BY CUBE ({_KEYS})")(lambda t: totals.with_totals(t, _KEYS.split(", "), _measures(), "cube"))
query("totals_sets", "lineitem", f"SELECT {_SHOW}, {_SUMS.format(k=_KEYS)} GROUP BY GROUPING SETS ((l_returnflag, l_linenumber), (l_linestatus), ())")(
    lambda t: totals.with_totals(t, _KEYS.split(", "), _measures(), [["l_returnflag", "l_linenumber"], ["l_linestatus"], []])
)
query(
    "pivot_status",
    "orders",
    """SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS "F", round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS "O",
    round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS "P", round(sum(o_totalprice), 2) AS "Total" FROM orders GROUP BY 1""",
)(lambda t: totals.pivoted(t, "o_orderpriority", "o_orderstatus", F.col("o_totalprice"), lambda c: F.round(F.sum(c), 2)))

# ---- quantiles and sketches ---------------------------------------------------------------

query(
    "quantiles_exact",
    "lineitem",
    """SELECT l_returnflag, q, round(CASE q WHEN 0.1 THEN a[1] WHEN 0.5 THEN a[2] ELSE a[3] END, 4) AS value FROM
    (SELECT l_returnflag, quantile_cont(l_extendedprice::DOUBLE, [0.1, 0.5, 0.95]) AS a FROM lineitem GROUP BY 1), (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE)) v(q)""",
)(lambda t: sketch.exact_quantiles(t, "l_extendedprice", [0.1, 0.5, 0.95], ["l_returnflag"]).withColumn("value", F.round("value", 4)))
query(
    "quantiles_sketch",
    "orders",
    """WITH s AS (SELECT year(o_orderdate) AS y, ceil(ln(o_totalprice / 1e-9::DOUBLE) / ln(1.01::DOUBLE / 0.99))::INT AS b, count(*) AS n FROM orders GROUP BY 1, 2),
    c AS (SELECT y, b, sum(n) OVER (PARTITION BY y ORDER BY b) AS u, sum(n) OVER (PARTITION BY y) AS a FROM s)
    SELECT y, q, round(1e-9::DOUBLE * pow(1.01::DOUBLE / 0.99, min(b)) * 2 / (1 + 1.01::DOUBLE / 0.99), 0) AS value FROM c, (VALUES (0.5::DOUBLE), (0.9::DOUBLE)) v(q) WHERE u >= floor((a - 1) * q) + 1 GROUP BY 1, 2""",
)(
    lambda t: sketch.quantiles(
        sketch.quantile_sketch(t.select(F.year("o_orderdate").cast("long").alias("y"), F.to_date("o_orderdate").alias("d"), "o_totalprice"), "o_totalprice", ["y", "d"]), [0.5, 0.9], ["y"]
    ).withColumn("value", F.round("value", 0))
)
query("spread", "events", "SELECT event_type, round(stddev_samp(value), 6) AS deviation, round(median(value), 6) AS middle, count(DISTINCT user_id) AS users FROM events GROUP BY 1")(
    lambda t: t.groupBy("event_type")
    .agg(F.round(F.stddev("value"), 6).alias("deviation"), F.count_distinct("user_id").alias("users"))
    .join(sketch.exact_quantiles(t, "value", [0.5], ["event_type"]).select("event_type", F.round("value", 6).alias("middle")), "event_type")
)
query("distinct_near", "events", "SELECT event_type, true AS near FROM events GROUP BY 1")(
    lambda t: sketch.distinct_of(sketch.distinct_sketch(t.withColumn("d", F.to_date("ts")), "user_id", ["event_type", "d"]), ["event_type"])
    .join(t.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact")), "event_type")
    .select("event_type", (F.abs(F.col("n") - F.col("exact")) <= 0.06 * F.col("exact")).alias("near"))
)

# ---- op log: deletions and snapshots ------------------------------------------------------

_OPS = """SELECT user_id AS dataset, event_id AS seq, CASE event_type WHEN 'signup' THEN 'set_rows' WHEN 'view' THEN 'add_rows' WHEN 'click' THEN 'add_rows' ELSE 'delete_row' END AS op,
  event_id % 7 AS "row" FROM events"""
_STATE = f"""WITH l AS ({_OPS}), m AS (SELECT dataset, max(seq) AS s FROM l WHERE op = 'set_rows' GROUP BY 1), g AS (SELECT dataset, "row", max(seq) AS s FROM l WHERE op = 'delete_row' GROUP BY 1, 2)
SELECT l.dataset, l.seq FROM l JOIN m USING (dataset) LEFT JOIN g ON g.dataset = l.dataset AND g."row" = l."row"
WHERE (l.op = 'set_rows' AND l.seq = m.s OR l.op = 'add_rows' AND l.seq > m.s) AND coalesce(g.s, -1) < l.seq"""


def _ops(t: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "set_rows").when(F.col("event_type").isin("view", "click"), "add_rows").otherwise("delete_row")
    return t.select(F.col("user_id").alias("dataset"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("event_id") % 7).alias("row"))


def _by_snapshots(t: DataFrame) -> DataFrame:
    """The state through snapshots at thirds of the log, each made from the one before, and the tail after the last."""
    log = _ops(t)
    ends = log.agg(F.min("seq"), F.max("seq")).first()
    low, high = ends[0] or 0, ends[1] or 0
    cuts = [low + (high - low) // 3, low + 2 * (high - low) // 3]
    first = oplog.snapshot(log.where(F.col("seq") <= cuts[0]))
    second = oplog.snapshot(log.where((F.col("seq") > cuts[0]) & (F.col("seq") <= cuts[1])), first)
    return oplog.from_snapshot(second, log.where(F.col("seq") > cuts[1])).select("dataset", "seq")


query("state_rows", "events", _STATE)(lambda t: oplog.state_rows(_ops(t)).select("dataset", "seq"))
query("state_by_snapshots", "events", _STATE)(_by_snapshots)





# ---- stores, fetchers, sinks, language order ------------------------------------------------


def _kv(t: DataFrame) -> DataFrame:
    """Events as changes of users' rows in four batches, compacted after the second and the last."""
    spark = t.sparkSession
    rows = t.select("user_id", "event_id", "event_type", "value", (F.col("event_type") == "purchase").alias("deleted"))
    store = KeyValue(spark, f"{shared_folder(spark)}/kv-{uuid.uuid4().hex}", "user_id long, event_id long, event_type string, value double, deleted boolean", "user_id", "event_id", base=10)
    low, high = t.agg(F.min("event_id"), F.max("event_id")).first()
    step = max(1, ((high or 0) - (low or 0)) // 4 + 1)
    for k in range(4):
        store.write()(rows.where(F.floor((F.col("event_id") - F.lit(low or 0)) / step) == k), k)
        if k in (1, 3):
            store.compact()
    return store.state()


query(
    "kv_compacted",
    "events",
    "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'purchase'",
)(_kv)


def _fetched(t: DataFrame) -> DataFrame:
    """Each page's address and a wrong one: first from pages with an article element, then from all."""
    urls = t.select("url").unionByName(t.select(F.concat("url", F.lit("?missing")).alias("url")))
    chain = [("articles", from_table(t.where(F.contains("html", F.lit("<article"))), "url", "html")), ("all pages", from_table(t, "url", "html"))]
    return fetched(urls, chain).select("url", F.length("text").cast("long").alias("n"), "via", F.array_join("errors", "; ").alias("errors"))


query(
    "fetched_pages",
    "pages",
    """WITH p AS (SELECT url, max(html) AS html, max(html) FILTER (contains(html, '<article')) AS art FROM pages WHERE url IS NOT NULL GROUP BY 1)
    SELECT url, CASE WHEN length(art) >= 20 THEN length(art) WHEN length(html) >= 20 THEN length(html) END AS n, CASE WHEN length(art) >= 20 THEN 'articles' WHEN length(html) >= 20 THEN 'all pages' END AS via,
    CASE WHEN length(art) >= 20 THEN '' WHEN art IS NULL THEN 'articles: not stored' ELSE 'articles: empty answer' END || CASE WHEN coalesce(length(art), 0) >= 20 OR length(html) >= 20 THEN '' ELSE '; all pages: empty answer' END AS errors FROM p
    UNION ALL SELECT url || '?missing', NULL, NULL, 'articles: not stored; all pages: not stored' FROM p""",
)(_fetched)


def _csv(t: DataFrame) -> DataFrame:
    path = f"{shared_folder(t.sparkSession)}/csv-{uuid.uuid4().hex}"
    sinks.write_ordered_csv(t.select("conv_id", "turn", "role", "text"), path, ["conv_id", "turn"])
    return sinks.read_ordered_csv(t.sparkSession, path, "conv_id long, turn long, role string, text string").withColumn("text", F.md5(F.col("text").cast("binary")))


query("csv_round_trip", "conversations", "SELECT conv_id, turn, role, md5(nullif(text, '')) AS text FROM conversations")(_csv)
query(
    "locale_order",
    "conversations",
    """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+')) AS word FROM conversations)
    SELECT word, row_number() OVER (ORDER BY word COLLATE pt, word) AS place FROM w""",
)(
    lambda t: order.ranked(
        t.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-zÀ-ÖØ-öø-ÿ]+)"))).alias("word")).distinct(), [locale.collated(F.col("word")), "word"], name="place"
    )
)
query(
    "locale_groups",
    "conversations",
    """WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+')) AS word FROM conversations) SELECT min(word) AS word, count(*) AS n FROM w
    GROUP BY replace(replace(translate(lower(strip_accents(word)), 'øð', 'od'), 'æ', 'ae'), 'ß', 'ss')""",
)(lambda t: locale.groups(t.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-zÀ-ÖØ-öø-ÿ]+)"))).alias("word")), "word", {"n": F.count("*")}))


def _chunk_rows(t: DataFrame) -> DataFrame:
    catalog.register(t.sparkSession)
    return t.sparkSession.sql("SELECT d.doc_id, c.start, c.chunk FROM {docs} d, LATERAL chunk_text(d.text, 650) c", docs=t)


query("chunk_function", "documents")(_chunk_rows)

# ---- requests that end in rules -------------------------------------------------------------


def _catalog(t: DataFrame) -> DataFrame:
    """The columns of orders under the names that people say."""
    kinds = {"o_orderdate": "date", "o_totalprice": "number", "o_orderstatus": "text", "o_orderpriority": "text"}
    rows = [("orders", c.removeprefix("o_"), k, n) for n, (c, k) in enumerate(kinds.items())]
    return t.sparkSession.createDataFrame(rows, "dataset string, column string, type string, position int")


def _requests(t: DataFrame) -> DataFrame:
    """A request for each order: what is asked for follows its status, priority and key; some names have typing errors."""
    by = F.when(F.col("o_orderstatus") == "F", "orderdate").when(F.col("o_orderstatus") == "O", "orderpriorit").otherwise("orderstaus")
    kind = F.when(F.col("o_orderkey") % 3 == 0, "de pizza ").when(F.col("o_orderkey") % 3 == 1, "de barras ").otherwise("")
    subject = F.when(F.col("o_orderkey") % 2 == 0, "total price").otherwise("pedidos")
    return t.select("o_orderkey", F.concat(F.lit("Crie um gráfico "), kind, F.lit("de "), subject, F.lit(" por "), by).alias("text"))


query(
    "charts_asked",
    "orders",
    """SELECT o_orderkey, 'orders' AS dataset, CASE o_orderstatus WHEN 'F' THEN 'orderdate' WHEN 'O' THEN 'orderpriority' ELSE 'orderstatus' END AS x,
    CASE WHEN o_orderkey % 2 = 0 THEN 'totalprice' END AS y, CASE WHEN o_orderkey % 2 = 0 THEN 'sum' ELSE 'count' END AS agg,
    CASE WHEN o_orderkey % 3 = 0 THEN 'donut' WHEN o_orderstatus = 'F' THEN 'line' ELSE 'bar' END AS kind, CASE WHEN o_orderstatus = 'F' THEN 'month' END AS group_date FROM orders""",
)(lambda t: ask.charts_asked(_requests(t), "o_orderkey", "text", _catalog(t), day(AS_OF)))
query(
    "changes_asked",
    "nation",
    """SELECT n_nationkey, 0 AS step, 'rename_tab' AS op, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 1, 'set_columns', CAST(n_nationkey % 4 + 1 AS VARCHAR) FROM nation
    UNION ALL SELECT n_nationkey, 3, 'set_theme', CASE WHEN n_nationkey % 2 = 0 THEN 'dark' ELSE 'light' END FROM nation""",
)(
    lambda t: ask.changes_asked(
        t.select(
            "n_nationkey",
            F.concat(
                F.lit("Renomeie a aba para "), "n_name", F.lit("; use "), (F.col("n_nationkey") % 4 + 1).cast("string"), F.lit(" colunas; obrigado e depois tema "),
                F.when(F.col("n_nationkey") % 2 == 0, "escuro").otherwise("claro"),
            ).alias("text"),
        ),
        "n_nationkey",
        "text",
    ).select("n_nationkey", "step", "op", "value")
)
