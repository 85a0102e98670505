"""Widgets that follow changes, bursts, streams joined in time and late rows: started streams against batch results."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sparkboard.operators import sketch
from sparkboard.plans import oplog, resolve, totals
from sparkboard.plans.spec import Chart, Filter, Kpi, SpecError
from sparkboard.streaming import joins, quiet, state, views

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
SALES = "id long, region string, day date, amount double, _sign int"


def at(hour, minute=0, day=1):
    return datetime.datetime(2024, 1, day, hour, minute)


def plain(df):
    return sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.collect())


VIEWS = {
    "sum": views.View("sales", Kpi("sum", "amount")),
    "avg": views.View("sales", Kpi("avg", "amount", Filter("region", "neq", "south"))),
    "count": views.View("sales", Kpi("count", filter=Filter("amount", "gt", 5))),
    "min": views.View("sales", Kpi("min", "amount")),
    "max": views.View("sales", Kpi("max", "amount")),
    "expired": views.View("sales", Kpi(validity="day", status="vencido")),
    "chart": views.View("sales", Chart("region", ("amount",))),
    "counts": views.View("sales", Chart("region", agg="count", top=2)),
    "months": views.View("sales", Chart("day", ("amount",), group_date="month")),
    "validity": views.View("sales", Chart(validity="day")),
    "other": views.View("stock", Kpi("count")),
}


def recomputed(rows, name):
    rule, as_of = VIEWS[name].rule, F.lit("2024-03-01").cast("date")
    return resolve.kpi(rows, rule, as_of) if isinstance(rule, Kpi) else resolve.chart(rows, rule, as_of)


def test_widgets_equal_a_full_recompute_after_each_batch(spark, tmp_path):
    rng, rows, path = random.Random(3), [], str(tmp_path / "changes")
    board = views.Board(spark, str(tmp_path / "board"), VIEWS, F.lit("2024-03-01").cast("date"))
    assert board.show("count").first().value == 0 and board.show("chart").count() == 0
    read = []

    def counted(batch, number):
        read.append(batch.count())
        board.refresh("sales")(batch, number)
        if number == 1:
            board.refresh("sales")(batch, number)  # the batch runs again

    for step in range(3):
        gone = rng.sample(rows, len(rows) // 3)
        new = [(100 * step + k, rng.choice(["north", "south", " east ", None, ""]), datetime.date(2024, rng.randint(1, 5), 3), rng.choice([None, float(rng.randint(-3, 20))])) for k in range(12)]
        rows = [r for r in rows if r not in gone] + new
        spark.createDataFrame([(*r, 1) for r in new] + [(*r, -1) for r in gone], SALES).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(SALES).parquet(path).writeStream.foreachBatch(counted)
        stream.option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()  # a restart each time
        now = spark.createDataFrame(rows, SALES.rpartition(",")[0])
        for name in VIEWS:
            if name != "other":
                assert plain(board.show(name)) == plain(recomputed(now, name)), (step, name)
        assert read[-1] == len(new) + len(gone)  # what was read follows the changes
    assert len(list((tmp_path / "board" / "sales").glob("version-*"))) == 2
    with pytest.raises(SpecError):
        views.View("sales", Kpi("last", "amount", order_by=("id",)))


def test_nothing_is_left_when_all_rows_go(spark):
    rows = spark.createDataFrame([(1, "a", datetime.date(2024, 1, 1), 2.0), (1, "a", datetime.date(2024, 1, 1), 2.0)], SALES.rpartition(",")[0])
    own = {n: v for n, v in VIEWS.items() if v.dataset == "sales"}
    now = views.merged(views.partials(rows, own, F.lit("2024-03-01").cast("date")), views.partials(rows.withColumn("_sign", F.lit(-1)), own, F.lit("2024-03-01").cast("date")))
    assert now.count() == 0


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def test_one_row_for_each_burst_over_a_restart(spark, rocks, tmp_path):
    path, out, mark = (str(tmp_path / n) for n in ("events", "out", "mark"))

    def step(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = quiet.debounced(state.read_events(spark, path), "user_id", "ts", "event_type", "10 minutes")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    step([(1, at(1, 0), 1, "a", 1.0), (2, at(1, 4), 1, "b", 1.0), (3, at(1, 1), 2, "x", 1.0)])
    step([(4, at(1, 9), 1, "c", 1.0), (5, at(1, 12), 2, "y", 1.0)])  # user 1 goes on; user 2 was quiet for 11 minutes
    step([(6, at(3, 0), 3, "z", 1.0)])
    step([(7, at(9, 0), 4, "end", 1.0)])
    events = spark.read.parquet(path)
    got = spark.read.parquet(out)
    want = quiet.debounced(events.where("user_id < 4"), "user_id", "ts", "event_type", "10 minutes")
    assert plain(got.select(sorted(got.columns))) == plain(want.select(sorted(want.columns)))
    assert {(r.key, r.n, r.newest) for r in got.collect()} == {("1", 3, "c"), ("2", 1, "x"), ("2", 1, "y"), ("3", 1, "z")}
    assert quiet.debounced(events.limit(0), "user_id", "ts", "event_type").count() == 0


def test_streams_joined_in_time(spark, tmp_path):
    path, out, mark = (str(tmp_path / n) for n in ("events", "out", "mark"))

    def joined(events):
        pairs = joins.joined_in_time(events.where("event_type = 'view'"), events.where("event_type = 'click'"), "user_id", "ts", "30 minutes", "1 hour")
        return pairs.select("event_id", "right_event_id")

    batches = [
        [(1, at(1), 1, "view", 1.0), (2, at(1, 10), 1, "click", 1.0), (3, at(1, 20), 2, "view", 1.0)],
        [(4, at(1, 40), 2, "click", 1.0), (5, at(1, 55), 1, "click", 1.0), (6, at(2), 1, "view", 1.0)],  # 4 meets a view of the batch before
        [(7, at(2, 30), 1, "click", 1.0), (8, at(2, 31), 1, "click", 1.0), (9, at(1, 45), None, "click", 1.0)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = joined(state.read_events(spark, path)).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark)
        stream.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert plain(spark.read.parquet(out)) == plain(joined(spark.read.parquet(path)))
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == {(1, 2), (3, 4), (6, 7)}


def test_late_rows_land_aside_once(spark, tmp_path):
    path, mark = str(tmp_path / "events"), str(tmp_path / "mark")
    keep = joins.LateRows(spark, str(tmp_path / "kept"), "ts", "1 hour")

    def twice(batch, number):
        keep.write()(batch, number)
        keep.write()(batch, number)  # the batch runs again

    batches = [[(1, at(5), 1, "a", 1.0)], [(2, at(4, 30), 1, "a", 1.0), (3, at(3), 1, "a", 1.0), (4, at(9), 1, "a", 1.0), (5, None, 1, "a", 1.0)], [(6, at(7, 59), 1, "a", 1.0), (7, at(8), 1, "a", 1.0)]]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = state.read_events(spark, path).writeStream.foreachBatch(twice).option("checkpointLocation", mark)
        stream.trigger(availableNow=True).start().awaitTermination()
    late = sorted(r.event_id for r in keep.read("late").collect())
    assert late == [3, 6] and sorted(r.event_id for r in keep.read("in_time").collect()) == [1, 2, 4, 5, 7]
    every = spark.createDataFrame([(k, *r) for k, rows in enumerate(batches) for r in rows], f"b int, {SCHEMA}")
    assert sorted(r.event_id for r in joins.by_arrival(every, "b", "ts", "1 hour").where("is_late").collect()) == late


def test_snapshots_equal_a_full_replay(spark):
    rng = random.Random(8)
    rows = [(rng.choice("abc"), k, rng.choice(["set_rows", "add_rows", "add_rows", "add_rows", "delete_row", "update_widget"]), rng.choice([1, 2, 3, 4, None])) for k in range(300)]
    log = spark.createDataFrame(rows, "dataset string, seq long, op string, row long")
    want = set()
    for d in "abc":
        now, begun = {}, False
        for _, seq, op, row in [r for r in rows if r[0] == d]:
            if op == "set_rows":
                now, begun = {seq: row}, True
            elif op == "add_rows" and begun:
                now[seq] = row
            elif op == "delete_row" and row is not None:
                now = {s: r for s, r in now.items() if r != row}
        want |= {(d, s) for s in now}
    have = lambda df: {(r.dataset, r.seq) for r in df.collect()}
    assert have(oplog.state_rows(log)) == want
    snap = None
    for low in range(0, 200, 50):
        snap = oplog.snapshot(log.where((F.col("seq") >= low) & (F.col("seq") < low + 50)), snap)
        assert have(oplog.from_snapshot(snap, log.where(F.col("seq") >= low + 50))) == want
    assert snap.count() < 200


def test_totals_and_cross_tables(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", None, 2.0), (" ", "x", 4.0), (None, "y", 8.0)], "k string, c string, v double")
    got = {(r.k, r.c, r.level): r.s for r in totals.with_totals(df, ["k", "c"], {"s": F.sum("v")}).collect()}
    assert got == {("a", "x", 0): 1, ("a", "(vazio)", 0): 2, ("(vazio)", "x", 0): 4, ("(vazio)", "y", 0): 8, ("a", "Total", 1): 3, ("(vazio)", "Total", 1): 12, ("Total", "Total", 3): 15}
    table = {r.k: r.asDict() for r in totals.pivoted(df, "k", "c", F.col("v")).collect()}
    assert table["a"] == {"k": "a", "(vazio)": 2, "x": 1, "y": None, "Total": 3} and table["(vazio)"]["Total"] == 12
    with pytest.raises(SpecError):
        totals.pivoted(df, "k", "c", F.col("v"), most=2)
    assert totals.with_totals(df.limit(0), ["k"], {"n": F.count("*")}).count() == 0


def test_sketches_stay_within_their_bound(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), k % 9, rng.choice([-1, 1]) * 10 ** rng.uniform(-3, 6)) for k in range(4000)] + [("a", 1, None), ("a", 1, 0.0), ("b", 2, float("nan"))]
    df = spark.createDataFrame(rows, "g string, d int, v double")
    at_ = [0.0, 0.1, 0.5, 0.99, 1.0]
    near = {(r.g, r.q): r.value for r in sketch.quantiles(sketch.quantile_sketch(df, "v", ["g", "d"]), at_, ["g"]).collect()}
    exact = {(r.g, r.q): r.value for r in sketch.exact_quantiles(df.where("not isnan(v)"), "v", at_, ["g"]).collect()}
    for g in "ab":
        own = sorted(v for x, _, v in rows if x == g and v is not None and v == v)
        for q in at_:
            low = own[int((len(own) - 1) * q)]
            assert abs(near[g, q] - low) <= 0.0101 * abs(low) + 1e-9
            place = (len(own) - 1) * q
            high = own[min(int(place) + 1, len(own) - 1)]
            assert exact[g, q] == pytest.approx(low + (high - low) * (place - int(place)), rel=1e-9)
    n = sketch.distinct_of(sketch.distinct_sketch(spark.range(20_000).withColumn("d", F.col("id") % 5), "id", ["d"])).first().n
    assert abs(n - 20_000) < 0.06 * 20_000
