import json

import pytest
from pyspark.sql import functions as F

from sparkboard.plans import resolve
from sparkboard.plans.oplog import live_rows, replay, replay_tabs, undo
from sparkboard.plans.profile import auto_board, profile
from sparkboard.plans.spec import SCHEMA, Chart, Filter, Kpi, SpecError, dump_board, load_board

def as_of():
    return F.lit("2026-09-15").cast("date")



@pytest.fixture(scope="module")
def months(spark):
    rows = [("Jan", "120", "310"), ("Fev", "98", "280"), ("Mar", "110", "295"), ("Abr", "105", "330"), ("Mai", "101", "342"), ("Jun", "96", "360")]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "_ord int, `Mês` string, Acidentes string, `Quase acidentes` string")


def test_indicators(months):
    assert resolve.kpi(months, Kpi("sum", "acidentes")).first().value == 630
    last = resolve.kpi(months, Kpi("last", "Quase acidentes", delta_prev=True)).first()
    assert (last.value, last.delta, last.spark) == (360, 18, [310, 280, 295, 330, 342, 360])
    assert resolve.kpi(months.limit(0), Kpi("sum", "Acidentes")).first().value is None


def test_filters(spark):
    t = spark.createDataFrame([(1, "OK"), (2, None), (3, "ruim"), (4, "")], "id int, s string")
    ids = lambda f: sorted(x.id for x in resolve.filtered(t, f).collect())
    assert ids(Filter("s", "neq", "ok")) == [2, 3, 4]
    assert ids(Filter("s", "eq", "Ok")) == [1]
    assert ids(Filter("s", "contains", "")) == [1, 2, 3, 4]
    assert ids(Filter("id", "gt", 2)) == [3, 4]
    with pytest.raises(SpecError):
        ids(Filter("none", "eq", 1))
    assert len(resolve.filtered(t, Filter("none", "eq", 1), lenient=True).collect()) == 4


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/t")
    plan = resolve.filtered(spark.read.parquet(f"{tmp_path}/t"), Filter("id", "gt", 3))._jdf.queryExecution().toString()
    assert "GreaterThan(id,3)" in plan


def test_top_and_rest(spark):
    t = spark.createDataFrame([(k, v) for k, v in zip("abcde", (5, 4, 3, 2, 1), strict=True)], "k string, v int")
    rows = sorted(resolve.chart(t, Chart("k", ("v",), top=3)).collect(), key=lambda r: r.position)
    assert [(r.label, r.v1) for r in rows] == [("a", 5), ("b", 4), ("Outros", 6)]
    assert sum(r.v1 for r in resolve.chart(t, Chart("k", ("v",), top=9)).collect()) == 15


def test_month_gaps(spark):
    t = spark.createDataFrame([("10/11/2024", 1), ("02/02/2025", 2), ("?", 3)], "d string, v int")
    rows = sorted(resolve.chart(t, Chart("d", ("v",), group_date="month"), as_of()).collect(), key=lambda r: r.position)
    assert [(r.month, r.v1) for r in rows] == [("2024-11", 1), ("2024-12", 0), ("2025-01", 0), ("2025-02", 2)]
    assert rows[0].label == "nov/24"


def test_validity_chart_and_fused(spark):
    t = spark.createDataFrame([("Portaria", "2027-03-10"), ("Galpão 1", "2026-09-01"), ("x", None)], "Local string, Recarga string")
    assert [(r.label, r.v1) for r in sorted(resolve.chart(t, Chart(validity="recarga"), as_of()).collect(), key=lambda r: r.position)] == [("vencido", 1), ("a_vencer", 0), ("em_dia", 1)]
    row = resolve.kpis(t, {"n": Kpi("count"), "late": Kpi(validity="Recarga", status="vencido")}, as_of()).first()
    assert (row.n, row.late) == (3, 1)


def test_counter_progress_donut(spark):
    t = spark.createDataFrame([("2026-09-01",), ("2026-09-10",)], "d string")
    assert resolve.counter(t, "d", as_of()).first().days == 5
    p = spark.range(1).select(resolve.progress(F.lit(150.0), F.lit(100.0)).alias("a"), resolve.progress(F.lit(1.0), F.lit(0.0)).alias("b")).first()
    assert (p.a, p.b) == (100, 0)
    g = spark.createDataFrame([(c, float(v)) for c, v in zip("abcdefgh", (8, 7, 6, 5, 4, 3, 2, 1), strict=True)], "label string, v1 double")
    d = resolve.donut(g).collect()
    assert len(d) == 6 and sum(x.v1 for x in d) == 36


def test_profile_and_auto_board(months):
    rows = [r.asDict() for r in profile(months.drop("_ord"), as_of()).orderBy("position").collect()]
    assert [r["type"] for r in rows] == ["period", "number", "number"]
    plan = auto_board(rows, "acidentes", 6)
    assert [w["type"] for w in plan] == ["kpi", "kpi", "chart", "table"]
    assert plan[2]["props"]["agg"] == "none" and plan[0]["props"]["from"]["agg"] == "last" and plan[0]["props"]["good"] == "down"


OPS = [
    {"op": "rename_tab", "name": "T"},
    {"op": "add_subtab", "id": "a", "name": "A"},
    {"op": "add_subtab", "id": "b", "name": "B"},
    {"op": "add_widget", "subId": "a", "widget": {"id": "w", "type": "kpi", "props": {"x": 1}}},
    {"op": "update_widget", "id": "w", "props": {"y": 2}},
    {"op": "move_widget", "id": "w", "subId": "b", "index": 0},
    {"op": "move_subtab", "id": "b", "index": 0},
    {"op": "add_dataset", "dataset": {"id": "d", "rows": [["1"]]}},
    {"op": "add_rows", "dataset": "d", "rows": [["2"]]},
    {"op": "no_such_op"},
]


def test_replay_and_undo(spark):
    board = replay(OPS)
    assert (board.name, [s.id for s in board.subtabs], board.subtabs[0].widgets[0].props, board.datasets["d"]["rows"]) == ("T", ["b", "a"], {"x": 1, "y": 2}, [["1"], ["2"]])
    assert undo(OPS, 2).datasets["d"]["rows"] == [["1"]]
    log = spark.createDataFrame([("t", k, json.dumps(o)) for k, o in enumerate(OPS)], "tab string, seq int, op string")
    assert json.loads(replay_tabs(log).first().board)["name"] == "T"


def test_live_rows(spark):
    log = spark.createDataFrame([("d", 1, "add_rows"), ("d", 2, "add_dataset"), ("d", 3, "add_rows"), ("d", 4, "set_rows"), ("d", 5, "add_rows"), ("e", 6, "add_rows")], "dataset string, seq int, op string")
    assert sorted(r.seq for r in live_rows(log).collect()) == [4, 5]


def test_board_round_trip():
    board = load_board({"schema": SCHEMA, "name": "x" * 80, "subtabs": [{"columns": 9, "widgets": [{"type": "kpi", "span": 7}, {"type": "none"}]}]})
    assert (len(board.name), board.subtabs[0].columns, len(board.subtabs[0].widgets), board.subtabs[0].widgets[0].span) == (60, 4, 1, 4)
    assert load_board(json.dumps(dump_board(board))).subtabs[0].columns == 4
    with pytest.raises(SpecError):
        load_board({"schema": "other"})
