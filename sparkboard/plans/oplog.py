"""Operation logs: row state by set operations, board metadata by a fold for each tab, undo."""

from __future__ import annotations

import copy
import json
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spec import WIDGETS, Board, SubTab, Widget, load_board

SET, ADD, DELETE = ("add_dataset", "set_rows"), "add_rows", "delete_row"


def live_rows(log: DataFrame, key: str = "dataset", seq: str = "seq", op: str = "op") -> DataFrame:
    """Log rows that make up the present state of each dataset: those of its last op that
    sets rows and of all that add rows after it. What comes before the first such op of a
    dataset does nothing. Replays no row by row: one aggregation and one join."""
    last = log.where(F.col(op).isin(*SET)).groupBy(key).agg(F.max(seq).alias("_last"))
    return log.where(F.col(op).isin(*SET, ADD)).join(last, key).where((F.col(seq) == F.col("_last")) | ((F.col(op) == ADD) & (F.col(seq) > F.col("_last")))).drop("_last")


def _flagged(log: DataFrame, key: str, seq: str, op: str, row: str) -> DataFrame:
    """Live rows with ``gone``: whether a later ``delete_row`` has taken the row away."""
    log = log if "gone" in log.columns else log.withColumn("gone", F.lit(False))
    taken = log.where((F.col(op) == DELETE) & F.col(row).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(row).alias("_row")).agg(F.max(seq).alias("_taken"))
    live = live_rows(log.where(F.col(op) != DELETE), key, seq, op)
    found = live.join(taken, (F.col(key) == F.col("_k")) & (F.col(row) == F.col("_row")), "left")
    return found.withColumn("gone", F.col("gone") | F.coalesce(F.col("_taken") > F.col(seq), F.lit(False))).drop("_k", "_row", "_taken")


def state_rows(log: DataFrame, key: str = "dataset", seq: str = "seq", op: str = "op", row: str = "row") -> DataFrame:
    """Log rows of the present rows: ``live_rows`` without those that a later ``delete_row`` of the same
    ``row`` has taken away. A row that is added again after that is there again; a null row cannot be deleted."""
    return _flagged(log, key, seq, op, row).where("not gone").drop("gone")


def snapshot(log: DataFrame, before: DataFrame | None = None, key: str = "dataset", seq: str = "seq", op: str = "op", row: str = "row") -> DataFrame:
    """The state after ``log`` as rows to be stored: its present rows, and with ``gone`` those that set a dataset's rows and
    have been deleted since, for what is added later counts after them. With ``before``, an earlier snapshot, ``log`` is
    only what follows it, so each snapshot costs a state and a stretch of log."""
    every = log.withColumn("gone", F.lit(False))
    rows = _flagged(every if before is None else before.unionByName(every), key, seq, op, row)
    return rows.where(~F.col("gone") | F.col(op).isin(*SET))


def from_snapshot(before: DataFrame, tail: DataFrame, key: str = "dataset", seq: str = "seq", op: str = "op", row: str = "row") -> DataFrame:
    """The present rows from a snapshot and the log that follows it: those of a replay of the whole log."""
    return state_rows(before.unionByName(tail.withColumn("gone", F.lit(False))), key, seq, op, row)


def undone(log: DataFrame, key: str = "dataset", seq: str = "seq", steps: int = 1) -> DataFrame:
    """The log without the last ``steps`` ops of each key; replay it for the state before them."""
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc(seq)))
    return log.withColumn("_r", rank).where(F.col("_r") > steps).drop("_r")


def apply_op(board: Board, op: dict[str, Any]) -> Board:
    """One of the sixteen ops on a board, in place; unknown ops and targets change nothing."""
    kind = op.get("op")
    subs, by_id = board.subtabs, {s.id: s for s in board.subtabs}
    within = lambda v, top: max(0, min(top, int(v or 0)))
    if kind == "rename_tab":
        board.name = str(op.get("name") or board.name)[:60]
    elif kind == "set_style":
        for k in ("color", "icon", "theme"):
            if op.get(k):
                setattr(board, k, op[k])
        if op.get("description") is not None:
            board.description = op["description"]
    elif kind == "add_subtab":
        subs.append(SubTab(name=str(op.get("name") or "Nova")[:60], columns=max(1, min(4, int(op.get("columns") or 3))), id=op.get("id") or f"s{len(subs)}"))
    elif kind == "rename_subtab" and op.get("id") in by_id:
        by_id[op["id"]].name = str(op.get("name") or "")[:60]
    elif kind == "remove_subtab":
        board.subtabs = [s for s in subs if s.id != op.get("id")]
    elif kind == "move_subtab" and op.get("id") in by_id:
        s = by_id[op["id"]]
        subs.remove(s)
        subs.insert(within(op.get("index"), len(subs)), s)
    elif kind == "set_columns" and op.get("id") in by_id:
        by_id[op["id"]].columns = max(1, min(4, int(op.get("columns") or 1)))
    elif kind == "add_widget" and subs and (op.get("widget") or {}).get("type") in WIDGETS:
        w, s = op["widget"], by_id.get(op.get("subId"), subs[0])
        made = Widget(type=w["type"], title=w.get("title") or "", span=max(1, min(4, int(w.get("span") or 1))), props=dict(w.get("props") or {}), id=w.get("id") or f"w{len(s.widgets)}")
        s.widgets.insert(within(op["index"], len(s.widgets)) if op.get("index") is not None else len(s.widgets), made)
    elif kind in ("update_widget", "remove_widget", "move_widget"):
        for s in subs:
            for w in [w for w in s.widgets if w.id == op.get("id")]:
                if kind == "update_widget":
                    w.title, w.type = op.get("title", w.title), op.get("type") if op.get("type") in WIDGETS else w.type
                    w.span = max(1, min(4, int(op.get("span") or w.span)))
                    w.props |= op.get("props") or {}
                    continue
                s.widgets.remove(w)
                if kind == "move_widget":
                    to = by_id.get(op.get("subId"), s)
                    to.widgets.insert(within(op.get("index"), len(to.widgets)), w)
                    return board
    elif kind == "add_dataset" and op.get("dataset"):
        board.datasets[op["dataset"]["id"]] = dict(op["dataset"])
    elif kind == "set_rows" and op.get("dataset") in board.datasets:
        board.datasets[op["dataset"]]["rows"] = list(op.get("rows") or [])
    elif kind == "add_rows" and op.get("dataset") in board.datasets:
        board.datasets[op["dataset"]].setdefault("rows", []).extend(op.get("rows") or [])
    elif kind == "add_source" and op.get("source"):
        board.sources[op["source"]["id"]] = dict(op["source"])
    elif kind == "update_source" and op.get("id") in board.sources:
        board.sources[op["id"]] |= op.get("patch") or {}
    return board


def replay(ops: list[dict[str, Any]]) -> Board:
    """The board that a log makes of an empty one."""
    board = Board()
    for op in ops:
        apply_op(board, copy.deepcopy(op))
    return board


def undo(ops: list[dict[str, Any]], steps: int = 1) -> Board:
    return replay(ops[: len(ops) - steps] if steps else ops)


def replay_tabs(log: DataFrame) -> DataFrame:
    """(tab, board as JSON) from (tab, seq, op as JSON): a fold for each tab, whose log is
    metadata of bounded size; rows of datasets go by ``live_rows``."""
    from .spec import dump_board

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        ops = [json.loads(x) for x in pdf.sort_values("seq")["op"]]
        return pd.DataFrame({"tab": pdf["tab"].iloc[:1], "board": [json.dumps(dump_board(replay(ops)), ensure_ascii=False, sort_keys=True)]})

    return log.groupBy("tab").applyInPandas(fold, "tab string, board string")


__all__ = ["apply_op", "from_snapshot", "live_rows", "load_board", "replay", "replay_tabs", "snapshot", "state_rows", "undo", "undone"]
