"""Widget rules as data: what a board says, checked and cleaned on the way in."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

SCHEMA = "ops360.tab/1"  # fixed value: the tag that stored boards carry
WIDGETS = ("kpi", "chart", "table", "note", "checklist", "links", "counter", "progress", "form", "calc", "site", "timeline", "image", "embed")
CHARTS = ("bar", "hbar", "line", "area", "donut", "stacked")
COLUMN_TYPES = ("text", "number", "date", "select")


class SpecError(ValueError):
    """A rule names what is not there, or is none."""


@dataclass(frozen=True)
class Filter:
    """col op value, with op one of contains, eq, neq, gt, lt; further ops are gte, lte, in."""

    col: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class Kpi:
    """A number over a dataset, or a fixed one (``value``) if no dataset is named."""

    agg: str = "sum"
    col: str | None = None
    filter: Filter | tuple[Filter, ...] | None = None
    validity: str | None = None
    status: str | None = None
    delta_prev: bool = False
    order_by: tuple[str, ...] = ()
    value: float | None = None
    good: str = "up"


@dataclass(frozen=True)
class Chart:
    """Series over the groups of a column, or fixed labels and series."""

    x: str | None = None
    y: tuple[str, ...] = ()
    agg: str = "sum"
    kind: str = "bar"
    group_date: str | None = None
    filter: Filter | tuple[Filter, ...] | None = None
    top: int | None = None
    validity: str | None = None
    labels: tuple[str, ...] = ()
    series: tuple[tuple[str, tuple[float, ...]], ...] = ()
    max_months: int | None = None
    order_by: tuple[str, ...] = ()


@dataclass
class Widget:
    type: str
    title: str = ""
    span: int = 1
    props: dict[str, Any] = field(default_factory=dict)
    id: str = ""


@dataclass
class SubTab:
    name: str = "Geral"
    columns: int = 3
    widgets: list[Widget] = field(default_factory=list)
    id: str = ""


@dataclass
class Board:
    """A tab: sub-tabs of widgets, datasets by id, sources, and the log of what changed it."""

    id: str = ""
    name: str = ""
    icon: str = ""
    color: str = "#2563eb"
    theme: str = ""
    description: str = ""
    subtabs: list[SubTab] = field(default_factory=list)
    datasets: dict[str, dict[str, Any]] = field(default_factory=dict)
    sources: dict[str, dict[str, Any]] = field(default_factory=dict)
    history: list[dict[str, Any]] = field(default_factory=list)


def _within(value: Any, low: int, high: int, default: int) -> int:
    try:
        return max(low, min(high, int(value)))
    except (TypeError, ValueError):
        return default


def load_board(source: str | dict[str, Any]) -> Board:
    """A board from its JSON form: lengths cut, columns and spans within 1 to 4, unknown
    widget types dropped, at least one sub-tab, the last 500 log entries."""
    raw = json.loads(source) if isinstance(source, str) else source
    if not isinstance(raw, dict) or raw.get("schema") != SCHEMA or not isinstance(raw.get("subtabs"), list):
        raise SpecError(f"no board of schema {SCHEMA}")
    color = str(raw.get("color") or "")
    board = Board(id=str(raw.get("id") or ""), name=str(raw.get("name") or "")[:60], icon=str(raw.get("icon") or "")[:4], color=color if re.fullmatch(r"#[0-9a-fA-F]{3,8}", color) else "#2563eb", theme=str(raw.get("theme") or ""), description=str(raw.get("description") or ""))
    for k, sub in enumerate(x for x in raw["subtabs"] if isinstance(x, dict)):
        widgets = [Widget(type=w["type"], title=str(w.get("title") or ""), span=_within(w.get("span"), 1, 4, 1), props=dict(w.get("props") or {}), id=str(w.get("id") or f"w{k}_{n}")) for n, w in enumerate(sub.get("widgets") or []) if isinstance(w, dict) and w.get("type") in WIDGETS]
        board.subtabs.append(SubTab(name=str(sub.get("name") or "Geral")[:60], columns=_within(sub.get("columns"), 1, 4, 3), widgets=widgets, id=str(sub.get("id") or f"s{k}")))
    board.subtabs = board.subtabs or [SubTab(id="s0")]
    board.datasets = dict(raw.get("datasets") or {})
    board.sources = dict(raw.get("sources") or {})
    board.history = list(raw.get("history") or [])[-500:]
    return board


def dump_board(board: Board) -> dict[str, Any]:
    """The JSON form of a board."""
    from dataclasses import asdict

    return {"schema": SCHEMA, **asdict(board)}


def as_filter(rule: dict[str, Any] | None) -> Filter | None:
    return Filter(str(rule.get("col")), str(rule.get("op")), rule.get("value")) if rule else None


def as_kpi(props: dict[str, Any]) -> tuple[str | None, Kpi]:
    """(dataset, rule) of a KPI widget's props."""
    src = props.get("from")
    if not src:
        return None, Kpi(value=props.get("value"), good=props.get("good", "up"))
    return src.get("dataset"), Kpi(agg=src.get("agg") or ("count" if not src.get("col") else "sum"), col=src.get("col"), filter=as_filter(src.get("filter")), validity=src.get("validity"), status=src.get("status"), delta_prev=bool(src.get("deltaPrev")), good=props.get("good", "up"))


def as_chart(props: dict[str, Any]) -> tuple[str | None, Chart]:
    """(dataset, rule) of a chart widget's props."""
    kind = {"pie": "donut"}.get(props.get("kind"), props.get("kind") or "bar")
    if not props.get("dataset"):
        return None, Chart(kind=kind, labels=tuple(props.get("labels") or ()), series=tuple((s.get("name", ""), tuple(s.get("values") or s.get("data") or ())) for s in props.get("series") or ()))
    y = props.get("y") or ()
    return props["dataset"], Chart(x=props.get("x"), y=(y,) if isinstance(y, str) else tuple(y), agg=props.get("agg") or "sum", kind=kind, group_date=props.get("groupDate"), filter=as_filter(props.get("filter")), top=props.get("top"), validity=props.get("validity"))
