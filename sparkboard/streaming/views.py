"""Widgets that follow the changes of their datasets (incremental view maintenance).

A widget keeps partial aggregates that add up: counts and sums for each label, and where it
needs single values (smallest, largest, dates for validity) a count for each value. A batch
of changed rows, each with +1 for a row that came and -1 for one that went, is aggregated in
the same way and added to them; no other row of the dataset is read again. What a widget shows
is computed from its partial aggregates, by the rules of ``plans.resolve``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import validity
from ..plans.resolve import BLANK, STATUSES, _date, _num, _with_gaps, column_name, ordered_groups, predicate
from ..plans.spec import Chart, Filter, Kpi, SpecError
from ..scratch import delete_folder

SIGN = "_sign"
_KEYS = ["view", "label", "day", "number"]
EMPTY = "view string, label string, day date, number double, n bigint, filled array<bigint>, sums array<double>"


@dataclass(frozen=True)
class View:
    """A widget over a dataset: an indicator or a grouped chart."""

    dataset: str
    rule: Kpi | Chart

    def __post_init__(self) -> None:
        rule = self.rule
        if isinstance(rule, Kpi) and rule.agg == "last" or isinstance(rule, Chart) and (rule.agg == "none" or rule.order_by):
            raise SpecError("rules over the order of rows need all rows, not their partial aggregates")


def _rules(rule: Kpi | Chart) -> list[Filter]:
    return [rule.filter] if isinstance(rule.filter, Filter) else list(rule.filter or ())


def _entry(rows: DataFrame, name: str, rule: Kpi | Chart, as_of: Column | None) -> Column:
    """What one row says to one view: its keys and values, null if filters keep it out."""
    label, day, number, values = F.lit(None).cast("string"), F.lit(None).cast("date"), F.lit(None).cast("double"), []
    ok = F.lit(True)
    for f in _rules(rule):
        ok = ok & predicate(rows, f)
    if rule.validity:
        day = _date(rows, rule.validity, as_of)
    elif isinstance(rule, Kpi):
        if rule.agg != "count":
            value = _num(rows, rule.col)
            number, values = (value, []) if rule.agg in ("min", "max") else (number, [value])
    else:
        values = [] if rule.agg == "count" else [_num(rows, y) for y in rule.y]
        if rule.group_date == "month":
            day = F.trunc(_date(rows, rule.x, as_of if as_of is not None else F.current_date()), "MM")
            ok = ok & day.isNotNull()
        else:
            text = F.trim(F.col(f"`{column_name(rows, rule.x)}`").cast("string"))
            label = F.coalesce(F.nullif(text, F.lit("")), F.lit(BLANK))
    array = F.array(*values).cast("array<double>") if values else F.array().cast("array<double>")
    return F.when(ok, F.struct(F.lit(name).alias("view"), label.alias("label"), day.alias("day"), number.alias("number"), array.alias("values")))


def partials(changes: DataFrame, views: dict[str, View], as_of: Column | None = None) -> DataFrame:
    """Partial aggregates of ``changes`` for all ``views`` of one dataset, in one pass.

    ``changes`` are rows of the dataset with ``_sign`` (1 or -1; without the column all rows came). An empty
    batch gives no rows. Widgets are told apart by name; rows outside a widget's filters say nothing to it.
    """
    sign = F.col(SIGN) if SIGN in changes.columns else F.lit(1)
    said = changes.select(sign.cast("long").alias("sign"), F.explode(F.array(*[_entry(changes, n, v.rule, as_of) for n, v in views.items()])).alias("e"))
    rows = said.where("e is not null").select("sign", "e.*")
    width = max([len(v.rule.y) if isinstance(v.rule, Chart) else 1 for v in views.values()], default=1)
    at = [F.get("values", F.lit(k)) for k in range(width)]
    return rows.groupBy(*_KEYS).agg(
        F.sum("sign").alias("n"),
        F.array(*[F.sum(F.when(v.isNotNull(), F.col("sign")).otherwise(F.lit(0).cast("long"))) for v in at]).alias("filled"),
        F.array(*[F.sum(F.coalesce(v, F.lit(0.0)) * F.col("sign")) for v in at]).alias("sums"),
    )


def merged(*parts: DataFrame) -> DataFrame:
    """Partial aggregates added up; what has come and gone alike is dropped."""
    every = reduce(DataFrame.unionByName, parts)
    add = lambda kind: lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0).cast(kind)) + F.coalesce(y, F.lit(0).cast(kind)))
    lists = every.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.collect_list("filled").alias("f"), F.collect_list("sums").alias("s"))  # a row for each part
    total = lambda c, kind: F.aggregate(c, F.array().cast(f"array<{kind}>"), add(kind))
    return lists.select(*_KEYS, "n", total("f", "bigint").alias("filled"), total("s", "double").alias("sums")).where("n <> 0")


def shown(state: DataFrame, name: str, view: View, as_of: Column | None = None) -> DataFrame:
    """What widget ``name`` shows: the rows that ``resolve.kpi``, ``validity_chart`` or ``grouped`` would give for all rows."""
    rule, own = view.rule, state.where(F.col("view") == name)
    if rule.validity:
        status = validity(F.col("day"), as_of)
        if isinstance(rule, Kpi):
            hit = F.when(status == (rule.status or "vencido"), F.col("n")).otherwise(0)
            return own.agg(F.coalesce(F.sum(hit), F.lit(0)).cast("double").alias("value"))
        counts = own.agg(*[F.coalesce(F.sum(F.when(status == s, F.col("n"))), F.lit(0)).cast("double").alias(s) for s in STATUSES])
        parts = ", ".join(f"{k}, '{s}', {s}" for k, s in enumerate(STATUSES, 1))
        return counts.selectExpr(f"stack(3, {parts}) as (position, label, v1)")
    if isinstance(rule, Kpi):
        n, s = F.sum(F.get("filled", F.lit(0))), F.sum(F.get("sums", F.lit(0)))
        value = {"count": F.coalesce(F.sum("n"), F.lit(0)).cast("double"), "min": F.min("number"), "max": F.max("number"), "avg": F.when(n > 0, s / n)}
        return own.agg(value.get(rule.agg, F.when(n > 0, s)).alias("value"))
    count = rule.agg == "count" or not rule.y
    names = ["v1"] if count else [f"v{k}" for k in range(1, len(rule.y) + 1)]
    values = [F.col("n").cast("double").alias("v1")] if count else [F.get("sums", F.lit(k)).alias(v) for k, v in enumerate(names)]
    if rule.group_date == "month":
        return _with_gaps(own.select(F.col("day").alias("_month"), *values), names, rule.max_months)
    return ordered_groups(own.select("label", *values), names, rule)


class Board:
    """Partial aggregates of a board's widgets, as versions in a folder that all machines share.

    ``refresh(dataset)`` is for foreachBatch: batch k of a dataset's changes makes the dataset's
    version k out of the newest version before it. A batch that runs again makes the same version again.
    The two newest versions stay.
    """

    def __init__(self, spark: SparkSession, path: str, views: dict[str, View], as_of: Column | None = None) -> None:
        self.spark, self.path, self.views, self.as_of = spark, path.rstrip("/"), views, as_of

    def _done(self, dataset: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{dataset}")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = [x.getPath() for x in fs.listStatus(folder)]
        return sorted(int(p.getName().partition("-")[2]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _version(self, dataset: str, number: int) -> DataFrame:
        return self.spark.read.schema(EMPTY).parquet(f"{self.path}/{dataset}/version-{number}")

    def refresh(self, dataset: str) -> Callable[[DataFrame, int], None]:
        own = {n: v for n, v in self.views.items() if v.dataset == dataset}

        def run(batch: DataFrame, number: int) -> None:
            before = [k for k in self._done(dataset) if k < number]
            parts = [partials(batch, own, self.as_of)] + ([self._version(dataset, before[-1])] if before else [])
            merged(*parts).write.mode("overwrite").parquet(f"{self.path}/{dataset}/version-{number}")
            for old in before[:-1]:
                delete_folder(self.spark, f"{self.path}/{dataset}/version-{old}")

        return run

    def show(self, name: str) -> DataFrame:
        view = self.views[name]
        done = self._done(view.dataset)
        state = self._version(view.dataset, done[-1]) if done else self.spark.createDataFrame([], EMPTY)
        return shown(state, name, view, self.as_of)
