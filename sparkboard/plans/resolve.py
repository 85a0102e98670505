"""Widget rules compiled to lazy DataFrames.

Every function takes a DataFrame and a rule and returns a DataFrame; nothing is
collected. Names are resolved while the plan is built, exactly first and then without
case and accents. What depends on row order takes ``order_by``: business columns, by
default ``_ord`` if the table has it. The current day is always the parameter ``as_of``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import date, month_key, month_label, validity
from ..functions.numbers import number
from ..functions.text import norm
from ..operators.order import ranked
from .spec import Chart, Filter, Kpi, SpecError

BLANK, REST = "(vazio)", "Outros"
STATUSES = ("vencido", "a_vencer", "em_dia")


def _key(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c)).lower().strip()


def column_name(df: DataFrame, name: str) -> str:
    """The column of ``df`` that ``name`` means."""
    if name in df.columns:
        return name
    for c in df.columns:
        if _key(c) == _key(name):
            return c
    raise SpecError(f"no column {name!r} among {', '.join(df.columns)}")


def _num(df: DataFrame, name: str) -> Column:
    c = column_name(df, name)
    return number(F.col(f"`{c}`"), dict(df.dtypes)[c])


def _date(df: DataFrame, name: str, as_of: Column) -> Column:
    c = column_name(df, name)
    return date(F.col(f"`{c}`"), dict(df.dtypes)[c], as_of)


def _order(df: DataFrame, order_by: Sequence[str]) -> list[str]:
    keys = [column_name(df, c) for c in order_by] or [c for c in ("_ord",) if c in df.columns]
    if not keys:
        raise SpecError("row order matters here: name order_by, or give the table _ord")
    return keys


def _typed(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[column_name(df, name)] not in ("string",)


def predicate(df: DataFrame, rule: Filter, lenient: bool = False) -> Column:
    """Whether a row passes; never null. A missing cell is an empty text, so neq keeps it.

    Comparisons of a numeric column with a number stay bare, so they reach the scan.
    With ``lenient`` a rule on an unknown column or with an unknown op passes all rows.
    """
    try:
        name = column_name(df, rule.col)
    except SpecError:
        if lenient:
            return F.lit(True)
        raise
    c, text = F.col(f"`{name}`"), norm(F.col(f"`{name}`"))
    wanted = norm(F.lit(None if rule.value is None else str(rule.value)))
    compare = {"gt": lambda a, b: a > b, "lt": lambda a, b: a < b, "gte": lambda a, b: a >= b, "lte": lambda a, b: a <= b}
    if rule.op in compare:
        if _typed(df, name) and isinstance(rule.value, (int, float)):
            return c.isNotNull() & compare[rule.op](c, F.lit(rule.value))
        value = F.lit(float(rule.value)) if isinstance(rule.value, (int, float)) else number(F.lit(rule.value), "string")
        return F.coalesce(compare[rule.op](_num(df, name), value), F.lit(False))
    if rule.op == "contains":
        return F.contains(text, wanted)
    if rule.op == "eq":
        return text == wanted
    if rule.op == "neq":
        return text != wanted
    if rule.op == "in":
        return text.isin(*[norm(F.lit(str(v))) for v in rule.value])
    if lenient:
        return F.lit(True)
    raise SpecError(f"unknown op {rule.op!r}")


def filtered(df: DataFrame, rules: Filter | Sequence[Filter] | None, lenient: bool = False) -> DataFrame:
    """Rows that pass all rules."""
    for rule in [rules] if isinstance(rules, Filter) else rules or ():
        df = df.where(predicate(df, rule, lenient))
    return df


def kpi(df: DataFrame, rule: Kpi, as_of: Column | None = None) -> DataFrame:
    """One row: value, and for ``last`` also delta and spark (the last twelve values).

    An unknown agg sums. Only values that parse count; without any the value is null.
    """
    rows = filtered(df, rule.filter)
    if rule.validity:
        hit = validity(_date(rows, rule.validity, as_of), as_of) == (rule.status or "vencido")
        return rows.agg(F.count_if(hit).cast("double").alias("value"))
    if rule.agg == "count":
        return rows.agg(F.count("*").cast("double").alias("value"))
    if rule.col is None:
        raise SpecError(f"{rule.agg} needs a column")
    v = _num(rows, rule.col)
    if rule.agg == "last":
        order = _order(rows, rule.order_by)
        # a bounded top-k instead of a sort of all rows
        last = rows.select(v.alias("v"), F.struct(*[F.col(f"`{c}`") for c in order]).alias("o")).where("v is not null").orderBy(F.desc("o")).limit(12)
        ends = last.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]).alias("spark"))
        value = F.when(F.size("spark") > 0, F.element_at("spark", -1))
        delta = F.when(F.size("spark") > 1, F.element_at("spark", -1) - F.element_at("spark", -2))
        return ends.select(value.alias("value"), (delta if rule.delta_prev else F.lit(None).cast("double")).alias("delta"), "spark")
    aggregate = {"avg": F.avg, "min": F.min, "max": F.max}.get(rule.agg, F.sum)
    return rows.agg(aggregate(v).alias("value"))


def fixed_kpi(spark: SparkSession, value: float | None, unit: str | None = None, delta: float | None = None) -> DataFrame:
    """One row of a KPI that names no dataset: value, unit, delta as they were given."""
    return spark.range(1).select(F.lit(value).cast("double").alias("value"), F.lit(unit).cast("string").alias("unit"), F.lit(delta).cast("double").alias("delta"))


def bar_kind(groups: DataFrame) -> DataFrame:
    """One row, kind: bars lie (hbar) if there are more than 8 labels and one has more than 10 characters."""
    return groups.agg(F.when((F.count("*") > 8) & (F.max(F.length("label")) > 10), "hbar").otherwise("bar").alias("kind"))


def kpis(df: DataFrame, rules: dict[str, Kpi], as_of: Column | None = None) -> DataFrame:
    """Many KPIs over one dataset in a single scan: one row, a column for each name."""
    columns = []
    for name, rule in rules.items():
        ok = F.lit(True)
        for f in [rule.filter] if isinstance(rule.filter, Filter) else rule.filter or ():
            ok = ok & predicate(df, f)
        if rule.validity:
            c = F.count_if(ok & (validity(_date(df, rule.validity, as_of), as_of) == (rule.status or "vencido"))).cast("double")
        elif rule.agg == "count":
            c = F.count_if(ok).cast("double")
        elif rule.agg == "last":
            order = F.struct(*[F.col(f"`{k}`") for k in _order(df, rule.order_by)])
            v = _num(df, rule.col)
            c = F.max_by(F.when(ok, v), F.when(ok & v.isNotNull(), order))
        else:
            c = {"avg": F.avg, "min": F.min, "max": F.max}.get(rule.agg, F.sum)(F.when(ok, _num(df, rule.col)))
        columns.append(c.alias(name))
    return df.agg(*columns)


def validity_chart(df: DataFrame, column: str, as_of: Column) -> DataFrame:
    """Three rows in fixed order, zeros kept: label, v1, position."""
    status = validity(_date(df, column, as_of), as_of)
    counts = df.agg(*[F.count_if(status == s).cast("double").alias(s) for s in STATUSES])
    parts = ", ".join(f"{k}, '{s}', {s}" for k, s in enumerate(STATUSES, 1))
    return counts.selectExpr(f"stack(3, {parts}) as (position, label, v1)")


def _series(df: DataFrame, rule: Chart) -> list[Column]:
    known = []
    for y in rule.y:
        try:
            known.append(_num(df, y))
        except SpecError:
            continue  # unknown series are left out
    return known


def grouped(df: DataFrame, rule: Chart, as_of: Column | None = None) -> DataFrame:
    """label and v1, v2, … by group, with position: the order in which they are shown."""
    rows = filtered(df, rule.filter)
    values = _series(rows, rule)
    count = rule.agg == "count" or not values
    sums = [F.count("*").cast("double").alias("v1")] if count else [F.sum(F.coalesce(v, F.lit(0.0))).alias(f"v{k}") for k, v in enumerate(values, 1)]
    names = ["v1"] if count else [f"v{k}" for k in range(1, len(values) + 1)]
    if rule.group_date == "month":
        month = F.trunc(_date(rows, rule.x, as_of if as_of is not None else F.current_date()), "MM")
        by_month = rows.withColumn("_month", month).where("_month is not null").groupBy("_month").agg(*sums)
        return _with_gaps(by_month, names, rule.max_months)
    label = F.trim(F.col(f"`{column_name(rows, rule.x)}`").cast("string"))
    key = F.coalesce(F.nullif(label, F.lit("")), F.lit(BLANK))
    order = rule.order_by or (("_ord",) if "_ord" in rows.columns else ())
    first = [F.min(F.struct(*[F.col(f"`{column_name(rows, c)}`") for c in order])).alias("_first")] if order else []
    return ordered_groups(rows.groupBy(key.alias("label")).agg(*sums, *first), names, rule)


def ordered_groups(groups: DataFrame, names: list[str], rule: Chart) -> DataFrame:
    """label, the values ``names`` and position of ``groups`` (label, values, ``_first`` if rows have an order)."""
    ordered = "_first" in groups.columns
    keys = ["_first", "label"] if ordered else ["label"]
    if not (rule.kind in ("line", "area") and ordered):
        keys = [("v1", "desc"), *keys]
    if rule.top is None:  # any number of groups: a global order, not a window over all
        return ranked(groups, keys, name="position").select("label", *names, F.col("position").cast("int").alias("position"))
    ranks = [F.desc(k[0]) if isinstance(k, tuple) else F.asc(k) for k in keys]
    # the largest top - 1 groups are a bounded top-k; all others fold into one row
    head = groups.orderBy(*ranks).limit(rule.top).select("label", *names, F.row_number().over(Window.orderBy(*ranks)).alias("position"))
    total = groups.agg(*[F.sum(n).alias(f"t_{n}") for n in names], F.count("*").alias("n"))
    kept = head.crossJoin(F.broadcast(total)).where((F.col("n") <= rule.top) | (F.col("position") < rule.top)).select("label", *names, "position")
    shown = head.where(F.col("position") < rule.top).agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(f"s_{n}") for n in names])
    rest = total.crossJoin(shown).where(F.col("n") > rule.top).select(F.lit(REST).alias("label"), *[(F.col(f"t_{n}") - F.col(f"s_{n}")).alias(n) for n in names], F.lit(rule.top).alias("position"))
    return kept.unionByName(rest)


def _with_gaps(by_month: DataFrame, names: list[str], most: int | None) -> DataFrame:
    """A row for every month from the first to the last, missing ones zero."""
    span = by_month.agg(F.min("_month").alias("a"), F.max("_month").alias("b")).where("a is not null")
    months = span.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("_month"), "a")
    if most is not None:
        months = months.where(F.months_between("_month", "a") < most)
    filled = F.broadcast(months.drop("a")).join(by_month, "_month", "left")  # as many rows as months
    position = (F.year("_month") * 12 + F.month("_month")).cast("int")
    return filled.select(month_key(F.col("_month")).alias("month"), month_label(F.col("_month")).alias("label"), *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names], position.alias("position"))


def raw_chart(df: DataFrame, rule: Chart, most: int = 80) -> DataFrame:
    """The first rows as they stand: label, v1, v2, …; what does not parse is 0."""
    rows = filtered(df, rule.filter)
    order = [F.col(f"`{c}`") for c in _order(rows, rule.order_by)]
    label = F.col(f"`{column_name(rows, rule.x)}`").cast("string")
    return rows.orderBy(*order).limit(most).select(*[o.alias(f"_o{k}") for k, o in enumerate(order)], label.alias("label"), *[F.coalesce(v, F.lit(0.0)).alias(f"v{k}") for k, v in enumerate(_series(rows, rule), 1)]).drop(*[f"_o{k}" for k in range(len(order))])


def chart(df: DataFrame, rule: Chart, as_of: Column | None = None) -> DataFrame:
    """The chart of any rule over a dataset."""
    if rule.validity:
        return validity_chart(df, rule.validity, as_of)
    return raw_chart(df, rule) if rule.agg == "none" else grouped(df, rule, as_of)


def fixed_chart(spark: SparkSession, rule: Chart) -> DataFrame:
    """Literal labels and series as rows."""
    rows = [(label, *[float(s[k]) if k < len(s) else 0.0 for _, s in rule.series], k + 1) for k, label in enumerate(rule.labels)]
    return spark.createDataFrame(rows, ", ".join(["label string", *[f"v{k} double" for k in range(1, len(rule.series) + 1)], "position int"]))


def donut(groups: DataFrame, slices: int = 6) -> DataFrame:
    """label, v1, share in per cent: values over 0, the smallest beyond ``slices`` in one."""
    some = groups.where("v1 > 0")
    rank = F.row_number().over(Window.orderBy(F.desc("v1"), F.asc("label")))
    head = some.orderBy(F.desc("v1"), F.asc("label")).limit(slices).withColumn("position", rank)
    total = some.agg(F.sum("v1").alias("t"), F.count("*").alias("n"))
    kept = head.crossJoin(F.broadcast(total)).where((F.col("n") <= slices) | (F.col("position") < slices))
    shown = head.where(F.col("position") < slices).agg(F.sum("v1").alias("s"))
    rest = total.crossJoin(shown).where(F.col("n") > slices).select(F.lit(REST).alias("label"), (F.col("t") - F.col("s")).alias("v1"), "t")
    return kept.select("label", "v1", "t").unionByName(rest).select("label", "v1", F.floor(F.col("v1") * 100 / F.col("t") + 0.5).cast("int").alias("share"))


def counter(df: DataFrame, column: str, as_of: Column, rule: Filter | None = None, since: Column | None = None) -> DataFrame:
    """One row: since (the latest date, else the fixed one) and days from it to ``as_of``, 0 at least."""
    rows = filtered(df, rule)
    last = rows.agg(F.max(_date(rows, column, as_of)).alias("d"))
    start = F.coalesce("d", since) if since is not None else F.col("d")
    return last.select(start.alias("since"), F.greatest(F.lit(0), F.datediff(as_of, start)).alias("days"))


def progress(value: Column, most: Column) -> Column:
    """Per cent of the maximum within 0 and 100; 0 if there is no maximum."""
    return F.when(F.coalesce(most, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), value * 100.0 / most)))


def delta_tone(delta: Column, good: str = "up") -> Column:
    """good, bad or neutral."""
    better = delta > 0 if good != "down" else delta < 0
    return F.when(delta.isNull() | (delta == 0), "neutral").when(better, "good").otherwise("bad")


def search(df: DataFrame, query: str) -> DataFrame:
    """Rows of which any cell holds the query, without case and accents."""
    wanted = norm(F.lit(query))
    hit = F.lit(False)
    for c in df.columns:
        hit = hit | F.contains(norm(F.col(f"`{c}`")), wanted)
    return df.where(hit)


def sort_keys(df: DataFrame, column: str, as_of: Column, descending: bool = False) -> list[Column]:
    """A total order: dates by day (unknown first), numbers before texts, texts without case and accents."""
    name = column_name(df, column)
    kind, c = dict(df.dtypes)[name], F.col(f"`{name}`")
    if kind in ("date", "timestamp"):
        keys = [F.coalesce(c.cast("date"), F.lit("1970-01-01").cast("date"))]
    else:
        n = number(c, kind)
        keys = [F.when(n.isNull(), 1).otherwise(0), n, norm(c), c.cast("string")]
    return [k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys]


def page(df: DataFrame, keys: list[Column], number_: int = 0, size: int = 100, more: int = 200) -> DataFrame:
    """A page of the sorted table: the first has ``size`` rows, each further one ``more``."""
    start = 0 if number_ == 0 else size + more * (number_ - 1)
    return df.orderBy(*keys).offset(start).limit(size if number_ == 0 else more)


def with_validity(df: DataFrame, column: str, as_of: Column, name: str = "Situação") -> DataFrame:
    return df.withColumn(name, validity(_date(df, column, as_of), as_of))


def timeline(df: DataFrame, column: str, ties: Sequence[str], most: int = 40) -> DataFrame:
    """The latest entries first."""
    return df.orderBy(F.col(column_name(df, column)).desc(), *[F.col(t).asc() for t in ties]).limit(most)


def checklist(df: DataFrame, done: Column) -> DataFrame:
    return df.agg(F.count_if(done).alias("done"), F.count("*").alias("total"))


def reshaped(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns by name in a new order; new ones are empty texts."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit("").alias(c) for c in columns])
