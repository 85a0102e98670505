"""A global order without a window over all rows.

Rows are dealt to ranges of (group, order keys), sorted there and written. A row's place
is its place in its range plus what earlier ranges hold of its group. A range starts with
at most one group that an earlier range has begun, so what is carried over is one row
for each range at most, and a group that holds all rows is shared by all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def _free(df: DataFrame, *names: str) -> list[str]:
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


Key = str | Column | tuple[str | Column, str]


def _keys(order: Sequence[Key]) -> list[tuple[Column, str]]:
    """Expression and direction (asc, desc, asc_nulls_last, desc_nulls_first) of each key."""
    pairs = [k if isinstance(k, tuple) else (k, "asc") for k in order]
    return [(F.col(f"`{c}`") if isinstance(c, str) else c, way) for c, way in pairs]


def ranked(
    df: DataFrame, order: Sequence[Key], within: Sequence[str] = (), name: str = "rank", sums: dict[str, Column] | None = None, ties: bool = False
) -> DataFrame:
    """``df`` with ``name``: each row's number, from 1, in the order of ``order`` among the
    rows alike in the columns ``within``; and for each of ``sums`` the total of the column
    over all rows before it.

    Without ``ties`` rows alike in all keys are numbered freely, so give keys that tell
    rows apart; with ``ties`` they share the smallest number (and all see the same sums).
    Null groups are a group; nulls stand where ``order`` puts them. An empty table
    gives an empty table. Writes the rows once to the shared folder.
    """
    sums, found = dict(sums or {}), _keys(order)
    part, at, *more = _free(df, "part", "at", *[f"key{k}" for k in range(len(found))], *[f"sum{k}" for k in range(len(sums))])
    keys, adds = more[: len(found)], more[len(found) :]
    groups = [F.col(f"`{c}`") for c in within]
    by = [getattr(F.col(k), way)() for k, (_, way) in zip(keys, found, strict=True)]
    every = df.select("*", *[e.alias(k) for k, (e, _) in zip(keys, found, strict=True)], *[c.alias(k) for k, c in zip(adds, sums.values(), strict=True)])
    dealt = every.repartitionByRange(*groups, *by).sortWithinPartitions(*groups, *by)
    placed = written(dealt.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(at)), "ordered")
    own = Window.partitionBy(part, *groups)
    held = placed.groupBy(part, *groups).agg(F.count("*").alias(name), *[F.sum(k).alias(k) for k in adds])
    part0, n0, *more = _free(placed, "part0", "n0", *[f"group{k}" for k in range(len(groups))], *[f"before{k}" for k in range(len(adds))])
    groups0, before0 = more[: len(groups)], more[len(groups) :]
    earlier = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = held.select(
        F.col(part).alias(part0),
        *[g.alias(x) for g, x in zip(groups, groups0, strict=True)],
        F.sum(f"`{name}`").over(earlier).alias(n0),
        *[F.sum(k).over(earlier).alias(b) for k, b in zip(adds, before0, strict=True)],
    ).where(F.col(n0).isNotNull())  # one row for each range at most
    same = F.col(part) == F.col(part0)
    for g, x in zip(groups, groups0, strict=True):
        same &= g.eqNullSafe(F.col(x))
    local = placed.withColumn(name, (F.rank().over(own.orderBy(*by)) if ties else F.row_number().over(own.orderBy(at))).cast("long"))
    for k in adds:
        local = local.withColumn(k, F.coalesce(F.sum(k).over(own.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        if ties:  # all of a tie lie in one range
            local = local.withColumn(k, F.first(k).over(Window.partitionBy(part, *groups, *keys).orderBy(at)))
    joined = local.join(F.broadcast(carried), same, "left")
    number = (F.col(f"`{name}`") + F.coalesce(n0, F.lit(0))).alias(name)
    before = [(F.col(k) + F.coalesce(b, F.lit(0))).alias(s) for k, b, s in zip(adds, before0, sums, strict=True)]
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], number, *before)


def placed_among(df: DataFrame, order: Sequence[Key], within: Sequence[str] = (), tiles: int = 4) -> DataFrame:
    """``df`` with row_number, rank, ntile, percent_rank and cume_dist of each row in the
    order of ``order`` among the rows alike in ``within``; the same numbers as SQL's.

    ``order`` should tell rows apart: else row_number and ntile deal ties freely. The size of each
    group joins by group; no window holds one.
    """
    rows = ranked(ranked(df, order, within, "row_number"), order, within, "rank", ties=True)
    groups = [F.col(f"`{c}`") for c in within]
    keys, (n, last) = [e for e, _ in _keys(order)], _free(rows, "rows_", "last_")
    found = _free(rows, *[f"k{i}_" for i in range(len(keys))])
    sizes = rows.groupBy(*groups).agg(F.count("*").alias(n))
    ends = rows.groupBy(*groups, *[k.alias(x) for k, x in zip(keys, found, strict=True)]).agg(F.max("row_number").alias(last))
    rows = _joined(rows, sizes, [*zip(groups, within, strict=True)])
    rows = _joined(rows, ends, [*zip(groups, within, strict=True), *zip(keys, found, strict=True)])
    small, large = F.floor(F.col(n) / tiles), F.col(n) % tiles  # the first `large` tiles hold one row more
    k = F.col("row_number") - 1
    ntile = F.when(k < large * (small + 1), F.floor(k / (small + 1))).otherwise(large + F.floor((k - large * (small + 1)) / F.greatest(small, F.lit(1)))) + 1
    percent = F.when(F.col(n) > 1, (F.col("rank") - 1) / (F.col(n) - 1)).otherwise(F.lit(0.0))
    return rows.select(
        *[F.col(f"`{c}`") for c in df.columns],
        "row_number",
        "rank",
        ntile.cast("long").alias("ntile"),
        percent.alias("percent_rank"),
        (F.col(last) / F.col(n)).alias("cume_dist"),
    )


def _joined(left: DataFrame, right: DataFrame, on: Sequence[tuple[Column, str]]) -> DataFrame:
    """Rows of ``left`` with what ``right`` holds for equal keys, nulls alike; without keys, with its one row."""
    names = _free(left, *[f"on{k}" for k in range(len(on))])
    right = right.withColumnsRenamed({c: x for (_, c), x in zip(on, names, strict=True)})
    if not on:
        return left.crossJoin(F.broadcast(right))  # one row
    same = F.lit(True)
    for (key, _), x in zip(on, names, strict=True):
        same &= key.eqNullSafe(F.col(x))
    return left.join(right, same).drop(*names)


def over_range(df: DataFrame, order: str, reach: float, aggregates: dict[str, str], within: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``aggregates`` (SQL, such as "sum(v)") over the rows of its group whose number ``order`` is at
    most ``reach`` smaller: SQL's RANGE BETWEEN reach PRECEDING AND CURRENT ROW.

    Numbers are cut into cells of width ``reach``; a row is also lent to the next cell, so a frame
    never needs a third one and a task holds cells, not groups. ``first`` and ``last`` see rows in
    the order of the number. A null number has a frame of its own: all nulls of its group.
    """
    cell, own, x = _free(df, "cell", "own", "x")
    groups = [F.col(f"`{c}`") for c in within]
    number = F.col(f"`{order}`").cast("double")
    here = F.floor(number / F.lit(float(reach))).cast("long")
    copies = F.when(number.isNull(), F.array(F.struct(here.alias(cell), F.lit(True).alias(own)))).otherwise(
        F.array(F.struct(here.alias(cell), F.lit(True).alias(own)), F.struct((here + 1).alias(cell), F.lit(False).alias(own)))
    )
    lent = df.select("*", number.alias(x), F.inline(copies))
    by = ", ".join(f"`{c}`" for c in [*within, cell])
    frame = f"OVER (PARTITION BY {by} ORDER BY `{x}` RANGE BETWEEN {float(reach)}D PRECEDING AND CURRENT ROW)"
    return lent.select("*", *[F.expr(f"{a} {frame}").alias(k) for k, a in aggregates.items()]).where(own).drop(cell, own, x)
