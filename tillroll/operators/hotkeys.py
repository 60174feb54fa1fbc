"""Groups too large for one task: finding them, and attaching values to rows in spite of them.

A group is *hot* when it has more rows than ``Limits.of`` allows. The limit is
at least ``rows / MAX_HOT_KEYS``, so at most ``MAX_HOT_KEYS`` groups can be hot
whatever the data: that is the bound behind every broadcast here. All other
groups fit into one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators.lineage import pinned, written
from tillroll.operators.rollup import Measure, cells, measured, rolled

GROUP_ROWS = 1_000_000
MAX_HOT_KEYS = 500_000
#: Rows that a task of the ordinary way has on average at most, however few shuffle partitions the session sets.
TASK_ROWS = 250_000


@dataclass(frozen=True)
class Limits:
    """How large a group may be for one task.

    ``rows`` is an upper bound of the rows of the table, where the caller knows
    one: a table no larger than ``group_rows`` needs no search for hot groups.
    """

    group_rows: int = GROUP_ROWS
    rows: int | None = None

    def of(self, rows: int) -> int:
        """Most rows a group of a table of ``rows`` rows may have to be handled inside one task."""
        return max(self.group_rows, ceil(rows / MAX_HOT_KEYS))

    def none_hot(self) -> bool:
        return self.rows is not None and self.rows <= self.group_rows


DEFAULT = Limits()


def read_once(df: DataFrame, limits: Limits) -> DataFrame:
    """Writes the rows once where hot groups are looked for: from there on many branches start, each of which would repeat the joins
    behind ``df``. A table too small for hot groups is read as it is."""
    return df if limits.none_hot() else written(df)


def together(df: DataFrame, anchor: str, rows: int | None) -> DataFrame:
    """The rows of an anchor in one task; ``rows``, the size of ``df`` or a bound of it, gives the least number of tasks."""
    wanted = ceil((rows or 0) / TASK_ROWS)
    if wanted <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(anchor)
    return df.repartition(wanted, anchor)


@dataclass(frozen=True)
class Hot:
    """Hot groups of some rows: their keys (None when there are none), the limit they exceed and the number of rows, where known."""

    names: tuple[str, ...]
    keys: DataFrame | None
    limit: int
    rows: int | None = None

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of ``df`` outside and inside the hot groups."""
        renamed = F.broadcast(self.keys.select(*[F.col(k).alias(f"hot_{k}") for k in self.names]))
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"hot_{k}")) for k in self.names])
        return df.join(renamed, same, "left_anti"), df.join(renamed, same, "left_semi")

    def apply(
        self,
        df: DataFrame,
        ordinary: Callable[[DataFrame], DataFrame],
        oversized: Callable[[DataFrame], DataFrame],
    ) -> DataFrame:
        """``ordinary`` over the rows of groups that fit into a task, ``oversized`` over the others."""
        if self.keys is None:
            return ordinary(df)
        cold_rows, hot_rows = self.split(df)
        return ordinary(cold_rows).unionByName(oversized(hot_rows))


def hot_keys(df: DataFrame, keys: Sequence[str], limits: Limits = DEFAULT) -> Hot:
    """The hot groups of ``df``, from a count with map-side combine that reads the key columns only."""
    if limits.none_hot():
        return Hot(tuple(keys), None, limits.group_rows, limits.rows)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"))
    totals = sizes.agg(F.sum("group_rows").alias("rows"), F.max("group_rows").alias("largest")).first()
    rows = totals["rows"] or 0
    limit = limits.of(rows)
    if (totals["largest"] or 0) <= limit:
        return Hot(tuple(keys), None, limit, rows)
    return Hot(tuple(keys), pinned(sizes.filter(F.col("group_rows") > limit).select(*keys)), limit, rows)


def lookup(df: DataFrame, side: DataFrame, keys: Sequence[str], rows: str, limit: int) -> DataFrame:
    """Left join of ``side`` (one row per key) to ``df`` that no hot key can overload.

    ``rows`` names the column of ``side`` with the number of rows of ``df`` per
    key. Keys above ``limit`` (few, see ``Limits.of``) are broadcast; the others
    meet in a shuffle. Rows that take no part in the shuffle join, because their
    key is hot or NULL, get a spread value and are scattered instead of meeting
    in one task. The spread is a function of task and content, so a task that
    runs again places its rows as before.
    """
    values = [c for c in side.columns if c not in keys and c != rows]
    large = side.filter(F.col(rows) > limit).select(*keys, F.struct(*values).alias("from_large"))
    small = side.filter(F.col(rows) <= limit).select(
        *keys, F.lit(0).cast("long").alias("spread"), F.struct(*values).alias("from_small")
    )
    met = df.join(F.broadcast(large), list(keys), "left")
    apart = reduce(or_, [F.col(k).isNull() for k in keys], F.col("from_large").isNotNull())
    scatter = F.xxhash64(F.spark_partition_id(), *df.columns).bitwiseOR(F.lit(1).cast("long"))
    met = met.withColumn("spread", F.when(apart, scatter).otherwise(F.lit(0).cast("long")))
    met = met.join(small, [*keys, "spread"], "left")
    found = F.coalesce("from_large", "from_small")
    return met.select(*df.columns, *[found[v].alias(v) for v in values])


def lookup_table(df: DataFrame, side: DataFrame, keys: Sequence[str], rows: str, limits: Limits = DEFAULT) -> DataFrame:
    """``lookup`` of a table whose size is not known: counted first, and broadcast whole where it is small."""
    side = written(side)
    sizes = side.agg(F.count(F.lit(1)).alias("keys"), F.sum(rows).alias("rows")).first()
    if sizes["keys"] <= MAX_HOT_KEYS:
        return df.join(F.broadcast(side.drop(rows)), list(keys), "left")
    return lookup(df, side, keys, rows, limits.of(sizes["rows"]))


@dataclass(frozen=True)
class GroupStats:
    """Aggregates over the groups of ``keys``, to be attached to every row of the group; measures can be rolled up."""

    keys: tuple[str, ...]
    aggregates: dict[str, Column | Measure]

    def columns(self) -> dict[str, Column]:
        return {name: a.of_rows() if isinstance(a, Measure) else a for name, a in self.aggregates.items()}

    def rolls_up(self) -> bool:
        return all(isinstance(a, Measure) for a in self.aggregates.values())


def attach(
    df: DataFrame,
    stats: Sequence[GroupStats],
    anchor: str,
    hot: Hot | None = None,
    limits: Limits = DEFAULT,
) -> DataFrame:
    """``df`` with group aggregates on every row; every key list starts with ``anchor``.

    Groups of ordinary size use windows, which share one exchange on ``anchor``.
    Rows of hot anchors go another way: their aggregates are pre-aggregated on
    the map side and looked up. Without ``hot``, the rows are written once before the search.
    """
    if hot is None:
        df = read_once(df, limits)
        hot = hot_keys(df, [anchor], limits)
    return hot.apply(
        df, lambda rows: with_windows(rows, stats, anchor, hot.rows), lambda rows: with_lookups(rows, stats, anchor, hot.limit)
    )


def with_windows(df: DataFrame, stats: Sequence[GroupStats], anchor: str, rows: int | None = None) -> DataFrame:
    """For anchors of ordinary size: one exchange for all windows, and one sort per key list."""
    columns = {}
    for s in stats:
        _check_anchor(s, anchor)
        in_group = reduce(and_, [F.col(k).isNotNull() for k in s.keys])
        window = Window.partitionBy(*s.keys)
        columns.update({name: F.when(in_group, agg.over(window)) for name, agg in s.columns().items()})
    return together(df, anchor, rows).withColumns(columns)


def with_lookups(df: DataFrame, stats: Sequence[GroupStats], anchor: str, limit: int) -> DataFrame:
    """For the rows of hot anchors, of which there are at most ``MAX_HOT_KEYS``.

    Measures of all key lists come from one aggregation of the rows over the union of the keys, rolled up for each list.
    """
    out = df
    rolling = [s for s in stats if s.rolls_up()]
    if rolling:
        finest = list(dict.fromkeys(k for s in rolling for k in s.keys))
        base = written(cells(df, finest, [m for s in rolling for m in s.aggregates.values()]))
    for s in stats:
        _check_anchor(s, anchor)
        if s.rolls_up():
            side = measured(rolled(base, s.keys), s.keys, s.aggregates)
        else:
            side = df.groupBy(*s.keys).agg(
                F.count(F.lit(1)).alias("group_rows"), *[agg.alias(name) for name, agg in s.columns().items()]
            )
        if s.keys == (anchor,):
            out = out.join(F.broadcast(side.drop("group_rows")), [anchor], "left")
        else:
            out = lookup(out, side, s.keys, "group_rows", limit)
    return out


def _check_anchor(stats: GroupStats, anchor: str) -> None:
    if stats.keys[0] != anchor:
        raise ValueError(f"the keys {stats.keys} must start with {anchor}")
