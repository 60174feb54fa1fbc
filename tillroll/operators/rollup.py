"""A lattice of roll-ups: rows are aggregated once, over the finest keys, and all coarser groups follow from these cells."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAIN = {"count": F.count, "sum": F.sum, "avg": F.avg, "std": F.stddev_samp}
#: What a cell keeps of a value for each kind of measure.
PARTS = {"count": {"n"}, "sum": {"n", "sum"}, "avg": {"n", "sum"}, "std": {"n", "sum", "low", "high", "square"}}


@dataclass(frozen=True, eq=False)
class Measure:
    """An aggregate of a named value, which works on rows and on cells alike."""

    kind: str
    name: str
    value: Column

    def of_rows(self) -> Column:
        return PLAIN[self.kind](self.value)

    def of_parts(self) -> Column:
        n, total = F.col(f"{self.name}__n"), F.col(f"{self.name}__sum") if self.kind != "count" else None
        if self.kind == "count":
            return n
        if self.kind == "sum":
            return F.when(n > 0, total)
        if self.kind == "avg":
            return total / F.nullif(n, F.lit(0))
        return F.when(n > 1, F.sqrt(F.col(f"{self.name}__square") / (n - 1)))


def cells(df: DataFrame, keys: Sequence[str], measures: Iterable[Measure]) -> DataFrame:
    """One row for each combination of ``keys`` (map-side combined), with the parts that the measures need and ``group_rows``."""
    wanted: dict[str, tuple[Column, set[str]]] = {}
    for m in measures:
        wanted.setdefault(m.name, (m.value, set()))[1].update(PARTS[m.kind])
    parts = {
        "n": F.count,
        "sum": lambda v: F.coalesce(F.sum(v.cast("double")), F.lit(0.0)),
        "low": F.min,
        "high": F.max,
        "square": lambda v: F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)),
    }
    found = [f(value).alias(f"{name}__{p}") for name, (value, some) in wanted.items() for p, f in parts.items() if p in some]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"), *found)


def rolled(finer: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of coarser ``keys`` from finer ones.

    ``square`` (squared deviations from the mean) of a group is that of its cells and of their means; where all values of a group are
    one, it is 0 without the noise of sums.
    """
    out = []
    for column in finer.columns:
        name, _, part = column.rpartition("__")
        if column == "group_rows" or part in ("n", "sum"):
            out.append(F.sum(column).alias(column))
        elif part == "low":
            out.append(F.min(column).alias(column))
        elif part == "high":
            out.append(F.max(column).alias(column))
        elif part == "square":
            n, total = F.col(f"{name}__n"), F.col(f"{name}__sum")
            of_means = F.sum(F.coalesce(total * total / F.nullif(n, F.lit(0)), F.lit(0.0))) - F.sum(total) * F.sum(total) / F.nullif(
                F.sum(n), F.lit(0)
            )
            same = F.min(f"{name}__low") == F.max(f"{name}__high")
            out.append(F.when(same, F.lit(0.0)).otherwise(F.greatest(F.sum(column) + of_means, F.lit(0.0))).alias(column))
    return finer.groupBy(*keys).agg(*out)


def measured(rolled_up: DataFrame, keys: Sequence[str], measures: dict[str, Measure]) -> DataFrame:
    """Keys, ``group_rows`` and the measures."""
    return rolled_up.select(*keys, "group_rows", *[m.of_parts().alias(name) for name, m in measures.items()])


def distinct_counts(df: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Distinct non-null values of several columns per group, from their combinations: no row is multiplied, only combinations are."""
    combined = df.groupBy(*keys, *columns).agg(F.count(F.lit(1)).alias("group_rows"))
    stacked = combined.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
        ).alias("cell"),
    ).select(*keys, "cell.*")
    values = stacked.groupBy(*keys, "column_name", "value").agg(F.count(F.lit(1)).alias("cells"))
    counted = [F.count(F.when(F.col("column_name") == c, F.col("value"))).alias(name) for c, name in columns.items()]
    return values.groupBy(*keys).agg(*counted)
