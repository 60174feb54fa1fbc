"""Exact-size samples, class balancing and hold-outs, repeatable by seed."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators.hotkeys import lookup_table
from tillroll.operators.joins import of_clients
from tillroll.operators.lineage import pinned, written

#: Bits of the draw that a pass looks at, and rows at the edge of a group below which no further pass is worth it.
DIGIT_BITS, EDGE_ROWS = 16, 100_000
COPIES_PER_ROW = 1 << 20


def _draws(df: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    rows = df.dropna(subset=list(keys)) if keys else df
    return rows.withColumn("draw", F.xxhash64(F.lit(seed), *df.columns))


def _met(rows: DataFrame, side: DataFrame, keys: Sequence[str], sizes: str) -> DataFrame:
    """Rows with the values of their group; ``side`` has a row for each group and ``sizes`` its number of rows."""
    if keys:
        return lookup_table(rows, side, keys, sizes)
    return rows.withColumns({c: side.select(c).scalar() for c in side.columns if c != sizes})


def edges(df: DataFrame, n: int | None, by: Sequence[str], seed: int, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """For each group the range of draws [``low``, ``high``] in which its n-th lowest draw lies, and the rows ``missing`` below it.

    Radix selection, for all groups at once: a pass counts the rows of each group's range by the next 16 bits of the draw (with
    map-side combine) and keeps the digit that holds the n-th row. One pass leaves a 65,536th of a group; a further one is made only
    where that has more than ``edge_rows`` rows, and after four a range is one draw. Without ``n`` the smallest group gives it.
    """
    keys = list(by)
    draws = _draws(df, keys, seed).select(*keys, "draw")
    state, shift = None, 64
    while shift:
        shift -= DIGIT_BITS
        rows = draws
        if state is not None:
            # signed numbers: the order of the draws is that of their leading bits, then of the rest
            rows = _met(draws, state.filter("open").select(*keys, "low", "high", "total"), keys, "total")
            rows = rows.filter(F.col("draw").between(F.col("low"), F.col("high")))
        counts = rows.groupBy(*keys, F.shiftright("draw", shift).alias("digit")).agg(F.count(F.lit(1)).alias("size"))
        # at most 65,536 rows in a group
        upto = Window.partitionBy(*keys).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("through", F.sum("size").over(upto))
        if state is None:
            counts = pinned(counts)
            totals = counts.groupBy(*keys).agg(F.sum("size").alias("total"))
            if n is None:
                n = totals.agg(F.min("total")).first()[0] or 0
            short = totals.filter(F.coalesce(F.col("total"), F.lit(0)) < n).first()
            if short is not None:
                raise ValueError(f"a group has fewer than {n} rows: {short.asDict()}")
            wanted = totals.withColumn("missing", F.lit(n).cast("long"))
        else:
            wanted = state.filter("open").select(*keys, "total", "missing")
        at = F.min(F.when(F.col("through") >= F.col("missing"), F.struct("digit", "through", "size")))
        found = counts.join(wanted, keys) if keys else counts.withColumns({c: wanted.select(c).scalar() for c in ("total", "missing")})
        last = found.groupBy(*keys).agg(at.alias("last"), F.max("missing").alias("missing"), F.max("total").alias("total"))
        low = F.shiftleft(F.col("last.digit"), shift)
        high = low + F.lit((1 << shift) - 1)
        # Where the last digit is taken whole, the edge shrinks to its highest draw.
        whole = F.col("missing") == F.col("last.through")
        step = last.select(
            *keys, F.when(whole, high).otherwise(low).alias("low"), high.alias("high"),
            F.when(whole, F.col("total")).otherwise(F.col("missing") - F.col("last.through") + F.col("last.size")).alias("missing"), "total",
            ((F.col("last.size") > edge_rows) & ~whole).alias("open"),
        )
        state = pinned(step if state is None else step.unionByName(state.filter("NOT open")))
        if state.filter("open").isEmpty():
            break
    return state


def exact_parts(
    df: DataFrame, n: int | None, by: Sequence[str] = (), seed: int = 0, edge_rows: int = EDGE_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Exactly ``n`` rows (per group of ``by``, if given; of the smallest group, without ``n``) without replacement, and all others.

    Rows are taken by hash of seed and content, so the draw depends on the data alone. Rows below the edge of their group (see
    ``edges``) are taken straight from the scan, rows above it are not; only those at the edge are shuffled and put in order, equal
    rows as one row with a number of copies. Fails when a group has fewer than ``n`` rows. Rows without a group are in neither part.
    """
    names, keys = df.columns, list(by)
    state = edges(df, n, keys, seed, edge_rows).select(*keys, "low", "high", "missing", "total")
    marked = _met(_draws(df, keys, seed), state, keys, "total")
    edge = marked.filter(F.col("draw").between(F.col("low"), F.col("high")))
    copies = edge.groupBy(*names, "draw", "missing").agg(F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy(*keys).orderBy("draw", *names).rowsBetween(Window.unboundedPreceding, 0)
    take = F.greatest(F.lit(0), F.least(F.col("copies"), F.col("missing") - F.sum("copies").over(order) + F.col("copies")))
    ranked = copies.withColumn("take", take).withColumn("leave", F.col("copies") - F.col("take"))

    def part(whole: Column, number: str) -> DataFrame:
        some = ranked.filter(F.col(number) > 0).select(*names, number)
        return marked.filter(whole).select(*names).unionByName(repeated(some, number))

    return part(F.col("draw") < F.col("low"), "take"), part(F.col("draw") > F.col("high"), "leave")


def exact_sample(df: DataFrame, n: int | None, by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """The first part of ``exact_parts``."""
    return exact_parts(df, n, by, seed)[0]


def repeated(df: DataFrame, copies: str) -> DataFrame:
    """Every row ``copies`` times; a large number is cut up and scattered before it is written out."""
    rest = df.filter(F.col(copies) == 1).drop(copies)
    many = df.filter(F.col(copies) > 1)
    parts = (
        many.withColumn("part", F.explode(F.sequence(F.lit(0), ((F.col(copies) - 1) / COPIES_PER_ROW).cast("long"))))
        .withColumn(
            "in_part", F.least(F.lit(COPIES_PER_ROW), F.col(copies) - F.col("part") * COPIES_PER_ROW).cast("int")
        )
        .repartition(*df.columns, "part")
    )
    copied = parts.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("in_part"))))
    return rest.unionByName(copied.select(*rest.columns))


def balanced_sample(df: DataFrame, n: int | None = None, seed: int = 0) -> DataFrame:
    """The same number of rows of every gender, that of the smallest one if ``n`` isn't given."""
    return exact_sample(df, n, ["gender"], seed)


def client_list(df: DataFrame) -> DataFrame:
    """Clients with their label."""
    return df.select("client_id", "gender").distinct()


def holdout(df: DataFrame, n: int, per_gender: bool = False, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows of all other clients, and rows of ``n`` clients held out (per gender, if asked for).

    The held clients are written once, as both sides use the list, each perhaps many times. Spark broadcasts it by its size in
    bytes; a longer one meets the rows in a shuffle, where adaptive execution splits clients with many rows.
    """
    held = written(exact_sample(client_list(df), n, ["gender"] if per_gender else [], seed).select("client_id"))
    return df.join(held, "client_id", "left_anti"), of_clients(df, held)


def row_split(df: DataFrame, test_share: float = 0.3, seed: int = 234) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, exactly ``ceil(test_share * rows)`` of the latter.

    Stateless: a row's side follows from its content and, among equal rows, from their number, so both sides fit together however
    often they are computed. Rows of one client fall on both sides; prefer ``holdout`` for evaluation.
    """
    test, rest = exact_parts(df, ceil(test_share * df.count()), seed=seed)
    return rest, test


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(``only_left``, ``only_right``): rows that one table has more often than the other, by a 64-bit hash of their content."""
    signed = [
        df.select(F.xxhash64(*sorted(left.columns)).alias("row"), F.lit(sign).alias("sign")) for df, sign in ((left, 1), (right, -1))
    ]
    balance = signed[0].unionByName(signed[1]).groupBy("row").agg(F.sum("sign").alias("more"))
    return balance.agg(
        F.coalesce(F.sum(F.greatest("more", F.lit(0))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.greatest(-F.col("more"), F.lit(0))), F.lit(0)).alias("only_right"),
    )
