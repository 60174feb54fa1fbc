"""Features with one row per client, and their way back to the transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.timeparts import weekday_of
from tillroll.operators import rollup
from tillroll.operators.hotkeys import DEFAULT, Hot, Limits, hot_keys, read_once, together
from tillroll.operators.lineage import written
from tillroll.operators.percentiles import percentiles_by
from tillroll.operators.scaling import winsorized

SIDES = ("amount_up", "amount_down")
WEEKDAYS = range(7)
NUNIQUE = {"term_id": "count_term_id", "trans_type": "count_trans_type", "mcc_code": "count_mcc_code"}

# The file layout names of the same three counts in the second feature builder.
NUNIQUE_ALIASES = {f"count_{c}": f"{c}_client_nunique" for c in NUNIQUE}


def money_aggregates() -> dict[str, Column]:
    """mean, std, count, sum of both sides; medians are kept apart, see ``median_aggregates``."""
    out = {}
    for c in SIDES:
        out[f"{c}_client_mean"] = F.avg(c)
        out[f"{c}_client_std"] = F.stddev_samp(c)
        out[f"{c}_client_count"] = F.count(c)
        out[f"{c}_client_sum"] = F.coalesce(F.sum(c), F.lit(0.0))
    return out


def median_aggregates() -> dict[str, Column]:
    return {f"{c}_client_median": F.median(c) for c in SIDES}


def nunique_in_one_task() -> dict[str, Column]:
    """Distinct counts from sets, for clients whose rows are in one task: no row is multiplied, nothing is shuffled again."""
    return {name: F.size(F.collect_set(c)).cast("long") for c, name in NUNIQUE.items()}


def weekday_aggregates() -> dict[str, Column]:
    """Non-null counts per weekday; NULL where the client has no row on that weekday."""
    out = {}
    for c in SIDES:
        for d in WEEKDAYS:
            present = F.count(F.when(F.col("weekday") == d, 1))
            out[f"{c}_weekday_{d}"] = F.when(present > 0, F.count(F.when(F.col("weekday") == d, F.col(c))))
    return out


def weekday_means() -> dict[str, Column]:
    """Mean count over the weekdays on which the client has rows: non-null amounts by distinct weekdays."""
    days = sum((F.max((F.col("weekday") == d).cast("int")) for d in WEEKDAYS), F.lit(0))
    return {
        f"amount_mean_{c.removeprefix('amount_')}_weekday": F.count(F.when(F.col("weekday").isNotNull(), F.col(c)))
        / F.nullif(days, F.lit(0))
        for c in SIDES
    }


def span_days(grain: str) -> Column:
    """Whole days between the first and the last transaction."""
    if grain == "day":
        return F.max("day") - F.min("day")
    return F.timestamp_diff("DAY", F.min("trans_ts"), F.max("trans_ts")).cast("int")


def days_per_transaction(grain: str = "day") -> Column:
    return span_days(grain) / F.count(F.lit(1))


def transactions_per_day(grain: str = "second") -> Column:
    """Infinite when the client is active on one day only."""
    span = span_days(grain)
    return F.when(span == 0, F.lit(float("inf"))).otherwise(F.count(F.lit(1)) / F.nullif(span, F.lit(0)))


def with_weekday(df: DataFrame, grain: str) -> DataFrame:
    """Weekday of the day number, or of the full timestamp (second 60 may reach the next day)."""
    return df.withColumn("weekday", weekday_of(F.col("day")) if grain == "day" else F.weekday("trans_ts"))


def by_client(df: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    """One row per client from aggregates that combine on the map side."""
    return df.groupBy("client_id").agg(*[agg.alias(name) for name, agg in aggregates.items()])


def with_whole_clients(
    df: DataFrame,
    aggregates: dict[str, Column],
    medians: bool = False,
    distinct: bool = False,
    hot: Hot | None = None,
    limits: Limits = DEFAULT,
) -> DataFrame:
    """``by_client`` with medians and distinct counts, which need all rows of a client.

    Clients of ordinary size come together in one exchange of the plain rows.
    Distinct counts have an aggregation of their own, over columns the other one
    does not carry. Clients too large for one task spread: distinct values are
    reduced before they meet, medians are counted. Without ``hot``, the rows are
    written once before the search for such clients.
    """

    def ordinary(rows: DataFrame) -> DataFrame:
        dealt = together(rows, "client_id", hot.rows)
        plain = {**aggregates, **(median_aggregates() if medians else {})}
        if not distinct:
            return by_client(dealt, plain)
        counts = by_client(dealt, nunique_in_one_task())
        return by_client(dealt, plain).join(counts, "client_id") if plain else counts

    def oversized(rows: DataFrame) -> DataFrame:
        out = by_client(rows, aggregates) if aggregates else None
        if distinct:
            counts = rollup.distinct_counts(rows, ["client_id"], NUNIQUE)
            out = counts if out is None else out.join(counts, "client_id")
        if medians:
            cells = rows.select("client_id", F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).cast("double").alias("value")) for c in SIDES])).alias("cell"))
            found = percentiles_by(cells.select("client_id", "cell.*"), F.col("value"), [0.5], ["client_id", "side"], limits=limits)
            each = [F.max(F.when(F.col("side") == c, F.col("percentiles")[0])).alias(f"{c}_client_median") for c in SIDES]
            out = out.join(found.groupBy("client_id").agg(*each), "client_id", "left")
        return out

    if hot is None:
        df = read_once(df, limits)
        hot = hot_keys(df, ["client_id"], limits)
    return hot.apply(df, ordinary, oversized)


def money_profile(df: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """mean, median, std, count, sum of income and spend per client."""
    return with_whole_clients(df.select("client_id", *SIDES), money_aggregates(), medians=True, limits=limits)


def distinct_counts(df: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Distinct terminals, transaction types and codes per client; NULL is not counted."""
    return with_whole_clients(df.select("client_id", *NUNIQUE), {}, distinct=True, limits=limits)


def weekday_counts(df: DataFrame) -> DataFrame:
    """Non-null counts per (client, weekday), long form."""
    return df.groupBy("client_id", "weekday").agg(*[F.count(c).alias(c) for c in SIDES])


def weekday_pivot(df: DataFrame) -> DataFrame:
    """The same with one column per side and weekday.

    The long form comes first, so that a transaction feeds two counts instead of one per cell.
    """
    cells = {
        f"{c}_weekday_{d}": F.max(F.when(F.col("weekday") == d, F.col(c))) for c in SIDES for d in WEEKDAYS
    }
    return by_client(weekday_counts(df), cells)


def net_difference(features: DataFrame) -> DataFrame:
    """Income minus spend per client."""
    return features.withColumn("delta_up_down", F.col("amount_up_client_sum") - F.col("amount_down_client_sum"))


def winsorized_difference(features: DataFrame, rows: str = "n_rows", limits: Limits = DEFAULT) -> DataFrame:
    """``net_difference`` cut at the percentiles over transactions: a client weighs by its row count.

    The client table is written out first: it is read for the percentiles and
    again for its rows, and computing it reads all transactions.
    """
    return winsorized(written(net_difference(features)), ["delta_up_down"], weight=F.col(rows), limits=limits)


def client_features(
    df: DataFrame,
    further: dict[str, Column],
    winsorize_difference: bool,
    hot: Hot | None = None,
    limits: Limits = DEFAULT,
) -> DataFrame:
    """Money profile, distinct counts, difference and ``further`` aggregates."""
    out = with_whole_clients(
        df,
        {**money_aggregates(), **further, "n_rows": F.count(F.lit(1))},
        medians=True,
        distinct=True,
        hot=hot,
        limits=limits,
    )
    return winsorized_difference(out, limits=limits) if winsorize_difference else net_difference(out)


def joined_back(df: DataFrame, features: DataFrame, hot: Hot | None = None, limits: Limits = DEFAULT) -> DataFrame:
    """Client features on every transaction of the client.

    Hot clients are few, so their features are broadcast; the others meet in a
    join in which no client exceeds the row limit. Without ``hot``, the rows
    are written once before the search for such clients.
    """
    features = features.drop("n_rows")
    if hot is None:
        df = read_once(df, limits)
        hot = hot_keys(df, ["client_id"], limits)
    return hot.apply(
        df,
        lambda rows: rows.join(features if hot.keys is None else hot.split(features)[0], "client_id"),
        lambda rows: rows.join(F.broadcast(hot.split(features)[1]), "client_id"),
    )
