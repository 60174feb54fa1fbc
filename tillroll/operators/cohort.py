"""Cohort questions over labelled transactions: counts, skews, exclusive codes, descriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.timeparts import date_of
from tillroll.operators.hotkeys import DEFAULT, Limits, lookup_table, read_once
from tillroll.operators.percentiles import percentiles_by

HOURS = range(24)
QUARTILES = [0.25, 0.5, 0.75]
SKETCH_BITS = 12


def non_null_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Non-null count of every other column per group; rows with a NULL key are in no group."""
    others = [c for c in df.columns if c not in keys]
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(*[F.count(c).alias(c) for c in others])


def code_counts(df: DataFrame, keys: Sequence[str], codes: Sequence[int]) -> DataFrame:
    """Transactions of the given codes per code and group; the filter reaches the scan. A NULL key is in no group."""
    kept = df.filter(F.col("MCC").isin(list(codes)))
    return (kept.dropna(subset=list(keys)) if keys else kept).groupBy("MCC", *keys).agg(F.count("MCC").alias("n"))


def peak_days(df: DataFrame, code: int, n: int | None = None) -> DataFrame:
    """Days of one code by falling count; the first ``n`` when given. Ties go by day and gender."""
    counts = code_counts(df, ["gender", "day"], [code]).drop("MCC")
    ordered = counts.orderBy(F.desc("n"), "day", "gender")
    return ordered if n is None else ordered.limit(n)


def day_slice(df: DataFrame, first: int, last: int) -> DataFrame:
    """Non-null counts per (gender, day) for days in [first, last]."""
    return non_null_counts(df.filter(F.col("day").between(first, last)), ["gender", "day"])


def count_slice(df: DataFrame, first: int, last: int | None = None, keys: Sequence[str] = ("gender", "day")) -> DataFrame:
    """Lines ``first`` up to but not including ``last`` (all, if not given) of the non-null counts in the order of ``keys``."""
    rest = non_null_counts(df, keys).orderBy(*keys).offset(first)
    return rest if last is None else rest.limit(last - first)


def hour_profile(df: DataFrame) -> DataFrame:
    """Counts on a full 0..23 axis per gender; hours without a transaction are 0. A NULL gender is in no group."""
    wide = df.dropna(subset=["gender"]).groupBy("gender").agg(F.array(*[F.count_if(F.col("hour") == h) for h in HOURS]).alias("counts"))
    return wide.select("gender", F.posexplode("counts").alias("index_hour", "n"))


def day_mod7_counts(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["day"]).groupBy(F.pmod("day", F.lit(7)).alias("day_mod7")).agg(F.count("MCC").alias("n"))


def code_day_mod7_counts(df: DataFrame, codes: Sequence[int]) -> DataFrame:
    return code_counts(df.withColumn("day_mod7", F.pmod("day", F.lit(7))), ["day_mod7"], codes)


def day_mod7_groups(df: DataFrame, code: int) -> DataFrame:
    """How many (gender, day) groups of one code fall on each ``day % 7``."""
    return day_mod7_counts(code_counts(df, ["gender", "day"], [code])).withColumnRenamed("n", "n_groups")


def code_value_counts(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["gender", "MCC"]).groupBy("gender", "MCC").agg(F.count(F.lit(1)).alias("n"))


def _count_of(gender: int, column: str) -> Column:
    return F.count(F.when(F.col("gender") == gender, F.col(column)))


def code_count_difference(df: DataFrame) -> DataFrame:
    """Counts of both genders per code; a side without the code is NULL, and so is the difference."""
    counts = (
        df.dropna(subset=["MCC"])
        .filter(F.col("gender").isin(0, 1))
        .groupBy("MCC")
        .agg(*[F.nullif(_count_of(g, "MCC"), F.lit(0)).alias(name) for g, name in ((1, "count_true"), (0, "count_false"))])
    )
    return counts.withColumn("diff_true_false", F.col("count_true") - F.col("count_false"))


def gender_skew(df: DataFrame) -> DataFrame:
    """Counts of non-null amounts per code and gender, their difference, total and normalised difference."""
    counts = (
        df.dropna(subset=["mcc_code"])
        .groupBy("mcc_code")
        .agg(_count_of(0, "amount").alias("count_0"), _count_of(1, "amount").alias("count_1"))
    )
    difference, total = F.col("count_0") - F.col("count_1"), F.col("count_0") + F.col("count_1")
    return (
        counts.withColumns({"dif_count": difference, "all_count": total})
        .filter(F.col("all_count") > 0)
        .withColumn("dif", F.col("dif_count") / F.col("all_count"))
        .withColumn("dif_abs", F.abs("dif"))
    )


def with_gender_skew(df: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """The skew of its code on every transaction; rows whose code has none drop out."""
    sizes = df.dropna(subset=["mcc_code"]).groupBy("mcc_code").agg(
        F.count(F.lit(1)).alias("n_rows"),
        _count_of(0, "amount").alias("count_0"),
        _count_of(1, "amount").alias("count_1"),
    )
    side = sizes.select(
        "mcc_code",
        "n_rows",
        ((F.col("count_0") - F.col("count_1")) / F.nullif(F.col("count_0") + F.col("count_1"), F.lit(0))).alias("dif"),
    )
    return lookup_table(df, side, ["mcc_code"], "n_rows", limits).filter(F.col("dif").isNotNull())


def exclusive_codes(df: DataFrame) -> DataFrame:
    """Codes that one gender uses and the other never does."""
    used = df.dropna(subset=["MCC"]).groupBy("MCC").agg(
        F.max(F.col("gender") == 0).alias("by_0"), F.max(F.col("gender") == 1).alias("by_1")
    )
    return used.filter(F.col("by_0") != F.col("by_1")).select(
        F.when(F.col("by_1"), "gender=1").otherwise("gender=0").alias("used_only_by"), "MCC"
    )


def nuniques_by_group(df: DataFrame, grouper: str, groups: Sequence) -> DataFrame:
    """Distinct non-null values of every column: over all rows and per group, one line per column.

    Values are reduced to distinct (column, value) pairs with a flag per group
    first, so no task gathers the values of a column. Each of the given groups is one column
    of the result; ``nuniques_long`` has a line for each and no bound.
    """
    cells = df.select(
        F.col(grouper).alias("group_key"),
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in df.columns])
        ).alias("cell"),
    ).select("group_key", "cell.*")
    seen = cells.filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(
        *[F.max(F.col("group_key").eqNullSafe(F.lit(g))).alias(f"in_{g}") for g in groups]
    )
    return seen.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_all"), *[F.count_if(F.col(f"in_{g}")).alias(f"n_{grouper}_{g}") for g in groups]
    )


def _cells(df: DataFrame, grouper: str) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in df.columns]
    cells = df.select(F.col(grouper).alias("group_key"), F.explode(F.array(*pairs)).alias("cell")).select("group_key", "cell.*")
    return cells.filter("group_key IS NOT NULL AND value IS NOT NULL")


def nuniques_long(df: DataFrame, grouper: str) -> DataFrame:
    """(group_key, column_name, n): distinct non-null values of every column in every group, however many groups there are."""
    values = _cells(df, grouper).groupBy("group_key", "column_name", "value").agg(F.count(F.lit(1)).alias("rows"))
    return values.groupBy("group_key", "column_name").agg(F.count(F.lit(1)).alias("n"))


def nunique_sketches(df: DataFrame, grouper: str, bits: int = SKETCH_BITS) -> DataFrame:
    """(group_key, column_name, sketch): mergeable sketches of the distinct values, of at most ``2^bits`` registers each."""
    return _cells(df, grouper).groupBy("group_key", "column_name").agg(F.hll_sketch_agg("value", F.lit(bits)).alias("sketch"))


def merged_nuniques(sketches: DataFrame, by: Sequence[str] = ("column_name",)) -> DataFrame:
    """Distinct values (about ``1.04 / sqrt(2^bits)`` off) over the groups of stored sketches, without the rows behind them."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def described(df: DataFrame, value: str, by: Sequence[str] = (), limits: Limits = DEFAULT) -> DataFrame:
    """count, mean, std, min, quartiles, max of a column, per group or over the whole table."""
    stats = [
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]
    df = read_once(df.select(*by, value), limits)
    found = percentiles_by(df, F.col(value), QUARTILES, by, limits=limits)
    if by:
        df = df.dropna(subset=list(by))
        out = df.groupBy(*by).agg(*stats).join(found, list(by), "left")
    else:
        out = df.agg(*stats).withColumn("percentiles", found.scalar())
    return out.withColumns({f"p{int(p * 100)}": F.get("percentiles", F.lit(i)) for i, p in enumerate(QUARTILES)}).drop(
        "percentiles"
    )


def code_histogram(df: DataFrame, bins: int) -> DataFrame:
    """Counts per gender in equal bins over the range of the codes; the last bin includes the largest code."""
    rows = df.dropna(subset=["gender", "MCC"])
    ends = rows.agg(F.min("MCC").alias("low"), F.max("MCC").alias("high"))
    low, high = ends.select("low").scalar(), ends.select("high").scalar()
    # integer arithmetic, so that a code on a border falls into the same bin everywhere
    width = F.greatest(high - low, F.lit(1)).cast("long")
    number = F.least(F.floor(((F.col("MCC") - low).cast("long") * bins) / width), F.lit(bins - 1))
    return rows.groupBy("gender", number.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def automatic_bins(df: DataFrame, column: str = "MCC", limits: Limits = DEFAULT) -> DataFrame:
    """(``low``, ``high``, ``width``, ``bins``) of a column, chosen from its data.

    The width is the smaller of two: twice the interquartile range over the cube root of the size, which fits large columns (but not
    less than half the range over the root of the size, so that bins stay few where the quartiles are close), and the range over the
    binary logarithm of the size plus one, which fits small ones. It is the rule of numpy's ``auto``.
    """
    df = df.select(column)
    value = F.col(column).cast("double")
    ends = df.agg(F.count(column).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    quartiles = percentiles_by(df, value, [0.25, 0.75], limits=limits)
    rows = ends.withColumn("percentiles", quartiles.scalar())
    spread, size = F.get("percentiles", F.lit(1)) - F.get("percentiles", F.lit(0)), F.col("high") - F.col("low")
    by_size = size / (F.log2(F.col("n").cast("double")) + 1.0)
    by_spread = F.greatest(2.0 * spread / F.cbrt(F.col("n").cast("double")), size / F.sqrt(F.col("n").cast("double")) / 2.0)
    width = F.when(size == 0, F.lit(1.0)).otherwise(F.least(by_spread, by_size))
    # the noise of roots must not decide whether there is one more bin
    bins = F.greatest(F.ceil(F.round(size / F.col("width"), 9)), F.lit(1)).cast("int")
    return rows.filter("n > 0").withColumn("width", width).select("low", "high", "width", bins.alias("bins"))


def automatic_histogram(df: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Counts per gender in equal bins whose number comes from the data; the last bin includes the largest code.

    Bins are small numbers, so the counts combine on the map side whatever the codes.
    """
    rows = read_once(df.select("gender", "MCC").dropna(), limits)
    plan = automatic_bins(rows, "MCC", limits)
    bounds = plan.select(F.struct("low", "high", "bins")).scalar()
    low, high, bins = (bounds[c] for c in ("low", "high", "bins"))
    place = F.floor((F.col("MCC").cast("double") - low) * bins / F.nullif(high - low, F.lit(0.0)))
    number = F.coalesce(F.least(place, bins - 1), F.lit(0)).cast("int")
    return rows.groupBy("gender", number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def day_range(df: DataFrame) -> DataFrame:
    """First and last day, with their dates."""
    return df.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day")).select(
        "*", date_of(F.col("first_day")).alias("first_date"), date_of(F.col("last_day")).alias("last_date")
    )


def class_balance(df: DataFrame) -> DataFrame:
    """Rows per class and the difference of the class sizes."""
    return df.agg(
        F.count_if(F.col("gender") == 0).alias("n_0"), F.count_if(F.col("gender") == 1).alias("n_1")
    ).withColumn("difference", F.abs(F.col("n_0") - F.col("n_1")))
