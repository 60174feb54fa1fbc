"""The registered queries, all over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.amounts import with_signed_amounts
from tillroll.functions.mcc import mcc_group
from tillroll.functions.timeparts import with_time_parts
from tillroll.operators import clients, cohort, habits, profile, sampling
from tillroll.operators.encoding import ordered_target_encoding, permutation_place
from tillroll.operators.hotkeys import Limits, hot_keys, read_once
from tillroll.operators.joins import day_time, labelled, of_clients
from tillroll.operators.lineage import new_path, written
from tillroll.operators.ranks import auc_of
from tillroll.operators.scaling import minmax_scaled, winsorized
from tillroll.plans import features, model
from tillroll.sources import driver_tables as tables
from tillroll.sources.readers import checked, read_transactions, rejected
from tillroll.sources.schema import TRANSACTIONS
from tillroll.sources.writers import commit_predictions, read_predictions

Query = Callable[[SparkSession, str], DataFrame]
Bound = Callable[[SparkSession, str], Limits]
SIDES = list(clients.SIDES)

# The codes, days and lines the cohort questions ask about.
FLOWERS, BARS, MENSWEAR, CAR_PARTS, WOMENSWEAR = 5992, 5813, 5611, 5532, 5621
FIRST_DAY, LAST_DAY = 150, 185
FIRST_LINE, LAST_LINE = 300, 370

ENCODED = ["mcc_code", "trans_type", "trans_city"]
VALIDATION_SHARE = 0.2

HISTOGRAM_BINS = 40
#: Rows from which the ``_hot`` queries take a client for oversized: about two in five clients of the driver's tables.
HOT_ROWS = 42
PEAK_DAYS = 20


def four_digits(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Doubles to four digits, so that the order of summation does not show.

    The step over nine decimal digits first removes the noise of floating
    sums, so that both engines see the same value on a rounding border.
    Values that are too large for nine digits have no fourth one to round.
    """
    names = [n for n, t in df.dtypes if t == "double"] if columns is None else columns
    if not names:
        return df
    place = "_rounded"
    while place in df.columns:
        place += "_"
    # One expression over an array: written out for each of many columns, the code is too long for the JVM to compile.
    every = F.transform(F.array(*[F.col(f"`{n}`") for n in names]), _rounded)
    return df.withColumn(place, every).withColumns({n: F.get(place, F.lit(i)) for i, n in enumerate(names)}).drop(place)


def _rounded(value: Column) -> Column:
    """Where a value is clearly nearer to one number of four digits than to the next, that number follows without decimals."""
    near = F.floor(value * 10_000 + 0.5)
    clear = (F.abs(value) < 1e8) & (F.abs(value * 10_000 - near) < 0.499)
    exact = F.coalesce(F.round(value.try_cast("decimal(28,9)"), 4).cast("double"), value)
    return F.when(clear, near / 10_000).otherwise(exact)


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.transactions(spark, sf_dir)


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(txn(spark, sf_dir), tables.labels(spark, sf_dir))


def test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_clients(txn(spark, sf_dir), tables.unlabelled(spark, sf_dir))


def limits(spark: SparkSession, sf_dir: str) -> Limits:
    """Small tables spare the search for hot groups."""
    return Limits(rows=tables.row_bound(spark, sf_dir))


def oversized(spark: SparkSession, sf_dir: str) -> Limits:
    """Limits by which clients of more than ``HOT_ROWS`` rows take the way of those too large for a task."""
    return Limits(group_rows=HOT_ROWS)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_time_parts(train(spark, sf_dir))


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_signed_amounts(parsed(spark, sf_dir))


def cohort_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_time(parsed(spark, sf_dir))


def parsed_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_time_parts(txn(spark, sf_dir)).select(
        "client_id", "trans_time", "day", "time", "hour", "trans_ts", "weekday", "day_mod7"
    )


def signed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_signed_amounts(txn(spark, sf_dir)).select("client_id", "amount", *SIDES)


def mcc_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn(spark, sf_dir).select("client_id", "mcc_code", mcc_group(F.col("mcc_code")).alias("mcc_describe"))


def winsorize_amount(spark: SparkSession, sf_dir: str, limits: Bound = limits) -> DataFrame:
    rows = with_signed_amounts(train(spark, sf_dir)).select("client_id", *SIDES)
    return four_digits(winsorized(rows, SIDES, limits=limits(spark, sf_dir)))


def minmax_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_signed_amounts(train(spark, sf_dir)).select("client_id", *SIDES)
    return four_digits(minmax_scaled(rows, SIDES))


def client_money_profile(spark: SparkSession, sf_dir: str, limits: Bound = limits) -> DataFrame:
    return four_digits(clients.money_profile(with_signed_amounts(train(spark, sf_dir)), limits(spark, sf_dir)))


def client_money_profile_winsor(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = limits(spark, sf_dir)
    rows = winsorized(with_signed_amounts(train(spark, sf_dir)), SIDES, limits=bound)
    return four_digits(clients.money_profile(rows, bound))


def client_nunique(spark: SparkSession, sf_dir: str, limits: Bound = limits) -> DataFrame:
    return clients.distinct_counts(train(spark, sf_dir), limits(spark, sf_dir))


def weekday_counts_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clients.weekday_counts(signed(spark, sf_dir))


def weekday_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clients.weekday_pivot(signed(spark, sf_dir))


def weekday_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clients.by_client(signed(spark, sf_dir), clients.weekday_means())


def client_span_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = {"span_days": clients.span_days("day"), "span_whole_days": clients.span_days("second")}
    return clients.by_client(parsed(spark, sf_dir), spans)


def all_time_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clients.by_client(parsed(spark, sf_dir), {"all_time_freq": clients.days_per_transaction()})


def txn_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clients.by_client(parsed(spark, sf_dir), {"txn_per_day": clients.transactions_per_day()})


def client_delta(spark: SparkSession, sf_dir: str, limits: Bound = limits) -> DataFrame:
    bound = limits(spark, sf_dir)
    rows = winsorized(with_signed_amounts(train(spark, sf_dir)), SIDES, limits=bound)
    sums = clients.by_client(rows, {**clients.money_aggregates(), "n_rows": F.count(F.lit(1))})
    return four_digits(clients.winsorized_difference(sums, limits=bound).select("client_id", "delta_up_down", "n_rows"))


def client_features_joined(spark: SparkSession, sf_dir: str, limits: Bound = limits) -> DataFrame:
    bound = limits(spark, sf_dir)
    base = read_once(train(spark, sf_dir).drop("trans_city"), bound)
    hot = hot_keys(base, ["client_id"], bound)
    rows = with_signed_amounts(with_time_parts(base))
    further = {**clients.weekday_means(), "all_time_freq": clients.days_per_transaction()}
    table = clients.client_features(rows, further, winsorize_difference=False, hot=hot, limits=bound)
    kept = rows.select("client_id", "gender", "trans_time", "amount")
    return four_digits(clients.joined_back(kept, table, hot, bound))


def mcc_code_count(spark: SparkSession, sf_dir: str, limits: Bound = limits) -> DataFrame:
    return habits.with_code_count(train(spark, sf_dir).select("client_id", "mcc_code", "amount"), limits(spark, sf_dir))


KEYS = ["client_id", "trans_time", "amount"]


def money_per_txn(spark: SparkSession, sf_dir: str, limits: Bound = limits) -> DataFrame:
    return four_digits(habits.money_per_transaction(train(spark, sf_dir).select(KEYS), limits(spark, sf_dir)))


def money_all(spark: SparkSession, sf_dir: str, limits: Bound = limits) -> DataFrame:
    return four_digits(habits.money_all(train(spark, sf_dir).select(KEYS), limits(spark, sf_dir)))


def spend_earn_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = habits.merged([habits.money_per_transaction_stats(), habits.money_all_stats()])
    aggregates = {name: agg for s in stats for name, agg in s.columns().items()}
    table = habits.finished(clients.by_client(train(spark, sf_dir), aggregates), stats)
    return four_digits(
        table.select("client_id", "Money_earn_spend_ratio_per_transaction", "ALL_money_spend_earn_ratio")
    )


def frequency(spark: SparkSession, sf_dir: str, limits: Bound = limits) -> DataFrame:
    rows = parsed(spark, sf_dir).select("client_id", "day", "hour")
    return four_digits(habits.frequency(rows, limits(spark, sf_dir)))


def habit_columns(spark: SparkSession, sf_dir: str, limits: Bound = limits) -> DataFrame:
    rows = train(spark, sf_dir).select("client_id", "term_id", "trans_type", "mcc_code", "amount")
    return four_digits(habits.habits(rows, limits(spark, sf_dir)))


def scoring_feature_table(spark: SparkSession, sf_dir: str, limits: Bound = limits) -> DataFrame:
    return four_digits(features.scoring_features(train(spark, sf_dir), limits=limits(spark, sf_dir)))


def training_feature_table(spark: SparkSession, sf_dir: str, limits: Bound = limits) -> DataFrame:
    table = features.training_features(train(spark, sf_dir), limits=limits(spark, sf_dir))
    return four_digits(table, [n for n, t in table.dtypes if t == "double" and n != "all_time_freq"])


def mcc_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.code_counts(cohort_rows(spark, sf_dir), ["gender", "day"], [FLOWERS, BARS, CAR_PARTS, WOMENSWEAR])


def mcc_hour_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.code_counts(cohort_rows(spark, sf_dir), ["gender", "hour"], [FLOWERS])


def mcc_peak_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.peak_days(cohort_rows(spark, sf_dir), FLOWERS, PEAK_DAYS)


def exclusive_mcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.exclusive_codes(cohort_rows(spark, sf_dir))


def describe_amount_by_gender(spark: SparkSession, sf_dir: str, limits: Bound = limits) -> DataFrame:
    rows = train(spark, sf_dir).select(
        "gender", "amount", F.when(F.col("amount") < 0, "amount < 0").otherwise("amount >= 0").alias("side")
    )
    return four_digits(cohort.described(rows.dropna(subset=["amount"]), "amount", ["gender", "side"], limits(spark, sf_dir)))


def describe_mcc_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cohort.code_count_difference(cohort_rows(spark, sf_dir))
    return four_digits(cohort.described(counts, "diff_true_false", limits=limits(spark, sf_dir)))


def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the classes before and after balancing."""
    return sampling.balanced_sample(cohort_rows(spark, sf_dir)).groupBy("gender").agg(F.count(F.lit(1)).alias("n"))


def balanced_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value counts of the codes in the balanced sample, with its control total."""
    counts = cohort.code_value_counts(sampling.balanced_sample(cohort_rows(spark, sf_dir).select("gender", "MCC")))
    return counts.agg(F.sum("n").alias("control_total"))


def balanced_sample_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the balanced sample that the table has not, or not as often, and rows of the table left out."""
    rows = written(cohort_rows(spark, sf_dir))
    return sampling.bag_difference(sampling.balanced_sample(rows), rows)


def _split_sizes(rest: DataFrame, held: DataFrame) -> DataFrame:
    return (
        rest.withColumn("part", F.lit("train"))
        .unionByName(held.withColumn("part", F.lit("test")))
        .groupBy("part")
        .agg(F.count_distinct("client_id").alias("n_clients"))
    )


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients on both sides of a hold-out of a fifth of the labelled clients."""
    rows = train(spark, sf_dir)
    n = sampling.client_list(rows).count() // 5
    return _split_sizes(*sampling.holdout(rows, n))


def stratified_holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out clients per gender, the same number of each."""
    rows = train(spark, sf_dir)
    n = sampling.client_list(rows).count() // 10
    _, held = sampling.holdout(rows, n, per_gender=True)
    return held.groupBy("gender").agg(F.count_distinct("client_id").alias("n_clients"))


def auc_of_income_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of the hard prediction that income means gender 1, for each type of transaction."""
    rows = train(spark, sf_dir).withColumn("prediction", (F.col("amount") >= 0).cast("int"))
    return auc_of(rows, "prediction", "gender", ["trans_type"])


def holdout_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients on both sides of a hold-out, and rows that the sides together lost or gained."""
    rows = written(train(spark, sf_dir))
    rest, held = sampling.holdout(rows, sampling.client_list(rows).count() // 5)
    both = rest.select("client_id").distinct().join(held.select("client_id").distinct(), "client_id")
    balance = sampling.bag_difference(rest.unionByName(held), rows)
    return balance.withColumn("n_common", both.agg(F.count(F.lit(1))).scalar())


def row_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the 70 to 30 split of rows, and rows that the sides together lost or gained."""
    rows = written(train(spark, sf_dir))
    parts = dict(zip(("train", "test"), sampling.row_split(rows), strict=True))
    sizes = [df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n")) for name, df in parts.items()]
    balance = sampling.bag_difference(parts["train"].unionByName(parts["test"]), rows)
    changed = balance.select(F.explode(F.array(
        F.struct(F.lit("gained").alias("part"), F.col("only_left").alias("n")), F.struct(F.lit("lost").alias("part"), F.col("only_right").alias("n"))
    )).alias("x")).select("x.*")
    return sizes[0].unionByName(sizes[1]).unionByName(changed)


def amount_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probability for every transaction of the unlabelled clients that needs no training: how far the amount lies above the least."""
    rows = test(spark, sf_dir)
    low, high = (rows.agg(f("amount").alias("x")).scalar() for f in (F.min, F.max))
    return rows.select("client_id", F.round((F.col("amount") - low) / F.nullif(high - low, F.lit(0.0)), 6).alias("probability"))


def submission_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in a committed file of predictions: rows, clients, least and largest probability."""
    path = new_path(spark, "result")
    commit_predictions(amount_score(spark, sf_dir), path)
    return read_predictions(spark, path).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("client_id").alias("n_clients"),
        F.min("probability").alias("lowest"), F.max("probability").alias("highest"),
    )


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transactions written as text and read back by the reader."""
    path = new_path(spark, "csv")
    txn(spark, sf_dir).write.option("header", True).csv(f"{path}/transactions.csv")
    return read_transactions(spark, path)


def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that the reader does not accept, by column, after every 97th code and every 89th amount was spoilt."""
    path = new_path(spark, "csv")
    rows = txn(spark, sf_dir)
    cents = F.round(F.col("amount") * 100).cast("long")
    spoilt = rows.withColumns({
        "mcc_code": F.when(F.pmod("mcc_code", F.lit(97)) == 0, F.concat(F.lit("x"), F.col("mcc_code").cast("string"))).otherwise(F.col("mcc_code").cast("string")),
        "amount": F.when(F.pmod(cents, F.lit(89)) == 0, F.lit("12,5")).otherwise(F.col("amount").cast("string")),
    })
    spoilt.write.option("header", True).csv(f"{path}/transactions.csv")
    found, _ = checked(spark, f"{path}/transactions.csv", TRANSACTIONS)
    cells = rejected(found).select(F.explode("rejects").alias("cell")).select("cell.*")
    return cells.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def mcc_bins_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins that the codes of the labelled transactions get."""
    return four_digits(cohort.automatic_bins(cohort_rows(spark, sf_dir), "MCC", limits(spark, sf_dir)))


def raw_null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values of the raw transactions and of the label table, by column."""
    parts = {"transactions": txn(spark, sf_dir), "labels": tables.labels(spark, sf_dir)}
    found = [profile.null_profile(df).withColumn("table_name", F.lit(name)) for name, df in parts.items()]
    return found[0].unionByName(found[1])


def held_out_features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Written features of four fifths of the labelled clients, and of the fifth held out."""
    rows = train(spark, sf_dir)
    n = sampling.client_list(rows).count() // 5
    bound = limits(spark, sf_dir)
    rest, held = (written(features.scoring_features(part, limits=bound)) for part in sampling.holdout(rows, n, per_gender=False))
    return rest, held


def model_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of the boosted trees (probabilities) and of the forest (hard predictions) on held-out clients, at the library's settings.

    ``trees`` is the size of the best prefix, found with patience on a fifth of the training clients.
    """
    known, unknown = held_out_features(spark, sf_dir)
    boosted = model.fit_boosted(known, model.TRAINING_ITERATIONS, model.TRAINING_RATE, validation_share=VALIDATION_SHARE, stored=True)
    forest = model.fit_forest(known, stored=True)
    scores = [
        ("boosted", len(boosted.stages[-1].treeWeights), model.auc(model.scored_by_boosted(boosted, unknown))),
        ("forest", len(forest.stages[-1].treeWeights), model.auc(model.predicted_by_forest(forest, unknown), "prediction")),
    ]
    return spark.createDataFrame(scores, "model string, trees int, auc double")


def validation_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss and AUC on held-out clients after every tree of the validated training."""
    known, unknown = held_out_features(spark, sf_dir)
    fitted = model.fit_boosted(known, model.TRAINING_ITERATIONS, model.TRAINING_RATE, stored=True)
    return model.curve_of(fitted, unknown)


def submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of every transaction of the unlabelled clients, from the best prefix of up to 1500 trees."""
    bound = limits(spark, sf_dir)
    boosted = model.fit_boosted(features.scoring_features(train(spark, sf_dir), limits=bound), validation_share=VALIDATION_SHARE)
    return model.scored_by_boosted(boosted, features.scoring_features(test(spark, sf_dir), limits=bound))


def target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered target statistics of three category columns, with the place of each row in the permutation."""
    cents = F.round(F.col("amount") * 100).cast("long").alias("cents")
    rows = train(spark, sf_dir).select("client_id", "trans_time", "mcc_code", "trans_type", "trans_city", "term_id", cents, "gender")
    names = [c for c in rows.columns if c != "gender"]
    placed = written(rows.select(*ENCODED, "gender", permutation_place(names, model.SEED).alias("place")))
    return ordered_target_encoding(placed, ENCODED, "gender", "place")


#: Queries that run a second time by the way of oversized clients.
BY_LIMITS = {
    "winsorize_amount": winsorize_amount,
    "client_money_profile": client_money_profile,
    "client_nunique": client_nunique,
    "client_delta": client_delta,
    "client_features_joined": client_features_joined,
    "mcc_code_count": mcc_code_count,
    "money_per_txn": money_per_txn,
    "money_all": money_all,
    "frequency": frequency,
    "habits": habit_columns,
    "scoring_feature_table": scoring_feature_table,
    "training_feature_table": training_feature_table,
    "describe_amount_by_gender": describe_amount_by_gender,
}

QUERIES: dict[str, Query] = {
    "parsed_time": parsed_time,
    "signed_split": signed_split,
    "mcc_describe": mcc_describe,
    "winsorize_amount": winsorize_amount,
    "minmax_amount": minmax_amount,
    "labelled_txn": train,
    "test_txn": test,
    "client_money_profile": client_money_profile,
    "client_money_profile_winsor": client_money_profile_winsor,
    "client_nunique": client_nunique,
    "weekday_counts_long": weekday_counts_long,
    "weekday_pivot": weekday_pivot,
    "weekday_mean": weekday_mean,
    "client_span_days": client_span_days,
    "all_time_freq": all_time_freq,
    "txn_per_day": txn_per_day,
    "client_delta": client_delta,
    "client_features_joined": client_features_joined,
    "mcc_code_count": mcc_code_count,
    "money_per_txn": money_per_txn,
    "money_all": money_all,
    "spend_earn_ratio": spend_earn_ratio,
    "frequency": frequency,
    "habits": habit_columns,
    "scoring_feature_table": scoring_feature_table,
    "training_feature_table": training_feature_table,
    "mcc_day_counts": mcc_day_counts,
    "mcc_hour_counts": mcc_hour_counts,
    "hour_profile": lambda s, d: cohort.hour_profile(cohort_rows(s, d)),
    "mcc_peak_days": mcc_peak_days,
    "day_slice": lambda s, d: cohort.day_slice(cohort_rows(s, d), FIRST_DAY, LAST_DAY),
    "gender_day_slice": lambda s, d: cohort.count_slice(cohort_rows(s, d), FIRST_LINE, LAST_LINE),
    "day_mod7_counts": lambda s, d: cohort.day_mod7_counts(cohort_rows(s, d)),
    "mcc_day_mod7_counts": lambda s, d: cohort.code_day_mod7_counts(cohort_rows(s, d), [BARS, MENSWEAR]),
    "day_mod7_groups": lambda s, d: cohort.day_mod7_groups(cohort_rows(s, d), BARS),
    "gender_day_counts": lambda s, d: cohort.non_null_counts(cohort_rows(s, d), ["gender", "day"]),
    "gender_counts": lambda s, d: cohort.non_null_counts(train(s, d), ["gender"]),
    "mcc_value_counts": lambda s, d: cohort.code_value_counts(cohort_rows(s, d)),
    "mcc_count_diff": lambda s, d: cohort.code_count_difference(cohort_rows(s, d)),
    "describe_mcc_diff": describe_mcc_diff,
    "gender_skew_by_mcc": lambda s, d: cohort.gender_skew(train(s, d)),
    "gender_skew_joined": lambda s, d: cohort.with_gender_skew(train(s, d), limits(s, d)).select("client_id", "mcc_code", "amount", "dif"),
    "exclusive_mcc": exclusive_mcc,
    "nuniques_by_group": lambda s, d: cohort.nuniques_by_group(cohort_rows(s, d), "gender", [0, 1]),
    "describe_amount_by_gender": describe_amount_by_gender,
    "mcc_histogram": lambda s, d: cohort.code_histogram(cohort_rows(s, d), HISTOGRAM_BINS),
    "null_profile": lambda s, d: profile.null_profile(train(s, d)),
    "table_shape": lambda s, d: profile.table_shape(train(s, d)),
    "day_range": lambda s, d: cohort.day_range(cohort_rows(s, d)),
    "class_balance": lambda s, d: cohort.class_balance(train(s, d)),
    "balanced_sample": balanced_sample,
    "balanced_value_counts": balanced_value_counts,
    "holdout_split": holdout_split,
    "stratified_holdout_split": stratified_holdout_split,
    "balanced_sample_bag": balanced_sample_bag,
    "holdout_bag": holdout_bag,
    "row_split": row_split,
    "target_encoding": target_encoding,
    "auc_of_amount": lambda s, d: auc_of(train(s, d), "amount", "gender"),
    "auc_of_income_by_type": auc_of_income_by_type,
    "nuniques_long": lambda s, d: cohort.nuniques_long(cohort_rows(s, d), "day"),
    "mcc_bins_auto": mcc_bins_auto,
    "mcc_histogram_auto": lambda s, d: cohort.automatic_histogram(cohort_rows(s, d), limits(s, d)),
    "gender_day_rows": lambda s, d: cohort.count_slice(cohort_rows(s, d), FIRST_LINE, None, ["day", "gender"]),
    "raw_null_profile": raw_null_profile,
    "csv_round_trip": csv_round_trip,
    "rejected_rows": rejected_rows,
    "submission_file": submission_file,
    "validation_curve": validation_curve,
    "model_auc": model_auc,
    "submission": submission,
}
QUERIES |= {f"{name}_hot": partial(query, limits=oversized) for name, query in BY_LIMITS.items()}
