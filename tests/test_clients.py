from __future__ import annotations

import math
import statistics

import pytest
from helpers import rows_by_client, same_rows
from pyspark.sql import functions as F

from tillroll.functions.amounts import with_signed_amounts
from tillroll.functions.timeparts import with_time_parts
from tillroll.operators import clients, habits
from tillroll.operators.hotkeys import Limits
from tillroll.plans.features import scoring_features, training_features, with_original_names


@pytest.fixture(scope="module")
def signed(edge):
    return with_signed_amounts(with_time_parts(edge))


def test_money_profile_rules(signed):
    got = rows_by_client(clients.money_profile(signed))
    one = got[1]
    assert (one["amount_up_client_mean"], one["amount_up_client_count"], one["amount_up_client_sum"]) == (10.0, 1, 10.0)
    assert one["amount_up_client_std"] is None, "deviation of one value is missing"
    assert one["amount_down_client_mean"] is None and one["amount_down_client_median"] is None
    assert (one["amount_down_client_sum"], one["amount_down_client_count"]) == (0.0, 0), "sum of nothing is 0"
    zeros = got[4]
    assert zeros["amount_up_client_count"] == zeros["amount_down_client_count"] == 2, "zero is on both sides"
    assert got[2]["amount_up_client_median"] == 7.0
    assert got[3]["amount_down_client_std"] == pytest.approx(statistics.stdev([4, 6]))
    assert got[5]["amount_up_client_count"] == 2, "a missing amount is on no side"


def test_distinct_counts_skip_missing(signed):
    got = rows_by_client(clients.distinct_counts(signed))
    assert (got[2]["count_term_id"], got[2]["count_trans_type"], got[2]["count_mcc_code"]) == (2, 2, 1)


def test_weekdays_absent_is_missing_and_present_without_income_is_zero(signed):
    pivot = rows_by_client(clients.weekday_pivot(signed))[6]
    # days 0 and 1 are Friday and Saturday, day 8 is a Saturday again
    assert pivot["amount_up_weekday_4"] == 0 and pivot["amount_down_weekday_4"] == 1
    assert pivot["amount_up_weekday_5"] == 2 and pivot["amount_down_weekday_5"] == 0
    assert pivot["amount_up_weekday_0"] is None
    mean = rows_by_client(clients.by_client(signed, clients.weekday_means()))[6]
    assert mean["amount_mean_up_weekday"] == 1.0 and mean["amount_mean_down_weekday"] == 0.5


def test_spans_and_frequencies(signed):
    spans = rows_by_client(
        clients.by_client(
            signed,
            {
                "days": clients.span_days("day"),
                "whole": clients.span_days("second"),
                "days_per_txn": clients.days_per_transaction(),
                "txn_per_day": clients.transactions_per_day(),
            },
        )
    )
    assert (spans[1]["days"], spans[1]["days_per_txn"], spans[1]["txn_per_day"]) == (0, 0.0, math.inf)
    assert (spans[2]["days"], spans[2]["whole"]) == (7, 7)
    # from midnight after day 219 to 13:00 of day 456
    assert (spans[5]["days"], spans[5]["whole"]) == (237, 236)
    assert spans[2]["txn_per_day"] == pytest.approx(3 / 7)


def test_weekday_of_the_timestamp_rolls_over(signed):
    day = clients.with_weekday(signed, "day").filter("trans_time = '219 23:59:60'").first()["weekday"]
    second = clients.with_weekday(signed, "second").filter("trans_time = '219 23:59:60'").first()["weekday"]
    assert (day, second) == (6, 0)


def test_money_window_rules(edge):
    got = rows_by_client(habits.with_stats(with_time_parts(edge), habits.all_stats(), Limits(rows=20)))
    only_up = got[2]
    assert only_up["Mean_spend_money_per_transaction"] == 0 and only_up["Money_spend_std_per_transaction"] == 0
    assert only_up["Money_earn_spend_ratio_per_transaction"] == 1000.0
    assert only_up["ALL_money_spend_earn_ratio"] == 0.0
    only_down = got[3]
    assert only_down["ALL_money_spend"] == -10.0 and only_down["ALL_money_spend_earn_ratio"] == 1000.0
    assert only_down["Money_earn_spend_ratio_per_transaction"] == 0.0
    zeros = got[4]
    assert zeros["Money_earn_spend_ratio_per_transaction"] == 0.0, "0/0 of the first ratio is 0"
    assert zeros["ALL_money_spend_earn_ratio"] is None, "0/0 of the second ratio is missing"
    assert got[5]["Mean_spend_money_per_transaction"] == -8.0, "one negative value is its own mean"
    assert got[1]["Std_net_money_per_transaction"] == 0.0


def test_habit_rules(edge):
    rows = habits.habits(edge, Limits(rows=20)).filter("client_id = 2").collect()
    without = next(r for r in rows if r["term_id"] is None)
    assert (without["Terminal_habit"], without["Terminal_habit_sum_money"], without["Terminal_habit_money"]) == (0, 0, 0)
    no_code = next(r for r in rows if r["mcc_code"] is None)
    assert (no_code["Product_habit_frequency"], no_code["Product_habit_sum_money"]) == (0, 0)
    assert {r["Service_habit"] for r in rows if r["trans_type"] == 1010} == {2}


def test_frequencies(edge):
    rows = habits.frequency(with_time_parts(edge), Limits(rows=20)).filter("client_id = 2").collect()
    day3 = next(r for r in rows if r["day"] == 3)
    assert (day3["Frequency_of_spending_per_day"], day3["Frequency_of_spending_all"]) == (2, 3)
    assert day3["Frequency_of_spending_per_week"] == pytest.approx(3 / 7)
    assert day3["Hours_std_transaction_per_day"] == pytest.approx(math.sqrt(2))
    assert next(r for r in rows if r["day"] == 10)["Hours_std_transaction_per_day"] == 0.0


def test_difference_weighs_clients_by_rows(skewed):
    rows = with_signed_amounts(skewed)
    sums = clients.by_client(rows, {**clients.money_aggregates(), "n_rows": F.count(F.lit(1))})
    deltas = clients.net_difference(sums)
    per_row = skewed.join(deltas, "client_id").agg(F.percentile("delta_up_down", F.array(F.lit(0.05), F.lit(0.95)))).first()[0]
    for limits in (Limits(), Limits(group_rows=5)):
        ends = clients.winsorized_difference(sums, limits=limits).agg(F.min("delta_up_down"), F.max("delta_up_down")).first()
        assert list(ends) == pytest.approx(per_row)


@pytest.mark.parametrize("build", [scoring_features, training_features])
def test_feature_tables_do_not_depend_on_the_limits(skewed_labelled, build):
    plain = build(skewed_labelled)
    assert plain.count() == skewed_labelled.count()
    for group_rows in (20, 80):
        same_rows(plain, build(skewed_labelled, limits=Limits(group_rows=group_rows)))


def test_client_features_of_hot_clients(skewed):
    rows = with_signed_amounts(with_time_parts(skewed))
    further = {**clients.weekday_aggregates(), "all_time_freq": clients.transactions_per_day()}
    plain = clients.client_features(rows, further, winsorize_difference=True)
    same_rows(plain, clients.client_features(rows, further, winsorize_difference=True, limits=Limits(group_rows=70)))


def test_scoring_columns(skewed_labelled):
    names = set(with_original_names(scoring_features(skewed_labelled)).columns)
    assert {"delta+-", "mcc_describe", "time", "day", "amount", "all_time_freq", "count_term_id"} <= names
    assert not names & {"amount_up", "amount_down", "weekday", "trans_time", "amount_up_weekday_0"}
    assert len([n for n in names if n.startswith("amount_up_client_")]) == 5
