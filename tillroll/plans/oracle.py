"""SQL counterparts of the registered queries, written for DuckDB over the same tables.

Independent of the Spark code but for a few constants of the questions (codes, days, lines).
"""

from __future__ import annotations

from tillroll.plans.queries import (
    BARS,
    BY_LIMITS,
    CAR_PARTS,
    FIRST_DAY,
    FIRST_LINE,
    FLOWERS,
    HISTOGRAM_BINS,
    LAST_DAY,
    LAST_LINE,
    MENSWEAR,
    PEAK_DAYS,
    WOMENSWEAR,
)

TXN = """
txn AS (
  SELECT o_custkey AS client_id,
    CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 457 AS VARCHAR) || ' '
      || lpad(CAST((l_orderkey * 7 + l_linenumber * 13) % 24 AS VARCHAR), 2, '0') || ':'
      || lpad(CAST((l_partkey * 11) % 60 AS VARCHAR), 2, '0') || ':'
      || lpad(CAST(l_orderkey % 61 AS VARCHAR), 2, '0') AS trans_time,
    CAST(CASE l_partkey % 20
      WHEN 0 THEN 5992 WHEN 1 THEN 5813 WHEN 2 THEN 5611 WHEN 3 THEN 5532 WHEN 4 THEN 5621
      WHEN 5 THEN 742 + (o_custkey % 2) * 21
      ELSE 700 + ((l_partkey * 37 + (o_custkey % 2) * (l_linenumber % 2) * 50) % 300) * 31 END AS INTEGER) AS mcc_code,
    CAST(1000 + l_linenumber * 10 AS INTEGER) AS trans_type,
    'city_' || CAST(c_nationkey AS VARCHAR) AS trans_city,
    CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE CAST(l_suppkey AS VARCHAR) END AS term_id,
    CASE WHEN l_quantity = 50 THEN 0.0 WHEN o_custkey % 50 = 7 THEN l_extendedprice
      WHEN o_custkey % 50 = 8 THEN -l_extendedprice WHEN l_returnflag = 'R' THEN l_extendedprice
      ELSE -l_extendedprice END AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
),
labels_known AS (
  SELECT c_custkey AS client_id, CAST(c_custkey % 2 AS INTEGER) AS gender FROM customer
  WHERE c_custkey % 11 <> 0 AND c_custkey % 5 <> 0
),
lab AS (SELECT txn.*, gender FROM txn JOIN labels_known USING (client_id))"""

TIMED = """,
timed AS (
  SELECT *, CAST(split_part(trans_time, ' ', 1) AS INTEGER) AS day, split_part(trans_time, ' ', 2) AS time,
    CAST(split_part(split_part(trans_time, ' ', 2), ':', 1) AS INTEGER) AS hour,
    CAST(split_part(split_part(trans_time, ' ', 2), ':', 2) AS INTEGER) AS minute,
    CAST(split_part(split_part(trans_time, ' ', 2), ':', 3) AS INTEGER) AS second
  FROM {source}
),
parsed AS (
  SELECT * EXCLUDE (minute, second),
    TIMESTAMP '2019-08-02 00:00:00' + to_days(day) + to_hours(hour) + to_minutes(minute) + to_seconds(second) AS trans_ts,
    CAST(isodow(DATE '2019-08-02' + day) - 1 AS INTEGER) AS weekday, day % 7 AS day_mod7
  FROM timed
)"""

DAY_TIME = """,
dt AS (SELECT gender, mcc_code AS MCC, day, time, hour FROM parsed)"""

SIGNED = """,
signed AS (
  SELECT *, CASE WHEN amount >= 0 THEN amount END AS amount_up, CASE WHEN amount <= 0 THEN abs(amount) END AS amount_down
  FROM {source}
)"""

WINSORIZED = """,
bounds AS (
  SELECT quantile_cont(amount_up, 0.05) AS up_low, quantile_cont(amount_up, 0.95) AS up_high,
    quantile_cont(amount_down, 0.05) AS down_low, quantile_cont(amount_down, 0.95) AS down_high FROM signed
),
winsor AS (
  SELECT signed.* EXCLUDE (amount_up, amount_down),
    CASE WHEN amount_up IS NOT NULL THEN least(greatest(amount_up, up_low), up_high) END AS amount_up,
    CASE WHEN amount_down IS NOT NULL THEN least(greatest(amount_down, down_low), down_high) END AS amount_down
  FROM signed, bounds
)"""


def four_digits(expression: str) -> str:
    return f"CAST(ROUND(CAST({expression} AS DECIMAL(28, 9)), 4) AS DOUBLE)"


def columns(named: dict[str, str]) -> str:
    return ", ".join(f"{expression} AS {name}" for name, expression in named.items())


def rounded(named: dict[str, str]) -> str:
    return columns({name: four_digits(expression) for name, expression in named.items()})


#: The borders of the code groups, written out apart from the library's own table.
GROUP_CASE = """CASE
  WHEN (mcc_code >= 724 AND mcc_code < 1799) THEN 1
  WHEN (mcc_code >= 1799 AND mcc_code < 2842) OR (mcc_code >= 4900 AND mcc_code < 5200) OR (mcc_code >= 5714 AND
  mcc_code < 5715) OR (mcc_code >= 9702 AND mcc_code < 9752) THEN 2
  WHEN (mcc_code >= 2842 AND mcc_code < 3299) THEN 3
  WHEN (mcc_code >= 3299 AND mcc_code < 3441) OR (mcc_code >= 7511 AND mcc_code < 7519) THEN 4
  WHEN (mcc_code >= 3441 AND mcc_code < 3882) OR (mcc_code >= 6760 AND mcc_code < 7011) THEN 5
  WHEN (mcc_code >= 3882 AND mcc_code < 4789) THEN 6
  WHEN (mcc_code >= 4789 AND mcc_code < 4900) THEN 7
  WHEN (mcc_code >= 5200 AND mcc_code < 5499) THEN 8
  WHEN (mcc_code >= 5499 AND mcc_code < 5599) OR (mcc_code >= 5699 AND mcc_code < 5714) OR (mcc_code >= 5969 AND
  mcc_code < 5999) THEN 9
  WHEN (mcc_code >= 5599 AND mcc_code < 5699) THEN 10
  WHEN (mcc_code >= 5715 AND mcc_code < 5735) OR (mcc_code >= 5811 AND mcc_code < 5950) THEN 11
  WHEN (mcc_code >= 5735 AND mcc_code < 5811) OR (mcc_code >= 5962 AND mcc_code < 5963) OR (mcc_code >= 5999 AND
  mcc_code < 6760) OR (mcc_code >= 7011 AND mcc_code < 7033) THEN 12
  WHEN (mcc_code >= 5950 AND mcc_code < 5962) OR (mcc_code >= 5963 AND mcc_code < 5969) THEN 13
  WHEN (mcc_code >= 7033 AND mcc_code < 7299) THEN 14
  WHEN (mcc_code >= 7299 AND mcc_code < 7511) OR (mcc_code >= 7519 AND mcc_code < 7523) THEN 15
  WHEN (mcc_code >= 7523 AND mcc_code < 7699) THEN 16
  WHEN (mcc_code >= 7699 AND mcc_code < 7999) THEN 17
  WHEN (mcc_code >= 7999 AND mcc_code < 8351) THEN 18
  WHEN (mcc_code >= 8351 AND mcc_code < 8699) THEN 19
  WHEN (mcc_code >= 8699 AND mcc_code < 8999) THEN 20
  WHEN (mcc_code >= 8999 AND mcc_code < 9702) OR (mcc_code >= 9752 AND mcc_code < 9754) THEN 21
  ELSE mcc_code END"""

LABELLED = f"WITH {TXN}"
PARSED = LABELLED + TIMED.format(source="lab")
COHORT = PARSED + DAY_TIME
SIGNED_PARSED = PARSED + SIGNED.format(source="parsed")
SIGNED_LABELLED = LABELLED + SIGNED.format(source="lab")
WINSOR_LABELLED = SIGNED_LABELLED + WINSORIZED
WINSOR_PARSED = SIGNED_PARSED + WINSORIZED

PROFILE = {}
PROFILE_COUNTS = {}
for _side in ("amount_up", "amount_down"):
    PROFILE[f"{_side}_client_mean"] = f"avg({_side})"
    PROFILE[f"{_side}_client_median"] = f"median({_side})"
    PROFILE[f"{_side}_client_std"] = f"stddev_samp({_side})"
    PROFILE[f"{_side}_client_sum"] = f"coalesce(sum({_side}), 0)"
    PROFILE_COUNTS[f"{_side}_client_count"] = f"count({_side})"

NUNIQUE = {
    "count_term_id": "count(DISTINCT term_id)",
    "count_trans_type": "count(DISTINCT trans_type)",
    "count_mcc_code": "count(DISTINCT mcc_code)",
}

WEEKDAY = {
    f"{side}_weekday_{day}": f"CASE WHEN count(*) FILTER (weekday = {day}) > 0 "
    f"THEN count({side}) FILTER (weekday = {day}) END"
    for side in ("amount_up", "amount_down")
    for day in range(7)
}

WEEKDAY_MEAN = {
    "amount_mean_up_weekday": "CAST(count(amount_up) AS DOUBLE) / count(DISTINCT weekday)",
    "amount_mean_down_weekday": "CAST(count(amount_down) AS DOUBLE) / count(DISTINCT weekday)",
}

DAYS_PER_TXN = {"all_time_freq": "CAST(max(day) - min(day) AS DOUBLE) / count(*)"}

WHOLE_DAYS = "CAST(floor((epoch(max(trans_ts)) - epoch(min(trans_ts))) / 86400) AS INTEGER)"

TXN_PER_DAY = f"CASE WHEN {WHOLE_DAYS} = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(count(*) AS DOUBLE) / {WHOLE_DAYS} END"

MONEY_PER_TXN = {
    "Mean_net_money_per_transaction": "avg(amount) OVER w",
    "Std_net_money_per_transaction": "coalesce(stddev_samp(amount) OVER w, 0)",
    "Mean_spend_money_per_transaction": "coalesce(avg(CASE WHEN amount < 0 THEN amount END) OVER w, 0)",
    "Mean_earn_money_per_transaction": "coalesce(avg(CASE WHEN amount > 0 THEN amount END) OVER w, 0)",
    "Money_spend_std_per_transaction": "coalesce(stddev_samp(CASE WHEN amount < 0 THEN amount END) OVER w, 0)",
    "Mean_earn_std_per_transaction": "coalesce(stddev_samp(CASE WHEN amount > 0 THEN amount END) OVER w, 0)",
}
MONEY_ALL = {
    "ALL_money_net": "coalesce(sum(amount) OVER w, 0)",
    "ALL_money_spend": "coalesce(sum(CASE WHEN amount < 0 THEN amount END) OVER w, 0)",
    "ALL_money_earn": "coalesce(sum(CASE WHEN amount > 0 THEN amount END) OVER w, 0)",
}
EARN_SPEND = (
    "CASE WHEN Money_spend_std_per_transaction = 0 THEN CASE WHEN Mean_earn_money_per_transaction = 0 THEN 0 ELSE 1000 END "
    "ELSE abs(Mean_earn_money_per_transaction) / abs(Money_spend_std_per_transaction) END"
)
SPEND_EARN = (
    "CASE WHEN ALL_money_earn = 0 THEN CASE WHEN ALL_money_spend = 0 THEN NULL ELSE 1000 END "
    "ELSE abs(ALL_money_spend) / abs(ALL_money_earn) END"
)
FREQUENCY_COUNTS = {
    "Frequency_of_spending_all": "count(day) OVER w",
    "Frequency_of_spending_per_day": "count(day) OVER (PARTITION BY client_id, day)",
}
FREQUENCY_DOUBLES = {
    "Frequency_of_spending_per_week": "count(day) OVER w / 7.0",
    "Hours_std_transaction_per_day": "coalesce(stddev_samp(hour) OVER (PARTITION BY client_id, day), 0)",
}
BY_TERM = "OVER (PARTITION BY client_id, term_id)"
BY_TYPE = "OVER (PARTITION BY client_id, trans_type)"
BY_MCC = "OVER (PARTITION BY client_id, mcc_code)"
HABIT_COUNTS = {
    "Terminal_habit": f"count(term_id) {BY_TERM}",
    "Service_habit": f"count(trans_type) {BY_TYPE}",
    "Product_habit_frequency": f"count(mcc_code) {BY_MCC}",
}
HABIT_DOUBLES = {
    "Terminal_habit_sum_money": f"CASE WHEN term_id IS NULL THEN 0 ELSE coalesce(sum(amount) {BY_TERM}, 0) END",
    "Terminal_habit_money": f"CASE WHEN term_id IS NULL THEN 0 ELSE coalesce(avg(amount) {BY_TERM}, 0) END",
    "Product_habit_sum_money": f"CASE WHEN mcc_code IS NULL THEN 0 ELSE coalesce(sum(amount) {BY_MCC}, 0) END",
    "Product_habit_mean_money": f"CASE WHEN mcc_code IS NULL THEN 0 ELSE coalesce(avg(amount) {BY_MCC}, 0) END",
}
WINDOW = "WINDOW w AS (PARTITION BY client_id)"


def same(named: dict[str, str]) -> dict[str, str]:
    return {name: name for name in named}


CLIENT_DELTA = """,
sums AS (
  SELECT client_id, count(*) AS n_rows, coalesce(sum(amount_up), 0) - coalesce(sum(amount_down), 0) AS delta
  FROM winsor GROUP BY client_id
),
delta_bounds AS (
  SELECT quantile_cont(delta, 0.05) AS low, quantile_cont(delta, 0.95) AS high
  FROM lab JOIN sums USING (client_id)
)"""

DIFFERENCE = """,
counted AS (
  SELECT MCC, nullif(count(*) FILTER (gender = 1), 0) AS count_true, nullif(count(*) FILTER (gender = 0), 0) AS count_false
  FROM dt GROUP BY MCC
),
diff AS (SELECT *, count_true - count_false AS diff_true_false FROM counted)"""


def described(value: str) -> str:
    doubles = {
        "mean": f"avg({value})",
        "std": f"stddev_samp({value})",
        "p25": f"quantile_cont({value}, 0.25)",
        "p50": f"quantile_cont({value}, 0.5)",
        "p75": f"quantile_cont({value}, 0.75)",
    }
    return f"count({value}) AS n, {rounded(doubles)}"


SKEW = """,
skew AS (
  SELECT mcc_code, count(amount) FILTER (gender = 0) AS count_0, count(amount) FILTER (gender = 1) AS count_1
  FROM lab GROUP BY mcc_code
)"""

PLACED = """,
placed AS (
  SELECT mcc_code, trans_type, trans_city, gender, md5(concat_ws('|', '63', {key})) AS place FROM lab
)""".format(
    key=", ".join(
        f"coalesce(CAST({c} AS VARCHAR), '-')"
        for c in ("client_id", "trans_time", "mcc_code", "trans_type", "trans_city", "term_id", "CAST(round(amount * 100) AS BIGINT)")
    )
)


def encoded(column: str) -> str:
    upto = f"OVER (PARTITION BY {column} ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    here = f"OVER (PARTITION BY {column}, place)"
    return (
        f"(CAST(sum(gender) {upto} - sum(gender) {here} AS DOUBLE) + 0.5::DOUBLE) / "
        f"(CAST(count(*) {upto} - count(*) {here} AS DOUBLE) + 1::DOUBLE)"
    )


def auc(source: str, score: str, by: str = "") -> str:
    """Area under the curve of ``score`` for gender, per ``by``."""
    key, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return (
        f"counted AS (SELECT {key}{score} AS score, count(*) FILTER (gender = 1) AS p, count(*) FILTER (gender = 0) AS q "
        f"FROM {source} WHERE {score} IS NOT NULL GROUP BY ALL), "
        f"ranked AS (SELECT *, coalesce(sum(q) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below "
        f"FROM counted) SELECT {key}CAST(sum(p + q) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS n_positive, "
        "CAST(sum(p * (2 * below + q)) AS DOUBLE) / nullif(2::DOUBLE * CAST(sum(p) AS DOUBLE) * CAST(sum(q) AS DOUBLE), 0) AS auc "
        f"FROM ranked{f' GROUP BY {by}' if by else ''}"
    )


COHORT_COLUMNS = ["gender", "MCC", "day", "time", "hour"]
LABELLED_TYPES = {
    "client_id": "bigint",
    "trans_time": "string",
    "mcc_code": "int",
    "trans_type": "int",
    "trans_city": "string",
    "term_id": "string",
    "amount": "double",
    "gender": "int",
}

RAW_TYPES = {c: t for c, t in LABELLED_TYPES.items() if c != "gender"}
LABEL_TYPES = {"client_id": "bigint", "gender": "int"}

AUTO_BINS = """,
ends AS (
  SELECT CAST(count(MCC) AS DOUBLE) AS n, CAST(min(MCC) AS DOUBLE) AS low, CAST(max(MCC) AS DOUBLE) AS high,
    quantile_cont(CAST(MCC AS DOUBLE), 0.75) - quantile_cont(CAST(MCC AS DOUBLE), 0.25) AS spread FROM dt
),
widths AS (
  SELECT *, (high - low) / (log2(n) + 1::DOUBLE) AS by_size, greatest(2::DOUBLE * spread / cbrt(n), (high - low) / sqrt(n) / 2::DOUBLE) AS by_spread
  FROM ends
),
chosen AS (
  SELECT low, high, width, CAST(greatest(ceil(round((high - low) / width, 9)), 1) AS INTEGER) AS bins
  FROM (SELECT *, least(by_spread, by_size) AS width FROM widths)
)"""

SMALLER_CLASS = "(SELECT min(n) FROM (SELECT count(*) AS n FROM lab GROUP BY gender))"

SCORING = f"""{WINSOR_PARSED},
profile AS (
  SELECT client_id, {columns({**PROFILE, **PROFILE_COUNTS, **NUNIQUE, **WEEKDAY_MEAN, **DAYS_PER_TXN})}
  FROM winsor GROUP BY client_id
),
deltas AS (SELECT client_id, amount_up_client_sum - amount_down_client_sum AS delta FROM profile),
delta_bounds AS (
  SELECT quantile_cont(delta, 0.05) AS low, quantile_cont(delta, 0.95) AS high FROM lab JOIN deltas USING (client_id)
),
wide AS (
  SELECT *, {columns({**MONEY_PER_TXN, **MONEY_ALL, **FREQUENCY_COUNTS, **FREQUENCY_DOUBLES, **HABIT_COUNTS, **HABIT_DOUBLES})}
  FROM parsed {WINDOW}
)
SELECT client_id, gender, mcc_code, trans_type, trans_city, term_id, day, hour AS time, {GROUP_CASE} AS mcc_describe,
  {rounded({"amount": "amount", "delta_up_down": "least(greatest(delta, low), high)"})},
  {rounded({**same(PROFILE), **same(WEEKDAY_MEAN), **same(DAYS_PER_TXN)})},
  {columns({**same(PROFILE_COUNTS), **same(NUNIQUE)})},
  {rounded({**same(MONEY_PER_TXN), **same(MONEY_ALL), **same(FREQUENCY_DOUBLES), **same(HABIT_DOUBLES)})},
  {columns({**same(FREQUENCY_COUNTS), **same(HABIT_COUNTS)})},
  {rounded({"Money_earn_spend_ratio_per_transaction": EARN_SPEND, "ALL_money_spend_earn_ratio": SPEND_EARN})}
FROM wide JOIN profile USING (client_id) JOIN deltas USING (client_id), delta_bounds"""

NUNIQUE_SECOND = {
    "term_id_client_nunique": "count(DISTINCT term_id)",
    "trans_type_client_nunique": "count(DISTINCT trans_type)",
    "mcc_code_client_nunique": "count(DISTINCT mcc_code)",
}

TRAINING = f"""{SIGNED_PARSED},
by_second AS (SELECT * EXCLUDE (weekday), CAST(isodow(trans_ts) - 1 AS INTEGER) AS weekday FROM signed),
profile AS (
  SELECT client_id, {columns({**PROFILE, **PROFILE_COUNTS, **NUNIQUE_SECOND, **WEEKDAY})}, {TXN_PER_DAY} AS all_time_freq
  FROM by_second GROUP BY client_id
)
SELECT client_id, gender, mcc_code, trans_type, trans_city, {GROUP_CASE} AS mcc_describe, all_time_freq,
  {rounded({**same(PROFILE), "delta_up_down": "amount_up_client_sum - amount_down_client_sum"})},
  {columns({**same(PROFILE_COUNTS), **same(NUNIQUE_SECOND), **same(WEEKDAY)})}
FROM lab JOIN profile USING (client_id)"""

ORACLE_SQL: dict[str, str] = {
    "parsed_time": f"WITH {TXN}{TIMED.format(source='txn')} "
    "SELECT client_id, trans_time, day, time, hour, trans_ts, weekday, day_mod7 FROM parsed",
    "signed_split": f"WITH {TXN}{SIGNED.format(source='txn')} SELECT client_id, amount, amount_up, amount_down FROM signed",
    "mcc_describe": f"WITH {TXN} SELECT client_id, mcc_code, {GROUP_CASE} AS mcc_describe FROM txn",
    "winsorize_amount": f"{WINSOR_LABELLED} SELECT client_id, "
    f"{rounded({'amount_up': 'amount_up', 'amount_down': 'amount_down'})} FROM winsor",
    "minmax_amount": f"{SIGNED_LABELLED}, ends AS (SELECT min(amount_up) AS u0, max(amount_up) AS u1, "
    "min(amount_down) AS d0, max(amount_down) AS d1 FROM signed) SELECT client_id, "
    + rounded(
        {"amount_up": "(amount_up - u0) / (u1 - u0) * 1000", "amount_down": "(amount_down - d0) / (d1 - d0) * 1000"}
    )
    + " FROM signed, ends",
    "labelled_txn": f"{LABELLED} SELECT * FROM lab",
    "test_txn": f"{LABELLED} SELECT * FROM txn WHERE client_id IN "
    "(SELECT c_custkey FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 5 = 0)",
    "client_money_profile": f"{SIGNED_LABELLED} SELECT client_id, {rounded(PROFILE)}, {columns(PROFILE_COUNTS)} "
    "FROM signed GROUP BY client_id",
    "client_money_profile_winsor": f"{WINSOR_LABELLED} SELECT client_id, {rounded(PROFILE)}, {columns(PROFILE_COUNTS)} "
    "FROM winsor GROUP BY client_id",
    "client_nunique": f"{LABELLED} SELECT client_id, {columns(NUNIQUE)} FROM lab GROUP BY client_id",
    "weekday_counts_long": f"{SIGNED_PARSED} SELECT client_id, weekday, count(amount_up) AS amount_up, "
    "count(amount_down) AS amount_down FROM signed GROUP BY client_id, weekday",
    "weekday_pivot": f"{SIGNED_PARSED} SELECT client_id, {columns(WEEKDAY)} FROM signed GROUP BY client_id",
    "weekday_mean": f"{SIGNED_PARSED}, cells AS (SELECT client_id, weekday, count(amount_up) AS up, count(amount_down) AS down "
    "FROM signed GROUP BY client_id, weekday) SELECT client_id, avg(up) AS amount_mean_up_weekday, "
    "avg(down) AS amount_mean_down_weekday FROM cells GROUP BY client_id",
    "client_span_days": f"{PARSED} SELECT client_id, max(day) - min(day) AS span_days, {WHOLE_DAYS} AS span_whole_days "
    "FROM parsed GROUP BY client_id",
    "all_time_freq": f"{PARSED} SELECT client_id, {columns(DAYS_PER_TXN)} FROM parsed GROUP BY client_id",
    "txn_per_day": f"{PARSED} SELECT client_id, {TXN_PER_DAY} AS txn_per_day FROM parsed GROUP BY client_id",
    "client_delta": f"{WINSOR_LABELLED}{CLIENT_DELTA} SELECT client_id, n_rows, "
    f"{four_digits('least(greatest(delta, low), high)')} AS delta_up_down FROM sums, delta_bounds",
    "client_features_joined": f"{SIGNED_PARSED}, profile AS (SELECT client_id, "
    f"{columns({**PROFILE, **PROFILE_COUNTS, **NUNIQUE, **WEEKDAY_MEAN, **DAYS_PER_TXN})} FROM signed GROUP BY client_id) "
    f"SELECT client_id, gender, trans_time, {four_digits('amount')} AS amount, {rounded(same(PROFILE))}, "
    f"{columns({**same(PROFILE_COUNTS), **same(NUNIQUE)})}, {rounded({**same(WEEKDAY_MEAN), **same(DAYS_PER_TXN)})}, "
    f"{four_digits('amount_up_client_sum - amount_down_client_sum')} AS delta_up_down FROM lab JOIN profile USING (client_id)",
    "mcc_code_count": f"{LABELLED} SELECT client_id, mcc_code, amount, mcc_code_count FROM lab JOIN (SELECT client_id, mcc_code, "
    "count(*) AS mcc_code_count FROM lab GROUP BY client_id, mcc_code) USING (client_id, mcc_code)",
    "money_per_txn": f"{LABELLED}, wide AS (SELECT client_id, trans_time, amount, {columns(MONEY_PER_TXN)} FROM lab {WINDOW}) "
    f"SELECT client_id, trans_time, {rounded({'amount': 'amount', **same(MONEY_PER_TXN)})}, "
    f"{rounded({'Money_earn_spend_ratio_per_transaction': EARN_SPEND})} FROM wide",
    "money_all": f"{LABELLED}, wide AS (SELECT client_id, trans_time, amount, {columns(MONEY_ALL)} FROM lab {WINDOW}) "
    f"SELECT client_id, trans_time, {rounded({'amount': 'amount', **same(MONEY_ALL)})}, "
    f"{rounded({'ALL_money_spend_earn_ratio': SPEND_EARN})} FROM wide",
    "spend_earn_ratio": f"{LABELLED}, wide AS (SELECT client_id, {columns({**MONEY_PER_TXN, **MONEY_ALL})} FROM lab {WINDOW}), "
    f"clients AS (SELECT DISTINCT client_id, {four_digits(EARN_SPEND)} AS a, {four_digits(SPEND_EARN)} AS b FROM wide) "
    "SELECT client_id, max(a) AS Money_earn_spend_ratio_per_transaction, max(b) AS ALL_money_spend_earn_ratio "
    "FROM clients GROUP BY client_id",
    "frequency": f"{PARSED} SELECT client_id, day, hour, {columns(FREQUENCY_COUNTS)}, {rounded(FREQUENCY_DOUBLES)} "
    f"FROM parsed {WINDOW}",
    "habits": f"{LABELLED} SELECT client_id, term_id, trans_type, mcc_code, {four_digits('amount')} AS amount, "
    f"{columns(HABIT_COUNTS)}, {rounded(HABIT_DOUBLES)} FROM lab",
    "scoring_feature_table": SCORING,
    "training_feature_table": TRAINING,
    "mcc_day_counts": f"{COHORT} SELECT MCC, gender, day, count(*) AS n FROM dt "
    f"WHERE MCC IN ({FLOWERS}, {BARS}, {CAR_PARTS}, {WOMENSWEAR}) GROUP BY MCC, gender, day",
    "mcc_hour_counts": f"{COHORT} SELECT MCC, gender, hour, count(*) AS n FROM dt WHERE MCC = {FLOWERS} GROUP BY MCC, gender, hour",
    "hour_profile": f"{COHORT} SELECT g.gender, CAST(h.h AS INTEGER) AS index_hour, count(dt.hour) AS n "
    "FROM (SELECT DISTINCT gender FROM dt) g, range(24) h(h) LEFT JOIN dt ON dt.gender = g.gender AND dt.hour = h.h GROUP BY 1, 2",
    "mcc_peak_days": f"{COHORT} SELECT gender, day, count(*) AS n FROM dt WHERE MCC = {FLOWERS} GROUP BY gender, day "
    f"ORDER BY n DESC, day, gender LIMIT {PEAK_DAYS}",
    "day_slice": f"{COHORT} SELECT gender, day, count(MCC) AS MCC, count(time) AS time, count(hour) AS hour FROM dt "
    f"WHERE day BETWEEN {FIRST_DAY} AND {LAST_DAY} GROUP BY gender, day",
    "gender_day_slice": f"{COHORT} SELECT gender, day, count(MCC) AS MCC, count(time) AS time, count(hour) AS hour "
    f"FROM dt GROUP BY gender, day ORDER BY gender, day LIMIT {LAST_LINE - FIRST_LINE} OFFSET {FIRST_LINE}",
    "day_mod7_counts": f"{COHORT} SELECT day % 7 AS day_mod7, count(MCC) AS n FROM dt GROUP BY 1",
    "mcc_day_mod7_counts": f"{COHORT} SELECT MCC, day % 7 AS day_mod7, count(*) AS n FROM dt "
    f"WHERE MCC IN ({BARS}, {MENSWEAR}) GROUP BY 1, 2",
    "day_mod7_groups": f"{COHORT} SELECT day % 7 AS day_mod7, count(*) AS n_groups FROM "
    f"(SELECT DISTINCT gender, day FROM dt WHERE MCC = {BARS}) GROUP BY 1",
    "gender_day_counts": f"{COHORT} SELECT gender, day, count(MCC) AS MCC, count(time) AS time, count(hour) AS hour "
    "FROM dt GROUP BY gender, day",
    "gender_counts": f"{LABELLED} SELECT gender, "
    + columns({c: f"count({c})" for c in LABELLED_TYPES if c != "gender"})
    + " FROM lab GROUP BY gender",
    "mcc_value_counts": f"{COHORT} SELECT gender, MCC, count(*) AS n FROM dt GROUP BY gender, MCC",
    "mcc_count_diff": f"{COHORT}{DIFFERENCE} SELECT MCC, count_true, count_false, diff_true_false FROM diff",
    "describe_mcc_diff": f"{COHORT}{DIFFERENCE} SELECT {described('diff_true_false')}, min(diff_true_false) AS min, "
    "max(diff_true_false) AS max FROM diff",
    "gender_skew_by_mcc": f"{LABELLED}{SKEW} SELECT mcc_code, count_0, count_1, count_0 - count_1 AS dif_count, "
    "count_0 + count_1 AS all_count, CAST(count_0 - count_1 AS DOUBLE) / (count_0 + count_1) AS dif, "
    "abs(CAST(count_0 - count_1 AS DOUBLE) / (count_0 + count_1)) AS dif_abs FROM skew",
    "gender_skew_joined": f"{LABELLED}{SKEW} SELECT client_id, mcc_code, amount, "
    "CAST(count_0 - count_1 AS DOUBLE) / (count_0 + count_1) AS dif FROM lab JOIN skew USING (mcc_code)",
    "exclusive_mcc": f"{COHORT} SELECT 'gender=1' AS used_only_by, MCC FROM (SELECT MCC FROM dt WHERE gender = 1 "
    "EXCEPT SELECT MCC FROM dt WHERE gender = 0) UNION ALL SELECT 'gender=0', MCC FROM (SELECT MCC FROM dt WHERE gender = 0 "
    "EXCEPT SELECT MCC FROM dt WHERE gender = 1)",
    "nuniques_by_group": f"{COHORT} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_all, count(DISTINCT {c}) FILTER (gender = 0) AS n_gender_0, "
        f"count(DISTINCT {c}) FILTER (gender = 1) AS n_gender_1 FROM dt"
        for c in COHORT_COLUMNS
    ),
    "describe_amount_by_gender": f"{LABELLED} SELECT gender, CASE WHEN amount < 0 THEN 'amount < 0' ELSE 'amount >= 0' END AS side, "
    f"{described('amount')}, {rounded({'min': 'min(amount)', 'max': 'max(amount)'})} FROM lab GROUP BY 1, 2",
    "mcc_histogram": f"{COHORT}, ends AS (SELECT CAST(min(MCC) AS BIGINT) AS low, CAST(max(MCC) AS BIGINT) AS high FROM dt) "
    f"SELECT gender, CAST(least((MCC - low) * {HISTOGRAM_BINS} // (high - low), {HISTOGRAM_BINS - 1}) AS INTEGER) AS bin, "
    "count(*) AS n FROM dt, ends GROUP BY 1, 2",
    "null_profile": f"{LABELLED} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) - count({c}) AS n_null, count({c}) AS n_non_null FROM lab"
        for c, t in LABELLED_TYPES.items()
    ),
    "table_shape": f"{LABELLED} SELECT count(*) AS n_rows, {len(LABELLED_TYPES)} AS n_columns FROM lab",
    "day_range": f"{COHORT} SELECT min(day) AS first_day, max(day) AS last_day, DATE '2019-08-02' + min(day) AS first_date, "
    "DATE '2019-08-02' + max(day) AS last_date FROM dt",
    "class_balance": f"{LABELLED} SELECT count(*) FILTER (gender = 0) AS n_0, count(*) FILTER (gender = 1) AS n_1, "
    "abs(count(*) FILTER (gender = 0) - count(*) FILTER (gender = 1)) AS difference FROM lab",
    "balanced_sample": f"{LABELLED} SELECT gender, CAST({SMALLER_CLASS} AS BIGINT) AS n FROM lab GROUP BY gender",
    "balanced_value_counts": f"{LABELLED} SELECT CAST(2 * {SMALLER_CLASS} AS BIGINT) AS control_total",
    "holdout_split": f"{LABELLED}, c AS (SELECT count(DISTINCT client_id) AS n FROM lab) "
    "SELECT 'test' AS part, n // 5 AS n_clients FROM c UNION ALL SELECT 'train', n - n // 5 FROM c",
    "stratified_holdout_split": f"{LABELLED}, c AS (SELECT count(DISTINCT client_id) AS n FROM lab) "
    "SELECT gender, n // 10 AS n_clients FROM (SELECT DISTINCT gender FROM lab), c",
    "target_encoding": f"{LABELLED}{PLACED} SELECT mcc_code, trans_type, trans_city, gender, place, "
    + columns({f"{c}_target": encoded(c) for c in ("mcc_code", "trans_type", "trans_city")})
    + " FROM placed",
    "auc_of_amount": f"{LABELLED}, {auc('lab', 'amount')}",
    "auc_of_income_by_type": f"{LABELLED}, {auc('lab', 'CAST(amount >= 0 AS INTEGER)', 'trans_type')}",
    "balanced_sample_bag": f"{LABELLED} SELECT CAST(0 AS BIGINT) AS only_left, "
    f"CAST(count(*) - 2 * {SMALLER_CLASS} AS BIGINT) AS only_right FROM lab",
    "holdout_bag": "SELECT CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right, CAST(0 AS BIGINT) AS n_common",
    "row_split": f"{LABELLED}, c AS (SELECT count(*) AS n, CAST(ceil(0.3::DOUBLE * count(*)) AS BIGINT) AS t FROM lab) "
    "SELECT 'train' AS part, n - t AS n FROM c UNION ALL SELECT 'test', t FROM c "
    "UNION ALL SELECT 'lost', CAST(0 AS BIGINT) UNION ALL SELECT 'gained', CAST(0 AS BIGINT)",
    "nuniques_long": f"{COHORT} "
    + " UNION ALL ".join(
        f"SELECT day AS group_key, '{c}' AS column_name, count(DISTINCT {c}) AS n FROM dt WHERE {c} IS NOT NULL GROUP BY day"
        for c in COHORT_COLUMNS
    ),
    "mcc_bins_auto": f"{COHORT}{AUTO_BINS} SELECT low, high, bins, {four_digits('width')} AS width FROM chosen",
    "mcc_histogram_auto": f"{COHORT}{AUTO_BINS} SELECT gender, CAST(least(floor((CAST(MCC AS DOUBLE) - low) * bins / (high - low)), "
    "bins - 1) AS INTEGER) AS bin, count(*) AS n FROM dt, chosen GROUP BY 1, 2",
    "gender_day_rows": f"{COHORT} SELECT gender, day, count(MCC) AS MCC, count(time) AS time, count(hour) AS hour "
    f"FROM dt GROUP BY gender, day ORDER BY day, gender OFFSET {FIRST_LINE}",
    "raw_null_profile": f"WITH {TXN} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, '{c}' AS column_name, '{t}' AS data_type, count(*) - count({c}) AS n_null, "
        f"count({c}) AS n_non_null FROM {source}"
        for name, source, types in (("transactions", "txn", RAW_TYPES), ("labels", "labels_known", LABEL_TYPES))
        for c, t in types.items()
    ),
    "csv_round_trip": f"WITH {TXN} SELECT * FROM txn",
    "rejected_rows": f"WITH {TXN} SELECT 'mcc_code' AS column_name, 'x' || CAST(mcc_code AS VARCHAR) AS value, count(*) AS n FROM txn "
    "WHERE mcc_code % 97 = 0 GROUP BY 2 UNION ALL SELECT 'amount', '12,5', count(*) FROM txn "
    "WHERE CAST(round(amount * 100) AS BIGINT) % 89 = 0",
    "submission_file": f"WITH {TXN}, known AS (SELECT * FROM txn WHERE client_id IN "
    "(SELECT c_custkey FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 5 = 0)) "
    "SELECT count(*) AS n_rows, count(DISTINCT client_id) AS n_clients, 0::DOUBLE AS lowest, 1::DOUBLE AS highest FROM known",
}

ORACLE_SQL |= {f"{name}_hot": ORACLE_SQL[name] for name in BY_LIMITS}
