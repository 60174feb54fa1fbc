from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tillroll.sources.readers import accepted, checked, read_clients, read_labels, read_transactions, rejected
from tillroll.sources.schema import LABELS, TRANSACTIONS
from tillroll.sources.writers import commit_predictions, manifests, read_predictions, write_predictions


def write(path, text):
    path.write_text(text)


def test_csv_with_unnamed_column_and_missing_values(spark, tmp_path):
    write(
        tmp_path / "transactions.csv",
        ",client_id,trans_time,mcc_code,trans_type,trans_city,term_id,amount\n"
        "0,7,3 10:00:00,5992,1010,Tver,T1,-5.25\n"
        "1,8,4 11:00:60,5813.0,1020,,NaN,nan\n"
        "2,9,5 12:00:00,,x,Omsk,0012,1e2\n",
    )
    df = read_transactions(spark, str(tmp_path))
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in TRANSACTIONS]
    rows = [tuple(r) for r in df.orderBy("client_id").collect()]
    assert rows == [
        (7, "3 10:00:00", 5992, 1010, "Tver", "T1", -5.25),
        (8, "4 11:00:60", 5813, 1020, None, None, None),
        (9, "5 12:00:00", None, None, "Omsk", "0012", 100.0),
    ]


def test_labels_and_clients(spark, tmp_path):
    write(tmp_path / "train.csv", "client_id,gender\n1,0\n2,1\n")
    write(tmp_path / "test.csv", "Unnamed: 0,client_id\n0,3\n1,4\n")
    assert sorted(map(tuple, read_labels(spark, str(tmp_path)).collect())) == [(1, 0), (2, 1)]
    assert sorted(map(tuple, read_clients(spark, str(tmp_path)).collect())) == [(3,), (4,)]


def test_parquet_round_trip(spark, edge, tmp_path):
    edge.write.parquet(str(tmp_path / "t"))
    back = read_transactions(spark, str(tmp_path), "t", "parquet")
    assert sorted(map(str, back.collect())) == sorted(map(str, edge.collect()))


def test_missing_column_and_unknown_format(spark, tmp_path):
    write(tmp_path / "train.csv", "client_id\n1\n")
    with pytest.raises(ValueError, match="gender"):
        read_labels(spark, str(tmp_path))
    with pytest.raises(ValueError, match="format"):
        read_labels(spark, str(tmp_path), fmt="orc")


def test_predictions_have_no_row_number(spark, tmp_path):
    scored = spark.createDataFrame([(1, 0.25, 9), (1, 0.5, 9)], "client_id long, probability double, extra int")
    write_predictions(scored, str(tmp_path / "result"))
    back = spark.read.option("header", True).csv(str(tmp_path / "result"))
    assert back.columns == ["client_id", "probability"] and back.count() == 2


def test_cells_that_cannot_be_read_are_kept_and_counted(spark, tmp_path):
    lines = ["client_id,trans_time,mcc_code,trans_type,trans_city,term_id,amount",
             "1,0 10:00:00,5992,1010,a,t1,10.5", "x2,0 10:00:00,59x2,1010,a,NaN,oops", "3,0 10:00:00,5992.0,NA,a,,nan", "4,0 10:00:00,,1010,a,t,1e3"]
    (tmp_path / "transactions.csv").write_text("\n".join(lines) + "\n")
    rows, seen = checked(spark, str(tmp_path / "transactions.csv"), TRANSACTIONS)
    bad = [(r["client_id"], [(x["column_name"], x["value"]) for x in r["rejects"]]) for r in rejected(rows).collect()]
    assert bad == [(None, [("client_id", "x2"), ("mcc_code", "59x2"), ("amount", "oops")])]
    assert seen.get["rows"] == 4 and seen.get["rejected"] == 1
    assert {k: v for k, v in seen.get.items() if k.startswith("bad_") and v} == {"bad_client_id": 1, "bad_mcc_code": 1, "bad_amount": 1}
    good = accepted(checked(spark, str(tmp_path / "transactions.csv"), TRANSACTIONS)[0])
    assert good.columns == TRANSACTIONS.names and {r["client_id"] for r in good.collect()} == {1, 3, 4}


def test_rejects_of_parquet(spark, tmp_path):
    df = spark.createDataFrame([("1", "7.0"), ("b", None), (None, "z")], "client_id string, gender string")
    df.write.parquet(str(tmp_path / "t"))
    rows, _ = checked(spark, str(tmp_path / "t"), LABELS, "parquet")
    assert sorted([[x["value"] for x in r["rejects"]] for r in rows.collect()]) == [[], ["b"], ["z"]]


@pytest.fixture
def scored(spark):
    return spark.range(0, 500, 1, 6).select((F.col("id") % 37).alias("client_id"), ((F.col("id") % 101) / 100.0).alias("probability"))


def test_committed_predictions_read_back(spark, scored, tmp_path):
    path = str(tmp_path / "result")
    with pytest.raises(Exception, match="(?i)path|exist"):
        read_predictions(spark, path)
    commit_predictions(scored, path, 3)
    assert sorted(read_predictions(spark, path).collect()) == sorted(scored.collect())
    last = manifests(spark, path).first()
    assert (last["rows"], last["clients"], last["lowest"], last["highest"]) == (500, 37, 0.0, 1.0)


def test_a_run_that_fails_leaves_the_result_before_it(spark, scored, tmp_path):
    path = str(tmp_path / "result")
    commit_predictions(scored, path, 2)
    broken = scored.withColumn("probability", F.when(F.col("client_id") == 3, F.raise_error(F.lit("lost")).cast("double")).otherwise(0.5))
    with pytest.raises(Exception, match="lost"):
        commit_predictions(broken, path, 2)
    assert read_predictions(spark, path).count() == 500 and manifests(spark, path).count() == 1
    commit_predictions(scored.limit(7), path, 2)
    assert read_predictions(spark, path).count() == 7 and manifests(spark, path).count() == 2


def test_repeated_runs_write_the_same_parts_and_lost_rows_show(spark, scored, tmp_path):
    path = tmp_path / "result"
    folders = [commit_predictions(df, str(path), 3) for df in (scored, scored.repartition(5))]
    parts = [[f.read_text() for f in sorted((path / x).glob("part-*.csv"), key=lambda f: f.name[:10])] for x in folders]
    assert parts[0] == parts[1] and len(parts[0]) == 3
    next((path / folders[1]).glob("part-*.csv")).unlink()
    with pytest.raises(ValueError, match="its manifest 500"):
        read_predictions(spark, str(path))


def test_no_predictions_are_a_result_too(spark, scored, tmp_path):
    commit_predictions(scored.limit(0), str(tmp_path / "r"))
    assert read_predictions(spark, str(tmp_path / "r")).count() == 0
