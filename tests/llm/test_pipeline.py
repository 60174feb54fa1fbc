"""The five stages in a row, over documents with planted cases and columns whose names the stages use themselves."""

from __future__ import annotations

from helpers import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from tillroll.llm.decontaminate import leaks
from tillroll.llm.ngram_join import one_of_each


def test_stages_over_planted_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    item = next(r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if len(r.text.split()) > 20)
    words = [f"word{i} and thing{i * 7 % 50}" for i in range(120)]
    long = " ".join(words) + "."
    made = [(10**6, long), (10**6 + 1, long), (10**6 + 2, long.replace("word60 ", "other ")), (10**6 + 3, f"Before it there are words. {item} After it as well."),
            (10**6 + 4, f"Write to anna.schmidt@example.org about the {' '.join(words[:30])}."), (10**6 + 5, None), (10**6 + 6, "too short")]
    planted = spark.createDataFrame([(i, t, "en", "made", 0) for i, t in made], docs.schema)
    clashing = {c: F.lit("mine") for c in ("kept", "quality", "doc", "component_id", "key", "_leak_key", "s", "h1", "row", "entities", "n_entities")}
    (tmp_path / "in").mkdir()
    docs.unionByName(planted).withColumns(clashing).coalesce(3).write.parquet(f"{tmp_path}/in/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/in/benchmark.parquet")

    given, seen = spark.read.parquet(f"{tmp_path}/in/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, given, f"{tmp_path}/in").write.parquet(f"{tmp_path}/{k}")
        left = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert left.columns == given.columns
            assert {r[0] for r in left.select("doc_id").collect()} <= {r[0] for r in given.select("doc_id").collect()}
            assert left.filter("kept != 'mine' OR quality != 'mine' OR _leak_key != 'mine' OR h1 != 'mine' OR entities != 'mine'").isEmpty()
        seen.append({r[0] for r in left.select("doc_id").collect()})
        given = left
    cleaned, single, free, private, packed = seen
    assert not {10**6 + 5, 10**6 + 6} & cleaned and 10**6 + 3 in cleaned
    assert single & {10**6, 10**6 + 1, 10**6 + 2} == {10**6}
    assert 10**6 + 3 in single and 10**6 + 3 not in free
    assert private == free and packed == private
    assert one_of_each(spark.read.parquet(f"{tmp_path}/2")).count() == len(free)
    assert leaks(spark.read.parquet(f"{tmp_path}/2"), spark.read.parquet(f"{tmp_path}/in/benchmark.parquet")).isEmpty()
    assert "anna.schmidt@example.org" not in spark.read.parquet(f"{tmp_path}/3").filter(f"doc_id = {10**6 + 4}").first().text
    bins = given.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("offset").alias("first"))
    assert bins.filter("n != end OR first != 0 OR end > 1024").isEmpty()
    assert corpus_pipeline.run(spark, f"{tmp_path}/in").count() == given.count()
