"""Classifiers over the feature sets: fit, validate, score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, TargetEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.encoding import content_place, ordered_target_encoding
from tillroll.operators.lineage import drop, new_path, written
from tillroll.operators.ranks import auc_of
from tillroll.plans.boosting import grown_with_patience, validation_curve
from tillroll.plans.packed import Grower, borders_of, with_bins

LABEL = "gender"
CATEGORICAL = ["mcc_code", "trans_type", "trans_city", "mcc_describe"]
NOT_FEATURES = ["term_id", "client_id", LABEL]
ONE_HOT = ["trans_city", "mcc_describe"]

# The settings of the two trainings and of the forest.
SEED = 63
SCORING_ITERATIONS, SCORING_RATE = 1500, 0.011
TRAINING_ITERATIONS, TRAINING_RATE = 100, 0.1
FOREST_DEPTH = 10
PATIENCE = 70

# Missing numbers count as smaller than every number in the boosted trees, and as 0 in the forest.
BELOW_ALL = -1.0e12


def numeric_features(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    skipped = {*NOT_FEATURES, *CATEGORICAL, *without}
    return [name for name, dtype in df.dtypes if name not in skipped and dtype in ("int", "bigint", "double")]


def prepared(df: DataFrame, missing: float = BELOW_ALL) -> DataFrame:
    """Categories as strings, numbers as finite doubles, label as double."""
    out = {c: F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in CATEGORICAL}
    for c in numeric_features(df):
        value = F.col(c).cast("double")
        out[c] = F.when(value == F.lit(float("inf")), F.lit(-BELOW_ALL)).otherwise(F.coalesce(value, F.lit(missing)))
    if LABEL in df.columns:
        out[LABEL] = F.col(LABEL).cast("double")
    return df.withColumns(out)


def with_validation_flag(df: DataFrame, share: float, seed: int = SEED) -> DataFrame:
    """Marks a share of the clients, with all their rows, for validation."""
    return df.withColumn("is_validation", F.pmod(F.xxhash64(F.lit(seed), "client_id"), F.lit(10_000)) < int(share * 10_000))


def fit_boosted(
    features: DataFrame,
    iterations: int = SCORING_ITERATIONS,
    rate: float = SCORING_RATE,
    depth: int = 6,
    seed: int = SEED,
    validation_share: float = 0.0,
    patience: int = PATIENCE,
    stored: bool = False,
) -> PipelineModel:
    """Boosted trees on ordered target statistics of the categories.

    A training row's categories are encoded from earlier rows of a permutation only, so no row sees its own label; other rows get
    the statistics of all training rows. With a validation share (of the clients), training stops when ``patience`` trees have
    brought no gain in the area under the curve there, and the best prefix is kept. The features are written out first, since
    indexing, encoding and training each read them, unless they are ``stored`` already. Numbers are packed to the trees' bins, a byte
    each, before the rows are exchanged and written for the encoding.
    """
    data = prepared(features) if stored else written(prepared(features))
    if validation_share > 0:
        data = with_validation_flag(data, validation_share, seed)
        known = data.filter(~F.col("is_validation"))
    else:
        known = data
    encoding = _encoding(features).fit(known)
    *encoders, assembler = encoding.stages
    mean = known.agg(F.avg(LABEL)).first()[0] or 0.0
    numbers, values = F.array(*numeric_features(features)), [f"{c}_value" for c in CATEGORICAL]
    borders = borders_of(known, numbers, seed)
    placed = known.withColumn("place", content_place(data.columns, seed))
    spark, paths = features.sparkSession, [new_path(features.sparkSession) for _ in range(2)]
    narrow = written(with_bins(placed, numbers, borders, [*CATEGORICAL, LABEL, "place"]), paths[0])
    ordered = ordered_target_encoding(narrow, CATEGORICAL, LABEL, "place", prior=mean, suffix="_value")
    learnt = written(ordered.select(LABEL, "bins", F.array(*values).alias("values")), paths[1])
    drop(spark, paths[0])
    further = borders_of(learnt, F.col("values"), seed)
    rows = with_bins(learnt, F.col("values"), further, [LABEL, "bins"], "further").select(LABEL, F.concat("bins", "further").alias("bins"))
    grower = Grower(rows, LABEL, borders + further, rate, depth)
    if validation_share > 0:
        unseen = written(encoding.transform(data.filter("is_validation")).select(LABEL, "features"))
        model, _ = grown_with_patience(grower, unseen, LABEL, iterations, seed, patience)
    else:
        grower.grow(iterations)
        model = grower.model(LABEL, "features", seed, iterations)
        grower.close()
    drop(spark, paths[1])
    return PipelineModel([*encoders, assembler, model])


def _encoding(features: DataFrame) -> Pipeline:
    """Categories to their target statistics, and all features into one vector."""
    indexed, encoded = [f"{c}_index" for c in CATEGORICAL], [f"{c}_target" for c in CATEGORICAL]
    return Pipeline(
        stages=[
            StringIndexer(inputCols=CATEGORICAL, outputCols=indexed, handleInvalid="keep"),
            TargetEncoder(
                inputCols=indexed, outputCols=encoded, labelCol=LABEL, targetType="binary", smoothing=1.0, handleInvalid="keep"
            ),
            # the sum drops the category marks of the index, so that the trees see plain numbers
            SQLTransformer(statement="SELECT *, " + ", ".join(f"{c}_target + 0D AS {c}_value" for c in CATEGORICAL) + " FROM __THIS__"),
            VectorAssembler(inputCols=[*numeric_features(features), *[f"{c}_value" for c in CATEGORICAL]], outputCol="features"),
        ]
    )


def fit_forest(
    features: DataFrame, trees: int = 100, depth: int = FOREST_DEPTH, seed: int = SEED, stored: bool = False
) -> PipelineModel:
    """Random forest on one-hot city and code group; the raw code is left out, missing numbers are 0. ``stored``: see ``fit_boosted``."""
    data = prepared(features, missing=0.0).withColumn("trans_type", F.col("trans_type").cast("double"))
    data = data if stored else written(data)
    numeric = [*numeric_features(features), "trans_type"]
    indexed, hot = [f"{c}_index" for c in ONE_HOT], [f"{c}_hot" for c in ONE_HOT]
    stages = [
        StringIndexer(inputCols=ONE_HOT, outputCols=indexed, handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=hot, handleInvalid="keep"),
        VectorAssembler(inputCols=[*numeric, *hot], outputCol="features"),
        RandomForestClassifier(labelCol=LABEL, numTrees=trees, maxDepth=depth, seed=seed),
    ]
    return Pipeline(stages=stages).fit(data)


def scored_by_boosted(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Every transaction with the probability of the positive class."""
    out = model.transform(prepared(features))
    return out.select(
        "client_id",
        vector_to_array("probability")[1].alias("probability"),
        *([LABEL] if LABEL in features.columns else []),
    )


def curve_of(model: PipelineModel, features: DataFrame) -> DataFrame:
    """The ``validation_curve`` of fitted boosted trees over labelled features."""
    *encoders, boosted = model.stages
    return validation_curve(boosted, PipelineModel(encoders).transform(prepared(features)), LABEL)


def predicted_by_forest(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Every transaction with its hard prediction (0 or 1)."""
    data = prepared(features, missing=0.0).withColumn("trans_type", F.col("trans_type").cast("double"))
    return model.transform(data).select("client_id", F.col("prediction"), *([LABEL] if LABEL in features.columns else []))


def auc(scored: DataFrame, score: str = "probability") -> float:
    """Area under the ROC curve of a score column against the label, with a point for every distinct score."""
    return auc_of(scored, score, LABEL).first()["auc"]
