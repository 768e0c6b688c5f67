"""Lap classification with Spark ML: training, stratified folds, metrics, attribution."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapspark.operators.ordered import row_number_in_order
from lapspark.session import materialize

# Model size of the classifier.
TREES = 300
DEPTH = 5
LEARNING_RATE = 0.05
SUBSAMPLE = 0.8
SEED = 42
FOLDS = 5


def require_two_classes(rows: DataFrame, label: str = "label") -> None:
    """A classifier needs at least two classes: the smallest and the largest label differ."""
    low, high = rows.agg(F.min(label), F.max(label)).first()
    if low is None or low == high:
        raise ValueError("training needs at least two classes")


def classifier(
    features: Sequence[str], label: str = "label", trees: int = TREES, boosted: bool = False
) -> Pipeline:
    """Label index, feature vector and tree model as one pipeline."""
    common = {"featuresCol": "features_vec", "labelCol": "label_index", "seed": SEED}
    if boosted:
        gbt = GBTClassifier(
            maxIter=trees, maxDepth=DEPTH, stepSize=LEARNING_RATE, subsamplingRate=SUBSAMPLE, **common
        )
        model = OneVsRest(classifier=gbt, featuresCol="features_vec", labelCol="label_index")
    else:
        model = RandomForestClassifier(
            numTrees=trees, maxDepth=DEPTH, subsamplingRate=SUBSAMPLE, **common
        )
    return Pipeline(
        stages=[
            StringIndexer(
                inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="keep"
            ),
            VectorAssembler(inputCols=list(features), outputCol="features_vec"),
            model,
        ]
    )


def train_classifier(
    rows: DataFrame, features: Sequence[str], label: str = "label", trees: int = TREES, boosted: bool = False
) -> PipelineModel:
    require_two_classes(rows, label)
    return classifier(features, label, trees, boosted).fit(rows)


def model_labels(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with ``predicted`` (label text) and, where the model has them, class probabilities."""
    scored = model.transform(rows)
    names = F.array(*[F.lit(n) for n in model_labels(model)])
    out = scored.withColumn("predicted", F.get(names, F.col("prediction").cast("int")))
    if "probability" in scored.columns:
        out = out.withColumn("probabilities", vector_to_array("probability"))
    return out.drop("rawPrediction", "probability", "prediction", "features_vec", "label_index")


def class_probabilities(model: PipelineModel, rows: DataFrame, ident: str) -> DataFrame:
    """Ranked class probabilities of each lap in long form (one row per class)."""
    names = F.array(*[F.lit(n) for n in model_labels(model)])
    scored = predict(model, rows)
    pairs = F.zip_with(
        names, F.slice("probabilities", 1, F.size(names)), lambda n, p: F.struct((-p).alias("m"), n.alias("class"))
    )
    return scored.select(ident, F.posexplode(F.array_sort(pairs)).alias("_i", "_p")).select(
        ident,
        (F.col("_i") + 1).alias("rank"),
        F.col("_p.class").alias("class"),
        (-F.col("_p.m")).alias("probability"),
    )


def stratified_folds(
    rows: DataFrame, label: str = "label", ident: str = "id", folds: int = FOLDS, seed: int = SEED
) -> DataFrame:
    """Shuffled, class-balanced fold numbers: position within the class by hash, modulo the folds."""
    hashed = rows.withColumn("_h", F.xxhash64(ident, F.lit(seed)))
    numbered = row_number_in_order(
        hashed, [label], ["_h", ident], F.shiftright("_h", 52), "_rank"
    )
    return numbered.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(folds)).cast("int")).drop("_h", "_rank")


def cross_validate(
    rows: DataFrame,
    features: Sequence[str],
    label: str = "label",
    ident: str = "id",
    folds: int = FOLDS,
    trees: int = TREES,
) -> DataFrame:
    """Accuracy of every fold with the mean, population deviation and difference to the mean."""
    require_two_classes(rows, label)
    split = materialize(stratified_folds(rows, label, ident, folds))

    def score(fold: int) -> DataFrame:
        model = classifier(features, label, trees).fit(split.where(F.col("fold") != fold))
        held = predict(model, split.where(F.col("fold") == fold))
        hit = F.coalesce(F.col("predicted") == F.col(label).cast("string"), F.lit(False))
        return held.select("fold", hit.alias("_hit"))

    # The folds are independent jobs; submitting them together keeps the cluster busy.
    with ThreadPool(min(folds, 5)) as pool:
        scored = pool.map(score, range(folds))
    per_fold = materialize(
        reduce(DataFrame.unionByName, scored)
        .groupBy("fold")
        .agg(F.avg(F.col("_hit").cast("double")).alias("accuracy"))
    )
    overall = per_fold.agg(
        F.avg("accuracy").alias("cv_mean"), F.stddev_pop("accuracy").alias("cv_std")
    )
    out = per_fold.withColumns(
        {"cv_mean": overall.select("cv_mean").scalar(), "cv_std": overall.select("cv_std").scalar()}
    )
    return out.withColumn("delta", F.col("accuracy") - F.col("cv_mean"))


def confusion_matrix(predictions: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return predictions.groupBy(
        F.col(label).cast("string").alias("actual"), F.col(predicted).cast("string").alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(predictions: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support per class; zero denominators give 0."""
    cells = confusion_matrix(predictions, label, predicted)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    actual = cells.groupBy(F.col("actual").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(hit).alias("_tp")
    )
    called = cells.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("_called"))
    both = actual.join(called, "class", "full").fillna(0, subset=["support", "_tp", "_called"])
    precision = F.when(F.col("_called") > 0, F.col("_tp") / F.col("_called")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("_tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(
        F.col("precision") + F.col("recall") > 0,
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")),
    ).otherwise(0.0)
    out = both.withColumns({"precision": precision, "recall": recall}).withColumn("f1_score", f1)
    band = F.when(F.col("f1_score") >= 0.90, "high").when(F.col("f1_score") >= 0.70, "medium").otherwise("low")
    return out.withColumn("f1_band", band).drop("_tp", "_called")


def accuracy(predictions: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    hit = F.coalesce(F.col(predicted).cast("string") == F.col(label).cast("string"), F.lit(False))
    return predictions.agg(F.avg(hit.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n_samples"))


def _shuffled_partner(rows: DataFrame, features: Sequence[str], ident: str, seed: int) -> DataFrame:
    """Pair every row with another row's features: equal ranks of two different hash orders.

    Both orders are numbered in hash buckets, so the permutation never gathers the table.
    """
    base = rows.select(F.lit(1).alias("_all"), ident, F.array(*features).alias("_other"))

    def numbered(salt: int) -> DataFrame:
        hashed = base.withColumn("_h", F.xxhash64(ident, F.lit(seed), F.lit(salt)))
        return row_number_in_order(hashed, ["_all"], ["_h", ident], F.shiftright("_h", 48), "_rank")

    take = numbered(0).select(ident, "_rank")
    return take.join(numbered(1).select("_rank", "_other"), "_rank").select(ident, "_other")


def feature_importance(
    model: PipelineModel,
    rows: DataFrame,
    features: Sequence[str],
    label: str = "label",
    ident: str = "id",
    top: int = 10,
    seed: int = SEED,
) -> DataFrame:
    """Permutation importance: accuracy lost when one feature's values are shuffled among the rows.

    Each row is copied once per feature with that feature taken from its partner (plus one untouched
    copy), and all copies are scored by one ``transform``.
    """
    features = list(features)
    paired = rows.join(_shuffled_partner(rows, features, ident, seed), ident)
    copies = paired.withColumn("_i", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))))
    swapped = {
        f: F.when(F.col("_i") == i, F.get("_other", F.lit(i))).otherwise(F.col(f))
        for i, f in enumerate(features)
    }
    scored = predict(model, copies.withColumns(swapped))
    hit = F.coalesce(F.col("predicted") == F.col(label).cast("string"), F.lit(False)).cast("double")
    by_copy = materialize(scored.groupBy("_i").agg(F.avg(hit).alias("_acc")))
    whole = by_copy.agg(F.max(F.when(F.col("_i") == -1, F.col("_acc"))).alias("_base"))
    drops = by_copy.where(F.col("_i") >= 0).withColumn("_base", whole.scalar())
    name = F.get(F.array(*[F.lit(f) for f in features]), F.col("_i"))
    return (
        drops.select(name.alias("feature"), (F.col("_base") - F.col("_acc")).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
        .limit(top)
    )


def shapley_sample(
    model: PipelineModel,
    rows: DataFrame,
    background: DataFrame,
    features: Sequence[str],
    ident: str = "id",
    permutations: int = 8,
    seed: int = SEED,
) -> DataFrame:
    """Sampled Shapley values of the predicted class for every row.

    For each permutation a row is paired with one background row; walking the permutation, features
    move one by one from the background's value to the row's own value, and the change in the
    predicted class's probability is credited to the moved feature. Every step is a row, all steps
    are scored by one ``transform``. The attributions of a row add up to ``own_probability`` minus
    ``background_probability`` (its mean over the background rows that were drawn).
    """
    features = list(features)
    n = len(features)
    slots = background.count()
    numbered = row_number_in_order(
        background.select(F.lit(1).alias("_all"), F.array(*features).alias("_bg"), F.xxhash64(*features).alias("_h")),
        ["_all"], ["_h", "_bg"], F.shiftright("_h", 48), "_slot",
    ).select("_slot", "_bg")
    names = model_labels(model)
    own = predict(model, rows)
    target = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("predicted")).cast("int")
    draws = own.select(
        ident, target.alias("_class"), F.array(*features).alias("_own"),
        F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("_draw"),
    )
    draws = draws.withColumn("_slot", F.pmod(F.xxhash64(ident, "_draw", F.lit(seed)), F.lit(slots)) + 1)
    draws = draws.join(numbered, "_slot")
    order = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)),
            lambda i: F.struct(F.xxhash64(F.col(ident), F.col("_draw"), i, F.lit(seed)).alias("h"), i.alias("i")),
        )
    )
    draws = draws.withColumn("_order", F.transform(order, lambda s: s["i"]))
    steps = draws.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(n))))
    values = {
        f: F.when(
            F.array_position("_order", F.lit(i)) <= F.col("_step"), F.get("_own", F.lit(i))
        ).otherwise(F.get("_bg", F.lit(i)))
        for i, f in enumerate(features)
    }
    scored = model.transform(steps.withColumns(values).withColumn("label", F.lit(names[0])))
    prob = F.get(vector_to_array("probability"), F.col("_class") - 1)
    # n+1 steps per draw: a fixed, small group.
    walk = scored.groupBy(ident, "_draw").agg(
        F.first("_order").alias("_order"),
        F.sort_array(F.collect_list(F.struct("_step", prob.alias("p")))).alias("_walk"),
    )
    gains = F.transform(
        F.sequence(F.lit(1), F.lit(n)),
        lambda s: F.struct(
            F.get(F.array(*[F.lit(f) for f in features]), F.get("_order", s - 1)).alias("feature"),
            (F.get(F.col("_walk")["p"], s) - F.get(F.col("_walk")["p"], s - 1)).alias("gain"),
        ),
    )
    p = F.col("_walk")["p"]
    credit = walk.select(ident, F.get(p, n).alias("_own"), F.get(p, 0).alias("_base"), F.inline(gains)).groupBy(ident, "feature").agg(
        F.avg("gain").alias("attribution"), F.avg("_own").alias("own_probability"),
        F.avg("_base").alias("background_probability"),
    )
    from pyspark.sql import Window

    by_size = Window.partitionBy(ident).orderBy(F.desc(F.abs("attribution")), "feature")
    return credit.withColumn("rank", F.row_number().over(by_size))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
