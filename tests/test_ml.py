import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapspark.operators import ml as M
from lapspark.session import shared_dir

NAMES = [f"f{i}" for i in range(10)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(42)
    data = np.concatenate([rng.normal(0, 1, (30, 10)), rng.normal(5, 1, (30, 10))])
    data[:, 9] = rng.normal(0, 1, 60)  # a feature that says nothing
    pdf = pd.DataFrame(data, columns=NAMES)
    pdf.insert(0, "label", ["AAA"] * 30 + ["BBB"] * 30)
    pdf.insert(0, "id", range(60))
    return spark.createDataFrame(pdf)


def test_train_save_predict(spark, rows):
    path = shared_dir(spark, "model")
    M.save_model(M.train_classifier(rows, NAMES, trees=10), path)
    model = M.load_model(path)
    assert M.model_labels(model) == ["AAA", "BBB"]
    assert M.accuracy(M.predict(model, rows)).collect()[0].accuracy == 1.0
    ranked = M.class_probabilities(model, rows, "id")
    assert ranked.count() == 120
    assert ranked.groupBy("id").agg(F.sum("probability").alias("p")).where(F.abs(F.col("p") - 1) > 1e-6).count() == 0


def test_boosted(rows):
    model = M.train_classifier(rows, NAMES, trees=3, boosted=True)
    assert M.accuracy(M.predict(model, rows)).collect()[0].accuracy > 0.9


def test_one_class_is_refused(rows):
    with pytest.raises(ValueError, match="two classes"):
        M.train_classifier(rows.where("label = 'AAA'"), NAMES)


def test_folds_and_cross_validation(rows):
    sizes = M.stratified_folds(rows).groupBy("label", "fold").count().collect()
    assert len(sizes) == 10 and all(r["count"] == 6 for r in sizes)
    scores = M.cross_validate(rows, NAMES, trees=5).orderBy("fold").collect()
    assert [r.fold for r in scores] == [0, 1, 2, 3, 4]
    values = np.array([r.accuracy for r in scores])
    assert scores[0].cv_mean == pytest.approx(values.mean()) and scores[0].cv_std == pytest.approx(values.std())
    assert values.mean() > 0.9


def test_class_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")], "label string, predicted string")
    got = {r["class"]: r for r in M.class_metrics(df).collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].support) == (0.5, 0.5, 2)
    assert got["b"].f1_score == pytest.approx(0.8) and got["b"].f1_band == "medium"
    assert (got["c"].precision, got["c"].recall, got["c"].f1_score) == (0.0, 0.0, 0.0)


def test_attribution(rows):
    one = rows.select("id", "label", *NAMES[8:])  # one telling and one empty feature
    model = M.train_classifier(one, NAMES[8:], trees=20)
    importance = {r.feature: r.importance for r in M.feature_importance(model, one, NAMES[8:]).collect()}
    assert importance["f8"] > 0.2 > abs(importance["f9"])
    shap = M.shapley_sample(model, one, one, NAMES[8:], permutations=6)
    assert shap.count() == 120
    top = shap.where("rank = 1").groupBy("feature").count().collect()
    assert max(top, key=lambda r: r["count"]).feature == "f8"
