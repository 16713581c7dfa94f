import pytest
from pyspark.sql import functions as F

from casework.operators import explain, models
from casework.operators.features import TfidfSpec

SPEC = TfidfSpec((1, 1), 300, 1)
TEXTS = {
    "Criminal Law": ("indictment for larceny, the prisoner was found guilty", "Larceny"),
    "Contract Law - Debt": ("suit on a promissory note for debt and payment", "Promissory Note"),
    "Property Law - Ejectment": ("ejectment to recover possession of land and title", "Ejectment"),
}
VERDICTS = ("Judgment AFFIRMED", "Judgment REVERSED", "Verdict Unknown")


@pytest.fixture(scope="module")
def cases(spark):
    rows = [
        (f"{i:04d}", f"{text} case {i % 5} {VERDICTS[i % 3]}", kind, sub if i % 2 else "General", VERDICTS[i % 3])
        for i, (kind, (text, sub)) in enumerate(list(TEXTS.items()) * 20)
    ]
    return spark.createDataFrame(rows, "case_id string, case_text string, case_type string, sub_type string, verdict string").cache()


def test_unknown_kind():
    with pytest.raises(ValueError):
        models.estimator("oracle", 10)


def test_case_classifier_and_storage(spark, cases, tmp_path):
    model = models.case_classifier("logistic", spec=SPEC, options={"maxIter": 15}).fit(cases)
    scores = {r.metric: r.value for r in model.evaluate(cases).collect()}
    assert scores["accuracy"] > 0.85
    model.save(str(tmp_path / "m"))
    again = models.TextClassifier.load(spark, str(tmp_path / "m"))
    both = model.predict(cases, "a", "c").join(again.predict(cases.select("case_id", "case_text"), "b").select("case_id", "b"), "case_id")
    assert both.filter("a <> b").count() == 0 and both.filter("c <= 0 OR c > 1").count() == 0
    top = explain.feature_importance(explain.linear_weights(model), 5)
    assert top.count() == 5


def test_verdict_predictor(spark, cases):
    model = models.VerdictPredictor("naive_bayes", spec=SPEC).fit(cases)
    assert model.inner.classes == ["affirmed", "reversed"]
    unknown = cases.withColumn("verdict", F.lit("Verdict Unknown"))
    assert {r.value for r in model.evaluate(unknown).collect()} == {0.0}


def test_subtype_routes(spark, cases):
    odd = cases.limit(2).withColumns({"case_type": F.lit("Family Law - Dower"), "case_id": F.concat(F.lit("x"), "case_id")})
    model = models.SubtypeClassifier("naive_bayes", SPEC).fit(cases.unionByName(odd))
    assert sorted(model.models) == sorted(TEXTS)
    out = model.predict(cases.unionByName(odd))
    assert out.count() == 62
    assert {r.predicted_sub_type for r in out.filter("case_type = 'Family Law - Dower'").collect()} == {"Unclassified"}


def test_batch_predict_marks_bad_rows(spark, cases):
    fitted = {"case_type": models.TextClassifier("case_type", "naive_bayes", SPEC).fit(cases)}
    asked = cases.select(F.col("case_id").alias("id"), "case_text").unionByName(
        spark.createDataFrame([("bad", "short"), ("none", None)], "id string, case_text string")
    )
    out = {r.id: r for r in models.batch_predict(asked, fitted).collect()}
    assert len(out) == 62 and out["bad"].case_type == out["none"].verdict == "ERROR" and out["0000"].error is None


def test_registered_models_are_whole(spark, sf, monkeypatch):
    """What the registered queries fit, without fitting it: the operators' own specs, options and folds."""
    from __spark_entry__ import queries
    from casework.operators.features import PRESETS

    class Seen(BaseException):  # an exception would be taken for a type that cannot be fitted
        pass

    def fit(self, df):
        raise Seen(self.spec, self.options)

    monkeypatch.setattr(models.TextClassifier, "fit", fit)
    own = {n: TfidfSpec() for n in ("case_classifier", "calibrated_svm", "verdict_predictor", "batch_predict", "cross_validate")}
    own |= {n: TfidfSpec() for n in ("compare_models", "model_explanation", "saved_model")}
    own |= {"subtype_classifier": PRESETS["sub_type"], "hierarchy_classifier": PRESETS["hierarchy"], "preset_classifier": PRESETS["outcome"]}
    for name, spec in own.items():
        with pytest.raises(Seen) as seen:
            queries()[name](spark, sf)
        assert seen.value.args == (spec, {}), name
    given = []
    monkeypatch.setattr(models, "compare_models", lambda train, test, label, kinds, *a, **k: given.append((sorted(kinds), a, k)))
    monkeypatch.setattr(models.TextClassifier, "cross_validate", lambda self, df, k=5: given.append(k) or {"scores": []})
    queries()["compare_models"](spark, sf)
    queries()["cross_validate"](spark, sf)
    assert given == [(sorted(models.ESTIMATORS), (), {}), 5]


def test_texts_are_tokenised_once_for_all_fits(spark, cases, monkeypatch):
    """The rows' terms are stored, and every vocabulary and vector is made of them."""
    from casework.operators import features as feat

    counted, plain = [], feat.term_counts
    monkeypatch.setattr(feat, "term_counts", lambda *a: counted.append(a[0]) or plain(*a))
    two = [models.TextClassifier(t, "naive_bayes", SPEC) for t in ("case_type", "sub_type")]
    rows = cases.withColumn("sub_type", F.when(F.col("case_id") < "0040", F.col("sub_type")))
    models.fit_all(two, rows)
    assert len(counted) == 1
    alone = models.TextClassifier("sub_type", "naive_bayes", SPEC).fit(rows)
    assert len(counted) == 2 and two[1].classes == alone.classes
    terms = lambda m: sorted((r.term, r.idx, r.df, r.idf) for r in m.vocab.collect())
    assert terms(two[1]) == terms(alone) and two[1].model.theta == alone.model.theta
    models.SubtypeClassifier("naive_bayes", SPEC).fit(cases)
    assert len(counted) == 3
    with pytest.raises(ValueError):
        models.count_once(rows, [two[0], models.TextClassifier("sub_type", spec=TfidfSpec((1, 2)))])


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_repeated_and_null_ids_come_back_once(spark, cases):
    model = models.TextClassifier("case_type", "naive_bayes", SPEC).fit(cases)
    asked = cases.limit(2).unionByName(cases.limit(1)).withColumn("case_id", F.lit("same"))
    asked = asked.unionByName(cases.limit(2).withColumn("case_id", F.lit(None).cast("string"))).withColumn("features", F.lit("clash"))
    out = model.predict(asked, "kind", "sure")
    assert _exchanges(model.predict(cases, "kind")) == 0
    assert out.columns == [*asked.columns, "kind", "sure"]
    assert out.count() == 5 and out.filter("case_id IS NULL").count() == 2
    assert out.filter("kind = case_type").count() == 5


def test_hierarchy_and_batch_scan_once(spark, cases, tmp_path):
    rows = cases.withColumns(
        {
            "l0_label": F.when(F.col("case_type").startswith("Criminal"), "CRIMINAL").otherwise("CIVIL"),
            "l1_label": F.when(F.col("case_type").startswith("Criminal"), "CRIMINAL").otherwise("CIVIL"),
            "l2_civil": F.when(~F.col("case_type").startswith("Criminal"), F.substring("case_type", 1, 8)),
            "l2_criminal": F.when(F.col("case_type").startswith("Criminal"), F.concat(F.lit("c"), (F.col("case_id").cast("int") % 2).cast("string"))),
        }
    )
    model = models.HierarchyClassifier("naive_bayes", SPEC).fit(rows)
    asked = cases.select("case_id", "case_text")
    out = model.predict(asked)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Join") == 0
    model.save(str(tmp_path / "h"))
    again = models.HierarchyClassifier.load(spark, str(tmp_path / "h")).predict(asked)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))
    fitted = {t: models.TextClassifier(t, "naive_bayes", SPEC).fit(cases) for t in ("case_type", "verdict")}
    served = models.batch_predict(cases.select(F.col("case_id").alias("id"), "case_text"), fitted)
    assert _exchanges(served) == 0 and served.filter("case_type = 'ERROR'").count() == 0


def test_cross_validation_is_that_of_separate_fits(spark, cases):
    from dataclasses import replace

    from casework.operators.evaluate import metrics_row
    from casework.operators.sampling import stratified_kfold

    spec = TfidfSpec((1, 2), 40, 2, 0.9)
    model = models.TextClassifier("sub_type", "naive_bayes", spec)
    got = model.cross_validate(cases, 3)
    folds = stratified_kfold(cases, "sub_type", "case_id", 3)
    want = []
    for f in range(3):
        one = replace(model).fit(folds.filter(F.col("fold") != f))
        want.append(metrics_row(one.score(folds.filter(F.col("fold") == f), "sub_type"), "sub_type", "predicted").first()["f1_macro"])
    assert got["scores"] == want and abs(got["mean"] - sum(want) / 3) < 1e-12


def test_mixed_features_scaling_and_storage(spark, cases, tmp_path):
    rows = cases.withColumns({"court": F.when(F.col("case_id") < "0030", "North").otherwise("South"), "f_year": F.lit(1880.0) + F.length("case_text")})
    common = {"flags": False, "extra": ("f_year",), "categorical": ("court", "sub_type"), "scale": True}
    model = models.TextClassifier("case_type", "logistic", SPEC, options={"maxIter": 20}, **common).fit(rows)
    names = model.feature_names()
    assert names[-6:-4] == ["court=North", "court=South"] and names[model.vocab_size] == "f_year"
    assert model.model.numFeatures == len(names)
    strange = rows.limit(3).withColumns({"court": F.lit("West"), "sub_type": F.lit(None).cast("string"), "f_year": F.lit(None).cast("double")})
    assert model.predict(strange, "x").count() == 3
    model.save(str(tmp_path / "m"))
    again = models.TextClassifier.load(spark, str(tmp_path / "m"))
    one, two = (sorted((r.case_id, r.p, r.c) for r in m.predict(rows, "p", "c").collect()) for m in (model, again))
    assert one == two


def test_features_against_plain_counts(spark):
    """Vectors of text, numbers and categories, one by one."""
    import math

    from casework.operators import features as feat

    texts = [(1, "b a b c", 2.0, "x"), (2, "a", 0.0, None), (2, "zz zz", None, "y"), (None, "", 3.0, "new"), (5, None, None, "x")]
    df = spark.createDataFrame(texts, "id long, t string, n double, k string")
    spec = TfidfSpec((1, 1), 10, 1)
    counted = feat.with_terms(df, "t", spec)
    vocab = feat.vocabulary(counted, spec)
    got = feat.row_vector(counted, feat.Lookup(vocab), spec, ("n",), {"k": ["x", "y"]}).select("id", "t", "features").collect()
    idf = {w: math.log(6 / (1 + d)) + 1 for w, d in {"a": 2, "b": 1, "c": 1, "zz": 1}.items()}
    order = sorted(idf)
    for row, (_, text, number, kind) in zip(got, texts):
        words = (text or "").split()
        w = {t: (1 + math.log(words.count(t))) * idf[t] for t in set(words)}
        norm = math.sqrt(sum(v * v for v in w.values())) or 1.0
        want = {order.index(t): v / norm for t, v in w.items()}
        want |= {4: number} if number else {}
        want |= {5 + ["x", "y"].index(kind): 1.0} if kind in ("x", "y") else {}
        assert row.features.size == 7 and dict(zip(row.features.indices.tolist(), row.features.values)) == pytest.approx(want)


def test_verdict_predictor_is_stored(spark, cases, tmp_path):
    model = models.VerdictPredictor("naive_bayes", spec=SPEC).fit(cases)
    model.save(str(tmp_path / "v"))
    again = models.VerdictPredictor.load(spark, str(tmp_path / "v"))
    assert sorted(map(str, model.predict(cases).collect())) == sorted(map(str, again.predict(cases).collect()))


def test_subtype_scores_unlabelled_rows_as_unclassified(spark, cases):
    model = models.SubtypeClassifier("naive_bayes", SPEC).fit(cases)
    odd = cases.limit(4).withColumns({"case_type": F.lit("Other"), "sub_type": F.lit(None).cast("string")})
    scores = {r.metric: r.value for r in model.evaluate(odd).collect()}
    assert scores["accuracy"] == 1.0


def test_explanations_of_every_kind(spark, cases):
    few = {"svm": {"maxIter": 5}, "random_forest": {"numTrees": 5}, "naive_bayes": {}, "logistic": {"maxIter": 5}}
    for kind, options in few.items():
        model = models.TextClassifier("case_type", kind, SPEC, calibrate=False, options=options).fit(cases)
        weights = explain.model_weights(model)
        terms = {r.term for r in weights.select("term").distinct().collect()}
        assert terms <= set(model.feature_names()) and explain.feature_importance(weights, 3).count() == 3
        if kind in ("svm", "naive_bayes"):
            assert terms == set(model.feature_names())


def test_shap_counts_rows_without_terms(spark):
    features = spark.createDataFrame([(1, "a", 1.0)], "id long, term string, x double")
    weights = spark.createDataFrame([("c", "a", 2.0)], "class string, term string, w double")
    got = explain.linear_shap(features, weights, spark.range(4)).first()
    assert got.mean_abs_shap == 2.0 * (0.75 + 3 * 0.25) / 4
