"""Classifiers over the TF-IDF features, fitted by Spark ML.

Class lists, class counts and fitted parameters are the only things that reach
the driver; all of them are bounded by the number of classes or by the
vocabulary size of the feature spec. Rows are scored where they are: the vocabulary and
the model travel to them, no column is joined back, and so repeated or missing ids
do no harm. Models of one table share the row's tokens.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from contextlib import AbstractContextManager
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    LogisticRegressionModel,
    NaiveBayes,
    NaiveBayesModel,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import MaxAbsScaler, MaxAbsScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.functions.numbers import round_even
from casework.functions.text import FLAG_PATTERNS, legal_flags
from casework.operators import features as feat
from casework.operators.evaluate import classification_metrics, metrics_row
from casework.operators.sampling import stratified_kfold
from casework.rules.label_maps import LEVEL_2_CHILDREN
from casework.rules.labels import verdict_group
from casework.session import compute_once, cut_lineage, kept_for_now

FLAGS = tuple(FLAG_PATTERNS)
ERROR, UNCLASSIFIED, OTHER = "ERROR", "Unclassified", "OTHER"
LEAST_ROWS, LEAST_CHARS = 10, 10
THRESHOLD, TEXT_ONLY_THRESHOLD = 0.45, 0.35

_COLS = {"featuresCol": "features", "labelCol": "label_index"}
# Fixed value: where the solvers stop.
TOLERANCE = 1e-4
PARALLEL = 8  # one-against-rest fits at a time


def _logistic(n: int, options: dict):
    penalty = 1.0 / (options.pop("C", 1.0) * n)
    return LogisticRegression(
        **_COLS, weightCol="weight", regParam=penalty, standardization=False, family="multinomial",
        **{"maxIter": 1000, "tol": TOLERANCE, **options},
    )


def _svm(n: int, options: dict):
    penalty = 1.0 / (options.pop("C", 1.0) * n)
    single = LinearSVC(**_COLS, regParam=penalty, standardization=False, **{"maxIter": 2000, "tol": TOLERANCE, **options})
    return OneVsRest(classifier=single, weightCol="weight", parallelism=PARALLEL, **_COLS)


def _forest(n: int, options: dict):
    return RandomForestClassifier(**_COLS, weightCol="weight", **{"numTrees": 200, "seed": 42, **options})


def _bayes(n: int, options: dict):
    return NaiveBayes(**_COLS, **{"smoothing": 0.1, **options})


def _boosted(n: int, options: dict):
    single = GBTClassifier(**_COLS, **{"maxIter": 300, "maxDepth": 6, "stepSize": 0.1, "seed": 42, **options})
    return OneVsRest(classifier=single, parallelism=PARALLEL, **_COLS)


ESTIMATORS: dict[str, Callable] = {
    "logistic": _logistic,
    "svm": _svm,
    "random_forest": _forest,
    "naive_bayes": _bayes,
    "xgboost": _boosted,
}
LOADERS = {
    "logistic": LogisticRegressionModel,
    "svm": OneVsRestModel,
    "random_forest": RandomForestClassificationModel,
    "naive_bayes": NaiveBayesModel,
    "xgboost": OneVsRestModel,
}


def estimator(kind: str, rows: int, **options):
    if kind not in ESTIMATORS:
        raise ValueError(f"unknown model type {kind!r}; choose from {sorted(ESTIMATORS)}")
    return ESTIMATORS[kind](rows, dict(options))


def index_of(label: Column, classes: Sequence[str]) -> Column:
    """Position in the sorted class list, null for a class outside it."""
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), label) - 1
    return F.when(position >= 0, position.cast("double"))


def balanced_weights(df: DataFrame, counts: dict[str, int]) -> DataFrame:
    """Weight rows by total/(classes * rows of the class)."""
    total, k = sum(counts.values()), len(counts)
    weight = F.coalesce(*[F.when(F.col("label") == c, total / (k * n)) for c, n in counts.items()])
    return df.withColumn("weight", weight)


def softmax(margins: Column) -> Column:
    raised = F.transform(margins, lambda m: F.exp(m - F.array_max(margins)))
    return F.transform(raised, lambda e: e / F.aggregate(raised, F.lit(0.0), lambda s, x: s + x))


# Columns of a row on its way through the models; the caller's own columns travel in the first.
_ROW, _TEXT = "_row", "_text"


@dataclass
class Prepared:
    """Training rows whose terms are counted already, and the vocabulary to use."""

    rows: DataFrame
    vocab: DataFrame


@dataclass
class TextClassifier:
    """TF-IDF, legal flags, numeric and categorical columns and one estimator for one label column.

    Null texts count as empty, null numbers as 0; null and unknown categories set no slot.
    """

    label: str
    kind: str = "logistic"
    spec: feat.TfidfSpec = field(default_factory=feat.TfidfSpec)
    text: str = "case_text"
    row_id: str = "case_id"
    flags: bool = True
    calibrate: bool = True
    options: dict = field(default_factory=dict)
    extra: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    scale: bool = False

    model: Model | None = None
    vocab: DataFrame | None = None
    vocab_size: int = 0
    classes: list[str] = field(default_factory=list)
    sigmoids: list[tuple[float, float]] = field(default_factory=list)
    codes: dict[str, list[str]] = field(default_factory=dict)
    scaler: MaxAbsScalerModel | None = None
    lookup: feat.Lookup | None = None

    # -- features ---------------------------------------------------------

    def _numeric(self) -> tuple[str, ...]:
        return (*(FLAGS if self.flags else ()), *self.extra)

    def _inputs(self) -> tuple[str, ...]:
        """Columns that the features are made of, besides the text."""
        return tuple(dict.fromkeys((*self.extra, *self.categorical)))

    def _counted(self, df: DataFrame, *carry: str) -> DataFrame:
        """(id, carried columns, number and category columns, terms)."""
        if self.flags:
            df = df.withColumns(legal_flags(F.col(self.text)))
        columns = dict.fromkeys((*carry, *self._numeric(), *self.categorical))
        return feat.term_counts(df, self.row_id, self.text, self.spec, *columns)

    def _vector(self, df: DataFrame, terms: str = "terms") -> DataFrame:
        df = feat.row_vector(df, self.lookup, self.spec, self._numeric(), self.codes, terms)
        if self.scaler:
            df = self.scaler.transform(df).drop("features").withColumnRenamed("scaled", "features")
        return df

    def feature_names(self) -> list[str]:
        """A name for every slot of the vector. The vocabulary is of a size that the spec bounds."""
        terms = [r.term for r in self.vocab.orderBy("idx").select("term").collect()]
        return [*terms, *self._numeric(), *[f"{c}={v}" for c, values in self.codes.items() for v in values]]

    # -- fitting ----------------------------------------------------------

    def fit(self, df: DataFrame | Prepared) -> TextClassifier:
        if isinstance(df, Prepared):
            return self._fit_counted(df.rows, df.vocab, df.rows)
        with count_once(df.filter(F.col(self.label).isNotNull()), [self]) as counted:
            return self.fit(self._prepared(counted))

    def _prepared(self, counted: DataFrame) -> Prepared:
        """The rows of *counted* that have a label, and their vocabulary, kept as a written table."""
        rows = counted.filter(F.col(self.label).isNotNull()).withColumn("label", F.col(self.label).cast("string"))
        return Prepared(rows, cut_lineage(feat.vocabulary(rows, self.spec), "vocabulary"))

    def _fit_counted(self, counted: DataFrame, vocab: DataFrame, known: DataFrame) -> TextClassifier:
        """Fits on (label, terms ...) of the rows *known*, which have a label."""
        self.vocab, self.scaler = vocab, None
        self.lookup = feat.Lookup(vocab)
        self.vocab_size = self.lookup.size
        counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # one per class
        self.classes = sorted(counts)
        self.codes = {c: self._values(known, c) for c in self.categorical}
        inputs = dict.fromkeys((self.row_id, "label", *self._numeric(), *self.categorical, "terms"))
        rows = feat.known_terms(counted.select(*inputs), self.lookup, self.spec)
        # vectors are several times as large as what they are made of, and quickly made
        with kept_for_now(rows, "training") as rows:
            rows = self._vector(rows).select(self.row_id, "label", "features")
            rows = rows.withColumn("label_index", index_of(F.col("label"), self.classes))
            rows = balanced_weights(rows, counts)
            if self.scale:
                self.scaler = MaxAbsScaler(inputCol="features", outputCol="scaled").fit(rows)
                rows = self.scaler.transform(rows).drop("features").withColumnRenamed("scaled", "features")
            self._fit_rows(rows, sum(counts.values()))
        return self

    @staticmethod
    def _values(df: DataFrame, column: str) -> list[str]:
        """The categories in order: one row for each reaches the driver, as for classes."""
        found = df.select(F.col(column).cast("string").alias("v")).where("v IS NOT NULL").distinct()
        return sorted(r.v for r in found.collect())

    def _fit_rows(self, rows: DataFrame, n: int) -> None:
        self.model = estimator(self.kind, n, **self.options).fit(rows)
        self.sigmoids = []
        if self.kind == "svm" and self.calibrate:
            self.sigmoids = self._calibrate(rows, n)

    def _calibrate(self, rows: DataFrame, n: int, folds: int = 3) -> list[tuple[float, float]]:
        """Slope and offset per class of a sigmoid over out-of-fold margins."""
        rows = stratified_kfold(rows, "label", self.row_id, folds)
        parts = []
        for f in range(folds):
            held = estimator(self.kind, n, **self.options).fit(rows.filter(F.col("fold") != f))
            parts.append(held.transform(rows.filter(F.col("fold") == f)))
        scored = parts[0]
        for part in parts[1:]:
            scored = scored.unionByName(part)
        margins = cut_lineage(
            scored.select("label_index", vector_to_array("rawPrediction").alias("margins")), "margins"
        )
        fitted = []
        for i in range(len(self.classes)):
            one = margins.select(
                (F.col("label_index") == i).cast("double").alias("label_index"),
                array_to_vector(F.array(F.get("margins", F.lit(i)))).alias("features"),
            )
            line = LogisticRegression(**_COLS, maxIter=100).fit(one)
            fitted.append((float(line.coefficients[0]), float(line.intercept)))
        return fitted

    # -- scoring ----------------------------------------------------------

    def _probabilities(self, scored: DataFrame) -> Column:
        if "probability" in scored.columns:
            return vector_to_array("probability")
        margins = vector_to_array("rawPrediction")
        if not self.sigmoids:
            return softmax(margins)
        each = F.array(
            *[1 / (1 + F.exp(-(F.get(margins, F.lit(i)) * a + b))) for i, (a, b) in enumerate(self.sigmoids)]
        )
        total = F.aggregate(each, F.lit(0.0), lambda s, x: s + x)
        return F.when(total > 0, F.transform(each, lambda p: p / total)).otherwise(
            F.transform(each, lambda p: F.lit(1.0 / max(1, len(self.classes))))
        )

    def _scored(self, packed: DataFrame, terms: str = "terms") -> DataFrame:
        """Packed rows with ``probabilities``, ``predicted`` and ``confidence``."""
        kept = packed.columns
        scored = self.model.transform(self._vector(packed, terms))
        scored = compute_once(scored, {"probabilities": self._probabilities(scored)})
        best = F.array_max("probabilities")
        names = F.array(*[F.lit(c) for c in self.classes])
        predicted = F.element_at(names, F.array_position("probabilities", best).cast("int"))
        return scored.select(*kept, "probabilities", predicted.alias("predicted"), best.alias("confidence"))

    def score(self, df: DataFrame, *carry: str) -> DataFrame:
        """(id, carried columns, probabilities, predicted, confidence)."""
        scored = self._scored(pack(df, [self]))
        return scored.select(*[f"{_ROW}.{c}" for c in (self.row_id, *carry)], "probabilities", "predicted", "confidence")

    def predict(self, df: DataFrame, out: str, confidence: str | None = None) -> DataFrame:
        """*df* with the predicted label (and confidence) beside it."""
        return predict_all(df, {out: self}, {out: confidence} if confidence else {})

    def evaluate(self, df: DataFrame) -> DataFrame:
        """(metric, value) on labelled rows."""
        known = df.filter(F.col(self.label).isNotNull())
        return classification_metrics(self.score(known, self.label), self.label, "predicted")

    def cross_validate(self, df: DataFrame, k: int = 5, metric: str = "f1_macro") -> dict[str, object]:
        """Mean, population deviation and the k scores of *metric*.

        Texts are tokenised once.
        """
        folds = stratified_kfold(df, self.label, self.row_id, k)
        folds = folds.withColumn("label", F.col(self.label).cast("string"))
        scores = []
        with kept_for_now(self._counted(folds, "label", "fold"), "folds") as counted:
            known = counted.filter(F.col("label").isNotNull())
            for f in range(k):
                model = replace(self, model=None, vocab=None, classes=[], sigmoids=[], codes={}, scaler=None, lookup=None)
                rows = known.filter(F.col("fold") != f)
                model.fit(Prepared(rows, cut_lineage(feat.vocabulary(rows, self.spec), "vocabulary")))
                held = model._scored(counted.filter(F.col("fold") == f))
                scores.append(metrics_row(held, "label", "predicted").first()[metric])
        mean = sum(scores) / k
        return {"mean": mean, "std": (sum((s - mean) ** 2 for s in scores) / k) ** 0.5, "scores": scores}

    # -- storage ----------------------------------------------------------

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        if self.scaler:
            self.scaler.write().overwrite().save(f"{path}/scaler")
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocabulary")
        manifest = {
            "label": self.label, "kind": self.kind, "spec": asdict(self.spec), "text": self.text,
            "row_id": self.row_id, "flags": self.flags, "calibrate": self.calibrate,
            "options": self.options, "extra": list(self.extra), "vocab_size": self.vocab_size,
            "classes": self.classes, "sigmoids": self.sigmoids, "categorical": list(self.categorical),
            "codes": self.codes, "scale": self.scale,
        }
        write_manifest(self.vocab.sparkSession, path, manifest)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextClassifier:
        m = read_manifest(spark, path)
        spec = {k: tuple(v) if isinstance(v, list) else v for k, v in m.pop("spec").items()}
        sigmoids = [tuple(s) for s in m.pop("sigmoids")]
        for name in ("extra", "categorical"):
            m[name] = tuple(m[name])
        out = cls(**m, spec=feat.TfidfSpec(**spec), sigmoids=sigmoids)
        out.model = LOADERS[out.kind].load(f"{path}/model")
        out.vocab = spark.read.parquet(f"{path}/vocabulary")
        out.lookup = feat.Lookup(out.vocab)
        if out.scale:
            out.scaler = MaxAbsScalerModel.load(f"{path}/scaler")
        return out


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    line = spark.createDataFrame([(json.dumps(manifest),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()["value"])


def _tokenised(model: TextClassifier) -> tuple:
    """What decides a row's terms; models for which it is equal can share them."""
    return model.text, model.spec.ngrams, model.spec.stop_words, model.spec.token_pattern


def count_once(df: DataFrame, models: Sequence[TextClassifier], *carry: str) -> AbstractContextManager[DataFrame]:
    """The rows with their terms and what else *models* are fitted on, as a table that is written for a block.

    The models split texts alike, so texts are tokenised once, not once for each vocabulary and once more
    for each model's vectors. *carry* names further columns to keep.
    """
    first = models[0]
    if any((_tokenised(m), m.row_id) != (_tokenised(first), first.row_id) for m in models):
        raise ValueError("models that split texts differently cannot share their terms")
    columns = dict.fromkeys((*carry, *(c for m in models for c in (m.label, *m._inputs()))))
    columns.pop(first.row_id, None)
    if any(m.flags for m in models):
        df = df.withColumns(legal_flags(F.col(first.text)))
        columns |= dict.fromkeys(FLAGS)
    text = "_count_text"  # a label or category may be the text column itself
    df = df.withColumn(text, F.col(first.text))
    return kept_for_now(feat.term_counts(df, first.row_id, text, first.spec, *columns), "terms")


def fit_all(models: Sequence[TextClassifier], df: DataFrame) -> None:
    """Fits every model on the rows that have its label; models that split texts alike share the terms."""
    groups: dict[tuple, list[TextClassifier]] = {}
    for model in models:
        groups.setdefault((_tokenised(model), model.row_id), []).append(model)
    for some in groups.values():
        known = reduce(lambda a, b: a | b, [F.col(m.label).isNotNull() for m in some])
        with count_once(df.filter(known), some) as counted:
            for model in some:
                model.fit(model._prepared(counted))


def pack(df: DataFrame, models: Sequence[TextClassifier], keep: Column | None = None) -> DataFrame:
    """*df* as one column, with what *models* read beside it; ``terms`` are those of the first model.

    Rows where *keep* does not hold have no text.
    """
    first = models[0]
    columns = dict.fromkeys(c for m in models for c in m._inputs())
    text = F.col(first.text) if keep is None else F.when(keep, F.col(first.text))
    packed = df.select(F.struct(*df.columns).alias(_ROW), text.alias(_TEXT), *columns)
    if any(m.flags for m in models):
        packed = packed.withColumns(legal_flags(F.col(_TEXT)))
    return feat.with_row_terms(packed, _TEXT, first.spec).drop(_TEXT)


def predict_all(df: DataFrame, models: dict[str, TextClassifier], confidences: dict[str, str] | None = None, keep: Column | None = None) -> DataFrame:
    """*df* with the prediction of every model in the column of its name, in one scan.

    Models that split texts alike share the row's terms, whatever their vocabularies are.
    *confidences* names columns for confidences. Rows where *keep* does not hold are scored as empty texts.
    """
    groups: dict[tuple, list[str]] = {}
    for name, model in models.items():
        groups.setdefault(_tokenised(model), []).append(name)
    confidences = confidences or {}
    for names in groups.values():
        scored = pack(df, [models[n] for n in names], keep)
        added: list[Column] = []
        for i, name in enumerate(names):
            scored = models[name]._scored(scored)
            scored = scored.withColumnsRenamed({"predicted": f"_predicted{i}", "confidence": f"_confidence{i}"}).drop("probabilities")
            added.append(F.col(f"_predicted{i}").alias(name))
            if name in confidences:
                added.append(F.col(f"_confidence{i}").alias(confidences[name]))
        new = {*names, *(confidences[n] for n in names if n in confidences)}
        df = scored.select(*[F.col(f"{_ROW}.{c}").alias(c) for c in df.columns if c not in new], *added)
    return df


def case_classifier(kind: str = "svm", **options) -> TextClassifier:
    return TextClassifier("case_type", kind, **options)


# Label column, feature preset, numeric (see ``features.numeric_features``) and
# categorical columns of the single-table models.
MODEL_PRESETS = {
    "outcome": ("four_class_label", "outcome", (), ("case_type", "sub_type", "court", "year")),
    "outcome_text": ("four_class_label", "outcome_text", (), ()),
    "case_type": ("case_type_mapped", "case_type", (), ()),
    "sub_type": ("sub_type_mapped", "sub_type_flat", (), ()),
}


def preset_classifier(name: str, kind: str = "logistic", spec: feat.TfidfSpec | None = None, **options) -> TextClassifier:
    """One of the named models. Put ``numeric_features`` on the rows first where it has numeric columns."""
    label, preset, extra, categorical = MODEL_PRESETS[name]
    spec = spec or feat.PRESETS[preset]
    return TextClassifier(label, kind, spec, flags=False, extra=extra, categorical=categorical, **options)


class VerdictPredictor:
    """Verdict groups from the text; rows with an unknown group neither train nor score."""

    GROUP = "verdict_group"

    def __init__(self, kind: str = "logistic", **options):
        self.inner = TextClassifier(self.GROUP, kind, **options)

    def _known(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.GROUP, verdict_group(F.col("verdict"))).filter(F.col(self.GROUP) != "unknown")

    def fit(self, df: DataFrame) -> VerdictPredictor:
        self.inner.fit(self._known(df))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return self.inner.predict(df, "predicted_verdict_group", "verdict_confidence")

    def evaluate(self, df: DataFrame) -> DataFrame:
        """(metric, value); all zero when no row has a known verdict."""
        known = self._known(df)
        if known.isEmpty():
            spark = df.sparkSession
            zeros = [(m, 0.0) for m in ("accuracy", "f1_macro", "f1_weighted")]
            return spark.createDataFrame(zeros, "metric string, value double")
        return self.inner.evaluate(known)

    def save(self, path: str) -> None:
        self.inner.save(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VerdictPredictor:
        out = cls()
        out.inner = TextClassifier.load(spark, path)
        return out


class SubtypeClassifier:
    """One classifier per case type that has enough rows and at least two sub-types.

    The loop is over types, of which there are at most a handful; each fit is a
    distributed job over that type's rows.
    """

    def __init__(self, kind: str = "logistic", spec: feat.TfidfSpec | None = None, **options):
        self.kind, self.spec, self.options = kind, spec or feat.PRESETS["sub_type"], options
        self.models: dict[str, TextClassifier] = {}
        self.failed: dict[str, str] = {}

    def fit(self, df: DataFrame) -> SubtypeClassifier:
        known = df.filter(F.col("sub_type").isNotNull())
        sizes = known.groupBy("case_type").agg(F.count("*").alias("n"), F.count_distinct("sub_type").alias("k"))
        fitted = sizes.filter((F.col("n") >= LEAST_ROWS) & (F.col("k") >= 2)).orderBy("case_type").collect()
        if not fitted:
            return self
        with count_once(known, [TextClassifier("sub_type", self.kind, self.spec, **self.options)], "case_type") as counted:
            for row in fitted:
                model = TextClassifier("sub_type", self.kind, self.spec, **self.options)
                try:
                    self.models[row.case_type] = model.fit(model._prepared(counted.filter(F.col("case_type") == row.case_type)))
                except IllegalArgumentException as error:  # a type that the estimator refuses is left out, and named
                    self.failed[row.case_type] = str(error)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """Route on predicted_case_type when present, else on case_type; other types are Unclassified."""
        route = "predicted_case_type" if "predicted_case_type" in df.columns else "case_type"
        names = ("predicted_sub_type", "sub_type_confidence")
        parts = [
            model.predict(df.filter(F.col(route) == case_type), *names) for case_type, model in self.models.items()
        ]
        routed = F.coalesce(F.col(route).isin(*self.models), F.lit(False)) if self.models else F.lit(False)
        rest = df.filter(~routed).withColumns({names[0]: F.lit(UNCLASSIFIED), names[1]: F.lit(0.0)})
        for part in parts:
            rest = rest.unionByName(part.select(*rest.columns))
        return rest

    def evaluate(self, df: DataFrame) -> DataFrame:
        """Scores on the true type's model; rows without a sub-type count as Unclassified."""
        scored = self.predict(df.drop("predicted_case_type"))
        scored = scored.withColumn("sub_type", F.coalesce("sub_type", F.lit(UNCLASSIFIED)))
        return classification_metrics(scored, "sub_type", "predicted_sub_type")

    def save(self, path: str) -> None:
        for i, (case_type, model) in enumerate(sorted(self.models.items())):
            model.save(f"{path}/{i}")
        write_manifest(SparkSession.active(), path, {"kind": self.kind, "types": sorted(self.models)})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SubtypeClassifier:
        m = read_manifest(spark, path)
        out = cls(m["kind"])
        out.models = {t: TextClassifier.load(spark, f"{path}/{i}") for i, t in enumerate(m["types"])}
        return out


# -- three-level hierarchy ----------------------------------------------------

LEVELS = {"l0": "l0_label", "l1": "l1_label", "l2_civil": "l2_civil", "l2_criminal": "l2_criminal"}


def gate_hierarchy(df: DataFrame, threshold: float = THRESHOLD, agree: bool = True) -> DataFrame:
    """Turn the four levels' predictions and confidences into one consistent answer.

    Reads ``<level>_pred`` and ``<level>_conf``. With *agree* the first two levels
    must name the same branch and the third a child of it; without, the later
    variant routes by the second level and checks nothing.
    """
    l0, l1 = F.col("l0_pred"), F.col("l1_pred")
    sure0 = F.col("l0_conf") >= threshold
    routed = sure0 & l0.isin(*LEVEL_2_CHILDREN)
    sure1 = F.col("l1_conf") >= threshold
    branch = l0 if agree else l1
    civil = branch == "CIVIL"
    l2 = F.when(civil, F.col("l2_civil_pred")).otherwise(F.col("l2_criminal_pred"))
    conf2 = F.when(civil, F.col("l2_civil_conf")).otherwise(F.col("l2_criminal_conf"))
    child = F.when(civil, l2.isin(*LEVEL_2_CHILDREN["CIVIL"])).otherwise(l2.isin(*LEVEL_2_CHILDREN["CRIMINAL"]))
    first = F.when(civil, LEVEL_2_CHILDREN["CIVIL"][0]).otherwise(LEVEL_2_CHILDREN["CRIMINAL"][0])
    kept = F.when(child, l2).otherwise(first) if agree else l2
    valid = (l1 == l0) & (~sure1 | child) if agree else F.lit(True)
    return df.select(
        "*",
        F.when(sure0, l0).otherwise(OTHER).alias("l0_predicted"),
        round_even(F.col("l0_conf"), 4).alias("l0_confidence"),
        F.when(routed, l1).alias("l1_predicted"),
        F.when(routed, round_even(F.col("l1_conf"), 4)).alias("l1_confidence"),
        F.when(routed & ~sure1, OTHER)
        .when(routed & (conf2 < threshold), OTHER)
        .when(routed, kept)
        .alias("l2_predicted"),
        F.when(routed & sure1, round_even(conf2, 4)).alias("l2_confidence"),
        (~sure0 | (routed & (~sure1 | (conf2 < threshold)))).alias("low_conf_flag"),
        (~routed | valid).alias("hierarchy_valid"),
    )


class HierarchyClassifier:
    """Four classifiers, each scoring every row in one scan; ``gate_hierarchy`` decides."""

    def __init__(
        self, kind: str = "logistic", spec: feat.TfidfSpec | None = None, threshold: float = THRESHOLD,
        extra: tuple[str, ...] = (), categorical: tuple[str, ...] = (), **options,
    ):
        spec = spec or feat.PRESETS["hierarchy"]
        self.threshold = threshold
        common = {"flags": False, "extra": extra, "categorical": categorical, **options}
        self.models = {level: TextClassifier(label, kind, spec, **common) for level, label in LEVELS.items()}

    def fit(self, df: DataFrame) -> HierarchyClassifier:
        fit_all(list(self.models.values()), df.withColumns({label: F.when(F.col(label) != OTHER, F.col(label)) for label in LEVELS.values()}))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        models = {f"{level}_pred": model for level, model in self.models.items()}
        scored = predict_all(df, models, {f"{level}_pred": f"{level}_conf" for level in LEVELS})
        raw = [f"{level}_{kind}" for level in LEVELS for kind in ("pred", "conf")]
        return gate_hierarchy(scored, self.threshold).drop(*raw)

    def save(self, path: str) -> None:
        for level, model in self.models.items():
            model.save(f"{path}/{level}")
        write_manifest(SparkSession.active(), path, {"threshold": self.threshold})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> HierarchyClassifier:
        out = cls(threshold=read_manifest(spark, path)["threshold"])
        out.models = {level: TextClassifier.load(spark, f"{path}/{level}") for level in LEVELS}
        return out


# -- serving ------------------------------------------------------------------

TARGETS = ("case_type", "sub_type", "verdict")


def batch_predict(df: DataFrame, models: dict[str, TextClassifier]) -> DataFrame:
    """(id, case_type, sub_type, verdict, error) for rows (id, case_text, court, num_citations).

    Texts under ten characters get ERROR labels and a message; all other rows are scored
    for every target in one scan. Absent or null courts and citation numbers get defaults
    where a model reads them.
    """
    usable = F.coalesce(F.length("case_text") >= LEAST_CHARS, F.lit(False))
    rows = df
    for name, default in (("court", F.lit("Unknown Court")), ("num_citations", F.lit(0))):
        if any(name in m._inputs() for m in models.values()):
            rows = rows.withColumn(name, F.coalesce(F.col(name), default) if name in df.columns else default)
    asked = {t: models[t] for t in TARGETS if t in models}
    scored = predict_all(rows, {f"_{t}": m for t, m in asked.items()}, keep=usable) if asked else rows
    label = lambda t: F.when(usable, F.col(f"_{t}") if t in asked else F.lit("UNKNOWN")).otherwise(ERROR).alias(t)
    error = F.when(~usable, "case_text is too short").alias("error")
    return scored.select("id", *[label(t) for t in TARGETS], error)


def compare_models(
    train: DataFrame, val: DataFrame, label: str, kinds: Sequence[str], options: dict[str, dict] | None = None, **common
) -> DataFrame:
    """(model, val_f1_macro, val_accuracy, train_seconds), best first. One fit per model type."""
    import time

    rows = []
    for kind in kinds:
        start = time.time()
        model = TextClassifier(label, kind, options=(options or {}).get(kind, {}), **common).fit(train)
        seconds = time.time() - start
        score = metrics_row(model.score(val, label), label, "predicted").first()
        rows.append((kind, float(score["f1_macro"]), float(score["accuracy"]), seconds))
    out = train.sparkSession.createDataFrame(
        rows, "model string, val_f1_macro double, val_accuracy double, train_seconds double"
    )
    return out.orderBy(F.desc("val_f1_macro"), "model")


