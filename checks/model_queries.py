"""Registered queries: metrics, features, splits, models, retrieval, storage and resume."""

from __future__ import annotations

from pyspark.sql import functions as F

from casework.operators import cells, evaluate, explain, models, retrieve, sampling
from casework.operators import features as feat
from casework.operators.filters import filter_cases
from casework.operators.oversample import smote
from casework.plans.case_table import label_cases
from casework.rules import labels
from casework.session import cut_lineage, scratch_path, spread
from casework.sources import tables
from casework.streaming.resume import Ledger, resume_batch, stream_cases
from checks import bindings as b
from checks import rule_sql as rs
from checks.bindings import collapse, lit, r_even
from checks.registry import SQL, register

P, CASES = b.PREDICTIONS, b.CASES

# -- metrics ----------------------------------------------------------------------

_PER_LABEL = """ls AS (SELECT "true" AS label FROM p UNION SELECT pred FROM p),
s AS (SELECT label, (SELECT count(*) FROM p WHERE "true" = label) AS support, (SELECT count(*) FROM p WHERE pred = label) AS predicted,
  (SELECT count(*) FROM p WHERE "true" = label AND pred = label) AS hits FROM ls),
m AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
  CASE WHEN support + predicted > 0 THEN 2 * hits / (support + predicted) ELSE 0 END AS f1 FROM s),
a AS (SELECT CAST(sum(support) AS BIGINT) AS n, sum(hits) / sum(support) AS acc, avg(f1) AS fm, sum(f1 * support) / sum(support) AS fw, avg(precision) AS pm,
  avg(recall) AS rm, sum(precision * support) / sum(support) AS pw, sum(recall * support) / sum(support) AS rw,
  sum(CAST(support AS DOUBLE) * predicted) / (sum(support) * sum(support)) AS ch, count(*) FILTER (support > 0) AS k FROM m)"""
_PER = f"{P}, {_PER_LABEL}"
_METRICS = {
    "accuracy": "acc", "f1_macro": "fm", "f1_weighted": "fw", "f1_micro": "acc", "precision_macro": "pm",
    "recall_macro": "rm", "cohen_kappa": "(acc - ch) / (1 - ch)", "support_total": "n", "num_classes": "k",
}
_METRIC_ROWS = " UNION ALL ".join(f"SELECT '{n}' AS metric, {r_even(e, 6)} AS value FROM a" for n, e in _METRICS.items())


@register("classification_metrics", f"WITH {_PER} {_METRIC_ROWS}")
def _(spark, sf):
    return evaluate.classification_metrics(b.predictions(spark, sf), "true", "pred")


_GRID = """ls AS (SELECT "true" AS l FROM p UNION SELECT pred FROM p),
g AS (SELECT x.l AS "true", y.l AS pred, (SELECT count(*) FROM p WHERE p."true" = x.l AND p.pred = y.l) AS n FROM ls x, ls y)"""


@register("confusion", f"WITH {P}, {_GRID} SELECT * FROM g")
def _(spark, sf):
    return evaluate.confusion(b.predictions(spark, sf), "true", "pred")


@register(
    "confusion_normalised",
    f"""WITH {P}, {_GRID}, t AS (SELECT *, sum(n) OVER (PARTITION BY "true") AS tot FROM g)
SELECT "true", pred, n, CASE WHEN tot > 0 THEN {r_even('n / tot', 6)} ELSE 0.0 END AS share FROM t""",
)
def _(spark, sf):
    return evaluate.confusion(b.predictions(spark, sf), "true", "pred", normalise=True)


@register(
    "per_class_report",
    f"""WITH {_PER} SELECT label, {r_even('precision', 4)} AS precision, {r_even('recall', 4)} AS recall, {r_even('f1', 4)} AS f1, support FROM m
UNION ALL SELECT 'accuracy', {r_even('acc', 4)}, {r_even('acc', 4)}, {r_even('acc', 4)}, n FROM a
UNION ALL SELECT 'macro avg', {r_even('pm', 4)}, {r_even('rm', 4)}, {r_even('fm', 4)}, n FROM a
UNION ALL SELECT 'weighted avg', {r_even('pw', 4)}, {r_even('rw', 4)}, {r_even('fw', 4)}, n FROM a""",
)
def _(spark, sf):
    return evaluate.per_class_report(b.predictions(spark, sf), "true", "pred")


@register(
    "top_k_accuracy",
    f"""WITH s AS (SELECT doc_id, quality, toxic, l, (doc_id * 7 + l * 13) % 10 AS sc FROM labels, range(4) t(l)),
r AS (SELECT doc_id, quality + toxic AS y, l, row_number() OVER (PARTITION BY doc_id ORDER BY sc DESC, CAST(l AS VARCHAR)) AS rk FROM s)
SELECT {r_even('avg(hit)', 6)} AS top_k_accuracy FROM (SELECT doc_id, max(CAST(y = l AND rk <= 2 AS INT)) AS hit FROM r GROUP BY 1)""",
)
def _(spark, sf):
    df = b.table(spark, sf, "labels")
    scores = F.map_from_arrays(
        F.array(*[F.lit(str(i)) for i in range(4)]),
        F.array(*[((F.col("doc_id") * 7 + i * 13) % 10).cast("double") for i in range(4)]),
    )
    df = df.withColumns({"y": (F.col("quality") + F.col("toxic")).cast("string"), "scores": scores})
    return evaluate.top_k_accuracy(df, "y", "scores", 2)


@register(
    "evaluate_all",
    f"""WITH {P}, q AS (SELECT doc_id, CAST(quality AS VARCHAR) AS t, CAST(CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS VARCHAR) AS g FROM labels)
SELECT 'quality' AS target, 'accuracy' AS metric, {r_even('avg(CAST(t = g AS INT))', 6)} AS value FROM q
UNION ALL SELECT 'toxic', 'accuracy', {r_even('avg(CAST(toxic = CASE WHEN doc_id % 7 = 0 THEN 1 - toxic ELSE toxic END AS INT))', 6)} FROM labels""",
)
def _(spark, sf):
    return _every_metric(spark, sf).filter("metric = 'accuracy'")


def _every_metric(spark, sf):
    df = b.table(spark, sf, "labels").withColumns(
        {
            "q": F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")),
            "t": F.when(F.col("doc_id") % 7 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")),
        }
    )
    return evaluate.evaluate_all(df, {"quality": ("quality", "q"), "toxic": ("toxic", "t")})


def _target_sql(name: str, step: int) -> str:
    return f"""SELECT '{name}' AS target, * FROM (WITH p AS (SELECT {name} AS "true", CASE WHEN doc_id % {step} = 0 THEN 1 - {name} ELSE {name} END AS pred
  FROM labels WHERE {name} IS NOT NULL), {_PER_LABEL} {_METRIC_ROWS})"""


@register("evaluate_all_metrics", f"{_target_sql('quality', 5)} UNION ALL {_target_sql('toxic', 7)}")
def _(spark, sf):
    return _every_metric(spark, sf)


# -- features ----------------------------------------------------------------------


_ONE_WORD = """pos AS (SELECT k, unnest(ws) AS t, generate_subscripts(ws, 1) AS i FROM tok),
one AS (SELECT k, t, lead(t) OVER w AS t2, lead(t, 2) OVER w AS t3 FROM pos WINDOW w AS (PARTITION BY k ORDER BY i))"""


def tfidf_sql(source: str, key: str, text: str, pattern: str, high: int, size: int, min_df: int, max_share: float) -> str:
    """CTEs up to ``w``: (key, term, x) with unit norm, smoothed idf, sublinear counts."""
    grams = "SELECT k, t AS term FROM one"
    if high > 1:
        grams += " UNION ALL SELECT k, t || ' ' || t2 FROM one WHERE t2 IS NOT NULL"
    return f"""tok AS MATERIALIZED (SELECT {key} AS k, regexp_extract_all(strip_accents(lower({text})), {lit(pattern)}) AS ws FROM {source}),
{_ONE_WORD}, grams AS ({grams}), tf AS MATERIALIZED (SELECT k, term, count(*) AS tf FROM grams GROUP BY 1, 2),
docs AS (SELECT count(*) AS n FROM tok),
voc AS MATERIALIZED (SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY 1), docs
  WHERE df >= {min_df} AND df <= {max_share} * n ORDER BY total DESC, term LIMIT {size}),
x AS (SELECT k, term, (ln(tf) + 1) * idf AS x FROM tf JOIN voc USING (term)),
w AS MATERIALIZED (SELECT k, term, x / sqrt(sum(x * x) OVER (PARTITION BY k)) AS x FROM x)"""


_SPEC = feat.TfidfSpec((1, 2), 2000, 2, 0.9)
_TFIDF = tfidf_sql("documents", "doc_id", "text", feat.WORDS_AND_APOSTROPHES, 2, 2000, 2, 0.9)


@register("tfidf", f"WITH {_TFIDF} SELECT k AS doc_id, term, {r_even('x', 6)} AS tfidf FROM w")
def _(spark, sf):
    return feat.tfidf(b.documents(spark, sf), "doc_id", "text", _SPEC)


_STOP = ("the", "and", "of", "to", "in")
_WORDS = "list_filter(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]{2,}'), lambda t: t NOT IN ('the', 'and', 'of', 'to', 'in'))"


@register(
    "tfidf_vocabulary",
    f"""WITH tok AS (SELECT doc_id AS k, {_WORDS} AS ws FROM documents), {_ONE_WORD},
grams AS (SELECT k, t AS term FROM one UNION ALL SELECT k, t || ' ' || t2 FROM one WHERE t2 IS NOT NULL
  UNION ALL SELECT k, t || ' ' || t2 || ' ' || t3 FROM one WHERE t3 IS NOT NULL),
st AS (SELECT term, sum(tf) AS total, count(*) AS df FROM (SELECT k, term, count(*) AS tf FROM grams GROUP BY 1, 2) GROUP BY 1),
kept AS (SELECT * FROM st WHERE df >= 3 AND df <= 0.5 * (SELECT count(*) FROM documents) ORDER BY total DESC, term LIMIT 500)
SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INT) AS idx, df, {r_even('ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1', 6)} AS idf FROM kept""",
)
def _(spark, sf):
    spec = feat.TfidfSpec((1, 3), 500, 3, 0.5, stop_words=_STOP, token_pattern=feat.WORDS_OF_TWO)
    vocab = feat.vocabulary(cut_lineage(feat.term_counts(b.documents(spark, sf), "doc_id", "text", spec), "words"), spec)
    return vocab.withColumn("idf", feat.round_even(F.col("idf"), 6))


@register(
    "ordinal_encode",
    f"""WITH {b.ORDER_CASES}, t AS (SELECT DISTINCT court FROM oc WHERE CAST(case_id AS BIGINT) % 2 = 0 AND court NOT LIKE '%3'),
c AS (SELECT court, row_number() OVER (ORDER BY court) - 1 AS code FROM t)
SELECT case_id, CAST(coalesce(code, -1) AS INT) AS court_code FROM oc LEFT JOIN c USING (court)""",
)
def _(spark, sf):
    df = b.order_cases(spark, sf)
    train = df.filter((F.col("case_id").cast("bigint") % 2 == 0) & ~F.col("court").endswith("3"))
    return feat.ordinal_encode(df, "court", feat.categories(train, "court"), "court_code").select("case_id", "court_code")


@register(
    "one_hot",
    """WITH c AS (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_custkey % 2 = 0)
SELECT c_custkey, array_to_string(list_transform((SELECT list(s ORDER BY s) FROM c), lambda x: CAST(x = c_mktsegment AS INT)), '') AS hot FROM customer""",
)
def _(spark, sf):
    df = b.table(spark, sf, "customer")
    codes = feat.categories(df.filter("c_custkey % 2 = 0"), "c_mktsegment")
    hot = feat.one_hot(df, "c_mktsegment", codes, "hot")
    return hot.select("c_custkey", F.array_join(F.transform("hot", lambda x: x.cast("string")), "").alias("hot"))


@register(
    "label_encode",
    f"""WITH {b.ORDER_CASES}, c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(verdict_mapped, 'unknown') AS v FROM oc))
SELECT case_id, CAST(code AS INT) AS code, v AS label FROM oc JOIN c ON coalesce(verdict_mapped, 'unknown') = v""",
)
def _(spark, sf):
    df = b.order_cases(spark, sf)
    codes = feat.categories(df, "verdict_mapped")
    coded = feat.ordinal_encode(df, "verdict_mapped", codes, "code").select("case_id", "code")
    return feat.label_decode(coded, "code", codes, "label").select("case_id", "code", "label")


@register(
    "numeric_features",
    f"""WITH {rs.LABELLED} SELECT case_id, CAST(num_citations AS DOUBLE) AS f_citations, coalesce(try_cast(year AS DOUBLE), 0.0) AS f_year,
  CAST(length(case_text) AS DOUBLE) AS f_text_length FROM labelled""",
)
def _(spark, sf):
    return feat.numeric_features(b.cited(spark, sf)).select("case_id", "f_citations", "f_year", "f_text_length")


@register(
    "scale",
    f"""WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS sd, max(abs(l_quantity)) AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, {r_even('(l_quantity - m) / sd', 6)} AS z, {r_even('l_quantity / sd', 6)} AS v, {r_even('l_quantity / t', 6)} AS a FROM lineitem, s""",
)
def _(spark, sf):
    df = b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    for how, out in (("zscore", "z"), ("variance", "v"), ("maxabs", "a")):
        df = feat.scale(df, "l_quantity", how, out)
    return df.select("l_orderkey", "l_linenumber", *[feat.round_even(F.col(c), 6).alias(c) for c in "zva"])


@register("assemble_features")
def _(spark, sf):
    spec = feat.TfidfSpec((1, 1), 300, 2)
    df = feat.numeric_features(b.cited(spark, sf))
    counted = cut_lineage(feat.term_counts(df, "case_id", "case_text", spec, "f_citations", "f_text_length"), "words")
    weighed = feat.weigh(counted, feat.vocabulary(counted, spec), "case_id", spec, "f_citations", "f_text_length")
    return feat.feature_vector(weighed, 300, ("f_citations", "f_text_length")).select("case_id", F.col("features").cast("string"))


# -- splits -------------------------------------------------------------------------

_RANK = "row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42:' || o_orderkey), o_orderkey)"


@register(
    "stratified_split",
    f"""WITH r AS (SELECT o_orderkey, o_orderpriority, {_RANK} AS rk, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
t AS (SELECT *, round_even(CAST(n AS DOUBLE) * 0.15e0, 0) AS nt FROM r WHERE n >= 2), v AS (SELECT *, round_even((n - nt) * (0.15e0 / (1 - 0.15e0)), 0) AS nv FROM t)
SELECT o_orderkey, o_orderpriority, CASE WHEN rk <= nt THEN 'test' WHEN rk <= nt + nv THEN 'val' ELSE 'train' END AS split FROM v""",
)
def _(spark, sf):
    df = b.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.stratified_split(df, "o_orderpriority", "o_orderkey")


@register(
    "stratified_kfold",
    f"SELECT o_orderkey, CAST(({_RANK} - 1) % 5 AS INT) AS fold FROM orders",
)
def _(spark, sf):
    df = b.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.stratified_kfold(df, "o_orderpriority", "o_orderkey").select("o_orderkey", "fold")


@register("sample_rows", "SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 50")
def _(spark, sf):
    return sampling.sample_rows(b.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 50)


@register(
    "sample_per_group",
    "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('42:' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r = 1",
)
def _(spark, sf):
    df = b.table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return sampling.sample_per_group(df, "o_custkey", "o_orderkey")


@register(
    "split_coverage",
    f"""WITH r AS (SELECT l_shipdate, l_partkey % 900 AS label, CASE WHEN l_orderkey % 6 = 0 THEN 'test' ELSE 'train' END AS split FROM lineitem),
c AS (SELECT label, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test FROM r GROUP BY 1)
SELECT *, CASE WHEN train = 0 THEN 'train' WHEN test = 0 THEN 'test' ELSE '' END AS missing_from FROM c""",
)
def _(spark, sf):
    df = b.table(spark, sf, "lineitem")
    split = F.when(F.col("l_orderkey") % 6 == 0, "test").otherwise("train")
    return evaluate.split_coverage(df.select((F.col("l_partkey") % 900).alias("label"), split.alias("split")), "label")


@register("smote")
def _(spark, sf):
    df = b.table(spark, sf, "embeddings")
    made = smote(df, "label", "vec_id", "embedding", 5)
    return made.groupBy("label").agg(F.count("*").alias("n"), F.count("parent").alias("made"))


# -- explanation ---------------------------------------------------------------------

_WEIGHTS = "wt AS (SELECT c, term, CAST('0x' || left(md5(c || ':' || term), 6) AS INT) / 16777216e0 - 0.5 AS weight FROM voc, range(3) t(c))"


def _weights(vocab):
    df = vocab.select("term", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("class"))
    digest = F.substring(F.md5(F.concat_ws(":", F.col("class").cast("string"), "term")), 1, 6)
    return df.select(F.col("class").cast("string").alias("class"), "term", (F.conv(digest, 16, 10).cast("double") / 16777216.0 - 0.5).alias("w"))


_SMALL = feat.TfidfSpec((1, 1), 400, 2, 0.9)
_SMALL_SQL = tfidf_sql("documents", "doc_id", "text", feat.WORDS_AND_APOSTROPHES, 1, 400, 2, 0.9)


@register(
    "feature_importance",
    f"""WITH {_SMALL_SQL}, {_WEIGHTS} SELECT term AS feature, {r_even('avg(abs(weight))', 6)} AS importance FROM wt GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""",
)
def _(spark, sf):
    vocab = feat.vocabulary(cut_lineage(feat.term_counts(b.documents(spark, sf), "doc_id", "text", _SMALL), "words"), _SMALL)
    return explain.feature_importance(_weights(vocab))


@register(
    "linear_shap",
    f"""WITH {_SMALL_SQL}, {_WEIGHTS}, nd AS (SELECT count(*) AS n FROM documents), mean AS (SELECT term, sum(x) / (SELECT n FROM nd) AS m FROM w GROUP BY 1),
full_ AS (SELECT d.k, term, coalesce(x, 0) AS x, m FROM (SELECT doc_id AS k FROM documents) d CROSS JOIN mean LEFT JOIN w USING (k, term)),
sp AS (SELECT term, avg(abs(x - m)) AS spread FROM full_ GROUP BY 1), sz AS (SELECT term, avg(abs(weight)) AS size FROM wt GROUP BY 1)
SELECT term AS feature, {r_even('size * spread', 8)} AS mean_abs_shap FROM sp JOIN sz USING (term) ORDER BY 2 DESC, 1 LIMIT 30""",
)
def _(spark, sf):
    counted = cut_lineage(feat.term_counts(b.documents(spark, sf), "doc_id", "text", _SMALL), "words")
    vocab = feat.vocabulary(counted, _SMALL)
    long = feat.long_weights(counted, vocab, "doc_id", _SMALL)
    return explain.linear_shap(long, _weights(vocab), b.documents(spark, sf))


# -- the hierarchy's gating -------------------------------------------------------------

_ONE = "(o_orderkey * {m} % 101) / 100e0"


def _pick_sql(m: int, *names: str) -> str:
    return f"[{', '.join(lit(n) for n in names)}][CAST(o_orderkey * {m} % {len(names)} AS INT) + 1]"


_LEVELS = {
    "l0": (3, 17, ("CIVIL", "CRIMINAL", "CONTRACT", "PROPERTY", "TORTS")),
    "l1": (5, 23, ("CIVIL", "CRIMINAL")),
    "l2_civil": (7, 29, ("APPELLATE", "TRIAL_ENFORCEMENT", "STRAY")),
    "l2_criminal": (11, 31, ("GENERAL_CRIMINAL", "SPECIFIC_OFFENSE", "STRAY")),
}
_LEVEL_SQL = "SELECT o_orderkey, " + ", ".join(
    f"{_pick_sql(m, *names)} AS {n}_pred, {_ONE.format(m=c)} AS {n}_conf" for n, (m, c, names) in _LEVELS.items()
) + " FROM orders"


@register(
    "gate_hierarchy",
    f"""WITH r AS ({_LEVEL_SQL}), q AS (SELECT *, l0_conf >= 0.45 AS s0, l1_conf >= 0.45 AS s1, l0_pred IN ('CIVIL', 'CRIMINAL') AS br,
  CASE WHEN l0_pred = 'CIVIL' THEN l2_civil_pred ELSE l2_criminal_pred END AS p2, CASE WHEN l0_pred = 'CIVIL' THEN l2_civil_conf ELSE l2_criminal_conf END AS c2 FROM r)
SELECT o_orderkey, CASE WHEN s0 THEN l0_pred ELSE 'OTHER' END AS l0_predicted,
  CASE WHEN s0 AND br THEN l1_pred END AS l1_predicted,
  CASE WHEN NOT s0 OR NOT br THEN NULL WHEN NOT s1 OR c2 < 0.45 THEN 'OTHER' WHEN p2 <> 'STRAY' THEN p2 WHEN l0_pred = 'CIVIL' THEN 'APPELLATE' ELSE 'GENERAL_CRIMINAL' END AS l2_predicted,
  NOT s0 OR (br AND (NOT s1 OR c2 < 0.45)) AS low_conf_flag, NOT (s0 AND br) OR (l1_pred = l0_pred AND (NOT s1 OR p2 <> 'STRAY')) AS hierarchy_valid FROM q""",
)
def _(spark, sf):
    o, key = b.table(spark, sf, "orders"), F.col("o_orderkey")
    columns = {}
    for n, (m, c, names) in _LEVELS.items():
        at = (key * m % len(names) + 1).cast("int")
        columns[f"{n}_pred"] = F.element_at(F.array(*[F.lit(x) for x in names]), at)
        columns[f"{n}_conf"] = (key * c % 101) / 100.0
    gated = models.gate_hierarchy(o.select("o_orderkey", *[c.alias(n) for n, c in columns.items()]))
    return gated.select("o_orderkey", "l0_predicted", "l1_predicted", "l2_predicted", "low_conf_flag", "hierarchy_valid")


# -- models -----------------------------------------------------------------------------


def _split(df, label):
    out = sampling.stratified_split(df, label, "case_id", 0.2, 0.0001)
    return out.filter("split <> 'test'"), out.filter("split = 'test'")


def _training(spark, sf):
    return b.labelled(spark, sf).select("case_id", "case_text", "case_type", "sub_type", "verdict", "court", "year", "num_citations")


@register("case_classifier")
def _(spark, sf):
    train, test = _split(_training(spark, sf), "case_type")
    return models.case_classifier("logistic").fit(train).evaluate(test)


@register("calibrated_svm")
def _(spark, sf):
    rows = b.documents(spark, sf).join(b.table(spark, sf, "labels"), "doc_id")
    rows = rows.select(F.col("doc_id").alias("case_id"), F.col("text").alias("case_text"), F.col("quality").cast("string").alias("label0"))
    model = models.TextClassifier("label0", "svm").fit(rows)
    scored = model.score(rows, "label0")
    total = F.aggregate("probabilities", F.lit(0.0), lambda s, x: s + x)
    return scored.select("case_id", "label0", "predicted", feat.round_even(total, 6).alias("probability_sum"))


@register("verdict_predictor")
def _(spark, sf):
    rows = _training(spark, sf).withColumn("g", labels.verdict_group(F.col("verdict")))
    train, test = _split(rows, "g")
    return models.VerdictPredictor().fit(train).evaluate(test)


@register("subtype_classifier")
def _(spark, sf):
    rows = _training(spark, sf)
    model = models.SubtypeClassifier().fit(rows)
    return model.predict(rows).select("case_id", "case_type", "predicted_sub_type", "sub_type_confidence")


@register("hierarchy_classifier")
def _(spark, sf):
    rows = _training(spark, sf)
    rows = rows.withColumns(labels.hierarchy_labels(F.col("sub_type")))
    model = models.HierarchyClassifier().fit(rows)
    return model.predict(rows.select("case_id", "case_text")).drop("case_text")


@register("batch_predict")
def _(spark, sf):
    rows = _training(spark, sf)
    fitted = {t: models.TextClassifier(t, "naive_bayes") for t in ("case_type", "verdict")}
    models.fit_all(list(fitted.values()), rows)
    asked = rows.select(F.col("case_id").alias("id"), F.when(F.col("case_id").cast("int") % 20 == 0, "short").otherwise(F.col("case_text")).alias("case_text"))
    return models.batch_predict(asked, fitted)


@register("cross_validate")
def _(spark, sf):
    result = models.TextClassifier("case_type", "naive_bayes").cross_validate(_training(spark, sf))
    rows = [(i, s) for i, s in enumerate(result["scores"])]
    return spark.createDataFrame(rows, "fold int, f1_macro double")


@register("compare_models")
def _(spark, sf):
    train, test = _split(_training(spark, sf), "case_type")
    return models.compare_models(train, test, "case_type", list(models.ESTIMATORS))


@register("model_explanation")
def _(spark, sf):
    model = models.case_classifier("logistic").fit(_training(spark, sf))
    return explain.feature_importance(explain.linear_weights(model))


@register("preset_classifier")
def _(spark, sf):
    rows = feat.numeric_features(labels.with_four_class(b.labelled(spark, sf), "verdict"))
    model = models.preset_classifier("outcome").fit(rows)
    return model.evaluate(rows)


@register("saved_model")
def _(spark, sf):
    rows = _training(spark, sf)
    model = models.TextClassifier("case_type", "naive_bayes").fit(rows)
    path = scratch_path(spark, "model")
    model.save(path)
    again = models.TextClassifier.load(spark, path)
    both = model.predict(rows, "first").join(again.predict(rows.select("case_id", "case_text"), "second").select("case_id", "second"), "case_id")
    return both.agg(F.count("*").alias("rows"), F.count_if(F.col("first") == F.col("second")).alias("equal"))


# -- retrieval -----------------------------------------------------------------------------

_CHUNK = f"""ck AS (SELECT case_id, string_split({collapse('case_text')}, ' ') AS w FROM cases),
ci AS (SELECT case_id, w, len(w) AS n, unnest(range(CASE WHEN len(w) <= 300 THEN 1 ELSE CAST(ceil((len(w) - 300) / 250.0) AS BIGINT) + 1 END)) AS i FROM ck),
chunks AS (SELECT case_id || '_chunk_' || lpad(CAST(i AS VARCHAR), 4, '0') AS chunk_id, case_id, CAST(i AS INT) AS chunk_index,
  array_to_string(list_slice(w, i * 250 + 1, i * 250 + 300), ' ') AS text, CAST(i * 250 AS INT) AS word_start, CAST(least(i * 250 + 300, n) AS INT) AS word_end FROM ci)"""


@register("chunk", f"WITH {CASES}, {_CHUNK} SELECT * FROM chunks")
def _(spark, sf):
    return retrieve.chunk(b.cases(spark, sf)).drop("metadata")


@register(
    "chunk_metadata",
    f"WITH {CASES}, {_CHUNK} SELECT chunk_id, court, year FROM chunks JOIN cases USING (case_id)",
)
def _(spark, sf):
    df = retrieve.chunk(b.cases(spark, sf))
    return df.select("chunk_id", F.col("metadata")["court"].alias("court"), F.col("metadata")["year"].alias("year"))


@register("embed")
def _(spark, sf):
    df = retrieve.embed(retrieve.chunk(b.cases(spark, sf)), dim=64)
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    return df.select("chunk_id", feat.round_even(F.sqrt(square), 4).alias("norm"))


_DOT = "list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), lambda z: z[1] * z[2]))"


def _vectors(spark, sf):
    return spread(b.table(spark, sf, "embeddings"), "vec_id").withColumnRenamed("vec_id", "id")


@register(
    "vector_search",
    f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round_even({_DOT} * 1e10, 0) / 1e10 AS score FROM embeddings q, embeddings v WHERE q.vec_id % 10 = 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, CAST(rank AS INT) AS rank, {r_even('score', 4)} AS score FROM r WHERE rank <= 5""",
)
def vector_search(spark, sf):
    vectors = _vectors(spark, sf)
    return retrieve.search(vectors.filter("id % 10 = 3"), vectors, 5).select("query_id", "id", "rank", "score")


def _ranked(hits):
    return hits.select("query_id", "id", "rank", feat.round_even(F.col("score"), 4).alias("score"))


@register("vector_search_tiled", SQL["vector_search"])
def _(spark, sf):
    """The shape for many queries: both sides in tiles."""
    vectors = _vectors(spark, sf)
    return _ranked(retrieve.top_k(vectors.filter("id % 10 = 3"), vectors, 5, broadcast_queries=0, tile_rows=64))


@register(
    "class_neighbours",
    f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round_even({_DOT} * 1e10, 0) / 1e10 AS score FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, CAST(rank AS INT) AS rank, {r_even('score', 4)} AS score FROM r WHERE rank <= 3""",
)
def _(spark, sf):
    """Every vector's neighbours of its own class; tiles of different classes never meet."""
    vectors = _vectors(spark, sf)
    return _ranked(retrieve.top_k(vectors, vectors, 3, same="label", skip="id", broadcast_queries=0, tile_rows=64))


@register("cell_search", SQL["vector_search"])
def _(spark, sf):
    """The search through a stored index of cells."""
    path = scratch_path(spark, "cells")
    vectors = _vectors(spark, sf)
    cells.write_cells(vectors, path, cells=32)
    return _ranked(cells.search_cells(vectors.filter("id % 10 = 3"), path, 5))


@register(
    "similar_cases",
    f"""WITH v0 AS (SELECT vec_id // 4 || '_chunk_' || lpad(CAST(vec_id % 4 AS VARCHAR), 4, '0') AS id, CAST(vec_id // 4 AS VARCHAR) AS case_id, embedding FROM embeddings),
s AS (SELECT q.case_id AS query_id, v.id, round_even({_DOT} * 1e10, 0) / 1e10 AS score FROM v0 q, v0 v WHERE q.id LIKE '%0000' AND q.case_id <> v.case_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, CAST(rank AS INT) AS rank, {r_even('score', 4)} AS score FROM r WHERE rank <= 3""",
)
def _(spark, sf):
    v = b.table(spark, sf, "embeddings")
    case = F.floor(F.col("vec_id") / 4).cast("string")
    chunks = v.select(F.format_string("%s_chunk_%04d", case, F.col("vec_id") % 4).alias("id"), "embedding")
    queries = v.filter("vec_id % 4 = 0").select(case.alias("id"), "embedding")
    return retrieve.similar_cases(queries, spread(chunks, "id"), 3).select("query_id", "id", "rank", "score")


_HITS = f"""s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round_even({_DOT} * 1e10, 0) / 1e10 AS score FROM embeddings q, embeddings v WHERE q.vec_id % 25 = 3),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 3),
hit AS (SELECT h.*, {r_even('score', 4)} AS sc, substr(c.case_text, 1, 300) AS text, c.case_type, c.verdict FROM h JOIN labelled c ON c.case_id = CAST(h.id % 150 AS VARCHAR)),
ctx AS (SELECT query_id, string_agg('[Case ' || rank || '] ID=' || id || format('  Score={{:.3f}}', sc) || '  Type=' || case_type || '  Verdict=' || verdict
    || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS sources FROM hit GROUP BY 1)"""


def _contexts(spark, sf, slots=None):
    """Every vector stands for the case its number falls on, of the first *slots* cases or of all."""
    vectors = _vectors(spark, sf)
    facts = b.labelled(spark, sf).select(
        F.col("case_id").cast("bigint").alias("slot"),
        F.col("case_text").alias("text"),
        F.create_map(F.lit("case_type"), F.col("case_type"), F.lit("verdict"), F.col("verdict")).alias("metadata"),
    )
    slots = facts.count() if slots is None else slots
    vectors = vectors.withColumn("slot", F.col("id") % slots).join(facts, "slot")
    hits = retrieve.search(vectors.filter("id % 25 = 3"), vectors, 3)
    return retrieve.format_context(hits)


@register("format_context", f"WITH {rs.LABELLED}, {_HITS} SELECT query_id, context, sources FROM ctx")
def _(spark, sf):
    return _with_sources(_contexts(spark, sf, 150))


def _with_sources(df):
    return df.select("query_id", "context", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


def _over_all(name):
    """The query's SQL with vectors dealt over the whole table."""
    return SQL[name].replace("h.id % 150", "h.id % (SELECT count(*) FROM labelled)")


@register("format_context_all", _over_all("format_context"))
def _(spark, sf):
    return _with_sources(_contexts(spark, sf))


_HEAD = "You are an expert legal analyst. Use the following retrieved case excerpts to answer the question.\n\nRETRIEVED CASES:\n"
_TAIL = "\n\nProvide a concise, accurate legal answer citing the relevant cases where applicable.\nANSWER:"


@register(
    "build_prompts",
    f"""WITH {rs.LABELLED}, {_HITS} SELECT vec_id AS id, {lit(_HEAD)} || context || {lit(chr(10) * 2 + 'QUESTION: ')} || b.text || {lit(_TAIL)} AS prompt
FROM embeddings e JOIN ctx ON ctx.query_id = e.vec_id JOIN benchmark b ON b.item_id = e.vec_id % 40""",
)
def _(spark, sf):
    return _prompts(spark, sf, 40, _contexts(spark, sf, 150))


def _prompts(spark, sf, items, contexts):
    asked = b.table(spark, sf, "embeddings").filter("vec_id % 25 = 3").select("vec_id", (F.col("vec_id") % items).alias("item_id"))
    questions = asked.join(b.table(spark, sf, "benchmark"), "item_id").select(F.col("vec_id").alias("id"), F.col("text").alias("question"))
    return retrieve.build_prompts(questions, contexts).select("id", "prompt")


@register(
    "build_prompts_all",
    _over_all("build_prompts").replace("e.vec_id % 40", "e.vec_id % (SELECT count(*) FROM benchmark)"),
)
def _(spark, sf):
    return _prompts(spark, sf, b.table(spark, sf, "benchmark").count(), _contexts(spark, sf))


def _rag(spark, sf):
    c = b.table(spark, sf, "conversations")
    asked = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    given = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = asked.join(given, ["conv_id", "turn"]).withColumn("item_id", F.col("conv_id") % 40)
    docs = b.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("doc"))
    pairs = pairs.join(docs, "item_id").withColumn("docs", F.array("doc", "question"))
    return retrieve.rag_scores(pairs)


def _set(c: str) -> str:
    return f"list_filter(list_distinct(string_split({collapse(f'lower({c})')}, ' ')), lambda x: x <> '')"


_RAG = f"""pr AS (SELECT q.conv_id, q.turn, {_set('q.text')} AS q, {_set('a.text')} AS a, {_set("b.text || ' ' || q.text")} AS d
  FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 JOIN benchmark b ON b.item_id = q.conv_id % 40
  WHERE q.role = 'user' AND a.role = 'assistant'),
rag AS (SELECT conv_id, turn, least({r_even('len(list_intersect(q, d)) / (len(q) + 1e-9)', 3)}, 1.0) AS context_precision,
  least({r_even('len(list_intersect(a, d)) / (len(a) + 1e-9)', 3)}, 1.0) AS answer_relevance FROM pr)"""


@register("rag_scores", f"WITH {_RAG} SELECT * FROM rag")
def _(spark, sf):
    return _rag(spark, sf).select("conv_id", "turn", "context_precision", "answer_relevance")


@register(
    "rag_eval",
    f"WITH {_RAG} SELECT {r_even('avg(context_precision)', 3)} AS avg_context_precision, {r_even('avg(answer_relevance)', 3)} AS avg_answer_relevance, count(*) AS n_queries FROM rag",
)
def _(spark, sf):
    return retrieve.rag_eval(_rag(spark, sf))


# -- storage and resume -----------------------------------------------------------------------

_SAVED = ("case_id", "source_folder", "year", "court", "case_text")


def _digest(df):
    columns = [F.coalesce(F.col(c), F.lit("")) for c in sorted(_SAVED)]
    return df.select("case_id", F.md5(F.concat_ws("|", *columns)).alias("digest"))


_DIGEST = "SELECT case_id, md5(case_id || '|' || case_text || '|' || court || '|' || source_folder || '|' || year) AS digest FROM cases"


@register("saved_cases_parquet", f"WITH {CASES} {_DIGEST}")
def _(spark, sf):
    paths = tables.save_outputs(b.cases(spark, sf), scratch_path(spark, "outputs"))
    return _digest(tables.read_cases(spark, paths["parquet"]).withColumn("source_folder", F.col("source_folder").cast("string")))


@register("saved_cases_csv", f"WITH {CASES} {_DIGEST}")
def _(spark, sf):
    df = b.cases(spark, sf).select(*_SAVED)
    paths = tables.save_outputs(df, scratch_path(spark, "outputs"), partition_by=None)
    return _digest(tables.read_cases(spark, paths["csv"], df.schema))


@register("saved_vectors", "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(len(embedding) AS INT) AS dim, round_even(list_sum(CAST(embedding AS DOUBLE[])) * 1e6, 0) / 1e6 AS total FROM embeddings")
def _(spark, sf):
    path = scratch_path(spark, "vectors")
    v = b.table(spark, sf, "embeddings")
    none = F.lit(None).cast("map<string,string>")
    tables.save_vectors(v.select(F.col("vec_id").cast("string").alias("id"), "embedding", F.lit("").alias("text"), none.alias("metadata")), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return tables.load_vectors(spark, path).select("id", F.size("embedding").alias("dim"), feat.round_even(total, 6).alias("total"))


@register("resume_batch", f"WITH {rs.LABELLED} SELECT case_id, verdict FROM labelled")
def _(spark, sf):
    """Two runs: the first sees half of the cases, the second all of them."""
    cases = b.cases(spark, sf)
    ledger, out = Ledger(spark, scratch_path(spark, "ledger")), scratch_path(spark, "resumed")

    def process(df):
        return label_cases(df, columns=("verdict",)).select("source_folder", "case_id", "verdict")

    resume_batch(cases.filter("CAST(case_id AS INT) % 2 = 0"), ledger, process, out, "source_folder", "case_id")
    return resume_batch(cases, ledger, process, out, "source_folder", "case_id").drop("source_folder")


@register("resume_stream", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def _(spark, sf):
    """Two arrivals of event files; the second call only processes the second."""
    events = b.table(spark, sf, "events")
    inbox, out, state = (scratch_path(spark, n) for n in ("inbox", "stream", "state"))

    def process(df):
        return df.select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))

    for part in (0, 1):
        events.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(inbox)
        stream_cases(spark, events.schema, inbox, out, state, process)
    return spark.read.parquet(out).drop("batch")


@register("exported_predictions", f"WITH {P} SELECT CAST(id AS VARCHAR) AS id, pred AS verdict FROM p")
def _(spark, sf):
    path = scratch_path(spark, "predictions")
    df = b.predictions(spark, sf)
    blank = F.lit("").cast("string")
    tables.export_predictions(df.select("id", F.col("true").alias("case_type"), blank.alias("sub_type"), F.col("pred").alias("verdict"), blank.alias("error")), path)
    return tables.read_csv_stripped(spark, path).select("id", "verdict")


@register("report_file", f"WITH {b.ORDER_CASES} SELECT CAST(year_numeric AS VARCHAR) AS year, CAST(count(*) AS VARCHAR) AS n_cases FROM oc GROUP BY 1")
def _(spark, sf):
    from casework.operators.profile import annual_volume

    path = scratch_path(spark, "report")
    tables.save_report(annual_volume(b.order_cases(spark, sf)), path)
    return tables.read_csv_stripped(spark, path)


@register("case_filter_sql", f"WITH {b.ORDER_CASES} SELECT case_id FROM oc WHERE verdict_mapped = 'P' AND year_numeric >= 1998")
def _(spark, sf):
    from casework.sources.jdbc import run_sql

    filter_cases(b.order_cases(spark, sf), verdict="P").createOrReplaceTempView("casework_orders")
    return run_sql(spark, "SELECT case_id FROM casework_orders WHERE year_numeric >= :since", since=1998)


# -- case files -----------------------------------------------------------------------------------

_PAIRS = f"WITH {b.FILE_SIDES} SELECT source, stem, md5(html) AS page, json FROM sides WHERE has_html AND has_json"


@register("discovered_cases", _PAIRS)
def _(spark, sf):
    from casework.sources.case_files import discover_cases

    root = scratch_path(spark, "files")
    b.write_case_files(spark, sf, root, "html", "json")
    return discover_cases(spark, root).select("source", "stem", F.md5(F.col("html").cast("binary")).alias("page"), "json")


@register(
    "unmatched_files",
    f"""WITH {b.FILE_SIDES} SELECT source, stem, CASE WHEN has_html THEN 'html' ELSE 'json' END AS side FROM sides WHERE has_html <> has_json""",
)
def _(spark, sf):
    from casework.sources.case_files import unmatched_files

    root = scratch_path(spark, "files")
    b.write_case_files(spark, sf, root, "html", "json")
    return unmatched_files(spark, root)


@register("streamed_case_files", _PAIRS)
def _(spark, sf):
    """The pages arrive before their sidecars; a third call finds nothing new."""
    from casework.streaming.resume import stream_case_files

    root, out, state = (scratch_path(spark, n) for n in ("inbox", "streamed", "state"))
    process = lambda df: df.select("source", "stem", F.md5(F.col("html").cast("binary")).alias("page"), "json")
    for kinds in (("html",), ("json",), ()):
        b.write_case_files(spark, sf, root, *kinds)
        stream_case_files(spark, root, out, state, process, 100_000)
    return spark.read.parquet(out).drop("batch")


@register(
    "master_metadata",
    """SELECT CAST(doc_id AS VARCHAR) AS case_id, CASE WHEN doc_id % 5 < 3 THEN source END AS name FROM documents""",
)
def _(spark, sf):
    """Three of five documents have an entry by id or by stem; of two entries the last one counts."""
    from casework.sources.case_files import attach_master_metadata

    docs = b.documents(spark, sf).filter("doc_id IS NOT NULL")
    cases = docs.select(F.col("doc_id").cast("string").alias("case_id"), F.concat(F.lit("stem "), F.col("doc_id").cast("string")).alias("stem"))
    by_id = F.when(F.col("doc_id") % 5 < 2, F.col("doc_id").cast("string"))
    by_stem = F.when(F.col("doc_id") % 5 == 2, F.concat(F.lit("stem "), F.col("doc_id").cast("string")))
    entries = docs.select(by_id.alias("id"), by_stem.alias("name"), F.lit(None).cast("string").alias("decision_date"), F.col("source").alias("court"), F.lit(2).cast("long").alias("position"))
    early = entries.withColumns({"court": F.lit("early"), "position": F.lit(1).cast("long")})
    found = attach_master_metadata(cases, entries.unionByName(early))
    return found.select("case_id", F.col("metadata.court").alias("name"))


@register(
    "case_prompts",
    f"""WITH {rs.LABELLED}, t AS (SELECT case_id, case_text, verdict FROM labelled)
SELECT case_id AS id, 'summary' AS template, md5('Summarise the following legal case in 3-5 sentences, noting the case type, verdict, and key legal principles.' || chr(10) || chr(10)
  || 'CASE TEXT:' || chr(10) || case_text || chr(10) || chr(10) || 'SUMMARY:') AS digest FROM t
UNION ALL SELECT case_id, 'explanation', md5('Given the following case facts and verdict, explain the legal reasoning.' || chr(10) || chr(10)
  || 'CASE FACTS:' || chr(10) || case_text || chr(10) || chr(10) || 'VERDICT: ' || verdict || chr(10) || chr(10) || 'LEGAL REASONING:') FROM t""",
)
def _(spark, sf):
    rows = b.labelled(spark, sf).select(F.col("case_id").alias("id"), "case_text", F.col("case_text").alias("facts"), "verdict")
    out = []
    for name, template in (("summary", "case_summary"), ("explanation", "verdict_explanation")):
        prompts = retrieve.build_prompts(rows, template=template)
        out.append(prompts.select("id", F.lit(name).alias("template"), F.md5(F.col("prompt").cast("binary")).alias("digest")))
    return out[0].unionByName(out[1])
