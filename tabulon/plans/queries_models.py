"""Queries that fit models on the labelled documents table.

Fits have no SQL counterpart.  Where a fitted model must obey an identity
(shares of predictions, additivity, order), the identity is the check.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulon.functions.clean import clean_unknowns
from tabulon.functions.hashing import add_noise
from tabulon.functions.text import parent_of
from tabulon.operators import encode, evaluate, folds, importance, models, summaries, treeshap
from tabulon.operators.columns import FeatureSet, feature_set
from tabulon.plans import ledger, study
from tabulon.plans.registry import query, r, rounded
from tabulon.plans.views import table, view, with_views
from tabulon.session import scratch_path

CASES = with_views("cases")
KEY = "doc_id"
FEATURES = FeatureSet("cases", ("n_chars", "n_blanks", "n_lines", "random_noise"), ("lang", "source"))
LEVELS = ["Low", "Significant", "Undamaged"]
FOLDS, REPEATS = 5, 1
FIT_ROWS = None  # no bound: the survey study fits a model to all training rows of its fold


def _prepared(spark, d, strategy="median", flags=()):
    return study.prepare(add_noise(view(spark, d, "cases"), KEY), KEY, FEATURES, strategy, flags)


def _forest(n=200, min_leaf=2):
    return models.random_forest(n, min_leaf)


def _one_hot(spark, d):
    """One-hot matrix as the explanation scripts use it."""
    df = add_noise(view(spark, d, "cases"), KEY)
    df, _ = encode.encode_label(df, "target")
    df, _ = encode.impute_median(df, ["n_lines"])
    df, hot = encode.one_hot(df, ["lang", "source"])
    return df, [*FEATURES.numeric, *hot.columns], hot


_PER_FOLD = f"""{CASES}, f AS (SELECT target, (row_number() OVER (ORDER BY target, md5(doc_id || ':0:42'), doc_id) - 1) % {FOLDS} AS fold
    FROM cases)"""


def _scores(spark, d, name):
    prep = _prepared(spark, d)
    scores, _ = study.cross_validate(prep, KEY, {name: models.model_registry()[name]}, FOLDS, REPEATS)
    return rounded(scores, "MacroF1", "Accuracy")


for _name in ("DecisionTree", "RandomForest", "LogisticRegression", "RidgeClassifier", "LinearSVC", "GradientBoosting"):
    query(f"cross_validate_{_name}")(lambda spark, d, n=_name: _scores(spark, d, n))


@query("fold_predictions", f"""{_PER_FOLD}
    SELECT CAST(fold AS INTEGER) AS "Fold", CAST(CASE target WHEN 'Low' THEN 0 WHEN 'Significant' THEN 1 ELSE 2 END AS DOUBLE) AS y,
           count(*) AS n FROM f GROUP BY 1, 2""")
def fold_predictions(spark, d):
    """Each row is predicted once: class counts per fold equal the fold table's."""
    prep = _prepared(spark, d)
    made = folds.stratified_folds(prep.table, KEY, "label", FOLDS)
    pred = models.fit_predict(prep.table, KEY, prep.features, made, {"RandomForest": _forest()})
    return pred.groupBy("Fold", "y").agg(F.count("yhat").alias("n"))


@query("survey_cross_validation")
def survey_cross_validation(spark, d):
    """The whole study on the survey: clean, featurise, prepare, over-sample, fit, score."""
    features = feature_set("Engineered")
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "cents", "parapet_height_m",
                                                     "buidling_height_m", "wall_length_side", "dataset_source")
    rows = view(spark, d, "survey").withColumn("row_id", F.concat_ws("-", "l_orderkey", F.row_number().over(place)))
    survey = study.engineer(clean_unknowns(rows), "row_id", features.numeric, features.categorical)
    prep = study.prepare(survey, "row_id", features)
    scores, _ = study.cross_validate(prep, "row_id", {"RandomForest": _forest()}, FOLDS, REPEATS, "Engineered", fit_rows=FIT_ROWS)
    return rounded(scores, "MacroF1", "Accuracy")


@query("study_ledger", f"""{CASES}, f AS (SELECT target, rep, (row_number() OVER (PARTITION BY rep ORDER BY target,
        md5(doc_id || ':' || rep || ':42'), doc_id) - 1) % {FOLDS} AS fold FROM cases, (SELECT unnest(range(5)) AS rep))
    SELECT m AS "Model", CAST(rep * {FOLDS} + fold AS INTEGER) AS "Fold",
           CAST(CASE target WHEN 'Low' THEN 0 WHEN 'Significant' THEN 1 ELSE 2 END AS DOUBLE) AS y, count(*) AS n, 6 AS features
    FROM f, (SELECT unnest(['DecisionTree', 'RidgeClassifier']) AS m) GROUP BY ALL""")
def study_ledger(spark, d):
    """Five folds in five repeats, stopped after the first model and taken up again with the second.

    Every row is predicted once per model and repeat, and every fold has the importance of every feature.
    """
    prep, path = _prepared(spark, d), scratch_path(spark, "study")
    both = {name: models.model_registry()[name] for name in ("DecisionTree", "RidgeClassifier")}
    ledger.run_study(prep, KEY, {"DecisionTree": both["DecisionTree"]}, path, "Cases", FOLDS, 5)
    _, predictions, imp = ledger.run_study(prep, KEY, both, path, "Cases", FOLDS, 5)
    listed = imp.groupBy("Model", "Fold").agg(F.countDistinct("Feature").cast("int").alias("features"))
    return predictions.groupBy("Model", "Fold", "y").agg(F.count("yhat").alias("n")).join(listed, ["Model", "Fold"])


@query("smote_ablation")
def smote_ablation(spark, d):
    return rounded(study.smote_ablation(_prepared(spark, d), KEY, "Low", _forest(100, 1), FOLDS, REPEATS),
                   "macro_f1", "class_f1")


@query("permutation_importance")
def permutation_importance(spark, d):
    prep = _prepared(spark, d)
    made = folds.repeated_folds(prep.table, KEY, "label", FOLDS, REPEATS)
    imp = importance.permutation_importance(prep.table, KEY, prep.features, made, {"RandomForest": _forest()}, prep.resampler)
    return rounded(imp, "Decrease_in_Accuracy")


@query("permutation_importance_constant", f"""{CASES} SELECT 'same' AS "Feature", 0.0::DOUBLE AS "Decrease" FROM cases
    GROUP BY ALL HAVING count(*) > 0""")
def permutation_importance_constant(spark, d):
    """Shuffling a constant column changes nothing."""
    prep = _prepared(spark, d)
    df = prep.table.withColumn("same", F.lit(1.0))
    feats = [*prep.features, "same"]
    model = _forest()(encode.assemble(df, feats))
    return importance.permutation_scores(model, df, KEY, feats, "macro_f1").filter("Feature = 'same'")


@query("rfecv")
def rfecv(spark, d):
    """On the over-sampled training part of the first split."""
    prep = _prepared(spark, d)
    first = folds.first_split(folds.stratified_folds(prep.table, KEY, "label", FOLDS))
    train = prep.table.join(first, KEY, "left_anti")
    return rounded(importance.rfecv(train, KEY, prep.features, _forest(100), 3, resample=prep.resampler), "Best_Score")


@query("missingness_sensitivity")
def missingness_sensitivity(spark, d):
    df = add_noise(view(spark, d, "cases"), KEY)
    out = study.missingness_sensitivity(df, KEY, FEATURES, ["n_lines"], _forest(100), FOLDS)
    return rounded(out, *[c for c in out.columns if c != "Feature"])


@query("shap_additivity", f"""{CASES} SELECT doc_id, class, 0.0::DOUBLE AS gap FROM cases,
    (SELECT unnest(['Low', 'Significant', 'Undamaged']) AS class)""")
def shap_additivity(spark, d):
    """Base value plus SHAP values is the predicted probability, row by row."""
    prep = _prepared(spark, d)
    model = _forest()(encode.assemble(prep.table, prep.features))
    trees = treeshap.tree_table(model)
    base = treeshap.base_values(trees, prep.classes)
    shap = treeshap.shap_values(trees, prep.table, KEY, prep.features)
    total = shap.select(F.col("key").alias(KEY), F.posexplode("phi").alias("c", "row")).select(
        KEY, "c", F.aggregate("row", F.lit(0.0), lambda a, b: a + b).alias("total"))
    scored = model.transform(encode.assemble(prep.table, prep.features)).select(
        KEY, F.posexplode(vector_to_array("probability")).alias("c", "p"))
    names = F.array(*[F.lit(c) for c in prep.classes])
    bases = F.array(*[F.lit(base[c]) for c in prep.classes])
    gap = F.col("total") + bases[F.col("c")] - F.col("p")
    return rounded(total.join(scored, [KEY, "c"]).select(KEY, names[F.col("c")].alias("class"), gap.alias("gap")), "gap")


@query("shap_out_of_fold", f"""{_PER_FOLD} SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n FROM f GROUP BY fold""")
def shap_out_of_fold(spark, d):
    """Every row is explained once, by the model of its own fold."""
    prep = _prepared(spark, d)
    made = folds.stratified_folds(prep.table, KEY, "label", FOLDS)
    shap = treeshap.shap_oof(prep.table, KEY, prep.features, "label", made,
                             lambda train: _forest()(encode.assemble(train, prep.features)))
    return shap.filter(F.size("phi") == 3).groupBy("fold").agg(F.count("key").alias("n"))


@query("shap_mean_abs")
def shap_mean_abs(spark, d):
    df, feats, hot = _one_hot(spark, d)
    model = _forest()(encode.assemble(df, feats))
    mean = treeshap.mean_abs_shap(treeshap.shap_values(model, df, KEY, feats), feats, LEVELS)
    by_parent = mean.groupBy("class", parent_of("feature", hot.parents).alias("feature")).agg(
        F.sum("mean_abs_shap").alias("mean_abs_shap"))
    return rounded(by_parent, "mean_abs_shap")


@query("shap_interactions_parent")
def shap_interactions_parent(spark, d):
    """Pair strengths of the Significant class, as a share of main effects."""
    df, feats, hot = _one_hot(spark, d)
    trees = treeshap.tree_table(_forest()(encode.assemble(df, feats)))
    pairs = treeshap.interaction_strength(trees, df, KEY, feats, LEVELS, ["Significant"])
    mean = treeshap.mean_abs_shap(treeshap.shap_values(trees, df, KEY, feats), feats, LEVELS)
    sums = treeshap.parent_interactions(pairs, hot.parents)
    effects = treeshap.parent_effects(mean.filter(F.col("class") == "Significant"), hot.parents)
    return rounded(treeshap.normalized_interactions(sums, effects), "strength", "main_1", "main_2", "relative_pct")


@query("shap_interaction_sums", f"""{CASES} SELECT doc_id, class, feature, 0.0::DOUBLE AS gap FROM cases,
    (SELECT unnest(['Low', 'Significant', 'Undamaged']) AS class),
    (SELECT unnest(['n_chars', 'n_blanks', 'n_lines', 'random_noise', 'lang', 'source']) AS feature)""")
def shap_interaction_sums(spark, d):
    """Interactions of a feature with all others add up to prediction - alone - others + base.

    ``alone`` and ``others`` are the mean predictions given that feature only and given all others; they
    come from a plain walk that knows nothing of Shapley values.
    """
    prep = _prepared(spark, d)
    model = _forest()(encode.assemble(prep.table, prep.features))
    trees = treeshap.tree_table(model)
    n, classes = len(prep.features), len(prep.classes)
    base = treeshap.base_values(trees, prep.classes)
    pairs = treeshap.pair_values(trees, prep.table, KEY, prep.features)
    cells = [(i, j) for i in range(n) for j in range(i + 1, n)]
    v, e = F.col("v"), F.col("e")
    sums = [sum((v[c * len(cells) + at] for at, p in enumerate(cells) if f in p), F.lit(0.0)) * 2 for c in range(classes) for f in range(n)]
    means = treeshap.single_expectations(trees, prep.table, KEY, prep.features).select("key", F.col("v").alias("e"))
    scored = model.transform(encode.assemble(prep.table, prep.features)).select(
        F.col(KEY).alias("key"), vector_to_array("probability").alias("p"))
    rows = []
    for c, name in enumerate(prep.classes):
        for f, feature in enumerate(prep.features):
            gap = sums[c * n + f] - (F.col("p")[c] - e[c * n + f] - e[(classes + c) * n + f] + F.lit(base[name]))
            rows.append(F.struct(F.lit(name).alias("class"), F.lit(feature).alias("feature"), gap.alias("gap")))
    joined = pairs.join(means, "key").join(scored, "key")
    return rounded(joined.select(F.col("key").alias(KEY), F.explode(F.array(*rows)).alias("r")).select(KEY, "r.*"), "gap")


@query("shap_model_comparison")
def shap_model_comparison(spark, d):
    """Forest and boosted trees: ranks of mean absolute SHAP values."""
    prep = _prepared(spark, d)
    train = encode.assemble(prep.table, prep.features)
    mean = [treeshap.mean_abs_shap(treeshap.shap_values(fit(train), prep.table, KEY, prep.features), prep.features, LEVELS).filter(
        F.col("class") == "Significant") for fit in (_forest(), models.boosted_trees())]
    return rounded(treeshap.compare_shap(*mean), "a_score", "b_score")


@query("dependence_table", f"""{CASES} SELECT doc_id AS key, n_chars AS value, n_blanks AS colour,
    n_chars > 2000 AS above_threshold FROM cases""")
def dependence_table(spark, d):
    """Feature values next to SHAP values; the values themselves are checked."""
    prep = _prepared(spark, d)
    model = _forest()(encode.assemble(prep.table, prep.features))
    shap = treeshap.shap_values(model, prep.table, KEY, prep.features)
    out = treeshap.dependence(shap, prep.features, prep.classes, "n_chars", "Significant", "n_blanks", 2000)
    return out.filter(F.col("shap").isNotNull()).drop("shap")


@query("beeswarm_topk")
def beeswarm_topk(spark, d):
    prep = _prepared(spark, d)
    model = _forest()(encode.assemble(prep.table, prep.features))
    shap = treeshap.shap_values(model, prep.table, KEY, prep.features)
    return rounded(treeshap.beeswarm(shap, prep.features, prep.classes, "Significant", 20), "value", "x")


# A stored table of explanations: three features, two classes, a row per line of an order.
_STORED = """SELECT l_orderkey * 10 + l_linenumber AS key, l_quantity AS x0, l_extendedprice AS x1, l_discount AS x2,
    l_tax - 0.04 AS a0, (l_quantity - 25) / 100 AS a1, 0.05 - l_discount AS a2,
    0.04 - l_tax AS b0, l_discount - 0.02 AS b1, (l_quantity - 10) / 50 AS b2 FROM {}"""
_STORED_FEATURES = ["tax", "size", "discount"]


def _stored_shap(spark, d):
    rows = spark.sql(_STORED.format("{t}"), t=table(spark, d, "lineitem"))
    return rows.select("key", F.array("x0", "x1", "x2").alias("x"), F.array(F.array("a0", "a1", "a2"), F.array("b0", "b1", "b2")).alias("phi"))


_STORED_MEANS = f"""WITH s AS ({_STORED.format("lineitem")}),
    m AS (SELECT c, f, avg(abs(v)) AS mean FROM (SELECT unnest(['A', 'A', 'A', 'B', 'B', 'B']) AS c,
        unnest(['tax', 'size', 'discount', 'tax', 'size', 'discount']) AS f, unnest([a0, a1, a2, b0, b1, b2]) AS v FROM s) GROUP BY ALL)"""


@query("shap_means_stored", f"""{_STORED_MEANS} SELECT c AS class, f AS feature, {r('mean', 'mean_abs_shap')} FROM m""")
def shap_means_stored(spark, d):
    return rounded(treeshap.mean_abs_shap(_stored_shap(spark, d), _STORED_FEATURES, ["A", "B"]), "mean_abs_shap")


@query("dependence_stored", f"""{_STORED_MEANS} SELECT key, x1 AS value, {r('b1', 'shap')}, x0 AS colour, x1 > 30000 AS above_threshold FROM s""")
def dependence_stored(spark, d):
    """Feature value, SHAP value, colour and threshold of every explained row."""
    return rounded(treeshap.dependence(_stored_shap(spark, d), _STORED_FEATURES, ["A", "B"], "size", "B", "tax", 30000), "shap")


@query("beeswarm_stored", f"""{_STORED_MEANS}, k AS (SELECT f FROM m WHERE c = 'B' ORDER BY mean DESC, f LIMIT 2),
    l AS (SELECT key, unnest(['tax', 'size', 'discount']) AS feature, unnest([x0, x1, x2]) AS x, unnest([b0, b1, b2]) AS value FROM s)
    SELECT key, feature, {r('x', 'x')}, {r('value', 'value')} FROM l WHERE feature IN (SELECT f FROM k)""")
def beeswarm_stored(spark, d):
    return rounded(treeshap.beeswarm(_stored_shap(spark, d), _STORED_FEATURES, ["A", "B"], "B", 2), "x", "value")


@query("shap_comparison_stored", f"""{_STORED_MEANS},
    w AS (SELECT f, max(mean) FILTER (c = 'A') AS a, max(mean) FILTER (c = 'B') AS b FROM m GROUP BY f)
    SELECT f AS feature, {r('a', 'a_score')}, {r('b', 'b_score')}, (rank() OVER (ORDER BY a DESC))::DOUBLE AS a_rank,
        (rank() OVER (ORDER BY b DESC))::DOUBLE AS b_rank,
        abs((rank() OVER (ORDER BY a DESC))::DOUBLE - (rank() OVER (ORDER BY b DESC))::DOUBLE) AS rank_difference FROM w""")
def shap_comparison_stored(spark, d):
    """Ranks of two models' mean absolute SHAP values; here the two classes stand for the models."""
    means = treeshap.mean_abs_shap(_stored_shap(spark, d), _STORED_FEATURES, ["A", "B"])
    return rounded(treeshap.compare_shap(*[means.filter(F.col("class") == c) for c in "AB"]), "a_score", "b_score")


@query("ridge_scores")
def ridge_scores(spark, d):
    """Confusion of the ridge classifier fitted on the full table."""
    prep = _prepared(spark, d)
    model = models.ridge_classifier()(encode.assemble(prep.table, prep.features))
    return evaluate.confusion(models.predict(model, prep.table, prep.features, [KEY]))


@query("importance_ci")
def importance_ci(spark, d):
    """Mean importance with its bootstrap interval, as the bar charts draw it."""
    imp = permutation_importance(spark, d)
    return rounded(summaries.bootstrap_mean_ci(imp, ["Feature"], "Decrease_in_Accuracy", ["Feature", "Fold"], 1000),
                   "mean", "ci_lo", "ci_hi")
