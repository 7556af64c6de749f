"""Queries: metrics, tests, rankings, summaries and chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions import clean, geo, text
from tabulon.operators import evaluate, importance, ordering, stats, summaries, treeshap
from tabulon.plans.queries_features import _HAVERSINE_SQL, PLACE
from tabulon.plans.registry import query, r, rounded
from tabulon.plans.views import table, view, with_views

SURVEY, CASES, PRED = with_views("survey"), with_views("cases"), with_views("pred")
SCORES, IMP, SERIES = with_views("scores"), with_views("importance"), with_views("series")
_LABEL = ("CASE WHEN degree_of_damage_u = 0 THEN 'Undamaged' WHEN degree_of_damage_u = 1 THEN 'Low' "
          "WHEN degree_of_damage_u >= 2 THEN 'Significant' END")
_STATUS = ("CASE WHEN lower(trim(status_u)) = 'undamaged' THEN 'Undamaged' WHEN lower(trim(status_u)) = 'minor' "
           "THEN 'Low' WHEN lower(trim(status_u)) IN ('moderate', 'severe', 'destroyed') THEN 'Significant' END")
LEVELS = list(clean.DAMAGE_ORDER)


def labelled(spark, d):
    return view(spark, d, "survey").withColumn("target", clean.damage_label("degree_of_damage_u")).na.drop(
        subset=["target"])


# ---- evaluation ----

@query("confusion", f"""{PRED} SELECT y, yhat, count(*) AS n FROM pred GROUP BY y, yhat""")
def confusion(spark, d):
    return evaluate.confusion(view(spark, d, "pred"))


@query("accuracy_by_fold", f"""{PRED} SELECT fold, {r('avg((y = yhat)::INT)', 'accuracy')} FROM pred GROUP BY fold""")
def accuracy_by_fold(spark, d):
    return rounded(evaluate.accuracy(view(spark, d, "pred"), ["fold"]), "accuracy")


def _scores_sql(keys: str) -> str:
    """Per-class scores by explicit class list and sub-selects."""
    on = f"{keys}, " if keys else ""
    return f"""cls AS (SELECT DISTINCT {on}y AS class FROM pred UNION SELECT DISTINCT {on}yhat FROM pred),
        tab AS (SELECT {'cls.' + keys + ', ' if keys else ''}class,
                  count_if(y = class AND yhat = class) AS tp, count_if(y = class) AS support, count_if(yhat = class) AS said
                FROM cls JOIN pred ON {'cls.' + keys + ' = pred.' + keys if keys else 'true'} GROUP BY ALL),
        sc AS (SELECT *, coalesce(tp / nullif(said, 0), 0) AS "precision", coalesce(tp / nullif(support, 0), 0) AS recall,
                  coalesce(2 * tp / nullif(said + support, 0), 0) AS f1 FROM tab)"""


@query("macro_f1_by_fold", f"""{PRED}, {_scores_sql('fold')}
    SELECT fold, {r('avg(f1)', 'macro_f1')} FROM sc GROUP BY fold""")
def macro_f1_by_fold(spark, d):
    return rounded(evaluate.macro_f1(view(spark, d, "pred"), ["fold"]), "macro_f1")


@query("class_f1_by_fold", f"""{PRED}, {_scores_sql('fold')}
    SELECT fold, {r("coalesce(max(CASE WHEN class = 'R' AND support > 0 THEN f1 END), 0)", 'class_f1')} FROM sc GROUP BY fold""")
def class_f1_by_fold(spark, d):
    return rounded(evaluate.class_f1(view(spark, d, "pred"), "R", ["fold"]), "class_f1")


@query("fold_scores", f"""{PRED}, {_scores_sql('fold')}
    SELECT fold, {r('avg(f1)', 'MacroF1')}, {r('sum(tp) / sum(support)', 'Accuracy')} FROM sc GROUP BY fold""")
def fold_scores(spark, d):
    return rounded(evaluate.fold_scores(view(spark, d, "pred"), ["fold"]), "MacroF1", "Accuracy")


def _report_sql(keys: str) -> str:
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    avg = ", ".join(f'avg("{c}") AS "{c}"' for c in ("precision", "recall", "f1"))
    wavg = ", ".join(f'sum("{c}" * support) / sum(support) AS "{c}"' for c in ("precision", "recall", "f1"))
    acc = ", ".join(f'sum(tp) / sum(support) AS "{c}"' for c in ("precision", "recall", "f1"))
    return f"""rep AS (SELECT {k}class, "precision", recall, f1, support FROM sc
        UNION ALL SELECT {k}'accuracy', {acc}, sum(support) FROM sc {g}
        UNION ALL SELECT {k}'macro avg', {avg}, sum(support) FROM sc {g}
        UNION ALL SELECT {k}'weighted avg', {wavg}, sum(support) FROM sc {g})"""


@query("class_report_pooled", f"""{PRED}, {_scores_sql('')}, {_report_sql('')}
    SELECT class, {r('"precision"', '"precision"')}, {r('recall', 'recall')}, {r('f1', 'f1')},
           CAST(support AS BIGINT) AS support FROM rep""")
def class_report_pooled(spark, d):
    return rounded(evaluate.report_pooled(view(spark, d, "pred")), "precision", "recall", "f1")


@query("class_report_mean", f"""{PRED}, {_scores_sql('fold')}, {_report_sql('fold')}
    SELECT class, {r('avg("precision")', '"precision"')}, {r('avg(recall)', 'recall')}, {r('avg(f1)', 'f1')},
           {r('avg(support)', 'support')} FROM rep GROUP BY class""")
def class_report_mean(spark, d):
    return rounded(evaluate.report_mean(view(spark, d, "pred"), "fold"), "precision", "recall", "f1", "support")


@query("cv_summary", f"""{SCORES} SELECT Setting, Model, {r('avg(MacroF1)', 'MacroF1_mean')},
    {r('stddev_samp(MacroF1)', 'MacroF1_std')}, {r('avg(Accuracy)', 'Accuracy_mean')}, {r('stddev_samp(Accuracy)', 'Accuracy_std')}
    FROM scores GROUP BY Setting, Model""")
def cv_summary(spark, d):
    return rounded(evaluate.summarize(view(spark, d, "scores")),
                   "MacroF1_mean", "MacroF1_std", "Accuracy_mean", "Accuracy_std")


@query("best_model", f"""{SCORES}, m AS (SELECT Setting, Model, avg(Accuracy) AS mean FROM scores GROUP BY Setting, Model)
    SELECT Setting, Model, {r('mean', 'mean')} FROM (SELECT *, row_number() OVER (PARTITION BY Setting ORDER BY mean DESC, Model) AS i
    FROM m) WHERE i = 1""")
def best_model(spark, d):
    return rounded(summaries.best_group(view(spark, d, "scores"), ["Setting"], "Model", "Accuracy"), "mean")


# ---- tests ----

def _ranks_sql(src: str, key: str) -> str:
    """Average ranks of |d| per key from a table with key and d <> 0."""
    return f"""ranked AS (SELECT *, (rank() OVER (PARTITION BY {key} ORDER BY abs(d)))
        + (count(*) OVER (PARTITION BY {key}, abs(d)) - 1) / 2.0 AS rk FROM {src} WHERE d <> 0)"""


@query("wilcoxon_w", f"""WITH p AS (SELECT c_mktsegment, c_acctbal - 4500 AS d FROM customer), {_ranks_sql('p', 'c_mktsegment')}
    SELECT c_mktsegment, count(*) AS n, {r('least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), sum(CASE WHEN d < 0 THEN rk ELSE 0 END))', 'w')}
    FROM ranked GROUP BY c_mktsegment""")
def wilcoxon_w(spark, d):
    df = table(spark, d, "customer").withColumn("mid", F.lit(4500.0))
    return rounded(stats.signed_rank(df, ["c_mktsegment"], "c_acctbal", "mid").select("c_mktsegment", "n", "w"), "w")


def _exact_p_sql(src: str, key: str) -> str:
    """Exact two-sided p by listing every sign pattern of the ranks."""
    return f"""{_ranks_sql(src, key)},
        stat AS (SELECT {key}, count(*) AS n, least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END),
                 sum(CASE WHEN d < 0 THEN rk ELSE 0 END)) AS w FROM ranked GROUP BY {key}),
        signs AS (SELECT s.{key}, w, bits, (SELECT coalesce(sum(i), 0) FROM (SELECT unnest(range(1, n + 1)) AS i)
                  WHERE (bits >> (i - 1)) & 1 = 1) AS plus
                  FROM (SELECT *, unnest(range(CAST(pow(2, n) AS BIGINT))) AS bits FROM stat) s),
        pv AS (SELECT {key}, least(1, 2 * count_if(plus <= w) / count(*)) AS p_value FROM signs GROUP BY {key})"""


_EQUIV = f"""{SCORES}, m AS (SELECT Setting, Model, avg(Accuracy) AS mean FROM scores GROUP BY Setting, Model),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Setting ORDER BY mean DESC, Model) AS i FROM m) WHERE i = 1),
    pairs AS (SELECT s.Setting || '|' || s.Model AS k, b2.Accuracy - s.Accuracy AS d FROM scores s
              JOIN best b ON s.Setting = b.Setting AND s.Model <> b.Model
              JOIN scores b2 ON b2.Setting = b.Setting AND b2.Model = b.Model AND b2.Fold = s.Fold),
    {_exact_p_sql('pairs', 'k')},
    eq AS (SELECT m.Setting, m.Model, best.Model AS Best_Model, p_value, best.mean - m.mean AS Diff_Mean
           FROM m JOIN best USING (Setting) JOIN pv ON pv.k = m.Setting || '|' || m.Model),
    hm AS (SELECT *, least(1, (count(*) OVER (PARTITION BY Setting) - row_number() OVER (PARTITION BY Setting ORDER BY p_value) + 1)
           * p_value) AS s FROM eq)"""


@query("model_equivalence", f"""{_EQUIV}
    SELECT Setting, Model, Best_Model, {r('p_value', 'p_value')}, {r('Diff_Mean', 'Diff_Mean')},
           {r('max(s) OVER (PARTITION BY Setting ORDER BY p_value ROWS UNBOUNDED PRECEDING)', 'p_holm')} FROM hm""")
def model_equivalence(spark, d):
    return rounded(stats.model_equivalence(view(spark, d, "scores"), "Accuracy"), "p_value", "Diff_Mean", "p_holm")


@query("significance_flags", f"""{_EQUIV}
    SELECT Setting, Model, p_value < 0.05 AS significant, CASE WHEN p_value < 0.001 THEN 'p < 0.001'
           ELSE 'p = ' || format('{{:.3f}}', p_value) END AS shown FROM eq""")
def significance_flags(spark, d):
    eq = stats.model_equivalence(view(spark, d, "scores"), "Accuracy")
    return eq.select("Setting", "Model", stats.significant().alias("significant"), text.format_p("p_value").alias("shown"))


@query("holm_adjust", f"""{IMP}, m AS (SELECT Setting, Model, Feature, avg(Decrease_in_Accuracy) + 0.05 AS p FROM importance
        GROUP BY Setting, Model, Feature),
    s AS (SELECT *, least(1, (count(*) OVER (PARTITION BY Setting, Model)
          - row_number() OVER (PARTITION BY Setting, Model ORDER BY p) + 1) * p) AS s FROM m)
    SELECT Setting, Model, Feature, {r('p', 'p')},
           {r('max(s) OVER (PARTITION BY Setting, Model ORDER BY p ROWS UNBOUNDED PRECEDING)', 'p_holm')} FROM s""")
def holm_adjust(spark, d):
    p = view(spark, d, "importance").groupBy("Setting", "Model", "Feature").agg(
        (F.avg("Decrease_in_Accuracy") + 0.05).alias("p"))
    return rounded(stats.holm(p, "p", ["Setting", "Model"]), "p", "p_holm")


_AVG_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query("spearman", f"""WITH k AS (SELECT {_AVG_RANK.format(c='l_extendedprice')} AS rx, {_AVG_RANK.format(c='l_quantity')} AS ry
        FROM lineitem)
    SELECT count(*) AS n, {r('corr(rx, ry)', 'rho')} FROM k""")
def spearman(spark, d):
    return rounded(stats.spearman(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity").drop("p_value"), "rho")


@query("mann_whitney_u", f"""WITH k AS (SELECT c_mktsegment AS g, {_AVG_RANK.format(c='c_acctbal')} AS rk FROM customer
        WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
    s AS (SELECT count_if(g = 'BUILDING')::BIGINT AS n1, count_if(g = 'MACHINERY')::BIGINT AS n2,
                 sum(CASE WHEN g = 'BUILDING' THEN rk END) AS r1 FROM k)
    SELECT n1, n2, {r('r1 - n1 * (n1 + 1) / 2.0', 'u1')}, {r('n1 * n2 - (r1 - n1 * (n1 + 1) / 2.0)', 'u2')} FROM s""")
def mann_whitney_u(spark, d):
    out = stats.rank_sum(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY")
    return rounded(out.select("n1", "n2", "u1", "u2"), "u1", "u2")


@query("mann_whitney")
def mann_whitney(spark, d):
    df = labelled(spark, d).withColumn("distance_km", geo.segment_distance_km(*PLACE))
    return rounded(stats.mann_whitney(df, "target", "distance_km", "Undamaged", "Significant"), "u1", "p_value")


@query("mann_whitney_p", f"""WITH RECURSIVE c AS (SELECT c_mktsegment AS g, round(c_acctbal / 100) AS v FROM customer
        WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
    k AS (SELECT g, v, {_AVG_RANK.format(c='v')} AS rk FROM c),
    s AS (SELECT count_if(g = 'BUILDING') AS n1, count_if(g = 'MACHINERY') AS n2, sum(CASE WHEN g = 'BUILDING' THEN rk END) AS r1,
                 (SELECT sum(m * m * m - m) FROM (SELECT count(*)::DOUBLE AS m FROM k GROUP BY v)) AS ties FROM k),
    u AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2.0 AS u1, n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0))) AS var FROM s),
    z AS (SELECT *, (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2.0 - 0.5) / sqrt(2 * var) AS z FROM u),
    e AS (SELECT 0 AS i, z AS t, z AS total, z FROM z UNION ALL
          SELECT i + 1, t * 2 * z * z / (2 * i + 3), total + t * 2 * z * z / (2 * i + 3), z FROM e WHERE i < 300)
    SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, {r('u1', 'u1')},
        {r("least(1, 1 - 2 / sqrt(pi()) * exp(-z * z) * (SELECT total FROM e WHERE i = 300))", 'p_value')} FROM z""")
def mann_whitney_p(spark, d):
    """U and its p with many ties."""
    df = table(spark, d, "customer").withColumn("v", F.round(F.col("c_acctbal") / 100))
    return rounded(stats.mann_whitney(df, "c_mktsegment", "v", "BUILDING", "MACHINERY"), "u1", "p_value")


@query("spearman_p", f"""{SERIES.replace("WITH ", "WITH RECURSIVE ", 1)},
    b AS (SELECT a.Mean AS x, n.Mean AS y FROM series a JOIN series n ON a.Feature = n.Feature AND a.run = 'A' AND n.run = 'N'),
    q AS (SELECT {_AVG_RANK.format(c='x')} AS rx, {_AVG_RANK.format(c='y')} AS ry FROM b),
    k AS (SELECT count(*) AS n, corr(rx, ry) AS rho, (count(*) - 2) % 2 AS odd, (count(*) - 2) // 2 AS terms FROM q),
    e AS (SELECT 0 AS j, 1e0 AS t, 0e0 AS total, odd, terms, 1 - rho * rho AS c FROM k UNION ALL
          SELECT j + 1, t * c * (2 * j + 1 + odd) / (2 * j + 2 + odd), total + t, odd, terms, c FROM e WHERE j < terms)
    SELECT n, {r('rho', 'rho')}, {r("""CASE WHEN odd = 0 THEN 1 - abs(rho) * total
        ELSE 1 - 2 / pi() * (asin(abs(rho)) + abs(rho) * sqrt(1 - rho * rho) * total) END""", 'p_value')}
    FROM k, (SELECT total FROM e ORDER BY j DESC LIMIT 1)""")
def spearman_p(spark, d):
    """Rank correlation of two short series with Student's p."""
    series = view(spark, d, "series")
    a, b = (series.filter(F.col("run") == run).select("Feature", F.col("Mean").alias(name)) for run, name in (("A", "x"), ("N", "y")))
    return rounded(stats.spearman(a.join(b, "Feature"), "x", "y"), "rho", "p_value")


@query("average_rank", f"""SELECT l_returnflag, l_quantity, {r('''(rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC)
    + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0)''', 'rank')}, l_orderkey FROM lineitem""")
def average_rank(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    return ordering.average_rank(df, "l_quantity", "rank", ["l_returnflag"])


@query("feature_tiers", f"""{IMP}, one AS (SELECT * FROM importance),
    m AS (SELECT Setting, Model, Feature, avg(Decrease_in_Accuracy) AS Mean FROM one GROUP BY ALL),
    pos AS (SELECT *, row_number() OVER (PARTITION BY Setting, Model ORDER BY Mean DESC, Feature) AS Position FROM m),
    val AS (SELECT one.*, Position FROM one JOIN pos USING (Setting, Model, Feature) WHERE Position <= 21),
    pairs AS (SELECT b.Setting || '|' || b.Model || '|' || b.Position AS k, a.Decrease_in_Accuracy - b.Decrease_in_Accuracy AS d
              FROM val a JOIN val b ON a.Setting = b.Setting AND a.Model = b.Model AND a.Fold = b.Fold AND b.Position = a.Position + 1),
    {_exact_p_sql('pairs', 'k')}
    SELECT Setting, Model, CAST(Position AS INTEGER) AS Position, Feature, {r('Mean', 'Mean')}, {r('p_value', 'p_value')},
           CAST(1 + sum(coalesce((p_value < 0.05)::INT, 0)) OVER (PARTITION BY Setting, Model ORDER BY Position) AS BIGINT) AS Tier
    FROM pos LEFT JOIN pv ON pv.k = Setting || '|' || Model || '|' || Position WHERE Position <= 21""")
def feature_tiers(spark, d):
    return rounded(stats.feature_tiers(view(spark, d, "importance")), "Mean", "p_value")


# ---- importance and rankings ----

@query("noise_guardrail", f"""{IMP}, m AS (SELECT Setting, Model, Feature, avg(Decrease_in_Accuracy) AS mean FROM importance GROUP BY ALL),
    good AS (SELECT DISTINCT m.Setting, m.Feature FROM m JOIN m z ON z.Setting = m.Setting AND z.Model = m.Model
             AND z.Feature = 'Brand#13' WHERE m.mean > z.mean AND m.mean > 0 AND m.Feature <> 'Brand#13')
    SELECT i.Setting, Model, i.Feature, Fold, {r('Decrease_in_Accuracy', 'Decrease_in_Accuracy')}
    FROM importance i SEMI JOIN good g ON g.Setting = i.Setting AND g.Feature = i.Feature""")
def noise_guardrail(spark, d):
    return rounded(importance.above_noise(view(spark, d, "importance"), "Brand#13"), "Decrease_in_Accuracy")


_STATS = """, st AS (SELECT Setting, Model, first_value(Model) OVER (PARTITION BY Setting ORDER BY v DESC, Model) AS Best_Model,
        v AS p_value FROM (SELECT Setting, Model, avg(MacroF1) + 0.0001 AS v FROM scores GROUP BY Setting, Model))"""


@query("keep_equivalent", f"""{IMP}, {SCORES.removeprefix('WITH ')}{_STATS}
    SELECT Setting, Model, count(*) AS n, {r('sum(Decrease_in_Accuracy)', 'total')} FROM importance
    WHERE (Setting, Model) IN (SELECT (Setting, Model) FROM st WHERE Model <> Best_Model AND p_value > 0.05)
       OR (Setting, Model) IN (SELECT (Setting, Best_Model) FROM st) GROUP BY Setting, Model""")
def keep_equivalent(spark, d):
    means = view(spark, d, "scores").groupBy("Setting", "Model").agg((F.avg("MacroF1") + 0.0001).alias("p_value"))
    best = summaries.best_group(view(spark, d, "scores"), ["Setting"], "Model", "MacroF1").select(
        "Setting", F.col("Model").alias("Best_Model"))
    st = means.join(best, "Setting").filter("Model <> Best_Model")
    kept = importance.keep_equivalent(view(spark, d, "importance"), st)
    return rounded(kept.groupBy("Setting", "Model").agg(
        F.count("*").alias("n"), F.sum("Decrease_in_Accuracy").alias("total")), "total")


@query("mean_importance_topk", f"""{IMP} SELECT Feature, {r('avg(Decrease_in_Accuracy)', 'Mean')} FROM importance GROUP BY Feature
    ORDER BY avg(Decrease_in_Accuracy) DESC, Feature LIMIT 10""")
def mean_importance_topk(spark, d):
    mean = importance.mean_importance(view(spark, d, "importance"))
    return rounded(ordering.top_k(mean, [F.desc("Mean"), F.asc("Feature")], 10), "Mean")


def _run(spark, d, name):
    return view(spark, d, "series").filter(F.col("run") == name).select("Feature", "Mean")


_RUNS = ", ".join(f"{n} AS (SELECT Feature, Mean FROM series WHERE run = '{n}')" for n in "ANR")


@query("full_outer_ranks", f"""{SERIES}, {_RUNS},
    j AS (SELECT coalesce(A.Feature, N.Feature, R.Feature) AS Feature, A.Mean AS a, N.Mean AS n, R.Mean AS r
          FROM A FULL JOIN N ON A.Feature = N.Feature FULL JOIN R ON coalesce(A.Feature, N.Feature) = R.Feature)
    SELECT Feature, {', '.join(f"{r(c, c + '_score')}, CASE WHEN {c} IS NOT NULL THEN CAST(rank() OVER (ORDER BY {c} DESC NULLS LAST) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS DOUBLE) END AS {c}_rank" for c in 'anr')}
    FROM j""")
def full_outer_ranks(spark, d):
    out = importance.compare_ranks({n.lower(): _run(spark, d, n) for n in "ANR"})
    return rounded(out, "a_score", "n_score", "r_score")


@query("aligned_series", f"""{SERIES}, {_RUNS}
    SELECT coalesce(A.Feature, R.Feature) AS Feature, {r('A.Mean', 'a')}, {r('R.Mean', 'r')}
    FROM A FULL JOIN R ON A.Feature = R.Feature""")
def aligned_series(spark, d):
    return rounded(importance.align({"a": _run(spark, d, "A"), "r": _run(spark, d, "R")}, "Feature", "Mean"), "a", "r")


_POS = """pa AS (SELECT Feature, Mean, row_number() OVER (ORDER BY Mean DESC, Feature) AS pos FROM A),
    pr AS (SELECT Feature, Mean, row_number() OVER (ORDER BY Mean DESC, Feature) AS pos FROM R)"""
_TARGETS = f"""{SERIES}, {_RUNS}, {_POS}, cmp AS (
    SELECT Feature, pa.Mean AS mean_a, coalesce(pr.Mean, 0) AS mean_r, pa.pos AS rank_a, coalesce(pr.pos, 999) AS rank_r,
           abs(pa.pos - coalesce(pr.pos, 999)) AS rank_difference FROM pa LEFT JOIN pr USING (Feature) WHERE Feature <> 'Brand#13')"""


def compare_targets(spark, d):
    """Positions of features in two rankings; a feature missing in the second
    one is 999th, and the probe is removed after the positions are taken."""
    def placed(name, tag):
        ranked = ordering.position(_run(spark, d, name), [F.desc("Mean"), F.asc("Feature")], f"rank_{tag}")
        return ranked.withColumnRenamed("Mean", f"mean_{tag}")

    a, b = placed("A", "a"), placed("R", "r")
    both = importance.lookup(importance.lookup(a, b, "Feature", "mean_r", 0.0), b, "Feature", "rank_r", 999)
    return both.filter("Feature <> 'Brand#13'").withColumn("rank_difference", F.abs(F.col("rank_a") - F.col("rank_r")))


@query("target_comparison", f"""{_TARGETS}
    SELECT Feature, {r('mean_a', 'mean_a')}, {r('mean_r', 'mean_r')}, rank_a, rank_r, rank_difference FROM cmp""")
def target_comparison(spark, d):
    return rounded(compare_targets(spark, d), "mean_a", "mean_r")


@query("rank_scatter", f"""{_TARGETS}
    SELECT Feature, rank_a, rank_r, (rank_a <= 10 OR rank_r <= 10) AS annotate FROM cmp WHERE rank_a <= 20""")
def rank_scatter(spark, d):
    return summaries.rank_scatter(compare_targets(spark, d), "rank_a", "rank_r").select(
        "Feature", "rank_a", "rank_r", "annotate")


@query("largest_rank_changes", f"""{_TARGETS}
    SELECT Feature, rank_difference FROM cmp ORDER BY rank_difference DESC, Feature LIMIT 10""")
def largest_rank_changes(spark, d):
    best = ordering.top_k(compare_targets(spark, d), [F.desc("rank_difference"), F.asc("Feature")], 10)
    return best.select("Feature", "rank_difference")


@query("side_by_side_topk", f"""{SERIES}, {_RUNS}, {_POS}
    SELECT CAST(pos AS INTEGER) AS place, pa.Feature AS Feature_a, {r('pa.Mean', 'Mean_a')}, pr.Feature AS Feature_b,
           {r('pr.Mean', 'Mean_b')} FROM pa FULL JOIN pr USING (pos) WHERE pos <= 10""")
def side_by_side_topk(spark, d):
    out = summaries.side_by_side_topk(_run(spark, d, "A"), _run(spark, d, "R"), "Feature", "Mean")
    return rounded(out, "Mean_a", "Mean_b")


@query("common_topk", f"""{SERIES}, {_RUNS}, {_POS}
    SELECT Feature FROM pa WHERE pos <= 10 INTERSECT SELECT Feature FROM R WHERE Mean > 25.4""")
def common_topk(spark, d):
    kept = _run(spark, d, "R").withColumn("Support", F.col("Mean") > 25.4)
    return importance.compare_rankings(_run(spark, d, "A"), kept)


@query("common_features", f"""{SERIES}, {_RUNS}
    SELECT Feature FROM A WHERE Feature <> 'Brand#13' INTERSECT SELECT Feature FROM R""")
def common_features(spark, d):
    return importance.common_features(_run(spark, d, "A"), _run(spark, d, "R"), exclude=["Brand#13"])


@query("distinct_features", f"""{SERIES}, {_RUNS}
    SELECT Feature FROM A EXCEPT SELECT Feature FROM R WHERE Mean > 25.4""")
def distinct_features(spark, d):
    return importance.distinct_features(_run(spark, d, "A"), without=_run(spark, d, "R").filter("Mean > 25.4"))


@query("topk_long", f"""{SERIES}, {_RUNS}, w AS (SELECT A.Feature, A.Mean AS a, N.Mean AS n FROM A LEFT JOIN N USING (Feature)
        ORDER BY A.Mean DESC, Feature LIMIT 10)
    SELECT Feature, 'a' AS strategy, {r('a', 'score')} FROM w UNION ALL SELECT Feature, 'n', {r('n', 'score')} FROM w""")
def topk_long(spark, d):
    wide = importance.align({"a": _run(spark, d, "A"), "n": _run(spark, d, "N")}, "Feature", "Mean")
    return rounded(summaries.topk_long(wide, "Feature", "a", ["a", "n"], 10), "score")


@query("feature_pairs", """SELECT a.b AS feature_1, c.b AS feature_2, a.b || ' x ' || c.b AS label
    FROM (SELECT DISTINCT p_brand AS b FROM part) a JOIN (SELECT DISTINCT p_brand AS b FROM part) c ON a.b < c.b""")
def feature_pairs(spark, d):
    pairs = importance.feature_pairs(table(spark, d, "part"), "p_brand")
    return pairs.withColumn("label", text.pair_label("feature_1", "feature_2"))


_PAIRS = f"""{with_views('pairs')}, named AS (
    SELECT CASE WHEN feature_1 LIKE 'p\\_type\\_%' ESCAPE '\\' THEN 'p_type' WHEN feature_1 LIKE 'l\\_returnflag\\_%' ESCAPE '\\' THEN 'l_returnflag' ELSE feature_1 END AS p1,
           CASE WHEN feature_2 LIKE 'p\\_type\\_%' ESCAPE '\\' THEN 'p_type' WHEN feature_2 LIKE 'l\\_returnflag\\_%' ESCAPE '\\' THEN 'l_returnflag' ELSE feature_2 END AS p2,
           strength FROM pairs),
    sums AS (SELECT least(p1, p2) AS parent_1, greatest(p1, p2) AS parent_2, sum(strength) AS strength FROM named
             WHERE p1 <> p2 GROUP BY 1, 2)"""


def _parents(spark, d):
    """One-hot column to feature, from the level lists of the tables."""
    types = [x[0] for x in table(spark, d, "part").select("p_type").distinct().limit(10_001).collect()]
    flags = [x[0] for x in table(spark, d, "lineitem").select("l_returnflag").distinct().limit(10_001).collect()]
    if max(len(types), len(flags)) > 10_000:
        raise ValueError("too many levels")
    return {**{f"p_type_{t}": "p_type" for t in [*types, "none"]}, **{f"l_returnflag_{f}": "l_returnflag" for f in flags}}


@query("parent_pair_sums", f"""{_PAIRS}
    SELECT parent_1 || ' x ' || parent_2 AS interaction, parent_1, parent_2, {r('strength', 'strength')} FROM sums""")
def parent_pair_sums(spark, d):
    return rounded(treeshap.parent_interactions(view(spark, d, "pairs"), _parents(spark, d)), "strength")


@query("normalized_interactions", f"""{_PAIRS}, {with_views('effects').removeprefix('WITH ')},
    main AS (SELECT CASE WHEN feature LIKE 'p\\_type\\_%' ESCAPE '\\' THEN 'p_type' WHEN feature LIKE 'l\\_returnflag\\_%' ESCAPE '\\' THEN 'l_returnflag'
             ELSE feature END AS parent, sum(mean_abs_shap) AS e FROM effects GROUP BY 1)
    SELECT parent_1 || ' x ' || parent_2 AS interaction, {r('strength', 'strength')}, {r('a.e', 'main_1')}, {r('b.e', 'main_2')},
           {r('strength / ((a.e + b.e) / 2) * 100', 'relative_pct')}
    FROM sums JOIN main a ON a.parent = parent_1 JOIN main b ON b.parent = parent_2""")
def normalized_interactions(spark, d):
    parents = _parents(spark, d)
    sums = treeshap.parent_interactions(view(spark, d, "pairs"), parents)
    effects = treeshap.parent_effects(view(spark, d, "effects"), parents)
    out = treeshap.normalized_interactions(sums, effects)
    return rounded(out, "strength", "main_1", "main_2", "relative_pct")


# ---- summaries and chart tables ----

@query("group_stats", f"""{SURVEY} SELECT archetype, {r('avg(wall_thickness)', 'mean')}, {r('stddev_samp(wall_thickness)', 'std')},
    count(wall_thickness) AS n FROM survey GROUP BY archetype""")
def group_stats(spark, d):
    return rounded(summaries.group_stats(view(spark, d, "survey"), ["archetype"], "wall_thickness"), "mean", "std")


@query("value_counts", f"""SELECT event_type, count(*) AS count, {r('count(*) * 100.0 / (SELECT count(*) FROM events)', 'percent')}
    FROM events GROUP BY event_type""")
def value_counts(spark, d):
    return rounded(summaries.value_counts(table(spark, d, "events"), ["event_type"], normalize=True), "percent")


_PIVOT = ", ".join(f"count_if({_LABEL} = '{v}')::BIGINT AS \"{v}\"" for v in LEVELS)
_PCT = ", ".join(r(f"count_if({_LABEL} = '{v}') * 100.0 / nullif(count({_LABEL}), 0)", f'"{v}"') for v in LEVELS)


@query("crosstab", f"""{SURVEY} SELECT archetype, {_PIVOT} FROM survey WHERE {_LABEL} IS NOT NULL GROUP BY archetype""")
def crosstab(spark, d):
    return summaries.crosstab(labelled(spark, d), "archetype", "target", LEVELS)


@query("crosstab_pct", f"""{SURVEY} SELECT archetype, {_PCT} FROM survey WHERE {_LABEL} IS NOT NULL GROUP BY archetype""")
def crosstab_pct(spark, d):
    return rounded(summaries.crosstab_pct(labelled(spark, d), "archetype", "target", LEVELS), *LEVELS)


@query("group_share", f"""{SURVEY}, c AS (SELECT dataset_source, {_LABEL} AS target, count(*) AS count FROM survey
        WHERE {_LABEL} IS NOT NULL GROUP BY 1, 2)
    SELECT *, CAST(sum(count) OVER (PARTITION BY dataset_source) AS BIGINT) AS total,
           {r('count * 100.0 / sum(count) OVER (PARTITION BY dataset_source)', 'percentage')} FROM c""")
def group_share(spark, d):
    return rounded(summaries.group_share(labelled(spark, d), "dataset_source", "target"), "percentage")


@query("join_totals", """SELECT o_orderstatus, o_orderpriority, count(*) AS n, any_value(total) AS total FROM orders
    JOIN (SELECT o_orderstatus, count(*) AS total FROM orders GROUP BY 1) USING (o_orderstatus) GROUP BY 1, 2""")
def join_totals(spark, d):
    df = table(spark, d, "orders")
    counts = df.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return summaries.join_totals(counts, counts.groupBy("o_orderstatus").agg(F.sum("n").alias("total")), "o_orderstatus")


@query("frequent_groups_crosstab", """SELECT CAST(p_partkey AS BIGINT) AS l_partkey,
        """ + ", ".join(r(f"count_if(l_returnflag = '{v}') * 100.0 / count(*)", f'"{v}"') for v in "ANR") + """
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_partkey HAVING count(*) >= 25""")
def frequent_groups_crosstab(spark, d):
    return rounded(summaries.frequent_crosstab_pct(table(spark, d, "lineitem"), "l_partkey", "l_returnflag", list("ANR"), 25),
                   *"ANR")


@query("keep_frequent", """SELECT count(*) AS n, """ + r("sum(l_quantity)", "total") + """ FROM lineitem
    WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) >= 30)""")
def keep_frequent(spark, d):
    kept = summaries.keep_frequent(table(spark, d, "lineitem"), "l_partkey", 30)
    return rounded(kept.agg(F.count("*").alias("n"), F.coalesce(F.sum("l_quantity"), F.lit(None)).alias("total")), "total")


_PROP = ", ".join(r(f"count_if({_LABEL} = '{v}') / count({_LABEL})", f'"{v}"') for v in LEVELS)


@query("topk_groups_share", f"""{SURVEY} SELECT roof_shape_u, {_PROP} FROM survey WHERE {_LABEL} IS NOT NULL
    GROUP BY roof_shape_u ORDER BY count(*) DESC, roof_shape_u LIMIT 4""")
def topk_groups_share(spark, d):
    return rounded(summaries.top_groups_share(labelled(spark, d), "roof_shape_u", "target", LEVELS), *LEVELS)


_BAND = """CASE WHEN year_built_u < 1880 THEN 'Pre-1880' WHEN year_built_u < 1900 THEN '1880-1900'
    WHEN year_built_u < 1920 THEN '1900-1920' WHEN year_built_u < 1950 THEN '1920-1950' END"""


@query("age_band_crosstab", f"""{SURVEY} SELECT {_BAND} AS band, {_PCT} FROM survey WHERE {_LABEL} IS NOT NULL
    GROUP BY 1 HAVING band IS NOT NULL""")
def age_band_crosstab(spark, d):
    out = summaries.band_crosstab(labelled(spark, d), "year_built_u", [1880, 1900, 1920, 1950], "target", LEVELS)
    return rounded(out, *LEVELS)


@query("label_agreement", f"""{SURVEY}, l AS (SELECT {_LABEL} AS a, {_STATUS} AS b FROM survey WHERE {_LABEL} IS NOT NULL AND {_STATUS} IS NOT NULL)
    SELECT 'damage' AS source, a AS class, count(*) AS count FROM l GROUP BY a
    UNION ALL SELECT 'status', b, count(*) FROM l GROUP BY b""")
def label_agreement(spark, d):
    df = view(spark, d, "survey").select(clean.damage_label("degree_of_damage_u").alias("a"),
                                         clean.status_label("status_u").alias("b"))
    return summaries.label_agreement(df, {"damage": "a", "status": "b"})


@query("histogram_by_group", f"""{SURVEY} SELECT dataset_source, floor(year_built_u / 10) * 10.0::DOUBLE AS bin_start, count(*) AS count
    FROM survey WHERE year_built_u BETWEEN 1860 AND 1990 GROUP BY 1, 2""")
def histogram_by_group(spark, d):
    return summaries.histogram(view(spark, d, "survey"), "year_built_u", 10, ["dataset_source"], 1860, 1990)


@query("histogram_30_bins", """SELECT l_returnflag, CAST(least(floor((l_extendedprice - lo) * 30 / (hi - lo)), 29) AS INTEGER) AS bin,
    count(*) AS count FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) GROUP BY 1, 2""")
def histogram_30_bins(spark, d):
    out = summaries.histogram_bins(table(spark, d, "lineitem"), "l_extendedprice", 30, ["l_returnflag"])
    return out.withColumn("count", F.col("count").cast("long"))


@query("count_by_group", f"""{SURVEY} SELECT {_LABEL} AS target, dataset_source, count(*) AS count,
    CAST(CASE {_LABEL} WHEN 'Undamaged' THEN 0 WHEN 'Low' THEN 1 ELSE 2 END AS INTEGER) AS place
    FROM survey WHERE {_LABEL} IS NOT NULL GROUP BY 1, 2""")
def count_by_group(spark, d):
    return summaries.count_by(labelled(spark, d), "target", "dataset_source", LEVELS)


@query("class_size_labels", f"""{SURVEY} SELECT {_LABEL} || chr(10) || '(n=' || count(*) || ')' AS label FROM survey
    WHERE {_LABEL} IS NOT NULL GROUP BY {_LABEL}""")
def class_size_labels(spark, d):
    counts = summaries.value_counts(labelled(spark, d), ["target"])
    return counts.select(text.count_label("target", "count").alias("label"))


_BOX = f"""q AS (SELECT {{g}}, count({{v}}) AS n, quantile_cont({{v}}, 0.25) AS q1, median({{v}}) AS median,
    quantile_cont({{v}}, 0.75) AS q3 FROM {{t}} GROUP BY {{g}})"""


@query("box_stats", f"""{SURVEY}{_HAVERSINE_SQL}, lab AS (SELECT {_LABEL} AS target, distance_km FROM dist WHERE {_LABEL} IS NOT NULL),
    {_BOX.format(g='target', v='distance_km', t='lab')}
    SELECT target, any_value(n) AS n, {r('any_value(q1)', 'q1')}, {r('any_value(median)', 'median')}, {r('any_value(q3)', 'q3')},
      {r('min(CASE WHEN distance_km >= q1 - 1.5 * (q3 - q1) THEN distance_km END)', 'whisker_lo')},
      {r('max(CASE WHEN distance_km <= q3 + 1.5 * (q3 - q1) THEN distance_km END)', 'whisker_hi')},
      count_if(distance_km < q1 - 1.5 * (q3 - q1) OR distance_km > q3 + 1.5 * (q3 - q1))::BIGINT AS outliers
    FROM lab JOIN q USING (target) GROUP BY target""")
def box_stats(spark, d):
    """Distance to the track by damage class."""
    df = labelled(spark, d).select("target", geo.segment_distance_km(*PLACE).alias("distance_km"))
    return rounded(summaries.box_stats(df, "distance_km", ["target"]), "q1", "median", "q3", "whisker_lo", "whisker_hi")


@query("box_outliers", f"""WITH {_BOX.format(g='event_type', v='value', t='events')}
    SELECT event_type, value, count(*) AS n FROM events JOIN q USING (event_type)
    WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) GROUP BY 1, 2""")
def box_outliers(spark, d):
    return summaries.box_outliers(table(spark, d, "events"), "value", ["event_type"])


_POISSON = " + ".join(f"(u >= {p!r})::INT" for p in summaries._POISSON_CDF)


@query("bootstrap_mean_ci", f"""WITH w AS (SELECT c_mktsegment, rep, c_acctbal, {_POISSON} AS w FROM (
        SELECT c_mktsegment, rep, c_acctbal,
               (('0x' || substr(md5(c_custkey || ':' || rep // 4 || ':42'), 1 + 8 * (rep % 4), 8))::BIGINT + 0.5) / 4294967296.0 AS u
        FROM customer, (SELECT unnest(range(1000)) AS rep))),
    m AS (SELECT c_mktsegment, rep, sum(w * c_acctbal) / sum(w) AS m FROM w GROUP BY 1, 2),
    ci AS (SELECT c_mktsegment, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY 1)
    SELECT c_mktsegment, {r('avg(c_acctbal)', 'mean', 4)}, count(*) AS n, {r('any_value(lo)', 'ci_lo', 4)}, {r('any_value(hi)', 'ci_hi', 4)}
    FROM customer JOIN ci USING (c_mktsegment) GROUP BY 1""")
def bootstrap_mean_ci(spark, d):
    out = summaries.bootstrap_mean_ci(table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal", "c_custkey", 1000)
    return rounded(out, "mean", "ci_lo", "ci_hi", digits=4)


@query("distinct_values", "SELECT DISTINCT source FROM documents")
def distinct_values(spark, d):
    return summaries.distinct_values(table(spark, d, "documents"), "source")


@query("position_in_order", """SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS position FROM customer""")
def position_in_order(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return ordering.position(df, [F.desc("c_acctbal"), F.asc("c_custkey")]).select("c_custkey", "position")


@query("exact_quantiles", f"""SELECT l_returnflag, count(*) AS n, {r('quantile_cont(l_extendedprice, 0.1)', 'p10')},
    {r('median(l_extendedprice)', 'p50')}, {r('quantile_cont(l_extendedprice, 0.99)', 'p99')} FROM lineitem GROUP BY 1""")
def exact_quantiles(spark, d):
    out = ordering.exact_quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice",
                                   {"p10": 0.1, "p50": 0.5, "p99": 0.99})
    return rounded(out, "p10", "p50", "p99")
