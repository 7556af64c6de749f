"""Queries: reading, cleaning, geometry, encoding, folds, resampling."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabulon.functions import clean, geo, hashing, ratios, text
from tabulon.operators import columns, dictionary, encode, folds, neighbors, resample
from tabulon.plans.registry import query, r, rounded
from tabulon.plans.views import table, view, with_views
from tabulon.session import scratch_path
from tabulon.sources import (
    SCORE_SCHEMA,
    columns_like,
    common_columns,
    drop_unnamed,
    export_features,
    first_row,
    header_is_data,
    normalize_columns,
    profile,
    read_results,
    read_survey,
    union_sources,
    with_source,
    write_table,
)

SURVEY, CASES = with_views("survey"), with_views("cases")
PLACE = ("latitude", "longitude", "tornado_start_lat", "tornado_start_long", "tornado_end_lat", "tornado_end_long")


# ---- sources and schema ----

@query("normalize_union", """
    SELECT 'lines' AS dataset_source, count(*) AS n, count(l_quantity) AS n_quantity, 0::BIGINT AS n_price,
           CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM lineitem
    UNION ALL SELECT 'orders', count(*), 0, count(o_totalprice), CAST(sum(o_orderkey) AS BIGINT) FROM orders""")
def normalize_union(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias(" Order Key"), F.col("l_quantity").alias("Quan.tity"))
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("ORDER KEY"), F.col("o_totalprice").alias("Total Price"))
    both = union_sources(with_source(normalize_columns(a), "lines"), with_source(normalize_columns(b), "orders"))
    return both.groupBy("dataset_source").agg(
        F.count("*").alias("n"), F.count("quantity").alias("n_quantity"), F.count("total_price").alias("n_price"),
        F.sum("order_key").alias("key_sum"))


@query("common_columns", """
    SELECT o_orderkey AS key, count(*) AS n FROM (
        SELECT o_orderkey FROM orders UNION ALL SELECT l_orderkey FROM lineitem) GROUP BY o_orderkey""")
def common(spark, d):
    a = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "key")
    b = table(spark, d, "orders").withColumnRenamed("o_orderkey", "key")
    cols = common_columns(a, b)
    return union_sources(b.select(cols), a.select(cols)).groupBy(*cols).agg(F.count("*").alias("n"))


@query("survey_csv_round_trip", """
    SELECT c_mktsegment, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS key_sum,
           CAST(sum(length(c_name)) AS BIGINT) AS name_chars FROM customer GROUP BY c_mktsegment""")
def csv_round_trip(spark, d):
    """Write a latin-1 survey file with an index column, read it as text."""
    path = scratch_path(spark, "survey-csv")
    rows = table(spark, d, "customer").select(
        F.col("c_custkey").alias("Unnamed: 0"), F.col("c_custkey").alias("Cust Key"),
        F.concat(F.col("c_name"), F.lit("é")).alias("Name."), F.col("c_mktsegment").alias("c_mktsegment"))
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    back = drop_unnamed(normalize_columns(read_survey(spark, path, "ISO-8859-1")))
    return back.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.sum(F.col("cust_key").cast("long")).alias("key_sum"),
        F.sum(F.length(F.regexp_replace("name", "é$", ""))).alias("name_chars"))


@query("results_round_trip", f"""{with_views("scores")}
    SELECT Setting, Model, CAST(Fold AS INTEGER) AS Fold, {r('MacroF1', 'MacroF1')}, {r('Accuracy', 'Accuracy')}
    FROM scores""")
def results_round_trip(spark, d):
    path = scratch_path(spark, "scores-csv")
    write_table(view(spark, d, "scores"), path, "csv")
    return rounded(read_results(spark, path, SCORE_SCHEMA), "MacroF1", "Accuracy")


@query("export_features", f"""{SURVEY}
    SELECT archetype, count(*) AS n, {r('sum(wall_length_front)', 'front')}, count(wall_thickness) AS n_thickness
    FROM survey GROUP BY archetype""")
def export(spark, d):
    path = scratch_path(spark, "export")
    df = view(spark, d, "survey").select("archetype", "wall_length_front", "wall_thickness",
                                         F.lit(1).alias("unnamed:_7"))
    export_features(df, path, "parquet")
    back = spark.read.parquet(path)
    return rounded(back.groupBy("archetype").agg(
        F.count("*").alias("n"), F.sum("wall_length_front").alias("front"),
        F.count("wall_thickness").alias("n_thickness")), "front")


@query("columns_like", """SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority""")
def like(spark, d):
    df = table(spark, d, "orders")
    return df.groupBy(*columns_like(df, "PRIOR")).agg(F.count("*").alias("n"))


def _profile_sql(t: str, cols: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{k}' AS type, count(*) AS \"rows\", count({c}) AS non_null, "
        f"count(DISTINCT {c}) AS \"distinct\", min(CAST({c} AS VARCHAR)) AS min_value FROM {t}" for c, k in cols.items())


@query("profile_columns", _profile_sql("customer", {
    "c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double",
    "c_mktsegment": "string"}))
def profile_columns(spark, d):
    return profile(table(spark, d, "customer"))


@query("profile_counts", """
    SELECT "column", type, "rows", non_null, min_value FROM (""" + _profile_sql("orders", {
    "o_orderkey": "bigint", "o_orderstatus": "string", "o_orderpriority": "string"}) + ")")
def profile_counts(spark, d):
    """One plain pass, without distinct counts."""
    return profile(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), distinct=False)


@query("first_rows", """
    WITH f AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 1)
    SELECT 'plain' AS source, i::INTEGER AS position, n AS "column", v AS value, false AS header FROM (SELECT
        unnest(range(5)) AS i, unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS n,
        unnest([c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR, c_acctbal::VARCHAR, c_mktsegment]) AS v FROM f)
    UNION ALL SELECT 'headless', i::INTEGER, '_c' || i, n, true FROM (SELECT
        unnest(range(5)) AS i, unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS n)""")
def first_rows(spark, d):
    """First row of a source with a header, and of its file read as if it had none: there the row repeats the names."""
    customer = table(spark, d, "customer")
    plain, path = customer.orderBy("c_custkey"), scratch_path(spark, "headless")
    write_table(plain.limit(100).coalesce(1), path, "csv")
    headless = spark.read.csv(path)
    parts = []
    for name, df, order in (("plain", customer, [F.col("c_custkey")]), ("headless", headless, [])):
        test = header_is_data(headless if name == "headless" else plain, customer.columns)
        parts.append(first_row(df, order).select(F.lit(name).alias("source"), "position", "column", "value", F.lit(test).alias("header")))
    return parts[0].unionByName(parts[1])


@query("export_engineered", f"""{SURVEY}
    SELECT archetype, count(*) AS n, count(aspect) AS n_aspect, {r('sum(aspect)', 'aspect')}, {r('sum(slender)', 'slender')},
           count(CASE WHEN lower(trim(occupany_u)) IN ('un', 'unknown', 'n/a', 'na') THEN NULL ELSE occupany_u END) AS n_occupied
    FROM (SELECT *, buidling_height_m / nullif(least(wall_length_front, wall_length_side), 0) AS aspect,
                 buidling_height_m * 1000 / nullif(wall_thickness, 0) AS slender FROM survey) GROUP BY archetype""")
def export_engineered(spark, d):
    """The cleaned and engineered table, written and read back."""
    path = scratch_path(spark, "engineered")
    df = ratios.geometric_ratios(clean.clean_unknowns(view(spark, d, "survey"))).withColumn("unnamed:_7", F.lit(1))
    export_features(df, path, "parquet")
    back = spark.read.parquet(path)
    return rounded(back.groupBy("archetype").agg(
        F.count("*").alias("n"), F.count("aspect_ratio").alias("n_aspect"), F.sum("aspect_ratio").alias("aspect"),
        F.sum("wall_slenderness").alias("slender"), F.count("occupany_u").alias("n_occupied")), "aspect", "slender")


# ---- cleaning and predicates ----

@query("clean_unknowns", f"""{SURVEY}, cleaned AS (SELECT
        CASE WHEN lower(trim(occupany_u)) IN ('un', 'unknown', 'n/a', 'na') THEN NULL ELSE occupany_u END AS occupany_u,
        CASE WHEN lower(trim(status_u)) IN ('un', 'unknown', 'n/a', 'na') THEN NULL ELSE status_u END AS status_u
        FROM survey)
    SELECT occupany_u, status_u, count(*) AS n FROM cleaned GROUP BY occupany_u, status_u""")
def clean_unknowns(spark, d):
    df = clean.clean_reader_nulls(clean.clean_unknowns(view(spark, d, "survey").select("occupany_u", "status_u")))
    return df.groupBy("occupany_u", "status_u").agg(F.count("*").alias("n"))


_READ = """CASE l_linenumber WHEN 1 THEN 'NaN' WHEN 2 THEN '#N/A' WHEN 3 THEN 'null' WHEN 4 THEN 'nan ' WHEN 5 THEN '' WHEN 6 THEN '<NA>'
    ELSE l_returnflag END"""


@query("clean_reader_nulls", f"""SELECT word, count(*) AS n FROM (SELECT CASE WHEN l_linenumber IN (1, 2, 3, 5, 6) THEN NULL
    ELSE {_READ} END AS word FROM lineitem) GROUP BY word""")
def clean_reader_nulls(spark, d):
    """Tokens that a reader takes for null; they are matched as they are, without trimming."""
    df = clean.clean_reader_nulls(table(spark, d, "lineitem").select(F.expr(_READ).alias("word")))
    return df.groupBy("word").agg(F.count("*").alias("n"))


@query("to_numeric_strip", f"""{SURVEY}, v AS (
        SELECT dataset_source, TRY_CAST(replace(replace(area_text, ',', ''), ' ', '') AS DOUBLE) AS x FROM survey)
    SELECT dataset_source, count(*) AS n, count(x) AS n_numbers, {r('sum(x)', 'total')} FROM v GROUP BY dataset_source""")
def to_numeric_strip(spark, d):
    df = view(spark, d, "survey").withColumn("x", clean.to_numeric("area_text"))
    return rounded(df.groupBy("dataset_source").agg(
        F.count("*").alias("n"), F.count("x").alias("n_numbers"), F.sum("x").alias("total")), "total")


@query("damage_label", f"""{SURVEY}
    SELECT CASE WHEN degree_of_damage_u = 0 THEN 'Undamaged' WHEN degree_of_damage_u = 1 THEN 'Low'
                WHEN degree_of_damage_u >= 2 THEN 'Significant' END AS target,
           CAST(CASE WHEN degree_of_damage_u = 0 THEN 0 WHEN degree_of_damage_u = 1 THEN 1
                WHEN degree_of_damage_u >= 2 THEN 2 END AS INTEGER) AS code, count(*) AS n
    FROM survey GROUP BY 1, 2""")
def damage_label(spark, d):
    return view(spark, d, "survey").groupBy(
        clean.damage_label("degree_of_damage_u").alias("target"), clean.damage_code("degree_of_damage_u").alias("code")
    ).agg(F.count("*").alias("n"))


@query("status_label", f"""{SURVEY}
    SELECT CASE WHEN lower(trim(status_u)) = 'undamaged' THEN 'Undamaged' WHEN lower(trim(status_u)) = 'minor' THEN 'Low'
                WHEN lower(trim(status_u)) IN ('moderate', 'severe', 'destroyed') THEN 'Significant' END AS target,
           count(*) AS n FROM survey GROUP BY 1 HAVING target IS NOT NULL""")
def status_label(spark, d):
    labelled = view(spark, d, "survey").withColumn("target", clean.status_label("status_u")).na.drop(subset=["target"])
    return labelled.groupBy("target").agg(F.count("*").alias("n"))


@query("parse_ef", f"""{SURVEY}, v AS (SELECT CASE WHEN lower(trim(tornado_ef)) = 'subef' THEN -1
        ELSE CAST(trunc(TRY_CAST(replace(lower(trim(tornado_ef)), 'ef', '') AS DOUBLE)) AS INTEGER) END AS ef FROM survey)
    SELECT CAST(ef AS INTEGER) AS ef_numeric, CASE WHEN ef = -1 THEN 'sub' ELSE CAST(ef AS VARCHAR) END AS shown,
           count(*) AS n FROM v GROUP BY ef""")
def parse_ef(spark, d):
    df = view(spark, d, "survey").withColumn("ef_numeric", clean.parse_ef("tornado_ef"))
    return df.groupBy("ef_numeric", clean.ef_display("ef_numeric").alias("shown")).agg(F.count("*").alias("n"))


@query("truthy_count", f"""{SURVEY}
    SELECT dataset_source, count_if(lower(trim(located_in_historic_district)) IN ('yes', 'y', 'true', '1'))::BIGINT AS n
    FROM survey GROUP BY dataset_source""")
def truthy_count(spark, d):
    return view(spark, d, "survey").groupBy("dataset_source").agg(
        F.count_if(clean.is_truthy("located_in_historic_district")).alias("n"))


_STAT_COLS = ("wall_thickness", "wall_fenestration_per_n", "wall_fenestration_per_w", "year_built_u")


@query("drop_all_null", f"""{SURVEY} """ + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, min({c}) + 0.0 AS min, max({c}) + 0.0 AS max FROM survey"
    for c in _STAT_COLS))
def drop_all_null(spark, d):
    df = view(spark, d, "survey").select(*_STAT_COLS, F.lit(None).cast("double").alias("first_floor_elevation_m"))
    kept = columns.drop_all_null(df, df.columns)
    return columns.column_stats(kept, kept.columns)


@query("missing_flags", f"""{SURVEY}
    SELECT CAST(wall_thickness IS NULL AS INTEGER) AS wall_thickness_is_missing,
           CAST(wall_fenestration_per_w IS NULL AS INTEGER) AS wall_fenestration_per_w_is_missing, count(*) AS n
    FROM survey GROUP BY 1, 2""")
def missing_flags(spark, d):
    df = columns.add_missing_flag(view(spark, d, "survey"), ["wall_thickness", "wall_fenestration_per_w"])
    return df.groupBy("wall_thickness_is_missing", "wall_fenestration_per_w_is_missing").agg(F.count("*").alias("n"))


_MISS = {"wall_thickness": "Numeric", "wall_fenestration_per_n": "Numeric", "wall_fenestration_per_w": "Numeric",
         "year_built_u": "Numeric", "archetype": "Categorical", "occupany_u": "Categorical"}
_MISS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS Feature, count_if({'lower(trim(occupany_u)) IN (' + chr(39) + 'un' + chr(39) + ',' + chr(39) + 'n/a' + chr(39) + ')' if c == 'occupany_u' else c + ' IS NULL'})::BIGINT AS Missing_Count, '{k}' AS Type, count(*) AS total FROM survey"
    for c, k in _MISS.items())


@query("missingness_report", f"""{SURVEY}
    SELECT Feature, Missing_Count, {r('Missing_Count * 100.0 / total', 'Missing_Percent')}, Type FROM ({_MISS_SQL})""")
def missingness_report(spark, d):
    df = clean.clean_unknowns(view(spark, d, "survey"), cols=["archetype", "occupany_u"])
    return rounded(columns.missingness_report(df, list(_MISS), ["archetype", "occupany_u"]), "Missing_Percent")


@query("missingness_order", f"""{SURVEY}
    SELECT row_number() OVER (ORDER BY Missing_Count DESC, Feature) AS place, Feature, Missing_Count FROM ({_MISS_SQL})""")
def missingness_order(spark, d):
    """The report's rows in the order it returns them."""
    df = clean.clean_unknowns(view(spark, d, "survey"), cols=["archetype", "occupany_u"])
    report = columns.missingness_report(df, list(_MISS), ["archetype", "occupany_u"]).select("Feature", "Missing_Count")
    return report.select(F.collect_list(F.struct("Feature", "Missing_Count")).alias("l")).select(
        F.posexplode("l").alias("at", "r")).select((F.col("at") + 1).cast("long").alias("place"), "r.*")


# ---- geometry and ratios ----

_HAVERSINE_SQL = """, foot AS (
    SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE
           greatest(0, least(1, ((longitude - x1) * dx + (latitude - y1) * dy) / nullif(dx * dx + dy * dy, 0))) END AS t
    FROM (SELECT *, tornado_start_long AS x1, tornado_start_lat AS y1, tornado_end_long - tornado_start_long AS dx,
                 tornado_end_lat - tornado_start_lat AS dy FROM survey)),
    arc AS (SELECT *, pow(sin(radians(y1 + t * dy - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(y1 + t * dy))
                  * pow(sin(radians(x1 + t * dx - longitude) / 2), 2) AS a FROM foot),
    dist AS (SELECT *, 2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)) AS distance_km FROM arc)"""


@query("segment_distance_haversine", f"""{SURVEY}{_HAVERSINE_SQL}
    SELECT l_orderkey, l_partkey, l_linenumber, dataset_source, {r('distance_km', 'distance_km')} FROM dist""")
def segment_distance_haversine(spark, d):
    df = view(spark, d, "survey").withColumn("distance_km", geo.segment_distance_km(*PLACE))
    return rounded(df.select("l_orderkey", "l_partkey", "l_linenumber", "dataset_source", "distance_km"), "distance_km")


@query("point_distance", f"""{SURVEY}, arc AS (SELECT dataset_source,
        pow(sin(radians(tornado_end_lat - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(tornado_end_lat))
        * pow(sin(radians(tornado_end_long - longitude) / 2), 2) AS a FROM survey)
    SELECT dataset_source, {r('avg(2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)))', 'mean_km')},
           {r('max(2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)))', 'max_km')} FROM arc GROUP BY dataset_source""")
def point_distance(spark, d):
    km = geo.haversine_km("latitude", "longitude", "tornado_end_lat", "tornado_end_long")
    return rounded(view(spark, d, "survey").groupBy("dataset_source").agg(
        F.avg(km).alias("mean_km"), F.max(km).alias("max_km")), "mean_km", "max_km")


@query("segment_distance_planar", f"""{SURVEY}, km AS (SELECT *,
        111.0 * cos(radians((tornado_start_lat + tornado_end_lat + latitude) / 3)) AS s FROM survey),
    flat AS (SELECT *, longitude * s AS px, latitude * 111.0 AS py, tornado_start_long * s AS x1, tornado_start_lat * 111.0 AS y1,
             tornado_end_long * s - tornado_start_long * s AS dx, tornado_end_lat * 111.0 - tornado_start_lat * 111.0 AS dy FROM km),
    foot AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE
             greatest(0, least(1, ((px - x1) * dx + (py - y1) * dy) / nullif(dx * dx + dy * dy, 0))) END AS t FROM flat)
    SELECT l_orderkey, l_partkey, l_linenumber, dataset_source,
           {r('sqrt(pow(px - x1 - t * dx, 2) + pow(py - y1 - t * dy, 2))', 'distance_km')} FROM foot""")
def segment_distance_planar(spark, d):
    df = view(spark, d, "survey").withColumn("distance_km", geo.segment_distance_km(*PLACE, method="planar"))
    return rounded(df.select("l_orderkey", "l_partkey", "l_linenumber", "dataset_source", "distance_km"), "distance_km")


_RATIO_SQL = {
    "min_dimension": "least(wall_length_front, wall_length_side)",
    "max_dimension": "greatest(wall_length_front, wall_length_side)",
    "perimeter": "2 * (wall_length_front + wall_length_side)",
    "total_wall_area": "2 * (wall_length_front + wall_length_side) * buidling_height_m",
    "aspect_ratio": "buidling_height_m / nullif(least(wall_length_front, wall_length_side), 0)",
    "wall_slenderness": "buidling_height_m * 1000 / nullif(wall_thickness, 0)",
    "roof_wall_ratio": "building_area_m2 / nullif(2 * (wall_length_front + wall_length_side) * buidling_height_m, 0)",
    "parapet_slenderness": "parapet_height_m * 1000 / nullif(wall_thickness, 0)",
    "plan_aspect_ratio": "greatest(wall_length_front, wall_length_side) / nullif(least(wall_length_front, wall_length_side), 0)",
}


@query("geometric_ratios", f"""{SURVEY}
    SELECT dataset_source, {', '.join(f"count({e}) AS n_{n}, {r(f'avg({e})', n)}" for n, e in _RATIO_SQL.items())}
    FROM survey GROUP BY dataset_source""")
def geometric_ratios(spark, d):
    df = ratios.geometric_ratios(view(spark, d, "survey"))
    names = list(_RATIO_SQL)
    return rounded(df.groupBy("dataset_source").agg(
        *[F.count(n).alias(f"n_{n}") for n in names], *[F.avg(n).alias(n) for n in names]), *names)


@query("row_mean_fenestration", f"""{SURVEY}, v AS (SELECT dataset_source,
        (coalesce(wall_fenestration_per_n, 0) + coalesce(wall_fenestration_per_s, 0) + coalesce(wall_fenestration_per_e, 0)
         + coalesce(wall_fenestration_per_w, 0)) / nullif((wall_fenestration_per_n IS NOT NULL)::INT
         + (wall_fenestration_per_s IS NOT NULL)::INT + (wall_fenestration_per_e IS NOT NULL)::INT
         + (wall_fenestration_per_w IS NOT NULL)::INT, 0) AS m FROM survey)
    SELECT dataset_source, {r('m', 'mean_fenestration')}, count(*) AS n FROM v GROUP BY 1, 2""")
def row_mean_fenestration(spark, d):
    df = view(spark, d, "survey").withColumn("mean_fenestration", ratios.row_mean(ratios.FENESTRATION))
    return rounded(df, "mean_fenestration").groupBy("dataset_source", "mean_fenestration").agg(F.count("*").alias("n"))


def _u(s: str, word: int = 0) -> str:
    return f"((('0x' || substr(md5({s}), {8 * word + 1}, 8))::BIGINT + 0.5) / 4294967296.0)"


@query("noise_probe", f"""
    SELECT o_orderkey, {r(f"sqrt(-2 * ln({_u('o_orderkey || chr(58) || 42')})) * cos(2 * pi() * {_u('o_orderkey || chr(58) || 42', 1)})", 'random_noise')}
    FROM orders""")
def noise_probe(spark, d):
    return rounded(hashing.add_noise(table(spark, d, "orders").select("o_orderkey"), "o_orderkey"), "random_noise")


@query("split_sentences", None)
def split_sentences(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(
        text.split_sentences("text", whole_words=False)).alias("pos", "sentence"))
    return docs


_ABBR = "text"
for _i, _a in enumerate(text.ABBREVIATIONS):
    _ABBR = f"replace({_ABBR}, '{_a}', '{_a[:-1]}' || chr(1))"
_WS = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
from tabulon.plans.registry import ORACLES  # noqa: E402

_ABBR_WORDS = "text"
for _a in text.ABBREVIATIONS:
    _dots = _a[:-1].replace(".", "[.]")
    _ABBR_WORDS = f"regexp_replace({_ABBR_WORDS}, '(^|[^\\p{{L}}\\p{{N}}_])({_dots})[.]', '\\1\\2' || chr(1), 'g')"
_SENTENCES = """
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos,
           replace(s, chr(1), '.') AS sentence FROM (
        SELECT doc_id, unnest(parts) AS s, unnest(range(len(parts))) AS i FROM (
            SELECT doc_id, string_split(regexp_replace(%s, '([.?!])%s+', '\\1' || chr(2), 'g'), chr(2)) AS parts
            FROM documents)) WHERE s <> ''"""
ORACLES["split_sentences"] = _SENTENCES % (_ABBR, _WS)


@query("split_sentences_words", _SENTENCES % (_ABBR_WORDS, _WS))
def split_sentences_words(spark, d):
    """The default mode: an abbreviation protects only when it is a word of its own."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.split_sentences("text")).alias("pos", "sentence"))



# ---- encoding and imputation ----

@query("label_encode", f"""{CASES}
    SELECT target, CAST(dense_rank() OVER (ORDER BY target) - 1 AS DOUBLE) AS label, count(*) AS n
    FROM cases GROUP BY target""")
def label_encode(spark, d):
    df, _ = encode.encode_label(view(spark, d, "cases"), "target")
    return df.groupBy("target", "label").agg(F.count("*").alias("n"))


_OCC = "CASE WHEN lower(trim(occupany_u)) IN ('un', 'n/a') THEN NULL ELSE occupany_u END"


@query("ordinal_encode", f"""{SURVEY}, v AS (SELECT {_OCC} AS o FROM survey)
    SELECT CAST(dense_rank() OVER (ORDER BY coalesce(o, 'nan')) - 1 AS DOUBLE) AS occupany_u, count(*) AS n
    FROM v GROUP BY coalesce(o, 'nan')""")
def ordinal_encode(spark, d):
    df = clean.clean_unknowns(view(spark, d, "survey").select("occupany_u"))
    return encode.ordinal_encode(df, ["occupany_u"])[0].groupBy("occupany_u").agg(F.count("*").alias("n"))


@query("ordinal_encode_keep_null", f"""{SURVEY}, v AS (SELECT {_OCC} AS o FROM survey)
    SELECT CASE WHEN o IS NOT NULL THEN CAST(dense_rank() OVER (ORDER BY o NULLS LAST) - 1 AS DOUBLE) END AS occupany_u,
           count(*) AS n FROM v GROUP BY o""")
def ordinal_encode_keep_null(spark, d):
    df = clean.clean_unknowns(view(spark, d, "survey").select("occupany_u"))
    return encode.ordinal_encode(df, ["occupany_u"], keep_null=True)[0].groupBy("occupany_u").agg(F.count("*").alias("n"))


@query("one_hot_counts", f"""{CASES}, v AS (
        SELECT 'lang' AS parent, lang AS level, count(*) AS n FROM cases GROUP BY lang
        UNION ALL SELECT 'source', source, count(*) FROM cases GROUP BY source)
    SELECT parent, parent || '_' || level AS "column", n FROM (
        SELECT *, row_number() OVER (PARTITION BY parent ORDER BY level) AS i FROM v) WHERE i > 1""")
def one_hot_counts(spark, d):
    df, hot = encode.one_hot(view(spark, d, "cases"), ["lang", "source"])
    one = df.agg(*[F.sum(c).cast("long").alias(c) for c in hot.columns])
    long = one.unpivot([], hot.columns, "column", "n")
    return long.select(text.parent_of("column", hot.parents).alias("parent"), "column", "n")


_IMPUTE = ("wall_thickness", "wall_fenestration_per_n", "building_area_m2")


@query("impute_median", f"""{SURVEY}, m AS (SELECT {', '.join(f'median({c}) AS m_{c}' for c in _IMPUTE)} FROM survey)
    SELECT dataset_source, {', '.join(r(f'sum(coalesce({c}, m_{c}))', c, 4) for c in _IMPUTE)},
           {', '.join(r(f'max(m_{c})', f'median_{c}') for c in _IMPUTE)}
    FROM survey, m GROUP BY dataset_source""")
def impute_median(spark, d):
    df, fitted = encode.impute_median(view(spark, d, "survey").select("dataset_source", *_IMPUTE), _IMPUTE)
    out = df.groupBy("dataset_source").agg(
        *[F.sum(c).alias(c) for c in _IMPUTE], *[F.lit(fitted[c]).alias(f"median_{c}") for c in _IMPUTE])
    return rounded(rounded(out, *_IMPUTE, digits=4), *[f"median_{c}" for c in _IMPUTE])


@query("impute_const", f"""{SURVEY}, v AS (SELECT {_OCC} AS o FROM survey)
    SELECT coalesce(o, 'missing') AS occupany_u, count(*) AS n FROM v GROUP BY 1""")
def impute_const(spark, d):
    df = encode.impute_const(clean.clean_unknowns(view(spark, d, "survey").select("occupany_u")), ["occupany_u"])
    return df.groupBy("occupany_u").agg(F.count("*").alias("n"))


@query("impute_iterative")
def impute_iterative(spark, d):
    df, _ = encode.ordinal_encode(view(spark, d, "cases"), ["lang", "source"], keep_null=True)
    cols = ["n_chars", "n_blanks", "n_lines", "lang", "source"]
    df = df.withColumn("lang", F.when(F.col("n_lines").isNotNull() | (F.col("n_chars") > 500), F.col("lang")))
    return rounded(encode.impute_iterative(df.select("doc_id", *cols), cols, codes=["lang", "source"]),
                   "n_lines")


@query("impute_iterative_known", f"""{CASES}
    SELECT doc_id, n_chars, n_blanks, n_lines, n_lines IS NULL AS was_gap, true AS complete FROM cases""")
def impute_iterative_known(spark, d):
    """Known values come through unchanged and every gap is filled."""
    df = view(spark, d, "cases").select("doc_id", "n_chars", "n_blanks", "n_lines")
    df = df.withColumn("was_gap", F.col("n_lines").isNull())
    out = encode.impute_iterative(df, ["n_chars", "n_blanks", "n_lines"])
    known = F.when(~F.col("was_gap"), F.col("n_lines"))
    return out.select("doc_id", "n_chars", "n_blanks", known.alias("n_lines"), "was_gap",
                      F.col("n_lines").isNotNull().alias("complete"))


@query("dictionary_codes", """
    SELECT l_orderkey, l_linenumber, (dense_rank() OVER (ORDER BY l_orderkey::VARCHAR) - 1)::DOUBLE AS code, p.place::INTEGER AS place
    FROM lineitem JOIN (SELECT s, dense_rank() OVER (ORDER BY s) - 2 AS place FROM (SELECT DISTINCT both_flags AS s FROM (
        SELECT l_returnflag || l_linestatus AS both_flags FROM lineitem))) p ON p.s = l_returnflag || l_linestatus""")
def dictionary_codes(spark, d):
    """A column with as many levels as orders, and the place of a sparse one-hot vector (-1: the first level)."""
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").cast("string").alias("code"),
                                            F.concat("l_returnflag", "l_linestatus").alias("s"))
    coded = dictionary.dictionary_encode(df, {"code": dictionary.fit_dictionary(df, "code")})
    hot, _ = dictionary.sparse_one_hot(coded, ["s"])
    at = F.array_position(vector_to_array("s_hot"), F.lit(1.0)).cast("int") - 1
    return hot.select("l_orderkey", "l_linenumber", "code", at.alias("place"))


def _evidence_steps(name: str, moments: str) -> str:
    """Evidence maximisation with one predictor, as a recursion over its scalars."""
    return f"""
    {name}_e AS (SELECT 0 AS k, 0e0 AS w, 1e0 / (yy / n + 2.220446049250313e-16) AS alpha, 1e0 AS lam, 1e300 AS moved FROM {moments}
        UNION ALL
        SELECT k + 1, v, (n - used + 2e-6) / (greatest(yy - 2 * v * xy + v * v * xx, 0) + 2e-6), (used + 2e-6) / (v * v + 2e-6), abs(w - v)
        FROM (SELECT *, xy * alpha / (lam + alpha * xx) AS v, alpha * xx / (lam + alpha * xx) AS used FROM {name}_e, {moments}
              WHERE k < 300 AND moved >= 1e-3)),
    {name} AS (SELECT w, my - mx * w AS shift FROM (SELECT xy * alpha / (lam + alpha * xx) AS w, mx, my FROM {name}_e, {moments}
        ORDER BY k DESC LIMIT 1))"""


def _moments(x: str, y: str, where: str, source: str) -> str:
    return f"""(SELECT count(*) AS n, avg({x}) AS mx, avg({y}) AS my, sum({x} * {x}) - count(*) * avg({x}) * avg({x}) AS xx,
        sum({x} * {y}) - count(*) * avg({x}) * avg({y}) AS xy, sum({y} * {y}) - count(*) * avg({y}) * avg({y}) AS yy FROM {source} WHERE {where})"""


@query("impute_one_round", f"""{CASES.replace("WITH ", "WITH RECURSIVE ", 1)},
    t AS (SELECT doc_id, CASE WHEN doc_id % 50 <> 1 THEN n_blanks END AS a, n_lines AS b FROM cases),
    c AS (SELECT avg(a) AS ma, avg(b) AS mb FROM t),
    z AS (SELECT doc_id, a IS NULL AS na, b IS NULL AS nb, coalesce(a - ma, 0) AS a, coalesce(b - mb, 0) AS b FROM t, c),
    g1 AS {_moments("b", "a", "NOT na", "z")}, {_evidence_steps("q1", "g1")},
    y AS (SELECT doc_id, na, nb, CASE WHEN na THEN shift + w * b ELSE a END AS a, b FROM z, q1),
    g2 AS {_moments("a", "b", "NOT nb", "y")}, {_evidence_steps("q2", "g2")}
    SELECT doc_id, {r("a + ma", "a", 4)}, {r("CASE WHEN nb THEN shift + w * a ELSE b END + mb", "b", 4)} FROM y, q2, c""")
def impute_one_round(spark, d):
    """Filled values of two columns with gaps after one round."""
    gap = F.when(F.col("doc_id") % 50 != 1, F.col("n_blanks"))
    df = view(spark, d, "cases").select("doc_id", gap.alias("a"), F.col("n_lines").alias("b"))
    return rounded(encode.impute_iterative(df, ["a", "b"], rounds=1), "a", "b", digits=4)


@query("class_weights", """
    SELECT o_orderpriority, count(*) AS n, """ + r(
    "(SELECT count(*) FROM orders) / (CAST((SELECT count(DISTINCT o_orderpriority) FROM orders) AS DOUBLE) * count(*))",
    "weight") + " FROM orders GROUP BY o_orderpriority")
def class_weights(spark, d):
    return rounded(encode.class_weights(table(spark, d, "orders"), "o_orderpriority"), "weight")


# ---- folds and resampling ----

@query("stratified_folds", """
    SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderstatus, md5(o_orderkey || ':0:42'), o_orderkey) - 1) % 5
           AS INTEGER) AS fold FROM orders""")
def stratified_folds(spark, d):
    return folds.stratified_folds(table(spark, d, "orders"), "o_orderkey", "o_orderstatus", 5)


@query("repeated_folds", f"""{CASES}
    SELECT doc_id, CAST(rep AS INTEGER) AS repeat, CAST((row_number() OVER (PARTITION BY rep
           ORDER BY target, md5(doc_id || ':' || rep || ':42'), doc_id) - 1) % 5 AS INTEGER) AS fold
    FROM cases, (SELECT unnest(range(5)) AS rep)""")
def repeated_folds(spark, d):
    return folds.repeated_folds(view(spark, d, "cases"), "doc_id", "target", 5, 5)


@query("first_split", """
    SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM (SELECT o_orderkey, (row_number() OVER (
        ORDER BY o_orderstatus, md5(o_orderkey || ':0:42'), o_orderkey) - 1) % 5 AS fold FROM orders) WHERE fold = 0""")
def first_split(spark, d):
    made = folds.stratified_folds(table(spark, d, "orders"), "o_orderkey", "o_orderstatus", 5)
    return folds.first_split(made).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))


@query("permute_column", """
    WITH a AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS i
               FROM orders),
         b AS (SELECT o_orderstatus, o_totalprice,
                      row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || ':42'), o_orderkey) AS i FROM orders)
    SELECT a.o_orderkey, a.o_orderstatus, b.o_totalprice FROM a JOIN b USING (o_orderstatus, i)""")
def permute_column(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return folds.permute_column(df, "o_orderkey", "o_totalprice", ["o_orderstatus"])


_CODED = f"""{CASES}, coded AS (SELECT doc_id, target, n_chars, n_blanks, lang, source FROM cases),
    pen AS (SELECT target, (stddev_pop(n_chars) + stddev_pop(n_blanks)) / 2 AS p FROM coded GROUP BY target)"""


@query("smotenc_neighbors", f"""{_CODED}, pairs AS (
        SELECT a.doc_id, b.doc_id AS neighbor, pow(a.n_chars - b.n_chars, 2) + pow(a.n_blanks - b.n_blanks, 2)
               + ((a.lang <> b.lang)::INT + (a.source <> b.source)::INT) * (p * p) AS d2
        FROM coded a JOIN coded b ON a.target = b.target AND a.doc_id <> b.doc_id JOIN pen ON pen.target = a.target),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d2, neighbor) AS rank FROM pairs)
    SELECT doc_id, CAST(rank AS INTEGER) AS rank, neighbor, {r('sqrt(d2)', 'distance', 4)} FROM ranked WHERE rank <= 5""")
def smotenc_neighbors(spark, d):
    df, _ = encode.ordinal_encode(view(spark, d, "cases"), ["lang", "source"])
    near = neighbors.neighbor_table(df, "doc_id", "target", ["n_chars", "n_blanks"], ["lang", "source"], 5)
    return rounded(near, "distance", digits=4)


_WIDE, _WIDE_CODES = [f"m{i}" for i in range(30)], ["c0", "c1"]


@query("smotenc_neighbors_wide", f"""{with_views("order_profile")},
    pen AS (SELECT o_orderstatus, (SELECT median(v) FROM (SELECT unnest([{", ".join(f"stddev_pop({c})" for c in _WIDE)}]) AS v)) AS p
            FROM order_profile GROUP BY 1),
    best AS (SELECT a.o_orderkey, min({{'d2': {" + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _WIDE)}
                 + ({" + ".join(f"(a.{c} <> b.{c})::INT" for c in _WIDE_CODES)}) * (p * p), 'k': b.o_orderkey}}, 5) AS near
             FROM order_profile a JOIN order_profile b ON a.o_orderstatus = b.o_orderstatus AND a.o_orderkey <> b.o_orderkey
             JOIN pen ON pen.o_orderstatus = a.o_orderstatus GROUP BY 1)
    SELECT o_orderkey, i::INTEGER AS rank, near[i].k AS neighbor, {r('sqrt(near[i].d2)', 'distance', 4)}
    FROM best, (SELECT unnest(range(1, 6)) AS i) WHERE i <= len(near)""")
def smotenc_neighbors_wide(spark, d):
    """Thirty numbers and two codes; classes above the cell size go by pivots."""
    near = neighbors.neighbor_table(view(spark, d, "order_profile"), "o_orderkey", "o_orderstatus", _WIDE, _WIDE_CODES, 5, cell_rows=256)
    return rounded(near, "distance", digits=4)


@query("smotenc_rows", f"""{_CODED},
    ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d2, neighbor) AS rank FROM (
        SELECT a.doc_id, b.doc_id AS neighbor, b.n_chars, b.n_blanks, b.lang, b.source,
               pow(a.n_chars - b.n_chars, 2) + pow(a.n_blanks - b.n_blanks, 2) + ((a.lang <> b.lang)::INT + (a.source <> b.source)::INT) * (p * p) AS d2
        FROM coded a JOIN coded b ON a.target = b.target AND a.doc_id <> b.doc_id JOIN pen ON pen.target = a.target)) WHERE rank <= 5),
    modes AS (SELECT doc_id, (SELECT lang FROM ranked i WHERE i.doc_id = o.doc_id GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1) AS lang,
        (SELECT source FROM ranked i WHERE i.doc_id = o.doc_id GROUP BY source ORDER BY count(*) DESC, source LIMIT 1) AS source
        FROM (SELECT DISTINCT doc_id FROM ranked) o),
    sizes AS (SELECT target, count(*) AS n, max(count(*)) OVER () - count(*) AS need FROM coded GROUP BY target),
    turns AS (SELECT doc_id, target, n_chars, n_blanks, need // n + ((row_number() OVER (PARTITION BY target ORDER BY md5(doc_id || ':42'), doc_id) - 1) < need % n)::INT AS t
        FROM coded JOIN sizes USING (target)),
    made AS (SELECT *, md5(doc_id || ':' || s || ':42') AS d FROM (SELECT *, unnest(range(1, t + 1)) AS s FROM turns)),
    drawn AS (SELECT *, (('0x' || substr(d, 1, 8))::BIGINT + 0.5) / 4294967296.0 AS gap,
        floor((('0x' || substr(d, 9, 8))::BIGINT + 0.5) / 4294967296.0 * 5) + 1 AS pick FROM made)
    SELECT target, {r('w.n_chars + gap * (k.n_chars - w.n_chars)', 'n_chars', 4)}, {r('w.n_blanks + gap * (k.n_blanks - w.n_blanks)', 'n_blanks', 4)},
        (SELECT count(DISTINCT lang) FROM coded c WHERE c.lang < m.lang) * 1e0 AS lang,
        (SELECT count(DISTINCT source) FROM coded c WHERE c.source < m.source) * 1e0 AS source
    FROM drawn w JOIN ranked k ON k.doc_id = w.doc_id AND k.rank = w.pick JOIN modes m ON m.doc_id = w.doc_id""")
def smotenc_rows(spark, d):
    """The synthetic rows themselves: places between neighbours and most frequent codes."""
    df, _ = encode.ordinal_encode(view(spark, d, "cases"), ["lang", "source"])
    more = resample.smotenc(df, "doc_id", "target", ["n_chars", "n_blanks"], ["lang", "source"], 5)
    new = more.filter("synthetic").select("target", "n_chars", "n_blanks", *[F.col(c).cast("double").alias(c) for c in ("lang", "source")])
    return rounded(new, "n_chars", "n_blanks", digits=4)


@query("smotenc_counts", f"""{CASES}, c AS (SELECT target, count(*) AS n FROM cases GROUP BY target)
    SELECT target, false AS synthetic, n FROM c
    UNION ALL SELECT target, true, (SELECT max(n) FROM c) - n FROM c WHERE n < (SELECT max(n) FROM c)""")
def smotenc_counts(spark, d):
    df, _ = encode.ordinal_encode(view(spark, d, "cases"), ["lang", "source"])
    more = resample.smotenc(df, "doc_id", "target", ["n_chars", "n_blanks"], ["lang", "source"], 5)
    return more.groupBy("target", "synthetic").agg(F.count("*").alias("n"))


@query("smote_counts", """WITH c AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment)
    SELECT c_mktsegment, (SELECT max(n) FROM c) AS n FROM c""")
def smote_counts(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal",
                                            F.col("c_nationkey").cast("double").alias("c_nationkey"))
    more = resample.smote(df, "c_custkey", "c_mktsegment", ["c_acctbal", "c_nationkey"], 5)
    return more.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


