"""Views over the benchmark tables in the shape the operators expect.

Each view is one SELECT that Spark and the checking engine both understand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "labels")

VIEWS = {
    # A building survey with unknown words, odd numbers and two tracks.
    "survey": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
               CASE WHEN l_linestatus = 'O' THEN 'east' ELSE 'west' END AS dataset_source,
               CASE WHEN l_quantity < 40 THEN 0e0 WHEN l_quantity < 43 THEN 1e0
                    WHEN l_quantity < 45 THEN 1.5e0 ELSE floor((l_quantity - 41) / 2) * 1e0 END AS degree_of_damage_u,
               CASE o_orderpriority WHEN '1-URGENT' THEN ' Destroyed ' WHEN '2-HIGH' THEN 'severe'
                    WHEN '3-MEDIUM' THEN 'Minor' WHEN '5-LOW' THEN 'undamaged' ELSE ' Unknown ' END AS status_u,
               CASE l_linenumber WHEN 1 THEN 'subEF' WHEN 2 THEN 'EF0' WHEN 3 THEN ' EF2 ' WHEN 4 THEN '2.7'
                    WHEN 5 THEN 'EFx' WHEN 6 THEN 'n/a' ELSE '3' END AS tornado_ef,
               36 + (l_partkey % 997) / 997e0 AS latitude,
               -87 + (l_orderkey % 991) / 991e0 AS longitude,
               CASE WHEN l_linestatus = 'O' THEN 36.1e0 ELSE 36.6e0 END AS tornado_start_lat,
               CASE WHEN l_linestatus = 'O' THEN -86.9e0 ELSE -86.5e0 END AS tornado_start_long,
               CASE WHEN l_linestatus = 'O' THEN 36.3e0 ELSE 36.6e0 END AS tornado_end_lat,
               CASE WHEN l_linestatus = 'O' THEN -86.2e0 ELSE -86.5e0 END AS tornado_end_long,
               p_size * 1e0 AS wall_length_front,
               l_quantity AS wall_length_side,
               round(l_tax * 100) + 0e0 AS buidling_height_m,
               nullif(l_linenumber * 50, 50) * 1e0 AS wall_thickness,
               l_extendedprice / 100 AS building_area_m2,
               l_discount + 0e0 AS parapet_height_m,
               nullif(round(l_discount * 100) + 0e0, 0e0) AS wall_fenestration_per_n,
               nullif(round(l_tax * 100) + 0e0, 0e0) AS wall_fenestration_per_s,
               nullif(l_linenumber, 3) * 10e0 AS wall_fenestration_per_e,
               CASE WHEN p_size >= 10 THEN p_size * 1e0 END AS wall_fenestration_per_w,
               1850e0 + l_partkey % 150 AS year_built_u,
               concat(CAST(CAST(floor(l_extendedprice / 1000) AS BIGINT) AS STRING), ',',
                      lpad(CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS STRING), 3, '0'),
                      CASE l_linenumber WHEN 6 THEN 'x' WHEN 7 THEN ' ' ELSE '' END) AS area_text,
               CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN ' Un ' WHEN '1-URGENT' THEN 'N/A'
                    ELSE o_orderpriority END AS occupany_u,
               CASE WHEN l_linenumber = 2 THEN 'Yes ' WHEN l_linenumber = 3 THEN 'y' WHEN l_linenumber = 4 THEN '1'
                    ELSE 'no' END AS located_in_historic_district,
               p_type AS archetype, p_brand AS roof_shape_u
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {orders} ON l_orderkey = o_orderkey
    """,
    # The table the models learn from: three classes, most rows undamaged.
    "cases": """
        SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'Significant' WHEN quality = 0 THEN 'Low' ELSE 'Undamaged' END AS target,
               n_chars * 1e0 AS n_chars,
               (length(text) - length(replace(text, ' ', ''))) * 1e0 AS n_blanks,
               nullif(length(text) - length(replace(text, chr(10), '')), 0) * 1e0 AS n_lines,
               lang, source
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
    """,
    "scores": """
        SELECT l_linestatus AS Setting, l_returnflag AS Model, l_linenumber AS Fold,
               avg(l_discount) AS MacroF1, avg(l_extendedprice) / 100000 AS Accuracy
        FROM {lineitem} GROUP BY l_linestatus, l_returnflag, l_linenumber
    """,
    "pred": """
        SELECT l_linenumber AS fold, l_returnflag AS y,
               CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 30 THEN l_returnflag
                    WHEN l_quantity < 48 THEN 'N' ELSE 'Z' END AS yhat
        FROM {lineitem}
    """,
    "importance": """
        SELECT l_linestatus AS Setting, l_returnflag AS Model, p_brand AS Feature, CAST(p_size % 10 AS INT) AS Fold,
               avg(l_extendedprice) / 100000 - 0.52e0 AS Decrease_in_Accuracy
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
        GROUP BY l_linestatus, l_returnflag, p_brand, p_size % 10
    """,
    # Mean importance of each feature under each of three strategies; some gaps.
    "series": """
        SELECT l_returnflag AS run, p_brand AS Feature, avg(l_quantity) AS Mean
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
        WHERE NOT (l_returnflag = 'R' AND p_type = 'ECONOMY' AND p_brand = 'Brand#3')
        GROUP BY l_returnflag, p_brand
        HAVING NOT (l_returnflag = 'A' AND p_brand = 'Brand#7') AND NOT (l_returnflag = 'N' AND p_brand = 'Brand#9')
    """,
    # One row per order: 30 measures of comparable size and two codes.
    "order_profile": """
        SELECT o_orderkey, o_orderstatus, o_totalprice / 100000 AS m0, year(o_orderdate) - 1990e0 AS m1,
               month(o_orderdate) / 4e0 AS m2, day(o_orderdate) / 10e0 AS m3, p.*,
               CAST(substr(o_orderpriority, 1, 1) AS INT) * 1e0 AS c0, n_lines * 1e0 AS c1
        FROM {orders} JOIN (
            SELECT l_orderkey, count(*) AS n_lines,
                   sum(l_quantity) / 100 AS m4, min(l_quantity) / 20 AS m5, max(l_quantity) / 20 AS m6,
                   sum(l_quantity) / count(*) / 20 AS m7,
                   sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 1e7 AS m8, min(l_extendedprice) / 20000 AS m9,
                   max(l_extendedprice) / 20000 AS m10,
                   sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / count(*) / 2e6 AS m11,
                   sum(CAST(round(l_discount * 100) AS BIGINT)) / 2e1 AS m12, min(l_discount) * 20 AS m13,
                   max(l_discount) * 20 AS m14, sum(CAST(round(l_discount * 100) AS BIGINT)) / count(*) / 4e0 AS m15,
                   sum(CAST(round(l_tax * 100) AS BIGINT)) / 2e1 AS m16, min(l_tax) * 20 AS m17, max(l_tax) * 20 AS m18,
                   sum(CAST(round(l_tax * 100) AS BIGINT)) / count(*) / 4e0 AS m19,
                   sum(CASE WHEN l_returnflag = 'A' THEN 1e0 ELSE 0e0 END) AS m20,
                   sum(CASE WHEN l_returnflag = 'N' THEN 1e0 ELSE 0e0 END) AS m21,
                   sum(CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END) AS m22,
                   sum(CASE WHEN l_linestatus = 'O' THEN 1e0 ELSE 0e0 END) AS m23,
                   sum(CASE WHEN l_quantity > 25 THEN 1e0 ELSE 0e0 END) AS m24,
                   sum(CASE WHEN l_discount > 0.05 THEN 1e0 ELSE 0e0 END) AS m25,
                   min(l_partkey % 97) / 30e0 AS m26, max(l_partkey % 97) / 30e0 AS m27,
                   min(l_suppkey % 13) / 4e0 AS m28, max(l_suppkey % 13) / 4e0 AS m29
            FROM {lineitem} GROUP BY l_orderkey) p ON o_orderkey = l_orderkey
    """,
    # Strength of pairs of one-hot columns.
    "pairs": """
        SELECT concat('p_type_', p_type) AS feature_1, concat('l_returnflag_', l_returnflag) AS feature_2,
               avg(l_discount) AS strength
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY p_type, l_returnflag
        UNION ALL
        SELECT concat('l_returnflag_', l_returnflag) AS feature_1, 'l_tax' AS feature_2, avg(l_tax) AS strength
        FROM {lineitem} GROUP BY l_returnflag
        UNION ALL
        SELECT concat('p_type_', p_type) AS feature_1, 'p_type_none' AS feature_2, avg(p_retailprice) AS strength
        FROM {part} GROUP BY p_type
    """,
    # Mean absolute main effect of each of those columns.
    "effects": """
        SELECT concat('p_type_', p_type) AS feature, avg(l_discount) AS mean_abs_shap
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY p_type
        UNION ALL
        SELECT concat('l_returnflag_', l_returnflag) AS feature, avg(l_tax) AS mean_abs_shap
        FROM {lineitem} GROUP BY l_returnflag
        UNION ALL
        SELECT 'l_tax' AS feature, avg(l_tax) * 2 AS mean_abs_shap FROM {lineitem}
    """,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def with_views(*names: str) -> str:
    """WITH clause that defines the views for the checking engine."""
    parts = []
    for n in names:
        text = VIEWS[n]
        for t in TABLES:
            text = text.replace("{" + t + "}", t)
        parts.append(f"{n} AS ({text.replace(' AS STRING', ' AS VARCHAR')})")
    return "WITH " + ", ".join(parts)
