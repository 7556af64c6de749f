from tabulon.sources.tables import (
    IMPORTANCE_SCHEMA,
    EQUIVALENCE_SCHEMA,
    SCORE_SCHEMA,
    columns_like,
    common_columns,
    drop_unnamed,
    export_features,
    first_row,
    header_is_data,
    normalize_columns,
    normalized_name,
    profile,
    read_results,
    read_survey,
    union_sources,
    with_source,
    write_table,
)
