"""All queries of this folder, in the order of their numbers."""

from tabulon.llm import (  # noqa: F401
    centroid_tables,
    cover_tree,
    cross_entropy,
    filter_audit,
    hamming,
    kneser_ney,
    line_dedup,
    mixing,
    padded_bpe,
    piece_dropout,
    shingle_join,
    token_counts,
    url_lists,
)
from tabulon.llm.registry import ORACLES, QUERIES  # noqa: F401
