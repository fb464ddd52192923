from .text import (
    citation,
    clean_text,
    extract_citations,
    overlap_count,
    overlap_ratio,
    register_sql_functions,
    split_on_period,
    split_sentences,
    strip,
    tokenize,
)
from .vector import cosine_similarity, dot_product, l2_norm, squared_distance

__all__ = [
    "citation",
    "clean_text",
    "cosine_similarity",
    "dot_product",
    "extract_citations",
    "l2_norm",
    "overlap_count",
    "overlap_ratio",
    "register_sql_functions",
    "split_on_period",
    "split_sentences",
    "squared_distance",
    "strip",
    "tokenize",
]
