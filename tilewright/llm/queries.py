"""The queries of this subpackage and the SQL that they can be held against."""

from . import byte_bpe, fingerprints, line_dedup, mixing, near_dup, nearest, quality, token_files, toxicity, url_filter

QUERIES = {
    "op1_document_fingerprints": fingerprints.query,
    "op2_nearest_neighbours": nearest.query,
    "op3_token_files": token_files.query,
    "op4_source_mixing": mixing.query,
    "op5_line_dedup": line_dedup.query,
    "op6_quality_network": quality.query,
    "op7_near_duplicates": near_dup.query,
    "op8_url_filters": url_filter.query,
    "op9_byte_bpe": byte_bpe.query,
    "op10_toxicity_neighbours": toxicity.query,
}

ORACLES = {"op8_url_filters": url_filter.oracle()}
