"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""
from . import bpe, near_dedup, packing, quality_neighbours, quality_rules, sharding, substring_dedup, tiff, toxicity, url_filters

QUERIES = {f.__name__: f for f in (
    quality_rules.op1_quality_rules, url_filters.op2_url_filters, packing.op3_packing, substring_dedup.op4_substring_dedup,
    toxicity.op5_toxicity, tiff.op6_tiff, bpe.op7_byte_bpe, quality_neighbours.op8_quality, near_dedup.op9_near_dedup, sharding.op10_sharding)}

ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE, "op2_url_filters": url_filters.ORACLE,
    "op4_substring_dedup": substring_dedup.ORACLE, "op10_sharding": sharding.ORACLE}
