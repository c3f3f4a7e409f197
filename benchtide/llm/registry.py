"""The queries of this subpackage and their SQL twins, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, exact_dedup, fill_in_middle, html_extract, jaccard, language_model, license_scan, packing, quality, repeats, secret_scan, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": language_model.op1_lm_scoring,
    "op2_packing": packing.op2_packing,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_suffix_array_dedup": repeats.op4_suffix_array_dedup,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_html_extraction": html_extract.op9_html_extraction,
    "op10_ngram_jaccard_join": jaccard.op10_ngram_jaccard_join,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
}

ORACLES: dict[str, str] = {"op7_exact_dedup": exact_dedup.OP7_SQL, "op12_fill_in_middle": fill_in_middle.OP12_SQL}
