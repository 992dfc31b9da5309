"""The queries of this package, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import alignment, bpe, html, jpeg, lexical, licenses, mixing, ngrams, quality, sharding, substrings, toxicity, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bradley_terry_quality": quality.op1_bradley_terry_quality,
        "op2_source_mix": mixing.op2_source_mix,
        "op3_byte_bpe": bpe.op3_byte_bpe,
        "op4_template_extraction": html.op4_template_extraction,
        "op5_hash_tree_shards": sharding.op5_hash_tree_shards,
        "op6_jpeg_media": jpeg.op6_jpeg_media,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_license_templates": licenses.op8_license_templates,
        "op10_ngram_jaccard": ngrams.op10_ngram_jaccard,
        "op11_super_kmer_dedup": substrings.op11_super_kmer_dedup,
        "op12_bit_sliced_search": lexical.op12_bit_sliced_search,
        "op13_token_alignment": alignment.op13_token_alignment,
        "op9_epsilon_grid_join": vectors.op9_epsilon_grid_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mix": mixing.OP2_SQL, "op8_license_templates": licenses.OP8_SQL, "op12_bit_sliced_search": lexical.OP12_SQL, "op9_epsilon_grid_join": vectors.OP9_SQL}
