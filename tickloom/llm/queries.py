"""Queries of this subpackage: one ``opN_<name>`` for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import audio, bpe, huffman, jaccard, langid, lattice, licences, mixing, pii, quality
from tickloom.llm.common import documents


def _over_documents(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice_score": _over_documents(lattice.op1_lattice_score),
    "op10_jaccard_join": _over_documents(jaccard.op10_jaccard_join),
    "op2_quality_rules": _over_documents(quality.op2_quality_rules),
    "op3_byte_bpe": _over_documents(bpe.op3_byte_bpe),
    "op4_huffman_ids": _over_documents(huffman.op4_huffman_ids),
    "op5_mix_sources": _over_documents(mixing.op5_mix_sources),
    "mix_taken_words": _over_documents(mixing.taken_words),
    "op6_pii_pseudonyms": _over_documents(pii.op6_pii_pseudonyms),
    "op7_licence_scan": _over_documents(licences.op7_licence_scan),
    "op8_audio_features": _over_documents(audio.op8_audio_features),
    "op9_language_id": _over_documents(langid.op9_language_id),
}

ORACLE: dict[str, str] = {"mix_taken_words": mixing.TAKEN_SQL}
