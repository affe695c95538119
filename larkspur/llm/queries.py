"""Queries of this subpackage and the SQL that some of them can be held to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embeddings, licences, near_dedup
from .embeddings import op7_embeddings
from .fingerprint import op3_fingerprint
from .licences import op5_licences
from .near_dedup import op6_near_dedup
from .packing import op4_packing
from .quality import op8_quality
from .sentencepiece_codec import op1_sentencepiece
from .suffixes import op9_suffixes
from .token_count import op2_token_counts
from .toxicity import op10_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_token_counts": op2_token_counts,
        "op3_fingerprint": op3_fingerprint,
        "op4_packing": op4_packing,
        "op5_licences": op5_licences,
        "op6_near_dedup": op6_near_dedup,
        "op7_embeddings": op7_embeddings,
        "op8_quality": op8_quality,
        "op9_suffixes": op9_suffixes,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_licences": licences.oracle(),
        "op6_near_dedup": near_dedup.ORACLE,
        "op7_embeddings": embeddings.ORACLE,
    }
