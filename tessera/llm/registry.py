"""Queries of this package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .audio import op10_media_audio
from .forest import op3_embedding_near_dedup
from .html import op7_html_extraction
from .language import op6_language_id
from .lines import OP2_SQL, op2_line_dedup
from .packing import op1_best_fit_packing
from .secrets import op4_secret_scan
from .simhash import op5_simhash_near_dedup
from .toxicity import op8_toxicity
from .transducer import op9_sentencepiece_wfst

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_line_dedup,
        op3_embedding_near_dedup,
        op4_secret_scan,
        op5_simhash_near_dedup,
        op6_language_id,
        op7_html_extraction,
        op8_toxicity,
        op9_sentencepiece_wfst,
        op10_media_audio,
    )
}

ORACLE_SQL: dict[str, str] = {"op2_line_dedup": OP2_SQL}
