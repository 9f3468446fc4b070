"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe_automaton import op4_bpe_automaton
from .embedding_dedup import op10_embedding_dedup
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .language import op8_language
from .license_scan import OP6_SQL, op6_license_scan
from .packing import op1_packing
from .quality import op13_quality
from .simhash import op7_simhash
from .site_tree import op2_site_tree
from .token_alignment import op12_token_alignment
from .token_rollup import op5_token_counts
from .url_filter import OP9_SQL, op9_url_filter
from .whitening import op11_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_packing,
        op2_site_tree,
        op3_exact_dedup,
        op4_bpe_automaton,
        op5_token_counts,
        op6_license_scan,
        op7_simhash,
        op8_language,
        op9_url_filter,
        op10_embedding_dedup,
        op11_whitening,
        op12_token_alignment,
        op13_quality,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op6_license_scan": OP6_SQL, "op9_url_filter": OP9_SQL}
