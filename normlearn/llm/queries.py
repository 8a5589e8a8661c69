"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from . import exact_dedup, licenses, lm_scoring, media, mixing, near_dup, packing, quality, token_counts, token_files
from .ship import ship


def _shipped(query):
    """A query whose tasks run Python: they need the package, and batches bounded in bytes."""

    def run(spark, sf_dir: str):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {
        "op1_source_mix": mixing.op1_source_mix,
        "op2_packing": _shipped(packing.op2_packing),
        "op3_token_counts": _shipped(token_counts.op3_token_counts),
        "op4_token_files": _shipped(token_files.op4_token_files),
        "op5_quality": _shipped(quality.op5_quality),
        "op6_licenses": licenses.op6_licenses,
        "op7_lm_scoring": _shipped(lm_scoring.op7_lm_scoring),
        "op8_near_dup": _shipped(near_dup.op8_near_dup),
        "op9_media": _shipped(media.op9_media),
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_source_mix": mixing.oracle(),
        "op7_lm_scoring": lm_scoring.ORACLE,
        "op8_near_dup": near_dup.ORACLE,
        "op10_exact_dedup": exact_dedup.ORACLE,
    }
