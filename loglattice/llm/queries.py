"""The registered queries of this subpackage; ``pipeline`` applies the stages of corpus_pipeline.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_text, linetree, nbsvm, packing, periodic, phrases, quality_rules, radix, secrets, simhash, toxicity, variants
from .common import tidied


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the repository's top

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {
        "op1_decontamination": decontaminate.op1,
        "op2_substring_dedup": phrases.op2,
        "op3_html_extraction": html_text.op3,
        "op4_simhash_near_dedup": simhash.op4,
        "op5_secret_scan": secrets.op5,
        "op6_suffix_dedup": radix.op6,
        "op7_line_dedup": linetree.op7,
        "op8_quality_rules": quality_rules.op8,
        "op9_quality_classifier": nbsvm.op9,
        "op10_packing": packing.op10,
        "op11_periodic_runs": periodic.op11,
        "op12_spelling_variants": variants.op12,
        "op13_toxicity": toxicity.op13,
    }
    return {name: tidied(query) for name, query in own.items()} | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    """SQL can express none of these on whole tables in reasonable time; they are tested against brute force."""
    return {}
