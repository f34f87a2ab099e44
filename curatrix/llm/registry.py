"""What the subpackage adds to the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curatrix.llm.bilinear import op9_bilinear_lm
from curatrix.llm.images import op10_image_copies
from curatrix.llm.importance import op11_importance
from curatrix.llm.mixing import op4_pfair_mix
from curatrix.llm.nbsvm import op6_nbsvm_quality
from curatrix.llm.periodic import op12_periodic_runs
from curatrix.llm.pieces import op5_sentencepiece
from curatrix.llm.ppm import op13_ppm_language
from curatrix.llm.quality_rules import op7_quality_rules
from curatrix.llm.secrets import ORACLE_SQL, op2_secret_ledger
from curatrix.llm.simhash import op8_simhash
from curatrix.llm.toxicity import op1_nnpu_toxicity
from curatrix.llm.urls import op3_url_words


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_nnpu_toxicity": op1_nnpu_toxicity,
        "op2_secret_ledger": op2_secret_ledger,
        "op3_url_words": op3_url_words,
        "op4_pfair_mix": op4_pfair_mix,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_nbsvm_quality": op6_nbsvm_quality,
        "op7_quality_rules": op7_quality_rules,
        "op8_simhash": op8_simhash,
        "op9_bilinear_lm": op9_bilinear_lm,
        "op10_image_copies": op10_image_copies,
        "op11_importance": op11_importance,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_ppm_language": op13_ppm_language,
    }


def oracle_sql() -> dict[str, str]:
    """The ledger's rows only: fitted models, components, tokenization and the schedule are not expressible."""
    return {"op2_secret_ledger": ORACLE_SQL}
