"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import ORACLE as DECONTAMINATION
from .decontaminate import op1_decontamination
from .exact import ORACLE as EXACT
from .exact import op12_exact_dedup
from .html import op10_html_extraction
from .jaccard import ORACLE as JACCARD
from .jaccard import op6_jaccard
from .language import op9_lm_score
from .lines import ORACLE as LINES
from .lines import op7_line_dedup
from .media import op8_media_gif
from .packing import op3_packing
from .quality import op4_quality
from .repair import op11_conversation_repair
from .secrets import op5_secrets
from .secrets import oracle as secrets_oracle
from .toxicity import op2_toxicity
from .vectors import op13_vector_codes

ORACLES: dict[str, str] = {
    "op1_decontamination": DECONTAMINATION,
    "op5_secrets": secrets_oracle(),
    "op6_jaccard": JACCARD,
    "op7_line_dedup": LINES,
    "op12_exact_dedup": EXACT,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_decontamination,
        op2_toxicity,
        op3_packing,
        op4_quality,
        op5_secrets,
        op6_jaccard,
        op7_line_dedup,
        op8_media_gif,
        op9_lm_score,
        op10_html_extraction,
        op11_conversation_repair,
        op12_exact_dedup,
        op13_vector_codes,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
