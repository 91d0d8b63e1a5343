"""The queries of this subpackage, as the entry module registers them."""

from __future__ import annotations

from collections.abc import Callable

from .chat import op10_chat_format
from .fim import ORACLE as FIM_ORACLE
from .fim import op13_fill_in_middle
from .lang_id import op9_language_id
from .lm_score import op1_lm_score
from .minhash import op5_minhash_near_dedup
from .nn_descent import op7_nn_descent
from .packing import op6_best_fit_packing
from .quality import op4_quality_rules
from .sp_codec import op3_sentencepiece
from .spelling import op12_spelling_variants
from .suffix_dedup import op11_suffix_array_dedup
from .token_count import op8_token_count
from .toxicity import op2_toxicity


def queries() -> dict[str, Callable]:
    found = [op1_lm_score, op2_toxicity, op3_sentencepiece, op4_quality_rules, op5_minhash_near_dedup, op6_best_fit_packing, op7_nn_descent, op8_token_count, op9_language_id, op10_chat_format, op11_suffix_array_dedup, op12_spelling_variants, op13_fill_in_middle]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op13_fill_in_middle": FIM_ORACLE}
