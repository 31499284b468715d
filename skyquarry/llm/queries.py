"""The queries of this subpackage, and the SQL that some can be compared with."""

from __future__ import annotations

from .decontamination import op9_decontamination
from .gru_lm import op3_lm_score
from .language_id import op8_language_id
from .mixing import OP2_SQL, op2_mixing
from .quality_model import op5_quality_model
from .quality_rules import OP7_SQL, op7_quality_rules
from .repeats import op11_repeated_passages
from .secrets import op1_secrets
from .simhash import op6_simhash
from .toxicity import op4_toxicity
from .url_filter import OP10_SQL, op10_url_filter
from .variants import OP13_SQL, op13_spelling_variants
from .whitening import op12_whitening

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_mixing": op2_mixing,
    "op3_lm_score": op3_lm_score,
    "op4_toxicity": op4_toxicity,
    "op5_quality_model": op5_quality_model,
    "op6_simhash": op6_simhash,
    "op7_quality_rules": op7_quality_rules,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_url_filter": op10_url_filter,
    "op11_repeated_passages": op11_repeated_passages,
    "op12_whitening": op12_whitening,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLE_SQL = {"op2_mixing": OP2_SQL, "op7_quality_rules": OP7_SQL, "op10_url_filter": OP10_SQL, "op13_spelling_variants": OP13_SQL}
