"""The queries of this subpackage and the SQL that states the same, where SQL can."""

from __future__ import annotations

from .decontamination import OP8_SQL, op8_decontamination
from .fingerprints import op7_fingerprints
from .language import op3_language_id
from .lines import op10_line_dedup
from .lm_scoring import OP2_SQL, op2_lm_scoring
from .near_duplicates import op6_simhash_components
from .packing import op5_best_fit_packing
from .phrases import OP12_SQL, op12_phrases
from .prefix_trie import op13_prefix_trie
from .substrings import OP1_SQL, op1_substring_dedup
from .token_output import op9_token_output
from .toxicity import op11_toxicity
from .warc import op4_warc

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_language_id": op3_language_id,
    "op4_warc": op4_warc,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_simhash_components": op6_simhash_components,
    "op7_fingerprints": op7_fingerprints,
    "op8_decontamination": op8_decontamination,
    "op9_token_output": op9_token_output,
    "op10_line_dedup": op10_line_dedup,
    "op11_toxicity": op11_toxicity,
    "op12_phrases": op12_phrases,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": OP1_SQL, "op2_lm_scoring": OP2_SQL, "op8_decontamination": OP8_SQL, "op12_phrases": OP12_SQL}
