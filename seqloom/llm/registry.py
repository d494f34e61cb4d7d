"""Queries of the training-data operators, and SQL where SQL can express them."""

from .delta_lloyd import OP11_SQL, op11_centroid_clustering
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .html_text import op10_html_extraction
from .language_id import op3_language_id
from .minhash_dedup import op7_minhash_dedup
from .mixing import op4_mixing
from .packing import op9_best_fit_packing
from .personal_data import op13_personal_data
from .quality import OP5_SQL, op5_quality_rules
from .secrets import op2_secret_scans
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .toxicity import op6_toxicity

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_secret_scans": op2_secret_scans,
    "op3_language_id": op3_language_id,
    "op4_mixing": op4_mixing,
    "op5_quality_rules": op5_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_html_extraction": op10_html_extraction,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_personal_data": op13_personal_data,
}
SQL = {
    "op1_substring_dedup": OP1_SQL,
    "op5_quality_rules": OP5_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op11_centroid_clustering": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
