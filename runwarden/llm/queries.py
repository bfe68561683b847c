"""The queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from .alignment import op11_alignment
from .bpe import op7_bpe
from .embedding import op4_embedding_ego
from .exact import OP9_SQL, op9_exact_dedup
from .mixing import OP6_SQL, op6_mixing
from .quality import op8_quality
from .runs import op13_periodic_runs
from .secrets import op5_secrets
from .simhash import op10_simhash
from .suffix_array import op2_substring_suffix_array
from .suffix_tree import op1_substring_suffix_tree
from .toxicity import op12_toxicity
from .urls import op3_url_filter

QUERIES = {
    "op1_substring_suffix_tree": op1_substring_suffix_tree,
    "op2_substring_suffix_array": op2_substring_suffix_array,
    "op3_url_filter": op3_url_filter,
    "op4_embedding_ego": op4_embedding_ego,
    "op5_secrets": op5_secrets,
    "op6_mixing": op6_mixing,
    "op7_bpe": op7_bpe,
    "op8_quality": op8_quality,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_simhash": op10_simhash,
    "op11_alignment": op11_alignment,
    "op12_toxicity": op12_toxicity,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE = {"op6_mixing": OP6_SQL, "op9_exact_dedup": OP9_SQL}
