"""The registered queries of this package and their DuckDB counterparts."""

from __future__ import annotations

from evalflow.llm import oracles
from evalflow.llm.alignment import op11_alignment
from evalflow.llm.decontamination import op1_decontamination
from evalflow.llm.fill_in_middle import op13_fill_in_middle
from evalflow.llm.jaccard import op8_jaccard_join
from evalflow.llm.mixing import op6_mixing
from evalflow.llm.neighbours import op3_nearest
from evalflow.llm.pii import op2_pii
from evalflow.llm.sharding import op7_sharding
from evalflow.llm.sketch_duplicates import op12_sketch_duplicates
from evalflow.llm.substrings import op4_substring_dedup
from evalflow.llm.token_counts import op9_token_counts
from evalflow.llm.token_files import op5_token_files
from evalflow.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_pii": op2_pii,
    "op3_nearest": op3_nearest,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_token_files": op5_token_files,
    "op6_mixing": op6_mixing,
    "op7_sharding": op7_sharding,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "op11_alignment": op11_alignment,
    "op12_sketch_duplicates": op12_sketch_duplicates,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: The others are compared with brute force, the library or held-out data in tests/llm.
ORACLES = {
    "op1_decontamination": oracles.DECONTAMINATION,
    "op4_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op8_jaccard_join": oracles.JACCARD_JOIN,
    "op11_alignment": op11_alignment,
    "op12_sketch_duplicates": oracles.SKETCH_DUPLICATES,
    "op13_fill_in_middle": oracles.FILL_IN_MIDDLE,
}
