"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import attribution, decontaminate, language, lattice, neardup, packing, repeats, sharding, token_files, topk

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_topk": topk.op2_topk,
    "op3_language_id": language.op3_language_id,
    "op4_packing": packing.op4_packing,
    "op5_repeats": repeats.op5_repeats,
    "op6_lattice": lattice.op6_lattice,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_neardup": neardup.op8_neardup,
    "op9_token_files": token_files.op9_token_files,
    "op10_token_counts": attribution.op10_token_counts,
}

ORACLE_SQL = {
    "op2_topk": topk.OP2_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
}
