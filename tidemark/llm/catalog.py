"""The queries of this subpackage, and the SQL of those that SQL can express."""
from __future__ import annotations

from tidemark.llm import chaining, decontamination, imatch, importance, jaccard, mixing, secrets, spans, style_tree, token_files

QUERIES = {
    "op1_style_tree": style_tree.op1_style_tree,
    "op10_passages": chaining.op10_passages,
    "op6_substrings": spans.op6_substrings,
    "op2_jaccard": jaccard.op2_jaccard,
    "op8_imatch": imatch.op8_imatch,
    "op9_importance": importance.op9_importance,
    "op3_token_files": token_files.op3_token_files,
    "op4_secrets": secrets.op4_secrets,
    "op5_decontamination": decontamination.op5_decontamination,
    "op7_mixing": mixing.op7_mixing,
}
ORACLE_SQL = {
    "op4_secrets": secrets.OP4_SQL,
    "op2_jaccard": jaccard.OP2_SQL,
    "op6_substrings": spans.OP6_SQL,
    "op5_decontamination": decontamination.OP5_SQL,
    "op7_mixing": mixing.OP7_SQL,
}
