"""The queries of this subpackage and, where SQL can state them, their DuckDB SQL."""

from __future__ import annotations

from . import (op1_ngram_join, op2_toxicity, op3_html, op4_language, op5_spotsigs, op6_mixing, op7_decontaminate,
               op8_chat, op9_token_files, op10_sharding, op11_vector_codes, op12_filter_audit, op13_bpe)

_MODULES = (op1_ngram_join, op2_toxicity, op3_html, op4_language, op5_spotsigs, op6_mixing, op7_decontaminate, op8_chat,
            op9_token_files, op10_sharding, op11_vector_codes, op12_filter_audit, op13_bpe)

QUERIES = {m.NAME: m.query for m in _MODULES}
ORACLE_SQL = {m.NAME: m.SQL for m in _MODULES if m.SQL is not None}
