"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from .chat_format import OP11_SQL, op11_chat_format
from .cover_tree import OP12_SQL, op12_vector_codes
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .html_wrappers import op6_html_wrappers
from .language_id import op2_language_id
from .minhash import op10_minhash_near_dedup
from .packing import op3_best_fit_packing
from .pii import op1_pii
from .quality_rules import op4_quality_rules
from .sentence_pieces import op7_sentence_pieces
from .sharding import op9_feistel_sharding
from .source_audit import OP13_SQL, op13_source_audit
from .suffix_dedup import op8_suffix_dedup

QUERIES = {
    "op1_pii": op1_pii,
    "op2_language_id": op2_language_id,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_html_wrappers": op6_html_wrappers,
    "op7_sentence_pieces": op7_sentence_pieces,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_feistel_sharding": op9_feistel_sharding,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_chat_format": op11_chat_format,
    "op12_vector_codes": op12_vector_codes,
    "op13_source_audit": op13_source_audit,
}

SQL = {
    "op5_exact_dedup": OP5_SQL,
    "op11_chat_format": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_source_audit": OP13_SQL,
}
