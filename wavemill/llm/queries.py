"""The queries and SQL that __spark_entry__.py adds if this subpackage can be imported."""

from __future__ import annotations

from .bpe import op9_byte_bpe
from .chat import OP1_SQL, op1_chat_formatting
from .decontaminate import op4_benchmark_decontamination
from .jaccard import op5_ngram_jaccard_join
from .language import op3_language_id
from .licenses import op8_license_scan
from .merkle import OP11_SQL, op11_merkle_manifest
from .quality import op10_quality_rules
from .repair import OP12_SQL, op12_conversation_repair
from .sharding import OP2_SQL, op2_hilbert_sharding
from .substrings import OP7_SQL, op7_substring_dedup
from .toxicity import op6_toxicity
from .urls import OP13_SQL, op13_url_filters

QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_hilbert_sharding, op3_language_id, op4_benchmark_decontamination, op5_ngram_jaccard_join, op6_toxicity, op7_substring_dedup, op8_license_scan, op9_byte_bpe, op10_quality_rules, op11_merkle_manifest, op12_conversation_repair, op13_url_filters)}
SQL: dict[str, str] = {"op1_chat_formatting": OP1_SQL, "op2_hilbert_sharding": OP2_SQL, "op7_substring_dedup": OP7_SQL, "op11_merkle_manifest": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_url_filters": OP13_SQL}
