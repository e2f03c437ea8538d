"""Queries of this subpackage and the SQL that DuckDB answers them with."""

from stratabar.llm.bpe import op2_bpe
from stratabar.llm.chat_format import OP7_SQL, op7_chat_format
from stratabar.llm.decontaminate import op4_decontamination
from stratabar.llm.jaccard_join import op6_jaccard_join
from stratabar.llm.lang_id import op5_language_id
from stratabar.llm.quality import op10_quality_rules
from stratabar.llm.sharding import op8_sharding
from stratabar.llm.token_files import op3_token_files
from stratabar.llm.toxicity import op9_toxicity
from stratabar.llm.url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_bpe": op2_bpe,
    "op3_token_files": op3_token_files,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_chat_format": op7_chat_format,
    "op8_sharding": op8_sharding,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL = {
    "op1_url_filter": OP1_SQL,
    "op7_chat_format": OP7_SQL,
}
