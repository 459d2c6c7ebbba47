"""The operators' queries, over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from chainloom.llm.decontaminate import op8_benchmark_decontamination
from chainloom.llm.embedding_dedup import op5_embedding_dedup
from chainloom.llm.language import op9_language
from chainloom.llm.lm_score import op3_lm_score
from chainloom.llm.mixing import op2_mix_sources
from chainloom.llm.quality import op7_quality
from chainloom.llm.simhash import op4_simhash
from chainloom.llm.substring_dedup import op10_substring_dedup
from chainloom.llm.token_output import op1_token_output
from chainloom.llm.url_filter import OP6_SQL, op6_url_filters

QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_mix_sources": op2_mix_sources,
    "op3_lm_score": op3_lm_score,
    "op4_simhash": op4_simhash,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_url_filters": op6_url_filters,
    "op7_quality": op7_quality,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_language": op9_language,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op6_url_filters": OP6_SQL,
}
