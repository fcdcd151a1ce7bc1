"""Queries of this subpackage and, where SQL can express one, its DuckDB counterpart."""

from __future__ import annotations

from spanloom.llm.collocations import op12_phrase_collocations
from spanloom.llm.extract import op3_html_extraction
from spanloom.llm.hamming import op2_top_k_search
from spanloom.llm.maxscore import op11_ranked_search
from spanloom.llm.mixing import op4_source_mixing
from spanloom.llm.oracle import SQL
from spanloom.llm.pieces import op6_sentencepiece
from spanloom.llm.pii import op5_pii_surrogates
from spanloom.llm.quality import op7_quality_rules
from spanloom.llm.simhash import op8_simhash
from spanloom.llm.substring import op10_substring_dedup
from spanloom.llm.tokencount import op9_token_counts
from spanloom.llm.toxicity import op13_toxicity
from spanloom.llm.warc import op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_top_k_search": op2_top_k_search,
    "op3_html_extraction": op3_html_extraction,
    "op4_source_mixing": op4_source_mixing,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_quality_rules": op7_quality_rules,
    "op8_simhash": op8_simhash,
    "op9_token_counts": op9_token_counts,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_toxicity": op13_toxicity,
}

ORACLE_SQL: dict[str, str] = dict(SQL)
