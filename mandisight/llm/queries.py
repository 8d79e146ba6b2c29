"""Registered queries of this folder and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from mandisight.llm import conversation_trie, embed_dedup, host_rules, line_dedup, ngram_join, warc
from mandisight.llm.bpe_rank import op7_bpe_rank_array
from mandisight.llm.embed_dedup import op5_embedding_near_dedup
from mandisight.llm.lang_id import op10_lang_id
from mandisight.llm.license_scan import op1_license_scan
from mandisight.llm.ngram_join import op3_ngram_jaccard_join
from mandisight.llm.packing import op8_best_fit_packing
from mandisight.llm.pu_quality import op2_pu_quality
from mandisight.llm.token_alignment import op11_token_alignment
from mandisight.llm.token_planes import op6_token_planes
from mandisight.llm.warc import op9_warc_index_first

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_pu_quality": op2_pu_quality,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_host_rules": host_rules.op4_host_rules,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_token_planes": op6_token_planes,
    "op7_bpe_rank_array": op7_bpe_rank_array,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_warc_index_first": op9_warc_index_first,
    "op10_lang_id": op10_lang_id,
    "op11_token_alignment": op11_token_alignment,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_conversation_trie": conversation_trie.op13_conversation_trie,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": ngram_join.SQL,
    "op4_host_rules": host_rules.SQL,
    "op5_embedding_near_dedup": embed_dedup.SQL,
    "op9_warc_index_first": warc.SQL,
    "op12_line_dedup": line_dedup.SQL,
    "op13_conversation_trie": conversation_trie.SQL,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
