"""Registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from tributary.llm.bpe_prefix import op8_bpe_round_trip
from tributary.llm.conversation_trie import OP12_SQL, op12_conversation_trie
from tributary.llm.jaccard_join import op7_jaccard_join
from tributary.llm.line_dedup import OP10_SQL, op10_line_dedup
from tributary.llm.lm_scoring import op5_lm_scores
from tributary.llm.mixing import op1_mix_sources
from tributary.llm.ogg_media import op9_ogg_media
from tributary.llm.piece_bpe import op13_piece_round_trip
from tributary.llm.token_counts import op2_token_counts
from tributary.llm.token_store import op4_token_files
from tributary.llm.topk_search import OP6_SQL, op6_top_k
from tributary.llm.toxicity import op3_toxicity
from tributary.llm.vector_codes import OP11_SQL, op11_vector_codes

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_token_files": op4_token_files,
    "op5_lm_scores": op5_lm_scores,
    "op6_top_k": op6_top_k,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_ogg_media": op9_ogg_media,
    "op10_line_dedup": op10_line_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_piece_round_trip": op13_piece_round_trip,
}

ORACLE_SQL: dict[str, str] = {"op6_top_k": OP6_SQL, "op10_line_dedup": OP10_SQL, "op11_vector_codes": OP11_SQL, "op12_conversation_trie": OP12_SQL}
