"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .conversation_trie import OP13_SQL, op13_conversation_trie
from .covering_simhash import op12_covering_simhash
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .fill_in_middle import OP11_SQL, op11_fill_in_middle
from .jaccard_join import op10_ngram_jaccard_join
from .line_dedup import op9_line_dedup
from .media import op6_media_columns
from .oracles import OP2_SQL, OP10_SQL
from .packing import op3_best_fit_packing
from .sentence_pieces import op5_sentence_pieces
from .suffix_array import op1_suffix_array_dedup
from .suffix_tree import op2_substring_dedup
from .token_counts import op4_token_counts
from .toxicity import op7_toxicity

QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_token_counts": op4_token_counts,
    "op5_sentence_pieces": op5_sentence_pieces,
    "op6_media_columns": op6_media_columns,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_covering_simhash": op12_covering_simhash,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLE_SQL: dict[str, str] = {"op2_substring_dedup": OP2_SQL, "op8_exact_dedup": OP8_SQL, "op10_ngram_jaccard_join": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op13_conversation_trie": OP13_SQL}
