"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tidemark.llm.conversation_repair import op13_conversation_repair
from tidemark.llm.feistel_shards import op12_feistel_shards
from tidemark.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from tidemark.llm.html_text import op3_html_text
from tidemark.llm.jaccard_join import op8_jaccard_join
from tidemark.llm.language_id import op10_language_id
from tidemark.llm.license_scan import OP5_SQL, op5_license_scan
from tidemark.llm.multi_index import OP7_SQL, op7_multi_index
from tidemark.llm.packing import op9_packing
from tidemark.llm.pii import op1_pii
from tidemark.llm.sentence_pieces import op2_sentence_pieces
from tidemark.llm.toxicity import op4_toxicity
from tidemark.llm.vantage_tree import op6_vantage_tree

QUERIES = {
    "op1_pii": op1_pii,
    "op2_sentence_pieces": op2_sentence_pieces,
    "op3_html_text": op3_html_text,
    "op4_toxicity": op4_toxicity,
    "op5_license_scan": op5_license_scan,
    "op6_vantage_tree": op6_vantage_tree,
    "op7_multi_index": op7_multi_index,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_packing": op9_packing,
    "op10_language_id": op10_language_id,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_feistel_shards": op12_feistel_shards,
    "op13_conversation_repair": op13_conversation_repair,
}

SQL: dict[str, str] = {"op5_license_scan": OP5_SQL, "op7_multi_index": OP7_SQL,
                       "op11_hard_negatives": OP11_SQL}
