"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from folioflow.llm.bpe_tree import op4_bpe_tree
from folioflow.llm.dart_minhash import op6_dart_minhash
from folioflow.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from folioflow.llm.hmm_lm import op3_hmm_lm
from folioflow.llm.huffman_ids import op11_huffman_ids
from folioflow.llm.language_id import op5_language_id
from folioflow.llm.media_sequences import op9_media_sequences
from folioflow.llm.packing import op2_packing
from folioflow.llm.periodic_runs import op12_periodic_runs
from folioflow.llm.topk_search import OP7_SQL, op7_topk_search
from folioflow.llm.toxicity import op1_toxicity
from folioflow.llm.url_graph import OP8_SQL, op8_url_graph
from folioflow.llm.warc_zstd import OP10_SQL, op10_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_hmm_lm": op3_hmm_lm,
    "op4_bpe_tree": op4_bpe_tree,
    "op5_language_id": op5_language_id,
    "op6_dart_minhash": op6_dart_minhash,
    "op7_topk_search": op7_topk_search,
    "op8_url_graph": op8_url_graph,
    "op9_media_sequences": op9_media_sequences,
    "op10_warc": op10_warc,
    "op11_huffman_ids": op11_huffman_ids,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL = {
    "op7_topk_search": OP7_SQL,
    "op8_url_graph": OP8_SQL,
    "op10_warc": OP10_SQL,
    "op13_hard_negatives": OP13_SQL,
}
