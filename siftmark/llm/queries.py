"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .chat import op1_chat_round_trip
from .clustering import op12_weighted_lloyd
from .idfiles import op9_orc_ids
from .near import op5_order_minhash
from .oracles import ORACLE_SQL
from .packing import op10_residual_packing
from .quality import op8_divergence_rules
from .secret_scan import op6_zstd_novelty
from .sharding import op4_feistel_sharding
from .substrings import op2_relative_lempel_ziv
from .tokens import op7_prefix_bpe
from .topk import op3_norm_buckets
from .toxicity import op11_gated_toxicity
from .trie import op13_prefix_trie

QUERIES = {f.__name__: f for f in (op1_chat_round_trip, op2_relative_lempel_ziv, op3_norm_buckets, op4_feistel_sharding, op5_order_minhash, op6_zstd_novelty, op7_prefix_bpe, op8_divergence_rules, op9_orc_ids, op10_residual_packing, op11_gated_toxicity, op12_weighted_lloyd, op13_prefix_trie)}

__all__ = ["ORACLE_SQL", "QUERIES"]
