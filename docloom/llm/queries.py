"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontaminate, embeddings, licenses, minhash, mixing, oracles, packing, quality, sharding, spelling, tokencount, tokenfile, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_embedding_graph": embeddings.op2_embedding_graph,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_ring_shards": sharding.op4_ring_shards,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_token_counts": tokencount.op6_token_counts,
    "op7_token_file": tokenfile.op7_token_file,
    "op8_quality": quality.op8_quality,
    "op9_minhash": minhash.op9_minhash,
    "op10_source_mix": mixing.op10_source_mix,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_packing": packing.op12_packing,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_graph": oracles.EMBEDDINGS,
    "op5_decontaminate": oracles.DECONTAMINATION,
    "op9_minhash": oracles.NEAR_DUPLICATES,
    "op11_conversation_repair": oracles.CONVERSATIONS,
    "op13_spelling_variants": oracles.SPELLING,
}
