"""The training-data queries and, where SQL can say it, their DuckDB SQL."""

from __future__ import annotations

from tidewater.llm import byte_dedup, chat, contamination, embedding_dedup, infill, licenses, mixing, ngram_join, periodic, pii, quality, urls, warc

QUERIES = {
    "op1_signature_tree_join": ngram_join.op1,
    "op2_host_reputation": urls.op2,
    "op3_adaptive_quality": quality.op3,
    "op4_warc_index_merge": warc.op4,
    "op5_license_digests": licenses.op5,
    "op6_minhash_containment": contamination.op6,
    "op7_suffix_array_dedup": byte_dedup.op7,
    "op8_chat_roundtrip": chat.op8,
    "op9_pii_boosting": pii.op9,
    "op10_systematic_mix": mixing.op10,
    "op11_automaton_infill": infill.op11,
    "op12_suffix_tree_runs": periodic.op12,
    "op13_spherical_cells": embedding_dedup.op13,
}
SQL = {
    "op2_host_reputation": urls.OP2_SQL,
    "op1_signature_tree_join": ngram_join.OP1_SQL,
    "op3_adaptive_quality": quality.OP3_SQL,
    "op4_warc_index_merge": warc.OP4_SQL,
    "op5_license_digests": licenses.OP5_SQL,
    "op6_minhash_containment": contamination.OP6_SQL,
    "op8_chat_roundtrip": chat.OP8_SQL,
    "op10_systematic_mix": mixing.OP10_SQL,
    "op11_automaton_infill": infill.OP11_SQL,
    "op12_suffix_tree_runs": periodic.OP12_SQL,
    "op13_spherical_cells": embedding_dedup.OP13_SQL,
}
