"""The queries of this subpackage: name -> callable, and DuckDB SQL where it
can state the same rows."""

from __future__ import annotations

from shoplens.llm import containment, crf, factor_machine, feistel, hpylm, imatch, mixing, prefix_trie, resampling, signature_tree, vector_fit, winnow, zstd_ids

QUERIES = {
    "op3_signature_tree": signature_tree.op3_signature_tree,
    "op1_pitman_yor": hpylm.op1_pitman_yor,
    "op2_soft_mixing": mixing.op2_soft_mixing,
    "op9_zstd_ids": zstd_ids.op9_zstd_ids,
    "op4_crf_toxicity": crf.op4_crf_toxicity,
    "op10_factor_machine": factor_machine.op10_factor_machine,
    "op6_containment": containment.op6_containment,
    "op7_winnow_lines": winnow.op7_winnow_lines,
    "op7_winnow_passages": winnow.op7_winnow_passages,
    "op5_imatch": imatch.op5_imatch,
    "op8_feistel_shards": feistel.op8_feistel_shards,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_vector_fit": vector_fit.op12_vector_fit,
    "op13_resampling": resampling.op13_resampling,
}

ORACLE: dict[str, str] = {
    "op3_signature_tree": signature_tree.ORACLE,
    "op6_containment": containment.ORACLE,
    "op7_winnow_lines": winnow.ORACLE,
    "op7_winnow_passages": winnow.PASSAGES,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op13_resampling": resampling.ORACLE,
}
