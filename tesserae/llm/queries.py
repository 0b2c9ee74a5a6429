"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, line_dedup, lexical, link_graph, manifest, mixing, near_dedup, ogg_media, personal_data, quality, rule_forest, warc_fixity, winnow

QUERIES = {
    "op1_ogg_media": ogg_media.op1_ogg_media,
    "op2_link_graph": link_graph.op2_link_graph,
    "op3_merkle_fixity": warc_fixity.op3_merkle_fixity,
    "op4_fast_minhash": near_dedup.op4_fast_minhash,
    "op5_contextual_pii": personal_data.op5_contextual_pii,
    "op6_fair_queue_mix": mixing.op6_fair_queue_mix,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_winnowing": winnow.op9_winnowing,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
    "op11_fractal_manifest": manifest.op11_fractal_manifest,
    "op12_rule_forest": rule_forest.op12_rule_forest,
    "op13_bit_sliced_search": lexical.op13_bit_sliced_search,
}

ORACLE_SQL: dict[str, str] = {
    "op2_link_graph": link_graph.SQL,
    "op3_merkle_fixity": warc_fixity.SQL,
    "op6_fair_queue_mix": mixing.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op11_fractal_manifest": manifest.SQL,
    "op13_bit_sliced_search": lexical.SQL,
}
