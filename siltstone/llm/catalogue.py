"""Registered queries of the training-data operators and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from siltstone.llm import consensus, linkage, lookalikes, mixing, packing, pairs, splitting, survivors


def queries() -> dict:
    return {
        "p1_found": survivors.p1_found,
        "p1_groups": survivors.p1_groups,
        "p2_found": linkage.p2_found,
        "p2_confidence": linkage.p2_confidence,
        "p3_found": splitting.p3_found,
        "p3_pieces": splitting.p3_pieces,
        "p3_token_pieces": splitting.p3_token_pieces,
        "p4_found": consensus.p4_found,
        "p4_consensus": consensus.p4_consensus,
        "p4_annotators": consensus.p4_annotators,
        "p4_agreement": consensus.p4_agreement,
        "p5_found": pairs.p5_found,
        "p6_containers": packing.p6_containers,
        "p6_packing": packing.p6_packing,
        "p6_report": packing.p6_report,
        "p7_mix": mixing.p7_mix,
        "p8_found": lookalikes.p8_found,
        "p8_canonical": lookalikes.p8_canonical,
        "p8_classes": lookalikes.p8_classes,
        "p7_shares": mixing.p7_shares,
        "p7_temperature": mixing.p7_temperature,
        "p7_tempered_mix": mixing.p7_tempered_mix,
        "p7_tempered_shares": mixing.p7_tempered_shares,
    }


_LONG = """SELECT 'section' AS item_kind, id AS item_key, CAST(no - 1 AS INTEGER) AS item_no FROM (SELECT id, unnest(sections) AS x, generate_subscripts(sections, 1) AS no FROM parsed_papers) WHERE length(x.text) > 2000
UNION ALL SELECT 'full_text', id, -1 FROM parsed_papers WHERE (sections IS NULL OR len(sections) = 0) AND length(full_text) > 2000
UNION ALL SELECT 'chunk', chunk_key, chunk_id FROM chunk_lookup WHERE length(text) > 2000"""


def oracle_sql() -> dict:
    return {"p3_found": _LONG}
