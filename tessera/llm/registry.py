"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import jaccard, katz, media, mixing, neighbours, packing, pii, repeats, toxicity, urls


def queries() -> dict:
    return {
        "op1_pii": pii.op1_pii,
        "op2_neighbours": neighbours.op2_neighbours,
        "op3_jaccard": jaccard.op3_jaccard,
        "op4_url_filters": urls.op4_url_filters,
        "op5_packing": packing.op5_packing,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_repeats": repeats.op7_repeats,
        "op8_katz": katz.op8_katz,
        "op9_mixing": mixing.op9_mixing,
        "op10_media": media.op10_media,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard": jaccard.OP3_SQL, "op4_url_filters": urls.OP4_SQL}
