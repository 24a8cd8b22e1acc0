"""The registered query of each operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from . import annulus, cap_filters, chat, jaccard_tgm, langid_gru, maglev, matroska, mixing, quality_fm, secret_scan, spm_wfst, token_align, token_index


def queries():
    return {
        "op1_token_index": token_index._digest,
        "op2_chat_format": chat._digest,
        "op3_quality_fm": quality_fm._digest,
        "op4_cap_filters": cap_filters._digest,
        "op5_spm_wfst": spm_wfst._digest,
        "op6_langid_gru": langid_gru._digest,
        "op7_maglev_sharding": maglev._digest,
        "op8_jaccard_tgm": jaccard_tgm._digest,
        "op9_matroska": matroska._digest,
        "op10_mix_sources": mixing._digest,
        "op11_token_align": token_align._digest,
        "op12_secret_links": secret_scan._digest,
        "op13_annulus_kmeans": annulus._digest,
    }


def oracle_sql():
    return {"op2_chat_format": chat.SQL, "op4_cap_filters": cap_filters.SQL, "op7_maglev_sharding": maglev.sql(), "op10_mix_sources": mixing.SQL, "op12_secret_links": secret_scan.sql(), "op13_annulus_kmeans": annulus.sql()}
