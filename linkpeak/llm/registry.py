"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from linkpeak.llm import clusters, decontamination, jaccard, licenses, mixing, pii, prefixes, quality, sharding, substrings, topk, toxicity, urls


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_quality": quality.op2_quality,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_urls": urls.op4_urls,
        "op5_decontamination": decontamination.op5_decontamination,
        "op6_sharding": sharding.op6_sharding,
        "op7_pii": pii.op7_pii,
        "op8_jaccard": jaccard.op8_jaccard,
        "op9_topk": topk.op9_topk,
        "op10_licenses": licenses.op10_licenses,
        "op11_prefixes": prefixes.op11_prefixes,
        "op12_substrings": substrings.op12_substrings,
        "op13_clusters": clusters.op13_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": decontamination.OP5_SQL, "op8_jaccard": jaccard.OP8_SQL, "op9_topk": topk.OP9_SQL, "op11_prefixes": prefixes.OP11_SQL, "op12_substrings": substrings.OP12_SQL, "op13_clusters": clusters.OP13_SQL}
