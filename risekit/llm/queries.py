"""The corpus queries and their SQL."""

from __future__ import annotations

from risekit.llm import bpe, chat, decontaminate, fingerprints, jaccard, line_dedup, negatives, packing, search, sharding, toxicity, url_filters, warc


def queries() -> dict:
    return {
        "op1_warc": warc.op1_warc,
        "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
        "op2_ngram_jaccard_links": jaccard.op2_ngram_jaccard_links,
        "op3_bpe": bpe.op3_bpe,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_url_filters": url_filters.op5_url_filters,
        "op6_sharding": sharding.op6_sharding,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_fingerprints": fingerprints.op8_fingerprints,
        "op9_decontamination": decontaminate.op9_decontamination,
        "op10_chat_format": chat.op10_chat_format,
        "op11_packing": packing.op11_packing,
        "op12_search": search.op12_search,
        "op13_hard_negatives": negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.op1_sql(),
        "op2_ngram_jaccard": jaccard.op2_sql(),
        "op4_line_dedup": line_dedup.op4_sql(),
        "op5_url_filters": url_filters.op5_sql(),
        "op9_decontamination": decontaminate.op9_sql(),
        "op10_chat_format": chat.op10_sql(),
        "op12_search": search.op12_sql(),
        "op13_hard_negatives": negatives.op13_sql(),
    }
