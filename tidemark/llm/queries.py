"""The operators' queries by name, and the SQL that checks them."""

from __future__ import annotations

from tidemark.llm import codes, decontaminate, html, jaccard, licenses, packing, phrases, pieces, secrets, topk, toxicity, url_filter, warc

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_sentencepiece": pieces.query,
    "op3_licenses": licenses.query,
    "op4_topk": topk.query,
    "op5_url_filter": url_filter.query,
    "op6_secret_scan": secrets.query,
    "op7_decontaminate": decontaminate.query,
    "op8_html": html.query,
    "op9_jaccard_join": jaccard.query,
    "op10_warc": warc.query,
    "op11_packing": packing.query,
    "op12_phrases": phrases.query,
    "op13_product_codes": codes.query,
}
ORACLES = {"op4_topk": topk.ORACLE, "op5_url_filter": url_filter.ORACLE, "op10_warc": warc.ORACLE, "op12_phrases": phrases.ORACLE, "op13_product_codes": codes.ORACLE}
