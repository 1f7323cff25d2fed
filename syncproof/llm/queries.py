"""The corpus queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from syncproof.llm import collocation, decontaminate, fingerprint, langid, line_dedup, packing, pii, quality, secrets, sentencepiece, simhash, trie, url_filter

QUERIES = {
    "op1_quality": quality.query,
    "op2_decontaminate": decontaminate.query,
    "op3_url_filter": url_filter.query,
    "op4_fingerprint": fingerprint.query,
    "op5_sentencepiece": sentencepiece.query,
    "op6_pii": pii.query,
    "op7_langid": langid.query,
    "op8_simhash": simhash.query,
    "op9_secrets": secrets.query,
    "op10_line_dedup": line_dedup.query,
    "op11_trie": trie.query,
    "op12_packing": packing.query,
    "op13_collocations": collocation.query,
}
SQL = {
    "op2_decontaminate": decontaminate.SQL,
    "op3_url_filter": url_filter.SQL,
    "op11_trie": trie.SQL,
    "op13_collocations": collocation.SQL,
}
