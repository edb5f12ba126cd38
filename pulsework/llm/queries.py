"""The registered queries of this subpackage, and their SQL."""

from . import op1_sharding, op2_quality, op3_substring, op4_decontamination, op5_mixing, op6_licenses, op7_quality_rules, op8_jaccard, op9_toxicity, op10_html, op11_language, op12_search, op13_trie

QUERIES = {
    "op1_sharding": op1_sharding.query,
    "op2_quality": op2_quality.query,
    "op3_substring_dedup": op3_substring.query,
    "op4_decontamination": op4_decontamination.query,
    "op5_mixing": op5_mixing.query,
    "op6_license_scan": op6_licenses.query,
    "op7_quality_rules": op7_quality_rules.query,
    "op8_jaccard_join": op8_jaccard.query,
    "op9_toxicity": op9_toxicity.query,
    "op10_html_extraction": op10_html.query,
    "op11_language_id": op11_language.query,
    "op12_lexical_search": op12_search.query,
    "op13_conversation_trie": op13_trie.query,
}
ORACLE: dict[str, str] = {"op1_sharding": op1_sharding.SQL, "op4_decontamination": op4_decontamination.SQL, "op6_license_scan": op6_licenses.SQL, "op7_quality_rules": op7_quality_rules.SQL, "op8_jaccard_join": op8_jaccard.SQL, "op12_lexical_search": op12_search.SQL, "op13_conversation_trie": op13_trie.SQL}
