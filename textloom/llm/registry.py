"""Queries and SQL of the llm operators."""

from textloom.llm import dart_minhash, license_scan, line_dedup, link_trust, min_cut, mixing, multi_index, packing, quality_rules, token_files

QUERIES = {
    "op1_link_trust": link_trust.op1_link_trust,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_packing": packing.op4_packing,
    "op5_html_extraction": min_cut.op5_html_extraction,
    "op6_token_files": token_files.op6_token_files,
    "op7_multi_index": multi_index.op7_multi_index,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_mixing": mixing.op9_mixing,
    "op10_near_duplicates": dart_minhash.op10_near_duplicates,
    "conversation_packing": packing.conversation_packing,
}
#: The others cannot be put in SQL; tests hold them against brute force.
ORACLE = {
    "op2_line_dedup": line_dedup.SQL,
    "op8_quality_rules": quality_rules.SQL,
    "op9_mixing": mixing.SQL,
}
