"""The queries of this subpackage and the SQL that checks them."""

from netloom.llm import op01_simhash, op02_decontaminate, op03_exact_dedup, op04_substring_dedup, op05_packing, op06_token_count, op07_pii, op08_toxicity, op09_html_extract, op10_line_dedup

QUERIES = {
    "op1_simhash": op01_simhash.op1_simhash,
    "op2_decontaminate": op02_decontaminate.op2_decontaminate,
    "op3_exact_dedup": op03_exact_dedup.op3_exact_dedup,
    "op4_substring_dedup": op04_substring_dedup.op4_substring_dedup,
    "op5_packing": op05_packing.op5_packing,
    "op6_token_count": op06_token_count.op6_token_count,
    "op7_pii": op07_pii.op7_pii,
    "op8_toxicity": op08_toxicity.op8_toxicity,
    "op9_html_extract": op09_html_extract.op9_html_extract,
    "op10_line_dedup": op10_line_dedup.op10_line_dedup,
}

ORACLE_SQL = {"op3_exact_dedup": op03_exact_dedup.ORACLE_SQL, "op4_substring_dedup": op04_substring_dedup.ORACLE_SQL, "op10_line_dedup": op10_line_dedup.ORACLE_SQL}
