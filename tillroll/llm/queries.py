"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from tillroll.llm import infill, lexical, lines, oracle
from tillroll.llm.chat import op1_chat_formatting
from tillroll.llm.decontaminate import op2_decontamination
from tillroll.llm.ngram_join import op3_ngram_jaccard
from tillroll.llm.packing import op10_best_fit_packing
from tillroll.llm.quality import op4_quality_rules
from tillroll.llm.repeats import op7_suffix_dedup
from tillroll.llm.secrets import op5_secret_scan
from tillroll.llm.surrogates import op9_pii_surrogates
from tillroll.llm.toxicity import op8_toxicity
from tillroll.llm.warc import op6_warc

QUERIES = {
    "op8_toxicity": op8_toxicity,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op6_warc": op6_warc,
    "op1_chat_formatting": op1_chat_formatting,
    "op5_secret_scan": op5_secret_scan,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op2_decontamination": op2_decontamination,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_quality_rules": op4_quality_rules,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_fill_in_middle": infill.op11_fill_in_middle,
    "op12_ranked_lexical_search": lexical.op12_ranked_lexical_search,
    "op13_line_dedup": lines.op13_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    **oracle.ORACLE_SQL,
    "op11_fill_in_middle": infill.ORACLE_SQL,
    "op12_ranked_lexical_search": lexical.ORACLE_SQL,
    "op13_line_dedup": lines.ORACLE_SQL,
}
