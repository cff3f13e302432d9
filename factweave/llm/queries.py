"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from factweave.llm.chunks import op5_substring_dedup
from factweave.llm.decontaminate import op2_decontaminate
from factweave.llm.licenses import op10_license_scan
from factweave.llm.lines import op6_line_dedup
from factweave.llm.mixing import ORACLE_OP1, op1_mix_sources
from factweave.llm.neardup import op8_near_duplicates
from factweave.llm.periodic import op12_periodic_runs
from factweave.llm.prefixes import op11_prefix_trie
from factweave.llm.search import op4_search
from factweave.llm.secrets import op3_secret_spans
from factweave.llm.suffixes import op9_suffix_dedup
from factweave.llm.tokenfiles import op13_token_files
from factweave.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_decontaminate": op2_decontaminate,
    "op3_secret_spans": op3_secret_spans,
    "op4_search": op4_search,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_files": op13_token_files,
}

#: Hash functions other than MD5, entropy windows, learned scores, automata and components have no counterpart in SQL.
ORACLES = {"op1_mix_sources": ORACLE_OP1}
