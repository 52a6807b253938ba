"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from glossa.llm.bpe import op13_duckdb_bpe
from glossa.llm.crosswalk import op12_token_links
from glossa.llm.decontam import OP4_SQL, op4_decontamination
from glossa.llm.html import op2_tag_path_ratios
from glossa.llm.lines import op7_fuzzy_lines
from glossa.llm.minhash import op1_minhash_near_dedup
from glossa.llm.negatives import OP11_SQL, op11_ivf_negatives
from glossa.llm.packing import op5_vector_packing
from glossa.llm.quality import op6_co_training
from glossa.llm.separators import op9_separator_scan
from glossa.llm.urls import OP8_SQL, op8_host_reputation
from glossa.llm.vectors import op10_hnsw_near_vectors
from glossa.llm.warc import op3_warc_derivatives

QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_tag_path_ratios": op2_tag_path_ratios,
    "op3_warc_derivatives": op3_warc_derivatives,
    "op4_decontamination": op4_decontamination,
    "op5_vector_packing": op5_vector_packing,
    "op6_co_training": op6_co_training,
    "op7_fuzzy_lines": op7_fuzzy_lines,
    "op8_host_reputation": op8_host_reputation,
    "op9_separator_scan": op9_separator_scan,
    "op10_hnsw_near_vectors": op10_hnsw_near_vectors,
    "op11_ivf_negatives": op11_ivf_negatives,
    "op12_token_links": op12_token_links,
    "op13_duckdb_bpe": op13_duckdb_bpe,
}
ORACLE_SQL = {
    "op4_decontamination": OP4_SQL,
    "op8_host_reputation": OP8_SQL,
    "op11_ivf_negatives": OP11_SQL,
}
