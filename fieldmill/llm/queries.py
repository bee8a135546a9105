"""Driver queries of this subpackage: QUERIES (name -> function of spark and
the table folder) and ORACLES (DuckDB SQL where it can express the query)."""

from __future__ import annotations

from .bpe import op5_bpe_rank_array
from .divergence import OP13_SQL, op13_source_divergence
from .html_text import op6_site_style_tree
from .lexical import OP11_SQL, op11_lexical_search
from .mixing import op7_hash_threshold_mix
from .near_text import op4_minhash_dedup
from .near_vectors import op8_spherical_cap_dedup
from .quality import op10_quality_rules
from .substrings import op9_substring_dedup
from .suffixes import op12_suffix_dedup
from .token_files import op2_token_files
from .urls import OP1_SQL, op1_url_digest_array
from .warc import OP3_SQL, op3_warc_normaliser

QUERIES = {f.__name__: f for f in (
    op1_url_digest_array, op2_token_files, op3_warc_normaliser, op4_minhash_dedup, op5_bpe_rank_array,
    op6_site_style_tree, op7_hash_threshold_mix, op8_spherical_cap_dedup, op9_substring_dedup, op10_quality_rules,
    op11_lexical_search, op12_suffix_dedup, op13_source_divergence)}

ORACLES = {"op1_url_digest_array": OP1_SQL, "op3_warc_normaliser": OP3_SQL,
           "op11_lexical_search": OP11_SQL, "op13_source_divergence": OP13_SQL}
