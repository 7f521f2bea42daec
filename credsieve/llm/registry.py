"""Queries of this subpackage for the driver's contract."""

from __future__ import annotations

from .bpe import op1_bpe
from .decontamination import op4_decontamination
from .edits import op3_token_counts
from .language import op2_language
from .licenses import op5_licenses
from .minhash import op9_minhash
from .pii import op6_pii
from .sharding import op8_sharding
from .urls import ORACLE as URL_ORACLE
from .urls import op10_url_filters
from .vectors import op7_vectors

QUERIES = {"op1_bpe": op1_bpe, "op2_language": op2_language, "op3_token_counts": op3_token_counts, "op4_decontamination": op4_decontamination, "op5_licenses": op5_licenses, "op6_pii": op6_pii, "op7_vectors": op7_vectors, "op8_sharding": op8_sharding, "op9_minhash": op9_minhash, "op10_url_filters": op10_url_filters}

# No SQL engine at hand has the tokenizers, models, hashes or fuzzy search of the others; tests/llm holds them against brute force.
ORACLE_SQL = {"op10_url_filters": URL_ORACLE}
