"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from .bpe import op10_bpe
from .licenses import op9_licenses
from .line_dedup import OP1_SQL, op1_line_dedup
from .media import op4_media
from .mixing import OP7_SQL, op7_mix
from .quality import op3_quality
from .secrets import op6_secrets
from .simhash import op5_simhash
from .token_store import op8_token_store
from .weighted_sampling import op2_fingerprints

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_fingerprints": op2_fingerprints,
    "op3_quality": op3_quality,
    "op4_media": op4_media,
    "op5_simhash": op5_simhash,
    "op6_secrets": op6_secrets,
    "op7_mix": op7_mix,
    "op8_token_store": op8_token_store,
    "op9_licenses": op9_licenses,
    "op10_bpe": op10_bpe,
}

SQL = {
    "op1_line_dedup": OP1_SQL,
    "op7_mix": OP7_SQL,
}
