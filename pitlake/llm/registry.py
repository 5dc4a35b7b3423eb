"""The queries of this subpackage for the driver, and their SQL."""

from __future__ import annotations

from pitlake.llm.bpe import op6_bpe
from pitlake.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from pitlake.llm.licenses import OP8_SQL, op8_licenses
from pitlake.llm.minhash import op9_minhash
from pitlake.llm.mixing import OP10_SQL, op10_mixing
from pitlake.llm.sharding import OP5_SQL, op5_sharding
from pitlake.llm.substring_dedup import op4_suffix_dedup
from pitlake.llm.toxicity import op2_toxicity
from pitlake.llm.url_filter import OP1_SQL, op1_url_filter
from pitlake.llm.vector_dedup import OP7_SQL, op7_vector_dedup

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_toxicity": op2_toxicity,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_sharding": op5_sharding,
    "op6_bpe": op6_bpe,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_licenses": op8_licenses,
    "op9_minhash": op9_minhash,
    "op10_mixing": op10_mixing,
}
ORACLES = {
    "op1_url_filter": OP1_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op5_sharding": OP5_SQL,
    "op7_vector_dedup": OP7_SQL,
    "op8_licenses": OP8_SQL,
    "op10_mixing": OP10_SQL,
}
