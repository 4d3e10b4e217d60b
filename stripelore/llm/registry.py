"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from .bpe import op6_byte_bpe
from .cells import op5_nearest_neighbours
from .media import op8_media_columns
from .mixing import OP2_SQL, op2_mixing
from .near_dedup import op3_minhash_near_dedup
from .quality import op7_quality
from .sharding import OP4_SQL, op4_sharding
from .substring_dedup import OP10_SQL, op10_substring_dedup
from .toxicity import op9_toxicity
from .url_filter import OP1_SQL, op1_url_filters

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_mixing": op2_mixing,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_sharding": op4_sharding,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_quality": op7_quality,
    "op8_media_columns": op8_media_columns,
    "op9_toxicity": op9_toxicity,
    "op10_substring_dedup": op10_substring_dedup,
}
#: The others are held against brute force in tests/llm.
ORACLES = {
    "op1_url_filters": OP1_SQL,
    "op2_mixing": OP2_SQL,
    "op4_sharding": OP4_SQL,
    "op10_substring_dedup": OP10_SQL,
}
