"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from .extraction import op2_extract
from .licenses import OP10_SQL, op10_licenses
from .media import op5_media
from .mixing import op7_mix
from .neardup import op8_neardup
from .packing import op3_pack
from .sharding import op1_shards
from .topk import OP9_SQL, op9_topk
from .toxicity import op6_toxicity
from .urls import OP4_SQL, op4_urls

QUERIES = {"op1_shards": op1_shards, "op2_extract": op2_extract, "op3_pack": op3_pack, "op4_urls": op4_urls, "op5_media": op5_media, "op6_toxicity": op6_toxicity, "op7_mix": op7_mix, "op8_neardup": op8_neardup, "op9_topk": op9_topk, "op10_licenses": op10_licenses}
ORACLE_SQL: dict[str, str] = {"op4_urls": OP4_SQL, "op9_topk": OP9_SQL, "op10_licenses": OP10_SQL}
