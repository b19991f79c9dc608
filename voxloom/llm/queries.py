"""Queries of the training-data operators, by name."""

from __future__ import annotations

from voxloom.llm.avi import op2_avi_clips
from voxloom.llm.byte_bpe import op5_byte_bpe
from voxloom.llm.divergence import ORACLE_SQL as DIVERGENCE_SQL
from voxloom.llm.divergence import op12_source_divergence
from voxloom.llm.id_files import op9_id_files
from voxloom.llm.language_id import op6_language_id
from voxloom.llm.lz_fingerprint import op1_lz_fingerprint
from voxloom.llm.minmax import ORACLE_SQL as NEAR_DEDUP_SQL
from voxloom.llm.minmax import op3_minmax_near_dedup
from voxloom.llm.packing import op4_packing
from voxloom.llm.pseudonyms import op7_pii_pseudonyms
from voxloom.llm.sharding import ORACLE_SQL as SHARDS_SQL
from voxloom.llm.sharding import op11_stratified_shards
from voxloom.llm.token_counts import op8_token_counts
from voxloom.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_lz_fingerprint": op1_lz_fingerprint,
    "op2_avi_clips": op2_avi_clips,
    "op3_minmax_near_dedup": op3_minmax_near_dedup,
    "op4_packing": op4_packing,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_language_id": op6_language_id,
    "op7_pii_pseudonyms": op7_pii_pseudonyms,
    "op8_token_counts": op8_token_counts,
    "op9_id_files": op9_id_files,
    "op10_toxicity": op10_toxicity,
    "op11_stratified_shards": op11_stratified_shards,
    "op12_source_divergence": op12_source_divergence,
}
#: The others have no SQL: tests hold them against brute force, the public libraries or held-out rows.
ORACLES: dict[str, str] = {"op3_minmax_near_dedup": NEAR_DEDUP_SQL, "op11_stratified_shards": SHARDS_SQL, "op12_source_divergence": DIVERGENCE_SQL}
