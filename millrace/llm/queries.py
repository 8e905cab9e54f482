"""The registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from . import decontaminate, materialise, mixing, oracles, quality, secrets, sharding, simhash, spotsigs, tokencount, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_simhash_near_dedup": simhash.op2,
    "op3_decontamination": decontaminate.op3,
    "op4_training_order": materialise.op4,
    "op5_mixing": mixing.op5,
    "op6_token_counts": tokencount.op6,
    "op7_secret_scan": secrets.op7,
    "op8_jump_sharding": sharding.op8,
    "op9_quality": quality.op9,
    "op10_spotsigs": spotsigs.op10,
}

ORACLE_SQL = {"op7_secret_scan": oracles.SECRET_SCAN, "op8_jump_sharding": oracles.JUMP_SHARDING}
