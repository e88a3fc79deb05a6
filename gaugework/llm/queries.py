"""The operators of this folder as queries over the given tables, with SQL where it can state them."""

from __future__ import annotations

from gaugework.llm import alignment, ann, bpe, forest, line_dedup, lm, merkle, minhash, mixing, quality, sharding, token_files, toxicity

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_quality": quality.op2_quality,
    "op3_ann": ann.op3_ann,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_minhash": minhash.op5_minhash,
    "op6_forest": forest.op6_forest,
    "op7_lm": lm.op7_lm,
    "op8_mixing": mixing.op8_mixing,
    "op9_tokens": token_files.op9_tokens,
    "op10_bpe": bpe.op10_bpe,
    "op11_merkle": merkle.op11_merkle,
    "op12_align": alignment.op12_align,
    "op13_lines": line_dedup.op13_lines,
}

SQL = {"op5_minhash": minhash.OP5_SQL, "op1_sharding": sharding.OP1_SQL, "op8_mixing": mixing.OP8_SQL, "op11_merkle": merkle.OP11_SQL, "op13_lines": line_dedup.OP13_SQL}
