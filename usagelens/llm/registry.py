"""The training-data operators' queries and their SQL."""

from __future__ import annotations

from usagelens.llm import ann, bpe, crosstok, licenses, mixing, neardup, packing, pstable, quality, secrets, sharding, toxicity, zfast

QUERIES = {
    "op1_best_fit_packing": packing.op1,
    "op2_bbit_minhash": neardup.op2,
    "op3_cross_polytope": ann.op3,
    "op4_line_quality": quality.op4,
    "op5_pfair_mixing": mixing.op5,
    "op6_entropy_secrets": secrets.op6,
    "op7_segment_toxicity": toxicity.op7,
    "op8_backtracking_bpe": bpe.op8,
    "op9_license_dice": licenses.op9,
    "op10_bounded_ring": sharding.op10,
    "op11_pstable_copies": pstable.op11,
    "op12_galloping_alignment": crosstok.op12,
    "op13_zfast_trie": zfast.op13,
}
ORACLES = {
    "op2_bbit_minhash": neardup.ORACLE,
    "op4_line_quality": quality.ORACLE,
    "op9_license_dice": licenses.ORACLE,
    "op11_pstable_copies": pstable.ORACLE,
    "op13_zfast_trie": zfast.ORACLE,
}
