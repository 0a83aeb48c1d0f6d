"""The queries of this subpackage and their SQL, for the entry module at the repository's top."""

from __future__ import annotations

from textloom.llm import bpe, edit_count, exact_dedup, line_dedup, lm, mixing, pii, quality, simhash, topk

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_bpe": bpe.op2_bpe,
    "op3_quality": quality.op3_quality,
    "op4_lm": lm.op4_lm,
    "op5_mix": mixing.op5_mix,
    "op6_simhash": simhash.op6_simhash,
    "op7_pii": pii.op7_pii,
    "op8_edit_counts": edit_count.op8_edit_counts,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

#: Queries that SQL can express; tests hold the others against brute force.
SQL = {"op1_topk": topk.SQL, "op5_mix": mixing.SQL, "op10_exact_dedup": exact_dedup.SQL}


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
