"""The dealt operators' queries by name, and DuckDB SQL where that can say the same."""

from __future__ import annotations

from ledgerline.llm import bpe, chat, dac, ledger, neardup, packing, quality, simhash, toxicity, wrappers


def pipeline(spark, sf_dir):
    """The rows of corpus_pipeline.run()."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_wrappers": wrappers.op2_wrappers,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_embeddings": neardup.op4_embeddings,
    "op5_simhash": simhash.op5_simhash,
    "op6_tokens": dac.op6_tokens,
    "op7_quality": quality.op7_quality,
    "op8_ledger": ledger.op8_ledger,
    "ledger_ablation": ledger.ledger_ablation,
    "op9_chat": chat.op9_chat,
    "op10_bpe": bpe.op10_bpe,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {"op8_ledger": ledger.ORACLE, "ledger_ablation": ledger.ABLATION, "op9_chat": chat.ORACLE}
