"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from llm import (
    bpe, collocations, decontamination, histogram_shards, html_text, kneser_ney, line_dedup, prefix_tree_join, quality_rules, sql,
    suffix_dedup, token_files, warc, whitening,
)

QUERIES = {
    "op1_kneser_ney": kneser_ney.op1_kneser_ney,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_token_files": token_files.op3_token_files,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_warc": warc.op5_warc,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_histogram_shards": histogram_shards.op7_histogram_shards,
    "op8_html_text": html_text.op8_html_text,
    "op9_prefix_tree_join": prefix_tree_join.op9_prefix_tree_join,
    "op10_bpe": bpe.op10_bpe,
    "op11_whitening": whitening.op11_whitening,
    "op12_collocations": collocations.op12_collocations,
    "op13_line_dedup": line_dedup.op13_line_dedup,
}

def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
ORACLES: dict[str, str] = {
    "op2_quality_rules": sql.OP2_SQL,
    "op5_warc": sql.OP5_SQL,
    "op12_collocations": sql.OP12_SQL,
    "op13_line_dedup": sql.OP13_SQL,
}
