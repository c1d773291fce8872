"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from marquee.llm import class_lm, decontaminate, html_blocks, jaccard_join, line_runs, merkle, mixing, periodic_runs, perspectives, pipeline, quality_cascade, simhash_anchor, unit_dedup, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_unit_dedup": unit_dedup.op2_unit_dedup,
    "op3_class_lm": class_lm.op3_class_lm,
    "op4_mixing": mixing.op4_mixing,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_line_runs": line_runs.op6_line_runs,
    "op7_perspectives": perspectives.op7_perspectives,
    "op8_quality_cascade": quality_cascade.op8_quality_cascade,
    "op9_simhash_anchor": simhash_anchor.op9_simhash_anchor,
    "op10_html_blocks": html_blocks.op10_html_blocks,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_merkle": merkle.op12_merkle,
    "op13_jaccard_join": jaccard_join.op13_jaccard_join,
    "pipeline": pipeline.run,
}

ORACLE_SQL = {
    "op1_warc": warc.ORACLE_SQL,
    "op4_mixing": mixing.ORACLE_SQL,
    "op5_decontaminate": decontaminate.ORACLE_SQL,
    "op6_line_runs": line_runs.ORACLE_SQL,
    "op7_perspectives": perspectives.ORACLE_SQL,
    "op8_quality_cascade": quality_cascade.ORACLE_SQL,
    "op11_periodic_runs": periodic_runs.ORACLE_SQL,
    "op12_merkle": merkle.ORACLE_SQL,
    "op13_jaccard_join": jaccard_join.ORACLE_SQL,
}
