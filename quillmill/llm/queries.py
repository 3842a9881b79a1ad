"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from . import ann, collocations, decontaminate, html_text, line_dedup, mixing, ngram_join, periodic, quality, repeats, token_counts, token_files, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_token_files": token_files.op3_token_files,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_html_text": html_text.op5_html_text,
    "op6_nearest": ann.op6_nearest,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_warc_zip": warc.op8_warc_zip,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_repeats": repeats.op11_repeats,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE_SQL = {"op2_line_dedup": line_dedup.OP2_SQL, "op8_warc_zip": warc.OP8_SQL, "op11_repeats": repeats.OP11_SQL, "op12_periodic_runs": periodic.OP12_SQL, "op13_collocations": collocations.OP13_SQL}
