"""Queries of this subpackage: one for each operator, and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontamination, html_text, packing, paragraphs, periodic, quality_crf, quality_rules, simhash, suffixes, token_counts, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        paragraphs.op1_substring_dedup,
        packing.op2_best_fit_packing,
        warc.op3_warc,
        token_counts.op4_token_counts,
        decontamination.op5_decontamination,
        html_text.op6_html_text,
        simhash.op7_simhash,
        quality_rules.op8_quality_rules,
        suffixes.op9_suffix_dedup,
        quality_crf.op10_quality_classifier,
        periodic.op11_periodic_runs,
        url_filter.op12_url_filter,
        conversations.op13_conversation_repair,
    )
}
SQL: dict[str, str] = {"op3_warc": warc.OP3_SQL, "op6_html_text": html_text.OP6_SQL, "op8_quality_rules": quality_rules.OP8_SQL}
