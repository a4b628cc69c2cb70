"""The queries of this folder, by the names under which they are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import op5_quality_rules as op5
from ledgerloom.llm import op7_line_dedup as op7
from ledgerloom.llm import op12_filter_audit as op12
from ledgerloom.llm.op1_substring_dedup import op1_substring_dedup
from ledgerloom.llm.op2_decontamination import op2_decontamination
from ledgerloom.llm.op3_ngram_join import op3_class_links, op3_ngram_join
from ledgerloom.llm.op4_token_ids import op4_token_ids
from ledgerloom.llm.op6_pii import op6_pii
from ledgerloom.llm.op8_byte_bpe import op8_byte_bpe
from ledgerloom.llm.op9_license_scan import op9_license_scan
from ledgerloom.llm.op10_toxicity import op10_toxicity
from ledgerloom.llm.op11_tokenizer_alignment import op11_tokenizer_alignment
from ledgerloom.llm.op13_lm_scoring import op13_lm_scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_substring_dedup,
        op2_decontamination,
        op3_ngram_join,
        op3_class_links,
        op4_token_ids,
        op5.op5_quality_rules,
        op6_pii,
        op7.op7_line_dedup,
        op7.op7_passage_dedup,
        op8_byte_bpe,
        op9_license_scan,
        op10_toxicity,
        op11_tokenizer_alignment,
        op12.op12_filter_audit,
        op13_lm_scoring,
    )
}

#: DuckDB SQL of those queries that SQL can express over whole tables.
ORACLE_SQL: dict[str, str] = {"op5_quality_rules": op5.ORACLE, "op7_line_dedup": op7.ORACLE, "op12_filter_audit": op12.ORACLE}
