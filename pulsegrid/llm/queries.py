"""Queries of the corpus operators, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm.bpe import op8_bpe
from pulsegrid.llm.chat import OP1_SQL, op1_chat
from pulsegrid.llm.decontamination import op4_decontamination
from pulsegrid.llm.extraction import op3_html_extraction
from pulsegrid.llm.fill_middle import OP12_SQL, op12_fill_middle
from pulsegrid.llm.line_dedup import OP7_SQL, op7_line_dedup
from pulsegrid.llm.periodic import op11_periodic_runs
from pulsegrid.llm.pieces import op13_pieces
from pulsegrid.llm.quality import op5_quality
from pulsegrid.llm.repetition import op6_repetition
from pulsegrid.llm.sharding import op9_sharding
from pulsegrid.llm.simhash import op10_simhash
from pulsegrid.llm.suffix_dedup import op2_suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_decontamination": op4_decontamination,
    "op5_quality": op5_quality,
    "op6_repetition": op6_repetition,
    "op7_line_dedup": op7_line_dedup,
    "op8_bpe": op8_bpe,
    "op9_sharding": op9_sharding,
    "op10_simhash": op10_simhash,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_fill_middle": op12_fill_middle,
    "op13_pieces": op13_pieces,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat": OP1_SQL,
    "op7_line_dedup": OP7_SQL,
    "op12_fill_middle": OP12_SQL,
}
