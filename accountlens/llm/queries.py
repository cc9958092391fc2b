"""The queries of this subpackage and the SQL that some of them are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from accountlens.llm.alignment import op12_token_alignment
from accountlens.llm.backoff import op5_backoff_lm
from accountlens.llm.chat import OP10_SQL, op10_preference_chat
from accountlens.llm.collocations import OP13_SQL, op13_phrase_collocations
from accountlens.llm.decontaminate import op1_template_decontamination
from accountlens.llm.langid import op6_rank_order_langid
from accountlens.llm.mixing import OP11_SQL, op11_source_mixing
from accountlens.llm.packing import op3_linear_grouping_packing
from accountlens.llm.pii import op7_contextual_pii
from accountlens.llm.rollups import OP9_SQL, op9_token_rollups
from accountlens.llm.simhash import op8_simhash_dedup
from accountlens.llm.substrings import op2_debruijn_dedup
from accountlens.llm.topk import OP4_SQL, op4_multi_index_topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = [
        op1_template_decontamination,
        op2_debruijn_dedup,
        op3_linear_grouping_packing,
        op4_multi_index_topk,
        op5_backoff_lm,
        op6_rank_order_langid,
        op7_contextual_pii,
        op8_simhash_dedup,
        op9_token_rollups,
        op10_preference_chat,
        op11_source_mixing,
        op12_token_alignment,
        op13_phrase_collocations,
    ]
    return {query.__name__: query for query in listed}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_multi_index_topk": OP4_SQL,
        "op9_token_rollups": OP9_SQL,
        "op10_preference_chat": OP10_SQL,
        "op11_source_mixing": OP11_SQL,
        "op13_phrase_collocations": OP13_SQL,
    }
