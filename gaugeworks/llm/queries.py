"""The queries of the training-data operators, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from gaugeworks.llm import chat, decontam, minhash, neighbours, packing, passages, quality, sharding, token_files, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_windows": chat.op1_chat_windows,
    "op2_warc": warc.op2_warc,
    "op3_sharding": sharding.op3_sharding,
    "op4_repeated_passages": passages.op4_repeated_passages,
    "op5_nearest_neighbours": neighbours.op5_nearest_neighbours,
    "op6_near_duplicates": minhash.op6_near_duplicates,
    "op7_decontamination": decontam.op7_decontamination,
    "op8_quality": quality.op8_quality,
    "op9_token_files": token_files.op9_token_files,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op1_chat_windows": chat.SQL,
    "op2_warc": warc.SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
