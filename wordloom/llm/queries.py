"""The queries of this subpackage and the SQL that some of them must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import ann, bpe, chat, decontaminate, line_dedup, secrets, simhash, substring_dedup, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_chat_format": chat.op2_chat_format,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_secret_scan": secrets.op4_secret_scan,
        "op5_bpe": bpe.op5_bpe,
        "op6_ann": ann.op6_ann,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_simhash": simhash.op8_simhash,
        "op9_warc": warc.op9_warc,
        "op10_substring_dedup": substring_dedup.op10_substring_dedup,
        "chat_layouts": chat.chat_layouts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat.SQL, "op3_line_dedup": line_dedup.SQL, "op9_warc": warc.SQL, "chat_layouts": chat.LAYOUTS_SQL}
