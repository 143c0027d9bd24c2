"""Queries of the training-data operators and the SQL that checks them where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cliploom.llm import coverage, encode, language, ledger, mixing, neardup, overlap, packing
from cliploom.session import table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode.encode_texts(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": ledger.p1_found,
        "p1_counts": ledger.p1_counts,
        "p2_mix": mixing.p2_mix,
        "p2_shares": mixing.p2_shares,
        "p3_subset": coverage.p3_subset,
        "p4_found": neardup.p4_found,
        "p5_found": overlap.p5_found,
        "p5_report": overlap.p5_report,
        "p6_ids": p6_ids,
        "p7_containers": packing.p7_containers,
        "p7_fill": packing.p7_fill,
        "p7_checks": packing.p7_checks,
        "p8_found": language.p8_found,
        "p8_spans": language.p8_spans,
    }


def oracle_sql() -> dict[str, str]:
    return ledger.SQL | mixing.SQL | neardup.SQL | overlap.SQL | packing.SQL
