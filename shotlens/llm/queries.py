"""The queries of this package and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shotlens.llm.ann import op1_nearest
from shotlens.llm.bpe import op6_bpe
from shotlens.llm.html_text import op5_html_text
from shotlens.llm.langid import op8_language
from shotlens.llm.merkle import OP11_SQL, op11_merkle
from shotlens.llm.neardup import OP4_SQL, op4_near_duplicates
from shotlens.llm.packing import op2_packing
from shotlens.llm.quality import OP12_SQL, op12_quality
from shotlens.llm.resample import OP13_SQL, op13_resample
from shotlens.llm.search import op7_bm25_search
from shotlens.llm.toxicity import op10_toxicity
from shotlens.llm.url_filter import OP9_SQL, op9_url_filter
from shotlens.llm.warc import OP3_SQL, op3_warc_bundles


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_nearest": op1_nearest,
        "op2_packing": op2_packing,
        "op3_warc_bundles": op3_warc_bundles,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_html_text": op5_html_text,
        "op6_bpe": op6_bpe,
        "op7_bm25_search": op7_bm25_search,
        "op8_language": op8_language,
        "op9_url_filter": op9_url_filter,
        "op10_toxicity": op10_toxicity,
        "op11_merkle": op11_merkle,
        "op12_quality": op12_quality,
        "op13_resample": op13_resample,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_bundles": OP3_SQL, "op4_near_duplicates": OP4_SQL, "op9_url_filter": OP9_SQL, "op11_merkle": OP11_SQL, "op12_quality": OP12_SQL, "op13_resample": OP13_SQL}
