"""Queries of this subpackage, by the names the driver uses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textsieve.llm.ann import op10_ann
from textsieve.llm.decontaminate import op5_decontaminate
from textsieve.llm.html_extract import op2_html_extract
from textsieve.llm.language_id import op8_language_id
from textsieve.llm.license_scan import op3_license_scan
from textsieve.llm.mixing import op9_mixing
from textsieve.llm.near_dedup import op1_near_dedup
from textsieve.llm.oracles import ORACLES as _SQL
from textsieve.llm.quality import op4_quality
from textsieve.llm.sharding import op7_sharding
from textsieve.llm.warc import op6_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_html_extract": op2_html_extract,
    "op3_license_scan": op3_license_scan,
    "op4_quality": op4_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_warc": op6_warc,
    "op7_sharding": op7_sharding,
    "op8_language_id": op8_language_id,
    "op9_mixing": op9_mixing,
    "op10_ann": op10_ann,
}

ORACLES: dict[str, str] = dict(_SQL)
