"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartulary.llm.fill_middle import OP12_SQL, op12_fill_middle
from cartulary.llm.html_extract import op3_html_extract
from cartulary.llm.jaccard_join import op5_jaccard_join
from cartulary.llm.avi import op7_avi_media
from cartulary.llm.language_id import op8_language_id
from cartulary.llm.packing import op6_pack_windows
from cartulary.llm.license_scan import op10_license_scan
from cartulary.llm.sharding import op9_stratified_shards
from cartulary.llm.bpe import op4_byte_bpe
from cartulary.llm.quality import op1_quality_rules
from cartulary.llm.secret_scan import op2_secret_scan
from cartulary.llm.toxicity import op11_toxicity
from cartulary.llm.source_divergence import OP13_SQL, op13_source_divergence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op3_html_extract": op3_html_extract,
    "op5_jaccard_join": op5_jaccard_join,
    "op7_avi_media": op7_avi_media,
    "op8_language_id": op8_language_id,
    "op6_pack_windows": op6_pack_windows,
    "op10_license_scan": op10_license_scan,
    "op9_stratified_shards": op9_stratified_shards,
    "op1_quality_rules": op1_quality_rules,
    "op2_secret_scan": op2_secret_scan,
    "op4_byte_bpe": op4_byte_bpe,
    "op11_toxicity": op11_toxicity,
    "op12_fill_middle": op12_fill_middle,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {"op12_fill_middle": OP12_SQL, "op13_source_divergence": OP13_SQL}
