"""The queries of these operators, by name, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paidup.llm.codebooks import op13_vector_codes
from paidup.llm.decontaminate import op1_decontaminate
from paidup.llm.language import op7_language
from paidup.llm.licenses import op6_licenses
from paidup.llm.near_copies import op8_near_copies
from paidup.llm.neighbours import op5_neighbours
from paidup.llm.oracles import decontaminate_sql, near_copies_sql, vector_codes_sql, warc_sql
from paidup.llm.packing import op10_packing
from paidup.llm.private_data import op11_private_data
from paidup.llm.repeats import op3_repeats
from paidup.llm.spelling import op12_spelling
from paidup.llm.token_files import op4_token_files
from paidup.llm.warc import op9_warc
from paidup.llm.wrappers import op2_main_text


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_main_text": op2_main_text,
        "op3_repeats": op3_repeats,
        "op4_token_files": op4_token_files,
        "op5_neighbours": op5_neighbours,
        "op6_licenses": op6_licenses,
        "op7_language": op7_language,
        "op8_near_copies": op8_near_copies,
        "op9_warc": op9_warc,
        "op10_packing": op10_packing,
        "op11_private_data": op11_private_data,
        "op12_spelling": op12_spelling,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate_sql(),
        "op8_near_copies": near_copies_sql(),
        "op9_warc": warc_sql(),
        "op13_vector_codes": vector_codes_sql(),
    }
