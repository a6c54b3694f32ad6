"""Queries of this subpackage: one for each operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import OP7_SQL, op7_decontamination
from .language import op10_language
from .media import op2_media
from .mixing import OP8_ROWS_SQL, OP8_SQL, op8_mixing, op8_mixing_rows
from .near import OP6_SQL, op6_near
from .pii import OP1_SQL, op1_pii
from .quality import op9_quality
from .repeats import OP4_SQL, op4_repeats
from .secrets import OP3_SQL, op3_secrets
from .tokens import op5_tokens

ALL = (op1_pii, op2_media, op3_secrets, op4_repeats, op5_tokens, op6_near, op7_decontamination, op8_mixing, op8_mixing_rows, op9_quality, op10_language)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op1_pii": OP1_SQL, "op3_secrets": OP3_SQL, "op4_repeats": OP4_SQL, "op6_near": OP6_SQL, "op7_decontamination": OP7_SQL, "op8_mixing": OP8_SQL, "op8_mixing_rows": OP8_ROWS_SQL}
