"""The corpus operators' queries, with production parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op4_bpe
from .chat import op1_chat
from .fim import op12_fim
from .langid import op2_langid
from .lmscore import op3_lmscore
from .media import op7_media
from .mixing import op10_mixing
from .neardup import op9_neardup
from .quality import op5_quality
from .repair import op13_repair
from .sharding import op11_shards
from .sql import oracle_sql as oracle_sql
from .tokens import op8_tokens
from .warc import op6_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat": op1_chat,
        "op2_langid": op2_langid,
        "op3_lmscore": op3_lmscore,
        "op4_bpe": op4_bpe,
        "op5_quality": op5_quality,
        "op6_warc": op6_warc,
        "op7_media": op7_media,
        "op8_tokens": op8_tokens,
        "op9_neardup": op9_neardup,
        "op10_mixing": op10_mixing,
        "op11_shards": op11_shards,
        "op12_fim": op12_fim,
        "op13_repair": op13_repair,
    }
