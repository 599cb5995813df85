"""Joins with a table of hot keys, where the key itself must not decide the task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 64
SALT = "_salt"


def join_salted(df: DataFrame, few: DataFrame, keys: Sequence[str], spread_by: Sequence[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """``df`` joined with ``few`` on ``keys``; the rows of a key go to ``salts`` tasks by a hash of ``spread_by``.

    ``few`` has at most one row per key and is repeated ``salts`` times: Spark's size check sees it before that, so the
    copies are merged and never broadcast. Null keys match nothing.
    """
    spread = df.withColumn(SALT, F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    copies = few.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies.hint("merge"), [*keys, SALT], how).drop(SALT)
