"""Reads for a batch of requests ``(seq, user_id)``: rows for the users that
are there, and a "not found" reason for each request whose user is not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_for(requests: DataFrame, known: DataFrame, answers: DataFrame, key: str, message: str
             ) -> tuple[DataFrame, DataFrame]:
    """``known(user_id, <key>)`` has one row per user that the read finds, and
    ``answers`` the read's rows by ``key``.  Returns (``seq`` and the answer's
    columns, rejects ``(seq, reason)``); a found user without rows gives
    neither.  Only the answers of requested users are joined."""
    found = requests.join(known.select("user_id", *([key] if key != "user_id" else [])), "user_id")
    wanted = answers.join(found.select(key).distinct(), key, "left_semi")
    rows = wanted.join(found.select("seq", key), key).select("seq", *answers.columns)
    rejects = requests.join(known.select("user_id"), "user_id", "left_anti").select("seq", F.lit(message).alias("reason"))
    return rows, rejects
