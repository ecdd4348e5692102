"""Requests for a score matched with their answers, both of which are streams.

A request is pending until its answer comes or its time is up; an answer without a pending request is ignored, and so is a second
one. Watermarks bound what is kept: a request leaves the state when it is answered or can be answered no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIMEOUT = "60 seconds"
DELAY = "2 minutes"
NO_SCORE, TIMED_OUT = "no score in the answer", "timed out"


def outcomes(requests: DataFrame, answers: DataFrame, timeout: str = TIMEOUT, delay: str = DELAY) -> DataFrame:
    """One row for each request (id, asked_at, and more): its columns, answered_at, score, error.

    answers: (id, answered_at, score, error); of an id's answers the first counts. An answer's error is the request's, an answer
    without a score is one, and a request without an answer in time is TIMED_OUT. Rows may come late by the delay.
    """
    asked = requests.withWatermark("asked_at", delay)
    said = answers.select(F.col("id").alias("answer_id"), "answered_at", "score", F.col("error").alias("said")).withWatermark("answered_at", delay)
    if said.isStreaming:
        said = said.dropDuplicatesWithinWatermark(["answer_id"])
    else:
        first = said.groupBy("answer_id").agg(F.min_by(F.struct("answered_at", "score", "said"), F.struct("answered_at", "score", "said")).alias("a"))
        said = first.select("answer_id", "a.*")
    in_time = (F.col("id") == F.col("answer_id")) & (F.col("answered_at") >= F.col("asked_at")) & (F.col("answered_at") <= F.col("asked_at") + F.expr(f"INTERVAL {timeout}"))
    both = asked.join(said, in_time, "left_outer")
    error = F.when(F.col("answer_id").isNull(), TIMED_OUT).otherwise(F.coalesce("said", F.when(F.col("score").isNull() | F.isnan("score"), NO_SCORE)))
    return both.select(*requests.columns, "answered_at", F.when(error.isNull(), F.col("score")).alias("score"), error.alias("error"))
