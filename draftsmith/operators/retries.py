"""Retries with exponential back-off over a ledger of attempts.

A request is known by its key columns.  Each round asks for the replies of all
requests that are due and appends one row an attempt to the ledger: its number,
when it was made, how it ended, and when the next one is due.  An attempt without
a reply, or with an error, is *transient* and is made again ``base ** attempt``
seconds later, ``max_retries`` times; an invalid reply is *permanent* and never
asked for again.  What is due is an anti join with the finished requests and a
filter on the due time, so any number of requests wait at once and the state
outlives the job: a restarted run goes on with the ledger it finds.

A round is written once, to a folder of its own that a repeated round overwrites;
attempts and replies are in the same rows, so they cannot disagree.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from draftsmith.streaming.jobs import read_if_written

MAX_RETRIES = 3
BASE = 2.0
KEY = ("sample_id", "turn")


def read_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """All attempts so far (None: there are none)."""
    return read_if_written(spark, folder, "*")


def latest(ledger: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Each request's last attempt."""
    last = F.max_by(F.struct("attempt", "outcome", "due"), "attempt")
    return ledger.groupBy(*key).agg(last.alias("_l")).select(*key, "_l.*")


def due_requests(requests: DataFrame, ledger: DataFrame | None, now: float, key: tuple[str, ...] = KEY) -> DataFrame:
    """Requests to ask for at ``now``, with the number of the attempt as ``attempt``."""
    if ledger is None:
        return requests.withColumn("attempt", F.lit(1))
    last = latest(ledger, key)
    todo = requests.join(last.filter("outcome <> 'transient'").select(*key), list(key), "left_anti")
    waiting = last.filter("outcome = 'transient'").select(*key, (F.col("attempt") + 1).alias("attempt"), "due")
    return todo.join(waiting, list(key), "left").filter(F.col("due").isNull() | (F.col("due") <= now)).withColumn("attempt", F.coalesce("attempt", F.lit(1))).drop("due")


def attempts(asked: DataFrame, replies: DataFrame, now: float, permanent: Column | str, key: tuple[str, ...] = KEY, max_retries: int = MAX_RETRIES, base: float = BASE) -> DataFrame:
    """Ledger rows of one round: ``key, attempt, at, outcome`` (``ok``, ``transient``,
    ``permanent``, or ``exhausted`` for a last transient failure), ``due``, and the
    columns of ``replies(key, reply, error, ...)``.  ``permanent`` is the condition
    of an invalid reply."""
    answered = replies.withColumn("_answered", F.lit(True))
    j = asked.select(*key, "attempt").join(answered, list(key), "left")
    good = F.col("_answered").isNotNull() & F.col("error").isNull()
    failed = F.when(F.col("attempt") > max_retries, "exhausted").otherwise("transient")
    invalid = F.expr(permanent) if isinstance(permanent, str) else permanent
    outcome = F.when(F.coalesce(invalid, F.lit(False)), "permanent").when(good, "ok").otherwise(failed)
    j = j.withColumn("outcome", outcome).withColumn("at", F.lit(float(now)))
    due = F.when(F.col("outcome") == "transient", F.col("at") + F.pow(F.lit(base), F.col("attempt")))
    error = F.when(F.col("_answered").isNull(), "no reply").otherwise(F.col("error"))
    return j.withColumn("due", due).withColumn("error", error).drop("_answered")


def ask_until_done(
    requests: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    folder: str,
    permanent: Column | str,
    *,
    key: tuple[str, ...] = KEY,
    max_retries: int = MAX_RETRIES,
    base: float = BASE,
    clock: Callable[[], float] = time.time,
    sleep: Callable[[float], None] = time.sleep,
    max_rounds: int | None = None,
) -> DataFrame:
    """Rounds of due requests → ``answer`` (due requests in, reply rows out) → ledger,
    until no request waits (or ``max_rounds``).  Between rounds the driver sleeps
    until the next request is due.  Returns the ledger."""
    spark = requests.sparkSession
    rounds = 0
    while max_rounds is None or rounds < max_rounds:
        ledger = read_ledger(spark, folder)
        number = 0 if ledger is None else ledger.agg(F.max("round")).first()[0] + 1
        now = clock()
        asked = due_requests(requests, ledger, now, key)
        if ledger is not None and asked.isEmpty():
            # the soonest of the requests that still wait
            waiting = latest(ledger, key).filter("outcome = 'transient'").join(requests.select(*key), list(key), "left_semi")
            soonest = waiting.agg(F.min("due")).first()[0]
            if soonest is None:
                break
            sleep(max(0.0, soonest - now))
            continue
        attempts(asked, answer(asked), now, permanent, key, max_retries, base).write.mode("overwrite").parquet(f"{folder}/round={number}")
        rounds += 1
        if ledger is None and read_ledger(spark, folder).isEmpty():
            break  # nothing to ask
    return read_ledger(spark, folder)
