"""Attempt ledger."""

from pyspark.sql import functions as F

from draftsmith.operators.retries import ask_until_done, due_requests, latest, read_ledger

PERMANENT = "error = 'invalid'"


class Clock:
    """Time that passes by sleeping only."""

    def __init__(self, now=100.0):
        self.now, self.slept = now, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def _requests(spark):
    return spark.createDataFrame([(i, t, f"question {i}.{t}") for i in range(6) for t in (1, 3)], "sample_id long, turn long, text string")


def _answer(calls):
    """Request i: answers after i failures (0 to 3); 4 never answers; 5 is invalid.
    Turn 3 fails without any reply row."""

    def answer(asked):
        calls.append(sorted((r.sample_id, r.turn, r.attempt) for r in asked.collect()))
        failed = F.col("attempt") <= F.when(F.col("sample_id") == 4, 99).otherwise(F.col("sample_id"))
        error = F.when(F.col("sample_id") == 5, "invalid").when(failed, "timeout")
        out = asked.select("sample_id", "turn", F.when(error.isNull(), F.concat(F.lit("re: "), "text")).alias("reply"), error.alias("error"))
        return out.filter((F.col("turn") == 1) | F.col("error").isNull() | (F.col("error") == "invalid"))

    return answer


def test_attempts_and_due_times(spark, tmp_path):
    clock, calls = Clock(), []
    done = ask_until_done(_requests(spark), _answer(calls), str(tmp_path / "l"), PERMANENT, clock=clock, sleep=clock.sleep)
    assert clock.slept == [2.0, 4.0, 8.0]
    got = {(r.sample_id, r.turn, r.attempt): (r.at, r.outcome, r.due) for r in done.collect()}
    at = {1: 100.0, 2: 102.0, 3: 106.0, 4: 114.0}
    for turn in (1, 3):
        for i in range(4):
            for k in range(1, i + 1):
                assert got[i, turn, k] == (at[k], "transient", at[k] + 2.0**k)
            assert got[i, turn, i + 1] == (at[i + 1], "ok", None)
        assert got[4, turn, 3] == (106.0, "transient", 114.0) and got[4, turn, 4] == (114.0, "exhausted", None)
        assert got[5, turn, 1] == (100.0, "permanent", None)
    assert len(got) == 2 * (1 + 2 + 3 + 4 + 4 + 1)
    # nothing is asked for twice in a round, nothing finished is asked for again
    assert [len(c) for c in calls] == [12, 8, 6, 4]
    errors = {(r.turn, r.error) for r in done.filter("outcome = 'exhausted'").collect()}
    assert errors == {(1, "timeout"), (3, "no reply")}
    assert {r.reply for r in done.filter("outcome = 'ok'").collect()} == {f"re: question {i}.{t}" for i in range(4) for t in (1, 3)}


def test_state_outlives_a_restart(spark, tmp_path):
    folder, clock, calls = str(tmp_path / "l"), Clock(), []
    ask_until_done(_requests(spark), _answer(calls), folder, PERMANENT, clock=clock, sleep=clock.sleep, max_rounds=1)
    # a new run too early: only what has never been asked for is due
    more = _requests(spark).unionAll(spark.createDataFrame([(0, 9, "late")], "sample_id long, turn long, text string"))
    early = due_requests(more, read_ledger(spark, folder), 101.0)
    assert [(r.sample_id, r.turn, r.attempt) for r in early.collect()] == [(0, 9, 1)]
    due = due_requests(more, read_ledger(spark, folder), 102.0)
    assert sorted((r.sample_id, r.attempt) for r in due.collect()) == [(0, 1)] + [(i, 2) for i in (1, 1, 2, 2, 3, 3, 4, 4)]
    clock.now = 200.0  # a long break
    done = ask_until_done(more, _answer(calls), folder, PERMANENT, clock=clock, sleep=clock.sleep)
    ended = {(r.sample_id, r.turn): (r.attempt, r.outcome) for r in latest(done).collect()}
    assert ended == {(i, t): (i + 1, "ok") for i in range(4) for t in (1, 3)} | {(4, t): (4, "exhausted") for t in (1, 3)} | {(5, t): (1, "permanent") for t in (1, 3)} | {(0, 9): (1, "ok")}
    n = len(calls)
    ask_until_done(more, _answer(calls), folder, PERMANENT, clock=clock, sleep=clock.sleep)
    assert len(calls) == n  # nothing left to ask


def test_no_requests(spark, tmp_path):
    done = ask_until_done(_requests(spark).limit(0), _answer([]), str(tmp_path / "l"), PERMANENT)
    assert done.count() == 0
