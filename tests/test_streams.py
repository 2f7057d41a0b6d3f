"""Usage and phase streams over restarts, late and repeated rows."""

from __future__ import annotations

from datetime import datetime

from tessella.sources.stash import new_path
from tessella.streaming import usage

CALLS = "ts timestamp, purpose string, prompt_tokens long, completion_tokens long, failed boolean"
UPDATES = "record_id string, seq long, phase string"


def test_usage_goes_on_after_a_restart(spark):
    source, out, checkpoint = (new_path(spark, x) for x in ("calls", "usage", "usage-checkpoint"))
    jan, feb = datetime(2024, 1, 31, 23, 59), datetime(2024, 2, 1)
    parts = [
        [(jan, "answer", 10, 5, False), (jan, "judge", 7, 1, False), (jan, "answer", 99, 99, True)],
        [(feb, "answer", 1, 1, False), (jan, "answer", 3, None, None), (feb, None, 2, 2, False)],  # one late call, in its own month
    ]
    for part in parts:
        spark.createDataFrame(part, CALLS).coalesce(1).write.mode("append").parquet(source)
        usage.usage_stream(spark, source, out, checkpoint, CALLS)
        usage.usage_stream(spark, source, out, checkpoint, CALLS)  # nothing new
    found = {(r.month, r.purpose): (r.calls, r.tokens, r.failures) for r in usage.usage_of(spark, out).collect()}
    assert found == {
        ("2024-01", "answer"): (2, 18.0, 1),
        ("2024-01", "judge"): (1, 8.0, 0),
        ("2024-01", "(all)"): (3, 26.0, 1),
        ("2024-02", "answer"): (1, 2.0, 0),
        ("2024-02", ""): (1, 4.0, 0),
        ("2024-02", "(all)"): (2, 6.0, 0),
    }
    totals = [(r.month, r.purpose, r.calls) for r in spark.read.parquet(out).collect()]
    assert len(totals) == 5  # a batch hands on only what it changed: 2, then 3 rows


def test_phases_are_told_once(spark):
    source, out, checkpoint = (new_path(spark, x) for x in ("updates", "changes", "changes-checkpoint"))
    parts = [
        [("a", 1, "retrieving"), ("a", 3, "generating"), ("a", 2, "retrieving"), ("b", 1, "retrieving"), ("a", 3, "generating")],
        [("a", 4, "generating"), ("a", 2, "retrieving"), ("a", 5, "done"), ("b", 2, "retrieving")],
        [("b", 3, "error"), ("b", 4, "retrieving")],
    ]
    for part in parts:
        spark.createDataFrame(part, UPDATES).coalesce(1).write.mode("append").parquet(source)
        usage.phase_stream(spark, source, out, checkpoint, UPDATES)
    found = sorted(tuple(r) for r in usage.changes_of(spark, out).select("record_id", "seq", "phase").collect())
    assert found == [("a", 1, "retrieving"), ("a", 3, "generating"), ("a", 5, "done"), ("b", 1, "retrieving"), ("b", 3, "error"), ("b", 4, "retrieving")]
