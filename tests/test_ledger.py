"""The labelling ledger: stopped runs, retries, odd sheets."""

import os
import uuid
from collections import Counter

import pytest

from postrisk.operators import ledger

ANN = (("a", 0.0, 10), ("b", 0.5, 20))


def _sheets(spark, n=60):
    rows = [(f"p{k}", f"text {k}", name, "1" if k % 10 == 0 else None, k) for k in range(n) for name, _, _ in ANN]
    return spark.createDataFrame(rows, "post_id string, text string, annotator string, label string, work int")


def _labeller(folder, break_at=None):
    """Labels by the prompt's last digit and the seed; notes every call in a file of its own; from the
    ``break_at``-th call on it raises."""
    def run(prompts, temperature, seed):
        import pandas as pd
        if break_at is not None and len(os.listdir(folder)) >= break_at:
            raise RuntimeError("stopped")
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.writelines(f"{seed}|{p.splitlines()[-1]}\n" for p in prompts.fillna("none"))
        last = prompts.str[-1].astype(int)
        return pd.Series([9 if d == 3 or (d + seed) % 4 == 0 else d % 2 for d in last]), ["r"] * len(prompts)
    return run


def _want(k, seed):
    d = k % 10
    if d == 0:
        return (1, 0)
    for attempt in range(3):
        if d != 3 and (d + seed + attempt) % 4:
            return (d % 2, attempt + 1)
    return (None, 3)


def test_killed_run_labels_no_committed_row_twice(spark, tmp_path):
    calls, path = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()
    sheets = _sheets(spark).coalesce(2)
    with pytest.raises(Exception, match="stopped"):
        ledger.run_ledger(sheets, _labeller(str(calls), break_at=12), path, ANN, commits=4)
    first = ledger.read_ledger(spark, path).collect()
    assert 0 < len({r.work for r in first}) < 108
    before = set(os.listdir(calls))
    assert ledger.run_ledger(sheets, _labeller(str(calls)), path, ANN, commits=4) > 0
    again = Counter(line for f in set(os.listdir(calls)) - before for line in open(calls / f).read().split("\n") if line)
    assert max(again.values()) == 1  # one call a row and seed in the second run
    seeds = {n: s for n, _, s in ANN}
    told = {f"{seeds[r.annotator] + r.attempt - 1}|text {r.post_id[1:]}" for r in first}
    assert not told & set(again)  # nothing that the first run committed
    log = ledger.read_ledger(spark, path)
    assert log.groupBy("work", "attempt").count().where("count > 1").isEmpty()
    got = {(r.post_id, r.annotator): (r.label, r.attempts) for r in ledger.labelled(sheets, path).collect()}
    assert got == {(f"p{k}", n): _want(k, s) for k in range(60) for n, _, s in ANN}
    assert ledger.run_ledger(sheets, _labeller(str(calls), break_at=0), path, ANN, commits=7) == 0  # nothing left to call


def test_stop_repeats_nulls_and_other_guidelines(spark, tmp_path):
    calls, path = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()
    odd = spark.createDataFrame([("x", "t 2", "a", None), ("x", "t 2", "a", None), (None, "t 2", "a", None), ("", "t 2", "a", None),
                                 ("x", "t 2", None, None), ("y", "t 5", "b", " 1 ")], "post_id string, text string, annotator string, label string")
    def run(**kw):
        return ledger.run_ledger(odd, lambda p, t, s: (p.str.len() * 0 + 1, ["r"] * len(p)), path, ANN, **kw)
    assert run(commits=64, stop_after=1) == 1
    some = ledger.labelled(odd, path)
    assert some.where("attempts = 1").count() >= 1 and some.where("label is null").count() >= 1
    run(commits=3)
    assert ledger.read_ledger(spark, path).count() == 4  # the repeated row is one piece of work
    rows = ledger.labelled(odd, path).collect()
    assert len(rows) == 6 and all(r.label == 1 for r in rows)
    assert [r.auto_reason for r in rows if r.post_id == "y"] == ["existing label"]
    assert run(guideline="Look twice.\n") > 0 and ledger.read_ledger(spark, path).count() == 8
    none = odd.where("false")
    assert ledger.run_ledger(none, None, str(tmp_path / "new"), ANN) == 0 and ledger.labelled(none, str(tmp_path / "new")).count() == 0
