"""Models as hooks: who is asked what, how often, and what a failure costs."""

from __future__ import annotations

import glob
import json
import os
import uuid

import pytest

from tideline.plans import scoring

ROWS = "stream_id string, seq bigint, t double, event_type string, confidence double, motion double, text string"


def logging_model(folder: str, name: str, fail=(), answer=None):
    """A model that writes down each call and each time it is made."""
    def load():
        open(f"{folder}/{name}-made-{uuid.uuid4().hex}", "w").close()

        def ask(rows):
            with open(f"{folder}/{name}-call-{uuid.uuid4().hex}", "w") as f:
                json.dump([r["text"] for r in rows], f)
            if any(r["text"] in fail for r in rows):
                raise RuntimeError("no")
            return [answer(r) if answer else f"said {r['text']}" for r in rows]

        return ask

    return load


def calls(folder: str, name: str) -> list[list[str]]:
    return [json.load(open(p)) for p in glob.glob(f"{folder}/{name}-call-*")]


def rows_of(spark, texts):
    return spark.createDataFrame([("s", i, float(i), "goal", 0.9, 0.0, t) for i, t in enumerate(texts)], ROWS)


def test_each_thing_is_asked_once(spark, tmp_path):
    d = str(tmp_path)
    scorer = scoring.Scorer("once", logging_model(d, "once"), batch_rows=4)
    rows = rows_of(spark, ["a", "b", "a", "c", None, "b"] * 3).repartition(3)
    for _ in range(2):
        got = {(r["seq"], r["response"]) for r in scoring.answered(rows, scorer, ["text"], f"{d}/store").collect()}
        assert got == {(i, f"said {t}") for i, t in enumerate(["a", "b", "a", "c", None, "b"] * 3)}
    asked = [x for c in calls(d, "once") for x in c]
    assert sorted(map(str, asked)) == ["None", "a", "b", "c"]
    # a run with one more row asks for that row only
    scoring.answered(rows_of(spark, ["a", "new"]), scorer, ["text"], f"{d}/store").collect()
    assert sorted(map(str, (x for c in calls(d, "once") for x in c))) == ["None", "a", "b", "c", "new"]
    # another version of the model knows nothing
    again = scoring.Scorer("once-2", logging_model(d, "second"))
    assert scoring.known_answers(spark, again, f"{d}/store").count() == 0


def test_batches_keep_both_bounds(spark, tmp_path):
    rows = [("k", {"text": "x" * n}) for n in (10, 10, 10, 500, 1, 1, 1, 1, 1)]
    assert [[len(r["text"]) for _, r in b] for b in scoring.batched(rows, 4, 25)] == [[10, 10], [10], [500], [1, 1, 1, 1], [1]]
    assert list(scoring.batched([], 4, 25)) == []
    d = str(tmp_path)
    scorer = scoring.Scorer("bounds", logging_model(d, "bounds"), batch_rows=5)
    scoring.answered(rows_of(spark, [f"t{i}" for i in range(23)]).coalesce(1), scorer, ["text"], f"{d}/store").count()
    assert max(map(len, calls(d, "bounds"))) <= 5 and sum(map(len, calls(d, "bounds"))) == 23


def test_a_worker_makes_its_model_once(spark, tmp_path):
    d = str(tmp_path)
    scorer = scoring.Scorer(f"made-{uuid.uuid4().hex}", logging_model(d, "made"), batch_rows=2)
    scoring.answered(rows_of(spark, [f"t{i}" for i in range(64)]).repartition(16), scorer, ["text"], f"{d}/store").count()
    assert len(calls(d, "made")) >= 32 and len(glob.glob(f"{d}/made-made-*")) <= 8


def test_a_failure_costs_its_row_only_and_is_asked_again(spark, tmp_path):
    d = str(tmp_path)
    rows = rows_of(spark, ["a", "bad", "c"]).coalesce(1)
    broken = scoring.Scorer("model", logging_model(d, "broken", fail=("bad",)))
    got = {r["text"]: r["response"] for r in scoring.answered(rows, broken, ["text"], f"{d}/store").collect()}
    assert got == {"a": "said a", "bad": None, "c": "said c"}
    from tideline.plans.scoring import _models  # the driver's own; workers of the fixture keep theirs by name

    assert "model" not in _models
    mended = scoring.Scorer("model", logging_model(d, "mended"))
    kept = spark.read.parquet(f"{d}/store/model=model").where("response is null").collect()
    assert [r["error"] for r in kept] == ["RuntimeError: no"]
    assert scoring.known_answers(spark, mended, f"{d}/store").count() == 2


def test_a_run_fails_where_it_may_not_go_on(spark, tmp_path):
    d = str(tmp_path)
    strict = scoring.Scorer("strict", logging_model(d, "strict", fail=("bad",)), fail_open=False)
    with pytest.raises(Exception, match="no"):
        scoring.answered(rows_of(spark, ["bad"]), strict, ["text"], f"{d}/store")
    assert scoring.known_answers(spark, strict, f"{d}/store").count() == 0
    short = scoring.Scorer("short", lambda: lambda rows: [], fail_open=True)
    assert [r["response"] for r in scoring.answered(rows_of(spark, ["a"]), short, ["text"], f"{d}/store").collect()] == [None]


def verdict(event, confidence):
    return json.dumps({"event": event, "confidence": confidence})


def test_only_doubtful_rows_reach_the_second_tier(spark, tmp_path):
    d = str(tmp_path)
    said = {"sure": verdict("catch", 0.95), "weak": verdict("catch", 0.61), "key": verdict("goal", 0.99), "none": verdict("none", 0.9), "odd": "mumble"}
    punch, texts = verdict("punch", 0.8), ["sure"] * 8 + ["weak", "key", "none", "odd"]
    rows = spark.createDataFrame([("s", i, float(i), "catch", 0.4, 0.0, f"{t}:{i}") for i, t in enumerate(texts)], ROWS)
    one = scoring.Scorer("one", logging_model(d, "one", answer=lambda r: said[r["text"].split(":")[0]]))
    two = scoring.Scorer("two", logging_model(d, "two", answer=lambda r: None if r["text"].startswith("key") else punch))
    for _ in range(2):
        got = {r["text"].split(":")[0]: (r["tier"], r["result"], r["event_type"], r["confidence"]) for r in scoring.two_tiers(rows, one, two, ["text"], f"{d}/store", ["goal"]).collect()}
        assert got == {"sure": ("tier1", "confirmed", "catch", 0.95), "weak": ("tier1", "confirmed", "catch", 0.61), "none": ("tier1", "rejected", None, 0.9), "key": ("tier1", "confirmed", "goal", 0.99), "odd": ("tier2", "confirmed", "punch", 0.8)}
    first, second = ([x for c in calls(d, n) for x in c] for n in ("one", "two"))
    assert sorted(first) == sorted(f"{t}:{i}" for i, t in enumerate(texts))
    # the row without an answer is asked once more by the second run, the other never again
    assert sorted(set(second)) == ["key:9", "odd:11"] and second.count("odd:11") == 1 and second.count("key:9") <= 4


def test_one_tier_alone_and_a_stream_whose_first_tier_is_broken(spark, tmp_path):
    d = str(tmp_path)
    rows = spark.createDataFrame([("s", i, float(i), "catch", 0.4, 0.0, f"x{i}") for i in range(20)], ROWS)
    penalty, catch = verdict("penalty", 0.9), verdict("catch", 0.7)
    one = scoring.Scorer("always-goal", logging_model(d, "always", answer=lambda r: penalty))
    alone = scoring.two_tiers(rows, one, None, ["text"], f"{d}/store", [])
    assert {r["tier"] for r in alone.collect()} == {"tier1"}
    two = scoring.Scorer("second", logging_model(d, "second", answer=lambda r: catch))
    both = scoring.two_tiers(rows, one, two, ["text"], f"{d}/store", [], expected={"penalty": 0.02})
    assert {(r["tier"], r["event_type"]) for r in both.collect()} == {("tier2", "catch")}
    assert sum(map(len, calls(d, "always"))) == 20 and sum(map(len, calls(d, "second"))) == 20


def test_a_model_that_cannot_be_made_lets_rows_pass(spark, tmp_path):
    def load():
        raise OSError("no weights")

    rows = rows_of(spark, ["a", "b"])
    out = scoring.verdicts(rows, scoring.Scorer("absent", load), ["text"], f"{tmp_path}/store", "tier1").collect()
    assert {(r["result"], r["event_type"], r["confidence"]) for r in out} == {("uncertain", None, 0.9)}
    assert os.path.isdir(f"{tmp_path}/store/model=absent")
