"""Answers kept across runs, and models that fail."""

import pandas as pd
import pytest

from folioscan.operators import answers as A

CALLS = "prompt string, language string"


def calls_of(spark, prompts):
    return spark.createDataFrame([(p, "fr") for p in prompts], CALLS)


def recording(folder, model):
    """The model, with every prompt it is asked written to a file of its own."""
    def run(calls):
        import uuid
        for p in calls["prompt"]:
            (folder / uuid.uuid4().hex).write_text(str(p))
        return model(calls)

    return run


def asked(folder):
    found = sorted(f.read_text() for f in folder.iterdir())
    for f in folder.iterdir():
        f.unlink()
    return found


def test_a_second_run_asks_only_what_is_new(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    store = A.open_answers(spark, str(tmp_path / "kept"), 4)
    model = recording(log, lambda c: c["prompt"].str.upper())
    first = A.answer_new(calls_of(spark, ["a", "b", "b", ""]), store, model, 1)
    assert sorted(r[:] for r in first.collect()) == [("", "fr", None, None, "EmptyReply"),
                                                     ("a", "fr", "A", 1, None), ("b", "fr", "B", 1, None)]
    assert sorted(set(asked(log))) == ["", "a", "b"]
    # The table is known only by its folder, as to another session.
    spark.sql(f"DROP TABLE {store.table}")
    store = A.open_answers(spark, str(tmp_path / "kept"), 4)
    second = {r.prompt: (r.answer, r.run_no) for r in A.answer_new(
        calls_of(spark, ["a", "b", "c"]), store, model, 2).collect()}
    assert second == {"a": ("A", 1), "b": ("B", 1), "c": ("C", 2)}
    assert asked(log) == ["c"]
    assert A.unanswered(calls_of(spark, ["a", "c", "d"]), store).select("prompt").collect() == [("d",)]


def test_kept_answers_never_move(spark, tmp_path):
    store = A.open_answers(spark, str(tmp_path / "kept"), 4)
    A.answer_new(calls_of(spark, ["a", "b"]), store, lambda c: c["prompt"].str.upper(), 1)
    plan = A.unanswered(calls_of(spark, ["a", "d"]), store)._jdf.queryExecution().executedPlan().toString()
    _, _, side = plan.partition("Bucketed: true")
    assert side and "SortMergeJoin" in plan
    stored_side = plan[plan.rindex("Sort ", 0, plan.index("Bucketed: true")):plan.index("Bucketed: true")]
    assert "Exchange" not in stored_side and "REPARTITION_BY_NUM" in plan


def test_a_failing_batch_loses_nothing(spark, tmp_path):
    def model(calls):
        if calls["prompt"].str.startswith("bad").any():
            raise KeyError("refused")
        return ["" if p == "blank" else p * 2 for p in calls["prompt"]]

    store = A.open_answers(spark, str(tmp_path / "kept"), 2)
    prompts = [f"p{i}" for i in range(300)] + ["bad1", "bad2", "blank"]
    got = {r.prompt: r for r in A.answer_new(calls_of(spark, prompts), store, model, 1).collect()}
    assert len(got) == 303 and all(got[f"p{i}"].answer == f"p{i}" * 2 for i in range(300))
    assert {p: got[p].error_class for p in prompts[300:]} == {
        "bad1": "KeyError", "bad2": "KeyError", "blank": "EmptyReply"}


@pytest.mark.parametrize("n, bad", [(1, {0}), (7, set()), (64, {5}), (64, {0, 63}), (9, set(range(9)))])
def test_the_model_is_asked_a_bounded_number_of_times(n, bad):
    times = []

    def model(calls):
        times.append(len(calls))
        if bad & set(calls["prompt"]):
            raise TimeoutError
        return [str(p) for p in calls["prompt"]]

    got = A._replies(pd.DataFrame({"prompt": range(n)}), model, 3)
    assert got == [(None, "TimeoutError") if i in bad else (str(i), None) for i in range(n)]
    assert len(times) <= 2 * n + 3 * len(bad)


def test_a_passing_failure_and_a_wrong_count():
    state = {"n": 0}

    def shaky(calls):
        state["n"] += 1
        if state["n"] == 1:
            raise OSError
        return list(calls["prompt"])

    frame = pd.DataFrame({"prompt": ["a", "b"]})
    assert A._replies(frame, shaky, 3) == [("a", None), ("b", None)]
    assert A._replies(frame, lambda c: ["x"] * 3, 3) == [(None, "WrongCount")] * 2


def test_no_calls_and_missing_parts(spark, tmp_path):
    store = A.open_answers(spark, str(tmp_path / "kept"), 2)
    assert A.answer_new(spark.createDataFrame([], CALLS), store, lambda c: [], 1).isEmpty()
    rows = spark.createDataFrame([(None, "fr"), ("", "fr"), ("x", None), ("x", "")], CALLS)
    got = A.answer_new(rows, store, lambda c: ["yes"] * len(c), 1)
    assert got.count() == 4 and got.filter("answer = 'yes'").count() == 4


def test_calls_that_fail_by_themselves():
    """They are tried again together and cost the others nothing."""
    batches = []

    def model(calls):
        batches.append(list(calls["prompt"]))
        return [ValueError() if p % 5 == 0 else LookupError() if p == 7 and len(batches) < 3 else str(p)
                for p in calls["prompt"]]

    got = A._replies(pd.DataFrame({"prompt": range(10)}), model, 3)
    assert got == [(None, "ValueError") if p % 5 == 0 else (str(p), None) for p in range(10)]
    assert batches == [list(range(10)), [0, 5, 7], [0, 5, 7]]
