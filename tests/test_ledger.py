"""The ledger of replies: what is sent, and what is not sent again."""

import pytest
from pyspark.sql import functions as F

from tableviews.operators import exchange, ledger


def requests_of(spark, prompts):
    frame = spark.createDataFrame(list(enumerate(prompts)), "k long, p string")
    return exchange.make_requests(frame, "answer", ["k"], F.col("p"))


def counting(folder):
    """A function that answers by length and notes each prompt that it gets."""
    def fn(prompts):
        import uuid
        from pathlib import Path

        Path(f"{folder}/{uuid.uuid4().hex}").write_text("\n".join(prompts))
        return [f"{len(p)} letters" for p in prompts]

    return fn


def calls(folder):
    return sorted(line for file in folder.iterdir() for line in file.read_text().split("\n"))


@pytest.fixture
def places(tmp_path):
    (tmp_path / "calls").mkdir()
    return f"file://{tmp_path}/ledger", tmp_path / "calls"


def test_equal_prompts_are_sent_once_and_known_ones_never_again(spark, places):
    folder, seen = places
    first = requests_of(spark, ["a", "bb", "a", "ccc", None, "a"])
    assert ledger.send(first, folder, counting(seen), "one", batch_prompts=2) == (3, 0, 0)
    assert calls(seen) == ["a", "bb", "ccc"]
    second = requests_of(spark, ["a", "dddd", "bb", "dddd"])
    assert ledger.send(second, folder, counting(seen), "two") == (1, 0, 0)
    assert ledger.send(second, folder, counting(seen), "three") == (0, 0, 0)
    assert calls(seen) == ["a", "bb", "ccc", "dddd"]
    told = exchange.attach_replies(second, ledger.answered(second, folder))
    assert sorted((r.k, r.text, r.error) for r in told.collect()) == [(0, "1 letters", None), (1, "4 letters", None), (2, "2 letters", None), (3, "4 letters", None)]
    assert {r.text: r.wave for r in ledger.answered(second, folder).collect()} == {"1 letters": "one", "2 letters": "one", "4 letters": "two"}
    lost = exchange.attach_replies(first, ledger.answered(first, folder)).filter("error IS NOT NULL")
    assert [r.k for r in lost.collect()] == [4]


def test_a_run_that_stops_keeps_its_finished_batches(spark, places):
    folder, seen = places
    prompts = [f"prompt {k}" for k in range(40)]
    whole = counting(seen)

    def breaks(given):
        if "prompt 13" in given:
            raise RuntimeError("the service is down")
        return whole(given)

    with pytest.raises(Exception, match="service is down"):
        ledger.send(requests_of(spark, prompts).coalesce(1), folder, breaks, batch_prompts=3)
    kept = calls(seen)
    assert "prompt 13" not in kept and {r.text for r in ledger.replies(spark, folder).collect()} <= {"8 letters", "9 letters"}
    assert ledger.replies(spark, folder).count() == len(kept)
    # what is answered is not sent again
    assert ledger.send(requests_of(spark, prompts), folder, whole, batch_prompts=3).sent == 40 - len(kept)
    assert calls(seen) == sorted(prompts) and ledger.replies(spark, folder).count() == 40


def test_a_task_that_runs_again_finds_its_finished_batches(spark, places, monkeypatch):
    folder, seen = places
    requests = requests_of(spark, ["x", "y", "z"])
    ledger.send(requests, folder, counting(seen), batch_prompts=10)
    # the same open prompts once more, as a second attempt at the task has them
    monkeypatch.setattr(ledger, "pending", lambda requests, folder: requests.select(ledger.prompt_key(F.col("prompt")).alias("prompt_key"), "prompt"))
    assert ledger.send(requests, folder, counting(seen), batch_prompts=10) == (0, 3, 0)
    assert calls(seen) == ["x", "y", "z"]


def test_silent_prompts_stay_open(spark, places):
    folder, _ = places
    requests = requests_of(spark, ["x", "y", ""])
    assert ledger.send(requests, folder, lambda prompts: [None if p == "x" else " " if p == "" else "ok" for p in prompts]) == (3, 0, 2)
    assert sorted(r.prompt for r in ledger.pending(requests, folder).collect()) == ["", "x"]
    assert ledger.send(requests, folder, lambda prompts: ["late"] * len(prompts)).sent == 2


def test_a_wrong_number_of_replies_is_an_error(spark, places):
    with pytest.raises(Exception, match="2 prompts got 1 replies"):
        ledger.send(requests_of(spark, ["x", "y"]), places[0], lambda prompts: ["one"])


def test_no_requests(spark, places):
    none = requests_of(spark, ["x"]).limit(0)
    assert ledger.send(none, places[0], lambda prompts: []) == (0, 0, 0) and ledger.answered(none, places[0]).count() == 0
