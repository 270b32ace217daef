"""Answering: the generator's errors, retries and what it is not asked."""

import pytest

from lodeseam.operators import answer as A
from lodeseam.operators.search import NO_EVIDENCE


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "question string, evidence string")


def test_answers_cite_their_evidence(spark):
    got = A.answer(asked(spark, ("a?", "[S1] file: x\n[S2] y [S9]"), ("b?", None), ("c?", " \n"), ("d?", "[S3] z"))).collect()
    assert {r.question: r.answer for r in got} == {"a?": "See [S1], [S2]", "b?": NO_EVIDENCE, "c?": NO_EVIDENCE, "d?": "See [S3]"}
    assert A.answer(asked(spark)).count() == 0


def test_the_generator_is_not_asked_without_evidence(spark):
    def never(prompts):
        raise AssertionError("asked")

    assert A.answer(asked(spark, ("b?", None), ("c?", "")), never).count() == 2


def test_lost_connections_are_tried_again():
    calls = []

    def flaky(prompts):
        calls.append(len(prompts))
        if len(calls) < 2:
            raise ConnectionError
        return ["x"] * len(prompts)

    assert A.called(flaky, ["a", "b"], 2) == ["x", "x"] and calls == [2, 2]
    calls.clear()
    with pytest.raises(ConnectionError):
        A.called(flaky, ["a"], 1)


def test_empty_answers_are_errors(spark):
    for bad in ("", " \n", None):
        with pytest.raises(A.EmptyAnswer):
            A.called(lambda prompts: [bad], ["a"], 1)
    with pytest.raises(ValueError):
        A.called(lambda prompts: [], ["a"], 1)
    with pytest.raises(Exception, match="empty answer"):
        A.answer(asked(spark, ("a?", "[S1] x")), lambda prompts: [""] * len(prompts)).collect()
