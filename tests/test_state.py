import pytest
from pyspark.errors import PySparkException

from lodeseam.operators import state


def jobs(spark, *rows):
    return spark.createDataFrame(list(rows), "job_id string, status string")


def test_create_refuses_taken_repeated_and_null_keys(spark):
    old = jobs(spark, ("a", "ready"))
    assert sorted(r.job_id for r in state.create(old, jobs(spark, ("b", "queued"), ("c", "queued")), "job_id").collect()) == ["a", "b", "c"]
    for bad in ([("a", "queued")], [("b", "queued"), ("b", "queued")], [(None, "queued")]):
        with pytest.raises(PySparkException, match="key exists already"):
            state.create(old, jobs(spark, *bad), "job_id").collect()


def test_ready_allows_unknown_keys_and_ready_jobs(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "job_id string")
    got = state.ready(asked, jobs(spark, ("a", "ready"), ("b", "failed")), "job_id").collect()
    assert {r.job_id: r.allowed for r in got} == {"a": True, "b": False, "c": True, None: True}


def test_job_and_chat_are_created_together_or_not_at_all(spark):
    old, chats = jobs(spark, ("a", "ready")), spark.createDataFrame([("c1", "a", "A")], "chat_id string, job_id string, title string")
    new = lambda *rows: spark.createDataFrame(list(rows), "job_id string, status string, chat_id string, title string")
    made, talked = state.create_with_chat(old, chats, new(("b", "queued", "c2", "B"), ("d", "queued", "c3", "D")))
    assert sorted(map(tuple, made.collect())) == [("a", "ready"), ("b", "queued"), ("d", "queued")]
    assert sorted(map(tuple, talked.collect())) == [("c1", "a", "A"), ("c2", "b", "B"), ("c3", "d", "D")]
    for bad in (("b", "queued", "c1", "B"), ("a", "queued", "c2", "B"), ("b", "queued", None, "B"), (None, "queued", "c2", "B")):
        for table in state.create_with_chat(old, chats, new(("e", "queued", "c9", "E"), bad)):
            with pytest.raises(PySparkException, match="key exists already"):
                table.collect()


def test_failed_jobs_keep_their_progress(spark):
    from pyspark.sql import functions as F

    rows = [("a", 1, "queued"), ("a", 2, "embedding"), ("a", 3, "failed"), ("b", 1, "ready"), ("b", 2, "queued"), ("b", 3, "failed"), ("c", 1, "failed")]
    events = spark.createDataFrame(rows, "job_id string, at int, status string").withColumn("progress", state.progress(F.col("status")))
    got = {r.job_id: (r.status, r.progress) for r in state.current(events, "job_id", ["at"], ("progress",)).collect()}
    assert got == {"a": ("failed", 60), "b": ("failed", 0), "c": ("failed", None)}
