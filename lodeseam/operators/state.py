"""Job and conversation state as append-only events: the current row of a key is a fold over its events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseam.functions.metadata import ACTIVE, PROGRESS

#: An event of this status begins a new epoch: what earlier epochs counted no longer holds.
RESET = "queued"


def progress(status: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in PROGRESS.items() for x in pair])
    return F.element_at(known, status)


def current(events: DataFrame, key: str, order: list[str], sticky: tuple[str, ...] = ()) -> DataFrame:
    """The latest event of each key, with the last value that is not null of each ``sticky`` column since its last reset.

    One shuffle on the key; events of a key are summed up in each task first, so a hot key costs one row a task."""
    at = F.struct(*order)
    reset = F.max(F.when(F.col("status") == RESET, at)).alias("reset")
    latest = events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), at).alias("latest"), reset)
    out = latest.select(key, "latest.*", "reset")
    if not sticky:
        return out.drop("reset")
    since = events.join(latest.select(F.col(key).alias("__key"), F.col("reset").alias("__reset")), F.col(key).eqNullSafe(F.col("__key")))
    since = since.where(F.col("__reset").isNull() | (at >= F.col("__reset")))
    kept = since.groupBy(F.col(key).alias("__key")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in sticky])
    return out.drop(*sticky, "reset").join(kept, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def history(events: DataFrame, key: str, order: list[str], sticky: tuple[str, ...]) -> DataFrame:
    """Every event with the sticky columns as they stood then, by epoch."""
    by_key = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    epochs = events.withColumn("epoch", F.sum((F.col("status") == RESET).cast("long")).over(by_key))
    by_epoch = Window.partitionBy(key, "epoch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return epochs.withColumns({c: F.last(c, ignorenulls=True).over(by_epoch) for c in sticky})


def recover_interrupted(rows: DataFrame) -> DataFrame:
    """Jobs that were active become failed; ``recovered`` tells which."""
    active = F.col("status").isin(*ACTIVE)
    return rows.withColumn("recovered", active).withColumn("status", F.when(active, F.lit("failed")).otherwise(F.col("status")))


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without the keys that are gone."""
    return parents.join(gone.select(key), key, "left_anti"), children.join(gone.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new``, and those of ``old`` that they don't replace."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def add_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """Only 'user' and 'assistant' may speak; any other role stops the query."""
    good = F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))
    checked = new.withColumn("role", F.when(good, F.col("role")).otherwise(F.raise_error(F.concat(F.lit("role "), F.coalesce("role", F.lit("null")))).cast("string")))
    return messages.unionByName(checked)


def _checked(new: DataFrame, guards: list[tuple[DataFrame, str]]) -> DataFrame:
    """``new``, if each of its keys is there, given once and free in its table; any that isn't stops what reads any key.

    New rows are counted by key together with the old ones' keys, so one shuffle on a key decides."""
    met, free, message = new, F.lit(True), F.lit("key exists already: ")
    for i, (old, key) in enumerate(guards):
        marks = old.select(key, F.lit(1).alias("n")).unionByName(new.select(key, F.lit(1).alias("n")))
        seen = marks.groupBy(F.col(key).alias(f"__key{i}")).agg(F.sum("n").alias(f"__n{i}"))
        met = met.join(seen, F.col(key).eqNullSafe(F.col(f"__key{i}")), "left")
        free = free & F.col(key).isNotNull() & (F.col(f"__n{i}") == 1)
        message = F.concat(message, F.lit(" " * bool(i)), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    guarded = {key: F.when(free, F.col(key)).otherwise(F.raise_error(message).cast(new.schema[key].dataType)) for _, key in guards}
    return met.withColumns(guarded).select(*new.columns)


def create(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` and the rows of ``new``; a key that is null, taken or given twice stops the query."""
    return old.unionByName(_checked(new, [(old, key)]))


def create_with_chat(jobs: DataFrame, chats: DataFrame, new: DataFrame, job: str = "job_id", chat: str = "chat_id") -> tuple[DataFrame, DataFrame]:
    """Jobs and chats with a row more in each for every row of ``new``. Both stand under one guard: if a job's or a chat's key
    is null, taken or given twice, neither table can be read, so that both are written or none."""
    checked = _checked(new, [(jobs, job), (chats, chat)])
    return jobs.unionByName(checked.select(*jobs.columns)), chats.unionByName(checked.select(*chats.columns))


def ready(asked: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """``asked`` with a column ``allowed``: a job must be ready; keys without a job are allowed."""
    states = jobs.select(F.col(key).alias("__key"), F.col("status").alias("__status"))
    met = asked.join(states, F.col(key) == F.col("__key"), "left")
    allowed = F.col("__key").isNull() | F.coalesce(F.col("__status") == "ready", F.lit(False))
    return met.withColumn("allowed", allowed).drop("__key", "__status")
