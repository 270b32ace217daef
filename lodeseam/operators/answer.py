"""Answers to many questions in one plan: a generator is called on Arrow batches of prompts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseam.operators.search import NO_EVIDENCE, prompt

#: From prompts to answers, as many and in order. A lost connection is a ConnectionError.
Generator = Callable[[list[str]], list[str]]


class EmptyAnswer(RuntimeError):
    """The generator gave no text."""


def citing(prompts: list[str]) -> list[str]:
    """Stands in for a model: names what the evidence of each prompt is marked with, in order."""
    return ["See " + ", ".join(dict.fromkeys(re.findall(r"^\[\w+\]", p, re.M))) for p in prompts]


def called(generator: Generator, prompts: list[str], attempts: int) -> list[str]:
    """Ask again where the connection was lost before an answer came; an empty answer is an error, never a result."""
    for attempt in range(1, attempts + 1):
        try:
            answers = generator(prompts)
            break
        except ConnectionError:
            if attempt == attempts:
                raise
    if len(answers) != len(prompts):
        raise ValueError(f"{len(prompts)} prompts, {len(answers)} answers")
    for text in answers:
        if not (text or "").strip():
            raise EmptyAnswer("the generator gave an empty answer")
    return answers


def answer(asked: DataFrame, generator: Generator | None = None, attempts: int = 2) -> DataFrame:
    """``asked`` with a column ``answer``, from its ``question`` and ``evidence``. Where there is no evidence, or it is blank,
    the answer is fixed and the generator is not called. Rows stay where they are; only those with evidence meet Python."""
    has = F.coalesce(F.col("evidence").rlike(r"(?U)\S"), F.lit(False))
    kind = T.StructType([*asked.schema.fields, T.StructField("answer", T.StringType())])
    generator = generator or citing

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prompts = batch.pop("prompt_")
            yield batch.assign(answer=called(generator, prompts.tolist(), attempts) if len(batch) else [])

    told = asked.where(has).withColumn("prompt_", prompt(F.col("question"), F.col("evidence"))).mapInPandas(work, kind)
    return told.unionByName(asked.where(~has).withColumn("answer", F.lit(NO_EVIDENCE)))
