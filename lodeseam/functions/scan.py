"""A pass over an array inside its row, with a state: Spark has folds, but none that gives what it met on the way."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def once(build: Callable[[], Column]) -> Callable[[], Column]:
    """The same expression at every call: a long one takes a second to put together."""
    held: dict[str, object] = {}

    @wraps(build)
    def get() -> Column:
        if held.get("jvm") is not SparkContext._gateway:
            held.update(jvm=SparkContext._gateway, column=build())
        return held["column"]

    return get


def none(kind: str) -> Column:
    """An empty array."""
    return F.array().cast(f"array<{kind}>")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value told once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column, Column], Column], kind: str) -> Column:
    """``(state, out)`` after all items. ``step(state, item)`` is the next state, ``emit(state, item, next)`` an
    array of what the item gives.

    A fold copies its state at every step. So what is given is gathered in blocks of about the root of the number of
    items and laid aside: n items cost n times that root, not n times n."""

    def one(acc: Column, item: Column) -> Column:
        return let(step(acc["state"], item), lambda now: F.struct(now.alias("state"), F.concat(acc["given"], emit(acc["state"], item, now)).alias("given")))

    def block(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["state"].alias("state"), none(kind).alias("given")), one)
        return let(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["done"], F.array(r["given"])).alias("done")))

    def parts(items: Column, size: Column) -> Column:
        firsts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), size)).otherwise(none("int"))
        return F.transform(firsts, lambda at: F.slice(items, at, size))

    def whole(items: Column) -> Column:
        size = F.greatest(F.lit(32), F.ceil(F.sqrt(F.size(items))).cast("int"))
        begin = F.struct(zero.alias("state"), none(f"array<{kind}>").alias("done"))
        return F.aggregate(parts(items, size), begin, block, lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["done"]).alias("out")))

    return let(items, whole)

