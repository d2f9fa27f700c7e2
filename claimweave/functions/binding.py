"""Intermediate results that an expression uses more than once."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` over a struct of values that are each computed once a row, however often it names them.

    A column that names a column is copied into it wherever it stands; a lambda's argument isn't.
    """
    return F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), body).getItem(0)


def built_once(build: Callable) -> Callable:
    """A function of plain values (names, numbers) whose columns are built once: a large one takes seconds of calls to the JVM,
    and refers to columns by name, so any table may use it again."""
    made: dict[tuple, tuple] = {}

    @wraps(build)
    def get(*args):
        gateway = SparkContext._gateway
        if args not in made or made[args][0] is not gateway:
            made[args] = (gateway, build(*args))
        return made[args][1]

    return get
