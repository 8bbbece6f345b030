"""Operators that keep a state for each key over all epochs, in Spark's state store: a restart from the checkpoint goes on with it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _type(stream: DataFrame, col: str) -> str:
    return stream.schema[col].dataType.simpleString()


def _plain(value: Any) -> Any:
    """A value of pandas as Python's own, null as None."""
    import pandas as pd

    if value is None or value is pd.NaT or value != value:
        return None
    return value.to_pydatetime() if isinstance(value, pd.Timestamp) else value.item() if hasattr(value, "item") else value


def _values(series) -> list:
    return [v for v in map(_plain, series) if v is not None]


def state_machine(stream: DataFrame, key: str, value: str, transition: Callable[[Any, list], tuple[Any, Iterable]], state: str, output: str) -> DataFrame:
    """(key, output) of a machine for each key: transition(old state or None, the epoch's values) -> (new state, what is put out).

    state and output are types, as in "long". Values of an epoch come in no order; null ones are left out. Keys keep their type.
    """

    def step(k: tuple, batches: Iterator, held) -> Iterator:
        import pandas as pd

        values = [v for b in batches for v in _values(b[value])]
        new, out = transition(held.get[0] if held.exists else None, values)
        if new is not None:
            held.update((new,))
        if out := list(out):
            yield pd.DataFrame({key: [k[0]] * len(out), "output": out})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return stream.select(key, value).groupBy(key).applyInPandasWithState(step, f"{key} {_type(stream, key)}, output {output}", f"state {state}", "append", GroupStateTimeout.NoTimeout)


def blocking_aggregate(stream: DataFrame, key: str, value: str, better: Callable[[Iterable], Any] = min) -> DataFrame:
    """(key, output): the best value of each key over all epochs, put out once an epoch where it has changed."""
    return state_machine(stream, key, value, _Best(better, False), _type(stream, value), _type(stream, value))


def streaming_aggregate(stream: DataFrame, key: str, value: str, better: Callable[[Iterable], Any] = min) -> DataFrame:
    """The same, put out at every improvement, as the values come."""
    return state_machine(stream, key, value, _Best(better, True), _type(stream, value), _type(stream, value))


class _Best:
    def __init__(self, better: Callable[[Iterable], Any], every: bool):
        self.better, self.every = better, every

    def __call__(self, held: Any, values: list) -> tuple[Any, list]:
        out, now = [], held
        for v in values:
            best = v if now is None else self.better((now, v))
            if best != now:
                now = best
                out.append(best)
        return now, out if self.every else out[-1:]


def distinct(stream: DataFrame, *cols: str) -> DataFrame:
    """Each record once, over all epochs."""
    return stream.select(*cols).dropDuplicates(list(cols)) if cols else stream.dropDuplicates()


def lookups(puts_and_gets: DataFrame, key: str, value: str, is_get: Column) -> DataFrame:
    """(key, value): the last value put for each request so far. Within an epoch puts come before requests, and of several puts the greatest counts.

    Key and value keep their types, so that 10 is greater than 9. Requests without a value yet have no answer; a null value is no put.
    """

    def step(k: tuple, batches: Iterator, held) -> Iterator:
        import pandas as pd

        n, puts = 0, []
        for b in batches:
            n += int(b["is_get"].sum())
            puts += _values(b.loc[~b["is_get"], value])
        if puts:
            held.update((max(puts),))
        if n and held.exists:
            yield pd.DataFrame({key: [k[0]] * n, value: [held.get[0]] * n})

    from pyspark.sql.streaming.state import GroupStateTimeout

    rows = puts_and_gets.select(key, value, F.coalesce(is_get, F.lit(False)).alias("is_get"))
    of_value = _type(rows, value)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {_type(rows, key)}, {value} {of_value}", f"state {of_value}", "append", GroupStateTimeout.NoTimeout)
