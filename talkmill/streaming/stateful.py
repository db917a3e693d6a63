"""Stateful operators: a step function over the rows of a key, in order; the same step replays a table or follows a stream.

A step takes (state, row) and returns the new state and a list of output tuples. The state is a dictionary that JSON can hold.

A timed operator also has an alarm: the moment, by the state alone, at which something happens though no row comes. A stream
rings it when the watermark passes that moment, a replay before the first row at or after it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[dict, dict], tuple[dict, list[tuple]]]


@dataclass(frozen=True)
class Operator:
    """A step, its first state and the columns of its output (after the key).

    Together: for a replay, the rows of a key already follow each other in a partition, in order, and are not exchanged.
    """

    step: Step
    initial: dict
    output: str
    together: bool = field(default=False, kw_only=True)

    def _names(self) -> list[str]:
        return [c.split()[0] for c in self.output.split(", ")]

    def _run(self, state: dict, rows: pd.DataFrame, order: list[str]) -> tuple[dict, pd.DataFrame]:
        out: list[tuple] = []
        for row in rows.sort_values(order, kind="stable").to_dict("records"):
            state, more = self.step(state, row)
            out += more
        return state, pd.DataFrame(out, columns=self._names())

    def _dealt(self, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
        return rows if self.together else rows.repartition(key).sortWithinPartitions(key, *order)

    def replay(self, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
        """The rows of each key, in order. They stream through one task in Arrow batches, and the state is all that is held of them; rows without a key take no part."""
        step, first, names = self.step, json.dumps(self.initial), self._names()

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, state = None, None
            for b in batches:
                out: list[tuple] = []
                for row in b.to_dict("records"):
                    if state is None or row[key] != now:
                        now, state = row[key], json.loads(first)
                    state, more = step(state, row)
                    out += [(now, *m) for m in more]
                yield pd.DataFrame(out, columns=[key, *names])

        dealt = self._dealt(rows.where(F.col(key).isNotNull()), key, order)
        return dealt.mapInPandas(each, f"{key} {dict(rows.dtypes)[key]}, {self.output}")

    def follow(self, stream: DataFrame, key: str, order: list[str]) -> DataFrame:
        """A stream's rows as they arrive; inside a batch they are ordered, across batches the state goes on."""

        def each(keys: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
            state = json.loads(held.get[0]) if held.exists else json.loads(json.dumps(self.initial))
            state, out = self._run(state, pd.concat(list(parts)), order)
            held.update((json.dumps(state),))
            out.insert(0, key, keys[0])
            yield out

        schema = f"{key} {dict(stream.dtypes)[key]}, {self.output}"
        return stream.groupBy(key).applyInPandasWithState(each, schema, "state string", "append", GroupStateTimeout.NoTimeout)


@dataclass(frozen=True)
class TimedOperator(Operator):
    """An operator with alarms. Rows have a column `ms`, the milliseconds of the epoch.

    `alarm` gives the next moment in ms, or None; `ring` takes the state and that moment and returns as a step does, with a later
    alarm or none. Rows without `ms` take no part. A row at the alarm's very moment comes after it.
    """

    alarm: Callable[[dict], int | None]
    ring: Step

    def rung(self, state: dict, until: float) -> tuple[dict, list[tuple]]:
        """The state and output after all alarms up to a moment."""
        out: list[tuple] = []
        while (at := self.alarm(state)) is not None and at <= until:
            state, more = self.ring(state, at)
            out += more
        return state, out

    def _timed(self, state: dict, row: dict) -> tuple[dict, list[tuple]]:
        state, out = self.rung(state, row["ms"])
        state, more = self.step(state, row)
        return state, out + more

    def replay(self, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
        """As of `Operator`; after a key's last row all its alarms ring, as on a stream whose watermark has passed them."""
        first, names, timed, rung = json.dumps(self.initial), self._names(), self._timed, self.rung

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, state = None, None
            for b in batches:
                out: list[tuple] = []
                for row in b.to_dict("records"):
                    if state is None or row[key] != now:
                        if state is not None:
                            out += [(now, *m) for m in rung(state, float("inf"))[1]]
                        now, state = row[key], json.loads(first)
                    state, more = timed(state, row)
                    out += [(now, *m) for m in more]
                yield pd.DataFrame(out, columns=[key, *names])
            if state is not None:
                yield pd.DataFrame([(now, *m) for m in rung(state, float("inf"))[1]], columns=[key, *names])

        dealt = self._dealt(rows.where(F.col(key).isNotNull() & F.col("ms").isNotNull()), key, ["ms", *order])
        return dealt.mapInPandas(each, f"{key} {dict(rows.dtypes)[key]}, {self.output}")

    def follow(self, stream: DataFrame, key: str, order: list[str], late: str = "10 seconds") -> DataFrame:
        """A stream's rows as they arrive; alarms ring when the watermark, `late` behind the newest `ms` of the stream, has passed them.

        Rows at or before the watermark are too late and take no part.
        """

        def each(keys: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
            state = json.loads(held.get[0]) if held.exists else json.loads(json.dumps(self.initial))
            if held.hasTimedOut:
                state, out = self.rung(state, held.getCurrentWatermarkMs())
            else:
                out = []
                for row in pd.concat(list(parts)).sort_values(["ms", *order], kind="stable").to_dict("records"):
                    state, more = self._timed(state, row)
                    out += more
            held.update((json.dumps(state),))
            at = self.alarm(state)
            if at is not None:
                held.setTimeoutTimestamp(max(int(at), held.getCurrentWatermarkMs() + 1))
            yield pd.DataFrame([(keys[0], *m) for m in out], columns=[key, *self._names()])

        rows = stream.where(F.col(key).isNotNull() & F.col("ms").isNotNull()).withColumn("_at", F.timestamp_millis("ms")).withWatermark("_at", late)
        schema = f"{key} {dict(stream.dtypes)[key]}, {self.output}"
        return rows.groupBy(key).applyInPandasWithState(each, schema, "state string", "append", GroupStateTimeout.EventTimeTimeout)
