"""Streams whose results depend on the order of event times: rows wait in state until the watermark has passed them, then go through a step in order;
timers of event time report what did not happen. A state of Spark's holds the keys of a bucket, as each costs milliseconds a batch."""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Callable, Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType, _parse_datatype_string

from tesserae.ship import ship

#: From a key's state and a row to the new state and rows of output.
Step = Callable[[object, tuple], tuple[object, list[tuple]]]
#: From a key's state and the watermark (seconds) to the new state, rows of output, and when to look again (seconds, or None).
Timer = Callable[[object, float], tuple[object, list[tuple], float | None]]


#: Spark's clock of a new stream is at 0 seconds, and rows there would be late; times are counted from here. Times before -START are late.
START = 86_400

#: Keys share so many states, whatever their number; a stream that goes on must keep it.
BUCKETS = 2048


def in_order(rows: DataFrame, key: str, time: str, order: list[str], columns: list[str], delay: str, step: Step, timer: Timer | None, schema: str) -> DataFrame:
    """What step and timer give for the rows of each key, in the order of `time` (seconds) and `order`; the key comes first in the output.

    A row waits until the newest row of all keys is `delay` further; results do not depend on batches or files, as long as no row comes
    later than that. Rows that do are left out, as everywhere behind a watermark. A bucket holds its keys' states and the rows of that time alone.
    timer is asked whenever the watermark has moved past the time it named, with rows or without.
    """
    ship(rows.sparkSession)
    names: list[str] = StructType.fieldNames(_parse_datatype_string(schema))
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS)))  # null alone, so the others' numbers stay whole in pandas
    r = rows.select(bucket.cast("int").alias("_bucket"), F.col(key).alias("_key"), F.timestamp_seconds(F.col(time) + START).alias("_at"), F.col(time).cast("double").alias("_t"), *order, *columns).withWatermark("_at", delay)
    by = itemgetter(*range(1, 2 + len(order))) if order else itemgetter(1)
    ms = lambda t: round((t + START) * 1000)

    def run(k: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        states, held = pickle.loads(group.get[0]) if group.exists else ({}, [])  # key to (state, when to look again)
        touched = set()
        if not group.hasTimedOut:
            for b in batches:
                keys = b["_key"].tolist() if k[0] >= 0 else [None] * len(b)
                touched.update(keys)
                held += zip(keys, *(b[c].tolist() for c in ("_t", *order, *columns)))
        now = group.getCurrentWatermarkMs()
        held.sort(key=by)
        n = bisect_right(held, now, key=lambda x: ms(x[1]))
        out: list[tuple] = []
        for x in held[:n]:
            state, got = step(states.get(x[0], (None, None))[0], x[1:])
            states[x[0]] = state, None
            out += [(x[0], *o) for o in got]
        again = ms(held[n][1]) - 1 if n < len(held) else None
        if timer:
            touched.update(x[0] for x in held[:n])
            touched.update(key for key, (_, due) in states.items() if due is not None and ms(due) <= now)
            for key in touched:
                state, got, due = timer(states.get(key, (None, None))[0], now / 1000 - START)
                states[key] = state, due
                out += [(key, *o) for o in got]
            first = min((ms(due) for _, due in states.values() if due is not None), default=None)
            again = first if again is None else again if first is None else min(again, first)
        held, states = held[n:], {key: x for key, x in states.items() if x != (None, None)}
        if held or states:
            group.update((pickle.dumps((states, held)),))
            if again is not None:
                group.setTimeoutTimestamp(max(again, now + 1))
        elif group.exists:
            group.remove()
        if out:
            yield pd.DataFrame(out, columns=names, dtype=object)

    return r.groupBy("_bucket").applyInPandasWithState(run, schema, "kept binary", "append", GroupStateTimeout.EventTimeTimeout)


def connections(updates: DataFrame, delay: str, timeout: float) -> DataFrame:
    """(source_id, t, connected) whenever a source's connection changes: up with its first update, down when `timeout` seconds have passed since its last
    one, whether another one of it ever comes or not: then the others' times move the clock. updates: source_id, seq, t."""

    def step(last: float | None, r: tuple) -> tuple[float, list[tuple]]:
        if last is None:
            return r[0], [(r[0], True)]
        return r[0], [(last + timeout, False), (r[0], True)] if r[0] - last > timeout else []

    def timer(last: float | None, now: float) -> tuple[float | None, list[tuple], float | None]:
        if last is None:
            return None, [], None
        if now > last + timeout:
            return None, [(last + timeout, False)], None
        return last, [], last + timeout

    return in_order(updates, "source_id", "t", ["seq"], [], delay, step, timer, "source_id long, t double, connected boolean")
