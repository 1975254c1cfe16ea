"""A memory pool of bounded size with least-importance eviction, as a stateful stream operator.

A request for an item in the pool is a hit and adds one to its importance. A miss takes a free slot,
or that of the least important item, the lowest slot of equals, with importance 1. Items belong to
pools by a key, and a pool's requests are handled in order of seq.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = "pool bigint, seq bigint, item bigint, hit boolean, evicted bigint"


class Pool:
    """One pool: slots of (item, importance)."""

    def __init__(self, capacity: int, slots: list[tuple[int, int]] | None = None):
        if capacity <= 0:
            raise ValueError("capacity must be positive")
        self.capacity, self.slots = capacity, list(slots or [])
        self.place = {item: i for i, (item, _) in enumerate(self.slots)}

    def request(self, item: int) -> tuple[bool, int | None]:
        """(hit, evicted item)"""
        if item in self.place:
            i = self.place[item]
            self.slots[i] = (item, self.slots[i][1] + 1)
            return True, None
        if len(self.slots) < self.capacity:
            self.place[item] = len(self.slots)
            self.slots.append((item, 1))
            return False, None
        i = min(range(len(self.slots)), key=lambda j: (self.slots[j][1], j))
        old = self.slots[i][0]
        del self.place[old]
        self.slots[i], self.place[item] = (item, 1), i
        return False, old


def _answers(pool: Pool, key: int, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("seq")
    said = [pool.request(int(i)) for i in rows["item"]]
    return pd.DataFrame({"pool": key, "seq": rows["seq"].to_numpy(), "item": rows["item"].to_numpy(), "hit": [h for h, _ in said], "evicted": pd.array([e for _, e in said], "Int64")})


def replay(requests: DataFrame, capacity: int) -> DataFrame:
    """(pool, seq, item, hit, evicted) of a table of requests(pool, seq, item).

    A pool is sequential by nature; Arrow streams its rows in order of seq, and only its slots are held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, key = None, None
        for rows in batches:
            for name, part in rows.groupby("pool", sort=False):
                if name != key:
                    own, key = Pool(capacity), name
                yield _answers(own, int(name), part)

    return requests.select("pool", "seq", "item").repartition("pool").sortWithinPartitions("pool", "seq").mapInPandas(run, _OUT)


class _Processor(StatefulProcessor):
    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("slots", "items array<bigint>, importance array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else None
        pool = Pool(self.capacity, list(zip(old[0], old[1])) if old else None)
        for part in rows:
            yield _answers(pool, key[0], part)
        self.state.update(([i for i, _ in pool.slots], [n for _, n in pool.slots]))

    def close(self) -> None:
        pass


def stream(requests: DataFrame, capacity: int) -> DataFrame:
    """The same over a stream: the slots are the state of each pool (needs the RocksDB state store)."""
    return requests.groupBy("pool").transformWithStateInPandas(_Processor(capacity), _OUT, "Append", "None")


def hit_rate(answers: DataFrame) -> DataFrame:
    """(pool, n_requests, n_hits, n_evicted)"""
    return answers.groupBy("pool").agg(F.count(F.lit(1)).alias("n_requests"), F.sum(F.col("hit").cast("bigint")).alias("n_hits"), F.count("evicted").alias("n_evicted"))


def first_requests(requests: DataFrame) -> DataFrame:
    """Requests that are an item's first in its pool: misses whatever the capacity."""
    order = Window.partitionBy("pool", "item").orderBy("seq")
    return requests.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
