"""Simulation of a cache over a trace of accesses."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ordered import folded


def lru_hits(trace: DataFrame, capacity: int) -> DataFrame:
    """part, hits, misses of a cache of `capacity` entries over each part's ordered accesses."""

    def begin():
        cache: OrderedDict = OrderedDict()

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            hits = 0
            for key in pdf["key"]:
                if key in cache:
                    cache.move_to_end(key)
                    hits += 1
                else:
                    cache[key] = True
                    if len(cache) > capacity:
                        cache.popitem(last=False)
            return pd.DataFrame({"part": [pdf["part"].iloc[0]], "hits": [hits], "misses": [len(pdf) - hits]})

        return step

    parts = folded(trace.select("part", "seq", "key"), "part", ["seq"], begin, "part long, hits long, misses long")
    return parts.groupBy("part").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
