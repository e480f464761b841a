"""Rows in order: the ones before them, running counts, and folds, without a task that holds a whole key.

The order is cut into stretches.  Ordered windows run within a key's stretch; what a later stretch needs of
the earlier ones is one row a stretch, and only these are windowed over a whole key.  A fold that cannot be
cut has a task a key, which reads the key's sorted rows as a stream and holds one batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(rows: DataFrame, by: str, order: list[str], stretch: Column, **previous: str) -> DataFrame:
    """rows and, under each given name, a column's value in the row of `by` before it (null in the first).
    `stretch` must not fall along the order, whose columns' values tell rows apart."""
    cut = rows.withColumn("__stretch", stretch)
    own = F.struct(*[F.col(c).alias(n) for n, c in previous.items()])
    near = cut.withColumn("__before", F.lag(own).over(Window.partitionBy(by, "__stretch").orderBy(*order)))
    last = cut.groupBy(by, "__stretch").agg(F.max_by(own, F.struct(*order)).alias("__last"))
    carried = last.select(by, "__stretch", F.lag("__last").over(Window.partitionBy(by).orderBy("__stretch")).alias("__carried"))
    seen = near.join(carried, [by, "__stretch"]).withColumn("__before", F.coalesce("__before", "__carried"))
    return seen.withColumns({n: F.col(f"__before.{n}") for n in previous}).drop("__stretch", "__before", "__carried")


def running_count(rows: DataFrame, by: str, order: list[str], stretch: Column, flag: str, name: str) -> DataFrame:
    """rows and how many rows of `by` up to each have the flag."""
    cut = rows.withColumn("__stretch", stretch)
    near = cut.withColumn("__near", F.count_if(flag).over(Window.partitionBy(by, "__stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    earlier = Window.partitionBy(by).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    counted = cut.groupBy(by, "__stretch").agg(F.count_if(flag).alias("__n"))
    before = counted.select(by, "__stretch", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__earlier"))
    return near.join(before, [by, "__stretch"]).withColumn(name, F.col("__near") + F.col("__earlier")).drop("__stretch", "__near", "__earlier")


def folded(rows: DataFrame, by: str, order: list[str], begin: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """For each value of `by`, begin() gives a function that is called with one batch after another of its rows in
    order, and whose frames are the result."""

    def run(frames):
        last, step = None, None
        for pdf in frames:
            keys = pdf[by].to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(pdf)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a < b:
                    if step is None or keys[a] != last:
                        last, step = keys[a], begin()
                    yield step(pdf.iloc[a:b])

    return rows.repartition(by).sortWithinPartitions(by, *order).mapInPandas(run, schema)
