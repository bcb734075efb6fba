"""Designs whose largest factor has so many levels that they, and vectors of them, stay on the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .design import Design, gather, sweep

NONE = (1 << 31) - 1


class Far:
    """A design without its far factor, ``near``, and blocks of observations in which the far one is eliminated.

    Vectors have the unknowns of the other factors alone. The far factor's coefficients are the means, by its levels, of what the
    others leave of the response; they are columns of Spark, made only when something asks for them.
    """

    def __init__(self, design: Design):
        self.design, self.name = design, design.factors[design.far]
        self.near = Design(design.df, [f for f in design.factors if f != self.name], design.weight, most_pairs=design.most_pairs)
        self.gone = (self.near.n_factors, NONE, NONE)

    def blocks(self, y: Column) -> DataFrame:
        """Observations dealt out by ranges of the far factor, whose neighbours tend to share the other factors' levels."""
        return self.near.encode(y, self.name)

    def product(self, blocks: DataFrame, x: np.ndarray) -> np.ndarray:
        return sweep(blocks, x, gone=self.gone)[0]

    def left(self, blocks: DataFrame, x: np.ndarray) -> np.ndarray:
        """D'W of what the near unknowns and the far factor leave of the response."""
        return sweep(blocks, -x, 1.0, gone=self.gone)[0]

    def _less_near(self, y: Column, x: np.ndarray, keep: list[str]) -> DataFrame:
        return gather(self.design.df, self.near.factors, self.near.coefficient_tables(x), "__fit").select(*keep, (y - F.col("__fit")).alias("__left"))

    def demeaned(self, df: DataFrame, name: str, x: np.ndarray, out: str) -> DataFrame:
        """``df``, rows of the design, and what all factors leave of the response."""
        df = gather(df, self.near.factors, self.near.coefficient_tables(x), "__fit")
        by, w = Window.partitionBy(F.col(f"`{self.name}`")), self.design.w
        rest = F.col(f"`{name}`").cast("double") - F.col("__fit")
        mean = F.coalesce(F.try_divide(F.sum(w * rest).over(by), F.sum(w).over(by)), F.lit(0.0))
        return df.withColumn(out, rest - mean).drop("__fit")

    def coefficients(self, name: str, x: np.ndarray, coef: str = "coef") -> DataFrame:
        """factor, level (as text), dof and coefficient of every level, in the order of the design's factors."""
        w, spark, k = self.design.w, self.design.df.sparkSession, self.design.far
        kind = self.design.df.schema[self.name].dataType.simpleString()
        rows = self._less_near(F.col(f"`{name}`").cast("double"), x, [F.col(f"`{self.name}`").alias("level"), w.alias("__w")])
        far = rows.groupBy("level").agg(F.coalesce(F.try_divide(F.sum(F.col("__w") * F.col("__left")), F.sum("__w")), F.lit(0.0)).alias("c")).sort("level")
        start = sum(n for f, n in zip(self.near.factors, self.near.n_levels) if self.design.factors.index(f) < k)
        far = spark.createDataFrame(far.rdd.zipWithIndex().map(lambda r: (r[0][0], r[1] + start, r[0][1])), f"level {kind}, dof long, c double").persist()
        n = far.count()
        near = self.near.coefficients(x, coef).withColumn("dof", F.when(F.col("dof") >= start, F.col("dof") + n).otherwise(F.col("dof")))
        return near.unionAll(far.select(F.lit(self.name).alias("factor"), F.col("level").cast("string").alias("level"), "dof", F.col("c").alias(coef)))


def squares(blocks: DataFrame) -> float:
    """The square of the length of the far factor's part of D'W y, from one pass over the blocks, where it is the last one."""
    import pyarrow as pa

    last = f"d{sum(f[0] == 'd' for f in blocks.columns) - 1}"

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                get = lambda name, kind: np.frombuffer(b.column(name)[row].as_buffer(), kind)  # noqa: B023, E731
                y = get("y", float)
                total = np.bincount(get(last, np.int32), y * get("w", float) if b.column("w")[row].is_valid else y)
                yield pa.RecordBatch.from_arrays([pa.array([float(total @ total)])], ["s"])

    return float(sum(r[0] for r in blocks.mapInArrow(run, "s double").collect()))
