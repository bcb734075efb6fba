"""Components of the graph in which two factors' levels meet, on the cluster."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder, so that lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="demeanor-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint()


def pair_components(df: DataFrame, q: str, r: str) -> DataFrame:
    """(factor 0 or 1, q or r level, component) of all levels; a component's name is its smallest level of ``q``.

    Every level is pointed at the smallest one among itself and its neighbours, and links are replaced by links
    to that one, first those to larger levels and then those to smaller ones, until all are stars. The number
    of rounds grows with the logarithm of the longest path. Rows in which a factor is null link nothing.
    """
    types = [df.schema[c].dataType.simpleString() for c in (q, r)]
    node = lambda k, of: F.struct(F.lit(k).alias("k"), *[(F.col(f"`{c}`") if j == k else F.lit(None)).cast(t).alias(n) for j, (c, t, n) in enumerate(zip((q, r), types, "qr"))]).alias(of)
    known = df.where(F.col(f"`{q}`").isNotNull() & F.col(f"`{r}`").isNotNull())
    edges = _cut(known.select(node(1, "a"), node(0, "b")).distinct())  # b < a
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("to"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("to").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("to"))
        small = large.join(least, "a").where("b <> to").select(F.col("b").alias("a"), F.col("to").alias("b")).unionAll(least.select("a", F.col("to").alias("b"))).distinct()
        new = _cut(small)
        if new.count() == edges.count() and new.join(edges, ["a", "b"], "left_anti").isEmpty():
            break
        edges = new
    ends = edges.unionAll(edges.select(F.col("b").alias("a"), "b").distinct())
    return ends.select(F.col("a.k").alias("factor"), F.col("a.q").alias(q), F.col("a.r").alias(r), F.col("b.q").alias("component"))


def largest_component(df: DataFrame, q: str, r: str) -> DataFrame:
    """The rows of the component with most rows; of equal ones, that with the smallest level of ``q``."""
    of = pair_components(df, q, r).where("factor = 0").select(F.col(q).alias("__level"), F.col("component").alias("__component"))
    rows = df.join(of, F.col(f"`{q}`") == F.col("__level"))
    best = rows.where(F.col(f"`{r}`").isNotNull()).groupBy("__component").count().orderBy(F.desc("count"), "__component").limit(1)
    return rows.join(F.broadcast(best.select("__component")), "__component", "left_semi").where(F.col(f"`{r}`").isNotNull()).select(*[F.col(f"`{c}`") for c in df.columns])
