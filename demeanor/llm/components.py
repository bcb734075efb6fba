"""Connected components of links, by repeated contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, comp) for every id in ``links`` (a, b), comp being the smallest id of its component.

    Each round points every id at its smallest neighbour, if that is smaller, follows the pointers to
    their ends by doubling, and puts the ends in place of the links' ids. Nulls link with nothing.
    """
    edges = scratch.save(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    label = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = scratch.save(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("comp"), F.lit(True).alias("moved")), "smallest")
        while True:
            far = to.select(F.col("id").alias("_i"), F.col("comp").alias("_c")).where("_i <> _c")
            new = to.join(far, to["comp"] == far["_i"], "left").select("id", F.coalesce("_c", "comp").alias("comp"), F.col("_c").isNotNull().alias("moved"))
            new = scratch.save(new, "jump")
            scratch.drop(to)
            to = new
            if new.where("moved").isEmpty():
                break
        at_a, at_b = to.select(F.col("id").alias("a"), F.col("comp").alias("ca")), to.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
        rest = edges.join(at_a, "a").join(at_b, "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
        rest = scratch.save(rest, "contracted")
        scratch.drop(edges)
        edges = rest
        if label is None:
            label = to
        else:
            step = to.select(F.col("id").alias("_i"), F.col("comp").alias("_c"))
            new = scratch.save(label.join(step, label["comp"] == step["_i"], "left").select("id", F.coalesce("_c", "comp").alias("comp")), "label")
            scratch.drop(label, to)
            label = new
        if edges.isEmpty():
            scratch.drop(edges)
            return label
