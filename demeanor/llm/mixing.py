"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each document gets a count from a Poisson distribution whose mean is its source's target repetition
rate, inverted at a uniform number hashed from the seed and the document's identity; the document is
exploded by that count and the copies are dealt out by a hash, which orders them globally. A null
source is a source of its own; a null identity hashes like the empty text. Rows that are equal get
equal counts. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_SOURCES, BROADCAST_VALUES = 10_000, 1_000_000
NO_SOURCE = "\x00null"


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the seed and the parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_table(rate: Column) -> Column:
    """Cumulative probabilities for 0, 1, ... so far that the rest is below double precision."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    logs = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct((-rate).alias("p"), F.array(F.exp(-rate)).alias("c")),
        lambda a, k: F.struct((a["p"] + F.log(rate) - F.log(k.cast("double"))).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + F.exp(a["p"] + F.log(rate) - F.log(k.cast("double"))))).alias("c")),
        lambda a: a["c"],
    )
    return F.when(rate > 0, logs).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, source: str = "source", total: float | None = None) -> DataFrame:
    """One row a source: documents, target share and mean repetition rate.

    Without ``weights``, a source's share goes with its document count to the power ``temperature``.
    ``total``: documents wanted in all; as many as there are, if not given. With ``weights``, sources
    that are not named get weight 0.
    """
    n = docs.groupBy(F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(NO_SOURCE)).alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        raw = F.pow(F.col("_n").cast("double"), F.lit(float(temperature)))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(NO_SOURCE if k is None else k), F.lit(float(v)))]
        raw = F.coalesce(F.element_at(F.create_map(*pairs), F.col("_source")), F.lit(0.0)) if pairs else F.lit(0.0)
    n = n.select("_source", "_n", raw.alias("_raw"))
    whole = n.agg(F.sum("_raw").alias("w"), F.sum("_n").alias("n")).first()
    wanted = float(total) if total is not None else float(whole["n"] or 0)
    share = F.col("_raw") / F.lit(whole["w"]) if whole["w"] else F.lit(0.0)
    return n.select("_source", "_n", share.alias("_share"), (share * F.lit(wanted) / F.col("_n")).alias("_rate"))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, seed: int = 20, key: str = "doc_id", source: str = "source", shuffle: bool = True, extra: bool = True) -> DataFrame:
    """Documents repeated to the target mix; all columns stay.

    With ``extra``, adds ``mix_rate``, ``mix_copy`` (0, 1, ...), and ``mix_order`` (the hash that orders
    the copies globally); they replace columns of those names. With ``shuffle``, partitions are ranges of
    ``mix_order``, sorted by it.
    """
    rates = source_rates(docs, weights, temperature, source)
    rates = rates.select("_source", "_rate", poisson_table(F.col("_rate")).alias("_cdf"))
    size = rates.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("_cdf")), F.lit(0)).alias("values")).first()
    few = size["n"] <= BROADCAST_SOURCES and size["values"] <= BROADCAST_VALUES
    packed = docs.select(F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(NO_SOURCE)).alias("_source"), F.col(f"`{key}`").cast("string").alias("_key"), F.struct("*").alias("_row"))
    joined = packed.join(F.broadcast(rates) if few else rates, "_source").withColumn("_u", uniform(seed, F.col("_key")))
    counted = joined.withColumn("_count", F.size(F.filter("_cdf", lambda c: c <= F.col("_u"))))
    copies = counted.where("_count > 0").select("_row", "_key", F.col("_rate").alias("mix_rate"), F.explode(F.sequence(F.lit(0), F.col("_count") - 1)).alias("mix_copy"))
    out = copies.withColumn("mix_order", F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.coalesce("_key", F.lit("")), F.col("mix_copy").cast("string")).cast("binary")))
    if shuffle:
        # The hash is uniform, so equal ranges of it need no sampling pass.
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        number = F.conv(F.substring("mix_order", 1, 8), 16, 10).cast("long") * F.lit(parts)
        out = out.repartitionById(parts, F.shiftright(number, 32).cast("int")).sortWithinPartitions("mix_order")
    own = ["mix_rate", "mix_copy", "mix_order"] if extra else []
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in own], *own)
