"""Embedding near-duplicates: a subspace pigeonhole join.

Unit vectors with cosine c lie at squared distance 2 - 2c. Vectors are turned by a fixed random
rotation and split into blocks of few dimensions, each with a share of the squared distance in
proportion to its dimensions: two vectors that link keep the budget of at least one block. Each
block is a range join: cells of its first coordinate, as wide as the budget and the slack by which pairs
are given to blocks, meet their neighbours, in tiles of bounded size, and pairs that keep the block's budget
become candidates. Candidates are
verified exactly, in double precision, on the whole vectors; a pair counts in the first block that
proposes it.

Equal vectors collapse first; their copies count as links. A tile pair gives each vector's number of
links and a forest of links, never the pairs themselves. Vectors that are null, zero, or hold null or
non-finite components link with nothing, nor do vectors of different length. Null ids have a null
component; rows that repeat an id are each returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

BLOCK_DIMENSIONS = 16
TILE = 1 << 15
PAIRS_AT_ONCE = 1 << 21
SEED = 3
SLACK = 1e-5  # single precision finds candidates, generously; double precision decides


def _rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def _vector(v) -> np.ndarray | None:
    if v is None or len(v) == 0 or any(x is None for x in v):
        return None
    x = np.asarray(v, np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    return x if top > 0 else None


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=-1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def _signed(kind: str):
    """id, a 128-bit signature (null if the vector links with nothing) and the vector's bytes as numbers of this kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two, raw = [], [], []
            for v in b.column(1).to_pylist():
                x = _vector(v)
                s = (None, None) if x is None else np.frombuffer(xxhash.xxh3_128_digest((x + 0.0).tobytes()), np.int64).tolist()
                one.append(s[0])
                two.append(s[1])
                raw.append(None if x is None else (x + 0.0).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(raw, pa.binary())], ["vec_id", "s1", "s2", "v"])

    return run


def _read(raw, kind: str, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(-1, d).astype(np.float64)


def _plan(d: int, distance: float) -> list[tuple[slice, float]]:
    n = max(1, d // BLOCK_DIMENSIONS)
    ends = [round(k * d / n) for k in range(n + 1)]
    return [(slice(a, b), distance * (b - a) / d) for a, b in zip(ends, ends[1:])]


def _cells(d: int, kind: str, distance: float):
    """(block, cell, id, vector) of each vector, once for each block."""
    rotation, plan = _rotation(d), _plan(d, distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                if not b.num_rows:
                    continue
                raw = b.column("v").to_pylist()
                x = _unit(_read(raw, kind, d)) @ rotation
                for k, (part, budget) in enumerate(plan):
                    cell = np.floor(x[:, part.start] / np.sqrt(budget + SLACK)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), k, np.int32)), pa.array(cell), b.column("id"), b.column("copies"), b.column("v")], ["block", "cell", "id", "copies", "v"])

    return run


class Forest:
    """A spanning forest of links between places 0 to n - 1; links inside one tree leave no trace."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.label[a] != self.label[b]
        if not apart.any():
            return
        parent = self.label

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for x, y in set(zip(a[apart].tolist(), b[apart].tolist())):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                self.links.append((x, y))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def _compare(d: int, kind: str, least: float, distance: float):
    """Links of one pair of tiles (or of a tile with itself)."""
    rotation, plan = _rotation(d), _plan(d, distance)

    def run(key, pdf):
        import pandas as pd

        block, same = int(key[0]), bool(key[4])
        left = pdf[pdf["side"] == 0].sort_values("id")
        right = left if same else pdf[pdf["side"] == 1].sort_values("id")
        nothing = pd.DataFrame({"kind": [], "a": [], "b": []}).astype("int64")
        if not len(left) or not len(right):
            return nothing
        u = [_unit(_read(s["v"], kind, d)) for s in ((left,) if same else (left, right))] * (2 if same else 1)
        rotated = [(x @ rotation).astype(np.float32) for x in u[: 2 - same]] * (1 + same)
        part, budget = plan[block]
        x, y = rotated[0][:, part], rotated[1][:, part]
        y2 = (y * y).sum(axis=1)
        # Pairs are found, verified and folded some rows at a time: what is held does not grow with the number of pairs.
        base = 0 if same else len(left)
        forest = Forest(base + len(right))
        copies = [s["copies"].to_numpy() for s in (left, right)]
        n_left, n_right = np.zeros(len(left)), np.zeros(len(right))
        rows_at_once = max(1, PAIRS_AT_ONCE // len(y))
        for at in range(0, len(x), rows_at_once):
            some = x[at : at + rows_at_once]
            apart = (some * some).sum(axis=1)[:, None] + y2 - 2 * (some @ y.T)
            i, j = np.nonzero(apart <= budget + SLACK)
            i += at
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 16):
                p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                # the first block with the pair in its budget, in the same arithmetic everywhere, owns it
                ok = ((rotated[0][p, part] - rotated[1][q, part]) ** 2).sum(axis=1) <= budget + SLACK / 2
                for e, most in plan[:block]:
                    ok &= ~(((rotated[0][p, e] - rotated[1][q, e]) ** 2).sum(axis=1) <= most + SLACK / 2)
                p, q = p[ok], q[ok]
                ok = (u[0][p] * u[1][q]).sum(axis=1) >= least
                p, q = p[ok], q[ok]
                n_left += np.bincount(p, copies[1][q], len(left))
                n_right += np.bincount(q, copies[0][p], len(right))
                forest.add(p, q + base)
        ids = [s["id"].to_numpy() for s in (left, right)]
        where = np.concatenate(ids) if base else ids[0]
        forest = where[np.array(forest.links, np.int64).reshape(-1, 2)]
        rows = [forest]
        counts = [np.stack([s[n > 0], n[n > 0].astype(np.int64)], axis=1) for s, n in zip(ids, (n_left, n_right))]
        kinds = [np.zeros(len(rows[0]), np.int64), *(np.ones(len(c), np.int64) for c in counts)]
        whole = np.concatenate([*rows, *counts])
        return pd.DataFrame({"kind": np.concatenate(kinds), "a": whole[:, 0], "b": whole[:, 1]})

    return run


def near_vectors(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    kind = "f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_signed(kind), "vec_id long, s1 long, s2 long, v binary")
    rows = scratch.save(rows, "vectors")
    real = rows.where("s1 IS NOT NULL AND vec_id IS NOT NULL")
    reps = real.groupBy("s1", "s2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    whole = reps.join(real.select(F.col("vec_id").alias("id"), "s1", "s2", "v").dropDuplicates(["id", "s1", "s2"]), ["id", "s1", "s2"])
    whole = scratch.save(whole.select("id", "copies", "s1", "s2", "v", (F.length("v") / int(kind[1])).cast("int").alias("d")), "distinct")
    found = []
    for d in sorted(r["d"] for r in whole.select("d").distinct().collect()):
        found.append(_links(whole.where(F.col("d") == d), d, kind, least, scratch))
    if found:
        every = found[0]
        for x in found[1:]:
            every = every.unionAll(x)
        comp = components(every.where("kind = 0").select("a", "b"), scratch)
        counts = every.where("kind = 1").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("n"))
        of = whole.select("id", "copies", "s1", "s2").join(counts, "id", "left").join(comp.select("id", "comp"), "id", "left")
        of = of.select("s1", "s2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "id").alias("component_id"))
        out = rows.select("vec_id", "s1", "s2", F.col("vec_id").isNotNull().alias("_ok")).join(of, ["s1", "s2"], "left")
    else:
        out = rows.select("vec_id", F.lit(True).alias("_ok"), F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    out = out.select("vec_id", F.when(F.col("_ok"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
    return scratch.save(out, "result")


def _links(whole: DataFrame, d: int, kind: str, least: float, scratch: Scratch) -> DataFrame:
    """(kind, a, b): links (kind 0) and numbers of links (kind 1), of vectors of d components."""
    distance = 2.0 - 2.0 * least
    cells = whole.select("id", "copies", "v").mapInArrow(_cells(d, kind, distance), "block int, cell int, id long, copies long, v binary")
    places = cells.select("block", "cell", "id", "copies", "v")
    sizes = places.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("k"))
    sizes = scratch.save(sizes.select("block", "cell", F.ceil(F.col("k") / TILE).cast("int").alias("tiles")), "cells")
    # Each tile meets every tile of its own cell (from its own on) and of the next cell.
    tiles = sizes.select("block", "cell", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "tiles")
    own = tiles.select("block", "cell", "tile", F.lit(0).alias("off"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("other"))
    ahead = sizes.select("block", (F.col("cell") - 1).alias("cell"), F.col("tiles").alias("more"))
    next_ = tiles.join(ahead, ["block", "cell"]).select("block", "cell", "tile", F.lit(1).alias("off"), F.explode(F.sequence(F.lit(0), F.col("more") - 1)).alias("other"))
    meets = own.unionAll(next_)
    sides = meets.select("block", "cell", "tile", F.lit(0).alias("side"), F.struct("block", "cell", "tile", "other", "off").alias("m"))
    sides = sides.unionAll(meets.where("off = 1 OR tile <> other").select("block", (F.col("cell") + F.col("off")).alias("cell"), F.col("other").alias("tile"), F.lit(1).alias("side"), F.struct("block", "cell", "tile", "other", "off").alias("m")))
    placed = places.join(sizes, ["block", "cell"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    dealt = placed.join(sides, ["block", "cell", "tile"]).select("m.block", "m.cell", F.col("m.tile").alias("tile"), F.col("m.other").alias("other"), ((F.col("m.off") == 0) & (F.col("m.tile") == F.col("m.other"))).cast("int").alias("same"), "m.off", "side", "id", "copies", "v")
    done = dealt.withColumn("other", F.col("other") * 2 + F.col("off")).groupBy("block", "cell", "tile", "other", "same").applyInPandas(_compare(d, kind, least, distance), "kind long, a long, b long")
    return scratch.save(done, "pairs")
