"""N-gram Jaccard join: a grouped prefix join over sets of word shingles.

Texts are lower-cased (A-Z), words are runs of characters other than space and U+0009 to U+000D. A
document's set holds its distinct shingles of ``n`` words; with fewer words the whole sequence is the
only one; without words or text the set is empty and links with nothing. Shingles, sets and prefixes are
compared by hashes of 64 bits or more (57 bits for shingles in prefixes, which only adds candidates).
Two documents link if ``den * intersection >= num * union``.

1. Shingles have one order for all documents, rare ones first: a count sketch of fixed size, summed over
   all texts, gives their frequencies. A set's prefix is so long that two sets that link share a shingle
   of their prefixes. Documents with equal sets collapse to the one of smallest id; sets with the same
   prefix and size form a group, led by its smallest id.
2. Groups that share a prefix shingle meet in its block. Its centre, the group whose prefix is shared most,
   is compared with the block's others, and each group's first with its members: as many comparisons as
   entries. Links so found merge into components.
3. Blocks that lie inside one component are done. In the others, groups of different components are
   paired if their sizes and the shingle's places in their prefixes allow a link.
4. Group pairs are filtered by an upper bound on their overlap, from bitmaps of their sets. Jaccard
   distance being a metric, a pair too far apart for any of its groups' members to link is dropped, and
   the others are expanded to members.
5. What is left is verified exactly on the whole sets.

So copies and near copies, however many, are never paired with each other all to all, and no link
between different components is missed. With ``links=True`` there is no such shortcut: all pairs of
distinct sets that share a prefix shingle are filtered and verified, and each row gets its number of
links, copies included; the work then grows with the number of links, so with the square of a group of
near copies.

Null ids link with nothing and have a null component; rows that repeat an id are each returned, each
with its own text's links: the join then works on numbers of rows, and a component's id is the smallest
id of its rows (two components may hold the same one). An empty table gives an empty table; other columns
of the input, whatever their names, are not read. Long texts are hashed whole, in pieces.
"""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_rows, quoted
from .components import components

SKETCH_BITS = 22  # 4 MB where it is broadcast; a shingle stands out once it is more frequent than the rest of its bucket
SKETCH_PARTS = 256
PAIRS_IN_TASK = 64
BROADCAST_IDS = 1_000_000
PIECE_BYTES = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")
_GAP = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
# A word's hash sums the products of random numbers for its bytes and their places; longer words use another hash.
_BYTE, _PLACE = (np.random.default_rng(7).integers(0, 1 << 64, n, np.uint64) | np.uint64(1) for n in (256, 64))
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``data``, A-Z as a-z, and where the words start."""
    raw = np.frombuffer(data, np.uint8)
    gap = np.concatenate([[True], _GAP[raw], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    short = sizes <= len(_PLACE)
    own = sizes[short]
    out = np.zeros(len(starts), np.uint64)
    if len(own):
        begin = np.cumsum(own) - own
        place = np.arange(begin[-1] + own[-1]) - np.repeat(begin, own)
        out[short] = np.add.reduceat(_BYTE[raw[place + np.repeat(starts[short], own)]] * _PLACE[place], begin)
    for i in np.flatnonzero(~short):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + sizes[i]].lower())
    return out, starts


def _fold(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    size = len(words) - k + 1
    out = np.full(size, np.uint64(0x9E3779B97F4A7C15 + k), np.uint64)
    for i in range(k):
        out = (out ^ words[i : size + i]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xC4CEB9FE1A85EC53)
        out ^= out >> np.uint64(29)
    return out


class Shingler:
    """Sorted arrays of the distinct shingle hashes of texts.

    Short texts are hashed together, long ones in pieces cut between words.
    """

    def __init__(self, n: int):
        self.n = n

    def of(self, text: str | None) -> np.ndarray:
        return self.many([text])[0]

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        held: list[bytes] = []
        size = 0
        for t in texts:
            data = t.encode() if t else b""
            if held and size + len(data) > PIECE_BYTES:
                out += self._sets(held)
                held, size = [], 0
            held.append(data)
            size += len(data) + 1
        return out + self._sets(held) if held else out

    def _sets(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(texts) == 1:
            data, at, parts = texts[0], 0, []
            while at < len(data):
                cut = _SPACE.search(data, at + PIECE_BYTES)
                end = cut.start() if cut else len(data)
                parts.append(_hash_words(data[at:end])[0])
                at = end
            words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            ends = np.array([len(words)])
        else:
            words, starts = _hash_words(b"\n".join(texts))
            ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
        every = _fold(words, self.n) if len(words) >= self.n else words
        out, a = [], 0
        for b in ends.tolist():
            h = np.sort(every[a : b - self.n + 1] if b - a >= self.n else _fold(words[a:b], b - a) if b > a else words[:0])
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) > 1 else h)
            a = b
        return out


def _levels(docs: DataFrame, n: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Quarters of the binary logarithm of how many sets have a shingle of each bucket, all documents counted.

    Tasks count in arrays of fixed size; parts of the arrays are added up in Spark, one by one, so the result
    and what any task holds do not grow with the input. It only shapes the order of shingles.
    """
    size = (1 << bits) // SKETCH_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, shift = Shingler(n), np.zeros(1 << bits, np.uint32), np.uint64(64 - bits)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                if sets := shingler.many(b.column(0).slice(at, 512).to_pylist()):
                    np.add.at(seen, (np.concatenate(sets) >> shift).astype(np.int64), np.uint32(1))
        if not seen.any():
            return
        parts = [zstandard.compress(seen[k * size : (k + 1) * size].tobytes(), 1) for k in range(SKETCH_PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = np.zeros(size, np.int64), None
        for b in batches:
            for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if last not in (None, part):
                    yield done(last, total)
                    total[:] = 0
                total += np.frombuffer(zstandard.decompress(counts), np.uint32)
                last = part
        if last is not None:
            yield done(last, total)

    def done(part: int, total: np.ndarray) -> pa.RecordBatch:
        level = np.ceil(4 * np.log2(np.maximum(total, 1))).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["part", "level"])

    counted = docs.select("text").mapInArrow(count, "part int, counts binary")
    levels = counted.repartition("part").sortWithinPartitions("part").mapInArrow(add, "part int, level binary")
    out = np.zeros(1 << bits, np.uint8)
    for part, level in levels.collect():
        out[part * size : (part + 1) * size] = np.frombuffer(level, np.uint8)
    return out


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _prefix(h: np.ndarray, levels: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` shingles in the global order: by level of frequency, then hash."""
    level = levels[h >> np.uint64(65 - len(levels).bit_length())].astype(np.uint64)
    key = level << np.uint64(57) | h >> np.uint64(7)
    return np.sort(key) if size >= len(key) else np.sort(np.partition(key, size - 1)[:size])


def _bitmap(h: np.ndarray) -> bytes:
    """For each of at least 2 bits a shingle, whether an odd number of shingles falls on it."""
    size = max(64, 1 << (2 * len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def _most_common(na: int, nb: int, x: bytes, y: bytes) -> int:
    """No less than what sets of these sizes and bitmaps have in common: every odd bit of both together stands for a shingle of one only."""
    u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(u) > len(v):
        u = u[: len(u) // 2] ^ u[len(u) // 2 :]
    while len(v) > len(u):
        v = v[: len(v) // 2] ^ v[len(v) // 2 :]
    return min(na, nb, (na + nb - int(np.bitwise_count(u ^ v).sum())) // 2)


def _profiles(docs: DataFrame, n: int, num: int, den: int, levels: np.ndarray) -> DataFrame:
    """doc_id, set size, a 128-bit signature of the set, its group (a signature of size and prefix), its prefix and its bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def make():
        shingler, order = Shingler(n), shared.value

        def work(cols):
            out: list[list] = [[] for _ in range(7)]
            for doc_id, h in zip(cols[0], shingler.many(cols[1])):
                prefix = _prefix(h, order, prefix_size(len(h), num, den)) if len(h) else h
                sign = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64).tolist()
                group = xxhash.xxh3_64_intdigest(prefix.tobytes(), len(h)) - (1 << 63)
                for c, v in zip(out, (doc_id, len(h), *sign, group, prefix.view(np.int64), _bitmap(h) if len(h) else None)):
                    c.append(v)
            return out

        return work

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n long, s1 long, s2 long, g long, prefix array<long>, bits binary", make)


@contextlib.contextmanager
def _small_batches(spark, rows: int = 256):
    """Rows that hold whole sets go to Python few at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _overlaps(pairs: DataFrame, sets: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(a, b, na, nb, both): sizes of the pairs' documents, and how many of the hashes in ``sets`` (doc_id, n, h) both have.

    Pairs are dealt out by their first id, many pairs of one id over several tasks; the first id's
    hashes go once to each of them, followed by the others' one by one.
    """
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    salted = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / PAIRS_IN_TASK)).cast("int").alias("salt"))
    held = sets.select(F.col("doc_id").alias("b"), "n", "h")
    second = salted.join(held, "b").select("a", "salt", "b", "n", "h")
    first = salted.select("a", "salt").distinct().join(held.withColumnRenamed("b", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "n", "h")
    dealt = first.unionAll(second).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, size = np.zeros(0, np.uint64), 0
        for batch in batches:
            rows: list[tuple] = []
            for a, b, n, h in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("n").to_pylist(), batch.column("h")):
                own = np.frombuffer(h.as_buffer(), np.uint64)
                if b is None:
                    base, size = own.copy(), n
                    continue
                x, y = (own, base) if len(own) < len(base) else (base, own)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                rows.append((a, b, size, n, int((y[at] == x).sum()) if len(y) else 0))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "na", "nb", "both"])

    with _small_batches(pairs.sparkSession):
        return scratch.save(dealt.mapInArrow(run, "a long, b long, na long, nb long, both long"), name)


def _filter_pairs(pairs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(a, b, na, nb, most) of pairs of ids: sizes, and an upper bound on what their sets have in common."""
    sides = [bitmaps.select(F.col("doc_id").alias(x), F.col("n").alias("n" + x), F.col("bits").alias("bits_" + x)) for x in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "na", "nb", "bits_a", "bits_b")

    def make():
        return lambda cols: [*cols[:4], [_most_common(*x) for x in zip(*cols[2:])]]

    return map_rows(both, both.columns, "a long, b long, na long, nb long, most long", make, chunk_rows=4096)


def _verify(pairs: DataFrame, docs: DataFrame, n: int, scratch: Scratch, name: str) -> DataFrame:
    """(a, b, na, nb, both) of the pairs, on whole sets built from the texts again. Every id has one row only."""
    ids = scratch.save(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct(), name + "-ids")
    few = ids.count() <= BROADCAST_IDS

    def make():
        shingler = Shingler(n)

        def work(cols):
            sets = shingler.many(cols[1])
            return [cols[0], list(map(len, sets)), [h.tobytes() for h in sets]]

        return work

    texts = docs.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), "doc_id", "left_semi")
    sets = scratch.save(map_rows(texts, ["doc_id", "text"], "doc_id long, n long, h binary", make), name + "-sets")
    out = _overlaps(pairs, sets, scratch, name)
    scratch.drop(ids, sets)
    return out


def jaccard_join(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest linked id, itself included) and, if asked for, n_links of every row."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not _repeated(docs):
        return _join(docs, n, num, den, scratch, links)
    rows = _numbered(docs, scratch)
    found = _join(_by_row(rows), n, num, den, scratch, links).withColumnRenamed("doc_id", "__row")
    of = found.join(rows.select("__row", "doc_id"), "__row", "left")
    least = of.where("component_id IS NOT NULL").groupBy("component_id").agg(F.min("doc_id").alias("least"))
    out = of.join(least, "component_id", "left").select("doc_id", "n_shingles", F.col("least").alias("component_id"), *(["n_links"] if links else []))
    return scratch.save(out, "by-id")


def one_of_each(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The row of smallest id of each component, and all rows without id.

    Columns, whatever their names and types, stay as they are. Where an id stands in several rows, each of them with another set counts by itself; of rows with one id
    in one component, or with one id and the empty set, the one with the smallest hash stays.
    """
    scratch = Scratch(docs.sparkSession)
    nameless = docs.where("doc_id IS NULL")
    if not _repeated(docs):
        found = _join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), n, num, den, scratch).where("doc_id = component_id")
        kept = docs.join(found.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi")
        return kept.select(*map(quoted, docs.columns)).union(nameless)
    names = [f"_{k}" for k in range(len(docs.columns))]
    plain = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.struct(*[quoted(c).alias(x) for c, x in zip(docs.columns, names)]).alias("all"))
    rows = _numbered(plain, scratch)
    found = _join(_by_row(rows), n, num, den, scratch).withColumnRenamed("doc_id", "__row")
    hashed = [f"all.{x}" for x, f in zip(names, docs.schema) if f.name != "doc_id" and not re.search("map<|variant", f.dataType.simpleString())]
    order = F.struct("doc_id", F.xxhash64(*hashed).alias("hash"), "__row")
    ranked = found.join(rows.select("__row", "doc_id", order.alias("order")), "__row")
    empty = F.col("n_shingles") == 0
    first = ranked.groupBy(empty.alias("empty"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("key")).agg(F.min("order").alias("order"))
    kept = rows.join(first.select(F.col("order.__row").alias("__row")), "__row", "left_semi")
    return kept.select(*[F.col(f"all.{x}").alias(c) for c, x in zip(docs.columns, names)]).union(nameless)


def _repeated(docs: DataFrame) -> bool:
    return not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with a number each, in ``__row``; written down, so that it stays."""
    return scratch.save(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")


def _by_row(rows: DataFrame) -> DataFrame:
    return rows.select(F.when(F.col("doc_id").isNotNull(), F.col("__row")).alias("doc_id"), "text")


def _join(docs: DataFrame, n: int, num: int, den: int, scratch: Scratch, links: bool = False) -> DataFrame:
    """The join of rows whose ids, where not null, are longs and each stand in one row."""
    profiles = scratch.save(_profiles(docs, n, num, den, _levels(docs, n)), "profiles")
    real = profiles.where("n > 0 AND doc_id IS NOT NULL")
    bitmaps = real.select("doc_id", "n", "bits")
    reps = scratch.save(real.groupBy("n", "s1", "s2", "g").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "reps")

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        passed = scratch.save(pairs.where(linked("most")).select("a", "b"), name + "-passed")
        out = _verify(passed, docs, n, scratch, name)
        scratch.drop(passed)
        return out.where(linked("both")).withColumn("d", 1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both")))

    def linked(both: str) -> str:
        return f"{both} * {den} >= (na + nb - {both}) * {num}"

    if links:
        every, comp, of_set = _counted(real, reps, bitmaps, verify, num, den, scratch)
    else:
        every, comp = _linked(real, reps, bitmaps, verify, num, den, scratch)
        of_set = reps
    of_set = of_set.join(comp, of_set["rep"] == comp["id"], "left").select("n", "s1", "s2", F.coalesce("comp", "rep").alias("comp"), *(["n_links"] if links else []))
    out = profiles.select("doc_id", "n", "s1", "s2").join(of_set, ["n", "s1", "s2"], "left")
    known = F.col("doc_id").isNotNull()
    n_links = F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links") if links else None
    out = scratch.save(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(known, F.coalesce("comp", "doc_id")).alias("component_id"), *([n_links] if links else [])), "result")
    scratch.drop(profiles, reps, comp, *every)
    return out


def _linked(real: DataFrame, reps: DataFrame, bitmaps: DataFrame, verify, num: int, den: int, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Components (id, comp) of the distinct sets that link with others; and the tables that they rest on."""
    # Blocks: the groups that share a prefix shingle. Copies of a group have the same rows, which the sums and distinct rows absorb.
    tokens = real.select("g", "n", F.posexplode("prefix").alias("pos", "w"))
    blocks = scratch.save(tokens.groupBy("w").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("w"), "blocks")
    shared = scratch.save(tokens.join(blocks, "w").select("w", "pos", "n", "g").distinct(), "shared")
    scratch.drop(blocks)
    leaders = scratch.save(reps.groupBy("g").agg(F.min("rep").alias("leader")), "leaders")
    inside = scratch.save(reps.join(leaders, "g").where("rep <> leader").select("g", F.col("leader").alias("a"), F.col("rep").alias("b")), "members")

    # Each block's centre is the group the largest part of whose prefix others share: what near copies were copied from, rather than one of them.
    central = shared.groupBy("g").agg((F.count(F.lit(1)) / F.max(F.expr(f"n - ceil({num} * n / {den}) + 1"))).alias("part"))
    centres = shared.join(central, "g").groupBy("w").agg(F.max_by("g", "part").alias("centre"))
    ends = shared.join(centres, "w").where("g <> centre").select(F.col("centre").alias("g1"), F.col("g").alias("g2")).distinct()
    one, two = (leaders.select(F.col("g").alias("g" + k), F.col("leader").alias(x)) for k, x in zip("12", "ab"))
    stars = ends.join(one, "g1").join(two, "g2").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().unionAll(inside.select("a", "b"))
    near = scratch.save(_filter_pairs(stars, bitmaps), "stars")
    found = scratch.save(verify(near, "first").select("a", "b", "d"), "first-links")
    scratch.drop(near)
    comp = components(found, scratch)

    # What stands in a block: each group's leader, and members that do not link with it, each with its component.
    # A leader stands for the members that do, up to its spread away.
    joined = inside.join(found, ["a", "b"])
    spread = joined.groupBy(F.col("a").alias("c")).agg(F.max("d").alias("spread"))
    loose = inside.join(found, ["a", "b"], "left_anti").select("g", F.col("b").alias("c"))
    present = leaders.select("g", F.col("leader").alias("c")).unionAll(loose).join(comp.select(F.col("id").alias("c"), "comp"), "c", "left").select("g", "c", F.coalesce("comp", "c").alias("comp"))
    present = scratch.save(present, "present")
    entries = shared.select("w", "pos", "n", "g").join(present, "g").select("w", "pos", "n", "c", "comp")
    # A group without a block of its own may still have loose members that link among themselves.
    size = reps.select(F.col("rep").alias("c"), "n")
    own = present.join(loose.select("g").distinct(), "g").join(size, "c").select(F.col("g").alias("w"), F.lit(0).alias("pos"), "n", "c", "comp")
    entries = scratch.save(entries.unionAll(own), "entries")
    scratch.drop(shared)
    mixed = scratch.save(entries.groupBy("w").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("w"), "mixed")
    held = scratch.save(entries.join(mixed, "w"), "held")
    scratch.drop(entries, mixed)
    left, right = (held.select("w", *[F.col(x).alias(x + k) for x in ("pos", "n", "c", "comp")]) for k in "12")
    close = f"comp1 < comp2 AND n1 * {den} >= n2 * {num} AND n2 * {den} >= n1 * {num} AND {_reach(num, den)}"
    across = scratch.save(left.join(right, "w").where(close).select(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b")).distinct(), "across")
    scratch.drop(held)
    near = scratch.save(_filter_pairs(across, bitmaps), "across-near")
    more = scratch.save(verify(near, "second").select("a", "b", "d"), "second-links")
    used = [leaders, inside, found, present, across, near, more]
    if not joined.isEmpty():
        wide = near
        for x in "ab":
            wide = wide.join(spread.select(F.col("c").alias(x), F.col("spread").alias("r" + x)), x, "left")
        far = f"1 - most / (na + nb - most) <= {1 - num / den} + coalesce(ra, 0D) + coalesce(rb, 0D) + 1e-9"
        wide = wide.where(f"(ra IS NOT NULL OR rb IS NOT NULL) AND {far}").select("a", "b")
        members = joined.select("a", "b").unionAll(joined.select("a", F.col("a").alias("b")).distinct())
        for x in "ab":
            wide = wide.join(members.select(F.col("a").alias(x), F.col("b").alias("m" + x)), x, "left")
        pairs = wide.where("ma IS NOT NULL OR mb IS NOT NULL").select(F.coalesce("ma", "a").alias("a"), F.coalesce("mb", "b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        expanded = scratch.save(_filter_pairs(pairs.join(across, ["a", "b"], "left_anti"), bitmaps), "expanded")
        third = scratch.save(verify(expanded, "third").select("a", "b", "d"), "third-links")
        used += [expanded, third]
        more = more.unionAll(third)
    return used, _merged(comp, more, scratch)


def _merged(comp: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Components (id, comp) after more links: the components themselves are linked and merged."""
    of = links.select("a", "b")
    for x in "ab":
        of = of.join(comp.select(F.col("id").alias(x), F.col("comp").alias("comp_" + x)), x, "left")
    own = scratch.save(of.select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b")).distinct(), "merging")
    if own.isEmpty():
        return comp
    merged = components(own, scratch)
    step = merged.select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    out = comp.join(step, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    out = scratch.save(out.unionAll(merged.join(comp.select("id"), "id", "left_anti").select("id", "comp")), "components")
    scratch.drop(comp, own, merged)
    return out


def _counted(real: DataFrame, reps: DataFrame, bitmaps: DataFrame, verify, num: int, den: int, scratch: Scratch) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Tables in use, components, and the distinct sets with their numbers of links: every two that link, weighted by their copies."""
    tokens = reps.select(F.col("rep").alias("doc_id")).join(real.select("doc_id", "n", F.posexplode("prefix").alias("pos", "w")), "doc_id")
    tokens = scratch.save(tokens.withColumnRenamed("doc_id", "c"), "tokens")
    one, two = (tokens.select("w", *[F.col(x).alias(x + k) for x in ("c", "n", "pos")]) for k in "12")
    near = f"c1 < c2 AND n1 * {den} >= n2 * {num} AND n2 * {den} >= n1 * {num} AND {_reach(num, den)}"
    pairs = scratch.save(one.join(two, "w").where(near).select(F.col("c1").alias("a"), F.col("c2").alias("b")).distinct(), "pairs")
    screened = scratch.save(_filter_pairs(pairs, bitmaps), "pairs-near")
    scratch.drop(tokens, pairs)
    found = scratch.save(verify(screened, "every").select("a", "b"), "every-link")
    comp = components(found, scratch)
    copies = reps.select(F.col("rep").alias("b"), "copies")
    both = found.unionAll(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    count = both.join(copies, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("others"))
    of_set = reps.join(count, "rep", "left").withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("copies") - 1)
    return [screened, found], comp, of_set


def _reach(num: int, den: int) -> str:
    """Whether sets of n1 and n2 shingles that share no prefix shingle before places pos1 and pos2 may overlap enough.

    A pair may share several prefix shingles; the first of them passes, so no pair is lost.
    """
    return f"(1 + least(n1 - pos1 - 1, n2 - pos2 - 1)) * {num + den} >= {num} * (n1 + n2)"
