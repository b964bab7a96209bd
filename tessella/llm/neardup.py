"""Near-duplicate groups by HyperMinHash sketches, banding and exact checks.

A document's words (A-Z lower-cased) give its set of word shingles. Texts of one set are one class. Each
class has a sketch of 128 compressed registers: the least hash of each bucket as its count of leading zeros and
ten mantissa bits; empty buckets borrow from others by a fixed probe. Bands of four registers bring classes
together; a band shared by few classes gives all their pairs, one shared by many pairs each class with the
band's most popular member. The collision-corrected Jaccard estimate drops pairs far below the threshold, and
the full shingle sets decide on the rest. Then every pair that a band of many classes still holds in two groups
is compared, in blocks of bounded size: sketches first, full sets of those that are near any. Only pairs inside
the largest group that a band holds are left out, as their group is proven.

Loss: a pair at the threshold shares none of 32 bands with probability 6e-11 (0.85) or 5e-8 (0.8), and lies six
standard errors below its estimate with 1e-9. Nothing is lost beyond that, in bands of any size; a band of m classes,
r of them outside its largest group, costs about r * (m - r / 2) comparisons of sketches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, marked, slot_table, written
from tessella.llm.components import components
from tessella.session import ship

#: Words of a shingle, and percentage of the union that the intersection of linked sets has at least.
SHINGLE = 3
THRESHOLD = 85
#: Registers of a sketch (a power of two), mantissa bits of each, and registers of a band.
REGISTERS = 128
MANTISSA = 10
BAND = 4
#: Bands of at most this many classes give all their pairs.
SMALL = 8
#: Classes, and their shingles, that one side of a block of comparisons has on average at most.
BLOCK = 512
BLOCK_SHINGLES = 1_000_000
#: Standard errors below the threshold at which an estimate drops a pair.
MARGIN = 6.0
_PROBES = 64

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _MIX1
    x = (x ^ x >> np.uint64(27)) * _MIX2
    return x ^ x >> np.uint64(31)


#: Bucket that each bucket borrows from at each attempt.
_PROBE = (_mix(np.arange(1, _PROBES * REGISTERS + 1, dtype=np.uint64) * _GOLD) % np.uint64(REGISTERS)).astype(np.int64).reshape(_PROBES, REGISTERS)
_EDGES = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - (REGISTERS.bit_length() - 1))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text; of the whole sequence if it has fewer words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    if len(h) < width:
        h = np.concatenate([h, np.full(width - len(h), len(h), dtype=np.uint64)])
    out = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        out = _mix(out + _GOLD) ^ h[k : len(h) - width + 1 + k]
    return np.unique(_mix(out + _GOLD))


def registers(hashes: np.ndarray) -> np.ndarray:
    """Compressed registers of a non-empty sorted set, as signed 16-bit numbers."""
    at = np.searchsorted(hashes, _EDGES)
    filled = np.diff(np.append(at, len(hashes))) > 0
    least = hashes[np.minimum(at, len(hashes) - 1)]
    rest = (least << np.uint64(7)) >> np.uint64(12)
    fraction, bits = np.frexp(rest.astype(np.float64))
    mantissa = np.where(rest > 0, (fraction * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
    value = ((52 - bits.astype(np.int64)) << MANTISSA | mantissa) - 32768
    empty = np.flatnonzero(~filled)
    if len(empty):
        source = np.flatnonzero(filled)
        for probe in _PROBE:
            lender = probe[empty]
            good = filled[lender]
            value[empty[good]] = value[lender[good]]
            empty = empty[~good]
            if not len(empty):
                break
        if len(empty):
            value[empty] = value[source[np.searchsorted(source, empty) % len(source)]]
    return value.astype(np.int16)


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(key, n_shingles, digest, registers) of every text; digest and registers are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, values = [], [], []
            for value in batch.column(1):
                found = shingles(value.as_py(), width)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                values.append(registers(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(values, pa.list_(pa.int16()))],
                names=[key, "n_shingles", "digest", "registers"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_shingles long, digest binary, registers array<short>")


def shingle_sets(texts: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(cid, shingles) from (cid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, rows = 0, batch.num_rows
            while start < rows:
                sets, size, stop = [], 0, start
                while stop < rows and size < 2_000_000:
                    sets.append(shingles(batch.column(1)[stop].as_py(), width).view(np.int64))
                    size += len(sets[-1]) + 8
                    stop += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.array(sets, pa.list_(pa.int64()))], names=["cid", "shingles"]
                )
                start = stop

    return texts.select("cid", "text").mapInArrow(run, "cid long, shingles array<long>")


def _accidental(n: Column, m: Column) -> Column:
    """Probability that registers of different hashes agree, for sets of n and m: same zeros and same mantissa."""
    zeros = lambda size, k: F.exp(-size / REGISTERS * F.pow(F.lit(0.5), k + 1)) - F.exp(-size / REGISTERS * F.pow(F.lit(0.5), k))
    levels = F.sequence(F.lit(0), F.lit(40))
    same = F.aggregate(levels, F.lit(0.0), lambda s, k: s + zeros(n, k) * zeros(m, k))
    return same / 2**MANTISSA


def estimate(a: Column, b: Column, n: Column, m: Column) -> Column:
    """Jaccard estimate from two sketches: the share of equal registers, less the expected accidental ones."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / REGISTERS
    chance = _accidental(n, m)
    return (equal - chance) / (1 - chance)


def _promising(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow a link and whose estimate is not far below the threshold."""
    side = lambda s: classes.select(F.col("cid").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("registers").alias(f"r{s}"))
    share = threshold / 100
    held = pairs.join(side("a"), "a").join(side("b"), "b")
    sized = held.where(100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    # Borrowed registers repeat, so a set of few shingles counts as so many registers only.
    error = F.sqrt(F.lit(share * (1 - share)) / F.least(F.lit(REGISTERS), "na", "nb"))
    close = estimate(F.col("ra"), F.col("rb"), F.col("na"), F.col("nb")) >= share - MARGIN * error
    return sized.where(close).select("a", "b", "na", "nb")


def _linked(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose full sets meet the threshold."""
    side = lambda s: sets.select(F.col("cid").alias(s), F.col("shingles").alias(f"s{s}"))
    held = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return held.where(100 * common >= threshold * (F.col("na") + F.col("nb") - common)).select("a", "b")


def _ordered(one: str, other: str) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _first_pairs(members: DataFrame) -> DataFrame:
    """All pairs of small bands; in the others each member with the most popular one."""
    small = members.where(F.col("together") <= SMALL).groupBy("band").agg(F.sort_array(F.collect_list("cid")).alias("c"))
    tails = F.transform("c", lambda x, i: F.transform(F.slice("c", i + 2, SMALL), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    all_pairs = small.select(F.explode(F.flatten(tails)).alias("p")).select("p.a", "p.b")
    large = members.where(F.col("together") > SMALL)
    heads = large.groupBy("band").agg(F.max_by("cid", F.struct("popular", "cid")).alias("head"))
    stars = large.join(heads, "band").where("cid <> head").select(*_ordered("cid", "head"))
    return all_pairs.union(stars).distinct()


def _blocks(members: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """(block, cid, label): members of large bands that hold several groups, so that any two of two groups share a block.

    A band's largest group and the rest of its members are each dealt to blocks by hash; each block of the rest meets
    every other block. A band whose members are one group already has none.
    """
    large = members.where(F.col("together") > SMALL).select("band", "cid").join(classes.select("cid", "n_shingles"), "cid")
    named = large.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    parts = named.groupBy("band", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    most = lambda c: F.max_by(c, F.struct("n", "label"))
    needed = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES))
    split = (
        parts.groupBy("band")
        .agg(most("label").alias("main"), most("n").alias("n"), most("size").alias("size"), F.sum("n").alias("all_n"), F.sum("size").alias("all_size"))
        .where("all_n > n")
        .select(
            "band",
            "main",
            needed(F.col("n"), F.col("size")).alias("inner"),
            needed(F.col("all_n") - F.col("n"), F.col("all_size") - F.col("size")).alias("outer"),
        )
    )
    inside = F.col("label") == F.col("main")
    held = named.join(split, "band").withColumn("own", F.pmod(F.xxhash64("band", "cid"), F.when(inside, F.col("inner")).otherwise(F.col("outer"))))
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    block = lambda kind, i, j: F.xxhash64("band", F.lit(kind), i, j)
    own = F.col("own")
    across = F.when(inside, F.transform(numbers("outer"), lambda j: block(0, own, j))).otherwise(F.transform(numbers("inner"), lambda i: block(0, i, own)))
    others = F.transform(F.filter(numbers("outer"), lambda k: k != own), lambda k: block(1, F.least(k, own), F.greatest(k, own)))
    seats = F.when(inside, across).otherwise(F.concat(across, others))
    return held.select(F.explode(seats).alias("block"), "cid", "label")


def _outside(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels as numbers from 0, and the rows that are not of the most frequent one."""
    _, group_of, counts = np.unique(labels, return_inverse=True, return_counts=True)
    return group_of, np.flatnonzero(group_of != counts.argmax())


def _near_any(blocks: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Rows (block, cid, label) whose size and sketch are not far from those of some member of another group in the block."""
    share = threshold / 100

    def run(table: pa.Table) -> pa.Table:
        sketch = table.column("registers").combine_chunks().flatten().to_numpy().reshape(-1, REGISTERS)
        size = table.column("n_shingles").to_numpy()
        group_of, outside = _outside(table.column("label").to_numpy())
        near = np.zeros(len(size), dtype=bool)
        for i in outside:
            # Accidental agreement only raises the share of equal registers, so none is dropped for it.
            equal = (sketch == sketch[i]).sum(axis=1) / REGISTERS
            error = np.sqrt(share * (1 - share) / np.minimum(REGISTERS, np.minimum(size, size[i])))
            sized = 100 * np.minimum(size, size[i]) >= threshold * np.maximum(size, size[i])
            found = sized & (group_of != group_of[i]) & (equal >= share - MARGIN * error)
            near |= found
            near[i] |= found.any()
        return table.select(["block", "cid", "label"]).filter(pa.array(near))

    held = blocks.join(classes.select("cid", "n_shingles", "registers"), "cid").select("block", "cid", "label", "n_shingles", "registers")
    return held.groupBy("block").applyInArrow(run, "block long, cid long, label long")


def _bridges(blocks: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) whose full sets meet the threshold, enough to join all groups that are linked inside a block."""

    def run(table: pa.Table) -> pa.Table:
        cid = table.column("cid").to_numpy()
        lists = table.column("shingles").combine_chunks()
        size = lists.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(size)), size)
        _, shingle = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        holders = row[np.argsort(shingle, kind="stable")]
        first = np.concatenate([[0], np.cumsum(np.bincount(shingle))])
        start = np.concatenate([[0], np.cumsum(size)])
        group_of, outside = _outside(table.column("label").to_numpy())
        a, b = [], []
        for i in outside:
            common = np.bincount(np.concatenate([holders[first[k] : first[k + 1]] for k in shingle[start[i] : start[i + 1]]]), minlength=len(size))
            linked = np.flatnonzero((100 * common >= threshold * (size[i] + size - common)) & (group_of != group_of[i]))
            met, at = np.unique(group_of[linked], return_index=True)
            a += [cid[i]] * len(met)
            b += cid[linked[at]].tolist()
            group_of[np.isin(group_of, met)] = group_of[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    held = blocks.join(sets, "cid").select("block", "cid", "label", "shingles")
    found = held.groupBy("block").applyInArrow(run, "a long, b long")
    return found.select(*_ordered("a", "b")).distinct()


def group(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Near-duplicate groups: (key, n_shingles, component_id, kept, class_id) for every row of ``docs``.

    Texts are linked whose sets of shingles of ``width`` words meet in ``threshold`` percent of their union or more.
    component_id is the smallest key reachable over links, kept is key = component_id, class_id the smallest key of
    the rows with the same shingle set. A null or empty text, or one without words, has n_shingles 0 and is a group
    of its own. Rows that repeat a key are kept or not alike. A null key counts as larger than all others; a
    group of null keys only has a null component_id and is kept. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    named_rows = docs.select(F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash")).alias("id"), F.col(text).alias("text"))
    sketched = sketches(named_rows, "id", "text", width).select("id.key", "id.text_hash", "n_shingles", "digest", "registers")
    rows = scratch.keep(sketched, "rows")
    first = (
        rows.where("n_shingles > 0")
        .groupBy("digest")
        .agg(
            F.min("key").alias("class_id"),
            F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("text_hash").alias("text_hash"))).alias("at"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("registers").alias("registers"),
        )
    )
    classes = scratch.keep(first.select(F.monotonically_increasing_id().alias("cid"), "digest", "class_id", "at", "n_shingles", "registers"), "classes")
    numbers = F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1))
    keys = F.transform(numbers, lambda b: F.xxhash64(b, F.slice("registers", b * BAND + 1, BAND)))
    bands = classes.select("cid", F.explode(keys).alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("together")).where("together > 1")
    met = scratch.keep(bands.join(shared, "band"), "met")
    popular = met.groupBy("cid").agg(F.sum("together").alias("popular"))
    members = scratch.keep(met.join(popular, "cid"), "members")

    pairs = scratch.keep(_promising(_first_pairs(members), classes, threshold), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).union(members.where(F.col("together") > SMALL).select("cid")).distinct()
    place = classes.select("cid", "at.key", "at.text_hash").join(wanted, "cid")
    place = scratch.keep(place.select("cid", F.xxhash64("key", "text_hash").alias("place")), "place")
    # The text of one row of each class; copies of it that sit in other rows with the same key go on the map side.
    # Texts that no pair and no large band needs stay where they are, but for those that share a slot.
    placed = source.select(F.xxhash64("key", "text_hash").alias("place"), "text")
    needed = marked(placed, "place", slot_table(place.select("place")), "needed").where("needed").drop("needed")
    texts = needed.join(place, "place").groupBy("cid").agg(F.first("text").alias("text"))
    sets = scratch.keep(shingle_sets(texts, width), "sets")
    links = scratch.keep(_linked(pairs, sets, threshold), "links")
    labels = components(links)
    near = scratch.keep(_near_any(_blocks(members, labels, classes), classes, threshold), "near")
    bridges = scratch.keep(_bridges(near, sets, threshold), "bridges")
    if not bridges.isEmpty():
        labels = components(links.union(bridges))
    held = classes.select("cid", "digest", "class_id").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    lowest = held.where("label is not null").groupBy("label").agg(F.min("class_id").alias("component_id"))
    named = held.join(lowest, "label", "left").select("digest", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    named = scratch.keep(named, "named")
    scratch.drop("classes", "met", "members", "pairs", "place", "sets", "links", "near", "bridges")
    out = rows.select("key", "n_shingles", "digest").join(named, "digest", "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("key")).otherwise(F.col("component_id"))
    return out.select(
        F.col("key").alias(key),
        "n_shingles",
        component.alias("component_id"),
        F.col("key").eqNullSafe(component).alias("kept"),
        F.when(alone, F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each near-duplicate group, with all its columns: that of the smallest key, null the largest.

    Where keys repeat or are null anywhere, a row's key is taken together with its text; of equal rows one stays.
    Empty texts stay, one for each key. Columns of ``docs`` may have any names, and an empty table gives none.
    """
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    columns = [F.col("row")[c].alias(c) for c in docs.columns]
    unclear = not docs.groupBy(F.col(key).alias("own")).agg(F.count("*").alias("n")).where("n > 1 OR own IS NULL").isEmpty()
    if not unclear:
        # Only rows whose slot is a dropped key's move to the exact check; all others stay where they are.
        gone = written(group(docs, key, text, width, threshold).where("not kept").select(F.col(key).alias("own")), "gone")
        rows = docs.select(whole, F.col(key).alias("own"), F.xxhash64(key).alias("number"))
        seen = marked(rows, "number", slot_table(gone.select(F.xxhash64("own"))), "suspect")
        cleared = seen.where("suspect").join(gone, "own", "left_anti")
        return seen.where("not suspect").unionByName(cleared).select(*columns)
    own = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text"))
    keyed = docs.select(whole, own.alias("own"), F.col(text).alias("said"))
    kept = written(group(keyed, "own", "said", width, threshold).where("kept").select("own").distinct(), "kept")
    one = keyed.join(kept, "own", "left_semi").groupBy("own").agg(F.first("row").alias("row"))
    return one.select(*columns)
