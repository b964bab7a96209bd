"""Semantic cache as tables: lookup with an identifier guard, time to live, capacity, counters."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import ship

THRESHOLD = 0.85
TTL_SECONDS = 3600
CAPACITY = 500
#: Rows of a block of requests and of entries, and rows that a packing task holds.
REQUEST_BLOCK = 256
ENTRY_BLOCK = 1024
HELD_ROWS = 16_384


def namespace(user: str = "user_id") -> Column:
    """The tenant that a row belongs to."""
    return F.coalesce(F.col(user), F.lit("anon"))


def live(entries: DataFrame, now: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Entries that have not expired at ``now``."""
    return entries.where(F.col("created_at") + F.make_dt_interval(secs=F.lit(ttl_seconds)) > now)


def newest(entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """At most ``capacity`` entries of each user, the newest; the victims are the oldest, not random ones."""
    order = Window.partitionBy(namespace()).orderBy(F.desc("created_at"), F.desc("entry_id"))
    return entries.withColumn("age_rank", F.row_number().over(order)).where(F.col("age_rank") <= capacity).drop("age_rank")


def lookup(requests: DataFrame, entries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Outcome of each request against its user's entries.

    requests(request_id, user_id, q, ids), entries(entry_id, user_id, v, entry_ids). A null user is the tenant of
    ``namespace``. An entry at or above the threshold
    is a hit if its identifiers equal the request's, else it is blocked. Returns request_id, hit, reason, entry_id,
    score, blocked; the guard is the reason only where there is no clean hit. Ties go to the lowest entry_id. A vector
    that is null or of another length than the request's is near nothing; an entry without entry_id is none.

    Both sides are packed by tenant in their scans and meet as blocks: a pair of blocks is one matrix product and gives
    one row a request, so a tenant with a large share of all rows is many pairs of blocks, which adaptive execution
    splits, and pairs of single rows are never built.
    """
    ship(requests.sparkSession)
    kind = "double" if any("double" in f.schema[c].dataType.simpleString() for f, c in ((requests, "q"), (entries, "v"))) else "float"
    key = requests.schema["request_id"].dataType.simpleString()
    tenant = namespace().cast("string").alias("tenant")
    row = lambda key, v, ids: (tenant, key, F.col(v).cast(f"array<{kind}>").alias("v"), F.coalesce(F.to_json(ids), F.lit("")).alias("guard"))
    asked = requests.select(*row(F.col("request_id"), "q", "ids"))
    held = entries.where("entry_id is not null").select(*row(F.col("entry_id").cast("long"), "v", "entry_ids"))
    packed = "tenant string, {0}_width int, {0}_keys array<{1}>, {0}_vectors array<{2}>, {0}_guards array<string>"
    left = asked.mapInArrow(_packed(REQUEST_BLOCK, "q"), packed.format("q", key, kind))
    right = held.mapInArrow(_packed(ENTRY_BLOCK, "e"), packed.format("e", "bigint", kind))
    parts = f"request_id {key}, n long, clean double, clean_id long, vetoed double, vetoed_id long, blocked long"
    met = left.join(right, "tenant").mapInArrow(_judged(threshold), parts)
    # Requests of tenants without entries meet nothing; a row of zeros keeps them.
    nothing = requests.selectExpr("request_id", "0L n", "double(null) clean", "bigint(null) clean_id", "double(null) vetoed", "bigint(null) vetoed_id", "0L blocked")
    best = lambda score, entry: F.max(F.when(F.col(score).isNotNull(), F.struct(F.col(score).alias("score"), (-F.col(entry)).alias("order"))))
    summed = met.unionByName(nothing).groupBy("request_id").agg(
        F.sum("n").alias("n"), best("clean", "clean_id").alias("clean"), best("vetoed", "vetoed_id").alias("vetoed"), F.sum("blocked").alias("blocked")
    )
    reason = (
        F.when(F.col("clean").isNotNull(), "hit")
        .when(F.col("n") == 0, "empty")
        .when(F.col("vetoed").isNotNull(), "identifier guard")
        .otherwise("below threshold")
    )
    chosen = F.coalesce("clean", "vetoed")
    return summed.select(
        "request_id",
        F.col("clean").isNotNull().alias("hit"),
        reason.alias("reason"),
        (-chosen["order"]).alias("entry_id"),
        F.round(chosen["score"], 9).alias("score"),
        "blocked",
    )


def _packed(size: int, name: str):
    """Task function: (tenant, key, v, guard) to blocks of up to ``size`` rows of one tenant and vector length.

    A task holds at most HELD_ROWS rows; then all go out as they are, so blocks of many small tenants are small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[pa.RecordBatch]] = defaultdict(list)
        total = 0

        def flush(tenant: str, width: int) -> Iterator[pa.RecordBatch]:
            rows = pa.concat_batches(held.pop((tenant, width)))
            for at in range(0, len(rows), size):
                part = rows.slice(at, size)
                lists = (part.column(1), part.column(2).flatten(), part.column(3))
                columns = [pa.array([tenant]), pa.array([width], pa.int32()), *(pa.ListArray.from_arrays([0, len(x)], x) for x in lists)]
                yield pa.RecordBatch.from_arrays(columns, names=["tenant", *(f"{name}_{x}" for x in ("width", "keys", "vectors", "guards"))])

        for batch in batches:
            widths = pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            tenants = batch.column(0).dictionary_encode()
            codes = tenants.indices.to_numpy()
            order = np.lexsort((widths, codes))
            edges = np.flatnonzero(np.diff(codes[order]) | np.diff(widths[order])) + 1
            for rows in np.split(order, edges) if len(order) else ():
                own = (tenants.dictionary[codes[rows[0]]].as_py(), int(widths[rows[0]]))
                held[own].append(batch.take(pa.array(rows)))
                total += len(rows)
                if sum(map(len, held[own])) >= size:
                    total -= sum(map(len, held[own]))
                    yield from flush(*own)
            if total >= HELD_ROWS:
                for own in list(held):
                    yield from flush(*own)
                total = 0
        for own in list(held):
            yield from flush(*own)

    return run


def _judged(threshold: float):
    """Task function: a joined pair of blocks to one row a request: entries, the best clean and vetoed one, number blocked."""

    def best(scores: np.ndarray, ids: np.ndarray, which: np.ndarray) -> tuple[pa.Array, pa.Array]:
        scores = np.where(which, scores, -np.inf)
        top = scores.max(axis=1)
        lowest = np.where(scores == top[:, None], ids[None, :], np.iinfo(np.int64).max).min(axis=1)
        return pa.array(top, mask=np.isneginf(top)), pa.array(lowest, mask=np.isneginf(top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                values = lambda name: batch.column(name)[i].values  # noqa: B023, E731
                matrix = lambda name, width: values(name).to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)  # noqa: B023, E731
                keys, ids = values("q_keys"), values("e_keys").to_numpy()
                width = batch.column("q_width")[i].as_py()
                if width and width == batch.column("e_width")[i].as_py():
                    scores = np.round(matrix("q_vectors", width) @ matrix("e_vectors", width).T, 9)
                else:
                    scores = np.full((len(keys), len(ids)), np.nan)
                guards = pa.concat_arrays([values("q_guards"), values("e_guards")]).dictionary_encode().indices.to_numpy()
                same = guards[: len(keys), None] == guards[None, len(keys) :]
                near = scores >= threshold
                clean, vetoed = best(scores, ids, near & same), best(scores, ids, near & ~same)
                columns = [keys, pa.array(np.full(len(keys), len(ids))), *clean, *vetoed, pa.array((near & ~same).sum(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, names=["request_id", "n", "clean", "clean_id", "vetoed", "vetoed_id", "blocked"])

    return run


def request(requests: DataFrame, entries: DataFrame, now: Column, threshold: float = THRESHOLD) -> DataFrame:
    """``lookup`` among the entries that are live at ``now``, the newest of each tenant up to the capacity.

    At most CAPACITY entries a tenant meet its requests, so the pairs grow with the requests only.
    """
    return lookup(requests, newest(live(entries, now)), threshold)


def cacheable(tools_used: Column) -> Column:
    """Only answers that used no tool may be stored."""
    return F.coalesce(F.size(tools_used), F.lit(0)) <= 0


def store(entries: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """The cache after storing ``answers``: live entries and the answers that may be cached, within each tenant's capacity.

    Both have entry_id, user_id, created_at, and what else an entry holds; answers have tools_used besides.
    """
    fresh = answers.where(cacheable(F.col("tools_used"))).drop("tools_used")
    return newest(live(entries, now).unionByName(fresh))


def clear(entries: DataFrame, user: str | None) -> tuple[DataFrame, DataFrame]:
    """The entries without those of a tenant, and one row with the number removed."""
    own = namespace() == F.coalesce(F.lit(user).cast("string"), F.lit("anon"))
    return entries.where(~own), entries.agg(F.count_if(own).alias("removed"))


def listed(entries: DataFrame, size: int = 120) -> DataFrame:
    """Entries as a list shows them: the answer's first ``size`` characters."""
    return entries.withColumn("answer", F.left("answer", F.lit(size)))


def counters(outcomes: DataFrame) -> DataFrame:
    """One row: lookups, hits, misses by reason, and the hit rate in percent."""
    of = lambda reason: F.count_if(F.col("reason") == reason)
    return outcomes.agg(
        F.count("*").alias("lookups"),
        F.count_if("hit").alias("hits"),
        F.count_if(~F.col("hit")).alias("misses"),
        of("identifier guard").alias("blocked"),
        of("below threshold").alias("below"),
        of("empty").alias("empty"),
        F.round(F.coalesce(F.try_divide(100.0 * F.count_if("hit"), F.count("*")), F.lit(0.0)), 6).alias("hit_rate"),
    )
