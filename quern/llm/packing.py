"""Best-fit packing of documents into training sequences by a grouping genetic algorithm.

A document's length is its number of words (runs of what isn't white space), or any expression given as
``length``.  A document longer than ``capacity`` is cut into full pieces and a rest; pieces are then packed into
bins of ``capacity`` so that little is left empty and nothing else is cut.

* **Shards.**  Pieces are dealt by a hash of their place in the table to shards of about ``shard_items``, each a
  packing problem of its own, so that a worker holds a few thousand lengths (never texts) and work grows in
  proportion to the pieces.  By their place, not their contents: rows without a doc_id and rows that repeat spread too.
* **Islands.**  Each shard evolves on ``islands`` islands, each a row of a DataFrame with its own population of
  packings: best-fit-decreasing ones with perturbed orders.  Crossover injects a random choice of the first
  parent's well-filled bins whole into the second, takes out every bin of the second that holds one of their
  pieces again, and best-fits the displaced pieces, longest first, into the bins that remain.  Mutation dissolves a
  few of the worst-filled bins.  Fitness is the mean squared fill of the bins (fewer bins, and those full).
* **Migration.**  After each of ``epochs`` the elite of an island replaces the worst of the next one in a ring: a
  join of the islands' table with itself, written to the shared folder.

The best packing over the islands of each shard is the result: one row a bin.  All random choices are seeded by
shard, island and epoch: a run, or a task that is run again, gives the same bins.

Defined cases: null and empty texts and texts without a word have length 0 and are in no bin; rows with a null
doc_id are packed under the null; repeated rows are packed as often as they occur; a text of any length is cut into
pieces that are all packed; of bins that fit a piece equally well the first takes it; an empty table has no bins; only
doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import cut, map_arrow, pick, prepare

CAPACITY, SHARD_ITEMS, ISLANDS, POPULATION, EPOCHS, CHILDREN = 2048, 4096, 3, 4, 3, 3


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def pieces(docs: DataFrame, capacity: int = CAPACITY, length: Column | None = None) -> DataFrame:
    """(doc_id, piece, size): a document's pieces of at most ``capacity``, in order."""
    own = pick(docs, doc_id="doc_id", text="text")
    n = F.coalesce((words(F.col("text")) if length is None else length).cast("long"), F.lit(0).cast("long"))
    sized = own.select("doc_id", n.alias("n")).where("n > 0")
    last = F.floor((F.col("n") - 1) / capacity).cast("int")
    cutup = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return cutup.select("doc_id", "piece", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece").cast("long") * capacity).cast("int").alias("size"))


class Packing:
    """A packing of n pieces: the bin of each, and the fill of each bin."""

    def __init__(self, bin_of: np.ndarray, fill: np.ndarray):
        self.bin_of, self.fill = bin_of, fill

    def fitness(self, capacity: int) -> float:
        return float(np.mean((self.fill / capacity) ** 2)) if len(self.fill) else 1.0


def best_fit(sizes: np.ndarray, order: np.ndarray, bin_of: np.ndarray, fill: np.ndarray, capacity: int) -> Packing:
    """The packing after putting each piece of ``order`` into the fullest bin that has room, or a new one."""
    rooms = sorted(((capacity - f) << 32) | b for b, f in enumerate(fill.tolist()) if f < capacity)
    bins = len(fill)
    of = bin_of.copy()
    for item, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        k = bisect_left(rooms, size << 32)
        if k < len(rooms):
            room = rooms.pop(k)
            b, left = room & 0xFFFFFFFF, (room >> 32) - size
        else:
            b, left = bins, capacity - size
            bins += 1
        of[item] = b
        if left:
            insort(rooms, (left << 32) | b)
    return Packing(of, np.bincount(of, weights=sizes, minlength=bins).astype(np.int64))


def renumbered(bin_of: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, int]:
    """The bins that aren't gone, numbered anew; -1 for pieces of those that are."""
    new = np.where(gone, -1, np.cumsum(~gone) - 1)
    return new[bin_of], int(np.count_nonzero(~gone))


def crossover(a: Packing, b: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    full = np.flatnonzero(a.fill >= np.quantile(a.fill, 0.5))
    chosen = np.zeros(len(a.fill), bool)
    chosen[rng.choice(full, max(1, len(full) // 6), replace=False)] = True
    inject = chosen[a.bin_of]
    gone = np.zeros(len(b.fill), bool)
    gone[b.bin_of[inject]] = True
    of, bins = renumbered(b.bin_of, gone)
    number = np.cumsum(chosen) - 1 + bins
    of[inject] = number[a.bin_of[inject]]
    loose = np.flatnonzero(of < 0)
    fill = np.bincount(of[of >= 0], weights=sizes[of >= 0], minlength=bins + int(chosen.sum())).astype(np.int64)
    return best_fit(sizes, loose[np.argsort(-sizes[loose], kind="stable")], of, fill, capacity)


def mutation(p: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    gone = np.zeros(len(p.fill), bool)
    gone[np.argsort(p.fill, kind="stable")[: 1 + len(p.fill) // 50]] = True
    gone[rng.integers(0, len(p.fill), 1 + len(p.fill) // 50)] = True
    of, bins = renumbered(p.bin_of, gone)
    loose = np.flatnonzero(of < 0)
    fill = np.bincount(of[of >= 0], weights=sizes[of >= 0], minlength=bins).astype(np.int64)
    return best_fit(sizes, loose[np.argsort(-sizes[loose], kind="stable")], of, fill, capacity)


def first_generation(sizes: np.ndarray, capacity: int, population: int, rng: np.random.Generator) -> list[Packing]:
    out = []
    for k in range(population):
        noise = 1.0 if k == 0 else rng.uniform(1 - 0.1 * k, 1 + 0.1 * k, len(sizes))
        order = np.argsort(-(sizes * noise), kind="stable")
        out.append(best_fit(sizes, order, np.full(len(sizes), -1, np.int64), np.zeros(0, np.int64), capacity))
    return out


def evolve(members: list[Packing], sizes: np.ndarray, capacity: int, children: int, rng: np.random.Generator) -> list[Packing]:
    """The next generation, best first."""
    size = len(members)
    ranked = sorted(members, key=lambda p: -p.fitness(capacity))
    for _ in range(children):
        i, j = rng.choice(size, 2, replace=False) if size > 1 else (0, 0)
        child = crossover(ranked[min(i, j)], ranked[max(i, j)], sizes, capacity, rng)
        if rng.random() < 0.5:
            child = mutation(child, sizes, capacity, rng)
        ranked = sorted([*ranked, child], key=lambda p: -p.fitness(capacity))[:size]
    return ranked


def _row(shard, island, sizes, members, capacity):
    return {
        "shard": shard,
        "island": island,
        "sizes": sizes.astype(np.int32).tobytes(),
        "members": np.stack([p.bin_of for p in members]).astype(np.int32).tobytes(),
        "best": members[0].bin_of.astype(np.int32).tobytes(),
        "fitness": members[0].fitness(capacity),
    }


_STATE = "shard long, island int, sizes binary, members binary, best binary, fitness double"
_ARROW = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("sizes", pa.binary()), ("members", pa.binary()), ("best", pa.binary()), ("fitness", pa.float64())])


def _packing(raw: bytes, sizes: np.ndarray) -> Packing:
    of = np.frombuffer(raw, np.int32).astype(np.int64)
    return Packing(of, np.bincount(of, weights=sizes).astype(np.int64))


def _epoch_task(epoch: int, capacity: int, population: int, children: int, seed: int):
    def task(batches):
        for batch in batches:
            for r in batch.to_pylist():
                sizes = np.frombuffer(r["sizes"], np.int32).astype(np.int64)
                rng = np.random.default_rng([seed, r["shard"], r["island"], epoch])
                if epoch == 0:
                    members = first_generation(sizes, capacity, population, rng)
                else:
                    each = 4 * len(sizes)
                    members = [_packing(r["members"][k : k + each], sizes) for k in range(0, len(r["members"]), each)]
                    members[-1] = _packing(r["guest"], sizes)
                members = evolve(members, sizes, capacity, children, rng)
                yield pa.RecordBatch.from_pylist([_row(r["shard"], r["island"], sizes, members, capacity)], _ARROW)

    return task


def _bins_task(batches):
    for batch in batches:
        for k, r in enumerate(batch.select(["shard", "best"]).to_pylist()):
            of = np.frombuffer(r["best"], np.int32)
            items = batch.column(batch.schema.get_field_index("items"))[k].values
            order = np.argsort(of, kind="stable")
            counts = np.bincount(of)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, items.field(f).take(pa.array(order))) for f in ("doc_id", "piece", "size")]
            filled = np.bincount(of, weights=items.field("size").to_numpy()).astype(np.int64)
            bins = (r["shard"] << 32) + np.arange(len(counts))
            yield pa.RecordBatch.from_arrays([pa.array(bins), *lists, pa.array(filled)], ["bin_id", "doc_ids", "pieces", "sizes", "filled"])


def pack(docs: DataFrame, capacity: int = CAPACITY, length: Column | None = None, shard_items: int = SHARD_ITEMS, islands: int = ISLANDS, population: int = POPULATION, epochs: int = EPOCHS, children: int = CHILDREN, seed: int = 7) -> DataFrame:
    """(bin_id, doc_ids, pieces, sizes, filled): the bins, their contents in three lists of equal length."""
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    items = cut(pieces(docs, capacity, length))
    shards = max(1, -(-items.count() // shard_items))
    # items is written: reading it again gives each row the same place
    dealt = items.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("long"))
    held = cut(dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("doc_id", "piece", "size"))).alias("items")))

    def sizes_task(batches):
        for batch in batches:
            for k, shard in enumerate(batch.column(0).to_pylist()):
                sizes = batch.column(1)[k].values.to_numpy().astype(np.int32)
                for island in range(islands):
                    yield pa.RecordBatch.from_pylist([{"shard": shard, "island": island, "sizes": sizes.tobytes()}], pa.schema(list(_ARROW)[:3]))

    lengths = held.select("shard", F.col("items.size").alias("size"))
    start = map_arrow(lengths, sizes_task, "shard long, island int, sizes binary").repartition(max(1, min(shards * islands, 2 * spark.sparkContext.defaultParallelism + shards // 8)), "shard", "island")
    state = cut(map_arrow(start, _epoch_task(0, capacity, population, children, seed), _STATE))
    for epoch in range(1, epochs):
        guests = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("best").alias("guest"))
        met = state.drop("best", "fitness").join(guests.hint("shuffle_hash"), ["shard", "island"])
        state = cut(map_arrow(met, _epoch_task(epoch, capacity, population, children, seed), _STATE))
    best = state.groupBy("shard").agg(F.max_by("best", F.struct("fitness", -F.col("island"))).alias("best"))
    return map_arrow(held.join(best, "shard"), _bins_task, f"bin_id long, doc_ids array<{kind}>, pieces array<int>, sizes array<int>, filled long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of all documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
