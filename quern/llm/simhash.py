"""Near duplicates by SimHash, compared exactly in tiles.

* **Signatures.**  128 bits over a text's distinct pairs of consecutive words (a text of one word: the word), each
  pair casting one vote a bit.  Word pairs, not words: texts of one language share their function words, and
  single-word features would bring unrelated texts close.  128 bits, not 64: a copy with 3 words in 100 changed is
  some 14 of 128 bits away and unrelated texts 64, which leaves room for a radius between; of 64 bits, 7 and 32
  overlap once the pairs of documents run into the billions.
* **Comparison.**  Two documents are near duplicates if their signatures differ in at most ``radius`` bits, however
  long they are.  Documents with equal signatures are one point.  The 128 bits are divided into blocks, and each block
  has a threshold, such that the thresholds plus one sum up to ``radius`` plus one: two points within the radius are
  within the threshold in at least one block, else they would differ in more bits.  So for each block the points lie
  sorted by the block's value in files of the shared folder, and the points of one value are compared, by
  exclusive-or and bit counts in numpy, with those of all values within the threshold.  The search is exact and
  compares a few in a hundred of all pairs, the fewer the more points there are: more points have fewer and wider
  blocks (the README says how many).  Up to ``blocks_from`` points, for which blocks don't pay, all pairs of tiles
  are compared, with the same result: tiles are ranges of population counts; a count that has more points than a tile
  holds fills several, dealt by hash; every pair of tiles is one group of a Spark task and is skipped only if its
  population counts differ by more than the radius, which no pair within the radius does.
* **Groups.**  Each task passes on a spanning forest of the pairs it found, not the pairs; the connected components
  over all tasks are groups, found by alternating large-star and small-star steps, each written to the shared
  folder.  The document with the smallest doc_id of each group stays.

Defined cases: texts without a word (null, empty, only symbols) have no signature and are never duplicates; rows
with a null doc_id can't be named and stay; of rows that share a doc_id each has the group of its own text: it goes if
that group has a lesser doc_id, so that no text is lost; rows that repeat both stay or go together; a text of any length is read in whole; a bit with as many votes for as against
is 0; an empty table has no groups; columns besides doc_id and text are passed on as they are.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import arrays
from quern.llm import kernel as K
from quern.llm.common import column, cut, delete, map_arrow, own_folder, pick, prepare, row_key, small, texts_of, without_rows

RADIUS = 26
#: At least this many tiles, and more once a tile would have more than TILE_ROWS points (24 bytes each).
TILES, TILE_ROWS = 16, 500_000
#: From this many points on the search goes by blocks; points in one of their files (24 bytes each).
BLOCKS_FROM, FILE_ROWS = 50_000, 1 << 22
#: Bits of the widest block; pairs that a task holds before it makes a forest of them.
WIDEST, HELD_PAIRS = 24, 1_000_000
#: Seconds that one pair, one value and one value near it take, roughly; seconds of work in a task.
PAIR_S, VALUE_S, NEAR_S, TASK_S = 3e-9, 2e-4, 3e-8, 8
_U = np.uint64


def signatures_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) words of 64 bits, and the number of distinct features of each text (0: no signature)."""
    sig, count = np.zeros((len(texts), 2), _U), np.zeros(len(texts), np.int64)
    for a, b in K.slices(texts):
        cps, starts = K.code_points(texts[a:b])
        h, s, _ = K.words(cps)
        if not len(h):
            continue
        doc = np.searchsorted(starts, s, "right") - 1
        same = doc[1:] == doc[:-1]
        pair = K.mix(h[:-1] * _U(0x9E3779B97F4A7C15) + h[1:])[same]
        words = np.bincount(doc, minlength=b - a)
        lone = words[doc] == 1
        feature = np.concatenate([pair, h[lone]])
        of = np.concatenate([doc[1:][same], doc[lone]]).astype(_U)
        key = np.sort((of << _U(44)) | (feature >> _U(20)))
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        of = (key >> _U(44)).astype(np.int64)
        low = key & _U((1 << 44) - 1)
        votes = np.empty((len(low), 2), _U)
        votes[:, 0] = K.mix(low + _U(0x51ED270B0F2A3C55))
        votes[:, 1] = K.mix(low * _U(0xC2B2AE3D27D4EB4F) + _U(0x165667B19E3779F9))
        bits = np.unpackbits(votes.view(np.uint8), axis=1, bitorder="little")
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        n = np.diff(np.append(first, len(of)))
        sums = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        on = np.packbits(sums * 2 > n[:, None], axis=1, bitorder="little")
        sig[a + of[first]] = on.view(_U)
        count[a + of[first]] = n
    return sig, count


def _signature_task(names: list[str]):
    def task(batches):
        for batch in batches:
            sig, n = signatures_of(texts_of(batch))
            own = [batch.column(batch.schema.get_field_index(c)) for c in names]
            out = pa.RecordBatch.from_arrays([*own, pa.array(sig[:, 0].view(np.int64)), pa.array(sig[:, 1].view(np.int64))], [*names, "h0", "h1"])
            yield out.filter(pa.array(n > 0))

    return task


def signatures(docs: DataFrame) -> DataFrame:
    """docs without their text, with h0 and h1, for the rows that have a doc_id and a word."""
    names = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)
    return map_arrow(docs.where("doc_id is not null and text is not null"), _signature_task(names), f"{schema}, h0 long, h1 long")


def populations(sig: np.ndarray) -> np.ndarray:
    """The number of bits set in each of (n, 2) signatures."""
    return np.bitwise_count(sig).sum(axis=1, dtype=np.int64)


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs within the radius between two tiles (each sorted by population count); of one tile, each pair once."""
    pa_, pb_ = populations(a), populations(b)
    left, right = [], []
    rows, cols = 64, 4096
    halves = [(np.ascontiguousarray(a[:, k]), np.ascontiguousarray(b[:, k])) for k in (0, 1)]
    differ = np.empty(rows * cols, _U)
    counts = np.empty((2, rows * cols), np.uint8)
    for i in range(0, len(a), rows):
        end = min(i + rows, len(a))
        lo, hi = np.searchsorted(pb_, [pa_[i] - radius, pa_[end - 1] + radius + 1])
        if same:
            lo = max(lo, i)
        for j in range(lo, hi, cols):
            stop = min(hi, j + cols)
            shape = (end - i, stop - j)
            x = differ[: shape[0] * shape[1]].reshape(shape)
            c = [counts[k, : x.size].reshape(shape) for k in (0, 1)]
            for k, (of_a, of_b) in enumerate(halves):
                np.bitwise_xor(of_a[i:end, None], of_b[None, j:stop], out=x)
                np.bitwise_count(x, out=c[k])
            at = np.flatnonzero(np.minimum(c[0], c[1]) <= radius // 2)
            at = at[counts[0, at] + counts[1, at] <= radius]
            u, v = at // shape[1] + i, at % shape[1] + j
            if same:
                u, v = u[u < v], v[u < v]
            left.append(u)
            right.append(v)
    empty = np.zeros(0, np.int64)
    return np.concatenate([*left, empty]), np.concatenate([*right, empty])


def forest(u: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    """For each of ``size`` nodes the least node that the edges connect it to."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = np.minimum(new, new[new])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _tile_task(radius: int):
    def task(table: pa.Table) -> pa.Table:
        rep = table["node"].to_numpy()
        order = np.argsort(rep, kind="stable")  # a node's label is then the least
        right = table["r"].to_numpy()[order] == 1
        sig = np.stack([table["h0"].to_numpy()[order], table["h1"].to_numpy()[order]], axis=1).view(_U)
        rep = rep[order]
        pop = populations(sig)
        ia = np.flatnonzero(~right)
        ia = ia[np.argsort(pop[ia], kind="stable")]
        same = bool(table["same"][0].as_py())
        ib = ia if same else (lambda x: x[np.argsort(pop[x], kind="stable")])(np.flatnonzero(right))
        u, v = close_pairs(sig[ia], sig[ib], radius, same)
        label = forest(ia[u], ib[v], len(rep))
        moved = np.flatnonzero(label != np.arange(len(rep)))
        return pa.table({"a": pa.array(rep[moved]), "b": pa.array(rep[label[moved]])})

    return task


def tiling(counts: dict[int, int], tiles: int, tile_rows: int) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """For each population count its first tile and how many it has; of each tile its least and largest count."""
    total = sum(counts.values())
    target = -(-total // max(1, min(max(tiles, math.ceil(total / tile_rows)), math.ceil(total / 256))))
    first, many, ends, room = [0] * 129, [1] * 129, [], 0
    for p in range(129):
        n = counts.get(p, 0)
        if not n:
            continue
        if n > target:
            many[p], room = -(-n // target), 0
            first[p] = len(ends)
            ends += [(p, p)] * many[p]
            continue
        if n > room:
            ends.append((p, p))
            room = target
        first[p] = len(ends) - 1
        ends[-1] = (ends[-1][0], p)
        room -= n
    return first, many, ends


def blocks_of(n: int, radius: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, threshold) of each block, for the division that is likely the least work for n points."""

    def divided(m: int) -> list[tuple[int, int, int]]:
        most = [(radius + 1) // m + (k < (radius + 1) % m) - 1 for k in range(m)]
        bits = [1] * m
        for _ in range(128 - m):  # each further bit to the block that is the most work
            k = max((k for k in range(m) if bits[k] < WIDEST), key=lambda k: work_of(n, bits[k], most[k]))
            bits[k] += 1
        return [(sum(bits[:k]), bits[k], most[k]) for k in range(m) if most[k] >= 0]

    return min((divided(m) for m in range(-(-128 // WIDEST), max(-(-128 // WIDEST), min(radius + 1, 32)) + 1)), key=lambda x: sum(work_of(n, *b[1:]) for b in x))


def work_of(n: int, bits: int, threshold: int) -> float:
    """About the seconds that the search of one block takes."""
    near = sum(math.comb(bits, e) for e in range(threshold + 1))
    return n * n / 2 * min(1, near / 2**bits) * PAIR_S + min(n, 2**bits) * (VALUE_S + near * NEAR_S)


def values_of(h0: np.ndarray, h1: np.ndarray, first: int, bits: int) -> np.ndarray:
    """The value of a block in each signature."""
    x = h0 >> _U(first) if first < 64 else h1 >> _U(first - 64)
    if first < 64 < first + bits:
        x = x | h1 << _U(64 - first)
    return (x & _U((1 << bits) - 1)).astype(np.int64)


def _value_column(first: int, bits: int) -> Column:
    x = F.shiftrightunsigned("h0", first) if first < 64 else F.shiftrightunsigned("h1", first - 64)
    if first < 64 < first + bits:
        x = x.bitwiseOR(F.shiftleft("h1", 64 - first))
    return x.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _block_task(folder: str, blocks: list[tuple[int, int, int]]):
    def task(table: pa.Table) -> pa.Table:
        k, part = table["k"][0].as_py(), table["part"][0].as_py()
        h0, h1, node = table["h0"].to_numpy().view(_U), table["h1"].to_numpy().view(_U), table["node"].to_numpy()
        order = np.argsort(values_of(h0, h1, *blocks[k][:2]), kind="stable")
        return pa.table({"k": [k], "part": [part], "n": [len(node)], "file": [arrays.write(folder, [h0[order], h1[order], node[order]])]})

    return task


class _Sorted:
    """The points of one block in the order of its values, as they lie in one file after the other."""

    def __init__(self, folder: str, files: list[dict], first: int, bits: int):
        files = sorted(files, key=lambda r: r["part"])
        self.parts = [arrays.read(folder, r["file"], [(_U, r["n"]), (_U, r["n"]), (np.int64, r["n"])]) for r in files]
        self.edges = np.cumsum([0, *(r["n"] for r in files)])
        self.start = np.zeros(2**bits + 1, np.int64)  # of each value, and the end
        for h0, h1, _ in self.parts:
            for i in range(0, len(h0), 1 << 20):
                self.start[1:] += np.bincount(values_of(h0[i : i + (1 << 20)], h1[i : i + (1 << 20)], first, bits), minlength=2**bits)
        np.cumsum(self.start, out=self.start)

    def take(self, what: int, at: np.ndarray) -> np.ndarray:
        """One of h0, h1 and node at ascending places."""
        if len(self.parts) == 1:
            return self.parts[0][what][at]
        cuts = np.searchsorted(at, self.edges)
        own = [(p, a, b) for p, (a, b) in enumerate(itertools.pairwise(cuts)) if a < b]
        return np.concatenate([self.parts[p][what][at[a:b] - self.edges[p]] for p, a, b in own])


def _within(points: _Sorted, own: np.ndarray, other: np.ndarray, radius: int):
    """Pieces of the pairs within the radius, as places, between places that ascend."""
    rows, cols = 16, -(-len(other) // max(1, len(other) // 4096))  # numpy is slow over short rows
    b0, b1 = points.take(0, other), points.take(1, other)
    a0, a1 = points.take(0, own)[:, None], points.take(1, own)[:, None]
    buffers, counts = np.empty((2, rows * cols), _U), np.empty(rows * cols, np.uint8)
    for i in range(0, len(own), rows):
        for j in range(0, len(other), cols):
            shape = (min(rows, len(own) - i), min(cols, len(other) - j))
            x, y, c = (z[: shape[0] * shape[1]].reshape(shape) for z in (*buffers, counts))
            np.bitwise_xor(a0[i : i + rows], b0[j : j + cols], out=x)
            np.bitwise_xor(a1[i : i + rows], b1[j : j + cols], out=y)
            np.bitwise_count(np.bitwise_or(x, y, out=x), out=c)  # no more than the two halves' counts
            at = np.flatnonzero(c <= radius)
            if len(at):
                u, v = i + at // shape[1], j + at % shape[1]
                u, v = (z[np.bitwise_count(a0[u, 0] ^ b0[v]) + np.bitwise_count(a1[u, 0] ^ b1[v]) <= radius] for z in (u, v))
                yield own[u], other[v]


def _forest_of(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (greater, least node of its component) of pairs of nodes."""
    a, b = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in pairs)]) for k in (0, 1))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = forest(at[: len(a)], at[len(a) :], len(nodes))
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _block_search(points: _Sorted, begin: int, end: int, bits: int, threshold: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs within the radius of the points at begin to end with those whose value is near theirs."""
    masks = np.array([sum(1 << b for b in c) for e in range(1, threshold + 1) for c in itertools.combinations(range(bits), e)], np.int64)
    lowest = masks & -masks
    start, held, n = points.start, [], 0
    at = begin
    while at < end:
        value = int(np.searchsorted(start, at, "right")) - 1
        stop = min(end, int(start[value + 1]))
        own = np.arange(at, stop)
        near = np.sort(value ^ masks[(value & lowest) == 0])  # of two values, the one without the lowest differing bit
        low, many = start[near], start[near + 1] - start[near]
        low, many = low[many > 0], many[many > 0]
        places = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        for a, b in itertools.chain(_within(points, own, np.arange(at, start[value + 1]), radius), _within(points, own, places, radius) if len(places) else ()):
            a, b = a[a != b], b[a != b]
            if len(a):
                order = np.argsort(a, kind="stable")
                nodes_a = points.take(2, a[order])
                by_b = np.argsort(b[order], kind="stable")
                nodes_b = np.empty_like(nodes_a)
                nodes_b[by_b] = points.take(2, b[order][by_b])
                held.append((nodes_a, nodes_b))
                n += len(a)
                if n > HELD_PAIRS:
                    held = [_forest_of(held)]
                    n = 0
        at = stop
    return _forest_of(held)


def _search_task(folder: str, files: list[dict], blocks: list[tuple[int, int, int]], items: list[tuple[int, int, int]], radius: int):
    def task(batches):
        for batch in batches:
            for item in batch.column(0).to_pylist():
                k, begin, end = items[item]
                first, bits, threshold = blocks[k]
                points = _Sorted(folder, [r for r in files if r["k"] == k], first, bits)
                a, b = _block_search(points, begin, end, bits, threshold, radius)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return task


def block_edges(points: DataFrame, n: int, radius: int, tasks: int, file_rows: int = FILE_ROWS) -> DataFrame:
    """(a, b), a > b: a forest, task by task, of all pairs within the radius of n points (node, h0, h1), by blocks."""
    spark = points.sparkSession
    blocks, folder = blocks_of(n, radius), own_folder(spark, "blocks")
    part_bits = min(math.ceil(math.log2(max(1, n / file_rows))), min(w for _, w, _ in blocks))
    of = F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright(_value_column(first, w), w - part_bits).cast("int").alias("part")) for k, (first, w, _) in enumerate(blocks)])
    keyed = points.select("node", "h0", "h1", F.explode(of).alias("x")).select("node", "h0", "h1", "x.k", "x.part")
    files = [r.asDict() for r in keyed.groupBy("k", "part").applyInArrow(_block_task(folder, blocks), "k long, part long, n long, file string").collect()]  # a row a file
    work = [work_of(n, w, t) for _, w, t in blocks]
    items = []
    for k, own in enumerate(work):
        pieces = max(1, round(own / min(TASK_S, sum(work) / tasks)))
        ends = [n * i // pieces for i in range(pieces + 1)]
        items += [(k, a, b) for a, b in itertools.pairwise(ends) if a < b]
    found = cut(spark.range(0, len(items), 1, len(items)).mapInArrow(_search_task(folder, files, blocks, items, radius), "a long, b long"))
    delete(spark, folder)
    return found


def edges(points: DataFrame, radius: int = RADIUS, tiles: int = TILES, tile_rows: int = TILE_ROWS, blocks_from: int = BLOCKS_FROM) -> DataFrame:
    """(a, b), a > b: a spanning forest, task by task, of all near-duplicate pairs of points (node, h0, h1)."""
    spark = points.sparkSession
    pop = F.bit_count("h0") + F.bit_count("h1")
    counts = {r["pop"]: r["count"] for r in points.groupBy(pop.alias("pop")).count().collect()}  # at most 129 rows
    if (n := sum(counts.values())) >= max(1, blocks_from):
        return block_edges(points, n, radius, tiles)
    first, many, ends = tiling(counts, tiles, tile_rows)
    if not ends:
        return spark.createDataFrame([], "a long, b long")
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), pop + 1)
    points = points.withColumn("t", (of(first) + F.pmod(F.xxhash64("h0", "h1"), of(many))).cast("int"))
    last = len(ends) - 1
    bounds = spark.createDataFrame([(t, *x) for t, x in enumerate(ends)], "t int, lo int, hi int")  # a row a tile
    right = bounds.toDF("j", "lo_j", "hi_j")
    pairs = bounds.withColumnRenamed("t", "i").withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(last)))).join(F.broadcast(right), "j")
    near = F.greatest(F.col("lo") - F.col("hi_j"), F.col("lo_j") - F.col("hi")) <= radius
    plan = cut(pairs.where(near).select((F.col("i").cast("long") * len(ends) + F.col("j")).alias("pair"), "i", "j"))
    n = plan.count()
    one = points.join(small(plan, n), F.col("t") == F.col("i")).select("pair", "node", "h0", "h1", F.lit(0).alias("r"), (F.col("i") == F.col("j")).alias("same"))
    two = points.join(small(plan.where("i < j"), n), F.col("t") == F.col("j")).select("pair", "node", "h0", "h1", F.lit(1).alias("r"), F.lit(False).alias("same"))
    return one.unionByName(two).groupBy("pair").applyInArrow(_tile_task(radius), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each node of links (a, b) but the roots, the least node it is connected to."""
    e = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        e = cut(star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct())


def _duplicates(own: DataFrame, radius: int, tiles: int, tile_rows: int, blocks_from: int) -> DataFrame:
    """own without text, with kept_doc_id, for the rows that a document of a lesser id stands for."""
    sig = cut(signatures(own))
    points = sig.groupBy("h0", "h1").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    points = cut(points.withColumn("node", F.monotonically_increasing_id()))
    roots = cut(components(edges(points, radius, tiles, tile_rows, blocks_from)))
    every = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    n = roots.count()
    grouped = points.join(small(every, 2 * n), "node", "left")
    least = grouped.where("root is not null").groupBy("root").agg(F.min("rep").alias("least"))
    named = grouped.where("root is not null or n > 1").join(small(least, n), "root", "left").select("h0", "h1", F.coalesce("least", "rep").alias("kept_doc_id"))
    named = cut(named)
    return sig.join(small(named, named.count()), ["h0", "h1"]).where("doc_id <> kept_doc_id").drop("h0", "h1")


def duplicates(docs: DataFrame, radius: int = RADIUS, tiles: int = TILES, tile_rows: int = TILE_ROWS, blocks_from: int = BLOCKS_FROM) -> DataFrame:
    """(doc_id, kept_doc_id): each document that a kept one of its group stands for."""
    prepare(docs.sparkSession)
    found = _duplicates(pick(docs, doc_id="doc_id", text="text"), radius, tiles, tile_rows, blocks_from)
    return found.select("doc_id", "kept_doc_id").distinct()


def keep(docs: DataFrame, radius: int = RADIUS, tiles: int = TILES, tile_rows: int = TILE_ROWS, blocks_from: int = BLOCKS_FROM) -> DataFrame:
    """docs with one document of each group, the one of the least doc_id."""
    prepare(docs.sparkSession)
    keys = row_key(column(docs, "doc_id"), column(docs, "text"))
    own = docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").alias("text"), keys[0].alias("k0"), keys[1].alias("k1"))
    return without_rows(docs, ("doc_id", "text"), _duplicates(own, radius, tiles, tile_rows, blocks_from).select("k0", "k1"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that another one of its group stands for, with that one's id, which names the group."""
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
