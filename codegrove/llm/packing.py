"""Packing of tokenised documents into fixed-length sequences by a grouping genetic algorithm.

Pieces of equal length are interchangeable, so the number of pieces of each length (at
most `capacity` numbers, whatever the corpus) states the whole problem. A chromosome is a
list of groups: a bin filled with given lengths, and how many such bins there are.
Crossover injects whole well-filled bins of one parent into the other, removes the bins
that would use a piece twice, and best-fits the displaced pieces. Islands evolve as Spark
tasks; after each epoch every island's elite moves to the next island. Evolution ends when
the number of bins reaches the lower bound, or after `epochs`.

The pieces then find their places without meeting in one task: each is ranked among the
pieces of its length by two-level counting, and the plan maps (length, rank) to a place.
"""

from __future__ import annotations

import json
import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codegrove.llm.common import materialize
from codegrove.llm.near_dedup import _sliced
from codegrove.llm.tokens import default_ranks, default_tokenizer, encode_all

CAPACITY = 1024
END_ID = 2
ISLANDS, POPULATION, EPOCHS, GENERATIONS = 4, 6, 3, 12
#: Pieces of one length that are ranked together, on average at most.
RANKED_TOGETHER = 1 << 10
#: About so many bytes of text are encoded together, a repeated word once.
ENCODED_TOGETHER = 8 << 20

Groups = list[tuple[tuple[int, ...], int]]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """Tokenise and cut: (doc_id, piece, start, length, ids_crc32). Only documents over capacity are cut; the first piece takes the remainder."""
    tokenizer, ranks = tokenizer or default_tokenizer(), ranks if tokenizer else default_ranks()

    def run(batches):
        for b in (part for x in batches for part in _sliced(x, ENCODED_TOGETHER)):
            rows = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            texts = [t or "" for t in b.column("text").to_pylist()]
            for doc, ids in zip(b.column("doc_id").to_pylist(), encode_all(texts, tokenizer, ranks)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                start, length, piece = 0, len(ids) % capacity or capacity, 0
                while start < len(ids):
                    for k, v in zip(rows, (doc, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()))):
                        rows[k].append(v)
                    start, length, piece = start + length, capacity, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in rows.values()], names=list(rows))

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long")


def _merge(groups: Groups) -> Groups:
    total: dict[tuple[int, ...], int] = {}
    for lengths, n in groups:
        if n:
            total[lengths] = total.get(lengths, 0) + n
    return list(total.items())


def _complete(room: int, open_lengths: list[int]) -> tuple[int, ...]:
    """Lengths to put into a room: an exact pair if there is one, else the largest that fits, again and again."""
    out = []
    while room and open_lengths and open_lengths[0] <= room:
        at = bisect_left(open_lengths, room)
        if at < len(open_lengths) and open_lengths[at] == room:
            return (*out, room)
        for x in reversed(open_lengths[:at]):
            if 2 * x < room:
                break
            k = bisect_left(open_lengths, room - x)
            if x != room - x and k < len(open_lengths) and open_lengths[k] == room - x:
                return (*out, x, room - x)
        out.append(open_lengths[at - 1])
        room -= open_lengths[at - 1]
    return tuple(out)


def fill(counts: dict[int, int], capacity: int, rng: random.Random | None = None) -> Groups:
    """Bins for all pieces, each opened by the longest piece left (a random one where rng is given)."""
    left = {k: n for k, n in counts.items() if n}
    lengths = sorted(left)
    out = []
    while lengths:
        head = lengths[-1] if rng is None or rng.random() < 0.8 else rng.choice(lengths)
        bin_ = tuple(sorted((head, *_complete(capacity - head, lengths)), reverse=True))
        used = {x: bin_.count(x) for x in bin_}
        while any(left[x] < c for x, c in used.items()):  # a length was taken more often than there is
            x = next(x for x, c in used.items() if left[x] < c)
            bin_ = tuple(sorted(_without(bin_, x), reverse=True))
            used = {x: bin_.count(x) for x in bin_}
        n = min(left[x] // c for x, c in used.items())
        out.append((bin_, n))
        for x, c in used.items():
            left[x] -= n * c
            if not left[x]:
                lengths.remove(x)
    return _merge(out)


def _without(bin_: tuple[int, ...], x: int) -> list[int]:
    rest = list(bin_)
    rest.remove(x)
    return rest


def best_fit(groups: Groups, loose: dict[int, int], capacity: int, rng: random.Random | None = None) -> Groups:
    """Put loose pieces, longest first, into the fullest bins that take them; new bins take the rest."""
    room: dict[int, list[list]] = {}
    for lengths, n in groups:
        room.setdefault(capacity - sum(lengths), []).append([lengths, n])
    sizes = sorted(room)
    rest: dict[int, int] = {}
    for x in sorted(loose, reverse=True):
        n = loose[x]
        while n:
            at = bisect_left(sizes, x)
            if at == len(sizes):
                rest[x] = n
                break
            space = sizes[at]
            lengths, m = room[space].pop()
            t = min(m, n)
            if m > t:
                room[space].append([lengths, m - t])
            if not room[space]:
                del room[space], sizes[at]
            n -= t
            if space - x not in room:
                room[space - x] = []
                insort(sizes, space - x)
            room[space - x].append([tuple(sorted((*lengths, x), reverse=True)), t])
    return _merge([(lengths, n) for bins in room.values() for lengths, n in bins] + fill(rest, capacity, rng))


def crossover(one: Groups, other: Groups, counts: dict[int, int], capacity: int, rng: random.Random) -> Groups:
    """Inject well-filled bins of other into one; drop bins of one that need a piece already used; best-fit what is displaced."""
    left = dict(counts)
    child: Groups = []

    def take(lengths: tuple[int, ...], n: int) -> None:
        used = {x: lengths.count(x) for x in lengths}
        n = min(n, *(left[x] // c for x, c in used.items()))
        if n > 0:
            child.append((lengths, n))
            for x, c in used.items():
                left[x] -= n * c

    for lengths, n in sorted(other, key=lambda g: -sum(g[0])):
        if rng.random() < (0.5 if sum(lengths) == capacity else 0.2):
            take(lengths, n)
    for lengths, n in sorted(one, key=lambda g: -sum(g[0])):
        take(lengths, n)
    return best_fit(child, {x: n for x, n in left.items() if n}, capacity, rng)


def mutate(groups: Groups, counts: dict[int, int], capacity: int, rng: random.Random) -> Groups:
    """Empty the bins that are not full and a few others, and pack their pieces anew."""
    kept, loose = [], {}
    for lengths, n in groups:
        if sum(lengths) < capacity or rng.random() < 0.1:
            for x in lengths:
                loose[x] = loose.get(x, 0) + n
        else:
            kept.append((lengths, n))
    return _merge(kept + fill(loose, capacity, rng))


def cost(groups: Groups, capacity: int) -> tuple[int, float]:
    """Number of bins, then how unevenly they are filled: uneven filling leaves room for better children."""
    return sum(n for _, n in groups), -sum(n * (sum(x) / capacity) ** 2 for x, n in groups)


def evolve(population: list[Groups], counts: dict[int, int], capacity: int, seed: int, generations: int) -> list[Groups]:
    rng = random.Random(seed)
    bound = -(-sum(k * n for k, n in counts.items()) // capacity)
    rank = lambda g: cost(g, capacity)
    population = sorted(population, key=rank)
    for _ in range(generations):
        if rank(population[0])[0] <= bound:
            break
        one, other = rng.choice(population[: max(2, len(population) // 2)]), rng.choice(population)
        child = crossover(one, other, counts, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, counts, capacity, rng)
        if child not in population:
            population = sorted([*population[:-1], child], key=rank) if rank(child) < rank(population[-1]) else population
    return population


def plan(spark: SparkSession, counts: dict[int, int], capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS) -> Groups:
    """The best groups that the islands find."""
    if not counts:
        return []
    bound = -(-sum(k * n for k, n in counts.items()) // capacity)
    best = fill(counts, capacity)
    if cost(best, capacity)[0] <= bound:
        return best
    counts_json = json.dumps(counts)

    def run(frames):
        import pandas as pd

        numbers = {int(k): n for k, n in json.loads(counts_json).items()}
        for frame in frames:
            for row in frame.itertuples():
                rng = random.Random(row.seed)
                population = [[(tuple(x), n) for x, n in g] for g in json.loads(row.population)]
                while len(population) < POPULATION:
                    population.append(fill(numbers, capacity, rng))
                population = evolve(population, numbers, capacity, row.seed, GENERATIONS)
                yield pd.DataFrame({"island": [row.island], "population": [json.dumps(population)]})

    elites: list[Groups] = [best] * islands
    groups_of: list[list[Groups]] = [[] for _ in range(islands)]
    for epoch in range(epochs):
        rows = [(k, 1000 * epoch + k, json.dumps([*groups_of[k], elites[k - 1]])) for k in range(islands)]
        frame = spark.createDataFrame(rows, "island long, seed long, population string").repartition(islands, "island")
        for r in frame.mapInPandas(run, "island long, population string").collect():  # one bounded row for each island
            groups_of[r.island] = [[(tuple(x), n) for x, n in g] for g in json.loads(r.population)]
            elites[r.island] = groups_of[r.island][0]
            groups_of[r.island] = groups_of[r.island][: POPULATION - 1]
        best = min([best, *elites], key=lambda g: cost(g, capacity))
        if cost(best, capacity)[0] <= bound:
            break
    return best


def _places(groups: Groups) -> tuple[np.ndarray, ...]:
    """For each run of equal places, sorted by (length, first rank): length, first rank, first sequence, offset."""
    runs, taken, sequence = [], {}, 0
    for lengths, n in groups:
        offset = 0
        for x in lengths:
            runs.append((x, taken.get(x, 0), sequence, offset))
            taken[x] = taken.get(x, 0) + n
            offset += x
        sequence += n
    return tuple(np.array(c, dtype=np.int64) for c in zip(*sorted(runs))) if runs else tuple(np.empty(0, np.int64) for _ in range(4))


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """Pack all documents: one row per piece, with sequence_id and the offset in that sequence.

    A null, empty or blank text is a document of its ids and the end id. A null doc_id is
    kept; rows that share a doc_id are packed separately. An empty table gives an empty
    result; columns besides doc_id and text are not read.
    """
    rows = materialize(pieces(docs, capacity, end_id, tokenizer, ranks).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    length, first, sequence, offset = _places(plan(rows.sparkSession, counts, capacity))
    # a length is dealt into buckets in proportion to its pieces, by their place in the table: repeated rows part
    buckets = rows.sparkSession.createDataFrame([(x, n // RANKED_TOGETHER + 1) for x, n in counts.items()], "length long, buckets long")
    keyed = rows.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("row"), "buckets")).drop("buckets")  # at most `capacity` rows
    before = keyed.groupBy("length", "bucket").count()
    over = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "bucket", F.coalesce(F.sum("count").over(over), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("row")
    ranked = keyed.withColumn("rank", F.row_number().over(inside)).join(before, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") - 1 + F.col("before")).cast("long").alias("rank"))
    scale = 1 << 44  # ranks of one length stay below it

    def run(batches):
        key = length * scale + first
        for b in batches:
            x, r = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(key, x * scale + r, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence[at] + r - first[at]), pa.array(offset[at])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long")
