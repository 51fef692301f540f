"""SimHash near-duplicate detection by binary-trie self-joins.

Fingerprints link at two or fewer differing bits. The 64 bits are cut into three
blocks; two differing bits leave one block untouched, so three tries are built, each
over a rotation that puts one block on top. In each trie the error budget of the top
block is zero, which makes every trie node at that depth an independent task: below
it, node pairs are walked together, differing bits accumulate, and a pair whose sum
exceeds the budget is pruned.

Work is done on distinct fingerprints, so copies never meet one another. A node that
holds more than `node_limit` distinct fingerprints is split at its next bits, as many as
leave few in each part; a pair of parts is a task of its own if their bits differ within
the budget. A fingerprint goes to the tasks of its own part and of those within the budget:
their number grows with the square of the number of bits, not with the node. A distinct
fingerprint has at most 2,080 others within two bits, and a task only returns a spanning
forest of its links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from codegrove.llm.common import connected_components, materialize

#: Width of the three blocks of a 64-bit fingerprint.
BLOCKS = (22, 21, 21)
NODE_LIMIT = 1024
#: A crowded node is split at so many bits at most.
MOST_BITS = 20
_FRONTIER = 1 << 20


def simhash(text: str | None, shingle_words: int = 3) -> int:
    """64-bit SimHash of a text; null, empty and blank texts give 0."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
    h, seed = xxhash.xxh64_intdigest, 42
    hashes = np.array([h(s, seed) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row of docs; other columns are ignored."""

    def run(batches):
        for b in batches:
            fps = np.array([simhash(t.as_py(), shingle_words) for t in b.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def trie_pairs(codes: np.ndarray, left: np.ndarray, right: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of codes that differ in at most `budget` bits.

    codes: unsigned 64-bit, sorted inside each root. left, right: (n, 2) index ranges of
    root pairs; codes of a range agree on their first `depth` bits, as do both ranges of
    a pair. A range paired with itself gives each pair once.
    """
    alo, ahi, blo, bhi = left[:, 0], left[:, 1], right[:, 0], right[:, 1]
    acc = np.zeros(len(alo), dtype=np.int8)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for level in range(depth, 64):
        one = (ahi - alo == 1) & (bhi - blo == 1)  # two single leaves: the rest of both paths at once
        if one.any():
            i, j = alo[one], blo[one]
            ok = (np.bitwise_count(codes[i] ^ codes[j]) <= budget) & (i != j)
            found.append((i[ok], j[ok]))
            rest = ~one
            alo, ahi, blo, bhi, acc = alo[rest], ahi[rest], blo[rest], bhi[rest], acc[rest]
        if not len(alo):
            break
        ones = np.concatenate(([0], np.cumsum((codes >> np.uint64(63 - level)) & np.uint64(1)))).astype(np.int32)
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        parts = []
        for x0, x1, y0, y1, step, mirrored in ((alo, amid, blo, bmid, 0, False), (amid, ahi, bmid, bhi, 0, False), (alo, amid, bmid, bhi, 1, False), (amid, ahi, blo, bmid, 1, True)):
            keep = (x1 > x0) & (y1 > y0) & (acc + step <= budget)
            if mirrored:
                keep &= alo != blo
            if not step:
                keep &= (x0 != y0) | (x1 - x0 > 1)  # a leaf with itself
            parts.append((x0[keep], x1[keep], y0[keep], y1[keep], acc[keep] + np.int8(step)))
        alo, ahi, blo, bhi, acc = (np.concatenate(p) for p in zip(*parts))
    for i, j, m, n in zip(alo, blo, ahi - alo, bhi - blo):  # equal codes
        a, b = np.repeat(np.arange(i, i + m), n), np.tile(np.arange(j, j + n), m)
        keep = (a < b) if i == j else np.ones(len(a), bool)
        found.append((a[keep], b[keep]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label of each of n nodes: the smallest index in its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            return label


def _links(task: np.ndarray, side: np.ndarray, paired: np.ndarray, codes: np.ndarray, node: np.ndarray, depth: int, budget: int):
    """Spanning links of the tasks in the arrays, which are sorted by task, side and code. paired: the task is of two parts, of which one may be empty."""
    cut = np.flatnonzero(np.r_[True, (task[1:] != task[:-1]) | (side[1:] != side[:-1])])
    end = np.r_[cut[1:], len(task)]
    left, right = [], []
    k = 0
    while k < len(cut):
        same = k + 1 < len(cut) and task[cut[k]] == task[cut[k + 1]]
        if same:  # two parts of one node
            left.append((cut[k], end[k]))
            right.append((cut[k + 1], end[k + 1]))
        elif end[k] - cut[k] > 1 and not paired[cut[k]]:
            left.append((cut[k], end[k]))
            right.append((cut[k], end[k]))
        k += 1 + same
    if not left:
        return
    left, right = np.array(left, dtype=np.int32), np.array(right, dtype=np.int32)
    size = np.cumsum((left[:, 1] - left[:, 0]).astype(np.int64) * (right[:, 1] - right[:, 0]))
    for group in np.split(np.arange(len(left)), np.flatnonzero(np.diff(size // _FRONTIER)) + 1):
        a, b = trie_pairs(codes, left[group], right[group], depth, budget)
        if len(a):
            label = _forest(len(codes), a, b)
            i = np.flatnonzero(label != np.arange(len(codes)))
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[label[i]])], names=["u", "v"])


def _walk(batches, depth: int, budget: int):
    """Stream sorted task rows; a task is handed on when all its rows are there."""
    kept: list[np.ndarray] = []
    held = 0

    def columns(rows):
        # one number per task: tasks are contiguous, so a running count of changes serves
        change = np.r_[False, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]
        return np.cumsum(change), rows[:, 3], rows[:, 1] != rows[:, 2], rows[:, 4].astype(np.int64).view(np.uint64), rows[:, 5]

    for b in batches:
        rows = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "p", "q", "part", "code", "node")]).astype(np.int64)
        if not len(rows):
            continue
        kept.append(rows)
        held += len(rows)
        if (kept[0][0, :3] == rows[-1, :3]).all():
            continue
        rows = np.concatenate(kept)
        last = int(np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))[-1]) + 1
        yield from _links(*columns(rows[:last]), depth, budget)
        kept = [rows[last:]]
    if kept:
        yield from _links(*columns(np.concatenate(kept)), depth, budget)


def hamming_links(nodes: DataFrame, max_bits: int = 2, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Links (u, v) between rows (fp, node) of distinct fingerprints that differ in at most max_bits (0 to 2) bits.

    Only a spanning forest of each trie node's links is returned: it connects exactly
    what all links connect.
    """
    if not 0 <= max_bits < len(BLOCKS):
        raise ValueError(f"{len(BLOCKS)} blocks find all pairs within 0 to {len(BLOCKS) - 1} bits, not within {max_bits}")
    masks = F.array(*(F.lit(m).cast("long") for m in sorted(sum(1 << b for b in own) for k in range(max_bits + 1) for own in combinations(range(MOST_BITS), k))))
    links = None
    for r, width in enumerate(BLOCKS):
        turn = sum(BLOCKS[:r])
        rotated = F.col("fp") if not turn else F.shiftleft("fp", turn).bitwiseOR(F.shiftrightunsigned("fp", 64 - turn))
        rows = nodes.select(rotated.alias("code"), "node").withColumn("key", F.shiftrightunsigned("code", 64 - width))
        bits = F.least(F.ceil(F.log2(F.col("count") / node_limit)) + 3, F.lit(min(MOST_BITS, 64 - width)))
        large = rows.groupBy("key").count().where(F.col("count") > node_limit).select("key", bits.cast("int").alias("bits"))
        rows = rows.join(large, "key", "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
        below = F.expr(f"shiftright(code, {64 - width} - bits)")
        rows = rows.withColumn("part", below.bitwiseAND(F.expr("shiftleft(1L, bits) - 1")))
        rows = rows.withColumn("other", F.explode(F.filter(masks, lambda m: m < F.expr("shiftleft(1L, bits)")))).withColumn("other", F.col("part").bitwiseXOR(F.col("other")))
        rows = rows.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "code", "node")
        # signed sort order differs from unsigned only in the top bit, which is constant inside a key
        tasks = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "part", "code")
        found = tasks.mapInArrow(lambda batches, depth=width: _walk(batches, depth, max_bits), "u long, v long")
        links = found if links is None else links.union(found)
    return links


def near_duplicates(docs: DataFrame, max_bits: int = 2, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    fingerprint: 16 lowercase hex digits. component_id: smallest doc_id reachable over
    links of at most max_bits differing bits, the document itself included. Null, empty
    and blank texts have fingerprint zero and link like any other. A row whose doc_id is
    null keeps its fingerprint and has a null component. Repeated rows come out once
    each. An empty table gives an empty result; columns besides doc_id and text are not read.
    """
    fps = materialize(fingerprints(docs, shingle_words), "fingerprints")
    nodes = materialize(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    components = connected_components(hamming_links(nodes, max_bits))
    classes = nodes.join(components, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    classes = materialize(classes, "classes")
    return fps.join(classes, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
    )
