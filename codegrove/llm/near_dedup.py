"""Groups of documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8, by SimHash and an exact join for the rest.

Documents of equal sets are one node. Each node has a SimHash fingerprint of its set; the
binary-trie self-join of simhash.py links those that differ in at most FINGERPRINT_BITS bits, and
links whose texts are similar connect their nodes. Fingerprints give no bound at a similarity of
0.8, where some ten bits differ, so pairs not yet connected are found by prefixes:

All documents order their shingles alike: those of many documents, as told from a sample, come last,
the others by their hash. Of n shingles, two similar documents share one of the first
n - ceil(0.8 n) + 1, so every similar pair meets at such a shingle. First each node is compared with the smallest node of its size at
each of its shingles, which links large groups by a number of pairs that grows with
their size; then all pairs of nodes that meet and are not yet connected are compared.
Neither the fingerprints, the order nor the first step decide what is found. Of a pair that meets, the numbers
of shingles in BINS ranges of hashes are compared first: the sum of the smaller ones bounds
what the two can share, and only pairs that may be similar by it are compared by text.
Shingles are told by 64-bit hashes.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from codegrove.llm.common import connected_components, discard, materialize, trimmed
from codegrove.llm.line_dedup import _bytes, _mix, _words
from codegrove.llm.simhash import hamming_links

SHINGLE_WORDS, THRESHOLD = 5, 0.8
#: Fingerprints that differ in so many bits at most are candidates.
FINGERPRINT_BITS = 2
#: One of so many documents is read to find common shingles; a shingle is common if so many of those hold it; at most so many are kept.
SAMPLED, COMMON, MOST_COMMON = 16, 4, 1 << 17
#: Ranges of hashes in which shingles are counted, in 16 bits each; larger sets than could be counted so are not.
BINS, COUNTED = 256, 1 << 16
#: Ids of texts to be compared are broadcast up to so many.
BROADCAST_ROWS = 200_000


def shingle_sets(texts: pa.Array, width: int = SHINGLE_WORDS):
    """Sorted distinct 64-bit hashes of the shingles of each text: (hashes, end to end; where each text's begin and the last ends).

    A text of fewer words is one shingle, a blank or null text none. Words are bytes between
    ASCII white space, in lower case (A-Z only), told by 64-bit hashes.
    """
    data, offsets = _bytes(texts)
    at, h = _words(data, offsets)
    ends = np.searchsorted(at, offsets)
    doc = np.repeat(np.arange(len(texts)), np.diff(ends))
    size = np.diff(ends)[doc]  # words of the text that each word is of
    total = np.zeros(len(h), np.uint64)
    for k in range(width):
        factor = np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 | 1)
        term = _mix(h, 0xFF51AFD7ED558CCD + 2 * k) * factor
        n = max(0, len(h) - k)
        total[:n] += np.where(k < size[:n], term[k:], np.uint64(0))
    place = np.arange(len(h)) - ends[doc]
    valid = (place + width <= size) | ((place == 0) & (size < width))
    s, doc = _mix(total[valid] + np.minimum(size[valid], width).astype(np.uint64), 0xC2B2AE3D27D4EB4F).view(np.int64), doc[valid]
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])] if len(s) else np.zeros(0, bool)
    return s[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def shingles(text: str) -> np.ndarray:
    return _recent(text) if len(text) < 1 << 20 else _recent.__wrapped__(text)


@functools.lru_cache(maxsize=8)  # a group's text comes again and again; very long ones are not kept
def _recent(text: str) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.large_string()))[0]


def _sliced(batch: pa.RecordBatch, size: int = 1 << 20):
    """Slices of whole texts of about so many bytes, or one longer text."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def fingerprint(s: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set of hashes: a bit is 1 if set in over half of them; 0 of none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(s), 255 << 7):
        bits = np.unpackbits(s[at : at + (255 << 7)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255  # sums of 255 bits fit a byte
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > len(s), bitorder="little").view("<i8")[0])


def fingerprint_pairs(heads: DataFrame) -> DataFrame:
    """(u, v), u < v, of rows (node, fp): those of one fingerprint paired with the smallest of them, and these linked by hamming_links."""
    codes = materialize(heads.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    same = heads.select("fp", F.col("node").alias("v")).join(codes.withColumnRenamed("node", "u"), "fp").where("u < v").select("u", "v")
    links = hamming_links(codes, FINGERPRINT_BITS)
    return materialize(same.union(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).distinct(), "fingerprint-pairs")


def first_shingles(s: np.ndarray, common: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The shingles of the set s (sorted) at which a similar document must meet it. common: most frequent first."""
    n = len(s) - math.ceil(threshold * len(s) - 1e-9) + 1
    if not len(s) or not len(common):
        return s[:n]
    order = np.argsort(common, kind="stable")
    at = order[np.minimum(np.searchsorted(common[order], s), len(common) - 1)]
    rank = np.where(common[at] == s, len(common) - at, 0)  # 0: not common; the most frequent last
    return s[np.argsort(rank, kind="stable")[:n]]


def bins(s: np.ndarray) -> bytes:
    """How many of the hashes s (sorted) fall into each range; empty for a set too large to be counted."""
    edges = np.linspace(-(2**63), 2**63, BINS + 1)[1:-1].astype(np.int64)
    return b"" if len(s) >= COUNTED else np.diff(np.r_[0, np.searchsorted(s, edges), len(s)]).astype("<u2").tobytes()


def may_share(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The most shingles that each pair of sets can share by their bins; no bound (a large number) where one is not counted."""
    out = np.full(len(a), 1 << 62, np.int64)
    both = np.array([bool(x) and bool(y) for x, y in zip(a, b)], bool)
    if both.any():
        x, y = (np.frombuffer(b"".join(v for v, k in zip(c, both) if k), "<u2").reshape(-1, BINS) for c in (a, b))
        out[both] = np.minimum(x, y).sum(axis=1, dtype=np.int64)
    return out


def _chosen(texts: DataFrame, nodes: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, text), written, of the nodes in needed. texts: doc_id, text, text_hash; nodes: doc_id, text_hash. A text that is not needed does not travel, unless very many are."""
    wanted = materialize(nodes.select("doc_id", "text_hash").join(needed, F.col("doc_id") == F.col("node"), "left_semi").distinct(), "wanted")
    few = wanted.count() <= BROADCAST_ROWS
    found = texts.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), ["doc_id", "text_hash"], "left_semi")
    chosen = materialize(found.dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("node"), "text"), "compared")
    discard(wanted)
    return chosen


def _similar(pairs: DataFrame, counts: DataFrame, texts: DataFrame, nodes: DataFrame, threshold: float, label: str) -> DataFrame:
    """Those (u, v) of pairs whose texts are similar, written. counts: one row for each node; texts, nodes: see _chosen."""

    def bounded(batches):
        for x in batches:
            for b in (x.slice(i, 4096) for i in range(0, x.num_rows, 4096)):
                most = may_share(b.column("a").to_pylist(), b.column("b").to_pylist())
                total = b.column("n").to_numpy().astype(np.int64) + b.column("m").to_numpy()
                yield b.select(["u", "v"]).filter(pa.array(most >= threshold * (total - np.minimum(most, total)) - 1e-9))

    left, right = (counts.select(F.col("node").alias(k), F.col("n").alias(n), F.col("bins").alias(c)) for k, n, c in (("u", "n", "a"), ("v", "m", "b")))
    near = pairs.join(left, "u").join(right, "v").select("u", "v", "n", "m", "a", "b").mapInArrow(bounded, "u long, v long")
    near = materialize(near, "near-pairs")
    if near.isEmpty():
        return near
    chosen = _chosen(texts, nodes, near.select(F.col("u").alias("node")).union(near.select(F.col("v").alias("node"))).distinct())
    left, right = chosen.select(F.col("node").alias("u"), F.col("text").alias("a")), chosen.select(F.col("node").alias("v"), F.col("text").alias("b"))
    sides = near.join(left, "u").join(right, "v").select("u", "v", "a", "b")

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("a"), b.column("b")):
                x, y = shingles(x.as_py()), shingles(y.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    links = materialize(sides.mapInArrow(trimmed(run), "u long, v long"), label)
    for table in (near, chosen):
        discard(table)
    return links


def near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, component_id) for each row of docs with a doc_id and a text.

    component_id: smallest doc_id reachable over pairs whose similarity is at least threshold,
    the document itself included. text_hash: xxhash64 of the text, which tells rows of one
    doc_id apart. Blank texts are equal to one another. Null ids and null texts are left out:
    they are no copies of anything. An empty table gives an empty result; columns besides
    doc_id and text are not read.
    """
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).where("doc_id is not null and text is not null")

    def all_shingles(batches):
        for b in batches:
            for part in _sliced(b):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(part.column("text"))[0])], names=["s"])

    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).select("text")
    seen = sample.mapInArrow(all_shingles, "s long").groupBy("s").count().where(F.col("count") >= COMMON)
    common = seen.orderBy(F.desc("count"), "s").limit(MOST_COMMON).select("s").toArrow()["s"].to_numpy().astype(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def describe(batches):
        for b in (part for x in batches for part in _sliced(x)):
            s, ends = shingle_sets(b.column("text"))
            sets = [s[i:j] for i, j in zip(ends[:-1], ends[1:])]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            first = [first_shingles(s, shared.value, threshold) for s in sets]
            described = [pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(first, pa.list_(pa.int64())), pa.array([bins(s) for s in sets], pa.binary()), pa.array([fingerprint(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *described], names=["doc_id", "text_hash", "k", "n", "first", "bins", "fp"])

    rows = materialize(texts.mapInArrow(trimmed(describe), "doc_id long, text_hash long, k binary, n int, first array<long>, bins binary, fp long"), "shingles")
    nodes = materialize(rows.groupBy("k").agg(F.min(F.struct("doc_id", "text_hash")).alias("r")).select("k", F.col("r.doc_id").alias("doc_id"), F.col("r.text_hash").alias("text_hash")), "sets")
    of = materialize(rows.select("doc_id", "text_hash", "k").join(nodes.select("k", F.col("doc_id").alias("node")), "k").select("doc_id", "text_hash", "node"), "of")
    heads = materialize(rows.join(nodes, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("node"), "n", "first", "bins", "fp"), "nodes")
    discard(rows)
    counts = heads.select("node", "n", "bins")
    met = heads.select("node", "n", F.explode("first").alias("s"))
    several = met.groupBy("s").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("s")
    met = materialize(met.join(several, "s", "left_semi").distinct(), "met")

    marked = fingerprint_pairs(heads.select("node", "fp"))
    alike = _similar(marked, counts, texts, nodes, threshold, "fingerprint-links")
    components = materialize(connected_components(alike), "connected")

    first = None
    for shift in (0.0, 0.5):
        near = met.withColumn("band", F.floor(F.log("n") / -math.log(threshold) + shift))
        pairs = near.join(near.groupBy("s", "band").agg(F.min("node").alias("u")), ["s", "band"]).where("u < node").select("u", F.col("node").alias("v"))
        first = pairs if first is None else first.union(pairs)
    ends = [components.select(F.col("node").alias(k), F.col("component").alias(c)) for k, c in (("u", "x"), ("v", "y"))]
    apart = first.distinct().join(ends[0], "u", "left").join(ends[1], "v", "left").where("coalesce(x, u) <> coalesce(y, v)").select("u", "v")
    first = materialize(apart.join(marked, ["u", "v"], "left_anti"), "first-pairs")
    links = alike.union(_similar(first, counts, texts, nodes, threshold, "first-links"))
    components = connected_components(links)

    labelled = met.join(components, "node", "left").select("s", "node", "n", F.coalesce("component", "node").alias("label"))
    open_ = labelled.groupBy("s").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("s")
    labelled = materialize(labelled.join(open_, "s", "left_semi"), "open")
    a, b = (labelled.select("s", *(F.col(c).alias(c + side) for c in ("node", "n", "label"))) for side in "ab")
    sizes = (F.col("na") >= threshold * F.col("nb") - 1e-9) & (F.col("nb") >= threshold * F.col("na") - 1e-9)
    rest = a.join(b, (a.s == b.s) & (F.col("nodea") < F.col("nodeb")) & (F.col("labela") != F.col("labelb")) & sizes).select(F.col("nodea").alias("u"), F.col("nodeb").alias("v")).distinct()
    more = _similar(rest.join(first.union(marked), ["u", "v"], "left_anti"), counts, texts, nodes, threshold, "more-links")
    for table in (heads, met, first, labelled, marked, nodes):
        discard(table)
    components = connected_components(links.union(more))
    copies = materialize(of.join(components, "node", "left").select("doc_id", "text_hash", F.coalesce("component", "node").alias("component_id")), "near-copies")
    discard(of)
    return copies
