"""Removal of long repeated passages by relative Lempel-Ziv parsing.

Every document is parsed against all documents with smaller ids, the reference. The
reference is indexed in blocks that the text itself delimits: each window of
`window_words` words belongs to the block of its smallest 8-word hash, so equal windows
fall into blocks of one anchor wherever they stand, and equal passages are cut alike.

1. A block that an earlier document holds whole matches the smallest such document at a
   known place.
2. A block that is not known whole, though others are indexed under its anchor, is opened:
   each of its windows is looked up among the windows of the opened blocks, and matches the
   smallest document that holds it. Matches begin and end inside such blocks.
3. Matches of one source and one displacement that overlap or touch are one match: it
   runs on over block boundaries for as long as the source stays the same.
4. The parse goes through a document greedily: at each place it takes the match that reaches
   farthest, emits the factor (start, length, source, place in the source), and goes on from
   the factor's end. A match that began before that end and reaches beyond it is taken up
   there, so no window across a factor boundary is missed. Words under factors are removed.

A match names the smallest document that holds each window, so it ends where that document
changes, even if a larger document would match longer; covered words do not depend on it.

Blocks and windows are known by two independent 64-bit polynomial hashes over XXH3 word
hashes. The index keeps one row for each distinct block, so a passage that a third of all
documents holds costs one row. Windows travel in packed blocks that are reduced first: a
window that many documents hold costs a row for each packed block, and no task gets all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from codegrove.llm.common import discard, materialize

ANCHOR_WORDS = 8
#: A window as it travels. So many are reduced and packed together, and met together in a bucket.
WINDOW = np.dtype([(k, "<i8") for k in ("w1", "w2", "doc", "rk")] + [("first", "<i4")])
MATCH = np.dtype([(k, "<i8") for k in ("doc", "rk", "source")] + [(k, "<i4") for k in ("first", "source_first")])
PACKED, BUCKETS = 1 << 17, 64
#: Odd multipliers of the two polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1


class Rolling:
    """Hashes of word ranges of one document."""

    def __init__(self, words: list[bytes]):
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
        self.sums, self.down = [], []
        for base, seed in zip(BASES, (0, 0x165667B19E3779F9)):
            up = np.full(len(h) + 1, base, dtype=np.uint64)
            up[0] = 1
            up = np.cumprod(up)
            down = np.full(len(h) + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
            down[0] = 1
            self.down.append(np.cumprod(down))
            mixed = (h ^ np.uint64(seed)) * np.uint64(0xFF51AFD7ED558CCD)
            mixed ^= mixed >> np.uint64(29)
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * up[:-1]))))

    def __call__(self, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash k (0 or 1) of the words in [start, end), mixed with their number."""
        s = self.sums[k]
        x = (s[end] - s[start]) * self.down[k][start] + (end - start).astype(np.uint64)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value in each run of `width` values."""
    at, reach = np.arange(len(x)), 1
    while reach < width:
        step = min(reach, width - reach)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(x[b] < x[a], b, a)
        reach += step
    return at


def parse(words: list[bytes], window: int) -> dict[str, np.ndarray] | None:
    """Blocks of one document: first window, number of windows, anchor, two hashes."""
    n = len(words) - window + 1
    if n <= 0:
        return None
    k = min(ANCHOR_WORDS, window)
    roll = Rolling(words)
    start = np.arange(len(words) - k + 1)
    gram = roll(0, start, start + k)
    at = sliding_argmin(gram, window - k + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    count = np.diff(np.r_[first, n])
    end = first + count - 1 + window
    place = (at[first] - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return {"first": first, "count": count, "anchor": gram[at[first]], "c1": roll(0, first, end) + place, "c2": roll(1, first, end) + place}


def _blocks(docs: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for b in batches:
            words = [(t.as_py() or "").encode().split() for t in b.column("text")]
            whole = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
            rows = [parse(w, window) if d.is_valid else None for d, w in zip(b.column("doc_id"), words)]
            ends = pa.array(np.cumsum([0] + [len(r["first"]) if r else 0 for r in rows]).astype(np.int32))
            lists = [
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64)] + [r[k].view(np.int64) for r in rows if r])))
                for k in ("first", "count", "anchor", "c1", "c2")
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("rk"), pa.array([len(w) for w in words], pa.int64()), pa.array(whole, pa.string()), *lists],
                names=["doc_id", "rk", "n_words", "whole_sha256", "first", "count", "anchor", "c1", "c2"],
            )

    lists = ", ".join(f"{k} array<bigint>" for k in ("first", "count", "anchor", "c1", "c2"))
    return docs.mapInArrow(run, f"doc_id long, rk long, n_words long, whole_sha256 string, {lists}")


def _matched(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of many windows: those that no smaller document here holds, and matches of the others with the smallest."""
    rows = rows[np.lexsort([rows[k] for k in ("first", "rk", "doc", "w2", "w1")])]
    head = np.flatnonzero(np.r_[True, (rows["w1"][1:] != rows["w1"][:-1]) | (rows["w2"][1:] != rows["w2"][:-1])])
    of = np.repeat(head, np.diff(np.r_[head, len(rows)]))
    later = rows["doc"] > rows["doc"][of]
    out = np.empty(int(later.sum()), MATCH)
    for k in ("doc", "rk", "first"):
        out[k] = rows[k][later]
    out["source"], out["source_first"] = rows["doc"][of[later]], rows["first"][of[later]]
    return rows[~later], out


def _repeats(opened: DataFrame, window: int, buckets: int) -> DataFrame:
    """(doc_id, rk, first, count, source, source_first) for each window of the opened blocks that a smaller doc_id holds too; count is 1."""

    def deal(batches):
        held, size = [], 0

        def blocks():
            rows, matches = _matched(np.concatenate(held))
            bucket = (rows["w1"].view(np.uint64) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            blobs = [rows[i:j].tobytes() for i, j in zip(start, np.r_[start[1:], len(rows)])]
            passed = [matches[i : i + PACKED // 8] for i in range(0, len(matches), PACKED // 8)]  # to any bucket: they only pass through it
            return pa.RecordBatch.from_arrays(
                [pa.array([*bucket[start].tolist(), *(int(p["rk"][0]) % buckets for p in passed)], pa.int32()), pa.array([*blobs, *(b"" for _ in passed)], pa.binary()), pa.array([*(b"" for _ in blobs), *(p.tobytes() for p in passed)], pa.binary())],
                names=["bucket", "windows", "matches"],
            )

        for b in batches:
            for doc, rk, text, spans in zip(b.column("doc_id").to_pylist(), b.column("rk").to_pylist(), b.column("text"), b.column("spans").to_pylist()):
                at = np.unique(np.concatenate([np.arange(s["first"], s["first"] + s["count"]) for s in spans]))
                roll = Rolling(text.as_py().encode().split())
                rows = np.empty(len(at), WINDOW)
                rows["w1"], rows["w2"] = (roll(k, at, at + window).view(np.int64) for k in (0, 1))
                rows["doc"], rows["rk"], rows["first"] = doc, rk, at
                held.append(rows)
                size += len(rows)
                if size >= PACKED:
                    yield blocks()
                    held, size = [], 0
        if size:
            yield blocks()

    def batch(m: np.ndarray) -> pa.RecordBatch:
        column = lambda k: pa.array(m[k].astype(np.int64))
        return pa.RecordBatch.from_arrays([column("doc"), column("rk"), column("first"), pa.array(np.ones(len(m), np.int64)), column("source"), column("source_first")], names=["doc_id", "rk", "first", "count", "source", "source_first"])

    def run(batches):
        held, now = [], None
        for b in batches:
            for k, windows, matches in zip(*(b.column(c).to_pylist() for c in ("bucket", "windows", "matches"))):
                if held and k != now:
                    yield batch(_matched(np.concatenate(held))[1])
                    held = []
                now = k
                if windows:
                    held.append(np.frombuffer(windows, WINDOW))
                if matches:
                    yield batch(np.frombuffer(matches, MATCH))
        if held:
            yield batch(_matched(np.concatenate(held))[1])

    dealt = opened.mapInArrow(deal, "bucket int, windows binary, matches binary").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "doc_id long, rk long, first long, count long, source long, source_first long")


def factors(first: np.ndarray, count: np.ndarray, source: np.ndarray, source_first: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """The greedy parse over matches of windows [first, first + count): factors (start, length, source, place in the source), in order, without overlap."""
    if not len(first):
        return []
    shift = source_first - first
    order = np.lexsort((first, shift, source))
    first, end, source, shift = first[order], (first + count - 1 + window)[order], source[order], shift[order]
    # matches of one diagonal that overlap or touch are one: a new one begins where the farthest end so far stays behind
    same = np.r_[False, (source[1:] == source[:-1]) & (shift[1:] == shift[:-1])]
    group = np.cumsum(~same)
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * span) - group * span
    new = np.flatnonzero(~same | np.r_[True, first[1:] > reach[:-1]])
    start, end = first[new], reach[np.r_[new[1:], len(reach)] - 1]
    source, shift = source[new], shift[new]
    order = np.argsort(start, kind="stable")
    out, at, k, best = [], 0, 0, -1
    start, end, source, shift = (x[order].tolist() for x in (start, end, source, shift))
    while k < len(start) or (best >= 0 and end[best] > at):
        while k < len(start) and start[k] <= at:
            if best < 0 or end[k] > end[best]:
                best = k
            k += 1
        if best >= 0 and end[best] > at:
            out.append((at, end[best] - at, source[best], at + shift[best]))
            at = end[best]
        elif k < len(start):
            at = start[k]
    return out


def _cut(rows: DataFrame, window: int) -> DataFrame:
    """Parse the texts with their matches: (doc_id, rk, removed, factors, n_removed, kept_sha256)."""

    def run(batches):
        for b in batches:
            parsed, spans_out, removed, kept = [], [], [], []
            for text, spans in zip(b.column("text"), b.column("spans")):
                words = text.as_py().encode().split()
                fields = spans.values
                found = factors(*(fields.field(k).to_numpy() for k in ("first", "count", "source", "source_first")), window)
                gone = np.zeros(len(words), bool)
                for start, length, _, _ in found:
                    gone[start : start + length] = True
                turn = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                parsed.append([dict(zip(("start", "length", "source", "source_start"), f)) for f in found])
                spans_out.append([{"start": int(x), "length": int(y - x)} for x, y in zip(turn[::2], turn[1::2])])
                removed.append(int(gone.sum()))
                kept.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist()) if not g)).hexdigest())
            kind = lambda *names: pa.list_(pa.struct([(n, pa.int64()) for n in names]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("rk"), pa.array(spans_out, kind("start", "length")), pa.array(parsed, kind("start", "length", "source", "source_start")), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "rk", "removed", "factors", "n_removed", "kept_sha256"],
            )

    return rows.mapInArrow(run, f"doc_id long, rk long, removed {SPANS}, factors {FACTORS}, n_removed long, kept_sha256 string")


SPANS = "array<struct<start: long, length: long>>"
FACTORS = "array<struct<start: long, length: long, source: long, source_start: long>>"


def dedup_substrings(docs: DataFrame, window_words: int = 50) -> DataFrame:
    """Remove every word covered by a window that also starts in a document with a smaller doc_id.

    A window is window_words consecutive words `[^\\x20\\x09-\\x0D]+` of one document;
    windows are judged on the input. Returns doc_id, n_words, n_removed, kept_sha256 (of
    the kept words joined by one space, UTF-8), removed, the spans of removed words, and
    factors, the parse of those spans (source: a doc_id, source_start: a word's number in it).

    Null, empty and short texts have no window and keep all words. A row whose doc_id is
    null is never a source and keeps all words. Rows that share a doc_id are parts of one
    document: they never remove each other's words; each row comes out once. An empty
    table gives an empty result; columns besides doc_id and text are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), "text")
    key = ["doc_id", "rk"]
    parsed = materialize(_blocks(docs, window_words), "blocks")
    block = F.explode(F.arrays_zip("first", "count", "anchor", "c1", "c2")).alias("b")
    uses = parsed.select(*key, block).select(*key, "b.*")

    at_source = F.min_by("first", "doc_id").alias("source_first")
    index = materialize(uses.groupBy("anchor", "c1", "c2").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), at_source), "index")
    shared = index.groupBy("anchor").agg(F.count("*").alias("n"), F.max(F.col("last") > F.col("source")).alias("again"))
    shared = shared.where("n > 1 or again").select("anchor", (F.col("n") > 1).alias("open"))
    held = materialize(index.join(shared, "anchor").select("anchor", "c1", "c2", "source", "source_first", "open"), "shared-index")
    discard(index)

    known = F.col("source") < F.col("doc_id")
    hits = materialize(uses.join(held, ["anchor", "c1", "c2"]).where(F.col("open") | known).select(*key, "first", "count", "source", "source_first", known.alias("known")), "hits")
    discard(held)
    # the hash tables are of a partition's spans; texts are not sorted
    unknown = hits.where("not known")
    total = unknown.agg(F.sum("count")).first()[0] or 0
    spans = unknown.groupBy(*key).agg(F.collect_list(F.struct("first", "count")).alias("spans"))
    repeats = materialize(_repeats(docs.join(spans.hint("shuffle_hash"), key).select(*key, "text", "spans"), window_words, max(BUCKETS, -(-total // PACKED))), "repeats")

    match = ["first", "count", "source", "source_first"]
    matches = hits.where("known").select(*key, *match).union(repeats.select(*key, *match))
    grouped = matches.groupBy(*key).agg(F.collect_list(F.struct(*match)).alias("spans"))
    cut = _cut(docs.join(grouped.hint("shuffle_hash"), key).select(*key, "text", "spans"), window_words)
    cut = cut.groupBy(*key).agg(*(F.first(c).alias(c) for c in ("removed", "factors", "n_removed", "kept_sha256")))
    return (
        parsed.select(*key, "n_words", "whole_sha256")
        .join(cut, key, "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
            F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
            F.coalesce("removed", F.array().cast(SPANS)).alias("removed"),
            F.coalesce("factors", F.array().cast(FACTORS)).alias("factors"),
        )
    )
