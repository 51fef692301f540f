"""Line deduplication by an exact set-similarity join.

Lines are sets of lower-case words. A line goes when an earlier line (by doc_id, then line
number) has a Jaccard similarity of `threshold` or more with it; blank lines stay. Later
lines are judged against all earlier lines, whether or not those stay.

1. Word counts over all documents order the words by rarity, in steps of a twelfth of a
   doubling. They are kept in a fixed number of hashed counters; any order is exact, a good
   one keeps groups small.
2. Lines with equal word sets are one class, known by two 64-bit sums over differently
   mixed word hashes; every line but the first of a class goes.
3. Each class puts its rarest words, the prefix that two similar sets must share one of,
   into an index, with a 128-bit bitmap of its words; a word that occurs once in all
   documents is left out, as nobody else has it. Members of an index entry meet, those
   of nearest size first; a pair passes the length and positional filters and the bound
   that the bitmaps put on the overlap; a class that has PARTNERS partners, the likeliest
   of those met so far, is not compared on.
   Entries of words counted more than GROUP times are never gathered: they meet in rounds,
   round k with the earliest 16 ** k members, taken by partial aggregation.
4. Partners are verified by Jaccard on the word sets. A class none of whose partners holds,
   and which was not compared with all candidates, is compared with the rest of them.

Words are told by 64-bit hashes throughout, in classes and in verification: two words that
agree in theirs count as one. Texts are read in runs of whole lines of about SLICE bytes,
so memory follows the longest line and not the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from codegrove.llm.common import discard, materialize, trimmed

THRESHOLD = 0.8
#: Counters for word frequencies, whatever the vocabulary.
COUNTERS = 1 << 22
#: Counters that travel together; at most 2^16.
BLOCK = 1 << 16
#: Words counted more often are joined in rounds.
GROUP = 4096
STEPS = 12
#: So many partners of a class are taken from an index entry before comparison stops.
PARTNERS = 8
#: A line that has words, as it travels: sums of its word hashes, its place, size and bitmap, numbers of prefix words.
ROW = np.dtype([(k, "<i8") for k in ("k1", "k2", "doc", "rk", "b1", "b2")] + [(k, "<i4") for k in ("line", "n", "lone", "hot", "size")])
LATER = np.dtype([("doc", "<i8"), ("rk", "<i8"), ("line", "<i4")])
#: What an entry knows of its class; (doc_id, line, tag) tells and orders classes. The tag is the rk of its document and only matters for rows that share a doc_id.
MEMBER = ["doc_id", "line", "tag", "n", "at", "b1", "b2"]
#: A member of an index entry is compared with so many smaller and so many larger ones at first, then with twice as many, and so on.
MEETINGS = 64
#: Two numbers of so many bits are packed into one long where entries are exchanged.
HALF = 31
#: Entries travel in blocks, dealt by word into BUCKETS buckets, or as many as leave about ENTRIES entries in each.
BUCKETS, ENTRIES = 256, 1 << 18
#: Bytes of text taken up at once.
SLICE = 1 << 20
#: Parts in which the earliest entries of a common word are found before they are merged.
PARTS = 16
#: Words of more bytes, a multiple of eight, are hashed one by one.
LONG = 32
#: Tables of classes up to so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Keys of documents, single numbers, are broadcast up to so many.
BROADCAST_KEYS = 1_000_000


def _mix(h: np.ndarray, by: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(by)
    return h ^ (h >> np.uint64(29))


def _words(data: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of UTF-8 bytes start, and 64-bit hashes of them in lower case (A-Z only). docs: offsets of the documents, at which words end.

    A word is read as numbers of eight bytes, the last filled up with zeros: the first and
    the length are mixed, then each further number is added and mixed in. Words of more
    than LONG bytes get XXH3.
    """
    size = len(data)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    lower = np.zeros(size + LONG, np.uint8)  # numbers are read beyond the end
    np.add(data, (data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5), out=lower[:size])
    word = (data != 32) & (data - np.uint8(9) >= 5)
    edges = np.flatnonzero(np.concatenate((word[:1], word[1:] != word[:-1], word[-1:])))  # starts and ends in turn
    inner = docs[(docs > 0) & (docs < size)]
    inner = np.unique(inner[word[inner] & word[inner - 1]])
    if len(inner):
        edges = np.insert(edges, np.repeat(np.searchsorted(edges, inner), 2), np.repeat(inner, 2))
    start = np.ascontiguousarray(edges[::2])
    length = edges[1::2] - start
    numbers = np.ndarray(size + LONG - 7, np.uint64, lower, strides=(1,))  # the eight bytes from each place
    masks = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(LONG + 1)], np.uint64)
    length = np.minimum(length, LONG + 1)
    h = numbers[start] & masks[np.minimum(length, 8)]
    h += length.view(np.uint64) * np.uint64(0x9FB21C651E98DF2B)
    h = _mix(h, 0x9E3779B97F4A7C15)
    more = np.flatnonzero(length > 8)
    for k in range(8, LONG, 8):
        h[more] = _mix(h[more] + (numbers[start[more] + k] & masks[np.minimum(length[more] - k, 8)]), 0xD6E8FEB86659FD93)
        more = more[length[more] > k + 8]
    for i in more:
        end = int(edges[2 * i + 1])
        h[i] = _mix(np.array([xxhash.xxh3_64_intdigest(lower[start[i] : end].tobytes())], np.uint64), 0x9E3779B97F4A7C15)[0]
    return start, h


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and each text's offset in them; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _sets(line: np.ndarray, h: np.ndarray, levels: np.ndarray | None = None):
    """Distinct word hashes of many lines: (line, hash, rarity), sorted by line, then rarity, then hash. line and h: of each word; the last word's line is the largest."""
    level = levels[(h % np.uint64(len(levels))).astype(np.int64)] if levels is not None else np.zeros(len(h), np.uint16)
    packed = (line.astype(np.uint64) << np.uint64(42)) | (level.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32))
    order = np.argsort(packed)
    p, x = packed[order], h[order]
    new = np.r_[True, p[1:] != p[:-1]] if len(h) else np.zeros(0, bool)
    if (len(line) and line[-1] >= 1 << 22) or (x[1:] != x[:-1])[~new[1:]].any():  # hashes that agree in their upper half
        order = np.lexsort((h, level, line))
        line, h, level = line[order], h[order], level[order]
        new = np.r_[True, (line[1:] != line[:-1]) | (h[1:] != h[:-1])]
        return line[new], h[new], level[new]
    p = p[new]
    return (p >> np.uint64(42)).view(np.int64), x[new], (p >> np.uint64(32)).astype(np.uint16) & np.uint16(1023)


def _slices(texts: pa.Array, size: int = SLICE):
    """Runs of whole lines of about `size` bytes, or one longer line: (bytes, offsets of the documents in them, number of the first document, number of the line it begins with)."""
    data, offsets = _bytes(texts)
    doc, at, line = 0, 0, 0
    while doc < len(texts):
        end = max(doc, int(np.searchsorted(offsets, at + size, side="right")) - 1)
        if end > doc:  # whole documents, but for the beginning of the first
            yield data[at : offsets[end]], np.r_[0, offsets[doc + 1 : end + 1] - at], doc, line
            doc, at, line = end, int(offsets[end]), 0
            continue
        stop, cut, seen = int(offsets[doc + 1]), 0, at
        while not cut and seen < stop:
            breaks = np.flatnonzero(data[seen : min(seen + size, stop)] == 10)
            cut = seen + int(breaks[-1]) + 1 if len(breaks) else 0
            seen += size
        cut = cut or stop
        yield data[at:cut], np.array([0, cut - at]), doc, line
        line += int((data[at:cut] == 10).sum())
        at = cut
        if cut == stop:
            doc, line = doc + 1, 0


def word_levels(docs: DataFrame, counters: int = COUNTERS) -> tuple[np.ndarray, int]:
    """How often the words of each counter occur in docs, as STEPS * log2(n), rounded; the array's size is fixed. Also the number of line breaks in docs.

    Counters travel in blocks of BLOCK, of which a task sends those that are not zero.
    """

    def count(batches):
        total, breaks = np.zeros(counters, np.int64), 0
        for b in batches:
            for data, offsets, _, _ in _slices(b.column("text")):
                h = _words(data, offsets)[1]
                np.add.at(total, (h % np.uint64(counters)).astype(np.int64), 1)
                breaks += int((data == 10).sum()) + len(offsets)
        yield pa.RecordBatch.from_pydict({"block": pa.array([-1], pa.int32()), "at": [b"\0\0"], "n": [np.int64(breaks).tobytes()]})
        for k, i in enumerate(range(0, counters, BLOCK)):
            at = np.flatnonzero(total[i : i + BLOCK])
            if len(at):
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "at": [at.astype(np.uint16).tobytes()], "n": [total[i + at].tobytes()]})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, at, n in zip(*(b.column(c).to_pylist() for c in ("block", "at", "n"))):
                total = sums.setdefault(k, np.zeros(BLOCK, np.int64))
                total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int64)
        for k, total in sums.items():
            level = np.rint(np.log2(np.maximum(total, 1)) * STEPS).astype(np.uint16)
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "levels": [total[:1].tobytes() if k < 0 else level.tobytes()]})

    counted = docs.select("text").mapInArrow(trimmed(count), "block int, at binary, n binary")
    rows = counted.repartition("block").mapInArrow(add, "block int, levels binary").toArrow()  # a row for each block
    out, breaks = np.zeros(-(-counters // BLOCK) * BLOCK, np.uint16), 0
    for k, level in zip(rows["block"].to_pylist(), rows["levels"].to_pylist()):
        if k < 0:
            breaks = int(np.frombuffer(level, np.int64)[0])
        else:
            out[k * BLOCK : (k + 1) * BLOCK] = np.frombuffer(level, np.uint16)
    return out[:counters], breaks


def _lines(data: np.ndarray, offsets: np.ndarray, first_line: int, levels: np.ndarray, threshold: float, common: float):
    """Of each line that has words: (number of its document, ROW without doc and rk), and all prefixes, end to end."""
    at, h = _words(data, offsets)
    breaks = np.flatnonzero(data == 10)
    opening = np.searchsorted(breaks, offsets[:-1]) + np.arange(len(offsets) - 1)  # number of each document's first line among all lines
    ends = np.sort(np.concatenate((breaks, offsets[1:])))  # of each line
    line, h, level = _sets(np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(at, ends), prepend=0)), h, levels)
    start = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
    rows = np.zeros(len(start), ROW)
    if not len(start):
        return np.zeros(0, np.int64), rows, np.zeros(0, np.int64)
    n = np.diff(np.r_[start, len(line)])
    rows["k1"], rows["k2"] = (np.add.reduceat(x, start).view(np.int64) for x in (h, _mix(h, 0xC2B2AE3D27D4EB4F)))
    bit = np.uint64(1) << (h & np.uint64(63))
    upper = -((h >> np.uint64(6)) & np.uint64(1))  # all bits or none
    rows["b1"], rows["b2"] = (np.bitwise_or.reduceat(bit & keep, start).view(np.int64) for keep in (upper, ~upper))
    prefix = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1
    prefix[n / (n + 1) < threshold - 1e-9] = 0  # so short that only equal sets are similar
    stop = np.cumsum(prefix)
    inside = np.repeat(start - (stop - prefix), prefix) + np.arange(stop[-1])
    h, level = h[inside], level[inside]
    rows["lone"], rows["hot"] = (np.diff(np.r_[0, np.cumsum(x)][np.r_[0, stop]]) for x in (level == 0, (level > 0) & (level > common)))  # the lone are the rarest, so they come first
    rows["size"], rows["n"] = prefix - rows["lone"], n
    doc = np.searchsorted(opening, line[start], side="right") - 1
    rows["line"] = line[start] - opening[doc] + np.where(doc == 0, first_line, 0)
    return doc, rows, h[level > 0].view(np.int64)


def _ordered(rows: np.ndarray) -> np.ndarray:
    """Places of rows by class, then document, line and rk."""
    k1 = np.ascontiguousarray(rows["k1"])
    order = np.argsort(k1)
    same = np.diff(k1[order]) == 0
    tied = np.flatnonzero(np.r_[False, same] | np.r_[same, False]) if len(rows) else order
    if len(tied):  # most classes are of one line
        own = rows[order[tied]]
        order[tied] = order[tied][np.lexsort([own[k] for k in ("rk", "line", "doc", "k2", "k1")])]
    return order


def _reduced(held: list[tuple[np.ndarray, np.ndarray]]):
    """The first row of each class with its prefix, and the other rows, but for repeats of the first itself."""
    rows, prefix = (np.concatenate(x) for x in zip(*held))
    order = _ordered(rows)
    size = rows["size"].astype(np.int64)
    begin = np.cumsum(size) - size
    rows = rows[order]
    head = np.flatnonzero(np.r_[True, (rows["k1"][1:] != rows["k1"][:-1]) | (rows["k2"][1:] != rows["k2"][:-1])])
    of = np.repeat(head, np.diff(np.r_[head, len(rows)]))
    later = (rows["doc"] != rows["doc"][of]) | (rows["line"] != rows["line"][of]) | (rows["rk"] != rows["rk"][of])
    size, begin = size[order[head]], begin[order[head]]
    take = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    others = np.empty(int(later.sum()), LATER)
    for k in LATER.names:
        others[k] = rows[k][later]
    return rows[head], prefix[take], others


def _classes(docs: DataFrame, threshold: float, group: int) -> DataFrame:
    """A row for each class, at its first line: (doc_id, line, tag, n, b1, b2, lone, hot, prefix); and (doc_id, line, tag) of all other lines that have words.

    lone: number of words before the prefix that occur once in all documents; hot: number
    of words at its end that are common. Rows travel in blocks, reduced to one row of each
    class first, so a line that many documents hold costs a row for each block.
    """
    levels, breaks = word_levels(docs)
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # COUNTERS numbers of two bytes
    common = STEPS * np.log2(group) if group else -1
    buckets = max(BUCKETS, -(-breaks // ENTRIES))

    def deal(batches):
        held, count = [], 0

        def blocks():
            first, prefix, later = _reduced(held)
            bucket = (_mix(first["k1"].view(np.uint64), 0xD6E8FEB86659FD93) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            size = first["size"].astype(np.int64)
            begin = (np.cumsum(size) - size)[order]
            first, bucket, size = first[order], bucket[order], size[order]
            prefix = prefix[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends, cuts = np.r_[start[1:], len(first)], np.r_[0, np.cumsum(size)]
            out = [bucket[start], [first[i:j].tobytes() for i, j in zip(start, ends)], [prefix[cuts[i] : cuts[j]].tobytes() for i, j in zip(start, ends)], [b""] * len(start)]
            for i in range(0, len(later), 1 << 14):  # to any bucket: these rows only pass through it
                part = later[i : i + (1 << 14)]
                out = [np.r_[out[0], np.int32(int(part["rk"][0]) % buckets)], [*out[1], b""], [*out[2], b""], [*out[3], part.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["bucket", "rows", "prefixes", "later"])

        for b in batches:
            ids, keys = b.column("doc_id").to_numpy(), b.column("rk").to_numpy()
            for data, offsets, first_doc, first_line in _slices(b.column("text")):
                doc, rows, prefix = _lines(data, offsets, first_line, shared.value, threshold, common)
                rows["doc"], rows["rk"] = ids[first_doc + doc], keys[first_doc + doc]
                held.append((rows, prefix))
                count += len(rows)
                if count >= ENTRIES // 2:
                    yield blocks()
                    held, count = [], 0
        if count:
            yield blocks()

    def bucket(held):
        first, prefix, later = _reduced(held)
        ends = pa.array(np.r_[0, np.cumsum(first["size"])].astype(np.int32))
        numbers = {"doc_id": first["doc"], "line": first["line"], "tag": first["rk"], **{k: first[k] for k in ("n", "b1", "b2", "lone", "hot")}}
        yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x)) for x in numbers.values()), pa.ListArray.from_arrays(ends, pa.array(prefix))], names=[*numbers, "prefix"])
        yield others(later)

    def others(later):
        none = {"n": pa.int32(), **dict.fromkeys(("b1", "b2"), pa.int64()), **dict.fromkeys(("lone", "hot"), pa.int32()), "prefix": pa.list_(pa.int64())}
        known = [pa.array(np.ascontiguousarray(later[k])) for k in ("doc", "line", "rk")]
        return pa.RecordBatch.from_arrays([*known, *(pa.nulls(len(later), t) for t in none.values())], names=[*MINE, *none])

    def run(batches):
        held, now = [], None
        for b in batches:
            for k, rows, prefixes, later in zip(*(b.column(c).to_pylist() for c in ("bucket", "rows", "prefixes", "later"))):
                if held and k != now:
                    yield from bucket(held)
                    held = []
                now = k
                if rows:
                    held.append((np.frombuffer(rows, ROW), np.frombuffer(prefixes, np.int64)))
                if later:
                    yield others(np.frombuffer(later, LATER))
        if held:
            yield from bucket(held)

    dealt = docs.mapInArrow(trimmed(deal), "bucket int, rows binary, prefixes binary, later binary").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(trimmed(run), "doc_id long, line int, tag long, n int, b1 long, b2 long, lone int, hot int, prefix array<bigint>")


def _shared(word: np.ndarray) -> np.ndarray:
    """Where words stand that stand more than once, equal ones together."""
    order = np.argsort(word)
    same = word[order[1:]] == word[order[:-1]]
    return order[np.r_[False, same] | np.r_[same, False]] if len(word) else order


def _meet(firsts: DataFrame, threshold: float) -> DataFrame:
    """Pairs of a class and earlier partners, PARTNERS at most, in each index entry whose word is not common; more: there may be others.

    A bucket is in memory at once. Its words occur at most GROUP times each, and the number
    of buckets follows the number of entries. Entries meet by the upper half of their word:
    a pair that only this half makes equal is one more to verify.
    """
    low = (1 << HALF) - 1
    total = firsts.select(F.sum(F.ceil(F.col("n") * (1 - threshold)) + 1)).first()[0] or 0
    buckets = max(BUCKETS, -(-int(total) // ENTRIES))

    def deal(batches):
        held, count = [], 0

        def blocks():
            rows = np.concatenate(held, axis=1)
            bucket = (_mix(rows[0].view(np.uint64) >> np.uint64(HALF), 0xC2B2AE3D27D4EB4F) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[:, order], bucket[order]
            start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[start[1:], rows.shape[1]]
            return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[start]), "entries": pa.array([rows[:, i:j].tobytes() for i, j in zip(start, ends)], pa.binary())})

        for b in batches:
            col = {k: b.column(k).to_numpy() for k in ("doc_id", "line", "tag", "n", "b1", "b2", "lone", "hot")}
            sizes = b.column("prefix").value_lengths().to_numpy().astype(np.int64)
            own = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(own)) - (np.cumsum(sizes) - sizes)[own]
            cold = at < (sizes - col["hot"])[own]
            own, at = own[cold], at[cold] + col["lone"][own[cold]]
            word = (b.column("prefix").flatten().to_numpy()[cold] & ~low) | col["line"][own]
            extent = (col["n"].astype(np.int64)[own] << HALF) | at
            held.append(np.stack([word, col["doc_id"][own], col["tag"][own], extent, col["b1"][own], col["b2"][own]]))
            count += len(own)
            if count >= ENTRIES // 2:
                yield blocks()
                held, count = [], 0
        if count:
            yield blocks()

    def partners(c: dict[str, np.ndarray]):
        """c: sorted by word and n; the line is in the lower half of the word. In a pair the smaller or equal set has the word among its first n - 2t / (1 + t) * n words: short. So a member meets short ones of at most its size, and if it is short itself also all larger ones."""
        word, line, doc, tag, b1, b2 = c["word"] >> HALF, c["word"] & low, c["doc_id"], c["tag"], c["b1"].view(np.uint64), c["b2"].view(np.uint64)
        n, rest = c["extent"] >> HALF, (c["extent"] >> HALF) - (c["extent"] & low)
        entry = np.cumsum(np.r_[False, word[1:] != word[:-1]][: len(word)]) << 32
        least, most = np.ceil(n * threshold - 1e-9).astype(np.int64), np.floor(n / threshold + 1e-9).astype(np.int64)
        is_short = rest >= np.ceil(n * (2 * threshold / (1 + threshold)) - 1e-9)
        rows, short, sizes = np.arange(len(word)), np.flatnonzero(is_short), entry + n
        low_from, low_to = np.searchsorted(sizes[short], entry + least), np.searchsorted(sizes[short], sizes, side="right")
        high_from, high_to = np.searchsorted(sizes, sizes, side="right"), np.where(is_short, np.searchsorted(sizes, entry + most, side="right"), 0)
        mine, theirs, had, many = [rows[:0]], [rows[:0]], np.zeros(len(word), np.int64), MEETINGS
        while True:
            on = np.flatnonzero(((low_from < low_to) | (high_from < high_to)) & (had[rows] < PARTNERS))
            rows, low_from, low_to, high_from, high_to = (x[on] for x in (rows, low_from, low_to, high_from, high_to))
            if not len(rows):
                break
            for i in range(0, len(rows), SLICE // many + 1):  # the nearest in size
                part = slice(i, i + SLICE // many + 1)
                below, above = (np.clip(to[part] - begin[part], 0, many) for begin, to in ((low_from, low_to), (high_from, high_to)))
                r = np.concatenate((np.repeat(rows[part], below), np.repeat(rows[part], above)))
                a = np.concatenate((short[np.repeat(low_to[part] - np.cumsum(below), below) + np.arange(below.sum())], np.repeat(high_from[part] - (np.cumsum(above) - above), above) + np.arange(above.sum())))
                need = np.ceil((n[r] + n[a]) * (threshold / (1 + threshold)) - 1e-9)
                ok = np.flatnonzero(np.minimum(rest[r], rest[a]) >= need)
                r, a, need = r[ok], a[ok], need[ok]
                apart = np.bitwise_count(b1[r] ^ b1[a]).astype(np.int64) + np.bitwise_count(b2[r] ^ b2[a])
                ok = n[r] + n[a] - apart >= 2 * need
                ok &= (doc[a] < doc[r]) | ((doc[a] == doc[r]) & ((line[a] < line[r]) | ((line[a] == line[r]) & (tag[a] < tag[r]))))
                r, a, apart = r[ok], a[ok], apart[ok]
                order = np.lexsort((doc[a], apart / (n[r] + n[a]), r))  # the likeliest first, of these the earliest
                r, a = r[order], a[order]
                first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]][: len(r)])
                rank = had[r] + np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
                had[r] = rank + 1
                mine.append(r[rank < PARTNERS])
                theirs.append(a[rank < PARTNERS])
            low_to, high_from, many = low_to - many, high_from + many, many * 2
        mine, theirs = np.concatenate(mine), np.concatenate(theirs)
        cols = [x.astype(t) for i in (mine, theirs) for x, t in ((doc[i], np.int64), (line[i], np.int32), (tag[i], np.int64))]
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in cols), pa.array(had[mine] >= PARTNERS)], names=[*PAIR, "more"])

    def bucket(blocks: list[bytes]):
        rows = np.concatenate([np.frombuffer(x, np.int64).reshape(6, -1) for x in blocks], axis=1)
        order = _shared(rows[0] >> HALF)  # words of several classes
        word, extent = rows[0][order] >> HALF, rows[3][order]
        entry = np.cumsum(np.r_[False, word[1:] != word[:-1]][: len(word)])
        order = order[np.argsort((entry << 32) | (extent >> HALF))]
        return partners(dict(zip(("word", "doc_id", "tag", "extent", "b1", "b2"), (x[order] for x in rows))))

    def run(batches):
        blocks, now = [], None
        for b in batches:
            for k, x in zip(b.column("bucket").to_pylist(), b.column("entries").to_pylist()):
                if blocks and k != now:
                    yield bucket(blocks)
                    blocks = []
                blocks.append(x)
                now = k
        if blocks:
            yield bucket(blocks)

    dealt = firsts.select("doc_id", "line", "tag", "n", "b1", "b2", "lone", "hot", "prefix").mapInArrow(trimmed(deal), "bucket int, entries binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(run), "doc_id long, line int, tag long, a_doc_id long, a_line int, a_tag long, more boolean")


def _prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*(F.col(c).alias(p + c) for c in df.columns))


PAIR = ["doc_id", "line", "tag", "a_doc_id", "a_line", "a_tag"]
MINE, THEIRS = PAIR[:3], PAIR[3:]


def _pairs(later: DataFrame, earlier: DataFrame, threshold: float) -> DataFrame:
    """The same filters as _meet, as a join of entries on their word."""
    both = later.join(_prefixed(earlier, "a_"), F.col("word") == F.col("a_word"))
    need = F.ceil((F.col("n") + F.col("a_n")) * (threshold / (1 + threshold)) - 1e-9)
    apart = F.bit_count(F.col("b1").bitwiseXOR(F.col("a_b1"))) + F.bit_count(F.col("b2").bitwiseXOR(F.col("a_b2")))
    ok = F.least("n", "a_n") >= F.greatest("n", "a_n") * threshold - 1e-9
    ok &= (F.least(F.col("n") - F.col("at"), F.col("a_n") - F.col("a_at")) >= need) & (F.col("n") + F.col("a_n") - apart >= 2 * need)
    # column by column, the cheapest first: a struct would be built for each pair
    before = F.lit(False)
    for mine, theirs in reversed(list(zip(MINE, THEIRS))):
        before = (F.col(theirs) < F.col(mine)) | ((F.col(theirs) == F.col(mine)) & before)
    return both.where(before & ok).select(*PAIR)


def _rounds(entries: DataFrame, threshold: float) -> DataFrame | None:
    """_meet for entries of common words: no entry is gathered anywhere. None if there are no entries."""
    entries = materialize(entries, "common")
    found, low, high = None, 0, 1
    while not entries.isEmpty():
        if low:
            ranked = lambda df, *key: df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*MINE))).where(F.col("rank") <= high)
            heads = ranked(entries.withColumn("part", F.pmod(F.xxhash64(*MINE), F.lit(PARTS))), "word", "part").drop("part")
            heads = ranked(heads, "word").where(F.col("rank") > low).drop("rank")
        else:
            heads = entries.groupBy("word").agg(F.min(F.struct(*MEMBER)).alias("m")).select("word", "m.*")
        heads = materialize(heads, "heads")
        if heads.isEmpty():
            break
        later = entries if found is None else entries.join(found.select(*MINE), MINE, "left_anti")
        now = materialize(_pairs(later, heads, threshold).distinct(), "partners")
        discard(heads)
        found = now if found is None else found.union(now)
        low, high = high, high * 16
    return found


def _word_sets(docs: DataFrame, needed: DataFrame, few: bool = False) -> DataFrame:
    """(doc_id, line, tag, words) of the classes in needed (doc_id, line, tag, rk), read from the first line of each. few: they are probably in few documents, so that others need not travel. A class may come several times where its row is repeated."""
    lines = needed.groupBy("doc_id", "rk").agg(F.collect_set(F.struct("line", "tag")).alias("lines"))
    if few:
        lines = materialize(lines, "wanted")
        if lines.count() <= BROADCAST_KEYS:
            docs = docs.join(F.broadcast(lines.select("rk").distinct()), "rk", "left_semi")

    def run(batches):
        seen: set[tuple[int, int]] = set()  # repeats of a row are in one task, unless that was split
        for b in (x.slice(i, 64) for x in batches for i in range(0, x.num_rows, 64)):
            keys = list(zip(b.column("doc_id").to_pylist(), b.column("rk").to_pylist()))
            new = {k: i for i, k in enumerate(keys) if k not in seen}
            seen.update(new)
            if not new:
                continue
            b = b.take(pa.array(list(new.values()), pa.int64())) if len(new) < len(keys) else b
            lists = b.column("lines")
            doc = np.repeat(b.column("doc_id").to_numpy(), lists.value_lengths().to_numpy())
            number, tag = lists.flatten().field("line"), lists.flatten().field("tag")
            wanted, ends = number.to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            taken = []
            for text, i, j in zip(b.column("text"), ends[:-1], ends[1:]):
                lines = text.as_py().encode().split(b"\n")
                taken += [lines[k] for k in wanted[i:j]]
            data = np.frombuffer(b"\n".join(taken), np.uint8)
            at, h = _words(data, np.zeros(0, np.int64))
            line, h, _ = _sets(np.searchsorted(np.flatnonzero(data == 10), at), h)
            cuts = pa.array(np.searchsorted(line, np.arange(len(doc) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(doc), number, tag, pa.ListArray.from_arrays(cuts, pa.array(h.view(np.int64)))], names=["doc_id", "line", "tag", "words"])

    found = docs.join(lines.hint("shuffle_hash"), ["doc_id", "rk"]).select("doc_id", "rk", "text", "lines")
    return found.mapInArrow(run, f"doc_id long, line int, tag {needed.schema['tag'].dataType.simpleString()}, words array<bigint>")


def _similar_sets(threshold: float):
    """For mapInArrow: the classes (doc_id, line, tag) of rows whose word sets, words and a_words, are similar."""

    def run(batches):
        for b in batches:
            lists = [b.column(c) for c in ("words", "a_words")]
            sizes = [x.value_lengths().to_numpy().astype(np.int64) for x in lists]
            row, words = np.concatenate([np.repeat(np.arange(len(n)), n) for n in sizes]), np.concatenate([x.flatten().to_numpy() for x in lists])
            union = np.bincount(_sets(row, words.view(np.uint64))[0], minlength=b.num_rows)
            ok = sum(sizes) - union >= union * threshold - 1e-9
            yield b.select(MINE).filter(pa.array(ok))

    return run


def _verified(docs: DataFrame, pairs: DataFrame, threshold: float, few: bool = False) -> DataFrame:
    """Classes (doc_id, line, tag) with a pair whose word sets are similar. A hash table of a partition's wanted lines, not of texts, meets the texts."""
    needed = pairs.select(*MINE).union(pairs.select(*THEIRS)).distinct().withColumn("rk", F.col("tag"))
    sets = materialize(_word_sets(docs, needed, few), "word-sets", **{"parquet.enable.dictionary#words.list.element": "false"})
    both = pairs.join(sets.hint("shuffle_hash"), MINE).join(_prefixed(sets, "a_").hint("shuffle_hash"), THEIRS)  # sets are not sorted
    similar = both.select(*MINE, "words", "a_words").mapInArrow(_similar_sets(threshold), "doc_id long, line int, tag long")
    similar = materialize(similar.distinct(), "similar")
    discard(sets)
    return similar


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _entries(firsts: DataFrame) -> DataFrame:
    """A row for each index entry of the classes."""
    rows = firsts.select("doc_id", "line", "tag", "n", "b1", "b2", "lone", F.posexplode("prefix").alias("at", "word"))
    return rows.withColumn("at", F.col("lone") + F.col("at")).drop("lone")


def _similar(docs: DataFrame, firsts: DataFrame, threshold: float) -> DataFrame:
    """Classes (doc_id, line, tag) that are similar to a class whose first line is earlier."""
    pairs = _meet(firsts, threshold)
    hot = firsts.where("hot > 0").withColumn("lone", F.col("lone") + F.size("prefix") - F.col("hot")).withColumn("prefix", F.slice("prefix", F.size("prefix") - F.col("hot") + 1, F.col("hot")))
    common = _rounds(_entries(hot).select("word", *MEMBER), threshold)
    if common is not None:
        pairs = pairs.union(common.withColumn("more", F.lit(True)))
    pairs = materialize(pairs.groupBy(*PAIR).agg(F.max("more").alias("more")), "pairs")
    found = _verified(docs, pairs, threshold)
    failed = materialize(pairs.where("more").select(*MINE).distinct().join(found, MINE, "left_anti"), "failed")
    if failed.isEmpty():
        return found
    again = materialize(_entries(firsts.join(_small(failed), MINE, "left_semi")).select("word", *MEMBER), "again")
    others = _entries(firsts).join(_small(again.select("word").distinct()), "word", "left_semi").select("word", *MEMBER)
    rest = _pairs(again, others, threshold).distinct().join(pairs, PAIR, "left_anti")
    return found.union(_verified(docs, materialize(rest, "rest"), threshold, few=True))


def find_repeats(docs: DataFrame, threshold: float = THRESHOLD, group: int = GROUP) -> DataFrame:
    """(doc_id, rk, lines): numbers of the lines to remove, for each document that loses lines. docs: doc_id, rk, text."""
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in ("b1", "b2", "prefix.list.element")}  # numbers that hardly repeat
    lines = materialize(_classes(docs.where("doc_id is not null"), threshold, group), "lines", **plain)
    gone = lines.where("n is null").select(*MINE).union(_similar(docs, lines.where("n is not null"), threshold))
    repeats = materialize(gone.groupBy("doc_id", F.col("tag").alias("rk")).agg(F.collect_set("line").alias("lines")), "repeats")
    discard(lines)
    return repeats


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, group: int = GROUP, n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """docs with repeated lines removed from text, and the counts of lines in columns named n_lines and n_removed (replacing any of these names).

    Null and empty texts have one blank line and stay as they are; blank lines stay. Rows
    with a null doc_id stay as they are and are no source. Among rows that share a doc_id
    an earlier line is one with a smaller number; equal rows are treated as one and come
    out alike. An empty table gives an empty result. All other columns are kept.
    """
    docs = docs.drop(n_lines, n_removed)
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    inner = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("rk"), F.col("text").cast("string").alias("text"))
    repeats = find_repeats(inner, threshold, group).select(F.col("doc_id").alias("__codegrove_id"), F.col("rk").alias("__codegrove_rk"), F.col("lines").alias("__codegrove_gone"))
    # the hash table is of a partition's line numbers; texts are not sorted
    joined = docs.withColumn("__codegrove_key", key).join(repeats.hint("shuffle_hash"), (F.col("doc_id") == F.col("__codegrove_id")) & (F.col("__codegrove_key") == F.col("__codegrove_rk")), "left")
    loses = F.col("__codegrove_gone").isNotNull()
    joined = joined.withColumn("__codegrove_lines", F.when(loses, F.split("text", "\n")))  # a column of its own, so that transform does not split the text for every line
    stay = F.array_except(F.sequence(F.lit(0), F.size("__codegrove_lines") - 1), "__codegrove_gone")
    kept = F.when(loses, F.array_join(F.transform(stay, lambda i: F.get("__codegrove_lines", i)), "\n")).otherwise(F.col("text"))
    columns = [kept.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    count = (F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("int")
    return joined.select(*columns, F.when(loses, F.size("__codegrove_lines")).otherwise(count).alias(n_lines), F.when(loses, F.size("__codegrove_gone")).otherwise(0).alias(n_removed))
