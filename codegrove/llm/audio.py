"""Audio fingerprints from chroma frames.

A recording is 16-bit mono PCM in a binary column. Overlapping frames are mapped to
energies of the twelve pitch classes; an integral image over (frame, pitch class) makes
any rectangle's sum four look-ups; sixteen filters compare rectangles, each answer is two
bits, and the bits of one place are packed into a 32-bit integer. Places are HOP samples
apart. Queries are fingerprinted at PHASES starts inside a hop, so one of them stands within
half a step of the places of any recording of the same sound. Two recordings are aligned by
the histogram of offsets at which they hold equal integers, and the alignment is confirmed
by its bit errors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codegrove.llm.common import materialize

RATE, FRAME, HOP = 4000, 512, 256
#: Filter window in frames; kinds and rectangles follow from the rule in `filters`.
SPAN = 8
PHASES = 4
#: A match overlaps at so many places and differs there in at most such a share of bits; so many equal integers make a candidate.
MIN_OVERLAP, MAX_BIT_ERROR, MIN_VOTES = 16, 0.2, 2


def filters() -> list[tuple[int, int, int, int]]:
    """Sixteen (kind, first pitch class, height, width): kinds 0 to 3 compare left and right, lower and upper, checks, and middle with sides."""
    return [(k % 4, (5 * k) % 9, 2 + k % 3, (4, 8, 4, 6)[k % 4]) for k in range(16)]


def chroma(samples: np.ndarray) -> np.ndarray:
    """(frames, 12) normalised pitch-class energies, smoothed over three frames."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=1)) ** 2
    hertz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    used = (hertz >= 100) & (hertz <= 1900)
    pitch = np.round(12 * np.log2(np.maximum(hertz, 1) / 440)).astype(int) % 12
    energy = power[:, used] @ np.eye(12)[pitch[used]]
    padded = np.pad(energy, ((1, 1), (0, 0)), mode="edge")
    energy = 0.25 * padded[:-2] + 0.5 * padded[1:-1] + 0.25 * padded[2:]
    norm = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.divide(energy, norm, out=np.zeros_like(energy), where=norm > 1e-3)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Packed 32-bit integers, one for each place of the filter window."""
    image = np.zeros((1, 1))
    c = chroma(samples.astype(np.float64))
    n = len(c) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    x = np.arange(n)

    def area(x0, x1, y0, y1):
        return image[x + x1, y1] - image[x + x0, y1] - image[x + x1, y0] + image[x + x0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in filters():
        mid, half, third = y + max(1, h // 2), w // 2, max(1, w // 3)
        top = min(12, y + h)
        if kind == 0:
            a, b = area(0, half, y, top), area(half, w, y, top)
        elif kind == 1:
            a, b = area(0, w, y, mid), area(0, w, mid, top)
        elif kind == 2:
            a, b = area(0, half, y, mid) + area(half, w, mid, top), area(half, w, y, mid) + area(0, half, mid, top)
        else:
            a, b = 2 * area(third, w - third, y, top), area(0, third, y, top) + area(w - third, w, y, top)
        v = np.log1p(a) - np.log1p(b)
        level = (v > -0.25).astype(np.uint32) + (v > 0) + (v > 0.25)  # 0 to 3
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1))).astype(np.uint32)  # neighbours differ in one bit
    return out.view(np.int32)


def render(notes: np.ndarray) -> bytes:
    """A test recording: one note of 64 ms for each number, its pitch by the number's size."""
    if not len(notes):
        return b""
    values = np.nan_to_num(np.asarray(notes, dtype=np.float64))
    steps = np.floor((np.tanh(values * 4) + 1) * 11.999).astype(int)
    hertz = np.repeat(220 * 2 ** (steps / 12), HOP)
    return (8000 * np.sin(2 * math.pi * np.cumsum(hertz) / RATE)).astype("<i2").tobytes()


def excerpt(recording: bytes, seed: int) -> bytes:
    """Four fifths of a test recording, cut at any sample, with noise 20 dB below it."""
    x = np.frombuffer(recording, dtype="<i2").astype(np.float64)
    rng = np.random.default_rng(seed)
    x = x[int(rng.integers(0, len(x) // 5 + 1)) :][: 4 * len(x) // 5]
    return np.clip(x + rng.normal(0, 0.1 * x.std() if len(x) else 0, len(x)), -32768, 32767).astype("<i2").tobytes()


def fingerprints(recordings: DataFrame, every: int = 0) -> DataFrame:
    """(rec_id, fp array<int>, phases) for each row of recordings (rec_id, audio). phases: for ids divisible by `every`, the fingerprints from PHASES starts. Null and short audio: empty arrays."""
    kind = pa.list_(pa.list_(pa.int32()))

    def run(batches):
        for b in batches:
            fps, phases = [], []
            for rec, sound in zip(b.column("rec_id").to_pylist(), b.column("audio")):
                sound = sound.as_py() or b""
                samples = np.frombuffer(sound[: len(sound) // 2 * 2], dtype="<i2")
                fps.append(fingerprint(samples))
                phases.append([fps[-1], *(fingerprint(samples[k * HOP // PHASES :]) for k in range(1, PHASES))] if every and rec is not None and rec % every == 0 else None)
            yield pa.RecordBatch.from_arrays([b.column("rec_id"), pa.array(fps, pa.list_(pa.int32())), pa.array(phases, kind)], names=["rec_id", "fp", "phases"])

    return recordings.select(F.col("rec_id").cast("long").alias("rec_id"), F.col("audio").cast("binary").alias("audio")).mapInArrow(run, "rec_id long, fp array<int>, phases array<array<int>>")


def runs(codes: str) -> Column:
    """An array column as runs of equal neighbours: (code, at, n), so a long constant stretch is one entry."""
    c = F.col(codes)
    starts = F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda i: (i == 0) | (F.get(c, i) != F.get(c, i - 1)))
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(c)))
    entries = F.zip_with(starts, ends, lambda i, j: F.struct(F.get(c, i).alias("code"), i.alias("at"), (j - i).alias("n")))
    return F.when(F.size(c) > 0, entries).otherwise(F.array().cast("array<struct<code: int, at: int, n: int>>"))


def align(recordings: DataFrame, every: int = 50, min_votes: int = MIN_VOTES, max_bit_error: float = MAX_BIT_ERROR) -> tuple[DataFrame, DataFrame]:
    """Search with every recording whose id is divisible by `every` against all recordings.

    Returns (members, matches). members: (rec_id, class_id), class_id the smallest id with
    the same fingerprint, so copies never meet one another; a class asks by its smallest id
    that is divisible. matches: (query_class, match_class, offset, votes, bit_error) between
    different classes that overlap at MIN_OVERLAP places or more, differ there in at most
    max_bit_error of all bits, and hold equal integers at `min_votes` of them. offset: samples
    by which a sound stands later in the query than in the match, to HOP / PHASES. Of several
    offsets the one with most votes is taken, then the smaller bit error, then the smaller
    offset. Null ids are skipped; null or short audio is a class without integers, which
    matches nothing.

    Integers meet in runs of equal neighbours, which are laid start to start and end to end:
    a run pair gives two offsets at most, however long it is.
    """
    fps = materialize(fingerprints(recordings, every).where("rec_id is not null"), "audio")
    key = F.xxhash64("fp"), F.size("fp"), F.hash("fp")
    keyed = fps.select("rec_id", "fp", *(k.alias(f"k{i}") for i, k in enumerate(key)))
    k = ["k0", "k1", "k2"]
    classes = materialize(keyed.groupBy(*k).agg(F.min("rec_id").alias("class_id"), F.min(F.when(F.col("rec_id") % every == 0, F.col("rec_id"))).alias("asks"), F.any_value("fp").alias("fp")), "audio-classes")
    members = keyed.select("rec_id", *k).join(classes.select(*k, "class_id"), k).select("rec_id", "class_id")

    asked = classes.where("asks is not null").select(F.col("class_id").alias("query_class"), F.col("asks").alias("rec_id"))
    phases = fps.where("phases is not null").select("rec_id", F.posexplode("phases").alias("phase", "q")).join(asked, "rec_id").select("query_class", "phase", "q").dropDuplicates(["query_class", "phase"])
    queries = materialize(phases, "audio-queries")
    query = queries.select("query_class", "phase", F.explode(runs("q")).alias("r")).select("query_class", "phase", F.col("r.code").alias("code"), F.col("r.at").alias("qa"), F.col("r.n").alias("qn"))
    places = classes.select(F.col("class_id").alias("match_class"), F.explode(runs("fp")).alias("r")).select("match_class", F.col("r.code").alias("code"), F.col("r.at").alias("ma"), F.col("r.n").alias("mn"))
    met = query.join(places, "code").where("query_class <> match_class")
    lay = F.array_distinct(F.array(F.col("qa") - F.col("ma"), F.col("qa") + F.col("qn") - F.col("ma") - F.col("mn")))
    votes = met.select("query_class", "phase", "match_class", F.least("qn", "mn").alias("n"), F.explode(lay).alias("shift")).groupBy("query_class", "phase", "match_class", "shift").agg(F.sum("n").alias("votes")).where(F.col("votes") >= min_votes)

    sides = votes.join(queries, ["query_class", "phase"]).join(classes.select(F.col("class_id").alias("match_class"), F.col("fp").alias("m")), "match_class")
    first, second = F.greatest("shift", F.lit(0)), F.greatest(-F.col("shift"), F.lit(0))
    length = F.least(F.size("q") - first, F.size("m") - second)
    sides = sides.where(length >= MIN_OVERLAP)
    bits = F.aggregate(F.zip_with(F.slice("q", first + 1, length), F.slice("m", second + 1, length), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, b: s + b)
    offset = F.col("shift") * HOP + F.col("phase") * (HOP // PHASES)
    rated = sides.select("query_class", "match_class", offset.alias("offset"), "votes", (bits / (32 * length)).alias("bit_error")).where(F.col("bit_error") <= max_bit_error)
    best = F.min(F.struct(-F.col("votes"), "bit_error", "offset")).alias("b")
    found = rated.groupBy("query_class", "match_class").agg(best)
    return members, found.select("query_class", "match_class", F.col("b.offset").alias("offset"), (-F.col("b.col1")).alias("votes"), F.col("b.bit_error").alias("bit_error"))
