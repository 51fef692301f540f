"""SimHash and substring deduplication against brute force."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
import xxhash

from codegrove.llm import near_dedup, pipeline
from codegrove.llm.simhash import hamming_links, near_duplicates, simhash, trie_pairs
from codegrove.llm.common import connected_components
from codegrove.llm.substring_dedup import dedup_substrings, sliding_argmin

SCHEMA = "doc_id long, text string, rk string, fp int"


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items, linked):
    root = {i: i for i in range(len(items))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(items))]


def test_simhash_of_odd_texts():
    for text in (None, "", " \t\n", "One", "one TWO", "a b c d", "É à b \x1c c", "x " * 70000):
        assert simhash(text) == brute_simhash(text)


def test_trie_pairs_match_brute_force():
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    codes = sorted({centre ^ sum(1 << b for b in rng.sample(range(50), rng.randint(0, 3))) for _ in range(300)})
    u = np.array(codes, dtype=np.uint64)
    whole = np.array([[0, len(u)]])
    got = {tuple(sorted(p)) for p in zip(*(x.tolist() for x in trie_pairs(u, whole, whole, 0, 2)))}
    assert got == {(i, j) for j in range(len(u)) for i in range(j) if (codes[i] ^ codes[j]).bit_count() <= 2}
    halves = trie_pairs(u, np.array([[0, 100]]), np.array([[100, len(u)]]), 0, 2)
    assert {tuple(p) for p in zip(*(x.tolist() for x in halves))} == {p for p in got if p[0] < 100 <= p[1]}


@pytest.mark.parametrize("limit", [1024, 7])
def test_links_connect_what_brute_force_connects(spark, limit):
    rng = random.Random(2)
    codes = {rng.getrandbits(64) for _ in range(60)}
    for c in list(codes)[:20]:
        for _ in range(8):
            c ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
            codes.add(c)
    codes = sorted(codes)
    rows = [(c - (1 << 64) if c >> 63 else c, i) for i, c in enumerate(codes)]
    links = hamming_links(spark.createDataFrame(rows, "fp long, node long"), 2, limit)
    got = {r.node: r.component for r in connected_components(links).collect()}
    want = brute_components(codes, lambda a, b: (a ^ b).bit_count() <= 2)
    assert [got.get(i, i) for i in range(len(codes))] == want


def test_components_of_small_graphs(spark):
    rng = random.Random(8)
    graphs = [[(4, 1), (4, 3), (5, 3), (5, 2)]]
    for n in (8, 12):
        ids = rng.sample(range(100), n)
        graphs.append(list(zip(ids, ids[1:])))
        graphs.append([(ids[i], ids[rng.randrange(i)]) for i in range(1, n)] + [(200, 201), (202, 202)])
    for edges in graphs:
        ids = sorted({x for e in edges for x in e if e[0] != e[1]})
        want = brute_components(ids, lambda a, b: (a, b) in edges or (b, a) in edges)
        got = [(r.node, r.component) for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()]
        assert sorted(got) == [(i, ids[c]) for i, c in zip(ids, want)]


def test_near_duplicates_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(5, "", None, 1), (3, None, None, 2), (9, long, "x", 3), (7, long + " tail", "x", 3), (7, long + " tail", "x", 3), (None, long, "x", 3), (1, "other words here entirely", "x", 3)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[5].component_id == by[3].component_id == 3 and by[3].fingerprint == "0" * 16
    assert by[9].component_id == by[7].component_id == 7
    assert by[None].component_id is None and by[None].fingerprint == by[9].fingerprint
    assert by[1].component_id == 1 and int(by[9].fingerprint, 16) == brute_simhash(long)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def brute_substring(docs, window):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    seen = {}
    for d, w in words.items():
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            seen[k] = min(seen.get(k, d), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_sliding_argmin():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 5, 200).astype(np.uint64)
    for width in (1, 2, 3, 43):
        assert sliding_argmin(x, width).tolist() == [i + int(x[i : i + width].argmin()) for i in range(len(x) - width + 1)]


@pytest.mark.parametrize("window", [3, 10, 50])
def test_substrings_match_brute_force(spark, window):
    rng = random.Random(window)
    pool = [f"w{i}" for i in range(40)]
    passages = [[rng.choice(pool) for _ in range(rng.randint(window - 2, 3 * window))] for _ in range(6)]
    docs = []
    for d in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(passages) if rng.random() < 0.6 else [f"u{rng.random()}" for _ in range(rng.randint(0, 2 * window))]
        if d % 7 == 3 and docs:
            words = (docs[-1][1] or "").split()
            if words:
                words[len(words) // 2] = "edited"
        docs.append((d * 3, rng.choice([" ", "\n", " \t"]).join(words)))
    docs += [(500, None), (501, ""), (502, "one two"), (503, "a " * 200), (504, "a " * 120)]
    rng.shuffle(docs)
    frame = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in dedup_substrings(frame, window).collect()}
    assert got == brute_substring(docs, window)


def check_factors(words, rows, window):
    """Factors lie in order, copy a smaller document's words, and cover what is removed."""
    for r in rows:
        at, covered = 0, set()
        for f in r.factors:
            assert f.start >= at and f.length > 0 and f.source < r.doc_id
            assert words[r.doc_id][f.start : f.start + f.length] == words[f.source][f.source_start : f.source_start + f.length]
            at = f.start + f.length
            covered.update(range(f.start, at))
        assert covered == {i for s in r.removed for i in range(s.start, s.start + s.length)} and len(covered) == r.n_removed


def longest_match(words, sources, at):
    return max(next((n for n in range(min(len(words) - at, len(s) - i) + 1) if words[at : at + n + 1] != s[i : i + n + 1] or n == min(len(words) - at, len(s) - i)), 0) for s in sources for i in range(len(s)))


@pytest.mark.parametrize("window", [10, 50])
def test_factors_are_the_greedy_parse(spark, window):
    rng = random.Random(window)
    fresh = lambda n: [f"u{rng.random()}" for _ in range(n)]
    words = {1: fresh(900), 2: fresh(700), 3: fresh(400)}
    words[10] = [*fresh(30), *words[1][100:520], *words[2][50:600], *fresh(5), *words[3][3 : 3 + window], *words[1][5 : 5 + window - 1], *fresh(20)]
    words[11] = [*words[2][20:200], *words[2][190:400], *words[3]]
    words[12] = words[10][10:700]
    frame = spark.createDataFrame([(d, " ".join(w), "", 0) for d, w in words.items()], SCHEMA)
    rows = dedup_substrings(frame, window).collect()
    check_factors(words, rows, window)
    got = {r.doc_id: [(f.start, f.length, f.source, f.source_start) for f in r.factors] for r in rows}
    assert got[10] == [(30, 420, 1, 100), (450, 550, 2, 50), (1005, window, 3, 3)] and got[11] == [(0, 180, 2, 20), (180, 210, 2, 190), (390, 400, 3, 0)]
    for doc in (10, 11):  # each factor of one smallest source is the longest match at its place
        assert all(f[1] == longest_match(words[doc], [words[d] for d in (1, 2, 3)], f[0]) for f in got[doc])


def test_hot_windows_are_reduced_before_they_meet():
    from codegrove.llm.substring_dedup import WINDOW, _matched

    rows = np.zeros(5000, WINDOW)
    rows["w1"], rows["doc"], rows["first"] = 7, np.arange(5000)[::-1], 3
    kept, matches = _matched(rows)
    assert len(kept) == 1 and kept["doc"][0] == 0 and len(matches) == 4999 and set(matches["source"]) == {0}


def test_substring_edge_cases(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(4, text, "", 0), (4, text, "", 0), (None, text, "", 0), (9, text + " end", "", 0)]
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed, len(r.removed)) for r in dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, 80, 0, 0), (4, 80, 0, 0), (4, 80, 0, 0), (9, 81, 80, 1)]
    assert dedup_substrings(spark.createDataFrame([], SCHEMA)).collect() == []


def test_near_copies_match_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(500)]
    passage = [rng.choice(pool) for _ in range(40)]
    docs = []
    for size, edits in [(60, 1), (120, 1), (240, 2), (500, 4), (500, 8), (1000, 1), (30, 1)]:
        for _ in range(6):
            words = [rng.choice(pool) for _ in range(size)]
            for n in (0, edits, edits, 3 * edits):
                copy = list(words)
                for _ in range(n):
                    copy[rng.randrange(size)] = "changed"
                docs.append(copy)
    docs += [passage + [rng.choice(pool) for _ in range(rng.randint(0, 12))] for _ in range(40)]
    docs += [["a", "b", "c"], ["A", "b", "c"], ["a", "b", "d"], [], [" "]]
    rng.shuffle(docs)
    rows = [(3 * i + 1, " ".join(w), "x", 0) for i, w in enumerate(docs)] + [(9000, None, "x", 0), (9001, None, "x", 0), (None, " ".join(docs[0]), "x", 0), (9002, " ".join(docs[0]), "x", 0), (9002, "of its own", "x", 0)]

    def shingled(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    texts = [r for r in rows if r[0] is not None and r[1] is not None]
    sets = [shingled(t) for _, t, *_ in texts]
    root = brute_components(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    want = sorted((r[0], texts[c][0]) for r, c in zip(texts, root))
    assert sum(d != c for d, c in want) > 80
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for common in (4, 1):
        monkeypatch.setattr(near_dedup, "COMMON", common)
        assert sorted((r.doc_id, r.component_id) for r in near_dedup.near_copies(frame).collect()) == want
    kept = sorted((r.doc_id or 0, r.text) for r in pipeline.simhash_near_dedup(spark, frame, "").collect())
    gone = {d for d, c in want if c < d} - {9002}
    assert kept == sorted((d or 0, t) for d, t, *_ in rows if d not in gone and (d, t) != (9002, " ".join(docs[0])))
    assert near_dedup.near_copies(frame.limit(0)).collect() == []


def test_shingle_sets_tell_texts_apart_like_words_do():
    import pyarrow as pa

    rng = random.Random(9)
    texts = [None, "", " \n", "a", "A", "b", "a b", "b a", "a b c d", "a b c d e", "A b\tc d  e f", "é É", "x" * 40 + " y z", "x y " * 400, "a b c d e a b c d e"] + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(200)]

    def plain(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())

    s, ends = near_dedup.shingle_sets(pa.array(["skipped one two three four five", *texts]).slice(1))
    got = [tuple(s[i:j].tolist()) for i, j in zip(ends[:-1], ends[1:])]
    known = {}
    for t, hashes in zip(texts, got):
        want = plain(t)
        assert len(hashes) == len(want) and list(hashes) == sorted(hashes) and known.setdefault(want, hashes) == hashes
        assert t is None or tuple(near_dedup.shingles(t).tolist()) == hashes
    assert len(set(known.values())) == len(known)


def test_bins_bound_what_two_sets_share():
    rng = np.random.default_rng(2)
    pool = np.sort(rng.integers(-(2**63), 2**63 - 1, 3000))
    sets = [np.sort(rng.choice(pool, n, replace=False)) for n in (0, 1, 50, 900, 2000)] + [pool]
    a, b = zip(*((x, y) for x in sets for y in sets))
    most = near_dedup.may_share([near_dedup.bins(x) for x in a], [near_dedup.bins(y) for y in b])
    assert all(m >= len(np.intersect1d(x, y)) and (m == len(x) or x is not y) for m, x, y in zip(most, a, b))
    apart = [np.sort(rng.integers(-(2**63), 2**63 - 1, 300)) for _ in range(2)]
    assert near_dedup.may_share(*([near_dedup.bins(x)] for x in apart))[0] < 250
    assert near_dedup.may_share([b""], [near_dedup.bins(pool)])[0] > 3000


def test_links_refuse_budgets_that_the_blocks_do_not_cover(spark):
    with pytest.raises(ValueError):
        hamming_links(spark.createDataFrame([], "fp long, node long"), 3)


def test_fingerprints_of_sets():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 254, 255, 256, 40000):
        s = np.sort(rng.integers(-(2**63), 2**63, n, dtype=np.int64))
        ones = [sum(int(x) >> b & 1 for x in s) for b in range(64)]
        assert near_dedup.fingerprint(s) % 2**64 == sum(1 << b for b in range(64) if 2 * ones[b] > n)


def test_near_copies_are_linked_by_their_fingerprints(spark, monkeypatch):
    rng = random.Random(8)
    docs = []
    for _ in range(12):
        words = [rng.choice("abcdefghij") + str(rng.randrange(900)) for _ in range(1500)]
        docs += [words, [*words[:-1], "end"], ["start", *words[1:]]]
    sets = [near_dedup.shingles(" ".join(w)) for w in docs]
    codes = [near_dedup.fingerprint(s) for s in sets] + [5, 5, 5]
    root = brute_components(codes, lambda a, b: ((a ^ b) % 2**64).bit_count() <= near_dedup.FINGERPRINT_BITS)
    pairs = [(r.u, r.v) for r in near_dedup.fingerprint_pairs(spark.createDataFrame(list(enumerate(codes)), "node long, fp long")).collect()]
    linked = {frozenset(p) for p in pairs}
    assert all(u < v for u, v in pairs) and brute_components(range(len(codes)), lambda a, b: frozenset((a, b)) in linked) == root and len(pairs) > 12

    found, similar = {}, near_dedup._similar
    monkeypatch.setattr(near_dedup, "_similar", lambda *of: found.setdefault(of[-1], similar(*of)))
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, r.component_id) for r in near_dedup.near_copies(frame).collect()) == [(i, i // 3 * 3) for i in range(36)]
    by_fingerprint = {frozenset((r.u, r.v)) for r in found["fingerprint-links"].collect()}
    assert by_fingerprint == {p for p in linked if max(p) < 36} and list(found) == ["fingerprint-links", "first-links", "more-links"]
    assert not by_fingerprint & {frozenset((r.u, r.v)) for r in found["first-links"].collect()}


def test_near_copies_move_and_leave_little(spark, monkeypatch):
    from codegrove.session import shared_dir

    rng = random.Random(11)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(300)] for _ in range(30)]
    words[7] = [*words[3][:-1], "end"]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string").repartition(3)
    plans, write = {}, near_dedup.materialize
    monkeypatch.setattr(near_dedup, "materialize", lambda df, label, **o: (plans.setdefault(label, []).append(df._jdf.queryExecution().toString()), write(df, label, **o))[1])
    here, limit = shared_dir(spark).removeprefix("file:"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    before = set(os.listdir(here))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: r.component_id for r in near_dedup.near_copies(frame).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {i: 3 if i == 7 else i for i in range(30)}
    # texts meet a small table of the wanted ones, and are not dealt out by themselves
    assert plans["compared"] and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans["compared"])
    left = {f.split("-", 1)[1].rsplit("-", 1)[0] for f in set(os.listdir(here)) - before if f.startswith("codegrove-")}
    assert not left & {"shingles", "sets", "nodes", "met", "compared"}


def test_line_dedup_leaves_its_lines_nowhere(spark):
    from codegrove.llm.line_dedup import dedup_lines
    from codegrove.session import shared_dir

    here = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(here))
    rows = dedup_lines(spark.createDataFrame([(1, "a b c d e f\nx"), (2, "a b c d e f\ny")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(1, "a b c d e f\nx"), (2, "y")]
    assert not [f for f in set(os.listdir(here)) - before if f.startswith("codegrove-lines-")]
