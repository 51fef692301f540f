"""Line dedup, licences, decontamination, audio, classifiers and the pipeline against plain versions."""

import random

import numpy as np
import pytest

import corpus_pipeline
from codegrove.llm import audio, decontaminate, license_rules, licenses, line_dedup, pu, quality, toxicity

SCHEMA = "doc_id long, text string, n int, rk string"


def brute_lines(docs, threshold=0.8):
    """Removed line numbers per doc_id."""
    lines = sorted((d, i, frozenset(x.lower().split())) for d, t in docs if d is not None and t is not None for i, x in enumerate(t.encode().split(b"\n")))
    gone = {}
    for k, (d, i, s) in enumerate(lines):
        if s and any(u and len(s & u) >= threshold * len(s | u) - 1e-9 for _, _, u in lines[:k]):
            gone.setdefault(d, set()).add(i)
    return gone


@pytest.mark.parametrize("threshold, group", [(0.8, 4096), (0.5, 4096), (0.8, 0), (0.5, 20)])
def test_line_dedup_matches_brute_force(spark, threshold, group):
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(60)]
    base = [[rng.choice(pool) for _ in range(rng.randint(1, 14))] for _ in range(25)]
    docs = []
    for d in range(70):
        out = []
        for _ in range(rng.randint(0, 6)):
            words = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(pool)
            out.append(" ".join(words).title() if rng.random() < 0.3 else "\t".join(words))
        docs.append((d * 2, "\n".join(out)))
    docs += [(900, None), (901, ""), (902, "\n\n \n"), (903, "É b c\né b c"), (None, docs[5][1])]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], SCHEMA).repartition(4)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame, threshold, group).collect()}
    gone = brute_lines(docs, threshold)
    assert len(got) == len(docs) and sum(map(len, gone.values())) > 30
    for d, t in docs:
        want = t if d not in gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])
        assert (got[d].text, got[d].n_removed, got[d].rk) == (want, len(gone.get(d, ())), "x"), d


def test_line_dedup_of_repeated_rows_and_long_texts(spark):
    long = "\n".join(f"only {i} here {i * 7} and {i * 13} there" for i in range(4000))
    rows = [(1, "a b c\nd", 1, ""), (1, "a b c\nd", 1, ""), (2, "x y z\na b c", 1, ""), (3, long, 1, ""), (4, long, 1, "")]
    got = sorted((r.doc_id, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 2, 0), (1, 2, 0), (2, 2, 1), (3, 4000, 0), (4, 4000, 4000)]
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("size", [8, 100, 1 << 20])
def test_slices_are_whole_lines_in_order(size):
    import pyarrow as pa

    texts = ["", "a\nbb\n\nccc", None, "x" * 50 + "\ny", "\n" * 9, "one", "z " * 300, "\n".join(f"line {i}" for i in range(60))]
    seen = []
    for data, offsets, doc, line in line_dedup._slices(pa.array(["skipped", *texts]).slice(1), size):
        assert len(data) <= max(size, 601) and offsets[0] == 0 and offsets[-1] == len(data)
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
            own = data[a:b].tobytes().split(b"\n")
            seen += [(doc + i, k + (line if i == 0 else 0), x) for k, x in enumerate(own) if x]
    assert seen == [(d, k, x) for d, t in enumerate(texts) for k, x in enumerate((t or "").encode().split(b"\n")) if x]


def test_very_long_texts_are_read_in_bounded_parts():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array(["".join(f"w{i % 997} {i} x\n" for i in range(d, d + 20_000)) for d in range(64)])
    levels = np.zeros(1 << 10, np.uint16)
    tracemalloc.start()
    rows = sum(len(line_dedup._lines(data, offsets, line, levels, 0.8, 1)[1]) for data, offsets, _, line in line_dedup._slices(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 64 * 20_000 and peak < 128 << 20


def test_licences(spark):
    texts = [
        (1, "Intro.\nLicensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n  http://x"),
        (2, "Licensed under the Apache License, Version 2.0. All rights reserved!"),
        (3, "Licensed under the Apache License, Version 2.0 (the \"License\");\nOther words.\nyou may not use this file except in compliance with the License."),
        (4, None), (5, ""), (6, " \n.\n"), (None, "Released under the MIT License."), (7, "Released under the MIT License.\n" * 3), (7, "Released under the MIT License.\n" * 3),
        (8, "word " * 100000 + ".\nReleased under the MIT License"),
    ]
    frame = spark.createDataFrame([(d, t, 0, "") for d, t in texts], SCHEMA).withColumnRenamed("n", "rule")
    got = sorted((r.doc_id or 0, r.rule, r.first_sentence, r.n_sentences) for r in licenses.scan_licenses(frame).collect())
    assert got == [(0, "mit-line", 0, 1), (1, "apache-2.0-header", 1, 3), (2, "apache-2.0-line", 0, 1), (2, "rights-reserved", 1, 1), (7, "mit-line", 0, 1), (7, "mit-line", 1, 1), (7, "mit-line", 2, 1), (8, "mit-line", 1, 1)]
    assert licenses.scan_licenses(frame.limit(0)).collect() == []


def licence_texts():
    """Whole notices, wrapped, commented, numbered and broken: (doc_id, text, rules in it)."""
    import textwrap

    r = {name: parts for name, (_, parts) in license_rules.RULES.items()}
    mit, notice = (f"{x}{end}" for x, end in zip(r["mit-text"], ":."))
    gnu = lambda rule, first=":": f"{r[rule][0]}{first} {r[rule][1]}{'; ' + r[rule][2] if len(r[rule]) > 2 else ''}."
    bsd = [r["bsd-3-clause"][0] + ":"] + [f"{{}} {x}." for x in r["bsd-3-clause"][1:]]
    wrap = lambda paragraphs, between="\n\n", width=60, **how: between.join(textwrap.fill(p, width, **how) for p in paragraphs)
    numbered = lambda marks: [bsd[0], *(b.format(m) for b, m in zip(bsd[1:], marks))]
    mit_rules, both = {"mit-text"}, {"bsd-2-clause", "bsd-3-clause"}
    warranty = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.'
    title = "MIT License\n\nCopyright (c) 2020 Some One\n\n"
    apache = 'Copyright 2020 Some One\n\nLicensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law'
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."
    out = [
        (title + wrap([mit, notice, warranty]), mit_rules), (title + "\n\n".join([mit, notice, warranty]), mit_rules), (wrap([mit, notice], "\n *\n", initial_indent=" * ", subsequent_indent=" * ").replace("\n", "\r\n"), mit_rules),
        (wrap([mit, notice], "\n#\n", 78, initial_indent="# ", subsequent_indent="# "), mit_rules), (wrap([mit, "Other words.", notice]), set()), ("\n".join([mit, notice]), mit_rules), (" ".join([mit, notice]), mit_rules),
        (apache, {"apache-2.0-header"}), ("\n".join(" * " + x for x in apache.split("\n")), {"apache-2.0-header"}), ("\n".join("// " + x for x in mpl.split("\n")), {"mpl-2.0-header"}),
        ("/* SPDX-License-Identifier: GPL-2.0-or-later */\nint x;", {"spdx-gpl-2.0-or-later"}), ("# SPDX-License-Identifier: MIT\nimport x", {"spdx-mit"}), ("The text says licensed under CC BY 4.0 here", set()), ("Copyright X. All rights\nreserved.", {"rights-reserved"}),
    ]
    for marks in (["1.", "2.", "3."], ["(a)", "(b)", "(c)"], "***", ["i.", "ii.", "iii."]):
        out += [(wrap(numbered(marks)), both), ("\n".join(numbered(marks)), both)]
    out.append((wrap(numbered("***")[:3]), {"bsd-2-clause"}))
    for rule in r:
        if rule.startswith(("gpl-3.0-header", "gpl-2.0-header", "agpl", "lgpl")):
            out += [(wrap(["Intro", gnu(rule, end), "This program is distributed in the hope that it will be useful"], initial_indent="; ", subsequent_indent="; ", between="\n;\n"), {rule}) for end in ":;"]
    for rule in ("isc-text", "zlib-text", "unlicense-text", "wtfpl-text", "cc0-1.0-text", "cc-by-4.0-text", "cc-by-sa-4.0-text", "epl-2.0-header", "bsl-1.0-line"):
        out.append((wrap([". ".join(r[rule]) + "."], width=70) + "\n\nmore", {rule}))
    return [(i, t, rules) for i, (t, rules) in enumerate(out)]


def test_wrapped_and_numbered_licences(spark):
    texts = licence_texts()
    got = {}
    for r in licenses.scan_licenses(spark.createDataFrame([(d, t, 0, "") for d, t, _ in texts], SCHEMA)).collect():
        got.setdefault(r.doc_id, set()).add(r.rule)
    assert [(d, got.get(d, set())) for d, *_ in texts] == [(d, want) for d, _, want in texts]


def test_licence_sql_states_the_rules(spark):
    import duckdb
    import pandas as pd

    frame = pd.DataFrame([(d, t) for d, t, _ in licence_texts()], columns=["doc_id", "text"])
    with duckdb.connect() as db:
        db.register("documents", frame)
        rows = db.sql(licenses.oracle_sql()).fetchall()
    assert {(d, rule) for d, rule, *_ in rows} == {(d, rule) for d, _, rules in licence_texts() for rule in rules}


def test_decontamination_matches_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 5, 9, 30, 60])))) for i in range(30)] + [(40, None), (41, ""), (None, "a b c d e f"), (42, "a a a a a a a a")]
    docs = []
    for d in range(60):
        words = [rng.choice(pool) for _ in range(rng.randint(0, 400))]
        for _ in range(rng.randint(0, 2)):
            w = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randint(0, 2)):
                if w:
                    w[rng.choice([0, -1, rng.randrange(len(w))])] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = w
        docs.append((d, " \n".join(words).upper()))
    docs += [(70, None), (71, ""), (None, items[0][1]), (72, "b " * 50000 + "a " * 9)]

    def shingles(text, n):
        w = (text or "").lower().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = set()
    for i, t in items:
        n = min(5, len((t or "").split()))
        s = shingles(t, n) if n else set()
        for d, text in docs:
            if s and i is not None and d is not None and len(s & shingles(text, n)) / len(s) >= 0.8 - 1e-9:
                want.add((d, i, len(s & shingles(text, n)), len(s)))
    frame = spark.createDataFrame([(d, t, 0, "") for d, t in docs], SCHEMA).withColumnRenamed("n", "item_id")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for rows in (200_000, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
        assert {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in decontaminate.find_contamination(frame, bench).collect()} == want
    assert decontaminate.find_contamination(frame, bench.limit(0)).collect() == decontaminate.find_contamination(frame.limit(0), bench).collect() == []
    kept = {r.doc_id for r in decontaminate.drop_contaminated(frame, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, *_ in want}


def test_sketches_of_size_partitions(spark):
    import math

    rows = [(n, 5, [i * 3 for i in range(n)]) for n in (1, 2, 3, 5, 7, 8, 20, 31, 32, 500)]
    got = {r.item_id: r for r in decontaminate.sketches(spark.createDataFrame(rows, "item_id long, width int, h array<long>")).collect()}
    for n, _, h in rows:
        r, miss = got[n], n - math.ceil(0.8 * n - 1e-9)
        largest = 2 ** (r.partition + 1) - 1
        most = largest - math.ceil(0.8 * largest - 1e-9)
        assert 2**r.partition <= n <= largest and r.sketch == h[: most + 1 + most // 2] and r.least_hits == len(r.sketch) - miss >= 1


def brute_alignment(query, match):
    """The least bit error over all starts inside a hop and all offsets that overlap at MIN_OVERLAP places, and that offset in samples."""
    m, best = audio.fingerprint(match), (1.0, None)
    for phase in range(audio.PHASES):
        q = audio.fingerprint(query[phase * audio.HOP // audio.PHASES :])
        for shift in range(audio.MIN_OVERLAP - len(m), len(q) - audio.MIN_OVERLAP + 1):
            a, b = q[max(shift, 0) :], m[max(-shift, 0) :]
            a, b = a[: len(b)], b[: len(a)]
            if len(a) >= audio.MIN_OVERLAP:
                best = min(best, (np.bitwise_count(a ^ b).sum() / (32 * len(a)), shift * audio.HOP + phase * audio.HOP // audio.PHASES))
    return best


def test_audio_alignment_against_brute_force(spark):
    rng = np.random.default_rng(5)
    notes = {i: rng.normal(0, 0.2, 64) for i in range(0, 40)}
    notes[101] = np.r_[rng.normal(0, 0.2, 9), notes[0][:40]]  # query 0 again, nine notes later
    notes[102] = notes[10][5:] + rng.normal(0, 0.001, 59)
    notes[103], notes[104] = notes[0], notes[20]
    rows = [(i, audio.render(v), 1) for i, v in notes.items()]
    for i in range(0, 40, 10):  # cuts at any sample, with more and more noise
        for k, noise in enumerate((0, 0.1, 0.3, 0.6, 1.0)):
            x = np.frombuffer(audio.render(notes[i]), "<i2")[int(rng.integers(100, 4000)) :][: int(rng.integers(9000, 13000))]
            rows.append((1001 + 10 * i + k, (x + rng.normal(0, noise * x.std(), len(x))).clip(-32768, 32767).astype("<i2").tobytes(), 1))
    rows += [(200, None, 1), (201, b"", 1), (None, b"", 1), (202, b"\0" * 999, 1), (103, audio.render(notes[0]), 1), (300, b"\0\0" * 40000, 1), (350, b"\0\0" * 90000, 1)]
    frame = spark.createDataFrame(rows, "rec_id long, audio binary, fp int")
    members, matches = audio.align(frame, every=10)
    of = {r.rec_id: r.class_id for r in members.collect()}
    assert of[103] == 0 and of[104] == 20 and of[200] == of[201] == of[202] == 200
    got = {(r.query_class, r.match_class): r for r in matches.collect()}
    assert got[0, 101].offset == -9 * audio.HOP and got[10, 102].offset == 5 * audio.HOP and got[0, 101].bit_error < 0.1 and got[300, 350].bit_error == 0
    sounds = {i: np.frombuffer(a or b"", "<i2") for i, a, _ in rows if i in set(of.values()) and len(a or b"") % 2 == 0}
    want = {}
    for q in (i for i in sounds if any(of[m] == i and m % 10 == 0 for m in of) and i < 300):
        for m in sounds:
            if m != q and m < 300 or m > 1000:
                error, offset = brute_alignment(sounds[q], sounds[m])
                if error <= audio.MAX_BIT_ERROR:
                    want[q, m] = offset
    found = {k for k in got if max(k) < 300 or k[1] > 1000}
    assert found <= set(want) and len(want) > 15 and len(found) >= 0.9 * len(want), (len(found), len(want))
    assert sum(abs(got[k].offset - want[k]) <= audio.HOP // audio.PHASES for k in found) >= 0.9 * len(found)
    assert all(df.collect() == [] for df in audio.align(frame.limit(0)))


def test_runs_of_equal_neighbours(spark):
    frame = spark.createDataFrame([([],), ([7],), ([1, 1, 2, 2, 2, 1],)], "c array<int>")
    assert [[tuple(x) for x in r.r] for r in frame.select(audio.runs("c").alias("r")).collect()] == [[], [(7, 0, 1)], [(1, 0, 2), (2, 2, 3), (1, 5, 1)]]


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize("score, label, least", [(toxicity.score_toxicity, "toxic", 0.9), (quality.score_quality, "quality", 0.95)])
def test_classifiers_on_held_out_rows(spark, score, label, least):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = score(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").toPandas()
    assert auc(rows.score.to_numpy(), rows[label].to_numpy()) > least


def test_classifier_edge_cases(spark):
    docs = spark.createDataFrame([(i, "good text here" if i % 2 else "bad $$$ text", i, "") for i in range(40)] + [(None, "x", 0, ""), (50, None, 0, ""), (51, "", 0, ""), (52, "w " * 200000, 0, ""), (3, "again", 0, "")], SCHEMA)
    docs = docs.withColumnRenamed("rk", "score")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == 45 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.score == 0 for r in toxicity.score_toxicity(docs, labels.limit(0)).collect())
    assert toxicity.score_toxicity(docs.limit(0), labels).collect() == []
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < 45


def test_most_frequent_word_counts_wherever_it_stands():
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(80)]
    for at in range(10):
        held = list(words)
        for k in range(8):
            held[10 * k + at] = "often"
        assert pu.statistics(" ".join(held))[0][20] == np.float32(0.1)


def test_non_negative_risk_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    x = np.column_stack([rng.normal(2 * y, 1), rng.normal(0, 1, 4000)])
    w, b = pu.minimise(x[y][:400], x, 0.3)
    assert auc(x @ w + b, y) > 0.9


def test_risk_and_gradient_against_plain_versions():
    rng = np.random.default_rng(3)
    p, u, w, prior = rng.normal(1, 1, (30, 4)), rng.normal(0, 1, (50, 4)), rng.normal(0, 1, 5), 0.35
    loss = lambda x, sign: np.mean([np.log(1 + np.exp(-sign * (row @ w[:-1] + w[-1]))) for row in x])
    on_positives, on_negatives, up, down = pu.risk(w, p, u, prior)
    assert np.isclose(on_positives, prior * loss(p, 1)) and np.isclose(on_negatives, loss(u, -1) - prior * loss(p, -1))
    for k in range(5):
        step = np.zeros(5)
        step[k] = 1e-6
        high, low = pu.risk(w + step, p, u, prior), pu.risk(w - step, p, u, prior)
        assert np.isclose((high[0] - low[0]) / 2e-6, up[k], atol=1e-6) and np.isclose((high[1] - low[1]) / 2e-6, down[k], atol=1e-6)


def test_minimise_reaches_what_plain_descent_reaches():
    rng = np.random.default_rng(4)
    y = rng.random(600) < 0.4
    x = np.column_stack([rng.normal(2 * y, 1), rng.normal(0, 1, 600)])
    w, b = pu.minimise(x[y][:120], x, 0.4, rounds=800, decay=0.0)
    plain = np.zeros(3)
    for _ in range(20_000):
        _, negative, up, down = pu.risk(plain, x[y][:120], x, 0.4)
        plain -= 0.1 * (up + down if negative >= 0 else -down)
    total = lambda v: sum(np.maximum(pu.risk(v, x[y][:120], x, 0.4)[:2], 0))
    assert total(np.r_[w, b]) < total(plain) + 1e-3


@pytest.mark.parametrize("prior", [0.1, 0.5, 0.9])
def test_prior_is_found_from_positives_and_unlabelled(prior):
    rng = np.random.default_rng(6)
    y = rng.random(6000) < prior
    x = np.column_stack([rng.normal(2.5 * y, 1), rng.normal(0, 1, 6000)])
    positive = np.column_stack([rng.normal(2.5, 1, 800), rng.normal(0, 1, 800)])
    assert abs(pu.estimate_prior(positive, x) - prior) < 0.07


def test_drop_toxic_keeps_columns_of_any_name_and_type(spark):
    import datetime

    docs = spark.createDataFrame([(i, "good text here" if i % 2 else "bad $$$ text", i, f"s{i}", datetime.timedelta(days=i)) for i in range(40)], "doc_id long, text string, n int, Score string, gap interval day to second").selectExpr("*", "make_interval(0, n) AS months", "map(n, Score) AS m")
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i in range(40) if i % 2}


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= rows
        rows = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    assert len(packed) == corpus_pipeline.run(spark, sf).count()


def test_likeliest_partners_of_an_entry_are_taken(spark):
    rows = [(d, 0, d, 10, 0 if d in (11, 100) else 3 << d, 0, 0, 0, [7 << 40]) for d in [*range(12), 100]]  # 11 agrees with 100 in all bits, the others but for two
    firsts = spark.createDataFrame(rows, "doc_id long, line int, tag long, n int, b1 long, b2 long, lone int, hot int, prefix array<bigint>")
    got = [r for r in line_dedup._meet(firsts, 0.8).collect() if r.doc_id == 100]
    assert 11 in {r.a_doc_id for r in got} and len(got) == line_dedup.PARTNERS and all(r.more for r in got)


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_meeting_step_by_step_loses_no_link(spark, monkeypatch, threshold):
    monkeypatch.setattr(line_dedup, "MEETINGS", 1)
    monkeypatch.setattr(line_dedup, "PARTNERS", 2)
    rng = random.Random(3)
    docs = []
    for d in range(90):  # variants of two long lines, of many sizes
        words = [f"t{d % 2}w{i}" for i in range(30)]
        docs.append((d, " ".join(rng.sample(words, rng.randint(20, 30)) + [f"x{rng.randrange(12)}" for _ in range(rng.randint(0, 6))])))
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame([(d, t, 1, "x") for d, t in docs], SCHEMA).repartition(3), threshold).collect()}
    gone = brute_lines(docs, threshold)
    assert got == {d: len(gone.get(d, ())) for d, _ in docs} and 20 < len(gone) < 90


def test_word_sets_of_repeated_rows_come_once_and_unsorted(spark):
    docs = spark.createDataFrame([(i % 5, 10 * (i % 5), f"one {i % 5}\ntwo b") for i in range(40)], "doc_id long, rk long, text string")
    needed = spark.createDataFrame([(i, 1, 10 * i, 10 * i) for i in range(5)], "doc_id long, line int, tag long, rk long")
    found = line_dedup._word_sets(docs, needed)
    assert sorted((r.doc_id, r.line, r.tag, len(r.words)) for r in found.collect()) == [(i, 1, 10 * i, 2) for i in range(5)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("MapInArrow")


def test_pipeline_keeps_columns_of_any_name(spark):
    rows = [(i, f"one two three\nline {i} of {i * 7}", "en", 5, 99, "x", "y") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, n_removed long, N_Lines string, __key string")
    out = corpus_pipeline.STAGES[1][1](spark, docs, "")
    assert out.columns == docs.columns and {(r.n_removed, r.N_Lines) for r in out.collect()} == {(99, "x")}
    assert sorted(r.n_chars for r in out.collect()) == [5] + [len(f"line {i} of {i * 7}") for i in range(1, 6)]


def test_words_are_told_apart_like_split():
    import pyarrow as pa

    texts = ["", "Ab aB", "x" * 40 + " " + "X" * 40, None, " \t ", "\n\nq\n", "é É", "ab", "a\0 a a\0\0", "tail", "tail", "w " * 200_000]
    expected = [w for t in texts for w in (t or "").encode().lower().split()]
    start, h = line_dedup._words(*line_dedup._bytes(pa.array(texts)))
    assert len(start) == len(expected)
    assert {(w, int(x)) for w, x in zip(expected, h)} == {(w, int(dict(zip(expected, h))[w])) for w in set(expected)}
    assert len(set(h.tolist())) == len(set(expected))


def test_words_of_one_entry_are_set_aside():
    rng = np.random.default_rng(5)
    for word in (np.zeros(0, np.int64), np.array([3]), np.array([3, 3]), rng.integers(-40, 40, 60), np.full(9, -1)):
        assert sorted(line_dedup._shared(word).tolist()) == [i for i, w in enumerate(word) if (word == w).sum() > 1]


def test_texts_without_wanted_lines_stay_where_they_are(spark, monkeypatch):
    docs = spark.createDataFrame([(i, 10 * i, f"first line {i}\nand b{i} and A{i} more") for i in range(40)], "doc_id long, rk long, text string")
    needed = spark.createDataFrame([(i, line, 7, 10 * i) for i, line in ((3, 0), (3, 1), (20, 1))], "doc_id long, line int, tag int, rk long")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for keys in (line_dedup.BROADCAST_KEYS, 1):  # too many keys: all texts are dealt out
            monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", keys)
            found = line_dedup._word_sets(docs, needed, few=True)
            assert ("BroadcastHashJoin [rk" in found._jdf.queryExecution().toString()) == (keys > 1)
            want = {(r.doc_id, r.line): sorted(r.words) for r in line_dedup._word_sets(docs, needed).collect()}
            assert {(r.doc_id, r.line): sorted(r.words) for r in found.collect()} == want and {k: len(v) for k, v in want.items()} == {(3, 0): 3, (3, 1): 4, (20, 1): 4}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
