"""Chat formatting as an exact round trip; packing against its contract."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from codegrove.llm import packing, tokens
from codegrove.llm.chat import MARKERS, digests, escape, format_conversations, loss_mask, masked_texts, read_back, render, unescape
from codegrove.llm.tokens import default_ranks, default_tokenizer, encode, tokenizer

TEXT = st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["<", "|", "\\", "<|", "<\\|", *MARKERS, "assistant", " ", "\n\n", "é", "日本", "🙂", "<|endoftext|>"]), max_size=9).map("".join))


@given(TEXT)
def test_escape_is_reversible(text):
    assert unescape(escape(text)) == text and "<|" not in escape(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "<|im_sep|>"]), TEXT), max_size=5))
def test_render_mask_and_read_back(turns):
    formatted, spans = render(turns)
    assert read_back(formatted) == turns
    offsets = np.array(tokenizer(default_tokenizer(), MARKERS).encode(formatted, add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2)
    mask = loss_mask(offsets[:, 0], offsets[:, 1], spans)
    assert masked_texts(formatted, offsets[:, 0], offsets[:, 1], mask) == [t for r, t in turns if r == "assistant" and t]


def test_conversations_edge_cases(spark, monkeypatch):
    rows = [(1, 1, "assistant", " \n\nhi<|im_end|>", 9), (1, 0, "user", None, 9), (2, 0, "assistant", "", 9), (2, None, None, "x" * 5000, 9), (None, 0, "assistant", "é", 9), (3, 0, "user", "a", 1), (3, 0, "user", "a", 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    got = {r.conv_id: r for r in digests(format_conversations(frame)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\n \n\nhi<|im_end|>\n") and got[1].loss_sha256 == sha(" \n\nhi<|im_end|>") and got[1].loss_chars == 15
    assert got[2].turns_sha256 == sha("\n" + "x" * 5000 + "\nassistant\n\n") and got[2].loss_chars == 0
    assert got[None].loss_sha256 == sha("é") and got[3].n_turns == 2 and len(got) == 4
    assert digests(format_conversations(spark.createDataFrame([], frame.schema))).collect() == []


def test_long_conversations_are_written_in_parts(spark):
    rows = [(7, i, ("user", "assistant")[i % 2], "lorem ipsum " * 20000) for i in range(14)]
    out = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert out.count() > 1
    r = digests(out).collect()
    assert len(r) == 1 and r[0].n_turns == 14 and r[0].loss_chars == 7 * 12 * 20000


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_both_libraries_give_equal_ids(text):
    assert encode(text, default_tokenizer(), default_ranks()) == encode(text, default_tokenizer(), None)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(TEXT, st.lists(st.sampled_from(["a", "bc", " ", "  ", "\n", "\u00a0", "\u2028", "\x1c", "'s", "7", " ab", "é"]), max_size=12).map("".join)), max_size=5))
def test_texts_encoded_together_have_the_ids_of_each(texts):
    got = tokens.encode_all(texts, default_tokenizer(), default_ranks())
    assert [ids.tolist() for ids in got] == [encode(t, default_tokenizer(), None) for t in texts]
    assert [ids.tolist() for ids in tokens.encode_all(texts, default_tokenizer(), None)] == [ids.tolist() for ids in got]


def test_repeated_words_are_encoded_once(monkeypatch):
    sent, whole = [], tokens.encode
    monkeypatch.setattr(tokens, "encode", lambda text, *of: sent.append(len(text)) or whole(text, *of))
    texts = [f"text {k} " + "of the same seldomseenword " * 500 + "." for k in range(40)]
    got = tokens.encode_all(texts, default_tokenizer(), default_ranks())
    assert [ids.tolist() for ids in got] == [whole(t, default_tokenizer(), None) for t in texts]
    assert sum(sent) < sum(map(len, texts)) / 100


def test_groups_use_every_piece_once():
    import random

    rng = random.Random(5)
    for n in (1, 5, 400):
        counts = defaultdict(int)
        for _ in range(n):
            counts[rng.randint(1, 1024)] += rng.randint(1, 3)
        population = [packing.fill(counts, 1024, random.Random(i)) for i in range(4)] + [packing.fill(counts, 1024)]
        for groups in [*population, *packing.evolve(population, counts, 1024, 3, 20), packing.mutate(population[0], counts, 1024, rng)]:
            used = defaultdict(int)
            for lengths, m in groups:
                assert sum(lengths) <= 1024
                for x in lengths:
                    used[x] += m
            assert used == counts


def test_islands_run_where_the_greedy_plan_leaves_room(spark):
    counts = {300: 200, 270: 200, 254: 200, 200: 200}
    greedy, best = packing.fill(counts, 1024), packing.plan(spark, counts)
    assert packing.cost(greedy, 1024)[0] > packing.cost(best, 1024)[0] >= 200
    used = defaultdict(int)
    for lengths, m in best:
        for x in lengths:
            used[x] += m
    assert used == counts


def check_packing(docs, rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array(t.encode(x or "", add_special_tokens=False).ids + [2], dtype="<u4") for d, x in docs}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert by_doc.keys() == ids.keys()
    for d, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        at = 0
        for i, r in enumerate(parts):
            assert (r.piece, r.start) == (i, at) and (i == 0 or r.length == 1024)
            at += r.length
        assert at == len(ids[d]) and (at > 1024 or len(parts) == 1)
    for places in by_seq.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 1024
    return len(by_seq), -(-sum(map(len, ids.values())) // 1024)


def test_packing_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 16)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(-1, None), (-2, ""), (None, "x"), (-3, "<|endoftext|> a"), (-4, "word " * 30000)]
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, length int, rank int").repartition(7)
    n, bound = check_packing(docs, packing.pack(frame).collect())
    assert n <= bound + 1
    assert packing.pack(frame.limit(0)).collect() == []
