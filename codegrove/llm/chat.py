"""Chat formatting with offset-aligned loss masks.

Whole conversations are rendered, encoded once with offsets, and the sorted spans of the
assistant's texts are intersected with the token spans by binary search. Markers are
special tokens, so no token reaches across the edge of a text. Inside texts and roles
every `<|` is escaped, so no control string of a text can act as a marker.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codegrove.llm.tokens import default_tokenizer, tokenizer as load

START, SEP, END = MARKERS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
#: A conversation is written in parts of whole turns of about so many characters.
PART_CHARS = 1 << 20


def escape(text: str) -> str:
    """One more backslash between `<` and `|`; escaped text never holds `<|`."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted text of (role, text) turns, and the (start, end) spans of the assistant's texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), np.array(spans, dtype=np.int64).reshape(-1, 2)


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """True for each token that overlaps a span; tokens and spans are sorted."""
    edge = np.zeros(len(starts) + 1, dtype=np.int64)
    spans = spans[spans[:, 1] > spans[:, 0]]
    np.add.at(edge, np.searchsorted(ends, spans[:, 0], side="right"), 1)
    np.add.at(edge, np.searchsorted(starts, spans[:, 1], side="left"), -1)
    return np.cumsum(edge[:-1]) > 0


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns in a formatted text."""
    turns = [x.partition(SEP) for x in formatted.split(END)[:-1]]
    return [(unescape(head.removeprefix(START)), unescape(body)) for head, _, body in turns]


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """Unescaped text under each run of masked tokens."""
    turn = np.flatnonzero(np.diff(np.r_[False, mask, False]))
    return [unescape(formatted[starts[a] : ends[b - 1]]) for a, b in zip(turn[::2], turn[1::2])]


def format_conversations(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row for each part of a conversation, the parts of one in order inside one partition.

    Returns conv_id, part, formatted, token_ids, token_starts, token_ends (code points in
    formatted) and loss_mask. Turns are ordered by turn, then role, then text; repeated
    rows are kept. A null text or role counts as empty, a null conv_id is a conversation
    of its own, a null turn comes first. An empty table gives an empty result; other
    columns are not read. Long conversations stream through in parts of whole turns.
    """
    path = tokenizer or default_tokenizer()
    kinds = pa.list_(pa.int32())

    def part(conv, number, turns):
        formatted, spans = render(turns)
        encoding = load(path, MARKERS).encode(formatted, add_special_tokens=False)
        offsets = np.array(encoding.offsets, dtype=np.int32).reshape(-1, 2)
        mask = loss_mask(offsets[:, 0], offsets[:, 1], spans)
        return (conv, number, formatted, encoding.ids, offsets[:, 0], offsets[:, 1], mask)

    def batch(rows):
        types = (pa.int64(), pa.int64(), pa.string(), kinds, kinds, kinds, pa.list_(pa.bool_()))
        names = ("conv_id", "part", "formatted", "token_ids", "token_starts", "token_ends", "loss_mask")
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names))

    def run(batches):
        conv, number, turns, size, out, out_size = None, 0, [], 0, [], 0
        for b in batches:
            for c, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if turns and (c != conv or size > PART_CHARS):
                    out.append(part(conv, number, turns))
                    out_size += size
                    number, turns, size = number + 1, [], 0
                    if out_size > PART_CHARS:
                        yield batch(out)
                        out, out_size = [], 0
                if c != conv:
                    conv, number = c, 0
                turns.append((role or "", text or ""))
                size += len(turns[-1][1]) + 32
        if turns:
            out.append(part(conv, number, turns))
        if out:
            yield batch(out)

    rows = conversations.select(*(F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    lists = "token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"
    return rows.mapInArrow(run, f"conv_id long, part long, formatted string, {lists}")


def digests(formatted: DataFrame) -> DataFrame:
    """Read the output of format_conversations back: one row of digests per conversation."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        def row():
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((conv, n, all_turns.hexdigest(), chars, loss.hexdigest(), size), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=names)

        begun = False
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i] for c in b.schema.names}
                if r["part"].as_py() == 0:
                    if begun:
                        yield row()
                    begun, conv, n, chars, size, all_turns, loss = True, r["conv_id"].as_py(), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                text = r["formatted"].as_py()
                for role, body in read_back(text):
                    n += 1
                    all_turns.update(f"{role}\n{body}\n".encode())
                starts, ends, mask = (np.array(r[c].values.to_numpy(zero_copy_only=False)) for c in ("token_starts", "token_ends", "loss_mask"))
                for body in masked_texts(text, starts, ends, mask.astype(bool)):
                    chars += len(body)
                    loss.update(body.encode())
                size += len(text)
        if begun:
            yield row()

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
