"""Public tokenizers, loaded once per Python process. Their files are parameters; nothing is trained."""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that hold this take the slower library, which knows it as one id.
_SPECIAL = "<|endoftext|>"
#: A space that no word follows: ids may reach over it.
_LOOSE = re.compile(r" (?:\s|$)")


def default_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def default_ranks() -> str:
    """The same vocabulary as ranks, for a faster library with equal ids."""
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=4)
def tokenizer(path: str, markers: tuple[str, ...] = ()):
    """The tokenizer in a file, with markers added as special tokens and offsets that keep leading spaces."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, processors

    t = Tokenizer.from_file(path)
    if markers:
        t.add_special_tokens(list(markers))
        t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


@functools.lru_cache(maxsize=4)
def _ranked(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str, ranks: str | None) -> list[int]:
    """Ids of one text, no special tokens added; ranks: a file with the same vocabulary, or None."""
    if ranks is None or _SPECIAL in text:
        return tokenizer(path).encode(text, add_special_tokens=False).ids
    return _ranked(ranks).encode_ordinary(text)


@functools.lru_cache(maxsize=4)
def _widths(path: str) -> np.ndarray:
    """Number of bytes of each id."""
    with open(path, "rb") as f:
        ranks = {int(b): len(base64.b64decode(a)) for a, b in map(bytes.split, f)}
    return np.array([ranks.get(k, 0) for k in range(max(ranks) + 1)], np.int64)


def encode_all(texts: list[str], path: str, ranks: str | None) -> list[np.ndarray]:
    """The ids of each text, as encode gives them; words that stand several times in texts are encoded once.

    No id reaches over the place before a space and a character that is no white space, so
    what stands between two such places has the same ids everywhere. Other texts are encoded whole.
    """
    out = [None if ranks and _SPECIAL not in t and not _LOOSE.search(t) else np.array(encode(t, path, ranks), "<u4") for t in texts]
    at = [k for k, ids in enumerate(out) if ids is None]
    if not at:
        return out
    split = pc.split_pattern(pa.array([texts[k] for k in at], pa.large_string()), " ")
    words, stops = pc.list_flatten(split), np.cumsum(pc.list_value_length(split).to_numpy())
    later = np.ones(len(words), bool)
    later[np.r_[0, stops[:-1]]] = False  # the first has no space before it
    heads = [encode(t, path, ranks) for t in words.filter(pa.array(~later)).to_pylist()]
    coded = words.filter(pa.array(later)).dictionary_encode()
    code, distinct = coded.indices.to_numpy(), coded.dictionary
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct.cast(pa.string())), " ")[0].as_py()
    ids = np.array(encode(f" {joined}" if len(distinct) else "", path, ranks), "<u4")
    ends, cuts = np.cumsum(_widths(ranks)[ids]), np.cumsum(pc.binary_length(distinct).to_numpy() + 1)
    last = np.searchsorted(ends, cuts)
    if not (ends[last] == cuts).all():
        raise ValueError("an id reaches over the end of a word")
    first = np.r_[0, last[:-1] + 1][: len(last)]
    n = (last + 1 - first)[code]
    to = np.cumsum(n)
    flat = ids[np.repeat((first[code] - (to - n)).astype(np.int32), n) + np.arange(n.sum(), dtype=np.int32)]
    to = np.r_[0, to][stops - np.arange(1, len(at) + 1)]
    for k, head, i, j in zip(at, heads, np.r_[0, to[:-1]], to):
        out[k] = np.concatenate([np.array(head, "<u4"), flat[i:j]])
    return out
