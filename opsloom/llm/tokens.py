"""Token ids of whole texts by a public byte-level BPE tokenizer, with offsets, and back.

The tokenizers library encodes over Arrow batches. A byte-level BPE cuts a text into pieces by its pre-tokenizer and
merges within each piece, so the ids of a piece never depend on its neighbours. A space before a character that is
visible beyond doubt always begins a piece: each text is cut there, the library's own pre-tokenizer cuts every distinct
segment further, and every distinct piece is given to the library once per worker and then looked up. The ids are those
of encoding the text whole, which the tests compare. Tokenizers of another build than this are refused.

Defined results: null and empty texts get an empty list. Strings of special tokens inside a text are ordinary text.
Lone surrogates can't occur in Arrow strings. Repeated rows and extra columns pass through; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the public tokenizers' vocabulary files; they are read where they are.
TOKENIZER_DIR = "/opt/tokenizers"
#: Segments that a worker keeps; beyond that it starts anew, which changes no id.
KEPT_SEGMENTS = 200_000

# At a space before a character that no version of Unicode takes for a blank. More spaces begin a piece, but needn't.
_CUT = re.compile(r" (?=[!-~À-ÿĀ-ɏͰ-ϿЀ-ӿ぀-ヿ㐀-鿿가-힣])")


@lru_cache(4)
def tokenizer(name: str, folder: str = TOKENIZER_DIR):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(os.path.join(folder, f"{name}.json"))
    loaded.encode_special_tokens = True
    return loaded


@lru_cache(1)
def byte_of_char() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, turned round.

    Visible Latin-1 characters stand for themselves, the other bytes for the characters from 256 on, in order.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(4)
def token_bytes(name: str, folder: str = TOKENIZER_DIR) -> list[bytes]:
    """The bytes of each token id."""
    table = byte_of_char()
    vocab = tokenizer(name, folder).get_vocab()
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    return out


def checked(loaded) -> None:
    """Refuses a tokenizer whose ids of a text aren't those of its pieces one after the other."""
    parts = json.loads(loaded.to_str())
    cut, model = parts["pre_tokenizer"] or {}, parts["model"]
    plain = parts["normalizer"] is None and parts["truncation"] is None and model["type"] == "BPE" and not model.get("dropout")
    if not (plain and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")):
        raise ValueError("only byte-level BPE without normaliser, truncation, dropout and prefix space can be encoded by pieces")


class Encoder:
    """Ids of texts, each distinct piece encoded once."""

    def __init__(self, name: str, folder: str) -> None:
        self.tokenizer = tokenizer(name, folder)
        checked(self.tokenizer)
        self.cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        #: Ids of segments that begin a text, of those behind a space (kept without it), and of pieces.
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def learn(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment."""
        if len(self.pieces) > KEPT_SEGMENTS:
            self.pieces = {}
        pieces = self.pieces
        cut = [[s[a:b] for _, (a, b) in self.cut(s)] for s in segments]
        new = list(dict.fromkeys(p for c in cut for p in c if p not in pieces))
        for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            pieces[p] = np.array(e.ids, np.int32).tobytes()
        return [b"".join([pieces[p] for p in c]) for c in cut]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's ids end."""
        if len(self.first) + len(self.later) > KEPT_SEGMENTS:
            self.first, self.later = {}, {}
        first, later = self.first, self.later
        cut = [_CUT.split(t) if t else [] for t in texts]
        fresh = list({p[0]: None for p in cut if p and p[0] not in first})
        first.update(zip(fresh, self.learn(fresh)))
        fresh = list({s: None for p in cut for s in p[1:] if s not in later})
        later.update(zip(fresh, self.learn([" " + s for s in fresh])))
        blocks = [b"".join([first[p[0]], *map(later.__getitem__, p[1:])]) if p else b"" for p in cut]
        ends = np.cumsum([0, *map(len, blocks)]) // 4
        return np.frombuffer(b"".join(blocks), np.int32), ends


@lru_cache(4)
def encoder(name: str, folder: str) -> Encoder:
    return Encoder(name, folder)


def ids_of(text: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> Column:
    """The token ids of a text column, without special tokens."""

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = encoder(name, folder)
        for texts in batches:
            ids, ends = run(texts.to_pylist())
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))

    encode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(encode, "array<int>")(text)


def char_spans(text: str, ids: list[int], pieces: list[bytes]) -> list[tuple[int, int]]:
    """The characters that each token covers, from the first to behind the last.

    A token that holds only some bytes of a character covers that character; so do its neighbours with the other bytes.
    """
    firsts = np.fromiter(
        (k for k, c in enumerate(text) for _ in range(len(c.encode()))), np.int64, count=len(text.encode())
    )
    out, at = [], 0
    for i in ids:
        size = len(pieces[i])
        out.append((int(firsts[at]), int(firsts[at + size - 1]) + 1) if size else (at, at))
        at += size
    return out


def with_offsets(df: DataFrame, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """df with ``ids``, ``starts`` and ``ends``: the ids and the characters [start, end) that each covers."""

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run, pieces = encoder(name, folder), token_bytes(name, folder)
        for texts in batches:
            rows = texts.to_pylist()
            ids, ends = run(rows)
            spans = [
                s for t, a, b in zip(rows, ends, ends[1:]) for s in (char_spans(t, ids[a:b].tolist(), pieces) if t else [])
            ]
            cut = pa.array(ends, pa.int32())
            lists = [
                pa.ListArray.from_arrays(cut, pa.array(values, pa.int32()))
                for values in (ids, [s for s, _ in spans], [e for _, e in spans])
            ]
            yield pa.StructArray.from_arrays(lists, names=["ids", "starts", "ends"])

    encode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kind = "struct<ids:array<int>,starts:array<int>,ends:array<int>>"
    kept = [c for c in df.columns if c not in ("ids", "starts", "ends")]
    return df.withColumn("__tokens", F.arrow_udf(encode, kind)(F.col(text))).select(*kept, "__tokens.*")


def text_of(ids: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> Column:
    """The text of token ids. Bytes that form no character, as at the cut end of a list, become U+FFFD."""

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = token_bytes(name, folder)
        for lists in batches:
            yield pa.array(
                [None if x is None else b"".join(pieces[i] for i in x).decode("utf-8", "replace") for x in lists.to_pylist()],
                pa.string(),
            )

    decode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(decode, "string")(ids)
