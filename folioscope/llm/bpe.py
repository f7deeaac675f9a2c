"""Byte-level BPE encoding by a dynamic programme over prefixes, and decoding.

For every prefix of a pre-token there is exactly one token that can end its encoding. It is found among the tokens that
match there (an automaton over all tokens) by one test on neighbours: a token may follow another when no merge across
their border would have fired while both sides of the border were still exposed. Back-pointers then give the exact ids.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: the pattern by which byte-level vocabularies of this family split a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for text below U+0250, with the classes spelled out for the faster standard module.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
SPLIT_LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_L}{_N}{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
NOT_LATIN = re.compile("[^\0-\u024f]")
PAIRS_REMEMBERED = 300_000
#: Pre-tokens remembered by a worker, and the longest (in characters) that is remembered.
REMEMBERED, REMEMBERED_CHARS = 150_000, 40
#: Rows handed back at a time.
ROWS_AT_ONCE = 512
#: Characters of text pre-tokenised at a time between two safe cuts; only memory depends on it.
CHUNK = 1 << 20


def visible_bytes() -> list[str]:
    """The character by which vocabulary files of this family write each byte: printable Latin-1 as itself, others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and the tests derived from them. Ids of merged tokens need not follow the merge order."""

    def __init__(self, file: str):
        model, self.bytes_of, self.special = _spec(file)
        ids = model["vocab"]
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.rank: dict[tuple[int, int], int] = {}
        made_at: dict[int, int] = {}
        parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = (ids[left], ids[right])
            self.rank[pair] = rank
            if (whole := ids[left + right]) not in parts:
                parts[whole], made_at[whole] = pair, rank
        never = len(self.rank)
        # Each token's right border: the token itself and its last parts, with the rank at which each was merged away. Left likewise.
        self.right_border: dict[int, list[tuple[int, int]]] = {}
        self.left_border: dict[int, list[tuple[int, int]]] = {}
        for i in ids.values():
            for border, side in ((self.right_border, 1), (self.left_border, 0)):
                gone, part, border[i] = never, i, []
                while True:
                    border[i].append((part, gone))
                    if part not in parts:
                        break
                    gone, part = made_at[part], parts[part][side]
        self.fits: dict[int, bool] = {}
        sound = [i for i in ids.values() if i not in parts or self._neighbours(*parts[i], until=made_at[i])]
        self._automaton({self.bytes_of[i]: i for i in sound})
        self.split = regex.compile(SPLIT)
        self.split_latin = re.compile(SPLIT_LATIN)

    def _automaton(self, tokens: dict[bytes, int]) -> None:
        """States are the prefixes of tokens; a state's tokens are those that end there, longest first."""
        self.goto: dict[int, int] = {}
        own: list[tuple[int, int] | None] = [None]
        for data, token in tokens.items():
            state = 0
            for byte in data:
                state = self.goto.setdefault(state << 8 | byte, len(own))
                if state == len(own):
                    own.append(None)
            own[state] = (token, len(data))
        self.own, self.shorter, self.found = own, [0] * len(own), [()] * len(own)
        edges = sorted(self.goto.items(), key=lambda e: e[0] >> 8)
        below: dict[int, list[tuple[int, int]]] = {}
        for key, state in edges:
            below.setdefault(key >> 8, []).append((key & 255, state))
        layer = [0]
        while layer:
            after = []
            for state in layer:
                for byte, child in below.get(state, ()):
                    self.shorter[child] = self._step(self.shorter[state], byte) if state else 0
                    self.found[child] = ((own[child],) if own[child] else ()) + self.found[self.shorter[child]]
                    after.append(child)
            layer = after

    def _step(self, state: int, byte: int) -> int:
        while (to := self.goto.get(state << 8 | byte)) is None and state:
            state = self.shorter[state]
        return to or 0

    def _neighbours(self, left: int, right: int, until: int) -> bool:
        """Whether left and right stay apart through all merges of a rank below `until`.

        Equal pairs merge from the left: a part that its own token merges away at the same rank is gone on the left
        side of the border and still there on the right side.
        """
        for a, a_gone in self.right_border[left]:
            for b, b_gone in self.left_border[right]:
                rank = self.rank.get((a, b))
                if rank is not None and rank < until and rank < a_gone and rank <= b_gone:
                    return False
        return True

    def pre_token(self, data: bytes) -> bytes:
        """Packed ids of one pre-token."""
        goto, found, fits = self.goto, self.found, self.fits
        last, start, state, end = [-1], [0], 0, 0
        for byte in data:
            end += 1
            to = goto.get(state << 8 | byte)
            state = self._step(state, byte) if to is None else to
            for token, size in found[state]:
                at = end - size
                if at:
                    pair = last[at] << 32 | token
                    ok = fits.get(pair)
                    if ok is None:
                        ok = self._neighbours(last[at], token, len(self.rank))
                        if len(fits) < PAIRS_REMEMBERED:
                            fits[pair] = ok
                    if not ok:
                        continue
                last.append(token)
                start.append(at)
                break
            else:
                raise ValueError("the vocabulary lacks a byte of this text")
        out = []
        while end:
            out.append(last[end])
            end = start[end]
        return struct.pack(f"<{len(out)}I", *out[::-1])


class Encoder(dict):
    """Packed ids (32-bit little-endian) of pre-tokens; remembers short ones up to a bound."""

    def __init__(self, file: str):
        super().__init__()
        self.vocabulary = Vocabulary(file)

    def __missing__(self, piece: str) -> bytes:
        ids = self.vocabulary.pre_token(piece.encode("utf-8", "replace"))
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as packed 32-bit integers. Strings of special tokens become those tokens."""
        v, out = self.vocabulary, []
        for i, part in enumerate(v.special_split.split(text) if v.special_split else [text]):
            if i % 2:
                out.append(np.array([v.special[part]], "<u4").tobytes())
                continue
            at = 0
            while at < len(part):
                end = at + CHUNK
                # A cut before white space that follows a non-space changes no pre-token.
                while end < len(part) and not (part[end].isspace() and not part[end - 1].isspace()):
                    end += 1
                piece = part[at:end]
                out.extend(map(self.__getitem__, (v.split if NOT_LATIN.search(piece) else v.split_latin).findall(piece)))
                at = end
        return b"".join(out)


def _spec(file: str) -> tuple[dict, dict[int, bytes], dict[str, int]]:
    """(the file's model, bytes of every id, ids of the special tokens)."""
    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    to_byte = {c: b for b, c in enumerate(visible_bytes())}
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    raw = {i: bytes(to_byte[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
    return spec["model"], raw | {i: t.encode() for t, i in special.items()}, special


@lru_cache(maxsize=2)
def token_bytes(file: str) -> dict[int, bytes]:
    """Bytes of each id: all that decoding needs."""
    return _spec(file)[1]


def text_of(packed: bytes, token: dict[int, bytes]) -> str:
    """Text of packed ids, special tokens included; bytes that form no character become U+FFFD."""
    return b"".join(map(token.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(file: str) -> Encoder:
    """One for each worker process and vocabulary."""
    return Encoder(file)


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds column `ids`: the text's ids as packed little-endian unsigned 32-bit integers (binary, so that long texts stay small).

    Null text counts as empty; an empty text has no ids. Whole texts of any length. All other columns stay; a column
    named like `ids` is replaced. Runs within each partition, no shuffle. `vocabulary`: path of the file on every executor.
    """
    return _add(df, text, {ids: (T.BinaryType(), pa.binary())}, lambda s, file=vocabulary: (encoder(file).encode(s or ""),))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds column `text` decoded from packed `ids`; null counts as no ids. All other columns stay."""
    return _add(df, ids, {text: (T.StringType(), pa.string())}, lambda b, file=vocabulary: (text_of(b or b"", token_bytes(file)),))


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds packed `ids` of `text`, as encode does, and `decoded`, what decode makes of them, in one pass. Columns in `drop` go."""

    def both(s, file=vocabulary):
        e = encoder(file)
        packed = e.encode(s or "")
        return packed, text_of(packed, e.vocabulary.bytes_of)

    return _add(df, text, {ids: (T.BinaryType(), pa.binary()), decoded: (T.StringType(), pa.string())}, both, drop)


def _add(df: DataFrame, source: str, targets: dict[str, tuple[T.DataType, pa.DataType]], f, drop: tuple[str, ...] = ()) -> DataFrame:
    kept = [c for c in df.columns if c not in targets and c not in drop]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(name, kind) for name, (kind, _) in targets.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                made = [f(x.as_py()) for x in batch.column(batch.schema.get_field_index(source))]
                columns = [pa.array([m[i] for m in made], arrow) for i, (_, arrow) in enumerate(targets.values())]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + columns, names=[*kept, *targets])

    return df.mapInArrow(run, schema)
