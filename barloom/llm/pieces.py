"""Reading a SentencePiece model file: pieces, scores, kinds and normaliser flags.

The file is a protocol buffer; only the few fields that matter are decoded, from
their wire form.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Vocabulary(NamedTuple):
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    dummy_prefix: bool

    def normal(self) -> dict[str, int]:
        return {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}

    def byte_ids(self) -> dict[int, int]:
        return {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + n]
            at += n


@lru_cache(4)
def load(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, kinds, flags = [], [], [], {3: 1, 4: 1, 5: 1}
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append(own[1].decode("utf-8"))
            scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
            kinds.append(own.get(3, NORMAL))
        elif number == 3:
            flags |= dict(_fields(value))
    if flags.get(2) or flags[4] or not flags[5]:
        raise NotImplementedError("only models whose normaliser keeps the text as it is are supported")
    if USER_DEFINED in kinds or len([k for k in kinds if k == BYTE]) != 256:
        raise NotImplementedError("only models with byte fallback and no user-defined pieces are supported")
    return Vocabulary(tuple(pieces), tuple(scores), tuple(kinds), bool(flags[3]))


def splits_at_spaces(pieces: dict[str, int]) -> bool:
    """Whether no piece has a space mark after another character, so that words are independent."""
    return not any(SPACE in p.lstrip(SPACE) for p in pieces)


def marks_apart(pieces: dict[str, int]) -> str:
    """ASCII characters, not letters or digits, that share no piece with any other character.

    Runs of these and runs of others are then independent too; a space mark may stand
    before either.
    """
    marks = {chr(c) for c in range(0x80) if not chr(c).isalnum()}
    mixed = [set(p.lstrip(SPACE)) for p in pieces]
    mixed = [p for p in mixed if p & marks and p - marks]
    while bad := set().union(*(p & marks for p in mixed if p - marks)):
        marks -= bad
        mixed = [p for p in (set(p.lstrip(SPACE)) for p in pieces) if p & marks and p - marks]
    return "".join(sorted(marks))


def independent_runs(pieces: dict[str, int]) -> re.Pattern[str]:
    """Matches the runs of a normalised text that no piece crosses, in order and without gaps."""
    marks = re.escape(marks_apart(pieces))
    if not marks:
        return re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
    return re.compile(f"{SPACE}*[^{SPACE}{marks}]+|{SPACE}*[{marks}]+|{SPACE}+")
