"""Reading SentencePiece model files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from struct import unpack

#: Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

#: The mark that stands for a space.
SPACE_MARK = "▁"


@dataclass(frozen=True)
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model_type: int
    byte_fallback: bool
    normalizer: str
    charsmap: bytes
    dummy_prefix: bool
    trims_spaces: bool
    escapes_spaces: bool

    @property
    def unknown(self) -> int:
        return self.kinds.index(UNKNOWN)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message; nested messages and fixed-width numbers as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


def parse(data: bytes) -> Model:
    """The model in a file's bytes; fields that are not set have the format's defaults."""
    pieces, scores, kinds = [], [], []
    trainer: dict[int, int | bytes] = {}
    rules: dict[int, int | bytes] = {}
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            pieces.append(piece.get(1, b"").decode())
            scores.append(unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            rules = dict(fields(value))
    return Model(pieces, scores, kinds, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), rules.get(1, b"").decode(), rules.get(2, b""),
                 bool(rules.get(3, 1)), bool(rules.get(4, 1)), bool(rules.get(5, 1)))


def load(path: str) -> Model:
    with open(path, "rb") as file:
        return parse(file.read())
