"""Cutting texts where no piece of a model can cross."""

from __future__ import annotations

import re

from logwarden.llm.spmodel import SPACE_MARK, Model

RUN = re.compile(" *[^ ]+| +")


def check_cuts(model: Model) -> None:
    """Texts may be cut before each run of spaces if pieces have space marks in front only."""
    if not (model.dummy_prefix and model.escapes_spaces and not model.trims_spaces and not model.charsmap):
        raise ValueError("only models with a dummy prefix, escaped spaces and the identity normaliser can be cut into pretokens")
    if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in model.pieces):
        raise ValueError("the model has pieces that cross from a word into a space")


def pretokens(text: str) -> list[str]:
    """The pretokens of a text without the first space of each, which the dummy prefix or a space supplies."""
    if not text:
        return []
    text = text.replace(SPACE_MARK, " ")
    words = text.split(" ")
    return words if all(words) else [run[1:] for run in RUN.findall(" " + text)]
