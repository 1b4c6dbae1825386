"""Pre-tokens of byte-level BPE: texts are cut into units that repeat, and units into pre-tokens."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: White space before a blank: the pre-token then depends on more than its unit.
_RUN = re.compile(r"\s ")
#: The same for Arrow, whose white space is ASCII.
_ARROW_RUN = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
)


@lru_cache(maxsize=1)
def pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def blank_runs(texts: pa.Array) -> np.ndarray:
    """True if units of a text are its pre-tokens, not the stretches from blank to blank."""
    return pc.match_substring_regex(texts, _ARROW_RUN).to_numpy(zero_copy_only=False)


def units(text: str) -> list[str]:
    """Pieces of a text whose pre-tokens, one piece after the other, are those of the text.

    A pre-token never goes on from a visible character to a blank, so a text is cut
    before every blank that follows a visible character. Texts with runs of white
    space that end in a blank are cut into their pre-tokens instead.
    """
    if _RUN.search(text):
        return pattern().findall(text)
    first, *rest = text.split(" ")
    out = [" " + x for x in rest]
    if first:
        out.insert(0, first)
    return out


class UnitCache(dict):
    """Results by unit for one Python worker, of bounded size; long units are not kept."""

    MAX_LENGTH = 64

    def __init__(self, compute, limit: int = 400_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, unit: str):
        value = self.compute(unit)
        if len(unit) <= self.MAX_LENGTH:
            if len(self) >= self.limit:
                self.clear()
            self[unit] = value
        return value
