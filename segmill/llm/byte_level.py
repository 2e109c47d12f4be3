"""What byte-level tokenizers share: how text is split, and the characters that stand for bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import regex

#: The byte-level splitting pattern, a fixed value of the tokenizers' format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT = regex.compile(PATTERN)
#: The same for texts of plain Latin characters, where the faster module has the same classes.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xc0-ɏ]*")
PLAIN_SPLIT = re.compile(r" ?[a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-ɏ]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[!-/:-@\[-`{-~\xd7\xf7]+|\s+(?!\S)|\s+")
#: Words of a text that are held at once.
WORDS = 1 << 16

#: The byte-level format writes a byte as a visible character: itself, or one from 256 on.
AS_THEMSELVES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
VISIBLE = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(AS_THEMSELVES)))}


def visible(raw: bytes) -> str:
    """Bytes as the characters that stand for them."""
    return raw.decode("latin-1").translate(VISIBLE)


#: A byte that UTF-8 never has; between words it becomes a line break, which stands for no byte.
BETWEEN = b"\xff"
_SHOWN = np.array([ord("\n") if b == BETWEEN[0] else VISIBLE.get(b, b) for b in range(256)], "<u2")


def visible_lines(words: list[bytes]) -> str:
    """UTF-8 words as visible characters, a line each."""
    return _SHOWN[np.frombuffer(BETWEEN.join(words), np.uint8)].tobytes().decode("utf-16-le")


OTHER, LETTER, DIGIT, SPACE = range(4)


@cache
def kinds(bits: int) -> np.ndarray:
    """The kind of each code point of so many bits, as the splitting pattern has it."""
    every = "".join(map(chr, range(min(1 << bits, 0x110000))))
    found = np.zeros(len(every), np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            found[m.start() : m.end()] = kind
    return found


def word_starts(raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, int]:
    """Where the matches of PATTERN start in UTF-8 bytes, and a place from which on this depends on what may follow the bytes.
    Texts stand one after another; `first` has their starts, ascending and without the first byte's, and empty ones may repeat."""
    chars, lead = raw, None
    if raw.max() >= 0x80:
        chars, lead = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4"), np.flatnonzero((raw & 0xC0) != 0x80)
        first = np.searchsorted(lead, first)
    n, kind = len(chars), kinds(max(8, int(chars.max()).bit_length()))[chars]
    space = kind == SPACE
    # a run of spaces before something else leaves its last one to it, if that is a blank, or as a match of its own
    parting = np.zeros(n, bool)
    parting[1:-1] = space[1:-1] & space[:-2] & ~space[2:]
    parting[first - 1] = False
    new = np.ones(n, bool)
    new[1:] = (kind[1:] != kind[:-1]) & (chars[:-1] != 0x20)
    new |= parting
    new[first] = True
    # 's and the like, where a match starts with the apostrophe
    text_start = np.zeros(n + 2, bool)
    text_start[first] = text_start[n:] = True
    at = np.flatnonzero(new & (chars == 0x27))
    at = at[~text_start[at + 1]]
    one, two = chars[at + 1], chars[np.minimum(at + 2, n - 1)]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    long &= ~text_start[at + 2]
    new[at[short | long] + 1] = False
    ends = np.concatenate([at[short] + 2, at[long] + 3])
    new[ends[ends < n]] = True
    starts, unsure = np.flatnonzero(new), max(0, n - 1)
    return (starts, unsure) if lead is None else (lead[starts], int(lead[unsure]))


def words_of(text: str, pattern: str = PATTERN) -> Iterator[list[str]]:
    """The matches of the pattern in a text, WORDS at a time."""
    split = SPLIT if pattern == PATTERN else regex.compile(pattern)
    if pattern == PATTERN and PLAIN.fullmatch(text):
        split = PLAIN_SPLIT
    if len(text) <= WORDS:
        yield split.findall(text) if not split.groups else [m.group() for m in split.finditer(text)]
        return
    found = (m.group() for m in split.finditer(text))
    while words := list(islice(found, WORDS)):
        yield words
