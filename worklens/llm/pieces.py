"""Cutting texts into pieces that tokenise alone as they do within the text, and ragged arrays."""

from __future__ import annotations

import re

import numpy as np

#: Between a non-space and a single space or line feed that another non-space follows,
#: and after such a line feed, every match of the byte-level pattern ends.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)")


#: White space other than space and line feed; fixed values.
_ASCII_SPACES = "\t\v\f\r\x1c\x1d\x1e\x1f"
_OTHER_SPACES = (
    "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def cut(text: str) -> list[str]:
    """The pieces of a text: in order and joined they are the text."""
    if (
        "\0" not in text
        and text.count(" ") + text.count("\n") + 1 == len(text.split())
        and not any(map(text.__contains__, _ASCII_SPACES))
        and (text.isascii() or not any(map(text.__contains__, _OTHER_SPACES)))
    ):
        # Single spaces and line feeds only, none at either end.
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
    return _CUT.split(text)


class Numbering(dict):
    """Numbers keys from zero in the order in which they are first asked for."""

    def __init__(self) -> None:
        self.new: list = []

    def __missing__(self, key):
        number = self[key] = len(self)
        self.new.append(key)
        return number

    def of(self, keys) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), dtype=np.int64)

    def take_new(self) -> list:
        new, self.new = self.new, []
        return new


class Ragged:
    """Rows of numbers of different length, kept in one flat array."""

    def __init__(self, dtype=np.int32) -> None:
        self.flat = np.empty(0, dtype=dtype)
        self.lengths = np.empty(0, dtype=np.int64)
        self.starts = np.empty(0, dtype=np.int64)

    def append(self, lengths: np.ndarray, flat: np.ndarray) -> None:
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        self.flat = np.concatenate((self.flat, flat.astype(self.flat.dtype)))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.starts = np.concatenate((self.starts, starts))

    def put(self, rows: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> None:
        """Sets rows by number; numbers left out on the way are empty until set."""
        more = max(int(rows.max(initial=-1)) + 1 - len(self.lengths), 0)
        self.lengths = np.concatenate((self.lengths, np.zeros(more, np.int64)))
        self.starts = np.concatenate((self.starts, np.zeros(more, np.int64)))
        self.lengths[rows] = lengths
        self.starts[rows] = len(self.flat) + np.cumsum(lengths) - lengths
        self.flat = np.concatenate((self.flat, flat.astype(self.flat.dtype)))

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lengths of the rows asked for, and their numbers one after another."""
        lengths = self.lengths[rows]
        at = np.repeat(self.starts[rows] - (np.cumsum(lengths) - lengths), lengths)
        return lengths, self.flat[at + np.arange(len(at))]


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sum of each group of consecutive values."""
    upto = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(lengths)
    return upto[ends] - upto[ends - lengths]
