"""What tokenizing whole texts shares: cuts that no token crosses, ids remembered by segment, and ragged arrays."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Sequence
from itertools import chain, count, islice

import numpy as np

#: Blanks before which a text may not be cut: they follow white space.
UNSAFE = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]
UNSAFE_ASCII = [w for w in UNSAFE if w.isascii()]
SAFE_CUT = re.compile(r"(?<=\S)(?= )")
MEMO = 1_000_000  # distinct pieces that a worker remembers
SEGMENTS = 400_000  # distinct segments that it remembers; over that, those met once go


def segments(text: str) -> list[str]:
    """Cut a text before each blank that follows something else than white space, and leave that blank out.

    Byte-level BPE splits texts there in any context: only the first sign of a pre-token can be a blank, unless all of it is white space.
    """
    if text.startswith(" ") or any([w in text for w in (UNSAFE_ASCII if text.isascii() else UNSAFE)]):
        first, *rest = SAFE_CUT.split(text)
        return [first, *(s[1:] for s in rest)]
    return text.split(" ")


def spread_out(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices begin[i] .. begin[i] + size[i] - 1, one range after the other."""
    size = size.astype(np.int64)
    total = np.cumsum(size)
    return np.repeat(begin - total + size, size) + np.arange(total[-1] if len(total) else 0)


class Ragged:
    """Rows of different lengths in one pool, for picking many at once."""

    def __init__(self, pool: np.ndarray, size: np.ndarray):
        self.pool, self.size = pool, size
        self.begin = np.cumsum(size, dtype=np.int64) - size

    def pick(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows one after the other, and how long each is."""
        size = self.size[rows].astype(np.int64)
        return self.pool[spread_out(self.begin[rows], size)], size


class SegmentIds:
    """Ids of whole texts from the ids of their distinct segments; up to SEGMENTS are remembered, those met often the longest."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode  # ids one after the other, and how many each has
        self._forget()

    def _forget(self) -> None:
        self._remember({}, {}, Ragged(np.zeros(0, np.int32), np.zeros(0, np.int32)))

    def _remember(self, first: dict[str, int], later: dict[str, int], ids: Ragged) -> None:
        number = count(len(ids.size))  # of a segment's row in `ids`: one that is looked up and not there gets the next
        self.first: dict[str, int] = defaultdict(number.__next__, first)  # segments that begin a text
        self.later: dict[str, int] = defaultdict(number.__next__, later)  # those after a blank, without it
        self.ids = ids
        self.met = np.zeros(len(ids.size), np.int64)

    def _forget_rare(self) -> None:
        """Keep the segments met most often, half of SEGMENTS at most."""
        least = 2
        while (kept := self.met >= least).sum() > SEGMENTS // 2:
            least *= 2
        pool, size = self.ids.pick(np.flatnonzero(kept))
        number, stays = (np.cumsum(kept) - 1).tolist(), kept.tolist()
        first, later = ({s: number[i] for s, i in seen.items() if stays[i]} for seen in (self.first, self.later))
        self._remember(first, later, Ragged(pool, size.astype(np.int32)))

    def _learn(self, segs: list[str], blank: str) -> None:
        ids, size = self.encode([blank + s for s in segs])
        self.ids = Ragged(np.concatenate([self.ids.pool, ids.astype(np.int32)]), np.concatenate([self.ids.size, size.astype(np.int32)]))

    def entries(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """Of all segments of the texts: their entries in `ids`; how many segments each text has; the segments."""
        if len(self.first) + len(self.later) > SEGMENTS:
            self._forget_rare()
        parts = [segments(t) for t in texts]
        heads = [p[0] for p in parts]
        rest = [p[1:] for p in parts]
        flat = list(chain.from_iterable(rest))
        many = np.fromiter(map(len, parts), np.int64, len(parts))
        begin = np.cumsum(many) - many
        out = np.empty(many.sum(), np.int64)
        head = np.zeros(len(out), bool)
        head[begin] = True
        out[head] = self._places(self.first, heads, "")
        out[~head] = self._places(self.later, flat, " ")
        met = np.bincount(out, minlength=len(self.ids.size))
        met[: len(self.met)] += self.met
        self.met = met
        return out, many, parts

    def _places(self, seen: dict[str, int], segs: list[str], blank: str) -> np.ndarray:
        """Entries of the segments; new ones are learned."""
        before = len(seen)
        at = np.fromiter(map(seen.__getitem__, segs), np.int64, len(segs))
        if len(seen) > before:
            try:
                self._learn(list(islice(reversed(seen), len(seen) - before))[::-1], blank)
            except BaseException:  # numbers without ids must not be met again
                self._forget()
                raise
        return at

    def texts(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and where each text's begin (one more entry at the end)."""
        entry, count, _ = self.entries(texts)
        ids, size = self.ids.pick(entry)
        at = np.concatenate([[0], np.cumsum(size)])
        return ids, at[np.concatenate([[0], np.cumsum(count)])]
