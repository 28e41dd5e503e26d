"""Cut a text into pieces that a byte-level BPE tokenizer encodes independently.

The usual byte-level pre-tokenizer pattern lets a word take one space before
it. A space that is not next to other white space on both sides therefore
always starts a new pre-token, and the text may be cut before every such
space. Equal pieces encode equally, so that an encoder may keep their results.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np

#: A space whose neighbours are both white space (or the end): such runs need the whole text.
_TANGLED = re.compile(r"\s (?:\s|\Z)")


def separable(text: str, specials: tuple[str, ...]) -> bool:
    return _TANGLED.search(text) is None and not any(s in text for s in specials)


def units(text: str) -> tuple[str, list[str]]:
    """The first piece, and the later ones without the space they start with."""
    head, *rest = text.split(" ")
    return head, rest


#: ASCII white space, and what Python counts as such.
_WS = np.zeros(256, bool)
_WS[[*range(9, 14), *range(28, 33)]] = True
_RANDOM = np.random.default_rng(5_880_131)
#: The hash of a piece: a random value for each byte, and an odd multiplier modulo 2^64.
_VALUES, _MULTIPLIER = _RANDOM.integers(0, 1 << 64, 256, np.uint64), 0x9E3779B97F4A7C15


_known_powers: dict[int, np.ndarray] = {}


def _powers(m: int, n: int) -> np.ndarray:
    """m^0 .. m^n modulo 2^64; kept, as every call needs the same ones."""
    known = _known_powers.get(m)
    if known is None or len(known) <= n:
        known = _known_powers[m] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, m, np.uint64)]))
    return known[: n + 1]


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, from prefix sums over all of them."""
    up, down = _powers(_MULTIPLIER, len(data)), _powers(pow(_MULTIPLIER, -1, 1 << 64), len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * up[:-1])])
    return (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


class _Tape:
    """Arrays appended end to end."""

    def __init__(self, kind: type):
        self.values, self.used = np.empty(1 << 16, kind), 0

    def add(self, more: np.ndarray) -> int:
        """Append; the place where it went."""
        at, self.used = self.used, self.used + len(more)
        if self.used > len(self.values):
            self.values = np.concatenate([self.values[:at], np.empty(max(len(more), at), self.values.dtype)])
        self.values[at : self.used] = more
        return at


_INT32 = 1 << 30


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, .. of every span, end to end."""
    before = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    small = np.int32 if total < _INT32 and int(starts.max(initial=0)) < _INT32 else np.int64
    out = np.repeat((starts - before).astype(small), lengths)
    out += np.arange(total, dtype=small)
    return out


class PieceTable:
    """What pieces encode to: sorted hashes, and the bytes and ids of their pieces end to end.

    A hash only finds a candidate: the bytes of every occurrence are compared
    with the candidate's, and a piece that shares its hash with another is
    encoded on its own. The table is bounded in pieces and in bytes; when it
    is full, only pieces that have come back since the last time stay.
    """

    #: Bytes of text that are looked up together.
    BLOCK = 4 << 20

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = 1_000_000, byte_limit: int = 24 << 20):
        self.encode, self.limit, self.byte_limit = encode, limit, byte_limit
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        #: For each key: place and number of ids, place and number of bytes.
        self.rows = np.empty((4, 0), np.int32)
        #: Whether a piece was met again.
        self.again = np.empty(0, bool)
        self.tape, self.text = _Tape(np.uint32), _Tape(np.uint8)

    def shrink(self) -> None:
        """Keep what was met again, if that is not most of the table."""
        keep, rows, tape, text = self.again, self.rows.astype(np.int64), self.tape, self.text
        keys, many = self.keys[keep], int(keep.sum())
        self.clear()
        if not many or 2 * many > self.limit or 2 * int(rows[3, keep].sum()) > self.byte_limit:
            return
        rows = rows[:, keep]
        self.tape.add(tape.values[_spans(rows[0], rows[1])])
        self.text.add(text.values[_spans(rows[2], rows[3])])
        rows[0], rows[2] = np.cumsum(rows[1]) - rows[1], np.cumsum(rows[3]) - rows[3]
        self.keys, self.rows, self.again = keys, rows.astype(np.int32), np.zeros(many, bool)

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = self.encode([data[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        at = self.tape.add(np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum())))
        return at + np.cumsum(size) - size, size

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all byte ranges end to end, and how many each has."""
        blocks = np.flatnonzero(np.diff((ends - starts[0]) // self.BLOCK)) + 1
        found = []
        for lo, hi in zip([0, *blocks.tolist()], [*blocks.tolist(), len(starts)], strict=True):
            base = starts[lo]
            found.append(self._lookup(data[base : ends[hi - 1]], starts[lo:hi] - base, ends[lo:hi] - base))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > self.limit or self.text.used > self.byte_limit:
            self.shrink()
        lengths = ends - starts
        unique, first, which = np.unique(piece_hashes(data, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        if len(self.keys):
            known = self.keys[np.minimum(place, len(self.keys) - 1)] == unique
        rows = np.empty((4, len(unique)), np.int32)
        rows[:, known] = self.rows[:, place[known]]
        self.again[place[known]] = True
        new = np.flatnonzero(~known)
        if len(new):
            a, n = starts[first[new]], lengths[first[new]]
            rows[0, new], rows[1, new] = self._encode(data, a, a + n)
            rows[2, new], rows[3, new] = self.text.add(data[_spans(a, n)]) + np.cumsum(n) - n, n
            self.keys, self.rows = np.insert(self.keys, place[new], unique[new]), np.insert(self.rows, place[new], rows[:, new], axis=1)
            self.again = np.insert(self.again, place[new], False)
        at, size, origin, long = rows[:, which].astype(np.int64)
        same = long == lengths
        sure = np.flatnonzero(same)
        if len(sure):
            n = lengths[sure]
            # pieces mostly lie end to end
            whole = len(sure) == len(starts) and bool((starts[1:] == ends[:-1]).all())
            here = data[starts[0] : ends[-1]] if whole else data[_spans(starts[sure], n)]
            equal = here == self.text.values[_spans(origin[sure], n)]
            if not equal.all():
                same[sure] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        other = np.flatnonzero(~same)
        if len(other):
            at[other], size[other] = self._encode(data, starts[other], ends[other])
        return self.tape.values[_spans(at, size)], size


def _tangled(data: np.ndarray, bounds: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Which of the texts (byte ranges between bounds) can't be cut at their spaces, or may not be for all that bytes tell."""
    n = len(bounds) - 1
    ws = _WS[data]
    before, after = np.concatenate([[False], ws[:-1]]), np.concatenate([ws[1:], [True]])
    filled = bounds[:-1][np.diff(bounds) > 0]
    before[filled] = False
    after[(bounds[1:] - 1)[np.diff(bounds) > 0]] = True
    odd = np.flatnonzero((data == 32) & before & after)
    # bytes that begin white space beyond ASCII: C2 85, C2 A0, E1 9A, E2 80, E2 81, E3 80
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    follow = data[np.minimum(lead + 1, len(data) - 1)]
    d = data[lead]
    wide = lead[((d == 0xC2) & ((follow == 0x85) | (follow == 0xA0))) | ((d == 0xE1) & (follow == 0x9A)) | ((d == 0xE2) & ((follow == 0x80) | (follow == 0x81))) | ((d == 0xE3) & (follow == 0x80))]
    found = [odd, wide]
    raw = data.tobytes()
    for s in special:
        at = raw.find(s)
        while at >= 0:
            found.append(np.array([at]))
            at = raw.find(s, at + 1)
    out = np.zeros(n, bool)
    places = np.concatenate(found)
    out[np.searchsorted(bounds, places, side="right") - 1] = True
    return out


def encode_texts(texts: list[bytes], table: PieceTable, whole: Callable[[str], list[int]], special: list[bytes]) -> list[np.ndarray]:
    """Ids of each text (UTF-8); texts that can't be cut are encoded as a whole."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return [np.empty(0, np.uint32)] * len(texts)
    tangled = _tangled(data, bounds, special)
    begins = data == 32
    begins[bounds[:-1][sizes > 0]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(data))
    owner = np.searchsorted(bounds, starts, side="right") - 1
    keep = ~tangled[owner]
    starts, ends, owner = starts[keep], ends[keep], owner[keep]
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
    if len(starts):
        flat, size = table.lookup(data, starts, ends)
        total = np.cumsum(size)
        last = np.searchsorted(owner, np.arange(len(texts)), side="right")
        cut = np.concatenate([[0], total])[last]
        for i, (a, b) in enumerate(zip(np.concatenate([[0], cut[:-1]]).tolist(), cut.tolist(), strict=True)):
            out[i] = flat[a:b]
    for i in np.flatnonzero(tangled):
        out[i] = np.array(whole(texts[i].decode()), np.uint32)
    return out
