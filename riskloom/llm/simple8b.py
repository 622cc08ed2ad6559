"""Simple-8b: unsigned integers in 64-bit words, 4 bits of selector and 60 of payload.

A selector says how many values of how many bits a word holds. Values of more than 60 bits follow an
escape word as they are. Coding starts anew in each block of BLOCK values, and the word at which each
block starts is kept, so blocks are coded and decoded side by side with array operations, and one block
can be read alone.
"""

from __future__ import annotations

import numpy as np

BLOCK = 2048
#: Fixed values: (values in a word, bits of each); a selector is a place in this list. 15 is the escape.
LAYOUT = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
_COUNT = np.array([c for c, _ in LAYOUT] + [0, 1], np.int64)


_WIDTH16 = np.maximum(np.frexp(np.arange(1 << 16, dtype=np.float64))[1], 1).astype(np.uint8)


def _bits(v: np.ndarray) -> np.ndarray:
    """Bits of each value, at least 1."""
    if int(v.max()) < 1 << 16:
        return _WIDTH16[v]
    out = np.ones(len(v), np.uint8)
    for b in range(1, 64):
        more = v >= np.uint64(1 << b)
        if not more.any():
            break
        out[more] = b + 1
    return out


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block)."""
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    v = np.ascontiguousarray(values)
    blocks = -(-n // block)
    # each block is followed by values too wide for any selector, so no word crosses its end
    apart = block + LAYOUT[0][0]
    widest = np.full((blocks, apart), 61, np.uint8)
    bits = _bits(v)
    whole = n // block
    widest[:whole, :block] = bits[: whole * block].reshape(whole, block)
    if whole < blocks:
        widest[whole, : n - whole * block] = bits[whole * block :]
    widest = widest.ravel()
    choice = np.full(len(widest), ESCAPE, np.uint8)
    have = 1  # widest[i] is the widest of `have` values from i on
    for s in range(len(LAYOUT) - 1, -1, -1):
        count, width = LAYOUT[s]
        while have < count:
            grow = min(have, count - have)
            widest[: len(widest) - grow] = np.maximum(widest[: len(widest) - grow], widest[grow:])
            have += grow
        if s and int(widest.min()) > width:
            break
        choice[widest <= width] = s
    jump = _COUNT.astype(np.uint8)[choice]
    starts_of = np.arange(0, n, block, dtype=np.int64)
    pos = np.arange(blocks, dtype=np.int64) * apart
    ends = pos + np.minimum(block, n - starts_of)
    mark = np.zeros(len(widest), bool)
    while len(pos):
        mark[pos] = True
        pos += jump[pos]
        live = pos < ends
        if not live.all():
            pos, ends = pos[live], ends[live]
    at = np.flatnonzero(mark)
    sel = choice[at]
    first = at - at // apart * LAYOUT[0][0]
    esc = sel == ESCAPE
    size = 1 + esc.astype(np.int64)
    where = np.concatenate([[0], np.cumsum(size)])
    words = np.empty(where[-1], np.uint64)
    for s in np.unique(sel):
        mine = np.flatnonzero(sel == s)
        if s == ESCAPE:
            words[where[mine]] = np.uint64(ESCAPE)
            words[where[mine] + 1] = v[first[mine]].astype(np.uint64)
            continue
        count, width = LAYOUT[s]
        w, start = np.full(len(mine), s, np.uint64), first[mine]
        for j in range(count):
            w |= v[start + j].astype(np.uint64) << np.uint64(4 + j * width)
        words[where[mine]] = w
    offsets = where[np.searchsorted(first, starts_of)].astype(np.uint64)
    return words, offsets


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n values of encode()."""
    words = np.ascontiguousarray(words, np.uint64)
    if not n:
        return np.empty(0, np.uint64)
    sel = (words & np.uint64(15)).astype(np.uint8)
    if (raw := np.flatnonzero(sel == ESCAPE)).size:  # the word behind an escape is a value
        keep = []
        prev = -2
        for i in raw.tolist():
            if i != prev + 1:
                keep.append(i)
                prev = i
            else:
                prev = -2
        head = np.ones(len(words), bool)
        head[np.array(keep) + 1] = False
        first = np.flatnonzero(head)
    else:
        first = np.arange(len(words))
    s_of = sel[first]
    to = np.concatenate([[0], np.cumsum(_COUNT[s_of])])
    if to[-1] != n:
        raise ValueError(f"{to[-1]} values in the words, {n} expected")
    out = np.empty(n, np.uint64)
    for s in np.unique(s_of):
        mine = np.flatnonzero(s_of == s)
        if s == ESCAPE:
            out[to[mine]] = words[first[mine] + 1]
            continue
        count, width = LAYOUT[s]
        w, mask = words[first[mine]], np.uint64((1 << width) - 1)
        for j in range(count):
            out[to[mine] + j] = (w >> np.uint64(4 + j * width)) & mask
    return out


def decode_block(words: np.ndarray, offsets: np.ndarray, n: int, k: int, block: int = BLOCK) -> np.ndarray:
    """The values of block k alone."""
    lo = int(offsets[k])
    hi = int(offsets[k + 1]) if k + 1 < len(offsets) else len(words)
    return decode(words[lo:hi], np.zeros(1, np.uint64), min(block, n - k * block), block)
