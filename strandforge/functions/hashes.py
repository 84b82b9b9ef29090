"""MD5 of many texts that differ at their ends alone, as arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: MD5's start, sines and turns, and the word that each step takes.
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = [int(abs(np.sin(float(i + 1))) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_WORDS = [(1, 0), (5, 1), (3, 5), (7, 0)]
_STEPS = [(i // 16, (m * i + a) % 16, _TURNS[i // 16][i % 4], _SINES[i]) for i in range(64) for m, a in [_WORDS[i // 16]]]
_ALL = 0xFFFFFFFF
_NUMBERS = {x: np.uint32(x) for x in (*_SINES, *range(1, 32))}


def _block(state: tuple, words: list) -> tuple:
    """The state after one block of 16 words; each of them, and of the state, is a number or an array of uint32.

    Until a step meets an array it is done once, in plain numbers.
    """
    many = [isinstance(x, np.ndarray) for x in words]
    a, b, c, d = state
    step = 0
    while not (isinstance(a, np.ndarray) or many[_STEPS[step][1]]):
        kind, w, turn, sine = _STEPS[step]  # the lead's words: of the first kind
        t = (a + ((b & c) | (~b & d)) + sine + words[w]) & _ALL
        a, b, c, d = d, (b + (t << turn | t >> 32 - turn)) & _ALL, b, c
        step += 1
    shape = next(x.shape for x in words if isinstance(x, np.ndarray))
    a, b, c, d = (np.full(shape, x, np.uint32) for x in (a, b, c, d))
    t, turned = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    xor, add, both = np.bitwise_xor, np.add, np.bitwise_or
    for kind, w, turn, sine in _STEPS[step:]:
        if kind == 0:
            xor(c, d, t)
            np.bitwise_and(t, b, t)
            xor(t, d, t)
        elif kind == 1:
            xor(b, c, t)
            np.bitwise_and(t, d, t)
            xor(t, c, t)
        elif kind == 2:
            xor(b, c, t)
            xor(t, d, t)
        else:
            np.invert(d, t)
            both(t, b, t)
            xor(t, c, t)
        add(t, a, t)
        if many[w]:
            add(t, words[w], t)
            add(t, _NUMBERS[sine], t)
        else:
            add(t, np.uint32((sine + words[w]) & _ALL), t)
        np.right_shift(t, _NUMBERS[32 - turn], turned)
        np.left_shift(t, _NUMBERS[turn], t)
        both(t, turned, t)
        add(t, b, t)
        a, b, c, d, t = d, t, b, c, a
    return tuple(x + (y if isinstance(y, np.ndarray) else np.uint32(y)) for x, y in zip((a, b, c, d), state, strict=True))


@lru_cache(256)
def _bytes_of(numbers: tuple[int, ...] | range, after: bytes) -> list[tuple[slice, np.ndarray]]:
    """Ascending numbers as decimal text before ``after``, those of one length together."""
    texts = [str(n).encode() + after for n in numbers]
    out, at = [], 0
    while at < len(texts):
        to = at
        while to < len(texts) and len(texts[to]) == len(texts[at]):
            to += 1
        out.append((slice(at, to), np.frombuffer(b"".join(texts[at:to]), np.uint8).reshape(to - at, -1)))
        at = to
    return out


def md5_of_pairs(lead: bytes, first: list[int] | range, second: list[int]) -> np.ndarray:
    """MD5 of ``lead`` + i + ":" + k for every i of ``first`` and k of ``second``, both ascending: (2, i, k), the digest's two big-endian halves.

    Hashing them one by one in Python takes six times as long.
    """
    out = np.empty((2, len(first), len(second)), np.uint64)
    begin = len(lead) // 4 * 4  # whole words of the lead are the same in all texts
    first = first if isinstance(first, range) else tuple(first)  # a range is asked for again and again
    before = [(rows, i, cols, k) for rows, i in _bytes_of(first, b":") for cols, k in _bytes_of(tuple(second), b"\x80")]
    blocks: dict[int, list] = {}
    for rows, i, cols, k in before:
        blocks.setdefault((len(lead) + i.shape[1] + k.shape[1] - 1 + 8) // 64 + 1, []).append((rows, i, cols, k))
    for count, parts in blocks.items():  # two counts at most where lengths differ by less than a block
        widest = max(i.shape[1] + k.shape[1] for _, i, _, k in parts)
        n = -(-(len(lead) - begin + widest) // 4)
        ends = np.zeros((len(first), len(second), 4 * n), np.uint8)
        bits = np.zeros((len(first), len(second)), np.uint32)
        ends[:, :, : len(lead) - begin] = np.frombuffer(lead[begin:], np.uint8)
        at = len(lead) - begin
        for rows, i, cols, k in parts:
            ends[rows, cols, at : at + i.shape[1]] = i[:, None]
            ends[rows, cols, at + i.shape[1] : at + i.shape[1] + k.shape[1]] = k[None]
            bits[rows, cols] = 8 * (len(lead) + i.shape[1] + k.shape[1] - 1)
        told = ends.view("<u4")
        words: list = [int.from_bytes(lead[x : x + 4], "little") for x in range(0, begin, 4)]
        words += [np.ascontiguousarray(told[:, :, x]) for x in range(n)]
        words = (words + [0] * (16 * count))[: 16 * count - 2] + [bits, 0]  # texts are far shorter than 2^32 bits
        state: tuple = _START
        for x in range(count):
            own = words[16 * x : 16 * x + 16]
            if x < begin // 64:  # within the lead: one block for all texts
                own[0] = np.full((1, 1), own[0], np.uint32)
            state = _block(state, own)
        halves = [(state[x].byteswap().astype(np.uint64) << np.uint64(32)) | state[x + 1].byteswap() for x in (0, 2)]
        for rows, _, cols, _ in parts:
            out[0, rows, cols], out[1, rows, cols] = halves[0][rows, cols], halves[1][rows, cols]
    return out


def by_hash(halves: np.ndarray, group: np.ndarray) -> np.ndarray:
    """By row, the columns in the order of their group, hash and number; ``halves`` as of ``md5_of_pairs``, at most 32 ascending groups.

    Group, leading bits and number are sorted as one whole number; rows in which leading bits of two columns tie are sorted by all bits.
    """
    low = max(1, (len(group) - 1).bit_length())
    keys = (group << np.uint64(59)) | ((halves[0] >> np.uint64(5 + low)) << np.uint64(low)) | np.arange(len(group), dtype=np.uint64)
    keys.sort(axis=1)
    order = (keys & np.uint64((1 << low) - 1)).astype(np.int64)
    keys >>= np.uint64(low)
    for k in np.flatnonzero((keys[:, 1:] == keys[:, :-1]).any(axis=1)):
        order[k] = np.lexsort((halves[1, k], halves[0, k], group))
    return order
