"""Burrows-Wheeler transforms of shards and their merge by interleave refinement (after Holt and McMillan)."""

from __future__ import annotations

import numpy as np


def transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, bwt) of a circular text of bytes: its rotations in order, and the byte before each. Ranks double in length."""
    n = len(text)
    packed, twice = np.zeros(n, np.uint64), np.concatenate([text, text[:8] if n >= 8 else np.resize(text, 8)]).astype(np.uint64)
    for i in range(8):
        packed = (packed << np.uint64(8)) | twice[i : i + n]
    rank, span = dense(packed), 8
    while span < n and rank.max() < n - 1:
        rank = dense(rank * n + np.roll(rank, -span))
        span *= 2
    order = np.argsort(rank, kind="stable")
    return order, text[order - 1]


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys without gaps, equal keys alike."""
    order = np.argsort(keys)
    held = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], held[1:] != held[:-1]]))
    return out


def merge(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleaves the transforms of shards until their rotations are in order by `depth` symbols, an even number.

    Returns (rank, block). rank[i] is the place of the i-th rotation of the merge among the shards' own, laid end to end; each
    shard's rotations keep their order. block[i] numbers the runs of rotations that have their first `depth` symbols in
    common: a new block begins just where the common prefix with the rotation before is shorter. No rotation is compared
    or sorted again: each round only deals the last interleave out by the symbols before.
    """
    if depth % 2:
        raise ValueError("depth has to be even")
    sizes = np.array([len(s) for s in shards])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # where the rotation that begins one symbol earlier stands in the same shard
    back = np.concatenate([np.argsort(np.argsort(s, kind="stable"), kind="stable") + b for s, b in zip(shards, begin)])
    symbols = np.concatenate(shards).astype(np.uint16)
    pair = (symbols[back] << np.uint16(8)) | symbols
    back = back[back].astype(np.int32)
    rank = np.arange(len(symbols), dtype=np.int32)
    block = np.zeros(len(symbols), np.int32)
    new = np.ones(len(symbols), bool)
    for column, back, rounds in dealing(pair, back, depth):
        for _ in range(rounds):
            letters = column[rank]
            dealt = np.argsort(letters, kind="stable")
            letters, block, rank = letters[dealt], block[dealt], back[rank[dealt]]
            np.logical_or(letters[1:] != letters[:-1], block[1:] != block[:-1], out=new[1:])
            block = np.cumsum(new, dtype=np.int32)
    return rank, block


def dealing(pair: np.ndarray, back: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(letters, where the rotation that begins before them stands, rounds): the rounds of `depth` symbols.

    Eight or four symbols a round where the shards hold few enough of them to number in 16 bits, and two for the rest.
    """
    known = [(pair, back, 2)]
    while known[-1][2] < 8:
        letters, back, n = known[-1]
        before = letters[back]
        order = np.argsort(letters, kind="stable")
        order = order[np.argsort(before[order], kind="stable")]
        first, second = before[order], letters[order]
        number = np.cumsum(np.concatenate([[0], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))
        if number[-1] >= 1 << 16:
            break
        wider = np.empty(len(pair), np.uint16)
        wider[order] = number
        known.append((wider, back[back], 2 * n))
    rounds = []
    for letters, back, n in reversed(known):
        rounds.append((letters, back, depth // n))
        depth %= n
    return rounds


def shard_lists(strings: list[bytes], most: int) -> list[list[int]]:
    """Numbers of the strings of each shard, of about `most` bytes."""
    shards, held = [[]], 0
    for i, s in enumerate(strings):
        if held and held + len(s) + 1 > most:
            shards.append([])
            held = 0
        shards[-1].append(i)
        held += len(s) + 1
    return shards


def repeats(strings: list[bytes], owners: np.ndarray, length: int, shard_bytes: int = 1 << 15) -> list[np.ndarray]:
    """For each string, and each place where a window of `length` bytes begins: the least owner of a string that holds that window.

    The strings are cut into shards, each shard is transformed, and the transforms are merged.
    """
    transforms, places, offset = [], [], 0
    for shard in shard_lists(strings, shard_bytes):
        # a separator of 0 after each string; bytes move up by one (UTF-8 has no byte 255)
        text = np.frombuffer(b"\xff".join([*(strings[i] for i in shard), b""]), np.uint8) + np.uint8(1)
        order, symbols = transform(text)
        transforms.append(symbols)
        places.append(order + offset)
        offset += len(text)
    rank, block = merge(transforms, length)
    place = np.concatenate(places)[rank]
    sizes = np.array([len(s) for s in strings])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    string = np.repeat(np.arange(len(strings)), sizes + 1)[place]
    whole = place - begin[string] + length <= sizes[string]
    block, place, string = block[whole], place[whole], string[whole]
    least = np.full(offset, np.iinfo(np.int64).max)
    if len(block):
        opens = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        first = np.minimum.reduceat(owners[string], opens)
        least[place] = np.repeat(first, np.diff(np.append(opens, len(block))))
    return [least[b : b + max(0, n - length + 1)] for b, n in zip(begin, sizes)]
