"""Hierarchical multi-length packing.

Documents are tokenised and cut. Full windows of the longest tier are sequences at once; what is left of a document is routed to the
smallest tier (context size) that takes it. Windows of the longest tier are filled first, their gaps from the largest pieces of
shorter tiers that fit, and closed by cutting one piece; then the next tier is packed from what is left, and so on. Windows of
a tier go to step groups of equal token counts, balanced by attention cost.

All of it happens inside the task that reads the documents: nothing is shuffled, a task holds one Arrow batch and at most one
open window per tier, and a task that runs again gives the same rows.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import read

TIERS = (128, 256, 512, 1024)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_group long"
_encoders: dict[str, object] = {}


def encoder(vocabulary: str, end_of_text: int = 50256):
    """A function from a text to its ids: byte-level BPE from a rank file, several times faster than the tokenizer file of the same vocabulary, and with the same ids.

    The rank file's regular expressions give up on very long stretches of white space; such a text goes through the tokenizer file.
    """
    if vocabulary not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": end_of_text})

        def encode(text: str) -> list[int]:
            try:
                return fast.encode(text, allowed_special="all", disallowed_special=())
            except ValueError:  # the stack of the regular expression ran out
                return whole_file_encoder(vocabulary.rsplit(".", 1)[0] + ".json").encode(text, add_special_tokens=False).ids

        _encoders[vocabulary] = encode
    return _encoders[vocabulary]


def whole_file_encoder(name: str):
    if name not in _encoders:
        import public_tokenizers
        from tokenizers import Tokenizer

        _encoders[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return _encoders[name]


class Pool:
    """Pieces of one tier by length; takes the longest that fits."""

    def __init__(self):
        self.sizes: list[int] = []
        self.by_size: dict[int, list] = {}
        self.tokens = 0

    def add(self, piece) -> None:
        same = self.by_size.setdefault(piece[2], [])
        if not same:
            insort(self.sizes, piece[2])
        same.append(piece)
        self.tokens += piece[2]

    def fitting(self, room: int) -> int:
        at = bisect_right(self.sizes, room)
        return self.sizes[at - 1] if at else 0

    def take(self, size: int):
        same = self.by_size[size]
        piece = same.pop()
        if not same:
            self.sizes.remove(size)
        self.tokens -= size
        return piece


class Packer:
    """Pieces are (document's place in ids, start, length)."""

    def __init__(self, tiers: tuple[int, ...], first_id: int):
        self.tiers, self.next_id = tiers, first_id
        self.pools = [Pool() for _ in tiers]
        self.out: list[tuple] = []
        self.done: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # (cost, sequence, tokens) by tier

    def document(self, at, n: int) -> None:
        long = self.tiers[-1]
        full = n - n % long
        for start in range(0, full, long):
            self.close(len(self.tiers) - 1, [(at, start, long)])
        if n > full:
            self.route((at, full, n - full))

    def route(self, piece) -> None:
        self.pools[next(i for i, t in enumerate(self.tiers) if piece[2] <= t)].add(piece)

    def close(self, tier: int, pieces: list) -> None:
        """A finished sequence."""
        window, offset, cost = sum(x[2] for x in pieces), 0, 0
        for at, start, length in pieces:
            self.out.append((at, start, length, self.next_id, offset, window))
            offset += length
            cost += length * length
        self.done[tier].append((cost, self.next_id, offset))
        self.next_id += 1

    def fill(self, tier: int, window: list, room: int) -> int:
        """Longest pieces of this tier and shorter ones first; a piece of the shortest tier that holds one is cut to close the gap."""
        while room:
            size, pool = max(((p.fitting(room), -i) for i, p in enumerate(self.pools[: tier + 1])), default=(0, 0))
            if size:
                piece = self.pools[-pool].take(size)
                window.append(piece)
                room -= piece[2]
                continue
            pool = next((p for p in self.pools if p.sizes), None)
            if pool is None:
                break
            at, start, length = pool.take(pool.sizes[0])
            window.append((at, start, room))
            self.route((at, start + room, length - room))
            room = 0
        return room

    def pack(self, last: bool) -> None:
        for tier in range(len(self.tiers) - 1, -1, -1):
            size, pool = self.tiers[tier], self.pools[tier]
            while pool.sizes and (self.waiting(tier) >= size):
                first = pool.take(pool.sizes[-1])
                window = [first]
                self.fill(tier, window, size - first[2])
                self.close(tier, window)
        if last:
            self.rest()

    def waiting(self, tier: int) -> int:
        """Tokens that could go to a window of the tier."""
        return sum(p.tokens for p in self.pools[: tier + 1])

    def rest(self) -> None:
        """Less than a long window is left: it goes to windows of the tiers, then of lower powers of two."""
        left = [p.take(size) for p in self.pools for size in list(p.sizes) for _ in range(len(p.by_size[size]))]
        left.sort(key=lambda x: -x[2])
        total = sum(x[2] for x in left)
        while total:
            room, window = min(self.tiers[-1], 1 << (total.bit_length() - 1)), []
            total -= room
            while room:
                at, start, length = left.pop(0)
                window.append((at, start, min(room, length)))
                if length > room:
                    left.insert(0, (at, start + room, length - room))
                room -= min(room, length)
            self.close(next(i for i, t in enumerate(self.tiers) if window and sum(x[2] for x in window) <= t), window)

    def groups(self, step_tokens: int, first: int) -> dict[int, int]:
        """Step group of each sequence: costly and cheap windows of a tier are dealt to and fro over as many groups as fill a step."""
        found, base = {}, first
        for tier, done in enumerate(self.done):
            n = max(1, -(-sum(x[2] for x in done) // step_tokens)) if done else 0
            for i, (_, sequence, _) in enumerate(sorted(done, reverse=True)):
                turn, place = divmod(i, n)
                found[sequence] = base + (place if turn % 2 == 0 else n - 1 - place)
            base += n
            self.done[tier] = []
        self.next_group = base
        return found


def pack_batches(batches: Iterator[pa.RecordBatch], tiers: tuple[int, ...], vocabulary: str, end: int, step_tokens: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encode = encoder(vocabulary)
    first = TaskContext.get().partitionId() << 40
    packer, next_group = Packer(tiers, first), first
    rows: list = []
    held: dict[int, np.ndarray] = {}  # ids of the documents that wait
    names: dict[int, int | None] = {}
    number = 0

    def flush(last: bool):
        nonlocal next_group
        packer.pack(last)
        group = packer.groups(step_tokens, next_group)
        next_group = packer.next_group
        out = packer.out
        packer.out = []
        rows = [(names[at], start, length, zlib.crc32(held[at][start : start + length]), len(held[at]), sequence, offset, window, group[sequence]) for at, start, length, sequence, offset, window in out]
        waiting = {p[0] for pool in packer.pools for same in pool.by_size.values() for p in same}
        for at in [x for x in held if x not in waiting]:
            del held[at], names[at]
        cols = list(zip(*rows)) or [[] for _ in range(9)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in SCHEMA.split(", ")])

    tokens = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.array(encode(text.as_py() or "") + [end], "<u4")
            held[number], names[number] = ids, doc_id
            packer.document(number, len(ids))
            number += 1
            tokens += len(ids)
            if tokens >= 1_000_000:  # bounds what a task holds
                yield flush(False)
                tokens = 0
    yield flush(True)


def pack(docs: DataFrame, tiers: tuple[int, ...] = TIERS, vocabulary: str = "byte_bpe_50k.tiktoken", end: int = 0, step_tokens: int = 65536) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_group) that cover every document once.

    Sequences are full windows of a tier, or, for less than a long window at the end of each task, of a power of two: there is no
    padding. Null and empty texts are the end id alone. A null doc_id stays null; repeated rows are packed each. Columns
    other than doc_id and text are not read. No rows give no pieces. Ids of a task start at its number times 2**40.
    """
    tiers = tuple(sorted(tiers))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: pack_batches(batches, tiers, vocabulary, end, step_tokens), SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
