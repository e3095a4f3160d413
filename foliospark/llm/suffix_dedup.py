"""Exact repeated passages across documents, by merging shard Burrows-Wheeler transforms.

Of equal texts only the first is searched: the others go whole. Every window of `length` bytes chooses an anchor, its 20-byte
gram of least hash, so equal windows have equal anchors and meet under the anchor's hash. The context of an anchor holds all
windows that may have chosen it. Anchors are found once and dealt out by hash, as packed bytes of some thousands a row; those that
lie in one document only are dropped. A context that an earlier document holds repeats whole. The contexts that differ are dealt out by anchor; each task cuts its share into
shards, builds their transforms and merges these by interleave refinement, which gives the runs of suffixes with `length` bytes
in common, and so the first document of each window. An anchor with very many contexts is dealt out to many tasks: by the
bytes beside it that half of its windows have in common, and these again by more bytes, until the parts are small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.bwt import repeats
from foliospark.llm.common import read, staged

GRAM = 20
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_LOW = np.uint64((1 << 24) - 1)


def anchors(raw: bytes, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in it, hash of its gram, hash of its context) of each anchor that a window chooses.

    raw holds texts of these sizes end to end; windows don't cross them. An anchor's context is the bytes that windows which hold
    it can have, and where it lies in them.
    """
    n, reach = len(raw), length - GRAM
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, none
    eight = np.array(np.ndarray(n - 7, "<u8", raw, 0, (1,)))  # the eight bytes at each place
    grams = n - GRAM + 1
    hashed = eight[:grams] * _A
    hashed += eight[8 : 8 + grams] * _B
    hashed += eight[GRAM - 8 : GRAM - 8 + grams] * _C
    hashed ^= hashed >> np.uint64(32)
    hashed *= _D
    hashed ^= hashed >> np.uint64(29)
    # the least 40 bits of hash, then the first place; places of equal grams are interchangeable
    least = hashed & ~_LOW
    least |= np.arange(grams, dtype=np.uint64) & _LOW if n > _LOW else np.arange(grams, dtype=np.uint64)
    span = 1
    while span * 2 <= reach + 1:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < reach + 1:
        least = np.minimum(least[: len(least) - (reach + 1 - span)], least[reach + 1 - span :])
    place = (least & _LOW).view(np.int64)
    if n > _LOW:
        start = np.arange(len(place))
        place = start + (place - start) % (1 << 24)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    crossing = np.zeros(len(place), bool)
    for b in begin[1:-1].tolist():
        crossing[max(0, b - length + 1) : b] = True
    place = place[~crossing]
    if not len(place):
        return none, none, none, none
    place = place[np.concatenate([[True], place[1:] != place[:-1]])]
    text = np.searchsorted(begin, place, "right") - 1
    first, last = begin[text], begin[text + 1]
    inner = (place - first >= reach) & (last - place >= length)
    context = np.zeros(len(place), np.uint64)
    at = place[inner] - reach
    mixed = eight[at] * _A
    for k in [*range(8, reach + length - 8, 8), reach + length - 8]:
        mixed ^= mixed >> np.uint64(32)
        mixed += eight[at + k]
        mixed *= _B
    context[inner] = mixed ^ (mixed >> np.uint64(29))
    edge = np.flatnonzero(~inner)
    context[edge] = [
        xxhash.xxh64_intdigest(raw[max(f, p - reach) : min(e, p + length)], max(0, reach - (p - f))) for p, f, e in zip(place[edge].tolist(), first[edge].tolist(), last[edge].tolist())
    ]
    return text, place - first, hashed[place].view(np.int64), context.view(np.int64)


def encoded(text) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


BLOCK, HELD = 1 << 18, 200_000  # bytes searched at once, anchors sorted at once
ALONE, KNOWN, WHOLE, MET = range(4)
PACKED = {"h": np.int64, "c": np.int64, "doc_id": np.int64, "tag": np.int64, "place": np.int32, "kind": np.int8}


def packed(found: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Anchors (h, c, doc_id, tag, place) of some documents as a row per bucket, its values as bytes.

    Of kind WHOLE: the context lies in an earlier one of these documents. KNOWN: the gram lies in several of them; these two are
    spread evenly, so a gram that many documents hold fills no bucket. MET tells the gram's bucket of the KNOWN ones, once. ALONE: to be met
    there by those of other documents.
    """
    h, c, doc, tag, place = found
    order = np.argsort(c)
    opens = np.flatnonzero(np.concatenate([[True], (c[order][1:] != c[order][:-1]) | (h[order][1:] != h[order][:-1])]))
    earliest = np.empty(len(h), np.int64)
    earliest[order] = np.repeat(np.minimum.reduceat(doc[order], opens), np.diff(np.append(opens, len(h))))
    order = np.argsort(h)
    opens = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    low, high = (f.reduceat(doc[order], opens) for f in (np.minimum, np.maximum))
    kind = np.empty(len(h), np.int8)
    kind[order] = np.repeat(np.where(low < high, KNOWN, ALONE), np.diff(np.append(opens, len(h))))
    kind[doc > earliest] = WHOLE
    met = h[order][opens][low < high]
    blank = np.zeros(len(met), np.int64)
    bucket = np.where(kind == ALONE, (h >> 20) % buckets, np.arange(len(h)) % buckets)
    bucket = np.concatenate([bucket, (met >> 20) % buckets])
    values = [np.where(kind == WHOLE, 0, h), np.where(kind == WHOLE, 0, c), doc, tag, place, kind]
    values = [np.concatenate([v, m]) for v, m in zip(values, (met, blank, low[low < high], blank, blank, np.full(len(met), MET)))]
    order = np.argsort(bucket, kind="stable")
    some, opens = np.unique(bucket[order], return_index=True)
    ends = np.append(opens, len(order))
    columns = [pa.array(some, pa.int64())]
    for v, kept in zip(values, PACKED.values()):
        offsets = (ends * np.dtype(kept).itemsize).astype(np.int32)
        columns.append(pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(v[order], kept))]))
    return pa.RecordBatch.from_arrays(columns, names=["bucket", *PACKED])


def repeated_anchors(docs: DataFrame, length: int, tasks: int) -> DataFrame:
    """docs (doc_id, tag, text) to (h, c, doc_id, tag, place, whole) of the anchors whose gram lies in several documents.

    whole says that an earlier document holds the anchor's context; h and c are 0 then.
    """
    buckets = 8 * tasks

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        block: list[tuple[int, int, bytes]] = []
        count = size = 0

        def searched() -> int:
            ids, tags = (np.array([b[i] for b in block], np.int64) for i in (0, 1))
            text, place, h, c = anchors(b"".join(b[2] for b in block), np.array([len(b[2]) for b in block]), length)
            held.append((h, c, ids[text], tags[text], place))
            block.clear()
            return len(h)

        for batch in batches:
            for doc_id, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = encoded(text)
                if len(raw) < length:
                    continue
                if block and size + len(raw) > BLOCK:
                    count, size = count + searched(), 0
                block.append((doc_id, tag, raw))
                size += len(raw)
                if count >= HELD:
                    yield packed([np.concatenate(x) for x in zip(*held)], buckets)
                    held, count = [], 0
        if block:
            searched()
        if held:
            yield packed([np.concatenate(x) for x in zip(*held)], buckets)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[bytes]] = {x: [] for x in PACKED}
        for batch in batches:
            for name, part in parts.items():
                part.extend(batch.column(batch.schema.get_field_index(name)).to_pylist())
        v = {name: np.frombuffer(b"".join(parts.pop(name)), kept) for name, kept in PACKED.items()}
        kept = (v["kind"] == KNOWN) | (v["kind"] == WHOLE)
        asked = np.flatnonzero(~kept)
        if len(asked):
            asked = asked[np.argsort(v["h"][asked])]
            h, doc, met = v["h"][asked], v["doc_id"][asked], v["kind"][asked] == MET
            opens = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            several = (np.minimum.reduceat(doc, opens) < np.maximum.reduceat(doc, opens)) | np.logical_or.reduceat(met, opens)
            kept[asked] = np.repeat(several, np.diff(np.append(opens, len(asked)))) & ~met
        kept = np.flatnonzero(kept)
        for at in range(0, len(kept), 100_000):
            rows = kept[at : at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(v[x][rows], pa.int64()) for x in ("h", "c", "doc_id", "tag", "place")), pa.array(v["kind"][rows] == WHOLE)], names=["h", "c", "doc_id", "tag", "place", "whole"]
            )

    found = docs.select("doc_id", "tag", "text").mapInArrow(search, "bucket long, " + ", ".join(f"{x} binary" for x in PACKED))
    return found.repartition(tasks, "bucket").mapInArrow(meet, "h long, c long, doc_id long, tag long, place long, whole boolean")


def text_copies(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, tag) of the rows whose whole text, of `length` bytes at least, is that of a document with a smaller doc_id."""
    keyed = docs.where(F.octet_length("text") >= length).select("doc_id", "tag", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"))
    groups = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    return keyed.join(groups, ["k1", "k2"]).where("doc_id > lo").select("doc_id", "tag").distinct()


def context_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(h, c, owner, count, left, context) of wanted (h, c, owner, count, tag, place): left counts the bytes before the anchor."""
    reach = length - GRAM
    per_doc = wanted.groupBy(F.col("owner").alias("of"), F.col("tag").alias("of_tag")).agg(F.collect_list(F.struct("h", "c", "owner", "count", "place")).alias("wanted"))
    joined = docs.join(per_doc, (F.col("doc_id") == F.col("of")) & (F.col("tag") == F.col("of_tag"))).select("text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, ask in zip(batch.column(0), batch.column(1)):
                raw, w = encoded(text), ask.values
                place = w.field("place").to_pylist()
                cut = pa.array([raw[max(0, p - reach) : p + length] for p in place], pa.binary())
                yield pa.RecordBatch.from_arrays([*(w.field(x) for x in ("h", "c", "owner", "count")), pa.array([min(p, reach) for p in place], pa.int32()), cut], names=["h", "c", "owner", "count", "left", "context"])

    return joined.mapInArrow(run, "h long, c long, owner long, count long, left int, context binary")


def meets(h: np.ndarray, sides: list[bytes]) -> np.ndarray:
    """Whether another context of the same group has the same side."""
    keys = np.array([hash((a, b)) for a, b in zip(h.tolist(), sides)])
    _, where, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[where] > 1


def chunk_masks(strings: list[bytes], left: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """Bit j of a context's mask: the window that begins j - reach from its anchor is in a string with a smaller owner."""
    reach, masks = length - GRAM, np.zeros(len(strings), np.int64)
    found = repeats(strings, owner, length)
    windows = np.array([len(x) for x in found])
    string = np.repeat(np.arange(len(found)), windows)
    j = np.arange(len(string)) - np.repeat(np.cumsum(windows) - windows - reach + left, windows)
    held = (np.concatenate(found) < owner[string]) & (j <= reach)
    np.bitwise_or.at(masks, string[held], np.left_shift(1, j[held]))
    return masks


SHARE = pa.schema([("g", pa.int64()), ("h", pa.int64()), ("c", pa.int64()), ("owner", pa.int64()), ("bits", pa.int64()), ("left", pa.int32()), ("context", pa.binary())])


def merged_masks(contexts: DataFrame, length: int, tasks: int, chunk: int = 1000) -> DataFrame:
    """(h, c, owner, mask) of contexts, dealt out by their group g to tasks and in these to chunks whose transforms are merged.

    Contexts of a group hold the same anchor; bits are the windows that the group is to decide. A window that holds the anchor has
    half the bytes it can reach to one side at least, so contexts that share neither side with another of their group have no
    window in common with any and stay out of the transforms.
    """
    half = (length - GRAM) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = pa.Table.from_batches((b.cast(SHARE) for b in batches), schema=SHARE).sort_by("g")
        g, owner, bits, left = (share.column(x).to_numpy() for x in ("g", "owner", "bits", "left"))
        strings = share.column("context").to_pylist()
        if not strings:
            return
        before = [s[a - half : a] if a >= half else s[:a] + bytes([1]) for s, a in zip(strings, left.tolist())]
        after = [s[a + GRAM : a + GRAM + half] for s, a in zip(strings, left.tolist())]
        kept = np.flatnonzero(meets(g, before) | meets(g, after))
        masks = np.zeros(len(strings), np.int64)
        edges = np.flatnonzero(np.concatenate([[True], g[kept][1:] != g[kept][:-1], [True]])) if len(kept) else np.zeros(1, np.int64)
        begin = 0
        for end in edges[1:].tolist():  # whole groups only
            if end - begin >= chunk or end == len(kept):
                part = kept[begin:end]
                masks[part] = chunk_masks([strings[i] for i in part], left[part], owner[part], length) & bits[part]
                begin = end
        yield from pa.table({"h": share.column("h"), "c": share.column("c"), "owner": share.column("owner"), "mask": pa.array(masks)}).to_batches()

    return contexts.select(*SHARE.names).repartition(tasks, "g").mapInArrow(run, "h long, c long, owner long, mask long")


def halves(groups: DataFrame, length: int) -> DataFrame:
    """groups (h, c, owner, left, context, a, b), each to decide its windows a to b, as groups of half as many windows, staged.

    Windows a to b of an anchor have in common the anchor, length - GRAM - b bytes before it and a after it; contexts with windows
    there in common agree in these bytes, which with a and b make the group's key g. A context alone in a group has none in common.
    lo to hi are those of the windows that the context has. Contexts whose windows lo to hi are all the same are a class, told apart by
    two hashes: least is its first owner. total counts the contexts of a group, classes its classes, firsts the contexts of their first owners.
    """
    reach, size, left = length - GRAM, F.octet_length("context"), F.col("left")
    mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    part = F.explode(F.array(F.struct(F.col("a").alias("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), F.col("b").alias("b"))))
    cut = groups.select("h", "c", "owner", "left", "context", part.alias("p")).select("h", "c", "owner", "left", "context", "p.a", "p.b")
    cut = cut.withColumns({"lo": F.greatest(F.col("a"), reach - left), "hi": F.least(F.col("b"), size - length + reach - left)}).where("lo <= hi")
    common = F.substring("context", left - reach + F.col("b") + 1, GRAM + reach - F.col("b") + F.col("a"))
    whole = F.substring("context", left - reach + F.col("lo") + 1, length + F.col("hi") - F.col("lo"))
    own = ["h", "a", "b", "lo", "hi", whole]
    cut = cut.withColumns({"g": F.xxhash64("h", "a", "b", common), "u": F.xxhash64(*own), "v": F.xxhash64(F.lit("second"), *own)})
    cut = staged(cut, "anchor-halves")  # counted and joined: halved and hashed once
    owners = cut.groupBy("u", "v", "owner").agg(F.count("*").alias("n"), F.first("g").alias("g"))
    classes = owners.groupBy(F.col("u").alias("of_u"), F.col("v").alias("of_v")).agg(F.first("g").alias("in_g"), F.min("owner").alias("least"), F.min_by("n", "owner").alias("first_n"), F.sum("n").alias("all_n"))
    counts = classes.groupBy(F.col("in_g").alias("of_g")).agg(F.sum("all_n").alias("total"), F.sum("first_n").alias("firsts"), F.count("*").alias("classes")).where("total > 1")
    known = classes.join(counts, F.col("in_g") == F.col("of_g")).select("of_u", "of_v", "least", "total", "firsts", "classes")
    parts = cut.join(known, (F.col("u") == F.col("of_u")) & (F.col("v") == F.col("of_v"))).drop("of_u", "of_v", "u", "v")
    return staged(parts, "anchor-parts", [cut])


def bits_between(a: Column, b: Column) -> Column:
    """A long whose bits a to b are set."""
    power = lambda n: F.pow(F.lit(2.0), n).cast("long")  # noqa: E731  exact below 2**53
    return power(b + 1) - power(a)


def crowd_masks(groups: DataFrame, length: int, crowd: int, share: int) -> DataFrame:
    """(h, c, owner, mask) of anchors with over `crowd` contexts: their groups are halved until they are small enough to merge.

    In a group that is still over `crowd`, contexts with all windows in common leave to their first owner, whose windows they repeat, so
    only contexts that differ are halved on. Of a single window the first owner is left alone.
    """
    reach, small, equal = length - GRAM, [], []
    groups = groups.select("h", "c", "owner", "left", "context", F.lit(0).alias("a"), F.lit(reach).alias("b"))
    for _ in range(reach.bit_length()):
        parts = halves(groups, length)
        first = parts.where(f"total > {crowd} and least = owner and classes > 1")
        small.append(parts.where(f"total <= {crowd}").unionByName(first.where(f"firsts <= {crowd}")))
        equal.append(parts.where(f"total > {crowd} and least < owner"))
        groups = first.where(f"firsts > {crowd}")
        if not groups.limit(1).count():
            break
    merging, same = small[0], equal[0]
    for more, alike in zip(small[1:], equal[1:]):
        merging, same = merging.unionByName(more), same.unionByName(alike)
    masks = merged_masks(merging.withColumn("bits", bits_between(F.col("a"), F.col("b"))), length, max(1, -(-merging.count() // share)))
    alike = same.select("h", "c", "owner", bits_between(F.col("lo"), F.col("hi")).alias("mask"))
    return masks.unionByName(alike).groupBy("h", "c", "owner").agg(F.bit_or("mask").alias("mask"))


def repeated_windows(docs: DataFrame, length: int, crowd: int, share: int, tasks: int) -> DataFrame:
    """(doc_id, tag, place, mask): bit j of mask says that the window that begins j - (length - GRAM) from place is in an earlier document.

    The first document with a context (its owner) needs its windows compared; in later ones all windows of the context repeat.
    """
    places = staged(repeated_anchors(docs, length, tasks), "anchor-places")
    met = places.where("not whole").drop("whole")
    contexts = staged(met.groupBy("h", "c").agg(F.min(F.struct("doc_id", "tag", "place")).alias("first")), "contexts")
    counts = contexts.groupBy(F.col("h").alias("k")).count().where("count > 1")
    differ = contexts.join(counts, F.col("h") == F.col("k")).select("h", "c", F.col("first.doc_id").alias("owner"), "count", "first.tag", "first.place")
    differ = staged(context_bytes(docs, differ, length), "context-bytes")
    total, crowded = differ.agg(F.count("*"), F.count_if(F.col("count") > crowd)).first()
    every = F.lit((1 << (length - GRAM + 1)) - 1).cast("long")
    masks = merged_masks(differ.where(f"count <= {crowd}").withColumns({"g": F.col("h"), "bits": every}), length, max(1, -(-(total - crowded) // share)))
    if crowded:
        masks = masks.unionByName(crowd_masks(differ.where(f"count > {crowd}"), length, crowd, share))
    masks = staged(masks.where("mask != 0").select("h", "c", "mask"), "context-masks", instead_of=[differ])
    owners = contexts.select("h", "c", F.col("first.doc_id").alias("owner"))
    judged = met.join(owners, ["h", "c"]).join(masks, ["h", "c"], "left")
    mask = F.when(F.col("doc_id") > F.col("owner"), every).otherwise(F.coalesce("mask", F.lit(0).cast("long")))
    marks = judged.select("doc_id", "tag", "place", mask.alias("mask")).where("mask != 0")
    return marks.unionByName(places.where("whole").select("doc_id", "tag", "place", every.alias("mask")))


def dedup_passages(docs: DataFrame, length: int = 50, crowd: int = 1000, share: int = 20_000, broadcast_rows: int = 200_000, search_bytes: int = 1 << 23) -> DataFrame:
    """(doc_id, n_bytes, kept binary, spans array of (start, end) of bytes), a row per row of docs.

    A byte goes if a string of `length` bytes that covers it also begins in a document with a smaller doc_id. Texts count as
    UTF-8 bytes, null as none; matches never cross documents. Rows with a null doc_id are neither searched nor cut. Rows that
    share a doc_id are one document: they don't cut each other. Other columns are not read. Anchors with more than
    `crowd` contexts are split over tasks; a task merges the transforms of about `share` contexts. Anchors of `search_bytes` of text
    on average meet in a task. Rows whose whole text is that of an
    earlier document are left out of the search by a broadcast of their ids, up to `broadcast_rows` of them, else by a shuffle.
    """
    reach = length - GRAM
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    per_id = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    repeats_ids, size = per_id.agg(F.coalesce(F.max("n") > 1, F.lit(False)), F.coalesce(F.sum("size"), F.lit(0))).first()
    rows = rows.withColumn("tag", F.xxhash64("text") if repeats_ids else F.lit(0).cast("long")).select("doc_id", "tag", "text")
    known = rows.where("doc_id is not null")
    copies = staged(text_copies(known, length), "text-copies")
    if copies.count() <= broadcast_rows:
        searched = known.join(F.broadcast(copies), ["doc_id", "tag"], "left_anti")
    else:
        searched = staged(known.join(copies, ["doc_id", "tag"], "left_anti"), "distinct-texts")
    marks = repeated_windows(searched, length, crowd, share, max(1, -(-size // search_bytes)))
    per_row = marks.groupBy(F.col("doc_id").alias("of"), F.col("tag").alias("of_tag")).agg(F.collect_set(F.struct("place", "mask")).alias("marks"))
    per_row = per_row.withColumn("whole", F.lit(False)).unionByName(copies.select(F.col("doc_id").alias("of"), F.col("tag").alias("of_tag"), F.lit(True).alias("whole")), allowMissingColumns=True)
    both = rows.join(per_row, (F.col("doc_id") == F.col("of")) & (F.col("tag") == F.col("of_tag")), "left").select("doc_id", "text", "marks", "whole")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def cut(raw: bytes, marked, whole) -> tuple[bytes, list[dict]]:
        if whole.as_py():
            return b"", [{"start": 0, "end": len(raw)}]
        if not marked.is_valid:
            return raw, []
        place, mask = (marked.values.field(x).to_numpy() for x in ("place", "mask"))
        at, j = np.nonzero((mask[:, None] >> np.arange(reach + 1)) & 1)
        start = np.clip(place[at] - reach + j, 0, None)
        start = start[start + length <= len(raw)]
        depth = np.cumsum(np.bincount(start, minlength=len(raw) + 1)[: len(raw) + 1] - np.bincount(start + length, minlength=len(raw) + 1)[: len(raw) + 1])
        gone = np.concatenate([[False], depth[:-1] > 0, [False]])
        edges = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2)
        return np.frombuffer(raw, np.uint8)[~gone[1:-1]].tobytes(), [{"start": int(a), "end": int(b)} for a, b in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [encoded(t) for t in batch.column(1)]
            done = [cut(raw, marked, whole) for raw, marked, whole in zip(raws, batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raws), pa.int64()), pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.list_(span))], names=["doc_id", "n_bytes", "kept", "spans"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_passages(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
