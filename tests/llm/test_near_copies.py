"""Near copies against brute-force Jaccard similarity."""

import random

import pytest

import corpus_pipeline as cp
from foliospark.llm import near_copies


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Smallest doc_id of the component of each doc_id."""
    sets = {d: shingles(t) for d, t in rows}
    label = {d: d for d in sets}

    def top(d):
        while label[d] != d:
            d = label[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return {d: top(d) for d in sets}


def made():
    """Texts with edits about the limit, chains of them, and a passage that many unlike texts share."""
    draw = random.Random(7)
    words = [f"w{i}" for i in range(4000)]
    rows, common = [], draw.choices(words, k=12)
    for n in (3, 5, 6, 20, 60, 200):
        for _ in range(6):
            base = draw.choices(words, k=n)
            for edits in range(6):
                rows.append(" ".join(base))
                for _ in range(max(1, edits * n // 120)):
                    base[draw.randrange(n)] = draw.choice(words)
    for _ in range(60):
        own = draw.choices(words, k=draw.randrange(1, 9))
        rows += [" ".join(common + own), " ".join(own + common)]
    return list(enumerate([*rows, "", " \n", "A B", "a  b"]))


@pytest.mark.parametrize("block", [2, 64])
def test_near_copies_are_those_of_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rows = made()
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    first = {}
    for r in got:
        first[r.component] = min(first.get(r.component, r.doc_id), r.doc_id)
    assert {r.doc_id: first[r.component] for r in got} == brute(rows) and len(got) == len(rows)


def test_stage_drops_near_copies(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = set(brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]).values())
    one = cp.near(spark, docs, sf_dir)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == want


def test_stage_keeps_one_row_a_group(spark):
    long, other = " ".join(f"a{i}" for i in range(100)), " ".join(f"b{i}" for i in range(100))
    near, lone = long + " end", "a text of its own that nothing else resembles"
    rows = [(1, long, "x"), (1, long, "x"), (1, long, "w"), (2, near, "x"), (2, lone, "x"), (None, other, "x"), (None, other, "x"), (None, near, "x"), (7, None, "x"), (7, "", "x")]
    got = cp.near(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()
    assert sorted(((r.doc_id, r.text, r.source) for r in got), key=repr) == sorted([(1, long, "w"), (2, lone, "x"), (None, other, "x"), (7, None, "x")], key=repr)


def test_hashes_do_not_depend_on_chunks(monkeypatch):
    draw = random.Random(3)
    text = " ".join(draw.choice(["a", "bc", "d" * 40, "e" * 70_000]) for _ in range(300))
    whole = near_copies.shingle_set(text)
    monkeypatch.setattr(near_copies, "CHUNK", 400_000)
    assert len(whole) == len(shingles(text)) and (near_copies.shingle_set(text) == whole).all()


def test_sketches_bound_the_difference():
    draw = random.Random(4)
    for n in (1, 5, 63, 64, 65, 300, 3000):
        one = {draw.getrandbits(63) for _ in range(n)}
        two = set(list(one)[: n - n // 10]) | {draw.getrandbits(63) for _ in range(n // 8)}
        bits = [int.from_bytes(near_copies.parity_sketch(near_copies.np.array(sorted(s), near_copies.np.int64)).tobytes(), "little") for s in (one, two)]
        if n in (5, 300, 3000):
            assert (bits[0] ^ bits[1]).bit_count() <= len(one ^ two)


def test_close_fingerprints_link_without_the_set_join(spark, monkeypatch):
    draw = random.Random(9)
    texts = [" ".join(f"w{draw.randrange(900)}" for _ in range(300)) for _ in range(6)]
    data = [(i, t) for i, t in enumerate(texts)] + [(10 + i, t + " more") for i, t in enumerate(texts)]
    prints = {i: near_copies.set_print(near_copies.shingle_set(t)) for i, t in data}
    wanted = {i for i in range(6) if ((prints[i] ^ prints[10 + i]) & (2**64 - 1)).bit_count() <= 2}
    assert wanted
    met = near_copies._met
    monkeypatch.setattr(near_copies, "_met", lambda one: met(one).where("false"))
    found = {r.doc_id: r.component for r in near_copies.near_copies(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert {i for i in range(6) if found[i] == found[10 + i]} == wanted
    assert len(set(found.values())) == len(data) - len(wanted)
