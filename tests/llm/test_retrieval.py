"""Lexical search, hard negatives and embedding near-duplicates against brute force."""

import math
import re
from collections import Counter

import numpy as np
from foliospark.llm import embedding_dedup, hard_negatives, lexical_search, simhash
from foliospark.llm.registry import queries

NAN, INF = float("nan"), float("inf")


def test_search_on_awkward_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)] + ["É", "naïve", "X9"]
    rows = [(int(i) if i % 9 else None, " ".join(rng.choice(words, rng.integers(1, 60)))) for i in range(150)]
    rows += [(5, None), (6, ""), (7, "!?"), (8, "w1 " * 3000), (400, "w1 w2"), (401, "w1 W2"), (400, "w1 w2")]
    items = [(1, "w1 W2, naïve"), (2, None), (3, "?"), (4, "w3"), (4, "x9 w4"), (None, "É w5"), (9, "absent"), (10, " ".join(words))]
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    counts = [(d, Counter(find(t))) for d, t in rows]
    n_docs, n_terms = sum(c.total() > 0 for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(find(t))
    want = []
    for i, terms in asked.items():
        scored = []
        for d, c in counts:
            m = 10 + (90 * c.total() * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in terms if c[w])
            scored.append((-s, d is None, d))
        want += [(i, n, d, -s) for n, (s, _, d) in enumerate(sorted(x for x in scored if x[0] < 0)[:10], 1)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, item int, n int").repartition(3)
    for block, size in ((1 << 14, 1 << 22), (16, 40)):
        monkeypatch.setattr(lexical_search, "BLOCK", block)
        monkeypatch.setattr(lexical_search, "QUERY_BYTES", size)
        got = lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string"))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(lexical_search, "PIECE", 7)
    for text in ("", "abc", "a" * 50, "one two-three é four " * 9, "x" * 20 + " y"):
        assert [w for p in lexical_search.pieces(text.encode()) for w in p] == text.replace("-", " ").encode().split()


def vectors(spark, rows, more=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int" + more)


BAD = [(900, None, 1), (700, [None, 1.0], 1), (800, [NAN, 1.0], 1), (600, [1.0, INF], 1)]


def test_hard_negatives_on_awkward_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(i), (rng.standard_normal(6) + 1).tolist(), int(rng.integers(0, 3))) for i in range(250)]
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(60)] + [(400, [], 0), (401, [0.5], 1), (402, [1e7] * 6, 1), (None, [1.0] * 6, 1), (403, [1.0] * 6, None)]
    rows += [(500 + i, [1.0] * 6, i % 2) for i in range(40)]
    q = {i: np.pad(np.floor(256 * np.array(v)).astype(int), (0, 6 - len(v))) for i, v, lab in rows if i is not None and lab is not None and i != 402}
    label = {i: lab for i, _, lab in rows if i in q}
    want = []
    for a in (i for i in q if i % 100 == 0):
        score = {i: int(q[a] @ q[i]) for i in q if i != a}
        ordered = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in ordered if label[i] == label[a]][:5]:
            fit = [i for i in ordered if label[i] != label[a] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:10]
            want += [(a, p, n, i, score[p], score[i]) for n, i in enumerate(fit, 1)]
    df = vectors(spark, [(*r, 1) for r in rows + BAD], ", k int").repartition(3)
    for anchors in (4096, 2):
        monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
        assert sorted(map(tuple, hard_negatives.hard_negatives(df).collect())) == sorted(want)
    assert hard_negatives.hard_negatives(vectors(spark, [(i, [], i % 2) for i in range(4)])).collect() != []


def linked(vecs, limit=0.9):
    """Links and smallest linked index of each vector."""
    x = np.array(vecs)
    norm = np.sqrt((x * x).sum(axis=1))
    sim = (x @ x.T) / np.maximum(norm[:, None] * norm[None], 1e-300)
    near = (sim >= limit) & (norm[:, None] > 0) & (norm[None] > 0)
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(x))])
        if (new == label).all():
            return near.sum(axis=1), label
        label = new


def spread(seed: int, n: int = 300, d: int = 16) -> np.ndarray:
    """Vectors with copies, near ones (cosine 0.88 to 1) in pairs, and a wide and a narrow crowd of them."""
    r = np.random.default_rng(seed)
    base = r.standard_normal((n, d))
    out = [base, base[:5]]
    for i, (m, low, high) in enumerate([(1, 0.88, 1.0)] * 40 + [(60, 0.9, 0.99), (80, 0.99, 1.0)]):
        u = base[i] / np.linalg.norm(base[i])
        z = r.standard_normal((m, d))
        z -= np.outer(z @ u, u)
        c = r.uniform(low, high, (m, 1))
        out.append((c * u + np.sqrt(1 - c * c) * z / np.linalg.norm(z, axis=1, keepdims=True)) * r.uniform(0.1, 9, (m, 1)))
    return np.concatenate(out)


def test_embedding_links_match_brute_force(spark):
    x = spread(1)
    n_links, label = linked(x)
    df = vectors(spark, [(i, v, 1) for i, v in enumerate(x.tolist())]).repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    assert len(got) == len(x) and all(r.n_links <= n_links[i] for i, r in got.items())  # none below the limit
    assert sum(r.n_links for r in got.values()) >= 0.99 * n_links.sum()
    assert sum(r.component_id == label[i] for i, r in got.items()) >= 0.99 * len(x)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embedding_links_of_awkward_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, [0.0, 1.0, 0.0], 1), (5, [0.0, 1e-200], 1), (None, [1e300, 1e299], 1), (None, [-1.0, 0.0], 1), (6, [], 1)]
    df = vectors(spark, [(*r, 1) for r in rows + BAD], ", k int")
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicate_vectors(df).collect()), key=repr)
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (None, 3, 1, False), (None, 0, None, False), (6, 0, 6, True), *((i, 0, i, True) for i, _, _ in BAD)]
    assert got == sorted(want, key=repr)


def test_embedding_query_finds_what_all_pairs_give(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    n_links, label = linked([r.embedding for r in rows])
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries()["op13_embedding_dedup"](spark, sf_dir).collect()}
    assert got == {r.vec_id: (n_links[i], rows[label[i]].vec_id) for i, r in enumerate(rows)}


def test_simhash_query_links_all_within_two_bits(spark, sf_dir):
    prints = {r.doc_id: simhash.fingerprint(r.text) % 2**64 for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    label, changed = {d: d for d in prints}, True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and label[a] > label[b]:
                    label[a], changed = label[b], True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries()["op5_simhash"](spark, sf_dir).collect()}
    assert got == {d: (f"{prints[d]:016x}", label[d]) for d in prints}
