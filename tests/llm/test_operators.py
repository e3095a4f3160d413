"""Operators that SQL can't express, against brute force; and awkward rows for all."""

import hashlib
import os
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliospark.llm import bwt, chat_format, components, decontaminate, iso_media, language_id, line_dedup, packing, quality, secret_scan, simhash, suffix_dedup

DOCS = "doc_id long, text string"
CLASH = ["n_lines", "row", "pos", "h1", "found", "score", "media", "tag", "w", "label", "fp", "start", "ids"]


def clashing(spark, data):
    """Documents with more columns, named like inner and result columns."""
    df = spark.createDataFrame(data, DOCS)
    for c in CLASH:
        df = df.withColumn(c, F.lit(7))
    return df


@pytest.fixture(scope="module")
def awkward(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    return clashing(spark, [(1, None), (2, ""), (None, "lost text " * 20), (None, None), (3, long), (4, long), (4, long), (5, "same id, first text " * 9), (5, "same id, other text " * 9), (6, "é\U0001f600" * 40)])


def test_line_dedup_rows(spark):
    line = "a line of well over twenty characters"
    data = [(1, line), (2, line + "\nkept"), (2, "kept\n" + line), (3, line.upper() + " "), (None, line), (4, None)]
    got = sorted((r.doc_id or -1, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(clashing(spark, data)).collect())
    assert got == [(-1, line, 1, 0), (1, "", 1, 1), (2, "kept", 2, 1), (2, "kept", 2, 1), (3, line.upper() + " ", 1, 0), (4, "", 1, 0)]
    assert line_dedup.dedup_lines(clashing(spark, data)).columns.count("n_lines") == 1


def test_line_runs_agree_for_any_batches(spark):
    draw = random.Random(5)
    data = [(i, "\n".join(f"line number {draw.randint(0, 60)} of a test text" for _ in range(8))) for i in range(120)]
    df = spark.createDataFrame(data, DOCS)
    results = [sorted(map(tuple, line_dedup.dedup_lines(df, batches=b, fanout=f).collect())) for b, f in ((1, 2), (6, 2))]
    assert results[0] == results[1]


def test_awkward_rows_run(spark, awkward, sf_dir):
    benchmark = spark.createDataFrame([(1, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11"), (None, "lost text"), (None, None)], "item_id long, text string")
    n = awkward.count()
    marked = decontaminate.contamination(awkward, benchmark).collect()
    assert len(marked) == n and sorted((r.doc_id, r.n_hit) for r in marked if r.doc_id in (3, 4)) == [(3, 11), (4, 11), (4, 11)]
    assert [(r.n_hit, r.n_items, r.contaminated) for r in marked if r.doc_id is None and r.text] == [(40, 0, True)]
    assert secret_scan.scan_secrets(awkward, F.lit("o"), F.lit("r")).count() == n
    assert simhash.near_duplicates(awkward).count() == n
    assert language_id.predict_language(awkward, {}).where("lang_pred = 'und' and score = 0").count() == n
    assert quality.quality_scores(awkward, spark.createDataFrame([(1, None), (99, 1)], "doc_id long, quality int")).where("score = 0.5").count() == n
    stored = iso_media.media_columns(iso_media.store_texts(awkward))
    assert stored.count() == n and stored.where("media_error is not null").count() == 0
    assert suffix_dedup.dedup_passages(awkward).count() == n
    pieces = packing.pack(awkward)
    assert pieces.where("start = 0").count() == n


def test_packing_covers_every_id(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "a <|endoftext|> b")], DOCS), allowMissingColumns=True)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids, at = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], "<u4"), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0 and len({r.step_group for r in pieces}) == 1


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprints(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(80).unionAll(spark.createDataFrame([(-1, None), (-2, "One"), (-3, "one \x0b TWO"), (-4, "É a b c d")], DOCS)).collect()
    for r in docs:
        assert simhash.fingerprint(r.text) % 2**64 == brute_fingerprint(r.text)


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_simhash_links_every_pair(spark, most):
    draw = random.Random(3)
    prints = {draw.getrandbits(64) for _ in range(150)}
    for p in list(prints)[:40]:
        prints |= {p ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for _ in range(6)}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    parent = {p: p for p in signed}

    def top(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) % 2**64).bit_count() <= 2:
                parent[top(a)] = top(b)
    want = defaultdict(set)
    for p in signed:
        want[top(p)].add(p)
    found = components.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), most=most)).collect()
    got = defaultdict(set)
    for node, label in found:
        got[label].add(node)
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)
    assert all(label == min(nodes) for label, nodes in got.items())


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (5, 5)], "a long, b long")
    labels = {r.node: r.label for r in components.components(edges).collect()}
    assert labels == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_ties_and_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_id.op7_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    scored = quality.op8_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (scored.predicted == scored.quality).mean() > 0.95 and scored.score.between(0, 1).all()
    assert ((scored.score >= 0.7) == (scored.predicted == 1)).all()


def test_language_profiles_have_one_order(spark):
    docs = spark.createDataFrame([(1, "abc abc", "x"), (2, "xyz xyz", "y"), (3, "123 ... ½", "x")], DOCS + ", lang string")
    profiles = language_id.train_profiles(docs)
    assert profiles == language_id.train_profiles(docs.repartition(3))
    out = {r.doc_id: r.lang_pred for r in language_id.predict_language(docs, profiles).collect()}
    assert out == {1: "x", 2: "y", 3: "und"}


def test_pairwise_ranking_orders_scores():
    draw = np.random.default_rng(1)
    good, bad = draw.normal(1, 1, (500, 3)), draw.normal(-1, 1, (100, 3))
    w = quality.fit_pairs(good, bad, 4000)
    assert np.mean(np.median(good @ w) > bad @ w) > 0.95


@pytest.mark.parametrize("frames", [1, 7, 8, 9, 16, 17, 1000])
def test_container_round_trip(frames):
    payload = os.urandom(64 * frames)
    data = iso_media.mux(payload)
    (track, _, _) = iso_media.tracks(data)[0]
    assert iso_media.samples(data) == payload and track["codec"] == "raw " and track["duration"] == frames / 25
    assert [data[k["start"] : k["end"]] for k in track["keyframes"]] == [payload[i * 64 : i * 64 + 64] for i in range(0, frames, 8)]


def test_other_containers():
    payload = os.urandom(64 * 3)
    data = iso_media.mux(payload)
    stsz = data.index(b"stsz")
    three = data[: stsz + 8] + struct.pack(">II", 0, 3) + data[stsz + 16 :]
    with pytest.raises(iso_media.Malformed):
        iso_media.tracks(three)  # a table that passes its box
    for cut in (0, 4, 20, len(data) - 3):
        with pytest.raises(iso_media.Malformed):
            iso_media.tracks(data[:cut])
    large = struct.pack(">I4sQ", 1, b"free", 24) + bytes(8)
    assert iso_media.tracks(data + large)[0][0]["n_samples"] == 3


def test_malformed_media_are_reported(spark):
    df = spark.createDataFrame([(1, b"junk"), (2, None), (3, iso_media.mux(bytes(64)))], "id long, media binary").withColumn("tracks", F.lit(1))
    got = {r.id: r for r in iso_media.media_columns(df).collect()}
    assert got[1].media_error and got[1].tracks is None and got[2].media_bytes is None and got[3].payload_bytes == 64


def brute_passages(data, length=50):
    first = {}
    for doc, text in data:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            g = raw[i : i + length]
            first[g] = min(first.get(g, 1 << 62), doc)
    out = {}
    for doc, text in data:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < doc:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest())
    return out


def test_window_of_a_crowd_knows_its_first_owner(spark):
    r = random.Random(5)
    some = lambda n: bytes(r.randrange(97, 123) for _ in range(n))
    common = some(50)
    contexts = spark.createDataFrame([(7, k, 10 + k, 30, bytearray(some(19) + bytes([65 + k]) + common + bytes([65 + k]) + some(9))) for k in range(6)], "h long, c long, owner long, left int, context binary")
    masks = suffix_dedup.crowd_masks(contexts, 50, crowd=2, share=20_000)
    assert "Join" not in masks._jdf.queryExecution().optimizedPlan().toString()  # windows are not joined with their first owners
    assert sorted((m.owner, m.mask) for m in masks.collect()) == [(10 + k, 1 << 20) for k in range(1, 6)]


def test_contexts_of_a_crowd_leave_once_all_windows_repeat(spark, monkeypatch):
    r, n, written = random.Random(6), 40, []
    some = lambda k: bytes(r.randrange(97, 123) for _ in range(k))
    line = some(65)  # windows 0 to 15 of each context lie in it
    contexts = [(7, k, 10 + k // 2, 30, line + bytes([100 + k]) + some(14)) for k in range(n)] + [(7, n, 5, 3, line[27:] + bytes([99]) + some(14))]
    table = spark.createDataFrame([(*c[:4], bytearray(c[4])) for c in contexts], "h long, c long, owner long, left int, context binary")
    halved = suffix_dedup.halves
    monkeypatch.setattr(suffix_dedup, "halves", lambda *given: written.append(halved(*given)) or written[-1])
    masks = {m.c: m.mask for m in suffix_dedup.crowd_masks(table, 50, crowd=2, share=20_000).collect() if m.mask}
    window = lambda c, j: c[4][c[3] - 30 + j :][:50] if 30 - c[3] <= j <= len(c[4]) - 20 - c[3] else None
    first = {}
    for c in contexts:
        for j in range(31):
            first[window(c, j)] = min(first.get(window(c, j), 1 << 62), c[2])
    wanted = {c[1]: sum(1 << j for j in range(31) if window(c, j) and first[window(c, j)] < c[2]) for c in contexts}
    assert masks == {c: m for c, m in wanted.items() if m}
    assert sum(t.count() for t in written) < 8 * n  # 31 rows or more a context if all were halved down to single windows


@pytest.mark.parametrize(("crowd", "share"), [(5000, 20_000), (2, 20_000), (5000, 15)])
def test_passages_match_brute_force(spark, crowd, share):
    draw = random.Random(11)
    letter = lambda n: "".join(draw.choice("ab é\n") for _ in range(n))
    shared = [letter(n) for n in (49, 50, 51, 70, 120)]
    data = [(i, letter(draw.randrange(40)) + draw.choice(shared) + letter(draw.randrange(60)) + draw.choice(shared)[3:]) for i in range(60)]
    data += [(100, "a" * 300), (101, "a" * 120 + "b"), (102, None), (103, ""), (104, data[0][1]), (105, "ab" * 90), (106, "ba" * 70)]
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.dedup_passages(spark.createDataFrame(data, DOCS), crowd=crowd, share=share).collect()}
    assert got == brute_passages(data)


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_whole_copies_go_by_broadcast_or_shuffle(spark, broadcast_rows):
    draw = random.Random(4)
    text = "".join(draw.choice("abcdef") for _ in range(80))
    data = [(3, text), (7, text), (8, "z" + text), (9, "short"), (10, "short"), (11, None), (12, text)]
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.dedup_passages(spark.createDataFrame(data, DOCS), broadcast_rows=broadcast_rows).collect()}
    assert got == brute_passages(data)


def test_passages_of_rows_that_share_an_id(spark):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(90))
    data = [(1, text), (2, "x" + text), (2, text + "y"), (None, text)]
    got = sorted(((r.doc_id or 0), len(r.kept)) for r in suffix_dedup.dedup_passages(spark.createDataFrame(data, DOCS)).collect())
    assert got == [(0, 90), (1, 90), (2, 1), (2, 1)]


def test_merged_transforms_are_in_order():
    draw = random.Random(2)
    texts = [np.frombuffer(bytes(draw.choice(b"ab") for _ in range(n)) + b"\0", np.uint8) for n in (40, 60, 25)]
    orders, symbols = zip(*map(bwt.transform, texts))
    rank, block = bwt.merge(list(symbols), 12)
    rotations = [bytes(np.roll(t, -int(at))[:12]) for t, order in zip(texts, orders) for at in order]
    heads = [rotations[r] for r in rank]
    assert heads == sorted(heads)
    assert [int(b) for b in np.diff(block)] == [int(a != b) for a, b in zip(heads, heads[1:])]


def test_chat_escapes_reverse(spark):
    texts = [c[:i] + x + c[i:] for c in chat_format.CONTROLS for i in (0, 1, len(c)) for x in ("", "\\", "<", "\\\\[")] + ["", "\\", "\\\\<s>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e"))
    rows = df.select("t", "e", chat_format.unescape(F.col("e")).alias("back")).collect()
    assert all(r.t == r.back and not any(c in r.e for c in chat_format.CONTROLS) for r in rows)


def test_copied_secrets_are_told_from_live_ones(spark):
    key = "ghp_QqRrSsTtUuVvWwXxYyZz0q1r2s3t4u5v"
    data = [(i, f"see {key} here", f"o{i}") for i in range(4)] + [(9, "mine ghp_ZzYyXxWwVvUuTtSsRrQq9z8y7x6w5v4u", "o9")] + [(i, "token = 'example-example'", f"o{i}") for i in range(20, 24)]
    got = {r.doc_id: r.found for r in secret_scan.scan_secrets(spark.createDataFrame(data, DOCS + ", owner string"), F.col("owner"), F.col("owner")).collect()}
    assert got[0] == [] and got[9][0].verdict == "live" and got[20][0].verdict == "example" and got[20][0].owners == 4


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "\n \t" * 300_000, "a" * 1_000_000, "x " * 10 + " " * 700_000 + "<|endoftext|>  end"])
def test_ids_of_very_long_runs(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.encoder("byte_bpe_50k.tiktoken")(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_of_a_million_blanks(spark):
    pieces = packing.pack(spark.createDataFrame([(1, " " * 1_000_000), (2, "b")], DOCS)).collect()
    assert sum(r.length for r in pieces if r.doc_id == 1) == next(r.doc_tokens for r in pieces if r.doc_id == 1) > 1


def test_secrets_copied_over_repositories_are_examples(spark):
    key = "password = 'hunter2hunter2'"
    data = [(i, f"x {key} y {key}", "one", f"r{i}") for i in range(4)] + [(9, "token: abcdefghijkl", "two", "r9"), (10, "token: abcdefghijkl", "six", "r9")]
    got = {r.doc_id: r.found for r in secret_scan.scan_secrets(spark.createDataFrame(data, DOCS + ", owner string, repo string"), F.col("owner"), F.col("repo")).collect()}
    assert [(s.start, s.end, s.owners, s.repos, s.verdict) for s in got[0]] == [(2, 28, 1, 4, "example"), (32, 58, 1, 4, "example")] and got[9][0].verdict == "shared"


def test_rows_without_a_conversation_stand_alone(spark):
    rows = [(None, 0, "user", "a", 1), (None, 1, "assistant", "b", 1), (5, 0, "assistant", "c", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at long").withColumn("formatted", F.lit(1)).withColumn("span", F.lit(1)).withColumn("alone", F.lit(1))
    got = sorted((r.conv_id or 0, r.formatted.count("<|im_start|>"), [tuple(s) for s in r.loss_spans]) for r in chat_format.format_chats(df).collect())
    assert got == [(0, 1, []), (0, 1, [(31, 1)]), (5, 1, [(31, 1)])]


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_query_is_that_of_plain_profiles(spark, sf_dir):
    """Ranks and distances by dictionaries and sorting."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()

    def profile(texts):
        counts = defaultdict(int)
        for text in texts:
            words = re.findall(r"[^\W\d_]+", (text or "").lower())
            line = f" {' '.join(words)} " if words else ""
            for i in range(len(line)):
                for n in (1, 2, 3):
                    gram = line[i : i + n]
                    if len(gram) == n and gram != " ":
                        counts[gram] += 1
        code = lambda g: sum(ord(c) << s for c, s in zip(g, (42, 21, 0)))
        return {g: r for r, g in enumerate(sorted(counts, key=lambda g: (-counts[g], code(g)))[:400])}

    known = defaultdict(list)
    for r in rows:
        if crc(r.doc_id, 3) != 1 and r.lang is not None:
            known[r.lang].append(r.text)
    profiles = {lang: profile(texts) for lang, texts in sorted(known.items())}
    got = {r.doc_id: r for r in language_id.op7_language_id(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        own = profile([r.text])
        g = got[r.doc_id]
        assert g.held_out == (crc(r.doc_id, 3) == 1)
        if not own:
            assert (g.lang_pred, g.score) == ("und", 0.0)
            continue
        far = {lang: sum(abs(p[x] - i) if x in p else 400 for x, i in own.items()) for lang, p in profiles.items()}
        best = min(far, key=lambda lang: (far[lang], lang))
        assert g.lang_pred == best and g.score == pytest.approx(1 - far[best] / (400 * len(own)))


def test_quality_query_is_that_of_a_plain_model(spark, sf_dir):
    import math

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if crc(r.doc_id, 4) != 2 and r.quality is not None}
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sorted((d, q == 1, [float(np.float32(v)) for v in quality.features(texts[d])]) for d, q in labels.items() if d in texts)
    x, good = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    w = quality.fit_pairs(z[good], z[~good], 60_000)
    cut = float(np.quantile(z @ w, sum(q != 1 for q in labels.values()) / len(labels)))
    for r in quality.op8_quality(spark, sf_dir).collect():
        v = sum(a * min(8, max(-8, (f - m) / s)) for a, f, m, s in zip(w, quality.features(texts[r.doc_id]), mean, scale))
        want = 1 / (1 + math.exp(-min(30, max(-30, v - cut + math.log(0.7 / 0.3)))))
        assert r.held_out == (crc(r.doc_id, 4) == 2) and r.score == pytest.approx(want, abs=1e-6) and r.predicted == int(r.score >= 0.7)


def test_media_query_is_that_of_plain_bytes(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in iso_media.op9_media(spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for d, raw in texts.items():
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = iso_media.mux(payload)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert media.count(payload) == 1 and (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_foreign_containers_are_reported(spark):
    data = iso_media.mux(bytes(range(64)) * 3)
    put = lambda kind, at, value: data[: data.index(kind) + at] + struct.pack(">I", value) + data[data.index(kind) + at + 4 :]
    deep = b""
    for _ in range(3000):
        deep = iso_media.box(b"mdia", deep)
    deep = iso_media.box(b"moov", iso_media.box(b"trak", deep))
    bad = [put(b"stco", 12, 10**6), put(b"stco", 12, 2**32 - 1), deep, data.replace(b"trak", b"trax"), put(b"stsz", 8, 1)[:-1], put(b"stsz", 12, 2**31), put(b"stsz", 8, 2**31), put(b"stsc", 16, 2**31), put(b"stsc", 12, 7), put(b"stsc", 8, 2**31), put(b"stss", 12, 99)]
    rows = iso_media.media_columns(spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bad)], "id long, media binary")).collect()
    held = {r.id: r for r in rows}
    assert len(held) == len(bad)
    for i, r in held.items():
        if i == 3:
            assert r.payload_bytes == 0 and r.tracks == []
        elif i == 7:
            assert r.media_error is None and r.payload_bytes == 192  # more samples in a chunk than there are
        else:
            assert r.media_error and r.tracks is None and r.payload_bytes is None


def test_runs_are_read_as_they_lie(spark):
    """Batches merge-anti-join the runs, and runs merge, without a shuffle or sort on the runs' side."""
    from foliospark.llm.common import sorted_buckets

    def plan(df):
        with sorted_buckets(spark):
            return df._jdf.queryExecution().executedPlan().toString()

    def nodes_above_scans(text):
        """Names of the nodes between each file scan and the join or union above it."""
        lines = [line for line in text.split("\n") if line.strip()]
        found = []
        for i, line in enumerate(lines):
            if "FileScan" in line:
                depth, above = len(line) - len(line.lstrip(" :+-")), []
                for up in reversed(lines[:i]):
                    d = len(up) - len(up.lstrip(" :+-"))
                    if d < depth:
                        depth = d
                        above.append(up.strip(" :+-"))
                        if "Join" in up or "Union" in up:
                            break
                found.append(above)
        return found

    keys = spark.range(400).selectExpr("id % 50 AS h1", "id % 50 AS h2", "id AS doc_id")
    index = line_dedup.LineRuns(spark, fanout=9)
    index.add(keys.where("doc_id >= 200"))
    index.add(keys.where("doc_id between 100 and 199"))
    third = plan(index.unsettled(keys.where("doc_id < 100")))
    held = nodes_above_scans(third)
    assert len(held) == 2 and all(not any(w in line for line in above for w in ("Exchange", "Sort ")) for above in held), third
    both = plan(line_dedup.merged(*index.runs()))
    assert "Exchange" not in both and "Sort " not in both and "SortMergeJoin" in both
    assert {(r.h1, r.n_docs, r.last_doc) for r in index.table().collect()} == {(k, 4, 350 + k) for k in range(50)}


def test_quality_is_learned_from_all_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    whole, dealt = (quality.fit_ranking(docs, labels, max_rows=n) for n in (10**6, 150))
    assert np.allclose(whole["mean"], dealt["mean"]) and np.allclose(whole["scale"], dealt["scale"], atol=1e-5)
    scored = [{r.doc_id: r.score for r in quality.score_quality(docs, m).collect()} for m in (whole, dealt)]
    assert np.mean([abs(scored[1][d] - v) < 0.1 and (scored[1][d] >= 0.7) == (v >= 0.7) for d, v in scored[0].items()]) > 0.9


def test_exact_quantile(spark):
    v = np.concatenate([np.random.default_rng(3).normal(size=3000), np.full(500, 0.25)])
    for share in (0.0, 0.31, 0.6, 1.0):
        assert quality.quantile(spark.createDataFrame([(float(x),) for x in v], "v double"), share, len(v), few=20) == pytest.approx(float(np.quantile(v, share)), abs=1e-12)
