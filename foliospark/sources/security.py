"""Decryption of PDF objects with the standard handler, revisions 2 to 6 (RC4, AES of 128 and 256 bits).

A file's key is derived once per file; keys join the objects on doc_id. AES and the hashes of revisions 5 and 6 are Column
expressions, RC4 and the keys of older revisions small Arrow UDFs. Files that need another password, or another handler, keep a
status instead of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.sources.syntax import COMMENT, HEX, LATIN, STRING, as_bytes, as_int, as_name, entries, every, get

#: Fixed value: the padding of passwords.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")
ROUNDS = 288  # the hash of revision 6 ends when a byte is at most its round less 32: by this round at the latest
EMPTY = bytearray()
SIDE = 2048  # rows that RC4 goes over side by side: half a MB of states
#: Text up to a string, and that string: what decrypt_strings cuts dictionaries into.
PIECE = rf"((?:{COMMENT}|<<|[^(<%]|(?!{STRING}|{HEX})[(<%])*+)({STRING}|{HEX})?"


def rc4(key: bytes, data: bytes) -> bytes:
    state, j = list(range(256)), 0
    for i in range(256):
        j = (j + state[i] + key[i % len(key)]) & 255
        state[i], state[j] = state[j], state[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + state[i]) & 255
        state[i], state[j] = state[j], state[i]
        out[n] = c ^ state[(state[i] + state[j]) & 255]
    return bytes(out)


def _rc4_rows(keys: np.ndarray, data: np.ndarray) -> np.ndarray:
    """RC4 of rows (n, bytes) side by side, each with its own key."""
    n, at = len(keys), np.arange(len(keys))
    state = np.repeat(np.arange(256, dtype=np.uint8)[:, None], n, axis=1)
    flat, j, turns = state.reshape(-1), np.zeros(n, np.uint8), np.ascontiguousarray(keys.T)
    place = lambda v: np.multiply(v, n, dtype=np.intp) + at
    for i in range(256):
        own = state[i].copy()
        j += own
        j += turns[i % len(turns)]
        other = place(j)
        state[i] = flat[other]
        flat[other] = own
    out, j = np.ascontiguousarray(data.T), np.zeros(n, np.uint8)
    for m in range(len(out)):
        i = (m + 1) & 255
        own = state[i].copy()
        j += own
        other = place(j)
        state[i] = flat[other]
        flat[other] = own
        out[m] ^= flat[place(own + state[i])]
    return np.ascontiguousarray(out.T)


def rc4_all(keys: Sequence[bytes], data: Sequence[bytes], turns: Iterable[int] = (0,)) -> list[bytes]:
    """RC4 of each datum by its key, once a turn, whose number each byte of the key is combined with; those of equal lengths go side by side."""
    out: list[bytes] = [b""] * len(keys)
    alike: dict[tuple[int, int], list[int]] = {}
    for at, (k, d) in enumerate(zip(keys, data, strict=True)):
        alike.setdefault((len(k), len(d)), []).append(at)
    for (long_key, long), found in alike.items():
        for begin in range(0, len(found), SIDE):
            some = found[begin : begin + SIDE]
            if len(some) < 8 or not long:
                for at in some:
                    out[at] = reduce(lambda d, t, k=keys[at]: rc4(bytes(x ^ t for x in k), d), turns, data[at])
                continue
            table = lambda values, width: np.frombuffer(b"".join(values[at] for at in some), np.uint8).reshape(-1, width)
            held, rows = table(keys, long_key), table(data, long)
            for t in turns:
                rows = _rc4_rows(held ^ np.uint8(t), rows)
            whole = rows.tobytes()
            for i, at in enumerate(some):
                out[at] = whole[i * long : (i + 1) * long]
    return out


def user_key(password: bytes, o: bytes, p: int, file_id: bytes, revision: int, n: int, metadata: bool) -> bytes:
    more = b"\xff\xff\xff\xff" if revision >= 4 and not metadata else b""
    key = hashlib.md5((password + PAD)[:32] + o + (p & 0xFFFFFFFF).to_bytes(4, "little") + file_id + more).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key[:n]).digest()
    return key[:n]


def _by_revision(revisions: Sequence[int], run: Callable[[list[int], range], list[bytes]], later: range) -> list[bytes]:
    """run over the places of files of revision 2 (one turn) and of later ones."""
    out: list[bytes] = [b""] * len(revisions)
    for turns, some in ((range(1), [i for i, r in enumerate(revisions) if r == 2]), (later, [i for i, r in enumerate(revisions) if r != 2])):
        for i, value in zip(some, run(some, turns), strict=True):
            out[i] = value
    return out


def user_checks(keys: Sequence[bytes], file_ids: Sequence[bytes], revisions: Sequence[int]) -> list[bytes]:
    """What /U begins with, by the file's key."""
    begin = [PAD if r == 2 else hashlib.md5(PAD + f).digest() for f, r in zip(file_ids, revisions, strict=True)]
    return _by_revision(revisions, lambda some, turns: rc4_all([keys[i] for i in some], [begin[i] for i in some], turns), range(20))


def user_check(key: bytes, file_id: bytes, revision: int) -> bytes:
    return user_checks([key], [file_id], [revision])[0]


def owner_key(password: bytes, revision: int) -> bytes:
    key = hashlib.md5((password + PAD)[:32]).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key).digest()
    return key


def owners_to_users(passwords: Sequence[bytes], o: Sequence[bytes], revisions: Sequence[int], n: Sequence[int]) -> list[bytes]:
    """The padded user passwords that the owners' passwords open."""
    keys = [owner_key(p, r)[:size] for p, r, size in zip(passwords, revisions, n, strict=True)]
    return _by_revision(revisions, lambda some, turns: rc4_all([keys[i] for i in some], [o[i] for i in some], turns), range(19, -1, -1))


def legacy_keys(rows: Sequence[tuple]) -> list[bytes | None]:
    """The keys of files (password, o, u, p, file_id, revision, n, metadata) that the password opens as its user's or its owner's, of revisions 2 to 4; None if neither. Passwords are tried as UTF-8 and as ISO-8859-1.

    Each way is tried for all the files that are still closed, side by side.
    """
    found: list[bytes | None] = [None] * len(rows)
    ways = [tuple(dict.fromkeys(((r[0] or "").encode(), (r[0] or "").encode("latin-1", "replace")))) for r in rows]
    closed = [i for i, r in enumerate(rows) if r[5] in (2, 3, 4)]
    for way in range(2):
        for by_owner in (False, True):
            closed = [i for i in closed if found[i] is None]
            some = [i for i in closed if way < len(ways[i])]
            given = [ways[i][way] for i in some]
            if by_owner:
                given = owners_to_users(given, *([rows[i][c] for i in some] for c in (1, 5, 6)))
            keys = [user_key(g, rows[i][1], *rows[i][3:]) for g, i in zip(given, some, strict=True)]
            checks = user_checks(keys, [rows[i][4] for i in some], [rows[i][5] for i in some])
            for i, key, check in zip(some, keys, checks, strict=True):
                u, least = rows[i][2], 32 if rows[i][5] == 2 else 16
                if not u or (len(u) >= least and check[:least] == u[:least]):
                    found[i] = key
    return found


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def byte(data: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(data, F.lit(at), F.lit(1))), 16, 10).cast("int")


def sealed(data: Column, key: Column, iv: Column) -> Column:
    """AES-CBC of data and padding, without the initial vector."""
    return F.substring(F.aes_encrypt(data, key, F.lit("CBC"), F.lit("PKCS"), iv), F.lit(17), F.lit(1 << 30))


def opened_blocks(data: Column, key: Column, iv: Column) -> Column:
    """Whole AES-CBC blocks decrypted, whatever they end in: a block of padding that continues them is put behind, since Spark wants one."""
    whole = (F.octet_length(data) >= 16) & (F.octet_length(data) % 16 == 0) & F.octet_length(key).isin(16, 24, 32)
    padding = sealed(F.lit(EMPTY), key, F.substring(data, F.lit(-16), F.lit(16)))
    return F.when(whole, F.aes_decrypt(F.concat(iv, data, padding), key, F.lit("CBC"), F.lit("PKCS")))


def opened(data: Column, key: Column) -> Column:
    """AES data behind their initial vector, decrypted, without padding if there is any; empty where they are not whole blocks."""
    blocks = opened_blocks(F.substring(data, F.lit(17), F.lit(1 << 30)), key, F.substring(data, F.lit(1), F.lit(16)))
    cut = lambda d: F.when(byte(d, -1).between(1, 16), F.substring(d, F.lit(1), F.octet_length(d) - byte(d, -1))).otherwise(d)
    return F.when(data.isNotNull(), F.coalesce(let(blocks, cut), F.lit(EMPTY)))


def hardened_hash(password: Column, salt: Column, more: Column) -> Column:
    """The hash of revision 6: rounds encrypt 64 copies of password, last digest and more, and choose the next digest by what comes out."""
    digest = lambda d, bits: F.unhex(F.sha2(d, bits))
    word = lambda e, i: F.conv(F.hex(F.substring(e, F.lit(4 * i + 1), F.lit(4))), 16, 10).cast("long")

    def after(e: Column) -> Column:
        by = (word(e, 0) + word(e, 1) + word(e, 2) + word(e, 3)) % 3  # as the sum of 16 bytes, since 256 leaves 1
        return F.struct(let(by, lambda b: F.when(b == 0, digest(e, 256)).when(b == 1, digest(e, 384)).otherwise(digest(e, 512))).alias("k"), byte(e, -1).alias("last"))

    def turn(state: Column, n: Column) -> Column:
        k = state["k"]
        eight = let(F.concat(password, k, more), lambda c: F.concat(*[c] * 8))
        part = lambda at: F.substring(k, F.lit(at), F.lit(16))
        made = let(let(eight, lambda c: F.concat(*[c] * 8)), lambda c: F.substring(F.aes_encrypt(c, part(1), F.lit("CBC"), F.lit("PKCS"), part(17)), F.lit(17), F.octet_length(c)))
        return F.when((n >= 64) & (state["last"] <= n - 32), state).otherwise(let(made, after))

    begin = F.struct(digest(F.concat(password, salt, more), 256).alias("k"), F.lit(0).alias("last"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, turn, lambda s: F.substring(s["k"], F.lit(1), F.lit(32)))


def salted_hash(password: Column, salt: Column, more: Column, revision: Column) -> Column:
    return F.when(revision == 5, F.unhex(F.sha2(F.concat(password, salt, more), 256))).otherwise(hardened_hash(password, salt, more))


def wrapped_key(password: Column, o: Column, u: Column, oe: Column, ue: Column, revision: Column) -> Column:
    """The key of a file of revision 5 or 6 that the password opens as its user's or its owner's; null if neither."""
    part = lambda d, at, n: F.substring(d, F.lit(at), F.lit(n))
    long_, none = (lambda d, n: F.octet_length(d) >= n), F.lit(EMPTY)
    by_user = long_(ue, 32) & (salted_hash(password, part(u, 33, 8), none, revision) == part(u, 1, 32))
    by_owner = long_(o, 48) & long_(oe, 32) & (salted_hash(password, part(o, 33, 8), part(u, 1, 48), revision) == part(o, 1, 32))
    way = lambda salt, more, held: F.struct(salt.alias("salt"), more.alias("more"), part(held, 1, 32).alias("held"))
    found = F.when(by_user, way(part(u, 41, 8), none, ue)).when(by_owner, way(part(o, 41, 8), part(u, 1, 48), oe))
    unwrapped = lambda w: let(salted_hash(password, w["salt"], w["more"], revision), lambda key: opened_blocks(w["held"], key, F.lit(bytearray(16))))
    return let(found, lambda w: F.when(w.isNotNull(), unwrapped(w)))


def crypt_filter(e: Column, which: str) -> Column:
    """What an encryption dictionary says of streams (StmF) or strings (StrF): rc4, aes, aes256 or none."""
    v, name, filters = as_int(get(e, "V")), F.coalesce(as_name(get(e, which)), F.lit("Identity")), get(e, "CF")
    own = F.try_element_at(F.filter(entries(filters), lambda x: x["k"] == name), F.lit(-1))["v"]
    method = F.coalesce(as_name(get(entries(own), "CFM")), F.lit("V2"))
    by_method = F.when(method == "AESV2", "aes").when(method == "AESV3", "aes256").when(method == "Identity", "none").otherwise("rc4")
    listed = F.when(name == "Identity", "none").when(F.startswith(own, F.lit("<<")), by_method).otherwise("rc4")
    return F.when(v >= 5, "aes256").when((v == 4) & F.startswith(filters, F.lit("<<")), listed).otherwise("rc4")


def file_keys(dicts: DataFrame) -> DataFrame:
    """(doc_id, status, key, streams, strings) of encrypted files (doc_id, dict, file_id, password): dict is the text of the encryption dictionary, a null password is the empty one.

    status is ok, need_password (none was given), bad_password, malformed (revision 5 or 6 without what passwords are checked by) or
    unsupported; key is null unless ok. streams and strings name the ciphers of these.
    """

    @F.pandas_udf("binary")
    def legacy(password: pd.Series, o: pd.Series, u: pd.Series, p: pd.Series, file_id: pd.Series, revision: pd.Series, n: pd.Series, metadata: pd.Series) -> pd.Series:
        return pd.Series(legacy_keys(list(zip(password, o, u, p, file_id, revision, n, metadata))), dtype=object)

    e = F.col("entries")
    whole = lambda k, default: F.coalesce(as_int(get(e, k)), F.lit(default).cast("long"))
    held = lambda k: F.coalesce(F.encode(as_bytes(get(e, k)), LATIN), F.lit(EMPTY))
    size = F.when(F.col("r") == 2, 5).otherwise(F.greatest(F.least(F.floor(whole("Length", 40) / 8), F.lit(16)), F.lit(5)))
    size = F.when((F.col("v") == 4) & get(e, "Length").isNull(), 16).otherwise(size)
    read = dicts.withColumn("entries", entries(F.col("dict"))).withColumn("v", whole("V", 0)).withColumn("r", whole("R", 0))
    read = read.select(
        "doc_id", "password", "r", F.coalesce("file_id", F.lit(EMPTY)).alias("file_id"), *(held(k).alias(k.lower()) for k in ("O", "U", "OE", "UE")), whole("P", 0).alias("p"), size.cast("int").alias("n"),
        F.coalesce(get(e, "EncryptMetadata") != "false", F.lit(True)).alias("metadata"), (as_name(get(e, "Filter")) == "Standard").alias("known"), crypt_filter(e, "StmF").alias("streams"), crypt_filter(e, "StrF").alias("strings"),
    )
    old = legacy("password", F.substring("o", 1, 32), F.substring("u", 1, 32), "p", "file_id", "r", "n", "metadata")
    given = F.encode(F.coalesce("password", F.lit("")), "UTF-8")
    new = F.when(F.col("r").isin(5, 6) & (F.octet_length("u") >= 48), wrapped_key(given, *map(F.col, ("o", "u", "oe", "ue", "r"))))
    keyed = read.withColumn("key", F.when(F.col("r").between(2, 4), old).otherwise(new))
    failed = F.when(F.col("password").isNull(), "need_password").otherwise("bad_password")
    able = F.coalesce(F.col("known"), F.lit(False)) & F.col("r").between(2, 6)
    status = F.when(~able, "unsupported").when((F.col("r") >= 5) & (F.octet_length("u") < 48), "malformed").when(F.col("key").isNull(), failed).otherwise("ok")
    return keyed.select("doc_id", status.alias("status"), F.when(able, F.col("key")).alias("key"), "streams", "strings")


def object_key(key: Column, num: Column, gen: Column, aes: bool) -> Column:
    """The key of one object: a digest of the file's key and the object's numbers."""
    little = lambda v, n: F.unhex(F.array_join(F.array(*(F.lpad(F.hex(F.floor(v / 256**i) % 256), 2, "0") for i in range(n))), ""))
    salt = [F.lit(bytearray(b"sAlT"))] if aes else []
    digest = F.unhex(F.md5(F.concat(key, little(num, 3), little(gen, 2), *salt)))
    return F.substring(digest, F.lit(1), F.least(F.octet_length(key) + 5, F.lit(16)))


def by_aes(data: Column, key: Column, num: Column, gen: Column, cipher: Column) -> Column:
    return F.when(cipher == "aes256", opened(data, key)).otherwise(opened(data, object_key(key, num, gen, True)))


def decrypt(data: Column, key: Column, num: Column, gen: Column, cipher: Column) -> Column:
    """Bytes of a stream decrypted; AES data that are no whole blocks are empty."""

    @F.pandas_udf("binary")
    def run(data: pd.Series, key: pd.Series) -> pd.Series:
        there = [i for i, (d, k) in enumerate(zip(data, key)) if d is not None and k is not None]
        out = pd.Series([None] * len(data), dtype=object)
        out.iloc[there] = rc4_all([key.iloc[i] for i in there], [data.iloc[i] for i in there])
        return out

    coded = F.when(cipher == "rc4", data)  # other data need not go to Python
    return F.when(cipher == "none", data).when(cipher == "rc4", run(coded, object_key(key, num, gen, False))).otherwise(by_aes(data, key, num, gen, cipher))


def decrypt_strings(d: Column, key: Column, num: Column, gen: Column, cipher: Column) -> Column:
    """A value's text whose strings, at any depth, are decrypted and written as hex; what else is there stays as it is."""

    @F.pandas_udf("array<binary>")
    def run(data: pd.Series, key: pd.Series) -> pd.Series:
        there = [(i, at) for i, (d, k) in enumerate(zip(data, key)) if d is not None and k is not None for at, x in enumerate(d) if x is not None]
        done = rc4_all([key.iloc[i] for i, _ in there], [data.iloc[i][at] for i, at in there])
        out = [None if d is None or k is None else [None] * len(d) for d, k in zip(data, key)]
        for (i, at), x in zip(there, done, strict=True):
            out[i][at] = x
        return pd.Series(out, dtype=object)

    coded = F.transform(every(d, PIECE, 2), lambda s: F.encode(as_bytes(F.nullif(s, F.lit(""))), LATIN))
    plain = F.when(cipher == "rc4", run(F.when(cipher == "rc4", coded), object_key(key, num, gen, False))).otherwise(F.transform(coded, lambda s: by_aes(s, key, num, gen, cipher)))
    written = F.zip_with(every(d, PIECE, 1), plain, lambda gap, s: F.concat(gap, F.coalesce(F.concat(F.lit("<"), F.hex(s), F.lit(">")), F.lit(""))))
    return F.when(cipher == "none", d).otherwise(F.array_join(written, ""))
