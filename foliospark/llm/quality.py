"""Quality classifier: Bradley-Terry pairwise ranking.

Document scores are learned from preference pairs (a good document over a bad one) by logistic loss on feature differences. The score
at the quantile that leaves as large a share below it as there are bad documents is the threshold; it maps to 0.7.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import read, scratch, staged

CUT = 0.7
_UPPER, _LOWER, _DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
_COMMON = np.frombuffer(b".,;:'\"()-?", np.uint8)
_SPACE = np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)


def features(text: str | None) -> list[float]:
    """Numbers about a whole text; shares come as they are and as logarithms. No labels, language, source or id."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw) or 1
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    space, upper, lower, digit, common = (int(hist[x].sum()) for x in (_SPACE, _UPPER, _LOWER, _DIGIT, _COMMON))
    wide = int(hist[128:].sum())
    odd = n - space - upper - lower - digit - common - wide
    words = raw.split()
    lines = raw.split(b"\n")
    w, k = len(words) or 1, len(lines)
    distinct = len(set(words))
    capital = sum(1 for x in words if 65 <= x[0] <= 90)
    shares = [
        upper / n, digit / n, common / n, max(odd, 0) / n, wide / n, int(hist[33]) / n, int(hist[124]) / n, int(hist[35:39].sum() + hist[42]) / n,
        capital / w, 1 - distinct / w, 1 - len(set(lines)) / k, k / n,
    ]
    packed = len(zlib.compress(raw, 1)) / n
    return [*shares, *(math.log(0.002 + s) for s in shares), packed, math.log(packed + 0.01), sum(map(len, words)) / w / 10, math.log(n), math.log(w), math.log(distinct + 1) / math.log(w + 1)]


def document_features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): a row per row of docs, from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float32()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<float>")


def fit_pairs(good: np.ndarray, bad: np.ndarray, pairs: int, ridge: float = 1e-3, steps: int = 25, seed: int = 7) -> np.ndarray:
    """Weights w that maximise the likelihood of good over bad, P = 1 / (1 + exp(-w (x_good - x_bad))), by Newton steps."""
    draw = np.random.default_rng(seed)
    diff = good[draw.integers(0, len(good), pairs)] - bad[draw.integers(0, len(bad), pairs)]
    w = np.zeros(diff.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        gradient = diff.T @ (1 - p) / pairs - ridge * w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_ranking(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, pairs: int = 60_000) -> dict | None:
    """Model from docs (doc_id, text) and labels (doc_id, quality); None unless both classes are there.

    All labelled documents are learned from. Up to max_rows labels the features of their documents come to the driver, which draws
    the pairs; more stay in Spark (fit_dealt), and three pairs are drawn for each of them. The share of bad documents is that of all labels.
    """
    known = labels.where("quality is not null").select(F.col("doc_id").alias("of"), "quality")
    total, bad_share = known.agg(F.count("*"), F.avg(F.when(F.col("quality") == 1, 0.0).otherwise(1.0))).first()
    if not total or bad_share in (0.0, 1.0):
        return None
    if total > max_rows:
        both = document_features(docs).join(known, F.col("doc_id") == F.col("of"))
        return fit_dealt(both.select("doc_id", "x", (F.col("quality") == 1).alias("good")), bad_share, max_rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(known.select("of").distinct()), F.col("doc_id") == F.col("of"), "left_semi")
    found: dict[int, list] = {}
    for r in document_features(chosen).collect():
        found.setdefault(r.doc_id, []).append(r.x)
    rows = sorted((r.of, r.quality == 1, x) for r in known.collect() for x in found.get(r.of, ()))
    x, y = np.array([r[2] for r in rows], float), np.array([r[1] for r in rows], bool)
    if not len(rows) or y.all() or not y.any():
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    w = fit_pairs(z[y], z[~y], pairs)
    return {"mean": mean, "scale": scale, "w": w, "cut": float(np.quantile(z @ w, bad_share))}


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a column of lists of equal length."""
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _summed(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of part (numbers of one shape) over the batches of df; a row of numbers a task comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + part(batch)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["v"])

    return sum(np.array(r.v) for r in df.mapInArrow(run, "v array<double>").collect())


def quantile(values: DataFrame, share: float, n: int, few: int = 10_000) -> float:
    """The exact quantile of the n numbers v of values, interpolated like numpy's: bins are counted, and the one with the wanted rank again, until it holds few numbers or one."""
    at = share * (n - 1)

    def ranked(rank: int) -> float:
        left = values
        while True:
            count, lo, hi = left.agg(F.count("*"), F.min("v"), F.max("v")).first()
            if lo == hi:
                return lo
            if count <= few:
                return sorted(r.v for r in left.collect())[rank]
            cell = F.least(F.floor((F.col("v") - lo) / (hi - lo) * 1000), F.lit(999))
            for r in sorted(left.groupBy(cell.alias("cell")).count().collect()):
                if rank < r["count"]:
                    left = left.where(cell == r.cell)
                    break
                rank -= r["count"]

    low = ranked(math.floor(at))
    return low if at == math.floor(at) else low + (ranked(math.floor(at) + 1) - low) * (at - math.floor(at))


def fit_dealt(rows: DataFrame, bad_share: float, deal: int = 20_000, ridge: float = 1e-3, steps: int = 25) -> dict | None:
    """The model of rows (doc_id, x, good), all of them, in Spark: sums, gradients and Hessians are added up over tasks.

    Rows are dealt by a hash of doc_id and features to groups of about `deal`. A group's pairs use each of its rows, three pairs a row. A class
    of fewer than 100 rows a group is dealt to every group.
    """
    with scratch():
        rows = staged(rows, "quality-rows")
        n, n_good = rows.agg(F.count("*"), F.count_if("good")).first()
        if n_good in (0, n):
            return None
        d = len(rows.first().x)
        moments = lambda b: np.stack([(x := _matrix(b.column(1))).sum(axis=0), (x * x).sum(axis=0)])
        first, second = _summed(rows, moments).reshape(2, d) / n
        mean, scale = first, np.sqrt(np.maximum(second - first * first, 0)) + 1e-6
        groups = max(1, n // deal)
        own = F.pmod(F.xxhash64("doc_id", "x"), F.lit(groups)).cast("int")
        rare = {good for good, held in ((True, n_good), (False, n - n_good)) if held < 100 * groups}
        everywhere = F.sequence(F.lit(0), F.lit(groups - 1))
        dealt = rows.withColumn("g", F.explode(F.when(F.col("good").isin(*rare), everywhere).otherwise(F.array(own)) if rare else F.array(own)))

        def drawn(part: pa.Table) -> pa.Table:
            g, good = part.column("g")[0].as_py(), np.asarray(part.column("good"))
            z = np.clip((_matrix(part.column("x").combine_chunks()) - mean) / scale, -8, 8).astype(np.float32)
            z = z[np.lexsort((*z.T, good))]
            good, draw = np.sort(good), np.random.default_rng(g)
            sides = []
            for side in (z[good], z[~good]):
                laps = -(-3 * len(z) // max(1, len(side)))
                sides.append(np.concatenate([side[draw.permutation(len(side))] for _ in range(laps)])[: 3 * len(z)])
            if not len(sides[0]) or not len(sides[1]):
                sides = [np.zeros((0, d), np.float32)] * 2
            diff = sides[0] - sides[1]
            return pa.table({"diff": pa.array([x.tobytes() for x in np.array_split(diff, max(1, len(diff) // 4000))], pa.binary())})

        pairs = staged(dealt.groupBy("g").applyInArrow(drawn, "diff binary"), "quality-pairs")
        w = np.zeros(d)
        for _ in range(steps):

            def slopes(batch: pa.RecordBatch, w: np.ndarray = w) -> np.ndarray:
                total = np.zeros((d + 2, d))
                for raw in batch.column(0):
                    diff = np.frombuffer(raw.as_py(), np.float32).reshape(-1, d).astype(float)
                    p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
                    total[0] += diff.T @ (1 - p)
                    total[1] += len(diff)
                    total[2:] += (diff * (p * (1 - p))[:, None]).T @ diff
                return total

            total = _summed(pairs, slopes).reshape(d + 2, d)
            step = np.linalg.solve(total[2:] / total[1, 0] + ridge * np.eye(d), total[0] / total[1, 0] - ridge * w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                z = np.clip((_matrix(batch.column(0)) - mean) / scale, -8, 8)
                yield pa.RecordBatch.from_arrays([pa.array(z @ w)], names=["v"])

        values = staged(rows.select("x").mapInArrow(score, "v double"), "quality-values")
        return {"mean": mean, "scale": scale, "w": w, "cut": quantile(values, bad_share, n)}


def score_rows(x: np.ndarray, model: dict | None) -> np.ndarray:
    if model is None or not len(x):
        return np.full(len(x), 0.5)
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["w"]
    return 1 / (1 + np.exp(-np.clip(z - model["cut"] + math.log(CUT / (1 - CUT)), -30, 30)))


def score_quality(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs plus score and predicted, from whole texts.

    Null and empty texts are scored like any other. Without a model every score is 0.5. Repeated rows are scored each, all
    columns pass through; own ones named score or predicted are replaced.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), "score double", "predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score_rows(np.array([features(t.as_py()) for t in batch.column(batch.num_columns - 1)], float), model)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32))], names=[*kept, "score", "predicted"])

    return docs.select(*kept, F.col("text").alias("__text")).mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs plus score and predicted; labels (doc_id, quality) are learned from and never applied.

    Labels without quality or without a document are not used; several labels of a document each count.
    """
    return score_quality(docs, fit_ranking(docs, labels))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    labels = read(spark, sf_dir, "labels").where(~held_out)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_quality(docs.select("doc_id", "text"), fit_ranking(docs, labels))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")
