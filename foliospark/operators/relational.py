"""Relational patterns of document analysis as DataFrame operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foliospark.storage import relation


def newest_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key with the largest order; an aggregate, so hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("best"))
    return best.select(*keys, "best.*")


def merge_newest(df: DataFrame, keys: list[str], values: list[str], order: Column) -> DataFrame:
    """Per key, each value's newest non-null: how trailers of an updated file merge."""
    return df.groupBy(*keys).agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), order)).alias(v) for v in values))


def asof(points: DataFrame, ranges: DataFrame, by: list[str], at: str, start: str, values: list[str]) -> DataFrame:
    """points with the values of the last range that starts at or before them: one union and one window, no range join."""
    held = F.struct(F.col(start).alias("__start"), *values)
    marks = ranges.select(*by, F.col(start).cast("long").alias("__at"), F.lit(0).alias("__kind"), held.alias("__held"), F.lit(None).cast(points.select(F.struct("*")).schema[0].dataType).alias("__row"))
    rows = points.select(*by, F.col(at).cast("long").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(marks.schema["__held"].dataType).alias("__held"), F.struct("*").alias("__row"))
    w = Window.partitionBy(*by).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = marks.unionByName(rows).withColumn("__held", F.last("__held", ignorenulls=True).over(w)).where("__kind = 1")
    return out.select("__row.*", F.col("__held.__start").alias(start), *(F.col(f"__held.{v}").alias(v) for v in values))


def fetch(refs: DataFrame, objects: DataFrame, on: list[str]) -> DataFrame:
    """Resolves references; a missing object gives nulls."""
    return refs.join(objects, on, "left")


def hidden_groups(members: DataFrame, off: DataFrame, group: str, member: str) -> DataFrame:
    """Membership groups all of whose members are switched off: what optional content hides."""
    marked = members.join(off.select(F.col(member), F.lit(True).alias("__off")), member, "left")
    return marked.groupBy(group).agg(F.bool_and(F.coalesce("__off", F.lit(False))).alias("hidden")).where("hidden").select(group)


def running_depth(df: DataFrame, by: list[str], order: list[str], opens: Column, closes: Column) -> DataFrame:
    """Nesting depth after each operation of a page."""
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    return df.withColumn("depth", F.sum(step).over(Window.partitionBy(*by).orderBy(*order)))


def islands(df: DataFrame, by: list[str], order: list[str], breaks: Column) -> DataFrame:
    """Numbers runs of rows: a new run begins where breaks holds (or is null, at the first row)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("island", F.sum(F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0)).over(w))


def match_places(texts: DataFrame, by: list[str], text: str, query: str) -> DataFrame:
    """(by, match_no, place): a row per non-overlapping match of query, ignoring case; by tells texts apart. Gaps between matches are summed by a window, so long texts with many matches take linear time."""
    pieces = F.split(F.lower(text), r"\Q" + query.lower() + r"\E", -1)
    gaps = texts.select(*by, F.posexplode(F.slice(pieces, F.lit(1), F.size(pieces) - 1)).alias("match_no", "gap"))
    till = F.sum(F.length("gap") + len(query)).over(Window.partitionBy(*by).orderBy("match_no"))
    return gaps.select(*by, "match_no", (till - len(query)).cast("int").alias("place"))


LINE = "line_no int, baseline double, height double, text string"


def coalesce_lines(runs: DataFrame, by: list[str], order: str = "ord") -> DataFrame:
    """Text runs (x, baseline, height, width, text) of a page joined to lines.

    A run stays on the line if its baseline is within 0.3 of its height of the line's, its height within a quarter of the line's,
    and it begins no more than half a height before the line's end; a gap over 0.2 heights gives a space. Baseline and height are
    those of the line's first run, so each run depends on where the line before it began: pages are dealt to tasks, sorted there,
    and read once in batches. A task holds a batch and the open line, a page may be of any length.
    """
    held = runs.where(F.length("text") > 0).select(*by, order, *(F.col(c).cast("double").alias(c) for c in ("x", "baseline", "height", "width")), "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held.select(*by).schema), LINE])
    names = [*by, *(c.split()[0] for c in LINE.split(", "))]

    def changed(column: pa.ChunkedArray) -> np.ndarray:
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        return np.asarray(pc.fill_null(pc.not_equal(a, b), False)) | (np.asarray(pc.is_null(a)) != np.asarray(pc.is_null(b)))

    def lines(rows: pa.Table, line_no: int) -> tuple[list, np.ndarray]:
        """Columns of the lines of rows, the first of which opens the line line_no; and where each line ends."""
        x, baseline, height, width = (rows.column(c).to_numpy() for c in ("x", "baseline", "height", "width"))
        end, n = x + width, len(x)
        page = np.concatenate([[True], reduce(np.logical_or, (changed(rows.column(c)) for c in by))])
        gap = np.concatenate([[0.0], x[1:] - end[:-1]])
        fits = np.concatenate([[False], x[1:] >= end[:-1] - height[1:] * 0.5]) & ~page
        alike = np.concatenate([[False], (baseline[1:] == baseline[:-1]) & (height[1:] == height[:-1]) & (height[1:] >= 0)])
        opens = ~fits  # a run like the one before it is as near to the line's first as that; others are compared with the first
        begin, seen = 0, 0
        for k in np.flatnonzero(fits & ~alike).tolist():
            earlier = np.flatnonzero(opens[seen:k])
            begin, seen = (seen + int(earlier[-1]) if len(earlier) else begin), k
            opens[k] = not (abs(baseline[k] - baseline[begin]) <= height[k] * 0.3 and abs(height[k] - height[begin]) <= height[begin] * 0.25)
        first = np.flatnonzero(opens)
        text = rows.column("text").combine_chunks()
        spaced = np.asarray(pc.ends_with(text.slice(0, n - 1), " ")) | np.asarray(pc.starts_with(text.slice(1), " "))
        space = ~opens & (gap > height * 0.2) & np.concatenate([[False], ~spaced])
        pieces = pc.if_else(pa.array(space), pc.binary_join_element_wise(pa.scalar(""), text, " "), text)
        bounds = np.append(first, n)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pieces), "")
        at = np.flatnonzero(page[first])
        numbers = np.arange(len(first)) - np.repeat(at, np.diff(np.append(at, len(first))))
        numbers[: at[1] if len(at) > 1 else None] += line_no
        keys = rows.select(by).take(pa.array(first))
        return [*(keys.column(c).combine_chunks() for c in by), pa.array(numbers.astype(np.int32)), pa.array(baseline[first]), pa.array(height[first]), joined], end[bounds[1:] - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, line_no = None, 0  # the open line as one run that ends where it ends
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]).drop_columns([order])
            rows = rows if left is None else pa.concat_tables([left.select(rows.column_names).cast(rows.schema), rows])
            # a new page begins at 0, the open line's goes on from its number
            out, ends = lines(rows, line_no)
            *keys, numbers, baseline, height, text = (c.slice(len(ends) - 1) for c in out)
            left, line_no = pa.table(dict(zip([*by, "x", "baseline", "height", "width", "text"], [*keys, pa.array(ends[-1:]), baseline, height, pa.array([0.0]), text]))), numbers[0].as_py()
            if len(ends) > 1:
                yield pa.RecordBatch.from_arrays([c.slice(0, len(ends) - 1) for c in out], names=names).cast(target)
        if left is not None:
            yield pa.RecordBatch.from_arrays([*(left.column(c).combine_chunks() for c in by), pa.array([line_no], pa.int32()), *(left.column(c).combine_chunks() for c in ("baseline", "height", "text"))], names=names).cast(target)

    target = to_arrow_schema(StructType.fromDDL(schema))
    return held.repartition(*by).sortWithinPartitions(*by, order).mapInArrow(run, schema)


def flatten_tree(nodes: DataFrame, inherited: list[str], sep: str = ".") -> DataFrame:
    """Walks (id, parent, name, inherited columns) from the roots (null parent) by a recursive query, however deep it goes.

    Gives id, parent, name, level, path (names joined by sep) and each inherited column from the nearest ancestor that has it.
    Ids have to be unique; then a node that is its own ancestor is never reached from a root. Nodes are written out first, since
    each level reads them, and so is the result, as the limits of recursion are lifted only while it is made.
    """
    spark, view = nodes.sparkSession, f"nodes_{uuid.uuid4().hex}"
    held = relation(nodes, "tree-nodes")
    limits = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": "-1"}
    before = {k: spark.conf.get(k) for k in limits}
    held.createOrReplaceTempView(view)
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        own = "".join(f", n.{c}" for c in inherited)
        down = "".join(f", coalesce(n.{c}, t.{c})" for c in inherited)
        names = "".join(f", {c}" for c in inherited)
        tree = spark.sql(f"""
            WITH RECURSIVE t(id, parent, name, level, path{names}) AS (
              SELECT n.id, n.parent, n.name, 0, n.name{own} FROM {view} n WHERE n.parent IS NULL
              UNION ALL
              SELECT n.id, n.parent, n.name, t.level + 1, concat(t.path, '{sep}', n.name){down}
              FROM {view} n JOIN t ON n.parent = t.id
            ) SELECT * FROM t""")
        return relation(tree, "tree", [held])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.catalog.dropTempView(view)


def tile_grid(cells: DataFrame, nx: Column, ny: Column, most: int | None = None) -> DataFrame:
    """A row per tile (ix, iy) of each cell pattern; with most, patterns of more tiles are left out, as a viewer does."""
    grid = (cells if most is None else cells.where(nx * ny <= most)).withColumn("ix", F.explode(F.sequence(F.lit(0), nx - 1)))
    return grid.withColumn("iy", F.explode(F.sequence(F.lit(0), ny - 1)))


def gradient_stops(shadings: DataFrame, t0: Column, t1: Column, stops: int = 24) -> DataFrame:
    """A row per stop of an axial or radial shading: its number, its place from 0 to 1 and its parameter."""
    out = shadings.withColumn("stop", F.explode(F.sequence(F.lit(0), F.lit(stops - 1)))).withColumn("place", F.col("stop") / (stops - 1))
    return out.withColumn("t", t0 + F.col("place") * (t1 - t0))
