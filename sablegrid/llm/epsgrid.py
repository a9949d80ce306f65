"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors whose cosine is c lie sqrt(2 - 2c) apart, and a projection brings no two points further
apart. Vectors are projected on the leading principal directions, and each gets its cell in a grid
whose cells are as wide as the largest distance of a link. Sorted by cell, the vectors form one
sequence, written as pieces with bounding boxes; neighbouring pieces form blocks, an eighth of the
sequence each as long as that fits a task. Sequence intervals are joined recursively, both across the
cluster (intervals of blocks, level by level) and inside a pair of blocks (intervals of short runs of
rows): a pair of intervals whose boxes are further apart than a link is skipped, others are split
until tiles are left, which are compared by a matrix product in double precision. Only blocks of which
some runs are near each other are shipped. A block pair sends back one count for each vector and a
spanning forest of its links, never the links themselves, so dense groups stay small. Equal vectors are
one class, joined once and counted by their number.

Vectors that spread evenly over many dimensions lie in cells that all touch, so that nothing between
them is provably distant: there the join compares all tiles, and what the blocks' size saves is shipping.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import U64, _mix
from .graph import components
from .session import arrow_rows, made, stage, sweep

DIRECTIONS, FANOUT = 8, 8
RUN, TILE = 64, 8  # rows of a run, which has a box, and runs of a tile, which is compared at once
SAMPLE = 10_000  # vectors that the principal directions are fitted on; any directions give whole results
LEAST_SAMPLE = 100  # vectors of a length from which its directions are fitted
APART = 10.0  # distance on the grid between vectors whose lengths differ by one
PIECE_BYTES = 512 << 10  # of the sequence in one row
BLOCKS, BLOCK_BYTES = 8, 8 << 20  # blocks that the sequence is cut into, or more so that none is larger


def _read(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (vec, dim, sig1, sig2, raw): raw is the vector in doubles, or null where it links with nothing."""
    schema = T.StructType([T.StructField("vec", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("sig1", T.LongType()), T.StructField("sig2", T.LongType()), T.StructField("raw", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 4096) for k in range(0, batch.num_rows, 4096)):
                lists = part.column(vec_col).cast(pa.large_list(pa.float64()))
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                flat = lists.flatten().to_numpy(zero_copy_only=False) + 0.0  # one zero only; nulls are not finite
                row, place = np.repeat(np.arange(len(sizes)), sizes), (np.arange(len(flat)) - np.repeat(ends[:-1], sizes)).astype(U64)
                odd, some = np.bincount(row[~np.isfinite(flat)], minlength=len(sizes)), np.bincount(row[flat != 0], minlength=len(sizes))
                good = part.column(id_col).is_valid().to_numpy(zero_copy_only=False) & (odd == 0) & (some > 0)
                sigs = []
                for seed in (1, 1 << 32):
                    total = np.concatenate([np.zeros(1, U64), np.cumsum(_mix(flat.view(U64) ^ _mix(place + U64(seed))), dtype=U64)])
                    sigs.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
                mask = pa.py_buffer(np.packbits(good, bitorder="little"))
                raws = pa.Array.from_buffers(pa.large_binary(), len(sizes), [mask, pa.py_buffer(8 * ends), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(id_col).cast(pa.int64()), pa.array(np.where(good, sizes, 0), pa.int32()), *map(pa.array, sigs), raws], names=schema.names)

    return df.select(id_col, vec_col).mapInArrow(run, schema)


def _unit(raws: list[bytes], rows: int | None = None) -> np.ndarray:
    x = np.frombuffer(b"".join(raws), np.float64).reshape(rows or len(raws), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _axes(sample: np.ndarray) -> np.ndarray:
    """Leading principal directions of unit vectors, with zeros where there are fewer."""
    middle = sample - sample.mean(0)
    _, vectors = np.linalg.eigh(middle.T @ middle)
    found = vectors[:, ::-1][:, :DIRECTIONS]
    return np.ascontiguousarray(np.pad(found, ((0, 0), (0, DIRECTIONS - found.shape[1]))))


class Directions:
    """The directions of each vector length: principal ones where the sample holds enough, else the first axes."""

    def __init__(self, classes: DataFrame):
        """From a bounded sample, the first vectors by a hash of the id."""
        rows = classes.orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).select("dim", "raw").collect()
        by_length: dict[int, list[bytes]] = {}
        for dim, raw in rows:
            by_length.setdefault(dim, []).append(bytes(raw))
        self.known = {dim: _axes(_unit(raws)) for dim, raws in by_length.items() if len(raws) >= LEAST_SAMPLE}

    def __getitem__(self, dim: int) -> np.ndarray:
        if dim not in self.known:
            return np.eye(dim, DIRECTIONS)
        return self.known[dim]


def _ordered(classes: DataFrame, shared, width: float) -> DataFrame:
    """Vectors in grid order: by length, cells on the directions, and a hash."""
    schema = T.StructType([T.StructField("vec", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("raw", T.BinaryType()), T.StructField("dim", T.IntegerType()), *(T.StructField(f"c{k}", T.IntegerType()) for k in range(DIRECTIONS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = shared.value
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.take(pa.array(np.flatnonzero(dims == dim)))
                cell = np.floor(_unit(own.column("raw").to_pylist()) @ directions[dim] / width).astype(np.int32)
                yield pa.RecordBatch.from_arrays([own.column("vec"), own.column("copies"), own.column("raw"), own.column("dim"), *map(pa.array, np.ascontiguousarray(cell.T))], names=schema.names)

    order = ["dim", *(f"c{k}" for k in range(DIRECTIONS)), F.xxhash64("vec")]  # the hash cuts a crowded cell
    return classes.select("vec", "copies", "raw", "dim").mapInArrow(run, schema).repartitionByRange(*order).sortWithinPartitions(*order)


def _pieces(ordered: DataFrame, shared) -> DataFrame:
    """The sequence as pieces: (dim, part, place, ids, copies, raw, low, high); place counts rows of the length and part before it.

    The first side of a box is the length, on a scale that sets different ones apart.
    """
    box = T.ArrayType(T.DoubleType())
    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("part", T.LongType()), T.StructField("place", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in ("ids", "copies", "raw")), T.StructField("low", box), T.StructField("high", box)])
    arrow = pa.schema([("dim", pa.int32()), ("part", pa.int64()), ("place", pa.int64()), ("ids", pa.binary()), ("copies", pa.binary()), ("raw", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions, part, place, held, now = shared.value, TaskContext.get().partitionId(), 0, [], None

        def send(table: pa.Table) -> pa.RecordBatch:
            raws = table.column("raw").to_pylist()
            at = _unit(raws) @ directions[now]
            ids, copies = (table.column(c).to_numpy().astype("<i8").tobytes() for c in ("vec", "copies"))
            apart = [float(APART * now)]
            return pa.RecordBatch.from_pylist([{"dim": now, "part": part, "place": place, "ids": ids, "copies": copies, "raw": b"".join(raws), "low": apart + at.min(0).tolist(), "high": apart + at.max(0).tolist()}], schema=arrow)

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if dims[a] != now:
                    if held:
                        yield send(pa.Table.from_batches(held))
                    now, place, held = int(dims[a]), 0, []
                held.append(batch.slice(a, b - a).select(["vec", "copies", "raw"]))
                rows = max(RUN, PIECE_BYTES // (8 * now))
                while sum(map(len, held)) >= rows:
                    table = pa.Table.from_batches(held)
                    yield send(table.slice(0, rows))
                    place, held = place + rows, [x for x in table.slice(rows).to_batches() if len(x)]
        if held:
            yield send(pa.Table.from_batches(held))

    return ordered.mapInArrow(run, schema)


def _in_blocks(pieces: DataFrame) -> tuple[DataFrame, int]:
    """The pieces with the number of their block, and the number of blocks; a block has one length of vectors."""
    parts = sorted(map(tuple, pieces.groupBy("dim", "part").agg(F.sum(F.octet_length("ids") / 8).cast("long")).collect()))  # a row for each partition of the sequence and length in it
    totals: dict[int, int] = {}
    for dim, _, n in parts:
        totals[dim] = totals.get(dim, 0) + n
    bases, first, seen, blocks = [], {}, {}, 0
    for dim, total in sorted(totals.items()):
        rows = max(RUN, min(-(-total // BLOCKS), BLOCK_BYTES // (8 * dim)))
        first[dim], blocks = (blocks, rows), blocks - (-total // rows)
    for dim, part, n in parts:
        bases.append((dim, part, seen.get(dim, 0), *first[dim]))
        seen[dim] = seen.get(dim, 0) + n
    table = pieces.sparkSession.createDataFrame(bases, "dim int, part long, base long, block0 long, rows long")
    numbered = pieces.join(F.broadcast(table), ["dim", "part"])
    return numbered.withColumn("block", F.col("block0") + F.floor((F.col("base") + F.col("place")) / F.col("rows"))).drop("base", "block0", "rows"), blocks


def _interval_pairs(boxes: DataFrame, count: int, far: float) -> DataFrame:
    """Pairs (i, j), i <= j, of blocks that are not provably distant; intervals are split level by level."""
    tops = 0
    while FANOUT**tops < count:
        tops += 1
    pairs = boxes.sparkSession.createDataFrame([(0, 0)], "i long, j long")
    for level in range(tops - 1, -1, -1):
        side = FANOUT**level
        node = F.floor(F.col("block") / side).alias("node")
        dims = range(DIRECTIONS + 1)
        merged = boxes.groupBy(node).agg(*(F.min(F.get("low", F.lit(k))).alias(f"l{k}") for k in dims), *(F.max(F.get("high", F.lit(k))).alias(f"h{k}") for k in dims))
        merged = stage(merged, "grid-boxes")
        one, two = (merged.select(*(F.col(c).alias(f"{c}{s}") for c in merged.columns)) for s in "ab")
        parts = F.sequence(F.lit(0), F.lit(FANOUT - 1))
        split = pairs.select((F.col("i") * FANOUT).alias("i"), (F.col("j") * FANOUT).alias("j"), F.explode(parts).alias("a")).select((F.col("i") + F.col("a")).alias("i"), "j", F.explode(parts).alias("b")).select("i", (F.col("j") + F.col("b")).alias("j")).where("i <= j")
        near = split.join(one, F.col("i") == F.col("nodea")).join(two, F.col("j") == F.col("nodeb"))
        gaps = (F.greatest(F.lit(0.0), F.col(f"l{k}a") - F.col(f"h{k}b"), F.col(f"l{k}b") - F.col(f"h{k}a")) for k in dims)
        total = sum((g * g for g in gaps), F.lit(0.0))
        pairs = stage(near.where(total <= far * far).select("i", "j"), "grid-pairs")
    return pairs


def _labels(joined: np.ndarray, n: int, m: int) -> np.ndarray:
    """Component labels of the two sides of a link matrix."""
    a, b = np.arange(n), np.arange(n, n + m)
    while True:
        new_a = np.minimum(a, np.where(joined, b, n + m).min(1))
        new_b = np.minimum(b, np.where(joined, new_a[:, None], n + m).min(0))
        if (new_a == a).all() and (new_b == b).all():
            return np.concatenate([a, b])
        a, b = new_a, new_b


def _forest(edges: list[np.ndarray], n: int) -> list[np.ndarray]:
    """At most n edges (node, smaller node) with the same components."""
    one, two = np.concatenate(edges, axis=1)
    label = np.arange(n)
    while True:
        low = np.minimum(label[one], label[two])
        new = label.copy()
        np.minimum.at(new, one, low)
        np.minimum.at(new, two, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(n))
    return [np.stack([node, label[node]])]


def _boxes(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and high corners of the runs."""
    starts = np.arange(0, len(at), RUN)
    return np.minimum.reduceat(at, starts), np.maximum.reduceat(at, starts)


def _tiles(boxes_x, boxes_y, same: bool, far: float) -> Iterator[tuple[int, int, int, int]]:
    """Intervals of runs (a, b, c, d) that are not provably distant, joined recursively."""
    (lx, hx), (ly, hy) = boxes_x, boxes_y
    todo = [(0, len(lx), 0, len(ly))]
    while todo:
        a, b, c, d = todo.pop()
        if same and d <= a:
            continue
        gap = np.maximum(0.0, np.maximum(lx[a:b].min(0) - hy[c:d].max(0), ly[c:d].min(0) - hx[a:b].max(0)))
        if (gap * gap).sum() > far * far:
            continue
        if b - a <= TILE and d - c <= TILE:
            yield a, b, c, d
            continue
        cut = lambda p, q: [(p, q)] if q - p <= TILE else [(p, (p + q) // 2), ((p + q) // 2, q)]
        todo += [(p, q, r, t) for (p, q), (r, t) in itertools.product(cut(a, b), cut(c, d))]


def _join_blocks(x, y, cx, cy, directions, same: bool, cosine: float, far: float):
    """Numbers of links of the rows of both blocks (copies counted) and a spanning forest over all rows."""
    boxes_x = _boxes(x @ directions)
    boxes_y = boxes_x if same else _boxes(y @ directions)
    n = len(x)
    nx, ny, edges, held = np.zeros(n, np.int64), np.zeros(len(y), np.int64), [], 0
    base = 0 if same else n
    for a, b, c, d in _tiles(boxes_x, boxes_y, same, far):
        a, b, c, d = a * RUN, min(b * RUN, n), c * RUN, min(d * RUN, len(y))
        links = x[a:b] @ y[c:d].T >= cosine
        if same:  # a tile across the diagonal counts what lies above it
            links &= np.arange(a, b)[:, None] < np.arange(c, d)
        if not links.any():
            continue
        rows, columns = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
        links = links[np.ix_(rows, columns)]
        nx[a + rows] += links @ cy[c + columns]
        ny[c + columns] += cx[a + rows] @ links
        label, node = _labels(links, len(rows), len(columns)), np.concatenate([a + rows, base + c + columns])
        tree = np.flatnonzero(label != np.arange(len(label)))
        edges.append(np.stack([node[tree], node[label[tree]]]))
        held += len(tree)
        if held > 1 << 20:
            edges = _forest(edges, base + len(y))
            held = edges[0].shape[1]
    if same:
        nx, ny = nx + ny, ny[:0]
    return nx, ny, _forest(edges, base + len(y))[0] if edges else np.zeros((2, 0), np.int64)


def _compare(pairs: DataFrame, pieces: DataFrame, shared, cosine: float, far: float) -> DataFrame:
    """Rows (a, n, b): a count of links of a, or a link of the spanning forest where b is set.

    Each block goes once to each of its pairs, piece by piece, and every pair is a group of its own.
    """
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("n", T.LongType()), T.StructField("b", T.LongType())])
    sides = F.when(F.col("i") == F.col("j"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    wanted = pairs.select("i", "j", F.explode(sides).alias("side")).withColumn("block", F.when(F.col("side") == 0, F.col("i")).otherwise(F.col("j")))
    data = pieces.join(wanted, "block").select("i", "j", "side", "part", "place", "ids", "copies", "raw")
    data = data.repartition("i", "j").sortWithinPartitions("i", "j", "side", "part", "place")

    def joined(pair: tuple[int, int], held: list[tuple]) -> Iterator[pa.RecordBatch]:
        sides = []
        for side in (0, 1) if pair[0] != pair[1] else (0,):
            own = [h[1:] for h in held if h[0] == side]
            ids, copies = (np.frombuffer(b"".join(h[k] for h in own), "<i8") for k in (0, 1))
            sides.append((ids, copies, _unit([h[2] for h in own], len(ids))))
        (ix, cx, x), (iy, cy, y) = sides[0], sides[-1]
        same = len(sides) == 1
        nx, ny, (one, two) = _join_blocks(x, y, cx, cy, shared.value[x.shape[1]], same, cosine, far)
        ids = ix if same else np.concatenate([ix, iy])
        who, n = np.concatenate([ix, iy[: len(ny)]]), np.concatenate([nx, ny])
        who, n = who[n > 0], n[n > 0]
        none = np.zeros(len(who), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([who, ids[one]])), pa.array(np.concatenate([n, np.zeros(len(one), np.int64)])), pa.array(np.concatenate([none, ids[two]]), mask=np.arange(len(who) + len(one)) < len(who))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "side", "ids", "copies", "raw")), strict=True):
                if (i, j) != now:
                    if held:
                        yield from joined(now, held)
                    now, held = (i, j), []
                held.append(tuple(row))
        if held:
            yield from joined(now, held)

    return data.mapInArrow(run, schema)


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """Components of vectors linked by a cosine of at least ``cosine``.

    Returns one row per input row: ``id_col`` (long), ``n_links`` (other vectors linked directly),
    ``component_id`` (smallest id reachable) and ``kept`` (the id is its component's). Vectors that
    are null, empty, zero or hold null or non-finite components, and rows without an id, link with
    nothing; so do vectors of different lengths. Equal vectors are linked; of rows that share an id
    but not a vector the links are added up. Other columns are not read; an empty table gives an
    empty result.
    """
    spark, mark = df.sparkSession, made()
    vectors = stage(_read(df, id_col, vec_col), "grid-vectors")
    good = vectors.where("raw is not null")
    classes = stage(good.groupBy("dim", "sig1", "sig2").agg(F.min("vec").alias("vec"), F.count(F.lit(1)).alias("copies"), F.first("raw").alias("raw")), "grid-classes")
    far = float(np.sqrt(2 - 2 * cosine)) * (1 + 1e-9)
    alone = vectors.where("raw is null").select("vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component_id"))
    if classes.isEmpty():
        return alone.select(F.col("vec").alias(id_col), "n_links", "component_id", F.lit(True).alias("kept"))
    shared = spark.sparkContext.broadcast(Directions(classes))  # at most SAMPLE / LEAST_SAMPLE small matrices
    pieces = stage(_pieces(_ordered(classes, shared, far), shared), "grid-blocks")
    pieces, blocks = _in_blocks(pieces)
    pairs = _interval_pairs(pieces.select("block", "low", "high"), blocks, far)
    with arrow_rows(spark, 8):
        found = stage(_compare(pairs, pieces, shared, cosine, far), "grid-links")
    labels = components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy(F.col("a").alias("vec")).agg(F.sum("n").alias("n"))
    out = classes.select("dim", "sig1", "sig2", F.col("vec").alias("rep"), "copies").join(counts.withColumnRenamed("vec", "rep"), "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    out = stage(out.select("dim", "sig1", "sig2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "grid-classes")
    sweep(mark, vectors, out)
    joined = good.select("vec", "dim", "sig1", "sig2").join(out, ["dim", "sig1", "sig2"]).select("vec", "n_links", "component_id")
    return joined.union(alone).select(F.col("vec").alias(id_col), "n_links", "component_id", F.coalesce(F.col("vec") == F.col("component_id"), F.lit(True)).alias("kept"))


#: ``vec_id, n_links, component_id, kept`` in DuckDB SQL, for ids without repeats.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, e, sqrt(list_sum([x * x FOR x IN e])) AS size FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL)
  WHERE len(e) > 0 AND NOT list_contains([x IS NULL OR NOT isfinite(x) FOR x IN e], true)),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.size > 0 AND b.size > 0 AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9),
reach(vec_id, node) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.node = l.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e JOIN (SELECT vec_id, min(node) AS c FROM reach GROUP BY vec_id) m USING (vec_id) LEFT JOIN n ON n.a = e.vec_id
"""
