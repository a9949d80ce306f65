"""N-gram Jaccard join of documents: a size-aware heavy-light set join.

Equal shingle sets are one class with one representative. A shingle's document frequency orders all
sets alike, rarest first: documents are cut into blocks, each block sends its shingles by hash range
as packed arrays, and gets back those that another set holds too. A set links only if at least its
smallest possible overlap is shared, which leaves near copies and lets all others go.

Of the rest, a light set (size up to a boundary) enumerates the two-element subsets of its prefix,
the shingles of which any partner must hold two; equal subsets meet. A heavy set is found by scanning
the inverted lists of its prefix. The boundary is the size at which subsets and scans cost least
together. Lists are not expanded to pairs. In rounds, each list's members are compared with one of
them, linked ones become one component, and a list within one component is done; this goes on while
a round halves what is open. Lists that are left are scanned where they lie, in blocks of bounded
size: members carry a parity sketch of their set, which bounds what two sets can share, and of the
pairs across components that it leaves each component offers its best few to the exact test. The
scan is repeated with more of them until no list has a pair that was not tested, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import U64, Texts, _mix, ascii_words, blocks, expand, hash_ranges
from .graph import components
from .session import arrow_rows, made, stage, sweep

WORDS = 5
SCAN_COST = 4
SKETCH_BITS = 2048  # of a set's parity sketch
LIST_BLOCK = 1024  # members of a list that are scanned against so many others in one task
SCAN_PAIRS = 1 << 20  # pairs that a task looks at together
OFFERS, MORE_OFFERS = 4, 8  # pairs that a component offers in the first scan of a list, and times more in each next one
ROWS = 256  # rows of packed sets in an Arrow batch
KEY_BITS = 56  # of a shingle's hash that decide pair tests; a range and 48 sent bits cover them
BLOCK_SHINGLES = 600_000  # shingles that a task holds before it sends them
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: Texts, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word shingles, sorted within each text, and the texts' bounds among them."""
    lower = Texts([])
    lower.bytes, lower.size = _LOWER[texts.bytes], texts.size
    begins, ends, firsts = ascii_words(texts)
    word = hash_ranges(lower.words8, begins, ends - begins)
    count = np.diff(firsts)
    shingles = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(texts.rows), shingles)
    at = expand(firsts[:-1], shingles)
    width = np.minimum(count, words)[row]
    h = _mix(width.astype(U64) + U64(11))
    padded = np.append(word, np.zeros(words, U64))
    for k in range(words):
        h = np.where(k < width, _mix(h * U64(0x9E3779B97F4A7C15) + padded[at + k]), h)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(texts.rows + 1))


def _signatures(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc", "n", "sig1", "sig2")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_col):
            h, bounds = shingle_sets(Texts(batch.column(text_col)), words)
            sums = [np.concatenate([np.zeros(1, U64), np.cumsum(_mix(h + U64(seed)))]) for seed in (1, 2)]
            sigs = [_mix(s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums]
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), *map(pa.array, (np.diff(bounds), *sigs))], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def _to_ranges(docs: DataFrame, bits: int, id_col: str, text_col: str, words: int) -> DataFrame:
    """Each block's shingles by hash range: 16-bit place in the block and the last 48 of ``KEY_BITS`` bits of the hash."""
    schema = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("docs", T.BinaryType()), T.StructField("entries", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def send() -> pa.RecordBatch:
            ids, sizes, h = (np.concatenate(x) for x in zip(*held, strict=True))
            place = np.repeat(np.arange(len(ids), dtype=np.uint16), sizes)
            order = np.argsort(h)
            h, place = h[order], place[order]
            part = (h >> U64(64 - bits)).astype(np.int64)
            key = h >> U64(64 - KEY_BITS)
            cuts = np.searchsorted(part, np.arange((1 << bits) + 1))
            used = np.flatnonzero(np.diff(cuts)).tolist()
            entries = [place[a:b].tobytes() + (key[a:b] >> U64(16)).astype("<u4").tobytes() + key[a:b].astype("<u2").tobytes() for a, b in ((cuts[r], cuts[r + 1]) for r in used)]
            table = ids.astype("<i8").tobytes() + sizes.astype("<i8").tobytes()
            # The table of the block's documents takes its way through some range.
            return pa.RecordBatch.from_arrays([pa.array([*used, block % (1 << bits)], pa.int32()), pa.array([block] * (len(used) + 1)), pa.array([*[None] * len(used), table], pa.binary()), pa.array([*entries, None], pa.binary())], names=schema.names)

        for batch in blocks(batches, text_col, 1 << 20):
            for piece in (batch.slice(k, 1 << 14) for k in range(0, batch.num_rows, 1 << 14)):
                h, bounds = shingle_sets(Texts(piece.column(text_col)), words)
                held.append((piece.column(id_col).cast(pa.int64()).to_numpy(), np.diff(bounds), h))
                if sum(len(x[2]) for x in held) > BLOCK_SHINGLES or sum(len(x[0]) for x in held) > 3 << 14:
                    yield send()
                    block, held = block + 1, []
        if held:
            yield send()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys with the sums of their counts, as one part."""
    key, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return [(key[first], np.add.reduceat(count, first))]


def _steps(frequency: np.ndarray) -> np.ndarray:
    """Frequencies in 16 bits: exact up to 2 ** 15, in steps of a 2048th of a power of two beyond."""
    high = (1 << 15) + np.floor(2048 * np.log2(np.maximum(frequency, 1 << 15) / (1 << 15)))
    return np.minimum(np.where(frequency < 1 << 15, frequency, high), 65535).astype("<u2")


def _to_blocks(ranges: DataFrame, bits: int) -> DataFrame:
    """Of each range, for each block the shingles that two sets or more hold, with their frequency.

    A range's rows come twice, sorted by Spark, which spills: first its distinct keys are counted, then
    each row is answered. A task holds the distinct keys of one range, however many sets hold them.
    """
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("docs", T.BinaryType()), T.StructField("entries", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, known = None, [], None
        for batch in batches:
            out: list[tuple] = []
            for r, turn, b, docs, raw in zip(*(batch.column(k).to_pylist() for k in ("range", "turn", "block", "docs", "entries")), strict=True):
                if r != now:
                    now, parts, known = r, [], None
                if docs is not None:
                    if turn == 0:
                        out.append((b, docs, None))
                    continue
                n = len(raw) // 8
                key = (U64(r) << U64(KEY_BITS - bits)) | (np.frombuffer(raw, "<u4", n, 2 * n).astype(U64) << U64(16)) | np.frombuffer(raw, "<u2", n, 6 * n)
                if turn == 0:
                    parts.append((key, np.ones(n, np.int64)))
                    if len(parts) > 1 and sum(len(k) for k, _ in parts[1:]) > max(1 << 20, len(parts[0][0])):
                        parts = _merged(parts)
                    continue
                if known is None:
                    key_of, count = _merged(parts)[0]
                    known, parts = (key_of[count > 1], _steps(count[count > 1])), []
                at = np.searchsorted(known[0], key)
                at[at == len(known[0])] = 0
                hit = np.flatnonzero(known[0][at] == key) if len(known[0]) else at[:0]
                if len(hit):
                    out.append((b, None, np.frombuffer(raw, "<u2", n)[hit].tobytes() + known[1][at[hit]].tobytes() + key[hit].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=schema.names)

    tasks = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ranges.repartitionById(tasks, F.shiftright(F.col("range").cast("long") * tasks, bits).cast("int"))  # neighbours go to one task
    twice = dealt.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"))
    return twice.sortWithinPartitions("range", "turn").mapInArrow(run, schema)


def _candidates(replies: DataFrame, percent: int) -> DataFrame:
    """Sets with enough shared shingles: size, number of shared ones, all of them rarest first, and the prefix.

    Replies come sorted by block, so that a task holds one block.
    """
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("n", T.LongType()), T.StructField("held", T.LongType()), T.StructField("shared", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))])

    def answer(table: bytes, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, sizes = np.frombuffer(table, "<i8").reshape(2, -1)
        cut = [len(p) // 12 for p in parts]
        place = np.concatenate([np.frombuffer(p, "<u2", n) for p, n in zip(parts, cut, strict=True)])
        frequency = np.concatenate([np.frombuffer(p, "<u2", n, 2 * n) for p, n in zip(parts, cut, strict=True)])
        key = np.concatenate([np.frombuffer(p, "<u8", n, 4 * n) for p, n in zip(parts, cut, strict=True)])
        held = np.bincount(place, minlength=len(ids))
        least = -(-sizes * percent // 100)
        # Two different sets are most alike when one is the other and one shingle more.
        good = (held >= least) & (held > 0) & (100 * sizes >= percent * (sizes + 1))
        docs = np.flatnonzero(good)
        if not len(docs):
            return
        keep = good[place]
        place, frequency, key = place[keep], frequency[keep], key[keep]
        key = key[np.lexsort((key, frequency, place))]
        ends = np.cumsum(held[docs])
        starts = ends - held[docs]
        room = np.minimum((held - least)[docs] + 2, held[docs])
        raw = key.view(np.int64)
        for a in range(0, len(docs), ROWS):
            z = a + ROWS
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[docs[a:z]]), pa.array(sizes[docs[a:z]]), pa.array(held[docs[a:z]]), pa.array([key[f:t].tobytes() for f, t in zip(starts[a:z], ends[a:z], strict=True)], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(room[a:z])]), pa.int32()), pa.array(raw[expand(starts[a:z], room[a:z])]))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table, parts = None, None, []
        for batch in batches:
            for b, docs, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if b != now:
                    if parts:
                        yield from answer(table, parts)
                    now, parts = b, []
                if docs is not None:
                    table = docs
                else:
                    parts.append(raw)
        if parts:
            yield from answer(table, parts)

    return replies.repartition("block").sortWithinPartitions("block").mapInArrow(run, schema)


def _boundary(sets: DataFrame) -> int:
    """The size up to which enumerating subsets costs less than scanning lists does.

    A subset is one row. A list's entry is a row too, met again by the list's pivot and, as one shingle
    selects less than two, by comparisons; ``SCAN_COST`` rows in all.
    """
    k = F.size("prefix")
    costs = sets.groupBy(F.ceil(2 * F.log2("n")).alias("step")).agg(F.sum(k * (k - 1) / 2).alias("subsets"), F.sum(SCAN_COST * k).alias("scan")).collect()  # a row for each half power of two
    costs = sorted((r["step"], float(r["subsets"]), float(r["scan"])) for r in costs)
    best = min(range(len(costs) + 1), key=lambda k: (sum(c[1] for c in costs[:k]) + sum(c[2] for c in costs[k:]), k))
    return int(2 ** (costs[best - 1][0] / 2)) if best else 0


def _entries(sets: DataFrame, boundary: int, percent: int) -> DataFrame:
    """Rows (key, doc, n, most, meets): equal keys may mean a link.

    ``most`` is the largest size of a partner for which this key can be the first that both hold: what
    comes after it in the set's order bounds the overlap.
    """
    k = F.size("prefix")
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), k - 1), lambda i: F.transform(F.slice("prefix", i + 1, k), lambda b, j: F.struct(F.xxhash64(F.lit(2), F.get("prefix", i - 1), b).alias("key"), (F.col("held") - i - j + 1).alias("rest")))))
    light = sets.where((F.col("n") <= boundary) & (k > 1)).select(F.inline(pairs), "doc", "n", F.lit(True).alias("meets"))
    single = F.transform(F.slice("prefix", 1, F.greatest(k - 1, F.lit(1))), lambda a, i: F.struct(F.xxhash64(F.lit(1), a).alias("key"), (F.col("held") - i).alias("rest")))
    heavy = sets.where(100 * F.col("n") > percent * boundary).select(F.inline(single), "doc", "n", (F.col("n") > boundary).alias("meets"))
    most = F.floor((100 + percent) * F.col("rest") / percent) - F.col("n")
    found = light.union(heavy)
    if 2 * percent <= 100:  # the smallest sets link by one shingle alone
        only = F.transform("prefix", lambda a, i: F.struct(F.xxhash64(F.lit(3), a).alias("key"), (F.col("held") - i).alias("rest")))
        found = found.union(sets.where(F.col("n") * percent <= 100).select(F.inline(only), "doc", "n", F.lit(True).alias("meets")))
    return found.select("key", "doc", "n", most.alias("most"), "meets")


def _fit(a: str, b: str, percent: int) -> Column:
    """Whether two entries of a key can be a link's first common one (columns n and most with suffixes)."""
    na, nb = F.col(f"n{a}"), F.col(f"n{b}")
    return (na <= F.col(f"most{b}")) & (nb <= F.col(f"most{a}")) & (100 * F.least(na, nb) >= percent * F.greatest(na, nb))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose similarity is enough, with ``linked``; all are returned."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("linked", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            both = np.array([len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), True)) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(100 * both >= percent * (na + nb - both))], names=schema.names)

    side = lambda c: sets.select(F.col("doc").alias(c), F.col("n").alias(f"n{c}"), F.col("shared").alias(f"s{c}"))
    with arrow_rows(pairs.sparkSession, ROWS):
        return stage(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, schema), "jaccard-pairs")


def _open_entries(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries, with their component, that may have a partner in another: by the bounds of their key.

    ``members`` is the number of the key's entries at least.
    """
    now = stage(entries.drop("component", "members").join(labels.withColumnRenamed("node", "doc"), "doc"), "jaccard-entries")
    keys = now.groupBy("key").agg(F.bool_or("meets").alias("any"), F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("smallest"), F.max("most").alias("largest"), F.count(F.lit(1)).alias("members"))
    keys = keys.where("any and low < high").select("key", "smallest", "largest", "members")
    return stage(now.join(keys, "key").where("n <= largest and smallest <= most").select("key", "doc", "n", "most", "meets", "component", "members"), "jaccard-entries")


def _with_one(entries: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of each key's members with one of them; of these a set takes the two that it meets most."""
    pivot = F.struct(F.xxhash64(F.lit(turn), "doc").alias("h"), F.col("doc").alias("pivot"), F.col("component").alias("of"), F.col("n").alias("n_p"), F.col("most").alias("most_p"))
    pivots = entries.groupBy("key").agg(F.min(pivot).alias("p")).select("key", "p.pivot", "p.of", "p.n_p", "p.most_p")
    met = entries.withColumnsRenamed({"n": "n_e", "most": "most_e"}).join(pivots, "key").where("component <> of").where(_fit("_e", "_p", percent))
    met = met.groupBy("doc", "pivot").agg(F.count(F.lit(1)).alias("times"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("times", "pivot")), False), 1, 2)
    return met.groupBy("doc").agg(best.alias("best")).select("doc", F.explode("best.pivot").alias("pivot")).select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b")).distinct()


def _sketches(sets: DataFrame) -> DataFrame:
    """Rows (doc, held, sketch): of each bit, whether an odd number of the set's shared shingles falls on it."""
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("held", T.LongType()), T.StructField("sketch", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("held").to_numpy()
            bit = _mix(np.frombuffer(b"".join(batch.column("shared").to_pylist()), "<u8")) % U64(SKETCH_BITS)
            odd = np.zeros((batch.num_rows, SKETCH_BITS // 64), U64)
            np.bitwise_xor.at(odd, (np.repeat(np.arange(batch.num_rows), held), (bit >> U64(6)).astype(np.int64)), U64(1) << (bit & U64(63)))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("held"), pa.array([x.tobytes() for x in odd], pa.binary())], names=schema.names)

    return sets.select("doc", "held", "shared").mapInArrow(run, schema)


def _scan(group: np.ndarray, block: np.ndarray, c: dict[str, np.ndarray], sketch: np.ndarray, percent: int, offers: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs (x, y) of places that whole lists offer, and whether they hold back others.

    ``group`` numbers the lists; where a list has two blocks, only pairs between them count.
    """
    n = len(group)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    two = np.repeat(np.minimum.reduceat(block, starts) != np.maximum.reduceat(block, starts), np.diff(np.append(starts, n)))
    after = np.arange(n) + 1
    kept, done = [], 0
    total = np.concatenate([[0], np.cumsum(ends - after)])
    while done < n:
        to = max(done + 1, int(np.searchsorted(total, total[done] + SCAN_PAIRS, "right")) - 1)
        count = (ends - after)[done:to]
        x, y = np.repeat(np.arange(done, to), count), expand(after[done:to], count)
        done = to
        good = (c["component"][x] != c["component"][y]) & (~two[x] | (block[x] != block[y])) & (c["meets"][x] | c["meets"][y])
        x, y = x[good], y[good]
        nx, ny = c["n"][x], c["n"][y]
        good = (nx <= c["most"][y]) & (ny <= c["most"][x]) & (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny))
        x, y = x[good], y[good]
        differ = np.concatenate([np.empty(0, np.int64), *(np.bitwise_count(sketch[x[k : k + 65536]] ^ sketch[y[k : k + 65536]]).sum(1, dtype=np.int64) for k in range(0, len(x), 65536))])
        # Two sets differ in one shingle for each odd bit at least, and what they share fills the rest.
        both, sizes = (c["held"][x] + c["held"][y] - differ) // 2, c["n"][x] + c["n"][y]
        good = (100 + percent) * both >= percent * sizes
        kept.append((x[good], y[good], (differ / sizes)[good]))
    x, y, far = (np.concatenate(k) for k in zip(*kept, strict=True))
    # Each component of a list offers its nearest pairs.
    who, pair = np.concatenate([c["component"][x], c["component"][y]]), np.tile(np.arange(len(x)), 2)
    order = np.lexsort((pair, far[pair], who, group[x][pair]))
    who, pair, of = who[order], pair[order], group[x][pair[order]]
    first = np.append(True, (who[1:] != who[:-1]) | (of[1:] != of[:-1]))[: len(who)]
    at = np.arange(len(who))
    rank = at - np.maximum.accumulate(np.where(first, at, 0)) if len(at) else at
    take = np.unique(pair[rank < offers])
    return x[take], y[take], len(take) < len(x)


def _scan_lists(entries: DataFrame, sketches: DataFrame, percent: int, offers: int) -> DataFrame:
    """Rows (a, b): pairs across components that the lists offer; a row of nulls says that there are more.

    A list of many members is cut into blocks of ``LIST_BLOCK``, and a task reads two of them at most.
    """
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    numbers = ("doc", "n", "most", "component", "held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def scan(table: pa.Table) -> Iterator[pa.RecordBatch]:
            c = {k: table.column(k).to_numpy() for k in (*numbers, "meets", "block", "key", "i", "j")}
            new = np.append(True, (c["key"][1:] != c["key"][:-1]) | (c["i"][1:] != c["i"][:-1]) | (c["j"][1:] != c["j"][:-1]))
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<u8").reshape(-1, SKETCH_BITS // 64)
            x, y, more = _scan(np.cumsum(new), c["block"], c, sketch, percent, offers)
            a, b = np.minimum(c["doc"][x], c["doc"][y]), np.maximum(c["doc"][x], c["doc"][y])
            a, b = np.unique(np.stack([a, b]), axis=1)
            nulls = pa.nulls(int(more), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(a), nulls]), pa.concat_arrays([pa.array(b), nulls])], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(map(len, held)) < 4 * LIST_BLOCK:
                continue
            table = pa.Table.from_batches(held)
            name = [table.column(k).to_numpy() for k in ("key", "i", "j")]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in name], axis=0))
            last = int(change[-1]) + 1 if len(change) else 0
            if last:  # the last list may go on in the next batch
                yield from scan(table.slice(0, last))
                held = table.slice(last).combine_chunks().to_batches()
        if held:
            yield from scan(pa.Table.from_batches(held))

    blocks_of = F.ceil(F.col("members") / LIST_BLOCK).cast("int")
    cut = entries.select("*", F.pmod(F.xxhash64(F.lit(5), "doc"), blocks_of.cast("long")).cast("int").alias("block"), blocks_of.alias("_blocks"))
    dealt = cut.select(*cut.columns, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    dealt = dealt.select("key", *numbers[:-1], "meets", "block", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j")).join(sketches, "doc")
    order = ("key", "i", "j")
    return dealt.select(*order, *numbers, "meets", "block", "sketch").repartition(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links: components are linked to each other, each pair once."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    between = links.join(of("a"), "a").join(of("b"), "b").where("a_of <> b_of").select(F.least("a_of", "b_of").alias("a"), F.greatest("a_of", "b_of").alias("b")).distinct()
    new = components(between).select(F.col("node").alias("component"), F.col("component").alias("under"))
    return stage(labels.join(new, "component", "left").select("node", F.coalesce("under", "component").alias("component")), "jaccard-labels")


def _near_components(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (node, component) of all sets."""
    labels = stage(sets.select(F.col("doc").alias("node"), F.col("doc").alias("component")).distinct(), "jaccard-labels")
    entries, tested, open_before, offers, turn = _entries(sets, _boundary(sets), percent), None, None, 0, 0
    while True:
        entries = _open_entries(entries, labels)
        left = entries.count()
        if not left:
            return labels
        # Every round either halves what is open or is followed by scans, which widen until nothing is held back.
        if offers or (open_before is not None and 2 * left > open_before):
            offers = offers * MORE_OFFERS or OFFERS
            sketches = _sketches(sets.join(entries.select("doc").distinct(), "doc", "left_semi"))
            with arrow_rows(sets.sparkSession, ROWS):
                offered = stage(_scan_lists(entries, sketches, percent, offers), "jaccard-offers")
            more, pairs = not offered.where("a is null").isEmpty(), offered.where("a is not null").distinct()
        else:
            more, pairs = True, _with_one(entries, turn, percent)
        turn, open_before = turn + 1, left
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        found = _links(pairs, sets, percent)
        tested = found if tested is None else tested.union(found)
        labels = _joined(labels, found.where("linked"))
        if not more:
            return labels


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = 75) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of at least ``percent`` in a hundred.

    A document's set is its distinct shingles of ``words`` words (ASCII white space between, A-Z in
    lower case); with fewer words the whole sequence is one. Returns one row per input row:
    ``id_col`` (long), ``n_shingles``, ``component_id`` (smallest id reachable). Null, empty and
    blank texts have an empty set and link with nothing. Rows that share an id are one document in
    the links between sets; a row without an id links with nothing and has no component. Hashes are
    of 64 bits (the first 56 of them in pair tests). Other columns are not read; an empty
    table gives an empty result.
    """
    spark, mark = df.sparkSession, made()
    signed = stage(_signatures(df, id_col, text_col, words), "jaccard-sets")
    filled = signed.where("n > 0 and doc is not null")
    classes = stage(filled.groupBy("n", "sig1", "sig2").agg(F.min("doc").alias("rep")), "jaccard-classes")
    docs = df.select(id_col, text_col).join(classes.select(F.col("rep").alias(id_col)).hint("merge"), id_col, "left_semi")
    bits = max(KEY_BITS - 48, min(16, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length()))  # a range or two for a task
    with arrow_rows(spark, ROWS):
        sets = stage(_candidates(_to_blocks(_to_ranges(docs, bits, id_col, text_col, words), bits), percent), "jaccard-candidates")
    labels = None if sets.isEmpty() else _near_components(sets, percent)
    if labels is not None:
        classes = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("rep", F.coalesce("component", "rep")).drop("component")
        classes = stage(classes, "jaccard-classes")
    sweep(mark, signed, classes)
    out = filled.join(classes, ["n", "sig1", "sig2"]).select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("rep").alias("component_id"))
    alone = signed.where("not (n > 0 and doc is not null)").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("doc").alias("component_id"))
    return out.union(alone)


#: ``doc_id, n_shingles, component_id`` in DuckDB SQL, for ids without repeats.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [hash(w)] ELSE list_distinct([hash(w[i:i + 4]) FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets),
shared AS (SELECT h FROM items GROUP BY h HAVING count(*) > 1),
rich AS (SELECT doc_id, n, h FROM items SEMI JOIN shared USING (h) QUALIFY 100 * count(*) OVER (PARTITION BY doc_id) >= 75 * n),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM rich a JOIN rich b ON a.h = b.h AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(doc_id, node) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.node = l.a)
SELECT s.doc_id, len(s.s) AS n_shingles, m.c AS component_id FROM sets s JOIN (SELECT doc_id, min(node) AS c FROM reach GROUP BY doc_id) m USING (doc_id)
"""
