"""Exact top-k search by inner product over a bit-sliced index.

Vectors are quantised and dealt into blocks by a hash of their ids.  A block keeps,
for every component and every bit of its value, one bitmap over the block's rows.
A query's scores of all rows of a block come from adding those bitmaps: a bit of
weight 2**j of the query's component and the bitmap of weight 2**b make one summand
of weight 2**(j+b), and summands are added column by column with full adders.
Negative components add the complement, which differs by a constant.  The best rows
are read off the sum's bitmaps from the most significant one down, and what is left
at the boundary is resolved by id.  Nothing is estimated, so nothing is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyarrow.compute import struct_field
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import written

BLOCK_ROWS = 8_192
CHUNK_QUERIES = 512
CELL_QUERIES = 65_536  # whose best rows a task keeps
CELL_BYTES = 64 << 20  # of the index, or of queries, that a task reads
CELLS_A_CORE = 4
ANSWER_BYTES = 24  # of one row found, shuffled
BLOCK_FIELDS = ("rows", "dims", "bits", "low", "ids", "names", "slices")
SCALE = 64
LARGEST = 1 << 57  # size of a quantised component: products of up to 4,096 of them fit a decimal of 38 digits
PLAIN_BITS = 62  # scores that surely fit are summed as machine integers


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``row, vec_id, v``: floor(scale * x) of every component, and a number that tells rows apart.

    Vectors with a null id, null or null or non-finite components take no part.  A
    component of 2**57 or more in size is an error: its scores could not be returned.
    """

    def bad(x: Column) -> Column:
        x = x.cast("double")
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    def step(x: Column) -> Column:
        scaled = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double") * scale) < float(LARGEST), scaled).otherwise(
            F.raise_error(F.lit(f"a component times {scale} is 2**57 or more in size")).cast("long")
        )

    whole = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad))
    told = whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", step).alias("v"))
    # written, so that a row keeps its number whichever executor reads it
    return written(told.withColumn("row", F.monotonically_increasing_id()), "vectors").select("row", "vec_id", "v")


def _matrix(values: pa.ListArray) -> np.ndarray:
    """Vectors as rows; short ones are filled up with zeros."""
    lengths = values.value_lengths().to_numpy().astype(np.int64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values.flatten().to_numpy()
    return out


def index(vectors: DataFrame) -> DataFrame:
    """``block, rows, dims, bits, low, ids, names, slices``: one row per block of ``row, vec_id, v``.

    ``ids`` ascend and ``names`` are their rows' numbers; ``slices`` holds dims x bits bitmaps of 64-bit words, of the
    components less ``low``, the block's least component.
    """
    blocks = max(1, -(-vectors.count() // BLOCK_ROWS))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))

    def sliced(block: int, ids: np.ndarray, names: np.ndarray, values: np.ndarray) -> dict:
        order = np.lexsort((names, ids))
        ids, names, values = ids[order], names[order], values[order]
        low = int(values.min(initial=0))
        bits = max(1, int(values.max(initial=0) - low).bit_length())
        words = -(-len(ids) // 64)
        raw = np.zeros((values.shape[1], bits, words * 8), np.uint8)
        for bit in range(bits):
            packed = np.packbits(((values.T - low) >> bit & 1).astype(np.uint8), axis=1, bitorder="little")
            raw[:, bit, : packed.shape[1]] = packed
        return {"block": block, "rows": len(ids), "dims": values.shape[1], "bits": bits, "low": low,
                "ids": ids.astype("<i8").tobytes(), "names": names.astype("<i8").tobytes(), "slices": raw.tobytes()}

    schema = pa.schema([("block", pa.int32()), ("rows", pa.int32()), ("dims", pa.int32()), ("bits", pa.int32()),
                        ("low", pa.int64()), ("ids", pa.binary()), ("names", pa.binary()), ("slices", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(kept).combine_chunks()
            ids = table.column("vec_id").to_numpy()
            names = table.column("row").to_numpy()
            row = sliced(table.column("block")[0].as_py(), ids, names, _matrix(table.column("v").combine_chunks()))
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(bounds, bounds[1:]):
                if a == b:
                    continue
                if kept and kept[-1].column("block")[0].as_py() != blocks[a]:
                    yield done()
                    kept = []
                kept.append(batch.slice(a, b - a))
        if kept:
            yield done()

    ready = dealt.select("block", "row", "vec_id", "v").repartition("block").sortWithinPartitions("block")
    return ready.mapInArrow(run, "block int, rows int, dims int, bits int, low long, ids binary, names binary, slices binary")


def added(columns: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Sum of bitmaps: ``columns[w]`` holds stacks of those of weight 2**w; returns the sum's bitmaps."""
    result, weight = [], 0
    while columns:
        stacks = columns.pop(weight, [])
        stack = np.concatenate(stacks) if len(stacks) > 1 else stacks[0] if stacks else None
        while stack is not None and len(stack) > 1:
            third = len(stack) // 3
            if third:  # full adders: three of a weight make one of it and one of the next
                a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                odd = a ^ b
                columns.setdefault(weight + 1, []).append((a & b) | (odd & c))
                stack = np.concatenate([odd ^ c, stack[3 * third :]]) if len(stack) > 3 * third else odd ^ c
            else:
                columns.setdefault(weight + 1, []).append(stack[:1] & stack[1:])
                stack = stack[:1] ^ stack[1:]
        result.append(None if stack is None else stack[0])
        weight += 1
    return result


def best_rows(sums: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the ``k`` largest sums among the rows of a bitmap; ties go to the smaller row number."""
    certain, open_ = np.zeros_like(among), among
    for bitmap in reversed(sums):
        ahead = open_ & bitmap
        size = int(np.bitwise_count(certain | ahead).sum())
        if size > k:
            open_ = ahead
        elif size < k:
            certain, open_ = certain | ahead, open_ & ~bitmap
        else:
            certain, open_ = certain | ahead, np.zeros_like(among)
            break
    rows, rest = _rows(certain), _rows(open_)
    return np.concatenate([rows, rest[: k - len(rows)]])


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


class Block:
    """One block of the index, ready for queries."""

    def __init__(self, rows: int, dims: int, bits: int, low: int, ids: bytes, names: bytes, slices: bytes) -> None:
        self.low, self.bits = low, bits
        self.ids, self.names = np.frombuffer(ids, "<i8"), np.frombuffer(names, "<i8")
        words = -(-rows // 64)
        plain = np.frombuffer(slices, np.uint64).reshape(dims, bits, words)
        self.slices = np.stack([plain, ~plain])
        valid = np.zeros(words * 64, np.uint8)
        valid[:rows] = 1
        self.valid = np.packbits(valid, bitorder="little").view(np.uint64)
        self.dims = dims

    def top(self, name: int, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k`` rows other than the query's own."""
        query = query[: self.dims]
        size, constant = np.abs(query), self.low * sum(query.tolist())
        columns: dict[int, list[np.ndarray]] = {}
        sign = (query < 0).astype(int)
        width = int(size.max(initial=0)).bit_length()
        for j in range(width):
            dims = np.flatnonzero(size >> j & 1)
            if not len(dims):
                continue
            for b in range(self.bits):
                columns.setdefault(j + b, []).append(self.slices[sign[dims], dims, b])
            constant -= (int(sign[dims].sum()) << j) * ((1 << self.bits) - 1)
        sums = [np.zeros_like(self.valid) if s is None else s for s in added(columns)]
        among = self.valid.copy()
        first, last = np.searchsorted(self.ids, [query_id, query_id + 1])
        for row in first + np.flatnonzero(self.names[first:last] == name):
            among[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        rows = best_rows(sums, among, k)
        plain = max(width + self.bits + self.dims.bit_length(), abs(constant).bit_length()) <= PLAIN_BITS
        scores = np.zeros(len(rows), np.int64 if plain else object)
        for weight, bitmap in enumerate(sums):
            own = bitmap[rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)
            scores += own.astype(np.int64) << weight if plain else own.astype(object) << weight
        return self.ids[rows], scores + constant


def better(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the best ``k`` of two lists of them; ties go to the smaller id."""
    ids, scores = np.concatenate([one[0], other[0]]), np.concatenate([one[1], other[1]])
    if scores.dtype == object:
        order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
    else:
        order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def grid(blocks: int, chunks: int, index_bytes: int, query_bytes: int, answer_bytes: int, cells: int) -> tuple[int, int]:
    """Into how many groups blocks and chunks of queries are dealt; every group of either meets all of the other's.

    Blocks are copied for each group of chunks; chunks, and the answers found, for each of blocks.  Of the ways to
    have about ``cells`` cells that a task can hold, the one that copies the fewest bytes.
    """
    least_b = min(blocks, max(1, -(-index_bytes // CELL_BYTES)))
    least_c = min(chunks, max(1, -(-query_bytes // CELL_BYTES), -(-chunks * CHUNK_QUERIES // CELL_QUERIES)))
    ways = [(min(blocks, max(least_b, -(-cells // c))), c) for c in range(least_c, min(chunks, max(cells, least_c)) + 1)]
    return min(ways, key=lambda w: (max(0, cells - w[0] * w[1]), w[1] * index_bytes + w[0] * (query_bytes + answer_bytes)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best rows of ``vectors``.

    Both are ``row, vec_id, v`` (see ``quantised``).  A row is not its own answer; ties
    go to the smaller ``vec_id``; a query with fewer rows to find gets all.  Rows
    that repeat an id are answers and queries each, of each other too.  Scores are
    exact whatever their size; one that does not fit a long is an error.  Vectors
    of different lengths are compared as if the shorter ended in zeros.  Groups of
    queries meet groups of blocks, each pair of groups in one task: it holds the
    queries and their best rows so far, and blocks pass by.  Nothing is joined.
    """
    blocks = written(index(vectors), "index")
    queries = written(queries, "queries")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias("bytes")
    asked = queries.agg(F.count(F.lit(1)).alias("n"), total(8 * F.size("v"))).first()
    built = blocks.agg(F.coalesce(F.max("block"), F.lit(0)).alias("last"), total(F.length("slices"))).first()
    chunks = max(1, -(-asked["n"] // CHUNK_QUERIES))
    wanted = CELLS_A_CORE * vectors.sparkSession.sparkContext.defaultParallelism
    of_blocks, of_chunks = grid(built["last"] + 1, chunks, built["bytes"], asked["bytes"], asked["n"] * k * ANSWER_BYTES, wanted)

    packs = queries.groupBy(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk")).agg(
        F.collect_list(F.struct("row", "vec_id", "v")).alias("queries")
    )

    def cells(name: str, groups: int, times: int, row: int, column: int) -> Column:
        """Numbers of the cells of a row's group: as many as the other side has groups."""
        copies = F.sequence(F.lit(0), F.lit(times - 1))
        return F.explode(F.transform(copies, lambda i: (F.col(name) % groups * row + i * column).cast("int"))).alias("cell")

    given = packs.select(cells("chunk", of_chunks, of_blocks, 1, of_chunks), "queries")
    passing = blocks.select(cells("block", of_blocks, of_chunks, of_chunks, 1), *BLOCK_FIELDS)
    both = given.unionByName(passing, allowMissingColumns=True)
    dealt = both.repartitionById(of_blocks * of_chunks, "cell").sortWithinPartitions("cell", F.col("queries").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []  # a pack's numbers, ids and vectors, and the best rows of each query so far

        def found() -> Iterator[pa.RecordBatch]:
            for names, ids, _, best in held:
                sizes = [len(i) for i, _ in best]
                scores = pa.array([Decimal(x) for _, s in best for x in s.tolist()], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(names, sizes)), pa.array(np.repeat(ids, sizes)),
                     pa.array(np.concatenate([i for i, _ in best])), scores],
                    ["query", "query_id", "vec_id", "score"],
                )

        for batch in batches:
            for row in range(batch.num_rows):
                get = {c: batch.column(c)[row] for c in batch.schema.names}
                if get["cell"].as_py() != cell:
                    yield from found()
                    cell, held = get["cell"].as_py(), []
                if get["queries"].is_valid:
                    own = get["queries"].values
                    names, ids = struct_field(own, "row").to_numpy(), struct_field(own, "vec_id").to_numpy()
                    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
                    held.append((names, ids, _matrix(struct_field(own, "v")), [none] * len(ids)))
                elif held:
                    block = Block(*(get[c].as_py() for c in BLOCK_FIELDS))
                    for names, ids, asking, best in held:
                        for i, query in enumerate(asking):
                            best[i] = better(best[i], block.top(int(names[i]), int(ids[i]), query, k), k)
        yield from found()

    local = dealt.mapInArrow(run, "query long, query_id long, vec_id long, score decimal(38,0)")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))
