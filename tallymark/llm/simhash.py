"""SimHash near-duplicates by BK-trees.

Every document gets a 64-bit fingerprint.  Two fingerprints that differ in at
most ``RADIUS`` bits agree wholly in at least one of ``BLOCKS`` = ``RADIUS`` + 1
blocks, so distinct fingerprints are dealt into shards by (block, its value).
Each shard becomes a BK-tree: a node's children hang on edges that carry their
Hamming distance to it, and a search at distance d from a node follows only edges
within d - radius .. d + radius.  A tree is sent to the tasks that search it as
rows of a bounded size, never through the driver: shards past ``TREE_NODES`` are
cut into several trees, and every block of queries meets every tree of its shard.
Links found are reduced to one per fingerprint where they are found, and connected
components are grown from those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import column, fresh, raw_texts, sized_broadcast, written
from tallymark.llm.components import components

RADIUS = 3
BLOCKS = 4
SHINGLE = 3
TREE_NODES = 1_024
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: bytes) -> int:
    """Majority bits of the XXH64 (seed 42) of all shingles, repeats included; zero without words."""
    words = text.lower().split()  # of bytes: lower-cases A-Z, splits at space and U+0009 to U+000D
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[: -SHINGLE]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a : b - 1], 42) for a, b in zip(starts, ends[SHINGLE - 1 :])], np.uint64)
    count = np.zeros(64, np.int64)
    for bit in range(8):  # eight sums at a time, one per byte; 255 rows cannot overflow a byte
        lanes = (hashes >> np.uint64(bit)) & _LANES
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255))
        count[bit::8] = sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int(((2 * count > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id, body`` (hash of the text), ``print`` (a signed 64-bit number) of every document, next to the scan."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in raw_texts(batch)], np.uint64).view(np.int64)
            columns = [batch.column("doc_id"), batch.column("body"), pa.array(found)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "body", "print"])

    hashed = documents.select("doc_id", F.xxhash64("text").alias("body"), "text")
    return hashed.mapInArrow(run, f"doc_id {kind}, body long, print long")


def grow(prints: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of many shards at once: (root of each shard, parent, edge) by row.

    ``shard`` numbers the rows' shards from 0.  The first row of a shard is its
    root.  In each round every row that is not placed yet looks at its distance to
    the node it has come to; the first row to ask for an edge becomes the child on
    it, the others go down to that child.
    """
    rows = np.arange(len(prints))
    _, roots = np.unique(shard, return_index=True)
    parent, edge = np.full(len(prints), -1), np.zeros(len(prints), np.int64)
    at = roots[shard]
    left = rows[at != rows]
    while len(left):
        distance = np.bitwise_count(prints[left] ^ prints[at[left]]).astype(np.int64)
        _, first, group = np.unique(at[left] * 65 + distance, return_index=True, return_inverse=True)
        child = left[first]
        parent[child], edge[child] = at[child], distance[first]
        at[left] = child[group]
        left = left[at[left] != left]
    return roots, parent, edge


def search(
    prints: np.ndarray, trees: tuple[np.ndarray, np.ndarray, np.ndarray], queries: np.ndarray, start: np.ndarray, radius: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, row) within ``radius``; each query begins at its tree's root ``start``."""
    _, parent, edge = trees
    order = np.lexsort((edge, parent))
    sorted_parent, sorted_edge = parent[order], edge[order]
    keys = sorted_parent * 65 + sorted_edge
    query, node = np.arange(len(queries)), start
    while len(query):
        distance = np.bitwise_count(queries[query] ^ prints[node]).astype(np.int64)
        hit = distance <= radius
        yield query[hit], node[hit]
        low = np.searchsorted(keys, node * 65 + np.maximum(distance - radius, 0), "left")
        high = np.searchsorted(keys, node * 65 + np.minimum(distance + radius, 64), "right")
        size = high - low
        query = np.repeat(query, size)
        node = order[np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _links(prints: np.ndarray, shard: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of shards: each linked fingerprint with the least one it reaches here.

    Rows of ``side`` 0 form the trees and rows of side 1 only search.
    """
    in_tree = np.flatnonzero(side == 0)
    if not len(in_tree):
        return prints[:0], prints[:0]
    names, own = np.unique(shard[in_tree], return_inverse=True)
    trees = grow(prints[in_tree], own)
    # every shard has rows of its tree, as chunks are dealt in pairs; a shard without any has nothing to find
    place = np.minimum(np.searchsorted(names, shard), len(names) - 1)
    asks = np.flatnonzero(names[place] == shard)
    label = np.arange(len(prints))
    pairs = [(asks[q], in_tree[n]) for q, n in search(prints[in_tree], trees, prints[asks], trees[0][place[asks]], radius)]
    a, b = (np.concatenate(x) for x in zip(*pairs))
    apart = a != b
    a, b = a[apart], b[apart]
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    linked = label != np.arange(len(prints))
    return prints[linked], prints[label[linked]]


def links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """``a, b``: links enough to join all distinct fingerprints that ``radius`` bits connect.

    ``prints`` holds each fingerprint once.  ``blocks`` must be above ``radius``.
    """
    if not radius < blocks <= 64:
        raise ValueError("there must be more blocks than differing bits")
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    shards = F.array(*[
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.shiftleft("print", 64 - hi), 64 - hi + lo).alias("value"))
        for i, (lo, hi) in enumerate(zip(edges, edges[1:]))
    ])
    dealt = prints.select("print", F.explode(shards).alias("s")).select("print", "s.block", "s.value")
    crowded = written(
        dealt.groupBy("block", "value").count().where(F.col("count") > tree_nodes)
        .select("block", "value", F.ceil(F.col("count") / tree_nodes).cast("int").alias("trees")),
        "crowded",
    )
    crowded, _ = sized_broadcast(crowded, F.lit(16))
    chunk = F.pmod(F.xxhash64("print"), F.col("trees")).cast("int")
    cut = (
        dealt.join(crowded, ["block", "value"], "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
        .withColumn("chunk", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
        .select(
            "block", "value", F.least("chunk", "other").alias("tree"), F.greatest("chunk", "other").alias("query"),
            (F.col("chunk") > F.col("other")).cast("int").alias("side"), "print",
        )
    )
    keys = ["block", "value", "tree", "query"]
    ready = cut.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def found(rows: np.ndarray) -> pa.RecordBatch:
            change = np.any(rows[1:, :4] != rows[:-1, :4], axis=1)
            shard = np.concatenate([[0], np.cumsum(change)])
            a, b = _links(rows[:, 5].view(np.uint64), shard, rows[:, 4], radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in [*keys, "side", "print"]], axis=1)
            rows = np.concatenate([*kept, rows])
            # the last shard may go on in the next batch; a shard has about two trees' rows at most
            same = np.all(rows[:, :4] == rows[-1, :4], axis=1)
            whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if whole:
                yield found(np.ascontiguousarray(rows[:whole]))
            kept = [rows[whole:]]
        if kept and len(kept[0]):
            yield found(np.ascontiguousarray(kept[0]))

    return ready.mapInArrow(run, "a long, b long").distinct()


def _named(documents: DataFrame, radius: int, blocks: int, tree_nodes: int) -> DataFrame:
    """``doc_id, body, print, component`` (its least fingerprint), ``component_id`` of every document."""
    seen = written(fingerprints(documents), "prints")
    nodes = written(seen.groupBy("print").agg(F.min("doc_id").alias("least")), "nodes")
    found = written(links(nodes.select("print"), radius, blocks, tree_nodes), "links")
    labels = components(found)
    grouped = nodes.join(labels.withColumnRenamed("node", "print"), "print", "left").withColumn(
        "component", F.coalesce("component", "print")
    )
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    return seen.join(grouped.select("print", "component").join(least, "component"), "print")


def near_duplicates(documents: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document.

    ``fingerprint`` is 16 lowercase hex digits, ``component_id`` the least
    ``doc_id`` that links reach, the document's own included.  Null and empty
    texts have the fingerprint zero and link to each other like any others; a null
    ``doc_id`` is never the least unless the whole component has no other;
    repeated rows are returned each; other columns are not read.
    """
    return _named(documents, radius, blocks, tree_nodes).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(
    documents: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree_nodes: int = TREE_NODES
) -> DataFrame:
    """One document of every group, the one with the least id, all its columns as they are.

    Rows without an id are copies like any others and rank last in their group; of
    a group's rows that share the least id, those of one text (the one with the
    least hash) stay, as one row.  Rows that share an id but no group are documents
    of their own.  Null and empty texts are one group.  Input columns may have any
    name; an empty table stays empty.
    """
    named = _named(documents, radius, blocks, tree_nodes)
    mark, body = fresh(documents, "_doc"), fresh(documents, "_body")
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "body")).alias("first"))
    keep = first.select(F.col("first.doc_id").alias(mark), F.col("first.body").alias(body)).distinct()
    own = documents.withColumn(body, F.xxhash64(column("text"))).withColumn(mark, column("doc_id"))
    told = keep.select(F.col(mark).alias("_kept_doc"), F.col(body).alias("_kept_body"))
    same = F.col(mark).eqNullSafe(told["_kept_doc"]) & (F.col(body) == told["_kept_body"])
    kept = own.join(told, same, "left_semi").dropDuplicates([mark, body])
    return kept.select(*[column(c) for c in documents.columns])
