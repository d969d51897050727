"""Which patterns of a table occur in which texts, for tables of any size.

Every pattern is filed under one of its q-grams, the one that is rarest in a probe
of the texts.  A text can only hold a pattern if it holds the gram the pattern is
filed under, so texts and patterns meet on grams instead of all with all: grams are
dealt into blocks of a bounded number of pattern bytes, a text is sent to the blocks
of the filed grams it has, and there an Aho-Corasick automaton of the block's patterns
confirms what really occurs.  A fixed-size bitmap of filed grams keeps texts without any
of them from moving at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallymark.operators.joins import small_side
from tallymark.session import scratch_path

Q = 3
BLOCK_BYTES = 1 << 18  # of patterns; an automaton takes some hundred times as much
TEXTS_PER_SHARE = 200_000  # texts of a block that go through one copy of its automaton
PROBE_TEXTS = 2_000  # read to tell rare grams from frequent ones; decides where patterns lie, never what is found
_COUNTERS = 18  # bits of the probe's counters
_BITMAP = 23  # bits of the bitmap's size: one megabyte
_EMPTY = np.zeros(1, np.uint64)  # the gram of the empty pattern, which every text has
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str, sizes: range = range(1, Q + 1)) -> np.ndarray:
    """Codes of a text's distinct runs of 1 to ``Q`` characters; no two runs share a code."""
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    found = [_EMPTY]
    for n in sizes:
        if len(letters) >= n:
            code = np.zeros(len(letters) - n + 1, np.uint64)
            for k in range(n):
                code |= letters[k : len(letters) - n + k + 1] << np.uint64(21 * k)
            found.append(code)
    return np.unique(np.concatenate(found))


def _place(codes: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((codes ^ (codes >> np.uint64(29))) * _MIX >> np.uint64(64 - bits)).astype(np.int64)


def _own_grams(pattern: str) -> np.ndarray:
    """Grams a pattern may be filed under: its runs of ``Q`` characters, or itself if it is shorter."""
    n = min(len(pattern), Q)
    return grams(pattern, range(n, n + 1))[1:] if n else _EMPTY


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _probe(texts: DataFrame) -> np.ndarray:
    """How often grams occur in some texts, in a fixed number of counters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _COUNTERS, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                np.add.at(total, _place(grams(text or ""), _COUNTERS), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    rows = texts.select("text").limit(PROBE_TEXTS).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << _COUNTERS, np.int64)
    total[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return total


def _filed(patterns: DataFrame, seen: np.ndarray, blocks: int) -> DataFrame:
    """``pattern, rank, gram, block``: the gram each pattern is filed under, and the block that holds the gram."""
    shared = patterns.sparkSession.sparkContext.broadcast(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for text in batch.column("pattern").to_pylist():
                own = _own_grams(text)
                codes.append(own[np.lexsort((own, shared.value[_place(own, _COUNTERS)]))[0]])
            own = np.array(codes, np.uint64)
            columns = [batch.column("pattern"), batch.column("rank"), pa.array(own.view(np.int64)), pa.array(_block(own, blocks))]
            yield pa.RecordBatch.from_arrays(columns, ["pattern", "rank", "gram", "block"])

    kind = patterns.schema["rank"].dataType.simpleString()
    return patterns.select("pattern", "rank").mapInArrow(run, f"pattern string, rank {kind}, gram long, block long")


def _bitmap(filed: DataFrame) -> np.ndarray:
    """One bit per filed gram, by hash; always the same size, whatever the table's."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_place(batch.column("gram").to_numpy().view(np.uint64), _BITMAP))
            word, first = np.unique(at >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], ["word", "bits"])

    rows = filed.select("gram").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    total = np.zeros(1 << (_BITMAP - 6), np.uint64)
    total[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return total


def _block(codes: np.ndarray, blocks: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (((codes ^ (codes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)).astype(np.int64) % blocks


def occurrences(texts: DataFrame, patterns: DataFrame, first_only: bool = False) -> DataFrame:
    """``id, rank, pattern`` for every pattern that occurs in a text, or the least (rank, pattern) per text.

    ``texts`` has ``id, text``, ``patterns`` has ``pattern, rank``; both are compared as
    they are.  Null texts and null patterns match nothing; the empty pattern is in
    every text; a pattern given twice is found under each of its ranks; empty tables
    give no rows.  Neither table is collected, and no pair is made that shares no gram.
    """
    spark = texts.sparkSession
    given = patterns.where(F.col("pattern").isNotNull())
    blocks = max(1, -(-(given.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0) // BLOCK_BYTES))
    filed = _stored(_filed(given, _probe(texts), blocks), "filed")
    known = spark.sparkContext.broadcast(_bitmap(filed))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = known.value
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                own = grams(text)
                at = _place(own, _BITMAP)
                hit = (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
                out.append(np.unique(_block(own[hit], blocks)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text"), pa.array(out, pa.list_(pa.int64()))], ["id", "text", "blocks"]
            )

    kind, rank = texts.schema["id"].dataType.simpleString(), patterns.schema["rank"].dataType.simpleString()
    asked = texts.where(F.col("text").isNotNull()).select("id", "text").mapInArrow(visits, f"id {kind}, text string, blocks array<long>")
    asked = _stored(asked.where(F.size("blocks") > 0), "asked").select("id", "text", F.explode("blocks").alias("block"))
    # a gram that very many patterns are filed under makes a block too large for one automaton
    parts = filed.groupBy("block").agg(F.ceil(F.sum(F.octet_length("pattern")) / (2 * BLOCK_BYTES)).cast("int").alias("parts"))
    parts = parts.withColumn("parts", F.greatest("parts", F.lit(1)))
    shares = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / TEXTS_PER_SHARE).cast("int").alias("shares"))
    sizes = small_side(parts.join(shares, "block"))
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["block", "part", "share", "pattern", "rank", "id", "text"]
    own = filed.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("pattern"), F.col("parts")).cast("int"))
    own = own.withColumn("share", up_to("shares")).withColumn("id", F.lit(None).cast(kind)).withColumn("text", F.lit(None).cast("string"))
    theirs = asked.join(sizes, "block").withColumn("share", F.pmod(F.xxhash64("id", "text"), F.col("shares")).cast("int"))
    theirs = theirs.withColumn("part", up_to("parts")).withColumn("pattern", F.lit(None).cast("string")).withColumn("rank", F.lit(None).cast(rank))
    both = own.select(*columns).unionByName(theirs.select(*columns))
    ready = both.repartition("block", "part", "share").sortWithinPartitions("block", "part", "share", F.col("pattern").isNull())

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ranks, automaton = None, {}, None
        for batch in batches:
            ids, found = [], []
            for block, part, share, pattern, rank, id_, text in zip(*(batch.column(c).to_pylist() for c in columns)):
                if (block, part, share) != place:
                    place, ranks, automaton = (block, part, share), {}, None
                if pattern is not None:
                    ranks.setdefault(pattern, []).append(rank)
                    continue
                if automaton is None:
                    automaton = ahocorasick.Automaton()
                    for p in ranks:
                        if p:
                            automaton.add_word(p, p)
                    automaton.make_automaton()
                here = {p for _, p in automaton.iter(text)} if len(automaton) else set()
                hits = [(r, p) for p in (here | {""} if "" in ranks else here) for r in ranks[p]]
                hits = [min(hits)] if first_only and hits else hits
                ids += [id_] * len(hits)
                found += hits
            columns_out = [pa.array(ids, id_type), pa.array([r for r, _ in found], rank_type), pa.array([p for _, p in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns_out, ["id", "rank", "pattern"])

    id_type, rank_type = to_arrow_type(texts.schema["id"].dataType), to_arrow_type(patterns.schema["rank"].dataType)
    met = ready.mapInArrow(confirm, f"id {kind}, rank {rank}, pattern string")
    if first_only:
        return met.groupBy("id").agg(F.min(F.struct("rank", "pattern")).alias("_r")).select("id", "_r.rank", "_r.pattern")
    return met.distinct()
