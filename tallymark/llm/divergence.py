"""How sources of one language differ in the words they use, exactly.

Every source and every language gives each kept term a share p (see ``shares``); two
shares p, q differ by f = floor((p - q)**2 / q).  For all pairs of sources f is summed
over all kept terms, although most sources lack most terms: a source gives every
term it lacks the same base share, so the sum over all terms is V * f(base, base)
plus corrections for the terms that one of the two has (from the source's histogram
of counts) and for those that both have.

The last ones come from a frequent-pattern tree.  A term's row is its nonzero counts
in order of source; equal rows are one row with a multiplicity.  Rows go into a tree
in which rows that begin alike share a path, and each node adds the correction of
itself and each of its ancestors once, times the terms that pass through it.
Corrections are sums over terms, so every task grows trees of a bounded size from its
own rows, and only sums by pair leave it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import raw_texts, sized_broadcast, written

WHOLE = 1_000_000_000
LEAST_DOCUMENTS = 3
TOP_TERMS = 200
FLUSH_TERMS = 1 << 18  # distinct terms that a task counts before it sends them on
TREE_NODES = 1 << 18
SOURCES_AT_ONCE = 256
SHARDS = 16  # of a hot source's histogram
_LETTERS = bytes.maketrans(
    bytes(range(0x80)), bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A else 0x20 for c in range(0x80))
)


def term_counts(documents: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and documents that have the term, counted next to the scan."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in found.items():
                if n:
                    columns = [pa.array([lang] * len(n)), pa.array([source] * len(n)), pa.array(list(n), pa.binary()).cast(pa.string()),
                               pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
            found.clear()

        for batch in batches:
            groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            for key, text in zip(groups, raw_texts(batch)):
                n, docs = found.setdefault(key, (Counter(), Counter()))
                terms = text.translate(_LETTERS).split()
                n.update(terms)
                docs.update(set(terms))
            if sum(len(n) for n, _ in found.values()) > FLUSH_TERMS:
                yield from flush()
        yield from flush()

    named = documents.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return named.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (count + 1) / (total + terms)), exact for counts of any size; null without terms."""
    whole = F.lit(Decimal(WHOLE)).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", whole, F.nullif(total + terms, F.lit(0)).cast("decimal(19,0)"))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q) * (p - q) / q) of two shares, which are at most WHOLE + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _exact_sums(values: np.ndarray, times: np.ndarray, keys: np.ndarray, n: int) -> list[int]:
    """Sums of ``values * times`` by key, exact: in parts that can't overflow."""
    total = [0] * n
    for shift in (0, 21, 42):
        part = (values >> shift) & ((1 << 21) - 1) if shift < 42 else values >> shift
        sums = np.zeros(n, np.int64)
        np.add.at(sums, keys, part * times)
        for k in np.flatnonzero(sums):
            total[k] += int(sums[k]) << shift
    return total


class Tree:
    """Frequent-pattern tree of term rows: items (source, count) with the shares that come with them."""

    def __init__(self) -> None:
        self.child: dict[tuple[int, str, int], int] = {}
        self.parent: list[int] = []
        self.times: list[int] = []
        self.item: list[tuple[str, int, int]] = []  # source, share, base share

    def insert(self, path: list[dict], times: int) -> None:
        at = -1
        for x in path:
            key = (at, x["source"], x["n"])
            node = self.child.get(key)
            if node is None:
                node = self.child[key] = len(self.parent)
                self.parent.append(at)
                self.times.append(0)
                self.item.append((x["source"], x["p"], x["base"]))
            self.times[node] += times
            at = node

    def corrections(self) -> Iterator[tuple[str, str, int]]:
        """(source, other, what both having terms adds to the pair's sum); nodes meet their ancestors level by level."""
        names = sorted({s for s, _, _ in self.item})
        number = {s: i for i, s in enumerate(names)}
        own = np.array([number[s] for s, _, _ in self.item])
        p = np.array([x for _, x, _ in self.item], np.int64)
        base = np.array([x for _, _, x in self.item], np.int64)
        times, parent = np.array(self.times, np.int64), np.array(self.parent)
        node, above = np.arange(len(parent)), parent
        total: Counter = Counter()
        while len(node):
            more = above >= 0
            node, above = node[more], above[more]
            for a, b in ((node, above), (above, node)):
                value = _f(p[a], p[b]) - _f(p[a], base[b]) - _f(base[a], p[b]) + _f(base[a], base[b])
                pairs, key = np.unique(own[a] * len(names) + own[b], return_inverse=True)
                for pair, x in zip(pairs.tolist(), _exact_sums(value, times[node], key, len(pairs))):
                    total[pair] += x
            above = parent[above]
        for pair, x in total.items():
            yield names[pair // len(names)], names[pair % len(names)], x


_SUM = "lang string, source string, item string, value decimal(38,0)"
_SUM_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.decimal128(38, 0))])


def _sums(rows: list[tuple[str, str, str, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    values = pa.array([Decimal(x) for x in columns[3]], pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), values], schema=_SUM_ARROW)


def joint_corrections(rows: DataFrame) -> DataFrame:
    """``lang, source, item, value`` from ``lang, path, times``: in a partition rows that begin alike follow each other, and trees are bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, tree = None, Tree()

        def done() -> pa.RecordBatch:
            return _sums([(lang, a, b, x) for a, b, x in tree.corrections()])

        for batch in batches:
            for own, path, times in zip(*(batch.column(c) for c in ("lang", "path", "times"))):
                own = own.as_py()
                if tree.parent and (own != lang or len(tree.parent) > TREE_NODES):
                    yield done()
                    tree = Tree()
                lang = own
                tree.insert(path.as_py(), times.as_py())
        if tree.parent:
            yield done()

    ready = rows.repartition("lang", F.xxhash64("path")).sortWithinPartitions("lang", "path")
    return ready.mapInArrow(run, _SUM)


def single_corrections(histogram: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: what a source's own terms add to the sums with each other source that lacks them.

    ``histogram`` has ``lang, source, base, p, times``; the other sources of a language
    (``groups``: ``lang, source, base``) come in packs of a bounded size.
    """
    packs = groups.groupBy("lang", F.floor((F.col("number") - 1) / SOURCES_AT_ONCE).alias("pack")).agg(
        F.sort_array(F.collect_list(F.struct("source", "base"))).alias("others")
    )
    packs = written(packs.select("lang", "others").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1)))), "packs")
    packs, _ = sized_broadcast(packs, F.size("others") * 64)
    own = histogram.groupBy("lang", "source", "base", F.pmod(F.xxhash64("p"), F.lit(SHARDS)).cast("int").alias("shard")).agg(
        F.sort_array(F.collect_list(F.struct("p", "times"))).alias("cells")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, source, base, cells, others in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "base", "cells", "others"))):
                others = [o for o in others if o["source"] != source]
                if not others:
                    continue
                p, times = (np.array([c[k] for c in cells], np.int64)[:, None] for k in ("p", "times"))
                q = np.array([o["base"] for o in others], np.int64)[None]
                key, each = np.broadcast_to(np.arange(len(others)), (len(p), len(others))).ravel(), np.broadcast_to(times, (len(p), len(others))).ravel()
                there = _exact_sums((_f(p, q) - _f(np.int64(base), q)).ravel(), each, key, len(others))
                back = _exact_sums((_f(q, p) - _f(q, np.int64(base))).ravel(), each, key, len(others))
                rows = [(lang, source, o["source"], x) for o, x in zip(others, there)]
                yield _sums(rows + [(lang, o["source"], source, x) for o, x in zip(others, back)])

    return own.join(packs, ["lang", "shard"]).select("lang", "source", "base", "cells", "others").mapInArrow(run, _SUM)


def audit(documents: DataFrame, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source differs from the others and from its language.

    Part ``pair`` ranks the other sources of the language, part ``term`` the terms a
    source uses more than its language does (the first ``top_terms``).  Null texts,
    languages and sources are ''; empty texts have no terms; repeated rows are
    documents each; groups without terms and languages without kept terms still have
    their pairs, at what the base shares give or 0; an empty table gives no rows;
    other columns are not read.
    """
    counted = term_counts(documents).repartition("lang", "term")
    by_source = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = written(
        by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("cells"))
        .where(F.col("docs") >= least_documents).select("lang", "term", "cells"),
        "terms",
    )
    cells = kept.select("lang", "term", F.explode("cells").alias("c")).select("lang", "term", "c.source", "c.n")
    there = documents.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    in_lang = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["n"])
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum(in_lang).alias("lang_total"))
    groups = there.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = written(
        groups.withColumn("base", share(F.lit(0), F.col("total"), F.col("terms")))
        .withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source"))),
        "groups",
    )
    known, _ = sized_broadcast(groups, F.octet_length("lang") + F.octet_length("source") + 40)
    placed = cells.join(known, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))

    whole = kept.select("lang", "term", in_lang.alias("own"), F.explode("cells").alias("c"))
    more = whole.select("lang", "term", "own", "c.source", "c.n").join(known, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("own"), F.col("lang_total"), F.col("terms"))
    more = more.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = more.select("lang", "source", F.lit("term").alias("part"), "item", distance(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)

    item = F.struct("source", "n", "p", "base")
    rows = placed.groupBy("lang", "term").agg(F.sort_array(F.collect_list(item)).alias("path"))
    paths = rows.where(F.size("path") > 1).groupBy("lang", "path").agg(F.count(F.lit(1)).alias("times"))
    histogram = placed.groupBy("lang", "source", "base", "p").agg(F.count(F.lit(1)).alias("times"))
    a, b = groups.alias("a"), groups.alias("b")
    bases = a.join(b, F.col("a.lang") == F.col("b.lang")).where("a.source <> b.source").select(
        "a.lang", "a.source", F.col("b.source").alias("item"),
        F.coalesce(F.col("a.terms").cast("decimal(19,0)") * distance(F.col("a.base"), F.col("b.base")), F.lit(0)).cast("decimal(38,0)").alias("value"),
    )
    added = bases.unionByName(single_corrections(histogram, groups.where("terms > 0"))).unionByName(joint_corrections(paths))
    pairs = added.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)
