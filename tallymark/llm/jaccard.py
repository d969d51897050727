"""N-gram Jaccard join in metric space.

One minus the Jaccard similarity is a metric, so with e = 1 - 0.9 two linked documents
x, y are at distances from any third one, a pivot, that differ by at most e.  A region
of documents picks pivots far from each other, every document goes home to its nearest
pivot, and y is copied into the region of pivot p too if d(y, p) <= d(y, home) + 2e:
a link is then whole inside the region of one of its ends.  What shares nothing with
any pivot is a region as well, with a copy of what is at 1 - e or farther from its
home.  Regions are joined recursively until they are small, of one component, or no
longer part, and then document by document, with the same inequality as a filter.

Nearly all documents of a corpus are at distance 1 from each other, where pivots tell
nothing apart.  The first regions therefore come from parts: the shingles of a set are
dealt into more parts than two linked sets can have differing shingles, so linked sets
have an equal part, and documents that chains of equal parts connect are a region.
Equal sets are one document.  Regions of any size are joined: past a bound, pivots are
compared in a distributed round, and what windows cannot part is dealt in block pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import raw_texts, sized_broadcast, written
from tallymark.llm.components import components

SHINGLE = 3
SHARE, OF = 90, 100  # linked: OF * intersection >= SHARE * union
REACH = 1 - SHARE / OF
SLACK = 1e-9  # of rounded distances; links themselves are decided on whole numbers
SPARE = 2  # parts beyond what the bound asks for, so that empty parts need not count
WIDTH = 1.3  # ratio of neighbouring size classes
PIVOTS = 8
LEAF = 24
ROWS = 1_024  # of a region that one task joins
HASHES = 1 << 21
ROUNDS = 3
GROWTH = 1.5  # windows that copy more than this no longer part a region


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; all words as one where there are fewer."""
    words = text.lower().split()  # of bytes: lower-cases A-Z, splits at space and U+0009 to U+000D
    if not words:
        return np.zeros(0, np.uint64)
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line)], np.uint64)
    digest, starts = xxhash.xxh64_intdigest, [0, *ends[:-size]]
    return np.array(sorted({digest(line[a : b - 1]) for a, b in zip(starts, ends[size - 1 :])}), np.uint64)


def _classes(limit: int = 1 << 40) -> np.ndarray:
    """Largest set of every size class; linked sets are of one class or of neighbours."""
    tops = [1]
    while tops[-1] < limit:
        tops.append(max(tops[-1] + 1, int(tops[-1] * WIDTH)))
    return np.array(tops)


CLASSES = _classes()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def part_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each part of a set, in its size class and in the next where a larger partner would be.

    Sets of a class differ in at most ``bound`` shingles if they are linked.  Of
    ``bound + 1 + SPARE`` parts more than ``SPARE`` are equal then, so a set with up to
    ``SPARE`` empty parts need not name those.
    """
    n, keys = len(hashes), []
    if not n:
        return np.zeros(0, np.int64)
    own = int(np.searchsorted(CLASSES, n))
    with np.errstate(over="ignore"):
        mixed = hashes * _MIX
        mixed ^= mixed >> np.uint64(31)
    for c in (own, own + 1) if n * OF // SHARE > CLASSES[own] else (own,):
        bound = int(2 * CLASSES[c] * (OF - SHARE) // (OF + SHARE))
        if not bound:
            continue  # linked sets of this class are equal
        parts = bound + 1 + SPARE
        part = ((mixed >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        sums, counts = np.zeros(parts, np.uint64), np.bincount(part, minlength=parts)
        with np.errstate(over="ignore"):
            # a sum of mixed hashes names a set of shingles whatever their order
            np.add.at(sums, part, (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))
            key = (sums + np.uint64(c)) * _MIX + np.arange(parts, dtype=np.uint64)
            key ^= key >> np.uint64(32)
        named = counts > 0 if (counts == 0).sum() <= SPARE else np.ones(parts, bool)
        keys.append(key[named].view(np.int64))
    return np.concatenate([np.zeros(0, np.int64), *keys])


def sets(documents: DataFrame) -> DataFrame:
    """``doc_id, body, n, high, low, keys`` of every document: hash of the text, size and digest of its set, keys of its parts."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, keys = [], [], []
            for text in raw_texts(batch):
                own = shingles(text)
                sizes.append(len(own))
                names.append(xxhash.xxh3_128_intdigest(own.tobytes()))
                keys.append(part_keys(own))
            ends = np.cumsum([0, *map(len, keys)])
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            half = (1 << 64) - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("body"), pa.array(sizes, pa.int64()),
                 pa.array(np.array([x >> 64 for x in names], np.uint64).view(np.int64)),
                 pa.array(np.array([x & half for x in names], np.uint64).view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                ["doc_id", "body", "n", "high", "low", "keys"],
            )

    hashed = documents.select("doc_id", F.xxhash64("text").alias("body"), "text")
    return hashed.mapInArrow(run, f"doc_id {kind}, body long, n long, high long, low long, keys array<long>")


class Sets:
    """Sets of one task, and the components that links found so far make of them."""

    def __init__(self, hashes: list[np.ndarray], label: np.ndarray | None = None) -> None:
        self.size = np.array([len(h) for h in hashes])
        self.start = np.cumsum([0, *self.size[:-1]])
        names, self.item = np.unique(np.concatenate(hashes), return_inverse=True)
        self.mark = np.zeros(len(names), bool)
        self.label = np.arange(len(hashes)) if label is None else label

    def common(self, one: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of one set with others."""
        sizes = self.size[others]
        ends = np.cumsum(sizes)
        place = np.repeat(self.start[others] - ends + sizes, sizes) + np.arange(ends[-1])
        own = self.item[self.start[one] : self.start[one] + self.size[one]]
        self.mark[own] = True
        found = np.add.reduceat(self.mark[self.item[place]], ends - sizes, dtype=np.int64)
        self.mark[own] = False
        return found

    def meet(self, one: int, others: np.ndarray) -> np.ndarray:
        """Distances of one set to others; those within reach join its component."""
        both = self.common(one, others)
        union = self.size[one] + self.size[others] - both
        near = np.unique(self.label[others[OF * both >= SHARE * union]])
        if len(near):
            near = np.append(near, self.label[one])
            self.label[np.isin(self.label, near)] = near.min()
        return 1 - both / union

    def settled(self, members: np.ndarray) -> bool:
        return len(members) < 2 or (self.label[members] == self.label[members[0]]).all()

    def flat(self, members: np.ndarray, known: np.ndarray) -> None:
        """Every member against the later ones that could be within reach and are not in its component."""
        for i, one in enumerate(members[:-1].tolist()):
            later = members[i + 1 :]
            size, sizes = self.size[one], self.size[later]
            near = (self.label[later] != self.label[one]) & (OF * np.minimum(size, sizes) >= SHARE * np.maximum(size, sizes))
            if near.any():
                near[near] = (np.abs(known[:, i + 1 :][:, near] - known[:, [i]]) <= REACH + SLACK).all(0)
            if near.any():
                self.meet(one, later[near])

    def join(self, members: np.ndarray) -> None:
        """Join a region: pivots, homes and windows, then its regions."""
        if self.settled(members):
            return
        if len(members) <= LEAF:
            return self.flat(members, np.zeros((0, len(members))))
        pivots, known = [0], [self.meet(int(members[0]), members)]
        while len(pivots) < PIVOTS:
            far = int(np.min(known, axis=0).argmax())
            if far in pivots:
                break
            pivots.append(far)
            known.append(self.meet(int(members[far]), members))
        known = np.array(known)
        if self.settled(members):
            return
        regions = [r for r in windows(known) if len(r)]
        rest = ~np.isin(np.arange(len(members)), pivots)  # pivots have met every member
        regions = [r[rest[r]] for r in regions]
        if sum(map(len, regions)) > GROWTH * len(members) or max(map(len, regions)) > 0.9 * len(members):
            return self.flat(members[rest], known[:, rest])
        for r in regions:
            self.join(members[r])


def windows(known: np.ndarray) -> Iterator[np.ndarray]:
    """Members of each pivot's region, copies included, and of the region of what shares nothing with any pivot."""
    home = known.min(0)
    inside = home < 1
    for distance in known:
        yield np.flatnonzero(inside & (distance <= home + 2 * REACH + SLACK))
    yield np.flatnonzero(home >= SHARE / OF - SLACK)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray | list]]:
    """Rows that lie together and agree in ``keys``, as columns; one group is held at a time."""
    kept: list[pa.RecordBatch] = []

    def done() -> dict:
        rows = pa.Table.from_batches(kept)
        return {c: rows.column(c).to_pylist() if c == "hashes" else rows.column(c).to_numpy() for c in rows.column_names}

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        told = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        bounds = [0, *(np.flatnonzero((told[1:] != told[:-1]).any(1)) + 1).tolist(), len(told)]
        for a, b in zip(bounds, bounds[1:]):
            if kept and tuple(told[a]) != last:
                yield done()
                kept.clear()
            kept.append(batch.slice(a, b - a))
            last = tuple(told[a])
    if kept:
        yield done()


def _pairs(ids: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    """Every document with the first one of its component."""
    _, first = np.unique(label, return_index=True)
    names = dict(zip(label[first].tolist(), ids[first].tolist()))
    root = np.array([names[x] for x in label.tolist()], np.int64)
    apart = root != ids
    return pa.RecordBatch.from_arrays([pa.array(ids[apart]), pa.array(root[apart])], ["a", "b"])


def join_regions(rows: DataFrame) -> DataFrame:
    """``a, b``: links enough to connect what is linked, of regions small enough for a task (``region, id, hashes``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["region"]):
            ids, first = np.unique(group["id"], return_index=True)  # a repeated document comes once
            if len(ids) > 1:
                own = Sets([np.frombuffer(group["hashes"][i], np.uint64) for i in first])
                own.join(np.arange(len(ids)))
                yield _pairs(ids, own.label)

    ready = rows.select("region", "id", "hashes").repartition("region").sortWithinPartitions("region")
    return ready.mapInArrow(run, "a long, b long")


def _compare_pivots(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``region, id, n, hashes, known, linked``: distances of every row of crowded regions to its region's pivots.

    A region's pivots lie before its rows in each share of them, so nothing is collected.
    """
    order = Window.partitionBy("region").orderBy(F.xxhash64("id"), "id")
    pivots = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2 * PIVOTS)
    shares = counts.select("region", F.col("blocks").alias("shares"))
    placed = rows.join(shares, "region").withColumn("share", F.pmod(F.xxhash64("id", F.lit(3)), F.col("shares")).cast("int"))
    first = pivots.join(shares, "region").withColumn("share", F.explode(F.sequence(F.lit(0), (F.col("shares") - 1).cast("int"))))
    kept = ["region", "share", "rank", "id", "n", "hashes"]
    both = placed.withColumn("rank", F.lit(1 << 20)).select(*kept).unionByName(first.select(*kept))
    schema = pa.schema([("region", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary()),
                        ("known", pa.list_(pa.float64())), ("linked", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, pivots = None, []
        for batch in batches:
            out = []
            for region, share, rank, id_, n, raw in zip(*(batch.column(c).to_pylist() for c in kept)):
                if (region, share) != place:
                    place, pivots = (region, share), []
                own = np.frombuffer(raw, np.uint64)
                if rank < 1 << 20:
                    pivots.append((id_, own))
                    continue
                both = [len(np.intersect1d(own, p, assume_unique=True)) for _, p in pivots]
                known = [1 - b / (len(own) + len(p) - b) for b, (_, p) in zip(both, pivots)]
                linked = [i for b, (i, p) in zip(both, pivots) if i != id_ and OF * b >= SHARE * (len(own) + len(p) - b)]
                out.append({"region": region, "id": id_, "n": n, "hashes": raw, "known": known, "linked": linked})
            yield pa.RecordBatch.from_pylist(out, schema)

    ready = both.repartition("region", "share").sortWithinPartitions("region", "share", "rank", "id")
    return ready.mapInArrow(run, "region long, id long, n long, hashes binary, known array<double>, linked array<long>")


def _sizes(rows: DataFrame) -> DataFrame:
    """``region, rows, blocks``: how many tasks' worth of documents a region has."""
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / ROWS), F.ceil(F.sum("n") / HASHES)).cast("int")
    return rows.groupBy("region").agg(F.count(F.lit(1)).alias("rows"), blocks.alias("blocks"))


def _roots(met: DataFrame) -> DataFrame:
    """``region, pivot, root``: pivots that links join, directly or through a row linked to both, have one root.

    What meets per region are pairs of its pivots, a bounded number.
    """
    pairs = met.where(F.size("members") > 0).select("region", F.explode(F.transform("members", lambda b: F.struct(F.get("members", F.lit(0)).alias("a"), b.alias("b")))).alias("p"))
    packed = pairs.groupBy("region").agg(F.collect_set("p").alias("pairs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for region, own in zip(batch.column("region").to_pylist(), batch.column("pairs").to_pylist()):
                root = {x: x for p in own for x in (p["a"], p["b"])}
                for _ in root:  # a chain has no more steps than pivots
                    for p in own:
                        root[p["a"]] = root[p["b"]] = min(root[p["a"]], root[p["b"]])
                out += [(region, x, r) for x, r in root.items()]
            columns = [pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))]
            yield pa.RecordBatch.from_arrays(columns, ["region", "pivot", "root"])

    return packed.mapInArrow(run, "region long, pivot long, root long")


def _part(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One distributed round over crowded regions: links with pivots, new regions, rows that windows cannot part."""
    own = F.when(F.array_min("known") == 0, F.array("id")).otherwise(F.array().cast("array<long>"))  # a pivot is at 0 from itself
    compared = _compare_pivots(rows, _sizes(rows)).withColumn("members", F.sort_array(F.concat("linked", own)))
    met = written(compared, "met")
    links = met.select(F.col("id").alias("a"), F.explode("linked").alias("b"))
    roots, _ = sized_broadcast(written(_roots(met), "roots"), F.lit(24))
    first = F.get("members", F.lit(0))
    told = met.withColumn("pivot", first).join(roots, ["region", "pivot"], "left").withColumn("component", F.coalesce("root", "id"))
    by_part = told.groupBy("region", "component").agg(F.count(F.lit(1)).alias("n"))
    main = by_part.groupBy("region").agg(F.max(F.struct("n", "component")).alias("m"), F.count(F.lit(1)).alias("parts"))
    home = F.array_min("known")
    inside = F.filter(
        F.sequence(F.lit(0), F.size("known") - 1),
        lambda j: (home < 1) & (F.element_at("known", j + 1) <= home + 2 * REACH + SLACK),
    )
    outside = F.when(home >= SHARE / OF - SLACK, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>"))
    told = told.join(main.where("parts > 1").select("region", F.col("m.component").alias("main")), "region")
    told = written(told.withColumn("goes", F.concat(inside, outside)), "told")
    spread = told.groupBy("region").agg(F.sum(F.size("goes")).alias("copies"), F.count(F.lit(1)).alias("rows"))
    parted = spread.where(F.col("copies") <= GROWTH * F.col("rows")).select("region")
    split = told.join(parted, "region", "left_semi").withColumn("to", F.explode("goes"))
    split = split.select(F.xxhash64("region", "to").alias("region"), "id", "n", "hashes")
    stuck = told.join(parted, "region", "left_anti").select("region", "id", "n", "hashes", (F.col("component") == F.col("main")).alias("main"))
    return links, split, stuck


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Links of crowded regions that windows cannot part: blocks meet blocks, but those of one component not each other."""
    counts = rows.groupBy("region", "main").agg(
        F.greatest(F.ceil(2 * F.count(F.lit(1)) / ROWS), F.ceil(2 * F.sum("n") / HASHES)).cast("int").alias("blocks")
    )
    sizes = counts.groupBy("region").agg(
        F.coalesce(F.max(F.when(F.col("main"), F.col("blocks"))), F.lit(0)).alias("mains"),
        F.coalesce(F.max(F.when(~F.col("main"), F.col("blocks"))), F.lit(0)).alias("others"),
    )
    own = rows.join(sizes, "region").withColumn(
        "block", F.when(F.col("main"), F.col("others") + F.pmod(F.xxhash64("id"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("id"), F.col("others"))).cast("int")
    )
    # a block of the main component meets the others only; one of the others meets every block
    last = F.when(F.col("main"), F.col("others") - 1).otherwise(F.col("mains") + F.col("others") - 1)
    dealt = own.where(last >= 0).withColumn("with", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.select("region", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "id", "hashes", "main")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["region", "one", "two"]):
            ids, first = np.unique(group["id"], return_index=True)
            main = group["main"][first]
            label = np.arange(len(ids))
            if main.any():
                label[main] = np.flatnonzero(main)[0]
            own = Sets([np.frombuffer(group["hashes"][i], np.uint64) for i in first], label)
            own.join(np.arange(len(ids)))
            yield _pairs(ids, own.label)

    keys = ["region", "one", "two"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def links(rows: DataFrame) -> DataFrame:
    """``a, b`` of all regions of ``region, id, n, hashes``, each document of a region once."""
    sizes = written(_sizes(rows), "sizes")
    found = written(join_regions(rows.join(sizes.where("blocks > 1"), "region", "left_anti")), "links")
    crowded = rows.join(sizes.where("blocks > 1"), "region", "left_semi")
    for _ in range(ROUNDS):
        if sizes.where("blocks > 1").isEmpty():
            return found
        pivots, split, stuck = _part(crowded)
        rows = written(split, "split")
        sizes = written(_sizes(rows), "sizes")
        more = join_regions(rows.join(sizes.where("blocks > 1"), "region", "left_anti"))
        found = found.unionByName(pivots).unionByName(written(more, "links")).unionByName(written(_block_pairs(stuck), "links"))
        crowded = rows.join(sizes.where("blocks > 1"), "region", "left_semi")
    return found.unionByName(written(_block_pairs(crowded.withColumn("main", F.lit(False))), "links"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document.

    ``component_id`` is the least ``doc_id`` that links reach, the document's own
    included.  Null texts and texts without words have no shingles and no links;
    rows alike in their sets are linked; a null ``doc_id`` is never the least unless
    its component has no other; repeated rows are returned each; other columns are
    not read; an empty table gives no rows.
    """
    seen = written(sets(documents), "sets")
    nodes = seen.where("n > 0").groupBy("high", "low").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "body")).alias("at"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys")
    )
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    keyed = nodes.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where(F.col("first") < F.col("last"))
    chains = keyed.join(shared, "key").where(F.col("id") > F.col("first")).select(F.col("id").alias("a"), F.col("first").alias("b"))
    regions = written(components(chains.distinct()), "regions")
    wanted = nodes.join(regions, nodes["id"] == regions["node"]).select(
        "id", "n", F.col("component").alias("region"), F.col("at.doc_id").alias("doc"), F.col("at.body").alias("code")
    )
    own = documents.select("doc_id", F.xxhash64("text").alias("body"), "text")
    told = own.join(wanted, own["doc_id"].eqNullSafe(wanted["doc"]) & (own["body"] == wanted["code"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = pa.array([shingles(t).tobytes() for t in raw_texts(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("region", "id", "n")] + [hashes], ["region", "id", "n", "hashes"])

    rows = written(told.select("region", "id", "n", "text").mapInArrow(run, "region long, id long, n long, hashes binary"), "rows")
    labels = components(links(rows))
    placed = nodes.join(labels, nodes["id"] == labels["node"], "left").select("high", "low", "least", F.coalesce("component", "id").alias("component"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "component").select("high", "low", "component_id")
    full = seen.where("n > 0").join(named, ["high", "low"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(seen.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
