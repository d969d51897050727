"""Conversation structure repair: the cheapest edits that make roles take turns.

A conversation is right if its roles read (system)? (user assistant)* or nothing.
Every row may be kept, given the role whose turn it is, or deleted, and empty turns
may be put in anywhere; rows that must go (blank, duplicate) and truncated rows cost
as told.  The cheapest edits are a shortest path through four states: nothing said
yet, after system, after user, after assistant.

Conversations of any length are cut into blocks of about the square root of their
rows.  A block's costs from state to state are one small matrix; going backward
over a conversation's matrices gives the cost still to pay at the end of each block.
Only those vectors, the checkpoints, are stored.  Each block then recomputes its own
rows' vectors from its checkpoint and walks forward along tight edits, the ASCII-least
letter first, so no task holds more than one block's rows or one conversation's blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.sequence import with_running
from tallymark.llm.common import column, written

LEAST_BLOCK = 64  # rows; shorter conversations are one block
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACE = " \t\n\x0b\f\r"
NEVER = 1 << 60
NEXT = (2, 2, 3, 2)  # state after the turn that is due: user, or assistant after a user
NAMES = {2: "user", 3: "assistant"}
KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}  # (state, initial s u a) -> state
LEFT = np.array([0, 2 * INSERT, INSERT, 0])  # inserts that end a conversation


def _edits(code: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of a row's edits, ASCII order, inserts left out; ``code`` is initial + 4 * fault."""
    initial, fault = code & 3, code >> 2
    yield "D", DELETE, state
    if fault < 2:
        if (state, initial) in KEPT:
            yield "K", TRUNCATED * fault, KEPT[state, initial]
        yield "R", REROLE + TRUNCATED * fault, NEXT[state]


def _step(code: int) -> np.ndarray:
    """Least cost from state to state over inserts and then one row."""
    costs = np.full((4, 4), NEVER)
    for state in range(4):
        at, paid = state, 0
        for _ in range(3):
            for _, cost, to in _edits(code, at):
                costs[state, to] = min(costs[state, to], paid + cost)
            at, paid = NEXT[at], paid + INSERT
    return costs


STEPS = np.stack([_step(code) for code in range(12)])


def block_costs(codes: bytes) -> np.ndarray:
    """Costs from state to state over a whole block."""
    total = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for code in codes:
        total = np.minimum((total[:, :, None] + STEPS[code]).min(1), NEVER)
    return total


def vectors(codes: bytes, after: np.ndarray) -> np.ndarray:
    """Cost still to pay before each row of a block, by state; the last one is its checkpoint."""
    out = np.empty((len(codes) + 1, 4), np.int64)
    out[-1] = after
    for i in range(len(codes) - 1, -1, -1):
        out[i] = np.minimum((STEPS[codes[i]] + out[i + 1]).min(1), NEVER)
    return out


def walk(codes: bytes, costs: np.ndarray, state: int, last: bool) -> tuple[list[tuple[str, int]], int]:
    """Tight edits of a block from ``state``: (letters, state before them) for each row, and the state after it.

    The last block of a conversation has one entry more, the inserts that end it.
    """
    found, costs = [], costs.tolist()
    for i, code in enumerate(codes):
        letters, start = "", state
        while True:
            due = costs[i][state]
            choices = {letter: (cost + costs[i + 1][to], to) for letter, cost, to in _edits(code, state)}
            letter = next(
                x for x in "DIKR"
                if (x == "I" and INSERT + costs[i][NEXT[state]] == due) or (x in choices and choices[x][0] == due)
            )
            letters += letter
            if letter != "I":
                state = choices[letter][1]
                break
            state = NEXT[state]
        found.append((letters, start))
    if last:
        start, n = state, int(LEFT[state]) // INSERT
        for _ in range(n):
            state = NEXT[state]
        found.append(("I" * n, start))
    return found, state


def lines(found: list[tuple[str, int]], first: int, codes: bytes) -> Iterator[tuple[int, int, str | None, bool]]:
    """(row, step, role, whether the row's own text follows) of what stays; a kept role is None."""
    for i, (letters, state) in enumerate(found):
        for k, letter in enumerate(letters):
            if letter == "D":
                continue
            to = KEPT[state, codes[i] & 3] if letter == "K" else NEXT[state]
            yield first + i, k, None if letter == "K" else NAMES[to], letter != "I"
            state = to


def _last_letter(text: Column) -> Column:
    return F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))


def _named(conv_id: Column) -> Column:
    """A conversation's id as a key that is never null."""
    return F.when(conv_id.isNull(), "").otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def _ordered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``c, turn, digest, role, text`` of distinct rows, and ``c, turn, digest, n, pos, code, blank, twin, short``.

    Rows alike in conversation, turn, role and text are one entry that stands for
    ``n`` rows from position ``pos``; only keys are put in order, no texts.
    """
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    told = turns.select(_named(F.col("conv_id")).alias("c"), "turn", digest.alias("digest"), "role", "text", "copies")
    distinct = written(
        told.groupBy("c", "turn", "digest").agg(F.any_value("role").alias("role"), F.any_value("text").alias("text"), F.sum("copies").alias("n")),
        "turns",
    )
    last = _last_letter(F.col("text"))
    letter = F.left("role", F.lit(1))
    initial = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    keys = distinct.select(
        "c", "turn", "digest", "n", initial.alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("short")
    )
    placed = with_running(keys, ["c"], ["turn", "digest"], {"upto": ("sum", F.col("n"))})
    placed = written(placed.withColumn("pos", F.col("upto") - F.col("n")).drop("upto"), "places")
    first = placed.groupBy("c", "digest").agg(F.min("pos").alias("pos")).select("c", "pos", F.lit(True).alias("first"))
    faults = placed.join(first, ["c", "pos"], "left").withColumn("first", F.coalesce("first", F.lit(False)))
    return distinct, faults


def _summaries(blocks: DataFrame) -> DataFrame:
    """``c, block, costs, head, tail, illegal`` of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, ends, illegal = [], [], []
            for codes in batch.column("codes"):
                codes = codes.as_py()
                own = np.frombuffer(codes, np.uint8) & 3
                costs.append(block_costs(codes).ravel())
                ends.append((int(own[0]), int(own[-1])))
                illegal.append(int((~_legal(own[:-1], own[1:])).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("c"), batch.column("block"), pa.array(costs, pa.list_(pa.int64())),
                 pa.array([h for h, _ in ends], pa.int32()), pa.array([t for _, t in ends], pa.int32()), pa.array(illegal, pa.int64())],
                ["c", "block", "costs", "head", "tail", "illegal"],
            )

    return blocks.select("c", "block", "codes").mapInArrow(run, "c string, block long, costs array<long>, head int, tail int, illegal long")


def _legal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether initials may follow each other: su, ua, au."""
    return ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))


def _checkpoints(summaries: DataFrame) -> DataFrame:
    """``c, cost, illegal, stops``: per conversation, and the cost vector at the end of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c, parts in zip(batch.column("c"), batch.column("parts")):
                parts, after, stops = parts.as_py(), LEFT.astype(np.int64), []
                for p in reversed(parts):
                    stops.append({"block": p["block"], "after": after.tolist(), "last": p is parts[-1]})
                    after = np.minimum((np.array(p["costs"]).reshape(4, 4) + after).min(1), NEVER)
                seams = [(np.array([a["tail"]]), np.array([b["head"]])) for a, b in zip(parts, parts[1:])]
                illegal = sum(p["illegal"] for p in parts) + sum(int(not _legal(a, b)[0]) for a, b in seams)
                rows.append({"c": c.as_py(), "cost": int(after[0]), "illegal": illegal, "stops": stops})
            yield pa.RecordBatch.from_pylist(rows, schema)

    stop = pa.struct([("block", pa.int64()), ("after", pa.list_(pa.int64())), ("last", pa.bool_())])
    schema = pa.schema([("c", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()), ("stops", pa.list_(stop))])
    # a conversation of n rows has about sqrt(n) blocks
    packed = summaries.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("block", "costs", "head", "tail", "illegal"))).alias("parts"))
    return packed.mapInArrow(run, "c string, cost long, illegal long, stops array<struct<block: long, after: array<long>, last: boolean>>")


def _starts(ready: DataFrame) -> DataFrame:
    """``c, block, start``: the state in which each block begins."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for codes, after, last in zip(*(batch.column(x).to_pylist() for x in ("codes", "after", "last"))):
                costs = vectors(codes, np.array(after))
                # states that cannot end well are never come to
                out.append([walk(codes, costs, s, last)[1] if costs[0][s] < NEVER else 0 for s in range(4)])
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("block"), pa.array(out, pa.list_(pa.int32()))], ["c", "block", "ends"])

    through = ready.select("c", "block", "codes", "after", "last").mapInArrow(ends, "c string, block long, ends array<int>")
    packed = through.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("block", "ends"))).alias("parts"))
    states = F.aggregate(
        "parts", F.array(F.lit(0)), lambda seen, p: F.concat(seen, F.array(F.element_at(p["ends"], F.element_at(seen, -1) + 1)))
    )
    paired = packed.select("c", F.explode(F.arrays_zip(F.col("parts.block").alias("block"), F.slice(states, 1, F.size("parts")).alias("start"))).alias("x"))
    return paired.select("c", "x.block", "x.start")


def repaired(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of every conversation after the cheapest edits, and one row of figures per conversation.

    ``turns`` has ``conv_id, turn, role, text`` without nulls in the last two, and may
    have ``copies`` (how many adjacent rows a row stands for).  Rows are taken by
    turn, a null turn first, equal turns by a hash of role and text.  Blank rows and
    rows whose role and text came earlier must go; a role other than system, user or
    assistant, told by its first letter, can't be kept.  A null ``conv_id`` is a
    conversation like others; other columns are not read; no rows give no rows.

    First result: ``c, pos, step, role, text`` in the order of ``pos, step``.  Second:
    ``c, blank, duplicate, truncated, illegal, cost, audit``.
    """
    if "copies" not in turns.columns:
        turns = turns.withColumn("copies", F.lit(1))
    distinct, faults = _ordered(turns)
    faults = written(faults, "faults")
    counts = faults.groupBy("c").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("n") - F.col("first").cast("int")).otherwise(0)).alias("duplicate"),
        F.sum((~F.col("blank") & F.col("first") & F.col("short")).cast("long")).alias("truncated"),
    )
    counts = written(counts.withColumn("size", F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.sqrt("rows"))).cast("long")), "counts")
    fault = F.when(F.col("blank") | ~F.col("first") | (F.col("k") > 0), 2).otherwise(F.col("short").cast("int"))
    each = faults.join(counts.select("c", "size"), "c").withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    each = each.select("c", (F.col("pos") + F.col("k")).alias("pos"), "size", (F.col("initial") + 4 * fault).alias("code"))
    cut = each.groupBy("c", F.floor(F.col("pos") / F.col("size")).cast("long").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("own"), F.min("pos").alias("from")
    )
    codes = F.unhex(F.array_join(F.transform("own.code", lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), ""))
    blocks = written(cut.select("c", "block", "from", codes.alias("codes")), "blocks")
    stops = written(_checkpoints(_summaries(blocks)), "stops")
    each_stop = stops.select("c", F.explode("stops").alias("s")).select("c", "s.block", "s.after", "s.last")
    ready = written(blocks.join(each_stop, ["c", "block"]), "ready")
    decided = ready.join(_starts(ready), ["c", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("c", "block", "from", "codes", "after", "last", "start")
        for batch in batches:
            rows = []
            for c, block, first, own, after, last, start in zip(*(batch.column(x).to_pylist() for x in names)):
                found, _ = walk(own, vectors(own, np.array(after)), start, last)
                stay = [{"pos": p, "step": k, "role": role, "own": text} for p, k, role, text in lines(found, first, own)]
                rows.append({"c": c, "block": block, "audit": "".join(x for x, _ in found), "stay": stay})
            yield pa.RecordBatch.from_pylist(rows, schema)

    line = pa.struct([("pos", pa.int64()), ("step", pa.int32()), ("role", pa.string()), ("own", pa.bool_())])
    schema = pa.schema([("c", pa.string()), ("block", pa.int64()), ("audit", pa.string()), ("stay", pa.list_(line))])
    walked = written(
        decided.mapInArrow(run, "c string, block long, audit string, stay array<struct<pos: long, step: int, role: string, own: boolean>>"),
        "walked",
    )
    audits = walked.groupBy("c").agg(F.array_join(F.sort_array(F.collect_list(F.struct("block", "audit"))).getField("audit"), "").alias("audit"))
    stay = walked.select("c", F.explode("stay").alias("s")).select("c", "s.pos", "s.step", F.col("s.role").alias("due"), "s.own")
    texts = faults.where("first and not blank").select("c", "pos", "turn", "digest").withColumn("t", F.coalesce("turn", F.lit(0)))
    full = distinct.withColumn("t", F.coalesce("turn", F.lit(0)))
    texts = texts.join(full.select("c", "t", F.col("turn").alias("turn2"), "digest", "role", "text"), ["c", "t", "digest"])
    texts = texts.where(F.col("turn").eqNullSafe(F.col("turn2"))).select("c", "pos", "role", "text")
    own = stay.where("own").join(texts, ["c", "pos"]).select("c", "pos", "step", F.coalesce("due", "role").alias("role"), "text")
    put_in = stay.where("not own").select("c", "pos", "step", F.col("due").alias("role"), F.lit("").alias("text"))
    figures = counts.select("c", "blank", "duplicate", "truncated").join(stops.select("c", "illegal", "cost"), "c").join(audits, "c")
    return own.unionByName(put_in), figures


def digests(rows: DataFrame) -> DataFrame:
    """``c, repaired_sha256``: SHA-256 of each conversation's ``role:text`` lines.

    A digest is made in order, so a conversation's rows pass through one task; they
    stream, and none is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"c": now, "repaired_sha256": state.hexdigest()}])

        for batch in batches:
            for c, role, text in zip(*(batch.column(x) for x in ("c", "role", "text"))):
                c = c.as_py()
                if c != now:
                    if state is not None:
                        yield done()
                    now, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role.as_py()}:{text.as_py()}".encode())
        if state is not None:
            yield done()

    ready = rows.repartition("c").sortWithinPartitions("c", "pos", "step")
    return ready.select("c", "role", "text").mapInArrow(run, "c string, repaired_sha256 string")


def audit(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Figures, edits and the digest of the repaired rows of every ``conv_id`` of ``conversations``.

    Conversations without a row in ``turns`` have zeros, no edits and the digest of nothing.
    """
    told = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "copies" if "copies" in turns.columns else F.lit(1).alias("copies"))
    told = written(told, "told")
    rows, figures = repaired(told)
    spread = told.groupBy(_named(F.col("conv_id")).alias("c")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    )
    every = conversations.select("conv_id").distinct().withColumn("c", _named(column("conv_id")))
    joined = every.join(spread, "c", "left").join(figures, "c", "left").join(digests(rows), "c", "left")
    numbers = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return joined.select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` with every twentieth row dropped, emptied, cut of its sentence ends,
    doubled or given to the user, by CRC32 of ``conv_id:turn``; a null is one space in what is hashed and in role and text."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    dice = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    out = turns.select(
        "conv_id", "turn", F.when(dice == 4, "user").otherwise(role).alias("role"),
        F.when(dice == 1, "").when(dice == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(dice == 3, 2).otherwise(1).alias("copies"), dice.alias("dice"),
    )
    return out.where("dice <> 0").drop("dice")
