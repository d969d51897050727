"""Registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.llm import (
    bpe, chat, divergence, jaccard, line_dedup, mixing, quality_classifier, quality_rules, simhash, structure, token_counts, topk, url_filter,
)
from tallymark.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
PROBE = "</s>[INST] ok [/INST]"
RULES = [
    url_filter.Rule("allow", "org/"), url_filter.Rule("block", "example.org/es/"),
    url_filter.Rule("block", "example.org/en/1"), url_filter.Rule("allow", "com/fr/"), url_filter.Rule("block", "com/de/"),
]


def reply_chains(turns: DataFrame) -> DataFrame:
    """Conversations as reply trees: every turn answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select("conv_id", "role", "text", F.row_number().over(order).alias("n"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"))
    return numbered.select(
        F.concat(name, F.col("n")).alias("message_id"),
        F.when(F.col("n") > 1, F.concat(name, F.col("n") - 1)).alias("parent_id"),
        "role", "text", F.lit(0.0).alias("score"),
    )


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    best = chat.conversations(reply_chains(given.unionByName(probe)))

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(root: str, formatted: str, loss: list[dict]) -> dict:
            turns, learned = hashlib.sha256(), hashlib.sha256()
            read = chat.read_turns(formatted)
            for role, text in read:
                turns.update(f"{role}\n{text}\n".encode())
            texts = chat.read_loss(formatted, [(s["start"], s["length"]) for s in loss])
            for text in texts:
                learned.update(text.encode())
            name = root.rpartition(":")[0]
            return {
                "conv_id": int(name) if name else None, "n_turns": len(read), "turns_sha256": turns.hexdigest(),
                "loss_chars": sum(map(len, texts)), "loss_sha256": learned.hexdigest(), "formatted_chars": len(formatted),
            }

        for batch in batches:
            columns = (batch.column(c) for c in ("root", "formatted", "loss"))
            rows = [row(*(v.as_py() for v in values)) for values in zip(*columns)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return best.select("root", "formatted", "loss").mapInArrow(
        read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


OP1 = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), turns AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS escaped,
    regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS name,
  FROM given
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(name) + length(escaped) + length('<s></s>') + 1) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality_rules.judge(documents, quality_rules.fit(documents, table(spark, sf_dir, "labels")))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality_classifier.score(documents, quality_classifier.fit(documents, table(spark, sf_dir, "labels")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


OP6 = """
WITH sources AS (SELECT source, count(*) AS n, pow(count(*), 0.7) AS weight FROM documents GROUP BY source),
rates AS (SELECT source, sum(n) OVER () * weight / sum(weight) OVER () / n AS rate FROM sources),
steps AS (
  SELECT source, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS up_to
  FROM rates, range(0, 400) AS r(k) WHERE k <= rate + 12 * sqrt(rate) + 30
), named AS (
  SELECT *, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS name FROM documents
), drawn AS (
  SELECT d.*, (
    SELECT count(*) FROM steps AS s WHERE s.source IS NOT DISTINCT FROM d.source
      AND s.up_to <= CAST('0x' || substr(md5('mix|' || name || '|1'), 1, 13) AS BIGINT) / 4503599627370496.0
  ) AS copies FROM named AS d
)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, md5('mix|place|' || name || '|' || copy) AS mix_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM drawn)
"""


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, RULES, url_filter.labelled_by_rules(pages, RULES))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), PIECE_BPE)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "text")


OP9 = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line
  FROM documents
), worded AS (
  SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k
  FROM lines WHERE regexp_matches(line, '[^ \t\n\x0b\x0c\r]')
), windows AS (
  SELECT a.doc_id, a.pos AS first, c.pos AS last, a.line || chr(10) || b.line || chr(10) || c.line AS body
  FROM worded a JOIN worded b ON a.doc_id = b.doc_id AND b.k = a.k + 1 JOIN worded c ON a.doc_id = c.doc_id AND c.k = a.k + 2
), later AS (
  SELECT doc_id, first, last FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM later
)
SELECT l.doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(g.pos) AS INTEGER) AS n_removed,
  coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS text
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
"""


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where("vec_id % 20 = 0"), 20)


OP10 = """
WITH q AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.own, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM q a JOIN q b ON a.own <> b.own WHERE a.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""

def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP11 = r"""
WITH given AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM given
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 3
), cells AS (
  SELECT w.lang, source, w.term, count(*) AS n FROM words AS w JOIN kept USING (lang, term) GROUP BY w.lang, source, w.term
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), groups AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM given) AS g
  LEFT JOIN cells AS c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + (1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT) // (g.total + l.v)::HUGEINT AS HUGEINT) AS p,
    CAST(1 + (1000000000 * (k.n + 1)::HUGEINT) // (l.total + l.v)::HUGEINT AS HUGEINT) AS q
  FROM groups AS g JOIN langs AS l ON l.lang = g.lang JOIN kept AS k ON k.lang = g.lang
  LEFT JOIN cells AS c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares AS a JOIN shares AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs AS p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every
) WHERE part = 'pair' OR rank <= 200
"""


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return structure.audit(structure.damaged(given), given)


def _structure_sql() -> str:
    """The same repair as a forward recursion over rows: per state the least (cost, edits, rows so far)."""

    def paid(state: str, cost: str, letter: str, said: str = "''") -> str:
        return f"struct_pack(cost := {state}.cost + {cost}, audit := {state}.audit || '{letter}', said := {state}.said || {said})"

    def least(*choices: str) -> str:
        return f"list_sort([{', '.join(choices)}])[1]"

    def keep(state: str, initial: str) -> str:
        rest = paid(state, "short", "K", "role || ':' || text || chr(10)")
        return f"CASE WHEN initial = '{initial}' AND NOT gone THEN {rest} ELSE never END"

    def rerole(state: str, role: str) -> str:
        rest = paid(state, "(2 + short)", "R", f"'{role}:' || text || chr(10)")
        return f"CASE WHEN NOT gone THEN {rest} ELSE never END"

    def delete(state: str) -> str:
        return paid(state, "3", "D")

    def insert(state: str, role: str) -> str:
        return paid(state, "2", "I", f"'{role}:' || chr(10)")

    user = [keep(s, "u") for s in ("s0", "s1", "s3")] + [rerole(s, "user") for s in ("s0", "s1", "s3")]
    return f"""
WITH RECURSIVE bits AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
    FROM range(256) AS r(n))
), given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), diced AS (
  SELECT given.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS dice FROM given, bits
), damaged AS (
  SELECT conv_id, turn, CASE WHEN dice = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN dice = 1 THEN '' WHEN dice = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN dice = 3 THEN 2 ELSE 1 END)) AS copy
  FROM diced WHERE dice <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS n,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS initial FROM damaged
), twins AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS twin,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM placed
), faults AS (
  SELECT *, bare = '' AS blank, bare <> '' AND twin > 1 AS duplicate, bare = '' OR twin > 1 AS gone,
    CAST(bare <> '' AND twin = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS INTEGER) AS short FROM twins
), figures AS (
  SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(CAST(blank AS INTEGER)) AS blank,
    sum(CAST(duplicate AS INTEGER)) AS duplicate, sum(short) AS truncated,
    sum(CASE WHEN n > 1 AND coalesce(before, '') || initial NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END) AS illegal
  FROM faults GROUP BY conv_id
), walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, struct_pack(cost := 0, audit := '', said := '') AS s0,
    struct_pack(cost := 1000000, audit := '', said := '') AS s1,
    struct_pack(cost := 2, audit := 'I', said := 'user:' || chr(10)) AS s2,
    struct_pack(cost := 4, audit := 'II', said := 'user:' || chr(10) || 'assistant:' || chr(10)) AS s3 FROM figures
  UNION ALL
  SELECT conv_id, n, t0 AS s0, t1 AS s1, u2 AS s2, {least("t3", insert("u2", "assistant"))} AS s3 FROM (
    SELECT *, {least("t2", *[insert(t, "user") for t in ("t0", "t1", "t3")])} AS u2 FROM (
      SELECT *, {delete("s0")} AS t0, {least(delete("s1"), keep("s0", "s"))} AS t1, {least(delete("s2"), *user)} AS t2,
        {least(delete("s3"), keep("s2", "a"), rerole("s2", "assistant"))} AS t3
      FROM (SELECT w.conv_id, f.n, s0, s1, s2, s3, f.role, f.text, f.initial, f.gone, f.short,
              struct_pack(cost := 1000000, audit := '', said := '') AS never
            FROM walk AS w JOIN faults AS f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n + 1)
    )
  )
), ended AS (
  SELECT f.*, {least("s0", "s3")} AS best FROM walk AS w JOIN figures AS f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.rows = w.n
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit,
  sha256(coalesce(left(best.said, length(best.said) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN ended AS e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


OP12 = _structure_sql()

def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_quality_rules, op3_bpe, op4_quality_classifier, op5_simhash, op6_mixing, op7_url_filter,
        op8_token_counts, op9_line_dedup, op10_topk, op11_source_divergence, op12_structure_repair,
        op13_jaccard_join,
    )
}
ORACLES = {"op1_chat_formatting": OP1, "op6_mixing": OP6, "op9_line_dedup": OP9, "op10_topk": OP10, "op11_source_divergence": OP11, "op12_structure_repair": OP12}
