"""Samples, prompts, pairing and answer scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.functions import lexicons as lx
from tallymark.functions import text as tx
from tallymark.operators import pairing, samples as sm, scoring, vector_join
from tallymark.operators.catalog import MODELS
from tallymark.operators.joins import salted_join
from tallymark.plans.oracle_views import quoted, rows, sql_list, sql_strip, sql_words
from tallymark.plans.registry import query, rounded
from tallymark.sources import views


# --- samples -----------------------------------------------------------------


@query(
    "d1_filter_samples",
    """SELECT sample_id, language, category, difficulty, md5(question) AS question_md5 FROM samples
       WHERE language = 'en' AND category = 'src3' AND difficulty = 'medium'""",
)
def d1(spark, d):
    kept = sm.filter_samples(views.samples(spark, d), "en", "src3", "medium")
    return kept.select("sample_id", "language", "category", "difficulty", F.md5("question").alias("question_md5"))


@query("d2_sample_by_id", "SELECT sample_id, language, category, md5(answer) AS answer_md5 FROM samples WHERE sample_id = 42")
def d2(spark, d):
    return sm.sample_by_id(views.samples(spark, d), 42).select(
        "sample_id", "language", "category", F.md5("answer").alias("answer_md5")
    )


@query(
    "d3_seeded_sample",
    """SELECT category, sample_id FROM (
           SELECT category, sample_id,
                  row_number() OVER (PARTITION BY category ORDER BY ((sample_id % 1000003) * 2654435761 + 42 * 40503)
                                     % 4294967296, sample_id) AS r FROM samples)
       WHERE r <= 30""",
)
def d3(spark, d):
    lean = views.samples(spark, d).select("category", "sample_id")
    return sm.seeded_sample(lean, ["category"], "sample_id", 30)


@query(
    "d4_batches",
    """SELECT category, batch, count(*) AS n, min(sample_id) AS first_id, max(sample_id) AS last_id
       FROM (SELECT category, sample_id,
                    (row_number() OVER (PARTITION BY category ORDER BY sample_id) - 1) // 8 AS batch FROM samples)
       GROUP BY category, batch""",
)
def d4(spark, d):
    lean = views.samples(spark, d).select("category", "sample_id")
    return sm.batches(lean, ["category"], ["sample_id"], 8).groupBy("category", "batch").agg(
        F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first_id"), F.max("sample_id").alias("last_id")
    )


@query(
    "d5_head_caps",
    """SELECT model, dataset, request_id, position::INTEGER AS position FROM (
           SELECT model, dataset, request_id,
                  row_number() OVER (PARTITION BY model, dataset ORDER BY request_id) AS position FROM responses)
       WHERE position <= 20""",
)
def d5(spark, d):
    lean = views.responses(spark, d).select("model", "dataset", "request_id")
    return sm.head(lean, ["model", "dataset"], ["request_id"], 20)


_STATS = """count(*) AS n, round(avg(length(question)), 6) AS avg_question_length, max(length(question))::INTEGER AS max_question_length,
            min(length(question))::INTEGER AS min_question_length, round(avg(length(answer)), 6) AS avg_answer_length,
            max(length(answer))::INTEGER AS max_answer_length, min(length(answer))::INTEGER AS min_answer_length"""


@query(
    "d6_dataset_profile",
    f"""SELECT 'all' AS dimension, NULL AS value, {_STATS} FROM samples
        UNION ALL SELECT 'language', language, {_STATS} FROM samples WHERE language <> '' GROUP BY language
        UNION ALL SELECT 'category', category, {_STATS} FROM samples WHERE category <> '' GROUP BY category
        UNION ALL SELECT 'difficulty', difficulty, {_STATS} FROM samples WHERE difficulty <> '' GROUP BY difficulty""",
)
def d6(spark, d):
    return rounded(sm.profile(views.samples(spark, d)))


FAMILY = """CASE WHEN contains(lower(model_path), 'llama') THEN
                     CASE WHEN contains(model_path, '3.2') THEN 'llama3.2' WHEN contains(model_path, '3.1') THEN 'llama3.1'
                          WHEN contains(model_path, '3') THEN 'llama3' ELSE 'llama2' END
                 WHEN contains(lower(model_path), 'qwen') THEN
                     CASE WHEN contains(model_path, '2.5') THEN 'qwen2.5' ELSE 'qwen1.5' END
                 WHEN contains(lower(model_path), 'mistral') THEN 'mistral'
                 WHEN contains(lower(model_path), 'gemma') THEN 'gemma' ELSE 'unknown' END"""


@query(
    "d7_model_family",
    f"""SELECT {FAMILY} AS family, model, count(*) AS responses, count(*) FILTER (error) AS errors
        FROM responses JOIN models USING (model) GROUP BY ALL""",
)
def d7(spark, d):
    log = views.responses(spark, d).groupBy("model").agg(
        F.count(F.lit(1)).alias("responses"), F.count_if(F.col("error")).alias("errors")
    )
    named = log.join(F.broadcast(views.models(spark)), "model")  # the catalog is a few rows of configuration
    return named.select(sm.model_family(F.col("model_path")).alias("family"), "model", "responses", "errors")


def _templates_sql():
    body = rows([(quoted(f), quoted(a), quoted(b)) for f, (a, b) in lx.PROMPT_TEMPLATES.items()])
    return f"(SELECT * FROM (VALUES {body}) AS t(family, plain, with_context))"


@query(
    "d8_prompts",
    f"""SELECT sample_id, model, family, length(prompt)::INTEGER AS chars, md5(prompt) AS prompt_md5
        FROM (SELECT sample_id, model, f.family,
                     CASE WHEN t.family IS NULL THEN question
                          WHEN context = '' THEN replace(plain, '{{question}}', question)
                          ELSE replace(replace(with_context, '{{context}}', context), '{{question}}', question) END AS prompt
              FROM (SELECT *, CASE WHEN difficulty = 'hard' THEN answer ELSE '' END AS context FROM samples),
                   (SELECT model, {FAMILY} AS family FROM models) f
              LEFT JOIN {_templates_sql()} t ON t.family = f.family)""",
)
def d8(spark, d):
    """Every sample as a prompt for every catalog model."""
    s = views.samples(spark, d).withColumn("context", F.when(F.col("difficulty") == "hard", F.col("answer")))
    due = sm.fan_out(s).withColumn("family", sm.model_family(F.col("model_path")))
    prompt = sm.render_prompt(F.col("family"), F.col("question"), F.col("context"))
    return due.select("sample_id", "model", "family", prompt.alias("prompt")).select(
        "sample_id", "model", "family", F.length("prompt").alias("chars"), F.md5("prompt").alias("prompt_md5")
    )


@query(
    "d9_prompt_hygiene",
    f"""SELECT sample_id, {sql_strip("question")} = '' AS rejected, length(question) > 3000 AS truncated,
               length({sql_strip("substring(question, 1, 3000)")})::INTEGER AS chars,
               md5({sql_strip("substring(question, 1, 3000)")}) AS prompt_md5 FROM samples""",
)
def d9(spark, d):
    out = sm.clean_prompts(views.samples(spark, d), "question", limit=3000)
    return out.select(
        "sample_id", "rejected", "truncated", F.length("question").alias("chars"), F.md5("question").alias("prompt_md5")
    )


@query(
    "d10_unmatched_ids",
    """SELECT sample_id, count(*) AS predictions, 'truth' AS missing FROM responses
       WHERE sample_id NOT IN (SELECT sample_id FROM samples) GROUP BY sample_id
       UNION ALL
       SELECT sample_id, 0, 'prediction' FROM samples WHERE sample_id NOT IN (SELECT sample_id FROM responses)""",
)
def d10(spark, d):
    return pairing.unmatched(views.responses(spark, d), views.samples(spark, d))


# --- pairing -----------------------------------------------------------------


@query(
    "j1_predictions_with_truth",
    """SELECT model, count(*) AS predictions, count(*) FILTER (error) AS failures,
              count(*) FILTER (s.sample_id IS NULL) AS unmatched, coalesce(sum(length(answer)), 0)::BIGINT AS answer_chars
       FROM responses r LEFT JOIN samples s ON r.sample_id = s.sample_id GROUP BY model""",
)
def j1(spark, d):
    truths = views.samples(spark, d).select("sample_id", F.length("answer").alias("chars"))
    paired = pairing.with_truth(views.responses(spark, d), truths)
    return paired.groupBy("model").agg(
        F.count(F.lit(1)).alias("predictions"),
        F.count_if(F.col("error")).alias("failures"),
        F.count_if(F.col("chars").isNull()).alias("unmatched"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("answer_chars"),
    )


@query(
    "j2_predictions_with_stats",
    """SELECT model, count(*) AS predictions, count(*) FILTER (NOT error) AS with_stats,
              round(avg(tokens_per_second) FILTER (NOT error), 6) AS tokens_per_second
       FROM responses GROUP BY model""",
)
def j2(spark, d):
    r = views.responses(spark, d)
    stats = r.where(~F.col("error")).select("request_id", "tokens_per_second", "memory_usage_mb")
    paired = pairing.with_stats(r.select("request_id", "model"), stats)
    return rounded(
        paired.groupBy("model").agg(
            F.count(F.lit(1)).alias("predictions"),
            F.count("memory_usage_mb").alias("with_stats"),
            F.avg("tokens_per_second").alias("tokens_per_second"),
        )
    )


@query(
    "j3_model_coverage",
    """WITH a AS (SELECT sample_id, model, count(*) AS n, count(*) FILTER (error) AS failed FROM responses GROUP BY ALL)
       SELECT model, count(*) AS prompts, count(n) AS answered, coalesce(sum(n), 0)::BIGINT AS responses,
              coalesce(sum(failed), 0)::BIGINT AS errors, count(*) FILTER (n IS NULL) AS missing
       FROM (SELECT sample_id, model FROM samples, (SELECT model FROM models)) LEFT JOIN a USING (sample_id, model)
       GROUP BY model""",
)
def j3(spark, d):
    due = sm.fan_out(views.samples(spark, d).select("sample_id"), MODELS)
    return pairing.coverage(due, views.responses(spark, d))


# --- scoring -----------------------------------------------------------------


@query(
    "e1_exact_match",
    f"""SELECT doc_id, ref_id,
               CASE WHEN {sql_strip("prediction")} = '' OR {sql_strip("truth")} = '' THEN 0
                    ELSE (lower({sql_strip("prediction")}) = lower({sql_strip("truth")}))::INT END::DOUBLE AS score,
               (lower({sql_strip("prediction")}) = lower({sql_strip("truth")}))::INT::DOUBLE AS score_blank_equal
        FROM partners""",
)
def e1(spark, d):
    """Documents against every partner they share a line or their text with, compared by digests: no text is shuffled."""
    digests = views.text_digests(spark, d)
    pairs = views.partners(spark, d).join(digests.withColumnRenamed("digest", "prediction"), "doc_id")
    truths = digests.select(F.col("doc_id").alias("ref_id"), F.col("digest").alias("truth"))
    p, t = F.col("prediction"), F.col("truth")
    return salted_join(pairs, truths, ["ref_id"], ["doc_id"]).select(
        "doc_id", "ref_id", tx.exact_match(p, t).alias("score"), tx.exact_match(p, t, True).alias("score_blank_equal")
    )


@query(
    "e2_contains",
    f"""SELECT doc_id, item_id, 1.0::DOUBLE AS score FROM documents d JOIN benchmark b
        ON contains(lower({sql_strip("d.text")}), lower({sql_strip("b.text")}))""",
)
def e2(spark, d):
    """All documents that quote a benchmark item whole."""
    pairs = views.pairs_contains(spark, d)
    scored = pairs.select("doc_id", "item_id", tx.contains_match(F.col("prediction"), F.col("truth")).alias("score"))
    return scored.where(F.col("score") == 1)


@query("e3_sequence_similarity")
def e3(spark, d):
    p, t = F.col("prediction"), F.col("truth")
    out = views.pairs_similar(spark, d).select("doc_id", "ref_id", scoring.similarity(p, t, True).alias("score"))
    return rounded(out.withColumn("correct", F.col("score") > 0.8))


@query(
    "e3_similarity_bound",
    """SELECT doc_id, ref_id, round(2 * least(length(prediction), length(truth)) / (length(prediction) + length(truth)), 6)
                  AS bound FROM partners""",
)
def e3_bound(spark, d):
    pairs = views.pairs_similar(spark, d)
    return rounded(
        pairs.select("doc_id", "ref_id", tx.similarity_bound(F.col("prediction"), F.col("truth")).alias("bound"))
    )


@query("e3_similar_enough")
def e3_correct(spark, d):
    pairs = views.pairs_similar(spark, d)
    return pairs.select("doc_id", "ref_id", scoring.similar_enough(F.col("prediction"), F.col("truth")).alias("correct"))


MATH_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
MATH_KEYS = ", ".join(MATH_KEY)


def _number_sql(expr):
    found = [f"try_cast(replace(regexp_extract({expr}, {quoted(p)}, 1), ',', '.') AS DOUBLE)" for p in lx.ANSWER_PATTERNS]
    return f"coalesce({', '.join(found)})"


@query(
    "e4_numeric_answer",
    f"""SELECT {MATH_KEYS}, a AS extracted_pred, b AS extracted_truth, coalesce(abs(a - b) < 1e-6, false) AS correct
        FROM (SELECT *, {_number_sql("prediction")} AS a, {_number_sql("truth")} AS b FROM math_answers)""",
)
def e4(spark, d):
    out = views.math_answers(spark, d).select(
        *MATH_KEY,
        tx.numeric_answer(F.col("prediction")).alias("extracted_pred"),
        tx.numeric_answer(F.col("truth")).alias("extracted_truth"),
    )
    return out.withColumn("correct", tx.numbers_agree(F.col("extracted_pred"), F.col("extracted_truth")))


_STEPS = f"""list_filter(list_transform(string_split(prediction, chr(10)), lambda x: {sql_strip("x")}),
                 lambda x: regexp_matches(x, {quoted("|".join(lx.STEP_INDICATORS))})
                      OR (contains(x, '=') AND regexp_matches(x, '[0-9]')))"""


@query(
    "e5_reasoning_steps",
    f"SELECT {MATH_KEYS}, len({_STEPS})::INTEGER AS n_steps, array_to_string({_STEPS}, ' | ') AS steps FROM math_answers",
)
def e5(spark, d):
    steps = tx.reasoning_steps(F.col("prediction"))
    out = views.math_answers(spark, d).select(*MATH_KEY, steps.alias("s"))
    return out.select(*MATH_KEY, F.size("s").alias("n_steps"), F.array_join("s", " | ").alias("steps"))


def _hits(expr, values):
    return "(" + " + ".join(f"contains({expr}, {quoted(v)})::INT" for v in values) + ")"


_QUALITY = """CASE WHEN n = 0 THEN 0 ELSE least(0.3 * least(n / 5, 1) + 0.3 * least(c / n, 0.5) + 0.4 * least(f / n, 1), 1) END"""


@query(
    "e6_reasoning_quality",
    f"""SELECT {MATH_KEYS}, round({_QUALITY}, 6) AS reasoning_quality
        FROM (SELECT *, len(s) AS n, coalesce(list_sum(list_transform(s, lambda x: {_hits("x", lx.LOGICAL_WORDS)})), 0) AS c,
                     len(list_filter(s, lambda x: {_hits("x", lx.FORMULA_SIGNS)} > 0)) AS f
              FROM (SELECT *, {_STEPS} AS s FROM math_answers))""",
)
def e6(spark, d):
    quality = tx.reasoning_quality(tx.reasoning_steps(F.col("prediction")))
    return rounded(views.math_answers(spark, d).select(*MATH_KEY, quality.alias("reasoning_quality")))


_HEDGING = f"""greatest(0, least(1, 0.5 + 0.1 * {_hits("prediction", lx.SURE_WORDS)} - 0.1 * {_hits("prediction", lx.UNSURE_WORDS)}
                 + 0.2 * (contains(prediction, '=') AND regexp_matches(prediction, '[0-9]'))::INT))"""


@query(
    "e7_math_confidence",
    f"SELECT {MATH_KEYS}, round({_HEDGING}, 6) AS confidence FROM math_answers",
)
def e7(spark, d):
    return rounded(
        views.math_answers(spark, d).select(*MATH_KEY, tx.math_confidence(F.col("prediction")).alias("confidence"))
    )


def _norm(expr):
    return f"lower(regexp_replace(regexp_replace({sql_strip(expr)}, '\\s+', ' ', 'g'), {quoted(lx.PUNCTUATION)}, '', 'g'))"


EXACT = f"({_norm('prediction')} = {_norm('truth')})::INT"
_WANTED = f"list_distinct(list_filter(regexp_extract_all(truth, '[가-힣]{{2,}}'), lambda w: NOT list_contains({sql_list(lx.STOPWORDS)}, w)))"
RECALL = f"""CASE WHEN len({_WANTED}) = 0 THEN 0
                  ELSE len(list_filter({_WANTED}, lambda k: contains(lower(prediction), k))) / len({_WANTED}) END"""


@query("e8_normalized_match", f"SELECT request_id, ({EXACT})::DOUBLE AS exact_score FROM qa_answers")
def e8(spark, d):
    return views.qa_answers(spark, d).select(
        "request_id", tx.normalized_match(F.col("prediction"), F.col("truth")).alias("exact_score")
    )


@query("e9_keyword_recall", f"SELECT request_id, round({RECALL}, 6) AS keyword_score FROM qa_answers")
def e9(spark, d):
    return rounded(
        views.qa_answers(spark, d).select(
            "request_id", tx.keyword_recall(F.col("prediction"), F.col("truth")).alias("keyword_score")
        )
    )


def _dot(a, b):
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"


COSINE = f"""CASE WHEN {_dot("embedding", "embedding")} * {_dot("ref", "ref")} = 0 THEN 0
                  ELSE greatest(0, {_dot("embedding", "ref")}
                       / (sqrt({_dot("embedding", "embedding")}) * sqrt({_dot("ref", "ref")}))) END"""


@query("e10_embedding_similarity", f"SELECT vec_id, ref_id, label, round({COSINE}, 6) AS semantic_score FROM vector_pairs")
def e10(spark, d):
    pairs = views.vector_pairs(spark, d)
    return rounded(
        pairs.select("vec_id", "ref_id", "label", tx.cosine(F.col("embedding"), F.col("ref")).alias("semantic_score"))
    )


SIMILAR_VECTORS = 0.3


@query(
    "e10_similar_vectors",
    f"""SELECT label, a, b, round(cosine, 6) AS cosine FROM (
            SELECT x.label, x.vec_id AS a, y.vec_id AS b, {_dot("x.embedding", "y.embedding")}
                   / (sqrt({_dot("x.embedding", "x.embedding")}) * sqrt({_dot("y.embedding", "y.embedding")})) AS cosine
            FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id)
        WHERE cosine >= {SIMILAR_VECTORS}""",
)
def e10_pairs(spark, d):
    """All pairs of a label whose cosine reaches the threshold."""
    vectors = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return rounded(vector_join.pairs_above(vectors, SIMILAR_VECTORS))


@query(
    "e11_qa_composite",
    f"""SELECT request_id, round(score, 6) AS score, score > 0.7 AS correct
        FROM (SELECT request_id, {EXACT} * 0.4 + 0.2 * ({RECALL}) AS score FROM qa_answers)""",
)
def e11(spark, d):
    p, t = F.col("prediction"), F.col("truth")
    score = tx.qa_composite(tx.normalized_match(p, t), F.lit(0.0), tx.keyword_recall(p, t))
    out = views.qa_answers(spark, d).select("request_id", score.alias("score"))
    return rounded(out.withColumn("correct", F.col("score") > scoring.QA_CORRECT_ABOVE))


@query(
    "e11_qa_composite_with_vectors",
    f"""SELECT request_id, round(e * 0.4 + c * 0.4 + r * 0.2, 6) AS score, e * 0.4 + c * 0.4 + r * 0.2 > 0.7 AS correct
        FROM (SELECT request_id, coalesce(c, 0) AS c, {EXACT} AS e, {RECALL} AS r
              FROM qa_answers LEFT JOIN (SELECT vec_id AS request_id, {COSINE} AS c FROM vector_pairs) USING (request_id))""",
)
def e11_vectors(spark, d):
    """All answers; one without a vector has no semantic part."""
    p, t = F.col("prediction"), F.col("truth")
    vectors = views.vector_pairs(spark, d).select(
        F.col("vec_id").alias("request_id"), tx.cosine(F.col("embedding"), F.col("ref")).alias("semantic")
    )
    joined = views.qa_answers(spark, d).join(vectors, "request_id", "left")
    semantic = F.coalesce("semantic", F.lit(0.0))
    score = tx.qa_composite(tx.normalized_match(p, t), semantic, tx.keyword_recall(p, t))
    out = joined.select("request_id", score.alias("score"))
    return rounded(out.withColumn("correct", F.col("score") > scoring.QA_CORRECT_ABOVE))


_BLANK = f"{sql_strip('prediction')} = ''"
_WORDS = sql_words("prediction")


_COMPLETE = f"""CASE WHEN {_BLANK} THEN 0 ELSE
                 0.4 * ({" OR ".join(f"ends_with({sql_strip('prediction')}, {quoted(e)})" for e in lx.SENTENCE_ENDINGS)})::INT
                 + 0.3 * (length({sql_strip("prediction")}) >= 5)::INT + 0.3 * (len({_WORDS}) >= 2)::INT END"""


@query("e12_completeness", f"SELECT request_id, round({_COMPLETE}, 6) AS completeness FROM qa_answers")
def e12(spark, d):
    return rounded(views.qa_answers(spark, d).select("request_id", tx.completeness(F.col("prediction")).alias("completeness")))


_CHARS = "string_split(prediction, '')"
_RUN = f"""len(list_filter(range(1, len({_CHARS}) - 2), lambda i: ({_CHARS})[i] <> chr(10) AND ({_CHARS})[i] = ({_CHARS})[i + 1]
               AND ({_CHARS})[i] = ({_CHARS})[i + 2] AND ({_CHARS})[i] = ({_CHARS})[i + 3])) > 0"""


_FLUENT = f"""CASE WHEN {_BLANK} THEN 0 ELSE greatest(0, least(1, 0.5
                 + CASE WHEN len({_WORDS}) > 1 THEN (len(list_distinct({_WORDS})) / len({_WORDS}) - 0.5) * 0.3 ELSE 0 END
                 + least({_hits("prediction", lx.CONNECTORS)} * 0.1, 0.2) - 0.1 * ({_RUN})::INT
                 - 0.1 * regexp_matches(prediction, '[가-힣][a-zA-Z][가-힣]')::INT)) END"""


@query("e13_fluency", f"SELECT request_id, round({_FLUENT}, 6) AS fluency FROM qa_answers")
def e13(spark, d):
    return rounded(views.qa_answers(spark, d).select("request_id", tx.fluency(F.col("prediction")).alias("fluency")))


_QA_SURE = f"""CASE WHEN {_BLANK} THEN 0 ELSE greatest(0, least(1, 0.5
                 + 0.1 * ({_hits("prediction", lx.SURE_EXPRESSIONS)} - {_hits("prediction", lx.UNSURE_EXPRESSIONS)}
                          + regexp_matches(prediction, '[0-9]')::INT
                          + (len(regexp_extract_all(prediction, '[가-힣]{{3,}}')) > 2)::INT))) END"""


@query("e14_qa_confidence", f"SELECT request_id, round({_QA_SURE}, 6) AS confidence FROM qa_answers")
def e14(spark, d):
    return rounded(views.qa_answers(spark, d).select("request_id", tx.qa_confidence(F.col("prediction")).alias("confidence")))


@query(
    "e15_token_efficiency",
    f"""SELECT conv_id, turn, round(len(list_filter({_WORDS}, lambda w: length(w) > 2)) / tokens, 6) AS token_efficiency
        FROM (SELECT *, CASE WHEN turn % 2 = 1 THEN length(prediction) // 4 + 1 ELSE len({_WORDS}) END AS tokens FROM chat_pairs)""",
)
def e15(spark, d):
    """Odd turns count a token per four letters; others fall back to words."""
    tokens = F.when(F.col("turn") % 2 == 1, F.floor(F.length("prediction") / 4) + 1)
    pairs = views.chat_pairs(spark, d)
    return rounded(pairs.select("conv_id", "turn", tx.token_efficiency(F.col("prediction"), tokens).alias("token_efficiency")))


_PERF = """(CASE WHEN tokens_per_second > 0 THEN least(tokens_per_second / 100, 1) ELSE 1 END
            * greatest(0.1, least(8000 / memory_usage_mb, 1)))"""


@query("e16_performance_score", f"SELECT request_id, round({_PERF}, 6) AS performance_score FROM responses")
def e16(spark, d):
    score = tx.performance_score(F.col("tokens_per_second"), F.col("memory_usage_mb"))
    return rounded(views.responses(spark, d).select("request_id", score.alias("performance_score")))


def routed(spark, d, native_only=False):
    """Answers of every kind with the evaluator that shall score them."""
    math = views.math_answers(spark, d).select(
        F.concat_ws("-", F.lit("math"), *MATH_KEY).alias("request_id"), "prediction", "truth",
        F.lit("korean_math").alias("evaluator"),
    )
    prose = views.qa_answers(spark, d).select(
        F.concat_ws("-", F.lit("qa"), "request_id").alias("request_id"),
        F.when(F.col("request_id") % 17 != 0, F.col("prediction")).alias("prediction"), "truth",
        F.lit("korean_qa").alias("evaluator"),
    )
    if native_only:
        return math.unionByName(prose)
    similar = views.pairs_similar(spark, d).select(
        F.concat_ws("-", F.lit("doc"), "doc_id", "ref_id").alias("request_id"), "prediction", "truth",
        F.when(F.col("doc_id") % 3 == 0, "performance").when(F.col("doc_id") % 3 == 1, "basic").otherwise("nonesuch")
        .alias("evaluator"),
    )
    return math.unionByName(prose).unionByName(similar)


@query("e17_performance_composite")
def e17(spark, d):
    """Similarity blended with the speed of the request of the same id."""
    pairs = views.pairs_similar(spark, d).withColumn("evaluator", F.lit("performance"))
    stats = views.responses(spark, d).select(
        F.col("request_id").alias("doc_id"), "tokens_per_second", "memory_usage_mb"
    )
    both = scoring.evaluate(pairs.join(stats, "doc_id", "left"))
    return rounded(both.select("doc_id", "ref_id", "tokens_per_second", "memory_usage_mb", "score", "correct"))


@query("e18_evaluator_dispatch")
def e18(spark, d):
    out = scoring.evaluate(routed(spark, d))
    return rounded(
        out.groupBy("evaluator", "used").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("correct")).alias("correct_count"),
            F.avg("score").alias("average_score"),
            F.avg("confidence").alias("average_confidence"),
            F.count("error").alias("errors"),
        )
    )


@query(
    "e18_native_dispatch",
    f"""SELECT 'korean_math' AS used, count(*) AS n, count(*) FILTER (coalesce(abs(a - b) < 1e-6, false)) AS correct_count,
               round(avg((coalesce(abs(a - b) < 1e-6, false))::INT), 6) AS average_score, 0 AS errors
        FROM (SELECT {_number_sql("prediction")} AS a, {_number_sql("truth")} AS b FROM math_answers)
        UNION ALL
        SELECT 'korean_qa', count(*), count(*) FILTER (score > 0.7), round(avg(score), 6),
               count(*) FILTER (request_id % 17 = 0)
        FROM (SELECT request_id, CASE WHEN request_id % 17 = 0 THEN 0 ELSE {EXACT} * 0.4 + 0.2 * ({RECALL}) END AS score
              FROM qa_answers)""",
)
def e18_native(spark, d):
    """The dispatch over the evaluators that need no Python."""
    out = scoring.evaluate(routed(spark, d, native_only=True))
    return rounded(
        out.groupBy("used").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("correct")).alias("correct_count"),
            F.avg("score").alias("average_score"),
            F.count("error").alias("errors"),
        )
    )


@query(
    "e18_math_details",
    f"""SELECT {MATH_KEYS}, coalesce(abs(a - b) < 1e-6, false)::INT::DOUBLE AS score, coalesce(abs(a - b) < 1e-6, false) AS correct,
               round({_HEDGING}, 6) AS confidence, a AS extracted_pred, b AS extracted_gt, round({_QUALITY}, 6) AS reasoning_quality,
               'korean' AS language, array_to_string(s, ' | ') AS steps
        FROM (SELECT *, len(s) AS n, coalesce(list_sum(list_transform(s, lambda x: {_hits("x", lx.LOGICAL_WORDS)})), 0) AS c,
                     len(list_filter(s, lambda x: {_hits("x", lx.FORMULA_SIGNS)} > 0)) AS f
              FROM (SELECT *, {_STEPS} AS s, {_number_sql("prediction")} AS a, {_number_sql("truth")} AS b FROM math_answers))""",
)
def e18_math(spark, d):
    """Every math answer with what the evaluator extracted, its steps and their quality."""
    out = scoring.with_details_by_text(views.math_answers(spark, d), "korean_math").withColumn("steps", F.array_join("reasoning_steps", " | "))
    told = ["score", "correct", "confidence", "extracted_pred", "extracted_gt", "reasoning_quality", "language", "steps"]
    return rounded(out.select(*MATH_KEY, *told))


@query(
    "e18_qa_details",
    f"""SELECT request_id, round(exact_score * 0.4 + keyword_score * 0.2, 6) AS score, exact_score * 0.4 + keyword_score * 0.2 > 0.7 AS correct,
               round({_QA_SURE}, 6) AS confidence, exact_score::DOUBLE AS exact_score, 0.0::DOUBLE AS semantic_score,
               round(keyword_score, 6) AS keyword_score, round({_COMPLETE}, 6) AS completeness, round({_FLUENT}, 6) AS fluency
        FROM (SELECT *, {EXACT} AS exact_score, {RECALL} AS keyword_score FROM qa_answers)""",
)
def e18_qa(spark, d):
    """Every prose answer with the parts of its score, its completeness and its fluency."""
    out = scoring.with_details(views.qa_answers(spark, d), "korean_qa")
    told = ["score", "correct", "confidence", "exact_score", "semantic_score", "keyword_score", "completeness", "fluency"]
    return rounded(out.select("request_id", *told))


def _word_overlap(prediction: str, truth: str, row: dict) -> dict:
    """Share of the truth's words that the prediction has; a truth without words can't be scored."""
    wanted = set(truth.split())
    score = len(wanted & set(prediction.split())) / len(wanted)
    return {"score": score, "correct": score > 0.5, "confidence": None, "details": {"wanted": len(wanted)}}


@query(
    "e18_row_failures",
    """SELECT conv_id, turn, round(CASE WHEN wanted = 0 THEN 0 ELSE shared / wanted END, 6) AS score,
              coalesce(wanted > 0 AND shared / wanted > 0.5, false) AS correct,
              CASE WHEN wanted = 0 THEN 'division by zero' END AS error, CASE WHEN wanted > 0 THEN wanted::VARCHAR END AS wanted
       FROM (SELECT conv_id, turn, len(list_distinct(t)) AS wanted, len(list_intersect(list_distinct(t), p)) AS shared
             FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(prediction, '[ \\t\\n]+'), lambda x: x <> '') AS p,
                          CASE WHEN turn % 7 = 3 THEN []::VARCHAR[]
                               ELSE list_filter(regexp_split_to_array(question, '[ \\t\\n]+'), lambda x: x <> '') END AS t FROM chat_pairs))""",
)
def e18_failures(spark, d):
    """An own Python evaluator that fails on some rows: they score 0 and say why, the others are scored."""
    pairs = views.chat_pairs(spark, d)
    empty = F.when(F.col("turn") % 7 == 3, "").otherwise(F.col("question"))
    asked = pairs.select("conv_id", "turn", "prediction", empty.alias("truth"), F.lit("word_overlap").alias("evaluator"))
    scoring.register_row_evaluator("word_overlap", _word_overlap)
    try:
        out = scoring.evaluate(asked, details=True)
    finally:
        scoring.unregister_evaluator("word_overlap")
    return rounded(out.select("conv_id", "turn", "score", "correct", "error", F.col("details")["wanted"].alias("wanted")))
