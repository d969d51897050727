"""The derived fact tables in SQL, written apart from the Spark code."""

from __future__ import annotations

import re

from tallymark.operators.catalog import MODELS
from tallymark.sources.views import ERROR_TEXTS, EXCEPTION_TYPES

# Whitespace as \s and str.strip() see it.
SQL_WS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def sql_strip(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '^[{SQL_WS}]+', ''), '[{SQL_WS}]+$', '')"


def sql_words(expr: str) -> str:
    return f"regexp_extract_all({expr}, '[^{SQL_WS}]+')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def rows(values) -> str:
    return ", ".join("(" + ", ".join(values_) + ")" for values_ in values)


_K = r"regexp_extract(props, '(\d+)', 1)::INTEGER"

VIEWS = {
    "responses": f"""
        SELECT event_id AS request_id, ts, user_id, 'm' || (user_id % 8) AS model, 'd' || (user_id % 5) AS dataset,
               ts::DATE AS "day", user_id * 10 + k % 10 AS sample_id, value / 100 AS latency_s, k AS output_tokens,
               event_type = 'error' AS error, (4000 + event_id % 4000)::DOUBLE AS memory_usage_mb,
               CASE WHEN value / 100 > 0 THEN k / (value / 100) ELSE 0 END AS tokens_per_second
        FROM (SELECT *, {_K} AS k FROM events)""",
    "scored": """
        SELECT *, CASE WHEN NOT error THEN output_tokens END AS score_pct,
               CASE WHEN NOT error THEN output_tokens / 100 END AS score
        FROM responses""",
    "host_metrics": f"""
        SELECT user_id AS deployment, 'm' || (user_id % 8) AS model, event_id AS tick_id, ts,
               least(100.0::DOUBLE, value) AS cpu_percent, k::DOUBLE AS memory_percent,
               (event_id % 100)::DOUBLE AS disk_percent,
               CASE WHEN user_id % 3 = 0 THEN k / 10 ELSE 0 END AS gpu_memory_gb, value / 50 AS response_s
        FROM (SELECT *, {_K} AS k FROM events)""",
    "device_metrics": """
        SELECT user_id % 16 AS device, event_id AS tick_id, ts, 80.0::DOUBLE AS total_gb, u AS utilization,
               u * 80 AS allocated_gb, 80 - u * 80 AS free_gb
        FROM (SELECT *, least(value, 100.0::DOUBLE) / 100 AS u FROM events)""",
    "errors": f"""
        SELECT event_id AS error_id, ts, user_id AS source, ({sql_list(ERROR_TEXTS)})[k % {len(ERROR_TEXTS)} + 1] AS message,
               ({sql_list(EXCEPTION_TYPES)})[event_id % {len(EXCEPTION_TYPES)} + 1] AS exception_type,
               event_id % 4 = 0 AS resolved
        FROM (SELECT *, {_K} AS k FROM events WHERE event_type = 'error')""",
    "task_log": """
        SELECT task_id, executor_type, state, created_at, rss_mb, worker,
               CASE WHEN state NOT IN ('running', 'pending') THEN created_at + to_hours((task_id % 180)::INTEGER) END
                   AS completed_at
        FROM (SELECT o_orderkey AS task_id, o_orderdate AS created_at, o_totalprice AS rss_mb, o_custkey % 50 AS worker,
                     CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'thread'
                          WHEN o_orderpriority = '3-MEDIUM' THEN 'process' ELSE 'async' END AS executor_type,
                     CASE WHEN o_orderstatus = 'F' THEN 'completed'
                          WHEN o_orderstatus = 'P' THEN (['failed', 'timeout', 'cancelled'])[o_custkey % 3 + 1]
                          WHEN o_custkey % 2 = 0 THEN 'running' ELSE 'pending' END AS state
              FROM orders)""",
    "trials": """
        SELECT l_suppkey AS study, 'm' || (l_suppkey % 8) AS model, 'd' || (l_suppkey % 5) AS dataset,
               l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_extendedprice AS x,
               l_discount * 10 AS temperature, 0.1::DOUBLE + l_tax * 10 AS top_p,
               (l_quantity * 2)::INTEGER AS top_k, l_linenumber * 70 AS max_new_tokens,
               1.0::DOUBLE + l_tax AS repetition_penalty,
               CASE WHEN state = 'complete' THEN (l_extendedprice % 1000) / 1000 END AS score, state, l_shipdate AS ts
        FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'failed'
                             WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'pruned' ELSE 'complete' END AS state
              FROM lineitem)""",
    "samples": """
        SELECT doc_id AS sample_id, text AS question, text AS answer, lang AS language,
               source AS category,
               CASE WHEN n_chars < 500 THEN 'easy' WHEN n_chars < 2000 THEN 'medium' ELSE 'hard' END AS difficulty
        FROM documents""",
    "models": "SELECT * FROM (VALUES "
    + rows([(quoted(m.name), quoted(m.path), str(m.load_in_4bit), str(m.load_in_8bit)) for m in MODELS])
    + ") AS t(model, model_path, load_in_4bit, load_in_8bit)",
    "chat_pairs": """
        SELECT conv_id, turn, question, prediction
        FROM (SELECT conv_id, turn, role, text AS prediction, lag(role) OVER w AS asked_by, lag(text) OVER w AS question
              FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        WHERE role = 'assistant' AND asked_by = 'user'""",
    "partners": f"""
        SELECT d.doc_id, d.ref_id, a.lang, a.text AS prediction, b.text AS truth
        FROM (SELECT DISTINCT doc_id, ref_id
              FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, line) AS ref_id
                    FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line FROM documents)
                    WHERE {sql_strip("line")} <> ''
                    UNION ALL
                    SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, lower({sql_strip("text")})) FROM documents
                    WHERE {sql_strip("text")} <> '')
              WHERE doc_id > ref_id) d
        JOIN documents a ON a.doc_id = d.doc_id JOIN documents b ON b.doc_id = d.ref_id""",
    "vector_pairs": """
        SELECT vec_id, label, embedding, first_value(vec_id) OVER w AS ref_id, first_value(embedding) OVER w AS ref
        FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)""",
    "math_answers": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag,
               CASE l_linenumber
                    WHEN 1 THEN '답은 ' || q || ' 입니다'
                    WHEN 2 THEN '정답: ' || q
                    WHEN 3 THEN '첫째, 값을 추정' || chr(10) || '결과는 ' || q || ',5'
                    WHEN 4 THEN '먼저 ' || a || ' + 1 = ' || (a + 1) || chr(10) || '그 때문에 따라서 ' || q
                    WHEN 5 THEN '  다음: x = y' || chr(10) || '그러므로 ' || q || chr(10) || '분명 반드시'
                    WHEN 6 THEN (q + a) || ' - ' || a || ' = ' || q || chr(10) || '마지막으로 확실히 ' || q || '개입니다'
                    ELSE '아마 생각에는 ' || q || ' km' END AS prediction,
               CASE l_returnflag WHEN 'A' THEN q::VARCHAR WHEN 'N' THEN '합계 ' || q || ',5개'
                    ELSE '정답은 ' || (l_linenumber * 5) || '원입니다' END AS truth
        FROM (SELECT *, l_quantity::INTEGER AS q, (l_partkey % 50)::INTEGER AS a FROM lineitem)""",
    "qa_answers": """
        SELECT o_orderkey AS request_id,
               CASE o_custkey % 6
                    WHEN 0 THEN '주문은 ' || said || ' 상태입니다.'
                    WHEN 1 THEN ' 주문은   ' || said || chr(9) || '상태입니다!! '
                    WHEN 2 THEN '확실히 주문은 ' || said || ' 상태입니다 그리고 번호는 ' || o_orderkey
                    WHEN 3 THEN '아마도 주문은ABC ' || said || ' 상태일 가능성이 높아요 하지만 주문은a상태'
                    WHEN 4 THEN '   '
                    ELSE said || ' ' || said || ' ' || said || ' ㅋㅋㅋㅋㅋ' END AS prediction,
               '주문은 ' || (['완료된', '진행중인', '보류된'])[o_orderkey % 3 + 1] || ' 상태입니다.' AS truth
        FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN '완료된' WHEN 'O' THEN '진행중인' ELSE '보류된' END AS said
              FROM orders)""",
    "step_reports": """
        SELECT l_suppkey AS study, l_orderkey AS trial, l_linenumber - 1 AS step,
               max((l_extendedprice % 1000) / 1000) AS value, l_orderkey % 5 <> 0 AS complete
        FROM lineitem GROUP BY ALL""",
    "host_by_run": """
        SELECT model, dataset, "day", avg(least(100.0::DOUBLE, latency_s * 100)) AS cpu_avg FROM responses GROUP BY ALL""",
    "run_perf": """
        SELECT model, dataset, "day", avg(tokens_per_second) AS tokens_per_second,
               coalesce(avg(latency_s) FILTER (latency_s > 0), 0) AS latency_avg, max(memory_usage_mb) AS memory_usage_mb,
               coalesce(count(*) / nullif(sum(latency_s) FILTER (latency_s > 0), 0), 0) AS throughput,
               count(*) FILTER (score > 0.8) / count(*) AS accuracy, max(ts) AS ts,
               (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 / 3600 AS duration_h,
               quantile_cont(latency_s, 0.5) FILTER (latency_s > 0) AS latency_p50,
               quantile_cont(latency_s, 0.95) FILTER (latency_s > 0) AS latency_p95,
               quantile_cont(latency_s, 0.99) FILTER (latency_s > 0) AS latency_p99
        FROM scored GROUP BY model, dataset, "day" """,
    "bench_runs": """
        SELECT *, CASE WHEN tokens > 0 THEN cost_per_hour_usd * duration_h / tokens ELSE 0 END AS cost_per_token_usd,
               CASE WHEN tokens > 0 THEN cost_per_hour_usd * duration_h / tokens ELSE 0 END * 1000 AS cost_per_1k_tokens_usd,
               cost_per_hour_usd * 24 * 30 AS estimated_monthly_cost_usd
        FROM (SELECT p.*, h.cpu_avg,
                     CASE WHEN memory_usage_mb > 0 THEN tokens_per_second / memory_usage_mb ELSE 0 END AS tokens_per_mb,
                     CASE WHEN memory_usage_mb > 0 THEN tokens_per_second / (memory_usage_mb / 1024) ELSE 0 END
                         AS memory_efficiency,
                     tokens_per_second / greatest(cpu_avg, 1) AS cpu_efficiency,
                     tokens_per_second / greatest(memory_usage_mb * cpu_avg / 1000, 1) AS overall_efficiency,
                     0.5 + memory_usage_mb / 1024 * 0.01 AS cost_per_hour_usd,
                     tokens_per_second * duration_h * 3600 AS tokens
              FROM run_perf p JOIN host_by_run h USING (model, dataset, "day"))""",
    "opt_runs": """
        SELECT 'opt_' || study AS run_id, model, dataset, study,
               coalesce(b.temperature, 0.1) AS temperature, coalesce(b.top_p, 0.9) AS top_p,
               coalesce(b.top_k, 50) AS top_k, coalesce(b.max_new_tokens, 512) AS max_new_tokens,
               coalesce(b.repetition_penalty, 1.0) AS repetition_penalty,
               coalesce(b.score, 0) AS best_score, n AS trials, first_ts, last_ts
        FROM (SELECT study, model, dataset, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts
              FROM trials GROUP BY ALL) g
        LEFT JOIN (SELECT * FROM trials WHERE score > 0 AND state = 'complete'
                   QUALIFY row_number() OVER (PARTITION BY study ORDER BY score DESC, o, l, p, x) = 1) b
        USING (study, model, dataset)""",
}


def with_views(sql: str) -> str:
    """Prefix the SQL with the views it names, in order of definition."""
    wanted: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in wanted and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                wanted.add(name)
                visit(VIEWS[name])

    visit(sql)
    ctes = [f"{name} AS ({body})" for name, body in VIEWS.items() if name in wanted]
    if not ctes:
        return sql
    if re.match(r"\s*WITH\s+RECURSIVE\b", sql):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + re.sub(r"^\s*WITH\s+RECURSIVE\b", "", sql)
    if re.match(r"\s*WITH\b", sql):
        return "WITH " + ", ".join(ctes) + ", " + re.sub(r"^\s*WITH\b", "", sql)
    return "WITH " + ", ".join(ctes) + " " + sql
