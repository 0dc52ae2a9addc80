"""The relational, window and scalar operators as SQL; a pair is Spark's and DuckDB's text where functions differ.

Stand-ins: orders for documents, lineitem for detected entities (quantity / 50 as score), supplier for detection methods,
customer for users, events for log entries and requests.
"""

from __future__ import annotations

_WORDS = ("SELECT doc_id, pos AS idx, w FROM {documents} LATERAL VIEW posexplode(regexp_extract_all(text, '([^ \\t\\n\\r]+)', 1)) AS pos, w", "SELECT doc_id, unnest(range(len(m))) AS idx, unnest(m) AS w FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\r]+') AS m FROM documents)")


def _words(text: str) -> tuple[str, str]:
    """Both texts of a query over the words of the documents."""
    return tuple(f"WITH words AS ({w}) {text}" for w in (_WORDS[0].replace("\\", "\\\\"), _WORDS[1]))


STATEMENTS: dict[str, str | tuple[str, str]] = {
    # joins
    "entity_method_join": "SELECT l_orderkey, l_linenumber, s_name FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey WHERE l_quantity / 50 >= 0.85",
    "document_summary": "SELECT o_orderkey, count(l_orderkey) AS n_entities FROM {orders} LEFT JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderkey",
    "ban_semi_join": "SELECT event_id, user_id FROM {events} WHERE EXISTS (SELECT 1 FROM {customer} WHERE c_custkey = user_id AND c_acctbal < 0)",
    "not_yet_processed": "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "common_files": "SELECT c_custkey AS id FROM {customer} INTERSECT SELECT o_custkey AS id FROM {orders}",
    "all_parties": "SELECT c_name AS name, c_nationkey AS nation FROM {customer} UNION SELECT s_name, s_nationkey FROM {supplier}",
    "rows_left": "SELECT c_custkey AS id FROM {customer} EXCEPT SELECT o_custkey AS id FROM {orders} WHERE o_orderstatus = 'P'",
    "type_count_comparison": "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, coalesce(a.n, 0) - coalesce(b.n, 0) AS difference FROM (SELECT l_returnflag AS k, count(*) AS n FROM {lineitem} GROUP BY 1) a FULL OUTER JOIN (SELECT o_orderstatus AS k, count(*) AS n FROM {orders} GROUP BY 1) b ON a.k = b.k",
    # filters
    "score_threshold": "SELECT l_orderkey, l_linenumber, l_quantity / 50 AS score FROM {lineitem} WHERE coalesce(l_quantity / 50, 0) >= 0.85",
    "equality_conjunction": "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
    "case_insensitive_lookup": "SELECT c_custkey, c_name FROM {customer} WHERE lower(c_mktsegment) = lower('Building')",
    "active_at": "SELECT event_id FROM {events} WHERE ts IS NULL OR ts > TIMESTAMP '2024-01-15 00:00:00'",
    # aggregations
    "count_by_type": "SELECT coalesce(l_returnflag, 'UNKNOWN') AS entity_type, count(*) AS n FROM {lineitem} GROUP BY 1",
    "count_per_page": "SELECT p.l_linenumber AS page, count(e.l_orderkey) AS n FROM (SELECT DISTINCT l_linenumber FROM {lineitem}) p LEFT JOIN (SELECT * FROM {lineitem} WHERE l_quantity > 49 AND l_linenumber < 4) e ON p.l_linenumber = e.l_linenumber GROUP BY 1",
    "batch_summary": "SELECT count(*) AS total, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS successful, count(CASE WHEN o_orderstatus <> 'F' THEN 1 END) AS failed FROM {orders}",
    "engine_label_stats": "SELECT l_returnflag AS entity, count(*) AS total, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS positive, CAST(round(100.0 * count(CASE WHEN l_linestatus = 'F' THEN 1 END) / count(*), 4) AS DOUBLE) AS rate FROM {lineitem} GROUP BY 1",
    "confidence_summary": "SELECT l_returnflag AS entity, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS least, max(l_quantity) AS most, round(stddev_pop(l_quantity), 6) AS deviation, count(*) AS n FROM {lineitem} GROUP BY 1",
    "records_by_day": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, max(event_id) AS last_id FROM {events} GROUP BY 1, 2",
    "class_dictionary": "SELECT p_type AS entity_type, row_number() OVER (ORDER BY p_type) - 1 AS id FROM (SELECT DISTINCT p_type FROM {part}) t",
    # windows
    "arg_max_dedup": "SELECT l_orderkey, l_suppkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_quantity DESC, l_linenumber) AS rn FROM {lineitem}) t WHERE rn = 1",
    "consecutive_groups": "SELECT l_orderkey, l_linenumber, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS island FROM {lineitem} WHERE l_quantity > 20",
    "merge_overlapping": "SELECT user_id, grp, min(s) AS span_start, max(e) AS span_end, max(value) AS score FROM (SELECT *, sum(CASE WHEN s <= before THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT user_id, event_id, value, s, s + 40 AS e, max(s + 40) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT user_id, event_id, value, event_id % 1000 AS s FROM {events}) a) b) c GROUP BY user_id, grp",
    "top_rates": "SELECT p_type, rate, rnk FROM (SELECT p_type, rate, rank() OVER (ORDER BY rate DESC) AS rnk FROM (SELECT p_type, round(avg(p_retailprice), 4) AS rate FROM {part} GROUP BY 1) a) b WHERE rnk <= 5",
    "rate_limiter": (
        "SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) > 1 AS limited FROM {events}",
        "SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) > 1 AS limited FROM events",
    ),
    "daily_quota": "SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) <= 20 AS admitted FROM {events}",
    "retention": "SELECT event_id, event_type FROM {events} WHERE ts < TIMESTAMP '2024-01-30 00:00:00' - CASE event_type WHEN 'error' THEN INTERVAL '15' DAY WHEN 'purchase' THEN INTERVAL '20' DAY ELSE INTERVAL '25' DAY END",
    "paged_list": "SELECT o_orderkey, o_orderdate FROM {orders} ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40",
    # words and offsets
    "running_offset": _words("SELECT doc_id, idx, w, sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) - (length(w) + 1) AS w_start FROM words"),
    "keyword_search": _words("SELECT doc_id, idx, w FROM words WHERE lower(trim(BOTH '.,!' FROM w)) IN ('license', 'mit', 'apache')"),
    "document_density": _words("SELECT doc_id, count(*) AS n_words, CAST(round(1000.0 * sum(CASE WHEN w LIKE '%@%' THEN 1 ELSE 0 END) / count(*), 6) AS DOUBLE) AS density FROM words GROUP BY doc_id"),
    # scalars
    "operation_id": ("SELECT doc_id, substring(sha2(text, 256), 1, 16) AS operation_id FROM {documents}", "SELECT doc_id, substring(sha256(text), 1, 16) AS operation_id FROM documents"),
    "cache_key": ("SELECT doc_id, md5(concat_ws('|', text, lang)) AS k FROM {documents}", "SELECT doc_id, md5(concat_ws('|', text, lang)) AS k FROM documents"),
    "slash_scrub": ("SELECT doc_id, length(text) - length(replace(text, '*', '')) AS n_stars, replace(replace(text, '*', ''), '/', '') AS t FROM {documents}", "SELECT doc_id, length(text) - length(replace(text, '*', '')) AS n_stars, replace(replace(text, '*', ''), '/', '') AS t FROM documents"),
    "log_category": "SELECT event_id, CASE WHEN event_type = 'error' THEN 'sensitive' WHEN event_type IN ('signup', 'purchase') THEN 'personal' ELSE 'standard' END AS category FROM {events}",
    "mask_name": ("SELECT c_custkey, concat(substring(c_name, 1, 1), repeat('*', length(c_name) - 2), substring(c_name, -1)) AS masked FROM {customer} WHERE length(c_name) > 2", "SELECT c_custkey, concat(substring(c_name, 1, 1), repeat('*', length(c_name) - 2), substring(c_name, -1, 1)) AS masked FROM customer WHERE length(c_name) > 2"),
    "subject_access": "SELECT event_id, ts, event_type, props FROM {events} WHERE user_id = 7 AND ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-28 00:00:00'",
}
