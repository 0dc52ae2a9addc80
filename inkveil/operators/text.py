"""Text, masking and validation operators as SQL; the pairs are Spark's and DuckDB's texts of the same query.

Spark's texts are raw: string literals keep one level of escapes, so a backslash of an expression is written twice.
"""

from __future__ import annotations

_LUHN = "CAST(substring(m, i, 1) AS INT)"

STATEMENTS: dict[str, str | tuple[str, str]] = {
    # places of a word, overlapping ones too: the pieces between zero-width matches give them in one pass
    "occurrences": (
        "SELECT doc_id, CAST(at AS INT) AS at FROM (SELECT doc_id, aggregate(p, struct(0 AS at, CAST(array() AS ARRAY<INT>) AS out), (a, x) -> struct(a.at + length(x) AS at, concat(a.out, IF(a.at > 0 OR startswith(text, 'ana'), array(a.at), CAST(array() AS ARRAY<INT>))) AS out)).out AS found FROM (SELECT doc_id, text, split(text, '(?=ana)') AS p FROM {documents} WHERE contains(text, 'ana')) s) t LATERAL VIEW explode(found) AS at",
        "SELECT doc_id, unnest(list_filter(range(0, length(text)), lambda i: substring(text, i + 1, 3) = 'ana'))::INT AS at FROM documents WHERE contains(text, 'ana')",
    ),
    "fixed_chunks": (
        "SELECT doc_id, i AS chunk, substring(text, i * 1000 + 1, 1000) AS t FROM {documents} LATERAL VIEW explode(sequence(0, greatest(0, CAST(floor((length(text) - 1) / 1000) AS INT)))) AS i WHERE text IS NOT NULL",
        "SELECT doc_id, unnest(range(0, greatest(0, floor((length(text) - 1) / 1000)::INT) + 1))::INT AS chunk, substring(text, chunk * 1000 + 1, 1000) AS t FROM documents WHERE text IS NOT NULL",
    ),
    "token_windows": (
        r"SELECT doc_id, k * 334 AS first, least(n, k * 334 + 384) AS last FROM (SELECT doc_id, size(regexp_extract_all(text, '[^ \\t\\n\\r]+', 0)) AS n FROM {documents} WHERE text IS NOT NULL) t LATERAL VIEW explode(sequence(0, greatest(0, CAST(ceil((n - 384) / 334) AS INT)))) AS k",
        r"SELECT doc_id, k * 334 AS first, least(n, k * 334 + 384) AS last FROM (SELECT doc_id, n, unnest(range(0, greatest(0, ceil((n - 384) / 334)::INT) + 1))::INT AS k FROM (SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\r]+'))::INT AS n FROM documents WHERE text IS NOT NULL))",
    ),
    # checks and masks
    "luhn": (
        r"SELECT doc_id, m, luhn_check(m) AS valid FROM {documents} LATERAL VIEW explode(regexp_extract_all(text, '\\b[0-9]{16}\\b', 0)) AS m",
        rf"SELECT doc_id, m, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN 2 * {_LUHN} - CASE WHEN {_LUHN} > 4 THEN 9 ELSE 0 END ELSE {_LUHN} END)) % 10 = 0 AS valid FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b[0-9]{{16}}\b')) AS m FROM documents)",
    ),
    "erase_subject": (
        "SELECT event_id, regexp_replace(props, ': *[0-9]+', ': \"[REDACTED-GDPR]\"') AS props FROM {events} WHERE user_id = 7",
        "SELECT event_id, regexp_replace(props, ': *[0-9]+', ': \"[REDACTED-GDPR]\"', 'g') AS props FROM events WHERE user_id = 7",
    ),
    "truncate_string": "SELECT doc_id, CASE WHEN length(text) > 100 THEN concat(substring(text, 1, 100), '...') ELSE text END AS t FROM {documents}",
    "username_rules": ("SELECT c_custkey, regexp_like(c_name, '^[A-Za-z0-9_#]{{3,32}}$') AS valid FROM {customer}".replace("{{", "{").replace("}}", "}"), "SELECT c_custkey, regexp_full_match(c_name, '[A-Za-z0-9_#]{3,32}') AS valid FROM customer"),
    "train_split": (
        "SELECT doc_id, substring(md5(CAST(doc_id AS STRING)), 1, 2) < '1a' AS validation FROM {documents}",
        "SELECT doc_id, substring(md5(CAST(doc_id AS VARCHAR)), 1, 2) < '1a' AS validation FROM documents",
    ),
    # measures of engines against labels: lines 1 to 4 are the labels, quantities over 15 the engine's finds
    "precision_recall": "SELECT kind, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 0.0 ELSE round(CAST(tp AS DOUBLE) / (tp + fp), 6) END AS prec, CASE WHEN tp + fn = 0 THEN 0.0 ELSE round(CAST(tp AS DOUBLE) / (tp + fn), 6) END AS rec, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE round(2.0 * CAST(tp AS DOUBLE) / (2 * tp + fp + fn), 6) END AS f1 FROM (SELECT coalesce(a.l_returnflag, b.l_returnflag) AS kind, count(CASE WHEN a.l_orderkey IS NOT NULL AND b.l_orderkey IS NOT NULL THEN 1 END) AS tp, count(CASE WHEN a.l_orderkey IS NULL THEN 1 END) AS fp, count(CASE WHEN b.l_orderkey IS NULL THEN 1 END) AS fn FROM (SELECT * FROM {lineitem} WHERE l_linenumber <= 4) a FULL OUTER JOIN (SELECT * FROM {lineitem} WHERE l_quantity > 15) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY 1) t",
    "file_overlap": "SELECT count(CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 1 END) AS overlap, count(CASE WHEN b.k IS NULL THEN 1 END) AS only_a, count(CASE WHEN a.k IS NULL THEN 1 END) AS only_b, CAST(round(100.0 * count(CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 1 END) / count(*), 4) AS DOUBLE) AS pct FROM (SELECT DISTINCT o_custkey AS k FROM {orders}) a FULL OUTER JOIN (SELECT DISTINCT c_custkey AS k FROM {customer} WHERE c_acctbal > 0) b ON a.k = b.k",
    "confidence_median": "SELECT l_returnflag AS entity, median(l_quantity) AS middle FROM {lineitem} GROUP BY 1",
    "usage_metrics": "SELECT event_type, count(*) AS calls, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, max(ts) AS last_used FROM {events} GROUP BY 1",
    "user_statistics": "SELECT c_custkey, count(event_id) AS n_events, count(DISTINCT event_type) AS n_types, max(ts) AS last_seen FROM {customer} LEFT JOIN {events} ON c_custkey = user_id GROUP BY 1",
}
