"""Queries of masks, log files, tables and labels over the business tables, with DuckDB's SQL.

Stand-ins: orders give log fields (a name and a value), events log lines and requests, customer users and their settings."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions import masking
from inkveil.operators import labels, models, tables
from inkveil.sources import logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_FIELD = """SELECT o_orderkey AS id, CASE o_orderkey % 11 WHEN 0 THEN 'user_id' WHEN 1 THEN 'Email' WHEN 2 THEN 'note' WHEN 3 THEN 'sessionToken' WHEN 4 THEN 'status' WHEN 5 THEN 'card' WHEN 6 THEN 'full name' WHEN 7 THEN 'City' WHEN 8 THEN 'pwd' WHEN 9 THEN 'text' ELSE 'zip' END AS name,
 CASE o_orderkey % 13 WHEN 0 THEN concat('user', o_custkey, '@example.com') WHEN 1 THEN '4111 1111 1111 1111' WHEN 2 THEN '4111-1111-1111-1112' WHEN 3 THEN 'about health insurance' WHEN 4 THEN '' WHEN 5 THEN 'ab' WHEN 6 THEN 'date of birth' WHEN 7 THEN concat('plain ', o_orderstatus) WHEN 8 THEN 'x@y' WHEN 9 THEN 'the user id' WHEN 10 THEN 'a bearer here' WHEN 11 THEN 'tax-id 12' ELSE concat('a@b', o_custkey, '.org') END AS value FROM {orders}"""
_MESSAGE = """SELECT o_orderkey AS id, CASE o_orderkey % 12 WHEN 0 THEN concat('failed at /var/data/run ', o_custkey, '/file.txt') WHEN 1 THEN concat('got {"a": 1, "b": {"c": ', o_custkey, '}} back') WHEN 2 THEN 'see https://host.example/x?y=1 now' WHEN 3 THEN concat('mail me at a', o_custkey, '@b.org')
 WHEN 4 THEN 'number 010190 12345 found' WHEN 5 THEN 'paid 4111 1111 1111 1111' WHEN 6 THEN concat('id: ', 10000 + o_custkey) WHEN 7 THEN 'ref 123456789012' WHEN 8 THEN 'from 10.0.0.7 to s3://b/c' WHEN 9 THEN 'wrong Password given' WHEN 10 THEN '' ELSE 'SELECT a, b FROM t' END AS m FROM {orders}"""
_NAME = """SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN concat('report_', o_custkey, '.pdf') WHEN 1 THEN 'a very long file name of a document.txt' WHEN 2 THEN 'my secret plan.doc' WHEN 3 THEN 'x.y.tar.gz' WHEN 4 THEN '.bashrc' WHEN 5 THEN '010190 12345.pdf' WHEN 6 THEN '' ELSE 'a/b:c*d?.txt' END AS n FROM {orders}"""
_URL = """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN concat('https://user:pw@host.example:8080/p/a?q=', o_custkey, '&api_key=abc&q=2#top') WHEN 1 THEN 'http://host.example/plain' WHEN 2 THEN 'HTTP://host.example/?Session=1&empty=&b=x' WHEN 3 THEN '' WHEN 4 THEN '/relative?code=7&n=1' ELSE 'https://host.example/?n=1' END AS u FROM {orders}"""
_LUHN = "(CASE WHEN regexp_full_match({0}, '[0-9]+') THEN list_sum(list_transform(range(1, length({0}) + 1), lambda i: CASE WHEN (length({0}) - i) % 2 = 1 THEN (2 * substr({0}, i, 1)::INT) // 10 + (2 * substr({0}, i, 1)::INT) % 10 ELSE substr({0}, i, 1)::INT END)) % 10 = 0 ELSE false END)"


def _duck(rx: str) -> str:
    return "'" + rx.replace("'", "''") + "'"


_PLAIN = "translate(value, ' -', '')"
_IS_CARD = f"(regexp_matches(value, {_duck(masking.CARD)}) AND strlen({_PLAIN}) BETWEEN 13 AND 19 AND {_LUHN.format(_PLAIN)})"
_IS_SENSITIVE = f"(regexp_matches(lower(name), '{'|'.join(masking.SENSITIVE_NAMES)}') OR regexp_matches(name, {_duck(masking.SECRET)}) OR strlen(value) >= 3 AND ({_IS_CARD} OR regexp_matches(value, {_duck(masking.SENSITIVE)})))"
_IS_EMAIL = f"(contains(lower(name), 'email') OR regexp_matches(value, {_duck(masking.EMAIL)}))"
_IS_PERSONAL = f"(regexp_matches(lower(name), '{'|'.join(masking.PERSONAL_NAMES)}') OR regexp_matches(name, {_duck(masking.PERSONAL)}) OR regexp_matches(value, {_duck(masking.EMAIL)}))"
_MASKED = "CASE WHEN len(string_split({0}, '@')) <> 2 THEN '***@***' WHEN length(split_part({0}, '@', 1)) <= 4 THEN substr({0}, 1, least(1, length(split_part({0}, '@', 1)))) || '***@' || split_part({0}, '@', 2) ELSE substr({0}, 1, 2) || repeat('*', length(split_part({0}, '@', 1)) - 4) || right(split_part({0}, '@', 1), 2) || '@' || split_part({0}, '@', 2) END"


def _from(text: str) -> str:
    return text.replace("{orders}", "orders")


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _of(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text.replace("{orders}", f"parquet.`{sf_dir}/orders.parquet`"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(f"SELECT id, name, value, coalesce({_IS_SENSITIVE}, false) AS sensitive, {_IS_PERSONAL} AS personal, {_IS_EMAIL} AS email, CASE WHEN {_IS_SENSITIVE} THEN 'sensitive' WHEN {_IS_PERSONAL} THEN 'personal' ELSE 'standard' END AS category FROM ({_from(_FIELD)}) f")
def field_kinds(spark, sf_dir):
    f = _of(spark, sf_dir, _FIELD)
    return f.select("id", "name", "value", masking.sensitive_field("name", "value").alias("sensitive"), masking.personal_field("name", "value").alias("personal"), masking.email_field("name", "value").alias("email"), masking.log_category(F.create_map("name", "value")).alias("category"))


@query(f"SELECT id, strlen(value) >= 5 AND (regexp_matches(value, {_duck(masking.EMAIL)}) OR regexp_matches(value, {_duck(masking.PERSONAL)})) AS personal, strlen(value) >= 5 AND (regexp_matches(value, {_duck(masking.SECRET)}) OR {_IS_CARD} OR regexp_matches(value, {_duck(masking.SENSITIVE)})) AS sensitive, {_IS_CARD} AS card FROM ({_from(_FIELD)}) f")
def text_kinds(spark, sf_dir):
    return _of(spark, sf_dir, _FIELD).select("id", masking.personal_text("value").alias("personal"), masking.sensitive_text("value").alias("sensitive"), masking.card_number("value").alias("card"))


def _level(level: str, masked: str) -> str:
    return f"SELECT id, CASE WHEN {_IS_PERSONAL} THEN {masked} ELSE value END AS value FROM (SELECT id, name, CASE WHEN {_IS_SENSITIVE} THEN '[REDACTED]' ELSE value END AS value FROM ({_from(_FIELD)}) f) g"


_LOW = f"CASE WHEN {_IS_EMAIL} THEN {_MASKED.format('value')} ELSE value END"
_MEDIUM = f"CASE WHEN lower(name) = 'user_id' THEN '***' WHEN {_IS_EMAIL} THEN {_MASKED.format('value')} WHEN length(value) > 2 THEN substr(value, 1, 1) || repeat('*', length(value) - 2) || right(value, 1) ELSE '**' END"


def _sanitised(level: str) -> Callable:
    def f(spark, sf_dir):
        fields = _of(spark, sf_dir, _FIELD).withColumn("m", F.create_map("name", "value"))
        return fields.select("id", F.map_values(masking.sanitise_fields("m", level))[0].alias("value"))

    f.__name__ = f"sanitise_{level}"
    return f


for _name, _sql in (("low", _level("low", _LOW)), ("medium", _level("medium", _MEDIUM)), ("high", _level("high", "'[PERSONAL_DATA]'")), ("none", f"SELECT id, value FROM ({_from(_FIELD)}) f")):
    query(_sql)(_sanitised(_name))


@query(f"SELECT id, {_MASKED.format('value')} AS masked, CASE WHEN len(string_split(value, '@')) = 2 AND length(split_part(value, '@', 1)) > 2 THEN substr(value, 1, 1) || repeat('*', length(split_part(value, '@', 1)) - 2) || right(split_part(value, '@', 1), 1) || '@' || split_part(value, '@', 2) ELSE value END AS ends FROM ({_from(_FIELD)}) f")
def mask_email(spark, sf_dir):
    return _of(spark, sf_dir, _FIELD).select("id", masking.mask_email("value").alias("masked"), masking.mask_email_ends("value").alias("ends"))


@query("SELECT '***' AS c_custkey, substr(c_name, 1, 1) || repeat('*', length(c_name) - 2) || right(c_name, 1) AS c_name, CASE WHEN c_nationkey > 0 THEN '~1' || repeat('0', length(c_nationkey::VARCHAR) - 1) ELSE '0' END AS c_nationkey, printf('~%.1f', round(c_acctbal::DECIMAL(18, 2), 1)::DOUBLE) AS c_acctbal FROM (SELECT *, c_custkey AS user_id FROM customer)")
def mask_by_type(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", "c_nationkey", "c_acctbal")
    return masking.mask_columns(c, ["user_id", "c_name", "c_nationkey", "c_acctbal"]).withColumnRenamed("user_id", "c_custkey")


@query("""SELECT o_orderkey AS id, '{"id":' || o_orderkey || ',"password":"[REDACTED]","in":{"SSN":"[REDACTED]","ok":"' || o_orderstatus || '"},"l":[{"token":"[REDACTED]"},{"k":1}]}' AS j FROM orders""")
def redact_keys(spark, sf_dir):
    j = F.concat(F.lit('{"id":'), "o_orderkey", F.lit(',"password":"x","in":{"SSN":{"a":1},"ok":"'), "o_orderstatus", F.lit('"},"l":[{"token":[1,2]},{"k":1}]}'))
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), masking.redact_keys(j).alias("j"))


def _scrubbed(m: str) -> str:
    m = f"regexp_replace({m}, '(?:/[\\w\\-. ]+)+/([\\w\\-. ]+)', '[PATH]/\\1', 'g')"
    found = f"regexp_extract({m}, '(?s)\\{{.*\\}}')"
    m = f"CASE WHEN {found} = '' THEN {m} ELSE replace({m}, {found}, '[JSON_CONTENT:' || (length({found}) - length(replace({found}, ':', ''))) || '_fields]') END"
    for u in masking.URLS.split("|"):
        m = f"regexp_replace({m}, {_duck(u)}, '[URL_REDACTED]', 'g')"
    for rx, to in masking.REWRITES:
        m = f"regexp_replace({m}, {_duck(rx)}, {_duck(to.replace('$1', chr(92) + '1'))}, 'g')"
    return m


_WITHHELD = " OR ".join(f"contains(lower(m), '{w}')" for w in masking.MESSAGE_WORDS)


@query(f"SELECT id, CASE WHEN m = '' THEN 'Error details not available' WHEN {_WITHHELD} THEN 'Error details redacted for security' ELSE {_scrubbed('m')} END AS m, {_WITHHELD} OR regexp_matches(m, {_duck('(?i)' + '|'.join([masking.MESSAGE_EMAIL, *masking.SENSITIVE_ERRORS]))}) AS sensitive FROM ({_from(_MESSAGE)}) f")
def scrub_messages(spark, sf_dir):
    return _of(spark, sf_dir, _MESSAGE).select("id", masking.scrub_message("m").alias("m"), masking.sensitive_error("m").alias("sensitive"))


@query(f"SELECT id, CASE WHEN n = '' THEN 'unnamed_file' WHEN regexp_matches(b, {_duck('(?i)' + '|'.join(masking.FILE_NAMES))}) THEN 'redacted_' || substr(md5(b), 1, 8) || e WHEN length(b) > 20 THEN substr(b, 1, 6) || '...' || right(b, 6) || e ELSE n END AS scrubbed, CASE WHEN n = '' THEN 'unnamed_file' ELSE regexp_replace(n, '[/\\\\:*?]', '', 'g') END AS safe FROM (SELECT id, n, regexp_extract(n, '[^./][^/]*(\\.[^./]*)$', 1) AS e, substr(n, 1, length(n) - length(regexp_extract(n, '[^./][^/]*(\\.[^./]*)$', 1))) AS b FROM ({_from(_NAME)}) f) g")
def scrub_filenames(spark, sf_dir):
    return _of(spark, sf_dir, _NAME).select("id", masking.scrub_filename("n").alias("scrubbed"), tables.safe_filename("n").alias("safe"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'https://host.example:8080/p/a?q=' || o_custkey || '&q=2&api_key=%5BREDACTED%5D#top' WHEN 1 THEN 'http://host.example/plain' WHEN 2 THEN 'http://host.example/?Session=%5BREDACTED%5D&b=x' WHEN 3 THEN 'unknown_url' WHEN 4 THEN '/relative?code=%5BREDACTED%5D&n=1' ELSE 'https://host.example/?n=1' END AS u FROM orders")
def mask_url(spark, sf_dir):
    return _of(spark, sf_dir, _URL).select("id", masking.scrub_url("u").alias("u"))


# tables


@query("SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_suppkey), s_name, s_acctbal FROM supplier")
def insert_rows(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return tables.insert(c, _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal")), "c_custkey", "s_suppkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS c_name, c_acctbal FROM customer")
def update_rows(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return tables.update(c, c.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("c_name"), F.lit(None).cast("double").alias("c_acctbal")), ["c_custkey"])


@query("SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey % 5 > 0")
def delete_with_children(spark, sf_dir):
    o, li = _table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k"), _table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k")
    parent, child = tables.delete_with(o, li, o.filter("o_custkey % 5 = 0"), ["k"])
    return parent.join(child, "k", "left").select(F.col("k").alias("o_orderkey"), "l_linenumber")


@query("SELECT k, v FROM (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name FROM supplier) t")
def upsert_rows(spark, sf_dir):
    c, s = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "supplier")
    return tables.upsert(c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), ["k"])


@query("SELECT nation, word FROM (SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS word FROM customer WHERE c_custkey % 2 = 0 UNION SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 1) t")
def add_ban_words(spark, sf_dir):
    w = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("word"), "c_custkey")
    return tables.add_missing(w.filter("c_custkey % 2 = 0").select("nation", "word").distinct(), w.filter("c_custkey % 2 = 1").select("nation", "word"), ["nation", "word"])


@query("SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS word FROM customer WHERE c_mktsegment <> 'BUILDING'")
def remove_ban_words(spark, sf_dir):
    w = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("word")).distinct()
    return tables.delete(w, w.filter("word = 'BUILDING'"), ["word"])


@query("SELECT c_custkey AS k, EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey) AS found FROM customer")
def key_exists(spark, sf_dir):
    c, s = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "supplier")
    return tables.exists(c.select(F.col("c_custkey").alias("k")), s.select(F.col("s_suppkey").alias("k")), ["k"])


@query("SELECT owner, v FROM (SELECT c_nationkey AS owner, c_name AS v FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT s_nationkey, s_name FROM supplier) t")
def import_settings(spark, sf_dir):
    c, s = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "supplier")
    return tables.replace_for(c.select(F.col("c_nationkey").alias("owner"), F.col("c_name").alias("v")), s.select(F.col("s_nationkey").alias("owner"), F.col("s_name").alias("v")), ["owner"])


@query("SELECT n_nationkey, coalesce(c, '') AS customers, coalesce(s, '') AS suppliers FROM nation LEFT JOIN (SELECT c_nationkey, string_agg(c_name, ',' ORDER BY c_name) AS c FROM customer GROUP BY 1) ON n_nationkey = c_nationkey LEFT JOIN (SELECT s_nationkey, string_agg(s_name, ',' ORDER BY s_name) AS s FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey")
def export_settings(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").select("n_nationkey")
    c = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_name")
    s = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_name")
    out = tables.bundle(n, {"customers": c, "suppliers": s}, "n_nationkey")
    return out.select("n_nationkey", F.array_join(F.col("customers.c_name"), ",").alias("customers"), F.array_join(F.col("suppliers.s_name"), ",").alias("suppliers"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 11 AND c_mktsegment = 'BUILDING'")
def where_all(spark, sf_dir):
    return tables.where(_table(spark, sf_dir, "customer"), c_nationkey=11, c_mktsegment="BUILDING").select("c_custkey", "c_name")


@query("SELECT n_nationkey AS nation_id, n_name FROM nation WHERE n_nationkey = 4")
def row_by_id(spark, sf_dir):
    return tables.by_id(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation_id"), "n_name"), "nations", 4)


@query("SELECT 1 AS position, 'n_nationkey' AS name, 'int' AS type UNION ALL SELECT 2, 'n_name', 'string' UNION ALL SELECT 3, 'n_regionkey', 'int'")
def table_columns(spark, sf_dir):
    return tables.columns_of(_table(spark, sf_dir, "nation")).drop("nullable")


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'")
def expired_rows(spark, sf_dir):
    return tables.expired(_table(spark, sf_dir, "events"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), "ts").select("event_id")


@query("SELECT count(*) AS n FROM customer WHERE c_nationkey = 3")
def table_count(spark, sf_dir):
    return tables.where(_table(spark, sf_dir, "customer"), c_nationkey=3).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber - 2 BETWEEN 1 AND 4")
def page_range(spark, sf_dir):
    return tables.page_range(_table(spark, sf_dir, "lineitem").withColumn("page", F.col("l_linenumber") - 2), 4).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/png' WHEN 3 THEN NULL WHEN 4 THEN 'text/plain' ELSE 'image/jpeg' END AS kind, CASE o_orderkey % 6 WHEN 0 THEN 'magic' WHEN 1 THEN NULL WHEN 2 THEN 'type' WHEN 3 THEN 'type' WHEN 4 THEN 'type' ELSE 'type' END AS fault FROM orders")
def uploads(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    name = F.expr("CASE o_orderkey % 6 WHEN 0 THEN 'a.PDF' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN 'd' WHEN 4 THEN 'e.txt' ELSE 'f.jpeg' END")
    content = F.expr("CASE o_orderkey % 6 WHEN 0 THEN cast('%PDF-2.0' AS binary) WHEN 1 THEN cast('%PDF-1.4 x' AS binary) WHEN 2 THEN unhex('89504E470D') ELSE cast('zz' AS binary) END")
    f = o.select(F.col("o_orderkey").alias("id"), name.alias("name"), content.alias("content")).withColumn("kind", tables.file_type("name", "content"))
    return f.select("id", "kind", tables.upload_fault("content", "kind").alias("fault"))


@query("SELECT event_id, CASE user_id % 3 WHEN 0 THEN '10.0.0.' || (user_id % 256) WHEN 1 THEN '192.168.1.9' ELSE 'unknown' END AS ip FROM events")
def client_addresses(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    header = F.expr("CASE user_id % 3 WHEN 0 THEN concat(' 10.0.0.', user_id % 256, ' , 1.2.3.4') WHEN 1 THEN '' END")
    return e.select("event_id", tables.client_ip(header, F.expr("CASE user_id % 3 WHEN 1 THEN '192.168.1.9' END")).alias("ip"))


@query("SELECT event_id, ip FROM (SELECT event_id, '10.' || (user_id % 4) || '.' || (event_id % 256) || '.7' AS ip, user_id % 4 AS b, event_id % 256 AS c FROM events) t WHERE ip = '10.3.9.7' OR b = 1 OR (b = 2 AND c BETWEEN 16 AND 31)")
def ip_ban(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", F.expr("concat('10.', user_id % 4, '.', event_id % 256, '.7')").alias("ip"))
    bans = spark.createDataFrame([("10.3.9.7",), ("10.1.0.0/16",), ("10.2.16.0/20",), ("bad/x",)], "network string")
    return tables.banned(e, bans)


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate + INTERVAL 30 DAY WHEN 1 THEN o_orderdate + INTERVAL 12 HOUR WHEN 2 THEN o_orderdate + INTERVAL 365 DAY END AS until FROM orders")
def key_expiry(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), tables.expiry(F.expr("CASE o_orderkey % 4 WHEN 0 THEN '30d' WHEN 1 THEN '12h' WHEN 2 THEN '1y' ELSE 'never' END"), F.col("o_orderdate")).alias("until"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'email' WHEN 2 THEN 'username,password' ELSE 'email,username,password' END AS faults FROM orders")
def account_rules(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    pick = lambda *v: F.expr("CASE o_orderkey % 4 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(v)) + " END")
    faults = tables.account_faults(pick("'a@b.org'", "'a@b'", "'x.y@z.com'", "NULL"), pick("'ann_1'", "'bob'", "'a b'", "'x'"), pick("'Abcdef1!'", "'Zyxwv9?a'", "'abcdefg1'", "''"))
    return o.select(F.col("o_orderkey").alias("id"), F.array_join(faults, ",").alias("faults"))


@query("SELECT c_custkey AS id, sha256(c_name) AS key_hash, c_name AS opened, true AS hidden FROM customer")
def sealed_names(spark, sf_dir):
    key = F.lit("0123456789abcdef").cast("binary")
    c = _table(spark, sf_dir, "customer").withColumn("s", tables.sealed("c_name", key))
    return c.select(F.col("c_custkey").alias("id"), F.sha2("c_name", 256).alias("key_hash"), tables.opened("s", key).alias("opened"), (F.col("s") != F.col("c_name")).alias("hidden"))


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'error' AND user_id % 2 = 0")
def guarded_query(spark, sf_dir):
    _table(spark, sf_dir, "events").createOrReplaceTempView("inkveil_open_events")
    return tables.guarded_select(spark, "SELECT event_id, event_type FROM inkveil_open_events WHERE event_type <> 'error' AND user_id % 2 = 0")


# log lines


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    fields = F.create_map(F.lit("path"), F.concat(F.lit("/p/"), F.col("event_type")), F.when(F.col("user_id") % 3 == 0, "email").otherwise("status"), F.concat(F.lit("u"), F.col("user_id"), F.lit("@x.org")))
    entry = F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.lit("info").alias("level"), F.col("event_type").alias("message"), F.col("user_id").cast("string").alias("user_id"), F.concat(F.lit("User"), "user_id").alias("username"), F.lit("10.0.0.1").alias("remote_addr"), fields.alias("fields"))
    return e.select(F.when(F.col("event_id") % 50 == 0, F.lit("no json")).otherwise(F.to_json(entry)).alias("value"))


@query("SELECT event_type AS message, user_id::VARCHAR AS user_id, '10.0.0.1' AS ip, count(*) AS n, min(date_trunc('second', ts)) AS first FROM events WHERE event_id % 50 <> 0 GROUP BY 1, 2")
def log_entries(spark, sf_dir):
    return logs.parsed(_lines(spark, sf_dir)).groupBy("message", "user_id", "ip").agg(F.count("*").alias("n"), F.min(F.col("ts").cast("timestamp_ntz")).alias("first"))


@query("SELECT event_type AS message, 'User7' AS username, count(*) AS n FROM events WHERE event_id % 50 <> 0 AND user_id = 7 AND date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-28 00:00:00' GROUP BY 1")
def subject_entries(spark, sf_dir):
    time = lambda t: F.lit(t).cast("timestamp")
    return logs.of_subject(_lines(spark, sf_dir), username="user7", since=time("2024-01-02 00:00:00"), until=time("2024-01-28 00:00:00")).groupBy("message", "username").agg(F.count("*").alias("n"))


@query("SELECT event_type AS message, '[REDACTED-GDPR]' AS user_id, CASE WHEN user_id % 3 = 0 THEN '[REDACTED-GDPR]' END AS email, CASE WHEN user_id % 3 = 0 THEN NULL ELSE '[REDACTED-GDPR]' END AS status, count(*) AS n FROM events WHERE event_id % 50 <> 0 GROUP BY ALL")
def erased_entries(spark, sf_dir):
    e = logs.erased(logs.parsed(_lines(spark, sf_dir)))
    return e.groupBy("message", "user_id", F.col("fields")["email"].alias("email"), F.col("fields")["status"].alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT sink, count(*) AS n, count(DISTINCT email) AS n_email FROM (SELECT 'personal' AS sink, 'u' || user_id || '@x.org' AS email FROM events WHERE event_id % 50 <> 0
 UNION ALL SELECT 'standard', CASE WHEN length('u' || user_id) <= 4 THEN 'u***@x.org' ELSE substr('u' || user_id, 1, 2) || repeat('*', length('u' || user_id) - 4) || right(user_id::VARCHAR, 2) || '@x.org' END FROM events WHERE event_id % 50 <> 0) t GROUP BY 1""")
def log_sinks(spark, sf_dir):
    e = logs.categorised(logs.parsed(_lines(spark, sf_dir)))
    value = F.coalesce(F.col("fields")["email"], F.col("fields")["status"])
    return e.groupBy("sink").agg(F.count("*").alias("n"), F.countDistinct(value).alias("n_email"))


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - CASE event_type WHEN 'error' THEN INTERVAL 5 DAY WHEN 'purchase' THEN INTERVAL 10 DAY ELSE INTERVAL 20 DAY END")
def kept_logs(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return logs.kept(e, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), {"view": 20, "error": 5, "purchase": 10}, "event_type").select("event_id", "event_type")


# labels

_MANUAL = "SELECT 'f' || (c_custkey % 20) || '.txt' AS file, upper(c_mktsegment) AS text, c_mktsegment AS type FROM customer WHERE c_custkey % 2 = 0"
_FOUND = "SELECT 'f' || (c_custkey % 20) || '.txt' AS file, lower(substr(c_mktsegment, 1, (5 + c_custkey % 7)::INT)) AS text, CASE WHEN c_custkey % 5 = 0 THEN 'OTHER' ELSE c_mktsegment END AS type FROM customer WHERE c_custkey % 4 = 0"


def _manual(spark, sf_dir):
    return _table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.expr("concat('f', c_custkey % 20, '.txt')").alias("file"), F.upper("c_mktsegment").alias("text"), F.col("c_mktsegment").alias("type"))


def _found(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").filter("c_custkey % 4 = 0")
    return c.select(F.expr("concat('f', c_custkey % 20, '.txt')").alias("file"), F.expr("lower(substr(c_mktsegment, 1, cast(5 + c_custkey % 7 AS int)))").alias("text"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN 'OTHER' ELSE c_mktsegment END").alias("type"))


@query(f"SELECT DISTINCT f.file, f.text, f.type, EXISTS (SELECT 1 FROM ({_MANUAL}) m WHERE m.file = f.file AND (contains(lower(m.text), lower(f.text)) OR contains(lower(f.text), lower(m.text)))) AS partial, EXISTS (SELECT 1 FROM ({_MANUAL}) m WHERE m.file = f.file AND m.type = f.type AND (contains(lower(m.text), lower(f.text)) OR contains(lower(f.text), lower(m.text)))) AS typed FROM ({_FOUND}) f")
def label_matches(spark, sf_dir):
    m, f = _manual(spark, sf_dir), _found(spark, sf_dir).distinct()
    return labels.partial(f, m).withColumnRenamed("matched", "partial").join(labels.partial(f, m, typed=True).withColumnRenamed("matched", "typed"), ["file", "text", "type"])


_LINES = "SELECT DISTINCT lower(line) AS line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) t"


@query(f"SELECT line AS text, EXISTS (SELECT 1 FROM benchmark b WHERE contains(lower(b.text), line) OR contains(line, lower(b.text))) AS matched FROM ({_LINES}) l")
def benchmark_lines(spark, sf_dir):
    """All lines of documents, and whether one holds or is held by an item of the benchmark."""
    as_labels = lambda df: df.select(F.lit("all").alias("file"), "text", F.lit("LINE").alias("type"))
    lines = _table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("text")).select(F.lower("text").alias("text"))
    return labels.partial(as_labels(lines), as_labels(_table(spark, sf_dir, "benchmark"))).select("text", "matched")


_STEM = "lower(regexp_replace(regexp_replace({}, '^.*/', ''), '[.][^.]*$', ''))"
_CHARS = "len(list_distinct(string_split({0}, '')))"


@query(
    f"""WITH n AS (SELECT name, {_STEM.format("name")} AS b FROM (SELECT DISTINCT p_name || '.pdf' AS name FROM part) p), t AS (SELECT target, {_STEM.format("target")} AS b FROM (SELECT DISTINCT split_part(p_name, ' ', 1) || '.json' AS target FROM part) p),
based AS (SELECT b, min(target) AS target FROM t GROUP BY 1),
near AS (SELECT n.name, arg_max(t.target, struct_pack(s := s, t := t.target)) AS target FROM n, t, LATERAL (SELECT CASE WHEN contains(t.b, n.b) THEN {_CHARS.format("n.b")} / length(t.b) WHEN contains(n.b, t.b) THEN {_CHARS.format("t.b")} / length(n.b) END AS s) WHERE s > 0.2 AND n.b <> '' AND t.b <> '' GROUP BY 1)
SELECT n.name, coalesce(based.target, near.target) AS target FROM n LEFT JOIN based USING (b) LEFT JOIN near ON near.name = n.name"""
)
def near_file_names(spark, sf_dir):
    """Names of parts as files, mapped to files that are named by a first word."""
    p = _table(spark, sf_dir, "part")
    return labels.mapped_names(p.select(F.concat("p_name", F.lit(".pdf")).alias("name")), p.select(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(".json")).alias("target")), least=0.2)


@query()
def greedy_matches(spark, sf_dir):
    """One manual label for each found one, in order; tests hold it against a loop."""
    m, f = _manual(spark, sf_dir), _found(spark, sf_dir)
    return labels.greedy(f.withColumn("pos", F.xxhash64("text", "type")), m.withColumn("pos", F.xxhash64("text")))


@query(f"SELECT k, coalesce(a, 0) AS n_a, coalesce(b, 0) AS n_b, coalesce(a, 0) - coalesce(b, 0) AS difference, CASE WHEN coalesce(b, 0) = 0 THEN 'inf'::DOUBLE ELSE coalesce(a, 0) / b END AS ratio FROM (SELECT type AS k, count(*) AS a FROM ({_FOUND}) GROUP BY 1) x FULL JOIN (SELECT type AS k, count(*) AS b FROM ({_MANUAL}) GROUP BY 1) y USING (k)")
def type_ratios(spark, sf_dir):
    return labels.compared(_found(spark, sf_dir), _manual(spark, sf_dir))


@query("SELECT engine, total, positive, rate, rank() OVER (ORDER BY rate DESC) AS place FROM (SELECT l_linestatus || l_returnflag AS engine, count(*) AS total, count(*) FILTER (l_discount > 0.05) AS positive, round(100.0 * count(*) FILTER (l_discount > 0.05) / count(*), 4)::DOUBLE AS rate FROM lineitem GROUP BY 1) t")
def engine_ranks(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").select(F.concat("l_linestatus", "l_returnflag").alias("engine"), (F.col("l_discount") > 0.05).alias("positive"))
    return labels.ranked(li)


@query("SELECT l_returnflag AS type, count(*) AS total, count(*) FILTER (l_discount > 0.05) AS positive, count(*) FILTER (l_discount <= 0.05) AS negative, round(100.0 * count(*) FILTER (l_discount > 0.05) / count(*), 4)::DOUBLE AS rate, round(100.0 * count(*) FILTER (l_discount <= 0.05) / count(*), 4)::DOUBLE AS false_rate FROM lineitem GROUP BY 1")
def label_shares(spark, sf_dir):
    return labels.shares(_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("type"), (F.col("l_discount") > 0.05).alias("positive")))


@query("SELECT CASE g WHEN 0 THEN 'a' ELSE 'b' END AS grain, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END::DOUBLE AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END::DOUBLE AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END::DOUBLE AS f1 FROM (SELECT o_orderkey % 2 AS g, count(*) FILTER (o_orderstatus = 'F') AS tp, count(*) FILTER (o_orderstatus = 'O') AS fp, count(*) FILTER (o_orderstatus = 'P') AS fn FROM orders GROUP BY 1) t")
def quality_figures(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.expr("CASE o_orderkey % 2 WHEN 0 THEN 'a' ELSE 'b' END").alias("grain"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'tp' WHEN 'O' THEN 'fp' ELSE 'fn' END").alias("outcome"))
    return labels.figures(o, ["grain"])


@query("SELECT 'f' || (c_custkey % 20) || '.txt' AS name, CASE WHEN c_custkey % 20 < 10 THEN 'f' || (c_custkey % 20) || '.txt' WHEN c_custkey % 20 < 15 THEN 'dir/f' || (c_custkey % 20) || '.json' END AS target FROM (SELECT DISTINCT c_custkey % 20 AS c_custkey FROM customer)")
def file_names(spark, sf_dir):
    n = _table(spark, sf_dir, "customer").select((F.col("c_custkey") % 20).alias("k")).distinct()
    targets = n.filter("k < 10").select(F.expr("concat('f', k, '.txt')").alias("target")).unionByName(n.filter("k between 10 and 14").select(F.expr("concat('dir/f', k, '.json')").alias("target")))
    return labels.mapped_names(n.select(F.expr("concat('f', k, '.txt')").alias("name")), targets, fuzzy=False)


@query("SELECT 'f' || (c_custkey % 20) || '.txt' AS file, 1 AS page, lower(c_mktsegment) AS text, CASE c_mktsegment WHEN 'BUILDING' THEN 'HOUSE' ELSE c_mktsegment END AS type, 1.0 AS confidence FROM customer WHERE c_custkey % 3 > 0")
def flat_labels(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    nested = c.select(F.expr("concat('f', c_custkey % 20, '.txt')").alias("file"), F.expr("array(named_struct('page', 1, 'entities', array(named_struct('text', lower(c_mktsegment), 'type', c_mktsegment, 'confidence', cast(null as double)))))").alias("pages"), (F.col("c_custkey") % 3 > 0).alias("ok"))
    return labels.flat(nested.filter("ok"), {"BUILDING": "HOUSE"})


@query(r"SELECT doc_id, trim(regexp_replace(replace(coalesce(text, ''), '\n', ' '), '\s+', ' ', 'g')) AS text FROM documents")
def clean_labels(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", labels.clean_text("text").alias("text"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'A:x|B:y' WHEN 1 THEN 'NAME:Ann Lee' WHEN 2 THEN 'CITY:Oslo|NAME:Per' WHEN 3 THEN 'PHONE:123' ELSE '' END AS labels FROM orders")
def manual_labels(spark, sf_dir):
    raw = F.expr("""CASE o_orderkey % 5 WHEN 0 THEN '{"A": ["x"], "B": ["y"]}' WHEN 1 THEN 'see [NAME: Ann Lee] here' WHEN 2 THEN 'in <CITY>Oslo</CITY> with <NAME>Per</NAME>' WHEN 3 THEN '{"PHONE": "123", broken' ELSE 'nothing' END""")
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.explode_outer(labels.manual(raw)).alias("l"))
    return o.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("l.type", F.lit(":"), "l.text"))), "|").alias("labels"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '{\"a\":1,\"b\":[1,2]}' WHEN 1 THEN '{\"a\":1}' WHEN 2 THEN '{\"a\":{\"b\":1}}' END AS repaired, CASE WHEN o_orderkey % 4 = 3 THEN true ELSE false END AS bad FROM orders")
def json_repair(spark, sf_dir):
    raw = F.expr("""CASE o_orderkey % 4 WHEN 0 THEN '{"a":1,"b":[1,2,],}' WHEN 1 THEN '{"a":1} trailing }' WHEN 2 THEN '{"a":{"b":1}}},' ELSE 'no json' END""")
    return labels.repaired(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("line")), "line").select("id", "repaired", "bad")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN '{\"a\":1}' WHEN 1 THEN '{\"b\":{\"c\":2}}' END AS answer FROM orders")
def answer_json(spark, sf_dir):
    raw = F.expr("""CASE o_orderkey % 3 WHEN 0 THEN 'Here: ```json\n{"a":1}\n``` ok' WHEN 1 THEN 'json {"b":{"c":2}} and {x' ELSE 'sorry' END""")
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), labels.answer(raw).alias("answer"))


# listings, samples and keys


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 20")
def listed_customers(spark, sf_dir):
    return tables.listed(_table(spark, sf_dir, "customer"), [F.desc("c_acctbal"), F.col("c_custkey")], 20, 2).select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 50")
def entities_of_method(spark, sf_dir):
    li = tables.where(_table(spark, sf_dir, "lineitem"), l_returnflag="R", l_linestatus="F")
    return tables.listed(li, [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")], 50).select("l_orderkey", "l_linenumber")


@query("SELECT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1 ORDER BY 1 LIMIT 15")
def next_files(spark, sf_dir):
    done = _table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    return tables.next_unprocessed(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct(), done, "k", 15)


@query("SELECT p_partkey FROM part ORDER BY p_name, p_partkey LIMIT 10")
def first_files(spark, sf_dir):
    p = _table(spark, sf_dir, "part").withColumn("o", F.struct("p_name", "p_partkey"))
    return tables.first_files(p, "o").select("p_partkey")


@query("SELECT p_partkey FROM part ORDER BY md5('5:' || p_partkey), p_partkey LIMIT 12")
def random_files(spark, sf_dir):
    return tables.random_files(_table(spark, sf_dir, "part"), "p_partkey", 12, 5).select("p_partkey")


@query("SELECT coalesce(c_custkey, s_suppkey + 145) AS pos, CASE WHEN c_custkey IS NULL THEN 'no file' WHEN s_suppkey IS NULL THEN 'no mapping' ELSE 'ready' END AS status FROM (SELECT c_custkey FROM customer WHERE c_custkey <= 150) c FULL JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey <= 10) s ON c_custkey = s_suppkey + 145")
def staged_files(spark, sf_dir):
    files = _table(spark, sf_dir, "customer").filter("c_custkey <= 150").select(F.col("c_custkey").alias("pos"))
    return tables.staged(files, _table(spark, sf_dir, "supplier").filter("s_suppkey <= 10").select((F.col("s_suppkey") + 145).alias("pos"))).select("pos", "status")


@query("SELECT user_id FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 60 MINUTE")
def idle_clients(spark, sf_dir):
    seen = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return tables.idle(seen, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), 60).select("user_id")


@query("SELECT c_custkey AS key_id FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 4 <> 1")
def verified_keys(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    keys = c.select(F.col("c_custkey").alias("key_id"), F.sha2("c_name", 256).alias("key_hash"), F.expr("CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN timestamp_ntz '2024-01-01 00:00:00' ELSE timestamp_ntz '2025-01-01 00:00:00' END").alias("expires_at"))
    given = c.select(F.col("c_custkey").alias("key_id"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'wrong' END").alias("secret"))
    return tables.verified_keys(given, keys, now).select("key_id")


@query("SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 'dark' ELSE 'system' END AS theme FROM customer")
def default_settings(spark, sf_dir):
    users = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    own = users.filter("user_id % 2 = 0").withColumn("theme", F.lit("dark"))
    return tables.add_missing(own, users.withColumn("theme", F.lit("system")), ["user_id"])


@query("SELECT o_orderkey AS id, text, type FROM orders, (VALUES ('a', 'A'), ('b', 'B')) t(text, type) WHERE o_orderkey % 2 = 0 OR type = 'A'")
def gathered_entities(spark, sf_dir):
    nested = F.expr("array(named_struct('text', array(named_struct('entities', array(named_struct('text', 'a', 'type', 'A'))))), named_struct('text', array(named_struct('entities', CASE WHEN o_orderkey % 2 = 0 THEN array(named_struct('text', 'b', 'type', 'B')) END))))")
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), nested.alias("pages"))
    return o.select("id", F.explode(labels.gathered("pages")).alias("e")).select("id", "e.text", "e.type")


@query("SELECT item_id, 'Find names in: ' || text || chr(10) || 'Answer in English as JSON {\"names\": []}.' AS p FROM benchmark")
def prompts(spark, sf_dir):
    b = _table(spark, sf_dir, "benchmark")
    return b.select("item_id", models.prompt('Find names in: {text}\nAnswer in {lang} as JSON {"names": []}.', text=F.col("text"), lang=F.lit("English")).alias("p"))


@query("SELECT doc_id, 0 AS page, 'CODE' AS entity_type, m AS original_text, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{4}')) AS m FROM documents) t GROUP BY ALL")
def recognised(spark, sf_dir):
    """The slot of a model, with digits in groups of four as the model's finds."""

    def model(pieces):
        return [[(m.start(), m.end(), "CODE", 0.9) for m in re.finditer(r"[0-9]{4}", p)] for p in pieces]

    d = _table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("page"), "text")
    return models.recognise(d, model).groupBy("doc_id", "page", "entity_type", "original_text").agg(F.count("*").alias("n"))
