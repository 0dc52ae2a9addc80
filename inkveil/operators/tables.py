"""Rows of a table by key: insert, update, upsert, delete with dependants, lookups, listing; files and their formats.

A table is a DataFrame; a write gives the new table, which replaces the old one by an overwrite of its files (or of the
partitions that changed). Keys are joined, so both sides may be of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators import numbering

# What an ad-hoc query mustn't name, and the columns by which tables are addressed.
DENIED = ("information_schema", "users", "user_settings", "api_keys", "sessions", "password", "update ", "insert ", "delete ", "drop ", "alter ", "create ", "truncate ")


def insert(table: DataFrame, rows: DataFrame, id_col: str, order: str) -> DataFrame:
    """`table` with `rows` (without ids) behind it, numbered on from its largest id in the order of a column."""
    most = table.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    new = numbering.numbered(rows, order).withColumn(id_col, (F.col("rn") + most).cast(table.schema[id_col].dataType))
    return table.unionByName(new.select(*table.columns))


def update(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """`table` with the columns of `changes` replaced in the rows that have their key; a null in `changes` leaves the value."""
    set_cols = [c for c in changes.columns if c not in key]
    new = changes.select(*key, *(F.col(c).alias(f"_new_{c}") for c in set_cols))
    return table.join(new, key, "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in set_cols}).select(*table.columns)


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """`rows`, and those of `table` whose key they don't have."""
    return table.join(rows.select(*key), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def add_missing(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """`table`, and those of `rows` (each key once) that it doesn't have."""
    return table.unionByName(rows.dropDuplicates(key).join(table.select(*key), key, "left_anti").select(*table.columns))


def delete(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """`table` without the rows whose key is in `keys`."""
    return table.join(keys.select(*key).distinct(), key, "left_anti")


def delete_with(parent: DataFrame, child: DataFrame, keys: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Parent and child tables without the keys."""
    return delete(parent, keys, key), delete(child, keys, key)


def replace_for(table: DataFrame, rows: DataFrame, owner: list[str]) -> DataFrame:
    """`table` with all rows of the owners in `rows` replaced by these, as an import does."""
    return delete(table, rows, owner).unionByName(rows.select(*table.columns))


def exists(keys: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """`keys` with `found`: whether `table` has a row with the key."""
    return keys.join(table.select(*key).distinct().withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def where(table: DataFrame, **values) -> DataFrame:
    """Rows with all of these values; None stands for null."""
    for c, v in values.items():
        table = table.filter(F.col(c).isNull() if v is None else F.col(c) == v)
    return table


def by_id(table: DataFrame, name: str, value: int) -> DataFrame:
    """The row with an id; the column is the table's name in the singular with _id."""
    singular = name[:-3] + "y" if name.endswith("ies") else name.removesuffix("s")
    return where(table, **{f"{singular}_id": value})


def listed(table: DataFrame, order: list[Column], limit: int = 20, page: int = 1) -> DataFrame:
    """A page of a listing, of 1 to 100 rows."""
    limit = min(100, max(1, limit))
    return table.orderBy(*order).offset((max(1, page) - 1) * limit).limit(limit)


def guarded_select(spark: SparkSession, query: str, denied: tuple[str, ...] = DENIED) -> DataFrame:
    """The rows of an ad-hoc query if it is a SELECT and names nothing that is denied."""
    if not query.strip().upper().startswith("SELECT") or any(w in query.lower() for w in denied):
        raise PermissionError("only SELECT queries over open tables are allowed")
    return spark.sql(query)


def columns_of(df: DataFrame) -> DataFrame:
    """Rows (position, name, type, nullable) of the columns of a table."""
    rows = [(i + 1, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def alive(table: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    return table.filter(F.col(expires).isNull() | (F.col(expires) > now))


def expired(table: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    return table.filter(F.col(expires) < now)


def page_range(items: DataFrame, total: Column | int, page: str = "page") -> DataFrame:
    """Items on pages from 1 to `total`."""
    return items.filter((F.col(page) >= 1) & (F.col(page) <= total))


def bundle(owners: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """One row for each owner with its rows of every part as a sorted list, empty if there are none."""
    out = owners
    for name, df in parts.items():
        rest = [c for c in df.columns if c != key]
        out = out.join(df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name)), key, "left")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    return out


def file_type(name: Column | str, content: Column | str) -> Column:
    """The MIME type by the extension, else by the first bytes; null if neither tells."""
    n, c = (F.col(x) if isinstance(x, str) else x for x in (name, content))
    ext = F.lower(F.regexp_extract(n, r"\.([^./]+)$", 1))
    by_name = F.when(ext == "pdf", "application/pdf").when(ext == "txt", "text/plain").when(ext == "json", "application/json").when(ext == "png", "image/png").when(ext.isin("jpg", "jpeg"), "image/jpeg")
    by_bytes = F.when(F.startswith(c, F.lit("%PDF").cast("binary")), "application/pdf").when(F.startswith(c, F.unhex(F.lit("89504E47"))), "image/png").when(F.startswith(c, F.unhex(F.lit("FFD8FF"))), "image/jpeg").when(F.startswith(c, F.unhex(F.lit("504B0304"))), "application/zip")
    return F.coalesce(by_name, by_bytes)


def upload_fault(content: Column | str, mime: Column | str, most: int = 10 << 20) -> Column:
    """Why an upload is refused, null if it isn't: its type, its size, its first bytes and version, or active content."""
    c, m = (F.col(x) if isinstance(x, str) else x for x in (content, mime))
    text = F.decode(c, "ISO-8859-1")
    return (
        F.when(~F.coalesce(m == "application/pdf", F.lit(False)), "type")
        .when(F.length(c) > most, "size")
        .when(~text.rlike(r"^%PDF-1\.[1-9]"), "magic")
        .when(F.contains(text, F.lit("/JavaScript")) | F.contains(text, F.lit("/JS")) | F.contains(text, F.lit("/AcroForm")), "active")
    )


def safe_filename(name: Column | str, most: int = 255, default: str = "unnamed_file") -> Column:
    """A file name without slashes, control and shell characters, at most `most` long."""
    n = F.col(name) if isinstance(name, str) else name
    out = F.substr(F.trim(F.regexp_replace(n, r"[/\\\x00-\x1f\x7f<>:\"|?*;&$`'!]", "")), F.lit(1), F.lit(most))
    return F.when(F.coalesce(out, F.lit("")) == "", default).otherwise(out)


def client_ip(forwarded: Column | str, direct: Column | str, most: int = 45) -> Column:
    """The first address of a forwarding header, else the direct one, at most `most` characters."""
    f, d = (F.col(x) if isinstance(x, str) else x for x in (forwarded, direct))
    first = F.trim(F.substring_index(f, ",", 1))
    return F.substr(F.coalesce(F.when(first != "", first), d, F.lit("unknown")), F.lit(1), F.lit(most))


def in_network(ip: Column | str, network: Column | str) -> Column:
    """Whether an IPv4 address equals `network` or lies in it if it is one in CIDR form; false for other texts."""
    a, n = (F.col(x) if isinstance(x, str) else x for x in (ip, network))

    def number(c: Column) -> Column:
        p = F.split(c, r"\.")
        ok = c.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
        return F.when(ok, sum((F.get(p, F.lit(i)).cast("long") * (1 << 8 * (3 - i)) for i in range(4)), F.lit(0).cast("long")))

    bits = F.regexp_extract(n, r"^[^/]+/(\d+)$", 1).try_cast("int")
    size = F.call_function("shiftleft", F.lit(1).cast("long"), 32 - bits)
    inside = F.floor(number(a) / size) == F.floor(number(F.substring_index(n, "/", 1)) / size)
    return (a == n) | F.coalesce(bits.between(0, 32) & inside, F.lit(False))


def banned(requests: DataFrame, bans: DataFrame, ip: str = "ip") -> DataFrame:
    """`requests` whose address a row of `bans` (network) names or holds. Single addresses are joined on equality; networks are
    joined on each prefix length that occurs (33 at most), so neither side is gone through for every row of the other. Distinct addresses
    are looked up, and requests, repeated ones too, kept by their address; null addresses aren't banned."""
    single = bans.filter(~F.col("network").contains("/")).select(F.col("network").alias("_k"))
    wide = bans.filter(F.col("network").rlike(r"^[^/]+/\d+$")).select(F.substring_index("network", "/", 1).alias("_a"), F.substring_index("network", "/", -1).cast("int").alias("_bits")).filter("_bits between 0 and 32")
    number = lambda c: sum((F.element_at(F.split(c, r"\."), i + 1).cast("long") * (1 << 8 * (3 - i)) for i in range(4)), F.lit(0).cast("long"))
    cut = lambda n: F.concat(F.col("_bits").cast("string"), F.lit("/"), F.floor(n / F.call_function("shiftleft", F.lit(1).cast("long"), 32 - F.col("_bits"))).cast("string"))
    nets = wide.select(cut(number("_a")).alias("_k"))
    lengths = [r[0] for r in wide.select("_bits").distinct().collect()]  # 33 at most
    addresses = requests.select(ip).distinct()
    ipv4 = addresses.filter(F.col(ip).rlike(r"^\d+\.\d+\.\d+\.\d+$"))
    keys = ipv4.withColumn("_bits", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>"))).withColumn("_k", cut(number(ip)))
    hit = addresses.withColumn("_k", F.col(ip)).join(single, "_k", "left_semi").select(ip).unionByName(keys.join(nets, "_k", "left_semi").select(ip))
    return requests.join(hit, ip, "left_semi").select(*requests.columns)


def expiry(duration: Column | str, since: Column) -> Column:
    """The time after a duration such as 30d, 12h, 45m or 1y; null for other texts (never expires)."""
    d = F.col(duration) if isinstance(duration, str) else duration
    n = F.regexp_extract(d, r"^(\d+)([smhdwy])$", 1).try_cast("int")
    unit = F.regexp_extract(d, r"^(\d+)([smhdwy])$", 2)
    seconds = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 7 * 86400).when(unit == "y", 365 * 86400)
    return since + F.make_dt_interval(secs=(n * seconds).cast("decimal(18,6)"))


def account_faults(email: Column | str, name: Column | str, password: Column | str) -> Column:
    """What is wrong with an account's data: e-mail, user name (3 to 50 letters, digits, _ and -), password (8 characters with upper and lower case, a digit and another)."""
    e, n, p = (F.col(x) if isinstance(x, str) else x for x in (email, name, password))
    ok = lambda c, rx: F.coalesce(c.rlike(rx), F.lit(False))
    strong = (F.coalesce(F.length(p), F.lit(0)) >= 8) & ok(p, "[A-Z]") & ok(p, "[a-z]") & ok(p, "[0-9]") & ok(p, "[^A-Za-z0-9]")
    tests = {"email": ok(e, r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"), "username": ok(n, r"^[A-Za-z0-9_\-]{3,50}$"), "password": strong}
    return F.filter(F.array(*(F.when(~good, F.lit(k)) for k, good in tests.items())), lambda x: x.isNotNull())


def sealed(text: Column | str, key: Column) -> Column:
    """A text encrypted by AES in GCM mode as Base64: nonce, ciphertext and tag."""
    return F.base64(F.aes_encrypt(F.col(text) if isinstance(text, str) else text, key, F.lit("GCM")))


def opened(sealed_text: Column | str, key: Column) -> Column:
    """The text of sealed(); null if it was tampered with."""
    return F.try_aes_decrypt(F.unbase64(F.col(sealed_text) if isinstance(sealed_text, str) else sealed_text), key, F.lit("GCM")).cast("string")


def write_by_day(rows: DataFrame, path: str, time_col: str) -> None:
    """Append rows as JSON lines under a folder for each day."""
    rows.withColumn("date", F.to_date(time_col)).write.mode("append").partitionBy("date").json(path)


def next_unprocessed(files: DataFrame, done: DataFrame, key: str, most: int) -> DataFrame:
    """The first `most` files, by key, that aren't done."""
    return files.join(done.select(key).distinct(), key, "left_anti").orderBy(key).limit(most)


def first_files(files: DataFrame, order: str, most: int = 10) -> DataFrame:
    """A batch of files, of `most` at most; the rest is left for another batch."""
    return files.orderBy(order).limit(most)


def random_files(files: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """`n` files drawn by a hash of the seed and their key, the same at every run."""
    return files.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def staged(files: DataFrame, mappings: DataFrame, key: str = "pos") -> DataFrame:
    """Files with their redaction mappings by position and a status: ready, or what is missing."""
    both = files.withColumn("_f", F.lit(True)).join(mappings.withColumn("_m", F.lit(True)), key, "full")
    return both.withColumn("status", F.when(F.col("_f").isNull(), "no file").when(F.col("_m").isNull(), "no mapping").otherwise("ready")).drop("_f", "_m")


def idle(clients: DataFrame, now: Column, minutes: int, seen: str = "last_seen") -> DataFrame:
    """Clients not seen for so long, whose limiters go."""
    return clients.filter(F.col(seen) < now - F.make_dt_interval(mins=F.lit(minutes)))


def verified_keys(given: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Given (key_id, secret) whose hash is that of a key that hasn't expired."""
    return given.withColumn("key_hash", F.sha2("secret", 256)).join(alive(keys, now).select("key_id", "key_hash"), ["key_id", "key_hash"], "left_semi").select(*given.columns)
