"""Masks and tests of log fields, messages, file names and addresses, as columns."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of fields that hold sensitive or personal data, and expressions for names and values.
SENSITIVE_NAMES = ("password", "token", "key", "secret", "auth_token", "access_token", "refresh_token", "jwt", "api_key", "credit_card", "card_number", "cvv", "ssn", "social_security", "hash", "salt")
PERSONAL_NAMES = (
    "user_id", "username", "email", "ip_address", "ip", "address", "phone", "name", "full_name", "first_name", "last_name", "zip_code",
    "postal_code", "city", "state", "country", "age", "gender", "dob", "date_of_birth", "session_id", "customer_id", "client_id",
)
SECRET = r"(?i)passw(or)?d|pwd|auth|token|secret|key|credential|jwt|bearer"
EMAIL = r"(?i)[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CARD = r"(?:\d[ -]*?){13,16}"
PERSONAL = r"(?i)\bname\b|\buser(name)?\b|\bemail\b|\bphone\b|\baddress\b|\bzip\b|\bpostal\b|\bcity\b|\bcountry\b|\bstate\b|\bip[_\s-]?addr|\buser[_\s-]?id\b|\bsession[_\s-]?id\b"
SENSITIVE = (
    r"(?i)\bcredit[_\s-]?card\b|\bcard[_\s-]?number\b|\bcvv\b|\bssn\b|\bsocial[_\s-]?security\b|\btax[_\s-]?id\b|\bpassport\b|\bdob\b|\bdate[_\s-]?of[_\s-]?birth\b"
    r"|\bhealth\b|\bmedical\b|\binsurance\b|\bcertificate\b|\blicense\b"
)
REDACTED_KEYS = ("password_hash", "salt", "api_key_hash", "password", "api_key", "token", "secret", "credit_card", "ssn", "social_security")
# Words of a message that is withheld whole.
MESSAGE_WORDS = (
    "password", "secret", "key", "token", "credential", "auth", "ssn", "social", "credit", "card", "cvv", "secure", "private", "passport", "license", "national", "health", "insurance",
    "bank", "fodselsnummer", "personnummer", "address", "phone", "email", "api", "access_token", "refresh_token", "bearer", "authorization", "admin", "username", "login", "signin", "certificate", "privkey",
)
MESSAGE_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
URLS = r"https?://[^\s/$.?#].[^\s]*|redis://[^\s]*|mongodb://[^\s]*|postgresql://[^\s]*|mysql://[^\s]*|jdbc:[^\s]*|file://[^\s]*|ftp://[^\s]*|s3://[^\s]*"
#: Rewrites of a message after paths, JSON and addresses, in order.
REWRITES = (
    (r"(?i)(auth|token|bearer|jwt|api[-_]?key)[^\s]*", "[AUTH_TOKEN]"),
    (MESSAGE_EMAIL, "[EMAIL]"),
    (r"\b\d{6}\s?\d{5}\b", "[NATIONAL_ID]"),
    (r"\b(?:\d{4}[ -]?){3}\d{4}\b", "[CREDIT_CARD]"),
    (r"(?i)\b(?:id|user|account)[\s:=_-]+(\d{4,})\b", "$1:[ID_NUMBER]"),
    (r"\b\d{8,16}\b", "[NUMBER_SEQUENCE]"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP_ADDRESS]"),
)
SENSITIVE_ERRORS = (
    r"password[=:]\S+", r"key[=:]\S+", r"token[=:]\S+", r"secret[=:]\S+", r"auth[=:]\S+", r"Basic\s+[A-Za-z0-9+/=]+", r"Bearer\s+[A-Za-z0-9._-]+", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    r"\b(?:\d{1,3}\.){3}\d{1,3}\b", r"filename.*\.(pdf|docx|txt)", r"traceback", r"user[=:]\S+", r"pass[=:]\S+", r"SELECT\s+.*\s+FROM",
)
FILE_NAMES = (MESSAGE_EMAIL, r"\b\d{6}\s?\d{5}\b", r"\b\d{3}[-\.\s]?\d{2}[-\.\s]?\d{4}\b", r"\b(?:\+\d{1,3}[-\.\s]?)?(?:\d{1,4}[-\.\s]?){2,5}\d{1,4}\b", "password", "secure", "confidential", "private", "secret")
QUERY_NAMES = ("key", "api_key", "apikey", "password", "secret", "token", "auth", "access_token", "refresh_token", "code", "id_token", "user", "username", "email", "session", "account", "jwt", "credentials", "client_secret", "private")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _has(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def card_number(value: Column | str) -> Column:
    """Whether a text with a run of 13 to 16 digits is, without spaces and dashes, a number of 13 to 19 digits that passes the Luhn test."""
    v = _col(value)
    plain = F.translate(v, " -", "")
    return _has(v, CARD) & F.octet_length(plain).between(13, 19) & F.call_function("luhn_check", plain)


def sensitive_field(name: Column | str, value: Column | str) -> Column:
    """Whether a field's name or its text says that it holds secrets, card numbers, health data and the like."""
    n, v = F.lower(_col(name)), _col(value)
    return _has(n, "|".join(SENSITIVE_NAMES)) | _has(n, SECRET) | F.coalesce((F.octet_length(v) >= 3) & (card_number(v) | _has(v, SENSITIVE)), F.lit(False))


def email_field(name: Column | str, value: Column | str) -> Column:
    return _has(F.lower(_col(name)), "email") | _has(_col(value), EMAIL)


def personal_field(name: Column | str, value: Column | str) -> Column:
    n = F.lower(_col(name))
    return _has(n, "|".join(PERSONAL_NAMES)) | _has(n, PERSONAL) | _has(_col(value), EMAIL)


def personal_text(text: Column | str) -> Column:
    t = _col(text)
    return F.coalesce((F.octet_length(t) >= 5) & (_has(t, EMAIL) | _has(t, PERSONAL)), F.lit(False))


def sensitive_text(text: Column | str) -> Column:
    t = _col(text)
    return F.coalesce((F.octet_length(t) >= 5) & (_has(t, SECRET) | card_number(t) | _has(t, SENSITIVE)), F.lit(False))


def mask_email(email: Column | str) -> Column:
    """Two letters at either end of the user, or one of a short user; `***@***` if it is no single address."""
    e = _col(email)
    parts = F.split(e, "@")
    user, domain = parts[0], F.get(parts, F.lit(1))
    short = F.concat(F.substring(user, 1, 1), F.lit("***@"), domain)
    long = F.concat(F.substring(user, 1, 2), F.repeat(F.lit("*"), F.length(user) - 4), F.substring(user, -2, 2), F.lit("@"), domain)
    return F.when(e.isNull(), None).when(F.size(parts) != 2, "***@***").when(F.length(user) <= 4, short).otherwise(long)


def mask_email_ends(email: Column | str) -> Column:
    """The first and last letter of the user; what is no single address, or has two letters at most, stays."""
    e = _col(email)
    parts = F.split(e, "@")
    user = parts[0]
    masked = F.concat(F.substring(user, 1, 1), F.repeat(F.lit("*"), F.length(user) - 2), F.substring(user, -1, 1), F.lit("@"), F.get(parts, F.lit(1)))
    return F.when((F.size(parts) == 2) & (F.length(user) > 2), masked).otherwise(e)


def mask_value(name: Column | str, value: Column | str, kind: T.DataType) -> Column:
    """A value as text, masked by its type: the ends of a text, the magnitude of a whole number, one decimal, the date of a time."""
    n, v = F.lower(_col(name)), _col(value)
    if isinstance(kind, T.StringType):
        ends = F.when(F.length(v) > 2, F.concat(F.substring(v, 1, 1), F.repeat(F.lit("*"), F.length(v) - 2), F.substring(v, -1, 1))).otherwise("**")
        masked = F.when(email_field(n, v), mask_email(v)).otherwise(ends)
    elif isinstance(kind, T.IntegralType):
        masked = F.when(_has(n, "id"), "***").when(v > 0, F.concat(F.lit("~1"), F.repeat(F.lit("0"), F.length(v.cast("string")) - 1))).otherwise("0")
    elif isinstance(kind, (T.FractionalType,)):
        masked = F.when(_has(n, "id"), "***").otherwise(F.regexp_replace(F.format_string("~%.1f", v.cast("double")), r"^~-0\.0$", "~0.0"))
    elif isinstance(kind, T.BooleanType):
        masked = v.cast("string")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        masked = F.date_format(v, "yyyy-MM-dd")
    else:
        masked = F.lit("***")
    return F.when(v.isNull(), None).when(n == "user_id", "***").otherwise(masked)


def mask_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df` with `columns` masked by mask_value."""
    return df.withColumns({c: mask_value(F.lit(c), F.col(c), df.schema[c].dataType) for c in columns})


def log_category(fields: Column | str) -> Column:
    """The category of a map of fields: sensitive before personal before standard."""
    entries = F.map_entries(_col(fields))
    return F.when(F.exists(entries, lambda e: sensitive_field(e["key"], e["value"])), "sensitive").when(F.exists(entries, lambda e: personal_field(e["key"], e["value"])), "personal").otherwise("standard")


def sanitise_fields(fields: Column | str, level: str, sensitive: Column | None = None) -> Column:
    """A map of fields with sensitive ones redacted, and personal ones by `level`: low masks e-mail addresses, medium all, high withholds them; none leaves all.

    sensitive: whether any field is sensitive, where that is known; else every field is tested."""
    if level not in ("none", "low", "medium", "high"):
        raise ValueError("level must be none, low, medium or high")
    m = _col(fields)
    if level == "none":
        return m

    def personal(k: Column, v: Column) -> Column:
        masked = {"low": F.when(email_field(k, v), mask_email(v)).otherwise(v), "medium": mask_value(k, v, T.StringType()), "high": F.lit("[PERSONAL_DATA]")}[level]
        return F.when(personal_field(k, v), masked).otherwise(v)

    # two passes, so that a mask, which looks at its value many times, has the redacted value at hand
    redacted = F.transform_values(m, lambda k, v: F.when(sensitive_field(k, v), F.lit("[REDACTED]")).otherwise(v))
    return F.transform_values(redacted if sensitive is None else F.when(sensitive, redacted).otherwise(m), personal)


def redact_keys(text: Column | str, keys: tuple[str, ...] = REDACTED_KEYS) -> Column:
    """A JSON object with the values of `keys` redacted, in nested objects and lists of objects too. Other texts stay."""
    wanted = frozenset(keys)

    def walk(x):
        if isinstance(x, dict):
            return {k: "[REDACTED]" if k.lower() in wanted else walk(v) for k, v in x.items()}
        if isinstance(x, list) and x and all(isinstance(v, dict) for v in x):
            return [walk(v) for v in x]
        return x

    def one(text: str | None) -> str | None:
        try:
            found = json.loads(text) if text else None
        except ValueError:
            return text
        return json.dumps(walk(found), ensure_ascii=False, separators=(",", ":")) if isinstance(found, dict) else text

    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return redacted(_col(text))


def scrub_message(message: Column | str) -> Column:
    """An error message without paths, JSON, addresses and numbers; one that holds a sensitive word is withheld."""
    m = _col(message)
    out = F.regexp_replace(m, r"(?:/[\w\-. ]+)+/([\w\-. ]+)", "[PATH]/$1")
    found = F.regexp_extract(out, r"(?s)\{.*\}", 0)
    fields = F.length(found) - F.length(F.replace(found, F.lit(":"), F.lit("")))
    out = F.regexp_replace(out, F.lit(r"(?s)\{.*\}"), F.concat(F.lit("[JSON_CONTENT:"), fields.cast("string"), F.lit("_fields]")))
    out = reduce(lambda c, u: F.regexp_replace(c, u, "[URL_REDACTED]"), URLS.split("|"), out)
    out = reduce(lambda c, x: F.regexp_replace(c, *x), REWRITES, out)
    low = F.lower(m)
    withheld = reduce(lambda a, w: a | low.contains(w), MESSAGE_WORDS[1:], low.contains(MESSAGE_WORDS[0]))
    return F.when(F.coalesce(m, F.lit("")) == "", "Error details not available").when(withheld, "Error details redacted for security").otherwise(out)


def sensitive_error(message: Column | str) -> Column:
    """Whether a message may hold sensitive data."""
    m = F.coalesce(_col(message), F.lit(""))
    low = F.lower(m)
    return reduce(lambda a, w: a | low.contains(w), MESSAGE_WORDS, F.lit(False)) | m.rlike("(?i)" + "|".join([MESSAGE_EMAIL, *SENSITIVE_ERRORS]))


def scrub_filename(name: Column | str) -> Column:
    """A file name whose base is replaced by a digest if it may name a person, and shortened if it is long."""
    n = _col(name)
    ext = F.regexp_extract(n, r"[^./][^/]*(\.[^./]*)$", 1)
    base = F.substr(n, F.lit(1), F.length(n) - F.length(ext))
    told = base.rlike("(?i)" + "|".join(FILE_NAMES))
    short = F.concat(F.substring(base, 1, 6), F.lit("..."), F.substring(base, -6, 6), ext)
    return F.when(F.coalesce(n, F.lit("")) == "", "unnamed_file").when(told, F.concat(F.lit("redacted_"), F.substring(F.md5(base.cast("binary")), 1, 8), ext)).when(F.length(base) > 20, short).otherwise(n)


def scrub_url(url: Column | str) -> Column:
    """A URL without user information, and with the values of sensitive parameters redacted. Parameters without a value go."""
    u = _col(url)
    part = lambda k: F.regexp_extract(u, r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?(#.*)?$", k)
    encode = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    plain = lambda c: F.try_url_decode(c)
    pairs = F.filter(F.transform(F.split(part(4), "&"), lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("k"), plain(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", ""))).alias("v"))), lambda p: F.coalesce(p["v"], F.lit("")) != "")
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    kept = F.flatten(F.transform(names, lambda n: F.when(F.lower(n).rlike("|".join(QUERY_NAMES)), F.array(F.concat(encode(n), F.lit("=%5BREDACTED%5D")))).otherwise(F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: F.concat(encode(n), F.lit("="), encode(p["v"]))))))
    query = F.array_join(kept, "&")
    scheme = F.when(part(1) != "", F.concat(F.lower(part(1)), F.lit(":"))).otherwise("")
    host = F.when(part(2) != "", F.concat(F.lit("//"), F.regexp_replace(F.substring(part(2), 3, 1 << 20), "^.*@", ""))).otherwise("")
    return F.when(F.coalesce(u, F.lit("")) == "", "unknown_url").otherwise(F.concat(scheme, host, part(3), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), part(5)))
