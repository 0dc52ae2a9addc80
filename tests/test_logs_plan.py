from inkveil.functions import masking
from inkveil.sources import logs
from pyspark.sql import functions as F

LINES = ['{"message": "a", "fields": {"email": "anna@x.org", "n": "1"}}', '{"message": "b", "fields": {"password": "p", "email": "bo@x.org"}}', '{"message": "c", "fields": {"path": "/p"}}', "{broken", "no json", "", None]


def test_an_entry_is_parsed_once_for_all_its_sinks(spark):
    out = logs.categorised(logs.parsed(spark.createDataFrame([(x,) for x in LINES], "value string")))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    got = sorted((r["message"], r["sink"], tuple(sorted(r["fields"].items()))) for r in out.filter("message is not null").collect())
    bo = masking.mask_email(F.lit("bo@x.org"))
    assert got == [
        ("a", "personal", (("email", "anna@x.org"), ("n", "1"))),
        ("a", "standard", (("email", spark.range(1).select(masking.mask_email(F.lit("anna@x.org"))).first()[0]), ("n", "1"))),
        ("b", "sensitive", (("email", "bo@x.org"), ("password", "p"))),
        ("b", "standard", (("email", spark.range(1).select(bo).first()[0]), ("password", "[REDACTED]"))),
        ("c", "standard", (("path", "/p"),)),
    ]
    assert out.filter("message is null").count() == 1  # an object that can't be read stays, as an empty entry
