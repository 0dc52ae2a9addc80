"""Bans of addresses and networks."""

import ipaddress

from inkveil.operators import tables


def test_banned(spark):
    rows = [(i, f"10.{i % 3}.{i % 5}.{i}") for i in range(60)] + [(7, "10.1.2.7")] * 2 + [(99, None), (98, "fe80::1"), (97, "")]
    nets = ["10.1.0.0/16", "10.2.3.0/24", "10.0.0.0", "fe80::1", "10.0.4.8/30", "10.1.2.7", "x/40", None]
    got = sorted(((r.n, r.ip) for r in tables.banned(spark.createDataFrame(rows, "n int, ip string"), spark.createDataFrame([(n,) for n in nets], "network string")).collect()))

    def held(ip):
        return any(ip == n or "/" in (n or "") and n[0] != "x" and ip[:2] == "10" and ipaddress.ip_address(ip) in ipaddress.ip_network(n, strict=False) for n in nets)

    assert got == sorted((n, ip) for n, ip in rows if ip and held(ip)) and got.count((7, "10.1.2.7")) == 3
