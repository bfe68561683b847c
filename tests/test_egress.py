"""Egress entries and lookups against Python's own addresses."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from runwarden.operators import egress

GOOD = ["10.96.0.0/12", "10.96.0.10/32:53", "127.0.0.1:8080", "*:443", "[::1]:8080", "fd00::/8", "2001:db8::/32", "10.1.2.3/8", "::ffff:10.0.0.1", "[2001:DB8::]:53", " 192.0.2.1 ", "1:2:3:4:5:6:7:8", "::", "[fe80::1]", "*", "1::/0", "0.0.0.0/0:81"]
BAD = ["", "  ", None, "10.0.0.0/33", "10.0.0.300/24", "host.example:443", "7", "[::1", "[::1]:", "[::1]x", "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::", "::g", "10.0.0.1:70000", "10.0.0.1:-1", "fd00::/129", "10.0.0.0/", "10.0.0.0/8/8", "1.2.3", "[]:80", "[*]:80", "1:2:3:4:5:6:7", "::1.2.3.400", "01.2.3.4", ":::", "1:::2", ":1:2:3:4:5:6:7"]


def net(entry):
    e = entry.strip()
    port = None
    if e.startswith("["):
        e, _, rest = e[1:].partition("]")
        port = int(rest[1:]) if rest else None
    elif e.count(":") == 1:
        e, p = e.split(":")
        port = int(p)
    return (None if e == "*" else ipaddress.ip_network(e, strict=False)), port


def plainly(entries, a, p):
    try:
        ip = ipaddress.ip_address(a) if a else None
    except ValueError:
        ip = None
    return any((port is None or port == p) and (n is None or (ip is not None and ip.version == n.version and ip in n)) for n, port in map(net, entries))


def test_entries(spark):
    rows = egress.parsed(spark.createDataFrame([(e,) for e in GOOD + BAD], "entry string")).collect()
    for r in rows[: len(GOOD)]:
        n, port = net(r.entry)
        assert not r.refused and r.port == port, r
        assert (r.version, len(r.prefix)) == ((0, 0) if n is None else (n.version, n.prefixlen)), r
        if n is not None and n.prefixlen:
            assert int(r.prefix, 2) == int(n.network_address) >> (n.max_prefixlen - n.prefixlen)
    for r in rows[len(GOOD) :]:
        assert r.refused and (r.version, r.prefix, r.port) == (None, None, None), r
    with pytest.raises(ValueError, match="300"):
        egress.rules_of(spark.createDataFrame([("10.0.0.300/24",)], "entry string"))
    assert egress.rules_of(spark.createDataFrame([("10.0.0.300/24",)], "entry string"), strict=False).collect() == []


def test_lookups(spark):
    rng = random.Random(1)
    for lists in ([g for g in GOOD if g not in ("*", "0.0.0.0/0:81")], ["10.0.0.0/8", "10.1.0.0/16", "10.1.0.0/16:53", "fd00::/8", "[fd00::/9]:5", "*:443", "10.9.9.9:443"], ["*"], ["10.0.0.0/16"], []):
        asked = [(a, p) for a in ("10.96.0.10", "10.112.0.1", "127.0.0.1", "::1", "fd12::1", "10.0.0.1", "not-an-ip", None, "10.1.200.3", "2001:db8::1", "0:0:0:0:0:FFFF:10.0.0.1", "1:2:3:4:5:6:7:8", "9.9.9.9", "") for p in (53, 80, 443, 5, 8080, None)]
        asked += [(str(ipaddress.ip_address(rng.getrandbits(32))), 80) for _ in range(20)]
        rules = egress.rules_of(spark.createDataFrame([(e,) for e in lists], "entry string"))
        got = egress.allowed(spark.createDataFrame([(i, *x) for i, x in enumerate(asked)], "i long, daddr string, dport int"), rules).collect()
        assert len(got) == len(asked)
        for r in got:
            assert r.allowed == plainly(lists, r.daddr, r.dport), (lists, r)


def test_rules_are_disjoint(spark):
    entries = ["10.0.0.0/8", "10.1.0.0/16", "10.1.0.0/16:53", "11.0.0.0/8:53", "11.1.0.0/16:53", "11.1.0.0/16", "*:22", "1.1.1.1:22", "2.2.2.2"]
    got = egress.rules_of(spark.createDataFrame([(e,) for e in entries], "entry string")).select("version", F.length("prefix").alias("n"), "port").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(4, 8, None), (4, 8, 53), (4, 16, None), (0, 0, 22), (4, 32, None)], key=str)
    asked = spark.createDataFrame([], "i long, daddr string, dport int")
    assert egress.allowed(asked, egress.rules_of(spark.createDataFrame([], "entry string"))).collect() == []
