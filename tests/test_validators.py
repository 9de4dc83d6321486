"""V2-V8 column functions against plain Python."""

import datetime as dt
import ipaddress
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlens.functions import columns as C
from flowlens.functions.columns import IPV4_RE, IPV6_RE, full


def _py_ip(s):
    if "%" in s:
        return False
    try:
        ipaddress.ip_address(s)
        return True
    except ValueError:
        return False


_PAT = re.compile(full(f"({IPV4_RE})|({IPV6_RE})").replace(r"\z", r"\Z"))


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet="0123456789abcdefABCDEF:.", min_size=0, max_size=24))
def test_ip_pattern_matches_stdlib(s):
    assert bool(_PAT.match(s)) == _py_ip(s)


@settings(max_examples=500, deadline=None)
@given(st.integers(min_value=0, max_value=2**128 - 1))
def test_ipv6_forms(n):
    a = ipaddress.IPv6Address(n)
    assert _PAT.match(str(a)) and _PAT.match(a.exploded)


def test_validators_in_spark(spark):
    vals = ["10.20.1.1", "010.1.1.1", "256.0.0.1", "::1", "fe80::1%eth0", "fe80::1%' OR '1'='1",
            "2001:db8::1.2.3.4", "db.corp.internal", "", "1:2:3:4:5:6:7:8:9"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = {r["v"]: r["ok"] for r in df.select("v", C.is_ip(F.col("v")).alias("ok")).collect()}
    assert got == {v: _py_ip(v) for v in vals}
    hosts = ["db.corp.internal", "-rf", "a b", "x" * 253, "x" * 254, "db;rm -rf /", "10.0.0.1", "abc\n"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = {r["h"]: r["ok"] for r in df.select("h", C.is_host(F.col("h")).alias("ok")).collect()}
    assert got == {"db.corp.internal": True, "-rf": False, "a b": False, "x" * 253: True,
                   "x" * 254: False, "db;rm -rf /": False, "10.0.0.1": True, "abc\n": False}


def test_parse_epoch(spark):
    cases = {
        "1704067200": 1704067200,
        " 1704067200 ": 1704067200,
        "2024-01-01T00:00:00Z": 1704067200,
        "2024-01-01T02:00:00+02:00": 1704067200,
        "2024-01-01T00:00:00": 1704067200,        # no zone = UTC
        "2024-01-01 00:00:30.5": 1704067230,
        "2024-01-01": 1704067200,
        "20240101": 20240101,                      # D14: all digits = epoch
        "2026-W27-3": None,                        # D14: week dates refused
        "yesterday": None,
        "": None,
        "2024-13-01T00:00:00Z": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: r["e"] for r in df.select("s", C.parse_epoch(F.col("s")).alias("e")).collect()}
    assert got == cases
    for k, v in cases.items():  # agrees with the standard library where both accept the text
        if v is not None and not k.strip().isdigit():
            iso = k.strip().replace("Z", "+00:00")
            d = dt.datetime.fromisoformat(iso)
            d = d if d.tzinfo else d.replace(tzinfo=dt.timezone.utc)
            assert int(d.timestamp()) == v


def test_iso_and_days(spark):
    df = spark.createDataFrame([(1704153599, 1704240000)], "lo long, hi long")
    r = df.select(C.iso(F.col("lo")).alias("a"), C.days_between(F.col("lo"), F.col("hi")).alias("d")).first()
    assert r["a"] == "2024-01-01T23:59:59Z"
    assert r["d"] == ["2024/01/01", "2024/01/02", "2024/01/03"]


def test_finding_id_matches_hashlib(spark):
    import hashlib

    def py(*parts):
        return "net-" + hashlib.sha1("|".join(str(p) for p in parts).encode()).hexdigest()[:6]

    df = spark.createDataFrame([("h", None, 25.0, 3)], "h string, n string, loss double, recv int")
    r = df.select(C.finding_id(F.lit("ping"), F.col("h"), F.col("recv"), F.col("loss")).alias("a"),
                  C.finding_id(F.lit("dns"), F.col("h"), F.col("n"), F.col("n")).alias("b")).first()
    assert r["a"] == py("ping", "h", 3, 25.0)
    assert r["b"] == py("dns", "h", None, None)


def test_boundary_class(spark):
    vals = {"10.20.3.4": "IN_VPC", "10.1.2.3": "PRIVATE_OTHER", "172.31.0.1": "PRIVATE_OTHER",
            "172.32.0.1": "PUBLIC", "192.168.9.9": "PRIVATE_OTHER", "203.0.113.5": "PUBLIC",
            "::1": "UNKNOWN", "db": "UNKNOWN"}
    df = spark.createDataFrame([(k,) for k in vals] + [(None,)], "a string")
    got = {r["a"]: r["c"] for r in df.select("a", C.boundary_class(F.col("a")).alias("c")).collect()}
    assert got == {**vals, None: "UNKNOWN"}


def test_canonical_ip_matches_stdlib(spark):
    import random
    rnd = random.Random(5)
    vals = ["::ffff:1.2.3.4", "::1.2.3.4", "2001:DB8:0:0:1:0:0:1", "2001:db8::0:1", "0:0:0:0:0:0:0:0",
            "1:0:0:2:0:0:0:3", "fe80:0000::0001", "::ffff:0:0", "64:ff9b::1.2.3.4", "1:0:2:0:3:0:4:0",
            "::ffff:1:2", "::", "::1", "1::", "10.20.1.1", "db.corp.internal"]
    for _ in range(400):
        groups = [rnd.choice([0, 0, 0, 1, 0xffff, rnd.getrandbits(16)]) for _ in range(8)]
        a = ipaddress.IPv6Address(b"".join(g.to_bytes(2, "big") for g in groups))
        vals += [a.exploded.upper(), str(a)]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = {r["v"]: r["c"] for r in df.select("v", C.canonical_ip(F.col("v")).alias("c")).collect()}
    for v in vals:
        exp = str(ipaddress.ip_address(v)) if _py_ip(v) else v
        assert got[v] == exp, (v, got[v], exp)
