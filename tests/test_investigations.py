"""Return path, prefixes, change points, incidents and answer versions: hand-made cases and brute force."""

import ipaddress
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowlens.functions import columns as C
from flowlens.operators import answers as AN
from flowlens.operators import changepoint as CP
from flowlens.operators import incidents as IC
from flowlens.operators import paths as PA
from flowlens.operators import prefixes as PX
from flowlens.operators import stitch as ST
from flowlens.operators.intervals import components, islands
from flowlens.plans.registry import QUERIES
from flowlens.sources import inputs as IN
from tests.conftest import SF_MID, SF_SMALL, rows
from tests.helpers import T0, flow, flows_df, probes_df


# ---------------------------------------------------------------- intervals
def brute_islands(items, gap):
    out = {}
    for key, lo, hi, n in sorted(items):
        runs = out.setdefault(key, [])
        if runs and lo <= runs[-1][1] + gap:
            runs[-1] = (runs[-1][0], max(runs[-1][1], hi), runs[-1][2] + n)
        else:
            runs.append((lo, hi, n))
    return sorted((k, *r) for k, rs in out.items() for r in rs)


@pytest.mark.parametrize("gap, chunk_s", [(0, 50), (5, 7), (30, 1000)])
def test_islands_against_brute_force(spark, gap, chunk_s):
    rng = random.Random(gap)
    items = []
    for _ in range(900):
        lo = rng.randrange(0, 4000)
        items.append((rng.choice("aaab"), lo, lo + rng.choice([0, 1, 9, 200 if rng.random() < 0.05 else 3]), rng.randint(1, 3)))
    df = spark.createDataFrame(items, "k string, lo long, hi long, n long")
    assert rows(islands(df, ["k"], "lo", "hi", gap, ("n",), chunk_s), "k", "lo", "hi", "n") == brute_islands(items, gap)


def test_components_against_union_find(spark):
    rng = random.Random(3)
    nodes = [f"n{k:03d}" for k in range(300)]
    order = rng.sample(nodes, 120)
    links = list(zip(order, order[1:])) + [(rng.choice(nodes), rng.choice(nodes)) for _ in range(80)]
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    want = sorted((n, min(m for m in nodes if find(m) == find(n))) for n in {x for link in links for x in link})
    assert rows(components(spark.createDataFrame(links, "a string, b string")), "node", "root") == want
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


# ---------------------------------------------------------------- return path
def both(client, server, port, sport, at, answer, forward="ACCEPT"):
    out = [flow(client, server, port, forward, at, sport=sport)]
    if answer:
        out.append(flow(server, client, sport, answer, at + 1, sport=port))
    return out


def labels(spark, items, **kw):
    return {(r["client"], r["client_port"], r["started"]): r for r in ST.return_path(flows_df(spark, items), **kw).collect()}


def test_only_the_reply_is_rejected(spark):
    items = both("10.0.0.1", "10.1.0.1", 443, 40000, T0, "REJECT") + both("10.0.0.2", "10.1.0.1", 443, 40001, T0, "ACCEPT")
    items += both("10.0.0.3", "10.1.0.1", 443, 40002, T0, None) + both("10.0.0.4", "10.1.0.1", 443, 40003, T0, None, "REJECT")
    items += [flow(None, "10.1.0.1", 443, "ACCEPT", T0), flow("10.0.0.5", "10.1.0.1", 443, None, T0)]
    found = {k[0]: r["label"] for k, r in labels(spark, items).items()}
    assert found == {"10.0.0.1": "RETURN_BLOCKED", "10.0.0.2": "BOTH", "10.0.0.3": "ONE_WAY", "10.0.0.4": "FORWARD_BLOCKED"}


def test_a_session_has_one_partner_and_a_reply_one_owner(spark):
    c, s = "10.0.0.1", "10.1.0.1"
    items = [flow(c, s, 443, "ACCEPT", T0, sport=50000), flow(c, s, 443, "ACCEPT", T0 + 100, sport=50000),  # one session: the gap is 40 s
             flow(s, c, 50000, "ACCEPT", T0 - 3, sport=443),  # begins within the slack before it
             flow(s, c, 50000, "REJECT", T0 + 290, sport=443),  # a second reply session, not the partner
             flow(c, s, 443, "ACCEPT", T0 + 600, sport=50000),  # a session whose reply came long after
             flow(s, c, 50000, "ACCEPT", T0 + 900, sport=443)]
    r = labels(spark, items)
    assert {k[2]: (v["label"], v["accepts"], v["reply_started"]) for k, v in r.items()} == {
        T0: ("BOTH", 2, T0 - 3), T0 + 600: ("ONE_WAY", 1, None)}


def test_every_label_occurs_and_the_hot_connection_is_reduced_first(spark):
    found = QUERIES["return_path"](spark, SF_MID)
    assert {r["label"] for r in found.select("label").distinct().collect()} == {"BOTH", "ONE_WAY", "RETURN_BLOCKED", "FORWARD_BLOCKED"}
    hot = flows_df(spark, [flow("10.0.0.1", "10.1.0.1", 443, "ACCEPT", T0 + k % 500, sport=50000) for k in range(4000)])
    (one,) = ST.return_path(hot).collect()
    assert (one["started"], one["ended"], one["accepts"], one["label"]) == (T0, T0 + 559, 4000, "ONE_WAY")


# ---------------------------------------------------------------- prefixes
def test_bits_of_addresses(spark):
    rng = random.Random(8)
    texts = ["::", "::1", "1::", "fe80::1:2", "::ffff:1.2.3.4", "1:2:3:4:5:6:7.8.9.10", "0.0.0.0", "255.255.255.255", "2001:DB8::A"]
    texts += [str(ipaddress.ip_address(rng.getrandbits(128) & rng.getrandbits(128))) for _ in range(60)]
    texts += [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts + ["x", "", "1.2.3", "fe80::1%eth0", None]], "a string")
    got = {r["a"]: r["b"] for r in df.select("a", C.ip_bits(F.col("a")).alias("b")).collect()}
    for t in texts:
        v = ipaddress.ip_address(t)
        assert got[t] == format(int(v) if v.version == 6 else (0xFFFF << 32) + int(v), "0128b")
    assert all(got[t] is None for t in ["x", "", "1.2.3", "fe80::1%eth0", None])


def test_longest_prefix_against_the_ipaddress_module(spark, monkeypatch):
    rng = random.Random(9)
    nets = {str(ipaddress.ip_network((rng.getrandbits(32) & 0x0F0F00FF | 0x0A000000, n), strict=False)) for n in (0, 4, 8, 12, 16, 24, 30, 32) for _ in range(6)}
    nets |= {str(ipaddress.ip_network((0x20010DB8 << 96 | rng.getrandbits(20) << 76, n), strict=False)) for n in (0, 16, 32, 48, 52, 64, 128) for _ in range(4)}
    table = [(n, f"L{k}") for k, n in enumerate(sorted(nets))]
    addrs = [str(ipaddress.IPv4Address(rng.getrandbits(32) & 0x0F0F00FF | 0x0A000000)) for _ in range(150)] + [n.split("/")[0] for n in nets]
    addrs += [str(ipaddress.IPv6Address(0x20010DB8 << 96 | rng.getrandbits(20) << 76 | rng.getrandbits(3))) for _ in range(100)]
    parsed = [(ipaddress.ip_network(n), label) for n, label in table]
    want = {}
    for a in set(addrs):
        v = ipaddress.ip_address(a)
        # IPv4 lies in the mapped range, so a prefix of IPv6 that holds that range holds it too
        m = ipaddress.ip_address((0xFFFF << 32) + int(v)) if v.version == 4 else v
        hits = [(n.prefixlen + (96 if n.version == 4 else 0), label) for n, label in parsed if (v in n if v.version == n.version else n.version == 6 and m in n)]
        want[a] = max(hits)[1] if hits else "NONE"
    df, p = spark.createDataFrame([(a,) for a in addrs] + [(None,), ("host",)], "addr string"), spark.createDataFrame(table, "prefix string, label string")
    for limit in (PX.MAX_BROADCAST_BYTES, 0):
        monkeypatch.setattr(PX, "MAX_BROADCAST_BYTES", limit)
        got = {r["addr"]: r["label"] for r in PX.longest_prefix(df, p, "NONE").collect()}
        assert got == {**want, None: "UNKNOWN", "host": "UNKNOWN"}


def test_prefixes_that_cannot_be_read(spark):
    p = spark.createDataFrame([("10.0.0.0/8", "a"), ("10.0.0.0/8", "b"), ("10.0.0.9/8", "0"), ("10.0.0.0/33", "x"), ("10.0.0.0/-1", "x"), ("10.0.0.0/8/9", "x"),
                               ("y", "x"), (None, "x"), ("::/129", "x"), ("10.1.0.0/16", None)], "prefix string, label string")
    assert [(r["length"], r["label"]) for r in PX.prefix_table(p).collect()] == [(104, "0")]
    assert PX.bad_prefixes(p).count() == 7
    none = p.limit(0)
    df = spark.createDataFrame([("10.0.0.1",), ("::1",)], "addr string")
    assert {r["addr"]: r["label"] for r in PX.longest_prefix(df, none, "PUBLIC").collect()} == {"10.0.0.1": "PUBLIC", "::1": "PUBLIC"}


# ---------------------------------------------------------------- change points
def cause(spark, items, **kw):
    df = spark.createDataFrame([(q, p, port, a, T0 + t) for q, p, port, a, t in items], "request_id long, peer string, dstport int, action string, start long")
    return {r["request_id"]: r for r in CP.intermittent_cause(df, **kw).collect()}


def test_each_explanation(spark):
    items = [(1, "p", 80, "ACCEPT" if t < 50 else "REJECT", t) for t in range(100)]
    items += [(2, "p", 80, "REJECT" if t < 30 else "ACCEPT", t) for t in range(100)]
    items += [(3, f"p{t % 4}", 80, "REJECT" if t % 4 == 1 else "ACCEPT", t) for t in range(100)]
    items += [(4, "p", 80 + t % 2, "REJECT" if t % 2 else "ACCEPT", t) for t in range(100)]
    items += [(5, "p", 80, random.Random(t).choice(["REJECT", "ACCEPT"]), t) for t in range(100)]
    items += [(6, "p", 80, a, 7) for a in ("ACCEPT", "REJECT", "REJECT", "OTHER", None)]
    items += [(7, "p", 80, "ACCEPT", t) for t in range(9)]
    for chunk_s in (7, 600, 10**6):
        got = cause(spark, items, chunk_s=chunk_s)
        assert {q: r["label"] for q, r in got.items()} == {1: "TIME", 2: "TIME", 3: "PEER", 4: "PORT", 5: "MIXED", 6: "MIXED"}
        assert (got[1]["split_second"], got[1]["turn"], got[1]["wrong"]) == (T0 + 50, "BLOCKED_FROM", 0)
        assert (got[2]["split_second"], got[2]["turn"]) == (T0 + 30, "OPENED_FROM")
        assert (got[6]["split_second"], got[6]["time_wrong"]) == (None, 1)


def test_every_cause_occurs(spark):
    seen = {r["label"] for r in QUERIES["intermittent_cause"](spark, SF_MID).select("label").distinct().collect()}
    assert {"TIME", "PEER", "MIXED"} <= seen


# ---------------------------------------------------------------- incidents
def test_chains_over_chunk_borders_are_one_incident(spark):
    e = [("a", 80, 1, 0, 50), ("a", 443, 1, 50, 120), ("b", 443, 1, 110, 130), ("c", 22, 1, 0, 500), ("b", 443, 2, 131, 140), ("d", 22, 1, 500, 510),
         ("a", 80, 2, 51, 52), ("z", 80, 1, 0, 10_000), ("z", 443, 1, 60, 61)]
    df = spark.createDataFrame([(*x, 2) for x in e], "dstaddr string, dstport int, episode long, started long, stopped long, n_flows long")
    for chunk_s in (13, 100, 100_000):
        got = rows(IC.incidents(df, 5000, chunk_s), "first_episode", "started", "stopped", "episodes", "addresses", "ports", "rejects", "standing")
        # a:80:2 shares address a with the second episode; z:443 shares its port with it; b:443:2 begins after all have ended
        assert got == [("a|443|1", 0, 130, 5, 3, 2, 10, False), ("b|443|2", 131, 140, 1, 1, 1, 2, False), ("c|22|1", 0, 510, 2, 2, 1, 4, False),
                       ("z|80|1", 0, 10_000, 1, 1, 1, 2, True)]


# ---------------------------------------------------------------- answers
def dig(status, *answers):
    return f";; ->>HEADER<<- opcode: QUERY, status: {status}, id: 1\n" + "".join(f"h. {ttl} IN A {ip}\n" for ip, ttl in answers)


def test_versions_of_an_answer(spark):
    caps = [(1, T0, "resolve_dns", "h", None, dig("NOERROR", ("10.1.0.1", 60))), (2, T0 + 50, "resolve_dns", "h", None, dig("NOERROR", ("10.1.0.1", 60))),
            (3, T0 + 200, "resolve_dns", "h", None, dig("NOERROR", ("10.1.0.2", 900))), (4, T0 + 400, "resolve_dns", "h", None, dig("SERVFAIL")),
            (5, T0 + 500, "resolve_dns", "h", None, dig("NOERROR", ("10.1.0.1", 60), ("10.1.0.2", 60)))]
    probes = probes_df(spark, caps)
    got = [(ip, s, a - T0, b and b - T0) for ip, s, a, b in rows(AN.versions(probes), "ip", "state", "since", "until")]
    assert sorted(got, key=repr) == sorted([
        ("10.1.0.1", "VALID", 0, 110), ("10.1.0.1", "EXPIRED", 110, 200), ("10.1.0.1", "LEFT", 200, 500), ("10.1.0.1", "VALID", 500, 560),
        ("10.1.0.1", "EXPIRED", 560, None), ("10.1.0.2", "VALID", 200, 400), ("10.1.0.2", "LEFT", 400, 500), ("10.1.0.2", "VALID", 500, 560),
        ("10.1.0.2", "EXPIRED", 560, None)], key=repr)
    f = flows_df(spark, [flow("10.0.0.1", "10.1.0.1", 80, a, T0 + t) for t, a in ((10, "ACCEPT"), (110, "REJECT"), (199, "ACCEPT"), (200, "REJECT"), (499, "REJECT"), (500, "ACCEPT"), (9000, "ACCEPT"))])
    stale = AN.stale_address_flows(f, probes)
    assert sorted((r["state"], r["since"] - T0, r["flows"], r["rejects"], r["first_flow"] - T0, r["last_flow"] - T0) for r in stale.collect()) == [
        ("EXPIRED", 110, 2, 1, 110, 199), ("EXPIRED", 560, 1, 0, 9000, 9000), ("LEFT", 200, 2, 2, 200, 499)]
    assert AN.stale_address_flows(f.limit(0), probes).count() == 0 and AN.stale_address_flows(f, probes.limit(0)).count() == 0


def test_states_of_the_fixture(spark):
    assert set(Counter(r["state"] for r in QUERIES["stale_address_flows"](spark, SF_MID).collect())) == {"EXPIRED", "LEFT"}


# ---------------------------------------------------------------- failing segments
def hops_of(raw):
    out = []
    for line in raw.split("\n")[1:]:
        rest = line.split(None, 1)[1] if len(line.split(None, 1)) > 1 else "*"
        out.append(None if rest.startswith("*") else rest.split()[0])
    return out


def brute_cover(caps, window_s=3600):
    """Suspected links by hand, and greedy set cover one link after another."""
    known, proven, failed = {}, set(), []
    for pid, at, host, raw in caps:
        hops = hops_of(raw)
        path, w = ["start"] + [h for h in hops if h], at // window_s * window_s
        proven |= {(w, a, b) for a, b in zip(path, path[1:])}
        if hops and hops[-1]:
            known.setdefault(host, set()).add(tuple(path))
        else:
            failed.append((w, pid, host, path[-1]))
    sets = {}
    for w, pid, host, last in failed:
        for path in known.get(host, ()):
            if last in path:
                rest = path[path.index(last):]
                for link in zip(rest, rest[1:]):
                    if (w, *link) not in proven:
                        sets.setdefault(w, {}).setdefault(link, set()).add(pid)
    out = []
    for w, links in sets.items():
        links = {k: set(v) for k, v in links.items()}
        while any(links.values()):
            best = min(links, key=lambda k: (-len(links[k]), k))
            done = set(links[best])
            out.append((w, *best, len(done)))
            for v in links.values():
                v -= done
    return sorted(out)


def test_failing_segments_against_brute_force(spark):
    got = rows(PA.greedy_cover(PA.suspects(IN.traces(spark, SF_SMALL))), "window", "from", "to", "explains")
    caps = [(r["probe_id"], r["probed_at"], r["host"], r["raw"]) for r in IN.traces(spark, SF_SMALL).collect()]
    assert got == brute_cover(caps) and got
    rng, caps = random.Random(6), []
    routers = [[f"10.{k}.{n}.1" for n in range(3)] for k in range(4)]
    for pid in range(500):
        host = rng.randrange(12)
        path = [routers[k][(host >> k) % 3 if rng.random() < 0.9 else rng.randrange(3)] for k in range(4)] + [f"10.9.9.{host}"]
        stop = rng.choice([5, 5, 0, 1, 2, 3, 4])
        lines = [f" {n}  {ip}  1.0 ms" if n <= stop and rng.random() < 0.9 or n == stop else f" {n}  *" for n, ip in enumerate(path, 1)]
        caps.append((pid, T0 + rng.randrange(0, 40_000), f"h{host}", "traceroute to x\n" + "\n".join(lines)))
    df = probes_df(spark, [(p, at, "traceroute_host", h, None, raw) for p, at, h, raw in caps])
    assert rows(PA.failing_segment(df), "window", "from", "to", "explains") == brute_cover(caps)
    assert PA.failing_segment(df.limit(0)).count() == 0
