"""How long a DNS answer holds, and traffic to addresses that have left it (M4, J2 in time).

Each capture of a host is an answer: the set of its addresses (empty unless NOERROR). For every (host, address) ever answered the
host's captures in time order say whether the address is in; equal neighbours are one version. A version with the address is VALID from
its first capture to the next version or to its last capture plus that answer's time to live, whichever comes first, and
EXPIRED from there to the next version; a version without it, after one with it, is LEFT. The versions of an (host, address) never
overlap, so a flow meets one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions import columns as C
from flowlens.operators import probes as PB
from flowlens.session import materialise

HOUR_S = 3600


def answers(probes: DataFrame) -> DataFrame:
    """(host, probed_at, probe_id, addresses: array of (ip, ttl)) of every DNS capture."""
    d = PB.parse_dns(probes.filter(F.col("tool") == "resolve_dns"))
    address = F.transform(F.filter("records", lambda r: C.is_ip(r["value"])), lambda r: F.struct(r["value"].alias("ip"), r["ttl"].cast("bigint").alias("ttl")))
    none = F.array().cast("array<struct<ip:string,ttl:bigint>>")
    return d.select("host", "probed_at", "probe_id", F.when(F.col("dns_status") == "NOERROR", address).otherwise(none).alias("addresses"))


def versions(probes: DataFrame) -> DataFrame:
    """(host, ip, state, since, until) with ``until`` exclusive, NULL for a version that still holds."""
    a = materialise(answers(probes), "dns-answers")
    ever = a.select("host", F.explode("addresses").alias("r")).select("host", "r.ip").distinct()
    # one row per capture and address that its host ever answered: the addresses of a host are few
    rows = a.join(ever, "host").select(
        "host", "ip", "probed_at", "probe_id",
        F.array_max(F.transform(F.filter("addresses", lambda r: r["ip"] == F.col("ip")), lambda r: r["ttl"])).alias("ttl"))
    rows = rows.withColumn("present", F.col("ttl").isNotNull())
    w = Window.partitionBy("host", "ip").orderBy("probed_at", "probe_id")
    rows = rows.withColumn("new", F.when(F.lag("present").over(w) == F.col("present"), 0).otherwise(1))
    rows = rows.withColumn("version", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    v = rows.groupBy("host", "ip", "version").agg(
        F.max("present").alias("present"), F.min("probed_at").alias("since"), F.max(F.col("probed_at") + F.col("ttl")).alias("dies"))
    v = v.withColumn("next", F.lead("since").over(Window.partitionBy("host", "ip").orderBy("version")))
    # an address is in the first version of its own that is not empty; a version without it before that is no departure
    v = v.filter(F.col("present") | (F.col("version") > 1))
    valid = v.filter("present").select("host", "ip", F.lit("VALID").alias("state"), "since",
                                       F.least(F.coalesce("next", "dies"), "dies").alias("until"))
    expired = v.filter("present and (next is null or next > dies)").select(
        "host", "ip", F.lit("EXPIRED").alias("state"), F.col("dies").alias("since"), F.col("next").alias("until"))
    left = v.filter("not present").select("host", "ip", F.lit("LEFT").alias("state"), "since", F.col("next").alias("until"))
    return valid.unionByName(expired).unionByName(left).filter("until is null or until > since")


def stale_address_flows(flows: DataFrame, probes: DataFrame) -> DataFrame:
    """(host, ip, state, since, until, flows, rejects, first_flow, last_flow): versions that are not VALID but saw traffic."""
    v = materialise(versions(probes).filter("state <> 'VALID'"), "dns-versions")
    asked = v.select(F.col("ip").alias("dstaddr")).distinct()
    per_second = (flows.join(asked, "dstaddr", "left_semi").groupBy("dstaddr", F.col("start").alias("second"))
                  .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("action") == "REJECT", 1)).alias("rej")))
    seconds = materialise(per_second, "address-seconds")
    span = seconds.agg(F.max("second").alias("hi")).first()["hi"]
    if span is None:
        return v.select("host", "ip", "state", "since", "until", *[F.lit(None).cast("bigint").alias(c) for c in (
            "flows", "rejects", "first_flow", "last_flow")]).limit(0)
    # versions are cut at hours up to the last flow, so the join is an equality on (address, hour) and a hot address spreads over its hours
    end = F.least(F.coalesce(F.col("until") - 1, F.lit(span)), F.lit(span))
    hours = v.filter(F.col("since") <= end).select("*", F.explode(F.sequence(F.floor(F.col("since") / HOUR_S), F.floor(end / HOUR_S))).alias("hour"))
    s = seconds.withColumn("hour", F.floor(F.col("second") / HOUR_S))
    hit = hours.join(s, (hours["ip"] == s["dstaddr"]) & (hours["hour"] == s["hour"]) & (s["second"] >= hours["since"])
                     & (hours["until"].isNull() | (s["second"] < hours["until"])))
    return hit.groupBy("host", "ip", "state", "since", "until").agg(
        F.sum("n").alias("flows"), F.sum("rej").alias("rejects"), F.min("second").alias("first_flow"), F.max("second").alias("last_flow"))
