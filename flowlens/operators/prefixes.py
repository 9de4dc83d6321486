"""Longest-prefix match of IPv4 and IPv6 addresses against a table of prefixes (M5 with a table instead of fixed ranges).

An address is 128 binary digits (IPv4 in its ``::ffff:`` form). For each prefix length that occurs in the table the address's first
digits are one probe, an equality join on them; the longest length that hits wins. Distinct addresses are matched, so
the probes are (addresses x lengths), 129 lengths at most, and never addresses x prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions import columns as C
from flowlens.session import materialise

MAX_BROADCAST_BYTES = 64 << 20


def prefix_table(prefixes: DataFrame) -> DataFrame:
    """(digits, length, label) of the readable rows of ``prefixes`` (prefix, label): ``address/length`` or a bare address.

    Bits behind the length are ignored. Of equal prefixes the least label holds. Rows whose prefix cannot be read are left out
    (``bad_prefixes`` has them).
    """
    p = _parsed(prefixes).filter(_readable())
    return p.groupBy(F.col("bits").substr(F.lit(1), F.col("length")).alias("digits"), "length").agg(F.min("label").alias("label"))


def bad_prefixes(prefixes: DataFrame) -> DataFrame:
    return _parsed(prefixes).filter(~F.coalesce(_readable(), F.lit(False))).select("prefix", "label")


def _parsed(prefixes: DataFrame) -> DataFrame:
    addr, given = F.substring_index("prefix", "/", 1), F.substring_index("prefix", "/", -1).try_cast("int")
    width = F.when(C.is_ipv4(addr), 32).otherwise(128)
    length = F.when(F.col("prefix").contains("/"), given).otherwise(width)
    return prefixes.select("prefix", "label", C.ip_bits(addr).alias("bits"), width.alias("width"), length.alias("given")).select(
        "*", (F.col("given") + 128 - F.col("width")).cast("int").alias("length"))


def _readable() -> Column:
    return F.col("bits").isNotNull() & F.col("label").isNotNull() & F.col("given").between(0, F.col("width")) & (
        F.length("prefix") - F.length(F.translate("prefix", "/", "")) <= 1)


def longest_prefix(addresses: DataFrame, prefixes: DataFrame, otherwise: str = "UNMATCHED") -> DataFrame:
    """(addr, family, prefix_length, label) of every distinct address of ``addresses`` (addr).

    ``prefix_length`` counts the family's own bits. An address in no prefix gets ``otherwise``; NULL and text that is no address
    get family NULL and label UNKNOWN. The table is broadcast when its size in bytes allows; beyond that both sides are joined by a shuffle.
    """
    table = materialise(prefix_table(prefixes), "prefixes")
    size = table.agg(F.sum(F.length("digits") + F.octet_length("label") + 24).alias("b"), F.collect_set("length").alias("l")).first()
    lengths = sorted(size["l"])  # 129 at most
    side = F.broadcast(table) if (size["b"] or 0) <= MAX_BROADCAST_BYTES else table
    a = materialise(addresses.select("addr").distinct().select("addr", C.ip_bits(F.col("addr")).alias("bits"),
                                                               C.is_ipv4(F.col("addr")).alias("four")), "address-bits")
    probes = a.filter(F.col("bits").isNotNull()).select("addr", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("length"), "bits").select(
        "addr", "length", F.col("bits").substr(F.lit(1), F.col("length")).alias("digits"))
    hits = probes.join(side, ["length", "digits"]).groupBy("addr").agg(F.max_by("label", "length").alias("label"), F.max("length").alias("length"))
    four = F.col("four")
    known = F.col("bits").isNotNull()
    return a.join(hits, "addr", "left").select(
        "addr", F.when(known, F.when(four, 4).otherwise(6)).alias("family"),
        F.when(four, F.greatest(F.col("length") - 96, F.lit(0))).otherwise(F.col("length")).alias("prefix_length"),
        F.when(known, F.coalesce("label", F.lit(otherwise))).otherwise("UNKNOWN").alias("label"))
