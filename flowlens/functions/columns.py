"""Column-level helpers: validators, time parsing, ids, address classes.

Everything here returns a ``Column`` built from built-in functions, so it runs
inside whole-stage codegen on the executors; no Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens import constants as K

# ---------------------------------------------------------------- patterns
# FIXED VALUES: host names are 1-253 characters of letters, digits, dot,
# underscore and dash, with no leading dash; IPv4 octets are 0-255 without
# leading zeros. The IPv6 pattern is generated by rule below; ISO-8601 is the
# extended form only.

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_RE = rf"{_OCTET}(\.{_OCTET}){{3}}"


def _ipv6_pattern() -> str:
    """IPv6 text forms accepted by a standard address parser, built by rule.

    Eight 1-4 digit hex groups; one ``::`` may stand for one or more zero
    groups; the last two groups may be written as a dotted IPv4 address.
    """
    h = "[0-9A-Fa-f]{1,4}"

    def run(n: int) -> str:  # exactly n groups joined by ':'
        return "" if n == 0 else (h if n == 1 else f"{h}(:{h}){{{n - 1}}}")

    alts = [run(8), f"({h}:){{6}}{IPV4_RE}"]
    for left in range(0, 8):          # '::' with `left` groups before it, up to 7 total
        right_max = 7 - left
        right = "" if right_max == 0 else f"({h}(:{h}){{0,{right_max - 1}}})?"
        alts.append(f"{run(left)}::{right}")
    for left in range(0, 6):          # '::' followed by an IPv4 tail (2 groups), up to 6 total
        right_max = 5 - left
        right = "" if right_max == 0 else f"({h}:){{0,{right_max}}}"
        alts.append(f"{run(left)}::{right}{IPV4_RE}")
    return "(" + "|".join(f"({a})" for a in alts) + ")"


IPV6_RE = _ipv6_pattern()
HOST_RE = r"[A-Za-z0-9._-]{1,253}"
DIGITS_RE = r"[0-9]+"
# Extended ISO-8601 date, optional time (minutes, seconds, fraction) and zone.
ISO_RE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?(Z|[+-][0-9]{2}:[0-9]{2})?"


def full(pattern: str) -> str:
    """Anchor a pattern to the whole string (\\z: no trailing-newline slack)."""
    return rf"^({pattern})\z"


# ---------------------------------------------------------------- validators

def is_ipv4(c: Column) -> Column:
    return F.coalesce(c.rlike(full(IPV4_RE)), F.lit(False))


def is_ip(c: Column) -> Column:
    """V2: an IPv4 or IPv6 literal; scoped addresses (with ``%``) are refused."""
    return F.coalesce(c.rlike(full(IPV4_RE)) | c.rlike(full(IPV6_RE)), F.lit(False))


def is_port(c: Column) -> Column:
    """V3: integer in 1..65535."""
    return F.coalesce(c.between(1, 65535), F.lit(False))


def is_host(c: Column) -> Column:
    """V4: hostname or IPv4 text of safe characters, no leading dash."""
    return F.coalesce(c.rlike(full(HOST_RE)) & ~c.startswith("-"), F.lit(False))


# ---------------------------------------------------------------- time

def parse_epoch(c: Column) -> Column:
    """V6: epoch seconds from an all-digit string or an ISO-8601 string.

    No zone means UTC (session zone is UTC). White space around the text is ignored. Blank or
    unreadable text, and times after the year 9999 (milliseconds taken for seconds), give NULL.
    """
    return bounded_epoch(unbounded_epoch(c))


def unbounded_epoch(c: Column) -> Column:
    """``parse_epoch`` before its bounds, for a projection of its own (the bounds name the value three times)."""
    s = F.regexp_replace(c, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")
    return (F.when(s.rlike(full(DIGITS_RE)), s.try_cast("bigint"))
             .when(s.rlike(full(ISO_RE)), F.unix_timestamp(s.try_cast("timestamp"))))


def bounded_epoch(c: Column) -> Column:
    """Epoch seconds that window arithmetic can hold (1970 to 9999), else NULL."""
    return F.when(c.between(0, K.MAX_EPOCH_S), c)


def fault(code: str, value: Column) -> Column:
    """Error row text: ``field CODE 'value as given'``."""
    return F.concat(F.lit(f"{code} '"), F.coalesce(value.cast("string"), F.lit("None")), F.lit("'"))


def fact(name: str, c: Column) -> Column:
    """``name=value``; NULL when the value is."""
    return F.concat(F.lit(f"{name}="), c.cast("string"))


def advice(codes: dict[str, tuple[str, str]], verdict: Column, *facts: Column) -> Column:
    """``cause=... next=...`` of a verdict and the facts that are known; NULL without a verdict."""
    texts = F.create_map(*[F.lit(x) for v, (cause, check) in codes.items()
                           for x in (v, f"cause={cause} next={check}")])
    return F.when(verdict.isNotNull(), F.concat_ws(" ", F.try_element_at(texts, verdict), *facts))


def iso(c: Column) -> Column:
    """Epoch seconds -> ``yyyy-MM-ddTHH:mm:ssZ`` (UTC)."""
    return F.date_format(F.timestamp_seconds(c), K.ISO_FMT)


def day_of(c: Column) -> Column:
    """UTC ``yyyy/MM/dd`` of epoch seconds."""
    return F.date_format(F.timestamp_seconds(c), K.DAY_FMT)


def days_between(lo: Column, hi: Column) -> Column:
    """V8: array of UTC day keys covering [lo, hi] inclusive."""
    d0 = F.to_date(F.timestamp_seconds(lo))
    d1 = F.to_date(F.timestamp_seconds(hi))
    return F.transform(F.sequence(d0, d1), lambda d: F.date_format(d, K.DAY_FMT))


# ---------------------------------------------------------------- ids

def id_part(c: Column) -> Column:
    """A finding-id part as text; NULL prints as ``None``."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def finding_id(*parts: Column) -> Column:
    """``net-`` + first 6 hex digits of SHA-1 over the parts joined by ``|``."""
    text = F.concat_ws("|", *[id_part(p) for p in parts])
    return F.concat(F.lit("net-"), F.substring(F.sha1(text), 1, 6))


# ---------------------------------------------------------------- addresses

def ipv4_to_long(c: Column) -> Column:
    """Dotted IPv4 -> unsigned 32-bit value as bigint; NULL when not IPv4."""
    o = F.split(c, r"\.")
    v = (o.getItem(0).cast("bigint") * 16777216 + o.getItem(1).cast("bigint") * 65536
         + o.getItem(2).cast("bigint") * 256 + o.getItem(3).cast("bigint"))
    return F.when(is_ipv4(c), v)


def _cidr_bounds(base: str, bits: int) -> tuple[int, int]:
    a, b, c, d = (int(x) for x in base.split("."))
    lo = (a << 24) | (b << 16) | (c << 8) | d
    return lo, lo + (1 << (32 - bits)) - 1


def in_cidr(v: Column, base: str, bits: int) -> Column:
    lo, hi = _cidr_bounds(base, bits)
    return v.between(lo, hi)


def boundary_class(addr: Column) -> Column:
    """M5: IN_VPC / PRIVATE_OTHER / PUBLIC; IPv6, NULL and non-IP text are UNKNOWN."""
    v = ipv4_to_long(addr)
    private = None
    for base, bits in K.PRIVATE_CIDRS:
        t = in_cidr(v, base, bits)
        private = t if private is None else (private | t)
    return (F.when(v.isNull(), "UNKNOWN")
             .when(in_cidr(v, *K.VPC_CIDR), "IN_VPC")
             .when(private, "PRIVATE_OTHER")
             .otherwise("PUBLIC"))


def protocol_number(name: Column) -> Column:
    """P5: protocol name (any case) -> IANA number; unknown -> NULL."""
    m = F.create_map(*[x for k, v in K.PROTOCOLS.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])
    return F.try_element_at(m, F.upper(name))


def ipv6_groups(addr: Column) -> Column:
    """The eight groups of an IPv6 literal as lower-case hexadecimal without leading zeros (a dotted tail is two groups)."""
    s = F.lower(addr)
    tail = F.substring_index(s, ":", -1)
    o = F.split(tail, r"\.")
    hi16 = o.getItem(0).cast("int") * 256 + o.getItem(1).cast("int")
    lo16 = o.getItem(2).cast("int") * 256 + o.getItem(3).cast("int")
    head = s.substr(F.lit(1), F.length(s) - F.length(tail))
    s2 = F.when(tail.contains("."), F.concat(head, F.lower(F.hex(hi16)), F.lit(":"), F.lower(F.hex(lo16)))) \
          .otherwise(s)
    nonempty = (lambda arr: F.filter(arr, lambda g: g != ""))
    left = nonempty(F.split(F.substring_index(s2, "::", 1), ":"))
    right = nonempty(F.split(F.substring_index(s2, "::", -1), ":"))
    fill = F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right))
    groups = F.when(s2.contains("::"), F.concat(left, fill, right)).otherwise(F.split(s2, ":"))
    return F.transform(groups, lambda g: F.lower(F.conv(g, 16, 16)))


def ip_bits(addr: Column) -> Column:
    """An address as 128 binary digits, IPv4 as ``::ffff:a.b.c.d``; NULL for anything that is not an IP literal."""
    text = F.when(is_ipv4(addr), F.concat(F.lit("::ffff:"), addr)).when(is_ip(addr), addr)

    def bits(t):
        return F.array_join(F.transform(ipv6_groups(t), lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")

    # a lambda binds the text, which its groups name many times, to one value
    return F.transform(F.array(text), lambda t: F.when(t.isNotNull(), bits(t))).getItem(0)


def canonical_ip(addr: Column) -> Column:
    """D11 (optional): one text form per address, so textual equality is address equality.

    IPv6 becomes the compressed lower-case form (leading zeros dropped, the
    first longest run of two or more zero groups written ``::``; an IPv4-mapped
    address keeps its dotted tail). IPv4 and anything that is not an IP literal
    are returned unchanged. Built-in functions only, so it can be applied once
    when flows are written and when questions are validated.
    """
    groups = ipv6_groups(addr)

    init = F.struct(F.lit(-1).alias("cs"), F.lit(0).alias("cl"), F.lit(-1).alias("bs"), F.lit(0).alias("bl"))

    def step(acc, i):
        z = F.element_at(groups, i + 1) == "0"
        cl = F.when(z, acc["cl"] + 1).otherwise(F.lit(0))
        cs = F.when(z, F.when(acc["cl"] == 0, i).otherwise(acc["cs"])).otherwise(F.lit(-1))
        better = cl > acc["bl"]
        return F.struct(cs.alias("cs"), cl.alias("cl"),
                        F.when(better, cs).otherwise(acc["bs"]).alias("bs"),
                        F.when(better, cl).otherwise(acc["bl"]).alias("bl"))

    run = F.aggregate(F.sequence(F.lit(0), F.lit(7)), init, step)
    bs, bl = run["bs"], run["bl"]
    compressed = F.when(bl >= 2, F.concat(
        F.array_join(F.slice(groups, F.lit(1), bs), ":"), F.lit("::"),
        F.array_join(F.slice(groups, bs + bl + 1, F.lit(8) - bs - bl), ":"))) \
        .otherwise(F.array_join(groups, ":"))
    mapped = F.when(
        (F.size(F.filter(F.slice(groups, 1, 5), lambda g: g != "0")) == 0)
        & (F.element_at(groups, 6) == "ffff"),
        F.concat(F.lit("::ffff:"), F.concat_ws(".", *[
            (F.conv(F.element_at(groups, k), 16, 10).cast("int") / d % 256).cast("int").cast("string")
            for k, d in ((7, 256), (7, 1), (8, 256), (8, 1))])))
    v6 = F.coalesce(mapped, compressed)
    return F.when(addr.rlike(full(IPV6_RE)), v6).otherwise(addr)
