"""DuckDB twins of the registered queries (the correctness oracle).

Each key's SQL is assembled from named CTEs with their dependencies, so every
string is self-contained and runs against the driver's pre-registered views.
The oracle is written the plain way (range join, whole-key windows); the Spark
side is written for scale. Agreement of the two is the check.
"""

from __future__ import annotations

from flowlens.functions.columns import DIGITS_RE, HOST_RE, IPV4_RE, IPV6_RE, ISO_RE
from flowlens.operators import probes as _PB
from flowlens.plans import params as _PR
from flowlens.sources import fixtures

CTES: dict[str, tuple[list[str], str]] = {}
ORACLE: dict[str, str] = {}
PARTS: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], sql: str) -> None:
    CTES[name] = (deps, sql.strip())


def query(key: str, deps: list[str], sql: str, overrides: dict[str, str] | None = None) -> None:
    """Register ``key``: the CTEs it needs (transitively) followed by ``sql``.

    ``overrides`` replaces the body of named CTEs (e.g. a one-row question).
    """
    overrides = overrides or {}
    PARTS[key] = (deps, sql)
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in ([] if n in overrides else CTES[n][0]):
            visit(d)
        order.append(n)

    for d in deps:
        visit(d)
    body = {n: overrides.get(n, CTES[n][1] if n in CTES else "") for n in order}
    head = ("WITH " + ",\n".join(f"{n} AS (\n{body[n]}\n)" for n in order) + "\n") if order else ""
    ORACLE[key] = head + sql.strip()


def iso(x: str) -> str:
    return f"strftime(make_timestamp(cast({x} AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


def day_of(x: str) -> str:
    return f"strftime(make_timestamp(cast({x} AS BIGINT) * 1000000), '%Y/%m/%d')"


def part(x: str) -> str:
    return f"coalesce(cast({x} AS VARCHAR), 'None')"


def fid(*parts: str) -> str:
    return f"'net-' || substr(sha1(concat_ws('|', {', '.join(part(p) for p in parts)})), 1, 6)"


def parse_epoch(x: str) -> str:
    s = f"regexp_replace({x}, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"
    return bounded(f"CASE WHEN regexp_full_match({s}, '{DIGITS_RE}') THEN try_cast({s} AS BIGINT) "
            f"WHEN regexp_full_match({s}, '{ISO_RE}') THEN "
            f"CASE WHEN regexp_matches({s}, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') "
            f"THEN cast(floor(epoch(try_cast({s} AS TIMESTAMPTZ))) AS BIGINT) "
            f"ELSE cast(floor(epoch(try_cast({s} AS TIMESTAMP))) AS BIGINT) END END")


def bounded(x: str) -> str:
    return f"(SELECT CASE WHEN t BETWEEN 0 AND 253402300799 THEN t END FROM (SELECT {x} AS t))"


def is_ip(x: str) -> str:
    return f"coalesce(regexp_full_match({x}, '({IPV4_RE})|({IPV6_RE})'), false)"


def is_ipv4(x: str) -> str:
    return f"coalesce(regexp_full_match({x}, '{IPV4_RE}'), false)"


def is_host(x: str) -> str:
    return f"coalesce(regexp_full_match({x}, '{HOST_RE}') AND NOT starts_with({x}, '-'), false)"


def quoted(x: str) -> str:
    return f"'''' || coalesce(cast({x} AS VARCHAR), 'None') || ''''"


def ipv4_long(x: str) -> str:
    o = [f"cast(split_part({x}, '.', {i}) AS BIGINT)" for i in (1, 2, 3, 4)]
    return f"CASE WHEN {is_ipv4(x)} THEN {o[0]} * 16777216 + {o[1]} * 65536 + {o[2]} * 256 + {o[3]} END"


def boundary(x: str) -> str:
    v = ipv4_long(x)
    return (f"CASE WHEN ({v}) IS NULL THEN 'UNKNOWN' "
            f"WHEN ({v}) BETWEEN 169082880 AND 169148415 THEN 'IN_VPC' "
            f"WHEN ({v}) BETWEEN 167772160 AND 184549375 OR ({v}) BETWEEN 2886729728 AND 2887778303 "
            f"OR ({v}) BETWEEN 3232235520 AND 3232301055 THEN 'PRIVATE_OTHER' ELSE 'PUBLIC' END")


# ---------------------------------------------------------------- inputs
cte("flows", [], fixtures.render("flows", "duckdb"))
cte("requests", [], fixtures.render("requests", "duckdb"))
cte("probes", [], fixtures.render("probes", "duckdb"))
cte("probe_runs", ["probes"], fixtures.render_probe_runs("duckdb", "probes"))

# ---------------------------------------------------------------- V1-V8
cte("vreq_a", ["requests"], f"""
SELECT r.* REPLACE (CASE WHEN as_of_epoch BETWEEN 0 AND 253402300799 THEN as_of_epoch END AS as_of_epoch), CASE WHEN ip <> '' THEN ip END AS ip_n,
  cast(CASE upper(protocol) WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 WHEN 'ICMP' THEN 1 END AS BIGINT) AS proto_n,
  {parse_epoch('start_time')} AS s_ep, {parse_epoch('end_time')} AS e_ep
FROM requests r""")
cte("vreq_b", ["vreq_a"], """
SELECT *, (s_ep IS NOT NULL OR e_ep IS NOT NULL) AS explicit,
  coalesce(e_ep, as_of_epoch) AS hi0,
  coalesce(s_ep, coalesce(e_ep, as_of_epoch) - 3600) AS lo0,
  CASE WHEN window_minutes IS NULL OR window_minutes < 1 THEN 60 ELSE least(window_minutes, 180) END AS w
FROM vreq_a""")
cte("vreq_c", ["vreq_b"], f"""
SELECT *, coalesce(
  CASE WHEN ip_n IS NOT NULL AND NOT {is_ip('ip_n')} THEN 'ip NOT_LITERAL ' || {quoted('ip_n')} END,
  CASE WHEN port IS NOT NULL AND NOT coalesce(port BETWEEN 1 AND 65535, false) THEN 'port OUT_OF_RANGE ' || {quoted('port')} END,
  CASE WHEN protocol IS NOT NULL AND proto_n IS NULL THEN 'protocol UNKNOWN ' || {quoted('protocol')} END,
  CASE WHEN ip_n IS NULL AND port IS NULL AND protocol IS NULL THEN 'scope EMPTY' END,
  CASE WHEN start_time IS NOT NULL AND s_ep IS NULL THEN 'start_time UNREADABLE ' || {quoted('start_time')} END,
  CASE WHEN end_time IS NOT NULL AND e_ep IS NULL THEN 'end_time UNREADABLE ' || {quoted('end_time')} END,
  CASE WHEN explicit AND lo0 > hi0 THEN 'start_time AFTER_END' END,
  CASE WHEN as_of_epoch IS NULL AND (NOT explicit OR e_ep IS NULL)
    THEN 'as_of_epoch MISSING' END) AS detail,
  ((hi0 + 60) - (lo0 - 60)) > 10800 AS clipped
FROM vreq_b""")
cte("vreq_d", ["vreq_c"], """
SELECT request_id, CASE WHEN detail IS NULL THEN 'OK' ELSE 'TOOL_ERROR' END AS status, detail,
  ip_n AS ip, CASE WHEN direction IN ('to', 'from') THEN direction ELSE 'to' END AS direction,
  port, proto_n AS protocol,
  CASE WHEN action IN ('ACCEPT', 'REJECT', 'ALL') THEN action ELSE 'ALL' END AS action,
  as_of_epoch, s_ep AS start_epoch, e_ep AS end_epoch, explicit,
  CASE WHEN explicit THEN CASE WHEN clipped THEN hi0 + 60 - 10800 ELSE lo0 - 60 END ELSE as_of_epoch - w * 60 END AS lo,
  CASE WHEN explicit THEN hi0 + 60 ELSE as_of_epoch END AS hi,
  CASE WHEN explicit THEN clipped ELSE coalesce(window_minutes > 180, false) END AS was_clipped
FROM vreq_c""")
cte("vreq", ["vreq_d"], """
SELECT *, cast(round_even(cast(hi - lo AS DOUBLE) / 60, 0) AS INTEGER) AS window_minutes FROM vreq_d""")
cte("vok", ["vreq"], "SELECT * FROM vreq WHERE status = 'OK'")

# ---------------------------------------------------------------- J1, A1-A8, K1-K3
cte("matched", ["vok", "flows"], """
SELECT v.request_id, CASE WHEN v.direction = 'to' THEN f.srcaddr ELSE f.dstaddr END AS peer,
  f.dstport, f.action, f.bytes, f.start, f."end"
FROM vok v JOIN flows f ON f.start BETWEEN v.lo AND v.hi
 AND (v.ip IS NULL OR (v.direction = 'to' AND f.dstaddr = v.ip) OR (v.direction = 'from' AND f.srcaddr = v.ip))
 AND (v.port IS NULL OR f.dstport = v.port)
 AND (v.protocol IS NULL OR f.protocol = v.protocol)
 AND (v.action = 'ALL' OR f.action = v.action)""")
cte("groups", ["matched"], """
SELECT request_id, peer, dstport, action, count(*) AS cnt, cast(sum(bytes) AS BIGINT) AS total_bytes,
  min(start) AS first_seen, max(start) AS last_seen, max("end") AS last_end
FROM matched GROUP BY request_id, peer, dstport, action""")
cte("totals", ["groups"], """
SELECT request_id,
  cast(sum(CASE WHEN upper(action) = 'ACCEPT' THEN cnt ELSE 0 END) AS BIGINT) AS accepts,
  cast(sum(CASE WHEN upper(action) = 'REJECT' THEN cnt ELSE 0 END) AS BIGINT) AS rejects,
  min(CASE WHEN upper(action) = 'REJECT' THEN first_seen END) AS first_reject_epoch,
  max(CASE WHEN upper(action) = 'REJECT' THEN last_seen END) AS last_reject_epoch,
  max(CASE WHEN upper(action) = 'REJECT' THEN last_end END) AS last_reject_end_epoch
FROM groups GROUP BY request_id""")
cte("peers", ["groups"], """
SELECT request_id, peer, cast(sum(cnt) AS BIGINT) AS flows,
  cast(sum(CASE WHEN upper(action) = 'REJECT' THEN cnt ELSE 0 END) AS BIGINT) AS rejects
FROM groups GROUP BY request_id, peer""")
cte("ports", ["groups"], """
SELECT request_id, dstport, cast(sum(cnt) AS BIGINT) AS flows
FROM groups WHERE dstport IS NOT NULL GROUP BY request_id, dstport""")
cte("findings", ["vreq", "totals"], f"""
SELECT request_id, status, detail, 'flow_log_query' AS tool, ip AS focus_ip, direction, port AS dstport,
  protocol, action,
  CASE WHEN status = 'OK' THEN {iso('lo')} END AS window_start,
  CASE WHEN status = 'OK' THEN {iso('hi')} END AS window_end,
  CASE WHEN status = 'OK' THEN window_minutes END AS window_minutes,
  acc AS accepts, rej AS rejects, {iso('first_reject_epoch')} AS first_reject, {iso('last_reject_epoch')} AS last_reject,
  {iso('last_reject_end_epoch')} AS last_reject_end, verdict,
  CASE WHEN verdict IS NOT NULL THEN concat_ws(' ', CASE verdict
    WHEN 'NO_DATA' THEN 'cause=NO_RECORDS next=LIVE_PROBE' WHEN 'PERSISTENT_REJECT' THEN 'cause=FILTER_DENIES next=FILTER_RULES'
    WHEN 'INTERMITTENT' THEN 'cause=FILTER_CHANGED_OR_PARTIAL next=FIRST_REJECT_PEERS_PORTS'
    WHEN 'ALL_ACCEPT' THEN 'cause=NONE next=NONE' END,
    'accepted=' || acc, 'rejected=' || rej, 'first_reject=' || {iso('first_reject_epoch')}) END AS remediation_hint,
  CASE WHEN status = 'OK' THEN {fid("'flowlog'", 'ip', 'direction', 'port', 'protocol', 'verdict', 'rej', 'acc')} END AS finding_id,
  CASE WHEN status = 'OK' THEN was_clipped END AS was_clipped,
  as_of_epoch, hi
FROM (
  SELECT x.*, CASE WHEN status <> 'OK' THEN NULL WHEN acc = 0 AND rej = 0 THEN 'NO_DATA'
      WHEN acc = 0 THEN 'PERSISTENT_REJECT' WHEN rej > 0 THEN 'INTERMITTENT' ELSE 'ALL_ACCEPT' END AS verdict
  FROM (SELECT v.*, t.first_reject_epoch, t.last_reject_epoch, t.last_reject_end_epoch,
          CASE WHEN v.status = 'OK' THEN coalesce(t.accepts, 0) END AS acc,
          CASE WHEN v.status = 'OK' THEN coalesce(t.rejects, 0) END AS rej
        FROM vreq v LEFT JOIN totals t USING (request_id)) x)""")

# ================================================================ keys
FLOW_COLS = ("version, account_id, interface_id, srcaddr, dstaddr, srcport, dstport, protocol, packets, bytes, "
             "start, \"end\", action, log_status, vpc_id, subnet_id, flow_direction, day")
query("flt_day", ["flows"], "SELECT * FROM flows WHERE day IN ('2024/01/15', '2024/01/16')")
query("flt_window", ["flows"], "SELECT * FROM flows WHERE start BETWEEN 1705305600 AND 1705316400")
query("flt_focus_to", ["flows"], "SELECT * FROM flows WHERE dstaddr = '10.20.1.3'")
query("flt_focus_from", ["flows"], "SELECT * FROM flows WHERE srcaddr = '10.20.0.5'")
query("flt_port", ["flows"], "SELECT * FROM flows WHERE dstport = 5432")
query("flt_protocol", ["flows"], "SELECT * FROM flows WHERE protocol = 17")
query("flt_action", ["flows"], "SELECT * FROM flows WHERE action = 'REJECT'")
query("flt_all_dims", ["flows"], """
SELECT * FROM flows WHERE day IN ('2024/01/15', '2024/01/16') AND start BETWEEN 1705276800 AND 1705449599
  AND dstaddr = '10.20.1.3' AND dstport = 5432 AND protocol = 6""")
query("proj_peer", ["flows"], """
SELECT 'to' AS direction, srcaddr AS peer, dstport, action, start FROM flows WHERE dstaddr = '10.20.1.3'
UNION ALL
SELECT 'from' AS direction, dstaddr AS peer, dstport, action, start FROM flows WHERE srcaddr = '10.20.0.5'""")

query("validate_requests", ["vreq"], "SELECT * FROM vreq")
query("hostile_requests", ["vreq"], "SELECT * FROM vreq",
      overrides={"requests": fixtures.HOSTILE.replace("<REQUESTS>", f"({fixtures.render('requests', 'duckdb')})")})
query("valid_ips", ["requests", "flows", "probes"], f"""
SELECT value, {is_ip('value')} AS is_ip, {is_ipv4('value')} AS is_ipv4 FROM (
  SELECT DISTINCT value FROM (SELECT ip AS value FROM requests UNION ALL SELECT srcaddr FROM flows
    UNION ALL SELECT dstaddr FROM flows UNION ALL SELECT host FROM probes) WHERE value IS NOT NULL)""")
query("valid_ports", ["requests"], """
SELECT request_id, port, coalesce(port BETWEEN 1 AND 65535, false) AS port_ok FROM requests""")
query("valid_hosts", ["probes", "requests"], f"""
SELECT value, {is_host('value')} AS host_ok FROM (
  SELECT DISTINCT value FROM (SELECT host AS value FROM probes UNION ALL SELECT props FROM events
    UNION ALL SELECT '-' || event_type FROM events UNION ALL SELECT event_type FROM events
    UNION ALL SELECT ip FROM requests) WHERE value IS NOT NULL)""")
query("normalise_requests", ["requests"], """
SELECT request_id, CASE WHEN direction IN ('to', 'from') THEN direction ELSE 'to' END AS direction,
  CASE WHEN action IN ('ACCEPT', 'REJECT', 'ALL') THEN action ELSE 'ALL' END AS action,
  cast(CASE upper(protocol) WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 WHEN 'ICMP' THEN 1 END AS BIGINT) AS protocol,
  CASE WHEN window_minutes IS NULL OR window_minutes < 1 THEN 60 ELSE least(window_minutes, 180) END AS window_minutes
FROM requests""")
query("parse_times", ["requests"], f"""
SELECT request_id, start_time, end_time, {parse_epoch('start_time')} AS start_epoch,
  {parse_epoch('end_time')} AS end_epoch FROM requests""")
query("resolve_windows", ["vok"], "SELECT request_id, explicit, lo, hi, was_clipped, window_minutes FROM vok")
query("window_days", ["vok"], f"""
SELECT request_id, strftime(d, '%Y/%m/%d') AS day FROM (
  SELECT request_id, unnest(generate_series(cast(make_timestamp(lo * 1000000) AS DATE),
                                            cast(make_timestamp(hi * 1000000) AS DATE), INTERVAL 1 DAY)) AS d
  FROM vok)""")
query("scope_echo", ["vok"], f"""
SELECT request_id, ip AS focus_ip, direction, port AS dstport, protocol, action, {iso('lo')} AS window_start,
  {iso('hi')} AS window_end, window_minutes FROM vok""")

query("flow_groups", ["groups"], "SELECT * FROM groups")
query("flow_totals", ["findings"], "SELECT request_id, accepts, rejects FROM findings WHERE status = 'OK'")
query("reject_span", ["totals"], f"""
SELECT request_id, {iso('first_reject_epoch')} AS first_reject, {iso('last_reject_epoch')} AS last_reject
FROM totals WHERE rejects > 0""")
query("peer_rollup", ["peers"], "SELECT * FROM peers")
query("port_rollup", ["ports"], "SELECT * FROM ports")
query("groups_topn", ["groups"], """
SELECT request_id, rank, peer, dstport, action, cnt FROM (
  SELECT *, cast(row_number() OVER (PARTITION BY request_id ORDER BY cnt DESC, peer ASC NULLS LAST,
      dstport ASC NULLS LAST, action ASC NULLS LAST) AS INTEGER) AS rank FROM groups) WHERE rank <= 20""")
query("top_peers", ["peers"], """
SELECT request_id, rank, peer, flows, rejects FROM (
  SELECT *, cast(row_number() OVER (PARTITION BY request_id ORDER BY flows DESC, peer ASC NULLS LAST) AS INTEGER) AS rank
  FROM peers) WHERE rank <= 10""")
query("top_ports", ["ports"], """
SELECT request_id, rank, dstport, flows FROM (
  SELECT *, cast(row_number() OVER (PARTITION BY request_id ORDER BY flows DESC, dstport ASC NULLS LAST) AS INTEGER) AS rank
  FROM ports) WHERE rank <= 10""")
FINDING_FLAT = ("request_id, status, detail, tool, focus_ip, direction, dstport, protocol, action, window_start, "
                "window_end, window_minutes, accepts, rejects, first_reject, last_reject, last_reject_end, verdict, "
                "remediation_hint, finding_id, was_clipped")
query("flow_verdict", ["findings"], f"SELECT {FINDING_FLAT} FROM findings", overrides={"requests": """
SELECT cast(0 AS BIGINT) AS request_id, '10.20.1.1' AS ip, 'to' AS direction, 5432 AS port, 'TCP' AS protocol,
  'ALL' AS action, cast(NULL AS INTEGER) AS window_minutes, '2024-01-15T08:00:00Z' AS start_time,
  '2024-01-15T10:58:00Z' AS end_time, cast(1705500000 AS BIGINT) AS as_of_epoch"""})
query("flow_verdict_hint", ["findings"], "SELECT request_id, verdict, remediation_hint FROM findings WHERE status = 'OK'")
query("batch_flow_verdicts", ["findings"], f"SELECT {FINDING_FLAT} FROM findings")
query("requests_without_flows", ["vok", "matched"], """
SELECT request_id, ip, direction, port, lo, hi FROM vok
WHERE request_id NOT IN (SELECT request_id FROM matched)""")

# ---------------------------------------------------------------- probes

NL = _PB.NEWLINE_RE
WSC = _PB.WS


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{WSC}+|{WSC}+$', '', 'g')"


def extract(x: str, pat: str, g: int) -> str:
    return f"CASE WHEN regexp_matches({x}, '{pat}') THEN regexp_extract({x}, '{pat}', {g}) END"


REC = _PB.RECORD_RE
cte("dns", ["probes"], f"""
SELECT probe_id, probed_at, host, raw,
  {extract('raw', _PB.DNS_STATUS_RE, 1)} AS dns_status,
  list_transform(list_filter(list_transform(string_split_regex(raw, '{NL}'), lambda l: {strip_ws('l')}),
                             lambda l: regexp_matches(l, '{REC}')),
    lambda l: {{'name': regexp_replace(regexp_extract(l, '{REC}', 1), '\\.+$', ''),
          'ttl': try_cast(regexp_extract(l, '{REC}', 2) AS INTEGER),
          'type': regexp_extract(l, '{REC}', 3),
          'value': regexp_replace(regexp_extract(l, '{REC}', 4), '\\.+$', '')}}) AS records,
  {extract('raw', _PB.RESOLVER_RE, 1)} AS resolver,
  try_cast({extract('raw', _PB.QUERY_MS_RE, 1)} AS INTEGER) AS query_ms
FROM probes WHERE tool = 'resolve_dns'""")
cte("dnsf", ["dns"], f"""
SELECT *, {fid("'dns'", 'host', 'dns_status', 'resolved_ip')} AS finding_id FROM (
  SELECT *, CASE WHEN len(records) > 0 THEN records[1].value END AS resolved_ip FROM dns)""")
query("dns_findings", ["dnsf"], """
SELECT probe_id, host, dns_status, resolved_ip, resolver, query_ms, cast(len(records) AS INTEGER) AS n_records,
  finding_id FROM dnsf""")
query("dns_records", ["dns"], """
SELECT probe_id, cast(pos AS INTEGER) AS pos, r.name, r.ttl, r.type, r.value FROM (
  SELECT probe_id, unnest(records) AS r, unnest(generate_series(1, len(records))) AS pos FROM dns)""")


def tcp_verdict(x: str) -> str:
    return (f"CASE WHEN contains(lower({x}), 'connected to') THEN 'OPEN' "
            f"WHEN contains(lower({x}), 'refused') THEN 'CONNECTION_REFUSED' "
            f"WHEN contains(lower({x}), 'timeout') OR contains(lower({x}), 'timed out') THEN 'CONNECTION_TIMEOUT' "
            f"ELSE 'UNKNOWN' END")


cte("tcp", ["probes"], f"""
SELECT *, verdict = 'OPEN' AS reachable,
  concat_ws(' ', CASE verdict WHEN 'OPEN' THEN 'cause=NONE next=NONE' WHEN 'CONNECTION_REFUSED' THEN 'cause=NO_LISTENER next=SERVICE'
    WHEN 'CONNECTION_TIMEOUT' THEN 'cause=DROPPED_OR_HOST_DOWN next=FILTER_RULES_AND_PING'
    ELSE 'cause=UNREADABLE next=EVIDENCE' END, 'port=' || port) AS remediation_hint,
  {fid("'tcp'", 'host', 'port', 'verdict')} AS finding_id FROM (
  SELECT probe_id, probed_at, host, port, concat_ws(':', host, cast(port AS VARCHAR)) AS target,
    {tcp_verdict('raw')} AS verdict,
    coalesce(list_filter(list_transform(string_split_regex(raw, '{NL}'), lambda l: {strip_ws('l')}),
                         lambda s: starts_with(s, 'Ncat:') AND NOT contains(s, 'Version'))[1],
             substring({strip_ws('raw')}, 1, 200)) AS evidence
  FROM probes WHERE tool = 'tcp_reachability')""")
query("tcp_findings", ["tcp"], """
SELECT probe_id, host, port, target, reachable, verdict, evidence, remediation_hint, finding_id FROM tcp""")

cte("ping", ["probes"], f"""
SELECT *, {fid("'ping'", 'host', 'packets_received', 'loss_pct')} AS finding_id,
  CASE WHEN reachable AND coalesce(loss_pct, 0.0) = 0 THEN 'ALIVE' WHEN reachable THEN 'PARTIAL_LOSS'
    ELSE 'NO_RESPONSE' END AS verdict FROM (
  SELECT probe_id, probed_at, host,
    try_cast({extract('raw', _PB.PING_RE, 1)} AS INTEGER) AS packets_sent,
    try_cast({extract('raw', _PB.PING_RE, 2)} AS INTEGER) AS packets_received,
    try_cast({extract('raw', _PB.PING_RE, 3)} AS DOUBLE) AS loss_pct,
    try_cast({extract('raw', _PB.RTT_RE, 1)} AS DOUBLE) AS rtt_avg_ms,
    coalesce(try_cast({extract('raw', _PB.PING_RE, 2)} AS INTEGER) > 0, false) AS reachable
  FROM probes WHERE tool = 'ping_host')""")
query("ping_findings", ["ping"], """
SELECT probe_id, host, packets_sent, packets_received, loss_pct, rtt_avg_ms, reachable, verdict, finding_id
FROM ping""")

HL, HA = _PB.HOP_LINE_RE, _PB.HOP_ANSWER_RE


def hops_sql(raw: str) -> str:
    rest = strip_ws(f"regexp_extract(l, '{HL}', 2)")
    answered = f"(NOT ({rest} = '*' OR starts_with({rest}, '* ')) AND regexp_matches({rest}, '{HA}'))"
    return (f"list_transform(list_filter(string_split_regex({raw}, '{NL}'), lambda l: regexp_matches(l, '{HL}')), "
            f"lambda l: {{'n': try_cast(regexp_extract(l, '{HL}', 1) AS INTEGER), "
            f"'ip': CASE WHEN {answered} THEN regexp_extract({rest}, '{HA}', 1) END, "
            f"'rtt_ms': CASE WHEN {answered} THEN try_cast(regexp_extract({rest}, '{HA}', 2) AS DOUBLE) END, "
            f"'timed_out': NOT {answered}}})")


cte("trace", ["probes"], f"""
SELECT *, {fid("'trace'", 'host', 'hop_count', 'last_responding_hop')} AS finding_id FROM (
  SELECT probe_id, probed_at, host, hops, cast(len(hops) AS INTEGER) AS hop_count,
    CASE WHEN len(list_filter(hops, lambda h: NOT h.timed_out)) > 0 THEN list_filter(hops, lambda h: NOT h.timed_out)[-1].n END
      AS last_responding_hop,
    CASE WHEN len(hops) > 0 AND NOT hops[-1].timed_out THEN 'REACHED' ELSE 'INCOMPLETE' END AS verdict
  FROM (SELECT probe_id, probed_at, host, {hops_sql('raw')} AS hops FROM probes WHERE tool = 'traceroute_host'))""")
query("trace_hops", ["trace"], """
SELECT probe_id, cast(pos AS INTEGER) AS pos, h.n, h.ip, h.rtt_ms, h.timed_out FROM (
  SELECT probe_id, unnest(hops) AS h, unnest(generate_series(1, len(hops))) AS pos FROM trace)""")
query("trace_findings", ["trace"], "SELECT probe_id, host, hop_count, last_responding_hop, verdict, finding_id FROM trace")

cte("runs_src", ["probe_runs"], """
SELECT *, coalesce(stdout, '') || coalesce(stderr, '') AS raw FROM probe_runs""")
query("probe_source", ["runs_src"], "SELECT probe_id, tool, host, port, run_status, raw FROM runs_src")
cte("gated", ["runs_src"], f"""
SELECT *, CASE WHEN detail IS NULL THEN 'OK' ELSE 'TOOL_ERROR' END AS status FROM (
  SELECT *, coalesce(
    CASE WHEN NOT coalesce(tool IN ('resolve_dns', 'tcp_reachability', 'ping_host', 'traceroute_host'), false)
      THEN 'tool UNKNOWN ''' || coalesce(tool, 'None') || '''' END,
    CASE WHEN NOT {is_host('host')} THEN 'host INVALID ''' || coalesce(host, 'None') || '''' END,
    CASE WHEN tool = 'tcp_reachability' AND NOT coalesce(port BETWEEN 1 AND 65535, false)
      THEN 'port OUT_OF_RANGE ''' || coalesce(cast(port AS VARCHAR), 'None') || '''' END,
    CASE WHEN NOT coalesce(CASE WHEN tool = 'resolve_dns' THEN run_status = 'Success'
                                ELSE run_status IN ('Success', 'Failed') END, false)
      THEN 'run_status INCOMPLETE ''' || coalesce(run_status, 'None') || '''' END) AS detail
  FROM runs_src)""")
query("probe_errors", ["gated"], "SELECT probe_id, tool, run_status, status, detail FROM gated")
query("normalise_probe_args", ["probe_runs"], f"""
SELECT probe_id, tool, host, port, {is_host('host')} AS host_ok,
  CASE WHEN tool = 'tcp_reachability' THEN coalesce(port BETWEEN 1 AND 65535, false) END AS port_ok,
  CASE WHEN tool = 'traceroute_host' THEN CASE WHEN max_hops BETWEEN 1 AND 30 THEN max_hops ELSE 8 END END AS max_hops
FROM probe_runs""")
cte("pf", ["gated"], f"""
SELECT probe_id, probed_at, tool, host, port, status, detail,
  CASE WHEN status <> 'OK' THEN NULL
    WHEN tool = 'resolve_dns' THEN dns_status WHEN tool = 'tcp_reachability' THEN tcp_v
    WHEN tool = 'ping_host' THEN CASE WHEN coalesce(recv > 0, false) AND coalesce(loss, 0.0) = 0 THEN 'ALIVE'
      WHEN coalesce(recv > 0, false) THEN 'PARTIAL_LOSS' ELSE 'NO_RESPONSE' END
    WHEN tool = 'traceroute_host' THEN CASE WHEN len(hops) > 0 AND NOT hops[-1].timed_out THEN 'REACHED' ELSE 'INCOMPLETE' END
  END AS verdict,
  CASE WHEN status <> 'OK' THEN NULL
    WHEN tool = 'resolve_dns' THEN {fid("'dns'", 'host', 'dns_status', 'resolved_ip')}
    WHEN tool = 'tcp_reachability' THEN {fid("'tcp'", 'host', 'port', 'tcp_v')}
    WHEN tool = 'ping_host' THEN {fid("'ping'", 'host', 'recv', 'loss')}
    WHEN tool = 'traceroute_host' THEN {fid("'trace'", 'host', 'len(hops)', "CASE WHEN len(list_filter(hops, lambda h: NOT h.timed_out)) > 0 THEN list_filter(hops, lambda h: NOT h.timed_out)[-1].n END")}
  END AS finding_id,
  CASE WHEN status = 'OK' AND tool = 'resolve_dns' THEN resolved_ip END AS resolved_ip
FROM (
  SELECT *, {extract('raw', _PB.DNS_STATUS_RE, 1)} AS dns_status,
    list_filter(list_transform(string_split_regex(raw, '{NL}'), lambda l: {strip_ws('l')}),
                lambda l: regexp_matches(l, '{REC}')) AS rec_lines,
    {tcp_verdict('raw')} AS tcp_v,
    try_cast({extract('raw', _PB.PING_RE, 2)} AS INTEGER) AS recv,
    try_cast({extract('raw', _PB.PING_RE, 3)} AS DOUBLE) AS loss,
    {hops_sql('raw')} AS hops
  FROM gated) x0
  CROSS JOIN LATERAL (SELECT CASE WHEN len(rec_lines) > 0
      THEN regexp_replace(regexp_extract(rec_lines[1], '{REC}', 4), '\\.+$', '') END AS resolved_ip) x1""")
query("probe_findings", ["pf"], "SELECT * FROM pf")
query("finding_ids", ["pf"], "SELECT probe_id, tool, finding_id FROM pf WHERE status = 'OK'")
query("iso_times", ["flows"], f"""
SELECT interface_id, srcport, start, {iso('start')} AS start_iso, {iso('"end"')} AS end_iso FROM flows""")

# ---------------------------------------------------------------- diagnosis
query("direction_correlation", ["flows"], """
SELECT *, CASE WHEN arrived_rejected > 0 THEN 'DEST_FILTER' WHEN arrived_ok > 0 THEN 'DELIVERED'
  WHEN sent > 0 THEN 'NEVER_ARRIVED' ELSE 'UNKNOWN' END AS correlation FROM (
  SELECT srcaddr, dstaddr, dstport,
    count(CASE WHEN flow_direction = 'egress' THEN 1 END) AS sent,
    count(CASE WHEN flow_direction = 'egress' AND action = 'REJECT' THEN 1 END) AS sent_rejected,
    count(CASE WHEN flow_direction = 'ingress' AND action = 'ACCEPT' THEN 1 END) AS arrived_ok,
    count(CASE WHEN flow_direction = 'ingress' AND action = 'REJECT' THEN 1 END) AS arrived_rejected
  FROM flows WHERE action IS NOT NULL GROUP BY srcaddr, dstaddr, dstport)""")
query("blast_radius", ["flows"], """
SELECT *, CASE WHEN rejected_peers = 0 THEN 'NONE' WHEN rejected_peers = peers THEN 'GLOBAL' ELSE 'PER_SOURCE' END AS peer_scope,
  CASE WHEN rejected_ports = 0 THEN 'NONE' WHEN rejected_ports = 1 THEN 'TARGETED_RULE' ELSE 'BROAD_OUTAGE' END AS port_scope
FROM (SELECT dstaddr, count(DISTINCT srcaddr) AS peers,
        count(DISTINCT CASE WHEN action = 'REJECT' THEN srcaddr END) AS rejected_peers,
        count(DISTINCT CASE WHEN action = 'REJECT' THEN dstport END) AS rejected_ports
      FROM flows WHERE action IS NOT NULL GROUP BY dstaddr)""")
cte("portcmp", ["tcp", "ping"], """
SELECT *, CASE WHEN tcp_open > 0 AND tcp_timeout > 0 THEN 'PER_PORT_BLOCK'
  WHEN tcp_timeout > 0 AND ping_alive > 0 THEN 'PER_PORT_BLOCK' WHEN tcp_timeout > 0 THEN 'ROUTE_OR_HOST'
  WHEN tcp_refused > 0 THEN 'LISTENER_DOWN' WHEN tcp_open > 0 THEN 'OPEN' ELSE 'INCONCLUSIVE' END AS diagnosis FROM (
  SELECT host, count(CASE WHEN kind = 'tcp' AND v = 'OPEN' THEN 1 END) AS tcp_open,
    count(CASE WHEN kind = 'tcp' AND v = 'CONNECTION_TIMEOUT' THEN 1 END) AS tcp_timeout,
    count(CASE WHEN kind = 'tcp' AND v = 'CONNECTION_REFUSED' THEN 1 END) AS tcp_refused,
    count(CASE WHEN kind = 'ping' AND v IN ('ALIVE', 'PARTIAL_LOSS') THEN 1 END) AS ping_alive
  FROM (SELECT * FROM (SELECT host, 'tcp' AS kind, verdict AS v, row_number() OVER (
            PARTITION BY host, port ORDER BY probed_at DESC, probe_id DESC) AS rn FROM tcp) WHERE rn = 1
        UNION ALL
        SELECT * FROM (SELECT host, 'ping', verdict, row_number() OVER (
            PARTITION BY host ORDER BY probed_at DESC, probe_id DESC) AS rn FROM ping) WHERE rn = 1)
  GROUP BY host)""")
query("port_comparison", ["portcmp"], "SELECT * FROM portcmp")
cte("dnsgate", ["dnsf"], f"""
SELECT l.host, c.captures, l.probe_id AS latest_probe_id, l.dns_status AS latest_status, l.resolved_ip AS latest_ip,
  l.finding_id AS dns_finding_id, c.answers, c.answers > 1 AS answer_changed,
  CASE WHEN l.dns_status IN ('NXDOMAIN', 'SERVFAIL') THEN 'DNS_FAULT'
    WHEN l.dns_status = 'NOERROR' AND {boundary('l.resolved_ip')} IN ('IN_VPC', 'PRIVATE_OTHER') THEN 'OK'
    WHEN l.dns_status = 'NOERROR' AND {boundary('l.resolved_ip')} = 'PUBLIC' THEN 'PUBLIC_ANSWER'
    ELSE 'INCONCLUSIVE' END AS gate
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY probed_at DESC, probe_id DESC) AS rn
                     FROM dnsf) WHERE rn = 1) l
JOIN (SELECT host, count(*) AS captures,
        count(DISTINCT CASE WHEN dns_status = 'NOERROR' THEN resolved_ip END) AS answers
      FROM dnsf GROUP BY host) c USING (host)""")
query("dns_gate", ["dnsgate"], "SELECT * FROM dnsgate")
query("dns_to_flow", ["dnsf", "probes"], f"""
SELECT q.probe_id AS question_id, q.host, q.port, q.probed_at AS as_of_epoch, a.resolved_ip AS ip,
  a.probe_id AS dns_probe_id
FROM (SELECT * FROM probes WHERE tool = 'tcp_reachability') q
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY probed_at DESC, probe_id DESC) AS rn
                          FROM dnsf WHERE {is_ip('resolved_ip')}) WHERE rn = 1) a USING (host)""")
query("boundary_class", ["flows"], f"""
SELECT srcaddr, count(*) AS flows, {boundary('srcaddr')} AS boundary FROM flows WHERE srcaddr IS NOT NULL
GROUP BY srcaddr""")
query("noise_split", ["groups"], f"""
SELECT request_id, {boundary('peer')} AS boundary, cast(sum(cnt) AS BIGINT) AS flows,
  cast(sum(CASE WHEN action = 'REJECT' THEN cnt ELSE 0 END) AS BIGINT) AS rejects
FROM groups GROUP BY request_id, {boundary('peer')}""")
cte("hostmap", ["dnsf"], f"""
SELECT resolved_ip AS ip, min(host) AS host FROM dnsf WHERE dns_status = 'NOERROR' AND {is_ip('resolved_ip')}
GROUP BY resolved_ip""")
cte("live", ["findings", "hostmap", "tcp"], """
SELECT request_id, focus_ip, dstport, host, verdict AS flow_verdict, rejects, probe_id, live_verdict,
  tcp_finding_id, flow_finding_id,
  CASE WHEN probe_id IS NULL THEN 'NO_LIVE_PROBE' WHEN live_verdict = 'CONNECTION_REFUSED' THEN 'LISTENER_DOWN'
    WHEN live_verdict = 'OPEN' AND rejects > 0 THEN 'RESOLVED_INCIDENT'
    WHEN live_verdict = 'CONNECTION_TIMEOUT' AND rejects > 0 THEN 'ONGOING_BLOCK'
    WHEN live_verdict = 'CONNECTION_TIMEOUT' AND verdict = 'NO_DATA' THEN 'TOO_RECENT_OR_NOT_ARRIVED'
    WHEN live_verdict = 'OPEN' AND verdict = 'ALL_ACCEPT' THEN 'HEALTHY' ELSE 'INCONCLUSIVE' END AS outcome
FROM (
  SELECT f.request_id, f.focus_ip, f.dstport, h.host, f.verdict, f.rejects, f.finding_id AS flow_finding_id,
    t.probe_id, t.verdict AS live_verdict, t.finding_id AS tcp_finding_id,
    row_number() OVER (PARTITION BY f.request_id ORDER BY t.probed_at DESC NULLS LAST, t.probe_id DESC NULLS LAST) AS rn
  FROM (SELECT * FROM findings WHERE status = 'OK') f
  LEFT JOIN hostmap h ON f.focus_ip = h.ip AND f.direction = 'to'
  LEFT JOIN tcp t ON t.host = h.host AND t.port = f.dstport AND t.probed_at <= f.as_of_epoch)
WHERE rn = 1""")
query("live_vs_forensic", ["live"], "SELECT * FROM live")
cte("dns_asof", ["live", "findings", "dnsf"], """
SELECT * FROM (
  SELECT l.request_id, d.dns_status, d.finding_id AS dns_finding_id,
    row_number() OVER (PARTITION BY l.request_id ORDER BY d.probed_at DESC, d.probe_id DESC) AS rn
  FROM live l JOIN findings f ON f.request_id = l.request_id
  JOIN dnsf d ON d.host = l.host AND d.probed_at <= f.as_of_epoch) WHERE rn = 1""")
cte("never", ["vok", "flows"], """
SELECT DISTINCT request_id FROM (
  SELECT v.request_id, f.srcaddr, f.dstaddr, f.dstport,
    count(CASE WHEN flow_direction = 'egress' THEN 1 END) AS sent,
    count(CASE WHEN flow_direction = 'ingress' THEN 1 END) AS arrived
  FROM vok v JOIN flows f ON f.start BETWEEN v.lo AND v.hi AND f.action IS NOT NULL
   AND (v.ip IS NULL OR (v.direction = 'to' AND f.dstaddr = v.ip) OR (v.direction = 'from' AND f.srcaddr = v.ip))
   AND (v.port IS NULL OR f.dstport = v.port) AND (v.protocol IS NULL OR f.protocol = v.protocol)
  GROUP BY v.request_id, f.srcaddr, f.dstaddr, f.dstport) WHERE sent > 0 AND arrived = 0""")
cte("rootcause", ["live", "dns_asof", "never"], """
SELECT l.request_id, l.host,
  CASE WHEN d.dns_status IN ('NXDOMAIN', 'SERVFAIL') THEN 'DNS_FAULT'
    WHEN l.outcome = 'LISTENER_DOWN' THEN 'LISTENER_DOWN'
    WHEN l.outcome = 'RESOLVED_INCIDENT' THEN 'RESOLVED_INCIDENT'
    WHEN l.outcome = 'ONGOING_BLOCK' THEN 'ONGOING_BLOCK'
    WHEN n.request_id IS NOT NULL THEN 'NEVER_ARRIVED'
    WHEN l.outcome = 'HEALTHY' THEN 'HEALTHY' ELSE 'INCONCLUSIVE' END AS root_cause,
  concat_ws(',', d.dns_finding_id, l.tcp_finding_id, l.flow_finding_id) AS evidence
FROM live l LEFT JOIN dns_asof d ON d.request_id = l.request_id LEFT JOIN never n ON n.request_id = l.request_id""")
query("root_cause", ["rootcause"], "SELECT * FROM rootcause")
query("conclusions", ["rootcause", "findings"], f"""
SELECT request_id, r.host, f.focus_ip, {boundary('f.focus_ip')} AS boundary, f.verdict, r.root_cause,
  CASE WHEN r.root_cause IN ('ONGOING_BLOCK', 'NEVER_ARRIVED') THEN 'YES' WHEN r.root_cause = 'RESOLVED_INCIDENT' THEN 'RESOLVED'
    WHEN r.root_cause = 'INCONCLUSIVE' THEN 'UNKNOWN' ELSE 'NO' END AS network_issue,
  r.evidence, f.first_reject, f.last_reject, f.remediation_hint
FROM rootcause r JOIN findings f USING (request_id)""")
cte("hostq", ["probes", "dnsf"], f"""
SELECT request_id, host, port, as_of_epoch, ip, dns_probe_id FROM (
  SELECT q.probe_id AS request_id, q.host, q.port, q.probed_at AS as_of_epoch, d.resolved_ip AS ip, d.probe_id AS dns_probe_id,
    row_number() OVER (PARTITION BY q.probe_id ORDER BY d.probed_at DESC NULLS LAST, d.probe_id DESC NULLS LAST) AS rn
  FROM (SELECT * FROM probes WHERE tool = 'tcp_reachability') q
  LEFT JOIN (SELECT * FROM dnsf WHERE dns_status = 'NOERROR' AND {is_ip('resolved_ip')}) d
    ON d.host = q.host AND d.probed_at <= q.probed_at) WHERE rn = 1""")
query("host_flow_verdicts", ["hostq", "findings"], """
SELECT q.request_id, q.host, q.port, q.as_of_epoch, q.ip, q.dns_probe_id, coalesce(f.status, 'NO_ADDRESS') AS status, f.detail,
  f.verdict, f.accepts, f.rejects, f.first_reject, f.finding_id
FROM hostq q LEFT JOIN findings f USING (request_id)""", overrides={"requests": """
SELECT request_id, ip, 'to' AS direction, port, 'TCP' AS protocol, 'ALL' AS action, cast(NULL AS INTEGER) AS window_minutes,
  cast(NULL AS VARCHAR) AS start_time, cast(NULL AS VARCHAR) AS end_time, as_of_epoch FROM hostq WHERE ip IS NOT NULL"""})
query("path_break", ["tcp", "trace"], """
SELECT probe_id, host, port, probed_at, tcp_finding_id, trace_probe_id, hop_count, last_hop, last_ip,
  CASE WHEN trace_probe_id IS NULL THEN 'NO_TRACE' WHEN trace_verdict = 'REACHED' THEN 'AT_HOST'
    WHEN last_hop IS NOT NULL THEN 'IN_PATH' ELSE 'NO_HOP' END AS breaks FROM (
  SELECT t.probe_id, t.host, t.port, t.probed_at, t.finding_id AS tcp_finding_id, r.probe_id AS trace_probe_id, r.hop_count,
    r.last_responding_hop AS last_hop, list_filter(r.hops, lambda h: NOT h.timed_out)[-1].ip AS last_ip, r.verdict AS trace_verdict,
    row_number() OVER (PARTITION BY t.probe_id ORDER BY r.probed_at DESC NULLS LAST, r.probe_id DESC NULLS LAST) AS rn
  FROM (SELECT * FROM tcp WHERE verdict = 'CONNECTION_TIMEOUT') t
  LEFT JOIN trace r ON r.host = t.host AND r.probed_at <= t.probed_at) WHERE rn = 1""")
LINE = "concat_ws(' ', " + ", ".join(f"coalesce(cast({c.strip()} AS VARCHAR), '-')" for c in FLOW_COLS.split(",")[:-1]) + ")"
cte("budget", ["vok", "flows"], f"""
SELECT request_id, count(*) AS days, cast(coalesce(sum(day_bytes), 0) AS BIGINT) AS bytes_scanned FROM (
  SELECT request_id, strftime(unnest(generate_series(cast(make_timestamp(lo * 1000000) AS DATE),
      cast(make_timestamp(hi * 1000000) AS DATE), INTERVAL 1 DAY)), '%Y/%m/%d') AS day FROM vok) w
LEFT JOIN (SELECT day, sum(strlen({LINE}) + 1) AS day_bytes FROM flows GROUP BY day) USING (day) GROUP BY request_id""")
query("scan_budget", ["budget"], "SELECT *, bytes_scanned > 1073741824 AS over_budget FROM budget")
query("budgeted_verdicts", ["findings", "budget"], f"""
SELECT request_id, CASE WHEN over_budget THEN 'TOOL_ERROR' ELSE status END AS status,
  CASE WHEN over_budget THEN 'scan OVER_BUDGET ' || {quoted('bytes_scanned')} ELSE detail END AS detail,
  CASE WHEN over_budget THEN NULL ELSE verdict END AS verdict, CASE WHEN over_budget THEN NULL ELSE accepts END AS accepts,
  CASE WHEN over_budget THEN NULL ELSE rejects END AS rejects, bytes_scanned, over_budget
FROM (SELECT f.*, b.bytes_scanned, b.bytes_scanned > 50000 AS over_budget
      FROM findings f LEFT JOIN budget b USING (request_id))""")
cte("all_episodes", ["flows"], """
SELECT dstaddr, dstport, cast(episode AS BIGINT) AS episode, min(action) AS action, min(start) AS started, max(start) AS stopped,
  count(*) AS n_flows FROM (
  SELECT *, sum(new) OVER (PARTITION BY dstaddr, dstport ORDER BY start, srcaddr, srcport, interface_id, action
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS episode FROM (
    SELECT *, CASE WHEN lag(action) OVER (PARTITION BY dstaddr, dstport
                                          ORDER BY start, srcaddr, srcport, interface_id, action) = action
                   THEN 0 ELSE 1 END AS new
    FROM flows WHERE action IN ('ACCEPT', 'REJECT') AND dstaddr IS NOT NULL AND dstport IS NOT NULL))
GROUP BY dstaddr, dstport, episode""")
query("reject_episodes", ["all_episodes"], "SELECT * FROM all_episodes")
query("no_data_reason", ["findings"], """
SELECT request_id, hi AS window_hi, as_of_epoch,
  CASE WHEN as_of_epoch - hi < 1200 THEN 'TOO_RECENT' ELSE 'NO_TRAFFIC' END AS reason
FROM findings WHERE status = 'OK' AND verdict = 'NO_DATA'""")
query("all_clear", ["findings", "flows"], """
SELECT request_id, focus_ip AS source, seen, verdict,
  CASE WHEN NOT seen THEN 'NEVER_SEEN' WHEN verdict = 'ALL_ACCEPT' THEN 'ALL_ACCEPT' ELSE 'AWS_SIDE_EVIDENCE' END AS reason,
  (NOT seen OR verdict = 'ALL_ACCEPT') AS hand_off
FROM (SELECT f.*, f.focus_ip IN (SELECT srcaddr FROM flows WHERE srcaddr IS NOT NULL) AS seen
      FROM findings f WHERE status = 'OK' AND direction = 'from' AND focus_ip IS NOT NULL)""")
query("all_findings", ["findings", "pf"], """
SELECT 'request' AS source, request_id AS source_id, tool, verdict, finding_id FROM findings WHERE status = 'OK'
UNION ALL
SELECT 'probe' AS source, probe_id AS source_id, tool, verdict, finding_id FROM pf WHERE status = 'OK'""")

# ---------------------------------------------------------------- sources, streams
query("flow_text_roundtrip", ["flows"], "SELECT * FROM flows")
query("flows_by_day", ["flows"], """
SELECT day, count(*) AS records, count(CASE WHEN action = 'ACCEPT' THEN 1 END) AS accepts,
  count(CASE WHEN action = 'REJECT' THEN 1 END) AS rejects, count(CASE WHEN log_status = 'NODATA' THEN 1 END) AS nodata,
  count(DISTINCT dstaddr) AS destinations FROM flows GROUP BY day""")
query("flow_ingest_late", ["flows"], "SELECT * FROM flows")
query("requests_from_json", ["requests"], """
SELECT request_id, ip, direction, port, cast(port AS VARCHAR) AS port_text, protocol, action, window_minutes, start_time, end_time, as_of_epoch
FROM requests""")
query("stream_minute_counts", ["flows"], """
SELECT minute_start, minute_start + 60 AS minute_end, count(*) AS flows,
  count(CASE WHEN action = 'ACCEPT' THEN 1 END) AS accepts, count(CASE WHEN action = 'REJECT' THEN 1 END) AS rejects
FROM (SELECT *, start // 60 * 60 AS minute_start FROM flows)
WHERE minute_start + 60 <= (SELECT max(start) FROM flows) - 1200
GROUP BY minute_start""")
query("stream_reject_sessions", ["flows"], """
SELECT dstaddr, dstport, min(start) AS session_start, max(start) + 300 AS session_end, count(*) AS rejects,
  min(start) AS first_start, max(start) AS last_start FROM (
  SELECT *, sum(nw) OVER (PARTITION BY dstaddr, dstport ORDER BY start ROWS UNBOUNDED PRECEDING) AS sid FROM (
    SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY dstaddr, dstport ORDER BY start) <= 300 THEN 0 ELSE 1 END AS nw
    FROM flows WHERE action = 'REJECT' AND dstaddr IS NOT NULL AND dstport IS NOT NULL))
GROUP BY dstaddr, dstport, sid
HAVING max(start) + 300 <= (SELECT max(start) FROM flows) - 1200""")

query("findings_sink", ["findings"], f"SELECT {FINDING_FLAT} FROM findings")
cte("tp_nest", ["peers"], """
SELECT request_id, list({'peer': peer, 'flows': flows, 'rejects': rejects} ORDER BY rank) AS top_peers FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY flows DESC, peer ASC NULLS LAST) AS rank FROM peers)
WHERE rank <= 10 GROUP BY request_id""")
cte("tq_nest", ["ports"], """
SELECT request_id, list({'dstport': dstport, 'flows': flows} ORDER BY rank) AS top_ports FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY flows DESC, dstport ASC NULLS LAST) AS rank FROM ports)
WHERE rank <= 10 GROUP BY request_id""")
query("finding_json", ["findings", "tp_nest", "tq_nest"], """
SELECT f.request_id, to_json({
  'tool': f.tool,
  'scope': CASE WHEN f.status IS NOT NULL THEN {'focus_ip': f.focus_ip, 'direction': f.direction, 'dstport': f.dstport,
    'protocol': f.protocol, 'action': f.action, 'window_start': f.window_start, 'window_end': f.window_end,
    'window_minutes': f.window_minutes} END,
  'accepts': f.accepts, 'rejects': f.rejects, 'first_reject': f.first_reject, 'last_reject': f.last_reject,
  'last_reject_end': f.last_reject_end,
  'top_peers': CASE WHEN f.status = 'OK' THEN coalesce(p.top_peers, []) END,
  'top_ports': CASE WHEN f.status = 'OK' THEN coalesce(q.top_ports, []) END,
  'verdict': f.verdict, 'remediation_hint': f.remediation_hint, 'finding_id': f.finding_id,
  'status': f.status, 'detail': f.detail})::VARCHAR AS json
FROM findings f LEFT JOIN tp_nest p USING (request_id) LEFT JOIN tq_nest q USING (request_id)""")

# ---------------------------------------------------------------- investigations over time, addresses and both directions
KEY5 = "client, client_port, server, server_port, protocol"
cte("two_way", ["flows"], fixtures.render_two_way("duckdb", "flows"))
cte("oriented", ["two_way"], """
SELECT CASE WHEN fwd THEN srcaddr ELSE dstaddr END AS client, CASE WHEN fwd THEN srcport ELSE dstport END AS client_port,
  CASE WHEN fwd THEN dstaddr ELSE srcaddr END AS server, CASE WHEN fwd THEN dstport ELSE srcport END AS server_port, protocol,
  CASE WHEN fwd THEN 'F' ELSE 'R' END AS way, start AS started, greatest(start, coalesce("end", start)) AS ended, action
FROM (SELECT *, dstport < srcport OR (dstport = srcport AND srcaddr <= dstaddr) AS fwd FROM two_way)
WHERE srcaddr IS NOT NULL AND dstaddr IS NOT NULL AND srcport IS NOT NULL AND dstport IS NOT NULL AND protocol IS NOT NULL
  AND action IN ('ACCEPT', 'REJECT')""")
cte("sessions", ["oriented"], f"""
SELECT {KEY5}, way, min(started) AS started, max(ended) AS ended, count(*) FILTER (action = 'ACCEPT') AS accepts,
  count(*) FILTER (action = 'REJECT') AS rejects
FROM (SELECT *, sum(CASE WHEN started <= latest + 120 THEN 0 ELSE 1 END) OVER (PARTITION BY {KEY5}, way ORDER BY started, ended
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
      FROM (SELECT *, max(ended) OVER (PARTITION BY {KEY5}, way ORDER BY started, ended ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest
            FROM oriented))
GROUP BY {KEY5}, way, run""")
query("return_path", ["sessions"], f"""
SELECT f.client, f.client_port, f.server, f.server_port, f.protocol, f.started, f.ended, f.accepts, f.rejects, r.reply_started, r.reply_ended,
  r.reply_accepts, r.reply_rejects, CASE WHEN f.accepts = 0 THEN 'FORWARD_BLOCKED' WHEN r.reply_started IS NULL THEN 'ONE_WAY'
    WHEN r.reply_accepts = 0 THEN 'RETURN_BLOCKED' ELSE 'BOTH' END AS label
FROM (SELECT * FROM sessions WHERE way = 'F') f
LEFT JOIN (
  SELECT {KEY5}, f_started, min(started) AS reply_started, arg_min(ended, started) AS reply_ended, arg_min(accepts, started) AS reply_accepts,
    arg_min(rejects, started) AS reply_rejects
  FROM (SELECT b.*, max(a.started) AS f_started, arg_max(a.ended, a.started) AS f_ended
        FROM (SELECT * FROM sessions WHERE way = 'R') b JOIN (SELECT * FROM sessions WHERE way = 'F') a USING ({KEY5})
        WHERE a.started - 5 <= b.started GROUP BY ALL)
  WHERE started <= f_ended + 120 GROUP BY {KEY5}, f_started) r
ON f.client = r.client AND f.client_port = r.client_port AND f.server = r.server AND f.server_port = r.server_port AND f.protocol = r.protocol
  AND f.started = r.f_started""")


def ip_bits(x: str) -> str:
    """128 binary digits of an IP literal, written out group by group."""
    v6 = f"CASE WHEN {is_ipv4(x)} THEN '::ffff:' || {x} ELSE lower({x}) END"
    tail = f"CASE WHEN contains(t, '.') THEN regexp_replace(t, '[^:]*$', '') || printf('%x:%x', try_cast(split_part(q, '.', 1) AS INTEGER) * 256 + try_cast(split_part(q, '.', 2) AS INTEGER), " \
           f"try_cast(split_part(q, '.', 3) AS INTEGER) * 256 + try_cast(split_part(q, '.', 4) AS INTEGER)) ELSE t END"
    four = "list_transform(range(1, 17), lambda k: printf('%s', CASE WHEN (try_cast('0x' || h AS BIGINT) >> (16 - k)::bigint) & 1 = 1 THEN '1' ELSE '0' END))"
    groups = ("CASE WHEN contains(s, '::') THEN list_concat(l, list_concat(list_transform(range(8 - len(l) - len(r)), lambda z: '0'), r)) "
              "ELSE string_split(s, ':') END")
    return (f"(SELECT CASE WHEN {is_ip(x)} THEN (SELECT list_aggregate(list_transform(g, lambda h: list_aggregate({four}, 'string_agg', '')), 'string_agg', '') "
            f"FROM (SELECT {groups} AS g FROM (SELECT s, list_filter(string_split(split_part(s, '::', 1), ':'), lambda z: z <> '') AS l, "
            f"list_filter(string_split(split_part(s, '::', 2), ':'), lambda z: z <> '') AS r "
            f"FROM (SELECT {tail} AS s FROM (SELECT {v6} AS t, regexp_extract({v6}, '[^:]*$') AS q))))) END)")


_rows = ", ".join(f"('{p}', '{n}')" for p, n in _PR.PREFIXES)
cte("prefixes", [], f"""
SELECT label, length, bits[1:length] AS digits FROM (
  SELECT label, bits, try_cast(given AS INTEGER) + 128 - width AS length, try_cast(given AS INTEGER) AS g, width FROM (
    SELECT label, {ip_bits("split_part(prefix, '/', 1)")} AS bits, CASE WHEN contains(prefix, ':') THEN 128 ELSE 32 END AS width,
      CASE WHEN contains(prefix, '/') THEN split_part(prefix, '/', 2) WHEN contains(prefix, ':') THEN '128' ELSE '32' END AS given
    FROM (VALUES {_rows}) v(prefix, label)))
WHERE bits IS NOT NULL AND g BETWEEN 0 AND width""")
cte("addr_bits", ["flows", "requests"], f"""
SELECT addr, {ip_bits('addr')} AS bits FROM (SELECT DISTINCT addr FROM (
{fixtures.render_addresses('flows', 'requests')}))""")
query("boundary_prefix", ["addr_bits", "prefixes"], f"""
SELECT addr, CASE WHEN bits IS NULL THEN NULL WHEN {is_ipv4('addr')} THEN 4 ELSE 6 END AS family,
  CASE WHEN {is_ipv4('addr')} THEN greatest(length - 96, 0) ELSE length END AS prefix_length,
  CASE WHEN bits IS NULL THEN 'UNKNOWN' ELSE coalesce(label, 'PUBLIC') END AS label
FROM addr_bits a LEFT JOIN LATERAL (
  SELECT length, min(label) AS label FROM prefixes p WHERE starts_with(a.bits, p.digits) GROUP BY length ORDER BY length DESC LIMIT 1) p ON true""")

cte("cause_rows", ["matched"], "SELECT * FROM matched WHERE action IN ('ACCEPT', 'REJECT')")
cte("cause_sums", ["cause_rows"], """
SELECT request_id, count(*) FILTER (action = 'ACCEPT') AS accepts, count(*) FILTER (action = 'REJECT') AS rejects
FROM cause_rows GROUP BY request_id HAVING accepts > 0 AND rejects > 0""")
cte("cause_splits", ["cause_rows", "cause_sums"], """
SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY wrong, second, turn) AS place FROM (
  SELECT s.request_id, s.second, t.turn,
    (SELECT count(*) FROM cause_rows r WHERE r.request_id = s.request_id
      AND (r.action = 'REJECT') <> (CASE WHEN t.turn = 'BLOCKED_FROM' THEN r.start >= s.second ELSE r.start < s.second END)) AS wrong
  FROM (SELECT DISTINCT request_id, start AS second FROM cause_rows JOIN cause_sums USING (request_id)
        QUALIFY start > min(start) OVER (PARTITION BY request_id)) s,
       (VALUES ('BLOCKED_FROM'), ('OPENED_FROM')) t(turn))""")
query("intermittent_cause", ["cause_sums", "cause_splits"], """
SELECT request_id, accepts, rejects, time_wrong, port_wrong, peer_wrong, split_second, turn, wrong,
  CASE WHEN 2 * wrong > least(accepts, rejects) THEN 'MIXED' WHEN time_wrong = wrong THEN 'TIME' WHEN port_wrong = wrong THEN 'PORT'
    ELSE 'PEER' END AS label
FROM (SELECT c.*, p.port_wrong, e.peer_wrong, s.second AS split_second, s.turn, coalesce(s.wrong, least(accepts, rejects)) AS time_wrong,
        least(coalesce(s.wrong, least(accepts, rejects)), p.port_wrong, e.peer_wrong) AS wrong
      FROM cause_sums c LEFT JOIN (SELECT * FROM cause_splits WHERE place = 1) s USING (request_id)
      JOIN (SELECT request_id, cast(sum(w) AS BIGINT) AS port_wrong FROM (
              SELECT request_id, least(count(*) FILTER (action = 'ACCEPT'), count(*) FILTER (action = 'REJECT')) AS w
              FROM cause_rows GROUP BY request_id, dstport) GROUP BY request_id) p USING (request_id)
      JOIN (SELECT request_id, cast(sum(w) AS BIGINT) AS peer_wrong FROM (
              SELECT request_id, least(count(*) FILTER (action = 'ACCEPT'), count(*) FILTER (action = 'REJECT')) AS w
              FROM cause_rows GROUP BY request_id, peer) GROUP BY request_id) e USING (request_id))""")

cte("rejections", ["all_episodes"], f"""
SELECT *, concat_ws('|', dstaddr, dstport, episode) AS id, stopped - started > {_PR.STANDING_S} AS standing FROM all_episodes WHERE action = 'REJECT'""")
query("incidents", ["rejections"], """
SELECT standing, min(id) AS first_episode, min(started) AS started, max(stopped) AS stopped, count(*) AS episodes,
  count(DISTINCT dstaddr) AS addresses, count(DISTINCT dstport) AS ports, cast(sum(n_flows) AS BIGINT) AS rejects
FROM rejections JOIN (
  WITH RECURSIVE edges AS (
    SELECT a.id AS a, b.id AS b FROM rejections a JOIN rejections b ON NOT a.standing AND NOT b.standing
      AND (a.dstaddr = b.dstaddr OR a.dstport = b.dstport) AND a.started <= b.stopped AND b.started <= a.stopped),
  reach(id, other) AS (SELECT id, id FROM rejections UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.other = e.a)
  SELECT id, min(other) AS root FROM reach GROUP BY id) USING (id)
GROUP BY standing, root""")

cte("answer_rows", ["dns"], f"""
SELECT host, ip, probed_at, probe_id, list_max(list_transform(list_filter(kept, lambda r: r.value = ip), lambda r: r.ttl::bigint)) AS ttl
FROM (SELECT host, probed_at, probe_id, CASE WHEN dns_status = 'NOERROR' THEN records ELSE [] END AS kept FROM dns)
JOIN (SELECT DISTINCT host, r.value AS ip FROM (SELECT host, unnest(records) AS r FROM dns WHERE dns_status = 'NOERROR') WHERE {is_ip('r.value')})
USING (host)""")
cte("answer_versions", ["answer_rows"], """
SELECT host, ip, version, present, since, dies, lead(since) OVER (PARTITION BY host, ip ORDER BY version) AS next FROM (
  SELECT host, ip, version, bool_or(ttl IS NOT NULL) AS present, min(probed_at) AS since, max(probed_at + ttl) AS dies FROM (
    SELECT *, sum(new) OVER (PARTITION BY host, ip ORDER BY probed_at, probe_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS version FROM (
      SELECT *, CASE WHEN lag(ttl IS NOT NULL) OVER (PARTITION BY host, ip ORDER BY probed_at, probe_id) = (ttl IS NOT NULL) THEN 0 ELSE 1 END AS new
      FROM answer_rows))
  GROUP BY host, ip, version)""")
query("stale_address_flows", ["answer_versions", "flows"], """
SELECT host, ip, state, since, until, count(*) AS flows, count(*) FILTER (f.action = 'REJECT') AS rejects, min(f.start) AS first_flow,
  max(f.start) AS last_flow
FROM (SELECT host, ip, 'EXPIRED' AS state, dies AS since, next AS until FROM answer_versions WHERE present AND (next IS NULL OR next > dies)
      UNION ALL SELECT host, ip, 'LEFT', since, next FROM answer_versions WHERE NOT present AND version > 1) v
JOIN flows f ON f.dstaddr = v.ip AND f.start >= v.since AND (v.until IS NULL OR f.start < v.until)
GROUP BY host, ip, state, since, until""")

query("flow_ingest_corrected", ["flows"], "SELECT * FROM flows")
query("probe_finding_json", ["gated", "dnsf", "tcp", "ping", "trace"], """
SELECT g.probe_id, CASE WHEN g.status <> 'OK' THEN to_json({'tool': g.tool, 'host': g.host, 'status': g.status, 'detail': g.detail})
  WHEN g.tool = 'resolve_dns' THEN to_json({'tool': g.tool, 'host': g.host, 'dns_status': d.dns_status, 'resolved_ip': d.resolved_ip,
    'records': d.records, 'resolver': d.resolver, 'query_ms': d.query_ms, 'finding_id': d.finding_id})
  WHEN g.tool = 'tcp_reachability' THEN to_json({'tool': g.tool, 'target': t.target, 'host': g.host, 'port': g.port, 'reachable': t.reachable,
    'verdict': t.verdict, 'evidence': t.evidence, 'remediation_hint': t.remediation_hint, 'finding_id': t.finding_id})
  WHEN g.tool = 'ping_host' THEN to_json({'tool': g.tool, 'host': g.host, 'packets_sent': p.packets_sent,
    'packets_received': p.packets_received, 'loss_pct': p.loss_pct, 'rtt_avg_ms': p.rtt_avg_ms, 'reachable': p.reachable, 'verdict': p.verdict,
    'finding_id': p.finding_id})
  ELSE to_json({'tool': g.tool, 'host': g.host, 'hops': r.hops, 'hop_count': r.hop_count, 'last_responding_hop': r.last_responding_hop,
    'verdict': r.verdict, 'finding_id': r.finding_id}) END::VARCHAR AS json
FROM gated g LEFT JOIN dnsf d USING (probe_id) LEFT JOIN tcp t USING (probe_id) LEFT JOIN ping p USING (probe_id)
LEFT JOIN trace r USING (probe_id)""")

# The same SQL over a crowded three hours (every label, more than ten ports and twenty groups in a question).
_busy = {"flows": fixtures.render_busy_flows("duckdb", f"({fixtures.render('flows', 'duckdb')}) f"),
         "requests": fixtures.render_busy_requests("duckdb")}
for _key in ("batch_flow_verdicts", "groups_topn", "top_peers", "top_ports", "all_clear", "requests_without_flows"):
    query(f"busy_{_key}", *PARTS[_key], overrides=_busy)
query("flow_ingest_stream", ["flows"], "SELECT * FROM flows")
query("stream_day_sizes", ["flows"], f"""
SELECT day, count(*) AS records, cast(sum(strlen({LINE}) + 1) AS BIGINT) AS day_bytes FROM flows GROUP BY day""")
