"""Network inputs derived from the driver's tables (FIXTURES.md section 2).

The same SQL text runs on Spark and on DuckDB; only three tokens differ. The
derivations are row-wise projections of ``events`` (no shuffle), so they scale
with the events table and keep its partitioning.
"""

from __future__ import annotations

TOKENS = {
    "spark": {
        "EPOCH": "unix_timestamp(ts)",
        "DAY": "date_format(ts,'yyyy/MM/dd')",
        "END": "`end`",
        "EVENTS": "{events}",
    },
    "duckdb": {
        "EPOCH": "cast(floor(epoch(ts)) as bigint)",
        "DAY": "strftime(ts,'%Y/%m/%d')",
        "END": '"end"',
        "EVENTS": "events",
    },
}

FLOWS = """
SELECT 2 AS version, '123456789012' AS account_id,
  concat('eni-', lpad(cast(event_id % 8 as string), 17, '0')) AS interface_id,
  CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 53 = 0 THEN concat('203.0.113.', cast(user_id % 24 + 1 as string)) ELSE concat('10.20.0.', cast(user_id % 24 + 1 as string)) END AS srcaddr,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE concat('10.20.1.', cast(event_id % 8 + 1 as string)) END AS dstaddr,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE cast(32768 + event_id % 28000 as int) END AS srcport,
  CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_type IN ('error','purchase') THEN 5432 WHEN event_type = 'click' THEN 80 WHEN event_type = 'view' THEN 443 ELSE 53 END AS dstport,
  cast(CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_type = 'signup' THEN 17 ELSE 6 END as bigint) AS protocol,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE cast(floor(value) as bigint) + 1 END AS packets,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE (cast(floor(value) as bigint) + 1) * 60 END AS bytes,
  <EPOCH> AS start, <EPOCH> + 60 AS <END>,
  CASE WHEN event_id % 97 = 0 THEN NULL
       WHEN event_id % 8 = 0 THEN 'REJECT'
       WHEN event_id % 8 = 1 THEN 'ACCEPT'
       WHEN event_type = 'error' THEN 'REJECT' ELSE 'ACCEPT' END AS action,
  CASE WHEN event_id % 97 = 0 THEN 'NODATA' ELSE 'OK' END AS log_status,
  'vpc-0a' AS vpc_id, concat('subnet-', cast(event_id % 2 as string)) AS subnet_id,
  CASE WHEN user_id % 24 < 3 THEN 'egress' WHEN event_id % 16 < 8 THEN 'ingress' ELSE 'egress' END AS flow_direction,
  <DAY> AS day
FROM <EVENTS>
"""

REQUESTS = """
SELECT event_id AS request_id,
  CASE event_id % 11 WHEN 3 THEN 'db.corp.internal' WHEN 4 THEN NULL ELSE concat('10.20.1.', cast(event_id % 8 + 1 as string)) END AS ip,
  CASE event_id % 7 WHEN 2 THEN 'from' WHEN 3 THEN 'sideways' ELSE 'to' END AS direction,
  CASE event_id % 10 WHEN 1 THEN NULL WHEN 2 THEN 70000 ELSE 5432 END AS port,
  CASE event_id % 6 WHEN 1 THEN 'tcp' WHEN 2 THEN 'GRE' END AS protocol,
  CASE event_id % 4 WHEN 1 THEN 'REJECT' WHEN 2 THEN 'reject' ELSE 'ALL' END AS action,
  CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 60 ELSE 500 END AS window_minutes,
  CASE event_id % 9 WHEN 1 THEN cast(<EPOCH> - 1800 as string) WHEN 2 THEN 'yesterday' WHEN 3 THEN NULL
    ELSE concat(replace(substring(cast(ts - interval '30' minute as string), 1, 19), ' ', 'T'), 'Z') END AS start_time,
  CASE event_id % 9 WHEN 3 THEN NULL ELSE
    CASE event_id % 13 WHEN 1 THEN NULL WHEN 2 THEN concat(replace(substring(cast(ts - interval '2' hour as string), 1, 19), ' ', 'T'), 'Z')
      ELSE concat(replace(substring(cast(ts + interval '30' minute as string), 1, 19), ' ', 'T'), 'Z') END END AS end_time,
  <EPOCH> + 3600 AS as_of_epoch
FROM <EVENTS> WHERE event_type = 'error'
"""

# Every question with one fault or oddity (the same text for Spark and DuckDB).
HOSTILE = """
SELECT request_id, CASE request_id % 11 WHEN 4 THEN 'db.internal' ELSE ip END AS ip, direction,
  cast(CASE request_id % 11 WHEN 5 THEN 70000 ELSE port END AS int) AS port,
  CASE request_id % 11 WHEN 6 THEN 'SCTP' ELSE protocol END AS protocol, action,
  cast(CASE request_id % 11 WHEN 7 THEN 600 WHEN 8 THEN -5 ELSE window_minutes END AS int) AS window_minutes,
  CASE request_id % 11 WHEN 0 THEN '1704067200000' WHEN 1 THEN '1704067200000000' WHEN 2 THEN '9223372036854775807'
    WHEN 3 THEN concat(chr(9), ' 1704067200', chr(10)) WHEN 9 THEN '2024-01-02T00:00:00Z' WHEN 7 THEN NULL WHEN 8 THEN NULL
    ELSE start_time END AS start_time,
  CASE request_id % 11 WHEN 3 THEN '1704069000' WHEN 9 THEN '2024-01-02T06:00:00Z' WHEN 7 THEN NULL WHEN 8 THEN NULL
    WHEN 10 THEN '99999999999999999999' ELSE end_time END AS end_time,
  CASE request_id % 11 WHEN 8 THEN CASE WHEN request_id % 2 = 0 THEN cast(9223372036854775807 AS bigint) END
    ELSE as_of_epoch END AS as_of_epoch
FROM <REQUESTS>
"""

PROBES = """
SELECT event_id AS probe_id, <EPOCH> AS probed_at,
  CASE event_id % 4 WHEN 0 THEN 'resolve_dns' WHEN 1 THEN 'tcp_reachability' WHEN 2 THEN 'ping_host' ELSE 'traceroute_host' END AS tool,
  host, CASE event_id % 8 WHEN 1 THEN 80 WHEN 5 THEN 5432 END AS port,
  CASE event_id % 4
  WHEN 0 THEN concat(';; ->>HEADER<<- opcode: QUERY, status: ',
      CASE WHEN event_type = 'error' OR user_id % 8 = 7 THEN 'NXDOMAIN' WHEN event_type = 'purchase' THEN 'SERVFAIL' ELSE 'NOERROR' END,
      ', id: ', cast(event_id as string), chr(10),
      CASE WHEN event_type IN ('error','purchase') OR user_id % 8 = 7 THEN ''
           WHEN event_type = 'click' THEN concat(host, '. 30 IN CNAME alias-', host, '.', chr(10), 'alias-', host, '. 60 IN A ', ip, chr(10))
           ELSE concat(host, '. 60 IN A ', ip, chr(10)) END,
      ';; Query time: ', cast(user_id % 40 as string), ' msec', chr(10), ';; SERVER: 10.20.0.2#53(10.20.0.2)')
  WHEN 1 THEN concat('Ncat: Version 7.93 ( https://nmap.org/ncat )', chr(10),
      CASE WHEN user_id % 8 = 1 THEN 'Ncat: TIMEOUT.' WHEN user_id % 8 = 2 THEN 'Ncat: Connection refused.'
           WHEN event_type = 'click' AND user_id % 8 <> 0 THEN 'Ncat: Connection refused.' WHEN event_type = 'error' AND user_id % 8 <> 0 THEN 'Ncat: TIMEOUT.'
           WHEN event_type = 'signup' AND user_id % 8 <> 0 THEN 'Ncat: Network is unreachable.'
           ELSE concat('Ncat: Connected to ', ip, ':', CASE event_id % 8 WHEN 1 THEN '80' ELSE '5432' END, '.') END)
  WHEN 2 THEN CASE WHEN event_type = 'error' OR user_id % 8 = 1 THEN '4 packets transmitted, 0 received, 100% packet loss, time 3060ms'
      WHEN event_type = 'signup' THEN '4 packets transmitted, 0 received, +4 errors, 100% packet loss, time 3060ms'
      WHEN event_type = 'click' THEN concat('4 packets transmitted, 3 received, 25% packet loss, time 3004ms', chr(10), 'rtt min/avg/max/mdev = 0.1/0.', cast(user_id % 9 + 1 as string), '/1.9/0.05 ms')
      ELSE concat('4 packets transmitted, 4 received, 0% packet loss, time 3004ms', chr(10), 'rtt min/avg/max/mdev = 0.1/0.', cast(user_id % 9 + 1 as string), '/1.9/0.05 ms') END
  ELSE concat('traceroute to ', ip, ' (', ip, '), 8 hops max, 60 byte packets', chr(10), ' 1  10.20.0.1  0.345 ms', chr(10), ' 2  *', chr(10),
      CASE WHEN event_type = 'error' THEN ' 3  *' WHEN event_type = 'click' THEN concat(' 3  ', ip, '  1.5 ms !X') ELSE concat(' 3  ', ip, '  1.25 ms') END)
  END AS raw
FROM (SELECT *, concat('db', cast(user_id % 8 as string), '.corp.internal') AS host,
             concat('10.20.1.', cast(user_id % 8 + 1 as string)) AS ip FROM <EVENTS>) e
"""

# Probe runs as the run service reports them: separate stdout/stderr and a
# run status. ncat writes to stderr, the other tools to stdout. A small share of
# runs did not complete cleanly.
PROBE_RUNS = """
SELECT probe_id, probed_at, tool, host, port,
  CASE WHEN tool = 'tcp_reachability' THEN '' ELSE raw END AS stdout,
  CASE WHEN tool = 'tcp_reachability' THEN raw ELSE '' END AS stderr,
  CASE probe_id % 17 WHEN 5 THEN 'TimedOut' WHEN 6 THEN 'Failed' WHEN 7 THEN 'Cancelled' ELSE 'Success' END AS run_status,
  CASE probe_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 31 ELSE cast(probe_id % 40 as int) END AS max_hops
FROM <PROBES>
"""

# Flows and the replies to them: most come back, some are rejected on the way back, some never come; one connection
# (10.20.0.9:40000 to 10.20.1.3:443) carries a sixteenth of all records.
TWO_WAY = """
SELECT srcaddr, dstaddr, srcport, dstport, protocol, start, <END>, action FROM <CALLS>
UNION ALL
SELECT dstaddr AS srcaddr, srcaddr AS dstaddr, dstport AS srcport, srcport AS dstport, protocol, start + 1 + start % 3 AS start,
  <END> + 1 + start % 3 AS <END>, CASE WHEN start % 5 = 1 THEN 'REJECT' ELSE 'ACCEPT' END AS action
FROM <CALLS> WHERE start % 7 <> 3
"""
CALLS = """
SELECT CASE WHEN hot THEN '10.20.0.9' ELSE srcaddr END AS srcaddr, dstaddr, cast(CASE WHEN hot THEN 40000 ELSE srcport END AS int) AS srcport,
  cast(CASE WHEN hot THEN 443 ELSE dstport END AS int) AS dstport, cast(CASE WHEN hot THEN 6 ELSE protocol END AS bigint) AS protocol,
  start, <END>, action
FROM (SELECT *, dstaddr = '10.20.1.3' AND srcport % 2 = 0 AS hot FROM <FLOWS>) f
"""

# Traces over three hops of routers; errors stop somewhere on the way, some hops never answer.
TRACES = """
SELECT event_id AS probe_id, <EPOCH> AS probed_at, 'traceroute_host' AS tool, concat('db', cast(user_id % 8 AS string), '.corp.internal') AS host,
  cast(NULL AS int) AS port, concat('traceroute to 10.20.1.', cast(user_id % 8 + 1 AS string), ', 8 hops max', chr(10), ' 1  ',
    CASE WHEN event_id % 9 = 0 THEN '*' ELSE '10.20.0.1  0.3 ms' END, chr(10), ' 2  ',
    CASE WHEN failed AND event_id % 4 = 0 THEN '*' ELSE concat('10.21.', cast(user_id % 2 AS string), '.1  0.8 ms') END, chr(10), ' 3  ',
    CASE WHEN failed AND event_id % 4 < 2 OR event_id % 7 = 0 THEN '*' ELSE concat('10.22.', cast(user_id % 4 AS string), '.1  1.1 ms') END, chr(10), ' 4  ',
    CASE WHEN failed THEN '*' ELSE concat('10.20.1.', cast(user_id % 8 + 1 AS string), '  1.5 ms') END) AS raw
FROM (SELECT *, event_type = 'error' AND user_id % 8 < 5 AS failed FROM <EVENTS>) e
"""

# Addresses of flows and questions, IPv6 addresses of the same hosts, mapped IPv4 and other text.
ADDRESSES = """
SELECT srcaddr AS addr FROM <FLOWS> UNION ALL SELECT dstaddr FROM <FLOWS> UNION ALL SELECT ip FROM <REQUESTS>
UNION ALL SELECT concat('2001:DB8:', cast(srcport % 8 AS string), '::', cast(srcport % 500 AS string)) FROM <FLOWS> WHERE srcport IS NOT NULL
UNION ALL SELECT concat('::ffff:', dstaddr) FROM <FLOWS> WHERE dstaddr IS NOT NULL
UNION ALL SELECT concat('fe80:0:0:', cast(srcport % 90 AS string), ':1:2:3:4') FROM <FLOWS> WHERE srcport IS NOT NULL
"""


# All flows folded into three hours, over forty ports, and questions on them: to an address, from one, or on a port only.
BUSY_FLOWS = """
SELECT version, account_id, interface_id, srcaddr, dstaddr, srcport,
  cast(CASE WHEN dstport IS NULL THEN NULL ELSE 8000 + least(srcport % 40, srcport % 23) END AS int) AS dstport, protocol, packets, bytes,
  1705305600 + start % 10680 AS start, 1705305660 + start % 10680 AS <END>, action, log_status, vpc_id, subnet_id, flow_direction,
  '2024/01/15' AS day
FROM <FLOWS>
"""
BUSY_REQUESTS = """
SELECT request_id, CASE kind WHEN 0 THEN concat('10.20.1.', cast(cast((request_id - kind) / 3 AS bigint) % 9 + 1 AS string))
    WHEN 1 THEN concat('10.20.0.', cast(request_id % 30 + 1 AS string)) END AS ip,
  CASE kind WHEN 1 THEN 'from' ELSE 'to' END AS direction, cast(CASE kind WHEN 2 THEN 8000 + request_id % 25 END AS int) AS port,
  'tcp' AS protocol, CASE request_id % 5 WHEN 4 THEN 'REJECT' ELSE 'ALL' END AS action, cast(NULL AS int) AS window_minutes,
  '2024-01-15T08:00:00Z' AS start_time, CASE request_id % 2 WHEN 0 THEN '2024-01-15T10:58:00Z' ELSE '2024-01-15T08:40:00Z' END AS end_time,
  cast(1705320000 AS bigint) AS as_of_epoch
FROM (SELECT DISTINCT cast(user_id % 90 AS bigint) AS request_id, user_id % 3 AS kind FROM <EVENTS>) q
"""


def render_busy_flows(dialect: str, flows_ref: str) -> str:
    return BUSY_FLOWS.replace("<END>", TOKENS[dialect]["END"]).replace("<FLOWS>", flows_ref).strip()


def render_busy_requests(dialect: str) -> str:
    return BUSY_REQUESTS.replace("<EVENTS>", TOKENS[dialect]["EVENTS"]).strip()


def render_two_way(dialect: str, flows_ref: str) -> str:
    end = TOKENS[dialect]["END"]
    calls = CALLS.replace("<END>", end).replace("<FLOWS>", flows_ref)
    return TWO_WAY.replace("<END>", end).replace("<CALLS>", f"({calls}) c").strip()


def render_addresses(flows_ref: str, requests_ref: str) -> str:
    return ADDRESSES.replace("<FLOWS>", flows_ref).replace("<REQUESTS>", requests_ref).strip()


TEMPLATES = {"traces": TRACES, "flows": FLOWS, "requests": REQUESTS, "probes": PROBES}


def render(name: str, dialect: str) -> str:
    sql = TEMPLATES[name]
    for k, v in TOKENS[dialect].items():
        sql = sql.replace(f"<{k}>", v)
    return sql.strip()


def render_probe_runs(dialect: str, probes_ref: str) -> str:
    return PROBE_RUNS.replace("<PROBES>", probes_ref).strip()
