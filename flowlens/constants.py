"""Fixed values that results depend on.

FIXED VALUES (must equal the behaviour being reproduced):
  - look-back window: default 60 minutes, at most 180 minutes
  - explicit-window padding: 60 seconds on each side
  - default explicit start when only an end is given: end - 3600 seconds
  - groups kept by the legacy top-N cut: 500
  - top peers / top ports per finding: 10
  - protocol names to IANA numbers: TCP 6, UDP 17, ICMP 1
  - actions: ACCEPT, REJECT, ALL (case-sensitive; anything else means ALL)
  - directions: to, from (anything else means to)
  - scan budget per query: 1073741824 bytes
  - traceroute max hops: 1..30, default 8
  - flow-log delivery lag considered "too recent": 1200 seconds
  - the probe network: 10.20.0.0/16; private ranges 10/8, 172.16/12, 192.168/16
"""

DEFAULT_WINDOW_MIN = 60
MAX_WINDOW_MIN = 180
MAX_EPOCH_S = 253_402_300_799  # 9999-12-31T23:59:59Z
PAD_S = 60
DEFAULT_EXPLICIT_SPAN_S = 3600
LEGACY_GROUP_LIMIT = 500
TOP_N = 10
PROTOCOLS = {"TCP": 6, "UDP": 17, "ICMP": 1}
ACTIONS = ("ACCEPT", "REJECT", "ALL")
DIRECTIONS = ("to", "from")
SCAN_CAP_BYTES = 1 << 30
MAX_HOPS_RANGE = (1, 30)
DEFAULT_MAX_HOPS = 8
RECENT_LAG_S = 1200
VPC_CIDR = ("10.20.0.0", 16)
PRIVATE_CIDRS = (("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16))

HOUR_S = 3600
DAY_FMT = "yyyy/MM/dd"
ISO_FMT = "yyyy-MM-dd'T'HH:mm:ss'Z'"

# Advice per verdict: (likely cause, next check) as codes; the facts of the row are added to them.
FLOW_ADVICE = {
    "NO_DATA": ("NO_RECORDS", "LIVE_PROBE"),
    "PERSISTENT_REJECT": ("FILTER_DENIES", "FILTER_RULES"),
    "INTERMITTENT": ("FILTER_CHANGED_OR_PARTIAL", "FIRST_REJECT_PEERS_PORTS"),
    "ALL_ACCEPT": ("NONE", "NONE"),
}
TCP_ADVICE = {
    "OPEN": ("NONE", "NONE"),
    "CONNECTION_REFUSED": ("NO_LISTENER", "SERVICE"),
    "CONNECTION_TIMEOUT": ("DROPPED_OR_HOST_DOWN", "FILTER_RULES_AND_PING"),
    "UNKNOWN": ("UNREADABLE", "EVIDENCE"),
}
