"""Fixed question parameters used by the single-question keys.

They name a question, the way a user would ask the reference tool; the data
under them is the whole derived flow table.
"""

MAIN_SCOPE = dict(request_id=0, ip="10.20.1.1", direction="to", port=5432, protocol="TCP",
                  action="ALL", window_minutes=None, start_time="2024-01-15T08:00:00Z",
                  end_time="2024-01-15T10:58:00Z", as_of_epoch=1705500000)
FILTER_DAYS = ("2024/01/15", "2024/01/16")
FILTER_LO = 1705305600   # 2024-01-15T08:00:00Z
FILTER_HI = 1705316400   # 2024-01-15T11:00:00Z
ALL_DIMS_LO = 1705276800  # 2024-01-15T00:00:00Z (the conjunction key spans both filter days)
ALL_DIMS_HI = 1705449599  # 2024-01-16T23:59:59Z
FOCUS_TO_IP = "10.20.1.3"
FOCUS_FROM_IP = "10.20.0.5"
FILTER_PORT = 5432
FILTER_PROTOCOL = "udp"
FILTER_ACTION = "REJECT"
TOP_GROUPS_N = 20
# A small budget for budgeted_verdicts, so that some questions of the small tables exceed it.
KEY_BUDGET_BYTES = 50_000
# Who owns which addresses: nested prefixes, single addresses, IPv6, one in the mapped form, and rows that cannot be read.
PREFIXES = (
    ("10.0.0.0/8", "ON_PREM"), ("10.20.0.0/16", "OWN"), ("10.20.1.0/29", "OWN_DB"), ("10.20.0.16/28", "PEERED"), ("10.20.0.5", "BASTION"),
    ("203.0.113.0/28", "PARTNER"), ("2001:db8::/32", "OWN"), ("2001:db8:3::/48", "PEERED"), ("2001:db8:3::100/120", "OWN_DB"),
    ("2001:0DB8:0005:0000::0040/124", "PARTNER"), ("fe80::/10", "LINK_LOCAL"), ("::ffff:10.20.1.7/128", "MAPPED"), ("10.20.1.7/32", "ZZ"),
    ("10.20.1.0/33", "BAD"), ("db.corp.internal", "BAD"), ("2001:db8::/", "BAD"))
STANDING_S = 6 * 3600  # a rejection longer than this is a standing rule, an incident of its own
