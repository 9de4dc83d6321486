"""Two-way stitching of flows: does the reply of a connection come back? (M1 extended by ports and time)

A record goes *forward* when its destination port is the smaller of the two (the service port; at equal ports the smaller
address is the client), else it is a *reply*, so both have one key: client, client port, server, server port, protocol. The records of a
key and direction are joined to sessions (``SESSION_GAP_S`` after the latest end begins a new one). A reply session belongs to the
latest forward session that begins at most ``SLACK_S`` after it, if it begins before that one's end plus the gap; the first such
reply session is the partner, so a forward session has one partner at most and a reply session one owner.

Labels: FORWARD_BLOCKED when no forward record was accepted; else ONE_WAY without a partner, RETURN_BLOCKED when the partner
has no accepted record, BOTH otherwise. Records without an address, port, protocol or action are left out; a record whose end is
missing or before its start ends at its start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.intervals import islands
from flowlens.session import materialise

SESSION_GAP_S = 120
SLACK_S = 5
KEY = ["client", "client_port", "server", "server_port", "protocol"]


def oriented(flows: DataFrame) -> DataFrame:
    """Records with the connection's key, the direction (F or R) and accept / reject counts."""
    f = flows.filter(F.expr("srcaddr is not null and dstaddr is not null and srcport is not null and dstport is not null and protocol is not null")
                     & F.col("action").isin("ACCEPT", "REJECT") & F.col("start").isNotNull())
    forward = (F.col("dstport") < F.col("srcport")) | ((F.col("dstport") == F.col("srcport")) & (F.col("srcaddr") <= F.col("dstaddr")))

    def pick(a, b, name):
        return F.when(forward, F.col(a)).otherwise(F.col(b)).alias(name)

    return f.select(pick("srcaddr", "dstaddr", "client"), pick("srcport", "dstport", "client_port"), pick("dstaddr", "srcaddr", "server"),
                    pick("dstport", "srcport", "server_port"), "protocol", F.when(forward, "F").otherwise("R").alias("way"),
                    F.col("start").alias("started"), F.greatest("start", F.coalesce("end", "start")).alias("ended"),
                    (F.col("action") == "ACCEPT").cast("bigint").alias("accepts"), (F.col("action") == "REJECT").cast("bigint").alias("rejects"))


def sessions(flows: DataFrame, gap_s: int = SESSION_GAP_S) -> DataFrame:
    """Sessions per key and direction: started, ended, accepts, rejects."""
    return islands(oriented(flows), [*KEY, "way"], "started", "ended", gap_s, ("accepts", "rejects"))


def return_path(flows: DataFrame, gap_s: int = SESSION_GAP_S, slack_s: int = SLACK_S) -> DataFrame:
    """One row per forward session: its counts, its partner's, and the label."""
    s = materialise(sessions(flows, gap_s), "sessions")
    # every reply session looks back to the latest forward session: forward rows take effect slack_s before they begin
    at = F.when(F.col("way") == "F", F.col("started") - slack_s).otherwise(F.col("started"))
    w = Window.partitionBy(*KEY).orderBy("at", "way").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    forward = F.when(F.col("way") == "F", F.struct(F.col("started").alias("f_started"), F.col("ended").alias("f_ended")))
    owned = s.withColumn("at", at).withColumn("f", F.last(forward, ignorenulls=True).over(w))
    reply = owned.filter((F.col("way") == "R") & F.col("f").isNotNull() & (F.col("started") <= F.col("f.f_ended") + gap_s))
    first = reply.groupBy(*KEY, F.col("f.f_started").alias("started")).agg(
        F.min(F.struct(F.col("started").alias("reply_started"), F.col("ended").alias("reply_ended"), F.col("accepts").alias("reply_accepts"),
                       F.col("rejects").alias("reply_rejects"))).alias("r"))
    label = (F.when(F.col("accepts") == 0, "FORWARD_BLOCKED").when(F.col("r").isNull(), "ONE_WAY")
              .when(F.col("r.reply_accepts") == 0, "RETURN_BLOCKED").otherwise("BOTH"))
    return s.filter("way = 'F'").drop("way").join(first, [*KEY, "started"], "left").select(
        *KEY, "started", "ended", "accepts", "rejects", "r.*", label.alias("label"))
