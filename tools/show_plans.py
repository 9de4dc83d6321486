"""Print the physical plans of the headline queries over a day-partitioned flow table.

usage: python tools/show_plans.py [sf_dir]   (default /root/testdata/sf0.01)
"""

from __future__ import annotations

import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])


def main(argv):
    from flowlens.operators import diagnose as DG
    from flowlens.operators import flows as FL
    from flowlens.operators import probes as PB
    from flowlens.plans import params as PR
    from flowlens.session import get_spark, scratch_path
    from flowlens.sources import flowlogs as FLG
    from flowlens.sources import inputs as IN

    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark()
    table = scratch_path(spark, "plans-flows")
    FLG.write_flows_table(IN.flows(spark, sf), table)
    flows = spark.read.parquet(table)
    plans = {
        "flow_verdict": lambda: FL.flow_verdict(spark, flows, **PR.MAIN_SCOPE),
        "batch_flow_verdicts": lambda: FL.batch_flow_verdicts(flows, IN.requests(spark, sf)),
        "probe_findings": lambda: PB.probe_findings(IN.probe_runs(spark, sf)),
        "reject_episodes": lambda: DG.reject_episodes(flows),
        "direction_correlation": lambda: DG.direction_correlation(flows),
    }
    for name, build in plans.items():
        print(f"\n======== {name}")
        build().explain("formatted")


if __name__ == "__main__":
    main(sys.argv)
