"""flowlens: network-forensics analytics on Spark DataFrames.

Questions (address, direction, port, protocol, action, time window) and probe
captures are tables; every verdict is a DataFrame job built from built-in
functions so Catalyst can push filters, prune columns and plan the shuffles.
"""

__version__ = "0.1.0"
