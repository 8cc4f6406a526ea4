"""quarry: a Spark-native findings-triage engine.

Every stage is a DataFrame -> DataFrame function: corpus filtering,
category fan-out, content-addressed keys and incremental anti-joins,
pluggable analysts, reply recovery, verdict overlay, allowlist
suppression, bucketing and roll-up reports.
"""

__version__ = "0.1.0"
