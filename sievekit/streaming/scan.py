"""The line scan and the gap clusters over streams of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sievekit.operators.lines import lines_of, rule_hits


def stream_findings(texts: DataFrame, rules: list[dict], id_col: str, text_col: str, *keep: str) -> DataFrame:
    """Findings of each text as it comes: no state."""
    return rule_hits(lines_of(texts, id_col, text_col, *keep), rules)


def stream_new(findings: DataFrame, baseline: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Stream findings less a static baseline."""
    return findings.join(baseline.select(fingerprint), fingerprint, "left_anti")


def stream_clusters(events: DataFrame, keys: list[str], at: str, gap: str, late: str) -> DataFrame:
    """Rows of the same keys at most ``gap`` apart form a session: the clusters of the batch scan over event time.

    Rows later than ``late`` behind the watermark are left out, which bounds the state.
    """
    session = F.session_window(at, gap)
    out = events.withWatermark(at, late).groupBy(*keys, session.alias("session")).agg(F.count("*").alias("occurrence_count"), F.min(at).alias("cluster_start"), F.max(at).alias("cluster_end"))
    return out.drop("session")


def append_to(findings: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of Parquet files that goes on where it was after a restart."""
    return findings.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
