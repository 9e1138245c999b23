"""Reports as rows of JSON text, written with ``df.write.text`` or joined into one file by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievekit.operators.findings import SEVERITIES

#: Package-url types of ecosystems, SARIF levels of ranks.
PURL_TYPES = {"PyPI": "pypi", "npm": "npm", "Go": "golang", "Maven": "maven", "crates.io": "cargo", "RubyGems": "gem", "NuGet": "nuget", "Packagist": "composer"}
LEVELS = ["error", "error", "warning", "note", "note"]


def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[key]


def report_order() -> list[Column]:
    return [F.col(c) for c in ("sev_rank", "path", "line", "rule_id", "message")]


def json_findings(findings: DataFrame) -> DataFrame:
    """One JSON object a finding, in report order."""
    name = F.coalesce(F.get(F.array(*map(F.lit, SEVERITIES)), F.col("sev_rank")), F.lit("unknown"))
    return findings.withColumn("severity", name).orderBy(*report_order()).select(F.to_json(F.struct("severity", *findings.columns)).alias("value"))


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("sev_rank", "engine").agg(F.count("*").alias("findings"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """SARIF results; findings with a ``flow`` (array of path, line, snippet) carry it as a code flow."""
    place = lambda path, line: F.struct(
        F.struct(F.struct(path.alias("uri")).alias("artifactLocation"), F.struct(line.alias("startLine")).alias("region")).alias("physicalLocation")
    )
    flow = F.transform("flow", lambda n: F.struct(place(n["path"], n["line"])["physicalLocation"].alias("physicalLocation")))
    flows = F.when(F.size("flow") > 0, F.array(F.struct(F.array(F.struct(F.transform(flow, lambda x: F.struct(x.alias("location"))).alias("locations"))).alias("threadFlows"))))
    return findings.orderBy(*report_order()).select(
        F.to_json(
            F.struct(
                F.col("rule_id").alias("ruleId"),
                F.coalesce(F.get(F.array(*map(F.lit, LEVELS)), F.col("sev_rank")), F.lit("none")).alias("level"),
                F.struct(F.col("message").alias("text")).alias("message"),
                F.array(place(F.col("path"), F.greatest(F.col("line"), F.lit(1)))).alias("locations"),
                flows.alias("codeFlows"),
            )
        ).alias("value")
    )


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    kind = F.coalesce(_lookup(PURL_TYPES, ecosystem), F.lit("generic"))
    path = F.when(ecosystem == "Maven", F.replace(name, F.lit(":"), F.lit("/"))).otherwise(F.replace(name, F.lit("@"), F.lit("%40")))
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), path, F.when(F.coalesce(version, F.lit("")) != "", F.concat(F.lit("@"), version)).otherwise(""))


def bill_of_materials(components: DataFrame) -> DataFrame:
    """Components with a reference that is unique: the purl, then purl#2 and so on. Columns ecosystem, name, version."""
    rows = components.withColumn("purl", purl(F.col("ecosystem"), F.col("name"), F.col("version")))
    n = F.row_number().over(W.partitionBy("purl").orderBy("ecosystem", "name", "version"))
    return rows.withColumn("bom_ref", F.when(n == 1, F.col("purl")).otherwise(F.concat("purl", F.lit("#"), n.cast("string"))))


def exploitability(findings: DataFrame) -> DataFrame:
    """OpenVEX statements: status by reachability, and an id that is a hash of the content."""
    status = F.when(F.col("reachability") == "reachable", "affected").when(F.col("reachability") == "unreachable", "not_affected").otherwise("under_investigation")
    rows = findings.select("advisory_id", purl(F.col("ecosystem"), F.col("name"), F.col("version")).alias("product"), status.alias("status")).distinct()
    return rows.withColumn("id", F.sha2(F.concat_ws("|", "advisory_id", "product", "status"), 256))


def baseline(findings: DataFrame) -> DataFrame:
    return findings.select("fingerprint").distinct().orderBy("fingerprint")


def exit_status(findings: DataFrame, passes: DataFrame, ci: bool) -> DataFrame:
    """2 if a pass hasn't completed, else 1 if there are findings, else 0; without ``ci`` always 0. passes: name, status."""
    degraded = passes.agg(F.coalesce(F.bool_or(F.col("status") != "completed"), F.lit(False)).alias("degraded"))
    any_ = findings.agg((F.count("*") > 0).alias("any"))  # two single rows meet
    code = F.when(F.lit(not ci), 0).when(F.col("degraded"), 2).when(F.col("any"), 1).otherwise(0)
    return degraded.join(any_, F.lit(True)).select(code.alias("status"), "degraded")
