"""The audit report and provenance text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit_report(results: DataFrame, path: str, run_date: str, run_id: str = "audit") -> None:
    """Persist per-file results (or totals, or provenance) under their run date and run.

    A run owns its partition: writing it again replaces its rows and leaves other runs alone, so
    a rerun or a retry changes nothing.
    """
    dated = results.withColumns({"run_date": F.lit(run_date).cast("date"), "run_id": F.lit(run_id)})
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date", "run_id").parquet(path)


def render_provenance(prov: DataFrame) -> DataFrame:
    """Operation, input and output, then who did it: in-process, or a tool with its argv.

    ``prov``: ``operation, input, output, agent, version, tool_path, sha256, argv``.
    """
    head = F.concat(F.col("operation"), F.lit(": "), F.col("input"), F.lit(" -> "), F.col("output"))
    own = F.concat(F.lit("  in-process ("), F.col("agent"), F.lit(" "), F.col("version"), F.lit(")"))
    tool = F.concat_ws(
        "\n",
        F.concat(F.lit("  "), F.col("version")),
        F.concat(F.lit("  "), F.col("tool_path"), F.lit(" (sha256 "), F.col("sha256"), F.lit(")")),
        F.concat(F.lit("  argv: "), F.array_join("argv", " ")),
    )
    who = F.when(F.col("tool_path").isNull(), own).otherwise(tool)
    return prov.withColumn("text", F.concat(head, F.lit("\n"), who, F.lit("\n")))


def provenance_audit(prov: DataFrame) -> DataFrame:
    """Which agent, version and binary made how many outputs, under how many argument lists."""
    return prov.groupBy("operation", "agent", "version", "sha256").agg(
        F.count(F.lit(1)).alias("outputs"),
        F.count_distinct(F.array_join("argv", " ")).alias("argument_lists"),
        F.min("output").alias("first_output"),
    )
