"""Where a sample clip of each track falls, how big it gets, and why it is refused."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeledger.functions.clips import default_clip, estimate_bytes, longest_fitting, parse_mode


def clip_plan(tracks: DataFrame, modes: Sequence[str], max_bytes: int) -> DataFrame:
    """One row per track and mode.

    ``tracks``: ``frames, sample_rate`` and optional wishes ``start`` and ``length`` in seconds.
    A start alone keeps the default length; a length alone is centred.
    """
    limit = F.lit(max_bytes).cast("long")
    rate = F.col("sample_rate").cast("double")
    # A mode is parsed once and not on every row.
    offer = F.array(*[F.struct(F.lit(m).alias("mode"), parse_mode(F.lit(m)).alias("m")) for m in modes])
    offered = tracks.withColumn("_offer", F.explode(offer))
    parsed = offered.withColumns({"mode": F.col("_offer.mode"), "_m": F.col("_offer.m"), "_secs": F.col("frames") / rate})
    kbps = F.col("_m.kbps")
    usual = parsed.withColumn("_default", default_clip(F.col("_secs"), kbps, limit))
    sized = usual.withColumn("_length", F.coalesce("length", "_default.length"))
    inside = F.greatest(F.least(F.col("_length"), F.floor("_secs").cast("double")), F.lit(1.0))
    centred = F.when(F.col("_secs").isNull(), 0.0).otherwise(
        F.floor(F.greatest((F.col("_secs") - inside) / 2.0, F.lit(0.0))).cast("double")
    )
    placed = sized.withColumn("_start", F.coalesce(F.col("start"), centred)).withColumns(
        {
            "estimate": estimate_bytes(kbps, F.col("_length")),
            "longest": longest_fitting(kbps, limit),
            "_from": F.round(F.col("_start") * rate).cast("long"),
        }
    )
    refused = (
        F.when(F.col("_m").isNull(), "BAD_MODE")
        .when((F.col("_start") < 0) | (F.col("_length") <= 0), "BAD_CLIP")
        .when((F.col("_m.kind") == "CBR") & (F.col("estimate") > limit), "TOO_LARGE")
        .when(F.col("_from") >= F.col("frames"), "START_PAST_END")
    )
    until = F.col("_from") + F.round(F.col("_length") * rate).cast("long")
    return placed.select(
        *[c for c in tracks.columns if c not in ("start", "length")],
        "mode",
        F.col("_start").alias("start"),
        F.col("_length").alias("length"),
        "estimate",
        "longest",
        F.when(refused.isNull(), F.col("_from")).alias("from_frame"),
        F.when(refused.isNull(), F.least(until, F.col("frames"))).alias("to_frame"),
        refused.alias("refused"),
    )
