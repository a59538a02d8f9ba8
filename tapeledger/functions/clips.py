"""MP3 sample clips: mode names, size estimates and where the clip falls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal constant bitrates in kbps, and the typical average of each VBR quality.
CBR_RATES = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
VBR_AVERAGE = [245, 225, 190, 175, 165, 130, 115, 100, 85, 65]

# Bytes a clip carries besides its audio, and its longest default length.
OVERHEAD_BYTES = 6144
DEFAULT_MAX_SECS = 30.0


def parse_mode(text: Column) -> Column:
    """``320``, ``256k``, ``v0`` as (kind, value, nominal kbps); null when not a mode."""
    plain = F.regexp_replace(F.lower(F.trim(text)), "(kbps|k)$", "")
    quality = F.regexp_extract(plain, r"^v\+?(\d+)$", 1).try_cast("int")
    rate = F.regexp_extract(plain, r"^\+?(\d+)$", 1).try_cast("int")
    averages = F.array(*[F.lit(v) for v in VBR_AVERAGE])
    return F.when(
        quality.between(0, 9),
        F.struct(
            F.lit("VBR").alias("kind"),
            quality.alias("value"),
            F.get(averages, quality).alias("kbps"),
        ),
    ).when(
        rate.isin(CBR_RATES),
        F.struct(F.lit("CBR").alias("kind"), rate.alias("value"), rate.alias("kbps")),
    )


def estimate_bytes(kbps: Column, secs: Column) -> Column:
    audio = F.greatest(secs, F.lit(0.0)) * kbps.cast("double") * 1000.0 / 8.0
    return F.ceil(audio).cast("long") + OVERHEAD_BYTES


def longest_fitting(kbps: Column, max_bytes: Column) -> Column:
    room = F.greatest(max_bytes - OVERHEAD_BYTES, F.lit(0)).cast("double")
    return F.floor(room * 8.0 / 1000.0 / kbps.cast("double")).cast("double")


def default_clip(track_secs: Column, kbps: Column, max_bytes: Column) -> Column:
    """The longest clip that fits, one to thirty seconds, centred and cut to whole seconds."""
    wanted = F.least(
        F.greatest(longest_fitting(kbps, max_bytes), F.lit(1.0)), F.lit(DEFAULT_MAX_SECS)
    )
    capped = F.greatest(F.least(wanted, F.floor(track_secs).cast("double")), F.lit(1.0))
    centred = F.floor(F.greatest((track_secs - capped) / 2.0, F.lit(0.0))).cast("double")
    return F.struct(
        F.when(track_secs.isNull(), 0.0).otherwise(centred).alias("start"),
        F.when(track_secs.isNull(), wanted).otherwise(capped).alias("length"),
    )
