"""Audio formats, stream facts and outcome rules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions, names and the tool each format would need.
FORMAT_OF_EXTENSION = {
    "flac": "FLAC",
    "fla": "FLAC",
    "wav": "WAV",
    "wave": "WAV",
    "shn": "SHN",
    "ape": "APE",
    "wv": "WavPack",
    "tta": "TTA",
}
TOOL_OF_FORMAT = {
    "FLAC": "nothing",
    "WAV": "nothing",
    "SHN": "shntool",
    "APE": "mac",
    "WavPack": "wvunpack",
    "TTA": "ttaenc",
}
READABLE_FORMATS = ["FLAC", "WAV"]

# Fixed value: audio frames in one CD sector.
SECTOR_FRAMES = 588

# Names that are never part of a set.
NOISE_NAMES = [".DS_Store", "Thumbs.db", "desktop.ini"]

# Device names that some systems refuse whatever the extension.
DEVICE_NAMES = (
    ["CON", "PRN", "AUX", "NUL"]
    + [f"COM{i}" for i in range(1, 10)]
    + [f"LPT{i}" for i in range(1, 10)]
)

# Per-file outcomes that fail a set.
FAILING = ["CORRUPT", "SUSPECT", "MISSING", "WRONG_SIZE", "UNREADABLE"]


def lookup(table: dict[str, str], key: Column) -> Column:
    """A small fixed table as a map literal, so the key is computed once; null when absent."""
    cells = [F.lit(v) for item in table.items() for v in item]
    return F.try_element_at(F.create_map(*cells), key)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Everything before the last slash; empty when there is none."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-cased extension; null for no dot, and for a name that only starts with one."""
    return F.nullif(
        F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1)), F.lit("")
    )


def classify_format(path: Column) -> Column:
    return lookup(FORMAT_OF_EXTENSION, extension(path))


def is_readable(fmt: Column) -> Column:
    return fmt.isin(READABLE_FORMATS)


def required_tool(fmt: Column) -> Column:
    return lookup(TOOL_OF_FORMAT, fmt)


def is_cdda(rate: Column, channels: Column, bits: Column) -> Column:
    return (rate == 44100) & (channels == 2) & (bits == 16)


def duration_secs(frames: Column, rate: Column) -> Column:
    return frames.cast("double") / rate.cast("double")


# A time unit in which a frame is a whole number at every usual sample rate, per second.
TICKS = 705_600_000


def ticks(frames: Column, rate: Column) -> Column:
    """A file's length in whole ticks, so that totals add up exactly in any order."""
    whole = F.call_function("div", frames, rate.cast("long")) * TICKS
    return whole + F.call_function("div", F.pmod(frames, rate.cast("long")) * TICKS, rate.cast("long"))


def tick_secs(total: Column) -> Column:
    return total / F.lit(float(TICKS))


def bytes_per_frame(channels: Column, bits: Column) -> Column:
    return channels * F.ceil(bits / 8).cast("int")


def sbe_check(frames: Column, rate: Column, channels: Column, bits: Column) -> Column:
    """Sector alignment: status, remainder and why it does not apply."""
    remainder = F.pmod(frames, F.lit(SECTOR_FRAMES)).cast("long")
    cdda = F.coalesce(is_cdda(rate, channels, bits), F.lit(False))
    reason = F.when(~cdda, "NOT_CDDA").when(frames.isNull(), "NO_LENGTH")
    return F.struct(
        F.when(reason.isNotNull(), "NOT_APPLICABLE")
        .when(remainder == 0, "ALIGNED")
        .otherwise("MISALIGNED")
        .alias("sbe"),
        F.when(reason.isNull() & (remainder != 0), remainder).alias("remainder_frames"),
        reason.alias("reason"),
    )


def verify_outcome(stored: Column, computed: Column, error: Column) -> Column:
    """Stored against computed audio digest. A decode error is not a mismatch."""
    return (
        F.when(error.isNotNull(), "FAILED")
        .when(stored.isNull(), "NO_MD5")
        .when(stored.eqNullSafe(computed), "OK")
        .otherwise("MISMATCH")
    )


def ffp(stored: Column) -> Column:
    """The fingerprint a FLAC header holds, or why there is none."""
    return F.struct(stored.alias("digest"), F.when(stored.isNull(), "no audio MD5 in the header").alias("error"))


def fails_run(verification: Column) -> Column:
    """A file without a stored digest is unverifiable, which does not fail a run."""
    return verification.isin("MISMATCH", "FAILED")


def is_taggable(fmt: Column) -> Column:
    return F.coalesce(fmt == "FLAC", F.lit(False))


def is_noise(name: Column) -> Column:
    return name.isin(NOISE_NAMES) | name.rlike(r"^\._|\.torrent$|^\..*\.part$")


def path_violation(components: Column) -> Column:
    """Why a relative path must not be joined to a folder; null when it is safe."""

    def component_rule(c: Column) -> Column:
        stem = F.upper(F.substring_index(c, ".", 1))
        return (
            F.when(c == "", "EMPTY_COMPONENT")
            .when(c.isin(".", ".."), "DOT_COMPONENT")
            .when(c.rlike(r"[/\\]"), "SEPARATOR")
            .when(F.instr(c, "\0") > 0, "NUL_BYTE")
            .when(stem.isin(DEVICE_NAMES), "RESERVED_DEVICE")
        )

    broken = F.filter(F.transform(components, component_rule), lambda r: r.isNotNull())
    return F.when(F.size(components) == 0, "EMPTY_PATH").otherwise(F.get(broken, F.lit(0)))


def is_padding(components: Column, attr: Column) -> Column:
    """Filler between files: flagged as such, or named by one of two older habits."""
    return (
        F.coalesce(F.instr(attr, "p") > 0, F.lit(False))
        | F.coalesce(F.get(components, F.lit(0)) == ".pad", F.lit(False))
        | F.coalesce(
            F.try_element_at(components, F.lit(-1)).startswith("_____padding_file"), F.lit(False)
        )
    )


def is_failure(status: Column) -> Column:
    return status.isin(FAILING)


def needs_attention(status: Column) -> Column:
    return status.isin([*FAILING, "PARTIAL"])


def tracker_usable(health: Column) -> Column:
    return health != "BROKEN"


def tracker_responds(health: Column) -> Column:
    return ~health.isin("BROKEN", "UNREACHABLE")


def conversion_checked(
    source_format: Column, bits: Column, stored: Column, computed: Column
) -> Column:
    """Whether a conversion's audio was compared, whether it held, and what that allows.

    WAV to FLAC: the new file must carry a digest, and 8-bit audio is signed in one format and
    unsigned in the other, so those digests say nothing. FLAC to WAV: checked only if the
    source stored a digest.
    """
    checked = (
        F.when(source_format == "WAV", stored.isNotNull() & (bits != 8))
        .when(source_format == "FLAC", stored.isNotNull())
        .otherwise(F.lit(False))
    )
    outcome = (
        F.when((source_format == "WAV") & stored.isNull(), "REFUSED")
        .when(checked & ~stored.eqNullSafe(computed), "REFUSED")
        .otherwise("CONVERTED")
    )
    return F.struct(
        checked.alias("checked"),
        outcome.alias("outcome"),
        (checked & (outcome == "CONVERTED")).alias("may_set_aside"),
    )


# Piece length limits in bytes, and how many pieces to aim for.
MIN_PIECE = 1 << 14
MAX_PIECE = 1 << 24
TARGET_PIECES = 2000
MAX_DECLARED_PIECE = 1 << 30


def piece_count(total: Column, piece_length: Column) -> Column:
    """Pieces needed for ``total`` bytes, the last one possibly short."""
    spill = F.pmod(total, piece_length)
    return F.call_function("div", total, piece_length) + (spill > 0).cast("long")


def auto_piece_length(total: Column) -> Column:
    """Smallest power of two in range that needs at most the aimed-for number of pieces."""
    exponents = range(MIN_PIECE.bit_length() - 1, MAX_PIECE.bit_length())
    start = None
    for e in exponents:
        fits = total <= F.lit(TARGET_PIECES << e)
        value = F.lit(1 << e).cast("long")
        start = F.when(fits, value) if start is None else start.when(fits, value)
    return start.otherwise(F.lit(MAX_PIECE).cast("long"))


def check_piece_length(n: Column) -> Column:
    """Why a chosen piece length is refused; null when it is fine."""
    in_range = n.between(MIN_PIECE, MAX_PIECE)
    return F.when(~in_range | (F.bit_count(n) != 1), "PIECE_LENGTH")
