"""Show, folder and track names, and manifest lines.

A parser gives every field or null, never part of a name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeledger.functions.binding import let
from tapeledger.functions.formats import base_name, dir_name

# Fixed value: two-digit years up to this one are 20xx, later ones 19xx.
SHORT_YEAR_PIVOT = 30
# Format tags a folder name may end with.
FOLDER_FORMATS = ["shnf", "flac16", "flac24"]
MAX_U32 = 4294967295
# At least one letter; otherwise letters, digits, underscore and hyphen, in any script. The shortest that does.
_LETTER = r"\p{IsAlphabetic}"
_BAND = rf"[\p{{N}}_\-&&[^{_LETTER}]]*+{_LETTER}[{_LETTER}\p{{N}}_\-]*?"
# Days that every year has, and the leap days of short (1931 to 2030) and long years. There is no year 0.
_DAY = (
    r"(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)"
    r"|02-(?:0[1-9]|1[0-9]|2[0-8]))"
)
_FOURTH = r"(?:0[48]|[2468][048]|[13579][26])"
_LONG_DATE = rf"(?:(?!0000)[0-9]{{4}}-{_DAY}|(?:[0-9]{{2}}{_FOURTH}|{_FOURTH}00)-02-29)"
_SHORT_DATE = rf"(?:[0-9]{{2}}-{_DAY}|(?:00|{_FOURTH})-02-29)"
BAND_DATE = rf"^({_BAND})(?:{_LONG_DATE}|{_SHORT_DATE})"


def _calendar(year: Column, month: Column, day: Column) -> Column:
    """A real date or null. Year 0 is refused: it has no place in a proleptic SQL calendar."""
    text = F.concat(year, F.lit("-"), month, F.lit("-"), day)
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (year != "0000"), text.try_cast("date"))


def _long_year(year: Column) -> Column:
    return F.when(F.length(year) == 4, year).otherwise(
        F.concat(F.when(year <= f"{SHORT_YEAR_PIVOT:02d}", "20").otherwise("19"), year)
    )


def parse_show_date(text: Column) -> Column:
    """``YYYY-MM-DD`` or ``YY-MM-DD`` as (date, year_form); null for anything else."""
    shape = r"^([0-9]{4}|[0-9]{2})-([0-9]{2})-([0-9]{2})\z"
    year, month, day = (F.regexp_extract(text, shape, i) for i in (1, 2, 3))
    form = F.when(F.length(year) == 4, "LONG").otherwise("SHORT")
    return let(
        _calendar(_long_year(year), month, day),
        lambda date: F.when(date.isNotNull(), F.struct(date.alias("date"), form.alias("year_form"))),
    )


def render_show_date(date: Column, year_form: Column) -> Column:
    return F.when(year_form == "SHORT", F.date_format(date, "yy-MM-dd")).otherwise(
        F.date_format(date, "yyyy-MM-dd")
    )


def split_band_date(stem: Column) -> Column:
    """(band, date, year_form, rest) at the first dash that has a date and a band around it.

    ``BAND_DATE`` holds the calendar, so the shortest band it finds is the one. At each dash the
    four-digit year comes before the two-digit one, because the band before it is shorter.
    """
    return let(F.regexp_extract(stem, BAND_DATE, 1), lambda band: F.when(band != "", _at_date(stem, band)))


def _at_date(stem: Column, band: Column) -> Column:
    def from_date(dated: Column) -> Column:
        long = F.substring(dated, 5, 1) == "-"
        year = F.when(long, "").when(F.substring(dated, 1, 2) <= f"{SHORT_YEAR_PIVOT:02d}", "20").otherwise("19")
        size = F.when(long, 10).otherwise(8)
        return F.struct(
            band.alias("band"),
            F.concat(year, F.substring(dated, F.lit(1), size)).try_cast("date").alias("date"),
            F.when(long, "LONG").otherwise("SHORT").alias("year_form"),
            F.substring(dated, size + 1, F.length(dated)).alias("rest"),
        )

    return let(F.substring(stem, F.length(band) + 1, F.length(stem)), from_date)


def parse_track_name(name: Column) -> Column:
    """band, date, year_form, disc, track, suffix and ext of a track name, or null."""
    stem = F.regexp_extract(name, r"(?s)^(.*)\.[A-Za-z0-9]+\z", 1)
    ext = F.regexp_extract(name, r"\.([A-Za-z0-9]+)\z", 1)
    return let(split_band_date(stem), lambda head: _after_date(head, ext))


def _after_date(head: Column, ext: Column) -> Column:
    shape = r"(?s)^(?:d([0-9]+))?t([0-9]+)(.*)\z"
    disc, track, suffix = (F.regexp_extract(head["rest"], shape, i) for i in (1, 2, 3))
    # An empty text is not cast: a cast that fails is dear.
    number = lambda text: F.when(text != "", text.try_cast("long"))
    cells = F.struct(disc.alias("disc_text"), number(disc).alias("disc"), number(track).alias("track"), suffix.alias("suffix"))

    def checked(v: Column) -> Column:
        valid = (v["track"] <= MAX_U32) & ((v["disc_text"] == "") | F.coalesce(v["disc"] <= MAX_U32, F.lit(False)))
        return F.when(
            valid,
            F.struct(
                head["band"].alias("band"),
                head["date"].alias("date"),
                head["year_form"].alias("year_form"),
                v["disc"].alias("disc"),
                v["track"].alias("track"),
                F.nullif(v["suffix"], F.lit("")).alias("suffix"),
                ext.alias("ext"),
            ),
        )

    return F.when(head.isNotNull(), let(cells, checked))


def render_track_name(
    band: Column, date: Column, year_form: Column, disc: Column, track: Column, suffix: Column, ext: Column
) -> Column:
    number = track.cast("string")
    return F.concat(
        band,
        render_show_date(date, year_form),
        F.when(disc.isNull(), "").otherwise(F.concat(F.lit("d"), disc.cast("string"))),
        F.lit("t"),
        F.when(track < 10, F.concat(F.lit("0"), number)).otherwise(number),
        F.coalesce(suffix, F.lit("")),
        F.lit("."),
        ext,
    )


def parse_show_folder(name: Column) -> Column:
    """band, date, year_form, segments and format of a show folder's name, or null."""
    cells = F.split(name, r"\.")
    last = F.try_element_at(cells, F.lit(-1))
    tagged = (F.size(cells) > 1) & last.isin(FOLDER_FORMATS)
    kept = F.size(cells) - 1 - tagged.cast("int")
    return let(
        split_band_date(F.get(cells, F.lit(0))),
        lambda head: F.when(
            head["rest"] == "",
            F.struct(
                head["band"].alias("band"),
                head["date"].alias("date"),
                head["year_form"].alias("year_form"),
                F.slice(cells, F.lit(2), kept).alias("segments"),
                F.when(tagged, last).alias("format"),
            ),
        ),
    )


def sanitize(text: Column) -> Column:
    # Most of what goes is blanks, and taking these out first is cheaper than matching them.
    return F.regexp_replace(F.replace(text, F.lit(" ")), r"[^A-Za-z0-9._-]+", "")


def slug(text: Column) -> Column:
    """Only letters and digits of the sanitized text, which is made once where both are asked for."""
    plain = sanitize(text)
    for mark in "._-":
        plain = F.replace(plain, F.lit(mark))
    return F.lower(plain)


def track_label(disc: Column, track: Column, position: Column) -> Column:
    """``d1t01`` or ``t01``; the position when the name gave no number."""
    number = F.coalesce(track, position).cast("string")
    two = F.when(F.length(number) < 2, F.concat(F.lit("0"), number)).otherwise(number)
    # A name that did not parse gives neither a disc nor a track.
    shown_disc = F.when(track.isNotNull(), disc)
    return F.when(
        shown_disc.isNotNull(), F.concat(F.lit("d"), shown_disc.cast("string"), F.lit("t"), two)
    ).otherwise(F.concat(F.lit("t"), two))


def info_file_name(folder: Column, first_track: Column) -> Column:
    """Band and date from the folder, else from its first track, else the folder's own name."""

    def stem(name: Column) -> Column:
        return let(
            name, lambda p: F.concat(p["band"], render_show_date(p["date"], p["year_form"]))
        )

    return F.concat(
        F.coalesce(stem(parse_show_folder(folder)), stem(parse_track_name(first_track)), folder),
        F.lit(".txt"),
    )


def destination_name(path: Column, extension: str) -> Column:
    """Same folder and stem with another extension; only the last one is swapped."""
    name = base_name(path)
    stem = F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"(?s)^(.+)\.[^.]*$", 1)).otherwise(name)
    folder = dir_name(path)
    return F.concat(
        F.when(F.contains(path, F.lit("/")), F.concat(folder, F.lit("/"))).otherwise(""),
        stem,
        F.lit(f".{extension}"),
    )


def default_output(folder: Column) -> Column:
    """The torrent's place: beside the folder, under the folder's name."""
    return F.concat(F.regexp_replace(folder, "/+$", ""), F.lit(".torrent"))


# Fixed value: what stands between digest and name in an ST5 line.
ST5_TAG = "  [shntool]  "
# Why a manifest line is refused.
NO_COLON = 'expected "name:hash"'
NO_SPACE = 'expected "hash  name"'
NO_NAME = "empty filename"
NOT_HEX = "not hexadecimal"
NOT_16 = "digest is not 16 bytes"

_SPACE = r"[\s\p{Z}\x85]"
_SOLID = r"[^\s\p{Z}\x85]"


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def manifest_kind(path: Column) -> Column:
    return F.when(
        F.lower(path).rlike(r"[^/]\.(ffp|md5|st5)$"),
        F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)),
    )


def manifest_line(kind: Column, raw: Column) -> Column:
    """(skip, file_name, digest, detail) of one line; ``detail`` says why a line is refused."""
    stripped = strip_space(F.regexp_replace(raw, "^\ufeff+", ""))
    return let(stripped, lambda line: _line_fields(kind, line))


def _line_fields(kind: Column, line: Column) -> Column:
    skip = (line == "") | line.startswith(";") | line.startswith("#")

    tag_at = F.instr(line, ST5_TAG)
    tagged = (kind != "ffp") & (tag_at > 0)
    ffp_shape = r"(?s)^(.*):([^:]*)$"
    gap_shape = rf"(?s)^({_SOLID}+){_SPACE}(.*)$"
    rest = F.regexp_replace(
        F.regexp_extract(line, gap_shape, 2), rf"^{_SPACE}*\*?", ""
    )
    name = strip_space(
        F.when(kind == "ffp", F.regexp_extract(line, ffp_shape, 1))
        .when(tagged, F.substring(line, tag_at + len(ST5_TAG), F.length(line)))
        .otherwise(rest)
    )
    digest = F.lower(
        strip_space(
            F.when(kind == "ffp", F.regexp_extract(line, ffp_shape, 2))
            .when(tagged, F.substring(line, F.lit(1), tag_at - 1))
            .otherwise(F.regexp_extract(line, gap_shape, 1))
        )
    )
    return let(
        F.struct(name.alias("name"), digest.alias("digest")),
        lambda v: _judged(kind, line, skip, tagged, v["name"], v["digest"]),
    )


def _judged(
    kind: Column, line: Column, skip: Column, tagged: Column, name: Column, digest: Column
) -> Column:
    bad_digest = F.when(~digest.rlike("^([0-9a-f]{2})*$"), NOT_HEX).when(F.length(digest) != 32, NOT_16)
    no_name = F.when(name == "", NO_NAME)
    detail = (
        F.when((kind == "ffp") & ~F.contains(line, F.lit(":")), NO_COLON)
        .when((kind == "ffp") | tagged, F.coalesce(no_name, bad_digest))
        .when(~line.rlike(_SPACE), NO_SPACE)
        .otherwise(F.coalesce(bad_digest, no_name))
    )
    return F.struct(
        skip.alias("skip"),
        F.when(detail.isNull(), name).alias("file_name"),
        F.when(detail.isNull(), digest).alias("digest"),
        detail.alias("detail"),
    )


def manifest_text(kind: Column, file_name: Column, digest: Column) -> Column:
    """The line a manifest of this kind holds for one file."""
    return (
        F.when(kind == "ffp", F.concat(file_name, F.lit(":"), digest))
        .when(kind == "md5", F.concat(digest, F.lit("  "), file_name))
        .otherwise(F.concat(digest, F.lit(ST5_TAG), file_name))
    )


def folder_order(path: Column) -> Column:
    """Sort key: names compared inside each folder, depth first."""
    return F.split(path, "/")


def stream_order(path: Column) -> Column:
    """Sort key: the whole path byte by byte, so ``d1.txt`` comes before ``d1/t01``."""
    return path
