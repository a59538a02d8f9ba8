"""Tracker catalogues: merging a user's list, and resolving what a set asks for.

Trackers: ``id, name, announce, private, source, health``; ``health`` is ANNOUNCES,
PERSONAL_UPLOAD, BROKEN, UNREACHABLE or UNCHECKED.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeledger.functions.formats import tracker_responds, tracker_usable
from tapeledger.functions.tags import fill_passkey
from tapeledger.operators.ordered import first_occurrence, longest_set, rows_per_block, scan_sets, spread
from tapeledger.session import union_all

SET = ["set_id"]


def merge_catalogue(bundled: DataFrame, user: DataFrame) -> DataFrame:
    """User entries replace bundled ones by id, the rest follow in file order.

    ``bundled`` has ``entry_no``, ``user`` has ``line_no``. A replaced entry stays visible as
    OVERRIDDEN just after its replacement; ``(block, place, after)`` is the merged order.
    """
    fields = ["id", "name", "announce", "private", "source", "health"]
    replaced = user.select("id", F.lit(True).alias("_replaced"))
    ours = bundled.join(replaced, "id", "left").select(
        *fields,
        F.when(F.col("_replaced"), "OVERRIDDEN").otherwise("BUNDLED").alias("origin"),
        F.lit(0).alias("block"),
        F.col("entry_no").cast("long").alias("place"),
        F.when(F.col("_replaced"), 1).otherwise(0).alias("after"),
    )
    places = bundled.select("id", "entry_no")
    theirs = user.join(places, "id", "left").select(
        *fields,
        F.lit("USER").alias("origin"),
        F.when(F.col("entry_no").isNull(), 1).otherwise(0).alias("block"),
        F.coalesce("entry_no", "line_no").cast("long").alias("place"),
        F.lit(0).alias("after"),
    )
    return union_all(ours, theirs)


def catalogue_counts(catalogue: DataFrame) -> DataFrame:
    """How many of the entries that answered can be used as they stand."""
    responds = (F.col("origin") != "OVERRIDDEN") & tracker_responds(F.col("health"))
    return catalogue.agg(
        F.count_if(responds & tracker_usable(F.col("health"))).alias("usable"), F.count_if(responds).alias("responding")
    )


def resolve_trackers(
    specs: DataFrame, catalogue: DataFrame, keys: DataFrame, longest: int | None = None, rows: int | None = None
) -> DataFrame:
    """One row per spec: its URL and tier, its warning, and why its set is refused.

    ``specs``: ``set_id, ordinal, spec``; ``catalogue``: choosable entries, one per id; ``keys``:
    ``id, passkey``. A spec with a scheme is a URL and is used as it is. The first refusal in a
    set refuses the set, whose rows then carry no URL. ``rows``, how many specs there are, sets the number of tasks.
    """
    longest = longest_set(specs, SET) if longest is None else longest
    entries = catalogue.withColumnRenamed("id", "spec").withColumn("_known", F.lit(True))
    # An id with keys in several lists has one row all the same.
    one_key = keys.groupBy(F.col("id").alias("spec")).agg(F.max("passkey").alias("passkey"))
    found = specs.join(entries.join(one_key, "spec", "full"), "spec", "left")
    is_url = F.contains("spec", F.lit("://"))
    url = F.when(is_url, F.col("spec")).otherwise(fill_passkey(F.col("announce"), F.col("passkey")))
    health = F.when(~is_url, F.col("health"))
    own = found.select(
        *SET,
        "ordinal",
        "spec",
        url.alias("url"),
        F.when(~is_url, F.coalesce("private", F.lit(False))).otherwise(False).alias("_private"),
        F.when(~is_url, F.col("source")).alias("_source"),
        F.when(~is_url & F.col("_known").isNull(), "UNKNOWN_ID")
        .when(~tracker_usable(health), "BROKEN")
        .when(url.isNull(), "NO_PASSKEY")
        .alias("_refusal"),
        F.when(health == "UNREACHABLE", "UNREACHABLE").when(health == "PERSONAL_UPLOAD", "PERSONAL_UPLOAD").alias("_health_warning"),
    )
    sourced = scan_sets(
        spread(own, SET, rows, longest),
        SET,
        totals={
            "_first_source": (F.min, F.when(F.col("_source").isNotNull(), F.struct("ordinal", "_source"))),
            "_private_sites": (F.sum, F.col("_private").cast("long")),
        },
        longest=longest,
    )
    conflict = F.when(F.col("_source") != F.col("_first_source._source"), "SOURCE_CONFLICT")
    refusal = F.coalesce("_refusal", conflict)
    judged = sourced.withColumn("_refusal", refusal)
    if longest <= rows_per_block(specs):
        # A short set is whole where it stands.
        firsts = scan_sets(judged, [*SET, "url"], totals={"_first": (F.min, F.col("ordinal"))}, longest=longest)
        flagged = firsts.withColumn("is_first", F.col("ordinal") == F.col("_first"))
    else:
        flagged = first_occurrence(judged, [*SET, "url"], F.col("ordinal"))
    first = F.coalesce("is_first", F.lit(False))
    scanned = scan_sets(
        flagged,
        SET,
        running={"_tiers": (F.sum, first.cast("long"))},
        totals={"_refused": (F.min, F.when(F.col("_refusal").isNotNull(), F.struct("ordinal", "_refusal")))},
        longest=longest,
    )
    good = F.col("_refused").isNull()
    return scanned.select(
        *SET,
        "ordinal",
        "spec",
        F.when(good & first, F.col("url")).alias("url"),
        F.when(good & first, F.col("_tiers") - 1).alias("tier"),
        F.array_compact(
            F.array(F.col("_health_warning"), F.when(~first, "DUPLICATE_URL"))
        ).alias("warnings"),
        F.col("_private_sites").alias("private_sites"),
        F.when(good, F.col("_first_source._source")).alias("source"),
        F.col("_refused._refusal").alias("refused"),
        F.col("_refused.ordinal").alias("refused_at"),
    )


def resolved_sets(resolved: DataFrame) -> DataFrame:
    """Per set: tiers, private flag, source, and whether several private sites are named."""
    return resolved.groupBy(*SET).agg(
        F.count("url").alias("tiers"),
        (F.max("private_sites") > 0).alias("private"),
        F.max("source").alias("source"),
        (F.max("private_sites") > 1).alias("several_private"),
        F.max("refused").alias("refused"),
    )
