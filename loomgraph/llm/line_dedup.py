"""Removal of boilerplate lines by the number of distinct sites they occur on, with DataFrame functions only.

Every line adds its site to the HyperLogLog sketch of the line's hash; sketches of tasks merge by aggregation. Where an estimate lies so near the
threshold that the sketch's error could decide, the distinct sites are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# Relative error beyond which a sketch with 2**12 registers is practically never off (six standard errors).
SKETCH_BITS, MARGIN = 12, 0.1
TAGS = [(r"(?s)<!--.*?-->", ""), (r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", ""), (r"(?i)<(br|p|div|li|ul|ol|h[1-6]|article|nav|header|footer|section|table|tr|body|title|head|html|td|main|aside)\b[^>]*>|</(p|div|li|ul|ol|h[1-6]|article|nav|header|footer|section|table|tr|body|title|head|html|td|main|aside)\s*>", "\n"), (r"<[^>]*>", "")]


def page_text(html: Column) -> Column:
    """Text of a page with a line break for every block tag; scripts, styles and comments go."""
    for pattern, by in TAGS:
        html = F.regexp_replace(html, pattern, by)
    return html


def site_of(url: Column) -> Column:
    """Host of a URL in lower case, without user, port, or leading www.; null without one."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def line_key(line: Column) -> Column:
    """Lines count as equal if they differ only in blanks."""
    return F.trim(F.regexp_replace(line, r"[ \t\r\f\x0B]+", " "))


def boilerplate_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h, n_sites, exact) of the line hashes of ``lines(h, site)`` found on ``min_sites`` distinct sites or more.

    Each task sketches its own lines and only sketches are shuffled, so a line with a third of all rows is one sketch per task. Lines that occur
    less often than ``min_sites`` cannot qualify. ``n_sites`` is the estimate where ``exact`` is false. Null hashes and sites do not count; an
    empty table gives an empty result.
    """
    lines = lines.where("h is not null and site is not null")
    sketches = lines.groupBy("h").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch")).where(F.col("n") >= min_sites)
    estimate = F.hll_sketch_estimate("sketch").alias("estimate")
    near = F.abs(F.col("estimate") - min_sites) <= F.greatest(F.lit(2.0), MARGIN * F.greatest(F.col("estimate").cast("double"), F.lit(float(min_sites))))
    likely = sketches.select("h", estimate).withColumn("near", near).where(F.col("near") | (F.col("estimate") >= min_sites))
    likely = Scratch(lines.sparkSession, "lines").save(likely, "likely")
    counted = lines.join(likely.where("near").select("h"), "h", "left_semi").groupBy("h").agg(F.countDistinct("site").alias("n_sites"))
    sure = likely.where("not near").select("h", F.col("estimate").alias("n_sites"), F.lit(False).alias("exact"))
    return sure.unionByName(counted.where(F.col("n_sites") >= min_sites).withColumn("exact", F.lit(True)))


def remove_boilerplate(pages: DataFrame, text: Column, site: Column, key: str = "page_id", min_sites: int = 10, min_chars: int = 1) -> DataFrame:
    """Rows of ``pages`` reduced to (key, site, n_lines, n_removed, kept): lines on ``min_sites`` or more sites are gone.

    Null text has no lines. Rows without a site keep every line and count for none unless the line is boilerplate elsewhere. Blank
    lines stay and are never boilerplate. Repeated rows count their site once. Very long texts are read whole. An empty table gives an empty
    result. Input columns other than those named are ignored. A line is known by a 64-bit hash; two lines of one hash count as one.
    """
    base = pages.select(F.col(key).alias("key"), site.alias("site"), F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"))
    hashed = F.transform("lines", lambda x: F.when(F.length(line_key(x)) >= min_chars, F.xxhash64(line_key(x))))
    base = Scratch(pages.sparkSession, "pages").save(base.withColumn("rid", F.xxhash64("key", "site", "lines")).withColumn("hashes", hashed), "lines")
    at = base.select("rid", "site", F.posexplode("hashes").alias("at", "h")).where("h is not null")
    common = boilerplate_lines(at.select("h", "site"), min_sites)
    gone = at.select("rid", "at", "h").join(common.select("h"), "h", "left_semi").groupBy("rid").agg(F.collect_set("at").alias("gone"))
    joined = base.join(gone, "rid", "left")
    stays = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    joined = joined.withColumn("stay", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(stays))
    return joined.select(
        F.col("key").alias(key), "site",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("stay")).cast("long").alias("n_removed"),
        F.array_join("stay", "\n").alias("kept"),
    )
