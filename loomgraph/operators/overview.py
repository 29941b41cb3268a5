"""An overview of sources that is kept as a table: a refresh reads and rewrites only what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Scratch
from .graph import overview_stats
from .merge import merge_rows, merged
from .stored import LISTED

SOURCE = "source_config_id"


def refresh_overview(sources: DataFrame, events: DataFrame, relations: DataFrame, path: str, marks: DataFrame, buckets: int = 16, tasks: int | None = None) -> DataFrame:
    """Brings the overview below ``path`` up to date; returns the marks taken, for ``clear_marks`` once all is written.

    Of ``sources(source_config_id)`` those with ``marks(source_config_id, revision)`` and those that the table lacks are computed; all, if there is no table or no mark. Up to
    1,000 of them are named in a filter of events and relations, which prunes folders of tables that are stored by source, and beyond that they are joined. Only the
    table's buckets of these sources are rewritten. Rows without a source are left out. ``tasks`` is that of ``overview_stats``.
    """
    spark = events.sparkSession
    scratch = Scratch(spark, "overview")
    taken = scratch.save(marks.select(SOURCE, "revision").where(F.col(SOURCE).isNotNull()), "taken")
    shown = merged(spark, path)
    every = shown is None or taken.limit(1).count() == 0
    wanted = sources.select(SOURCE).where(F.col(SOURCE).isNotNull()).distinct()
    if not every:
        dirty = taken.select(SOURCE, F.lit(True).alias("dirty")).distinct()
        known = shown.select(SOURCE, F.lit(True).alias("known"))
        wanted = wanted.join(dirty, SOURCE, "left").join(known, SOURCE, "left").where("dirty OR known IS NULL").select(SOURCE)
    wanted = scratch.save(wanted, "wanted")
    names = [r[0] for r in wanted.limit(LISTED + 1).collect()]
    if not names:
        return taken

    def of(df: DataFrame) -> DataFrame:
        return df.where(F.col(SOURCE).isin(names)) if len(names) <= LISTED else df.join(wanted, SOURCE, "left_semi")

    # A source without visible events has a row of zeros, which takes the place of what it had before.
    rows = wanted.join(overview_stats(of(events), of(relations), tasks), SOURCE, "left").na.fill(0)
    merge_rows(scratch.save(rows, "rows"), path, SOURCE, SOURCE, buckets)
    return taken


def clear_marks(marks: DataFrame, taken: DataFrame) -> DataFrame:
    """The marks that stay: those set anew, with another revision, since a refresh took them."""
    return marks.join(taken.select(SOURCE, "revision"), [SOURCE, "revision"], "left_anti")


def stored_overview(spark: SparkSession, path: str, sources: DataFrame) -> DataFrame | None:
    """The rows of ``overview_stats`` for the sources that there are still; None if there is no table."""
    rows = merged(spark, path)
    return None if rows is None else rows.where("n_events > 0").join(sources.select(SOURCE).distinct(), SOURCE, "left_semi")
