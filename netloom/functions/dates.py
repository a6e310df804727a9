"""Snapshot dates and names as column expressions, in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def default_date(now: Column) -> Column:
    """The UTC date a day before now."""
    return F.to_date(now - F.expr("INTERVAL 1 DAY"))


def valid_date(text: Column, now: Column) -> Column:
    """DATE for a real YYYY-MM-DD from 2000-01-01 to today, else null."""
    date = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    return F.when((date >= F.lit("2000-01-01").cast("date")) & (date <= F.to_date(now)), date)


def snapshot_id(date: Column) -> Column:
    return F.date_format(date, "yyyyMMdd'T000000Z'")


def snapshot_file(date: Column) -> Column:
    return F.date_format(date, "'rib.'yyyyMMdd'.0000.bz2'")


def snapshot_path(date: Column) -> Column:
    """Place of the file below an archive's root."""
    return F.concat(F.date_format(date, "yyyy.MM'/RIBS/'"), snapshot_file(date))


#: Fixed value: the public archive that daily table dumps come from.
ARCHIVE = "https://archive.routeviews.org/hkix.hkg/bgpdata"


def snapshot_url(date: Column, archive: str = ARCHIVE) -> Column:
    """Where the dump of a date is; fetching it is left to the caller."""
    return F.concat(F.lit(archive + "/"), snapshot_path(date))


def local_id(observed: Column) -> Column:
    return F.concat(F.lit("local-"), F.unix_timestamp(observed).cast("string"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_minute(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm 'UTC'")
