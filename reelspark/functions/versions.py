"""Release versions: channels and semantic order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms that a version may have.
CORE = r"^v[0-9]+\.[0-9]+\.[0-9]+"
MORE = r"(\.[0-9A-Za-z-]+)*$"


def channel(version: Column) -> Column:
    """stable, alpha or beta (release candidates too), null for other forms."""
    return F.when(version.rlike(CORE + "$"), "stable").when(version.rlike(f"{CORE}-alpha{MORE}"), "alpha").when(version.rlike(f"{CORE}-(beta|rc){MORE}"), "beta")


def order_key(version: Column) -> Column:
    """A value whose order is the versions' order: three numbers, then prereleases before the release,
    by their identifiers: numbers before names, numbers by value, names by code point, shorter first."""
    core = F.transform(F.split(F.regexp_replace(version, "^v|-.*$", ""), r"\."), lambda x: x.cast("bigint"))
    after = F.regexp_extract(version, "-(.*)$", 1)

    def identifier(x: Column) -> Column:
        number = F.when(x.rlike("^[0-9]{1,18}$"), x.cast("bigint"))
        return F.struct(F.when(number.isNull(), 1).otherwise(0).alias("kind"), F.coalesce(number, F.lit(0).cast("bigint")).alias("num"), F.when(number.isNull(), x).otherwise("").alias("txt"))

    return F.struct(core.alias("core"), (after == "").alias("release"), F.transform(F.split(after, r"\."), identifier).alias("pre"))
