"""Connected components of links between rows, without collecting any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizmetrics.llm.shared import drop, narrowed, size, store


def components(links: DataFrame) -> DataFrame:
    """``id, root`` for every id in ``links`` (``a, b``): the least id that links reach.

    Each round gives an id the least root among its neighbours, then follows roots once, so
    that the distance to the least id at least halves along chains of roots. Minima are
    combined before each shuffle; a hot id only meets its neighbours in a join that AQE can
    split. The tables have a file for each megabyte of links, not for each shuffle partition:
    most rounds are small.
    """
    both = store(
        links.select(F.col("a").alias("id"), F.col("b").alias("other"))
        .union(links.select(F.col("b").alias("id"), F.col("a").alias("other")))
        .filter("id <> other")
        .distinct(),
        "links",
    )
    data = size(both)
    least = both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("root"))
    roots = store(narrowed(least, data), "roots")
    while True:
        # The least root among the neighbours, and of one's own.
        offered = (
            both.join(roots.select(F.col("id").alias("other"), "root"), "other")
            .select("id", "root", F.lit(None).cast("long").alias("was"))
            .union(roots.select("id", "root", F.col("root").alias("was")))
            .groupBy("id")
            .agg(F.min("root").alias("root"), F.max("was").alias("was"))
        )
        offered = store(narrowed(offered, data), "roots-offered")
        # An id's root may have a root itself.
        after = (
            offered.alias("o")
            .join(offered.select(F.col("id").alias("root"), F.col("root").alias("beyond")), "root", "left")
            .select("o.id", F.least(F.col("o.root"), F.coalesce("beyond", "o.root")).alias("root"), "o.was")
        )
        after = store(narrowed(after, data), "roots")
        drop(roots, offered)
        roots = after.select("id", "root")
        if after.filter("root <> was").isEmpty():
            drop(both)
            return roots


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after more ``links``: only what joins two components is followed, once for
    all links between them, so a round costs what it finds and not all links so far."""
    one, two = (
        roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"
    )
    joined = links.join(one, "a", "left").join(two, "b", "left").select(
        "a", "b", F.coalesce("root_a", "a").alias("root_a"), F.coalesce("root_b", "b").alias("root_b")
    )
    joined = store(joined, "links-rooted")
    data = size(roots) + size(joined)
    between = joined.filter("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
    over = components(between).select(F.col("id").alias("root"), F.col("root").alias("beyond"))
    seen = joined.select(F.col("a").alias("id"), F.col("root_a").alias("root")).union(joined.select("b", "root_b"))
    every = roots.select("id", "root").union(seen).distinct()
    after = every.join(over, "root", "left").select("id", F.coalesce("beyond", "root").alias("root"))
    out = store(narrowed(after, data), "roots")
    drop(joined)
    return out
