"""Exact samples of a given size per group: the rows with the smallest seeded hash, without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.session import plain_plans

#: Hexadecimal digits by which a search step narrows, and rows it may rank at last.
DIGITS, SMALL = 4, 100_000


def seeded_hash(id_col: str, seed: int) -> Column:
    """md5 of ``<seed>:<id>`` as 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))


def smallest(df: DataFrame, id_col: str, group: Column, quotas: dict, seed: int, digits: int = DIGITS, small: int = SMALL) -> Column:
    """Flag of the ``quotas[g]`` rows of each group g that have the smallest (seeded md5 of the id, id).

    Rows are counted by the first digits of their hash; the prefix at which
    the count passes the quota holds the last row wanted. It is narrowed by
    further digits until it has at most ``small`` rows, which are ranked. So
    each step is one partial aggregation with at most 16**digits counts a
    group, and the flag is a comparison with one (hash, id) per group. Ids
    should be distinct and not null; rows of groups without quota are not flagged."""
    rows = df.select(group.alias("_group"), seeded_hash(id_col, seed).alias("_hash"), F.col(id_col).alias("_id"))
    spark, known, limits = df.sparkSession, {}, {}
    open_ = {g: ("", k) for g, k in quotas.items() if k > 0}  # group -> (prefix that holds the k-th smallest, k within it)
    while open_:
        width = min(32, max(len(p) for p, _ in open_.values()) + digits)
        within = _any_of([(F.col("_group") == g) & F.col("_hash").startswith(p) for g, (p, _) in open_.items()])
        counted = rows.where(within).groupBy("_group", F.substring("_hash", 1, width).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("_group").orderBy("prefix")))
        wanted = F.create_map(*[x for g, (_, k) in open_.items() for x in (F.lit(g), F.lit(k))])[F.col("_group")]
        last = upto.groupBy("_group").agg(
            F.min_by(F.struct("prefix", "n", "upto"), F.when(F.col("upto") >= wanted, F.col("prefix"))).alias("last"), F.max("upto").alias("held"))
        with plain_plans(spark):
            found = {r["_group"]: r for r in last.collect()}  # a row a group
        ranked = {}
        for g, (_, k) in open_.items():
            row = found.get(g)
            if row is None or row["held"] <= k:
                known[g] = None  # all rows
            else:
                prefix, n, at = row["last"]
                ranked[g] = (prefix, k - (at - n), n)
        open_ = {g: (p, k) for g, (p, k, n) in ranked.items() if n > small and len(p) < 32}
        ready = {g: (p, k) for g, (p, k, n) in ranked.items() if g not in open_}
        if ready:
            within = _any_of([(F.col("_group") == g) & F.col("_hash").startswith(p) for g, (p, _) in ready.items()])
            wanted = F.create_map(*[x for g, (_, k) in ready.items() for x in (F.lit(g), F.lit(k))])[F.col("_group")]
            nth = F.row_number().over(Window.partitionBy("_group").orderBy("_hash", "_id"))
            with plain_plans(spark):
                for r in rows.where(within).withColumn("nth", nth).where(F.col("nth") == wanted).collect():  # a row a group
                    limits[r["_group"]] = (r["_hash"], r["_id"])
    h, own = seeded_hash(id_col, seed), F.col(id_col)
    flags = [group == g for g in known]
    flags += [(group == g) & ((h < hash_) | ((h == hash_) & (own <= id_))) for g, (hash_, id_) in limits.items()]
    return F.coalesce(_any_of(flags), F.lit(False))


def _any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
