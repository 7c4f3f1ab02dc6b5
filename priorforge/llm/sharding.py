"""Reproducible shuffle into shards: a Feistel permutation, with cycle walking, over global row numbers.

DataFrame operations only. Rows are numbered from 0 without a global sort: rows that agree in id and text are counted
together first, the distinct ones are dealt to hash buckets, numbered by a running sum inside each bucket, and
shifted by the bucket's offset. The number depends on the rows alone, not on their files, order or partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import table

ROUNDS = 8
#: Steps of the walk that are unrolled; a row that needs more raises an error instead of getting a wrong place.
WALK = 64
#: Copies of one row are numbered in runs of so many.
RUN = 4096


def permuted(x: Column, n: int, seed: int = 7, rounds: int = ROUNDS) -> Column:
    """Place of row number ``x`` (0 to n-1) in a pseudo-random permutation of 0 to n-1.

    The domain is a x b >= n with a = ceil(sqrt(n)); a round adds a keyed hash of one half to the other, modulo that
    half's size, so each round is a bijection. Fewer than a places lie beyond n; who lands there walks on.
    """
    if n <= 1:
        return F.lit(0).cast("long") + x * 0
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    beyond = a * b - n

    def once(p: Column) -> Column:
        r = F.pmod(p, F.lit(b))
        start = F.struct(F.floor((p - r) / b).alias("l"), r.alias("r"))
        key = lambda i, half: F.xxhash64(F.lit(seed).cast("long"), i.cast("long"), half)
        end = F.aggregate(
            F.sequence(F.lit(0), F.lit(rounds - 1)),
            start,
            lambda s, i: F.when(F.pmod(i, F.lit(2)) == 0, F.struct(F.pmod(s["l"] + F.pmod(key(i, s["r"]), F.lit(a)), F.lit(a)).alias("l"), s["r"].alias("r"))).otherwise(
                F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(key(i, s["l"]), F.lit(b)), F.lit(b)).alias("r"))
            ),
        )
        return end["l"] * b + end["r"]

    p = once(x)
    if beyond:
        p = F.aggregate(F.sequence(F.lit(1), F.lit(min(beyond, WALK))), p, lambda q, _: F.when(q < n, q).otherwise(once(q)))
        p = F.when(p < n, p).otherwise(F.raise_error(F.lit("cycle walk too long; take another seed")).cast("long"))
    return p


def number_rows(rows: DataFrame, buckets: int = 4096) -> tuple[DataFrame, int]:
    """``rows`` with a column ``row_no``: a dense number from 0; and their count.

    Equal rows take neighbouring numbers. ``buckets`` bounds what the driver sees (one count each).
    """
    cols = rows.columns
    some = rows.groupBy(*cols).agg(F.count("*").alias("__n")).withColumn("__bucket", F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int"))
    some = table(some, "numbered")
    totals = sorted(map(tuple, some.groupBy("__bucket").agg(F.sum("__n")).collect()))
    offsets, n = [], 0
    for k, c in totals:
        offsets.append((k, n))
        n += c
    offs = rows.sparkSession.createDataFrame(offsets, "__bucket int, __offset long")
    w = Window.partitionBy("__bucket").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    first = some.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).join(F.broadcast(offs), "__bucket").withColumn("__first", F.col("__before") + F.col("__offset"))
    few = first.filter(F.col("__n") <= RUN).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    many = (
        first.filter(F.col("__n") > RUN)
        .withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / RUN))))
        .repartition("__first", "__run")
        .withColumn("__i", F.explode(F.sequence(F.col("__run") * RUN, F.least(F.col("__run") * RUN + RUN, F.col("__n")) - 1)))
        .drop("__run")
    )
    return few.unionByName(many).select(*cols, (F.col("__first") + F.col("__i")).alias("row_no")), n


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    Row number -> place p; shard = p mod shards, slot = p div shards: shard sizes differ by one at most, slots have no
    gaps, and both can be computed from the row number. size is the UTF-8 length plus 16 (null text: 16, crc of the
    empty text). Rows that agree in id and text take different slots. No rows: an empty result. Other columns,
    whatever their names, are not read. ``law`` is 'rows', so a shard more deals everything anew: grown_shard is null.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text_col).alias("__h"),
    )
    numbered, n = number_rows(rows)
    p = permuted(F.col("row_no"), n, seed)
    return (
        numbered.withColumn("__p", p)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.pmod(F.col("__p"), F.lit(shards)).cast("int").alias("shard"),
            F.floor((F.col("__p") - F.pmod(F.col("__p"), F.lit(shards))) / shards).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
