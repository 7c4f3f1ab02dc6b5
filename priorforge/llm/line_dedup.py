"""Removal of repeated passages by overlapping three-line windows, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .scratch import table

WINDOW = 3


def line_windows(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(id, h, s, e, w1, w2): each run of ``window`` consecutive lines that aren't blank, from line s to line e, and its hash.

    w1 and w2 hash the lines (trimmed of blanks) with two functions, 96 bits together; h hashes the whole text.
    """
    lines = F.transform(F.split(text_col, "\n", -1), lambda l, i: F.struct(i.alias("i"), F.trim(l).alias("l")))
    full = F.filter(lines, lambda x: x["l"] != "")
    hashed = F.transform(full, lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["l"]).alias("a"), F.hash(x["l"]).alias("b")))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), hashed.alias("x")).filter(F.size("x") >= window)
    part = lambda i, f: [F.element_at("x", i + k + 1)[f] for k in range(window)]
    made = F.transform(
        F.sequence(F.lit(0), F.size("x") - window),
        lambda i: F.struct(
            F.element_at("x", i + 1)["i"].alias("s"),
            F.element_at("x", i + window)["i"].alias("e"),
            F.xxhash64(*part(i, "a")).alias("w1"),
            F.hash(*part(i, "b")).alias("w2"),
        ),
    )
    return base.select("id", "h", F.explode(made).alias("w")).select("id", "h", "w.*")


def repeated_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, spans): line ranges that repeat an earlier passage, merged and in order; one row per affected text.

    A window's first occurrence is the least (id, text hash, line), null ids first. Every other occurrence is removed, but
    one that overlaps the first in the same text isn't an occurrence of its own. Windows of a text that share or cover
    lines merge into one span. Only hashes and positions are shuffled; the common ones are counted before the shuffle,
    and the join back on a very common window is one that adaptive execution can split.
    """
    found = table(line_windows(docs, window, id_col, text_col), "windows")
    first = (
        found.groupBy("w1", "w2")
        .agg(F.min(F.struct("id", "h", "s", "e")).alias("f"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("w1", "w2", "f")
    )
    here = F.col("id").eqNullSafe(F.col("f.id")) & (F.col("h") == F.col("f.h"))
    later = found.join(first, ["w1", "w2"]).filter(~(here & (F.col("s") <= F.col("f.e")))).select("id", "h", "s", "e").distinct()
    order = Window.partitionBy("id", "h").orderBy("s")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("new", F.coalesce((F.col("s") > reach + 1).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(order))
    merged = islands.groupBy("id", "h", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return merged.groupBy("id", "h").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the repeated lines cut out of the text, plus line_spans, n_lines and n_removed.

    A null text stays null, an empty one empty; texts of fewer than ``window`` lines that aren't blank stay as they are.
    Rows that agree in id and text count as one text and get the same result. Columns of ``docs`` named like the
    added ones are replaced. line_spans holds the removed ranges (first and last line, from 0).
    """
    spans = repeated_spans(docs, window, id_col, text_col)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("k"), F.xxhash64(text_col).alias("kh"))
    got = rows.join(spans, F.col("k").eqNullSafe(F.col("id")) & (F.col("kh") == F.col("h")), "left")
    text = F.col("row")[text_col]
    lines = F.split(text, "\n", -1)
    keep = F.transform(
        F.sequence(F.lit(0), F.size("spans")),
        lambda i: F.struct(
            F.when(i == 0, F.lit(0)).otherwise(F.element_at("spans", F.greatest(i, F.lit(1)))["e"] + 1).alias("s"),
            F.when(i == F.size("spans"), F.size("lines")).otherwise(F.element_at("spans", F.least(i + 1, F.size("spans")))["s"]).alias("e"),
        ),
    )
    cut = F.array_join(F.flatten(F.transform(keep, lambda r: F.slice("lines", r["s"] + 1, r["e"] - r["s"]))), "\n")
    removed = F.aggregate("spans", F.lit(0), lambda n, x: n + x["e"] - x["s"] + 1)
    out = got.withColumn("lines", F.when(F.col("spans").isNotNull(), lines))
    names = [c for c in docs.columns if c not in ("line_spans", "n_lines", "n_removed")]
    return out.select(
        *[F.when(F.col("spans").isNull(), text).otherwise(cut).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names],
        F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>")).alias("line_spans"),
        F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("int").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("int").alias("n_removed"),
    )
