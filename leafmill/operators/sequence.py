"""Order-dependent operators that hold for groups of any size: running sums, packing, runs, numbering.

A group may hold a third of all rows, so none is collected into one task. Sums are made over fixed blocks of the order, then over the
blocks, then within them; greedy packing is stitched from tables that each block makes on its own.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group that a block spans, in steps of the order column.
BLOCK = 1024


def running_sum(rows: DataFrame, group: list[str], order: str | list[str], value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """rows with the exclusive running sum of value within group, in the order of one or more columns, the last an integer. Ties share their sum's start.

    One shuffle by (group, block) serves both the sums of the blocks and the windows inside them; the windows over the blocks see one row
    per block. A block is a stretch of the last column within equal values of those before it.
    """
    *leading, last = [order] if isinstance(order, str) else order
    blocks = [*leading, "_block"]
    rows = rows.withColumn("_block", F.floor(F.col(last) / block)).withColumn("_value", value)
    sums = rows.groupBy(*group, *blocks).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*group).orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*group, *blocks).orderBy(last).rangeBetween(Window.unboundedPreceding, -1)
    return rows.join(offsets, [*group, *blocks]).withColumn(name, F.col("_offset") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).drop("_block", "_value", "_offset")


def page_islands(rows: DataFrame, group: str, order: str) -> DataFrame:
    """group, first, last: maximal runs of consecutive values. Ends are found by anti-joins; a window sees only the ends of runs."""
    seen = rows.filter(F.col(group).isNotNull() & F.col(order).isNotNull()).select(group, order).distinct()
    firsts = seen.join(seen.select(group, (F.col(order) + 1).alias(order)), [group, order], "left_anti").select(group, F.col(order).alias("at"), F.lit(0).alias("end"))
    lasts = seen.join(seen.select(group, (F.col(order) - 1).alias(order)), [group, order], "left_anti").select(group, F.col(order).alias("at"), F.lit(1).alias("end"))
    ends = firsts.unionByName(lasts)
    following = Window.partitionBy(group).orderBy("at", "end")
    return ends.withColumn("last", F.lead("at").over(following)).filter("end = 0").select(group, F.col("at").alias("first"), "last")


def _block_table(sizes: list[int], most: int) -> list[tuple[int, int, int]]:
    """For every page at which the chunk open before this block could close: (sum before it, size of the chunk open at the end, chunks).

    A chunk that comes into the block with `carry` characters closes before the first page whose running sum exceeds most - carry. Pages
    further than the limit cannot be first. The last entry is for a block that closes nothing.
    """
    sums, total, n = [], 0, len(sizes)
    for s in sizes:
        total += s
        sums.append(total)
    before = [0, *sums]
    # From each start: the page before which the chunk closes next.
    following = [bisect.bisect_right(sums, most + before[i], lo=min(i + 1, n)) for i in range(n)]
    carry, chunks = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        j = following[i]
        carry[i], chunks[i] = (total - before[i], 1) if j >= n else (carry[j], chunks[j] + 1)
    return [*((before[i], carry[i], chunks[i]) for i in range(n) if before[i] <= most), (total, -1, 0)]


def _stitch(key: tuple, pdf: pd.DataFrame, most: int) -> pd.DataFrame:
    """The open chunk's size and number before each block, block after block. One row per block comes in."""
    out, carry, closed, opened = [], 0, 0, False
    for blk, table in pdf.sort_values("blk")[["blk", "table"]].itertuples(index=False):
        out.append((key[0], blk, carry if opened else -1, closed))
        sums = [e["brk"] for e in table]
        if not opened:
            carry, closed, opened = table[0]["carry"], table[0]["packed"] - 1, True
        elif carry + sums[-1] <= most:
            carry += sums[-1]
        else:
            e = table[max(0, bisect.bisect_right(sums[:-1], most - carry) - 1)]
            carry, closed = e["carry"], closed + e["packed"]
    return pd.DataFrame(out, columns=["grp", "blk", "carry_in", "closed"])


def pack(pages: DataFrame, group: str, order: str, size: str, most: int, block: int = BLOCK) -> DataFrame:
    """group, order, chunk_no: consecutive rows packed greedily; a row that would exceed `most` opens a new chunk unless it is the first.

    Greedy packing depends on all rows before, but a block's effect on what follows is a small table: from which page on it packs anew.
    Groups of one block, the most, are packed inside one expression. The blocks of larger groups make their tables in parallel, one pass
    over a row per block stitches them, and the blocks number their rows in parallel again.
    """
    rows = pages.filter(F.col(group).isNotNull() & F.col(order).isNotNull()).select(F.col(group).cast("long").alias("grp"), F.col(order).cast("long").alias("page"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))
    # Two rows of one place are packed in the order of their size. A block holds `block` places of the order at most.
    blocks = rows.groupBy("grp", F.floor(F.col("page") / block).alias("blk")).agg(F.sort_array(F.collect_list(F.struct("page", "size"))).alias("pages"))
    span = blocks.groupBy("grp").agg(F.count(F.lit(1)).alias("blocks"))
    large = blocks.join(span.filter("blocks > 1").select("grp"), "grp", "left_semi")

    def tables(batches):
        for pdf in batches:
            made = [[{"brk": b, "carry": c, "packed": p} for b, c, p in _block_table([x["size"] for x in pages], most)] for pages in pdf["pages"]]
            yield pd.DataFrame({"grp": pdf["grp"], "blk": pdf["blk"], "table": made})

    made = large.mapInPandas(tables, "grp long, blk long, table array<struct<brk:long,carry:long,packed:long>>")
    starts = made.groupBy("grp").applyInPandas(lambda k, pdf: _stitch(k, pdf, most), "grp long, blk long, carry_in long, closed long")
    ready = blocks.join(starts, ["grp", "blk"], "left")
    out_type = "array<struct<page:bigint,no:bigint>>"
    zero = F.struct(F.coalesce("carry_in", F.lit(-1)).cast("long").alias("carry"), F.coalesce("closed", F.lit(0)).cast("long").alias("no"), F.array().cast(out_type).alias("out"))

    def step(acc, x):
        opens = (acc["carry"] >= 0) & (acc["carry"] + x["size"] > most)
        no = acc["no"] + F.when(opens, F.lit(1)).otherwise(F.lit(0))
        held = F.when(opens, F.lit(0)).otherwise(F.greatest(acc["carry"], F.lit(0)))
        return F.struct((held + x["size"]).cast("long").alias("carry"), no.cast("long").alias("no"), F.concat(acc["out"], F.array(F.struct(x["page"].alias("page"), (no + 1).cast("long").alias("no")))).cast(out_type).alias("out"))

    numbered = ready.select("grp", F.explode(F.aggregate("pages", zero, step, lambda acc: acc["out"])).alias("p"))
    return numbered.select(F.col("grp").alias(group), F.col("p.page").alias(order), F.col("p.no").alias("chunk_no"))


def numbered(rows: DataFrame, group: str, order: list[str], name: str, block: int = BLOCK) -> DataFrame:
    """rows with a running number from 1 within a group, in the order of integer columns; large groups are numbered block by block."""
    rows = rows.withColumn("_block", F.floor(F.col(order[0]) / block))
    sizes = rows.groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(group, "_block").orderBy(*order)
    placed = rows.join(offsets, [group, "_block"]).withColumn(name, F.col("_offset") + F.row_number().over(inside))
    return placed.drop("_block", "_offset")


def renumbered(rows: DataFrame, group: str, order: list[str], name: str = "new_id", form: str = "%s_sc_%03d", block: int = BLOCK) -> DataFrame:
    """The running number as an id."""
    return numbered(rows, group, order, "_running", block).withColumn(name, F.format_string(form, F.col(group).cast("string"), F.col("_running"))).drop("_running")


def canonical_ids(rows: DataFrame, group: str, order: str, id_col: str, form: str = r"^ch_\d{3,}$") -> DataFrame:
    """Ids of the canonical form stay, others become positional; where that makes a duplicate, the whole group is numbered anew."""
    placed = renumbered(rows, group, [order], "_positional", "%s|ch_%03d").withColumn("_positional", F.substring_index("_positional", "|", -1))
    kept = placed.withColumn("_id", F.when(F.col(id_col).rlike(form), F.col(id_col)).otherwise(F.col("_positional")))
    doubled = kept.groupBy(group, "_id").count().filter("count > 1").select(group).distinct().withColumn("_doubled", F.lit(True))
    return kept.join(doubled, group, "left").withColumn("canonical_id", F.when(F.col("_doubled"), F.col("_positional")).otherwise(F.col("_id"))).drop("_positional", "_id", "_doubled")
