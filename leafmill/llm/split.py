"""Problem 2: cutting oversized items at natural boundaries, with overlap.

One regular expression per limit does the cutting inside the JVM: bounded quantifiers consume up to the limit, the
alternatives stand in the order of boundary strength, and a plain run of characters is the last resort. The bodies it
extracts tile the text without gap or loss; each piece is a body with the overlap looked back before it.

Defined results
    null text                 no pieces
    empty text                no pieces
    text within the limit     one piece, the text itself
    null spec                 spec 1; a spec that split_specs lacks, or a limit below 1, sets no limit
    overlap not below limit   taken as limit - 1; a negative or null overlap as 0
    repeated rows             each row is cut on its own (chunk_key is the identity)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SPEC = 1

#: Boundary kinds in order of strength, each as what must lie before the cut. The first must leave a third of the limit.
BOUNDARIES = (
    ("paragraph", r"(?<=\n[ \t\r]{0,4}\n)"),
    ("sentence", r"(?:(?<=[。！？｡．।][」』）”’]{0,2})(?![」』）”’。！？])|(?<=[.!?…][”\"’'»」』）)\]]{0,2}\s)(?=\S))"),
    ("line", r"(?<=\n)"),
    ("clause", r"(?:(?<=[，、；：])|(?<=[,;:]\s))"),
)
#: Any white space or punctuation; allowed from the first character on.
LOOSE = (r"(?U)(?<=\s)(?=\S)", r"(?U)(?<=\s)", r"(?<=\p{P})(?=\P{P})", r"(?<=\p{P})")


def body_pattern(limit: Column) -> Column:
    """The pattern for one limit as a column: strong boundaries in the last two thirds, then any boundary, then characters."""
    most, least = limit.cast("string"), F.greatest(F.lit(1), F.floor(limit / 3)).cast("string")
    parts = [F.concat(F.lit("(?s).{1,"), most, F.lit("}\\z"))]
    parts += [F.concat(F.lit("|.{"), least, F.lit(","), most, F.lit("}" + after)) for _, after in BOUNDARIES]
    parts += [F.concat(F.lit("|.{1,"), most, F.lit("}" + after.removeprefix("(?U)"))) for after in LOOSE]
    parts += [F.concat(F.lit("|.{1,"), most, F.lit(r"}(?!\p{M})")), F.concat(F.lit("|.{1,"), most, F.lit("}"))]
    return F.concat(F.lit("(?U)"), *parts)


def longest_run(text: Column) -> Column:
    """Length of the longest run with neither white space nor punctuation; linear in the text."""
    return F.array_max(F.transform(F.split(text, r"(?U)[\s\p{P}]+"), F.length))


def split_bodies(chunks: DataFrame, specs: DataFrame) -> DataFrame:
    """One row per chunk with text: its limit, overlap and the bodies that tile its text.

    The specs are a fixed table of a few rows; they are joined without a hint, so their measured size picks the strategy.
    """
    rules = specs.groupBy(F.col("spec_id").alias("_spec")).agg(F.min("max_chars").alias("_max"), F.min("overlap_chars").alias("_lap"))
    rows = chunks.filter(F.col("text").isNotNull()).select(
        "chunk_key", "src_id", "start_page", "end_page", "text", F.coalesce("spec_id", F.lit(DEFAULT_SPEC)).alias("_spec")
    )
    rows = rows.join(rules, "_spec", "left")
    limit = F.when(F.col("_max") >= 1, F.col("_max"))
    rows = rows.withColumn("max_chars", limit).withColumn(
        "overlap_chars", F.greatest(F.lit(0), F.least(F.coalesce("_lap", F.lit(0)), F.coalesce("max_chars", F.lit(1)) - 1))
    )
    body = F.col("max_chars") - F.col("overlap_chars")
    too_long = F.col("max_chars").isNotNull() & (F.length("text") > F.col("max_chars"))
    bodies = F.when(too_long, F.regexp_extract_all("text", body_pattern(body), F.lit(0))).when(F.length("text") > 0, F.array("text")).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("bodies", bodies).drop("_spec", "_max", "_lap")


def oversized(chunks: DataFrame, specs: DataFrame) -> DataFrame:
    """(chunk_key, case_kind) of the chunks that had to be cut; forced where a run longer than the limit leaves no boundary."""
    cut = split_bodies(chunks, specs).filter(F.size("bodies") > 1)
    return cut.select("chunk_key", F.when(longest_run(F.col("text")) > F.col("max_chars"), "forced").otherwise("plain").alias("case_kind"))


def _page_spans(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """chunk_key, versions: the reads of each of its pages as (page, length, md5), in page order; texts are not shuffled."""
    reads = pages.filter(F.length("text") > 0).select(F.col("src_id").alias("_src"), F.col("page").alias("_page"), F.length("text").alias("len"), F.md5("text").alias("md5"))
    wanted = chunks.filter(F.col("start_page") <= F.col("end_page")).select("chunk_key", F.col("src_id").alias("_src"), F.explode(F.sequence("start_page", "end_page")).alias("_page"))
    return (
        wanted.join(reads, ["_src", "_page"]).groupBy("chunk_key").agg(F.sort_array(F.collect_set(F.struct(F.col("_page").alias("page"), "len", "md5"))).alias("versions"))
    )


def _located(text: Column, versions: Column, first: Column) -> Column:
    """array<struct<page,start>>: where each page begins in the chunk. Blank pages leave only their separators, hence the steps of two."""
    zero = F.struct(F.lit(0).alias("pos"), (first - 1).alias("last"), F.array().cast("array<struct<page:int,start:int>>").alias("spans"))

    def step(acc, v):
        gaps = F.sequence(F.lit(0), F.greatest(F.lit(0), v["page"] - acc["last"]) * 2, F.lit(2))
        at = F.try_element_at(F.filter(gaps, lambda g: F.md5(F.substring(text, acc["pos"] + g + 1, v["len"])) == v["md5"]), F.lit(1))
        hit = at.isNotNull() & (v["page"] > acc["last"])
        start = (acc["pos"] + at).cast("int")
        return F.when(
            hit,
            F.struct(
                (start + v["len"] + 2).cast("int").alias("pos"),
                v["page"].cast("int").alias("last"),
                F.concat(acc["spans"], F.array(F.struct(v["page"].cast("int").alias("page"), start.alias("start")))).alias("spans"),
            ),
        ).otherwise(acc)

    return F.aggregate(versions, zero, step, lambda acc: acc["spans"])


def split_pieces(chunks: DataFrame, specs: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per piece: chunk_key, piece_no, start_char, text, start_page, end_page.

    start_char counts code points from 0. Without any located page a piece keeps the chunk's own page range.
    """
    cut = split_bodies(chunks, specs)
    spans = _page_spans(cut.filter(F.size("bodies") > 1), pages)
    rows = cut.join(spans, "chunk_key", "left").withColumn("spans", _located(F.col("text"), F.coalesce("versions", F.array().cast("array<struct<page:int,len:int,md5:string>>")), F.col("start_page")))
    starts = F.aggregate("bodies", F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array((F.element_at(acc, -1) + F.length(b)).cast("int"))))
    rows = rows.withColumn("starts", F.slice(starts, 1, F.size("bodies")))
    one = rows.select("chunk_key", "src_id", "start_page", "end_page", "text", "overlap_chars", "spans", F.posexplode(F.arrays_zip("starts", "bodies")).alias("piece_no", "b"))
    begin = F.greatest(F.lit(0), F.col("b.starts") - F.col("overlap_chars"))
    end = F.col("b.starts") + F.length("b.bodies")
    one = one.withColumn("start_char", begin).withColumn("_end", end)

    def page_at(offset):
        return F.array_max(F.transform(F.filter("spans", lambda s: s["start"] <= offset), lambda s: s["page"]))

    return one.select(
        "chunk_key",
        F.col("piece_no").cast("int").alias("piece_no"),
        F.col("start_char").cast("int").alias("start_char"),
        F.expr("substring(text, start_char + 1, _end - start_char)").alias("text"),
        F.coalesce(page_at(F.col("start_char")), F.col("start_page")).alias("start_page"),
        F.coalesce(page_at(F.col("_end") - 1), F.col("end_page")).alias("end_page"),
    )
