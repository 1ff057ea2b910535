"""Sources and sinks of files: binary scans, JSON with declared schemas, subtitles, reports, layered settings."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import ass_time, srt_time


def binary_scan(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, length, modificationTime, content of files; a decoder goes on top as a provider (see plans.providers)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def read_json(spark: SparkSession, path: str, schema: str, defaults: dict | None = None) -> DataFrame:
    """JSON with a declared schema: unknown fields are dropped, missing ones null, then their default; broken records become nulls."""
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return rows.select(*(F.coalesce(F.col(c), F.lit((defaults or {}).get(c))).alias(c) if (defaults or {}).get(c) is not None else F.col(c) for c in rows.columns))


def write_json(rows: DataFrame, path: str) -> None:
    """One folder, replaced as a whole by the commit protocol: readers see the old files or the new ones."""
    rows.write.mode("overwrite").json(path)


def page_text(text: Column, recognised: Column, least: int) -> tuple[Column, Column]:
    """(text, text_source): the embedded text if long enough, else recognised text if that is longer, else what there is."""
    own, ocr = F.coalesce(text, F.lit("")), F.coalesce(recognised, F.lit(""))
    good, better = F.length(own) >= max(1, least), F.length(ocr) > F.length(own)
    source = F.when(good, "text").when(better, "ocr").when(F.length(own) > 0, "text").otherwise("empty")
    return F.when(~good & better, ocr).otherwise(own), source


def embedded_images(images: DataFrame, least_pixels: int) -> DataFrame:
    """Images of at least so many pixels, one row per (doc_id, page, xref)."""
    return images.filter(F.col("pixel_count") >= least_pixels).dropDuplicates(["doc_id", "page", "xref"])


def missing_languages(required: Column, installed: Column) -> Column:
    """Languages of a list such as "eng+chi_tra" that are not installed."""
    return F.array_except(F.filter(F.split(required, r"\+"), lambda x: F.length(x) > 0), installed)


def srt_lines(cues: DataFrame, group: str) -> DataFrame:
    """group, srt: the cues of each group as one SubRip text, in the order of their beginning.

    A group is one film; its cues fit in one text file by nature, so they are gathered per group.
    """
    block = F.concat_ws("\n", F.concat(srt_time(F.col("begin_sec")), F.lit(" --> "), srt_time(F.col("end_sec"))), F.col("cue"), F.lit(""))
    listed = cues.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("begin_sec", "cue_no", block.alias("b")))).alias("l"))
    numbered = F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x["b"]))
    return listed.select(group, F.concat(F.array_join(numbered, "\n"), F.lit("\n")).alias("srt"))


def ass_events(cues: DataFrame) -> DataFrame:
    """cues with ass: the dialogue line of each."""
    return cues.withColumn("ass", F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("begin_sec")), F.lit(","), ass_time(F.col("end_sec")), F.lit(",Default,,0,0,0,,"), F.replace(F.col("cue"), F.lit("\n"), F.lit("\\N"))))


def html_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with html: a table row of the columns, escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return rows.withColumn("html", F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), safe(c), F.lit("</td>")) for c in columns), F.lit("</tr>")))


def merged_settings(*layers: dict) -> dict:
    """Layers of settings, later ones over earlier ones: tables merge key by key, anything else is replaced."""
    out: dict = {}
    for layer in layers:
        for key, value in layer.items():
            out[key] = merged_settings(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def overlays(folder: str) -> list[str]:
    """Names of the settings files of a folder but the default, sorted."""
    return sorted(p.stem for p in Path(folder).glob("*.yaml") if p.stem != "default")


def voice_issues(probes: DataFrame) -> DataFrame:
    """Rules over probed audio samples: name, seconds, peak, rms, clipped (share). One row per broken rule."""
    from leafmill.operators.quality import Rule, broken_rules

    c = F.col
    long = (c("seconds") > 10) & (c("seconds") <= 20)
    rules = [
        Rule("bad_length", "error", (c("seconds") < 4) | (c("seconds") > 20), c("seconds")), Rule("short", "warning", (c("seconds") >= 4) & (c("seconds") < 6), c("seconds")),
        Rule("long", "warning", long, c("seconds")), Rule("quiet", "error", (c("peak") < 300) | (c("rms") < 50), c("rms")), Rule("clipped", "warning", c("clipped") > 0.001, c("clipped")),
    ]
    return broken_rules(probes, ["name"], rules)
