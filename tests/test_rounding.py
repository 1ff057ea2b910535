"""Rounded measures equal those of the SQL, also where the scaled value is next to a tie."""

import duckdb
import pytest
from pyspark.sql import functions as F

from leafmill.functions.numeric import rounded
from leafmill.operators import quality, review

# Ratios of four and five digits as percentages and as they are: half of them lie at a tie of one or three places, most of these not exactly.
VALUES = [i / 10_000 * 100 for i in range(1, 10_001)] + [i / 2_000 for i in range(1, 8_001)] + [-0.2855 * 100, 1e308, float("inf"), 4503599627370497.5, None]


@pytest.mark.parametrize("places", [1, 3])
def test_rounding_equals_sql(spark, places):
    got = [r["r"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, v double").select("i", rounded(F.col("v"), places).alias("r")).sort("i").collect()]
    want = [r[0] for r in duckdb.execute("SELECT round(v, ?::INTEGER) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [places, VALUES]).fetchall()]
    assert got == want


def test_share_next_to_a_tie(spark):
    """The ratios of the scenes that were told 0.1 too low."""
    s = "scene_id int, status string, pages int, audio_there boolean, subtitle string, subtitle_there boolean, visual_there boolean, visual_type string, source_there boolean, verbatim double"
    rows = spark.createDataFrame([(i, "rendered", 1, True, "x", True, True, "pdf_image", True, v) for i, v in enumerate([0.2855, 0.5495, 0.2935, 0.3005, 0.5385])], s)
    got = {r["scene_id"]: r["measure"] for r in quality.broken_rules(rows, ["scene_id"], review.asset_rules()).collect()}
    assert got == {0: 28.6, 1: 55.0, 2: 29.4, 3: 30.1, 4: 53.9}
