"""Texts beyond a million characters are compared whole."""

from leafmill.catalog import QUERIES
from leafmill.plans import documents


def test_overlap_of_whole_texts(spark, monkeypatch):
    tail = "The same closing words of both the long texts."
    # The page is short; the words it shares with the page before stand behind the first million characters of that one.
    pages = spark.createDataFrame([(1, "x" * 1_000_100 + tail), (2, tail)], "page_id long, text string")
    monkeypatch.setattr(documents, "table", lambda *_: pages)
    got = {r["page_id"]: r["overlap_milli"] for r in QUERIES["verbatim_overlap"](spark, "").collect()}
    assert got == {2: 652}  # one run of 30 of 46 characters
