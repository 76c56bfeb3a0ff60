"""The name of the text that is taken out of pages."""

import pytest

from topicloom.llm import pages


def test_a_name_that_is_taken_is_refused(spark):
    rows = spark.createDataFrame([(1, "<p>A line, of text.</p>", "old")], "page_id long, html string, Text string")
    with pytest.raises(ValueError):
        pages.extract_main_text(rows, "html", "text")
    assert pages.extract_main_text(rows, "html", "main").columns == ["page_id", "html", "Text", "main"]
