"""References in pages: only whole ones are read."""

from __future__ import annotations

from caseframe.sources import html


def test_references_without_a_semicolon_stay(spark):
    pages = spark.createDataFrame([(1, "<title>a&amp; b&amp</title><a href='/?x=1&copy=2&amp;y'>l</a><h1>&notes; &#65; &#66 & &lt;</h1>")], "id int, html string")
    got = [(r.part, r.name, r.value) for r in html.page_parts(pages, "id", "html").orderBy("pos").collect()]
    assert got == [("title", "", "a& b&amp"), ("link", "/?x=1&copy=2&y", ""), ("h1", "", "&notes; A &#66 & <")]
