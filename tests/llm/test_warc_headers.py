import pytest

from keyloom.llm import warc

from . import brute


@pytest.mark.parametrize("url", ["http://x/" + "a" * 70_000, "http://x/" + "é" * 65_530, "http://x/\u0410\u0420\u0422/\u041a\u0410\u0420\u0422\u0410", "http://x/\u0420\u0420\u0420", "http://x/p\u0420\u0420"])
def test_headers_of_any_url_end_where_they_end(spark, url):
    pages = [(1, "<p>a</p>"), (2, "<p>a</p>"), (3, "b\r\n\r\nc"), (4, "")]
    df = spark.createDataFrame([(i, url, h) for i, h in pages], "page_id long, url string, html string")
    assert sorted(tuple(x) for x in warc.round_trip(df).collect()) == sorted(brute.warc(pages))
    assert {x.url for x in warc.parse(warc.write_archive(df).records()).collect()} == {url}


@pytest.mark.parametrize("mark", ["\u2028", "\u2029", "\x85", "\r\n", "\n", "\x0b", "\x0c", "\r\n\r\n"])
def test_no_url_adds_a_header_line(spark, mark):
    pages = [(1, "a"), (2, "a"), (3, "b")]
    df = spark.createDataFrame([(i, f"http://x/{mark}WARC-Page-ID: 999{mark}WARC-Type: revisit", h) for i, h in pages], "page_id long, url string, html string")
    assert sorted(tuple(x) for x in warc.round_trip(df).collect()) == sorted(brute.warc(pages))
