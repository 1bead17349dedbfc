"""WARC and HTML extraction."""

import base64
import gzip
import hashlib
import html as html_lib
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from veritext.llm import html_text, queries, warc

PAGES = "page_id long, url string, html string, offset long, digest string"


@pytest.fixture(scope="module")
def pages(spark):
    long = "x" * 300_000
    rows = [(1, "https://a.example/", "<p>one</p>", 7, "d"), (2, "https://b.example/\r\nX: y", "<p>one</p>", 7, "d"), (3, None, None, 7, None),
            (4, "u", "", 7, "d"), (5, "u", "żółć 漢", 7, "d"), (6, "u", long, 7, "d"), (7, "v", long, 7, "d"), (7, "v", long, 7, "d"),
            (2 ** 60 + 1, "u", "big id", 7, "d"), (2 ** 60 + 3, "u", "big id", 7, "d"), (None, "u", "<p>one</p>", 7, "d"), (None, "u", "no id", 7, "d")]
    return spark.createDataFrame(rows, PAGES)


def expected(rows, least=0):
    first = {}
    for r in rows:
        body = (r.html or "").encode()
        if len(body) >= least and r.page_id is not None:
            first[body] = min(first.get(body, r.page_id), r.page_id)
    out = []
    for r in rows:
        body = (r.html or "").encode()
        ref = first.get(body) if len(body) >= least else None
        ref = None if ref == r.page_id else ref
        out.append((r.page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 100])
def test_warc_round_trip(spark, pages, least):
    base = warc.archive_folder(spark)
    index = warc.write_warc(pages, base, revisit_min_bytes=least, archive_bytes=2000)
    back = warc.read_warc(index, base).collect()
    got = sorted(((int(r.record_id) if r.record_id else None, r.n_bytes, r.digest, r.record_type, int(r.refers_to) if r.refers_to else None) for r in back), key=str)
    assert got == expected(pages.collect(), least)
    assert all(r.intact for r in back)
    bodies = {r.html or "" for r in pages.collect()}
    assert {bytes(r.payload).decode() for r in back if r.record_type == "response"} <= bodies
    assert index.filter(F.col("url").contains("X: y")).count() == 1             # the index keeps the URL
    assert all("\n" not in (r.url or "") for r in back)


def test_warc_selected_records_and_standard_members(spark, pages):
    base = warc.archive_folder(spark)
    index = warc.write_warc(pages, base)
    some = index.filter(F.col("record_id").isin("5", "6"))
    assert sorted(r.record_id for r in warc.read_warc(some, base).collect()) == ["5", "6"]
    system, path = warc.filesystem(base)
    for name in {r.archive for r in index.collect()}:
        raw = gzip.decompress(system.open_input_file(f"{path}/{name}").readall())   # members follow one another
        assert raw.startswith(b"WARC/1.1\r\n") and raw.count(b"WARC-Type: ") == index.filter(F.col("archive") == name).count()


def test_warc_empty_table(spark):
    base = warc.archive_folder(spark)
    index = warc.write_warc(spark.createDataFrame([], PAGES), base)
    assert index.count() == 0 and warc.read_warc(index, base).count() == 0


def test_runs_coalesce_sorted_ranges():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 100, 5), ("b", 0, 5), ("b", 5, 50)]
    assert list(warc.runs(iter(rows), gap=20, most=40)) == [("a", 0, [(0, 10), (10, 5)]), ("a", 100, [(100, 5)]), ("b", 0, [(0, 5)]), ("b", 5, [(5, 50)])]


def test_main_text_of_driver_pages(spark):
    """The article's blocks, by another way than the operator's."""
    got = {r.page_id: r for r in queries.op7_main_text(spark, SF_SMALL).collect()}
    for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html_lib.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1|article)>", article)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


WORDS = "word " * 60
CASES = {
    "": "",
    "a < b &amp; c": "a < b & c",
    "<article><p>one<!--c-->two <script>x</script>three</p></article>": "onetwo three",
    "<article><p>&#9999999; &#55296; &#150; &#38;amp;</p></article>": "� � – &amp;",
    "<nav>menu<article><p>text</p></article>": "text",
    "<body class='no-comments'><article><header><h1>T</h1></header><p>Some <b>bold</b>x.</p><aside>no</aside><p>Be.</p></article></body>": "T\nSome boldx.\nBe.",
    f"<div class=menu>Home</div><div><h1>T</h1><p>{WORDS}</p><p>end</p><div id=comments><p>{WORDS}</p></div></div>": f"T\n{WORDS.strip()}\nend",
    "<article><p>a<br>b</p><p title='x>y'>c</p><form>f</form><style>p{}</style></article><div class='cookie-notice'>n</div>": "a b\nc",
    "<article><p>cut off <a href=\"x": "cut off",
    "<article><p>x</p><div class='ad'>buy</div><div>y<div>z</div></div>": "x\ny\nz",
    "<ul><li><a href=a>one</a></li><li><a href=b>two</a></li></ul><p>" + WORDS + "</p>": WORDS.strip(),
}


@pytest.mark.parametrize("page", CASES)
def test_main_text_cases(page):
    assert html_text.main_text(page) == CASES[page]


@pytest.mark.parametrize("page", ['<a "' * 20_000, "<a " * 30_000, "<a " + ' x="y"' * 20_000 + ">z", "<p " + "x" * 80_000, "<!--" * 20_000, "</" * 40_000])
def test_broken_markup_is_fast(page):
    assert len(html_text.main_text(page)) <= 1


def test_spans_surge_and_dive():
    assert html_text.spans([5, 0, 0, 0, 30, 60, 3, 0, 0, 0, 9], surge=80) == [(4, 7)]


def test_main_text_keeps_columns_and_rows(spark):
    df = spark.createDataFrame([(1, None, "old"), (2, "<p>x</p>", "old"), (2, "<p>x</p>", "old")], "page_id long, html string, text string")
    got = html_text.with_main_text(df)
    assert got.columns == df.columns and sorted((r.page_id, r.text) for r in got.collect()) == [(1, ""), (2, "x"), (2, "x")]
    assert html_text.with_main_text(df.limit(0)).count() == 0
