"""Text fixtures (FIXTURES.md C1-C4, C15, C18) and cross-checks."""

import html as pyhtml
from html.parser import HTMLParser

import pytest


from tests.conftest import one
from veritext.functions import text as X
from veritext.operators import corpus as C

C1 = ('<title>T</title><h1> Ustawa<sup>1)</sup> o <a class="gloss-link tooltip">x</a>'
      '<a class="other">lekach</a> </h1><p>a<sup>2</sup></p>')


def test_title_and_text(spark):
    assert one(spark, X.h1_title("h"), [(C1,)], "h string") == ["Ustawaolekach"]
    assert one(spark, X.page_text("h"), [(C1,)], "h string") == ["T\nUstawa\no\nlekach\na\n2"]
    assert one(spark, X.h1_title("h"), [("<p>x</p>",)], "h string") == ["Brak tytułu"]
    assert one(spark, X.h1_title("h", missing=X.NO_TITLE_FILE), [("<p>x</p>",)], "h string") == ["brak_tytulu"]


def test_whitespace_and_safe_title(spark):
    assert one(spark, X.normalize_whitespace("t"), [("a  b\n \t\n\nc   d\ne",)], "t string") == ["a b\n\nc d\ne"]
    assert one(spark, X.safe_title("t"), [('A/B: "C" <d>|e?',)], "t string") == ["A_B_ _C_ _d__e_"]


def test_entities_match_python(spark):
    samples = ["a &amp; b", "&amp;lt;", "x&#233;y&#x41;z", "&copy;&middot;&quot;", "&#;&#xZ;", "no refs"]
    got = one(spark, X.decode_entities("t"), [(s,) for s in samples], "t string")
    assert got == [pyhtml.unescape(s) for s in samples]


def test_file_names(spark):
    rows = [
        ("<title>Ustawa z dnia 6 września 2001 r. – Prawo farmaceutyczne (tekst)</title>", "https://x.example/a"),
        ("<title>A &amp; B</title>", "https://x.example/a"),
        ("<p>none</p>", "https://x.example/api/acts/DU/2001/1381/text.html"),
        ("<p>none</p>", "https://x.example/a/b?page=2&ref=x"),
        ("<p>none</p>", "https://www.x.example/"),
        ("<p>none</p>", "https://x.example/one-two/#top"),
    ]
    got = one(spark, X.page_file_name("h", "u"), rows, "h string, u string")
    assert got == ["Ustawa_z_dnia_6_września_2001_r_Prawo_farmaceutycz", "A_B", "2001_1381_text_html",
                   "a_b_page_2_ref_x", "www_x_example", "one-two"]


def test_unique_file_names(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "x_2")], "page_id long, file_name string")
    out = {r.page_id: r.file_name for r in C.unique_file_names(df).collect()}
    assert len(set(out.values())) == 4
    assert out[1] == "x" and out[4] == "x_2"
    # a generated name that equals a real base gets another suffix
    df2 = spark.createDataFrame([(1, "y"), (2, "y"), (3, "y_2")], "page_id long, file_name string")
    out2 = {r.page_id: r.file_name for r in C.unique_file_names(df2).collect()}
    assert len(set(out2.values())) == 3 and out2[2] != "y_2"


class _Text(HTMLParser):
    """Python's standard parser: visible strings (consecutive data chunks
    joined into one string, as a document tree holds them), stripped, one
    per line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.buf = [], 0, []

    def _flush(self):
        text = "".join(self.buf).strip()
        if text and not self.skip:
            self.out.append(text)
        self.buf = []

    def handle_starttag(self, tag, attrs):
        self._flush()
        self.skip += tag in ("script", "style")

    def handle_startendtag(self, tag, attrs):
        self._flush()

    def handle_endtag(self, tag):
        self._flush()
        self.skip -= tag in ("script", "style")

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def handle_data(self, data):
        self.buf.append(data)

    def close(self):
        super().close()
        self._flush()


def test_html_text_matches_python_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    got = {r.page_id: r.t for r in pages.select("page_id", X.html_to_text("html").alias("t")).collect()}
    for r in pages.collect():
        p = _Text()
        p.feed(r.html)
        p.close()
        assert got[r.page_id] == "\n".join(p.out), r.page_id


HARD = [
    '<p title="a>b">x</p><p>a < b and c>d</p>',
    "<div data-x='1>2'>y<br/>z</div><!-- c > d --><p>&amp;lt;</p>",
    "<html><head><style>p>b{}</style><script>if (a<b) {}</script></head><body>k<b>bold</p>tail",
    "<?xml version='1.0'?><!DOCTYPE html><p>one</p>\n\n<p> two </p>",
]


def test_hard_html_matches_python_parser(spark):
    got = one(spark, X.html_to_text("h"), [(h,) for h in HARD], "h string")
    for h, g in zip(HARD, got):
        p = _Text()
        p.feed(h)
        p.close()
        assert g == "\n".join(p.out), h


def test_chunk_labels(spark):
    text = "wstęp\nArt. 1.\ntekst\n§ 2. treść\nArt. 2.\ninne"
    df = spark.createDataFrame([(7, text)], "doc_id long, text string")
    got = [(r.text, r.article, r.paragraph) for r in C.split_chunks(df).orderBy("pos").collect()]
    assert got == [("wstęp", None, None), ("Art. 1.", "1", None), ("tekst", "1", None),
                   ("§ 2. treść", "1", "2"), ("Art. 2.", "2", None), ("inne", "2", None)]


def test_length_profile(spark):
    df = spark.createDataFrame([("x" * n,) for n in (10, 20, 30, 40)], "text string")
    r = C.chunk_length_profile(df).first()
    assert (r["count"], r["mean"], r["std"], r["min"], r["max"]) == (4, 25.0, 12.909944, 10, 40)
    assert (r["p25"], r["p50"], r["p75"]) == (17.5, 25.0, 32.5)


def test_document_records(spark):
    pages = spark.createDataFrame([(1, "https://x.example/a", C1)], "page_id long, url string, html string")
    d = C.build_documents(pages).first()
    assert d.doc_id == "T" and d.metadata.title == "Ustawaolekach" and d.metadata.source_file == "T.html"
    assert d.metadata.text_length == len(d.text) and d.metadata.doc_type == "ustawa"


def test_quarantine(spark):
    pages = spark.createDataFrame([(1, None), (2, "  "), (3, "<p>ok</p>"), (4, "bad \ufffd")],
                                  "page_id long, html string")
    got = {r.page_id: (r.status, r.reason) for r in C.quarantine(pages).collect()}
    assert got == {1: ("rejected", "null_html"), 2: ("rejected", "blank_html"), 3: ("good", None),
                   4: ("rejected", "undecodable")}


def test_split_quarantine(spark):
    pages = spark.createDataFrame([(1, None), (2, "<p>ok</p>")], "page_id long, html string")
    good, rejected = C.split_quarantine(pages)
    assert [r.page_id for r in good.collect()] == [2] and "status" not in good.columns
    assert [(r.page_id, r.reason) for r in rejected.collect()] == [(1, "null_html")]


def test_text_corpus_last_wins(spark):
    pages = spark.createDataFrame([(1, "<h1>A</h1>one"), (2, "<h1>A</h1>two"), (3, "<p>x</p>")],
                                  "page_id long, html string")
    got = {r.file_name: r.text for r in C.text_corpus(pages).collect()}
    assert got == {"A.txt": "A\ntwo", "brak_tytulu.txt": "x"}


# ------------------------------------------------------- hard pages

HARD = ["a &amp; b", "&amp;lt; &#38;amp; &lt;", "w&oacute;dki &copy2020 &ampx &notit; &notin;", "&#9999999; &#55296; &#150; &#0065; &#x41 &#x0000000041;",
        "&#; & &&&; &nosuch; &#0; &#1; &#128;&#129; &#xFFFE; &#13;x", "&AMP &Lt; &acE; &lt &NewLine;|&Tab;|", "&#99999999999999999999; &#xFFFFFFFFF;"]


def test_references_as_the_standard_library_decodes_them(spark):
    import html

    assert one(spark, X.decode_entities("t"), [(h,) for h in HARD], "t string") == [html.unescape(h) for h in HARD]


@pytest.mark.parametrize("page,text,title", [
    ("a<!--c-->b", "a\nb", None), ("a<script>x</script>b", "a\nb", None), ("t<script>\nvar a=1;", "t", None),
    ("<!-- <h1>old</h1> --><h1>new</h1>", "new", "new"), ("<h1>cut off", "cut off", "cut off"), ("a < b", "a < b", None),
    ("<a title='a>b'>q</a>", "q", None), ("l1\x01x", "l1\x01x", None), ("a &lt;b&gt; c", "a <b> c", None),
    ("<p " + ' x="y"' * 20_000 + ">z", "z", None)])
def test_hard_pages(spark, page, text, title):
    got = spark.createDataFrame([(page,)], "h string").select(X.page_text("h").alias("t"), X.h1_title("h").alias("n")).first()
    assert got.t == text and got.n == (title or X.NO_TITLE)


def test_cut_tag_and_open_quote_are_fast(spark):
    import time

    pages = [("<a title=\"" + "x" * 80_000,), ("<p " + "x" * 80_000,), ("<a '" + "y" * 80_000,)]
    start = time.time()
    assert len(spark.createDataFrame(pages, "h string").select(X.page_text("h")).collect()) == 3
    assert time.time() - start < 30


def test_a_control_character_is_no_mark(spark):
    docs = spark.createDataFrame([(1, "l1\x01x\nl2")], "doc_id long, text string")
    assert [r.text for r in C.split_chunks(docs).orderBy("pos").collect()] == ["l1\x01x", "l2"]


def test_lines_of_an_article_are_one_chunk(spark):
    docs = spark.createDataFrame([(1, "wstęp\nArt. 1.\ntekst\n§ 2. treść\ndalej\nArt. 2.\ninne"), (2, "bez\nznaków")], "doc_id long, text string")
    got = [(r.doc_id, r.article, r.paragraph, r.text) for r in C.split_chunks(docs, regroup=True).orderBy("doc_id", "pos").collect()]
    assert got == [(1, None, None, "wstęp"), (1, "1", None, "Art. 1.\ntekst"), (1, "1", "2", "§ 2. treść\ndalej"),
                   (1, "2", None, "Art. 2.\ninne"), (2, None, None, "bez"), (2, None, None, "znaków")]


def test_a_failing_page_is_left_out(spark):
    pages = spark.createDataFrame([(1, "u", "<h1>A</h1>x"), (2, "u", None), (3, "u", "  \n"), (4, "u", "bad �"), (5, "u", "<h1>A</h1>y")],
                                  "page_id long, url string, html string")
    got = {r.page_id: r.doc_id for r in C.build_documents(pages).collect()}
    assert got == {1: "A", 5: "A_5"}
