"""Main text where marks, names and gaps mislead."""

import pytest

from veritext.llm.html_text import main_text

BODY = "word " * 100 + "end"
TEASER = "<article class='teaser'><p>Read this too.</p></article>"


def check(page, right):
    assert main_text(page).split("\n") == right


@pytest.mark.parametrize("page", [
    f"<aside>{TEASER}</aside><div><p>{BODY}</p></div>",
    f"<div class='sidebar'><div>{TEASER}</div></div><div><p>{BODY}</p></div>",
    f"<main><p>Short.</p></main><div><p>{BODY}</p></div>",
    f"<div><div class='ad'>buy<article><p>{BODY}</p></article></div>",
    f"<div class='ad'>buy</div><article><p>{BODY}</p></article><div><p>{'other ' * 40}</p></div>",
])
def test_marks_are_checked_against_the_text(page):
    check(page, [BODY])


@pytest.mark.parametrize("page", [
    f"<article><p>{BODY}</p></article><section class='comments'><article class='comment'><p>{BODY}</p></article></section>",
    f"<article><p>{BODY}</p><article class='comment odd' id='comment-12'><p>I agree.</p></article></article>",
    f"<main><article class='post has-comments'><p>{BODY}</p></article><div><article class='comment'><p>No.</p><article class='comment'><p>Yes.</p></article></article></div></main>",
    f"<article><p>{BODY}</p></article><div class='sidebar'><article><p>Other.</p></article></div>",
    f"<article><p>{BODY}</p></article><article id='comment-7'><p>I agree.</p></article>",
])
def test_comments_are_no_text(page):
    check(page, [BODY])


@pytest.mark.parametrize(("part", "kept"), [
    ("<section id='related-work'><p>Others did less.</p></section>", "Others did less."),
    ("<section id='related'><p>Others did less.</p></section>", "Others did less."),
    ("<h2 id='discussion'>Discussion</h2>", "Discussion"),
    ("<h2 id='comments' class='title'>Comments</h2>", "Comments"),
    ("<div id='search-results'><p>We found two.</p></div>", "We found two."),
    ("<p class='notice-period'>Three months.</p>", "Three months."),
    ("<p>A <span class='social'>social</span> matter.</p>", "A social matter."),
    ("<div class='ad-slot-3'>Buy.</div>", None),
    ("<div class='comment-list'><p>Me too.</p></div>", None),
    ("<div class='related links'><a href='a'>One</a> <a href='b'>Two</a></div>", None),
    ("<div class='search'>Find <input name='q'></div>", None),
])
def test_names_drop_no_sections(part, kept):
    check(f"<article><p>{BODY}</p>{part}<p>Last.</p></article>", [BODY, *([kept] if kept else []), "Last."])


def test_ids_of_headings_name_no_part_without_an_article():
    check(f"<div><h2 id='discussion'>Discussion</h2><h2 id='header'>Header</h2><p>{BODY}</p></div>", ["Discussion", "Header", BODY])


LONG = [f"{i} " + "word " * 98 + "end" for i in range(10)]
PARAGRAPHS = "".join(f"<p>{p}</p>" for p in LONG)


@pytest.mark.parametrize("page", [
    "<body><div>{0}<div class='ad'>Buy.</div>{1}</div></body>",
    "<body>{0}<form>Mail <input name='m'></form>{1}</body>",
    "<div><section>{0}</section></div><div>{0}<aside>No.</aside><section>{1}</section></div>",
])
@pytest.mark.parametrize("end", [["Short end."], ["last " * 100 + "word"], ["a " * 30 + "b", "Short end."]])
def test_what_follows_an_advert_is_kept(page, end):
    got = main_text(page.format(PARAGRAPHS, "".join(f"<p>{p}</p>" for p in end))).split("\n")
    assert got[-len(LONG) - len(end):] == LONG + end


def test_sidebars_of_unmarked_pages_are_left_out():
    side = "<div><p>" + "side " * 30 + "</p></div>"
    check(f"<body><div id='page'><div>{PARAGRAPHS}</div><nav>Menu</nav>{side}</div></body>", LONG)


def test_formulas_and_objects_are_part_of_their_line():
    page = ("<article><p>Energy is <math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi></mrow><annotation>E=m</annotation></semantics></math> in this case, "
            "as <object data='x'>the drawing</object> shows.</p><p>Next.</p></article>")
    assert main_text(page) == "Energy is E=m in this case, as the drawing shows.\nNext."


def test_dropped_inline_elements_do_not_break_a_line():
    for inline in ("<svg><title>icon</title></svg>", "<select><option>a</option></select>", "<video>old browser</video>", "<iframe src=x>no</iframe>", "<canvas>no</canvas>"):
        assert main_text(f"<article><p>One line {inline}goes on here.</p></article>") == "One line goes on here."


def test_lead_of_an_unmarked_page_is_kept():
    body = "This paragraph is the body of the page and long enough to make the sums of lengths surge at once."
    page = f"<body><p>Intro text is short.</p><ul><li><a href=a>First part</a></li><li><a href=b>Second part</a></li></ul><p>{body}</p><p>{body}</p></body>"
    assert main_text(page) == f"Intro text is short.\nFirst part\nSecond part\n{body}\n{body}"
