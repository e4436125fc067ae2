"""Main text of pages of several make-ups, and of broken ones."""

import random
import time

import pytest

from laborlake.llm import main_text

from .conftest import sentence

RNG = random.Random(8)
PARAGRAPHS = [". ".join(sentence(RNG, 9).capitalize() for _ in range(6)) + "." for _ in range(5)]
SHORT = "Ends here."
STORY = ["A title, short", *PARAGRAPHS, SHORT]
BODY = "".join(f"<p>{p}</p>" for p in [*PARAGRAPHS, SHORT])
MENU = "<ul><li><a href=/a>Home page</a><li><a href=/b>About us all</a><li><a href=/c>Contact</a></ul>"
TALK = "".join(f"<p>{p}</p>" for p in PARAGRAPHS[:3])


def text(source):
    return "\n".join(main_text.content(main_text.Page(source)))


@pytest.mark.parametrize(
    "source",
    [
        f"<article><h1>A title, short</h1>{BODY}</article>",
        f"<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1>{MENU}</header><main><h1>A title, short</h1>{BODY}</main>"
        f"<aside>{TALK}</aside><footer>Copyright us, all rights.</footer></body></html>",
        f"<div id=page><div class=top-menu>{MENU}</div><div class=x1><h1>A title, short</h1>{BODY}</div><div id=sidebar>{TALK}</div></div>",
        f"<div><div>{MENU}</div><div><h1>A title, short</h1>{BODY}</div><div><p>Some words</p>{MENU}</div></div>",
        f"<body class='has-sidebar'><article class='post with-comments'><header><h1>A title, short</h1></header>{BODY}"
        f"<section id=comments>{TALK}</section></article></body>",
        f"<article><h1>A title, short</h1><div class='cookie-notice'>{TALK}</div><form><p>Your mail</p><input><button>Go</button></form>{BODY}"
        f"<div class=commentList><div>{TALK}</div></div></article>",
        f"<table><tr><td>{MENU}<td><h1>A title, short</h1>{BODY}</table>",
        f"<article><h1>A title, short</h1><script>if (a<b) x='</article><p>no'; // </p></script><!-- <p>no</p> -->{BODY}<noscript>Turn it on</noscript></article>",
        f"<ARTICLE><H1>A title,\n <i>sho</i>rt</H1>{BODY.replace('<p>', '<P CLASS=p>').replace('</p>', '')}<aDSide hidden>x</aDSide></ARTICLE>",
        f"<article><h1>A title, short{BODY}<nav>{MENU}",
    ],
)
def test_the_article_and_nothing_else(source):
    assert text(source) == "\n".join(STORY)


def test_blocks_and_signs():
    assert text("<article><p>a&nbsp; b<br>c &amp;amp; &lt;d&gt; &eacute;&#x41;<p>x<b>y</b>z\n\t w<ul><li>one<li>two &copy 3</ul>tail</article>") == "a b c &amp; <d> éA\nxyz w\none\ntwo © 3\ntail"
    assert text("<article><p>1 < 2 & 3 > 2<p title='a>b' class=\"c>d\">k<![CDATA[x]]><?php y ?></p>l</article>") == "1 < 2 & 3 > 2\nk\nl"
    assert text("<article><p>see <a href=#>the whole of it</a>.</p><b><p>one</b> two</p></article>") == "see the whole of it.\none two"
    assert text("<article><p>a<button>press</button>b<span hidden>c</span></p></article>") == "a b"


def test_lists_and_cells_inside_an_article_stay():
    source = f"<article><h1>A title, short</h1>{BODY}<ul><li>one<li>two</ul><table><tr><th>k<td>v</table><blockquote>said</blockquote></article>"
    assert text(source) == "\n".join([*STORY, "one", "two", "k", "v", "said"])


def test_pages_without_content_and_broken_ones():
    nothing = ["", " ", "<p", "<!--", "<script>", "<article></article>", "<nav>a</nav>", "</p></div>", "<a href='", "<!", "<head><title>x</title>"]
    assert {text(source) for source in nothing} == {""}
    assert [text(source) for source in ("<", "&", "a<br>b", "<body>a")] == ["<", "&", "a b", "a"]


@pytest.mark.parametrize("piece", ["<div>a", "<b>a", "<p><b><i>a", "<a href='x", "<", "</div>", "<!-- ", "<td>a", "<ul><li>a", "<a b=", "<b></p>", "<div class=a id=b>x</b>"])
def test_long_pages_take_time_by_their_length(piece):
    began = time.process_time()
    main_text.content(main_text.Page(piece * 40_000))
    assert time.process_time() - began < 20


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars long, page string"
    rows = [(1, "u", "<article><p>Hi 漢 \U0001f600</p></article>", "t", 9, "p"), (None, None, None, None, None, None), (2, "v", "", "t", 9, "p")]
    out = main_text.extract(spark.createDataFrame(rows * 2, schema))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted([(1, "u", "Hi 漢 \U0001f600", 6), (None, None, "", 0), (2, "v", "", 0)] * 2, key=repr)
    assert main_text.extract(spark.createDataFrame([], schema)).count() == 0
