"""Pages whose end tags are missing keep their text."""

from html.parser import HTMLParser

import pytest

from weftline.llm import html_text
from weftline.llm.html_text import main_text

BODY = "<body><article><p>" + "Words of the article go on and on. " * 8 + "</p>{}<p>" + "Its last lines are here as well. " * 8 + "</p></article></body>"
WANT = html_text.main_text("<html><head><title>t</title></head>" + BODY.format("") + "</html>")


@pytest.mark.parametrize("head", ["<head><title>t</title>", "<head><meta charset=utf-8><title>t</title><style>p {}</style>", "<head><title>t</head>", "<head><title>t", "<head><style>p {}</head>", "<head><script>'</head>'</script></head>", "<head>"])
def test_head(head):
    assert "last lines" in WANT and html_text.main_text("<html>" + head + BODY.format("") + "</html>") == WANT


@pytest.mark.parametrize("tag", ["select", "svg", "object", "video", "audio", "canvas"])
def test_only_the_tag_goes(tag):
    assert html_text.main_text("<html>" + BODY.format(f"<{tag} width=1>") + "</html>") == WANT
    if tag not in ("svg", "object"):  # whose text is text of the article
        assert html_text.main_text("<html>" + BODY.format(f"<{tag}>not shown</{tag}>") + "</html>") == WANT


def test_math_is_text():
    got = html_text.main_text("<html>" + BODY.format("<p>where <math><semantics><mi>qx</mi><annotation>TeX</annotation></semantics></math> holds</p>"))
    assert "where qx holds" in got and "TeX" not in got


def test_raw_text_reaches_to_the_end():
    got = html_text.main_text("<html>" + BODY.format("<script>let x"))
    assert "Words of the article" in got and "let x" not in got and "last lines" not in got


LINKS = "<ul><li><a href=a>one two</a></li><li><a href=b>three</a></li><li><a href=c>four five six</a></li></ul>"


def test_word_counts_and_link_densities_decide():
    """Where element and class names say the same, the blocks' own and their neighbours' features differ."""
    long = "word " * 30
    inside = f"<article><h1>Title</h1><p>{long}</p>{LINKS}<p>{long}</p><p><a href=d>one link alone</a></p><p>the end.</p></article>"
    assert main_text(inside) == "\n\n".join(["Title", long.strip(), long.strip(), "one link alone", "the end."])
    plain = f"<div>{LINKS}</div><div><p>{long}</p><p>short one</p><p>{long}</p></div><div>{LINKS}</div>"  # no name at all
    assert main_text(plain) == "\n\n".join([long.strip(), "short one", long.strip()])
    cuts, todo = set(), [html_text.tree()]
    while todo:
        t = todo.pop()
        if t.cut:
            cuts.add(t.cut[0])
            todo += [t.below, t.above]
    assert cuts >= {0, 1, 3, 4, 5}  # words, link density, the neighbours' densities and words


class Articles(HTMLParser):
    """The blocks inside article elements, by the library's parser."""

    def __init__(self):
        super().__init__()
        self.depth, self.blocks, self.text = 0, [], []

    def cut(self):
        if whole := " ".join("".join(self.text).split()):
            self.blocks.append(whole)
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "p", "h1"):
            self.cut()
        self.depth += tag == "article"
        if tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in ("article", "p", "h1"):
            self.cut()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.text.append(data)


def test_against_another_parser(data, duck):
    for page, text in duck.sql("SELECT page_id, html FROM pages").fetchall():
        p = Articles()
        p.feed(text or "")
        p.close()
        assert main_text(text) == "\n\n".join(p.blocks), page


def test_very_long_and_equal_pages():
    long = "<article>" + "<p>" + "many words " * 40_000 + "</p>" * 2 + "<p>more of it</p>" * 2000
    assert main_text(long).count("\n\n") == 2000 and main_text(long) == main_text(long)
    assert main_text("<p>" * 50_000) == "" and main_text("<" * 50_000 + "a") is not None


def test_shown_text_of_other_elements():
    assert main_text("<article><p>Let <math><mi>x</mi></math> be one.</p><svg><text>Label</text></svg><object>Fallback</object></article>") == "Let x be one.\n\nLabelFallback"
