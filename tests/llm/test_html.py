import html as entities
import random
from html.parser import HTMLParser

import pytest

from clickweir.llm import html
from clickweir.llm.html import main_text

ARTICLE = "<h1>A &amp; B</h1><p>First\n  para&shy;graph with&nbsp;<b>bold</b>face.<p>Second<br>line</p><p> </p><div>It&#39;s &lt;em&gt; &unknown; &amp;amp;</div>"
WANT = "A & B\nFirst para­graph with boldface.\nSecond\nline\nIt's <em> &unknown; &amp;"


def test_article_among_other_blocks():
    page = ("<!DOCTYPE html><html><head><title>T</title><script>var a='</p><article>no';</script><style>p{}</style></head><body>"
            "<header><p>Site name</p></header><nav><ul><li><a href='/x>y'>Menu</a></li></ul></nav><!-- <p>gone</p> --><div class='cookie-notice'>We use cookies</div>"
            f"<aside>Side</aside><article>{ARTICLE}<div class='ad'><div>Buy</div> now</div><form>Mail <input></form><p>End.</p></article>"
            "<section id=comments><article class=comment><p>Great post</p></article></section><footer>&copy; x</footer></body></html>")
    assert main_text(page) == WANT + "\nEnd."


def test_surge_and_dive_without_article():
    text = "A sentence that is long enough to count as running text on its own, with more words."
    page = (f"<div><a href=a>One</a></div><div><a href=b>Two</a></div><div><a href=b>Three</a></div><div><a href=b>Four</a></div><h2>Head</h2><p>{text}</p>"
            f"<p>Short.</p><p>{text}</p><p><a href=c>Next</a></p><p><a href=c>Next</a></p><p><a href=c>Next</a></p><p><a href=c>Next</a></p><p>Tail</p>")
    assert main_text(page) == f"Head\n{text}\nShort.\n{text}"
    assert main_text("just text &lt;") == "just text <"
    assert main_text("<p>tiny</p>") == "tiny"


def test_teaser_articles_beside_a_div_body():
    text = "A sentence that is long enough to count as running text on its own, with more words."
    body = "".join(f"<p>{text} {n}</p>" for n in range(9))
    want = "\n".join(f"{text} {n}" for n in range(9))
    card = "<article class=card><h3><a href=x>Some other page</a></h3><p>A short teaser.</p></article>"
    assert main_text(f"<body>{card * 3}<div>{body}</div>{card * 3}</body>") == want
    assert main_text(f"<section>{body}</section><article><p>tiny</p></article>") == want
    assert main_text(f"<article><p>{text}</p><p>Intro.</p></article><div>{body}</div>") == f"{text}\nIntro.\n{want}"


def test_article_lines_weigh_more_than_others():
    text = "A sentence that is long enough to count as running text on its own, with more words."
    links = "<p><a href=c>Next</a></p>" * 4
    page = f"<div>Place</div><article><h1>Head</h1><p>{text}</p>{links}<p>End.</p></article><div>Date</div>"
    assert main_text(page) == f"Head\n{text}\nNext\nNext\nNext\nNext\nEnd."
    assert main_text(f"{page}<div><p>{text[2:]}</p></div>") == f"Head\n{text}\nNext\nNext\nNext\nNext\nEnd.\nDate\n{text[2:]}"
    assert main_text("<div>Home</div><article>" + "<li>word</li>" * 99 + f"</article><div>{text}</div>") == "\n".join(["word"] * 99 + [text])


@pytest.mark.parametrize("tag", [
    "blockquote cite='https://x.org/hidden/path'", 'section aria-label="hidden costs explained"', 'div data-state="not hidden"', "div data-id='related'",
    "div data-role=navigation", "div data-class=ad", "div title='id=menu class=ad role=search'", "div title=\"it's hidden\" lang=en", "div data-x=a/hidden",
    "div x-hidden", "div hidden-x=1", "div id.x=menu", "div data-style='display:none'", "div class=text class=ad", "div title = hidden"])
def test_attribute_values_and_longer_names_drop_nothing(tag):
    name = tag.split()[0]
    assert main_text(f"<article><{tag}><p>Kept.</p></{name}><p>End.</p></article>") == "Kept.\nEnd."


@pytest.mark.parametrize("tag", [
    "div hidden", "div HIDDEN=''", "div title='x' hidden", "div\nhidden class=text", "div id=menu", "div ID = 'related'", 'div data-x="y"class="ad"', "div role=' Navigation '",
    "div aria-hidden=true", "div style='color:red; display : none'", "div class=\"text ad\"", "div title=a/b hidden"])
def test_attributes_that_drop_an_element(tag):
    assert main_text(f"<article><{tag}><p>Gone.</p></div><p>End.</p></article>") == "End."


def test_broken_markup():
    assert main_text("<nav><li>x<article><p>kept &am") == "kept &am"
    assert main_text("<article><p>a</p><script>never closed <p>b") == "a"
    assert main_text("<article><p class=\"x>a</p><p>b</p></article>").endswith("b")
    assert main_text("<article><p>1 < 2 and 3 > 2</p><p>a<") == "1 < 2 and 3 > 2\na<"
    assert main_text("<article>" + "<p>w" * 50_000) == "\n".join("w" * 50_000)
    assert main_text("<" * 30_000) is not None


LONG = "A sentence that is long enough to count as running text on its own, with more words."


@pytest.mark.parametrize("tag", ['article class="post has-sidebar"', 'div class="content has-sidebar"', 'article class="post comments-open"', 'main class="no-comments"',
                                 'section id="market-share"', 'section id="social-policy"', 'div class="entry-header"', 'div id="main" class="sidebar"', "div class=header"])
def test_names_that_only_hold_such_a_word_drop_nothing(tag):
    name = tag.split()[0]
    assert main_text(f"<body><nav>Menu</nav><{tag}><h1>Head</h1><p>{LONG}</p><p>End.</p></{name}></body>") == f"Head\n{LONG}\nEnd."


@pytest.mark.parametrize("name", ["cookie-notice", "site-header", "main-nav", "ad-slot", "ad_300x250", "comment-list", "left-sidebar", "related-posts", "share-buttons", "newsletter-signup", "post-comments"])
def test_names_made_of_such_words_drop_an_element(name):
    assert main_text(f"<article><p>{LONG}</p><div class='x {name}'><p>{LONG} Gone.</p></div><p>End.</p></article>") == f"{LONG}\nEnd."
    assert main_text(f"<body><p>{LONG}</p><div id={name}><p>{LONG} Gone.</p></div></body>") == LONG


def test_pages_without_an_article():
    assert main_text(f"<nav><a href=x>Home</a></nav><div class=ad>{LONG}</div><div id=comments><p>{LONG}</p><p>{LONG}</p></div><footer>{LONG}</footer>") == ""
    assert main_text("<div class=sidebar>Short.</div>") == ""


@pytest.mark.parametrize("tag", ["<svg class=icon/>", "<svg/>", "<svg class='icon' />", "<svg><svg><path d=x /></svg></svg>", "<svg><title>Gone</title></svg>", "<button-bar></button-bar>",
                                 "<button-bar/>", "<button>Share", "<button type=submit><b>Share</b>", "<button>Share</button>", "<button>Share<button>Mail</button>", "<select><option>One</select>",
                                 "<noscript><p>Gone</p></noscript>", "<template><p>Gone</p></template>", "<object data=x />", "<iframe src='x' />", "<iframe src=x>Gone</iframe>",
                                 "<script src='x' />", "<script src=https://x.org/>gone('<p>')</script>", "<scripted-part></scripted-part>", "<textarea><p>Gone</textarea>", "<script-x>"])
def test_elements_that_end_where_they_end(tag):
    assert main_text(f"<body><article><p>{LONG}</p>{tag}<p>Second.</p></article><p>Tail</p></body>") == f"{LONG}\nSecond."
    assert main_text(f"<body><p>{LONG}</p>{tag}<p>{LONG} Second.</p></body>") == f"{LONG}\n{LONG} Second."


class Marked(HTMLParser):
    """Texts of the elements that a generated page marks as its article's blocks."""

    def __init__(self, page):
        super().__init__()
        self.texts, self.open = [], 0
        self.feed(page)

    def handle_starttag(self, tag, attributes):
        if "data-truth" in dict(attributes):
            self.texts.append("")
            self.open = 1
        elif self.open:
            self.open += 1

    def handle_endtag(self, tag):
        self.open = max(0, self.open - 1)

    def handle_data(self, data):
        if self.open:
            self.texts[-1] += data


def generated(pick, element):
    def words(least, most):
        return entities.escape(" ".join("".join(pick.choices("abcdeéß&<", k=pick.randint(1, 9))) for _ in range(pick.randint(least, most))))

    def block():
        one = words(20, 60)
        return pick.choice([f"<p data-truth>{one}</p>", f"<p data-truth><b>{one}</b> {words(1, 5)}</p>", f"<blockquote data-truth>{one}</blockquote>", f"<p data-truth>{one} <em>x</em></p>"])

    def between():
        return pick.choice(["", "", "<svg class=icon/>", "<!-- <p>x</p> -->", "<div class=ad><p>Buy it</p></div>", "<script>var x='<p>no</p>'</script>", "<part-bar></part-bar>",
                            "<form><input>Mail us</form>", "<button>Share</button>", "<div class='share-buttons'><a href=x>Share</a></div>", "<img src=x>"])

    def around():
        return pick.choice([f"<nav><ul>{''.join(f'<li><a href=x>{words(1, 3)}</a></li>' for _ in range(pick.randint(1, 9)))}</ul></nav>", f"<div class='site-header'><p>{words(5, 60)}</p></div>",
                            f"<div id=cookie-notice>{words(10, 50)}</div>", f"<aside><p>{words(20, 60)}</p></aside>", f"<div class='left-sidebar'><p>{words(20, 60)}</p></div>",
                            f"<section class=comments>{''.join(f'<div><p>{words(20, 60)}</p></div>' for _ in range(pick.randint(1, 9)))}</section>", f"<footer>{words(5, 60)}</footer>"])

    opening = pick.choice(["article", "main", "article class='post has-sidebar'", "main class=no-comments"] if element else ["div", "section id=market-share", "div class='content has-sidebar'"])
    blocks = "".join(block() + between() for _ in range(pick.randint(1, 12)))
    head, end = (f"<h1 data-truth>{words(2, 8)}</h1>", f"<p data-truth>{words(1, 4)}</p>") if element else ("", "")
    outside = [[around() for _ in range(pick.randint(0, 4))] for _ in range(2)]
    return f"<html><head><title>{words(2, 5)}</title></head><body>{''.join(outside[0])}<{opening}>{head}{blocks}{end}</{opening.split()[0]}>{''.join(outside[1])}</body></html>"


@pytest.mark.parametrize("element", [True, False])
def test_against_the_marked_blocks_of_generated_pages(element):
    pick = random.Random(element)
    for _ in range(1000):
        page = generated(pick, element)
        assert main_text(page) == "\n".join(" ".join(text.split()) for text in Marked(page).texts), page


def test_many_unclosed_elements():
    assert main_text("<article>" + f"<p>w<svg><button>x" * 30_000) == "\n".join("w" * 30_000)


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", ARTICLE), (2, None, None), (3, "u", ""), (None, "u", "<nav>x</nav>"), (1, "u", ARTICLE)],
                                  "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = html.extract(pages).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, WANT, len(WANT)), (1, WANT, len(WANT)), (2, "", 0), (3, "", 0)]
    assert html.extract(pages.limit(0)).count() == 0
