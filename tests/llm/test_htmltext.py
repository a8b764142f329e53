import itertools
import random
import re
import time
from html import unescape

import pytest

from commitscope.llm import htmltext

from .conftest import SF

BODY = "".join(f"<p>Paragraph {i} of the story tells &amp; retells&nbsp;it.</p>\n" for i in range(5))
WANT = "\n\n".join(f"Paragraph {i} of the story tells & retells it." for i in range(5))


def brute_best(scores):
    best, found = 0.0, (0, 0)
    for a, b in itertools.combinations(range(len(scores) + 1), 2):
        if sum(scores[a:b]) > best + 1e-9:
            best, found = sum(scores[a:b]), (a, b)
    return best, found


def test_best_run():
    rng = random.Random(1)
    for _ in range(200):
        scores = [float(rng.randint(-3, 3)) for _ in range(rng.randint(0, 14))]
        a, b = htmltext.best_run(scores)
        assert sum(scores[a:b]) == pytest.approx(brute_best(scores)[0])


@pytest.mark.parametrize("before,after", [
    ("<nav><ul><li><a href=/>Home</a><li><a href=/b>News of the day</a></ul></nav>", "<footer>All rights</footer>"),
    ("<header><h2>Site name</h2></header>", "<aside>Read this too, it is very long indeed</aside>"),
    ("<div class='cookie-notice'>We use cookies, do you agree</div>", "<div id=comments><p>First!</p><p>Nice one</p></div>"),
    ("<form><label>Search</label><input name=q><button>Go</button></form>", "<div class=\"ad ad-300\">Buy now</div>"),
    ("<script>var a = '<p>no</p>';</script><style>p{x:y}</style>", "<!-- <p>no</p> --><noscript>Turn it on</noscript>"),
    ("<div role=navigation>Menu one two</div>", "<p hidden>Not seen</p><div style='display: none'>nor this</div>"),
    ("<ul class='breadcrumbs'><li>Home<li>Sport</ul>", "<section class=related-posts><h3>More</h3><p>Other</p></section>")])
@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main>{}</main>", "<div id=content>{}</div>", "{}"])
def test_main_text(before, after, frame):
    html = f"<!DOCTYPE html><html><head><title>T</title></head><body>{before}{frame.format(BODY)}{after}</body></html>"
    assert htmltext.extract(html) == WANT


@pytest.mark.parametrize("wrapper", [
    "<div class='post comments-open'>{}</div>", "<div id=page class='cookies-accepted'>{}</div>",
    "<div class=has-share><div class='related-on'>{}</div></div>", "<article><div class='entry-content has-related'>{}</div></article>",
    "<article><div class='social-ready'>{}</div></article>", "<div class='form'><main><div id=notice-free>{}</div></main></div>"])
def test_wrappers_named_like_asides(wrapper):
    before, after = "<div class=ad>Buy now</div>", "<div id=comments><p>First!</p></div>"
    links = "<div>" + "<p>A teaser of some other page and its very long headline</p>" * 12 + "</div>"
    assert htmltext.extract(before + wrapper.format(BODY + after)) == WANT
    if "<article>" in wrapper or "<main>" in wrapper:
        assert htmltext.extract(links + wrapper.format(before + BODY) + links) == WANT


@pytest.mark.parametrize("frame", ["{}", "<article>{}</article>", "<div class='share-on'>{}</div>"])
def test_comments_longer_than_the_text_go(frame):
    thread = "<div id=comments>" + "<div class=comment-body><p>I read it all and I liked it.</p></div>" * 30 + "</div>"
    assert htmltext.extract(frame.format(f"<div class='post comments-open'>{BODY}</div>{thread}")) == WANT
    assert htmltext.extract(frame.format(BODY + thread)) == WANT


def test_asides_within_an_article_go():
    html = f"<article>{BODY}<aside>Elsewhere</aside><div class=advert><p>Buy</p></div><p>The end<br>of it</p>" \
           "<table><tr><td>a<td>b</tr></table></article>"
    assert htmltext.extract(html) == WANT + "\n\nThe end of it\n\na b"


@pytest.mark.parametrize("html,want", [
    (None, ""), ("", ""), ("   ", ""), ("<p>", ""), ("just words", "just words"), ("<p>a<p>b", "a\n\nb"),
    ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"), ("<p>cut <b>off", "cut off"), ("<p>x</p><a href=\"", "x"),
    ("<p>&lt;b&gt; &#233; &eacute; &amp;amp; &unknown;</p>", "<b> é é &amp; &unknown;"),
    ("<p title=\"a > b\">x</p>", "x"), ("<P CLASS=Ad>x</P><P>y</P>", "y"), ("<nav>n<article>a</article>", "a")])
def test_odd_pages(html, want):
    assert htmltext.extract(html) == want


@pytest.mark.parametrize("script", [
    "<script>for(i=0;i<n;i++){} // don't</script>", "<script>if (a <b) x = \"it's</script>", "<script>s = '<!--'</script>",
    "<script>document.write('<p title=\\'')</script>", "<style>/* <b ' */</style>", "<textarea><i '</textarea>",
    "<script>a<b</script><script>c<d '</script >", "<title>1 <x \"</title>"])
@pytest.mark.parametrize("frame", ["{}<article>{}</article>", "<article>{}{}</article>", "<div id=content>{}{}</div>"])
def test_scripts_that_look_like_tags(script, frame):
    body = "<p>It's the first.</p><p class=\"x\">And it's the \"second\".</p>" + BODY
    html = f"<body>{frame.format(script, script.join([body, '']))}<nav>Don't</nav></body>"
    assert htmltext.extract(html) == "It's the first.\n\nAnd it's the \"second\".\n\n" + WANT
    assert htmltext.tag_counts(html) == htmltext.tag_counts(re.sub("(?s)(<(script|style|textarea|title)>).*?(</\\2)", r"\1\3", html))


COMMENT = "<article class=\"{}\"><footer>Someone</footer><p>I read it all, twice, and I liked it a lot.</p></article>"


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main>{}</main>", "<div id=content>{}</div>",
                                   "<article class='post has-related'>{}</article>", "<div class='with-sidebar'><article>{}</article></div>"])
@pytest.mark.parametrize("thread", [
    "<section id=comments>{}</section>", "<div class='comments-area'><ol><li>{}</ol></div>", "{}"])
@pytest.mark.parametrize("name", ["comment-body", "comment", "comment even depth-1"])
def test_comments_in_articles_of_their_own_go(frame, thread, name):
    comments = thread.format(COMMENT.format(name) * 12)
    assert htmltext.extract(f"<body>{frame.format(BODY)}{comments}</body>") == WANT
    assert htmltext.extract(f"<body>{frame.format(BODY + comments)}</body>") == WANT


def test_one_comment_longer_than_the_article_goes():
    rant = "<article class=comment-body><p>" + "No, no and no. " * 100 + "</p></article>"
    assert htmltext.extract(f"<article>{BODY}</article><section id=comments>{rant}</section>") == WANT
    assert htmltext.extract(f"<article>{BODY}</article>{rant}") == WANT


@pytest.mark.parametrize("teasers", [
    "<aside class=related>{}</aside>", "<div class=related-posts>{}</div>", "<div id=sidebar>{}</div>", "<nav>{}</nav>",
    "<footer>{}</footer>"])
@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main><div>{}</div></main>",
                                   "<div id=page class='cookies-accepted'><article>{}</article></div>"])
def test_teasers_in_articles_go(teasers, frame):
    cards = teasers.format("<article class=card><h3>Another page</h3><p>and what it is about</p></article>" * 9)
    assert htmltext.extract(cards + frame.format(BODY) + cards) == WANT


def test_wrapped_page_with_a_short_free_article():
    html = f"<article class=card><p>Short one</p></article><div class='cookies-accepted'><main>{BODY}</main></div>"
    assert WANT in htmltext.extract(html)


@pytest.mark.parametrize("between", [
    "<figure><img src=a></figure>" * 150, "<div></div>" * 200, "<aside><p>" + "Buy this and that. " * 200 + "</p></aside>",
    "<div class=ad><p>Buy now, buy here, buy it all</p></div>" * 3, "<table>" + "<tr><td><td></tr>" * 300 + "</table>"])
@pytest.mark.parametrize("frame", ["<article>{}</article>", "<nav>A menu</nav><main>{}</main><footer>All rights</footer>"])
def test_no_block_of_an_article_is_lost(between, frame):
    assert htmltext.extract(frame.format("<p>The intro.</p>" + between + BODY)) == "The intro.\n\n" + WANT
    assert htmltext.extract(frame.format(BODY + between + "<p>The end.</p>")) == WANT + "\n\nThe end."


@pytest.mark.parametrize("opening,closing", [
    ("<div>", "</div>"), ("<div>", ""), ("<span>", ""), ("<div class=comment>", ""), ("<article>", "</article>"),
    ("<p><div><span><hr>", ""), ("<ul><li>", ""), ("<b>x</i>", ""), ("<div class=sidebar>y", "</div>")])
def test_depth_costs_no_more_than_length(opening, closing):
    def seconds(n):
        html = "<p>start</p>" + opening * n + BODY + closing * n
        began = time.process_time()
        htmltext.extract(html)
        return time.process_time() - began
    seconds(1_000)
    # A quadratic walk would take 256 times as long.
    assert seconds(64_000) < 60 * max(seconds(4_000), 0.01)


DIV = 0.0537123  # no sum of these and of whole words ties


def brute_extract(words, tags_open, tags_close):
    """Kept words of an unmarked page of blocks: the run of blocks with the
    largest sum, every run tried."""
    scores = [len(w) - DIV * (o + c) for w, o, c in zip(words, tags_open, tags_close)]
    best, kept = 0.0, []
    for a, b in itertools.combinations(range(len(words) + 1), 2):
        # Tags before the first and behind the last word needn't be taken.
        total = sum(scores[a:b]) + DIV * (tags_open[a] + tags_close[b - 1])
        if words[a] and words[b - 1] and total > best + 1e-9:
            best, kept = total, words[a:b]
    return "\n\n".join(" ".join(w) for w in kept if w)


def test_small_pages_against_all_runs():
    rng = random.Random(3)
    for _ in range(300):
        words, opens, closes, html = [], [], [], []
        for _ in range(rng.randint(1, 7)):
            w = [rng.choice("abc") for _ in range(rng.choice([0, 0, 1, 2, 5]))]
            k = rng.choice([1, 2, 15, 40])
            words.append(w), opens.append(k), closes.append(k)
            html.append("<div>" * k + " ".join(w) + "</div>" * k)
        assert htmltext.extract("".join(html), {"div": -DIV}) == brute_extract(words, opens, closes)


def test_very_long_page():
    html = "<article>" + "<p>word and word</p>" * 50_000 + "</article>"
    assert htmltext.extract(html).count("\n\n") == 49_999


def test_pages_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = htmltext.learn_weights(pages)
    assert weights["nav"] < weights["p"] < 0
    rows = htmltext.main_text(pages, weights).collect()
    assert len(rows) == pages.count()
    html = {r.page_id: r.html for r in pages.collect()}
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", html[r.page_id], re.S).group(1)
        blocks = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|li|ul)>", "\0", inner.replace("<br>", " "))).split("\0")
        assert r.text == "\n\n".join(b for b in (" ".join(unescape(b).split()) for b in blocks) if b)
        assert r.n_chars == len(r.text)


def test_nulls_and_empty_tables(spark):
    schema = "page_id long, url string, html string, text int, n_chars string"
    pages = spark.createDataFrame([(1, None, None, 1, "x"), (None, "u", "<p>a</p>", 2, None), (1, None, None, 1, "x")], schema)
    got = htmltext.main_text(pages, htmltext.learn_weights(pages)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(1, None, "", 0), (None, "u", "a", 1), (1, None, "", 0)], key=str)
    empty = pages.limit(0)
    assert htmltext.learn_weights(empty) == {} and htmltext.main_text(empty).count() == 0
