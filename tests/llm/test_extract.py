from trendloom.llm.extract import extract_pages, main_text

ARTICLE = (
    "<article><h1>Head &amp; line</h1><p><b>First one, with a comma, and words enough to count as a paragraph.<br>"
    "<p>Second\n  one &mdash; short.</p><p>Ti.</p><div>Loose <i>inline</i> text<p>inner</p>tail</div>"
    "<ul><li>item <a href=x>one</a></li><li>item two</ul><p>a &lt; b &amp c</p></article>"
)
WANT = "\n\n".join([
    "Head & line", "First one, with a comma, and words enough to count as a paragraph.", "Second one — short.", "Ti.",
    "Loose inline text", "inner", "tail", "item one", "item two", "a < b & c",
])


def _page(body):
    return (
        '<!DOCTYPE html><html><head><title>No</title><style>p{margin:0}</style><script>var t="</p>";track(0);</script></head><body>'
        '<header><h1>Site, the best, site, of, all</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad <p>x</p> -->'
        '<div class="ad">Buy, now, this, and, that, and more of it all.</div><div class="cookie-notice">We use cookies, many, many.</div>'
        f"{body}<aside><p>Side, bar, text, with, commas, and, more, words in it.</p></aside>"
        '<section id="comments"><p>First, comment, with, very, many, commas, and, words, in, it, from a reader.</p></section>'
        "<form><p>Sign, up, here, please, now, and get, much more mail.</p><input value='p'></form>"
        "<footer>&copy; host &middot; rights.</footer></body></html>"
    )


def test_article_in_full_and_nothing_else():
    assert main_text(_page(ARTICLE)) == WANT


def test_plain_containers_win_by_score():
    body = ARTICLE.replace("<article>", '<div><div class="box">').replace("</article>", "</div></div>")
    assert main_text(_page(body)) == WANT


def test_cut_off_pages_and_odd_markup():
    assert main_text(_page(ARTICLE).split("</article>")[0]) == WANT
    assert main_text("<p>1 < 2 and a<b, that is, some words to hold on to here") .startswith("1 < 2 and a")
    assert main_text(None) == main_text("") == main_text("<nav>only</nav>") == ""
    assert main_text("plain text &amp; no tags") == "plain text & no tags"
    deep = "<b>" * 20_000 + "word, " * 20
    assert main_text(f"<body><p>{deep}") == " ".join(["word,"] * 20)


def test_comments_and_adverts_inside_the_article_go():
    inner = ARTICLE.replace("<p>Ti.</p>", '<p>Ti.</p><div class="advert"><p>Buy, it.</p></div><script>x()</script>'
                            '<section class="post-comments"><p>Reader, says, so.</p></section>')
    assert main_text(_page(inner)) == WANT


def test_job_keeps_every_row(spark):
    rows = [(1, "u", _page(ARTICLE), "clash"), (1, "u", _page(ARTICLE), "clash"), (2, None, None, None), (None, "v", "", "x"),
            (3, "w", "<article><p>" + "long, word " * 100_000 + "</article>", "")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (1, len(WANT)), (1, len(WANT)), (2, 0), (3, 1_099_999)]
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_unmatched_tags_cost_linear_time():
    import time

    from trendloom.llm.extract import Page

    def seconds(n):
        pages = ["<b>" * n + "</i>" * n, "<b>" * n + "<div></div>" * n, "<b>" * n + "<li></li>" * n]
        start = time.process_time()
        for html in pages:
            Page(html + "text")
        return time.process_time() - start

    seconds(2000)
    assert seconds(32_000) < 40 * max(seconds(2000), 0.005)  # 16 times the tags; quadratic would be 256 times
