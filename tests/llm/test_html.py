from __future__ import annotations

from sparkloom.llm import html as H


def text_of(spark, *pages, host="h.example"):
    rows = [(i, f"https://{host}/{i}", p) for i, p in enumerate(pages)]
    return [r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="ad">Buy</div><div id="cookie-notice">We use cookies</div>
<article><h1>{title}</h1><p>{one} &amp; caf&eacute; &#x41;<p>Second <b>bold</b><br>line{two}<aside>Side</aside><form><label>Mail</label></form><ul><li>i1<li>i2</ul></article>
<section class="comments"><article class="comment"><p>Reader says</p></article></section><footer>&copy; Us</footer></body></html>"""


def fill(title, one, two):
    return PAGE.replace("{title}", title).replace("{one}", one).replace("{two}", two)


def test_article_without_the_rest(spark):
    got = text_of(spark, fill("A", "first  \n text", "!"), fill("B", "other", "?"))
    assert got == ["A\n\nfirst text & café A\n\nSecond bold line!\n\ni1\n\ni2", "B\n\nother & café A\n\nSecond bold line?\n\ni1\n\ni2"]


def test_copies_and_shared_paragraphs_keep_their_text(spark):
    page = fill("A", "same", "")
    assert len(set(text_of(spark, *[page] * 12))) == 1 and text_of(spark, *[page] * 12)[0].startswith("A\n\nsame")
    pages = [fill(f"T{i}", "shared paragraph" if i % 2 else f"own {i}", f" {i}") for i in range(12)]
    assert sum("shared paragraph" in t for t in text_of(spark, *pages)) == 6


def test_template_constants_go_in_articles_too(spark):
    """A notice that alignment finds on every page of a host, in no list of names."""
    pages = [f"<body><article><h1>T{i}</h1><div class=xyz><p>Read our terms before you go on</p></div><p>Story {i} {'word ' * (i + 9)}</p></article></body>" for i in range(12)]
    assert text_of(spark, *pages) == [f"T{i}\n\nStory {i} {('word ' * (i + 9)).strip()}" for i in range(12)]


def test_layouts_of_a_host_are_kept_apart(spark):
    """Pages of two templates: neither is measured by the other's pages."""
    story = lambda i: f"<body><div class=a><h1>T{i}</h1><p>Story {i} {'word ' * (i + 9)}</p></div><div class=b><p>Same below all stories of this site</p></div></body>"
    table = lambda i: "<body><table>" + "".join(f"<tr><td>cell {i} {k}</td><td>{i * k}</td></tr>" for k in range(12)) + "</table></body>"
    got = text_of(spark, *(story(i) if i % 2 else table(i) for i in range(40)))
    for i, text in enumerate(got):
        assert ("Same below" not in text) and text.startswith(f"T{i}\n\nStory {i}" if i % 2 else f"cell {i} 0")


def test_marks_do_not_empty_pages(spark):
    body = "<h1>Title {i}</h1>" + "".join(f"<p>Paragraph {k} of page {{i}} with some words that make it long enough.</p>" for k in range(6))
    for start, end in (("<form id=aspnet>", "</form>"), ("<div class='post-with-sidebar'>", "</div>"), ("<div class=share-price-report>", "</div>"), ("<div class=has-sidebar><aside>x</aside>", "</div>")):
        pages = [f"<html><body><nav>Home</nav>{start}{body.format(i=i)}{end}<footer>us</footer></body></html>" for i in range(3)]
        for i, text in enumerate(text_of(spark, *pages)):
            assert text.startswith(f"Title {i}\n\nParagraph 0") and text.count("Paragraph") == 6 and "Home" not in text and "us" not in text.split("\n\n"), start
    login = "<body><form><label>Name</label><p>Log in here please</p></form></body>"
    assert text_of(spark, login) == [""]


def test_deep_markup_loses_nothing(spark):
    deep = "<body><div><article><p>before</p>" + "<div>" * 300 + "<nav>menu</nav>deep" + "</div>" * 300 + "<p>after</p></article></div></body>"
    mixed = "<body><article><p>before</p>" + "<div><section>" * 300 + "deep" + "</section></div>" * 300 + "<p>after</p></article></body>"
    assert text_of(spark, deep, mixed) == ["before\n\ndeep\n\nafter"] * 2


def test_wide_levels_are_aligned_exactly(monkeypatch):
    import random

    random.seed(3)
    wide = lambda: "".join(random.choice(["<p>x</p>", "<ul><li>a</ul>", "<h2>h</h2>", "<div class=b><p>y</p></div>"]) for _ in range(60))
    for _ in range(5):
        a, b = H.Page(wide()).sign(), H.Page(wide()).sign()
        want = slow_match(a.root, b.root)
        assert H.tree_match(a.root, b.root, {}) == want
        monkeypatch.setattr(H, "TABLE_CELLS", 50)  # in halves
        assert H.tree_match(a.root, b.root, {}) == want
        monkeypatch.undo()


def test_extraction_matches_the_plain_rules(spark, sf):
    """Regions and constants by plain loops over all pages of a host, with every reference."""
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r.text for r in H.main_text(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    by_host: dict[str, list] = {}
    for r in rows:
        by_host.setdefault(r.url.split("/")[2], []).append((r.page_id, r.html, H.Page(r.html).sign()))
    for pages in by_host.values():
        for page_id, html, page in pages:
            others = [p for i, h, p in pages if h != html]
            constant = set.intersection(*(H.template_blocks(page, o) for o in others)) if len(others) >= 5 else set()
            text: dict[str, int] = {}
            for i, (holder, t, outside) in enumerate(page.blocks):
                if not outside and i not in constant:
                    text[H._place(holder)] = text.get(H._place(holder), 0) + len(t)
            best = max(text, key=text.get)  # every page of this table has its paragraphs in one element
            assert got[page_id] == "\n\n".join(t for i, (h, t, o) in enumerate(page.blocks) if not o and i not in constant and H._place(h) == best)


def test_wrapper_finds_content_without_an_article(spark):
    page = lambda i: f"<html><body><div class=top><p>Welcome to the site of everything</p></div><div class=text><p>Body {i} {'word ' * i}</p><p>More {i * 7}</p></div><div class=low><p>All rights reserved by us for ever</p></div></body></html>"
    got = text_of(spark, *(page(i) for i in range(1, 9)))
    assert got == [f"Body {i} {'word ' * i}".strip() + f"\n\nMore {i * 7}" for i in range(1, 9)]


def slow_match(a, b):
    """Simple tree matching by the plain recurrence."""
    if a.label != b.label:
        return 0
    m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + slow_match(x, y))
    return m[-1][-1] + 1


def test_tree_matching_is_optimal():
    import random

    random.seed(9)

    def tree(depth):
        if depth == 0:
            return "<p>x</p>"
        return "".join(f"<{t}>{tree(depth - 1)}</{t}>" for t in random.choices(["div", "ul", "section", "div class=b"], k=random.randint(0, 3))).replace("</div class=b>", "</div>")

    for _ in range(60):
        a, b = H.Page(tree(3)).sign(), H.Page(tree(3)).sign()
        assert H.tree_match(a.root, b.root, {}) == slow_match(a.root, b.root)


def test_damaged_markup(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    cases = ["", "plain", "<p>a<p>b", "<p>cut <b", "<p title='open>x</p>", "<!-- open", "<article><p>x &lt;y&gt; &unknown; &#0;</p></article>", deep, "<script>never closed <p>x", "</div></p>ok", "<p>" + "w " * 200_000 + "</p>", "<a<b>c", "< p>d"]
    got = text_of(spark, *cases)
    assert got[0] == "" and got[1] == "plain" and got[2] == "a\n\nb" and got[3] == "cut" and got[6].startswith("x <y> &unknown;") and got[7] == "deep" and got[8] == "" and got[9] == "ok"
    assert len(got[10]) == 399_999


def test_odd_rows(spark):
    frame = spark.createDataFrame([(1, None, None, "x"), (None, "no host", "<p>t</p>", "x"), (2, "", "", "x"), (2, "", "", "x")], "page_id long, url string, html string, host string")
    got = H.main_text(frame).toPandas()
    assert len(got) == 4 and sorted(got["text"]) == ["", "", "", "t"] and (got["n_chars"] == got["text"].str.len()).all()
    assert H.main_text(frame.limit(0)).count() == 0
