from tracewright.llm import html

PARA = "The cat was in the garden of the house and it is not that easy to say for how long he was there. " * 3
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><script>var a="</p><article>";</script><style>p{{}}</style></head><body class="home">
<header><h1>Site</h1><a href="/">Home</a></header><nav><ul><li><a href="/a">the menu of it</a></ul></nav>
<div class="cookie-notice">We use cookies for the good of all and it is the way that this was done.</div>
<div id="content"><h2>Title &amp; more</h2><p>{PARA}</p><div class="ad">buy the thing</div><p>Short<b>er</b> one&nbsp;here.<br>next
 line<p>{PARA}<form><input name=q>search</form></div>
<aside>the side of it</aside><section id="comments"><p>{PARA}</p></section><footer>&copy; of the site</footer></body></html>"""


def squeeze(text):
    return " ".join(text.split())


def test_page_without_article():
    assert html.main_text(PAGE) == squeeze(f"Title & more {PARA} Shorter one here. next line {PARA}")


def test_article_holds_all_its_blocks_and_nothing_else():
    page = f"<nav><a href=x>a</a></nav><div>{PARA}</div><article><h1>Head</h1><p>x &lt;b&gt; y<p>|||<ul><li>one<li>two</ul><div class='share'>no</div><p>end</article><p>{PARA}"
    assert html.main_text(page) == "Head x <b> y ||| one two end"


def test_link_density_and_odd_input():
    links = "".join(f"<a href=/{k}>the link of it {k}</a> " for k in range(30))
    assert html.main_text(f"<body><p>{PARA}</p><p>{links}</p><p>{PARA}</p>") == squeeze(PARA + PARA)
    for odd in ("", None, "<", "<p", "a < b", "<!--", "<script>", "</div></div>", "<a href=\"", "<p class='", "<![CDATA[x"):
        html.main_text(odd)
    assert html.main_text("<article>a < b &#39; &amp;lt;</article>") == "a < b ' &lt;"
    assert html.main_text("<article>cut off <b") == "cut off"
    assert html.main_text("<article><p>" + "<div>" * 5000 + "deep</article>") == "deep"


def test_operator(spark):
    rows = [(1, "u", PAGE, 0), (1, "u", PAGE, 0), (None, None, None, None), (2, "v", "", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n int")
    got = html.extract(df).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == sorted((p or 0, html.main_text(h), len(html.main_text(h))) for p, _, h, _ in rows)
    assert html.extract(df.limit(0)).count() == 0


def test_labels_decide_inside_an_article():
    menu = "<ul>" + "".join(f"<li><a href=/{k}>the one of them {k}</a></li>" for k in range(4)) + "</ul>"
    linked = "<p><a href=/x>A single linked line of the story stays in it</a></p>"
    assert html.main_text(f"<article><p>{PARA}</p>{linked}<p>{PARA}</p>{menu}</article>") == squeeze(f"{PARA} A single linked line of the story stays in it {PARA}")


def test_long_prose_in_named_containers_is_never_good():
    assert html.main_text(f"<article><p>x</p><aside><p>{PARA}</p></aside></article><footer>{PARA}</footer><div role=banner>{PARA}</div>") == "x"


def test_story_beside_article_cards():
    cards = "".join(f"<article><h3>Card {k}</h3><p>In a word.</p></article>" for k in range(3))
    assert html.main_text(f"<div><p>{PARA}</p><p>{PARA}</p></div>{cards}") == squeeze(PARA + PARA)
    assert html.main_text(f"<p>{PARA}</p><article><p>{PARA}</p></article><article>It is the end.</article>") == squeeze(PARA + "It is the end.")


def test_pass_two_equals_brute_force():
    import random

    rng, nothing = random.Random(3), (10**9, "")
    texts = [("the cat is in the garden of it " * 9, 0), ("the cat is in the garden of it " * 4, 0), ("Xyl kro " * 30, 0), ("short", 0), ("linked words here", 17), ("© it", 0)]
    for _ in range(300):
        scopes = sorted(rng.randint(0, 3) for _ in range(rng.randint(0, 14)))
        kinds = [rng.choice(["page", "article", "main", "out"]) for _ in range(4)]
        found = [html.Block(*rng.choice(texts), kinds[s], s, rng.choice(["p", "h2", ""])) for s in scopes]
        first = [html.first_label(x, n) for x, n in zip(found, html._runs(found), strict=True)]
        for kind in ("near", "short"):
            new = list(first)
            for k, x in enumerate(found):
                if first[k] == kind:
                    near = [(j, first[j]) for j in range(len(found)) if found[j].scope == x.scope and first[j] in ("good", "bad")]
                    left, right = [(k - j, v) for j, v in near if j < k], [(j - k, v) for j, v in near if j > k]
                    new[k] = html.inherit(min(left, default=nothing), min(right, default=nothing), x.kind, kind)
            first = new
        assert html.labels(found) == [x == "good" for x in first]


def test_large_broken_pages_take_linear_time():
    import time

    for piece in ("<div>", "<p>x", "<span class=ad>", "</i>", "<li>a<ul>", '<a "', "<section class=ad><p>a</section>"):
        began = time.process_time()
        html.main_text("<article>" + piece * (1_000_000 // len(piece)))
        assert time.process_time() - began < 10
