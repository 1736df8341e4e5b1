"""HTML extraction where the winning container holds only a part of the article, and of hosts with mixed layouts."""

from __future__ import annotations

from stockflow.llm.html_extract import Page, extract

LONG = " ".join(f"body{i} text" for i in range(60))
SOME = " ".join(f"other{i} text" for i in range(25))
NAV = "<nav><a href=/>Home</a></nav><div class=ad>Buy!</div>"


def _best(body):
    page = Page(f"<html><body>{NAV}{body}<footer>us</footer></body></html>")
    return page.best([page.ballot()[0][0]])[0]


def test_nested_sections_keep_the_whole_article():
    assert _best(f"<article><h1>T</h1><p>lead</p><div class=body><p>{LONG}</p></div></article>") == f"T lead {LONG}"
    assert _best(f"<article><header><h1>T</h1></header><section><p>{LONG}</p></section><section><p>{SOME}</p></section>"
                 "<div class=share>Share</div></article>") == f"T {LONG} {SOME}"
    assert _best(f"<main><h1>T</h1><article><div><p>{LONG}</p></div></article></main>") == f"T {LONG}"
    assert _best(f"<main><article><p>{LONG}</p></article><article class=x><p>{SOME}</p></article></main>") == LONG


def test_sections_of_two_classes_without_an_article():
    two = f"<div class=intro><p>{SOME}</p></div><div class=rest><p>{LONG}</p></div>"
    assert _best(two) == f"{SOME} {LONG}"
    assert _best(f"<div class=story><h1>T</h1>{two}</div>") == f"T {SOME} {LONG}"
    assert _best(f"<h1>T</h1><div class=tagline>Our site</div><div class=links><a href=/a>{SOME}</a></div>"
                 f"<div class=post><p>{LONG}</p></div>") == f"T {LONG}"


def test_mixed_layouts_of_a_host(spark):
    rows = [(i, f"https://h.example/{i}", f"<html><body>{NAV}<div class=post><p>p{i} {LONG}</p></div></body></html>") for i in range(6)]
    rows.append((9, "https://h.example/9", f"<html><body><div class=post><p>Old post</p></div><div class=story><p>s {LONG}</p></div></body></html>"))
    rows.append((10, "https://h.example/10", f"<html><body><article><div class=post><p>Teaser</p></div></article><div class=story><p>s {LONG}</p></div></body></html>"))
    rows.append((11, "https://h.example/11", f"<html><body><section><article><div class=post><p>x</p></div></article></section><article><p>a {LONG}</p></article></body></html>"))
    got = {r["page_id"]: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i]["text"] == f"p{i} {LONG}" for i in range(6))
    assert f"s {LONG}" in got[9]["text"] and f"s {LONG}" in got[10]["text"] and f"a {LONG}" in got[11]["text"]


def test_many_containers_of_one_path():
    page = Page("<body>" + "<div class=item><p>one line of text</p></div>" * 3000 + "</body>")
    assert page.best(["body>div.item"])[0] == " ".join(["one line of text"] * 3000)


def test_open_marks_and_boxes_beside():
    assert _best(f"<div class=lead>A short lead.</div><div class=text><p>{LONG}</p></div><div class=end>The end.</div>") == (
        f"A short lead. {LONG} The end.")
    assert _best(f"<div class=box><p>See the <a href=/r>full report of the committee</a></p><div><p>{LONG}</p></div></div>") == (
        f"See the full report of the committee {LONG}")
    assert _best(f"<article><h1>T</h1><p>{LONG}</p><section id=discussion><h2>Discussion</h2><p>We found much.</p></section></article>") == (
        f"T {LONG} Discussion We found much.")
    assert _best(f"<article><p>{LONG}</p><div class='cookie-recipe'><p>Mix the flour.</p></div><div class='cookie-notice'><p>We use them.</p></div></article>") == (
        f"{LONG} Mix the flour.")
    assert _best(f"<article><p>{LONG}</p><div class='cookie-law-info'><p>We use them.</p><button>Yes</button></div></article>") == LONG


def test_reader_comments_by_structure():
    def units(form=""):
        return "".join(f"<div class=item><span class=author>Ann{i}</span><time>3 May</time><p>Nice {i}!</p></div>" for i in range(3)) + form
    assert _best(f"<article><p>{LONG}</p><div class=reactions><h3>3 reactions</h3>{units()}</div></article>") == LONG
    assert _best(f"<article><p>{LONG}</p></article><div class=reactions><p>Nice!</p><p>Agreed.</p></div>") == LONG
    assert _best(f"<div class=post><p>{LONG}</p><div class=below><h3>What you say</h3>{units('<form><textarea></textarea></form>')}</div></div>") == LONG
    glossary = "".join(f"<li><b>Term{i}</b> means something.</li>" for i in range(3))
    live = "".join(f"<div class=entry><time>10:3{i}</time><p>It goes on.</p></div>" for i in range(3))
    kept = " ".join(f"Term{i} means something." for i in range(3)) + "".join(f" 10:3{i} It goes on." for i in range(3))
    assert _best(f"<article><p>{LONG}</p><ul>{glossary}</ul>{live}</article>") == f"{LONG} {kept}"
    posts = "".join(f"<div class=post><h2>P{i}</h2><span class=author>Ann</span> <time>3 May</time><p>{LONG}</p></div>" for i in range(2))
    assert _best(f"<main><p>Intro.</p>{posts}</main>") == "Intro. " + " ".join(f"P{i} Ann 3 May {LONG}" for i in range(2))


def test_what_a_host_repeats_goes(spark):
    def page(i, words):
        return (f"<html><body><div class=strip><p>Welcome to our site, dear reader.</p></div><div class=text><p>p{i} {LONG}</p></div>"
                f"<div class=end><p>{words}</p></div></body></html>")
    rows = [(i, "https://h.example/a", page(i, f"End {i}.")) for i in range(6)]
    rows += [(6, "https://one.example/a", page(6, "End 6."))] + [(7, "https://two.example/a", page(7, "End 7."))] * 5
    got = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {(r["page_id"], r["text"]) for r in extract(got).collect()}
    assert texts == {(i, f"p{i} {LONG} End {i}.") for i in range(6)} | {
        (i, f"Welcome to our site, dear reader. p{i} {LONG} End {i}.") for i in (6, 7)}


def test_a_host_of_many_templates_keeps_its_consensus(spark):
    rows = [(10 * t + i, "https://h.example/", f"<body><div class=t{chr(97 + t)}><p>a{t} {i} {LONG}</p></div></body>")
            for t in range(9) for i in range(3)]
    got = {r["page_id"]: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[10 * t + i]["path"] == f"body>div.t{chr(97 + t)}" for t in range(9) for i in range(3))
    assert all(got[10 * t + i]["text"] == f"a{t} {i} {LONG}" for t in range(9) for i in range(3))


def test_deep_pages_take_memory_by_their_length():
    import tracemalloc

    def peak(n):
        source = "<body>" + "".join(f"<div class=x{'abc'[i % 3]}><p>Some text.</p>" for i in range(n))
        tracemalloc.start()
        page = Page(source)
        assert len(page.best([page.ballot()[0][0]])[0]) == 11 * n - 1
        high = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return high
    assert peak(40_000) < 6 * peak(10_000)


def test_against_a_tree_walk():
    """Random pages of known parts: the extraction equals the parts that are the article."""
    import random
    rng = random.Random(7)
    for _ in range(60):
        def part(depth):
            kind = rng.choice(["p", "h2", "ul", "ad", "nav", "section", "quote"] if depth < 3 else ["p", "h2", "ad"])
            words = " ".join(f"w{rng.randrange(999)}" for _ in range(rng.randint(3, 30))) + "."
            if kind == "ad":
                return f"<div class='ad ad-{rng.randrange(9)}'>{words}</div>", []
            if kind == "nav":
                return f"<nav><a href=/>{words}</a></nav>", []
            if kind == "section":
                inner = [part(depth + 1) for _ in range(rng.randint(1, 4))]
                return f"<section>{''.join(h for h, _ in inner)}</section>", [t for _, ts in inner for t in ts]
            if kind == "ul":
                return f"<ul><li>{words}<li>{words}</ul>", [words, words]
            tag = {"quote": "blockquote"}.get(kind, kind)
            return f"<{tag}>{words.replace(' ', '  ', 1)}</{tag}>", [words]
        parts = [part(0) for _ in range(rng.randint(2, 9))] + [(f"<p>{LONG}</p>", [LONG])]
        rng.shuffle(parts)
        assert _best("<article>" + "".join(h for h, _ in parts) + "</article>") == " ".join(t for _, ts in parts for t in ts)
