"""HTML extraction, decontamination, piece codec and the pipeline."""

from __future__ import annotations

import random

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from stockflow.llm import decontaminate as DC
from stockflow.llm import piece_codec as PC
from stockflow.llm.html_extract import Page, extract
from tests.llm.data import corpus, empty, frame, plain, prose, words


# -- html ---------------------------------------------------------------------------

def _page(body, k=0):
    return (f"<!DOCTYPE html><html><head><title>T {k}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
            f"<header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></li></ul></nav>"
            f"<div class='cookie-notice'>We use cookies</div>{body}<aside>See also</aside>"
            f"<section id=comments><article class=comment><p>First! A long reader comment, longer than the text itself.</p></article></section>"
            f"<form><label>Mail</label><input></form><footer>&copy; us</footer></body></html>")


def test_html_extraction(spark):
    texts = {i: f"Title {i} First part & é of page {i}. second{i} bold end." for i in range(6)}
    rows = [(i, f"https://Host.example:80/{i}", _page(
        f"<div class='post post-{i}'><h1>Title {i}</h1><p>First  part &amp; &eacute;\nof page {i}.<p>second{i} <b>bo</b>ld end."
        f"<div class=ad>Buy!</div></div>", i)) for i in range(6)]
    rows += [(10, None, None), (11, "https://host.example/x", ""), (12, "nonsense", "just text"),
             (13, "https://host.example/cut", _page("<div class=post><h1>Cut</h1><p>Kept text of a page that is cut <a hre", 1)[:-400]),
             (14, "https://long.example/", _page("<article><header><h1>Long</h1></header>" + "<p>word word</p>" * 5000 + "</article>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS text", "'z' AS paths")
    got = {r["page_id"]: r for r in extract(df).collect()}
    for i, t in texts.items():
        assert got[i]["text"] == t and got[i]["path"] == "html>body>div.post.post-"
    assert got[10]["text"] == got[11]["text"] == "" and len(got) == len(rows)
    assert got[14]["text"] == "Long " + " ".join(["word word"] * 5000)
    assert extract(df.filter("false")).count() == 0


def test_page_parser():
    cut = Page("<body><article><h1>A</h1><p>one<br>two &am <b>th").text("body>article")
    assert cut == "A one two &am th"
    assert Page("<article><ul><li>a<li>b</ul><p>x</article>").text("article") == "a b x"
    assert Page("<div class=with-sidebar><p>in</p><div class=sidebar>out</div></div>").text("div.with-sidebar") == "in"
    assert Page("a < b <p>c").blocks[0][0] == "a < b"


# -- decontamination ------------------------------------------------------------------

def test_index_finds_every_pair_within_the_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    windows = []
    for p in prints.tolist():
        for d in range(16):
            x = p
            for b in rng.choice(64, d, replace=False):
                x ^= 1 << int(b)
            windows.append(x)
    windows = np.array(windows, np.uint64)
    w, i, d = DC.BlockIndex(prints).pairs(windows)
    far = np.bitwise_count(windows[:, None] ^ prints[None, :])
    want = {(a, b) for a, b in zip(*np.nonzero(far <= DC.RADIUS))}
    assert set(zip(w.tolist(), i.tolist())) == want and len(w) == len(want)
    assert (far[w, i] == d).all()


def test_sliding_fingerprints_equal_single_ones():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for size in (1, 3, 8, 24, 96, 128):
        got = DC.fingerprints(h, [size])[size]
        bits = np.unpackbits(h.view(np.uint8)).reshape(-1, 64)
        for at in (0, 17, 300 - size):
            want = np.packbits(bits[at:at + size].sum(0) * 2 > size).view(np.uint64)[0]
            assert got[at] == want


def test_decontamination(spark):
    rng = random.Random(7)
    items = [(k, prose(rng, rng.randint(6, 150), 4000)) for k in range(25)] + [(90, None), (91, ""), (92, "Only three words")]
    rows, want = [], set()
    for i in range(80):
        w = prose(rng, rng.randint(0, 120), 4000).split()
        if i % 4 == 0:
            k, t = items[i % 25]
            item = t.upper().split() if i % 8 else t.replace(" ", " ,").split()
            if i % 3 == 0 and len(item) > 80:
                item[40] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = item
            want.add((i, k))
        if i % 4 == 1:                                   # half of an item is no leak
            half = items[i % 25][1].split()
            w += half[:len(half) // 2]
        rows.append((i, " ".join(w), "en", "s", 1))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "so only three  words, then", "en", "s", 1),
             (903, prose(rng, 30000, 4000) + " " + items[3][1], "en", "s", 1)]
    want |= {(902, 92), (903, 3)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows)
    got = {(r["doc_id"], r["item_id"]): r for r in DC.matches(docs, bench).collect()}
    assert set(got) == want
    assert all(r["similarity"] >= DC.THRESHOLD for r in got.values())
    kept = DC.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {i for i, _ in want}
    assert DC.matches(empty(spark), bench).count() == 0
    assert DC.matches(docs, bench.filter("false")).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(DC, "BLOCK_CHARS", 200)
    items = [(k, prose(random.Random(k), 30, 4000)) for k in range(20)]
    docs = frame(spark, [(k, "before " + t + " after", "en", "s", 1) for k, t in items])
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(DC.item_blocks(bench))) > 5
    assert {(r["doc_id"], r["item_id"]) for r in DC.matches(docs, bench).collect()} == {(k, k) for k, _ in items}


# -- pieces ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PC.MODEL)


def test_codes_equal_the_library(library, monkeypatch):
    monkeypatch.setattr(PC, "CHUNK_CHARS", 500)
    rng = random.Random(3)
    vocab = PC.Vocabulary(PC.MODEL)
    texts = ["", " ", "  a  b\n c  ", "a\x00b", "aaaaaaaaa " * 3, "=" * 900, "x" * 1200 + " y", "日本語のテキスト" * 90, "▁▁ b", "ß½😀"]
    texts += ["".join(rng.choice("ab e \n▁éß=-0日😀tionthe") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    flat, off = PC.encode_texts(texts, vocab)
    for t, a, b in zip(texts, off[:-1], off[1:]):
        assert flat[a:b].tolist() == library.encode(t), repr(t[:50])


def test_encode_and_decode(spark, library):
    rows = corpus() + [(None, "x", None, None, None)]
    got = PC.encode_and_decode(plain(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["round_trip"]
        if r["text"] is None:
            assert r["piece_ids"] is None and r["n_pieces"] == 0
        elif len(r["text"]) < 5000:
            assert r["piece_ids"] == library.encode(r["text"])
    assert PC.encode_and_decode(plain(empty(spark))).count() == 0
    apart = PC.decode(PC.encode(plain(frame(spark, rows)))).collect()
    assert all(r["decoded"] == r["text"] for r in apart) and len(apart) == len(rows)
    with pytest.raises(ValueError):
        PC.encode(plain(frame(spark, rows)).selectExpr("*", "1 AS piece_ids"))


# -- pipeline -------------------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(5)
    items = [(k, prose(rng, 30, 4000)) for k in range(5)]
    rows = [r for r in corpus(n=60)] + [(3000 + k, prose(rng, 40) + " " + t, "en", "s", 1) for k, t in items]
    frame(spark, rows, clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = {r[0] for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
        now = {r["doc_id"] for r in out.collect()}
        gone = ids - now
        if name == "language":
            assert gone == {900, 901, 902}
        elif name == "exact":
            seen = {}
            for r in sorted(rows):
                if r[0] in ids:
                    seen.setdefault(" ".join(r[1].split()), r[0])
            assert now == set(seen.values())
        elif name == "decontaminate":
            assert gone == {3000 + k for k, _ in items}
        if name != "encode":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs, ids = out, now
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in result} == ids and all(r["round_trip"] and r["n_pieces"] == len(r["piece_ids"]) for r in result)


def test_pipeline_of_nothing(spark, tmp_path):
    frame(spark, [], clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert words(None) == []
