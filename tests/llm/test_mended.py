"""Cases that reviews found: texts of one id, two vocabularies in one worker, languages with little text, wrappers of pages, tags and bodies of records."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import decontaminate, html_text, language_id, ngram_join, piece_codec, warc
from chronoloom.llm.pieces import Vocabulary


def test_a_clean_text_that_shares_an_id_stays(spark):
    item = " ".join(f"t{i}" for i in range(30))
    rows = [(1, "before " + item + " after", "a"), (1, "another clean text of some words", "b"), (2, "a clean one", "c"), (None, item, "d"), (None, "clean without an id", "e"), (3, None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text_key string")
    kept = decontaminate.remove_contaminated(docs, spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r["_text_key"] for r in kept.collect()) == ["b", "c", "e", "f"]
    assert [(r.doc_id, r.item_id) for r in decontaminate.score_documents(docs.where("doc_id IS NOT NULL"), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()] == [(1, 9)]


def test_two_vocabularies_in_one_worker():
    bytes_ = tuple(f"<0x{b:02X}>" for b in range(256))
    tail = tuple(f"z{i}" for i in range(150))
    make = lambda words: Vocabulary(("<unk>", *bytes_, *words, *tail), (0.0,) * 257 + (-1.5,) * len(words) + (-9.5,) * 150, 1, 257)
    one, two = make(("▁ab", "▁", "a", "b")), make(("▁a", "▁", "a", "b"))
    assert piece_codec.shared_codec(one) is not piece_codec.shared_codec(two)
    ids = [np.frombuffer(piece_codec.shared_codec(v).encode("ab"), np.int32).tolist() for v in (one, two)]
    assert ids == [[257], [257, 260]]
    assert language_id.shared_vocabulary(one) is one and language_id.shared_vocabulary(two) is two
    again = make(("▁ab", "▁", "a", "b"))
    assert piece_codec.shared_codec(again) is piece_codec.shared_codec(one)


def test_no_language_wins_for_having_little_text():
    counts = np.array([[900.0, 9.0], [100.0, 0.0], [0.0, 0.0], [50.0, 0.0]])
    p = language_id.smoothed(counts, np.array([True, True, True, False]))
    assert np.allclose(p.sum(axis=0), 1) and (p > 0).all()
    assert p[1, 0] > p[1, 1] and p[2, 0] == pytest.approx(p[2, 1], rel=1e-12) and p[3, 0] == pytest.approx(p[3, 1], rel=1e-12)


def test_short_and_foreign_texts(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs.where(language_id.in_training(F.col("doc_id"))))
    foreign = ["Ελληνικά κείμενα", "Это русский текст", "漢字だけの文", "עברית", "ab"]
    rows = {r.text_: r for r in language_id.identify(spark.createDataFrame([(t, t) for t in foreign], "text string, text_ string"), model).collect()}
    for t in foreign[:4]:  # no language of the four has such pieces: none is far ahead of the others
        assert rows[t].lang_pred in model.languages and rows[t].score < 0.5
    held = docs.where(~language_id.in_training(F.col("doc_id")))
    right = language_id.identify(held.select("lang", "text"), model).where("lang IS NOT NULL").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.99


PROSE = "Words of the first paragraph go on and on. " * 5
P = f"<p>{PROSE}</p>"
LINKS = "".join(f'<li><a href="/x">Reference number {i} of all</a></li>' for i in range(4))
SAME = PROSE.strip()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<form id="aspnetForm"><nav>Home</nav><article><h1>T</h1>{P}</article></form>', ["T", SAME]),
        (f'<form id="aspnetForm"><div class="menu">Home</div><div><h1>Title</h1>{P}{P}</div></form>', ["Title", SAME, SAME]),
        (f'<div class="content-with-sidebar"><h1>T</h1>{P}</div><div class="sidebar">x y z</div>', ["T", SAME]),
        (f'<div class="article-body no-comments"><h1>T</h1>{P}</div><div class="has-menu"></div>', ["T", SAME]),
        (f'<article><h1>T</h1>{P}<section id="related-work"><h2>Related work</h2>{P}</section></article>', ["T", SAME, "Related work", SAME]),
        (f'<article><h1>T</h1>{P}<div class="dialog">{P}</div></article>', ["T", SAME, SAME]),
        (f"<article><h1>T</h1>{P}<h2>References</h2><ul>{LINKS}</ul></article>", ["T", SAME, "References", *(f"Reference number {i} of all" for i in range(4))]),
        (f'<article><h1>T</h1>{P}<form class="search"><label>Search</label></form><div class="related"><a href=x>Another story</a></div></article>', ["T", SAME]),
        (f'<article><h1>T</h1>{P}<div class="comments">{P}</div><div class="comment-list">{P}</div></article>', ["T", SAME]),
        (f'<nav>Home</nav><form class="login"><p>Name</p></form><div><h1>Title</h1>{P}{P}</div>', ["Title", SAME, SAME]),
    ],
)
def test_wrappers_and_names_of_pages(page, want):
    assert html_text.extract_texts([page])[0].split("\n") == want


def test_links_to_other_pages_go_with_their_heading():
    text = html_text.extract_texts([f"<article><h1>T</h1>{P}<h2>Related stories</h2><ul>{LINKS}</ul></article>"])[0]
    assert "Reference" not in text and SAME in text


def record(head, body, end="\r\n"):
    http = ("HTTP/1.1 200 OK" + end + end.join(head) + end + end).encode() + body
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: %d\r\n\r\n" % len(http) + http + b"\r\n\r\n"


@pytest.mark.parametrize("as_text", [False, True])
def test_tags_bodies_and_heads_of_records(spark, as_text):
    cases = [
        (["Content-Type: text/html"], b'<img alt="a > b"> y<p title="1>0">hello', "\r\n", "y\nhello"),
        (["Transfer-Encoding: chunked"], b"6\r\n<p>hel\r\n8;x=1\r\nlo\r\n\r\nab\r\n3\r\ncde\r\n0\r\nTrailer: x\r\n\r\n", "\r\n", "hello abcde"),
        (["Transfer-Encoding: chunked"], b"ff\r\nabc", "\r\n", "abc"),
        (["Transfer-Encoding: chunked"], b"", "\r\n", ""),
        (["Content-Type: text/html"], b"<p>bare\n\nfeed", "\n", "bare feed"),
        (["Content-Encoding: gzip"], b"\x1f\x8bxy", "\r\n", ""),
        (["Content-Encoding: identity"], b"<p>plain", "\r\n", "plain"),
        (["Content-Type: text/html"], b"<a href=x>don't</a> <p title=don't>it's <b", "\r\n", "don't\nit's <b"),
        (["Content-Type: text/html"], b'<script data-x="</p>>">no()</script><pre>one</pre><b class="' + b"y>" * 9000 + b'">two</b>', "\r\n", "one\ntwo"),
    ]
    rows = [(i, record(h, b, e)) for i, (h, b, e, _) in enumerate(cases)]
    if as_text:
        rows = [(i, r.decode("latin-1")) for i, r in rows]
    found = warc.derive(spark.createDataFrame(rows, f"i int, record {'string' if as_text else 'binary'}")).collect()
    blocks = {(r.i, r.record_type): r.block for r in found}
    assert [blocks[i, "conversion"] for i in range(len(cases))] == [c[-1] for c in cases]
    assert ["sourceEncoding: gzip (not read)" in blocks[i, "metadata"] for i in range(len(cases))] == [b"gzip" in r[1] if not as_text else "gzip" in r[1] for r in rows]
    assert all(re.search("sourceStatus: 200\r\n", blocks[i, "metadata"]) for i in range(len(cases)))


def test_items_of_equal_words_are_compared_once(spark, monkeypatch):
    """A benchmark of 40 copies has as many hashes as one of them, and gives each found id."""
    item = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, " ".join(["x", *item, "y"])), (2, "none of these words stands in any item at all"), (3, "yes no")], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(item)) for k in range(40)] + [(k, "Yes, no!") for k in range(40, 45)] + [(7, " ".join(item[:15]))], "item_id long, text string")
    shuffled = []
    monkeypatch.setattr(decontaminate, "SEED_LIMIT", 45 * len(decontaminate.LONG_MASKS))
    monkeypatch.setattr(decontaminate, "_shuffled_hits", lambda *a, f=decontaminate._shuffled_hits: shuffled.append(a) or f(*a))
    found = lambda: sorted((r.doc_id, r.item_id, r.matched, r.n_hits) for r in decontaminate.overlaps(docs, bench).collect())
    by_broadcast = found()
    assert not shuffled and [x[:3] for x in by_broadcast] == [(1, k, 30) for k in range(40)] + [(3, k, 2) for k in range(40, 45)]
    monkeypatch.setattr(decontaminate, "SEED_LIMIT", 0)
    assert found() == by_broadcast and shuffled


def test_seeds_of_a_large_benchmark_are_not_broadcast(spark, monkeypatch, tmp_path):
    """Whatever the benchmark's file weighs: beside the bitmap, only tables that a count has shown to be small."""
    monkeypatch.setattr(decontaminate, "SEED_LIMIT", 0)
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}")
    plan = decontaminate.overlaps(spark.read.parquet(f"{tmp_path}/documents"), spark.read.parquet(f"{tmp_path}/benchmark"))._jdf.queryExecution().executedPlan().toString()
    joins = [re.search(r"[\[(]?(seed|item_key)#", x)[1] for x in plan.split("\n") if re.search(r"SortMergeJoin \[(seed|item_key)#", x)]
    assert {*joins} == {"seed", "item_key"} and not re.search(r"BroadcastHashJoin \[(seed|item_key)#", plan)


def test_copies_in_other_tasks_get_buckets_of_their_own(spark, monkeypatch):
    """Each task emits a set once: a bucket holds no more where every text has eight copies in as many tasks."""
    texts = [" ".join(f"t{k}w{i}" for i in range(40)) for k in range(30)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts * 8)), 8), "doc_id long, text string")
    per_bucket = []
    monkeypatch.setattr(ngram_join, "BUCKETS", 1)
    monkeypatch.setattr(ngram_join, "PER_BUCKET", 300)
    monkeypatch.setattr(ngram_join, "signature_blocks", lambda d, n, f=ngram_join.signature_blocks: per_bucket.append(sum(len(r.low) // 4 for r in f(d, n).collect()) / n) or f(d, n))
    found = ngram_join.score_documents(docs).collect()
    assert len(found) == 240 and all(r.component_id == r.doc_id % 30 for r in found)
    assert len(per_bucket) == 1 and 0 < per_bucket[0] <= 300
