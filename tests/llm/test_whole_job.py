"""Cases in which a corpus operator once did less than its whole job."""

from tidemark.llm import html, toxicity


def test_op7_fits_on_every_unlike_text(spark, monkeypatch):
    # all texts share most words, so one smallest hash is the same for many of them
    shared = " ".join(f"common{i}" for i in range(40))
    rows = [(i, f"{shared} only{i}", i % 2) for i in range(60)] + [(100 + i, f"{shared.upper()}\n only0", i % 2) for i in range(6)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    seen = []
    learn = toxicity.learn_lexicon
    monkeypatch.setattr(toxicity, "learn_lexicon", lambda t: seen.extend(t.collect()) or learn(t))
    toxicity.train(docs, labels, folds=5, held_out=9)
    assert sorted((" ".join(r.text.lower().split()), r.y) for r in seen) == sorted({(" ".join(t.lower().split()), y) for _, t, y in rows})


def _hosts(spark, counts):
    """Templates by host: ``counts`` maps a host to its rows ``(main, hash, copies)``."""
    rows = [(h, m, [{"place": 0, "hash": x}]) for h, given in counts.items() for m, x, copies in given for _ in range(copies)]
    return {(r["_host"], r["hash"]) for r in html.templates(spark.createDataFrame(rows, html_rows)).collect()}


html_rows = "_host string, _main long, _trees array<struct<place:int,hash:long>>"


def test_op4_copies_and_size_of_a_host_hide_no_template(spark):
    copied = [(m, 7 if m < 20 else 1000 + m, 1) for m in range(30)] + [(99, 8, 1500)]
    large = [(m, 7 if m < 60 else 1000 + m, 1) for m in range(4000)]
    assert _hosts(spark, {"copied": copied, "large": large}) == {("copied", 7), ("large", 7)}


def test_op4_running_text_is_kept_only_in_a_marked_article(spark):
    page = "<html><body><div><p>{0}</p><p>every page says so</p></div><ul><li>{0} item</li><li>one of many links</li></ul></body></html>"
    article = "<html><body><article><p>{0}</p><p>every page says so</p></article></body></html>"
    rows = [(i, "http://plain.example/", page.format(f"text {i}")) for i in range(5)] + [(10 + i, "http://marked.example/", article.format(f"text {i}")) for i in range(5)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text {i}\n\ntext {i} item" for i in range(5)} | {10 + i: f"text {i}\n\nevery page says so" for i in range(5)}
