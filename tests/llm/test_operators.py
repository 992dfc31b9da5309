"""Edge cases of each operator, and results against brute force, round trips or held-out labels."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF
from tests.oracle import assert_same
from tidemark.llm import bpe, html, jpeg, licenses, mixing, ngrams, quality, queries, sharding, toxicity, vectors
from tidemark.session import table

LONG = "word " * 30_000
#: id null, text null, empty, blank, repeated rows, a very long text, a surrogate-free emoji, a made name.
ROWS = [
    (1, "The MIT License? Under the MIT License.", "a", "x"),
    (2, None, "a", "x"),
    (3, "", None, None),
    (4, " \t\n", "b", "x"),
    (5, "same same same same same", "b", "y"),
    (5, "same same same same same", "b", "y"),
    (6, LONG, "c", "z"),
    (7, "naïve 日本🙂 it's 123 \x00 end", "c", "z"),
    (None, "no id here at all", "a", "x"),
]
SCHEMA = "doc_id long, text string, source string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    pos = y == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("name,label,folds,held", [("op1_bradley_terry_quality", "quality", 3, 1), ("op7_toxicity", "toxic", 5, 0)])
def test_classifiers_on_held_out_labels(spark, name, label, folds, held):
    sf = SF.replace("0.001", "0.01")
    got = queries.queries()[name](spark, sf)
    assert got.count() == table(spark, sf, "documents").count()
    rows = got.join(table(spark, sf, "labels"), "doc_id").select("doc_id", "held_out", "score", "predicted", label).toPandas()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in rows.itertuples())
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()
    test = rows[rows.held_out]
    assert (test.predicted == test[label]).mean() > 0.95
    # of eight toxic texts in this small fold two have only words that no training text has
    assert auc(test.score.to_numpy(), test[label].to_numpy()) > (0.9 if label == "quality" else 0.8)


def test_op1_edges(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(docs, labels, held_out=9)
    out = quality.classify(docs, model)
    assert out.columns == ["doc_id", "text", "source", "score", "predicted"]
    assert out.where("score between 0 and 1").count() == len(ROWS)
    assert quality.classify(empty, model).count() == 0
    none = quality.train(docs, labels.where("false"))
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    bad = quality.fit(np.ones((2, len(quality.FEATURES))), np.zeros(2))
    assert bad.score(np.zeros((1, len(quality.FEATURES))))[0] < 0.5


def test_op1_ranks_pairs():
    good, bad = ["plain words stand here in a row of text"] * 20, ["AAA!!! BBB!!! AAA!!! $$$ | | |"] * 10
    x = quality.features(good + bad)
    m = quality.fit(x, np.array([1] * 20 + [0] * 10))
    s = m.score(x)
    assert s[:20].min() > 0.5 > s[20:].max()


def test_op2_edges(spark, docs, empty):
    got = mixing.mix(docs)
    rows = got.collect()
    assert len(rows) == len(ROWS) and all(r["size"] == len(words(r["text"])) and 0 <= r.taken <= 2 * r["size"] for r in rows)
    assert set(docs.columns) <= set(got.columns)
    assert mixing.mix(empty).count() == 0
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id or 0, r["size"], r.copies)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.emit(got, docs.columns).count() == sum(r.copies for r in rows)


def test_op2_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 985)], "source string, size long")
    t = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert t["a"] == 20 and abs(sum(t.values()) - 3000) < 1e-6
    # a fills up; b, c and null share what is left by 2, 1, 5 until c and null are full
    assert t["c"] == 10 and t[None] == 1970 and abs(t["b"] - 1000) < 1e-6


def test_op2_hot_source_is_near_its_target(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 97 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    for r in mixing.mix(df).groupBy("source").agg(F.max("target").alias("t"), F.sum("taken").alias("n")).collect():
        assert abs(r.n - r.t) <= 0.02 * r.t + 100


def test_op3_against_tiktoken(spark, docs, empty):
    import public_tokenizers
    import tiktoken

    v = bpe.vocabulary(bpe.default_path())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    texts = ["", " ", "it's we'll 's's", "a" * 500, "\n \n x  y\t\tz", "日本🙂 Ⅻ٣½", "'" * 30 + "s", "<|endoftext|>", "x\x1cy\x85z  w"]
    for t, i in zip(texts, v.encode(texts)[0]):
        assert np.frombuffer(i, "<u4").tolist() == enc.encode_ordinary(t) and v.decode(i) == t.encode()
    for r in bpe.digests(docs, bpe.default_path()).join(docs.distinct(), "doc_id").collect():
        ids = enc.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    clash = docs.withColumnRenamed("score", "ids")
    assert bpe.encode(clash, bpe.default_path(), slices=True).columns == ["doc_id", "text", "source", "ids", "n_tokens", "slice_starts"]
    assert bpe.digests(empty, bpe.default_path()).count() == 0


PAGE = "<html><head><title>t</title><script>var a='<p>x</p>';</script></head><body><nav>menu</nav><div class='ad'>buy</div>{}<footer>f</footer></body></html>"


def test_op4_blocks():
    text = lambda h: [b for b, _, framed in html.dissect(h)[0] if not framed]
    assert text(PAGE.format("<article><h1>T &amp; U</h1><p>one\n  two<p><b>bold <i>x</i> y<br><p>z&nbsp;&eacute;<aside>no</aside></article>")) == ["T & U", "one two", "bold x y", "z é"]
    assert text(PAGE.format("<main><p>a</p><section class='comments'><p>b</p></section><form>c</form></main>")) == ["a"]
    assert text(PAGE.format("<p>plain</p>")) == ["plain"]
    assert text("") == [] and text("just text < 3") == ["just text < 3"]
    assert text("<article><p>open &copy 2020 &am") == ["open © 2020 &am"]


def test_op4_templates_and_edges(spark):
    share = "<div><div>share this</div><p>{}</p></div>"
    rows = [(i, "http://H.example/" + str(i), PAGE.format(share.format(f"text {i}")), "n") for i in range(4)]
    # copies of one page make no template of it
    rows += [(10 + i, "http://other.example/", PAGE.format(share.format("the same")), "n") for i in range(5)]
    rows += [(20, None, None, "n"), (21, "no address", "", "n"), (None, "http://h.example/z", PAGE.format("<article><p>kept</p></article>"), "n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert [got[i].text for i in range(4)] == [f"text {i}" for i in range(4)] and got[0].n_templates == 4 and got[12].n_templates == 0
    assert got[12].text == "share this\n\nthe same" and got[20].text == got[21].text == "" and got[None].text == "kept"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html.extract(pages.where("false")).count() == 0


def test_op4_forms_alone_find_the_frame(spark):
    """Menus with other words on each page recur by form; a deep long page and clashing columns are rows like any other."""
    page = "<body><div id='m{0}'><ul><li><a>w{0} x</a></li><li>y{0}</li></ul></div><div><p>{1}</p><p>and {0}</p></div><div>bottom {0}</div></body>"
    rows = [(i, "http://h/", page.format(i, f"a long text of the page number {i} with many words in it " * 3), 1, 2) for i in range(6)]
    rows.append((6, "http://h/", "<div>" * 3000 + "deep " * 200_000, 1, 2))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _host long, _trees long")
    got = {r.page_id: r for r in html.extract(pages, names=False).collect()}
    assert [got[i].text for i in range(6)] == [" ".join((f"a long text of the page number {i} with many words in it " * 3).split()) + f"\n\nand {i}" for i in range(6)]
    assert all(got[i].n_recurring >= 2 and (got[i]._host, got[i]._trees) == (1, 2) for i in range(6))
    assert got[6].n_chars == 5 * 200_000 - 1


def test_op4_recurrence_on_the_table(spark):
    """Recurrence alone decides on hosts with enough pages: with the lists of names or without, the text is the same."""
    sf = SF.replace("0.001", "0.01")
    pages = table(spark, sf, "pages")
    named = html.extract(pages).select("page_id", "url", "text", "n_templates").cache()
    alone = html.extract(pages, names=False).select("page_id", F.col("text").alias("t"))
    hosts = named.withColumn("h", html.host(F.col("url"))).groupBy("h").agg(F.countDistinct("text").alias("texts"))
    both = named.withColumn("h", html.host(F.col("url"))).join(hosts, "h").join(alone, "page_id").where(F.col("texts") >= html.PLENTY)
    assert both.count() > 50 and both.where("n_templates = 0").count() == 0 and both.where("text <> t").count() == 0
    assert html.extract(pages, small=0).select(*named.columns).exceptAll(named).count() == 0


def test_op4_templates_against_brute_force(spark):
    """Counts, shares and places of all subtrees, in plain Python."""
    pages = [(r.url, r.html) for r in table(spark, SF.replace("0.001", "0.01"), "pages").collect()]
    mains, seen = defaultdict(set), defaultdict(lambda: defaultdict(list))
    for url, page in pages:
        h = re.sub("[/:?#].*", "", url.split("//", 1)[1]).lower()
        blocks, trees = html.dissect(page)
        main = "\n".join(t for t, _, framed in blocks if not framed)
        mains[h].add(main)
        for _, x, share, inside, exact, article in trees:
            seen[h, x][main].append((np.float32(share), inside, exact, article))
    want = set()
    for (h, x), by in seen.items():
        part, inside = (np.mean([float(max(t[i] for t in ts)) for ts in by.values()]) for i in (0, 1))
        exact, article = (any(t[i] for ts in by.values() for t in ts) for i in (2, 3))
        often = 0.5 * len(mains[h]) if inside >= 0.5 else min(0.02 * len(mains[h]), 50)
        if len(by) >= max(3, often) and (exact or (part <= 0.2 and inside < 0.5)) and (len(mains[h]) >= html.PLENTY or not article):
            want.add((h, x))
    found = html.dissected(table(spark, SF.replace("0.001", "0.01"), "pages"))
    assert {(r["_host"], r["hash"]) for r in html.templates(found).collect()} == want and len(want) > 100


def test_op5_edges(spark, docs, empty):
    got = sharding.shard(docs, sharding.layout(8), sharding.layout(9)).collect()
    assert len(got) == len(ROWS)
    by = defaultdict(list)
    for r in got:
        t = (r.text or "").encode()
        assert r["size"] == len(t) + 1 and r.text_crc32 == zlib.crc32(t) and r.grown_shard in (r.shard, 8)
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard(empty, sharding.layout(8)).count() == 0


def test_op5_moves_only_into_what_grows(spark):
    ids = spark.range(20_000)
    found = ids.select(*[sharding.place(F.col("id"), sharding.layout(n)).cast("int").alias(f"n{n}") for n in range(1, 42)]).toPandas().to_numpy()
    for n in range(1, 41):
        old, new = found[:, n - 1], found[:, n]
        assert set(new[old != new]) == {n} and abs((new == n).mean() - 1 / (n + 1)) < 0.02
    for n in (20, 41):  # regions, racks and shards all share alike
        assert np.abs(np.bincount(found[:, n - 1], minlength=n) / 20_000 - 1 / n).max() < 0.01
    tree = {"r": {"c": {0: 1.0, 1: 3.0}, "d": {2: 0.0}}}
    for law in (sharding.assign, sharding.place):
        assert abs(ids.where(law(F.col("id"), tree) == 1).count() / 20_000 - 0.75) < 0.02


def test_op5_levels_below_the_root_decide():
    """At 20 and 100 shards a root has 5 and 25 children, and a key's shard hangs on draws of all three levels."""
    for n, regions in ((20, 5), (100, 25)):
        tree = sharding.layout(n)
        assert len(tree) == regions and all(len(r) == 2 and all(len(k) == 2 for k in r.values()) for r in tree.values())
        used = [grown(str(k), tree, trace=True)[1] for k in range(3000)]
        assert all(sum(len(own) for own in u) < n // 2 for u in used) and {len(u) for u in used} == {3}
        assert sum(bool(u[1]) for u in used) > 1000 and sum(bool(u[2]) for u in used) > 1000


def grown(key, tree, trace=False):
    """``place`` step by step: from the last child on, the draw against the share; ``entry`` is where the parent took the key."""
    import xxhash

    weigh = lambda n: sum(map(weigh, n.values())) if isinstance(n, dict) else n
    node, path, before, entry, used = tree, "", 0.0, None, []
    while isinstance(node, dict):
        spans, at = [], before
        for name in node:
            if weigh(node[name]) > 0:
                spans.append((name, at, weigh(node[name])))
                at += weigh(node[name])
        drawn = []
        for name, start, w in reversed(spans):
            draw = ((xxhash.xxh64_intdigest(f"{path}/{name}".encode(), xxhash.xxh64_intdigest(key.encode(), 42)) >> 11) + 0.5) / 2.0**53
            held = entry is not None and entry > start
            if not held:
                drawn.append(name)
            if held or draw < w / (start + w) or name == spans[0][0]:
                break
        entry = entry if held else start / (1 - draw)
        node, path, before = node[name], f"{path}/{name}", start
        used.append(drawn)
    return (name, used) if trace else name


def descend(key, tree):
    """Brute force: the least of the draws at each level, by the hash function's definition."""
    import xxhash

    weigh = lambda n: sum(map(weigh, n.values())) if isinstance(n, dict) else n
    node, path = tree, ""
    while isinstance(node, dict):
        live = [n for n in node if weigh(node[n]) > 0]

        def draw(n):
            bits = xxhash.xxh64_intdigest(f"{path}/{n}".encode(), xxhash.xxh64_intdigest(key.encode(), 42)) >> 11
            return -np.log((bits + 0.5) / 2.0**53) / weigh(node[n])

        best = min(live, key=draw)
        node, path = node[best], f"{path}/{best}"
    return best


def test_op5_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    tree = {"x": {"a": {0: 1.0, 1: 2.5}, "b": {2: 1.0}}, "y": {"c": {3: 0.0, 4: 4.0}}}
    got = sharding.shard(docs, sharding.layout(27), tree).collect()
    assert all(r.shard == grown(str(r.doc_id), sharding.layout(27)) and r.grown_shard == grown(str(r.doc_id), tree) for r in got)
    assert all(r.s == descend(str(r.doc_id), tree) for r in docs.select("doc_id", sharding.assign(F.col("doc_id"), tree).alias("s")).collect())


def test_op5_changes_stay_in_their_subtrees(spark):
    """A heavier shard draws keys into its own region, rack and shard; the other region only loses keys to it."""
    old = {"x": {"a": {0: 1.0, 1: 1.0}, "b": {2: 1.0, 3: 1.0}}, "y": {"c": {4: 1.0, 5: 1.0}}}
    new = {"x": {"a": {0: 1.0, 1: 3.0}, "b": {2: 1.0, 3: 1.0}}, "y": old["y"]}
    moved = spark.range(20_000).select(sharding.assign(F.col("id"), old).alias("a"), sharding.assign(F.col("id"), new).alias("b")).where("a <> b")
    assert moved.where("b in (4, 5)").count() == 0 and moved.where("a in (2, 3) and b in (2, 3)").count() == 0
    assert moved.where("b = 1").count() > 0


def test_op9_components_of_a_tile_by_arrays():
    rng = np.random.default_rng(4)
    for n, m in ((50, 40), (300, 20_000), (200, 199)):
        i, j = (np.arange(m), np.arange(1, m + 1)) if m == n - 1 else (rng.integers(0, n, m), rng.integers(0, n, m))
        i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
        counts = rng.integers(1, 5, n)
        tile = vectors.Tile(counts)
        for at in range(0, len(i), 1000):
            tile.add(i[at : at + 1000], j[at : at + 1000])
        label = list(range(n))
        for _ in range(n):
            for a, b in zip(i.tolist(), j.tolist()):
                label[a] = label[b] = min(label[a], label[b])
        assert tile.root.tolist() == label
        assert tile.links.sum() == counts[i].sum() + counts[j].sum()


def test_op6_round_trip(spark, docs, empty):
    out = jpeg.measure(jpeg.store(docs.select("doc_id", "text"))).collect()
    for r in out:
        assert bytes(r.thumbnail) == jpeg.payload(r.text or "") and r.n_bytes == len((r.text or "").encode()) and r.feature
    big = jpeg.payload("é" * 400_000)
    assert [b"".join(x.tobytes() for x in t) for t in jpeg.thumbnails(jpeg.encode([big, jpeg.payload("")]))] == [big, bytes(64)]
    assert jpeg.store(empty).count() == 0
    bad = spark.createDataFrame([(1, bytearray(b"no jpeg")), (2, None)], "doc_id long, media binary")
    assert [r.feature for r in jpeg.measure(bad).collect()] == [None, None]


def test_op6_decodes_ac_coefficients():
    """A colour image with AC symbols, written here bit by bit."""
    dc, ac = jpeg.codes(*jpeg.DC_TABLE), jpeg.codes([0, 2, 1] + [0] * 13, [0x00, 0x01, 0x31])
    bits = ""

    def put(code, length):
        nonlocal bits
        bits += format(code, f"0{length}b")

    want = [5, 3, 0, 1]
    last = {0: 0, 1: 0, 2: 0}
    for k, value in enumerate(want):  # two MCUs of 2x1 luminance and two chroma blocks
        plan = [(0, value)] if k % 2 == 0 else [(0, value), (1, -4), (2, 6)]
        for component, v in plan:
            d = v - last[component]
            last[component] = v
            size = abs(d).bit_length()
            put(*dc[size])
            if size:
                put(d if d > 0 else d + (1 << size) - 1, size)
            put(*ac[0x31])
            put(1, 1)
            put(*ac[0x01])
            put(0, 1)
            put(*ac[0x00])
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    frame = bytes([8, 0, 8, 0, 32, 3, 1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0])
    head = b"\xff\xd8" + jpeg._segment(0xDB, b"\x00" + bytes([8] * 64)) + jpeg._segment(0xC0, frame)
    head += jpeg._segment(0xC4, b"\x00" + bytes(jpeg.DC_TABLE[0]) + bytes(jpeg.DC_TABLE[1])) + jpeg._segment(0xC4, b"\x10" + bytes([0, 2, 1] + [0] * 13) + bytes([0x00, 0x01, 0x31]))
    image = head + jpeg._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + data + b"\xff\xd9"
    assert (jpeg.thumbnails([image])[0][0].ravel().astype(int) - 128).tolist() == want


def edit(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d = _row(d, i, x, b)
    return d[-1]


def _row(d, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(d[j] + 1, new[-1] + 1, d[j - 1] + (x != y)))
    return new


def test_op7_automaton_is_edit_distance():
    terms = ["scum", "moron", "idiot", "worthless", "disgusting"]
    a = toxicity.Automaton(terms)
    rng = np.random.default_rng(3)
    for t in terms * 60:
        w = list(t)
        for _ in range(rng.integers(0, 4)):
            k = rng.integers(0, len(w) + 1)
            w[k : k + rng.integers(0, 2)] = rng.choice(list("abot")) if rng.random() < 0.6 else ""
        w = "".join(w)
        want = min((e for x in terms if (e := edit(x, w)) <= toxicity.edits(x)), default=-1)
        assert a.distance(w) == want, w


def test_op7_context_and_edges(spark, docs, empty):
    lex = toxicity.Lexicon(["idiot", "worthless"], ["lowei"])
    assert toxicity.counts("you idiot", lex) == (1, 0, 0, 0, 0)
    assert toxicity.counts('he said "you idiot" once', lex) == (0, 0, 0, 0, 1)
    assert toxicity.counts("idi0t idiott worthles loweischaft", lex)[1:4] == (1, 2, 0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.classify(docs, model)
    assert out.columns == ["doc_id", "text", "source", "score", "predicted", "hits"] and out.where("predicted = 0").count() == len(ROWS)
    assert toxicity.classify(empty, model).count() == 0


def test_op8_templates(spark, docs, empty):
    scan = licenses.scan_text
    assert scan("Released under the MIT License.")[:7] == (5, 1, 1, 1, "mit", "mit,mit-notice", 0.75)
    assert scan("licensed under the GNU General Public License, either version 3")[5] == "gpl-3"
    assert scan("licensed under the GNU General Public License, version 2")[5] == ""
    assert scan("Licensed under CC BY-NC 4.0.")[4:6] == ("cc-by-nc", "cc-by-nc,cc-by-nc-4")
    assert scan("")[:7] == (0, 0, None, None, "", "", 0.0)
    with pytest.raises(ValueError):
        licenses.Automaton("<<opt>> a")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert got[1].n_base == 1 and got[1].first_word == 3 and got[2].n_words == 0
    assert licenses.scan(empty).count() == 0


MIT = """The MIT License (MIT)

Copyright (c) 2021 Jane Q. Public and the Example Authors

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def written(markup, free="Some Holder Ltd", optional=True):
    """A text of a template: each variable's last alternative, free regions filled, optional parts in or out."""
    text = markup if optional else re.sub("<<opt>>[^<]*(<<free [0-9]+>>)?[^<]*<<end>>", "", markup)
    text = re.sub("<<free [0-9]+>>", free, re.sub("<<var [^>]*?([^|>]+)>>", r"\1", text))
    return re.sub("<<opt>>|<<end>>", "", text)


def test_op8_whole_texts():
    labels = lambda t: licenses.scan_text(t)[5].split(",")
    assert "mit-text" in labels(MIT) and "mit-text" in labels(f"before {MIT} after".replace("2021 Jane Q. Public and the Example Authors", "nobody"))
    assert "mit-text" not in labels(MIT.replace("NO EVENT", "EVENT")) and "mit-text" not in labels(MIT[: MIT.rindex(" IN THE SOFTWARE")])
    for label, texts in licenses.TEMPLATES.items():
        for m in texts:
            for optional in (True, False):
                words = written(m, optional=optional).split()
                assert label in labels(" ".join(words)), label
                gone = len(words) // 2 + 3
                if label.endswith(("-text", "-header", "-later")):
                    assert label not in labels(" ".join(words[:gone] + words[gone + 1 :])), label
    too_long = written(licenses.TEMPLATES["bsd-3-text"][0], free="a " * 13)
    assert "bsd-3-text" not in labels(too_long) and "bsd-2-text" not in labels(written(licenses.TEMPLATES["bsd-3-text"][0]))


def test_op8_automata_against_regular_expressions():
    """Random texts near the templates: the automaton finds a match where the expression does."""
    rng = np.random.default_rng(11)
    for label, texts in licenses.TEMPLATES.items():
        for m in texts:
            automaton, expression = licenses.Automaton(m), re.compile(licenses.pattern(m))
            for _ in range(20):
                words = written(m, free="x " * int(rng.integers(0, 25)), optional=bool(rng.integers(2))).split()
                for _ in range(int(rng.integers(0, 2))):
                    at = int(rng.integers(len(words)))
                    words[at : at + 1] = [] if rng.random() < 0.5 else [words[at], "x"]
                found = any(automaton.accepts([w.encode() for w in words], i) >= 0 for i in range(len(words)))
                assert found == bool(expression.search("".join(f" {w} " for w in words))), (label, words)


def test_very_long_texts_in_parts(monkeypatch):
    """Parts add up to what the whole gives: words, n-grams, features, hits, ids and images."""
    rng = np.random.default_rng(12)
    vocabulary = ["word", "Word", "it's", "naïve", "日本", "42", "--", "idiot", "x" * 40, "the", "the\n", "\t\t", " "]
    text = " ".join(rng.choice(vocabulary, size=60_000)) + " end"
    short = "a b c d e f g"
    lexicon = toxicity.Lexicon(["idiot"], [])
    v = bpe.Vocabulary(bpe.default_path())
    payload = jpeg.payload(text)

    def everything():
        s = ngrams.Sets([short, text, ""])
        ids, places = v.encode([short, text, ""])
        return s.key.tolist(), [s.grams(i).tolist() for i in range(3)], quality.features([short, text, ""]).tolist(), toxicity.counts(text, lexicon), ids, [p.tolist() for p in places]

    whole = everything()
    from tidemark.llm import batches

    for module in (ngrams, quality, toxicity):
        monkeypatch.setattr(module, "pieces", lambda t: batches.pieces(t, 5_000))
    assert "".join(batches.pieces(text, 5_000)) == text and len(batches.pieces(text, 5_000)) > 40
    assert batches.pieces("x" * 20_000, 5_000) == ["x" * 20_000] and batches.pieces("", 5) == [""]
    monkeypatch.setattr(bpe, "LONG", 5_000)
    assert everything() == whole and whole[3][0] > 1000
    at_once = jpeg.encode([payload])
    monkeypatch.setattr(jpeg, "ROWS", 100)
    parts = jpeg.encode([payload, jpeg.payload("")])
    assert parts[0] != at_once[0]
    assert [b"".join(x.tobytes() for x in t) for t in jpeg.thumbnails(parts)] == [payload, bytes(64)]


def test_op9_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 16))
    x = np.concatenate([base[rng.integers(12, size=150)] + rng.normal(scale=s, size=(150, 16)) for s in (0.05, 0.35)]).astype(np.float32)
    rows = [(i, [float(v) for v in r], "k") for i, r in enumerate(x)] + [(400 + i, [float(v) for v in x[0]], "k") for i in range(40)]
    odd = [(500, None, "k"), (501, [0.0] * 16, "k"), (502, [float("nan")] + [1.0] * 15, "k"), (503, [None] + [1.0] * 15, "k"), (504, [1.0], "k"), (505, [], "k")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, kept string")
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    assert len(got) == len(rows) + len(odd)
    v = np.array([np.array(r[1], np.float32).astype(float) for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.9
    np.fill_diagonal(near, False)
    ids = np.array([r[0] for r in rows])
    low = ids.copy()
    for _ in range(len(ids)):
        new = np.array([min(low[i], low[near[i]].min(initial=10**9)) for i in range(len(ids))])
        if (new == low).all():
            break
        low = new
    for i, k in enumerate(ids):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (near[i].sum(), low[i], low[i] == k)
    assert all(got[k[0]].n_links == 0 and got[k[0]].component_id == k[0] and got[k[0]].kept for k in odd)
    assert vectors.near_duplicates(df.where("false")).count() == 0


def test_op9_other_lengths_and_doubles(spark):
    """Vectors of every length link among themselves; a pair that only double precision tells apart stays apart."""
    x = [1.0, 0.0]
    edge = lambda c: [c, float(np.sqrt(1 - c * c))]
    rows = [(1, x, 5), (2, edge(0.9 - 1e-12), 5), (3, edge(0.9 + 1e-12), 5), (4, [2.0, 0.0, 0.0], 5), (5, [7.0, 0.0, 0.0], 5), (6, [1.0], 5), (7, x, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, _v int")
    got = {r.vec_id: (r.n_links, r.component_id, r._v) for r in vectors.near_duplicates(df).collect()}
    assert got[4] == (1, 4, 5) and got[5] == (1, 4, 5) and got[6] == (0, 6, 5)
    assert got[1] == (2, 1, 5) and got[7] == (2, 1, 5) and got[3][1] == 1 and got[2][:2] == (1, 1)


def test_op9_skips_provably_distant_intervals(spark, monkeypatch):
    monkeypatch.setattr(vectors, "INTERVAL", 64)
    monkeypatch.setattr(vectors, "TILE", 2)
    rng = np.random.default_rng(1)
    x = np.concatenate([c + rng.normal(scale=0.02, size=(200, 8)) for c in np.eye(8)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    seen = {}
    got = vectors.near_duplicates(df, trace=lambda name, d: seen.setdefault(name, d.collect())).collect()
    assert {r.component_id for r in got} == set(range(0, 1600, 200)) and all(r.n_links == 199 for r in got)
    every = 13 * 14 // 2  # tiles of 128 vectors
    assert len(seen["tiles"]) < every / 2 and seen["intervals"][0].skipped > 0


def test_op9_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "INTERVAL", 64)
    test_op9_against_all_pairs(spark)


def brute_components(rows):
    def grams(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])

    sets = [grams(t) for _, t in rows]
    link = [[j for j, b in enumerate(sets) if a and b and 100 * len(a & b) >= 75 * len(a | b)] for a in sets]
    low = [k for k, _ in rows]
    while True:
        new = [min([low[i], *(low[j] for j in link[i])], key=lambda k: (k is None, k)) for i in range(len(rows))]
        if new == low:
            return Counter((k, len(s), c) for (k, _), s, c in zip(rows, sets, new))
        low = new


def near_copies(seed, n):
    rng = np.random.default_rng(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(n):
        if i % 3 == 0:  # a group of graded copies
            w = [f"b{j}" for j in range(80)]
            for k in rng.integers(0, 80, size=rng.integers(0, 6)):
                w[k] = f"e{i}x{k}"
        else:
            w = [f"r{rng.integers(400)}" for _ in range(rng.integers(0, 120))]
        rows.append((i, " ".join(w) + (" " + passage if i % 4 == 1 else "")))
    return rows + [(1000 + i, rows[0][1].upper()) for i in range(30)]


def test_op10_against_all_pairs(spark, docs, empty):
    rows = near_copies(1, 240)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, ngrams.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect())) == brute_components(rows)
    plain = [(r[0], r[1]) for r in ROWS]
    assert Counter(map(tuple, ngrams.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect())) == brute_components(plain)
    assert ngrams.jaccard_components(empty).count() == 0


def test_op10_with_common_ngrams_last(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "SAMPLE", 1)
    rows = near_copies(2, 150)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, ngrams.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect())) == brute_components(rows)


def test_op10_required_overlap_never_exceeds_what_similar_sets_share():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(4, 60))
        a = set(range(n))
        b = set(list(a)[: n - int(rng.integers(0, n // 3 + 1))]) | {1000 + i for i in range(int(rng.integers(0, n // 3 + 1)))}
        if 100 * len(a & b) < 75 * len(a | b):
            continue
        order = {g: rng.random() for g in a | b}
        pa, pb = (set(sorted(s, key=order.get)[: ngrams.prefix(len(s))]) for s in (a, b))
        own = lambda m: 1 - -(-m * 75 // 100)
        need = max(1, min(own(len(a)), own(len(b))) - (-(len(a) + len(b)) * 75 // 175))
        assert len(pa & pb) >= need
