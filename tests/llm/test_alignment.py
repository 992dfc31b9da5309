"""Alignment of two tokenizers against a plain sweep over the libraries' own tokens."""

import hashlib
import json
from collections import Counter

import pytest
from tests.conftest import SF
from tidemark.llm import alignment
from tidemark.session import table


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    path = alignment.default_path("byte_bpe_50k.json")
    a = Tokenizer.from_file(path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.default_path("piece_bpe_32k.model"))
    with open(path, encoding="utf-8") as f:
        vocab = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    byte = alignment._byte_of_char()
    a_bytes = lambda i: bytes(byte[c] for c in vocab[i])
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, b, a_bytes, b_bytes


def brute(texts, libraries):
    a, b, a_bytes, b_bytes = libraries
    found, counts = [], Counter()
    for text in texts:
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        sides, want = [], (" " + (text or "")).encode()
        for x, of in zip(ids, (a_bytes, b_bytes)):
            at, spans = 0, []
            for i in x:
                spans.append((at, at + len(of(i)), i))
                at += len(of(i))
            sides.append(spans)
        if not text or any(b"".join(map(of, x)) != want for x, of in zip(ids, (a_bytes, b_bytes))):
            found.append(([], [], [], []))
            continue
        links, j = [], 0
        for s, e, i in sides[0]:
            while sides[1][j][1] <= s:
                j += 1
            k = j
            while k < len(sides[1]) and sides[1][k][0] < e:
                links.append((i, sides[1][k][2]))
                k += 1
        cuts = sorted({e for _, e, _ in sides[0]} & {e for _, e, _ in sides[1]})
        named, low = [], 0
        for c in cuts:
            named.append("|".join(",".join(str(i) for s, e, i in side if low < e <= c) for side in sides))
            low = c
        counts.update(links)
        found.append((ids[0], ids[1], named, links))
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(len(x), len(y), len(g), len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k), ";".join(g)) for x, y, g, k in found]


TEXTS = [
    None, "", " ", "  ", " a", "a ", "Hello world, it's  fine.\n\n Next\tline \n", "naïve 日本語のテキスト🙂 Ωmega", "<|endoftext|> <s> </s> <unk>", "▁odd▁", "x\u0000y", "é" * 50,
    "same same same", "same same same", "foo bar   baz　", "\n", "123 4567 89", "don't DON'T we'll", " leading and trailing ", "a\r\nb", "<0x41> <0x0A>",
]


@pytest.mark.parametrize("held", [alignment.HELD, 3])
def test_alignment_against_brute_force(spark, monkeypatch, libraries, held):
    monkeypatch.setattr(alignment, "HELD", held)
    docs = spark.createDataFrame([(i, t, "x", "links", 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_a string, row string, code int").repartition(3)
    out = alignment.cross_align(docs, whole=True)
    assert out.columns == ["doc_id", "text", "row", "code", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in out.collect()}
    assert got == dict(enumerate(brute(TEXTS, libraries)))
    assert alignment.cross_align(docs.where("false")).count() == 0


def test_long_texts_in_parts(monkeypatch, libraries):
    text = "Some words, and  more of them\n in a long text that goes on. " * 40 + "日本語" * 50
    both = alignment.coders("", "")
    facts, named, codes = alignment._facts([text], both)
    monkeypatch.setattr(alignment, "LONG", 100)
    assert len(alignment.parts(text)) > 10
    in_parts, digest, group, code = alignment._long_facts(text, both, True)
    assert [list(f) for f in in_parts] == [list(f) for f in facts] and group == named[0] and (code == codes[0]).all()
    assert digest == hashlib.sha256(group.encode()).hexdigest()
    assert not (lambda t: alignment._BETWEEN.search(t))("ä ö 1 2")


def test_op13_on_the_tables(spark, libraries):
    docs = sorted((r.doc_id, r.text) for r in table(spark, SF, "documents").collect())
    want = {d: (*x[:-1], hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "") for (d, _), x in zip(docs, brute([t for _, t in docs], libraries))}
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.op13_token_alignment(spark, SF).collect()}
    assert got == want
