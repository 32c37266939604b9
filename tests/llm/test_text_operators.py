"""Language ID, BPE, PII and toxicity: brute force, round trips, edge rows."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from marketlens.llm import byte_bpe, language_id, pii, toxicity
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string"
EDGE = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (2, "", "en", "s", 0, "x"),
        (None, "12 !!", None, "s", 5, None), (5, "word " * 30_000, "en", "s", 150_000, "y")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


def test_bpe_equals_tiktoken(spark, edge):
    v = byte_bpe.Vocabulary(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    ranks = {t: i for i, t in enumerate(v.tokens)}
    tk = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    texts = ["", None, "<|endoftext|>", "é" * 200, "x" * 3000, " \n\n  a\t"] + [
        "".join(rng.choice("abcdehst inorly!$%éß中🙂\n 0123") for _ in range(rng.randint(1, 200)))
        for _ in range(300)]
    enc = byte_bpe.Encoder(v)
    for text, ids in zip(texts, enc.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tk.encode_ordinary(text or "")
        assert enc.decode(ids) == (text or "").encode()
    path = P.path("byte_bpe_50k.tiktoken")
    rows = byte_bpe.tokenize(edge, path, P.PATTERN).collect()
    assert len(rows) == len(EDGE) and all(
        bytes(r.bpe.decoded) == (r.text or "").encode() for r in rows)
    assert byte_bpe.tokenize(edge.limit(0), path, P.PATTERN).count() == 0


def test_pieces_beyond_the_cache_are_still_encoded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 3)
    enc = byte_bpe.Encoder(byte_bpe.Vocabulary(P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    text = " ".join(f"w{i}x{i * 7}" for i in range(200))
    assert enc.decode(enc.encode([text, text])[1]).decode() == text


def literal_spans(text):
    def luhn(s):
        t = 0
        for i, c in enumerate(s[::-1]):
            x = int(c) * (1 + i % 2)
            t += x - 9 * (x > 9)
        return t % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) < 256 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        s = re.sub("[^0-9]", "", m.group())
        if 13 <= len(s) <= 19 and luhn(s):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_pii_base_spans_equal_the_literal_patterns(spark, edge):
    rng = random.Random(4)
    for _ in range(5000):
        text = "".join(rng.choice("a1.@-+ 2_%(9b0 ") for _ in range(rng.randint(0, 60)))
        assert [s[:3] for s in pii.spans_of(text) if s[4]] == literal_spans(text)
    assert pii.spans_of("9" * 100_000) == [] and pii.spans_of(None) == []
    found = pii.find_pii(edge)
    assert found.columns == ["doc_id", "spans"] and found.count() == len(EDGE)


def test_pii_checksums_and_context():
    kinds = lambda t: [s[0] for s in pii.spans_of(t)]
    assert kinds("IBAN DE89370400440532013000 here") == ["iban"]
    assert kinds("IBAN DE88370400440532013000 here") == []
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    near, far = pii.spans_of("visa 4111 1111 1111 1111"), pii.spans_of("4111 1111 1111 1111")
    assert near[0][3] > far[0][3]


def test_pii_redaction_leaves_no_base_span(spark):
    text = "mail a.b@c.de or +1 (017) 555-7713 from 10.0.0.1, 4111111111111111."
    rows = spark.createDataFrame([(1, text, "en", "s", len(text), None), *EDGE], SCHEMA)
    for r in pii.redact(rows).collect():
        assert literal_spans(r.text or "") == [] and r.n_chars == len(r.text or "")


def test_language_id_on_held_out_rows(spark, edge):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    net = language_id.train_network(docs.filter("pmod(doc_id, 4) != 2"))
    found = language_id.identify(docs.filter("pmod(doc_id, 4) = 2").drop("lang"), net).join(
        docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.language.lang == r.lang for r in found]) > 0.95
    assert all(0 <= r.language.score <= 1 for r in found)
    odd = {r.doc_id: r.language for r in language_id.identify(edge, net).collect()}
    assert odd[1].lang == odd[2].lang == odd[None].lang == "und" and odd[1].score == 0
    empty = language_id.train_network(docs.limit(0))
    assert {r.language.lang for r in language_id.identify(edge, empty).collect()} == {"und"}


def test_toxicity_finds_planted_words(spark, edge):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "in", "es", "re"]) for _ in range(rng.randint(1, 4)))
    def text(toxic):
        w = [word() for _ in range(120)]
        for _ in range(8 * toxic):
            w[rng.randrange(120)] = rng.choice(["worthless", "disgusting", "pathetic", "stupid"])
        return " ".join(w)
    docs = spark.createDataFrame([(i, text(i % 3 == 0)) for i in range(600)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    model = toxicity.train_model(docs, labels.filter("doc_id < 400"))
    held = toxicity.score_toxicity(docs.filter("doc_id >= 400"), model).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 3 == 0) for r in held]) > 0.95
    scored = toxicity.score_toxicity(edge, model).collect()
    assert len(scored) == len(EDGE) and all(0 <= r.score <= 1 for r in scored)
    blank = toxicity.train_model(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(edge, blank).collect()} == {0.0}


def test_toxicity_learns_what_stands_late_in_a_text(spark):
    rng = random.Random(4)

    def text(toxic):
        w = ["".join(rng.choices(["an", "er", "th", "on", "in", "es", "re"], k=rng.randint(1, 4))) for _ in range(1500)]
        for at in rng.sample(range(1300, 1500), 12 * toxic):
            w[at] = rng.choice(["worthless", "disgusting", "pathetic", "stupid"])
        return " ".join(w)

    docs = spark.createDataFrame([(i, text(i % 3 == 0)) for i in range(240)], "doc_id long, text string")
    assert docs.filter(F.substring("text", 1, 6000).rlike("worthless|disgusting|pathetic|stupid")).count() == 0
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    model = toxicity.train_model(docs, labels.filter("doc_id < 160"))
    held = toxicity.score_toxicity(docs.filter("doc_id >= 160"), model).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 3 == 0) for r in held]) > 0.95


def test_toxicity_training_takes_windows_from_all_over_a_text(spark, monkeypatch):
    text = " ".join(f"w{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(400))
    part = toxicity.spread(text, 0.25).split()
    assert len(part) == 12 * 8
    places = [text.split().index(w) for w in part]
    assert places == sorted(places) and max(np.diff(places)) <= 40 and places[-1] >= 360
    assert toxicity.spread(text, 1.0) == text
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 2000)
    rows = spark.createDataFrame([(k % 2, k, text) for k in range(8)], "toxic int, k long, text string")
    assert {len(r.text) < len(text) / 2 for r in toxicity._training_texts(rows)} == {True}


def test_op2_digests(spark):
    from marketlens.llm.registry import load_all

    rows = load_all()[0]["op2_byte_bpe"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
