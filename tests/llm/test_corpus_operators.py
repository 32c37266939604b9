"""N-gram join, decontamination, quality and the pipeline."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from marketlens.llm import decontamination, ngram_jaccard, quality
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def gram_set(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    """Smallest linked id of each row, by comparing all pairs."""
    sets = [gram_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        groups[find(i)].append(doc)
    return {doc: min(g) for g in groups.values() for doc in g}, {d: len(s) for (d, _), s in zip(rows, sets)}


def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choices(words, k=60) for _ in range(12)]
    rows = [(0, ""), (1, None), (2, "one Two"), (3, "ONE two"), (4, "  \n"), (5, "one two three")]
    passage = rng.choices(words, k=40)
    for i in range(6, 260):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.3:
            w = w[:rng.randint(3, 60)]
        if rng.random() < 0.3:
            w = passage + rng.choices(words, k=rng.randint(5, 40))
        rows.append((i, " ".join(w)))
    return rows


def test_join_equals_all_pairs(spark):
    rows = corpus()
    want, sizes = components(rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    got = ngram_jaccard.link_documents(df).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes


def test_join_edge_rows(spark):
    text = "a b c d e f g h"
    rows = [(3, text), (3, "quite other words than these are"), (9, text), (None, text), (7, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in ngram_jaccard.link_documents(df).collect()), key=str)
    assert got == sorted([(3, 3), (3, 3), (9, 3), (None, 3), (7, 7), (7, 7)], key=str)
    assert ngram_jaccard.link_documents(df.limit(0)).count() == 0
    kept = sorted(str(r.doc_id) for r in ngram_jaccard.one_of_each(df).collect())
    assert kept == ["3", "7", "None"]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in ngram_jaccard.connected(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_leaks_with_edits_case_and_punctuation(spark):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnrst"]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(12, 55)))) for i in range(60)]
    items += [(60, None), (61, "too short"), (0, items[0][1])]
    docs, want = [], set()
    for i, (item, text) in enumerate(items[:60]):
        w = text.upper().split()
        for _ in range(int(0.1 * len(w))):
            w[rng.randrange(len(w))] = "zzz"
        docs.append((i, " ".join(rng.choices(words, k=rng.randint(0, 90))) + ". " + ",\n".join(w) + "!"))
        want.add((i, item))
    docs += [(i, " ".join(rng.choices(words, k=200))) for i in range(100, 200)] + [(300, None), (301, "")]
    found = decontamination.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, x.item_id) for r in found.collect() for x in r.leaks}
    assert not {d for d, _ in got if d >= 100}
    assert len(want & got) >= 0.9 * len(want)
    none = decontamination.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([], "item_id long, text string"))
    assert all(r.leaks == [] for r in none.collect())


def edited(rng, words, kind, share, fresh):
    """``words`` with a share of edits of a kind, all over or clustered."""
    w, k = list(words), int(share * len(words))
    if kind == "clustered":
        a = rng.randrange(len(w) - k + 1)
        w[a:a + k] = [fresh() for _ in range(k)]
    for at in sorted(rng.sample(range(len(w)), k), reverse=True) if kind != "clustered" else ():
        w[at:at + 1] = {"delete": [], "insert": [w[at], fresh()], "replace": [fresh()]}[kind]
    return w


@pytest.mark.parametrize("size", [8, 11, 15, 16, 25, 39, 54, 100, 200, 420])
def test_every_leak_within_the_tolerance_is_found(size):
    rng = random.Random(size)

    def fresh():
        return f"w{rng.randrange(1 << 20):x}"

    items = [[fresh() for _ in range(size)] for _ in range(12)]
    index = decontamination.LeakIndex(list(range(len(items))), [" ".join(i) for i in items])
    texts, want = [], []
    for kind in ("delete", "insert", "replace", "clustered"):
        for share in (0.05, 0.1, 0.2):
            for i, item in enumerate(items):
                around = [[fresh() for _ in range(rng.randrange(60))] for _ in range(2)]
                texts.append(" ".join([*around[0], *edited(rng, item, kind, share, fresh), *around[1]]))
                want.append(i)
    words, begin = decontamination.word_hashes(texts)
    most = int(decontamination.TOLERANCE * size)
    recalled = brute = 0
    for t, (i, found) in enumerate(zip(want, index.leaks(texts))):
        best = decontamination.fit_distance(index.words[i], words[begin[t]:begin[t + 1]])[0]
        brute += best <= most
        recalled += [(x[0], x[3]) for x in found] == [(i, best)]
    assert brute == len(texts)
    assert recalled == brute


@pytest.mark.parametrize("size", [474, 1000])
def test_long_items_and_a_short_document_alone(size):
    item = " ".join(f"w{i}" for i in range(size))
    index = decontamination.LeakIndex([7], [item])
    for text in ("", "w0", "w0 w1 w2 w3 w4", " ".join(f"x{i}" for i in range(30))):
        assert index.leaks([text]) == [[]]
    assert index.leaks(["w0 w1 w2 w3 w4", item]) == [[], [(7, 0, size, 0)]]


def test_fit_distance_is_the_edit_distance_to_the_best_run():
    rng = random.Random(2)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(60):
        a = [rng.randint(1, 4) for _ in range(rng.randint(1, 7))]
        b = [rng.randint(1, 4) for _ in range(rng.randint(0, 9))]
        best = min(plain(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert decontamination.fit_distance(np.array(a, np.uint64), np.array(b, np.uint64))[0] == best


def test_quality_on_held_out_rows(spark):
    from marketlens.llm.registry import load_all

    sf = "/root/testdata/sf0.01"
    rows = load_all()[0]["op6_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    held = rows.filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in held)


def test_quality_edge_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "a " * 50_000), (None, "x")], "doc_id long, text string")
    stats = quality.with_statistics(rows).collect()
    assert all(len(r.stats) == len(quality.STATISTICS) for r in stats)
    measured = quality.with_statistics(rows).withColumn("y", F.lit(1.0))
    none = quality.fit_model(measured.limit(0), measured.limit(0))
    assert {r.score for r in quality.score_quality(measured, none).collect()} == {0.5}
    one = quality.fit_model(measured, measured)
    assert {round(r.score, 6) for r in quality.score_quality(measured, one).collect()} == {1.0}


def test_isotonic_is_the_closest_rising_fit():
    y = np.array([0.1, 0.4, 0.2, 0.3, 0.9, 0.7])
    fit = quality.isotonic(np.arange(6.0), y, np.ones(6))
    assert np.allclose(fit, [0.1, 0.3, 0.3, 0.3, 0.8, 0.8])


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_pipeline_drops_what_each_stage_should(spark, pipeline):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    out = pipeline.run(spark, sf).collect()
    kept = {r.doc_id for r in out}
    assert len(out) == len(kept) and all(r.round_trip for r in out)
    groups, _ = components(sorted(rows.items()))
    firsts = {d for d, c in groups.items() if d == c}
    leaks = {d for d, t in rows.items() if any(i in t for i in items)}
    assert kept <= firsts and not kept & leaks
    assert len(kept) >= 0.95 * len(firsts - leaks)


def test_pipeline_stages_take_odd_rows(spark, pipeline):
    sf = "/root/testdata/sf0.001"
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "The words of this text are plain", None, "s", 1),
           (3, "The words of this text are plain", None, "s", 1), (4, "mail me at a@b.de please now or then", "en", None, 3)]
    rows = spark.createDataFrame(odd, DOCS).withColumn("leaks", F.lit(1)).withColumn("language", F.lit("x"))
    for _, stage in pipeline.STAGES:
        assert stage(spark, rows, sf).count() >= 1
        assert stage(spark, rows.limit(0), sf).count() == 0
