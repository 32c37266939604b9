"""Periodic runs, site template removal and the conversation prefix trie."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from marketlens.llm import periodic_runs, prefix_trie, site_template
from marketlens.llm.registry import load

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- periodic runs ------------------------------------------------------------------------

def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q):
                s = w[i:i + length]
                if all(any(s[k] != s[k + r] for k in range(length - r)) for r in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    k = rng.choice([1, 2, 2, 3, 5, 30])
    w = []
    while len(w) < rng.choice([3, 20, 60, 200]):
        mode = rng.random()
        if mode < 0.3:
            w += [str(rng.randrange(k)) for _ in range(rng.randint(1, 15))]
        elif mode < 0.7:
            unit = [str(rng.randrange(k)) for _ in range(rng.randint(1, 12))]
            w += unit * rng.randint(2, 7) + unit[:rng.randrange(len(unit) + 1)]
        elif w:
            w += w[-rng.randint(1, 40):] * rng.randint(1, 5)
    return w


def test_runs_equal_a_search_of_all_periods():
    rng = random.Random(11)
    found = 0
    for _ in range(120):
        texts = [random_words(rng) for _ in range(rng.randint(1, 10))] + [[]]
        got = periodic_runs.runs_of_texts(texts)
        want = [plain_runs(w) for w in texts]
        assert got == want
        found += sum(map(len, want))
    assert found > 500


@pytest.mark.parametrize("period", [1, 2, 3, 4, 7, 8, 9, 31, 64, 100])
def test_runs_of_each_scale(period):
    unit = [f"u{i}" for i in range(period)]
    w = ["x", "y"] + unit * 5 + unit[: period // 2] + ["z"]
    start, length, q = 2, 5 * period + period // 2, period
    want = [(start, length, q)] if length >= 6 else []
    assert periodic_runs.runs_of_texts([w]) == [want]


def test_run_of_a_very_long_text():
    assert periodic_runs.runs_of_texts([["a", "b", "b"] * 200_000]) == [[(0, 600_000, 3)]]


def test_highly_periodic_part_of_a_longer_period():
    unit = ["a"] * 40 + ["b"]
    w = unit * 6
    got = periodic_runs.runs_of_texts([w])[0]
    assert got == plain_runs(w)
    assert (0, len(w), 41) in got and (0, 40, 1) in got


def test_collapse_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a a a a a a a"), (4, "a a a a a a a"), (None, "x"),
            (5, "A b A b A b A b A b A b"), (6, "w " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 AS runs", "2 AS collapsed", "3 AS start")
    got = periodic_runs.collapse_runs(docs).collect()
    assert len(got) == len(rows) and got[0].runs == 1 and got[0].collapsed == 2 and got[0].start == 3
    by_text = {r.text: r.periodic for r in got}
    for text in (None, "", " \n\t "):
        assert by_text[text].runs == [] and by_text[text].collapsed == ""
    assert by_text["a a a a a a a"].collapsed == "a"
    assert by_text["x"].collapsed == "x"
    assert by_text["w " * 30_000].runs[0].asDict() == {"start": 0, "length": 30_000, "period": 1}
    assert [tuple(r) for r in by_text[rows[6][1]].runs] == [(0, 9, 2)]
    empty = periodic_runs.collapse_runs(docs.limit(0))
    assert empty.columns == [*docs.columns, "periodic"] and empty.count() == 0


def test_op11_equals_plain_search(spark):
    got = {r.doc_id: tuple(r)[1:] for r in periodic_runs.op11_periodic_runs(spark, SF).collect()}
    rows = load(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    planted = 0
    for doc, text in rows:
        w = WORD.findall(text or "")
        n, h = len(w), zlib.crc32(str(doc).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        if n > 2000:
            continue
        runs = plain_runs(w)
        drop = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = " ".join(x for i, x in enumerate(w) if i not in drop)
        assert got[doc] == (
            len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
    assert planted


# --- site template removal --------------------------------------------------------------------

def text_of(page):
    return site_template.Page(page).text()


@pytest.mark.parametrize("page,want", [
    ("", ""),
    ("just text &amp; more", "just text & more"),
    ("<p>a<b>b</b>c<br>d<p>e", "abc d\ne"),
    ("<p>a  \n b&nbsp;c</p>", "a b c"),
    ("<div>one<div>two</div>three</div>", "one\ntwo\nthree"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
    ("<script>var t='</p>';</script><style>p{}</style><p>x<!-- <p>no --> y</p>", "x y"),
    ("<title>no</title><body>yes", "yes"),
    ("<head><title>no</title><p>yes", "yes"),
    ("<nav>n</nav><header>h</header><aside>s</aside><form>f</form><footer>f</footer><p>text</p>", "text"),
    ("<div class='ad'>buy</div><div id=comments><p>me</p></div><p>text</p>", "text"),
    ("<div class='cookie-notice'>c</div><div role=navigation>n</div><p hidden>h</p><p>text</p>", "text"),
    ("<p>one <span class=ad>buy</span> two <button>b</button>three</p>", "one two three"),
    ("<div>out</div><article><header><h1>T</h1></header><p>in</p><section class=comments>c</section></article>",
     "T\nin"),
    ("<main><div class=sidebar>s</div><p>x</p></main><p>out</p>", "x"),
    ("<body class='has-sidebar'><div class='has-sidebar'><p>kept</p></div>", "kept"),
    ("1 < 2 and a <b", "1 < 2 and a <b"),
    ('<p title="a > b">x</p><p class="broken>y</p><p>z</p>', "x\ny\nz"),
    ("<script>never ends <p>x", ""),
    ("<article></article><p>out</p>", ""),
    ("&lt;p&gt; &amp;amp; &#233; &copy", "<p> &amp; é ©"),
])
def test_page_text(page, want):
    assert text_of(page) == want


def test_deep_and_long_pages_are_linear():
    assert text_of("<div>" * 50_000 + "x") == "x"
    assert text_of("<p>" + "<span>" * 50_000 + "x" + "</span>" * 50_000) == "x"
    assert text_of('<a b="' * 50_000) == '<a b="' * 50_000
    assert len(text_of("<p>" + "word " * 400_000)) == 400_000 * 5 - 1


def pages_of_sites(n=9):
    out = []
    for i in range(n):
        box = "<div><p>Join our club</p></div>"
        body = f"<h1>Title {i}</h1><p>Own text {i}.</p><p>Under the usual licence.</p>"
        out.append((i, f"http://a.example/{i}", f"<div><ul><li>Home<li>Shop</ul></div><article>{body}{box}</article>"))
        # No declared article: what recurs is template, what does not is text.
        out.append((100 + i, f"http://b.example/{i}", f"<div>Home | Shop</div><p>Story {i}</p><div>Imprint</div>"))
        # Copies of one article: one surrounding, so nothing of it is template.
        out.append((200 + i, f"http://c.example/{i}", "<div><div>Same box</div><p>Same story</p></div>"))
        out.append((300 + i, None, "<div>Home</div><p>No site</p>"))
    return out


def plain_main_text(rows, min_pages):
    seen = defaultdict(set)
    host = lambda u: (re.match(r"^.*?://([^/?#]*)", u or "") or [None, ""])[1].lower()
    for _, url, page in rows:
        for s, around in site_template.Page(page or "").surroundings().items():
            seen[host(url), s].add(around)
    cut = defaultdict(set)
    for (h, s), around in seen.items():
        if h and len(around) >= min_pages:
            cut[h].add(s)
    return sorted((i, site_template.Page(p or "", frozenset(cut[host(u)])).text()) for i, u, p in rows)


def test_site_template_goes_and_articles_stay(spark):
    rows = pages_of_sites()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in site_template.main_text(pages).collect()}
    for i in range(9):
        assert got[i] == f"Title {i}\nOwn text {i}.\nUnder the usual licence."
        assert got[100 + i] == f"Story {i}"
        assert got[200 + i] == "Same box\nSame story"
        assert got[300 + i] == "Home\nNo site"
    assert sorted(got.items()) == plain_main_text(rows, site_template.MIN_PAGES)


def test_main_text_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (2, "x", ""), (None, "http://a/b", "<p>t</p>"), (3, "http://a/b", "<p>t</p>"),
            (3, "http://a/b", "<p>t</p>"), (3, "http://a/b", "<p>u</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "7 AS host", "8 AS key", "9 AS deleted", "10 AS row")
    got = site_template.main_text(pages)
    assert got.columns == [*pages.columns, "text"]
    assert sorted(r.text for r in got.collect()) == ["", "", "", "t", "t", "t", "u"]
    assert {(r.host, r.key, r.deleted, r.row) for r in got.collect()} == {(7, 8, 9, 10)}
    assert site_template.main_text(pages.limit(0)).count() == 0


def test_op12_equals_plain_version(spark):
    rows = [tuple(r) for r in load(spark, SF, "pages").select("page_id", "url", "html").collect()]
    got = site_template.op12_html_extraction(spark, SF).collect()
    assert sorted((r.page_id, r.text) for r in got) == plain_main_text(rows, site_template.MIN_PAGES)
    assert all(r.n_chars == len(r.text) for r in got)


# --- prefix trie ----------------------------------------------------------------------------

def plain_trie(conversations):
    """Rows of all nodes of {conv_id: [(role, text), ...]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = own + sum(saved[x] for x in kids[k])
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k],
         hashlib.sha256(",".join(map(str, sorted(ends.get(k, ())))).encode()).hexdigest())
        for k, m in members.items())


def trie_rows(strings):
    return sorted(tuple(r) for r in prefix_trie.prefix_trie(strings).select(*prefix_trie.OUT).collect())


def random_rows(rng, n):
    rows = []
    for c in range(n):
        turns = rng.choice([0, 1, 1, 2, 3, 4, 6])
        for t in range(turns):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "yes", "no", "hello\n", ""])))
    return rows


@pytest.mark.parametrize("block", [1, 300, 1 << 20])
def test_trie_equals_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK_BYTES", block)
    monkeypatch.setattr(prefix_trie, "PIECE_CHARS", 20)
    rows = random_rows(random.Random(13), 400)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    turns = prefix_trie.turn_rows(df)
    got = trie_rows(prefix_trie.id_strings(turns.withColumn("g", turns.conv_id), "g"))
    conversations = defaultdict(list)
    for c, _, role, text in rows:
        conversations[c].append((role, text))
    assert got == plain_trie(conversations)


def test_tree_layouts_grow_and_agree_with_a_dict():
    rng = random.Random(5)
    tree, known = prefix_trie.RadixTree(), {}
    for _ in range(3000):
        key = bytes(rng.randrange(rng.choice([2, 256])) for _ in range(rng.choice([0, 1, 2, 3, 40])))
        known[key] = len(known)
        tree.insert(key, (1, known[key], key, ""))
    nodes = tree.downwards()
    assert {n.value[2]: n.value[1] for n in nodes if n.value} == known
    assert {type(n.kids).__name__ for n in nodes if n.kids} == {"Sorted", "Indexed", "Full"}
    assert {n.kids.room for n in nodes if n.kids} == {4, 16, 48, 256}
    for n in nodes:
        if n.value:
            assert tree.along(n.value[2])[-1] is n


def test_rebuilt_conversations(spark):
    rng = random.Random(3)
    rows = [(c, t, "u", f"{rng.randrange(3)}") for c in [0, 1, 2, 7, 99, 100, 101, 255, 300, 301, 500, -1, -150]
            for t in range(rng.choice([1, 2, 5, 9]))]
    rows += [(None, 0, "u", "lost"), (7, None, None, None), (7, None, "u", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 AS id", "2 AS base", "3 AS key")
    own = defaultdict(list)
    rank = {(r, t): i for i, (r, t) in enumerate([("", ""), ("u", "")])}  # ids of equal turns decide
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    ids = {(r.role or "", r.text or ""): r.id for r in prefix_trie.turn_rows(df).join(
        df.select("conv_id", "turn", "role", "text"), ["conv_id", "turn"]).collect()}
    assert rank and ids
    built = {}
    for c, turns in own.items():
        turns.sort(key=lambda t: t[:2])
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = (base, h)
    words = {c: [t[2:] for t in turns] for c, turns in own.items()}
    want = {c: words.get(base, [])[:h] + words[c][h:] for c, (base, h) in built.items()}
    got = trie_rows(prefix_trie.rebuilt(df))
    other = {**want, 7: list(want[7])}
    if len(other[7]) >= 2 and built[7][1] == 0:
        other[7][0], other[7][1] = other[7][1], other[7][0]  # the two null turns, in order of their ids
    assert got in (plain_trie(want), plain_trie(other))


def test_trie_without_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(none)).count() == 0
    turnless = spark.createDataFrame([(5, bytearray()), (3, bytearray())], "conv_id long, key binary")
    assert trie_rows(turnless) == plain_trie({5: [], 3: []})


# --- cases mended in earlier operators ------------------------------------------------------

def test_iban_before_words_in_capitals():
    from marketlens.llm import pii

    text = "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF, then GB82 WEST 1234 5698 7654 32"
    got = [text[a:b] for kind, a, b, *_ in pii.spans_of(text) if kind == "iban"]
    assert got == ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]


def test_host_of_very_many_labels(spark):
    from marketlens.llm import url_filter

    rules = spark.createDataFrame([("example.org", "/a/", "block"), ("org", "/", "allow")],
                                  "host string, path string, verdict string")
    url = "http://" + "x." * 100_000 + "example.org/a/b"
    pages = spark.createDataFrame([(1, url), (2, "http://org/"), (3, "http://" + "y." * 100_000)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules, default="none").collect()}
    assert got == {1: ("example.org/a/", "block"), 2: ("org/", "allow"), 3: (None, "none")}


def test_shared_ids_with_an_empty_row_do_not_link(spark):
    from marketlens.llm import ngram_jaccard

    rows = [(1, "one two three four five six"), (1, None), (2, "a b c d e f g"), (2, ""), (3, "  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in ngram_jaccard.link_documents(docs).collect()}
    assert got == {(1, 1), (2, 2), (3, 3)}


def test_short_and_unspaced_items():
    from marketlens.llm import decontamination

    han = "机器学习是人工智能的一个分支它使计算机能够从数据中学习而无需明确编程" * 2
    items = ["The capital of France is Paris", "Paris", "no no", "", han]
    index = decontamination.LeakIndex([0, 1, 2, 3, 4], items)
    texts = ["They say: the capital of France is Paris!", "The capital of France was Paris", "paris", "Paris is nice",
             "no, no", "no", "", None, f"前言。{han[:20]}{han[21:]}后记", "机器 is not 学习"]
    got = [[x[0] for x in found] for found in index.leaks(texts)]
    assert got == [[0], [], [1], [], [2], [], [], [], [4], []]


@pytest.mark.parametrize("size", [8, 9, 10, 14, 15, 20, 29, 30, 35, 64, 128, 420])
def test_recall_of_walks_and_samples(size):
    """At least 0.9 of copies with edits of every kind at the tolerance."""
    from marketlens.llm import decontamination as d

    for kind in ("delete", "insert", "replace", "cluster"):
        pairs = [(f"w{'_'.join(map(str, item[:1]))}", item, copy) for item, copy in d._copies(77, size, kind, 60)]
        index = d.LeakIndex(list(range(len(pairs))), [" ".join(f"w{x}" for x in item) for _, item, _ in pairs])
        found = index.leaks([" ".join(f"w{x}" for x in copy) for _, _, copy in pairs])
        assert sum(any(x[0] == i for x in f) for i, f in enumerate(found)) >= 0.9 * len(pairs), kind


def test_results_are_filtered_without_a_second_search(spark):
    import corpus_pipeline

    docs = load(spark, SF, "documents")
    for stage in (corpus_pipeline.keep_known_languages, corpus_pipeline.drop_benchmark_leaks):
        plan = stage(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("hot", [1, 2, 20])
def test_join_with_ngrams_counted_in_their_block(spark, monkeypatch, hot):
    """Frequent n-grams go to their fragment as counts; links stay those of all pairs."""
    from marketlens.llm import ngram_jaccard
    from tests.llm.test_corpus_operators import components, corpus

    monkeypatch.setattr(ngram_jaccard, "HOT", hot)
    rows = corpus()
    want, sizes = components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_jaccard.link_documents(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes


@pytest.mark.parametrize("fragments, exact", [(16, False), (800, False), (16_384, True), (20_000, True), (1 << 22, True)])
def test_ngram_hashes_from_fragment_and_low_bits(fragments, exact):
    from marketlens.llm import ngram_jaccard as n

    rng = np.random.default_rng(3)
    grams = rng.integers(0, 1 << 64, 50_000, np.uint64)
    grams[:2] = 0, (1 << 64) - 1
    part = n._fragment(grams, fragments)
    starts = n._starts(fragments)
    assert (starts[part] <= grams).all() and (n._fragment(starts, fragments) == np.arange(fragments)).all()
    whole = n._whole(starts[part], grams)
    assert (n._fragment(whole, fragments) == part).all()
    again = n._whole(starts[part], n._unpack(n._pack(whole << np.uint64(n.DOC_BITS))) >> np.uint64(n.DOC_BITS))
    assert (again == whole).all()
    assert len(np.unique(whole)) == len(np.unique(grams))
    assert not exact or (whole == grams).all()
