"""Operators against plain versions, and the defined results of odd inputs."""

import hashlib
import json
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from arrayq.llm import chat, classifier, decontaminate, hmm, html_text, near_dup, packing, queries, rules, store, substring_dedup, token_counts
from arrayq.llm import graph
from arrayq.runtime import reachable

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    reachable(spark)
    return spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in rows], DOCS)


def vocabulary_text(rnd, n, words=400):
    return " ".join(f"w{rnd.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(7)
    base = [vocabulary_text(rnd, rnd.choice([0, 1, 3, 12, 13, 14, 60, 200])) for _ in range(120)]
    shared = vocabulary_text(rnd, 60, 9999)
    rows = list(enumerate(base))
    for k in range(40):
        w = base[k % 120].split() or ["x"]
        w[rnd.randrange(len(w))] = "Edited"
        rows.append((200 + k, " ".join(w)))
        rows.append((300 + k, f"{vocabulary_text(rnd, 30)} {shared}\n{vocabulary_text(rnd, 5)}"))
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "a " * 500), (404, "a " * 300), (405, "ab" * 200_000), (406, vocabulary_text(rnd, 20_000))]
    return rows


ODD = [(None, "a b c"), (5, None), (5, ""), (7, "x y z"), (7, "x y z"), (8, "é  \U0001f600 z")]


def test_substring_matches_brute(spark, corpus):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(substring_dedup.removed_words(frame(spark, corpus))).collect()}
    assert got == brute.substring(corpus)
    assert sum(x[1] for x in got.values()) > 1000


def test_substring_cut_texts_and_odd_rows(spark, corpus):
    out = substring_dedup.deduplicate(frame(spark, corpus))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    want = brute.substring(corpus)
    for r in out.collect():
        if want[r.doc_id][1]:
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][2] and r.n_chars == len(r.text)
        else:
            assert r.text == dict(corpus)[r.doc_id]
    clash = frame(spark, corpus).withColumn("begins", F.lit(1)).withColumn("cut_text", F.lit("x")).withColumn("text_hash", F.lit(2))
    out = substring_dedup.deduplicate(clash)
    assert out.columns == clash.columns and all(hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][2] for r in out.collect() if want[r.doc_id][1])
    assert substring_dedup.digest(substring_dedup.removed_words(frame(spark, ODD))).count() == len(ODD)
    assert substring_dedup.digest(substring_dedup.removed_words(frame(spark, []))).count() == 0


@pytest.mark.parametrize("shingle", [4, 5])
def test_near_duplicates_match_brute(spark, corpus, shingle):
    rows = [x for x in corpus if x[0] != 405]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, rows), shingle, block=32).collect()}
    assert got == brute.near(rows, shingle)


def test_hot_key_compares_components(spark):
    """Hundreds of texts that share most keys, some linked and some not, in small blocks."""
    rnd = random.Random(31)
    base = vocabulary_text(rnd, 120, 9999).split()
    rows = []
    for k in range(240):
        w = list(base)
        for _ in range(rnd.choice([1, 1, 2, 3, 6, 12])):
            w[rnd.randrange(120)] = f"new{rnd.randrange(50)}"
        rows.append((k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, rows), 5, block=16).collect()}
    assert got == brute.near(rows, 5) and len({x[1] for x in got.values()}) > 5
    two = frame(spark, [(1, "a b c d e f g h"), (1, "other words than those of the first one are here"), (2, "a b c d e f g h")])
    assert len({str(sorted(near_dup.near_duplicates(two).collect())) for _ in range(2)}) == 1


def test_near_duplicates_of_odd_rows(spark):
    got = sorted(near_dup.near_duplicates(frame(spark, ODD)).collect(), key=str)
    assert len(got) == len(ODD) and all(r.kept for r in got)
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0


def test_parity_bound_never_loses_a_link():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (5, 100, 3000):
        a = rng.integers(0, 1 << 63, n, np.uint64)
        b = np.concatenate([a[: n - n // 10], rng.integers(0, 1 << 63, n // 10, np.uint64)])
        p = near_dup.parities(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, n, 2 * n]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert near_dup.possible(p[:1], p[1:], np.array([2 * n]), math.floor(100 * true))[0]


def test_components(spark):
    reachable(spark)
    rnd = random.Random(3)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(1, 1), (None, 4)]
    up = {}
    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((up.get(a, a), up.get(b, b)))
            for k in {*up, a, b}:
                if up.get(k, k) == y:
                    up[k] = x
            up.setdefault(a, x), up.setdefault(b, x)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == up
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def enumerated(cls, start, move, emit):
    from itertools import product

    total = 0.0
    for path in product(range(len(start)), repeat=len(cls)):
        p = start[path[0]] * emit[cls[0], path[0]]
        for t in range(1, len(cls)):
            p *= move[path[t - 1], path[t]] * emit[cls[t], path[t]]
        total += p
    return math.log10(total)


def test_forward_is_the_sum_over_paths():
    import numpy as np

    rng = np.random.default_rng(2)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    start, move, emit = norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((6, 3)), 0)
    cls, first = rng.integers(0, 6, 9), np.array([0, 4, 5, 9])
    got = hmm.forward(cls, first, start, move, emit)
    assert np.allclose(got, [enumerated(cls[s:e], start, move, emit) for s, e in zip(first[:-1], first[1:])])


def test_stretches_count_like_whole_texts():
    """Each token and move counts once, and nearly as over the whole text; Baum-Welch never makes the texts less likely."""
    import numpy as np

    rng = np.random.default_rng(3)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    start, move, emit = norm(rng.random(4), 0), norm(rng.random((4, 4)) + 2 * np.eye(4), 1), norm(rng.random((50, 4)), 0)
    first = np.array([0, 1, 700, 701, 1000, 1020])
    cls = rng.integers(0, 50, 1020)
    last = -math.inf
    for _ in range(4):
        whole = hmm.expected(cls, first, start, move, emit)
        at, starts, counts, heads = hmm.stretches(first, 64, 16)
        assert sorted(at[counts].tolist()) == list(range(1020)) and heads.sum() == 5
        cut = hmm.expected(cls[at], starts, start, move, emit, counts, heads)
        assert all(np.allclose(x, y, rtol=1e-3, atol=1e-3) for x, y in zip(whole[:3], cut[:3])) and math.isclose(whole[3], cut[3], rel_tol=1e-5)
        assert math.isclose(whole[0].sum(), 5, rel_tol=1e-4) and math.isclose(cut[1].sum(), 1015, rel_tol=1e-4) and math.isclose(cut[2].sum(), 1020, rel_tol=1e-4)
        assert whole[3] >= last and math.isclose(whole[3], hmm.forward(cls, first, start, move, emit).sum() * math.log(10), rel_tol=1e-5)
        last, start, move, emit = whole[3], norm(whole[0], 0), norm(whole[1], 1), norm(whole[2], 0)
    assert len(hmm.stretches(np.array([0]), 64, 16)[0]) == 0


def test_language_model(spark, corpus):
    rows = [x for x in corpus if x[0] != 405]
    docs = frame(spark, rows).withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    got = {r.doc_id: r for r in hmm.scored(docs, docs.where("not held_out"), own=63, suffixes=64).collect()}
    assert len(got) == len(rows)
    counts = {}
    words = {d: [*brute.words(brute.lower(t)), None] for d, t in rows}
    for d, w in words.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            for x in w:
                counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for d, w in words.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(d).encode()) % 7 == 2, len(w), sum(x in counts for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0 or not w
    assert hmm.scored(docs.limit(0), docs.limit(0)).count() == 0


def test_quality_rules(spark):
    rnd = random.Random(4)
    rows = [(k, vocabulary_text(rnd, rnd.choice([5, 19, 20, 80]), 5000) + rnd.choice(["", "\nx y\nx y\n###", " a b c d e f g h" * 6])) for k in range(300)] + [(999, None), (998, "$" * 400 + " " + "z" * 50)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(300)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in rules.judged(docs, labels).collect()}
    for d, t in rows:
        w, lines, seen, dup = brute.words(t), (t or "").split("\n"), set(), 0
        for x in lines:
            if brute.words(x):
                dup += x in seen
                seen.add(x)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        hit = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(8)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(hit))
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert rules.judged(docs.limit(0), labels).count() == 0
    exact = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    for k, n, p in ((3, 40, 0.1), (0, 437, 0.01), (30, 40, 0.5), (39, 40, 0.9), (40, 40, 0.9), (900, 1000, 0.9)):
        assert math.isclose(rules.at_most(k, n, p), exact(k, n, p), rel_tol=1e-9)


def test_thresholds_keep_good_documents(spark, tmp_path):
    """Few of the good documents that had no part in choosing the cutoffs are rejected."""
    rnd = random.Random(9)
    rows = [(k, vocabulary_text(rnd, rnd.randrange(30, 120), 5000) + " #" * rnd.choice([0, 0, 0, 1, 2])) for k in range(3000)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(1500)], "doc_id long, quality int, toxic int")
    lost = rules.judged(frame(spark, rows), labels).where("doc_id >= 1500 and not base_failed and not kept").count()
    assert lost <= 1500 * 0.02


def test_thresholds_reject_planted_junk(spark):
    """500 good documents are enough: texts full of symbols are rejected, hardly a good one is; with 250, nothing is."""
    rnd = random.Random(10)
    assert rules.least_labels(4) == 437 and 0.99**437 <= 0.05 / 4 < 0.99**436
    rows = [(k, vocabulary_text(rnd, rnd.randrange(30, 120), 5000)) for k in range(1500)]
    rows += [(k, vocabulary_text(rnd, 40, 5000).replace(" ", "#$ ")) for k in range(2000, 2200)]
    label = lambda n: spark.createDataFrame([(k, 1, 0) for k in range(n)] + [(k, 0, 0) for k in range(2000, 2050)], "doc_id long, quality int, toxic int")
    got = rules.judged(frame(spark, rows), label(500)).where("not base_failed").collect()
    assert {r.kept for r in got if r.doc_id >= 2000} == {False} and sum(r.doc_id >= 2000 for r in got) == 200
    assert sum(not r.kept for r in got if r.doc_id < 2000) <= 15
    assert rules.judged(frame(spark, rows), label(250)).where("not base_failed and not kept").count() == 0


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ('<p title="5" tall">first text</p>', "first text"),
        ("<p>a<p>b<div>c</div>d", "a\nb\nc\nd"),
        ("x<script>no</script>y<!-- no -->z<button>no</button>!", "xyz!"),
        ("<head><title>no</title><meta x><p>in body", "in body"),
        ("1 < 2 &amp;&nbsp;3 &#8212;<br>4 </> <!-->5", "1 < 2 & 3 — 4 5"),
        ("<ul><li>x<li>y<ul><li>z</ul></ul><table><tr><td>1<td>2</table>", "x\ny\nz\n1\n2"),
        ("<header>no</header><nav>no</nav><article><header><h1>T</h1></header><p id=share>x<math>2</math></p><section class=alert>w</section></article><p>no", "T\nx2\nw"),
        ("<main><p>t</p><p class='ad'>no</p><div class='comments'>no</div><aside>no</aside><form>no</form><footer>no</footer></main>", "t"),
        ("<div class=cookie-notice>a</div><div class='site-footer footer'>no</div><div role=banner>no</div><div hidden>no</div><p class=notice>b", "b"),
        ("<svg/>a<textarea><p>no</textarea><style>no", "a"),
        ("", ""),
        ("<b", ""),
    ],
)
def test_main_text(source, want):
    assert html_text.Page(source).blocks() == want


def test_templates_match_brute(spark):
    """Sites of plain blocks: what recurs is counted in plain Python."""
    rnd = random.Random(21)
    rows, blocks, main = [], {}, {}
    for site, n in enumerate((1, 2, 3, 5, 8, 20, 60)):
        for k in range(n):
            own = [f"own {site} {k} {j} " + vocabulary_text(rnd, 12) for j in range(4)]
            some = [f"now and then {site} {j}" for j in range(4) if rnd.random() < (0.05, 0.3, 0.6, 0.95)[j]]
            b = [f"site {site} top", *own[:2], *some, *own[2:], f"site {site} end"]
            page = len(rows)
            blocks[page], main[page] = (site, b), k % 2 == 0 and site % 2 == 0
            inner = "".join(f"<div><p>{x}</p></div>" for x in b)
            rows.append((page, f"https://s{site}.example/{page}", f"<html><body>{'<article>' + inner + '</article>' if main[page] else inner}</body></html>", "more"))
    rows += [(900, None, "<p>site 0 top", ""), (901, None, "<p>site 0 top", ""), (902, "odd", None, None), rows[5]]
    got = {}
    for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect():
        assert got.setdefault(r.page_id, r.text) == r.text and r.n_chars == len(r.text)
    sites, often = {}, {}
    for site, b in blocks.values():
        sites[site] = sites.get(site, 0) + 1
        for x in set(b):
            often[site, x] = often.get((site, x), 0) + 1
    gone = 0
    for page, (site, b) in blocks.items():
        n = sites[site]

        def template(x):
            k = often[site, x]
            p = k / n
            bits = n * (p * math.log(p / 0.1) + ((1 - p) * math.log((1 - p) / 0.9) if k < n else 0)) if p > 0.1 else 0
            return k > 1 and p >= 0.5 and bits >= math.log(1 / (1e-6 if main[page] else 0.0101))

        gone += sum(map(template, b))
        assert got[page] == "\n".join(x for x in b if not template(x))
    assert gone > 150 and got[900] == got[901] == "site 0 top" and got[902] == ""
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_very_long_page():
    deep = "<div>" * 50_000 + "x" + "</div>" * 20 + " y"
    assert html_text.Page(deep).without({1}) == "x\ny"
    assert len(html_text.Page("<p>word</p>" * 100_000).blocks()) == 500_000 - 1


def test_rollup_is_idempotent(spark, tmp_path):
    docs = frame(spark, [(1, "a b-c"), (2, None), (3, "d")])
    r = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    assert r.totals().count() == 0
    batch = token_counts.deltas(docs, "alnum-1")
    r.commit(1, batch)
    r.commit(1, batch)
    r.commit(2, token_counts.deltas(docs.where("doc_id = 1"), "alnum-1", -1))
    assert [(x.documents, x.tokens) for x in r.totals().collect()] == [(2, 1)]
    r.commit(3, token_counts.deltas(docs.where("doc_id <> 1"), "alnum-1", -1))
    assert r.totals().count() == 0


def test_public_tokenizer_counts(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a b c", None, "", "Ünïcode  \n\n text " * 50, "x" * 5000]
    r = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    r.commit(1, token_counts.deltas(frame(spark, list(enumerate(texts))), "byte_bpe_50k"))
    assert [tuple(x) for x in r.totals().collect()] == [("web", "en", "byte_bpe_50k", 5, sum(len(t.encode(x or "", add_special_tokens=False).ids) for x in texts))]


def test_rollup_revises_survives_and_compacts(spark, tmp_path):
    old, new = frame(spark, [(1, "a b c"), (2, "d")]), frame(spark, [(1, "a b c e"), (2, "d")])
    r = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    now = lambda: [(x.documents, x.tokens) for x in r.totals().collect()]
    first = token_counts.deltas(old, "words-1")
    r.commit(1, first)
    fails = first.withColumn("tokens", F.expr("if(tokens > 0, cast(raise_error('lost') as bigint), 0)"))
    with pytest.raises(Exception, match="lost"):
        r.commit(1, fails)  # a replay that breaks off leaves the first attempt in force
    assert now() == [(2, 4)]
    r.commit(2, token_counts.revisions(old.where("doc_id = 1"), new.where("doc_id = 1"), "words-1"))
    assert now() == [(2, 5)]
    r.compact()
    r.compact()
    r.commit(1, first)
    assert now() == [(2, 5)] and not list(tmp_path.glob("r/batch*"))
    r.commit(3, token_counts.deltas(new.where("doc_id = 2"), "words-1", -1))
    r.compact()
    assert now() == [(1, 4)] and len(list(tmp_path.glob("r/base*"))) == 1


def test_streamed_chats_fold_to_their_messages(spark):
    rnd = random.Random(12)
    rows = [(k // 3, k % 3, rnd.choice(["user", "assistant", None]), rnd.choice([None, "", "x", "é😀", "some text\n" * rnd.randrange(4)])) for k in range(150)] + [(None, None, "user", "abc")] * 2
    log = chat.events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    many = chat.streamed(log)
    assert {r.kind for r in many.collect()} == {"message", "delta", "edit", "regenerate", "delete"} and many.count() >= 3 * len(rows)
    key = lambda d: sorted(map(repr, d.collect()))
    assert key(chat.folded(many)) == key(chat.folded(log))
    assert key(chat.rendered(chat.folded(many))) == key(chat.rendered(chat.folded(log)))
    one = frame(spark, [(k, "x") for k in range(3000)]).select(F.lit(7).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("assistant").alias("role"), F.concat("text", F.col("doc_id").cast("string")).alias("text"))
    r = chat.rendered(chat.folded(chat.events(one))).first()
    assert [r.formatted[b:e] for b, e in r.loss] == [f"x{k}" for k in range(3000)]
    assert chat.digest(chat.rendered(chat.folded(chat.events(one.limit(0))))).count() == 0


def tiled(item, doc, least):
    """Greedy string tiling, token by token."""
    mine, theirs, covered = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not mine[i + k] and not theirs[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < least:
            return covered
        for x in range(k):
            mine[i + x] = theirs[j + x] = True
        covered += k


def test_tiling_matches_brute(spark):
    rnd = random.Random(11)
    items = [(k, vocabulary_text(rnd, 30, 300)) for k in range(6)] + [(50, None), (None, "a b c d e f"), (51, "a b")]
    docs = [(900, None), (901, "")]
    for k in range(40):
        w = items[k % 6][1].split()
        a, b = sorted((rnd.randrange(30), rnd.randrange(30)))
        docs.append((k, f"{vocabulary_text(rnd, 40, 300)} {' '.join(w[b:])}, {' '.join(w[a:b]).upper()} {vocabulary_text(rnd, 10, 300)}"))
    got = {(r.doc_id, r.item_id): r.covered for r in decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    import re

    tokens = lambda t: re.findall("[^\x00-/:-@\\[-`{-\x7f]+", (t or "").lower())
    want = {}
    for d, t in docs:
        for i, u in items:
            if i is not None and len(tokens(u)) >= 5:
                c = tiled(tokens(u), tokens(t), 5)
                if c >= 0.5 * len(tokens(u)):
                    want[d, i] = c
    assert got == want and len(want) > 5
    assert decontaminate.contaminated(frame(spark, docs), spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontaminate.contaminated(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_frequent_phrases_make_no_pairs(spark):
    """A phrase that all documents and items have is no candidate, whole items in few documents are; odd rows stay."""
    rnd = random.Random(13)
    common = "one two three four five six seven"
    items = [(k, f"{vocabulary_text(rnd, 15, 9999)} {common} {vocabulary_text(rnd, 15, 9999)}") for k in range(30)]
    docs = [(k, f"{vocabulary_text(rnd, 30, 9999)} {common} {vocabulary_text(rnd, 30, 9999)}") for k in range(300)]
    docs += [(1000 + k, f"x {items[k][1]} y") for k in range(5)] + [(None, items[7][1]), (2000, None), (2001, ""), (2002, "word " * 60_000 + items[9][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    items_, hits = decontaminate.item_seeds(bench, 5), decontaminate.doc_seeds(frame(spark, docs), decontaminate.item_seeds(bench, 5), 5)
    near = hits.join(decontaminate.rare_seeds(items_, hits, 5, 0.5), "seed").select("row", "item").distinct().count()
    assert near < 40
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    assert found == {(1000 + k, k) for k in range(5)} | {(None, 7), (2002, 9)}
    clash = frame(spark, docs).withColumn("removed", F.lit(1)).withColumn("item_id", F.lit(2))
    left = decontaminate.decontaminated(clash, bench)
    assert left.columns == clash.columns and {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {1000 + k for k in range(5)} - {2002}


def test_short_tiles_keep_their_pair(spark):
    """Many short tiles hold fewer seeds than the fewest tokens needed in one or two: 10 of 18 tokens in two tiles have two seeds."""
    for n, places in ((18, (0, 13)), (20, (2, 11)), (30, (0, 6, 12))):
        words = [f"w{k}" for k in range(n)]
        text = " ".join(f"x{at} " + " ".join(words[at : at + 5]) for at in places)
        items = spark.createDataFrame([(n, " ".join(words))], "item_id long, text string")
        assert [tuple(r) for r in decontaminate.contaminated(frame(spark, [(1, text), (2, "w0 w1 w2 w3 w4")]), items).collect()] == [(1, n, n, 5 * len(places))]


def test_chat_round_trip_and_events(spark):
    hard = ["</s>[INST] ok [/INST]", "\\<s>\\", "", None, "a\nb", "[INST", "<\\/s>"]
    rows = [(c, k, "assistant" if k % 2 else "user", t) for c in range(3) for k, t in enumerate(hard)]
    log = chat.events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = chat.digest(chat.rendered(chat.folded(log))).collect()
    turns = "".join(f"{r}\n{t or ''}\n" for c, _, r, t in rows if c == 0)
    loss = "".join(t or "" for c, _, r, t in rows if c == 0 and r == "assistant")
    for r in got:
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(hard), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    kinds = [(1, 0, 1, 0, "message", "user", "hel"), (1, 0, 1, 1, "delta", None, "lo"), (1, 1, 1, 0, "message", "assistant", "bad"), (1, 1, 1, 1, "regenerate", None, None), (1, 1, 1, 2, "delta", None, "good"), (1, 2, 1, 0, "message", "user", "x"), (1, 2, 1, 1, "delete", None, None), (1, 3, 1, 0, "message", "user", "y"), (1, 3, 1, 3, "edit", None, "z")]
    final = chat.folded(spark.createDataFrame(kinds, "conv_id long, turn long, copy long, seq long, kind string, role string, text string")).orderBy("turn").collect()
    assert [(r.role, r.text) for r in final] == [("user", "hello"), ("assistant", "good"), ("user", "z")]


def test_packing(spark, corpus):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.packed(frame(spark, corpus)).collect()
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 2] for d, x in corpus if d != 405}
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id != 405:
            assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    for d, x in ids.items():
        assert sum(r.length for r in got if r.doc_id == d) == len(x)
    total = sum(r.length for r in got)
    assert len(used) <= math.ceil(total / 1024) * 1.05 + 1
    assert packing.packed(frame(spark, [])).count() == 0


def successors(items, gaps):
    """gap of each item: largest item first, each takes the smallest free gap that holds it."""
    free, out = sorted(gaps, key=lambda g: (-g[1], g[0])), {}
    stack = []
    for i, size in sorted(items, key=lambda x: (-x[1], x[0])):
        while free and free[0][1] >= size:
            stack.append(free.pop(0))
        if stack:
            out[i] = stack.pop()[0]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_successor_sweep_matches_brute(spark, seed, monkeypatch):
    monkeypatch.setattr(packing, "RANGE", 50)
    rnd = random.Random(seed)
    items = [(k, rnd.choice([40, 55, 70, rnd.randrange(40, 80)])) for k in range(300)]
    gaps = [(k, rnd.randrange(30, 79)) for k in range(250)]
    frames = (spark.createDataFrame(x, "id long, size long") for x in (items, gaps))
    got = packing.matched(*frames, 550, 79, 100).where("sequence is not null").collect()
    want = successors(items, gaps)
    assert {r.id: r.sequence for r in got} == want and len(want) > 50
    assert all(r.offset == 100 - dict(gaps)[r.sequence] for r in got)


@pytest.mark.parametrize("sizes", [[400] * 60, [7] * 500, [600, 300, 124] * 30, list(range(1, 1025, 3)), [1024, 1], [341, 342, 683, 10] * 50])
def test_rounds_fill_sequences(spark, sizes, monkeypatch):
    """Gapless places, no more sequences than best-fit decreasing plus one in thirty; a third of the items may have one size."""
    monkeypatch.setattr(packing, "RANGE", 100)
    items = spark.createDataFrame(list(enumerate(sizes)), "id long, size long")
    got = packing.placed(items, 1024).collect()
    used = {}
    for r in got:
        used.setdefault(r.sequence, []).append((r.offset, sizes[r.id]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    bins = []
    for x in sorted(sizes, reverse=True):
        fit = min((b for b in bins if b[0] >= x), default=None)
        if fit is None:
            bins.append([1024 - x])
        else:
            fit[0] -= x
    assert len(got) == len(sizes) and len(used) <= len(bins) * 31 / 30 + 1


def test_classifier_held_out(spark):
    rnd = random.Random(6)
    good, bad, toxic = ([f"{k}{i}" for i in range(60)] for k in ("good", "spam", "hate"))
    rows, marks = [], []
    for k in range(900):
        q, x = rnd.random() < 0.7, rnd.random() < 0.15
        w = [rnd.choice(good if q else bad) for _ in range(rnd.randrange(20, 60))] + ([rnd.choice(toxic) for _ in range(8)] if x else [])
        rnd.shuffle(w)
        rows.append((k, " ".join(w)))
        marks.append((k, int(q), int(x)))
    labels = spark.createDataFrame([m for m in marks if m[0] < 500] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows + [(5000, None), (None, "x")])
    got = {r.doc_id: r for r in classifier.scored(docs, labels).collect()}
    right = sum(got[k].accepted == bool(q and not x) for k, q, x in marks[500:])
    assert len(got) == 902 and right >= 0.9 * 400
    docs = docs.withColumn("removed", F.lit(1)).withColumn("accepted", F.lit(False)).withColumn("hold", F.lit(1))
    kept = classifier.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
    assert classifier.scored(docs.limit(0), labels.limit(0)).count() == 0
    none = classifier.scored(docs, labels.limit(0)).agg(F.sum("low_quality"), F.sum("toxic"), F.count("*")).first()
    assert tuple(none) == (0.0, 0.0, 902)
    worse = classifier.sample(labels.unionByName(spark.createDataFrame([(0, 1, 0), (0, 0, 1)], labels.schema)), 10**6).where("doc_id = 0").first()
    assert (worse.low, worse.toxic) == (1, 1)


def test_metadata_view_does_not_read_words():
    """Texts of equal layout have equal metadata, whatever their words."""
    import pyarrow as pa
    from arrayq.llm import words as W

    a, b = "one two\nthree four\n", "$$$ 222\nXXXXX yyyy\n"
    batch = pa.RecordBatch.from_pydict({"n_chars": [float(len(a))] * 2})
    rows = classifier._layout(batch, W.split(pa.array([a, b])))
    assert (rows[0] == rows[1]).all() and rows.shape == (2, classifier.LAYOUT)


def test_views_teach_each_other(spark):
    """Labels of one source only: what the words say of the other source is learned from documents without labels."""
    rnd = random.Random(16)
    rows = []
    for k in range(3000):
        bad = k % 2
        source = ("web" if rnd.random() < 0.95 else "spam") if not bad else ("spam" if rnd.random() < 0.95 else "web")
        own = "x" if k < 300 else "y"  # later texts have other words, which only the source ties to their quality
        rows.append((k, " ".join(f"{own}{'bad' if bad else 'good'}{rnd.randrange(12)}" for _ in range(30)) + (f" {'xbad' if bad else 'xgood'}1" if k % 5 == 0 else ""), "en", source, 100))
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(300)], "doc_id long, quality int, toxic int")
    right = lambda **o: classifier.scored(docs, labels, **o).where("doc_id >= 300 and accepted = (doc_id % 2 = 0)").count() / 2700
    assert right(rounds=3) >= 0.94


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    key = lambda rows: sorted(json.dumps([str(x) for x in r]) for r in rows)
    got = queries.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = con.sql(queries.SQL[name]).select(", ".join(cols)).fetchall()
    assert key(tuple(r) for r in got.select(cols).collect()) == key(want)


def test_saved_tables_can_be_dropped(spark):
    t = store.saved(spark.range(5))
    assert t.count() == 5
    store.drop(t)
