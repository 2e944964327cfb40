"""Toxicity, neighbours, token counts, LM scores and page text against brute force or held-out truth."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartweave.llm import html_text, lm, neighbours, tokens, toxicity
from chartweave.llm.common import load
from tests.llm import brute
from tests.llm.test_first_five import odd

SF = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"


# --- toxicity

def brute_segments(scores):
    """Maximal segments by their definition: the best one, then those left and right of it."""
    def inside(a, b):
        best = max(((sum(scores[s:e]), -s, -e) for s in range(a, b) for e in range(s + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        s, e = -best[1], -best[2]
        return inside(a, s) + [(s, e)] + inside(e, b)

    return inside(0, len(scores))


def test_segments_match_their_definition():
    rng = np.random.default_rng(4)
    for _ in range(60):
        scores = rng.normal(-0.3, 1, rng.integers(1, 26))
        got = toxicity.segments(scores)
        assert sorted((s, e) for s, e, _ in got) == sorted(brute_segments(scores.tolist()))
        assert all(math.isclose(v, scores[s:e].sum(), abs_tol=1e-9) for s, e, v in got)


def test_toxicity_held_out(spark):
    docs, labels = load(spark, MID, "documents"), load(spark, MID, "labels")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.predict(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.held_out == (brute.remainder(r.doc_id, 5) == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    clean = [r for r in held if not truth[r.doc_id]]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert sum(r.predicted for r in held if truth[r.doc_id]) >= 0.5 * sum(truth[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_passages_show_the_words(spark):
    docs, labels = load(spark, MID, "documents"), load(spark, MID, "labels")
    model = toxicity.learn(docs, labels)
    bad = [w for w, s in model.lexicon.items() if s > 1][:2]
    text = "The of and " * 40 + bad[0].upper() + " the " + bad[1] + " of" * 50
    row = toxicity.score_toxicity(spark.createDataFrame([(1, text)], "doc_id long, t string"), model, ["doc_id"], "t").first()
    assert row.score > 0.5 and any(bad[0] in text[p.start : p.end].lower() for p in row.passages)


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0, 1), (2, None, None), (3, 1, 1), (3, 1, 0), (None, 1, 1), (4, 1, 7), (9, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.predict(odd(spark), labels).count() == 8
    assert {r.predicted for r in toxicity.predict(odd(spark), labels.limit(0)).collect()} == {0}
    assert toxicity.predict(odd(spark).limit(0), labels).count() == 0


# --- neighbours

def brute_nearest(rows, every=20, k=20):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and not any(x is None or not math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in ok:
        if q % every == 0:
            out[q] = sorted((-float(sum(x * y for x, y in zip(a, b))), i) for i, b in ok if i != q)[:k]
    return out


@pytest.fixture
def many_partitions(spark):
    """Small results stay in as many partitions as large ones would have."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_neighbours_recall_and_exact_scores(spark, many_partitions):
    table = load(spark, SF, "embeddings")
    want = brute_nearest([(r.vec_id, r.embedding) for r in table.collect()])
    got: dict = {}
    for r in neighbours.nearest(table).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    hits = sum(len({i for _, i in got[q]} & {i for _, i in best}) for q, best in want.items())
    assert set(got) == set(want) and hits >= 0.9 * 20 * len(want)
    assert all(v == sorted(v) and len(v) == 20 for v in got.values())
    exact = {(q, i): s for q, best in want.items() for s, i in best}
    assert all(math.isclose(s, exact[q, i], rel_tol=1e-12) for q, v in got.items() for s, i in v if (q, i) in exact)


def test_neighbours_of_copies_and_odd_vectors(spark, many_partitions):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(60)]
    rows += [(i, [1.0, 2.0, 0.5, -1.0]) for i in range(60, 160)]  # one vector, many copies
    rows += [(160, None), (180, [0.0] * 4), (200, [1.0, None, 1.0, 1.0]), (220, [float("nan"), 1.0, 1.0, 1.0]), (240, [float("inf"), 1.0, 1.0, 1.0]), (260, []), (None, [1.0] * 4)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, cls int")
    got: dict = {}
    for r in neighbours.nearest(df).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    want = brute_nearest([r for r in rows if r[0] is not None])
    assert {q: [v[k] for k in sorted(v)] for q, v in got.items()} == {q: [i for _, i in best] for q, best in want.items()}
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in neighbours.nearest(df.filter("vec_id in (0, 5)")).collect()] == [(0, 1, 5)]


def test_best_bin_first_visits_every_leaf():
    x = np.random.default_rng(3).normal(size=(700, 5))
    tree = neighbours.grow(x)
    leaves = [i for i, c in enumerate(tree.children) if c is None]
    assert sorted(tree.bins(x[0])) == sorted(leaves) and sum(len(tree.points[i]) for i in leaves) == 700
    assert 1 <= neighbours.calibrate(tree, x) <= len(leaves)


# --- token counts

def test_token_histogram(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(n) for a, n in map(bytes.split, open(tokens.TOKENIZER, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for docs in (load(spark, SF, "documents"), odd(spark)):
        rows = [(r.source, len(enc.encode_ordinary(r.text or ""))) for r in docs.collect()]
        sums = tokens.suffix_sums(tokens.length_histogram(tokens.token_counts(docs, ["source"]), ["source"]), ["source"]).collect()
        assert Counter({(r.source, r.n_tokens): r.n_docs for r in sums}) == Counter(rows)
        for r in sums:
            own = [n for s, n in rows if s == r.source]
            assert (r.docs_at_least, r.tokens_at_least) == (sum(n >= r.n_tokens for n in own), sum(n for n in own if n >= r.n_tokens))
            assert r.truncated_total == sum(min(n, r.n_tokens) for n in own) and math.isclose(r.share_up_to, sum(n <= r.n_tokens for n in own) / len(own))
    sums = tokens.suffix_sums(tokens.length_histogram(tokens.token_counts(load(spark, SF, "documents"), ["source"])))
    own = [n for _, n in [(r.source, len(enc.encode_ordinary(r.text or ""))) for r in load(spark, SF, "documents").collect()]]
    assert {r["limit"]: r.total for r in tokens.truncated_totals(sums, [1, 100, 3000, 10**6]).collect()} == {x: sum(min(n, x) for n in own) for x in (1, 100, 3000, 10**6)}
    assert {r.share: r.n_tokens for r in tokens.length_quantiles(sums, [0.5, 0.9, 1.0]).collect()} == {q: sorted(own)[math.ceil(q * len(own)) - 1] for q in (0.5, 0.9, 1.0)}
    assert tokens.suffix_sums(tokens.length_histogram(tokens.token_counts(odd(spark).limit(0), ["source"]), ["source"]), ["source"]).count() == 0


def test_long_white_space_does_not_stop_the_tokenizer():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(n) for a, n in map(bytes.split, open(tokens.TOKENIZER, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for white in (" ", "\n", "\u3000", " \n\t", "\x1c"):
        for after in ("", "a", " 1", "!x", " a" * 9, "\x85"):
            for before in ("", "ab", "x!", " "):
                text = before + white * 12_000 + after
                assert tokens.encoded_length(enc, text) == len(enc.encode_ordinary(text))
                assert tokens.encoded_length(enc, text + text) == len(enc.encode_ordinary(text + text))
    assert tokens.encoded_length(enc, "a" + " " * 2_000_000 + "b" + "\n" * 1_500_000) > 2


# --- LM scores

@pytest.mark.parametrize("frequent", [lm.FREQUENT, 50])
def test_lm_base_score(spark, monkeypatch, many_partitions, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    docs = load(spark, SF, "documents").select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    train = [t for i, t in rows if brute.remainder(i, 10) != 0]
    count = Counter(w for t in train for w in brute.text_words(t))
    total, distinct = sum(count.values()) + len(train), len(count) + 1
    base = lambda c: math.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
    want = sorted((str(i), len(brute.text_words(t)) + 1, sum(w in count for w in brute.text_words(t)) + 1, round(sum(base(count[w]) for w in brute.text_words(t)) + base(len(train)), 4)) for i, t in rows)
    got = lm.evaluate(docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert {r.train_tokens for r in got} == {total} and all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_lm_is_a_distribution_and_compresses(spark):
    docs = load(spark, MID, "documents")
    model, _ = lm.learn(docs.select(F.col("text").cast("binary").alias("raw")))
    for context in (b"of the", bytes(lm.DEPTH), b"\xff\xfe\xfd\xfc\xfb\xfa"):
        c = context[-lm.DEPTH :]
        codes = np.array([int.from_bytes(c + bytes([x]), "big") for x in range(256)], np.uint64)
        assert math.isclose((10.0 ** model.tree.byte_log10(codes)).sum(), 1.0, rel_tol=1e-5)
    held = [r for r in lm.evaluate(docs).collect() if r.held_out]
    assert sum(r.bits_per_byte for r in held) / len(held) < 2.5
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_weights_follow_their_definition():
    data = b"abracadabra abracadabra"
    framed = bytes(lm.DEPTH) + data
    counts = {n: Counter(framed[i - n + 1 : i + 1] for i in range(lm.DEPTH, len(framed))) for n in range(1, lm.DEPTH + 2)}
    tree = lm.weigh({n: (np.array([int.from_bytes(g, "big") for g in sorted(c)], np.int64), np.array([c[g] for g in sorted(c)], np.int64)) for n, c in counts.items()})

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def node(context, bit, prefix):
        a = b = 0
        for i in range(lm.DEPTH, len(framed)):
            if framed[i - len(context) : i] == context and framed[i] >> (8 - bit) == prefix:
                one = framed[i] >> (7 - bit) & 1
                a, b = a + 1 - one, b + one
        return a, b

    def weighted(context, bit, prefix):
        """(log weighted probability, chance of a 1 on the path to deeper contexts)."""
        a, b = node(context, bit, prefix)
        own = kt(a, b)
        if len(context) == lm.DEPTH:
            return own
        below = sum(weighted(bytes([x]) + context, bit, prefix) for x in {framed[i - len(context) - 1] for i in range(lm.DEPTH, len(framed)) if framed[i - len(context) : i] == context})
        return np.logaddexp(own, below) - math.log(2)

    context, byte, want = framed[5 : 5 + lm.DEPTH], framed[5 + lm.DEPTH], 0.0
    for bit in range(8):
        prefix, p = byte >> (8 - bit), 0.5
        for d in range(lm.DEPTH, -1, -1):
            c = context[lm.DEPTH - d :]
            a, b = node(c, bit, prefix)
            if not a + b:
                continue
            estimate = (b + 0.5) / (a + b + 1)
            if d == lm.DEPTH:
                p = estimate
            else:
                own = kt(a, b)
                below = sum(weighted(bytes([x]) + c, bit, prefix) for x in {framed[i - d - 1] for i in range(lm.DEPTH, len(framed)) if framed[i - d : i] == c})
                mine = 1 / (1 + math.exp(below - own))
                p = mine * estimate + (1 - mine) * p
        want += math.log10(p if byte >> (7 - bit) & 1 else 1 - p)
    got = tree.byte_log10(np.array([int.from_bytes(context + bytes([byte]), "big")], np.uint64))[0]
    assert math.isclose(got, want, rel_tol=1e-4)


def test_lm_scores_stay_finite_whatever_the_counts():
    # One byte 20 million times after the same context, and another once: both bits' chances must hold.
    framed = bytes(lm.DEPTH)
    grams = {n: {} for n in range(1, lm.DEPTH + 2)}
    for n in grams:
        grams[n] = {(framed + b"a")[-n:]: 2 * 10**7, (framed + b"b")[-n:]: 1}
    tree = lm.weigh({n: (np.array(sorted(int.from_bytes(g, "big") for g in c), np.int64), np.array([c[g] for g in sorted(c)], np.int64)) for n, c in grams.items()})
    got = tree.byte_log10(np.array([int.from_bytes(framed + bytes([x]), "big") for x in range(256)], np.uint64))
    assert np.isfinite(got).all() and math.isclose((10.0**got).sum(), 1.0, rel_tol=1e-5)
    assert got[ord("a")] > -1e-5 and got[ord("b")] > got[ord("z")]


def test_lm_odd_rows(spark):
    assert lm.evaluate(odd(spark)).count() == 8
    assert lm.evaluate(odd(spark).limit(0)).count() == 0
    none = lm.evaluate(odd(spark).filter("doc_id = 123456"))
    assert none.count() == 0


# --- page text

def test_pages_round_trip(spark):
    """The given pages hold their article between two tags that nothing else uses."""
    import html
    import re

    pages = load(spark, MID, "pages")
    got = {r.page_id: r for r in html_text.extract(pages, ["page_id", "url"]).collect()}
    for r in pages.collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = (" ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", body))
        assert got[r.page_id].text == "\n\n".join(x for x in parts if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("  ", ""), ("<p>", ""),
    ("<article><p>a &amp; b<br>c &lt;d&gt; &#233;</p><p>two</article><footer>no word of this is wanted at all here</footer>", "a & b c <d> é\n\ntwo"),
    ("<main><h1>T</h1><!-- <p>x</p> --><script>var a='</p><p>';</script><style>p{}</style><p>One <b>bold</b>\n text.</p></main><form><p>Your name and a long line of text in it</p></form>", "T\n\nOne bold text."),
    ("<article><p>First of all there is some text.</p><div class='comments'><p>I say that this is a very nice text indeed.</p></div></article>", "First of all there is some text."),
    ("<article><p>Unclosed <i>tags <p>go on</article></div></article><nav><a href=x>m</a></nav>", "Unclosed tags\n\ngo on"),
])
def test_small_pages(page, want):
    assert html_text.main_text(page, html_text.trained()) == want


@pytest.mark.parametrize("page,want", [
    ("<html><head><meta charset=utf-8><title>t</title><article><p>No end of the head was written here at all.</p></article>", "No end of the head was written here at all."),
    ("<article><p>Before it.</p><svg><path d=x><p>What follows an element that is never closed stays.</p></article>", "Before it.\n\nWhat follows an element that is never closed stays."),
    ("<article><p>One <button>press<p>Two words here<button>ok</button> and more.</p></article>", "One press\n\nTwo words here and more."),
    ("<article><p>Shown <svg><text>no</text></svg>text<svg/> of it.</p><div style='display:none'><p>Drop or cap nothing else.</p></div></article>", "Shown text of it.\n\nDrop or cap nothing else."),
    ("<article><p title='a > b'>Quotes hide the sign.</p><p>1 < 2 and <3 too</p></article>", "Quotes hide the sign.\n\n1 < 2 and <3 too"),
    ("<article><p>Text</p><script>var a = '<p>';", "Text"),
])
def test_markup_that_is_not_closed_loses_no_text(page, want):
    assert html_text.main_text(page, html_text.trained()) == want


@pytest.mark.parametrize("part", ["<a ", "<a \"'>", "<div class=x>", "<svg>", '<a x=">"', "<script>", "<!--", "<button>x", "<p>", "</div>", "<a x='<b y=\""])
def test_time_grows_with_the_page(part):
    import time

    tree, took = html_text.trained(), []
    for n in (100_000, 400_000):
        start = time.process_time()
        html_text.main_text(part * (n // len(part)), tree)
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 0.5


def test_pages_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, 1), (None, "u", "<p>x</p>", 1), (1, "u", "<article>" + "<p>word" * 50_000, 2), (1, "u", "<div " * 20_000, 2)], "page_id long, url string, html string, _html int")
    rows = html_text.extract(df, ["page_id", "url"]).collect()
    assert len(rows) == 4 and {r.n_chars for r in rows} >= {0, 50_000 * 4 + 49_999 * 2}
    assert html_text.extract(df.limit(0), ["page_id"]).count() == 0


def test_hand_labelled_pages_are_mostly_right():
    tree, right, n = html_text.trained(), 0, 0
    for page in html_text.BY_HAND:
        found = html_text.blocks(page, marked=True)
        right += sum((html_text.share_of(tree, row) >= 0.5) == b["y"] for b, row in zip(found, html_text.features(found), strict=True))
        n += len(found)
    assert right / n > 0.95


def test_tree_nodes_are_followed_not_searched_for(monkeypatch):
    # Each bit of a rare gram was searched for at each depth among all nodes: most of the time of scoring.
    rng = np.random.default_rng(3)
    counted = {}
    for length in range(1, lm.DEPTH + 2):
        codes, n = np.unique(rng.integers(97, 101, (4000, length)) @ (256 ** np.arange(length)[::-1]), return_counts=True)
        some = rng.random(len(codes)) < 0.6  # so some contexts are kept without shorter ones
        counted[length] = (codes[some], n[some])
    tree = lm.weigh(counted)
    seen = rng.integers(96, 103, (500, lm.DEPTH + 1)) @ (256 ** np.arange(lm.DEPTH + 1)[::-1])
    tree.links()
    searches, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *a, **k: searches.append(1) or search(*a, **k))
    got = tree.byte_log10(seen.astype(np.uint64))
    assert len(searches) <= lm.DEPTH + 1
    nodes = [dict(zip(k.tolist(), zip(x, w), strict=True)) for k, x, w in zip(tree.keys, tree.less, tree.own, strict=True)]
    for code, value in zip(seen.tolist(), got, strict=True):
        total = 0.0
        for bit in range(8):
            prefix, one, p = (1 << bit) | ((code & 0xFF) >> (8 - bit)), (code & 0xFF) >> (7 - bit) & 1, 0.5
            for d in range(lm.DEPTH, -1, -1):
                less, own = nodes[d].get((((code >> 8) & ((1 << 8 * d) - 1)) << 8) | prefix, (None, None))
                if less is not None:
                    chance = less * np.float32(2 * one - 1)
                    p = own * (chance + np.float32(chance < 0)) + (1 - own) * p
            total += np.log10(p)
        assert abs(total - value) < 1e-5
    empty = lm.weigh({})
    assert np.allclose(empty.byte_log10(seen.astype(np.uint64)), 8 * np.log10(0.5))


def test_no_gram_is_left_out_of_the_tree(spark, monkeypatch, many_partitions):
    # The tree held the grams seen most only; next bytes of all others counted as never seen.
    docs = load(spark, SF, "documents").select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    codes_of = lambda t: lm.grams(np.frombuffer(lm.framed(None if t is None else t.encode()), np.uint8)).astype(np.int64)
    seen = np.concatenate([codes_of(t) for i, t in rows if brute.remainder(i, 10) != 0])
    tree = lm.weigh({n: np.unique(seen & ((1 << 8 * n) - 1), return_counts=True) for n in range(1, lm.DEPTH + 2)})
    want = sorted((str(i), tree.byte_log10(codes_of(t)).sum()) for i, t in rows)
    for limit, held in ((2000, lm.HELD if hasattr(lm, "HELD") else 0), (0, 500)):
        for name in ("MAX_GRAMS", "FREQUENT_GRAMS"):
            monkeypatch.setattr(lm, name, limit, raising=False)
        monkeypatch.setattr(lm, "HELD", held, raising=False)
        got = sorted((str(r.doc_id), r.score) for r in lm.evaluate(docs).collect())
        assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], rtol=1e-5, atol=1e-4)
