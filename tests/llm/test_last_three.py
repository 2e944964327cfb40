"""Fill-in-middle, source divergence and the quality network against brute force or held-out truth."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartweave.llm import divergence, fim, quality_net
from chartweave.llm.common import load
from chartweave.llm.queries import QUERIES, SQL
from tests.llm import brute
from tests.llm.test_first_five import odd
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"
NAMES = ("op11_fill_in_middle", "op12_source_divergence")


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    ok, n, _, note = compare(spark, duck(SF), name, QUERIES[name], SQL[name], SF)
    assert ok and n > 0, note


# --- fill-in-middle

def brute_fim(i, text, rules=fim.Rules()):
    t = text or ""
    parts = {"line": re.findall(r"[^\n]*\n|[^\n]+", t), "word": re.findall(r"[\t-\r ]*[^\t-\r ]+[\t-\r ]*|[\t-\r ]+", t), "character": list(t)}[rules.unit]
    if rules.unit == "word" and parts:
        parts = re.findall(r"^[\t-\r ]+(?=[^\t-\r ])|[^\t-\r ]+[\t-\r ]*|^[\t-\r ]+$", t)
        assert "".join(parts) == t
    digest = hashlib.sha256(f"{rules.seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(parts)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(parts[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not t or any(x in t for x in rules.sentinels) or h[2] % 100 >= rules.rate:
        return n, "plain", None, None, t
    x, y, z = rules.sentinels
    if h[3] % 100 < rules.spm:
        return n, "spm", len(p), len(p) + len(m), y + s + x + p + z + m
    return n, "psm", len(p), len(p) + len(m), x + p + y + s + z + m


@pytest.mark.parametrize("rules", [fim.Rules(), fim.Rules(unit="word", rate=60), fim.Rules(unit="character", spm=0, seed=3, sentinels=("[pre]", "[suf]", "[mid]"))])
def test_fim_matches_brute_force_and_goes_back(spark, rules):
    more = [(50, "a<P>b\nc"), (51, "\n\n\n"), (52, "\n" * 200_000), (53, "é😀\n" * 70_000 + "end"), (54, " x"), (55, "no line end"), (56, "x\r\ny\n")]
    docs = load(spark, SF, "documents").select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text")).unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = fim.transform(docs, rules).withColumn("back", fim.restored(F.col("fim_text"), F.col("fim_form"), rules)).collect()
    want = Counter((r.doc_id, *brute_fim(r.doc_id, r.text, rules)) for r in docs.collect())
    assert Counter((r.doc_id, r.fim_n, r.fim_form, r.fim_prefix_end, r.fim_middle_end, r.fim_text) for r in rows) == want
    assert all(r.back == (r.text or "") for r in rows)
    assert {r.fim_form for r in rows} >= ({"plain", "psm"} if rules.spm == 0 else {"plain", "psm", "spm"})


def test_borders_use_all_kinds_of_containers():
    rng = np.random.default_rng(8)
    sets = {
        "array": np.unique(rng.integers(0, 1 << 16, 500)), "bitmap": np.unique(rng.integers(0, 1 << 16, 30_000)), "run": np.arange(5, 40_000),
        "many": np.unique(np.concatenate((rng.integers(0, 1 << 20, 9000), np.arange(1 << 17, (1 << 17) + 70_000), (1 << 19) + rng.integers(0, 1 << 16, 20_000)))),
    }
    for kind, members in sets.items():
        s = fim.Borders(members)
        assert len(s) == len(members) and (kind == "many" or s.kinds() == [kind])
        assert [s.select(k) for k in range(0, len(members), 7)] == members[::7].tolist()
    assert set(fim.Borders(sets["many"]).kinds()) == {"array", "bitmap", "run"}
    assert len(fim.Borders(np.zeros(0, np.int64))) == 0
    with pytest.raises(IndexError):
        fim.Borders(sets["run"]).select(len(sets["run"]))


def test_fim_keeps_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\n", "x", 2, 3, 4, "old")], "doc_id long, text string, row string, n int, h1 int, a int, fim_text string")
    out = fim.transform(docs)
    r = out.first()
    assert out.columns == ["doc_id", "text", "row", "n", "h1", "a", "fim_n", "fim_form", "fim_prefix_end", "fim_middle_end", "fim_text"]
    assert (r.row, r["n"], r.h1, r.a, r.fim_n) == ("x", 2, 3, 4, 3) and r.fim_text == brute_fim(1, "a\nb\nc\n")[4]
    assert fim.transform(docs.limit(0)).count() == 0 and fim.fim_digest(docs.limit(0)).count() == 0


# --- source divergence

def brute_divergence(rows, least=3, top=200):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", brute.ascii_lower(t))
    seen, count, groups = Counter(), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, w = lang or "", source or "", terms(text)
        groups.add((lang, source))
        count[lang, source].update(w)
        seen.update((lang, x) for x in set(w))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (g, t), n in seen.items() if g == lang and n >= least)
        own = {s: count[g, s] for g, s in groups if g == lang}
        whole = Counter()
        for c in own.values():
            whole.update(c)
        v = len(kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + v) for t in kept}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in own.items()}, share(whole)
        for s in own:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in own if o != s]
            words = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", words, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("held,pairs,top", [(divergence.HELD, divergence.PAIRS, 200), (40, 30, 5)])
def test_divergence_matches_brute_force(spark, monkeypatch, held, pairs, top):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    docs = load(spark, SF, "documents").select("text", "lang", "source").unionByName(odd(spark).select("text", "lang", "source"))
    more = [("one two", "xx", "a"), ("one three", "xx", "b"), ("one ÄÖ ÄÖ", "xx", "c"), (None, "xx", "d"), ("", "yy", "a"), ("alone", "yy", None), ("é à é", "", ""), ("é", None, None), ("é 7é", "", "s")]
    docs = docs.unionByName(spark.createDataFrame(more, "text string, lang string, source string"))
    got = divergence.divergences(docs, top=top).collect()
    assert sorted(tuple(r) for r in got) == brute_divergence([(r.lang, r.source, r.text) for r in docs.collect()], top=top)


def test_divergence_of_very_large_counts_and_no_rows(spark):
    size = np.array([3 * 10**10, 7, 5], np.int64)
    at, count, lengths = np.array([0, 2, 1]), np.array([2 * 10**10, 1, 2]), np.array([2, 1])
    total = defaultdict(int)
    for keys, values in divergence.changes(at, count, lengths, size):
        for k, x in zip(keys.tolist(), values.tolist()):
            total[k] += x
    p = lambda c, s: 1 + 10**9 * (c + 1) // s
    table = [[2 * 10**10, 0, 1], [0, 2, 0]]
    d = lambda x, y: (x - y) ** 2 // y
    for a in range(3):
        for b in range(3):
            if a != b:
                base = 2 * d(p(0, int(size[a])), p(0, int(size[b])))
                assert base + total[a * 3 + b] == sum(d(p(t[a], int(size[a])), p(t[b], int(size[b]))) for t in table)
    wide = spark.createDataFrame([(2 * 10**10, 3 * 10**10)], "c long, s long").select(divergence.smoothed("c", "s").alias("x")).first().x
    assert wide == p(2 * 10**10, 3 * 10**10)
    assert divergence.divergences(odd(spark).limit(0)).count() == 0


# --- quality network

def slow_score(net, t):
    """The network by its definition, byte by byte."""
    blocks = -(-(len(t) + quality_net.WIDTH - 1) // quality_net.STEP)
    padded = bytes(quality_net.WIDTH - 1) + t + bytes((blocks + 1) * quality_net.STEP)
    conv = np.array([sum(net.taps[k, padded[i + k]] for k in range(quality_net.WIDTH)) for i in range(blocks * quality_net.STEP)])
    step = quality_net.STEP
    chunks = [conv[i * step : (i + 2) * step] for i in range(max(blocks - 1, 1))]
    z = np.array([np.maximum(c.max(axis=0) + net.bias, 0) for c in chunks])
    return 1 / (1 + np.exp(-(z.mean(0) @ net.mean + z.max(0) @ net.top + net.constant[0])))


def test_network_matches_its_definition(monkeypatch):
    net = quality_net.fresh(3)
    net.bias += 0.1
    texts = [b"", b"a", b"x" * 123, b"x" * 124, bytes(range(256)) * 3, b"the quick brown fox " * 40]
    want = [slow_score(net, t) for t in texts]
    assert np.allclose(quality_net.probabilities(net, texts), want, atol=1e-5)
    monkeypatch.setattr(quality_net, "_TOGETHER", quality_net.STEP * 2)
    assert np.allclose(quality_net.probabilities(net, texts), want, atol=1e-5)


def test_slopes_match_differences():
    net = quality_net.fresh(4)
    net = quality_net.Net(*(p.astype(np.float64) for p in net.parts()))
    net.bias += 0.05
    texts, y, w = [b"good text here", b"BAD!! TEXT!! " * 30], np.array([1.0, 0.0]), np.array([1.0, 0.5])

    def loss(n):
        p = np.array([slow_score(n, t) for t in texts])
        return float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())

    slopes = quality_net.slopes(net, texts, y, w)
    rng = np.random.default_rng(1)
    for part, g in zip(net.parts(), slopes, strict=True):
        for _ in range(4):
            i = tuple(rng.integers(0, s) for s in part.shape) if part.ndim < 3 else (rng.integers(0, 6), b"BAD!! "[rng.integers(0, 6)], rng.integers(0, quality_net.FILTERS))
            old = part[i]
            part[i] = old + 1e-4
            up = loss(net)
            part[i] = old - 1e-4
            down = loss(net)
            part[i] = old
            assert abs((up - down) / 2e-4 - g[i]) < 2e-3 * max(1, abs(g[i])) + 1e-4


def test_quality_held_out(spark):
    docs, labels = load(spark, "/root/testdata/sf0.1", "documents"), load(spark, "/root/testdata/sf0.1", "labels")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality_net.predict(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.held_out == (brute.remainder(r.doc_id, 3) == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    good, low = [r for r in held if truth[r.doc_id]], [r for r in held if not truth[r.doc_id]]
    assert sum(r.predicted for r in good) >= 0.99 * len(good) and sum(not r.predicted for r in low) >= 0.9 * len(low)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0, 1), (2, None, None), (3, 1, 1), (3, 1, 0), (None, 1, 1), (4, 7, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_net.predict(odd(spark), labels).count() == 8
    assert {r.score for r in quality_net.predict(odd(spark), labels.limit(0)).collect()} == {0.5}
    assert quality_net.predict(odd(spark).limit(0), labels).count() == 0
    one = quality_net.predict(odd(spark), spark.createDataFrame([(3, 1), (5, 1)], "doc_id long, quality int"))
    assert {r.predicted for r in one.collect()} == {1}
