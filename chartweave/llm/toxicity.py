"""Toxic passages by maximum-scoring segments of token log-odds.

A token's score is its log-odds between toxic and clean labelled texts under a Dirichlet
prior that follows the words' overall frequency, less a drift. Linear-time search finds all
maximal segments of a text. Segments of clean texts follow extreme-value statistics: a text
of n tokens has K*n*exp(-lambda*S) segments of score S or more by chance. That E-value says
which passages are significant; the best of them and the sum over all give a text's score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from chartweave.llm.common import remainder, slices, spread_rows, stage

#: Labelled rows of each class that are learnt from at most, those of the smallest hash of the id.
SAMPLE_PER_CLASS = 10_000
#: Words in the lexicon at most, those of the largest evidence.
LEXICON = 50_000
#: Weight of the prior in documents, least evidence (standard deviations) of a word, and cost of a token without evidence.
PRIOR, LEAST_Z, DRIFT = 200.0, 3.0, 0.15
#: A passage is significant up to this expected number by chance.
E_VALUE = 0.05
_WORD = r"[^\W\d_]+"
PASSAGES = ArrayType(StructType().add("start", "integer").add("end", "integer").add("score", "double").add("e_value", "double"))


@dataclass
class Model:
    """``lexicon``: word to score; ``lam`` and ``k``: the extreme-value law; ``fit``: constant and weights of the calibration."""

    lexicon: dict
    lam: float
    k: float
    fit: tuple


def segments(scores) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` of an array, in linear time.

    Each segment on the list remembers the last one before it whose left sum is smaller, so
    the search jumps back instead of walking.
    """
    import numpy as np

    good = scores > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
    total = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[list] = []  # start, end, left sum, right sum, link
    for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        new = [start, end, float(total[start]), float(total[end]), -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            new[4] = j
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new[0], new[2] = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, r - left) for s, e, left, r, _ in found]


def evidence(text: str | None, model: Model, with_text: bool = True):
    """``(x, y, passages)``: -log10 E of the best segment, their sum over significant ones, and the significant ones."""
    import re

    import numpy as np

    low = (text or "").lower()
    words = re.findall(_WORD, low)
    if not words or not model.lexicon:
        return 0.0, 0.0, []
    get = model.lexicon.get
    scores = np.fromiter((get(w, -DRIFT) for w in words), np.float64, len(words))
    if not (scores > 0).any():
        return 0.0, 0.0, []
    log_e = [(s, e, v, (math.log(model.k * len(words)) - model.lam * v) / math.log(10)) for s, e, v in segments(scores)]
    best = max(-x[3] for x in log_e)
    strong = [x for x in log_e if x[3] <= math.log10(E_VALUE)]
    passages = []
    if strong and with_text:
        at = [m.span() for m in re.finditer(_WORD, low)]
        passages = [(at[s][0], at[e - 1][1], v, 10.0**x) for s, e, v, x in strong]
    return min(max(best, 0.0), 60.0), min(sum(-x[3] for x in strong), 600.0), passages


def probability(x: float, y: float, model: Model) -> float:
    z = model.fit[0] + model.fit[1] * x + model.fit[2] * math.log1p(y)
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def training(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> tuple[DataFrame, dict]:
    """``(toxic, text)`` of the labelled sample, and how many labelled rows each class has in all."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    totals = {r.toxic: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    some = lambda c: known.filter(F.col("toxic") == c).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
    # The hint is safe: at most two times per_class rows of an id and a class.
    chosen = F.broadcast(some(0).unionByName(some(1)))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(chosen, "_id").select("toxic", "text")
    return stage(texts, "labelled", narrow=False), totals


def word_table(texts: DataFrame) -> DataFrame:
    """``(word, toxic, clean, n)``: texts of each class that have a word, and how often clean ones use it."""

    def run(batches: Iterator):
        import re
        from collections import Counter

        import pyarrow as pa

        held: tuple = (Counter(), Counter(), Counter())
        for b in slices(batches):
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = re.findall(_WORD, (text or "").lower())
                held[toxic].update(set(words))
                if not toxic:
                    held[2].update(words)
        names = list(held[0].keys() | held[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[w] for w in names], pa.int64()) for c in (held[1], held[0], held[2]))], ["word", "toxic", "clean", "n"])

    return texts.mapInArrow(run, "word string, toxic long, clean long, n long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("toxic", "clean", "n")))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """The model of a labelled sample; without both classes every text scores 0.

    Labels other than 0 and 1 and rows without id are left out; an id labelled twice counts
    as toxic if either says so.
    """
    import numpy as np

    texts, totals = training(docs, labels, id_col, text_col, label_col, per_class)
    size = {r.toxic: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return Model({}, 1.0, 1.0, (-700.0, 0.0, 0.0))
    n1, n0 = F.lit(float(size[1])), F.lit(float(size[0]))
    words = stage(word_table(texts), "words")
    prior = F.lit(PRIOR) * (F.col("toxic") + F.col("clean")) / (n1 + n0)
    a, b = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(a / (n1 + PRIOR - a)) - F.log(b / (n0 + PRIOR - b))
    scored = words.withColumn("odds", odds).withColumn("z", F.abs(odds) / F.sqrt(1 / a + 1 / b)).filter(F.col("z") >= LEAST_Z)
    rows = scored.orderBy(F.desc("z"), "word").limit(LEXICON).select("word", "odds", "n").collect()
    lexicon = {r.word: r.odds - DRIFT for r in rows}
    all_clean = max(words.agg(F.sum("n")).first()[0] or 1, 1)
    s, p = np.array([-DRIFT, *lexicon.values()]), np.array([0.0, *(r["n"] / all_clean for r in rows)])
    p[0] = max(1 - p.sum(), 0.0)
    lam = decay(s, p)
    model = Model(lexicon, lam, 1.0, (0.0, 0.0, 0.0))
    # With k at 1 the features are -log10 of n*exp(-lambda*S); the count of segments in clean texts then gives k.
    held = texts.sparkSession.sparkContext.broadcast(astuple(model))

    def measure(batches: Iterator):
        import re

        import pyarrow as pa

        m = Model(*held.value)
        for batch in slices(batches):
            out: list = [[], [], []]
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = re.findall(_WORD, (text or "").lower())
                v = np.fromiter((m.lexicon.get(x, -DRIFT) for x in w), np.float64, len(w))
                out[0].append(toxic)
                out[1].append(len(w))
                out[2].append([x[2] for x in segments(v)] if len(w) else [])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.float64()))], ["toxic", "n", "segments"])

    seen = texts.mapInArrow(measure, "toxic int, n long, segments array<double>").collect()
    chance = sum(math.exp(min(lam * x, 50.0)) > 1.5 for r in seen if not r.toxic for x in r.segments)
    model.k = (chance + 0.5) / max(sum(r.n for r in seen if not r.toxic), 1) * 1.5
    xs, ys, weight = [], [], []
    for r in seen:
        log_e = [(math.log(model.k * max(r.n, 1)) - lam * x) / math.log(10) for x in r.segments]
        best = min(max(max((-v for v in log_e), default=0.0), 0.0), 60.0)
        both = min(sum(-v for v in log_e if v <= math.log10(E_VALUE)), 600.0)
        xs.append((1.0, best, math.log1p(both)))
        ys.append(float(r.toxic))
        weight.append(totals.get(r.toxic, size[r.toxic]) / size[r.toxic])
    model.fit = logistic(np.array(xs), np.array(ys), np.array(weight))
    return model


def decay(scores, p) -> float:
    """The positive lambda at which the mean of exp(lambda * score) is 1, by bisection; 1 if there is none."""
    import numpy as np

    mean = lambda x: float((p * np.exp(np.minimum(x * scores, 500.0))).sum())
    if float((p * scores).sum()) >= 0 or not ((scores > 0) & (p > 0)).any():
        return 1.0
    low, high = 1e-6, 1.0
    while mean(high) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return high


def logistic(x, y, weight, ridge: float = 1e-2) -> tuple:
    """Weighted logistic regression by Newton steps, with a small ridge."""
    import numpy as np

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def score_toxicity(docs: DataFrame, model: Model, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` of every row with ``score`` (0 to 1), and ``passages``: the significant ones.

    Places are code points of the lower-cased text. Null and empty texts score like a text
    without a toxic word; texts are read whole.
    """
    held = docs.sparkSession.sparkContext.broadcast(astuple(model))

    def run(batches: Iterator):
        import pyarrow as pa

        m = Model(*held.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))
        for b in slices(batches):
            found = [evidence(t, m) for t in b.column(b.num_columns - 1).to_pylist()]
            spans = [[dict(zip(("start", "end", "score", "e_value"), p, strict=True)) for p in x[2]] for x in found]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([probability(x, y, m) for x, y, _ in found], pa.float64()), pa.array(spans, kind)], [*b.schema.names[:-1], "score", "passages"])

    schema = StructType([docs.schema[c] for c in id_cols]).add("score", "double").add("passages", PASSAGES)
    return spread_rows(docs.select(*id_cols, F.col(text_col).alias("_text"))).mapInArrow(run, schema)


def predict(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Learn from labels whose crc32(id) mod 5 is not 0; score every row by its text alone."""
    model = learn(docs, labels.filter(remainder(id_col, 5) != 0), id_col, text_col, label_col)
    rows = docs.select(id_col, (remainder(id_col, 5) == 0).alias("held_out"), F.col(text_col).alias("_t"))
    scored = score_toxicity(rows, model, [id_col, "held_out"], "_t")
    return scored.select(id_col, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
