"""A quality classifier: a byte-level convolutional network in numpy.

A filter looks at a few bytes in a row. Each filter runs over every byte of a text, and its
largest answers are pooled in chunks that overlap by half and cover the whole text. A text's
features are, for each filter, the mean over its chunks and the largest of them, and a
logistic unit turns both into one probability.

A filter's answer is a sum of one table entry a byte, so no text is ever spread into one-hot
vectors. Training goes in rounds: each partition of a bounded sample of labelled texts takes
Adam steps from the same weights, and the driver averages the weights that come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chartweave.llm.common import remainder, slices, spread_rows, stage

#: Labelled texts of each class that are learnt from at most, those of the smallest hash of the id.
SAMPLE_PER_CLASS = 1_000
#: Bytes of a filter, filters, and bytes from one chunk to the next; a chunk is twice as long.
WIDTH, FILTERS, STEP = 6, 16, 128
#: Rounds, partitions that train at once, texts a step, rate of a step, weight decay.
ROUNDS, SHARDS, BATCH, RATE, DECAY = 8, 4, 16, 0.02, 1e-4
#: Blocks that are looked at in one go, and bytes of texts that are put together at most.
_BLOCKS, _TOGETHER = 32, 1 << 22


@dataclass
class Net:
    """``taps[k, byte, filter]``, ``bias[filter]``, ``mean`` and ``top`` (weights of the pooled answers) and ``constant``."""

    taps: object
    bias: object
    mean: object
    top: object
    constant: object

    def parts(self) -> list:
        return [self.taps, self.bias, self.mean, self.top, self.constant]


def fresh(seed: int = 5) -> Net:
    import numpy as np

    rng, f = np.random.default_rng(seed), np.float32
    return Net(rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(f), np.zeros(FILTERS, f), rng.normal(0, 0.1, FILTERS).astype(f), rng.normal(0, 0.1, FILTERS).astype(f), np.zeros(1, f))


def laid_out(texts: list[bytes]):
    """``(buffer, first block of each text)``: each text in whole blocks, behind ``WIDTH`` - 1 zeros.

    Filters that run over the end of a text see zeros: the rest of its block, then those before the next text.
    """
    import numpy as np

    blocks = [-(-(len(t) + WIDTH - 1) // STEP) for t in texts]
    first = np.concatenate(([0], np.cumsum(blocks)))
    buffer = np.zeros(int(first[-1]) * STEP + WIDTH, np.uint8)
    for t, at in zip(texts, first[:-1].tolist(), strict=True):
        at = at * STEP + WIDTH - 1
        buffer[at : at + len(t)] = np.frombuffer(t, np.uint8)
    return buffer, first


def answers(net: Net, buffer, where: bool = False):
    """Largest answer of each filter in each block, and if asked its place in the buffer."""
    import numpy as np

    n = (len(buffer) - WIDTH) // STEP
    best, place = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64) if where else None
    for i in range(0, n, _BLOCKS):
        j = min(n, i + _BLOCKS)
        size = (j - i) * STEP
        total = net.taps[0].take(buffer[i * STEP : i * STEP + size], axis=0)
        for k in range(1, WIDTH):
            total += net.taps[k].take(buffer[i * STEP + k : i * STEP + k + size], axis=0)
        total = total.reshape(j - i, STEP, FILTERS)
        if where:
            at = total.argmax(axis=1)
            best[i:j] = np.take_along_axis(total, at[:, None], axis=1)[:, 0]
            place[i:j] = at + (np.arange(i, j) * STEP)[:, None]
        else:
            best[i:j] = total.max(axis=1)
    return best, place


def pooled(net: Net, best, first):
    """Chunks of two blocks: ``(answers, block that gave it, first chunk of each text)``."""
    import numpy as np

    # A text of m blocks has m - 1 chunks, one of a single block has one.
    own = np.diff(first)
    chunks = np.maximum(own - 1, 1)
    start = np.concatenate(([0], np.cumsum(chunks)))
    left = np.repeat(first[:-1] - start[:-1], chunks) + np.arange(start[-1])
    right = left + np.repeat(own > 1, chunks)
    later = best[right] > best[left]
    return np.maximum(np.where(later, best[right], best[left]) + net.bias, 0), np.where(later, right[:, None], left[:, None]), start


def features(z, start):
    """Mean and largest answer of each filter over a text's chunks."""
    import numpy as np

    return np.add.reduceat(z, start[:-1], axis=0) / np.diff(start)[:, None], np.maximum.reduceat(z, start[:-1], axis=0)


def probabilities(net: Net, texts: list[bytes]):
    """One probability a text; texts are put together as long as they are short."""
    import numpy as np

    out, at = np.empty(len(texts)), 0
    while at < len(texts):
        n, size = 1, len(texts[at])
        while at + n < len(texts) and size + len(texts[at + n]) <= _TOGETHER:
            size += len(texts[at + n])
            n += 1
        if size > _TOGETHER:
            best = long_answers(net, texts[at])
            first = np.array([0, len(best)])
        else:
            buffer, first = laid_out(texts[at : at + n])
            best = answers(net, buffer)[0]
        z, _, start = pooled(net, best, first)
        mean, top = features(z, start)
        score = mean @ net.mean.astype(float) + top @ net.top.astype(float) + float(net.constant[0])
        out[at : at + n] = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        at += n
    return out


def long_answers(net: Net, text: bytes):
    """``answers`` of one text, some blocks after the others."""
    import numpy as np

    blocks, most = -(-(len(text) + WIDTH - 1) // STEP), _TOGETHER // STEP
    best = []
    for i in range(0, blocks, most):
        n = min(most, blocks - i)
        buffer, before = np.zeros(n * STEP + WIDTH, np.uint8), (WIDTH - 1) * (i == 0)
        at = max(i * STEP - WIDTH + 1, 0)
        piece = np.frombuffer(text[at : at + len(buffer) - before], np.uint8)
        buffer[before : before + len(piece)] = piece
        best.append(answers(net, buffer)[0])
    return np.concatenate(best)


def slopes(net: Net, texts: list[bytes], y, weight):
    """Gradient of the weighted log loss over some texts, a part for each part of the net."""
    import numpy as np

    buffer, first = laid_out(texts)
    best, place = answers(net, buffer, where=True)
    z, block, start = pooled(net, best, first)
    mean, top = features(z, start)
    p = 1 / (1 + np.exp(-np.clip(mean @ net.mean + top @ net.top + net.constant[0], -30, 30)))
    g = (weight * (p - y) / len(texts)).astype(np.float32)
    chunks = np.diff(start)
    of = np.repeat(np.arange(len(texts)), chunks)
    dz = np.repeat(g / chunks, chunks)[:, None] * net.mean
    # The largest chunk of a text and filter; of equal ones all share, as max does not tell them apart.
    peak = z == top[of]
    share = peak / np.add.reduceat(peak.astype(np.float32), start[:-1], axis=0)[of]
    dz = (dz + share * g[of][:, None] * net.top) * (z > 0)
    d_taps = np.zeros_like(net.taps)
    filters = np.broadcast_to(np.arange(FILTERS), block.shape)
    at = place[block, filters]
    for k in range(WIDTH):
        np.add.at(d_taps[k], (buffer[at + k], filters), dz)
    return [d_taps, dz.sum(0), g @ mean, g @ top, g.sum(keepdims=True)]


def train(net: Net, texts: list[bytes], y, weight, seed: int, rate: float) -> Net:
    """One pass of Adam steps over the texts in seeded order."""
    import numpy as np

    parts, rng = [p.copy() for p in net.parts()], np.random.default_rng(seed)
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    order = rng.permutation(len(texts))
    for t, i in enumerate(range(0, len(order), BATCH), 1):
        some = order[i : i + BATCH]
        for p, g, a, b in zip(parts, slopes(Net(*parts), [texts[j] for j in some], y[some], weight[some]), m, v, strict=True):
            g = g + DECAY * p
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return Net(*parts)


def training(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> tuple[DataFrame, dict]:
    """``(key, label, text, shard)`` of the labelled sample, and how many labelled rows each class has in all.

    Labels other than 0 and 1 and rows without id are left out; an id labelled twice counts
    as 1 if either says so, and one with several texts gives the smallest.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    totals = {r.label: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    some = lambda c: known.filter(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(per_class)
    # The hint is safe: at most two times per_class rows of an id and a class.
    chosen = F.broadcast(some(0).unionByName(some(1)))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(chosen, "id")
    one = texts.groupBy("id", "label").agg(F.min("text").alias("text"))
    key = F.xxhash64("id", F.lit(3))
    return stage(one.select(key.alias("key"), "label", "text", F.pmod(key, F.lit(SHARDS)).cast("int").alias("shard")), "quality-sample"), totals


def one_round(held, weight: dict, rate: float, seed: int):
    """What a shard does in a round: a pass over its texts, from the weights that all shards start with."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by([("key", "ascending"), ("text", "ascending")])
        y = table["label"].to_numpy().astype(np.float32)
        w = np.array([weight[int(c)] for c in y], np.float32)
        texts = [t.encode("utf-8", "surrogatepass") for t in table["text"].to_pylist()]
        out = train(Net(*held.value), texts, y, w, seed + table["shard"][0].as_py(), rate)
        flat = np.concatenate([p.ravel() for p in out.parts()]).astype(np.float32)
        return pa.table({"n": pa.array([len(texts)], pa.int64()), "net": pa.array([flat.tobytes()], pa.binary()), "shard": table["shard"].slice(0, 1)})

    return run


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS, rounds: int = ROUNDS) -> Net:
    """The net after some rounds over a sample of at most ``per_class`` texts of each class.

    Classes weigh as much as they have labelled rows, so that 0.5 is the likelier class.
    Without both classes every text scores the share of label 1, without any label 0.5.
    """
    import numpy as np

    sample, totals = training(docs, labels, id_col, text_col, label_col, per_class)
    size = {r.label: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    net = fresh()
    if len(size) < 2:
        empty = [np.zeros_like(p) for p in net.parts()]
        empty[4][0] = 20.0 if 1 in size else -20.0 if 0 in size else 0.0
        return Net(*empty)
    rows = sum(size.values())
    weight = {c: rows * totals[c] / sum(totals.values()) / size[c] for c in size}
    shapes = [p.shape for p in net.parts()]
    for r in range(rounds):
        held, rate, seed = sample.sparkSession.sparkContext.broadcast(astuple(net)), RATE * (1 - 0.9 * r / rounds), r * SHARDS

        found = sorted(sample.groupBy("shard").applyInArrow(one_round(held, weight, rate, seed), "n long, net binary, shard int").collect(), key=lambda x: x.shard)
        flat = np.average([np.frombuffer(x.net, np.float32) for x in found], axis=0, weights=[x["n"] for x in found]).astype(np.float32)
        ends = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        net = Net(*(p.reshape(s) for p, s in zip(np.split(flat, ends), shapes, strict=True)))
        held.unpersist()
    return net


def score_quality(docs: DataFrame, net: Net, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` of every row with ``score``, the probability of label 1.

    Null texts score like empty ones. Texts are read whole, in parts of 4 MB if they are
    longer; rows that repeat score alike, and an empty table gives no rows. Other columns of
    ``docs`` are not read; ``id_cols`` must not hold ``score`` or ``_text``.
    """
    held = docs.sparkSession.sparkContext.broadcast(astuple(net))

    def run(batches: Iterator):
        import pyarrow as pa

        model = Net(*held.value)
        for b in slices(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(probabilities(model, texts), pa.float64())], [*b.schema.names[:-1], "score"])

    schema = StructType([docs.schema[c] for c in id_cols]).add("score", "double")
    return spread_rows(docs.select(*id_cols, F.col(text_col).alias("_text"))).mapInArrow(run, schema)


def predict(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Learn from labels whose crc32(id) mod 3 is not 1; score every row by its text alone."""
    net = learn(docs, labels.filter(remainder(id_col, 3) != 1), id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (remainder(id_col, 3) == 1).alias("held_out"), F.col(text_col).alias("text"))
    return score_quality(rows, net, ["doc_id", "held_out"]).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
