"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary choices, each with a context tree of its own over the bytes before
it. Every node has a Krichevsky-Trofimov estimate from its counts; going up from the deepest
context, a node mixes its own estimate with that of its children by the weight of evidence
of each. The counts come from all training texts, and the tree holds every context of them:
it is a table of grams, dealt by the two bytes nearest to the one that comes, whose subtrees
are weighed where they lie. Only what joins them, contexts of a byte and of none, is one
small tree. Scores of frequent grams are looked up in a table of fixed size, those of all
others by a join; once trained the model doesn't change while texts are scored.

Beside it stands a unigram score with additive smoothing over all words of the training
texts, looked up in the same two ways.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.llm.common import byte_table, remainder, slices, spread_rows, stage

#: Bytes of the longest context.
DEPTH = 5
#: Bytes of context by which subtrees are dealt.
NEAR = 2
#: Words whose counts, and grams (context and next byte) whose scores, every executor holds.
FREQUENT, FREQUENT_GRAMS = 200_000, 1_000_000
#: Different grams that a worker counts, and of whole subtrees that it weighs, at once.
HELD = 1 << 20
ALPHA = 0.1
#: Different words that a worker counts at once, and that it remembers the place of.
COUNTED, MEMO = 400_000, 200_000
#: Bytes that are worked on at once.
CHUNK = 1 << 19
_TEXT = byte_table("text")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Slots of the table of byte scores, as a power of two.
SLOTS = 21
END = 0


def framed(raw: bytes | None) -> bytes:
    """A text as the model reads it: A-Z in lower case, zeros as first context, and an end byte."""
    return bytes(DEPTH) + (raw or b"").translate(_LOWER) + bytes([END])


def grams(buffer, depth: int = DEPTH):
    """Codes of all runs of ``depth + 1`` bytes in an array of bytes, first byte highest."""
    import numpy as np

    out = np.zeros(max(len(buffer) - depth, 0), np.uint64)
    for i in range(depth + 1):
        out <<= np.uint64(8)
        out |= buffer[i : len(buffer) - depth + i]
    return out


def gather(texts: DataFrame) -> DataFrame:
    """``(kind, key, n)``: counts of words (kind 0, key a hash) and of grams of ``DEPTH + 1`` bytes (kind 1), of all texts in column ``raw``."""

    def run(batches: Iterator):
        from collections import Counter

        import numpy as np
        import pyarrow as pa
        import xxhash

        def rows(kind, keys, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)], ["kind", "key", "n"])

        def words_of(held):
            keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in held), np.uint64, len(held)).view(np.int64)
            return rows(0, keys, np.fromiter(held.values(), np.int64, len(held)))

        def fold(parts):
            code, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return code, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

        def counted(part):
            code, n = np.unique(np.concatenate(part), return_counts=True)
            return code, n.astype(np.int64)

        words, seen, part, size = Counter(), [], [], 0
        for b in slices(batches):
            for raw in b.column(0).to_pylist():
                words.update((raw or b"").translate(_TEXT).split())
                codes = grams(np.frombuffer(framed(raw), np.uint8))
                for at in range(0, len(codes), CHUNK):
                    part.append(codes[at : at + CHUNK])
                    size += len(part[-1])
                    if size >= CHUNK:
                        seen, part, size = [*seen, counted(part)], [], 0
                if len(seen) > 8:
                    seen = [fold(seen)]
                    if len(seen[0][0]) > HELD:
                        yield rows(1, seen[0][0].astype(np.int64), seen[0][1])
                        seen = []
                if len(words) > COUNTED:
                    yield words_of(words)
                    words = Counter()
        if words:
            yield words_of(words)
        if part:
            seen.append(counted(part))
        if seen:
            code, n = fold(seen)
            yield rows(1, code.astype(np.int64), n)

    return spread_rows(texts.select("raw")).mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class Tree:
    """Nodes of each depth: sorted ``keys`` (context and bit prefix), ``less`` and weight of the own estimate.

    ``less`` is the estimate of a one, or less than 0 the negative of that of a zero, whichever
    is smaller: so neither is lost beside the other, however often a node was seen.
    """

    keys: list
    less: list
    own: list
    _links: list | None = None
    #: Keys, log of the weighted probability and counts of the nodes of the least depth that was weighed.
    ends: tuple | None = None

    def links(self):
        """Of each depth: its contexts, the node of each before the first bit, and the nodes that follow a zero and a one (-1: none)."""
        import numpy as np

        if self._links is None:
            self._links = []
            for keys in self.keys:
                roots = np.flatnonzero((keys & 0xFF) == 1).astype(np.int32)
                after = np.full((2, len(keys)), -1, np.int32)
                inner = np.flatnonzero((keys & 0xFF) < 128)
                for bit in (0, 1):
                    key = keys[inner] + (keys[inner] & 0xFF) + bit  # one more bit doubles the prefix
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    after[bit, inner] = np.where(keys[at] == key, at, -1)
                self._links.append((keys[roots] >> 8, roots, after))
        return self._links

    def byte_log10(self, codes):
        """log10 probability of the last byte of each gram given the bytes before it."""
        import numpy as np

        total = np.zeros(len(codes))
        codes = codes.astype(np.int64)
        byte = codes & 0xFF
        # The grams whose context each depth holds, and their nodes there; from bit to bit these are followed by links.
        rows_at, links = [], self.links()
        for d, (contexts, roots, _) in enumerate(links):
            context = (codes >> 8) & ((1 << 8 * d) - 1)
            at = np.minimum(np.searchsorted(contexts, context), max(len(contexts) - 1, 0))
            rows = np.flatnonzero(contexts[at] == context) if len(contexts) else np.zeros(0, np.int64)
            rows_at.append((rows, roots[at[rows]]))
        for bit in range(8):
            one = (byte >> (7 - bit)) & 1  # the bit that comes
            p, sign = np.full(len(codes), 0.5), (2 * one - 1).astype(np.float32)
            # From the deepest context up: a node without counts passes an even chance on.
            for d in range(DEPTH, -1, -1):
                rows, at = rows_at[d]
                if not len(rows):
                    continue
                own = self.own[d][at]
                # For a zero the sign turns: what is then below 0 is the chance of the other bit.
                chance = self.less[d][at] * sign[rows]
                chance += chance < 0
                p[rows] = own * chance + (1 - own) * p[rows]
                at = links[d][2][one[rows], at]
                rows_at[d] = rows[at >= 0], at[at >= 0]
            total += np.log10(p)
        return total


def shorter(codes, counts, length: int):
    """Counts of the grams of ``length`` bytes that end where longer ones do."""
    import numpy as np

    short, at = np.unique(codes & ((1 << 8 * length) - 1), return_inverse=True)
    return short, np.bincount(at, weights=counts, minlength=len(short)).astype(np.int64)


def weigh(grams_by_length: dict, deepest: int = DEPTH, least: int = 0, below: tuple | None = None) -> Tree:
    """The weighted tree of gram counts ``{length: (codes, counts)}``, length 1 to ``DEPTH + 1``.

    Depths from ``deepest`` to ``least`` only, if they are given; ``below`` are the ``ends`` of
    the tree under them.
    """
    import numpy as np
    from math import lgamma

    half = np.array([lgamma(x + 0.5) for x in range(4096)])
    whole = np.array([lgamma(x + 1.0) for x in range(8192)])

    def log_gamma(x, table, shift):
        big = x >= len(table)
        out = table[np.where(big, 0, x)]
        y = x[big] + shift
        out[big] = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y)
        return out

    tree = Tree([np.zeros(0, np.int64)] * (DEPTH + 1), [np.zeros(0, np.float32)] * (DEPTH + 1), [np.zeros(0, np.float32)] * (DEPTH + 1))
    for d in range(deepest, least - 1, -1):
        code, n = grams_by_length.get(d + 1, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        code, n = np.asarray(code, np.int64), np.asarray(n, np.int64)
        byte, context = code & 0xFF, code >> 8
        bits = np.arange(8)
        key = ((context[:, None] << 8) | (1 << bits)[None, :] | (byte[:, None] >> (8 - bits)[None, :])).ravel()
        one = ((byte[:, None] >> (7 - bits)[None, :]) & 1).ravel().astype(bool)
        keys, at = np.unique(key, return_inverse=True)
        weight = np.repeat(n, 8)
        a = np.bincount(at[~one], weights=weight[~one], minlength=len(keys)).astype(np.int64)
        b = np.bincount(at[one], weights=weight[one], minlength=len(keys)).astype(np.int64)
        estimate = log_gamma(a, half, 0.5) + log_gamma(b, half, 0.5) - log_gamma(a + b, whole, 1.0) - np.log(np.pi)
        own = np.ones(len(keys))
        weighted = estimate
        if below is not None and len(keys):
            # A child's key has one more context byte above; without it, it is its parent's key.
            child = np.zeros(len(keys))
            up = ((below[0] >> 8) & ((1 << 8 * d) - 1)) << 8 | (below[0] & 0xFF)
            to = np.minimum(np.searchsorted(keys, up), len(keys) - 1)
            ok = keys[to] == up
            np.add.at(child, to[ok], below[1][ok])
            has = np.zeros(len(keys), bool)
            has[to[ok]] = True
            # Counts that no kept child has are coded by the node itself, at its own rate.
            kept = np.zeros(len(keys))
            np.add.at(kept, to[ok], below[2][ok])
            child = child + estimate * (1 - np.minimum(kept / np.maximum(a + b, 1), 1))
            own = np.where(has, 1 / (1 + np.exp(np.clip(child - estimate, -500, 500))), 1.0)
            weighted = np.where(has, np.logaddexp(estimate, child) - np.log(2), estimate)
        one, zero = (b + 0.5) / (a + b + 1.0), (a + 0.5) / (a + b + 1.0)
        tree.keys[d], tree.less[d], tree.own[d] = keys, np.where(one > 0.5, -zero, one).astype(np.float32), own.astype(np.float32)
        below = (keys, weighted, (a + b).astype(np.float64))
    tree.ends = below
    return tree


def in_subtrees(rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    """What ``work(codes, counts)`` gives for runs of ``rows`` (key, n) that hold whole subtrees.

    Rows are dealt by the ``NEAR`` bytes before the one that comes. A run has some ``HELD`` rows,
    or those of one subtree.
    """

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        def done(held):
            out = work(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)

        held, size = [], 0
        for b in batches:
            near, code, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(code):
                continue
            if size >= HELD:
                cut = int(np.searchsorted(near, last, "right"))
                held.append((code[:cut], n[:cut]))
                code, n, near = code[cut:], n[cut:], near[cut:]
                if not len(code):
                    continue
                yield done(held)
                held, size = [], 0
            held.append((code, n))
            size, last = size + len(code), near[-1]
        if held:
            yield done(held)

    names = [c.split()[0] for c in schema.split(", ")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * NEAR) - 1)).cast("int")
    return rows.select(near.alias("near"), "key", "n").repartition(parts, "near").sortWithinPartitions("near").mapInArrow(run, schema)


def subtrees(codes, counts) -> Tree:
    """The weighted tree of whole grams, from ``NEAR`` bytes of context on."""
    return weigh({length: shorter(codes, counts, length) for length in range(NEAR + 1, DEPTH + 2)}, least=NEAR)


def top_tree(grams: DataFrame) -> Tree:
    """The tree of fewer than ``NEAR`` bytes of context over all subtrees; it has 65,535 nodes at most."""
    import numpy as np

    def ends(codes, counts):
        key, weighted, n = subtrees(codes, counts).ends
        up = ((key >> 8) & ((1 << 8 * (NEAR - 1)) - 1)) << 8 | (key & 0xFF)
        keys, at = np.unique(up, return_inverse=True)
        return keys, np.bincount(at, weights=weighted, minlength=len(keys)), np.bincount(at, weights=n, minlength=len(keys))

    below = in_subtrees(grams, ends, "key long, weighted double, n double").groupBy("key").agg(F.sum("weighted").alias("weighted"), F.sum("n").alias("n")).orderBy("key").toArrow()
    short = grams.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * NEAR) - 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    codes, counts = short["key"].to_numpy(), short["n"].to_numpy()
    return weigh({length: shorter(codes, counts, length) for length in range(1, NEAR + 1)}, NEAR - 1, 0, tuple(below[c].to_numpy() for c in ("key", "weighted", "n")))


def gram_values(grams: DataFrame, asked: DataFrame, top: Tree) -> DataFrame:
    """``(key, value)``: log10 probability of the last byte of each of the distinct grams ``asked`` (key), by the tree of all ``grams``."""
    import numpy as np

    held = asked.sparkSession.sparkContext.broadcast((top.keys, top.less, top.own))

    def values(codes, counts):
        wanted, tree = codes[counts < 0], subtrees(codes[counts > 0], counts[counts > 0])
        keys, less, own = held.value
        whole = Tree(*(over[:NEAR] + under[NEAR:] for over, under in ((keys, tree.keys), (less, tree.less), (own, tree.own))))
        out = [whole.byte_log10(wanted[at : at + CHUNK]) for at in range(0, len(wanted), CHUNK)]
        return wanted, np.concatenate([np.zeros(0), *out])

    return in_subtrees(grams.select("key", "n").unionByName(asked.select("key", F.lit(-1).cast("long").alias("n"))), values, "key long, value double")


def slots_of(codes):
    import numpy as np

    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)


def score_table(codes, values):
    """Tags and log10 scores of ``2**SLOTS`` slots; a later code takes the slot of an earlier one."""
    import numpy as np

    tags, value = np.zeros(1 << SLOTS, np.uint64), np.full(1 << SLOTS, np.nan, np.float32)
    slot = slots_of(codes)
    tags[slot], value[slot] = codes, values
    return tags, value


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """About ``limit`` rows of the largest counts.

    How low the counts go is read off a histogram in steps of a 64th of a doubling; of the
    step in which the limit lies, the share that still fits is taken by hash. So neither the
    driver nor a task sorts the rows.
    """
    step = F.floor(F.log2("n") * 64)
    least, rows, share = None, 0, 0.0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r.step):
        least, share = r.step, min((limit - rows) / r["rows"], 1.0)
        rows += r["rows"]
        if rows >= limit:
            break
    some = (step == least) & (F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    return counts.filter((step > least) | some)


@dataclass
class Model:
    """What scoring needs: the top of the tree, all grams, the scores of frequent ones (frequent last), frequent words, and totals."""

    tree: Tree
    grams: DataFrame
    codes: object
    values: object
    words: object
    counts: object
    tokens: int
    distinct: int
    ends: int


def learn(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all ``texts`` (column ``raw``), and the counts ``(key, n)`` of its words."""
    import numpy as np

    counts = stage(gather(texts), "counts")
    words, grams = counts.filter("kind = 0").select("key", "n"), counts.filter("kind = 1").select("key", "n")
    ends = texts.count()
    n, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tree = top_tree(grams)
    often = most_frequent(grams, FREQUENT_GRAMS)
    held = gram_values(grams, often, tree).withColumn("value", F.col("value").cast("float")).join(often, "key").toArrow()
    last = np.lexsort((held["key"].to_numpy(), held["n"].to_numpy()))
    frequent = most_frequent(words, FREQUENT).toArrow()
    order = np.argsort(frequent["key"].to_numpy())
    codes, values = held["key"].to_numpy()[last].astype(np.uint64), held["value"].to_numpy()[last]
    return Model(tree, grams, codes, values, frequent["key"].to_numpy()[order], frequent["n"].to_numpy()[order], int(n) + ends, int(distinct) + (ends > 0), ends), words


def score(docs: DataFrame, model: Model, words: DataFrame, id_col: str, text_col: str, extra: list[str]) -> DataFrame:
    """``(id, *extra, n_tokens, n_known, base_score, score, bits_per_byte)`` of every row.

    A text's rare words and grams leave as ``(row, key, times)`` and meet their counts and
    scores in joins; the frequent ones never leave the executor.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.codes, model.values, model.words, model.counts))
    tokens, distinct, ends = model.tokens, model.distinct, model.ends

    def run(batches: Iterator):
        from collections import Counter
        from itertools import islice

        import numpy as np
        import pyarrow as pa
        import xxhash

        codes, values, frequent, n_frequent = held.value
        tags, value = score_table(codes, values)
        by_code = np.argsort(codes)
        codes, values = codes[by_code], values[by_code]
        base = np.log10(tokens + ALPHA * (distinct + 1))
        end = (np.log10(ends + ALPHA) if ends else np.log10(ALPHA)) - base
        log_count = np.log10(n_frequent + ALPHA) - base
        known: dict = {}  # word to its place among the frequent ones, -1 for a rare one, and its hash

        def byte_scores(codes_seen):
            """Scores of grams, 0 for those that are not among the frequent ones, and the places of these."""
            slot = slots_of(codes_seen)
            out = value[slot].astype(np.float64)
            miss = np.flatnonzero((tags[slot] != codes_seen) | np.isnan(out))
            if not len(miss):
                return out, miss
            # Frequent grams whose slot another one took, and all others.
            asked, back = np.unique(codes_seen[miss], return_inverse=True)
            found, known_ = np.zeros(len(asked)), np.zeros(len(asked), bool)
            if len(codes):
                at = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
                known_ = codes[at] == asked
                found = np.where(known_, values[at], 0.0)
            out[miss] = found[back]
            return out, miss[~known_[back]]

        def looked_up(new):
            """Places and hashes of words, searched for together; as many as fit are remembered."""
            h = np.fromiter((xxhash.xxh64_intdigest(w) for w in new), np.uint64, len(new)).view(np.int64)
            at = np.full(len(new), -1)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                at[frequent[at] != h] = -1
            found = dict(zip(new, zip(at.tolist(), h.tolist(), strict=True), strict=True))
            known.update(islice(found.items(), max(MEMO - len(known), 0)))
            return found

        def total(raws):
            """Of each text, many short texts at once: the sum of the scores of its frequent grams; of all its other ones the text, gram and times, by text."""
            out, group, size, other = np.zeros(len(raws)), [], 0, []

            def counted(row, code):
                order = np.lexsort((code, row))
                row, code = row[order], code[order]
                new = np.flatnonzero(np.concatenate((np.ones(min(len(row), 1), bool), (row[1:] != row[:-1]) | (code[1:] != code[:-1]))))
                other.append((row[new], code[new].astype(np.int64), np.diff(np.append(new, len(row)))))

            def flush(group):
                sizes = np.array([len(framed_) - DEPTH for _, framed_ in group])
                buffer = np.frombuffer(b"".join(f for _, f in group), np.uint8)
                at = np.cumsum([0, *(sizes[:-1] + DEPTH)])
                codes_seen = grams(buffer)
                found, cold = byte_scores(codes_seen)
                for (i, _), start, length in zip(group, at.tolist(), sizes.tolist(), strict=True):
                    out[i] = found[start : start + length].sum()
                # Grams across the border of two texts belong to none.
                of = np.searchsorted(at, cold, "right") - 1
                own = cold - at[of] < sizes[of]
                counted(np.array([i for i, _ in group])[of[own]], codes_seen[cold[own]])

            for i, raw in enumerate(raws):
                text = framed(raw)
                if len(text) > CHUNK:
                    for s in range(0, len(text) - DEPTH, CHUNK):
                        codes_seen = grams(np.frombuffer(text[s : s + CHUNK + DEPTH], np.uint8))
                        found, cold = byte_scores(codes_seen)
                        out[i] += found.sum()
                        counted(np.full(len(cold), i), codes_seen[cold])
                    continue
                group.append((i, text))
                size += len(text)
                if size >= CHUNK:
                    flush(group)
                    group, size = [], 0
            if group:
                flush(group)
            row, code, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*other, strict=True)) if other else (np.zeros(0, np.int64),) * 3
            order = np.argsort(row, kind="stable")
            ends_at = np.searchsorted(row[order], np.arange(len(raws) + 1)).astype(np.int32)
            listed = lambda x: pa.ListArray.from_arrays(pa.array(ends_at), pa.array(x[order], pa.int64()))
            return out, listed(code), listed(n)

        for b in slices(batches):
            raws = b.column(b.num_columns - 1).to_pylist()
            n_tokens, n_known, sums, rare, times, size = [], [], [], [], [], []
            for raw in raws:
                found = Counter((raw or b"").translate(_TEXT).split())
                number, hits, value_sum, hs, ns = 0, 0, 0.0, [], []
                places, weights = [], []
                new = looked_up([w for w in found if w not in known])
                for w, n in found.items():
                    number += n
                    at, h = known.get(w) or new[w]
                    if at >= 0:
                        hits += n
                        places.append(at)
                        weights.append(n)
                    else:
                        hs.append(h)
                        ns.append(n)
                if places:
                    value_sum = float(log_count[places] @ np.array(weights, np.float64))
                n_tokens.append(number + 1)
                n_known.append(hits + (ends > 0))
                sums.append(value_sum + end)
                rare.append(hs)
                times.append(ns)
                size.append(len(raw or b"") + 1)
            byte_sums, cold, cold_times = total(raws)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(sums, pa.float64()), pa.array(byte_sums), pa.array(size, pa.int64()), pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64())), cold, cold_times],
                [*b.schema.names[:-1], "n_tokens", "known", "base", "sum", "size", "rare", "times", "cold", "cold_times"],
            )

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in (id_col, *extra))
    rows = spread_rows(docs.select(id_col, *extra, F.monotonically_increasing_id().alias("_key"), F.col(text_col).cast("binary").alias("_raw")))
    part = stage(rows.mapInArrow(run, f"{kinds}, _key long, n_tokens long, known long, base double, sum double, size long, rare array<long>, times array<long>, cold array<long>, cold_times array<long>"), "scores")
    base = F.lit(float(tokens)) + ALPHA * (distinct + 1)
    # A row's number is written with it, so all readers of the stage see the same one.
    each = lambda keys, n: part.select("_key", F.explode(F.arrays_zip(keys, n)).alias("r")).select("_key", F.col(f"r.{keys}").alias("key"), F.col(f"r.{n}").alias("t"))
    of_words = each("rare", "times").join(words, "key", "left").select("_key", (F.col("t") * (F.log10(F.coalesce("n", F.lit(0)) + ALPHA) - F.log10(base))).alias("more"), F.when(F.col("n") > 0, F.col("t")).otherwise(0).alias("also"), F.lit(0.0).alias("bytes"))
    cold = each("cold", "cold_times")
    of_grams = cold.join(gram_values(model.grams, cold.select("key").distinct(), model.tree), "key").select("_key", F.lit(0.0).alias("more"), F.lit(0).cast("long").alias("also"), (F.col("t") * F.col("value")).alias("bytes"))
    seen = of_words.unionByName(of_grams).groupBy("_key").agg(*(F.sum(c).alias(c) for c in ("more", "also", "bytes")))
    out = part.drop("rare", "times", "cold", "cold_times").join(seen, "_key", "left").withColumn("score", F.col("sum") + F.coalesce("bytes", F.lit(0.0)))
    return out.select(id_col, *extra, "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
                      (-F.col("score") / F.log10(F.lit(2.0)) / F.col("size")).alias("bits_per_byte"))


def evaluate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from rows whose crc32(id) mod 10 is not 0 and score every row.

    Null texts count as empty ones: one token, the end. Rows that repeat score alike. With
    nothing to learn from, N and V are 0 and every bit has an even chance.
    """
    model, words = learn(docs.filter(remainder(id_col, 10) != 0).select(F.col(text_col).cast("binary").alias("raw")))
    rows = docs.select(id_col, (remainder(id_col, 10) == 0).alias("held_out"), text_col)
    return score(rows, model, words, id_col, text_col, ["held_out"])
