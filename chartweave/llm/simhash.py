"""SimHash near-duplicate groups found through Golay-code fuzzy keys.

A 64-bit fingerprint has four segments of 16 bits. Two fingerprints that differ in three
bits or fewer agree in some segment ``s`` whose successor ``s+1`` has one error at most:
with errors in three segments each has one, and with two or more segments free of errors
at most one of them is followed by the worst one. So the key
``(s, bits of s, Golay index of s+1)`` finds every pair, if the index forgives one error:
a segment, padded to 23 bits, gets the codeword it decodes to and those its 23 one-bit
neighbours decode to (one when it lies within two bits of a codeword, else six).
Fingerprints that share a key are compared, and only checked links are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartweave.llm.common import byte_table, free, row_key, slices, spread_rows, stage
from chartweave.llm.graph import components

#: Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a generator of the binary Golay code.
GOLAY_POLYNOMIAL = 0xC75
WORDS_PER_SHINGLE = 3
SEED = 42
MAX_BITS = 3
_TEXT = byte_table("text")
_CHUNK = 1 << 16


def simhash(raw: bytes | None, words_per_shingle: int = WORDS_PER_SHINGLE) -> int:
    """The fingerprint of one text in UTF-8 as a signed 64-bit number; 0 without words."""
    import numpy as np
    import xxhash

    words = (raw or b"").translate(_TEXT).split()
    if not words:
        return 0
    digest, k = xxhash.xxh64_intdigest, min(words_per_shingle, len(words))
    n = len(words) - k + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at : at + _CHUNK + k - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(part) - k + 1].tolist()
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = WORDS_PER_SHINGLE) -> DataFrame:
    """``(id, key, fp)`` of every row; null and wordless texts have fingerprint 0."""

    def run(batches: Iterator):
        import pyarrow as pa

        for b in slices(batches):
            fps = [simhash(t, words_per_shingle) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["id", "key", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = spread_rows(docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).cast("binary").alias("raw")))
    return rows.mapInArrow(run, f"id {kind}, key long, fp long")


def golay_tables():
    """``error[syndrome]`` for each of the 2,048 syndromes of the 23-bit code."""
    import numpy as np

    error = np.full(2048, -1, np.int64)
    bits = [1 << i for i in range(23)]
    for e in [0, *bits, *(a | b for a in bits for b in bits if a < b), *(a | b | c for a in bits for b in bits if a < b for c in bits if b < c)]:
        error[int(_syndrome(np.array([e]))[0])] = e
    return error


def _syndrome(x):
    """Remainder of 23-bit words by the generator."""
    x = x.copy()
    for i in range(22, 10, -1):
        x ^= ((x >> i) & 1) * (GOLAY_POLYNOMIAL << (i - 11))
    return x


def golay_indices(segments, error):
    """24 codeword indices for each 16-bit segment: its own, then those of its one-bit neighbours."""
    import numpy as np

    near = segments[:, None] ^ np.array([0] + [1 << i for i in range(23)], np.int64)[None, :]
    return (near ^ error[_syndrome(near)]) >> 11


def fuzzy_keys(fps: DataFrame) -> DataFrame:
    """``(key, fp)``: about 21 rows for each fingerprint of ``fps``."""

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        error = golay_tables()
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), _CHUNK):
                part = fp[at : at + _CHUNK]
                segments = np.stack([(part >> (16 * s)) & 0xFFFF for s in range(4)])
                for s in range(4):
                    index = np.sort(golay_indices(segments[(s + 1) % 4], error), axis=1)
                    first = np.concatenate([np.ones((len(part), 1), bool), index[:, 1:] != index[:, :-1]], axis=1)
                    keys = (s << 28) | (segments[s][:, None] << 12) | index
                    rows = np.broadcast_to(part[:, None], keys.shape)[first]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(rows)], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def bucket_links(fp, max_bits: int = MAX_BITS):
    """Edges that join what is linked among distinct unsigned fingerprints: a forest, not all pairs.

    Breadth-first search: each fingerprint taken up is compared with those not reached
    yet only, so a dense bucket is used up after a few steps.
    """
    import numpy as np

    left, a, b = fp.copy(), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = np.bitwise_count(left ^ x) <= max_bits
            if hit.any():
                found, left = left[hit], left[~hit]
                queue.extend(found)
                a.extend([x] * len(found))
                b.extend(found)
    return a, b


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints at ``max_bits`` (3 at most) or fewer bits.

    They join exactly what all such pairs join. Keys are sorted within their partition, and
    each run of a key is searched as it passes; a run holds eight bytes a distinct fingerprint.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the keys find pairs of up to 3 bits")

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        def edges(key, fp):
            fp = fp.view(np.uint64)  # signed numbers would be counted by their absolute value
            ends = np.flatnonzero(np.concatenate((key[1:] != key[:-1], [True]))) + 1
            starts = np.concatenate(([0], ends[:-1]))
            size = ends - starts
            two = starts[size == 2]
            ok = np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits
            a, b = [fp[two][ok]], [fp[two + 1][ok]]
            for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
                x, y = bucket_links(fp[s:e], max_bits)
                a.append(np.array(x, np.uint64))
                b.append(np.array(y, np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

        held: list = []
        for batch in batches:
            key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut or held and len(key) and held[0][0][0] != key[0]:
                held.append((key[:cut], fp[:cut]))
                yield edges(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            if len(key):
                held.append((key[cut:], fp[cut:]))
        if held:
            yield edges(*(np.concatenate(x) for x in zip(*held, strict=True)))

    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = fuzzy_keys(fps).repartition(parts, "key").sortWithinPartitions("key")
    return keys.mapInArrow(run, "a long, b long").distinct()


def grouped(docs: DataFrame, id_col: str, text_col: str, words_per_shingle: int, max_bits: int) -> DataFrame:
    """``(id, key, fp, root, component)`` of every row: ``root`` names its group, ``component`` is the smallest id there."""
    return with_components(stage(fingerprints(docs, id_col, text_col, words_per_shingle), "fingerprints"), lambda fps: links(fps, max_bits))


def with_components(rows: DataFrame, edges: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` (id, key, fp) with ``root`` and ``component`` of the groups that ``edges`` of the distinct ``fp`` join."""
    fps = stage(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = stage(components(edges(fps)), "roots")
    member = fps.join(roots, fps.fp == roots.node)
    lowest = member.groupBy("root").agg(F.min("first").alias("lowest"))
    linked = member.join(lowest, "root").select("fp", "root", "lowest")
    groups = fps.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("lowest", "first").alias("component"))
    return rows.join(groups, "fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = WORDS_PER_SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Every row's id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Groups are the connected components of links at ``max_bits`` or fewer differing bits;
    ``component_id`` is the smallest id in the group, itself included. Null and empty texts
    have fingerprint 0 and are linked like any other; repeated rows are kept and share a
    group; a null id is never the smallest (a group of null ids only has a null one); an
    empty table gives no rows; other columns are not read.
    """
    return grouped(docs, id_col, text_col, words_per_shingle, max_bits).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = WORDS_PER_SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id.

    If that id has several texts in the group, one of them stays, and of rows that repeat it
    one too. Rows without an id stay as they are.
    """
    return one_of_each(docs, grouped(docs, id_col, text_col, words_per_shingle, max_bits), id_col, text_col)


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of each of ``groups``, as ``near_dedup`` picks it; columns of any name are kept."""
    own, gone_key, twice_key, place = free(docs, "own_key", "gone_key", "twice_key", "place")
    groups = groups.filter("id IS NOT NULL")
    keep = groups.filter("id = component").groupBy("root").agg(F.min("key").alias("kept"))
    of = groups.groupBy("root", "key").agg(F.count("*").alias("times")).join(keep, "root")
    # Written out, their size is known before the texts are read: while few rows go, texts aren't shuffled.
    gone = stage(of.filter("key <> kept").select(F.col("key").alias(gone_key)).distinct(), "gone")
    twice = stage(of.filter("key = kept AND times > 1").select(F.col("key").alias(twice_key)), "twice")
    key = row_key(id_col, text_col)
    named = docs.filter(F.col(id_col).isNotNull()).join(gone, key == F.col(gone_key), "left_anti")
    once = named.join(twice, key == F.col(twice_key), "left_anti")
    repeated = named.withColumn(own, key).join(twice, F.col(own) == F.col(twice_key), "left_semi")
    first = repeated.withColumn(place, F.row_number().over(Window.partitionBy(own).orderBy(own))).filter(F.col(place) == 1).select(*docs.columns)
    return once.unionByName(first).unionByName(docs.filter(F.col(id_col).isNull()))
