"""Shingle sets of texts, their classes of equal sets, and rare-first routes to the groups in which they meet.

A shingle is a run of k terms, held as 48 bits of a hash. Records with equal sets form a class, named by a hash of the set, so
copies cost one entry. If two sets are similar to at least t, then with all shingles in one order the first n - ceil(t n) + 1 of
each contain a common one; in the order used here rare ones come first, so common phrases bring nothing together. How common a
shingle is comes from a count sketch over all records. Its error can change the order but not what it guarantees, as all records
are put in the same one. No shingle, class or candidate is dropped for being frequent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane import runtime
from korvane.llm.terms import term_prints, terms

#: Counters of the sketch (a fixed size, whatever the input) and its parts; words of 64 bits of a signature.
SKETCH, PARTS, WORDS = 1 << 20, 16, 8
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
_LOW48 = np.uint64((1 << 48) - 1)


def shingles_of(text: str | None, k: int, min_terms: int) -> np.ndarray:
    """Shingles of a text in order of place, as 48-bit numbers; none where it has fewer than min_terms terms."""
    found = terms(text)
    if len(found) < max(min_terms, k):
        return np.empty(0, dtype=np.uint64)
    return of_prints(term_prints(found), k)


def of_prints(p: np.ndarray, k: int) -> np.ndarray:
    """Shingles of a sequence of term prints that has at least k of them."""
    n = len(p) - k + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = (h ^ p[i : i + n]) * _MIX[i % len(_MIX)]
        h ^= h >> np.uint64(29)
    return (h * _MIX[0]) >> np.uint64(16)


def to_bytes(h: np.ndarray) -> bytes:
    """48-bit numbers, six bytes each."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8")


def set_class(own: np.ndarray) -> int:
    """Name of a set of distinct sorted shingles: 63 bits."""
    import xxhash

    return xxhash.xxh3_64_intdigest(own.tobytes()) >> 1


def shingle_table(df: DataFrame, key: str, text: str, k: int = 3, min_terms: int = 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """Written table (part, key, carried columns, class, h): a row of part -1 for each record, in h its set or, for too short a text,
    null; and rows of parts of the sketch, one of each part from every task."""
    kinds = dict(df.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *carry))
    rows = df.select(F.col(text).alias("_k_text"), key, *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, dtype=np.uint32)
        schema = None
        for b in batches:
            sets = [np.unique(shingles_of(x, k, min_terms)) for x in b.column(0).to_pylist()]
            if schema is None:
                schema = pa.schema([("part", pa.int32()), *((b.schema.names[i], b.column(i).type) for i in range(1, b.num_columns)), ("class", pa.int64()), ("h", pa.binary())])
            if sets and (flat := np.concatenate(sets)).size:
                sketch += np.bincount((flat % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
            columns = [pa.array(np.full(len(sets), -1, dtype=np.int32)), *(b.column(i) for i in range(1, b.num_columns))]
            columns += [pa.array([set_class(s) if s.size else None for s in sets], type=pa.int64()), pa.array([to_bytes(s) if s.size else None for s in sets], type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        if schema is not None:
            nothing = [pa.nulls(PARTS, schema.field(i).type) for i in range(1, len(schema) - 2)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS, dtype=np.int32)), *nothing, pa.nulls(PARTS, pa.int64()), pa.array([x.tobytes() for x in np.split(sketch, PARTS)], type=pa.binary())], schema=schema)

    return runtime.written(rows.mapInArrow(run, f"part int, {fields}, class bigint, h binary"), "shingles")


def sketch_of(table: DataFrame) -> np.ndarray:
    """The summed sketch: SKETCH counters, added up in groups of one part each; only the sum reaches the driver."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SKETCH // PARTS, dtype=np.uint64)
        for h in group["h"]:
            total += np.frombuffer(h, dtype=np.uint32)
        return pd.DataFrame({"part": [group["part"].iloc[0]], "h": [np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()]})

    rows = table.where(F.col("part") >= 0).select("part", "h").groupBy("part").applyInPandas(add, "part int, h binary").collect()
    out = np.zeros((PARTS, SKETCH // PARTS), dtype=np.uint32)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["h"], dtype=np.uint32)
    return out.reshape(-1)


def prefix_length(n: int, t: float) -> int:
    return n - int(np.ceil(t * n - 1e-9)) + 1


def least_covered(m: np.ndarray, n: np.ndarray, t: float) -> np.ndarray:
    """How many shingles the prefixes of sets of sizes m and n have in common at least, if the sets are similar to t: of the
    ceil(t n) - 1 outside of a prefix all may be shared, and the set whose prefix ends earlier decides."""
    sizes = np.stack([m, n])
    shared = np.ceil(t / (1 + t) * sizes.sum(axis=0) - 1e-9)
    return np.maximum(1, (shared - np.ceil(t * sizes - 1e-9) + 1).min(axis=0)).astype(np.int64)


def signature(own: np.ndarray) -> np.ndarray:
    """Bitmap of a set: one bit of 64 * WORDS for each shingle."""
    bits = np.zeros(64 * WORDS, dtype=bool)
    bits[(own % np.uint64(64 * WORDS)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


#: Sets of a group, at most on average: groups grow in number with the input.
SETS_OF_GROUP = 8192


def groups_for(spark: SparkSession, sets: int) -> int:
    """Number of groups for so many sets: at least that of shuffle partitions, and as many as SETS_OF_GROUP asks for."""
    return max(runtime.shuffle_width(spark), -(-sets // SETS_OF_GROUP))


def routed(table: DataFrame, t: float) -> DataFrame:
    """Rows (p, keys, docs, classes, sizes, bits): for each batch of sets and each group p, the rare-first prefixes' shingles that
    belong to p, and of the sets that have any: class, size and signature. Packed, so that millions of shingles move as a few rows. The upper
    16 bits of a shingle choose its group, where the lower 32 stand for it: two shingles that agree in them only add a candidate."""
    spark = table.sparkSession
    sets = table.where(F.col("part") < 0).where(F.col("h").isNotNull())
    groups = groups_for(spark, sets.count())
    sketch = spark.sparkContext.broadcast(sketch_of(table))
    rows = sets.select("class", "h")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = sketch.value
        for b in batches:
            b = b.drop_duplicates("class")  # copies within a batch: one stands for all
            keys, lengths, sizes, bits = [], [], [], []
            for h in b["h"]:
                own = from_bytes(h)
                n = prefix_length(len(own), t)
                rank = (counts[(own % np.uint64(SKETCH)).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (own >> np.uint64(16))
                keys.append(own[np.argpartition(rank, n - 1)[:n]] if n < len(own) else own)
                lengths.append(n)
                sizes.append(len(own))
                bits.append(signature(own))
            if not keys:
                continue
            flat, doc = np.concatenate(keys), np.repeat(np.arange(len(keys)), lengths)
            group = ((flat >> np.uint64(32)) % np.uint64(groups)).astype(np.int32)
            order = np.argsort(group, kind="stable")
            flat, doc, group = flat[order], doc[order], group[order]
            classes, sizes, bits = b["class"].to_numpy(), np.array(sizes, dtype=np.int32), np.array(bits)
            out = []
            for p, s, e in _spans(group):
                some, at = np.unique(doc[s:e], return_inverse=True)
                out.append((p, (flat[s:e] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), at.astype(np.uint16 if len(some) <= 1 << 16 else np.uint32).tobytes(), classes[some].tobytes(), sizes[some].tobytes(), bits[some].tobytes()))
            yield pd.DataFrame(out, columns=["p", "keys", "docs", "classes", "sizes", "bits"])

    return rows.mapInPandas(run, "p int, keys binary, docs binary, classes binary, sizes binary, bits binary")


def _spans(sorted_values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of each run of equal values."""
    if not len(sorted_values):
        return []
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return [(int(sorted_values[s]), int(s), int(e)) for s, e in zip(starts, np.r_[starts[1:], len(sorted_values)])]


class Group:
    """What has met in a group: shingles with the place of their set, and the sets."""

    def __init__(self, rows: pd.DataFrame) -> None:
        keys, docs, classes, sizes, bits, base = [], [], [], [], [], 0
        for r in rows.itertuples(index=False):
            keys.append(np.frombuffer(r.keys, dtype=np.uint32))
            docs.append(np.frombuffer(r.docs, dtype=np.uint16 if len(r.docs) * 2 == len(r.keys) else np.uint32).astype(np.int64) + base)
            classes.append(np.frombuffer(r.classes, dtype=np.int64))
            sizes.append(np.frombuffer(r.sizes, dtype=np.int32))
            bits.append(np.frombuffer(r.bits, dtype=np.uint64).reshape(-1, WORDS))
            base += len(classes[-1])
        at, cl = np.concatenate(docs), np.concatenate(classes)
        self.classes, keep = np.unique(cl, return_index=True)  # copies from other batches fall together here
        self.sizes, self.bits = np.concatenate(sizes)[keep].astype(np.int64), np.concatenate(bits)[keep]
        place = np.searchsorted(self.classes, cl)
        stays = np.zeros(len(cl), dtype=bool)
        stays[keep] = True
        mine = stays[at]
        self.keys, self.docs = np.concatenate(keys)[mine], place[at[mine]]
        self.ones = np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)


def verified(pairs: DataFrame, table: DataFrame, t: float) -> DataFrame:
    """(a, b) of those pairs of classes whose sets are similar to at least t, compared in full.

    Sets of classes that are in no pair are held back before the shuffle by a bitmap of fixed size.
    """
    return compared(pairs, table.where(F.col("part") < 0).where(F.col("h").isNotNull()).select("class", "h"), t)


def compared(pairs: DataFrame, rows: DataFrame, t: float, read: Callable[[bytes], np.ndarray] = from_bytes) -> DataFrame:
    """`verified` with the sets given as rows (class, h), of which a class may have several. read: a set from its h."""
    pairs = runtime.written(pairs, "candidates")
    wanted = runtime.bitmap(pairs.select(F.explode(F.array("a", "b")).alias("class")), "class")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(runtime.in_bitmap(wanted, b.column(0).to_numpy(zero_copy_only=False))))

    sets = rows.mapInArrow(held, "class bigint, h binary").groupBy("class").agg(F.first("h").alias("h"))
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("class").alias("b"), F.col("h").alias("hb")), "b").select("a", "b", "ha", "hb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                own, other = read(x), read(y)
                shared = len(np.intersect1d(own, other, assume_unique=True))
                good.append(shared >= t * (len(own) + len(other) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, type=pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")
