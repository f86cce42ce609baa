"""New batches against all history: records that bring nothing new.

A batch's texts, as sequences of term ids, are cut into stretches that meet in groups, and in each group they are one concatenated text
with a suffix array: the places of its windows in the order of what follows them. Both are stored, in that order, and never change.
The windows of a new batch are looked up by binary search in the arrays of all batches before it and in its own; what matches is added
up over all groups as the coverage of each pair of texts. Stored arrays of about the same size are merged, so there are
logarithmically many and each entry is moved a logarithmic number of times.

Which windows: of a set of n, those n - ceil(t n) + 1 that come first in an order that is the same for all (rare first). A pair similar
to t covers at least a known number of those; pairs that reach it are compared in full. Which group: that of the longest term in the
window, so that neighbouring windows stay together in one stretch and a common short term gathers nothing.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane import runtime
from korvane.llm import shingles, urls
from korvane.llm.terms import term_prints, terms

#: Pairs of matched places that are held at a time in a group; terms that are packed in a key of a suffix; bytes of a batch's arrays
#: up to which they are sent to the stored ones, beyond which both are shuffled.
WIDE, PACKED, SENT = 2_000_000, 4, 64 << 20
_SEGMENT = "p int, text binary, places binary, windows binary, docs binary, classes binary, sizes binary"
_FIELDS = (("text", np.uint16), ("places", np.int32), ("windows", np.uint16), ("docs", np.int32), ("classes", np.int64), ("sizes", np.int32))
_COLUMNS = ("p", *(c for c, _ in _FIELDS))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Segment:
    """A concatenated text of term ids (0 ends a stretch) and its suffix array: places in the order of what follows; immutable."""

    def __init__(self, text: np.ndarray, places: np.ndarray, windows: np.ndarray, docs: np.ndarray, classes: np.ndarray, sizes: np.ndarray, k: int) -> None:
        """windows, docs: how many windows each stretch has, and whose it is. classes, sizes: of the texts."""
        self.text, self.places, self.windows, self.docs, self.classes, self.sizes, self.k = text, places, windows, docs, classes, sizes, k

    @classmethod
    def built(cls, rows: pd.DataFrame, k: int) -> Segment:
        """Of packed stretches as `_stretches` gives them. A text that came twice is kept once."""
        text, windows, docs, classes, sizes, base = [], [], [], [], [], 0
        for r in rows.itertuples(index=False):
            text.append(np.frombuffer(r.text, dtype=np.uint16))
            windows.append(np.frombuffer(r.windows, dtype=np.uint16))
            docs.append(np.frombuffer(r.docs, dtype=np.int32) + base)
            classes.append(np.frombuffer(r.classes, dtype=np.int64))
            sizes.append(np.frombuffer(r.sizes, dtype=np.int32))
            base += len(classes[-1])
        out = cls(np.concatenate(text), np.empty(0, dtype=np.int32), np.concatenate(windows), np.concatenate(docs), np.concatenate(classes), np.concatenate(sizes), k)
        out._without_copies()
        out._sort()
        return out

    @classmethod
    def of(cls, r: object, k: int) -> Segment:
        """Of a stored row."""
        return cls(*(np.frombuffer(getattr(r, c), dtype=d) for c, d in _FIELDS), k)

    def row(self, p: int) -> tuple:
        return (p, self.text.tobytes(), self.places.astype(np.int32).tobytes(), self.windows.tobytes(), self.docs.astype(np.int32).tobytes(), self.classes.tobytes(), self.sizes.tobytes())

    def _starts(self) -> np.ndarray:
        """Place of each stretch: it has one term less than k more than windows, and its end."""
        lengths = self.windows.astype(np.int64) + self.k
        return np.cumsum(lengths) - lengths

    def _without_copies(self) -> None:
        first = np.sort(np.unique(self.classes, return_index=True)[1])
        if len(first) == len(self.classes):
            return
        stays = np.zeros(len(self.classes), dtype=bool)
        stays[first] = True
        new = np.cumsum(stays) - 1
        mine = stays[self.docs]
        self.text = self.text[np.repeat(mine, self.windows.astype(np.int64) + self.k)]
        self.windows, self.docs = self.windows[mine], new[self.docs[mine]].astype(np.int32)
        self.classes, self.sizes = self.classes[first], self.sizes[first]

    def keys(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers for each place that order the suffixes there, up to twice PACKED terms or the end of the stretch."""
        padded = np.concatenate([self.text, np.zeros(2 * PACKED, dtype=np.uint16)]).astype(np.uint64)
        out, inside = [], np.ones(len(places), dtype=bool)
        for half in range(2):
            key = np.zeros(len(places), dtype=np.uint64)
            for j in range(PACKED):
                term = padded[places + half * PACKED + j]
                inside &= term != 0
                key = (key << np.uint64(16)) | np.where(inside, term, np.uint64(0))
            out.append(key)
        return out[0], out[1]

    def _sort(self) -> None:
        w = self.windows.astype(np.int64)
        places = np.repeat(self._starts(), w) + np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        first, second = self.keys(places)
        self.places = places[np.lexsort((second, first))].astype(np.int32)

    def owners(self, places: np.ndarray) -> np.ndarray:
        """Text of each place."""
        return self.docs[np.searchsorted(self._starts(), places, "right") - 1].astype(np.int64)

    def merged(self, other: Segment) -> Segment:
        """Both as one, by merging the two sorted arrays. Texts that both have are kept once."""
        twice = np.isin(other.classes, self.classes)
        if twice.any():
            kept = Segment(other.text, other.places, other.windows, other.docs, other.classes, other.sizes, self.k)
            mine = ~twice[kept.docs]
            kept.text = kept.text[np.repeat(mine, kept.windows.astype(np.int64) + self.k)]
            new = np.cumsum(~twice) - 1
            kept.windows, kept.docs, kept.classes, kept.sizes = kept.windows[mine], new[kept.docs[mine]].astype(np.int32), kept.classes[~twice], kept.sizes[~twice]
            kept._sort()
            other = kept
        out = Segment(np.concatenate([self.text, other.text]), self.places, np.concatenate([self.windows, other.windows]), np.concatenate([self.docs, other.docs + len(self.classes)]), np.concatenate([self.classes, other.classes]), np.concatenate([self.sizes, other.sizes]), self.k)
        later = other.places.astype(np.int64) + len(self.text)
        a, b = out.keys(self.places.astype(np.int64)), out.keys(later)
        at = np.searchsorted(a[0], b[0], "right")  # equal first halves: the other array's follow, so the order is by first halves there
        where = at + np.arange(len(at))
        places = np.empty(len(self.places) + len(later), dtype=np.int32)
        free = np.ones(len(places), dtype=bool)
        free[where] = False
        places[where], places[free] = later, self.places
        out.places = places
        return out

    def covered(self, asked: Segment, t: float, same: bool) -> pd.DataFrame:
        """(a, b, covered, need): pairs of a class of `asked` and one of this segment that share windows here; how many; and how many a
        pair of their sizes shares at least over all groups. same: both are one batch, each pair is taken once."""
        mask = np.uint64((1 << 16 * (PACKED - self.k)) - 1)
        own = asked.places.astype(np.int64)
        windows = asked.keys(own)[0] & ~mask
        keys = self.keys(self.places.astype(np.int64))[0]
        low, high = np.searchsorted(keys, windows, "left"), np.searchsorted(keys, windows | mask, "right")
        hit = high > low
        low, width, docs = low[hit], (high - low)[hit], asked.owners(own)[hit]
        mine = self.owners(self.places.astype(np.int64))
        ends, found, at = np.cumsum(width), [], 0
        while at < len(width):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WIDE, "right")))
            w = width[at:to]
            rank = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
            u, v = np.repeat(docs[at:to], w), mine[np.repeat(low[at:to], w) + rank]
            m, n = asked.sizes[u], self.sizes[v]
            fits = (m >= t * n - 1e-9) & (n >= t * m - 1e-9) & (asked.classes[u] > self.classes[v] if same else asked.classes[u] != self.classes[v])
            found.append(np.unique(u[fits] * len(self.classes) + v[fits], return_counts=True))
            at = to
        both = np.concatenate([np.empty(0, dtype=np.int64), *(x for x, _ in found)])
        counts = np.concatenate([np.empty(0, dtype=np.int64), *(c for _, c in found)])
        pairs, back = np.unique(both, return_inverse=True)
        n = np.bincount(back, weights=counts, minlength=len(pairs)).astype(np.int64)
        u, v = pairs // max(1, len(self.classes)), pairs % max(1, len(self.classes))
        need = shingles.least_covered(asked.sizes[u], self.sizes[v], t)
        return pd.DataFrame({"a": asked.classes[u], "b": self.classes[v], "covered": n, "need": need})


def _set_of(sequence: bytes, k: int) -> np.ndarray:
    return np.unique(shingles.of_prints(np.frombuffer(sequence, dtype=np.uint64), k))


def _stretches(rows: DataFrame, t: float, k: int, counts: np.ndarray, groups: int) -> DataFrame:
    """Packed stretches (p, text, windows, docs, classes, sizes) of texts (class, sequence): for some of them and a group that some of
    their chosen windows belong to, the stretches of terms that hold these windows. Millions of windows move as a few rows."""
    sketch = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = sketch.value
        for b in batches:
            b = b.drop_duplicates("class")
            prints, chosen, sizes, base = [], [], [], 0
            for sequence in b["sequence"]:
                own = np.frombuffer(sequence, dtype=np.uint64)
                h, at = np.unique(shingles.of_prints(own, k), return_index=True)
                n = shingles.prefix_length(len(h), t)
                if n < len(h):
                    rank = (often[(h % np.uint64(shingles.SKETCH)).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(16))
                    at = at[np.argpartition(rank, n - 1)[:n]]
                prints.append(own)
                chosen.append(np.sort(at) + base)
                sizes.append(len(h))
                base += len(own)
            if not prints:
                continue
            flat, at, doc = np.concatenate(prints), np.concatenate(chosen), np.repeat(np.arange(len(chosen)), [len(x) for x in chosen])
            least = flat[at]
            for j in range(1, k):
                least = np.minimum(least, flat[at + j])
            group = (((least * _MIX) >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)
            new = np.r_[True, (at[1:] != at[:-1] + 1) | (group[1:] != group[:-1]) | (doc[1:] != doc[:-1])]
            first = np.flatnonzero(new)
            windows = np.diff(np.r_[first, len(at)])
            order = np.argsort(group[first], kind="stable")
            start, windows, owner, of_group = at[first][order], windows[order], doc[first][order], group[first][order]
            lengths = windows + k  # the terms and an end
            ends = np.cumsum(lengths)
            place = np.repeat(start, lengths) + np.arange(int(ends[-1])) - np.repeat(ends - lengths, lengths)
            ids = (((flat * _MIX) >> np.uint64(40)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
            text = ids[np.minimum(place, len(ids) - 1)]
            text[ends - 1] = 0
            classes, sizes = b["class"].to_numpy(), np.array(sizes, dtype=np.int32)
            out = []
            for p, s, e in shingles._spans(of_group):
                some, local = np.unique(owner[s:e], return_inverse=True)
                out.append((p, text[ends[s] - lengths[s] : ends[e - 1]].tobytes(), windows[s:e].astype(np.uint16).tobytes(), local.astype(np.int32).tobytes(), classes[some].tobytes(), sizes[some].tobytes()))
            yield pd.DataFrame(out, columns=["p", "text", "windows", "docs", "classes", "sizes"])

    return rows.select("class", "sequence").mapInPandas(run, "p int, text binary, windows binary, docs binary, classes binary, sizes binary")


def _table(df: DataFrame, key: str, batch: str | None, url: str, text: str, k: int, min_terms: int) -> DataFrame:
    """Written table (id, batch_no, page, class, sequence): sequence is the text's term prints; null, as class, for too short a text."""
    number = F.col(batch).cast("bigint") if batch else F.lit(1).cast("bigint")
    named = df.where(F.col(key).isNotNull() & number.isNotNull()).select(F.col(key).alias("id"), number.alias("batch_no"), F.col(url).alias("url"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            classes, sequences = [], []
            for x in b.column(3).to_pylist():
                own = terms(x)
                if len(own) < max(min_terms, k):
                    classes.append(None)
                    sequences.append(None)
                    continue
                prints = term_prints(own)
                classes.append(shingles.set_class(np.unique(shingles.of_prints(prints, k))))
                sequences.append(prints.tobytes())
            pages = pa.array([urls.page_key(u) for u in b.column(2).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pages, pa.array(classes, type=pa.int64()), pa.array(sequences, type=pa.binary())], names=["id", "batch_no", "page", "class", "sequence"])

    kind = dict(named.dtypes)["id"]
    return runtime.written(named.mapInArrow(run, f"id {kind}, batch_no bigint, page string, class bigint, sequence binary"), "sequences", ("batch_no",) if batch else ())


def _sketch(rows: DataFrame, k: int) -> np.ndarray:
    """How often windows occur in rows (class, sequence): a fixed number of counters; only their sums reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = np.zeros(shingles.SKETCH, dtype=np.uint32)
        for b in batches:
            if len(b):
                flat = np.concatenate([_set_of(s, k) for s in b["sequence"]])
                sketch += np.bincount((flat % np.uint64(shingles.SKETCH)).astype(np.int64), minlength=shingles.SKETCH).astype(np.uint32)
        yield pd.DataFrame({"part": np.arange(shingles.PARTS, dtype=np.int32), "h": [x.tobytes() for x in np.split(sketch, shingles.PARTS)]})

    return shingles.sketch_of(rows.select("sequence").mapInPandas(count, "part int, h binary"))


def _names(page: Column, own_class: Column) -> Column:
    """What a record is known by: its page and its class."""
    return F.array_compact(F.array(F.concat(F.lit("u"), page), F.concat(F.lit("c"), own_class.cast("string"))))


def _settle(new: DataFrame, links: DataFrame, known: DataFrame) -> DataFrame:
    """(id): the records of `new` (id, batch_no, page, class) that repeat an accepted one.

    links: (a, b) in both directions; known: (name) of what was accepted before all of them. A record makes known its page, its class
    and the classes linked to it once it is accepted. Each round accepts all open records that wait for no earlier open one, and drops
    those that these make known.
    """
    first, own = F.min(F.struct("batch_no", "id")).alias("first"), F.struct("batch_no", "id")

    def known_by(r: DataFrame) -> DataFrame:
        return r.select("id", "batch_no", F.explode(_names(F.col("page"), F.col("class"))).alias("name"))

    def made_known(r: DataFrame) -> DataFrame:
        """(name, first): by the first record that makes it known. Copies are one class before they meet their links."""
        near = r.where(F.col("class").isNotNull()).groupBy("class").agg(first).join(links, F.col("class") == F.col("a")).select(F.concat(F.lit("c"), F.col("b").cast("string")).alias("name"), "first")
        return known_by(r).groupBy("name").agg(first).unionByName(near).groupBy("name").agg(F.min("first").alias("first"))

    cases = runtime.written(known_by(new).join(known, "name", "left_semi").select("id").distinct(), "repeats")
    open_records = runtime.written(new.join(cases, "id", "left_anti"), "open")
    while not open_records.isEmpty():
        earliest = known_by(open_records).join(made_known(open_records), "name").groupBy("id", "batch_no").agg(F.min("first").alias("first"))
        waits = earliest.where(F.col("first") < own).select("id")
        waiting = runtime.written(open_records.join(waits, "id", "left_semi"), "waiting")
        if waiting.isEmpty():
            break
        accepted = open_records.join(waiting.select("id"), "id", "left_anti")
        met = runtime.written(known_by(waiting).join(made_known(accepted), "name").where(F.col("first") < own).select("id").distinct(), "met")
        cases = cases.unionByName(met)
        open_records = runtime.written(waiting.join(met, "id", "left_anti"), "open")
    return cases


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def repeats(df: DataFrame, key: str = "article_id", batch: str = "batch_no", url: str = "url", text: str = "text", t: float = 0.5, k: int = 3, min_terms: int = 20) -> DataFrame:
    """(key): each record after batch 0 that repeats a record accepted before it, by page or by text; batch by batch through an `Archive`
    of its own.

    Batch 0 is accepted whole; later records in order of (batch, key), each unless it repeats an accepted one. Null and blank urls
    name no page, and null, empty or short texts (fewer than min_terms terms) are near-duplicates of nothing; a record with neither
    is always accepted. Keys must be unique; records of equal order and key would be taken as one. Rows with null or negative batch or
    null key are left out. An empty table gives no row; further columns are not read. Texts are read once, into a table by batch.
    """
    spark = df.sparkSession
    table = _table(df, key, batch, url, text, k, min_terms)
    archive = Archive(spark, runtime.folder(spark, "archive"), t, k, min_terms)
    found = spark.createDataFrame([], table.select("id").schema)
    for n in sorted(r["batch_no"] for r in table.select("batch_no").distinct().collect()):  # as many as there were loads
        if n >= 0:
            found = found.unionByName(archive._add(table.where(F.col("batch_no") == n), n == 0))
    return found.withColumnRenamed("id", key)


class Archive:
    """History that is kept between runs: suffix arrays, sequences and names of accepted records in a folder, a directory for each batch.

    A batch adds one immutable directory. Its arrays are sent to the stored ones where they lie, or met by a shuffle if they are larger than
    SENT; stored arrays are never sorted again, and no text of earlier batches is read, but the sequences of texts that a pair
    asks for. When the newest directories are about as large as the one before, their arrays are merged. Order of windows and number of
    groups are those of the first batch for good: the guarantee needs one order for all, which need not be the best one.

    What is in use is said by a manifest, written last of each add: directories and their sizes, groups, parameters, and where the sketch
    lies. A new object on the folder goes on from the newest complete manifest; directories that none names (of an add that failed) are
    not read. Nothing is overwritten: a folder that another object has added to since, or one with other parameters or with batches but
    no manifest, raises ValueError. Runs of at most PACKED terms (k) are supported.
    """

    _KINDS = {"segments": _SEGMENT, "sets": "class bigint, sequence binary", "names": "name string"}

    def __init__(self, spark: SparkSession, folder: str, t: float = 0.5, k: int = 3, min_terms: int = 20) -> None:
        if not 1 <= k <= PACKED:
            raise ValueError(f"k must be 1 to {PACKED}")
        self.spark, self.folder, self.t, self.k, self.min_terms = spark, folder.rstrip("/"), t, k, min_terms
        self.parts: list[tuple[str, int]] = []  # directories in use and their sizes in records
        self.number, self.counts, self.groups, self.version, self.sketch = 0, np.zeros(0, dtype=np.uint32), 0, 0, ""
        self._load()

    def _manifests(self) -> list[int]:
        """Versions of the complete manifests in the folder."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in files.listStatus(root)] if files.exists(root) else []
        done = [int(n[9:]) for n in names if re.fullmatch(r"manifest=\d+", n) and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(root, f"{n}/_SUCCESS"))]
        if not done and any(re.fullmatch(r"batch=\d+", n) for n in names):
            raise ValueError(f"{self.folder} holds batches without a manifest")
        return sorted(done)

    def _load(self) -> None:
        done = self._manifests()
        if not done:
            return
        kept = json.loads(self.spark.read.schema("manifest string").parquet(f"{self.folder}/manifest={done[-1]}").first()["manifest"])
        own = {"t": self.t, "k": self.k, "min_terms": self.min_terms}
        if kept["parameters"] != own:
            raise ValueError(f"{self.folder} was made with {kept['parameters']}, not {own}")
        self.parts = [(name, size) for name, size in kept["parts"]]
        self.number, self.groups, self.version, self.sketch = kept["number"], kept["groups"], done[-1], kept["sketch"]
        self.counts = np.frombuffer(self.spark.read.schema("counts binary").parquet(f"{self.folder}/{self.sketch}").first()["counts"], dtype=np.uint32)

    def _save(self, parts: list[tuple[str, int]], number: int) -> None:
        if not self.sketch:
            name = f"sketch={uuid.uuid4().hex}"
            self.spark.createDataFrame([(bytearray(self.counts.tobytes()),)], "counts binary").coalesce(1).write.mode("error").parquet(f"{self.folder}/{name}")
            self.sketch = name
        kept = {"parts": parts, "number": number, "groups": self.groups, "sketch": self.sketch, "parameters": {"t": self.t, "k": self.k, "min_terms": self.min_terms}}
        self.spark.createDataFrame([(json.dumps(kept),)], "manifest string").coalesce(1).write.mode("error").parquet(f"{self.folder}/manifest={self.version + 1}")
        self.parts, self.number, self.version = parts, number, self.version + 1

    def _read(self, what: str, parts: list[tuple[str, int]]) -> DataFrame:
        paths = [f"{self.folder}/{name}/{what}" for name, _ in parts]
        return self.spark.read.schema(self._KINDS[what]).parquet(*paths) if paths else self.spark.createDataFrame([], self._KINDS[what])

    def add(self, df: DataFrame, key: str = "article_id", url: str = "url", text: str = "text") -> DataFrame:
        """(key): the records of a batch that repeat an accepted record, in order of key. The others are accepted. The first batch is
        accepted whole."""
        mark = runtime.mark()
        out = self._add(_table(df, key, None, url, text, self.k, self.min_terms), not self.parts)
        runtime.clean(self.spark, mark)
        return out.withColumnRenamed("id", key)

    def _add(self, table: DataFrame, whole: bool) -> DataFrame:
        """`add` for a written table of sequences. whole: all are accepted. What was written on the way is deleted."""
        if (self._manifests() or [0])[-1] != self.version:
            raise ValueError(f"{self.folder} was added to by another object")
        mark = runtime.mark()
        sets = table.where(F.col("class").isNotNull()).select("class", "sequence")
        if not self.groups:
            self.sketch, self.counts = "", _sketch(sets, self.k)
            self.groups = shingles.groups_for(self.spark, sets.count())
        k, name = self.k, f"batch={self.number}-{uuid.uuid4().hex}"
        built = _stretches(sets, self.t, k, self.counts, self.groups).groupBy("p").applyInPandas(lambda g: pd.DataFrame([Segment.built(g, k).row(int(g["p"].iloc[0]))], columns=list(_COLUMNS)), _SEGMENT)
        built.write.mode("error").parquet(f"{self.folder}/{name}/segments")
        records = table.select("id", "batch_no", "page", "class")
        if whole:
            cases = records.limit(0).select("id")
        else:
            links = _both(runtime.written(self._links(name, sets), "matches"))
            names = self._read("names", self.parts)
            near = links.select(F.concat(F.lit("c"), F.col("a").cast("string")).alias("name"), F.concat(F.lit("c"), F.col("b").cast("string")).alias("other")).join(names, "name", "left_semi").select(F.col("other").alias("name"))
            cases = _settle(records, links, names.unionByName(near))
        cases.write.mode("error").parquet(f"{self.folder}/{name}/repeats")
        cases = self.spark.read.schema(table.select("id").schema).parquet(f"{self.folder}/{name}/repeats")
        self._store(table.join(cases, "id", "left_anti"), name)
        runtime.clean(self.spark, mark)
        return cases

    def _links(self, name: str, sets: DataFrame) -> DataFrame:
        """(a, b): classes of the batch in directory `name` with the near-duplicate classes of earlier batches and of itself."""
        t, k = self.t, self.k
        path = f"{self.folder}/{name}/segments"
        new = self.spark.read.schema(_SEGMENT).parquet(path)
        stored = self._read("segments", self.parts).withColumn("same", F.lit(False)).unionByName(new.withColumn("same", F.lit(True)))
        asks = new.select(*(F.col(c).alias(f"n_{c}") for c in _COLUMNS))
        if runtime.size_of(self.spark, path) <= SENT:
            asks = F.broadcast(asks)

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples(index=False):
                    asked = Segment(*(np.frombuffer(getattr(r, f"n_{c}"), dtype=d) for c, d in _FIELDS), k)
                    yield Segment.of(r, k).covered(asked, t, r.same)

        parts = stored.join(asks, F.col("p") == F.col("n_p")).drop("p", "n_p").mapInPandas(look, "a bigint, b bigint, covered bigint, need bigint")
        candidates = parts.groupBy("a", "b").agg(F.sum("covered").alias("covered"), F.min("need").alias("need")).where(F.col("covered") >= F.col("need")).select("a", "b")
        return shingles.compared(candidates, self._read("sets", self.parts).unionByName(sets).withColumnRenamed("sequence", "h"), t, lambda s: _set_of(s, k))

    def _store(self, accepted: DataFrame, name: str) -> None:
        parts, number, k = list(self.parts), self.number + 1, self.k
        accepted.where(F.col("class").isNotNull()).select("class", "sequence").dropDuplicates(["class"]).write.option("compression", "zstd").mode("error").parquet(f"{self.folder}/{name}/sets")
        accepted.select(F.explode(_names(F.col("page"), F.col("class"))).alias("name")).distinct().write.mode("error").parquet(f"{self.folder}/{name}/names")
        parts.append((name, accepted.count()))
        while len(parts) > 1 and parts[-2][1] < 2 * parts[-1][1]:
            pair, into = parts[-2:], f"merge={number}-{uuid.uuid4().hex}"
            number += 1

            def merge(g: pd.DataFrame) -> pd.DataFrame:
                out, *others = (Segment.of(r, k) for r in g.itertuples(index=False))
                for other in others:
                    out = out.merged(other)
                return pd.DataFrame([out.row(int(g["p"].iloc[0]))], columns=list(_COLUMNS))

            self._read("segments", pair).groupBy("p").applyInPandas(merge, _SEGMENT).write.mode("error").parquet(f"{self.folder}/{into}/segments")
            for what in ("sets", "names"):
                self._read(what, pair).coalesce(runtime.shuffle_width(self.spark)).write.option("compression", "zstd").mode("error").parquet(f"{self.folder}/{into}/{what}")
            parts[-2:] = [(into, pair[0][1] + pair[1][1])]
        self._save(parts, number)
