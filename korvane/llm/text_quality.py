"""Per-document text statistics, and from them prose against lists, tables and junk.

Word and letter-pair counts over all documents say which words are common and which letters follow each other; every document's
statistics use them. Gradient-boosted trees are trained on a bounded sample of documents that simple rules label weakly where they
are sure and that nobody labelled; probabilities are calibrated on one part of the hand-checked labels and measured on the other, which
neither training nor calibration sees. Every document's statistics are worked out once and written; training, calibration, measurement
and classification read them there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvane import runtime

KINDS = ("prose", "list", "table", "junk")
#: Documents that are labelled weakly for training and hand-checked documents that calibrate or measure, at most; one hand-checked
#: document of so many is held out to measure.
TRAIN_ROWS, CALIBRATE_ROWS, HELD_OUT = 8000, 5000, 3
#: Classes of letters in the table of pairs: a to z, four German letters, Russian letters, other letters, digits, space, other.
_LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßабвгдеёжзийклмнопрстуфхцчшщъыьэюя"
_CLASSES = len(_LETTERS) + 4


def _class_table() -> np.ndarray:
    table = np.full(0x10000, _CLASSES - 1, dtype=np.int64)
    for c in range(0x10000):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = _LETTERS.index(low) if len(low) == 1 and low in _LETTERS else _CLASSES - 4
        elif x.isdigit():
            table[c] = _CLASSES - 3
        elif x.isspace():
            table[c] = _CLASSES - 2
    return table


_TABLE: np.ndarray | None = None
_VOWELS = np.array([_LETTERS.index(c) for c in "aeiouyäöüаеёиоуыэюя"])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _classes_of(codes: np.ndarray) -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        _TABLE = _class_table()
    return _TABLE[np.minimum(codes, 0xFFFF)]


_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_BULLET = re.compile(r"^\s*(?:[-–—•◦▪·*+→>]|№|§|#|\(?\d{1,3}(?:\.\d{1,3})*[.)]?|[a-zа-я]\))\s+", re.IGNORECASE)
_LEADER = re.compile(r"(?:\.{4,}|…{2,}|\s{3,})\s*\d+\s*$|[—–-]\s*\d{3,4}\s*$")
_SENTENCE_END = re.compile(r"[.!?…]['\"»”)\]]*\s*(?:\([^()]*\)\W*)?(?:#\w+\W*)*[^\w;,]*$")
_CELL = re.compile(r"^\W*(?:\d[\d\s.,:/%-]*|n/a|[—–-]|)\W*$")
_QUOTED = re.compile(r'"[^"\n]*"')
_SPACED = re.compile(r"\S\s{2,}(?=\S)")
_URL = re.compile(r"^\s*https?://\S+\s*$")
_TAGGED = re.compile(r"(?<!\S)#\w+")
_ESCAPED = re.compile(r"%[0-9A-Fa-f]{2}|\\x[0-9a-f]{2}|\\u[0-9a-f]{4}")
_HEX = re.compile(r"0x[0-9a-f]{4,}|\b[0-9a-f]{12,}\b")
_TAIL = re.compile(r"['\"»”)\]]*\s*[^\w;,]*$")
_STOP = re.compile(r"([.!?…])\s")
_NAME = re.compile(r"[^\W\d_]+,\s*[^\W\d_]\.")

STATISTICS = ("words", "mean_word_length", "symbol_share", "punctuated_lines", "common_words")
_NAMES = (
    *STATISTICS, "chars", "lines", "letters", "digits", "spaces", "upper", "odd_chars", "latin1", "replacement", "sentence_lines", "bullets", "leaders",
    "short_lines", "mean_line", "line_spread", "line_words", "entry_ends", "cells", "cell_lines", "cells_alike", "number_cells", "spaced", "urls", "tags", "escapes", "mixed",
    "distinct_words", "distinct_lines", "distinct_sentences", "longest_word", "single_letters", "pair_score", "worst_pairs", "vowels", "word_spread", "top_word", "name_lines", "colon_lines", "capital_words", "short_common", "inner_upper", "controls",
)


def _ends_sentence(line: str) -> bool:
    """Whether _SENTENCE_END is found in a line. Without a bracket or tag only its last stop can be what ends it."""
    if "(" in line or "#" in line:
        return _SENTENCE_END.search(line) is not None
    at = max(map(line.rfind, ".!?…"))
    return at >= 0 and _TAIL.match(line, at + 1) is not None


def _mixed(codes: np.ndarray) -> int:
    """Places where ASCII letters and digits, or small letters and capitals, alternate as no word does."""
    if len(codes) < 3:
        return 0
    small, capital, digit = codes - 97 < 26, codes - 65 < 26, codes - 48 < 10  # unsigned: what is less wraps round
    n, step = 0, small[:-1] & capital[1:]
    if digit.any():
        letter = small | capital
        n = int(np.count_nonzero(letter[:-2] & digit[1:-1] & letter[2:]))
    if step.any():
        n += int(np.count_nonzero(step[:-1] & capital[2:])) + int(np.count_nonzero(step[:-2] & step[2:]))
    return n


def _spread(values: list[int], mean: float) -> float:
    """Standard deviation, in the order of operations of numpy's own."""
    off = np.array(values, dtype=np.float64) - mean
    return float(np.sqrt(np.add.reduce(off * off) / len(values)))


def _hex_runs(parts: list[list[str]], prefixed: bool) -> int:
    """Finds of _HEX in texts between white space; without 0x only those of twelve characters or more can hold one."""
    return sum(len(_HEX.findall(x)) for x in chain.from_iterable(parts) if prefixed or len(x) >= 12)


def statistics(text: str, common: frozenset[str] | set[str], pairs: np.ndarray) -> list[float]:
    """The numbers of _NAMES for a non-blank text. Shares lie between 0 and 1; `words` counts runs of letters."""
    lines = [x for x in (y.strip("\r ") for y in text.split("\n")) if x.strip()]
    n, chars = max(1, len(lines)), len(text)
    words = _WORD.findall(text)
    low = list(map(str.lower, words))
    w = len(words) or 1
    times, capitals = Counter(low), [a for a, b in zip(words, low) if a != b]
    lengths = list(map(len, words)) or [0]
    mean_length = sum(lengths) / len(lengths)
    codes = _codes(text)
    classes = _classes_of(codes)
    kinds = np.bincount(classes, minlength=_CLASSES)
    letters, digits, spaces, other = int(kinds[: _CLASSES - 3].sum()), int(kinds[-3]), int(kinds[-2]), int(kinds[-1])
    known = classes < _CLASSES - 4
    seen = pairs.ravel()[(classes[:-1] * _CLASSES + classes[1:])[known[1:] & known[:-1]]]
    high = codes[codes - 0x7F < 0x81]  # unsigned: from 0x7F to 0xFF
    ends = [_ends_sentence(x) for x in lines]
    ended = sum(ends)
    parts = [x.split() for x in lines]
    line_words = list(map(len, parts)) or [0]
    longest = max(map(len, chain.from_iterable(parts)), default=0)
    ordered, half = sorted(line_words), len(line_words) // 2
    sentence_lines = sum(c >= 4 and e for c, e in zip(line_words, ends))
    bullets = sum(_BULLET.match(x) is not None for x in lines)
    leaders = sum(x[-1].isdigit() and _LEADER.search(x) is not None for x in map(str.rstrip, lines))
    sizes = list(map(len, lines)) or [0]
    mean_size = sum(sizes) / len(sizes)
    best_cells, best_alike, best_lines, best_numbers = 0.0, 0.0, 0.0, 0.0
    for sep in ("|", "\t", ";", ","):
        if text.count(sep) < (2 if sep == "\t" else 4):  # too few for two rows
            continue
        own = [_QUOTED.sub("q", x) for x in lines] if sep in ",;" and '"' in text else lines
        counts = [x.count(sep) for x in own]
        rows = [c for c in counts if c >= (1 if sep in "\t" else 2)]
        if len(rows) < 2:
            continue
        alike = Counter(rows).most_common(1)[0][1] / n
        if alike > best_alike:
            cells = [c for x, k in zip(own, counts) if k for c in x.strip("|").split(sep)]  # a quoted cell counts as text
            best_alike, best_lines, best_cells = alike, len(rows) / n, sum(rows) / len(rows)
            best_numbers = sum(bool(_CELL.match(c)) for c in cells) / len(cells)
    spaced = sum(_SPACED.search(x) is not None for x in lines) / n if "  " in text else 0.0
    tops = max(times.values()) / w if words else 0.0
    common_times = [(x, c) for x, c in times.items() if x in common]
    sentences = [x for x in map(str.strip, _STOP.sub("\\1\n", text).split("\n")) if x]
    vowels = int(kinds[_VOWELS].sum()) / max(1, letters)
    names = sum(_NAME.match(x) is not None for x in lines) if "," in text else 0
    colons = sum(0 <= x.find(": ") < 0.6 * len(x) for x in lines)
    return [
        float(len(words)), mean_length, other / chars, ended / n, sum(c for _, c in common_times) / w,
        float(np.log1p(chars)), float(np.log1p(n)), letters / chars, digits / chars, spaces / chars, sum(map(str.isupper, capitals)) / w, int(kinds[_CLASSES - 4]) / chars,
        int(np.count_nonzero(high >= 0x80)) / len(codes), text.count("�") / chars, sentence_lines / n, bullets / n, leaders / n,
        sum(x < 60 for x in sizes) / len(sizes), float(np.log1p(mean_size)), _spread(sizes, mean_size) / (mean_size + 1), (ordered[half] + ordered[-1 - half]) / 2, sum(x[-1] in ";," for x in lines) / n, best_cells, best_lines, best_alike, best_numbers,
        spaced, sum(bool(_URL.match(x)) for x in lines) / n if "://" in text else 0.0, min(1.0, len(_TAGGED.findall(text)) / w) if "#" in text else 0.0, 3 * len(_ESCAPED.findall(text)) / chars if "%" in text or "\\" in text else 0.0,
        min(1.0, (_mixed(codes) + (_hex_runs(parts, "0x" in text) if digits and (longest >= 12 or "0x" in text) else 0)) / w),
        len(times) / w, len(set(lines)) / n, len(set(sentences)) / max(1, len(sentences)), float(np.log1p(longest)), lengths.count(1) / len(lengths),
        float(np.add.reduce(seen) / seen.size) if seen.size else -12.0, int(np.count_nonzero(seen < -7.5)) / seen.size if seen.size else 1.0, vowels, _spread(lengths, mean_length), tops, names / n, colons / n, sum(x[:1].isupper() for x in capitals) / w,
        sum(c for x, c in common_times if len(x) <= 4) / w, sum(a[1:] != a[1:].lower() and not a.isupper() for a in capitals) / w, int(np.count_nonzero(high < 0xA0)) / len(codes),
    ]


_AT = {name: i for i, name in enumerate(_NAMES)}


def weak_kind(s: np.ndarray) -> int:
    """Index of KINDS where a rule is sure, else -1. s: statistics of a document."""
    g = lambda name: s[_AT[name]]
    words, lines = g("words"), np.expm1(g("lines"))
    long = words >= 12 or np.expm1(g("chars")) >= 60
    entries = max(g("bullets"), g("leaders"), g("urls"), g("name_lines"))
    rows = g("cells_alike") > 0.6 and (g("number_cells") > 0.25 or g("cells") >= 2) and g("entry_ends") < 0.5 or g("spaced") > 0.7 and g("digits") > 0.08
    if long and (g("replacement") > 0.2 or g("escapes") > 0.5 or g("escapes") > 0.15 and g("spaces") < 0.03 or g("tags") > 0.6 and g("sentence_lines") < 0.3 or g("controls") > 0.05 or g("latin1") > 0.35):
        return 3
    if long and entries < 0.3 and not rows and (g("mixed") > 0.12 and g("sentence_lines") < 0.3 or g("symbol_share") > 0.5 or g("inner_upper") > 0.5 or g("letters") < 0.25 and g("digits") > 0.5):
        return 3
    if lines >= 4 and g("distinct_lines") < 0.3 or words >= 30 and g("distinct_sentences") < 0.3:
        return 3
    if words >= 12 and lines <= 3 and g("distinct_words") < 0.6 and g("sentence_lines") < 0.2 and g("short_common") < 0.06:
        return 3
    if words >= 12 and entries < 0.3 and not rows and (g("worst_pairs") > 0.25 or g("pair_score") < -6.2 or g("single_letters") > 0.25 and g("word_spread") > 2 and g("short_common") < 0.4 or g("vowels") < 0.12):
        return 3
    if lines >= 4 and g("sentence_lines") < 0.5 and rows:
        return 2
    if lines >= 4 and g("sentence_lines") < 0.5 and g("cells_alike") < 0.5 and (entries > 0.5 or g("colon_lines") > 0.7 or g("short_lines") > 0.8 and g("punctuated_lines") < 0.3 and g("line_words") <= 4):
        return 1
    pairs = g("colon_lines") > 0.6 and g("line_words") <= 8  # a term and its explanation; lines of a dialogue are longer
    if lines >= 3 and pairs and g("cells_alike") < 0.5:
        return 1
    sound = not pairs and g("worst_pairs") < 0.06 and g("distinct_sentences") > 0.7 and entries < 0.5 and g("inner_upper") < 0.2 and g("tags") < 0.3
    if sound and g("sentence_lines") > 0.5 and g("cells_alike") < 0.5:
        return 0
    if sound and words >= 6 and g("distinct_words") > 0.2 and g("short_common") > 0.08 and entries < 0.2 and g("line_words") >= 6 and g("cells_alike") < 0.3 and g("symbol_share") < 0.15 and g("spaced") < 0.3:
        return 0
    return -1


class Trees:
    """Gradient-boosted trees for several classes: softmax loss, second-order splits on histograms."""

    def __init__(self, rounds: int = 45, depth: int = 4, rate: float = 0.2, bins: int = 48, ridge: float = 1.0, least: float = 2.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature, border, value of each node of a full tree
        self.classes = 0

    def fit(self, x: np.ndarray, y: np.ndarray, classes: int) -> Trees:
        n, f = x.shape
        self.classes = classes
        borders = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(borders[j], x[:, j], "right") for j in range(f)], axis=1)
        width = self.bins + 1
        flat = binned + np.arange(f) * width
        weight = np.array([n / (classes * max(1, (y == c).sum())) for c in range(classes)])[y] ** 0.5
        score = np.zeros((n, classes))
        for _ in range(self.rounds):
            e = np.exp(score - score.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            for c in range(classes):
                grad, hess = (p[:, c] - (y == c)) * weight, np.maximum(p[:, c] * (1 - p[:, c]), 1e-6) * weight
                node = np.zeros(n, dtype=np.int64)
                size = 2 ** (self.depth + 1) - 1
                feature, border, value = np.full(size, -1), np.zeros(size), np.zeros(size)
                for level in range(self.depth):
                    first, count = 2**level - 1, 2**level
                    at = ((node - first)[:, None] * (f * width) + flat).ravel()
                    g = np.bincount(at, np.repeat(grad, f), count * f * width).reshape(count, f, width).cumsum(axis=2)
                    h = np.bincount(at, np.repeat(hess, f), count * f * width).reshape(count, f, width).cumsum(axis=2)
                    gt, ht = g[:, :, -1:], h[:, :, -1:]
                    gain = g**2 / (h + self.ridge) + (gt - g) ** 2 / (ht - h + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(h < self.least) | (ht - h < self.least)] = 0
                    best = gain.reshape(count, -1).argmax(axis=1)
                    for k in range(count):
                        j, b = divmod(int(best[k]), width)
                        if gain[k, j, b] > 1e-6 and b < len(borders[j]):
                            feature[first + k], border[first + k] = j, borders[j][b]
                    own = feature[node]
                    right = (own >= 0) & (x[np.arange(n), np.maximum(own, 0)] >= border[node])
                    node = 2 * node + 1 + right
                g, h = np.bincount(node, grad, size), np.bincount(node, hess, size)
                value = -self.rate * g / (h + self.ridge)
                score[:, c] += value[node]
                self.trees.append((feature, border, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.classes))
        rows = np.arange(len(x))
        for i, (feature, border, value) in enumerate(self.trees):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                own = feature[node]
                node = 2 * node + 1 + ((own >= 0) & (x[rows, np.maximum(own, 0)] >= border[node]))
            out[:, i % self.classes] += value[node]
        return out


class Calibration:
    """Temperature and one offset per class, fitted to hand labels; leaves scores as they are without labels."""

    def __init__(self, classes: int) -> None:
        self.scale, self.offset = 1.0, np.zeros(classes)

    def fit(self, score: np.ndarray, y: np.ndarray, steps: int = 300, pull: float = 0.02) -> Calibration:
        if len(y) == 0:
            return self
        log_scale, offset = 0.0, np.zeros(score.shape[1])
        hot = np.eye(score.shape[1])[y]
        for _ in range(steps):
            p = self._softmax(np.exp(log_scale) * score + offset)
            d = (p - hot) / len(y)
            log_scale -= 0.5 * (float((d * score).sum()) * np.exp(log_scale) + pull * log_scale)
            offset -= 0.5 * (d.sum(axis=0) + pull * offset)
        self.scale, self.offset = float(np.exp(log_scale)), offset
        return self

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        return self._softmax(self.scale * score + self.offset)


def corpus_counts(df: DataFrame, text: str = "text") -> tuple[frozenset[str], np.ndarray]:
    """The common words (in at least 1 % of the documents with text) and log shares of letter pairs, counted over every document.
    Workers send their distinct words and one table of fixed size each. There are at most a hundred times as many common words as a document
    has distinct words on average, however many documents there are."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(_CLASSES * _CLASSES, dtype=np.int64)
        for b in batches:
            held: Counter[str] = Counter()
            for x in b["text"]:
                held.update(set(_WORD.findall(x.lower())))
                c = _classes_of(_codes(x))
                if len(c) > 1:
                    table += np.bincount(c[:-1] * _CLASSES + c[1:], minlength=_CLASSES * _CLASSES)
            yield pd.DataFrame({"word": list(held), "pair": -1, "n": list(held.values())})
        yield pd.DataFrame({"word": "", "pair": np.arange(len(table)), "n": table})

    texts = df.where(F.length(F.trim(text)) > 0).select(F.col(text).alias("text"))
    counts = runtime.written(texts.mapInPandas(count, "word string, pair int, n bigint").groupBy("word", "pair").agg(F.sum("n").alias("n")), "text-counts")
    total = texts.count()
    words = counts.where((F.col("pair") < 0) & (F.col("n") >= 0.01 * total)).select("word")
    table = np.zeros(_CLASSES * _CLASSES)
    for r in counts.where(F.col("pair") >= 0).select("pair", "n").collect():  # a fixed number of rows
        table[r["pair"]] = r["n"]
    table = table.reshape(_CLASSES, _CLASSES)
    pairs = np.log((table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * _CLASSES)) + np.log(0.5)
    return frozenset(r["word"] for r in words.collect()), pairs


def majority(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, kind): each labelled document's kind by distinct annotators; none where the leading kinds tie or are null."""
    votes = labels.where(F.col("kind").isin(*KINDS)).select(key, "annotator", "kind").distinct().groupBy(key, "kind").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy(key).agg(F.max("n").alias("top"))
    return votes.join(best, key).where(F.col("n") == F.col("top")).groupBy(key).agg(F.count(F.lit(1)).alias("tied"), F.first("kind").alias("kind")).where(F.col("tied") == 1).select(key, "kind")


def _not_blank(rows: pd.DataFrame) -> pd.DataFrame:
    return rows[[bool(x.strip()) for x in rows["text"]]]


def _statistics_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """Written table (key, own, weak): each non-blank document's statistics, packed, and the kind that a rule is sure of or -1."""
    spark = df.sparkSession
    common, pairs = corpus_counts(df, text)
    common_b, pairs_b = spark.sparkContext.broadcast(common), spark.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in map(_not_blank, batches):
            own = [np.array(statistics(x, common_b.value, pairs_b.value), dtype=np.float64) for x in b["text"]]
            yield pd.DataFrame({"key": b["key"].to_numpy(), "own": [x.tobytes() for x in own], "weak": np.array([weak_kind(x) for x in own], dtype=np.int32)})

    kind = dict(df.dtypes)[key]
    rows = df.where(F.length(text) > 0).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return runtime.written(rows.mapInPandas(run, f"key {kind}, own binary, weak int"), "text-statistics")


def _matrix(own: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(own), dtype=np.float64).reshape(-1, len(_NAMES))


def _first(rows: DataFrame, n: int) -> DataFrame:
    """At most n rows, in order of a hash of their key. Rows far behind the n-th are held back first, so that no task sends n of its own."""
    share = min(1.0, 1.2 * n / max(1, rows.count()))
    hashed = rows.withColumn("_h", F.shiftrightunsigned(F.xxhash64("key"), 1)).where(F.col("_h") <= min((1 << 63) - 1, int(share * (1 << 63))))
    return hashed.orderBy("_h", "key").limit(n).drop("_h")


def _fitted(table: DataFrame, labels: DataFrame | None, key: str, train_rows: int, calibrate_rows: int) -> tuple[Trees, Calibration, pd.DataFrame]:
    """Trees of documents without a label, their calibration on labelled ones, and (kind, said, probability) of those held out."""
    unseen = table.where(F.col("weak") >= 0)
    if labels is not None:
        unseen = unseen.join(labels.select(F.col(key).alias("key")).where(F.col("key").isNotNull()).distinct(), "key", "left_anti")
    sample = _first(unseen.dropDuplicates(["key"]), train_rows).select("own", "weak").toPandas()
    model, scale, held = Trees(), Calibration(len(KINDS)), pd.DataFrame({"kind": [], "said": [], "probability": []})
    if sample["weak"].nunique() > 1:
        model.fit(_matrix(sample["own"]), sample["weak"].to_numpy(dtype=np.int64), len(KINDS))
    if labels is None or not model.trees:
        return model, scale, held
    hand = majority(labels, key).select(F.col(key).alias("key"), "kind")
    known = _first(table.join(hand, "key").dropDuplicates(["key"]), calibrate_rows).select("kind", "own", (F.pmod(F.xxhash64("key", F.lit("held out")), F.lit(HELD_OUT)) == 0).alias("out")).toPandas()
    if len(known):
        score, kind, out = model.score(_matrix(known["own"])), known["kind"].map(KINDS.index).to_numpy(dtype=np.int64), known["out"].to_numpy(dtype=bool)
        scale.fit(score[~out], kind[~out])
        p = scale.probabilities(score[out])
        held = pd.DataFrame({"kind": known["kind"][out].to_numpy(), "said": [KINDS[i] for i in p.argmax(axis=1)], "probability": p[np.arange(len(p)), kind[out]]})
    return model, scale, held


def text_kinds(df: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS, calibrate_rows: int = CALIBRATE_ROWS) -> DataFrame:
    """(key, words, mean_word_length, symbol_share, punctuated_lines, common_words, kind, probability) of each row with non-blank text.

    words: runs of letters; symbol_share: characters that are no letter, digit or white space; punctuated_lines: non-blank lines
    ending a sentence; common_words: words that at least 1 % of the documents hold. Counts cover all documents; only the trees are
    fitted on a sample, of at most train_rows documents that a rule is sure of and nobody labelled, in order of a hash of their key, and
    calibrated on labelled ones (at most calibrate_rows, less those held out). Null, empty and blank texts give no row; repeated rows
    give repeated rows; without documents that a rule is sure of everything is prose; further columns are not read.
    """
    spark = df.sparkSession
    table = _statistics_table(df, key, text)
    model, scale, _ = _fitted(table, labels, key, train_rows, calibrate_rows)
    model_b = spark.sparkContext.broadcast((model, scale))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, calibration = model_b.value
        for b in batches:
            if not len(b):
                continue
            s = _matrix(b["own"])
            if trees.trees:
                p = calibration.probabilities(trees.score(s))
                best = p.argmax(axis=1)
                kind, probability = [KINDS[i] for i in best], p[np.arange(len(p)), best]
            else:
                kind, probability = ["prose"] * len(s), np.ones(len(s))
            out = pd.DataFrame(s[:, : len(STATISTICS)], columns=list(STATISTICS))
            yield out.assign(key=b["key"].to_numpy(), words=out["words"].astype("int64"), kind=kind, probability=probability)[["key", *STATISTICS, "kind", "probability"]]

    kind = dict(df.dtypes)[key]
    rows = table.select("key", "own")
    return rows.mapInPandas(run, f"key {kind}, words bigint, mean_word_length double, symbol_share double, punctuated_lines double, common_words double, kind string, probability double").withColumnRenamed("key", key)


def held_out_report(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS, calibrate_rows: int = CALIBRATE_ROWS) -> DataFrame:
    """(kind, said, documents, probability): hand-checked documents that neither training nor calibration saw, by their kind and the one
    that `text_kinds` says, with the mean probability of the right one. No row without labels or documents a rule is sure of."""
    _, _, held = _fitted(_statistics_table(df, key, text), labels, key, train_rows, calibrate_rows)
    rows = [(k, s, len(g), float(g["probability"].mean())) for (k, s), g in held.groupby(["kind", "said"])]
    return df.sparkSession.createDataFrame(rows, "kind string, said string, documents bigint, probability double")
