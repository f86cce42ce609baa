"""Byte-level BPE as a bounded-lookahead streaming transducer.

Merges never cross a boundary of the pre-tokenizer's pattern, so a text is cut there and each piece goes through the transducer.
Inside a piece the transducer keeps, for each end position, the last token of the encoding of the bytes so far. That token is the
only one that ends there and may follow the last token at its own start: two tokens may be neighbours if merging their joint
bytes gives those two again, which is decided by walking down the two merge trees. How many bytes behind its end can still change a
token, the sufficient lookahead, is worked out from the merge list; tokens that far back leave, and what is held stays bounded.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY_FILE = "byte_bpe_50k.tiktoken"
#: Characters of a text that are taken at a time, longest string that is remembered, and how many of them by a worker.
WINDOW, REMEMBERED_CHARS, REMEMBERED = 1 << 16, 48, 200_000


def vocabulary_path(name: str = VOCABULARY_FILE, folder: str | None = None) -> str:
    """The public vocabulary file: in folder, else in the folder that KORVANE_TOKENIZERS names, else of the installed package."""
    if folder or (folder := os.environ.get("KORVANE_TOKENIZERS")):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: A run of white space with what follows it. Where a visible character stands before it, no piece reaches across its start, so runs
#: can be encoded and remembered on their own; a text with UNEVEN white space (another kind before a common one) is cut in pieces only.
RUNS, UNEVEN = re.compile(r"[ \n\r\t]*[^ \n\r\t]+|[ \n\r\t]+"), re.compile("[\\x0b\\x0c\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000][ \\n\\r\\t]")
#: The pattern that the vocabulary was made with, in possessive form: no repetition is ever given back.
PIECES = r"'(?:[stmd]|re|ve|ll)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s++"


class Transducer:
    """Encoder and decoder of one vocabulary, given as ranks: the rank of a token is its id and the order of its merge."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.joined: dict[tuple[int, int], int] = {}
        single = {ranks[t] for t in ranks if len(t) == 1}
        for i in single:
            self.split[i] = None
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                pair = self._last_merge(token)
                self.split[i] = pair
                self.joined[pair] = i
        self.lookahead = self._sufficient_lookahead()
        self.neighbours: dict[tuple[int, int], bool] = {}
        self.endings = {t[c:] for t in ranks for c in range(len(t))}
        self.pattern = regex.compile(PIECES)
        self.pieces: dict[str, bytes] = _Memory(self.piece)
        self.runs: dict[str, bytes] = _Memory(self.run)

    def _last_merge(self, token: bytes) -> tuple[int, int]:
        """The two tokens whose merge made this one: of its cuts, the one that earlier merges alone would leave."""
        get, made = self.ranks.get, self.split
        cuts = [(a, b) for c in range(1, len(token)) if (a := get(token[:c])) in made and (b := get(token[c:])) in made]
        return cuts[0] if len(cuts) == 1 else next(x for x in cuts if self._apart(*x))

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the joint bytes of the two gives the two."""
        known = self.neighbours.get((left, right))
        if known is None:
            if len(self.neighbours) > 500_000:
                self.neighbours.clear()
            known = self.neighbours[left, right] = self._apart(left, right)
        return known

    def _apart(self, a: int, b: int) -> bool:
        """No merge across the border of the two comes before a merge inside them that hides its parts."""
        split, joined, before = self.split, self.joined, 1 << 60
        while True:
            if joined.get((a, b), before) < before:
                return False
            left, right = split[a], split[b]
            if left is None and right is None:
                return True
            if right is None or (left is not None and a > b):  # undo the later merge: the border pair that stood before it
                before, a = a, left[1]
            else:
                before, b = b + 1, right[0]

    def _sufficient_lookahead(self) -> int:
        """Bytes behind a token's end after which no further byte can change it.

        A merge (a, b) across an end is decided by b's bytes, and by what may take b's right side away before: an earlier merge (p, q)
        with p on the right spine of b, which is itself decided by what follows q. `beyond` follows these chains along falling ranks.
        """
        beyond: dict[int, int] = {}  # left token -> bytes behind it that a merge met so far may need
        most = 0
        for (a, b), i in sorted(self.joined.items(), key=lambda x: x[1]):
            need, p = 0, b
            while True:
                need = max(need, beyond.get(p, 0))
                pair = self.split[p]
                if pair is None:
                    break
                p = pair[1]
            need += len(self.tokens[b])
            beyond[a] = max(beyond.get(a, 0), need)
            most = max(most, need)
        return most

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece that comes in chunks of bytes, each as soon as no further byte can change it. What is held is fewer than
        three times the lookahead in bytes, and a chunk."""
        ranks, may, endings, reach = self.ranks, self.may_follow, self.endings, self.lookahead
        held, token_at, start_at = b"", [-1], [0]  # bytes behind the last settled token; for each end the last token and its start
        before = -1  # the last settled token
        for chunk in chunks:
            for at in range(0, len(chunk), reach):
                done = len(held)
                held += chunk[at : at + reach]
                n = len(held)
                for end in range(done + 1, n + 1):
                    for start in range(end - 1, -1, -1):
                        part = held[start:end]
                        if part not in endings:
                            break
                        token = ranks.get(part)
                        if token is None:
                            continue
                        left = token_at[start] if start else before
                        if left < 0 and start == 0 or left >= 0 and may(left, token):
                            token_at.append(token)
                            start_at.append(start)
                            break
                    if len(token_at) == end:  # no chain of final tokens ends here
                        token_at.append(-1)
                        start_at.append(0)
                if n >= 2 * reach:
                    ends = self._ends(start_at, n)
                    settled = [e for e in ends if e <= n - reach]
                    if settled:
                        for e in settled:
                            yield token_at[e]
                        cut = settled[-1]
                        before, held = token_at[cut], held[cut:]
                        # Chains that start before the cut lead nowhere any more: no final token crosses a settled end.
                        token_at = [-1, *(t if s >= cut else -1 for t, s in zip(token_at[cut + 1 :], start_at[cut + 1 :]))]
                        start_at = [0, *(max(0, s - cut) for s in start_at[cut + 1 :])]
        for e in self._ends(start_at, len(held)):
            yield token_at[e]

    @staticmethod
    def _ends(start_at: list[int], end: int) -> list[int]:
        """Ends of the tokens of the chain that leads to `end`, in order."""
        ends = []
        while end:
            ends.append(end)
            end = start_at[end]
        return ends[::-1]

    def piece(self, piece: str) -> bytes:
        """Ids of a piece as little-endian 32-bit integers."""
        return np.fromiter(self.stream((piece.encode("utf-8", "surrogatepass"),)), dtype="<i4").tobytes()

    def run(self, run: str) -> bytes:
        """Ids of a stretch of text that starts and ends where pieces do."""
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(run)))

    def windows(self, text: str) -> Iterator[str]:
        """The text in windows that end where a piece must end: before common white space that follows a visible character."""
        at = 0
        while len(text) - at > WINDOW:
            cut = next((c for c in range(at + WINDOW, at, -1) if text[c] in " \n\r\t" and not text[c - 1].isspace()), None)
            if cut is None:  # no such place behind: the first one ahead
                cut = next((c for c in range(at + WINDOW, len(text)) if text[c] in " \n\r\t" and not text[c - 1].isspace()), len(text))
            yield text[at:cut]
            at = cut
        yield text[at:]

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian 32-bit integers; none for an empty or null text."""
        if not text:
            return b""
        windows = (text,) if len(text) <= WINDOW else self.windows(text)
        if UNEVEN.search(text):
            return b"".join(map(self.run, windows))
        look, find = self.runs.__getitem__, RUNS.findall
        return b"".join(b"".join(map(look, find(w))) for w in windows)

    def decode(self, ids: Iterator[int]) -> Iterator[str]:
        """Text of a stream of ids, each character once its bytes are complete; what is no UTF-8 becomes U+FFFD."""
        import codecs

        state = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if part := state.decode(self.tokens[int(i)]):
                yield part
        if part := state.decode(b"", True):
            yield part


class _Memory(dict):
    """What was worked out, up to a bound; long strings are never kept."""

    def __init__(self, work: Callable[[str], bytes]) -> None:
        self.work = work

    def __missing__(self, key: str) -> bytes:
        ids = self.work(key)
        if len(key) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = ids
        return ids


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """Of a vocabulary file, once per Python worker."""
    with open(path, "rb") as f:
        return Transducer({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids array<int>): each row's text by the vocabulary, without special tokens.

    Null and empty texts have an empty list. Every row gives a row, repeated ones too; an empty table gives none; further columns
    are not read. A narrow plan: no shuffle, one window of text and one bounded memory of pieces per worker.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            coded = [t.encode(x) for x in b.column(1).to_pylist()]
            ends = np.cumsum([0] + [len(x) // 4 for x in coded], dtype=np.int64)
            flat = pa.array(np.frombuffer(b"".join(coded), dtype="<i4"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)], names=["key", "ids"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
