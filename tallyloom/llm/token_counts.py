"""Token counts of a byte-level pair encoding by heap-and-linked-list merging.

A text is split as the vocabulary's own pre-tokenizer splits it. A piece starts as a
linked list of byte symbols; a heap holds the adjacent pairs that have a merge rank;
the lowest (rank, place) is popped again and again, stale entries are passed over, and
each merge removes one symbol from the list. The count is the number of initial
symbols minus the number of merges; token ids are never made. Counts of pieces are
cached in each Python worker, up to a bounded number.

Null text counts as empty and has 0 tokens. The special strings of the vocabulary inside a
text count as one token each, as the library has it. Repeated rows count each. The
vocabulary's path is a parameter. Rows with a null or shared id count each. Texts may be of any length; a piece of it is merged as a whole. An empty table
gives an empty result. Other columns, whatever their names, have no effect.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: The published pre-tokenizer pattern of byte-level pair encodings.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 500_000
LONGEST_CACHED = 64


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next code point from 256."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + n)
            n += 1
    return [out[b] for b in range(256)]


class PairCounter:
    """Counts tokens of texts for one vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids = model["vocab"]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.pairs[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.bytes = [self.ids[c] for c in byte_symbols()]
        self.pieces = regex.compile(PATTERN).findall
        special = [t["content"] for t in spec["added_tokens"] if t["content"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cache: dict[str, int] = {}
        counter = self

        class Words(dict):
            """Count of a blank and a word."""

            def __missing__(self, word):
                n = counter.split_count(" " + word)
                if len(word) <= LONGEST_CACHED:
                    if len(self) >= CACHE:
                        self.clear()
                    self[word] = n
                return n

        self.words = Words()

    def merge_count(self, piece: str) -> int:
        """Symbols that remain after all merges of one piece."""
        ids = [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = len(ids)
        if n < 2:
            return n
        after, before, pairs = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs
        heap = [(*p, i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := pairs.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if p := pairs.get((new, ids[k])):
                    heapq.heappush(heap, (p[0], i, p[1], new, ids[k]))
            h = before[i]
            if h >= 0 and (p := pairs.get((ids[h], new))):
                heapq.heappush(heap, (p[0], h, p[1], ids[h], new))
        return n - merges

    def split_count(self, text: str) -> int:
        n, cache = 0, self.cache
        for piece, times in Counter(self.pieces(text)).items():
            c = cache.get(piece)
            if c is None:
                c = self.merge_count(piece)
                if len(piece) <= LONGEST_CACHED:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[piece] = c
            n += c * times
        return n

    def plain_count(self, text: str) -> int:
        """A blank between two words always starts a piece, so words can be counted each with its blank.

        Not so where blanks follow one another, with or without other white space between: those texts are split whole.
        """
        words = text.split(" ")
        seen = Counter(words)
        if "" in seen or any(map(str.isspace, seen)):
            return self.split_count(text)
        counts = self.words
        first = words[0]
        return self.split_count(first) - counts[first] + sum(counts[w] * n for w, n in seen.items())

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.special is None or not (found := self.special.findall(text)):
            return self.plain_count(text)
        return len(found) + sum(self.plain_count(x) for x in self.special.split(text) if x)


_counters: dict[str, PairCounter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for each row. One pass without shuffle."""

    def run(batches):
        if path not in _counters:
            _counters[path] = PairCounter(path)
        count = _counters[path].count
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = pa.array([count(t) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), n], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
