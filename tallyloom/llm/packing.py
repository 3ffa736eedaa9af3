"""Packing tokenised documents into sequences, shortest-pack-first over the length histogram.

A document longer than a sequence is cut into whole sequences and a remainder. The
histogram of piece lengths has at most max_len entries whatever the data's size, so it
comes to the driver; there the lengths are placed longest first, all pieces of a length
at once, each into the packing pattern with the least room that still holds it, and the
counts of the patterns are updated. A pattern's slots are kept as (length, times), so that
a sequence may hold as many pieces as fit. A pattern that is used for n sequences owns, for each
such entry, a run of n * times ranks of that length. The runs are then joined back to
the pieces by length and rank. A rank is counted in chunks of a length, so that a length that
many documents share is spread over tasks.

Null text is empty and has the end id alone. Repeated rows, and rows that share an id or have none, are packed each. An empty table
gives an empty result. Very long texts are tokenised word by word, whole, and cut into sequences; the cache holds short words only.
Other columns of the input, whatever their names, have no effect.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if, materialize, table
from .token_counts import byte_symbols

MAX_LEN = 2048
END_ID = 1
#: So many words are kept in a worker; past that, it starts anew.
CACHE = 400_000
#: Longer words and pieces, in characters, are not kept.
LONGEST_KEPT = 64
#: So many texts, of so many characters or one, are tokenised at a time.
TEXTS, TEXT_CHARS = 512, 4 << 20
#: The vocabulary's own pattern of pieces, for ASCII in lower case.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\s0-9a-z]+"
PIECES_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, chunk int"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "chunk"]


class WordIds:
    """Token ids as little-endian 32-bit bytes, for vocabularies that fold case, drop white space and mark the ends of words.

    Such a vocabulary's ids of a text are those of its pieces one after another. Words of
    letters, with or without a comma or the like at the end, and other words of printable
    ASCII are split here, and the library's model gives the ids of the pieces; both
    are kept. Any other word goes to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.symbols = dict(enumerate(byte_symbols()))
        self.known: dict[str, bytes] = {"": b""}
        self.bases: dict[str, bytes] = {}
        self.pieces = re.compile(PIECES, re.ASCII).findall
        self.marks = {m: self.encode(m) for m in ".,;:!?"}

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        """A piece in lower case."""
        got = self.bases.get(piece)
        if got is None:
            symbols = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.symbols)
            got = array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()
            if len(piece) <= LONGEST_KEPT:
                self.bases[piece] = got
        return got

    def word(self, word: str) -> bytes:
        mark = word[-1] if word[-1] in self.marks else ""
        base = word[:-1] if mark else word
        low = base.lower()
        if low.isalpha() and (low.isascii() or base.isalpha() and "Σ" not in base):
            ids = self.piece(low if low.isascii() else unicodedata.normalize("NFC", base).lower())
            return ids + self.marks[mark] if mark else ids
        if word.isascii() and word.isprintable() and "<|" not in word:
            return b"".join(map(self.piece, self.pieces(word.lower())))
        return self.encode(word)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        if len(self.known) + len(self.bases) > CACHE:
            self.known, self.bases = {"": b""}, {}
        known, long, word = self.known, {}, self.word
        for w in set().union(*split).difference(known):
            (known if len(w) <= LONGEST_KEPT else long)[w] = word(w)
        return [b"".join([known[w] if w in known else long[w] for w in words]) if long else b"".join(map(known.__getitem__, words)) for words in split]


def portions(texts: list[str | None]):
    """Slices of texts, of TEXTS texts and TEXT_CHARS characters at most, or of one text."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > first and (k - first >= TEXTS or size + n > TEXT_CHARS):
            yield first, k
            first, size = k, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


_tokenizers: dict[str, WordIds] = {}


def cut_pieces(docs: DataFrame, path: str, max_len: int = MAX_LEN, chunks: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece (PIECES_SCHEMA). One pass without shuffle."""

    def run(batches):
        if path not in _tokenizers:
            _tokenizers[path] = WordIds(path)
        ids_of, end = _tokenizers[path].ids, np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            numbers, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            for first, last in portions(texts):
                out = []
                for i, ids in zip(numbers[first:last], ids_of(texts[first:last]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for at in range(0, n, max_len):
                        piece = ids[4 * at : 4 * (at + max_len)]
                        crc = zlib.crc32(piece)
                        out.append((i, at, len(piece) // 4, crc, n, (crc ^ (hash(i) * 2654435761)) % chunks))
                cols = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.int32())], NAMES)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES_SCHEMA)


def shortest_pack_first(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Packing patterns as (number of sequences, slots), the slots as (length, times).

    Lengths are placed longest first. The n pieces of a length go to the pattern with the least room
    that is enough, as many as it has sequences; those sequences become a pattern of their own with one entry
    more. What finds no room opens new sequences. A pattern takes a length several times
    over while it has room.
    """
    by_room: dict[int, dict[tuple[tuple[int, int], ...], int]] = defaultdict(lambda: defaultdict(int))
    rooms: list[int] = []  # ascending, of patterns in use

    def add(room: int, slots: tuple[tuple[int, int], ...], n: int) -> None:
        if not by_room[room]:
            bisect.insort(rooms, room)
        by_room[room][slots] += n

    for length in sorted((x for x in histogram if histogram[x] > 0), reverse=True):
        left = histogram[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                # New sequences: as many slots of this length as fit, for the pieces that are left.
                fit = max_len // length
                n, rest = divmod(left, fit)
                if n:
                    add(max_len - fit * length, ((length, fit),), n)
                if rest:
                    add(max_len - rest * length, ((length, rest),), 1)
                break
            room = rooms[at]
            slots = min(by_room[room])
            have = by_room[room][slots]
            fit = room // length
            n, times = (min(have, left // fit), fit) if left >= fit else (1, left)
            by_room[room][slots] -= n
            if not by_room[room][slots]:
                del by_room[room][slots]
                if not by_room[room]:
                    rooms.remove(room)
            add(room - times * length, (*slots, (length, times)), n)
            left -= n * times
    return [(n, slots) for room in sorted(by_room) for slots, n in sorted(by_room[room].items(), reverse=True)]


def runs_of(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, sequences, first sequence, offset) for each entry of each pattern; its ranks fill a slot of all sequences, then the next slot."""
    out, used, sequence = [], defaultdict(int), 0
    for n, slots in patterns:
        offset = 0
        for length, times in slots:
            out.append((length, used[length], n, sequence, offset))
            used[length] += n * times
            offset += length * times
        sequence += n
    return out


def pack(docs: DataFrame, path: str, max_len: int = MAX_LEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece."""
    spark = docs.sparkSession
    pieces = materialize(cut_pieces(docs, path, max_len, id_col=id_col, text_col=text_col), "pieces")
    # Ranks: the place within (length, chunk), after the pieces of the length's earlier chunks.
    counts = pieces.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_len rows at most
    runs = runs_of(shortest_pack_first(histogram, max_len))
    by_length: dict[int, tuple[list[int], list[int], list[int], list[int]]] = {}
    for length, *run in runs:
        for values, x in zip(by_length.setdefault(length, ([], [], [], [])), run, strict=True):
            values.append(x)
    found = spark.createDataFrame([(k, *v) for k, v in by_length.items()], "l long, firsts array<long>, widths array<long>, sequences array<long>, offsets array<long>")
    earlier = W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("length", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    place = F.row_number().over(W.partitionBy("length", "chunk").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    ranked = pieces.withColumn("place", place).join(bases, ["length", "chunk"]).withColumn("rank", F.col("base") + F.col("place") - 1)
    # The runs of a length as sorted arrays, bounded by the number of patterns; the last run that begins at the rank or before is found by bisection.
    joined = ranked.join(broadcast_if(found, len(runs), 32), F.col("length") == F.col("l"))
    steps = [1 << k for k in reversed(range(max([len(v[0]) for v in by_length.values()], default=1).bit_length()))]
    index = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get("firsts", at + step) <= F.col("rank"), at + step).otherwise(at))
    at = joined.withColumn("at", index)
    at = at.withColumns({"within": F.col("rank") - F.get("firsts", F.col("at")), "width": F.get("widths", F.col("at"))})
    slot = F.expr("within div width")
    return at.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.get("sequences", F.col("at")) + F.col("within") % F.col("width")).alias("sequence_id"), (F.get("offsets", F.col("at")) + slot * F.col("length")).alias("offset"),
    )


def op5_packing(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
