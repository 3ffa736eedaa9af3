"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if a string of `least` bytes that covers it also starts earlier (in a text of
a smaller id, or further up in the same text). The first copy stays.

Suffixes of the whole corpus can't be sorted in one place, so the strings meet by anchors: the anchor of a
string is the place in it whose 32 following bytes have the least hash. Equal strings have
the same bytes at their anchors, so no repeat is missed. Strings in a row that share an anchor make one
context; about one anchor comes to every 35 bytes. Of contexts that are equal as a whole all but the
first are repeats, which the map tasks already find for the texts that they hold. Where
contexts that differ share their anchor's bytes, their text is fetched, and a
suffix array is built over the contexts of the anchors that meet in a task, in the order of
(id, row, place). For each suffix, the nearest suffixes above and below that start earlier give the
longest previous factor; where that reaches `least`, the string is a repeat.

An anchor that very many contexts have (a line between ever new neighbours) would bring them all to one task. Such anchors
are counted first, on a part of the rows, and their contexts are cut into single strings that
meet by their own hash: a string has one anchor, so equal ones still meet, and no two that differ need a
suffix array. Which anchors are taken for such has no effect on the result: the part of the rows chooses a plan only.

A text longer than CHUNK is worked on in stretches that overlap by a string less a byte; a context ends where its stretch does.

Null and empty texts lose nothing. Rows are numbered once, in a written table, and come in the order of
(id, row); so rows that share an id, or have none, are texts of their own, of which the
later ones lose what the earlier have. A null id comes last. An empty table gives an empty result. Anchors
are compared by 64-bit hashes of their bytes and of their contexts. Only the id, the text and the columns to keep are read, under names of their own, so other
columns, whatever their names, have no effect.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_by, materialize, table, text_bytes

GRAM = 32
LAST = (1 << 63) - 1
U = np.uint64
#: Bytes of text that a map task works on at a time, and of contexts under one suffix array.
CHUNK, SUFFIXES = 1 << 20, 1 << 20
#: An anchor of more contexts than HOT, counted on one of SAMPLE rows, has its contexts cut into strings. So many take less room than SUFFIXES.
HOT, SAMPLE = 4_000, 16
#: Of so many anchors at most, those of most contexts, the hashes go to all tasks (1 MB).
MOST_HOT = 1 << 17
#: Rows of a record batch that are worked on at a time.
ROWS_AT_ONCE = 256
#: Place, string starts before the anchor and strings, packed: 47, 8 and 8 bits.
_C = [U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * _C[1]
    return h ^ (h >> U(29))


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place; data has seven more bytes than places."""
    return np.ndarray(len(data) - 7, "<u8", data.data, 0, (1,))


def hash_at(w8: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Hash of `length` bytes at each of the places."""
    h = np.full(len(places), length, U)
    for k in [*range(0, length - 8, 8), length - 8]:
        h = mixed((h ^ w8[places + k]) * _C[0])
    return h


def window_min(a: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` values in a row."""
    span = 1
    while span * 2 <= width:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[: len(a) - (width - span)], a[width - span :]) if width > span else a


def anchors(texts: list[bytes], least: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Of all texts: text number, first string start, strings less one, anchor (places within the text), anchor hash, context hash.

    Contexts whose anchor hash is in hot are given as their strings, each with a hash of its own for the anchor's.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    data = np.frombuffer(b"".join(texts) + b"\0" * (least + 64), np.uint8)
    n = int(ends[-1]) if len(ends) else 0
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none, none, none.astype(U), none.astype(U)
    w8 = words_at(data)
    h = w8[:n] * _C[0]
    for k in range(8, GRAM, 8):
        h ^= w8[k : n + k]
        h *= _C[k // 8 % 4]
        h ^= h >> U(32)
    # The upper half is the hash, the lower the place, so that ties go to the first.
    keyed = (h & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=U)
    at = (window_min(keyed, least - GRAM + 1) & U(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(n + 1, np.int32)
    long = lengths >= least
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - least + 1, -1)
    s = np.flatnonzero(np.cumsum(valid[: len(at)]) > 0)
    if not len(s):
        return none, none, none, none, none.astype(U), none.astype(U)
    a = at[s]
    text = np.searchsorted(ends, s, side="right")
    cut = np.flatnonzero((a[1:] != a[:-1]) | (text[1:] != text[:-1]) | (s[1:] != s[:-1] + 1)) + 1
    lo, hi = s[np.concatenate([[0], cut])], s[np.concatenate([cut - 1, [len(s) - 1]])]
    a, text = a[np.concatenate([[0], cut])], text[np.concatenate([[0], cut])]
    anchor = mixed(h[a])
    if hot is not None and len(hot) and (cut := np.isin(anchor, hot)).any():
        n = np.where(cut, hi - lo + 1, 1)
        of = np.repeat(np.arange(len(n)), n)
        lo, hi, a, text, anchor, cut = lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), hi[of], a[of], text[of], anchor[of], cut[of]
        hi[cut] = lo[cut]
        anchor[cut] = mixed(anchor[cut] ^ (hash_at(w8, lo[cut], least) * _C[2]))
    context = mixed(hash_at(w8, lo, least) ^ (hash_at(w8, hi, least) * _C[1]) ^ ((hi - lo).astype(U) << U(32)) ^ (a - lo).astype(U) * _C[3])
    begin = starts[text]
    return text, lo - begin, hi - lo, a - begin, anchor, context


def pack(place, back, more):
    return (place.astype(np.int64) << 16) | (back.astype(np.int64) << 8) | more.astype(np.int64)


def unpack(p: np.ndarray):
    return p >> 16, (p >> 8) & 0xFF, p & 0xFF


def spans(row: np.ndarray, lo: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Rows (row, spans): the joined ranges of each text, as pairs of 32-bit numbers."""
    order = np.lexsort((lo, row))
    row, lo, end = row[order], lo[order], end[order]
    out = ([], [])
    if len(row):
        first = np.concatenate([[True], row[1:] != row[:-1]])
        group = np.cumsum(first) - 1
        # A running maximum of ends within each text, by lifting each text above the one before.
        lift = group * (1 << 33)
        reach = np.maximum.accumulate(end + lift)
        new = np.concatenate([[True], (lo + lift)[1:] > reach[:-1]])
        at = np.flatnonzero(new)
        stop = reach[np.concatenate([at[1:] - 1, [len(row) - 1]])] - lift[at]
        pairs = np.stack([lo[at], stop], 1).astype("<u4")
        heads = np.flatnonzero(first[at])
        for g, (i, j) in enumerate(zip(heads, np.concatenate([heads[1:], [len(at)]]), strict=True)):
            del g
            out[0].append(int(row[at[i]]))
            out[1].append(pairs[i:j].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], ["row", "spans"])


def _batches(batches, least: int, chunk: int):
    """(ids, rows, places of the stretches in their texts, stretches as bytes) of bounded size."""
    held, size = ([], [], [], []), 0

    def ready():
        return (*(np.array(x, np.int64) for x in held[:3]), held[3])

    for batch in batches:
        for i, row, t in zip(batch.column("id").to_pylist(), batch.column("row").to_pylist(), batch.column("text"), strict=True):
            t = t.as_py()
            data = t.encode("utf-8", "surrogatepass") if t else b""
            for at in range(0, max(1, len(data) - least + 1), chunk):
                stretch = data if len(data) < chunk + least else data[at : at + chunk + least - 1]
                for values, x in zip(held, (i, row, at, stretch), strict=True):
                    values.append(x)
                size += len(stretch)
                if size >= chunk:
                    yield ready()
                    held, size = ([], [], [], []), 0
    if held[0]:
        yield ready()


ROWS = ["anchor", "context", "doc", "row", "packed", "spans"]
ROWS_SCHEMA = "anchor long, context long, doc long, row long, packed long, spans binary"


def _rows(anchor, context, doc, row, packed):
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (anchor, context, doc, row, packed)), pa.nulls(len(row), pa.binary())], ROWS)


def _found(s: pa.RecordBatch):
    null = pa.nulls(s.num_rows, pa.int64())
    return pa.RecordBatch.from_arrays([null, null, null, s.column("row"), null, s.column("spans")], ROWS)


def _anchor_counts(least: int, chunk: int):
    """Rows (anchor, n): contexts that differ, of the texts at hand."""

    def run(batches):
        for *_, texts in _batches(batches, least, chunk):
            _, _, _, _, h, c = anchors(texts, least)
            order = np.lexsort((c, h))
            h, c = h[order], c[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])[: len(h)]
            found, n = np.unique(h[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["anchor", "n"])

    return run


def hot_anchors(rows: DataFrame, least: int, chunk: int = CHUNK) -> np.ndarray:
    """Hashes of the anchors that have more than about HOT contexts, MOST_HOT at most."""
    part = rows.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0)
    counts = part.mapInArrow(_anchor_counts(least, chunk), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    hot = counts.where(F.col("n") > HOT // SAMPLE).orderBy(F.col("n").desc(), "anchor").limit(MOST_HOT).select("anchor")
    return np.array([r["anchor"] for r in hot.collect()], np.int64).view(U)


def _emit(least: int, hot: np.ndarray, chunk: int):
    """Anchors, one for each context of the texts at hand, and the ranges of the contexts that repeat there."""

    def run(batches):
        for ids, rows, bases, texts in _batches(batches, least, chunk):
            text, lo, more, a, h, c = anchors(texts, least, hot)
            if not len(text):
                continue
            doc, row, base = ids[text], rows[text], bases[text]
            lo, a = lo + base, a + base
            packed = pack(a, a - lo, more)
            order = np.lexsort((packed, row, doc, c))
            h, c, doc, row, packed, lo, more = (x[order] for x in (h, c, doc, row, packed, lo, more))
            new = np.concatenate([[True], (c[1:] != c[:-1]) | (h[1:] != h[:-1])])
            later = ~new
            if later.any():
                yield _found(spans(row[later], lo[later], lo[later] + more[later] + least))
            yield _rows(h[new].view(np.int64), c[new].view(np.int64), doc[new], row[new], packed[new])

    return run


def _meet(least: int):
    """Ranges of contexts that repeat, and the contexts that need their text (anchor, doc, row, packed; context = 1)."""

    def run(batches):
        parts = []
        for batch in batches:
            done = pc.is_null(batch.column("anchor"))
            ready = batch.filter(done)
            if ready.num_rows:
                yield ready
            mine = batch.filter(pc.invert(done))
            # 40 bytes a row, for the partition at hand.
            parts.append([mine.column(k).to_numpy(zero_copy_only=False) for k in ROWS[:5]])
        if not parts:
            return
        h, c, doc, row, packed = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        if not len(h):
            return
        order = np.argsort(h, kind="stable")
        sorted_h = h[order]
        same = sorted_h[1:] == sorted_h[:-1]
        use = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        h, c, doc, row, packed = h[use], c[use], doc[use], row[use], packed[use]
        if not len(h):
            return
        order = np.lexsort((packed, row, doc, c, h))
        h, c, doc, row, packed = (x[order] for x in (h, c, doc, row, packed))
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new = new_h | np.concatenate([[True], c[1:] != c[:-1]])
        later = ~new
        if later.any():
            place, back, more = unpack(packed[later])
            lo = place - back
            yield _found(spans(row[later], lo, lo + more + least))
        group = np.cumsum(new_h) - 1
        several = np.bincount(group, new)[group] > 1
        need = several & new
        if need.any():
            yield _rows(h[need], np.ones(need.sum(), np.int64), doc[need], row[need], packed[need])

    return run


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Order of the suffixes by their first `depth` bytes, then by place; and ranks by the first 8, 16, ... bytes."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = words_at(padded)[:n].byteswap()
    # Up to four bytes the bytes themselves do for a rank.
    levels, span = [(k, (key >> U(64 - 8 * k)).astype(np.uint32)) for k in (1, 2, 4)], 8

    def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable").astype(np.int32)
        k = key[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(np.concatenate([[False], k[1:] != k[:-1]]), dtype=np.int32)
        return order, rank

    order, rank = ranked(key)
    levels.append((8, rank))
    while span < depth:
        step = min(span, depth - span)
        key = rank * np.int64(n + 1)
        if step < n:
            key[: n - step] += rank[step:]
            key[: n - step] += 1
        order, rank = ranked(key)
        span += step
        levels.append((span, rank))
    return order, levels


def neighbours(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in suffix order, the nearest place before and after it whose suffix starts earlier; -1 if none."""

    def smaller(o: np.ndarray) -> np.ndarray:
        at = np.arange(-1, len(o) - 1, dtype=np.int32)
        while True:
            go = np.flatnonzero((at >= 0) & (o[np.maximum(at, 0)] > o))
            if not len(go):
                return at
            at[go] = at[at[go]]

    before = smaller(order)
    after = smaller(order[::-1])[::-1]
    return before, np.where(after < 0, -1, len(order) - 1 - after)


def previous_factor(text: np.ndarray, depth: int, starts: np.ndarray | None = None) -> np.ndarray:
    """For each place, the length of the longest string there that also starts earlier, up to depth. starts: the only places that count, as booleans."""
    order, levels = suffix_array(text, depth)
    if starts is not None:
        order = order[starts[order]]
    out = np.zeros(len(text), np.int64)
    for other in neighbours(order):
        use = other >= 0
        i, j = order[use], order[other[use]]
        length = np.zeros(len(i), np.int64)
        # Whole ranks from long to short: the common length is a sum of spans.
        for span, rank in reversed(levels):
            fits = (i + length + span <= len(text)) & (j + length + span <= len(text)) & (length + span <= depth)
            equal = np.zeros(len(i), bool)
            equal[fits] = rank[(i + length)[fits]] == rank[(j + length)[fits]]
            length[equal] += span
        out[i] = np.maximum(out[i], length)
    return out


def _factors(least: int, size_of_array: int):
    """Rows (anchor, doc, row, packed, piece), sorted by anchor: the repeats among them."""

    def found(rows):
        rows.sort(key=lambda r: r[1:4])
        text = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        number = np.array([r[2] for r in rows], np.int64)
        place, back, more = unpack(np.array([r[3] for r in rows], np.int64))
        begin = np.concatenate([[0], np.cumsum([len(r[4]) for r in rows])[:-1]])
        n = more + 1
        row = np.repeat(np.arange(len(rows)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # Only strings inside a context count, not those across two.
        inside = np.zeros(len(text), bool)
        inside[begin[row] + within] = True
        factor = previous_factor(text, least, inside)
        hit = factor[begin[row] + within] >= least
        row, within = row[hit], within[hit]
        lo = (place - back)[row] + within
        return spans(number[row], lo, lo + least)

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "row", "packed", "piece")), strict=True):
                if size >= size_of_array and r[0] != last:
                    yield found(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
                last = r[0]
        if held:
            yield found(held)

    return run


def compared(rows: DataFrame, least: int, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Ranges that go, found without text (row, spans); and the contexts that need a suffix array (anchor, doc, row, packed, piece)."""
    emitted = rows.mapInArrow(_emit(least, hot_anchors(rows, least, chunk), chunk), ROWS_SCHEMA)
    dealt = dealt_by(emitted, text_bytes(rows), F.when(F.col("anchor").isNotNull(), F.col("anchor")).otherwise(F.xxhash64("row", "spans")))
    met = materialize(dealt.mapInArrow(_meet(least), ROWS_SCHEMA), "repeats")
    done = met.where("anchor IS NULL").select("row", "spans")
    # Text is fetched for the places of a row all at once; the wanted places of one are bounded by its length.
    wanted = met.where("anchor IS NOT NULL").groupBy(F.col("row").alias("w")).agg(F.collect_list(F.struct("anchor", "packed")).alias("places"))

    def cut(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(first, ROWS_AT_ONCE)
                places = batch.column("places")
                n = pc.list_value_length(places).to_numpy(zero_copy_only=False).astype(np.int64)
                anchor, packed = (places.flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                of = np.repeat(np.arange(len(n)), n)
                place, back, more = unpack(packed)
                starts, ends = (place - back).tolist(), (place - back + more + least).tolist()
                texts = [t.as_py().encode("utf-8", "surrogatepass") for t in batch.column("text")]
                pieces = [texts[k][s:e] for k, s, e in zip(of.tolist(), starts, ends, strict=True)]
                doc, row = (batch.column(c).to_numpy(zero_copy_only=False)[of] for c in ("id", "row"))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (anchor, doc, row, packed)), pa.array(pieces, pa.binary())], ["anchor", "doc", "row", "packed", "piece"])

    # The wanted places are few and small against the texts: a shuffled hash join needs no sort of the texts.
    fetched = rows.join(wanted.hint("shuffle_hash"), rows["row"] == wanted["w"]).select("id", "row", "text", "places")
    return done, fetched.mapInArrow(cut, "anchor long, doc long, row long, packed long, piece binary")


def repeated_spans(rows: DataFrame, least: int = 100, chunk: int = CHUNK, suffixes: int = SUFFIXES) -> DataFrame:
    """row, spans: all ranges that go, of each text that loses something (binary pairs; several rows may come for a text). rows: (id, row, text), written."""
    done, pieces = compared(rows, least, chunk)
    factors = pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_factors(least, suffixes), "row long, spans binary")
    return done.union(factors)


def remove_repeats(docs: DataFrame, least: int = 100, id_col: str = "doc_id", text_col: str = "text", keep: tuple = (), chunk: int = CHUNK, suffixes: int = SUFFIXES) -> DataFrame:
    """id, kept columns, n_bytes, n_removed, n_spans, kept_sha256, kept_text for each row.

    kept_text is the remaining text; characters that are cut in two stay whole in it.
    """
    numbered = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.col(text_col).alias("text"), F.col(id_col).isNull().alias("no_id"), *[F.col(k).alias(f"k_{k}") for k in keep])
    rows = materialize(numbered.withColumn("row", F.monotonically_increasing_id()), "rows")
    gone = materialize(repeated_spans(rows.select("id", "row", "text"), least, chunk, suffixes), "spans").groupBy(F.col("row").alias("g")).agg(F.collect_list("spans").alias("gone"))
    joined = rows.withColumnRenamed("text", "t_in").join(gone.hint("shuffle_hash"), F.col("row") == F.col("g"), "left").drop("g", "row")
    kept = [f"k_{k}" for k in keep]

    def run(batches):
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            out = ([], [], [], [], [])
            for t, gone in zip(batch.column("t_in").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                data = t.encode("utf-8", "surrogatepass") if t else b""
                mask, n_spans = np.ones(len(data), bool), 0
                if gone:
                    mine = [np.frombuffer(g, "<u4").reshape(-1, 2) for g in gone]
                    steps = np.zeros(len(data) + 1, np.int64)
                    for s in mine:
                        np.add.at(steps, np.minimum(s[:, 0], len(data)), 1)
                        np.add.at(steps, np.minimum(s[:, 1], len(data)), -1)
                    mask = np.cumsum(steps[:-1]) == 0
                    n_spans = int(np.count_nonzero(~mask[:1]) + np.count_nonzero(mask[:-1] & ~mask[1:]))
                raw = np.frombuffer(data, np.uint8)
                left = raw[mask].tobytes()
                out[0].append(len(data))
                out[1].append(len(data) - len(left))
                out[2].append(n_spans)
                out[3].append(hashlib.sha256(left).hexdigest())
                if n_spans and len(left):
                    begins = (raw & 0xC0) != 0x80
                    letter = np.cumsum(begins) - 1
                    whole = np.zeros(int(letter[-1]) + 1, bool)
                    whole[letter[mask]] = True
                    left = raw[whole[letter]].tobytes()
                out[4].append(None if t is None else left.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "no_id", *kept)), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.string())],
                ["id", "no_id", *kept, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
            )

    order = ["id", "no_id", *kept]
    types = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    fields = ", ".join(f"`{c}` {types[c]}" for c in order)
    out = joined.mapInArrow(run, f"{fields}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias(id_col), *[F.col(f"k_{k}").alias(k) for k in keep], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def op1_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")
