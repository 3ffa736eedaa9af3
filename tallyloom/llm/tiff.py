"""TIFF as a media column: write pages, walk image directories, decode strips and tiles.

The reader follows the chain of image directories of either byte order, decodes
PackBits, LZW, deflate or plain strips and tiles, undoes the horizontal predictor, and
gives one row for each page with its samples in row order. The writer makes 8-bit
pages, in strips or tiles, with any of these codings.

A null media value, or bytes that aren't TIFF, give no row. A file that is damaged, or has what isn't read here, gives the pages
before the damage and a row with no page and the error. Repeated rows give pages each. An empty table gives an empty result.
Pages are decoded one at a time; `most_bytes` bounds those of files from elsewhere, where a damaged size could ask for any memory. The query over
texts sets no bound and fails on a file that it cannot read back, so no text loses its row; a text is one row of Spark, of 2 GB at most. Other columns
of the input, whatever their names, have no effect.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH_TAG, HEIGHT_TAG, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
#: Bytes of a decoded page, above which a file from elsewhere is taken for damaged.
MOST_BYTES = 1 << 30
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def packbits_decode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += 2 + c
        else:
            if c > 128:
                out += data[i + 1 : i + 2] * (257 - c)
            i += 2 if c > 128 else 1
    return bytes(out)


#: Three equal bytes or more.
RUNS = re.compile(rb"(.)\1\1+", re.DOTALL)


def packbits_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(stop: int) -> None:
        for p in range(at, stop, 128):
            q = min(p + 128, stop)
            out.append(q - p - 1)
            out.extend(data[p:q])

    for run in RUNS.finditer(data):
        literal(run.start())
        n, byte = run.end() - run.start(), data[run.start()]
        for p in range(0, n, 128):
            k = min(128, n - p)
            out.extend((257 - k, byte) if k > 1 else (0, byte))
        at = run.end()
    literal(len(data))
    return bytes(out)


CLEAR, END, FREE = 256, 257, 258
#: LZW tables are cleared before this code is given.
FULL = 4095
#: Bits of the codes that follow a clearing: widths grow one code early. Later codes have 12.
WIDTHS = np.searchsorted([(1 << w) - FREE for w in (9, 10, 11)], np.arange(FULL), side="right") + 9
BITS_UNTIL = np.cumsum(WIDTHS)
BASE_WORDS = [bytes([i]) for i in range(256)] + [b"", b""]


def _words_of(codes: list[int], words: list[bytes], last: bytes | None, out: list[bytes]) -> bytes | None:
    """Append the codes' words to out and what they define to words; gives the last word."""
    if codes and last is None:
        last = words[codes[0]]
        out.append(last)
        codes = codes[1:]
    for code in codes:
        word = words[code] if code < len(words) else last + last[:1]
        words.append(last + word[:1])
        out.append(word)
        last = word
    return last


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends. The codes up to the next clearing are cut out together."""
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int32)
    at, total, out = 0, 8 * len(data), []
    words, last, fresh = list(BASE_WORDS), None, True
    while True:
        ends = BITS_UNTIL if fresh else 12 * np.arange(1, FULL + 1)
        n = int(np.searchsorted(ends, total - at, side="right"))
        if not n:
            break
        widths = WIDTHS[:n] if fresh else np.full(n, 12)
        first = at + ends[:n] - widths
        k = first >> 3
        codes = (raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) >> (24 - widths - (first & 7)) & ((1 << widths) - 1)
        marks = np.flatnonzero((codes == CLEAR) | (codes == END))
        stop = int(marks[0]) if len(marks) else n
        last = _words_of(codes[:stop].tolist(), words, last, out)
        if stop < n and codes[stop] == END:
            break
        at, fresh = at + int(ends[min(stop, n - 1)]), stop < n
        if fresh:
            words, last = list(BASE_WORDS), None
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes, known, free = [CLEAR], {}, FREE
    word = data[0] if data else None
    for byte in data[1:]:
        longer = word << 8 | byte
        code = known.get(longer)
        if code is not None:
            word = code
            continue
        codes.append(word)
        known[longer] = free
        free += 1
        if free == FULL:
            codes.append(CLEAR)
            known.clear()
            free = FREE
        word = byte
    codes += [END] if word is None else [word, END]
    # The width of a code goes by its place after the last clearing; each code falls on three bytes at most.
    c, place = np.array(codes), np.arange(len(codes))
    clears = np.flatnonzero(c == CLEAR)
    before = np.searchsorted(clears, place)
    widths = WIDTHS[np.where(before > 0, place - clears[before - 1] - 1, 0)]
    ends = np.cumsum(widths)
    first = ends - widths
    shifted, k = c << (24 - widths - (first & 7)), first >> 3
    parts = np.concatenate([shifted >> 16, shifted >> 8 & 255, shifted & 255])
    packed = np.bincount(np.concatenate([k, k + 1, k + 2]), weights=parts, minlength=len(data) + 3)
    return packed[: -(-int(ends[-1]) // 8)].astype(np.uint8).tobytes()


def _coded(block: np.ndarray, compression: int, predictor: int) -> bytes:
    """block: rows x width x samples."""
    if predictor == 2:
        moved = block.copy()
        moved[:, 1:] -= block[:, :-1]
        block = moved
    data = block.tobytes()
    if compression == DEFLATE:
        return zlib.compress(data, 1)
    if compression == LZW:
        return lzw_encode(data)
    if compression == PACKBITS:
        return b"".join(packbits_encode(row.tobytes()) for row in block)
    return data


def encode_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, strip_rows: int = 64, tile: tuple[int, int] | None = None) -> bytes:
    """pages: arrays of rows x width x samples, 8 bits each. tile: (height, width), multiples of 16."""
    out = bytearray(b"II*\x00\x00\x00\x00\x00")
    link = 4
    for page in pages:
        rows, width, samples = page.shape
        if tile:
            th, tw = tile
            full = np.zeros((-(-rows // th) * th, -(-width // tw) * tw, samples), np.uint8)
            full[:rows, :width] = page
            blocks = [full[y : y + th, x : x + tw] for y in range(0, full.shape[0], th) for x in range(0, full.shape[1], tw)]
        else:
            blocks = [page[y : y + strip_rows] for y in range(0, rows, strip_rows)]
        offsets, counts = [], []
        for b in blocks:
            data = _coded(b, compression, predictor)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        tags = {
            WIDTH_TAG: (4, [width]), HEIGHT_TAG: (4, [rows]), BITS: (3, [8] * samples), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [2 if samples == 3 else 1]),
            SAMPLES: (3, [samples]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor]),
        }
        tags |= {TILE_WIDTH: (4, [tile[1]]), TILE_HEIGHT: (4, [tile[0]]), TILE_OFFSETS: (4, offsets), TILE_BYTES: (4, counts)} if tile else {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [strip_rows]), STRIP_BYTES: (4, counts)}
        entries = []
        for tag, (kind, values) in sorted(tags.items()):
            raw = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                entries.append(struct.pack("<HHII", tag, kind, len(values), len(out)))
                out += raw
            else:
                entries.append(struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes):
    """Tag values of each image directory in turn; a chain that loops ends."""
    if data[:4] not in (b"II*\x00", b"MM\x00*"):
        return
    e = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(e + "I", data, 4)
    seen = set()
    while at and at not in seen and at + 2 <= len(data):
        seen.add(at)
        (n,) = struct.unpack_from(e + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(e + "HHI", data, at + 2 + 12 * k)
            size = SIZES.get(kind, 1) * count
            place = at + 10 + 12 * k
            if size > 4:
                (place,) = struct.unpack_from(e + "I", data, place)
            form = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}.get(kind)
            tags[tag] = struct.unpack_from(f"{e}{count}{form}", data, place) if form else data[place : place + size]
        yield tags
        (at,) = struct.unpack_from(e + "I", data, at + 2 + 12 * n)


def decode_page(data: bytes, tags: dict, most_bytes: int | None = MOST_BYTES) -> np.ndarray:
    """rows x width x samples. A page of over most_bytes is an error; None: any size."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, rows, samples = one(WIDTH_TAG, 0), one(HEIGHT_TAG, 0), one(SAMPLES, 1)
    if set(tags.get(BITS, (1,))) != {8} or one(PLANAR, 1) != 1:
        raise ValueError("only 8-bit samples in one plane are read")
    compression, predictor = one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
    if most_bytes is not None and rows * width * samples > most_bytes:
        raise ValueError(f"a page of {rows} x {width} x {samples} samples")
    page = np.zeros((rows, width, samples), np.uint8)
    if TILE_OFFSETS in tags:
        th, tw, offsets, counts = one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0), tags[TILE_OFFSETS], tags[TILE_BYTES]
        across = -(-width // tw)
        places = [(k // across * th, k % across * tw, th, tw) for k in range(len(offsets))]
    else:
        deep, offsets, counts = min(one(ROWS_PER_STRIP, rows), rows), tags[STRIP_OFFSETS], tags[STRIP_BYTES]
        places = [(k * deep, 0, min(deep, rows - k * deep), width) for k in range(len(offsets))]
    for (y, x, h, w), at, n in zip(places, offsets, counts, strict=True):
        block = data[at : at + n]
        if compression in (DEFLATE, OLD_DEFLATE):
            block = zlib.decompress(block)
        elif compression == LZW:
            block = lzw_decode(block)
        elif compression == PACKBITS:
            block = packbits_decode(block)
        elif compression != PLAIN:
            raise ValueError(f"compression {compression} isn't read")
        a = np.frombuffer(block, np.uint8, h * w * samples).reshape(h, w, samples)
        if predictor == 2:
            a = np.cumsum(a, axis=1, dtype=np.uint8)
        page[y : y + h, x : x + w] = a[: rows - y, : width - x]
    return page


PAGES_SCHEMA = "id long, n_bytes long, media_bytes long, media_sha256 string, page int, width int, height int, samples int, compression int, pixels binary, error string"


def read_pages(media: DataFrame, id_col: str = "id", media_col: str = "media", most_bytes: int | None = MOST_BYTES) -> DataFrame:
    """One row for each page of each TIFF (PAGES_SCHEMA). n_bytes is passed on from media, where it has that column."""

    def run(batches):
        for batch in batches:
            for i, n, data in zip(*(batch.column(c).to_pylist() for c in ("id", "n_bytes", "media")), strict=True):
                if data is None:
                    continue
                own = {"id": i, "n_bytes": n, "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
                try:
                    for k, tags in enumerate(directories(data)):
                        a = decode_page(data, tags, most_bytes)
                        page = {"page": k, "width": a.shape[1], "height": a.shape[0], "samples": a.shape[2], "compression": tags.get(COMPRESSION, (1,))[0], "pixels": a.tobytes()}
                        yield pa.RecordBatch.from_pylist([own | page], PAGES_ARROW)
                except (struct.error, zlib.error, ValueError, LookupError, TypeError, ArithmeticError, MemoryError) as e:
                    yield pa.RecordBatch.from_pylist([own | {"error": f"{type(e).__name__}: {e}"}], PAGES_ARROW)

    n_bytes = F.col("n_bytes").cast("long") if "n_bytes" in media.columns else F.lit(None).cast("long")
    return media.select(F.col(id_col).cast("long").alias("id"), n_bytes.alias("n_bytes"), F.col(media_col).alias("media")).mapInArrow(run, PAGES_SCHEMA)


PAGES_ARROW = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("compression", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())])
UNIT = 576
WIDTH, PLANES = 64, 3
#: Ways to store a text's page.
FORMS = (
    {"compression": DEFLATE, "predictor": 1, "strip_rows": 341},
    {"compression": DEFLATE, "predictor": 2, "tile": (64, 64)},
    {"compression": LZW, "predictor": 1, "strip_rows": 64},
    {"compression": PACKBITS, "predictor": 1, "tile": (16, 64)},
    {"compression": LZW, "predictor": 2, "tile": (32, 32)},
)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: each text, filled up with bytes 255 to a multiple of 576, as one RGB page of 64 samples' width, in one of FORMS by the text's checksum."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            for at in range(0, len(ids), 256):
                media, sizes = [], []
                for t in texts[at : at + 256]:
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    sizes.append(len(raw))
                    full = raw + b"\xff" * (UNIT - len(raw) % UNIT if len(raw) % UNIT or not raw else 0)
                    page = np.frombuffer(full, np.uint8).reshape(-1, WIDTH, PLANES)
                    media.append(encode_tiff([page], **FORMS[zlib.crc32(full) % len(FORMS)]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 256], pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_bytes long, media binary")


def _features(batches):
    for batch in batches:
        features, tails = [], []
        for pixels, w, h, c in zip(*(batch.column(x).to_pylist() for x in ("pixels", "width", "height", "samples")), strict=True):
            a = np.frombuffer(pixels, np.uint8)
            n = np.bincount(a, minlength=256)
            mean = int(n @ np.arange(256)) * 1000 // max(1, len(a))
            coarse = n.reshape(16, 16).sum(1) * 255 // max(1, len(a))
            features.append(f"{w}x{h}x{c};mean={mean};seen={np.count_nonzero(n)};" + bytes(coarse.astype(np.uint8)).hex())
            tails.append(zlib.crc32(pixels[-32:]))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(x) for x in ("id", "n_bytes", "media_bytes", "media_sha256")), pa.array([len(p) for p in batch.column("pixels").to_pylist()], pa.int64()),
             pa.array([hashlib.sha256(p).hexdigest() for p in batch.column("pixels").to_pylist()]), pa.array(tails, pa.int64()), pa.array(features, pa.string())],
            ["doc_id", "n_bytes", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "feature"],
        )


def text_pages(docs: DataFrame) -> DataFrame:
    """The pages of texts, written and read back; the job fails if one of them isn't read."""
    pages = read_pages(text_media(docs), most_bytes=None)
    failed = F.raise_error(F.concat(F.lit("a page was not read back: "), F.col("error")))
    return pages.withColumn("pixels", F.when(F.col("error").isNull(), F.col("pixels")).otherwise(failed.cast("binary")))


def op7_media_columns(spark, sf_dir):
    pages = text_pages(table(spark, sf_dir, "documents"))
    out = pages.mapInArrow(_features, "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
