"""Each operator against a brute-force version on a small table with nulls, empty and long texts, copies and clashing column names."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import common, components, fingerprints, mixing, ngram_join, packing, suffix_dedup, tiff, token_counts, toxicity, url_filter, warc
from tallyloom.llm.common import shared_dir

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, id long, tokens string, size long, y int"


def make(seed=1, n=120):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "Straße", "été", "word", "Data", "x1", "don't", "日本", "end.", "a,b", "<|endoftext|>", *("w%d" % i for i in range(300))]
    texts = []
    for i in range(n):
        k = rnd.random()
        if k < 0.15 and texts:
            texts.append(rnd.choice(texts))
        elif k < 0.45 and texts:
            w = (rnd.choice(texts) or "").split(" ")
            for _ in range(rnd.randint(1, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 5, 40, 200, 900]))))
    texts += ["", None, "   ", "\n\t", "one", "one two", "ONE TWO", "a  b\n\n c", "z" * 5000, "ab " * 3000]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en" if i % 3 else None, ["a", "b", "c", None][i % 4], 0, 1, 2, "t", 3, 4) for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that repeat altogether, an id with two texts, and null ids."""
    long = "passage " * 40
    return spark.createDataFrame([(5, long, "en", "s", 1, 0, 0, "", 0, 0), (5, long, "en", "s", 1, 0, 0, "", 0, 0), (6, "other words here", None, None, None, 0, 0, "", 0, 0), (6, "two texts of one id", None, None, None, 0, 0, "", 0, 0), (None, long, None, None, None, 0, 0, "", 0, 0), (None, None, None, None, None, 0, 0, "", 0, 0)], SCHEMA)


def removed(rows, least=100):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        keep = np.ones(len(b), bool)
        for s in range(len(b) - least + 1):
            w = b[s : s + least]
            if w in seen:
                keep[s : s + least] = False
            seen.add(w)
        left = np.frombuffer(b, np.uint8)[keep].tobytes()
        out[i] = (len(b), len(b) - len(left), int((~keep[:1]).sum() + (keep[:-1] & ~keep[1:]).sum()), hashlib.sha256(left).hexdigest())
    return out


def test_previous_factor():
    rng = np.random.default_rng(1)
    for n in (1, 2, 9, 300):
        x = rng.integers(97, 99, n).astype(np.uint8)
        b, got = x.tobytes(), suffix_dedup.previous_factor(x, 20)
        for i in range(n):
            best = max((next((k for k in range(20) if i + k >= n or b[i + k] != b[j + k]), 20) for j in range(i)), default=0)
            assert got[i] == best


def test_suffix_dedup(spark, docs, rows, empty, odd):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == removed(rows)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    out = suffix_dedup.remove_repeats(odd).collect()
    assert len(out) == 6 and sorted((r["doc_id"] or -1, r["n_removed"]) for r in out)[:2] == [(-1, 0), (-1, 320)]


def test_suffix_dedup_in_stretches(docs, rows):
    """Stretches far shorter than the texts, and many suffix arrays."""
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs, chunk=150, suffixes=2000).collect()}
    assert got == removed(rows)


def test_suffix_dedup_of_null_and_shared_ids(spark):
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = text(150)
    # So many null ids that a few bits don't tell their texts apart; copies at the same place and at others.
    rows = [(None, text(300) + passage + str(k)) for k in range(600)]
    rows += [(None, rows[0][1])] * 2 + [(7, text(400))] * 2 + [(7, passage + text(50)), (8, text(200))]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # The texts in the order of (id, row), each under a number of its own.
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    want = removed([(k, rows[k][1]) for k in order])
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == collections.Counter((rows[k][0], *v) for k, v in want.items())
    assert sum(r["n_removed"] == r["n_bytes"] for r in got) == 3


def test_suffix_dedup_of_a_line_between_many_neighbours(spark, monkeypatch):
    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    line, ends = text(70), [text(60) for _ in range(4)]
    rows = [(k, text(120) + line + (ends[k % 4] if k % 3 == 0 else "") + text(120)) for k in range(300)]
    rows += [(300 + k, rows[7 * k][1][60 + k : 260]) for k in range(20)]
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 1)
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == removed(rows)
    numbered = spark.createDataFrame([(k, k, t) for k, t in rows], "id long, row long, text string")
    assert len(suffix_dedup.hot_anchors(numbered, 100)) > 0
    # No anchor brings more contexts to one suffix array.
    assert suffix_dedup.compared(numbered, 100)[1].groupBy("anchor").count().agg(F.max("count")).first()[0] <= 20


def components_of(rows, words, num, den):
    h = ngram_join.WordHashes()
    sets = [(i, frozenset(ngram_join.shingle_set(t, h, words).tolist())) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = collections.Counter()
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and den * len(x & y) >= num * len(x | y):
                links[i] += 1
                links[j] += 1
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return {i: (len(x), root(i), links[i]) for i, x in sets}


@pytest.mark.parametrize("words, num, den", [(3, 90, 100), (5, 80, 100), (1, 60, 100)])
def test_ngram_join(docs, rows, words, num, den):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.jaccard_components(docs, words, num, den).collect()}
    assert got == components_of(rows, words, num, den)


def test_ngram_join_in_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 200)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.jaccard_components(docs, 1, 60, 100).collect()}
    assert got == components_of(rows, 1, 60, 100)


def test_ngram_join_edges(empty, odd):
    assert ngram_join.jaccard_components(empty).count() == 0
    out = sorted(((r["doc_id"] or -1, r["component_id"]) for r in ngram_join.jaccard_components(odd).collect()), key=str)
    assert out == [(-1, 5), (-1, None), (5, 5), (5, 5), (6, 6), (6, 6)]


def test_ngram_join_of_null_and_shared_ids(spark):
    a = ["w%d" % i for i in range(60)]
    near = lambda *at: " ".join("x" + w if i in at else w for i, w in enumerate(a))
    other = lambda k: " ".join(f"{k}v{i}" for i in range(60))
    # Near copies of one another: of a null id, of id 5 twice, of id 6. Texts of id 5 and null ids that are near to none or to one another only.
    texts = [(None, near(1)), (5, near()), (5, near()), (6, near(58)), (5, other(1)), (None, other(2)), (None, other(2) + " tail"), (6, other(3))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = sorted(((t, r["n_links"], r["component_id"]) for r, t in ((r, r["doc_id"]) for r in ngram_join.jaccard_components(docs, 1, 80, 100).collect())), key=str)
    want = components_of(list(enumerate(t for _, t in texts)), 1, 80, 100)
    least = collections.defaultdict(list)
    for k, (_, root, _) in want.items():
        least[root].append(texts[k][0])
    head = {root: min((i for i in ids if i is not None), default=None) for root, ids in least.items()}
    assert got == sorted(((texts[k][0], links, head[root]) for k, (_, root, links) in want.items()), key=str)


def test_tree_join_equals_pairs():
    """Roots and counts of links against all pairs, and memory that grows with the sets where all link with all."""
    import tracemalloc

    rnd = random.Random(3)
    for trial in range(60):
        seeds = [rnd.sample(range(60), rnd.randint(1, 25)) for _ in range(3)]
        sets = sorted({tuple(sorted(set(rnd.choice(seeds)) ^ {rnd.randrange(70) for _ in range(rnd.randint(0, 3))})) for _ in range(rnd.randint(2, 40))} - {()})
        if len(sets) < 2:
            continue
        copies = np.array([rnd.randint(1, 4) for _ in sets])
        blocks = [0, 1, *(rnd.randint(0, 1) for _ in sets[2:])] if trial % 2 else None
        num, den = rnd.choice([(90, 100), (80, 100), (1, 2)])
        root, links = ngram_join.tree_join([np.array(s, np.uint64) for s in sets], copies, blocks, num, den)
        want, group = [0] * len(sets), list(range(len(sets)))
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                same = len(set(a) & set(b))
                if i != j and (blocks is None or blocks[i] != blocks[j]) and den * same >= num * (len(a) + len(b) - same):
                    want[i] += copies[j]
                    group = [group[i] if g == group[j] else g for g in group]
        assert links.tolist() == want
        assert len(set(zip(root.tolist(), group, strict=True))) == len(set(root.tolist())) == len(set(group))
    peaks = []
    for n in (1000, 4000):
        alike = [np.append(np.arange(22, dtype=np.uint64), np.uint64(100 + k)) for k in range(n)]
        tracemalloc.start()
        root, links = ngram_join.tree_join(alike, np.ones(n, np.int64), None, 90, 100)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert set(links.tolist()) == {n - 1} and len(set(root.tolist())) == 1
    assert peaks[1] < 8 * peaks[0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (300, 200)] + [(1000 + i, 900) for i in range(50)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[300] == 100 and got[1049] == 900
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 1500 + "</p>"
    pages = spark.createDataFrame([(1, "http://a/1", big), (2, "http://a/2", big), (3, "http://a/\n3", big), (4, None, "small\r\n\r\nWARC/1.1"), (5, "u", "small\r\n\r\nWARC/1.1"), (6, "u", None), (7, "u", ""), (3, "u", big), (None, "u", big)], "page_id long, url string, html string")
    path = shared_dir(spark, "test-warc")
    warc.write_archives(pages, path)
    records = warc.read_archives(spark, path)
    assert records.count() == 27 and records.where("payload_digest <> declared_digest AND type = 'response'").count() == 0
    whole = warc.assemble(records)
    assert whole.where("request IS NULL OR metadata IS NULL").count() == 0
    kinds = collections.Counter((r["metadata"]["page_id"], r["capture"]["type"]) for r in whole.select("metadata", "capture").collect())
    assert whole.count() == 9 and kinds[3, "response"] == 2
    assert {k for k, t in kinds if t == "revisit"} == {1, 2, None} and (3, "response") in kinds
    assert warc.write_archives(pages.limit(0), path + "-none") is None


def test_warc_query_counts(spark, tmp_path):
    big = "y" * 1200
    spark.createDataFrame([(i, "u", big if i % 3 == 0 else str(i)) for i in range(90)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op2_warc(spark, str(tmp_path)).collect()
    assert len(got) == 90
    for r in got:
        payload = (big if r["page_id"] % 3 == 0 else str(r["page_id"])).encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 87) if r["page_id"] % 3 == 0 and r["page_id"] < 87 else ("response", None))


def test_toxicity(spark, empty):
    rnd = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(60)) + (" Grumblefoo!" if i % 5 == 0 else ""), "en", i % 5 == 0) for i in range(600)] + [(900, None, None, False), (901, "", "de", False)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(r[0], int(r[3])) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum((got[r[0]] >= 0.5) == r[3] for r in held) / len(held) > 0.95 and len(got) == len(rows)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.train(docs, labels.limit(0)) == 0.0 and toxicity.score(docs, 0.0).agg(F.max("score")).first()[0] == 0.0


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    ids = {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in rows}
    got = packing.pack(docs, path, 512).collect()
    covered, sequences = collections.Counter(), collections.defaultdict(list)
    for r in got:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        covered[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert covered == {i: len(x) for i, x in ids.items()}
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= 512
    assert packing.pack(empty, path).count() == 0


def test_packing_of_very_short_texts(spark):
    path = P.path("word_bpe_49k.json")
    texts = [None, "", "one", "one two", "the word of it"]
    short = spark.createDataFrame([(i, texts[i % 5] if i % 7 else None) for i in range(9000)], "doc_id long, text string").repartition(3)
    got = packing.pack(short, path).collect()
    assert len(got) == len({r["doc_id"] for r in got}) == 9000
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= packing.MAX_LEN
    # No sequence but the last has room left.
    assert len(sequences) == -(-sum(r["length"] for r in got) // packing.MAX_LEN)
    rnd = random.Random(3)
    histogram = {n: rnd.choice([0, 1, 7, 100_000]) for n in range(1, 2049)}
    patterns = packing.shortest_pack_first(histogram)
    placed = collections.Counter()
    for n, slots in patterns:
        assert sum(length * times for length, times in slots) <= 2048
        for length, times in slots:
            placed[length] += n * times
    assert placed == collections.Counter({k: v for k, v in histogram.items() if v}) and len(patterns) < 8192


def test_packing_of_words_without_end(spark):
    """Words of a megabyte, ASCII and not, are cut, and are not kept in the cache; the cache is bounded in what it holds."""
    path = P.path("word_bpe_49k.json")
    own = packing.WordIds(path)
    texts = ["abcdefghij" * 100_000, "日本語" * 50_000, "short words", None, "x" * 65]
    ids = own.ids(texts)
    assert all(len(w) <= packing.LONGEST_KEPT for w in own.known) and all(len(w) <= packing.LONGEST_KEPT for w in own.bases)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert list(packing.portions(["a" * (5 << 20), "b", "c" * (3 << 20), "d" * (2 << 20)])) == [(0, 1), (1, 3), (3, 4)]


def test_packing_fills_sequences():
    rnd = random.Random(3)
    for histogram in ({10: 100_000}, {5: 50_000, 12: 30_000, 20: 10_000}, {n: rnd.randint(1, 9000) for n in range(1, 31)}, {n: rnd.randint(1, 50) for n in range(1, 2049)}):
        patterns = packing.shortest_pack_first(histogram, packing.MAX_LEN)
        used = collections.Counter()
        for n, slots in patterns:
            assert sum(length * times for length, times in slots) <= packing.MAX_LEN
            for length, times in slots:
                used[length] += n * times
        assert used == histogram
        assert sum(k * n for k, n in histogram.items()) / (packing.MAX_LEN * sum(n for n, _ in patterns)) >= 0.99


def test_word_ids_like_library():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, own, rnd = Tokenizer.from_file(path), packing.WordIds(path), random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "\t", "the", "'s", "'", "<|endoftext|>", "<|", "é", "É", "日", "1", "23", "!", ".", ",", "　", "\xa0", "\x1c", "\x85", "er", " The", "😀", "\u0301", "İ", "Σ", "ß", "_", "\x0b"]
    for _ in range(2000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert own.ids([text])[0] == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, path).collect()}
    assert got == {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows}
    assert token_counts.count_tokens(empty, path).count() == 0
    own, rnd = token_counts.PairCounter(path), random.Random(2)
    parts = ["a", " ", "  ", "\n", "the", "'s", "<|endoftext|>", "é", "日", "23", "!", "　", "\xa0", "\x1c", "er", " the", "😀", "\t"]
    for _ in range(2000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_tiff_round_trips():
    rng = np.random.default_rng(0)
    for compression in (tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
        for predictor in (1, 2):
            for tile in (None, (16, 32)):
                pages = [rng.integers(0, 4, s).astype(np.uint8) * 60 for s in ((1, 1, 1), (70, 33, 3), (90, 64, 3))]
                data = tiff.encode_tiff(pages, compression, predictor, 17, tile)
                got = [tiff.decode_page(data, t) for t in tiff.directories(data)]
                assert len(got) == 3 and all((a == b).all() for a, b in zip(pages, got, strict=True))


def test_tiff_pages_and_texts(spark, docs, rows, empty):
    two = tiff.encode_tiff([np.zeros((2, 2, 1), np.uint8), np.ones((3, 2, 1), np.uint8)])
    media = spark.createDataFrame([(1, bytearray(two)), (2, None), (3, bytearray(b"no"))], "id long, media binary")
    assert sorted((r["id"], r["page"], r["height"]) for r in tiff.read_pages(media).collect()) == [(1, 0, 2), (1, 1, 3)]
    got = {r["id"]: bytes(r["pixels"]) for r in tiff.read_pages(tiff.text_media(docs)).collect()}
    for i, t in rows:
        b = (t or "").encode()
        assert got[i] == b + b"\xff" * (-len(b) % 576 if b else 576)
    assert tiff.read_pages(tiff.text_media(empty)).count() == 0
    assert len({(r["compression"]) for r in tiff.read_pages(tiff.text_media(docs)).select("compression").distinct().collect()}) == 3


def test_tiff_damaged(spark):
    whole = tiff.encode_tiff([np.arange(192, dtype=np.uint8).reshape(8, 8, 3), np.zeros((4, 4, 1), np.uint8)], tiff.DEFLATE)
    odd = [whole[:n] for n in (5, 9, 60, len(whole) - 3)] + [b"II*\x00\x08", whole.replace(tiff.struct.pack("<HHI", tiff.COMPRESSION, 3, 1) + b"\x08", tiff.struct.pack("<HHI", tiff.COMPRESSION, 3, 1) + b"\x07"), whole[:8] + b"\xff" * 40 + whole[48:]]
    media = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate([whole, *odd])], "id long, media binary")
    got = collections.defaultdict(list)
    for r in tiff.read_pages(media).collect():
        got[r["id"]].append((r["page"], r["error"]))
    assert sorted(got.pop(0)) == [(0, None), (1, None)]
    assert all(sum(e is not None for _, e in pages) <= 1 for pages in got.values()) and sum(e is not None for pages in got.values() for _, e in pages) >= 5


def test_media_query(spark, tmp_path, rows):
    """Every column of op7 against the stored form, made here once more; repeated rows, null and shared ids."""
    more = [*rows, (3, rows[3][1]), (None, "no id"), (3, "another text")]
    spark.createDataFrame(more, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("media", F.lit("clash")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter(tuple(r) for r in tiff.op7_media_columns(spark, str(tmp_path)).drop("feature").collect())
    want = collections.Counter()
    for i, t in more:
        b = (t or "").encode()
        full = b + b"\xff" * (-len(b) % 576 if b else 576)
        media = tiff.encode_tiff([np.frombuffer(full, np.uint8).reshape(-1, 64, 3)], **tiff.FORMS[zlib.crc32(full) % len(tiff.FORMS)])
        want[i, len(b), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]), len(media), hashlib.sha256(media).hexdigest()] += 1
    assert got == want


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?x", "http://example.com/en/71", "http://notexample.com/en/1", "https://com/en/", "http://x.net/de", "http://x.net/de/", "ftp://b.example.net/de/81#f", "http://example.net:80/de/8", "a://b://c/en/", "http://x.org?/es/", "http://" + "a." * 500 + "org/es/" + "y" * 3000]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls + urls[:2])], "page_id long, url string, host string")
    rules = spark.createDataFrame(url_filter.RULES, url_filter.RULES_SCHEMA)

    def judge(u):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, path = rest[:cut].lower(), rest[cut:]
            path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fits = [(len(h + p), h + p, a) for h, p, a in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == [(i, *judge(u)) for i, u in enumerate(urls + urls[:2])]
    assert url_filter.judge_urls(pages, rules.limit(0)).where("verdict = 'block'").count() == 0
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    many = spark.range(5000).select(F.concat(F.lit("h"), "id", F.lit(".net")).alias("rule_host"), F.lit("/").alias("rule_path"), F.lit("block").alias("action"))
    some = spark.range(0, 10000, 7).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit(".net/x")).alias("url"))
    assert url_filter.judge_urls(some, many).where("verdict = 'block'").count() == len(range(0, 5000, 7))


def test_fingerprints(spark, docs, rows, empty):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint(docs).collect()}
    down = sorted(rows, reverse=True)
    errors = []
    for k, (i, t) in enumerate(down):
        t, after = t or "", down[(k + 1) % len(down)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = (collections.Counter(w for w in x.translate({9: " ", 10: " ", 13: " "}).split(" ") if w) for x in (t, edited))
        if union := sum((a | b).values()):
            errors.append(got[i]["near_edited"] - sum((a & b).values()) / union)
        assert 0 <= got[i]["near_next"] <= 1
    assert abs(np.mean(errors)) < 0.04 and np.std(errors) < 0.12
    same = collections.defaultdict(set)
    for i, t in rows:
        same[t or ""].add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in same.values())
    assert fingerprints.fingerprint(empty).count() == 0
    assert fingerprints.fingerprint(docs.limit(1)).count() == 1


def test_fingerprints_of_null_and_shared_ids(spark, monkeypatch):
    """Null ids and an id that fill several buckets are cut by a hash of their texts, and every row has its next one."""
    rnd = random.Random(8)
    monkeypatch.setattr(fingerprints, "BUCKET", 4)
    monkeypatch.setattr(fingerprints, "FANOUT", 16)
    ids = [None] * 90 + [7] * 60 + [3, 3, 9, 9] + list(range(100, 220))
    docs = spark.createDataFrame([(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 30)))) for i in ids], "doc_id long, text string").repartition(5)
    hashed = [tuple(r) for r in docs.select("doc_id", F.xxhash64("text"), "text").collect()]
    cuts, hot = fingerprints.cut_points(docs.select(F.coalesce("doc_id", F.lit(fingerprints.LOWEST).cast("long")).alias("key")), len(ids))
    assert set(hot) == {7, fingerprints.LOWEST} and hot[7] == 15 and len(cuts) > 20
    down = sorted(hashed, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]), reverse=True)
    want = collections.Counter()
    for (i, _, t), (_, _, after) in zip(down, down[1:] + down[:1], strict=True):
        want[i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()] += 1
    got = fingerprints.fingerprint(docs).select("doc_id", "n_chars", "edited_sha256").collect()
    assert collections.Counter(map(tuple, got)) == want
    sizes = fingerprints.with_next(docs, "doc_id", "text").where("guest = 0").groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert sizes <= 20


def test_mixing(spark, docs, rows, empty, odd):
    taken_words = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]).alias("taken")
    out = mixing.mix(docs).select("*", taken_words).collect()
    assert len(out) == len(rows)
    size = {i: len([w for w in (t or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]) for i, t in rows}
    total = collections.Counter()
    for i, n in size.items():
        total[["a", "b", "c", None][i % 4]] += n
    weight = {"a": 1, "b": 2, "c": 3, None: 1}
    target, free, left = {}, set(total), float(sum(total.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
        free -= over
    taken = collections.Counter()
    for r in out:
        assert r["size"] == size[r["id"]] and r["source_size"] == total[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in total)
    again = mixing.mix(docs.repartition(3)).collect()
    assert {r["id"]: r["draws"] for r in again} == {r["id"]: r["draws"] for r in out}
    assert mixing.mix(empty).count() == 0 and mixing.mix(odd).count() == 6
    # A pass takes all of a document, but for one of each source; where a document is taken at all, null and empty texts of its source are too.
    parts = collections.Counter(r["source"] for r in out for d in r["draws"] if 0 < d["words"] < r["size"])
    assert all(n == 1 for n in parts.values())
    assert len({(d["shard"]) for r in out for d in r["draws"]}) > 8


def hypergeometric_weights(t, k, d):
    """The exact law by binomials."""
    return {x: math.comb(k, x) * math.comb(t - k, d - x) / math.comb(t, d) for x in range(max(0, d + k - t), min(k, d) + 1)}


def test_hypergeometric_quantiles(spark):
    cases = [(1, 1, 1), (1, 0, 1), (5, 5, 3), (10, 4, 5), (10, 9, 9), (60, 1, 30), (200, 90, 100), (1500, 40, 750), (4000, 1500, 2000)]
    rows = [(t, k, d, (i + 0.5) / 25) for t, k, d in cases for i in range(25)]
    df = spark.createDataFrame(rows, "t long, k long, d long, u double")
    for t, k, d, u, x in df.select("*", mixing.hypergeometric(F.col("t"), F.col("k"), F.col("d"), F.col("u"))).collect():
        below, want = 0.0, None
        for want, w in hypergeometric_weights(t, k, d).items():  # noqa: B007
            below += w
            if below > u:
                break
        assert x == want, (t, k, d, u)
    # Large ones: near the mean, and the ends of u stay in range.
    for u, reach in ((0.0, 13), (0.5, 0.1), (1 - 2.0**-53, 13)):
        x = spark.range(1).select(mixing.hypergeometric(F.lit(16_000_000), F.lit(5_000_000), F.lit(8_000_000), F.lit(u))).first()[0]
        assert abs(x - 2_500_000) <= reach * (5e6 * 0.25 * 11 / 16) ** 0.5 + 24


DRAWN = [("a", 0, 600), ("b", 0, 300), (None, 0, 60), ("b", 1, 43)]


def quotas_of(spark, drawn, levels, seed=7):
    rows = mixing.shard_quotas(spark.createDataFrame(drawn, "source string, pass int, n long"), len(drawn), levels, seed).collect()
    out = {(r["source"], r["pass"], r["shard"]): r["quota"] for r in rows}
    assert len(out) == len(rows) and all(out.values())
    return out


def test_mixing_tree(spark):
    """At every node half of the blocks go left, rounded up, and each source and pass keeps its number; a node's children add up to it; the blocks' shards follow the leaves."""
    above = {(s, p, 0): n for s, p, n in DRAWN}
    size = {0: 1003}
    for levels in range(1, 6):
        size = {2 * k + side: n // 2 if side else (n + 1) // 2 for k, n in size.items() for side in (0, 1)}
        quotas = quotas_of(spark, DRAWN, levels)
        by_shard, by_parent = collections.Counter(), collections.Counter()
        for (s, p, shard), n in quotas.items():
            by_shard[shard] += n
            by_parent[s, p, shard // 2] += n
        assert by_shard == size and by_parent == above
        above = quotas
    assert quotas_of(spark, DRAWN, 3) != quotas_of(spark, DRAWN, 3, 8)
    assert quotas_of(spark, [("a", 0, 0), ("b", 0, 1)], 2) == {("b", 0, 0): 1}
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id")).alias("text"), F.when(F.col("id") % 7 < 4, "a").otherwise("b").alias("source"))
    base = docs.select("source", mixing.word_count(F.col("text")).alias("size"), F.col("doc_id").alias("key"))
    blocks = mixing.draw_blocks(base, 7)[1].select("source", F.explode("draws").alias("d")).groupBy("source", "d.pass", "d.shard").count().collect()
    n = collections.Counter()
    for r in blocks:
        n[r["source"], r["pass"]] += r["count"]
    want = mixing.shard_quotas(spark.createDataFrame([(s, p, k) for (s, p), k in n.items()], "source string, pass int, n long"), len(n), mixing.LEAST_LEVELS, 7).collect()
    assert {(r["source"], r["pass"], r["shard"]): r["count"] for r in blocks} == {(r["source"], r["pass"], r["shard"]): r["quota"] for r in want}


def test_mixing_tree_follows_the_law(spark):
    """Over many nodes the numbers have the mean, the variance and the covariance of the multivariate hypergeometric distribution."""
    cells = F.array(*[mixing._struct(source=F.lit(s), n=F.lit(n).cast("long")) for s, n in (("a", 30), ("b", 20), ("c", 10))])
    uniform = lambda c: F.shiftrightunsigned(F.xxhash64(F.col("id"), c["source"]), 11) * F.lit(2.0**-53)
    got = np.array([r[0] for r in spark.range(4000).select(mixing.shared(cells, F.lit(30), uniform)).collect()])
    assert (got.sum(axis=1) == 30).all()
    share = np.array([30, 20, 10]) / 60
    spread = 30 * 30 / 59 * (np.diag(share) - np.outer(share, share))
    assert np.abs(got.mean(axis=0) - 30 * share).max() < 5 * (spread.max() / 4000) ** 0.5
    assert np.abs(np.cov(got.T) - spread).max() < 0.35
    for column, (k, d) in enumerate(((30, 30), (20, 30), (10, 30))):
        for x, w in hypergeometric_weights(60, k, d).items():
            assert abs((got[:, column] == x).mean() - w) < 5 * (w / 4000) ** 0.5 + 0.002


def test_mixing_tree_of_many_sources(spark, monkeypatch):
    """Where a node's numbers fill several arrays, sums are as exact."""
    monkeypatch.setattr(mixing, "CELLS", 4)
    drawn = [(f"s{i:03}", i % 3, 1 + i % 5) for i in range(150)]
    quotas = quotas_of(spark, drawn, 3)
    by_source, by_shard = collections.Counter(), collections.Counter()
    for (s, p, shard), n in quotas.items():
        by_source[s, p] += n
        by_shard[shard] += n
    assert by_source == {(s, p): n for s, p, n in drawn}
    total = sum(n for _, _, n in drawn)
    assert sum(by_shard.values()) == total and max(by_shard.values()) - min(by_shard.values()) <= 1


def test_mixing_in_ranges(docs, monkeypatch):
    """Tables ranked range by range give the same mix."""
    want = {r["id"]: r["draws"] for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "RANGE", 100)
    assert {r["id"]: r["draws"] for r in mixing.mix(docs).collect()} == want


def test_mixing_of_sources_without_words(spark):
    docs = spark.createDataFrame([(1, "", "x"), (2, None, "x"), (None, None, None), (4, "a b c", "y")], "doc_id long, text string, source string")
    out = {r["id"]: [d["words"] for d in r["draws"]] for r in mixing.mix(docs).collect()}
    assert out[1] == [0] and out[2] == [0] and out[None] == [0] and sum(out[4]) == 3


def test_tiff_of_texts_has_no_cap(spark, docs, tmp_path, monkeypatch):
    """Pages of texts are read back whatever their size, and one that isn't fails the job."""
    monkeypatch.setattr(tiff, "MOST_BYTES", 10)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert tiff.op7_media_columns(spark, str(tmp_path)).count() == docs.count()
    with pytest.raises(ValueError):
        tiff.decode_page(*(lambda data: (data, next(tiff.directories(data)), 10))(tiff.encode_tiff([np.zeros((4, 4, 3), np.uint8)])))
    broken = spark.createDataFrame([(1, 5, b"II*\x00\x08\x00\x00\x00\xff\xff")], "id long, n_bytes long, media binary")
    monkeypatch.setattr(tiff, "text_media", lambda rows: broken)
    with pytest.raises(Exception, match="was not read back"):
        tiff.text_pages(docs).collect()


def test_tiff_features(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["feature"] for r in tiff.op7_media_columns(spark, str(tmp_path)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        n = collections.Counter(full)
        size, mean = len(full) // 192, sum(b * k for b, k in n.items()) * 1000 // len(full)
        coarse = bytes(sum(n[b] for b in range(16 * k, 16 * k + 16)) * 255 // len(full) for k in range(16))
        assert got[i] == f"64x{size}x3;mean={mean};seen={len(n)};{coarse.hex()}"


def test_token_counts_of_odd_rows(odd, empty):
    path = P.path("byte_bpe_50k.json")
    out = token_counts.count_tokens(odd, path).collect()
    assert len(out) == 6 and sum(r["doc_id"] is None for r in out) == 2 and token_counts.count_tokens(empty, path).count() == 0
    by = collections.defaultdict(set)
    for r in out:
        by[r["n_bytes"]].add(r["n_tokens"])
    assert by[0] == {0} and all(len(v) == 1 for k, v in by.items() if k in (0, 320))


def test_toxicity_query(spark, data):
    out = toxicity.op3_toxicity(spark, data).collect()
    assert len(out) == spark.read.parquet(f"{data}/documents.parquet").count()
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1


def test_toxicity_of_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(5, 1, 1), (6, 1, 0), (6, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, labels)
    out = toxicity.score(odd, model).collect()
    assert len(out) == 6 and all(0 <= r["score"] <= 1 for r in out) and toxicity.score(empty, model).count() == 0


def test_shuffles_follow_the_bytes(docs, rows, monkeypatch):
    """With very few bytes a task both jobs cut their shuffles further; results stay."""
    plain = [sorted(map(tuple, f(docs).collect()), key=str) for f in (ngram_join.jaccard_components, suffix_dedup.remove_repeats)]
    monkeypatch.setattr(common, "TASK_BYTES", 4000)
    assert common.dealt_by(docs, 40_000, "doc_id").rdd.getNumPartitions() == 10
    again = [sorted(map(tuple, f(docs).collect()), key=str) for f in (ngram_join.jaccard_components, suffix_dedup.remove_repeats)]
    assert again == plain
