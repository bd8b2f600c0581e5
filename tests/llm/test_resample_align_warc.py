"""Importance resampling, tokenizer alignment and WARC archives against brute force, the libraries and round trips."""

import base64
import gzip
import hashlib
import io
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenshelf.llm import align, queries, resample, warc
from lumenshelf.llm.common import Scratch

# --- importance resampling -------------------------------------------------------------------------------------------------


def brute_features(text, width, buckets):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [zlib.crc32(b" ".join(words[i : i + n])) % buckets for n in range(1, width + 1) for i in range(len(words) - n + 1)], len(words)


def brute_resample(docs, target, percent, seed, width, buckets, min_words):
    own = {i: brute_features(t, width, buckets) for i, t in docs}
    s, t = Counter(x for f, _ in own.values() for x in f), Counter(x for text in target for x in brute_features(text, width, buckets)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = {}
    for i, (f, n) in own.items():
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        rows[i] = (len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= min_words)
    fits = sorted((i for i in rows if rows[i][3]), key=lambda i: (-rows[i][2], i))
    rank = {i: k + 1 for k, i in enumerate(fits[: percent * len(fits) // 100])}
    return {i: (*r[:3], rank.get(i)) for i, r in rows.items()}


@pytest.fixture(scope="module")
def mixed_texts():
    rng = random.Random(21)
    word = lambda: rng.choice(["Ärger", "naïve", "漢字", "x" * 90, "A1", f"w{rng.randrange(300)}", f"W{rng.randrange(40)}"])
    texts = [rng.choice([" ", "\n", ", ", "--"]).join(word() for _ in range(rng.randrange(60))) for _ in range(300)]
    return [*texts, None, "", "!! \x00 ??", texts[0], " ".join(word() for _ in range(30000)), "one"]


@pytest.mark.parametrize(("width", "percent", "buckets"), [(1, 10, 10_000), (2, 35, 50), (3, 100, 1000)])
def test_resample(spark, mixed_texts, width, percent, buckets):
    docs = list(enumerate(mixed_texts))
    target = ["Ärger W1 W2 w7", None, "漢字 a1 naïve " * 20]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("clash"), "weight": F.lit(1), "n": F.lit(None).cast("int")}).repartition(3)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, score int")
    got = {r.id: (r.n_features, r.weight, r.score, r.rank) for r in resample.resample(df, aim, percent=percent, seed=7, width=width, buckets=buckets).collect()}
    assert got == brute_resample(docs, target, percent, 7, width, buckets, 20)
    # the draw leans to the target
    drawn = [w for _, w, _, rank in got.values() if rank is not None]
    assert percent == 100 or np.mean(drawn) > np.mean([w for _, w, _, rank in got.values() if rank is None])


def test_resample_edges(spark):
    text = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (None, None), (2, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    got = resample.resample(df, none, percent=100).collect()
    assert len(got) == 5 and sorted(r.rank for r in got if r.rank) == [1, 2, 3]
    assert all(r.weight == got[0].weight for r in got if r.n_features == 25)
    assert {(r.n_features, r.weight, r.rank) for r in got if not r.n_features} == {(0, 0, None)}
    assert resample.resample(df.limit(0), none).count() == 0
    assert [r.rank for r in resample.resample(df, none, percent=0).collect()] == [None] * 5


def test_crc_of_slices():
    rng = random.Random(3)
    parts = [bytes(rng.randrange(256) for _ in range(rng.randrange(0, 40))) for _ in range(200)]
    size = np.array([len(p) for p in parts])
    got = resample.crc_on(np.full(200, 0xFFFFFFFF, np.uint32), np.frombuffer(b"".join(parts) + b"-", np.uint8), np.cumsum(size) - size, size)
    assert (got ^ np.uint32(0xFFFFFFFF)).tolist() == [zlib.crc32(p) for p in parts]


# --- alignment -------------------------------------------------------------------------------------------------------------

PATHS = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")


def brute_align(texts):
    """By the libraries, token by token; (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text."""
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    first.encode_special_tokens = True
    letters = align.byte_of_letter()
    groups = []
    for t in texts:
        groups.append([])
        if not t:
            continue
        a, b = first.encode(" " + t, add_special_tokens=False).ids, second.encode(t)
        bytes_a = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [second.id_to_piece(i)]]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
            continue
        i = j = at_a = at_b = 0
        now: tuple[list, list] = ([], [])
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                at_a, i = at_a + len(bytes_a[i]), i + 1
                now[0].append(a[i - 1])
            else:
                at_b, j = at_b + len(bytes_b[j]), j + 1
                now[1].append(b[j - 1])
            if at_a == at_b:
                groups[-1].append(now)
                now = ([], [])
    links = [[(x, y) for p, q in g for x in p for y in q] for g in groups]
    docs = Counter(pair for one in links for pair in set(one))
    best: dict[int, int] = {}
    for (x, _), n in docs.items():
        best[x] = max(best.get(x, 0), n)
    show = lambda g: ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g)
    return [(sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), len(one), sum(docs[x] == best[x[0]] for x in one), sum(docs[x] for x in one), show(g)) for g, one in zip(groups, links, strict=True)]


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(17)
    prose = ["the", "The", "naïve", "Straße", "漢字かな", "😀👍🏽", "don't", "we'll", "1234567", "x=y;", "…", "internationalization", "<|endoftext|>", "<s>", "<0x41>", "　", "é", "\t", "\n\n", "https://a.b/c?d=1", "​"]
    texts = [rng.choice(["", " ", "  "]) + rng.choice([" ", "  ", "", "   "]).join(rng.choice(prose) + rng.choice(["", ",", "s"]) for _ in range(rng.randrange(40))) + rng.choice(["", " ", "   "]) for _ in range(400)]
    noise = ["".join(rng.choice("abcdeé漢 \n\t'▁.=1\x00\x7f 😀") for _ in range(rng.randrange(60))) for _ in range(300)]
    dense = "".join(rng.choice("qzxjkvwy") for _ in range(5000))
    return [*texts, *noise, None, "", " ", "    ", "▁", "a▁b", dense, "=" * 3000, "x" * 70 + "é" * 80, " ".join(rng.choice(prose) for _ in range(20000)), texts[0], texts[0]]


@pytest.mark.parametrize("common", [align.COMMON, 40, 0])
def test_align_equals_libraries(spark, odd_texts, common):
    df = spark.createDataFrame(list(enumerate(odd_texts)), "doc_id long, text string").withColumns({"pairs": F.lit("clash"), "n_a": F.lit(1), "row": F.lit(2)}).repartition(3)
    got = {r.id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in align.align(df, *PATHS, common=common).collect()}
    want = brute_align(odd_texts)
    assert len(got) == len(odd_texts)
    assert [got[i] for i in range(len(want))] == want
    assert sum(w[0] > 0 for w in want) > 300 and any(not w[0] and t and t.strip() for w, t in zip(want, odd_texts, strict=True))


def test_align_of_large_groups(monkeypatch, odd_texts):
    """Groups that are expanded by distinct ids give the same pairs."""
    first, second = align.ByteLevel(json.load(open(PATHS[0], encoding="utf-8"))), align.Pieces(open(PATHS[1], "rb").read())
    found = align.Aligned(first, second, [t or "" for t in odd_texts])
    want = [x.tolist() for x in found.pairs()]
    for least in (0, 1, 4):
        monkeypatch.setattr(align, "DENSE", least)
        assert [x.tolist() for x in found.pairs()] == want


def test_pieces_without_words(odd_texts):
    """Text by text, as for models whose pieces hold spaces after other characters."""
    texts = [t for t in odd_texts if t]
    one, two = (align.Pieces(open(PATHS[1], "rb").read()) for _ in range(2))
    two.by_word = False
    for x, y in zip(one.encode(texts), two.encode(texts), strict=True):
        assert x.tolist() == y.tolist()


def test_align_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    got = sorted((r.id or 0, r.n_links, r.count_sum, r.n_best) for r in align.align(df, *PATHS).collect())
    assert got == [(0, 0, 0, 0), (0, 2, 6, 2), (1, 2, 6, 2), (1, 2, 6, 2)]
    assert align.align(df.limit(0), *PATHS).count() == 0


# --- archives --------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(5)
    rows = [(i, f"http://a.b/{i}", "".join(rng.choice(["\r\n\r\n", "\r", "\n", "é", "WARC/1.1\r\n", "x" * rng.randrange(3000)]) for _ in range(rng.randrange(12)))) for i in range(200)]
    rows += [(200 + i, f"http://c.d/{i}", rows[i % 3][2]) for i in range(30)]
    rows += [(300, None, None), (301, "http://a\r\nb", ""), (302, "u", "\r\n\r\n"), (303, "u", "\r\n\r\n"), (304, "é ü", "z" * 3_000_000), (-5, "u", rows[0][2])]
    return rows


def brute_records(rows, least_bytes=0):
    first = {}
    for i, _, t in rows:
        first[t or ""] = min(i, first.get(t or "", i))
    out = {}
    for i, _, t in rows:
        data = (t or "").encode()
        again = len(data) >= least_bytes and first[t or ""] != i
        out[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[t or ""] if again else None)
    return out


@pytest.mark.parametrize("least", [0, 10])
def test_warc_round_trip(spark, pages, least):
    df = spark.createDataFrame(pages, PAGES).withColumns({"key": F.lit("clash"), "body": F.lit(1), "least": F.lit(2), "value": F.lit(3)}).repartition(3)
    got = warc.round_trip(df, "page_id", "url", "html", min_bytes=least).select(warc.number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.number("refers_to").alias("to")).collect()
    assert len(got) == len(pages)
    assert {r.page_id: tuple(r)[1:] for r in got} == brute_records(pages, least)


def test_normalised_members_and_index(spark, pages):
    store = Scratch(spark, "test")
    root = store.folder()
    df = spark.createDataFrame(pages, PAGES)
    warc.write(df.coalesce(2), f"{root}/whole", "page_id", "url", "html")
    place = re.sub("^file:", "", root)
    import glob
    import os

    whole = sorted(glob.glob(f"{place}/whole/*.gz"))
    # a file with a member for each record is an archive, too
    lone = [gzip.compress(b"WARC/1.0\r\nContent-Length: 4\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\n\r\nabcd\r\n\r\n") for _ in range(3)]
    open(f"{place}/whole/other.warc.gz", "wb").write(b"".join(lone))
    index = store.keep(warc.normalise(spark, f"{root}/whole", f"{root}/members"))
    assert index.count() == len(pages) + 3
    bodies = {}
    for r in index.collect():
        with open(re.sub("^file:", "", r.archive), "rb") as f:
            f.seek(r.offset)
            bodies[r.record_id] = zlib.decompress(f.read(r.length), 31)  # one whole member
    joined = sorted(b"".join(x) for x in [re.findall(rb"(?s).+", gzip.open(p).read()) for p in whole])
    assert sum(map(len, bodies.values())) == sum(map(len, joined)) + len(gzip.decompress(lone[0]))
    for archive in {r.archive for r in index.collect()}:
        path = re.sub("^file:", "", archive)
        lines = [x.split("\t") for x in open(f"{path}.idx", encoding="utf-8").read().splitlines()]
        assert [(int(x[0]), int(x[1])) for x in lines] == sorted((r.offset, r.length) for r in index.collect() if r.archive == archive)
        data = gzip.open(path).read()  # all members after one another are the stream before
        assert data in [*(gzip.open(p).read() for p in whole), b"".join(map(gzip.decompress, lone))]
        assert os.path.getsize(path) == int(lines[-1][0]) + int(lines[-1][1])
    got = {r.record_id: r for r in warc.read(index).collect()}
    texts = {i: (t or "").encode() for i, _, t in pages}
    for r in got.values():
        if r.record_type == "response":
            assert bytes(r.payload) == texts[int(re.search(r"-?\d+", r.record_id)[0])]
    # any part of an index can be read alone
    some = index.where("offset > 1000")
    assert {r.record_id for r in warc.read(some).collect()} == {r.record_id for r in some.collect()}


def test_warc_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, None, "x"), (1, "u", "x"), (1, "u", "x"), (2, "u", "x"), (None, "u", "y"), (None, "u", "y")], PAGES)
    got = [(r.record_type, r.refers_to, warc_id(r.record_id)) for r in warc.round_trip(df, "page_id", "url", "html").collect()]
    assert sorted(got, key=repr) == sorted([("revisit", "<urn:page:1>", ""), ("response", None, "1"), ("response", None, "1"), ("revisit", "<urn:page:1>", "2"), ("response", None, ""), ("response", None, "")], key=repr)
    assert warc.round_trip(df.limit(0), "page_id", "url", "html").count() == 0


def warc_id(urn):
    return re.search(r"page:(.*)>", urn)[1]


def test_broken_archives_are_named(spark):
    root = Scratch(spark, "test").folder()
    place = re.sub("^file:", "", root)
    for name, data, said in [("short", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", "ends within a record"), ("other", b"GIF89a nothing\r\n\r\n", "no WARC record")]:
        import os

        os.makedirs(f"{place}/{name}")
        packed = io.BytesIO()
        with gzip.GzipFile(fileobj=packed, mode="wb") as f:
            f.write(data)
        open(f"{place}/{name}/{name}.warc.gz", "wb").write(packed.getvalue())
        with pytest.raises(Exception, match=said):
            warc.normalise(spark, f"{root}/{name}", f"{root}/out").collect()
