"""The training-data operators against brute force, and on nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenshelf.llm import bpe, bwt, ctw, egojoin, fingerprint, langid, minhash, mixing, passages, queries, urltree
from lumenshelf.llm.common import Scratch
from lumenshelf.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=5000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en" if k % 2 else None, f"s{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, short, empty, null and long texts."""
    rng = random.Random(3)
    base = [" ".join(words(rng, rng.randrange(60, 200))) for _ in range(20)]
    passage = " ".join(words(rng, 58))
    near = [" ".join(x if rng.random() > 0.01 else "edit" for x in base[k % 3].split()) for k in range(8)]
    mixed = [" ".join(words(rng, 40)) + " " + passage + " " + " ".join(words(rng, 30)) for _ in range(4)]
    return [*base, base[0], base[0].upper(), *near, *mixed, "", None, "one", "one two", "é 漢字 😀 's don't  ", " ".join(words(rng, 20000, 100000)), "x" * 5000]


def clean_words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


# --- embeddings ----------------------------------------------------------------------------------------------------------


def test_egojoin(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 16))
    v = [(centers[i % 12] + rng.normal(size=16) * 0.15 * (i % 4)).tolist() for i in range(240)]
    v[5], v[6], v[7], v[8], v[9], v[10] = None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, v[11]
    v[12] = [2 * x for x in v[13]]
    v[14] = [1.0, 2.0]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    got = {r.id: (r.n_links, r.component) for r in egojoin.near_vectors(df).collect()}
    ok = {i: np.array(x) / np.linalg.norm(x) for i, x in enumerate(v) if x and None not in x and np.isfinite(x).all() and any(x)}
    links = {i: [j for j in ok if j != i and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= 0.9] for i in ok}
    assert {i: n for i, (n, _) in got.items()} == {i: len(links.get(i, [])) for i in range(240)}
    assert {i: c for i, (_, c) in got.items()} == smallest(links, range(240))
    assert egojoin.near_vectors(df.limit(0)).count() == 0


def test_egojoin_of_extreme_vectors_repeated_rows_and_clashing_names(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 8))
    rows, plain = [], {}
    for i in range(60):
        v = base[i % 6] + rng.normal(size=8) * 0.1 * (i % 3)
        plain[i] = v / np.linalg.norm(v)
        rows.append((i, (v * [1.0, 1e200, 1e-200, 3e-310, 1e307][i % 5]).tolist()))
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (None, None), (70, [5e-324] * 8), (71, [1e308] * 8), (72, [float("inf")] + [1.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("clash"), "rep": F.lit(1), "v": F.lit(2), "dim": F.lit(3), "k1": F.lit(4), "fine": F.lit(5)})
    got = egojoin.near_vectors(df, cosine=0.9).collect()
    assert len(got) == len(rows)
    plain[70] = plain[71] = np.ones(8) / np.sqrt(8)
    links = {i: [j for j in plain if j != i and plain[i] @ plain[j] >= 0.9] for i in plain}
    assert min(abs(plain[i] @ plain[j] - 0.9) for i in plain for j in plain) > 1e-6
    want = smallest(links, plain)
    by_id = {r.id: (r.n_links, r.component) for r in got if r.id is not None and r.id not in (3, 72)}
    near_3 = {i: sum(j == 3 for j in links[i]) for i in links}
    # rows that repeat an id are vectors of their own
    assert by_id == {i: (len(links[i]) + 2 * near_3[i], want[i]) for i in links if i != 3}
    assert {(r.n_links, r.component) for r in got if r.id == 72 or r.id is None} == {(0, 72), (0, None)}


def smallest(links, ids):
    out = {}
    for i in sorted(ids):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in out:
                out[j] = i
                todo += links.get(j, [])
    return out


def test_components_of_a_long_chain(spark):
    store = Scratch(spark, "test")
    edges = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components(edges, store).collect()} == {1}
    assert components(edges.limit(0), store).count() == 0


# --- language ------------------------------------------------------------------------------------------------------------


def test_langid_held_out(spark):
    got = queries.op2_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)


def test_langid_edges(spark, corpus):
    df = frame(spark, [*corpus, "123 !!", None]).withColumn("score", F.lit("clash"))
    model = langid.train(df)
    got = langid.predict(df, model).collect()
    assert len(got) == len(corpus) + 2
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    none = langid.train(df.limit(0))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}


def test_langid_equals_brute_force(spark, monkeypatch):
    """Counts, probabilities and posteriors by dictionaries, text by text; and long texts that are counted in pieces."""
    rng = random.Random(13)
    vocabulary = {"aa": ["der", "die", "größe", "und"], "bb": ["the", "of", "thing", "naïve"], "cc": ["漢字", "かな", "のは"]}
    rows = [(i, " ".join(rng.choice(w) for _ in range(rng.randrange(1, 60))) + rng.choice(["", " 1", "!"]), x if i % 3 else None) for i, (x, w) in enumerate(list(vocabulary.items()) * 20)]
    rows += [(60, " ".join(rng.choice(vocabulary["bb"]) for _ in range(4000)), "bb"), (61, "", "aa"), (62, None, "bb"), (63, "the", "bb"), (63, "the", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def brute_grams(text):
        t = " " + re.sub(r"[^\w]|[\d_]", "\0", (text or "").lower())
        t = re.sub("\0+", " ", t + " ") if text is not None else "  "
        t = " " + re.sub(" +", " ", t[1:-1]) + " "
        out = []
        for n in langid.ORDERS:
            for i in range(len(t) - n + 1):
                h = 0
                for c in t[i : i + n]:
                    h = (h * 0x110001 + ord(c) + 1) % 2**64
                out.append(int(langid.mix(np.array([h], np.uint64))[0]) % langid.BUCKETS)
        return out

    counts = {x: {} for x in vocabulary}
    for _, t, x in rows:
        if x and t is not None:
            for g in brute_grams(t):
                counts[x][g] = counts[x].get(g, 0) + 1
    size = {x: sum(c.values()) + 0.5 * langid.BUCKETS for x, c in counts.items()}
    want = {}
    for i, t, _ in rows:
        if t and re.search(r"[^\W\d_]", t):
            g = brute_grams(t)
            like = {x: sum(math.log(counts[x].get(b, 0) + 0.5) - math.log(size[x]) for b in g) / max(1, len(g) / 64) for x in counts}
            top = max(like, key=like.get)
            want[i] = (top, 1 / sum(math.exp(v - like[top]) for v in like.values()))
        else:
            want[i] = ("und", 0.0)
    for piece in (langid.PIECE, 100):
        monkeypatch.setattr(langid, "PIECE", piece)
        few = [t.encode() for _, t, _ in rows if t]
        got = [np.bincount(b[r == 0] if j - a == 1 else b, minlength=langid.BUCKETS) for a, j, b, r in langid.pieces(few)]
        assert sum(x.sum() for x in got) == sum(len(langid.grams([t])[0]) for t in few)
        assert np.array_equal(sum(got), np.bincount(langid.grams(few)[0], minlength=langid.BUCKETS))
    monkeypatch.undo()
    names, matrix = langid.train(df)
    assert names == sorted(vocabulary)
    for j, x in enumerate(names):
        assert abs(np.exp(matrix[:, j]).sum() - 1) < 1e-9
        assert all(abs(matrix[g, j] - (math.log(counts[x].get(g, 0) + 0.5) - math.log(size[x]))) < 1e-9 for g in range(0, langid.BUCKETS, 97))
    for r in langid.predict(df, (names, matrix)).collect():
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-3


# --- fingerprints --------------------------------------------------------------------------------------------------------


def test_fingerprints(spark, corpus):
    df = frame(spark, corpus)
    got = {r.doc_id: r for r in fingerprint.with_edits(df, per_range=7).collect()}
    texts = {i: t or "" for i, t in enumerate(corpus)}
    order = sorted(texts, reverse=True)
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        t, u = texts[a], texts[b]
        k = len(t) // 3
        edited = t[: len(t) - k] + u[:k]
        assert got[a].n_chars == len(t)
        assert got[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        x, y, z = fingerprint.sketches([t.encode(), edited.encode(), u.encode()])
        assert got[a].fingerprint == fingerprint.to_text(x) and got[a].edited_fingerprint == fingerprint.to_text(y)
        assert (got[a].near_edited, got[a].near_next) == (fingerprint.likeness(x, y), fingerprint.likeness(x, z))
    assert got[0].fingerprint == got[20].fingerprint
    assert fingerprint.with_edits(df.limit(0)).count() == 0
    assert fingerprint.with_edits(df.limit(1)).count() == 1


def test_fingerprints_of_large_null_and_repeated_ids(spark):
    rng = random.Random(8)
    ids = [2**63 - 1, 2**63 - 2, 2**63 - 3, -(2**63), -5, 2**53 + 1, 2**53 + 2, 7, 7, None]
    df = frame(spark, [" ".join(words(rng, 40)) for _ in ids], ids).withColumns({"g": F.lit(1), "t": F.lit(2), "k": F.lit(3)})
    got = fingerprint.with_edits(df, per_range=2).collect()
    assert sorted(r.doc_id or 0 for r in got) == sorted(i or 0 for i in ids)
    texts = {r.doc_id: r.text for r in df.collect()}
    by_id = {r.doc_id: r for r in got}
    for a, b in [(2**63 - 1, 2**63 - 2), (2**63 - 2, 2**63 - 3), (2**53 + 2, 2**53 + 1)]:
        k = len(texts[a]) // 3
        assert by_id[a].edited_sha256 == hashlib.sha256((texts[a][: len(texts[a]) - k] + texts[b][:k]).encode()).hexdigest()


def test_sketches_estimate():
    rng = random.Random(1)
    a = words(rng, 20000)
    part = a[:2000]
    x, y = fingerprint.sketches([" ".join(a).encode(), " ".join(part).encode()])
    assert fingerprint.containment(y, x) > 0.95
    assert abs(fingerprint.likeness(x, y) - 0.1) < 0.05
    both = fingerprint.merge(x, y)
    assert fingerprint.likeness(both, x) == 1.0
    assert np.array_equal(fingerprint.from_text(fingerprint.to_text(x)), x)


def plain_hash(parts):
    """The hash of a shingle, from its words' bytes, in plain integers."""
    m, c = 2**64 - 1, 0x9E3779B97F4A7C15

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
        return x ^ (x >> 31)

    total = 0
    for w in parts:
        h = mixed((int.from_bytes(w[:8], "little") + len(w) * c) & m)
        for i in range(8, len(w), 8):
            h = mixed((h * c + int.from_bytes(w[i : i + 8], "little")) & m)
        total = (total * c + h) & m
    return mixed(total if len(parts) == fingerprint.WIDTH else (total + len(parts)) & m)


def test_sketches_equal_brute_force(corpus):
    """Kept hashes by sets of plain integers; likenesses by the definition; and how far they lie from the exact ones."""
    limit = 2**64 // 64
    sets, kept = [], []
    for t in corpus:
        w = [x.encode() for x in clean_words(t)]
        hashes = {plain_hash(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {plain_hash(w)} if w else set()
        small = sorted(hashes)
        sets.append(hashes)
        kept.append([h for k, h in enumerate(small) if k < 16 or h < limit])
    got = fingerprint.sketches([(t or "").encode() for t in corpus])
    assert [g.tolist() for g in got] == kept
    assert [fingerprint.to_text(g) for g in got] == [base64.b64encode(b"".join(h.to_bytes(8, "little") for h in k)).decode() for k in kept]
    errors = []
    for i, j in itertools.product(range(len(corpus)), repeat=2):
        cut = min(2**64 if len(kept[x]) < 16 else max(limit, kept[x][15]) for x in (i, j))
        a, b = ({h for h in kept[x] if h <= cut} for x in (i, j))
        want = 1.0 if not kept[i] and not kept[j] else len(a & b) / len(a | b) if a | b else 0.0
        assert fingerprint.likeness(got[i], got[j]) == want
        if sets[i] and sets[j]:
            errors.append(want - len(sets[i] & sets[j]) / len(sets[i] | sets[j]))
    assert np.sqrt(np.mean(np.square(errors))) < 0.05 and max(map(abs, errors)) < 0.5


# --- near duplicates -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_minhash(spark, corpus, width, percent):
    df = frame(spark, [*corpus, *corpus[:3]], [*range(len(corpus)), 0, 1, 2]).withColumn("rep", F.lit("clash"))
    got = minhash.near_duplicates(df, width=width, percent=percent).collect()
    assert len(got) == len(corpus) + 3
    sets = {}
    for i, t in enumerate(corpus):
        w = clean_words(t)
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    links = {i: [j for j in sets if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in sets}
    want = smallest(links, sets)
    assert all((r.n_shingles, r.component) == (len(sets[r.id]), want[r.id]) for r in got)
    kept = minhash.keep_one(df, width=width, percent=percent)
    assert {r.doc_id for r in kept.collect()} == set(want.values())
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_minhash_nulls(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, None), (2, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((r.id or -1, r.component or -1) for r in minhash.near_duplicates(df).collect()) == [(-1, -1), (-1, -1), (1, 1), (2, 2)]


def shingle_set(text, width):
    w = clean_words(text)
    return {tuple(w[j : j + width]) for j in range(len(w) - width + 1)}


def test_minhash_keeps_sets_with_own_shingles(spark):
    """A set that holds another one whole may have 15 in 100 shingles of its own, and still link at 0.85."""
    rng = random.Random(4)
    core, own = words(rng, 1002, 10**9), words(rng, 150, 10**9)
    texts = spark.createDataFrame([(1, " ".join(core)), (2, " ".join(core + own)), (3, " ".join(core + own + words(rng, 30, 10**9)))], "rep long, text string")
    hashed = minhash.shingle_sets(texts.where("rep < 3"), 3)
    assert {r.rep for r in minhash._linkable(hashed, 85).collect()} == {1, 2}
    assert {r.rep for r in minhash._linkable(minhash.shingle_sets(texts.where("rep <> 2"), 3), 85).collect()} == {1}


def test_minhash_finds_links_in_shared_buckets(spark):
    """Sets that meet in many buckets and mostly don't link, with six planted pairs of a set and a part of it."""
    rng = random.Random(31)
    blocks = [" ".join(words(rng, 30, 10**9)) for _ in range(100)]
    texts = [" ".join(blocks[i] for i in sorted(rng.sample(range(100), 90))) for _ in range(300)]
    for _ in range(6):
        part = " ".join(blocks[i] for i in sorted(rng.sample(range(100), 72)))
        texts += [part, part + " " + " ".join(words(rng, round(0.139 * 72 * 30), 10**9))]
    order = rng.sample(range(len(texts)), len(texts))
    got = {r.id: r.component for r in minhash.near_duplicates(frame(spark, texts, order), width=3, percent=85).collect()}
    sets = {i: shingle_set(t, 3) for i, t in zip(order, texts, strict=True)}
    links = {i: [] for i in sets}
    for i, j in itertools.combinations(sets, 2):
        both = len(sets[i] & sets[j])
        if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            links[i].append(j)
            links[j].append(i)
    assert sum(map(len, links.values())) >= 12
    assert got == smallest(links, sets)


# --- exact substrings ----------------------------------------------------------------------------------------------------


def brute_repeats(texts, length=100):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        m = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            k = b[j : j + length]
            if k in seen:
                m[j : j + length] = True
            seen.add(k)
        out[i] = (len(b), int(m.sum()), int(np.diff(np.r_[0, m.astype(int)]).clip(0).sum()), np.frombuffer(b, np.uint8)[~m].tobytes())
    return out


def test_bwt(spark, corpus):
    rng = random.Random(5)
    line = " ".join(words(rng, 25))
    texts = [*corpus[:-2], line * 3, line + "\0" + line, "ab" * 300, "x" * 5000, "ab" * 120 + line[:110]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in bwt.remove_repeats(frame(spark, texts)).collect()}
    assert got == brute_repeats(texts)
    assert bwt.remove_repeats(frame(spark, texts).limit(0)).count() == 0


def test_bwt_of_repeated_rows_and_clashing_names(spark):
    rng = random.Random(6)
    t, u = " ".join(words(rng, 60)), " ".join(words(rng, 60))
    df = spark.createDataFrame([(1, t), (1, t), (2, u), (3, t + u), (None, t)], "doc_id long, text string").withColumns({"doc": F.lit(1), "t": F.lit(2), "_s": F.lit(3)})
    got = sorted((r.doc_id or 0, r.n_removed) for r in bwt.remove_repeats(df).collect())
    want = {i: n for i, (_, n, _, _) in brute_repeats([None, t, u, t + u]).items()}
    assert got == sorted([(0, 0), (1, 0), (1, 0), (2, 0), (3, want[3])])


def test_merged_transforms_group_equal_prefixes():
    rng = random.Random(2)
    segments = [(i, 0, bytes(rng.choice(b"ab") for _ in range(rng.randrange(20, 60)))) for i in range(200)]
    shards = [bwt.Shard([s[2] for s in segments[k : k + 50]], 12) for k in range(0, 200, 50)]
    seg, place, group = bwt.merge(shards, 12)
    by_group, by_text = {}, {}
    for s, p, g in zip(seg, place, group, strict=True):
        if p + 12 <= len(segments[s][2]):
            by_group.setdefault(int(g), set()).add((int(s), int(p)))
            by_text.setdefault(segments[s][2][p : p + 12], set()).add((int(s), int(p)))
    assert sorted(map(sorted, by_group.values())) == sorted(map(sorted, by_text.values()))


# --- scores --------------------------------------------------------------------------------------------------------------


def test_ctw_counts_and_base(spark, corpus):
    df = frame(spark, [*corpus, corpus[0]])
    got = {r.doc_id: r for r in ctw.score(df, F.col("doc_id") % 5 != 0, block_bytes=20000).collect()}
    assert len(got) == len(corpus) + 1
    count, total = {}, 0
    for i, t in enumerate([*corpus, corpus[0]]):
        if i % 5:
            for w in [*clean_words(t), None]:
                count[w] = count.get(w, 0) + 1
                total += 1
    for i, t in enumerate([*corpus, corpus[0]]):
        tokens = [*clean_words(t), None]
        base = sum(np.log10((count.get(w, 0) + 0.1) / (total + 0.1 * (len(count) + 1))) for w in tokens)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens), sum(w in count for w in tokens), total)
        assert abs(got[i].base_score - base) < 1e-6 * max(1, abs(base))
        assert got[i].score < 0


def test_ctw_is_a_distribution():
    """Over all bytes after one context, seen or not, probabilities add up to one; and they equal the recursive definition."""
    rng = random.Random(4)
    data = bytes(rng.choice(b"abra ") for _ in range(400))
    depth = ctw.DEPTH
    code = np.array([int.from_bytes(data[i - depth : i + 1], "big") for i in range(depth, len(data))], np.int64)
    codes, n = np.unique(code, return_counts=True)
    ctx = int.from_bytes(data[10 : 10 + depth], "big")
    every = np.array([ctx << 8 | b for b in range(256)], np.int64)
    all_codes = np.union1d(codes, every)
    counts = np.zeros(len(all_codes), np.int64)
    counts[np.searchsorted(all_codes, codes)] = n
    found, bit = ctw.levels(all_codes, counts, depth, 0)
    pred, known = np.full(bit.shape, 0.5), np.zeros(bit.shape, bool)
    for d in range(depth, -1, -1):
        pred, known = ctw.blend(pred, known, *found[d].estimate(bit))
    p = pred.prod(axis=0)[np.searchsorted(all_codes, every)]
    assert abs(p.sum() - 1) < 1e-9
    assert p.argmax() in data


def test_ctw_beats_words_on_held_out_text(spark):
    got = queries.op7_ctw(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_ctw_edges(spark):
    df = spark.createDataFrame([(None, None), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert ctw.score(df, F.lit(False)).count() == 3
    assert ctw.score(df.limit(0), F.lit(True)).count() == 0


# --- passages ------------------------------------------------------------------------------------------------------------


def test_passages_find_every_verbatim_repeat(spark, corpus):
    df = frame(spark, corpus)
    got = {r.doc_id: r for r in passages.by_document(df).collect()}
    first, n = {}, 0
    for i, t in enumerate(corpus):
        w = clean_words(t)
        cover = set()
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), i) < i:
                cover |= set(range(j, j + 50))
        mine = {k for s in got[i].spans for k in range(s.start, s.end)}
        assert cover <= mine
        assert (got[i].n_words, got[i].n_dup_words) == (len(w), len(mine))
        n += len(cover)
    assert n > 300
    assert got[3].n_dup_words == 0
    cut = {r.doc_id: r.text for r in passages.cut_passages(df).collect()}
    assert 20 not in cut and cut[3] == corpus[3] and None in cut.values()
    assert passages.by_document(df.limit(0)).count() == 0
    clash = frame(spark, [corpus[0], corpus[20], corpus[0], None], [1, 2, 2, None]).withColumns({"doc": F.lit(1), "_spans": F.lit(2), "_raw": F.lit(3)})
    assert sorted((r.doc_id or 0, r.doc, r._spans, r._raw) for r in passages.cut_passages(clash).collect()) == [(0, 1, 2, 3), (1, 1, 2, 3)]


def edited(rng, text, every):
    return [f"e{rng.random()}" if k % every == every - 1 else w for k, w in enumerate(text)]


def test_passages_beside_text_with_more_edits():
    rng = random.Random(11)
    hashes = lambda *texts: [passages.Words([" ".join(t).encode()]).shingles(passages.WIDTH, short=False)[0] for t in texts]
    for n, at, every in [(70, [35], 9), (120, [40, 80], 10), (90, [], 8)] * 20:
        side, core, other = words(rng, 90, 10**6), words(rng, n, 10**6), words(rng, 90, 10**6)
        close = [f"e{rng.random()}" if k in at else w for k, w in enumerate(core)]
        a, b = hashes([*edited(rng, side, every), *close, *edited(rng, other, every)], [*words(rng, 7, 10**6), *side, *core, *other])
        seed = 90 + n // 4
        found = passages.compare(a, b, [(seed, seed + 7)], 50, 80)
        assert set(range(92, 88 + n)) <= {k for s, e, _ in found for k in range(s, e)}
        for s, e, how in found:
            best = max(passages._similar(a[s : e - 4], b[x:y], 80)[1] for x in range(s + 5, s + 10) for y in range(e + 1, e + 6))
            assert e - s >= 50 and 0.8 <= how <= best


def test_passages_of_covered_windows_and_second_copies(spark):
    rng = random.Random(12)
    new = lambda n: words(rng, n, 10**6)
    texts: list[list[str]] = []
    for _ in range(6):
        core, line, foot = new(120), new(30), new(60)
        # 30 words with the first, 60 with the second, of which the first covers a part
        texts += [[*new(9), *core[30:], *new(9)], [*new(5), *core, *new(5)], [*new(7), *core[:60], *new(7)]]
        texts += [[*new(50), *line, *new(50)] for _ in range(4)]
        around = [*new(20), *line, *new(20)]
        texts += [[*new(10), *around, *new(10)], [*new(30), *line, *new(30)], [*new(20), *around]]
        texts += [[*new(30), *foot], [*new(20), *foot, *new(30), *foot, *new(25), *foot]]
        texts += [[*line, *new(70), *foot[:45], *new(20), *core[20:70]]]
    df = frame(spark, [" ".join(t) for t in texts])
    got = {r.doc_id: {k for s in r.spans for k in range(s.start, s.end)} for r in passages.by_document(df).collect()}
    first: dict[tuple, int] = {}
    for i, t in enumerate(texts):
        cover = set()
        for j in range(len(t) - 49):
            if first.setdefault(tuple(t[j : j + 50]), i) < i:
                cover |= set(range(j, j + 50))
        assert got[i] == cover


def near_copy(rng, text, at):
    return [f"e{rng.random()}" if k in at else w for k, w in enumerate(text)]


def test_windows_meet_for_every_near_copy():
    """One edit in the middle of 50 words leaves runs of 20 and 21 shingles: the hardest place."""
    rng = random.Random(31)
    for _ in range(300):
        core = words(rng, rng.choice([50, 51]), 10**6)
        texts = [" ".join([*words(rng, 40, 10**6), *t, *words(rng, 40, 10**6)]).encode() for t in (core, near_copy(rng, core, [25]))]
        other = passages._windows(texts, np.array([1, 2]), 50)[3]
        assert (other == 1).any()


def test_near_copies_of_texts_that_are_not_the_first_of_their_group(spark):
    """Many texts share a line, the first one among them; near copies, in the order of ids, stand far apart. `many_docs` 4: by a shared shingle."""
    rng = random.Random(32)
    new = lambda n: words(rng, n, 10**6)
    line = new(44)
    cores = [[*new(6), *line] for _ in range(6)]
    texts = [[*new(40), *line, *new(40)] for _ in range(3)]
    texts += [[*new(20), *c, *new(20)] for c in cores]
    texts += [[*new(25), *near_copy(rng, c, [5]), *new(25)] for c in cores[3:] + cores[:3]]
    texts += [[*new(40), *line, *new(40)] for _ in range(2)]
    df = frame(spark, [" ".join(t) for t in texts])
    for many in (100, 4):
        got = {r.doc_id: list(r.links) for r in passages.by_document(df, many_docs=many).collect()}
        assert got == {i: [[6, 7, 8, 3, 4, 5][i - 9]] if 9 <= i < 15 else [] for i in range(len(texts))}


def test_near_copies_that_share_only_common_shingles(spark):
    """Two lines that more than `many_docs` texts have stand beside each other in two texts only, with another word between them."""
    rng = random.Random(36)
    new = lambda n: words(rng, n, 10**6)
    lines = [new(26), new(26)]
    alone = lambda: [[*new(30), *line, *new(30)] for line in lines for _ in range(3)]
    pair = lambda: [*new(20), *lines[0], *new(1), *lines[1], *new(20)]
    texts = [*alone(), pair(), *alone(), pair(), *alone()]
    df = frame(spark, [" ".join(t) for t in texts])
    got = {r.doc_id: [(s.start, s.end, s.other) for s in r.spans] for r in passages.by_document(df, many_docs=4).collect()}
    assert got == {i: [(20, 73, 6)] if i == 13 else [] for i in range(len(texts))}


def test_places_of_common_shingles():
    rng = np.random.default_rng(37)
    for _ in range(30):
        n = int(rng.integers(1, 220))
        h = np.arange(n) if rng.random() < 0.5 else rng.integers(0, 60, n)
        common = (rng.random(300) < rng.choice([0.8, 0.9]))[h]
        c = np.arange(max(0, n - passages.RUN + 1))
        want = np.zeros(n, bool)
        for i in range(n):
            for size in range(46, min(n - i, 128) + 1):
                own = len(set(h[i : i + size].tolist()))
                has = len(set(h[i : i + size][common[i : i + size]].tolist()))
                if own > 1 and 100 * has >= 80 * own and (own < size or 180 * has >= 80 * (own + 46)):
                    want[i : i + size - passages.RUN + 1] = True
        assert (passages._dense(common, h.astype(np.uint64), c, 46, 80) == want[: len(c)]).all()


def test_known_passages_are_not_compared_again():
    rng = np.random.default_rng(38)
    core, hashes = rng.integers(0, 2**63, 100, dtype=np.uint64), lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    a, b = np.r_[hashes(40), core, hashes(40)], np.r_[hashes(9), core, hashes(9)]
    for known, want in [([], [(40, 144)]), ([(40, 144)], []), ([(30, 90), (90, 150)], []), ([(41, 144)], [(40, 144)]), ([(0, 100)], [(40, 144)])]:
        assert [(s, e) for s, e, _ in passages.compare(a, b, [(60, 29)], 50, 80, known)] == want


def test_every_window_of_a_pivot_meets_other_chunks():
    """A line stands twice in a text, the second time within a passage that is its own: the first of a chunk keeps both windows."""
    rng = random.Random(33)
    new = lambda n: words(rng, n, 10**6)
    line = new(60)
    text = " ".join([*new(60), *line, *new(60), *line, *new(60)]).encode()
    key, _, c, _, oc, own = passages._windows([text, " ".join(line).encode()], np.array([5, 6]), 50)
    assert (oc[c < 0] >= 0).all()
    places = {k: sorted(c[(key == k) & (oc == passages.NONE)].tolist()) for k in set(own[oc >= 0].tolist())}
    assert len(places) > 2 and any(len(x) > 1 and x[-1] - x[0] == 120 for x in places.values())


def test_seeds_that_can_lie_in_a_passage():
    rng = np.random.default_rng(34)
    for _ in range(60):
        rows = [rng.random(rng.integers(0, 300)) < rng.choice([0.6, 0.75, 0.8, 0.85]) for _ in range(4)]
        seeds = [(r, int(c)) for r, x in enumerate(rows) for c in (rng.integers(0, len(x), 5) if len(x) else [])]
        got = passages._promising(np.concatenate(rows), np.r_[0, np.cumsum([len(x) for x in rows])], *np.array(seeds).reshape(-1, 2).T, 46, 80)
        for ok, (r, c) in zip(got, seeds, strict=True):
            sums = np.r_[0, np.cumsum(np.where(rows[r], 20, -80))]
            dense = any(sums[j] >= sums[i] for i in range(max(0, c - 128), c + 1) for j in range(i + 46, min(len(sums), i + 129)))
            run = any(s <= c <= e and e - s >= 45 for s, e in passages._runs(np.flatnonzero(rows[r]), passages.GAP)) if rows[r].any() else False
            assert ok == (dense or run)


def test_passages_of_copies(spark):
    rng = random.Random(35)
    new = lambda n: words(rng, n, 10**6)
    core = new(70)
    texts = [[*new(20), *core], [*core, *new(30)], [*new(9), *core, *new(9)]]
    ids = [1, 2, 3, 4, 5, 6]
    df = frame(spark, [" ".join(t) for t in [texts[0], texts[1], texts[0], texts[2], texts[1], texts[1]]], ids)
    got = {r.doc_id: ([(s.start, s.end, s.other) for s in r.spans], r.n_dup_words, r.component) for r in passages.by_document(df).collect()}
    assert got[1] == ([], 0, 1) and got[2] == ([(0, 70, 1)], 70, 1) and got[3] == ([(0, 90, 1)], 90, 1)
    assert got[4] == ([(9, 79, 1)], 70, 1) and got[5] == got[6] == ([(0, 100, 2)], 100, 1)
    assert passages._copies(df.selectExpr("doc_id as doc", "text"), 50).count() == 3


def test_compact_windows():
    rng = np.random.default_rng(7)
    v = rng.integers(0, 2**63, 300, dtype=np.uint64)
    got = set(zip(*(x.tolist() for x in passages.compact_windows(v, np.array([0]), np.array([300]), 20)), strict=True))
    want = set()
    for c in range(300):
        l = r = c
        while l > 0 and v[l - 1] > v[c]:
            l -= 1
        while r < 299 and v[r + 1] > v[c]:
            r += 1
        if r - l + 1 >= 20:
            want.add((c, l, r))
    assert got == want


# --- mixing --------------------------------------------------------------------------------------------------------------


def brute_mixture(sizes, weights, block):
    """Slots of all blocks, one after the other over the whole length, by exact fractions."""
    total = sum(weights.values())
    share = {k: Fraction(w, total) for k, w in weights.items()}
    blocks = [(j / share[k], (j + 1) / share[k], k, j) for k in share for j in range(-(-sizes[k] // block))]
    return {(k, j): (math.floor(a), math.ceil(b)) for a, b, k, j in blocks}


def test_mixture_stays_within_a_block_of_any_weights(spark):
    weights = {"a": 1_000_000, "b": 2, "c": 333, "d": 250_000, "e": 600_000}
    sizes = {"a": 4000, "b": 5, "c": 40, "d": 900, "e": 2500}
    rows = [(i, "t", None, s, 1) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), weights=weights, block=4, frame=64).collect()
    want = brute_mixture(sizes, weights, 4)
    by_slot = {r.slot: (r.source, r.block) for r in got}
    assert len(got) == len(rows) and len(by_slot) == len(want) and len({r.place for r in got}) == len(rows)
    near = lambda r: max(abs(r.release - want[r.source, r.block][0]), abs(r.deadline - want[r.source, r.block][1])) <= 1
    assert all(near(r) and r.release <= r.slot < r.deadline for r in got)
    # until a source runs out, each has within one block of its share
    done = dict.fromkeys(weights, 0)
    total = sum(weights.values())
    for slot in range(min(max(j for k, j in want if k == s) * total // weights[s] for s in weights)):
        done[by_slot[slot][0]] += 1
        assert all(abs(done[k] - Fraction(weights[k] * (slot + 1), total)) < 1 + 1e-6 for k in weights)


def test_mixture_of_many_sources(spark):
    rows = [(i, "t", None, f"s{i % 1500}", 1) for i in range(6000)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), block=1).collect()
    assert len(got) == 6000 and sorted(r.slot for r in got) == list(range(6000))
    assert all(r.release <= r.slot < r.deadline for r in got)


def test_sources_without_weight_come_last(spark):
    rows = [(i, "t", None, ["a", "b", None, "zero"][i % 4], 1) for i in range(400)]
    got = sorted(mixing.mix(spark.createDataFrame(rows, DOCS), weights={"a": 0.5, "b": 0.25, "zero": 0}, block=4).collect(), key=lambda r: r.place)
    assert len({r.place for r in got}) == 400
    assert {r.source for r in got[:200]} == {"a", "b"} and {r.source for r in got[200:]} == {None, "zero"}


def test_mix(spark):
    rows = [(i if i % 50 else None, "t", None, None if i % 7 == 0 else f"s{i % 3 if i % 2 else 0}", 1) for i in range(3000)] + [(1, "t", None, "s0", 1)] * 5
    df = spark.createDataFrame(rows, DOCS).withColumns({"slot": F.lit("clash"), "_key": F.lit(1), "_u": F.lit(2), "_g": F.lit(3)})
    got = mixing.mix(df, block=8, frame=100).collect()
    assert len(got) == 3005
    assert len({r.place for r in got}) == 3005
    assert all(r.release <= r.slot < r.deadline and (r._key, r._u, r._g) == (1, 2, 3) for r in got)
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.ordered(df, block=8).columns == df.columns
    # places don't depend on how the rows were dealt
    places = lambda d: sorted((r.place, r.doc_id or -1) for r in mixing.mix(d, block=8, frame=100).collect())
    assert places(df) == places(df.repartition(7, "n_chars", "text", "doc_id"))


# --- tokens --------------------------------------------------------------------------------------------------------------


def test_bpe_equals_library(spark, corpus):
    import tiktoken
    from public_tokenizers import PATTERN

    ranks = bpe.read_ranks(queries.vocabulary())
    tool = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    noise = ["".join(rng.choice("ab's tlre'vmd 1²３\n\t  é漢!.,-'' 😀　ſ́'") for _ in range(rng.randrange(40))) for _ in range(2000)]
    df = frame(spark, [*corpus, *noise]).withColumn("n_tokens", F.lit("clash"))
    got = bpe.decode(bpe.encode(df, queries.vocabulary()), queries.vocabulary()).collect()
    texts = [*corpus, *noise]
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id] or ""
        want = tool.encode_ordinary(t)
        assert np.frombuffer(bytes(r.token_ids), "<u4").tolist() == want and r.n_tokens == len(want)
        assert bytes(r.decoded) == t.encode()
    once = bpe.encode_and_decode(df.withColumn("decoded", F.lit(1)), queries.vocabulary())
    assert once.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids", "decoded"]
    assert sorted((r.doc_id, r.n_tokens, bytes(r.token_ids), bytes(r.decoded)) for r in once.collect()) == sorted((r.doc_id, r.n_tokens, bytes(r.token_ids), bytes(r.decoded)) for r in got)
    assert bpe.encode(df.limit(0), queries.vocabulary()).count() == 0
    assert bpe.encode(df.limit(3), queries.vocabulary()).select(bpe.unpack()).first()[0] == tool.encode_ordinary(texts[0])


# --- addresses -----------------------------------------------------------------------------------------------------------


def test_urls(spark):
    urls = ["https://A.Example.ORG/es/1?x", "http://a.example.org/en/12", "http://com/fr/x", "http://notcom/fr/x", None, "no scheme", "https://x.com#y", "https://x.com/de/1", "https://x.com/de/2.html", "ftp://net/a/b/c/d/e/f/g/h/i/j"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    got = {r.page_id: r for r in urltree.judge(df).collect()}
    assert len(got) == len(urls)
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert (got[1].rule, got[2].verdict, got[3].rule) == ("example.org/en/1", "allow", None)
    assert (got[4].host, got[4].path, got[5].host, got[6].path) == ("", "", "", "")
    assert got[8].template == "/de/*.html" and got[9].template == "/a/b/c/d/e/f/g/h/**"
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert urltree.judge(df.limit(0)).count() == 0


def test_similar_branches_share_their_labels(spark):
    """Branches without labels take those of their siblings, of all of the host where those have none, of all hosts at last."""
    rows = [f"http://a.com/de/{w}" for w in "abcdefgh"] + ["http://a.com/de/x/y"] * 3 + ["http://a.com/en/p", "http://a.com/en/q/r", "http://b.net/x", *(f"http://c.com/fr/{w}" for w in "abc"), "http://c.com/es/a"] + [None, None]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").withColumns({"_seg": F.lit(1), "_parts": F.lit(2), "n": F.lit(3), "parent": F.lit(4), "_given": F.lit(5)})
    got = {r.page_id: r for r in urltree.judge(df).collect()}
    assert len(got) == len(rows) and all((r._seg, r._parts, r.n, r.parent, r._given) == (1, 2, 3, 4, 5) for r in got.values())
    verdicts = {rows[i]: r.verdict for i, r in got.items()}
    assert verdicts["http://a.com/en/p"] == verdicts["http://a.com/en/q/r"] == "block"
    assert verdicts["http://c.com/es/a"] == "allow"
    prior = (11 + 0.5) / (14 + 2)
    host = (11 + 2 * prior) / (11 + 2)
    assert abs(got[11].purity - (0 + 2 * host) / 2) < 1e-9 and got[0].purity == got[3].purity
    assert abs(next(r for i, r in got.items() if rows[i] == "http://b.net/x").purity - prior) < 1e-9


def test_templates_decide_against_their_host(spark):
    rules = [("a.com", "/bad/", "block"), ("b.com", "/good/", "allow"), ("c.com", "/en/1", "block"), ("c.com", "/en/2", "allow")]
    rows = [f"http://a.com/bad/{i}" for i in range(20)] + [f"http://b.com/good/{i}" for i in range(20)] + [f"http://b.com/bad/{i}" for i in range(3)]
    rows += [f"http://c.com/en/{k}{i}{end}" for k in (1, 2) for i in range(10) for end in ("", ".html")][:-1]
    rows += [f"http://c.com/en/1{i}.php" for i in range(20)] + ["http://c.com/en/3.html", "http://c.com/en/3.php", "http://d.com/new/page"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").withColumn("basis", F.lit(1))
    got = {rows[r.page_id]: r for r in urltree.judge(df, rules=rules).collect()}
    for i in range(3):  # the host has 20 pages allowed, none blocked; the same template elsewhere is blocked
        r = got[f"http://b.com/bad/{i}"]
        assert (r.rule, r.verdict, r.template, r.basis) == (None, "block", "/bad/*", "template")
    # siblings of 10/20 and 10/19 are one branch, 20/20 is one of its own
    prior = (20 + 20 + 20 + 0.5) / (20 + 20 + 39 + 20 + 2)
    host = (40 + 2 * prior) / (59 + 2)
    siblings = (40 + 2 * host) / (59 + 2)
    html = (20 + 2 * (10 + 2 * siblings) / (19 + 2)) / (39 + 2)
    php = (20 + 2 * (20 + 2 * siblings) / (20 + 2)) / (20 + 2)
    for url, want, verdict in [("http://c.com/en/3.html", html, "block" if html > 0.5 else "allow"), ("http://c.com/en/3.php", php, "block")]:
        assert abs(got[url].purity - want) < 1e-12 and (got[url].verdict, got[url].basis) == (verdict, "branch")
    assert got["http://d.com/new/page"].basis == "prior" and got["http://a.com/bad/0"].basis == "rule"
    assert abs(got["http://d.com/new/page"].purity - prior) < 1e-12


def test_hot_hosts_are_dealt(spark, monkeypatch):
    """With a low threshold of what is hot, hosts, templates and branches take their salted and broadcast ways; verdicts stay."""
    rows = [f"http://{h}.com/{d}/{i}{end}" for h in ("a", "b", "c") for d in ("de", "en", "fr", "x") for i in range(12) for end in ("", ".html")]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    rules = [("com", "/fr/", "allow"), ("com", "/de/1", "block"), ("a.com", "/en/", "block"), ("b.com", "/x/1", "block")]
    want = sorted(tuple(r) for r in urltree.judge(df, rules=rules).collect())
    monkeypatch.setattr(urltree, "HOT", 3)
    monkeypatch.setattr(urltree, "HOSTS", 40)
    got = sorted(tuple(r) for r in urltree.judge(df, rules=rules).collect())
    assert [r[:-2] + r[-1:] for r in got] == [r[:-2] + r[-1:] for r in want]
    assert all(abs(x[-2] - y[-2]) < 1e-12 for x, y in zip(got, want, strict=True))


def test_minhash_pivots_with_many_members(spark, monkeypatch):
    """A pivot's members are dealt over several tasks; links are the same as by full sets."""
    rng = random.Random(12)
    core = words(rng, 120)
    texts = [" ".join(core[:i] + ["x%d" % i] + core[i + 1 :]) for i in range(0, 120, 6)] + [" ".join(words(rng, 60)) for _ in range(5)]
    monkeypatch.setattr(minhash, "MEMBERS", 3)
    got = {r.id: r.component for r in minhash.near_duplicates(frame(spark, texts), width=3, percent=85).collect()}
    sets = [shingle_set(t, 3) for t in texts]
    links = {i: [j for j in range(len(sets)) if j != i and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])] for i in range(len(sets))}
    assert sum(map(len, links.values())) > 200 and got == smallest(links, range(len(texts)))
