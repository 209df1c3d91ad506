"""SimHash blocks, spelling variants and shared ranking against brute force, and their edge cases."""

import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
LONG = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i % 7)}{chr(97 + i % 11)}x é{i}" for i in range(3_000))
ROWS = [(0, ""), (1, None), (2, " \n\t"), (3, "one"), (4, "one two"), (5, LONG), (5, LONG), (6, LONG), (7, LONG.replace("w", "v", 2)),
        (None, "a text without an id but with words"), (None, "a text without an id but with words"), (8, "Ünder ünder UNDER-under_under under")]
CLASHING = ["fingerprint", "component", "least", "n", "near", "form", "root", "prefix", "task", "score", "rank", "item", "terms", "ids", "part", "block"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit("own") for c in CLASHING})


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# --- SimHash -------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, near):
    """Smallest index reached, for every index."""
    label = list(range(len(values)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def check_simhash(rows, got):
    prints = [plain_fingerprint(t) for _, t in rows]
    of = components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(list)
    for (doc_id, _), c in zip(rows, of, strict=True):
        least[c].append(doc_id)
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted([(d, f"{p:016x}", min((x for x in least[c] if x is not None), default=None)) for (d, _), p, c in zip(rows, prints, of, strict=True)], key=key)
    assert sorted([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got], key=key) == want


def test_simhash_edges(docs):
    from marketlens.llm.simhash import near_duplicates

    check_simhash(pairs_of(docs), near_duplicates(docs, shingle=3).collect())
    assert near_duplicates(docs.where("false"), shingle=3).count() == 0


def test_simhash_real(real):
    from marketlens.llm.simhash import near_duplicates

    check_simhash(pairs_of(real), near_duplicates(real, shingle=3).collect())


def test_simhash_links_in_dense_runs(spark):
    """Fingerprints around a few centres: long runs of equal keys are searched by flips, short ones by neighbours."""
    from marketlens.llm.graph import connected_components
    from marketlens.llm.simhash import links

    draw = random.Random(3)
    values = {0, (1 << 64) - 1}
    for _ in range(3):
        centre = draw.getrandbits(64)
        for _ in range(250):
            values.add(centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 4))))
    values |= {draw.getrandbits(64) for _ in range(300)}
    values = sorted(values)
    of = components(values, lambda a, b: (a ^ b).bit_count() <= 2)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    found = dict(connected_components(links(prints)).collect())
    groups = lambda labels: {frozenset(g) for g in _groups(labels).values()}
    assert groups(dict(zip(signed, of, strict=True))) == groups({v: found.get(v, v) for v in signed})
    assert len(set(of)) < len(values) - 100


def _groups(labels):
    out = defaultdict(list)
    for value, label in labels.items():
        out[label].append(value)
    return out


def test_keys_cover_every_choice():
    from marketlens.llm.simhash import block_masks

    masks = block_masks()
    assert len(masks) == 15
    for a in range(64):
        for b in range(a):
            assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


# --- spelling ------------------------------------------------------------------------------------------


def plain_words(rows, thinning=97, least_length=5, least_count=3):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % thinning == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def plain_groups(words):
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
    near = defaultdict(set)
    for (a, b), own in holes.items():
        for w in own:
            near[w] |= own - {w}
        if a + b in words:
            near[a + b] |= own
            for w in own:
                near[w].add(a + b)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v.encode()), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def check_spelling(rows, got, **kwargs):
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}
    assert len(found) == len(got)
    assert found == plain_groups(plain_words(rows, **kwargs))


def test_spelling_edges(docs):
    from marketlens.llm.spelling import spelling_groups

    check_spelling(pairs_of(docs), spelling_groups(docs).collect())
    check_spelling(pairs_of(docs), spelling_groups(docs, least_length=1, least_count=1, thinning=2).collect(), least_length=1, least_count=1, thinning=2)
    assert spelling_groups(docs.where("false")).count() == 0


def test_spelling_real(real):
    from marketlens.llm.spelling import spelling_groups

    check_spelling(pairs_of(real), spelling_groups(real).collect())


def test_spelling_in_blocks(real, monkeypatch):
    """Prefixes split into many blocks, small search chunks and single-word leaves give the same."""
    from marketlens.llm import spelling

    for name, value in (("BLOCK", 64), ("ASKS", 128), ("_CHUNK", 50), ("_LEAF", 1)):
        monkeypatch.setattr(spelling, name, value)
    few = real.where("doc_id < 150")
    check_spelling(pairs_of(few), spelling.spelling_groups(few, least_length=3, least_count=1).collect(), least_length=3, least_count=1)


def test_one_edit():
    from marketlens.llm.spelling import code_points, one_edit

    words = ["aab", "aaab", "aaabb", "bab", "aba", "abab", "é", "éa", "aé", "aa", "aaa", "a" * 90, "a" * 91, "a" * 40 + "b" + "a" * 49]
    x, y = (np.array(v) for v in zip(*[(i, j) for i in range(len(words)) for j in range(len(words)) if i != j], strict=True))
    got = one_edit(*code_points(words), x, y)

    def plain(a, b):
        if len(a) == len(b):
            return sum(p != q for p, q in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    assert got.tolist() == [plain(words[i], words[j]) for i, j in zip(x, y, strict=True)]


# --- ranking -------------------------------------------------------------------------------------------


def plain_ranking(docs, items, k=50):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(split(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item_id, text in items:
        scores = []
        for (d, c), size in zip(held, sizes, strict=True):
            m = 100 - 50 + (50 * size * n) // max(length, 1)
            scores.append((sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(split(text)) if t in c), d))
        top = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1]))[:k]
        out += [(item_id, i + 1, d, s) for i, (s, d) in enumerate(top)]
    return out


def rows_of(df):
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()], key=str)


def test_ranking_edges(spark, docs):
    from marketlens.llm.ranking import top_documents

    items = [(1, "one two"), (2, ""), (3, None), (4, "text WITH words, an id; one"), (5, "Ünder under"), (5, "two words"), (5, "two words"),
             (None, "with words"), (6, "absent"), (7, "text with words")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("own") for c in CLASHING})
    want = plain_ranking(pairs_of(docs), list(dict.fromkeys(items)), k=3)
    assert rows_of(top_documents(docs, asked, k=3)) == sorted(want, key=str)
    assert top_documents(docs.where("false"), asked).count() == 0
    assert top_documents(docs, asked.where("false")).count() == 0


def test_ranking_real(spark, real, monkeypatch):
    """Also with items in several groups and blocks, and documents in small slices."""
    from marketlens.llm import ranking

    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = sorted(plain_ranking(pairs_of(real), [(r["item_id"], r["text"]) for r in items.collect()]), key=str)
    assert rows_of(ranking.top_documents(real, items)) == want
    for name, value in (("GROUP_BYTES", 4000), ("ITEM_BLOCK", 5), ("SLICE", 70)):
        monkeypatch.setattr(ranking, name, value)
    assert rows_of(ranking.top_documents(real, items)) == want


def test_shared_sets_add_up():
    from marketlens.llm.ranking import evaluation_order, shared_sets

    held = np.random.default_rng(5).random((40, 60)) < 0.3
    left, uses = shared_sets(held)
    total = {}
    for node in evaluation_order(uses):
        total[node] = left[node].astype(int) + sum((total[u] for u in uses[node]), np.zeros(60, int))
    assert all((total[i] == held[i]).all() for i in range(40))
    assert left.sum() + sum(map(len, uses)) < held.sum()


def test_long_texts_come_in_pieces():
    from marketlens.llm import ranking, simhash
    from marketlens.llm.pieces import pieces

    text = ("word one Two " * 50_000 + "x" * 3_000_000 + " end").encode()
    parts = list(pieces(text, simhash._SPACE))
    assert b"".join(parts) == text and len(parts) > 1
    assert [w for p in parts for w in p.split()] == text.split()
    assert [t for p in ranking.terms(text) for t in p] == re.findall(rb"[0-9a-z\x80-\xff]+", text.lower())
    assert simhash.fingerprint(text[:400_000], 3) == plain_fingerprint(text[:400_000].decode())
