"""Merkle manifest, phrase mining and nearest neighbours against brute force on hand-made tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulcast.llm import common, kmeans_tree, merkle, phrases
from tests.llm.test_corpus_operators import ROWS, SCHEMA


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_positions_are_gapless_and_ordered(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), rng.choice([None, *range(20)])) for _ in range(500)]
    table = spark.createDataFrame(rows, "g string, x long").repartition(7)
    got = common.positions(table, ["g"], ["x"], task_rows=40).collect()
    for g in "ab":
        own = sorted((r["pos"], r["x"]) for r in got if r["g"] == g)
        assert [p for p, _ in own] == list(range(len(own)))
        values = [-1 if x is None else x for _, x in own]
        assert values == sorted(values) and len(own) == sum(r[0] == g for r in rows)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes):
    """Levels of a tree from its nodes to one."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def siblings(levels, place):
    """(before, after) of a node's run on every level."""
    found = []
    for level in levels[:-1]:
        first = place // 8 * 8
        found.append(("".join(level[first:place]), "".join(level[place + 1 : first + 8])))
        place //= 8
    return found


def brute_manifest(rows):
    def leaf(doc, text):
        doc_id, lang, source, n_chars = doc
        parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
        return sha("".join(parts))

    trees = collections.defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in rows:
        doc = (doc_id, lang, source, n_chars)
        hit = doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        other = re.sub("[A-Z]", lambda m: m[0].lower(), text) if hit else text
        trees[lang].append((doc_id, leaf(doc, text), leaf(doc, other)))
    names = sorted(trees, key=lambda lang: b"" if lang is None else b"+" + lang.encode())
    for own in trees.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    levels = {lang: climb([x[1] for x in trees[lang]]) for lang in names}
    top = climb([levels[lang][-1][0] for lang in names])
    out = []
    for k, lang in enumerate(names):
        for place, (doc_id, digest, changed) in enumerate(trees[lang]):
            path = siblings(levels[lang], place) + siblings(top, k)
            now = changed
            for before, after in path:
                now = sha(before + now + after)
            proof = sha("".join(before + after for before, after in path))
            out.append((doc_id, digest, levels[lang][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=str)


def test_manifest_of_odd_rows(docs):
    assert sorted(map(tuple, merkle.manifest(docs).collect()), key=str) == brute_manifest(ROWS)


def test_manifest_of_several_rounds_and_many_trees(spark):
    rows = [(k, f"Text {k % 50}", "en", "s", k, True, 1) for k in range(4200)]  # 8**4 and more: two rounds of blocks
    rows += [(k, f"T {k}", f"l{k % 11}", None, None, True, 1) for k in range(60)]
    rows += [(None, "Lost", "en", "s", 1, True, 1), (None, None, None, None, None, None, None), (7, "Text 7", "en", "s", 7, True, 1)]
    rows += [(5000, "alone", "zz", "s", 1, True, 1), (5001, "x" * 200_000, "é", "s", 1, True, 1)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, merkle.manifest(table).collect()), key=str)
    assert got == brute_manifest(rows)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_of_nothing_and_of_one(spark, empty):
    assert merkle.manifest(empty).collect() == []
    row = (3, None, None, None, None, None, None)
    assert sorted(map(tuple, merkle.manifest(spark.createDataFrame([row], SCHEMA)).collect())) == brute_manifest([row])


def brute_phrases(rows, least, top):
    count, total = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    count[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = set()
        for longer, b in candidates.items():
            for m in range(2, len(longer)):
                for i in range(len(longer) - m + 1):
                    if 100 * b >= 80 * f[longer[i : i + m]]:
                        dropped.add(longer[i : i + m])
        found = []
        for p, a in candidates.items():
            if p not in dropped:
                score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def phrase_rows():
    rng = random.Random(8)
    words = "new york city Hall of the records über naïve a b c".split()
    rows = []
    for k in range(120):
        text = " ".join(rng.choices(words, weights=[9, 9, 7, 3, 5, 5, 2, 2, 2, 1, 1, 1], k=rng.choice([0, 1, 3, 30, 80])))
        text = text.replace("city", "city,") if k % 3 else text.replace("of the", "of\tthe\n")
        rows.append((k, text, ["en", "de", None, "und"][min(3, k % 9)], None, 1, True, 1))
    rows += [(1, None, "en", None, None, None, None), (2, " \t ", "en", None, None, None, None), (3, "the the the " * 5000, "de", None, None, None, None)]
    return rows + rows[:10]


@pytest.mark.parametrize("options", [{}, {"chunk_words": 20, "strip_entries": 3}])
def test_phrases(spark, options):
    rows = phrase_rows()
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, phrases.collocations(table, top=12, least=4, **options).collect()))
    assert got == brute_phrases(rows, 4, 12) and len(got) > 30


def test_phrases_of_odd_rows(docs, empty):
    assert sorted(map(tuple, phrases.collocations(docs, least=3).collect())) == brute_phrases(ROWS, 3, 2000)
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(docs, least=10**6).collect() == []


def test_phrase_scores_beyond_64_bits(spark):
    level = spark.createDataFrame([("en", 10**13)], "lang string, a long")
    got = level.select(F.expr(f"cast(a as decimal(20,0)) * cast({phrases.SCALE} as decimal(8,0)) div cast(a + a + 1 as decimal(20,0))")).first()[0]
    assert got == 2000000 * 10**13 // (2 * 10**13 + 1)


def test_dense_and_sparse_counts_agree():
    rng = np.random.default_rng(1)
    for strips in (1, 4):
        cells = rng.integers(0, 5000, 20000) * strips + strips - 1
        counts = rng.integers(1, 9, 20000)
        want = collections.Counter()
        for c, n in zip(cells.tolist(), counts.tolist()):
            want[c] += n
        for area in (5000 * strips, 1 << 60):
            at, sums = phrases.counted(cells, counts, strips, area)
            assert dict(zip(at.tolist(), sums.tolist())) == want
    assert all(len(x) == 0 for x in phrases.counted(np.zeros(0, np.int64), np.zeros(0, np.int64), 1, 1 << 60))


def test_tiles_cover_the_pair_space():
    stream = np.array([0, 1023, 1024, 2047, 2048, 5000, -1, 70000, 3, 70000, 3, 2**33])
    tile, cell, counts, where, inverse = phrases.pairs_of(stream)
    row, col = tile // 64, tile % 64
    left, right = cell // phrases._width(col) + phrases._start(row), cell % phrases._width(col) + phrases._start(col)
    pairs = [(int(left[i]), int(right[i])) for i in inverse]
    assert pairs == [(int(stream[w]), int(stream[w + 1])) for w in where]
    assert (counts == np.bincount(inverse)).all() and counts.max() == 2


def vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 12))
    rows = [(k, (centres[k % 9] + 0.4 * rng.normal(size=12)).tolist()) for k in range(900)]
    rows += [(k, rows[50][1]) for k in range(900, 1000)]  # a common vector
    rows += [(k, [2 * x for x in rows[k][1]]) for k in range(100, 120)]  # repeated ids, parallel vectors
    rows += [(1000, None), (1050, []), (1100, [0.0] * 12), (1150, [1.0] * 11 + [math.nan]), (1200, [1.0] * 11 + [None]), (1250, [math.inf] * 12)]
    rows += [(None, rows[3][1]), (1300, [1e300] * 12), (1350, [1e-300, *[0.0] * 11]), (1400, [1.0, 2.0]), (1450, [2.0, 1.0]), (1500, [1.0])]
    return rows


VECTORS = vectors()


def brute_nearest(rows, every, k):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = [v / np.abs(v).max() for _, v in good]
    unit = [v / np.sqrt((v * v).sum()) for v in unit]
    out = {}
    for a, (i, v) in enumerate(good):
        if i % every == 0:
            scores = sorted((-round(float(unit[a] @ unit[b]), 12), j) for b, (j, w) in enumerate(good) if b != a and len(w) == len(v))
            out.setdefault(i, []).append([(j, -s) for s, j in scores[:k]])
    return out


@pytest.mark.parametrize(
    "options",
    [
        {"recall": 1.0, "calibrate": 10**6},
        {"recall": 1.0, "calibrate": 10**6, "leaf_rows": 10, "max_sample": 100, "fit_rows": 60, "group_rows": 50, "part_queries": 3},
    ],
)
def test_nearest_neighbours(spark, options):
    table = spark.createDataFrame([(i, v, "x") for i, v in VECTORS], "vec_id long, embedding array<double>, leaf string").repartition(4)
    got = {}
    for r in kmeans_tree.nearest(table, F.col("vec_id") % 50 == 0, k=5, **options).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest(VECTORS, 50, 5)
    want = {i: lists for i, lists in want.items() if any(lists)}
    assert got.keys() == want.keys()
    for i, lists in want.items():
        flat = sorted((rank, round(s, 9)) for own in lists for rank, (_, s) in enumerate(own, 1))
        assert [(rank, round(s, 9)) for rank, _, s in sorted(got[i])] == flat
        if len(lists) == 1:
            assert [(j, round(s, 9)) for _, j, s in sorted(got[i])] == [(j, round(s, 9)) for j, s in lists[0]]


def test_nearest_neighbours_reach_the_recall_asked_for(spark):
    rng = np.random.default_rng(9)
    rows = [(k, rng.normal(size=16).tolist()) for k in range(3000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    near = kmeans_tree.nearest(table, F.col("vec_id") % 10 == 0, k=5, leaf_rows=20, max_sample=400, calibrate=100).collect()
    found = {(r["query_id"], r["vec_id"]) for r in near}
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want = {(i, j) for i, lists in brute_nearest(rows, 10, 5).items() for j, _ in lists[0]}
    assert len(near) == 1500 and len(found & want) >= 0.93 * len(want)


def test_nearest_neighbours_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert kmeans_tree.nearest(none, F.col("vec_id") % 50 == 0).collect() == []
    lone = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert kmeans_tree.nearest(lone, F.col("vec_id") % 50 == 0).collect() == []


def test_a_walk_opens_every_leaf_once_and_the_own_leaf_first():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(500, 6))
    tree = kmeans_tree.Tree(6)
    tree.grow(0, rows, 10, rng)
    tree.freeze()
    own = tree.leaf_of(rows)
    for row, leaf in zip(rows[:20], own[:20]):
        walk = list(tree.best_bins(row))
        assert walk[0] == leaf and sorted(walk) == sorted(tree.walk())
