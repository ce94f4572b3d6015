"""Sketches, their estimate, and near duplicates against brute force."""

import random
import re

import numpy as np
import pytest

from sieveworks.llm import jaccard, setsketch
from sieveworks.llm.setsketch import bands, compare, may_link, most_likely, sketches

DOCS = "doc_id long, text string, class long, token string, id long"


def random_set(n, seed):
    return np.unique(np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64))


def pair(n, similarity, seed):
    """Two sets of n with about this similarity."""
    pool, same = random_set(2 * n, seed), round(n * 2 * similarity / (1 + similarity))
    pool = np.random.default_rng(seed).permutation(pool)
    return np.sort(pool[:n]), np.sort(pool[n - same : 2 * n - same])


def test_sketches_merge():
    a, b = random_set(300, 1), random_set(40, 2)
    left, right, both = sketches([a, b, np.union1d(a, b)])
    assert (np.maximum(left, right) == both).all()


def test_a_sketch_depends_on_its_set_alone():
    sets = [random_set(n, n) for n in (1, 2, 7, 30, 500, 6000)]
    together, empty = sketches(sets), np.empty(0, np.uint64)
    assert all((sketches([s])[0] == t).all() for s, t in zip(sets, together))
    assert not sketches([empty, sets[0]])[0].any() and sketches([]).shape == (0, setsketch.REGISTERS)


@pytest.mark.parametrize("similarity", [0.3, 0.7, 0.85, 0.95])
def test_registers_agree_as_often_as_sets_overlap(similarity):
    agree, estimates, true = [], [], []
    for seed in range(60):
        a, b = pair(400, similarity, seed)
        x, y = sketches([a, b])
        more, less, same = compare(x[None, :], y)
        agree.append(same[0] / setsketch.REGISTERS)
        estimates.append(most_likely(np.array([400.0]), np.array([400.0]), more, less, same)[0])
        true.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert may_link([400], [400], more, less, same, round(similarity * 100) - 1)[0]
    assert np.mean(agree) == pytest.approx(np.mean(true), abs=0.02) and np.mean(estimates) == pytest.approx(np.mean(true), abs=0.02)


def test_estimate_knows_sizes():
    big = random_set(1000, 3)
    part = np.sort(np.random.default_rng(3).permutation(big)[:500])
    x, y = sketches([big, part])
    assert most_likely(np.array([1000.0]), np.array([500.0]), *compare(x[None, :], y))[0] == pytest.approx(0.5, abs=0.1)
    assert not may_link([1000], [500], *compare(x[None, :], y), 85)[0]


def test_bands_meet_at_the_threshold():
    met = 0
    for seed in range(100):
        x, y = bands(sketches(list(pair(200, 0.86, seed))))
        met += bool((x == y).any())
    assert met == 100


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n, percent):
    sets, root = [shingles(t, n) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)), d is not None and d == least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    bases = [rng.choices(vocabulary, k=rng.choice([4, 6, 9, 30, 80, 200])) for _ in range(40)]
    texts = []
    for base in bases:
        for _ in range(rng.choice([1, 2, 6])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words) if rng.random() < 0.5 else "\n".join(words).upper())
    texts += [" ".join(bases[1][:3]), None, "", " \t", "one", "ONE", "word " * 30_000]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("n", "percent", "tile"), [(5, 85, 8192), (5, 85, 3), (3, 60, 4), (5, 100, 8192)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, n, percent, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rows = corpus()
    got = setsketch.near_duplicates(spark.createDataFrame([(*r, 1, "t", 2) for r in rows], DOCS), n, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, n, percent)


def test_near_duplicates_of_null_and_repeated_ids(spark):
    text = " ".join(f"v{i}" for i in range(60))
    rows = [(3, text), (None, text + " more"), (3, text), (3, "an other text with this id"), (None, None), (2, "less " + text), (None, "alone as no other has these words")]
    got = setsketch.near_duplicates(spark.createDataFrame([(*r, 1, "t", 2) for r in rows], DOCS), 5, 85)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 5, 85)


def test_near_duplicates_of_an_empty_table(spark):
    assert setsketch.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
