import random

import numpy as np
import pytest

from duelgrid.llm import neardup


def brute(data):
    """Words, shingles, every pair, components."""
    def words(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return [w for w in "".join("\0" if c in " \t\n\x0b\x0c\r" else c for c in low).split("\0") if w]

    sets = {}
    for i, t in data:
        w = words(t)
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def near_copies(seed, n=140, words=90):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(60)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
            own[rnd.randrange(len(own))] += rnd.choice("xyz")
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [384, 25])
def test_against_all_pairs(documents, rows, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", block)
    rnd = random.Random(8)
    texts = near_copies(1) + near_copies(2, 40, 30) + [" ".join(rnd.choices([f"v{k}" for k in range(400)], k=80)) for _ in range(60)]
    texts += ["One two\x0bthree", "one TWO three", "one two three four", "é É", "É É", "one two three", "a b c d e", "a b c d e f", "", None, "  \n"]
    rnd.shuffle(texts)
    data = list(enumerate(texts))
    assert sorted(rows(neardup.near_duplicates(documents(data)))) == brute(data)


def test_odd_rows(odd, clashing, none, rows):
    found = rows(neardup.near_duplicates(odd))
    assert found == rows(neardup.near_duplicates(clashing))
    assert [r for r in found if r[0] is None] == [(None, 0, None, True), (None, 1, None, True)]
    assert [r for r in found if r[0] is not None] == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 5, True), (5, 1, 5, True)]
    assert neardup.near_duplicates(none).collect() == []


def test_very_long_texts(documents, rows):
    rnd = random.Random(4)
    long = [f"w{rnd.randrange(9000)}" for _ in range(60_000)]
    other = list(long)
    for k in range(0, 60_000, 200):
        other[k] += "x"
    data = [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(long[:30_000]))]
    found = rows(neardup.near_duplicates(documents(data)))
    assert [r[2] for r in found] == [1, 1, 3]


def test_one_of_each_group_stays(documents):
    data = [(3, "a b c d e f g"), (1, "a b c d e f g"), (2, "another text of some seven words"), (None, "a b c d e f g"), (4, None)]
    found = neardup.one_of_each(documents(data))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id or 0 for r in found.collect())) == [0, 1, 2, 4]


def test_posterior_bounds_grow_and_spare_true_pairs():
    bounds = neardup.least_matches()
    assert bounds[-1][0] == neardup.HASHES and all(a[1] < b[1] for a, b in zip(bounds, bounds[1:]))
    rnd = np.random.default_rng(1)
    agree = rnd.random((200_000, neardup.HASHES)) < 0.85
    lost = sum((agree[:, :n].sum(axis=1) < least).sum() for n, least in bounds)
    assert lost <= 10  # far fewer than one in ten thousand


def test_pairs_between_the_thresholds(documents):
    """Pairs alike by 0.80 to 0.85 go at a threshold of 80; op7's 85 links none of them."""
    rnd, data, shares = random.Random(12), [], []
    for k in range(60):
        base = [f"a{k}x{rnd.randrange(10**6)}" for _ in range(104)]
        other = list(base)
        for place in (20, 60):  # 100 shingles each, 90 shared
            other[place] += "z"
        data += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        sets = [{tuple(w[i:i + 5]) for i in range(100)} for w in (base, other)]
        shares.append(100 * len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    assert all(80 <= x < 85 for x in shares)
    assert sorted(r.doc_id for r in neardup.one_of_each(documents(data), least=80).collect()) == list(range(0, 120, 2))
    assert neardup.one_of_each(documents(data)).count() == 120
    assert all(r.component_id % 2 == 0 for r in neardup.near_duplicates(documents(data), least=80).collect())


@pytest.mark.parametrize("least", [50, 70, 80, 85, 95])
def test_bands_follow_the_threshold(least):
    bands, rows = neardup.shape(least)
    assert (1 - (least / 100) ** rows) ** bands <= 1e-6 and neardup.least_matches(least)[-1][0] == bands * rows
    assert neardup.shape(85) == (36, 7)


@pytest.mark.parametrize("salts", [1, 16])
def test_a_class_and_a_bucket_with_most_rows(documents, rows, salts, monkeypatch):
    """Half the rows are equal, a quarter is empty, null or short, the rest near copies of the equal ones."""
    monkeypatch.setattr(neardup, "SALTS", salts)
    base = near_copies(5, 60, 120)
    data = [(7 * i + 3, base[0]) for i in range(160)] + [(7 * i + 1, ("", None, " ", "a b")[i % 4]) for i in range(80)]
    data += [(7 * i + 5, t) for i, t in enumerate(base)]
    random.Random(2).shuffle(data)
    assert sorted(rows(neardup.near_duplicates(documents(data)))) == brute(data)


def test_ties_join_every_bucket(spark):
    rnd = random.Random(4)
    data = [(0, i) for i in range(300)] + [(1 + rnd.randrange(60), rnd.randrange(200)) for _ in range(150)]
    data = sorted(set(data))
    ties = [(r.u, r.v) for r in neardup.bucket_ties(spark.createDataFrame(data, "band bigint, rep bigint")).collect()]
    hub = [v for _, v in ties].count(0)
    assert hub < 150 and all(u > v for u, v in ties)
    root = {i: i for _, i in data}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in ties:
        root[max(find(u), find(v))] = min(find(u), find(v))
    got = {i: find(i) for i in root}
    root = {i: i for _, i in data}
    first = {}
    for b, i in data:
        x, y = find(first.setdefault(b, i)), find(i)
        root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in root}
