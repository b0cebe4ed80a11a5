import random

import numpy as np
import pytest

from duelgrid.llm import decontam


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choices("abcdefghiklmnoprstuvwxyzé", k=rnd.randint(2, 9))) for _ in range(n))


def benchmark(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")


def edited(text, n, seed):
    rnd, out = random.Random(seed), list(text)
    for _ in range(n):
        k = rnd.randrange(len(out))
        out[k:k + 1] = rnd.choice([[], [rnd.choice("xyz")], [out[k], "q"]])
    return "".join(out)


def distance(pattern, text):
    """Edits between the pattern and the nearest part of the text, whole table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def fold(text):
    return "".join(c.lower() for c in text if c.isalnum())


def test_passages_verbatim_and_edited(spark, documents):
    items = [prose(k, 40) for k in range(12)]
    data = [(0, prose(100, 200))]
    data += [(1 + k, f"{prose(200 + k, 30)} {items[k]} {prose(300 + k, 30)}") for k in range(4)]
    data += [(5 + k, prose(400 + k, 9) + " " + items[4 + k].upper().replace(" ", "!! ")) for k in range(4)]
    data += [(9 + k, prose(500 + k, 9) + edited(items[8 + k], len(items[8 + k]) // 40, k)) for k in range(4)]
    found = {r.doc_id: r for r in decontam.find_leaks(documents(data), benchmark(spark, items)).collect()}
    assert not found[0].contaminated and found[0].item_ids == []
    assert {i: found[i].item_ids for i in range(1, 13)} == {1 + k: [k] for k in range(12)}
    item, a, b, edits = map(int, found[1].regions.split(":"))
    assert fold(data[1][1][a:b]) in fold(items[0]) and edits == 0


def test_filter_and_alignment_against_the_whole_table():
    """Every window that the whole distance table finds within its budget is found, and no other."""
    rnd = random.Random(5)
    items = [prose(k, 12) for k in range(30)]  # one window each
    index = decontam.Index(list(enumerate(items)))
    for k in range(60):
        i = rnd.randrange(len(items))
        doc = prose(900 + k, 6) + edited(items[i], rnd.randrange(9), k) + prose(950 + k, 6)
        (found,) = index.find([doc])
        want = set()
        for j, item in enumerate(items):
            own = fold(item)
            (start, size, budget, _), *_ = decontam.windows(len(own))
            if any(distance(own[s:s + n], fold(doc)) <= budget for s, n, *_ in decontam.windows(len(own))):
                want.add(j)
        assert {x[0] for x in found} == want


def test_alignment_against_the_whole_table():
    rnd = random.Random(6)
    code = lambda s: np.array([ord(c) for c in s], dtype=np.uint32)
    for k in range(300):
        pattern = "".join(rnd.choices("abc", k=rnd.randint(12, 30)))
        region = edited("xx" + pattern + "yy", rnd.randrange(5), k)
        got, budget = decontam.aligned(code(pattern), code(region), 3), 3
        want = distance(pattern, region)
        if got:
            assert got[2] >= want and distance(pattern, region[got[0]:got[1]]) <= got[2] <= budget
        if want <= 1:
            assert got


def test_blocks_of_the_benchmark_give_the_same(spark, documents, rows):
    items = [prose(k, 40) for k in range(6)] + [None, "", "too short"]
    data = [(k, items[k] + prose(60 + k, 5) + items[(k + 1) % 6]) for k in range(6)] + [(7, None), (7, None), (None, "x " + items[0])]
    whole = rows(decontam.find_leaks(documents(data), benchmark(spark, items)))
    assert whole == rows(decontam.find_leaks(documents(data), benchmark(spark, items), block_chars=300))
    assert sorted(len(r[2]) for r in whole) == [0, 0, 1, 2, 2, 2, 2, 2, 2]
    left = decontam.drop_contaminated(documents(data), benchmark(spark, items), block_chars=300)
    assert [tuple(r)[:2] for r in left.collect()] == [(7, None), (7, None)]


@pytest.mark.parametrize("items", [[], [None], ["short"]])
def test_odd_rows(spark, odd, clashing, none, rows, items):
    bench = benchmark(spark, items)
    found = rows(decontam.find_leaks(odd, bench))
    assert found == rows(decontam.find_leaks(clashing, bench)) and len(found) == 8 and not any(r[1] for r in found)
    assert decontam.find_leaks(none, bench).count() == 0 and decontam.drop_contaminated(clashing, bench).count() == 8


def test_short_and_reworded_passages():
    """Quotes of 13 words from every place of an item, whole items with two of twenty words changed, short items."""
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choices("abcdefghiklmnoprstuvw", k=n))
    words = [word(5) for _ in range(40)]
    index = decontam.Index([(1, " ".join(words)), (2, " ".join(words[::-1][:20])), (3, "seven letter item x")])
    around = lambda text: f"{prose(7, 20)} {text} {prose(8, 20)}"
    for k in range(40 - 13 + 1):
        (found,) = index.find([around(" ".join(words[k:k + 13]))])
        assert [x[0] for x in found] == [1], k
    for a, b in ((3, 10), (5, 13), (6, 16), (9, 10), (2, 18)):
        changed = [*words[::-1][:20]]
        changed[a], changed[b] = word(5), word(5)
        assert 2 in [x[0] for x in index.find([around(" ".join(changed))])[0]], (a, b)
    assert [x[0] for x in index.find([around("Seven leter item X")])[0]] == [3]
    assert index.find([around(" ".join(words[4:9]))]) == [[]] == index.find([around("")])


def test_near_against_the_whole_table():
    rnd = random.Random(16)
    code = lambda s: np.array([ord(c) for c in s], dtype=np.uint32)
    for k in range(400):
        pattern = "".join(rnd.choices("abc", k=rnd.randint(12, 80)))
        region = edited("xx" + pattern + "yy", rnd.randrange(9), k)
        want = distance(pattern, region)
        assert [decontam.near(code(pattern), code(region), b) for b in range(9)] == [want <= b for b in range(9)]


def test_repeated_letters_need_bounded_memory():
    """A junk text against an item with a long run of the same letter: found, in little memory."""
    import tracemalloc

    index = decontam.Index([(1, "a" * 2_000 + " what else there is to say of it"), (2, "another item of the benchmark without runs, and long enough")])
    tracemalloc.start()
    found = index.find(["b" * 500 + "a" * 20_000, "another item of the benchmark without runs, and long enough"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x[0] for x in found[0]] == [1] and [x[0] for x in found[1]] == [2] and peak < 600 << 20


def test_parts_find_what_the_whole_does(monkeypatch):
    import random

    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abcde", k=rnd.randint(2, 6)))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(12)]
    texts = []
    for _ in range(30):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 60)))]
        for k in rnd.sample(range(12), 2):
            t = items[k][1]
            parts += [t[:rnd.randint(60, len(t))], " ".join(word() for _ in range(20))]
        texts.append(" ".join(parts))
    whole = [{x[0] for x in f} for f in decontam.Index(items).find(texts)]
    monkeypatch.setattr(decontam, "PAIRS", 40)
    assert [{x[0] for x in f} for f in decontam.Index(items).find(texts)] == whole and any(whole)
