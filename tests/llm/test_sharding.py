import random
import zlib

from duelgrid.llm import sharding


def check(found, rows, shards):
    """Every row once, sizes right, slots gapless."""
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in found) == sorted(
        (repr(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = {}
    for r in found:
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))


def test_shards_hold_nearly_equal_bytes(documents):
    rnd = random.Random(2)
    data = [(i, "é" * rnd.choice([3, 40, 40, 300]), rnd.choice(["en", "de", None]), "hot" if i % 3 else f"s{i % 7}", None) for i in range(3000)]
    found = sharding.kd_shards(documents(data), 24).collect()
    check(found, data, 24)
    total, largest = {}, max(len(t.encode()) + 8 for _, t, *_ in data)
    for r in found:
        total[r.shard] = total.get(r.shard, 0) + r.size
    mean = sum(total.values()) / 24
    # a cut is exact to half a row, and there are five levels
    assert len(total) == 24 and all(abs(v - mean) <= 2.5 * largest for v in total.values())


def median_by_hand(rows, goal):
    """Rows in order that go left."""
    below = 0
    for k, size in enumerate(rows):
        if below + size >= goal:
            return k + (below + size - goal <= goal - below)
        below += size


def test_one_cut_against_a_sorted_list(documents):
    rnd = random.Random(3)
    data = [(i, "x" * rnd.randrange(50), "en", "s", 7) for i in range(500)]
    found = sharding.kd_shards(documents(data), 2).collect()
    # bytes and doc_id both span their whole range; of equals the first dimension is taken
    order = sorted(found, key=lambda r: (r.size, r.doc_id))
    k = median_by_hand([r.size for r in order], sum(r.size for r in order) / 2)
    assert [r.shard for r in order] == [0] * k + [1] * (len(order) - k)


def test_equal_rows_are_dealt_too(documents):
    data = [(7, "same", "en", "s", 4)] * 240
    found = sharding.kd_shards(documents(data), 24).collect()
    check(found, data, 24)
    assert all(sum(r.shard == s for r in found) == 10 for s in range(24))


def test_odd_rows(odd, clashing, none, spark):
    for frame in (odd, clashing):
        check(sharding.kd_shards(frame, 4).collect(), [tuple(r)[:2] for r in odd.collect()], 4)
    assert sharding.kd_shards(none, 24).collect() == []


def test_no_python_in_the_plan(odd):
    plan = sharding.kd_shards(odd, 4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
