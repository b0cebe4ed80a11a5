"""Reorder rules against a hand-written list version, streaks and movement."""

import random

import pytest
from pyspark.sql import functions as F

from duelgrid.config import RankingConfig
from duelgrid.operators import ranking as K


def list_version(ranked, edges, streak, cfg):
    """Splice-based reference: head to head, champion tie-break, floors, display scores."""
    rows = [dict(r) for r in sorted(ranked, key=lambda r: r["pos"])]
    moved = set()
    for w, l, lp, wp in sorted(edges, key=lambda e: (e[2], e[3])):
        if w in moved:
            continue
        ids = [r["competitor"] for r in rows]
        wi, li = ids.index(w), ids.index(l)
        if wi <= li:
            continue
        rows.insert(li, rows.pop(wi))
        moved.add(w)
    h2h = [r["competitor"] for r in rows]
    for i in range(1, len(rows)):
        c, x = rows[i], rows[i - 1]
        if c["external_rank"] != "C" or x["external_rank"] == "C":
            continue
        gap = x["final_rating"] - c["final_rating"]
        if 0 < gap <= cfg.champion_band:
            rows[i - 1], rows[i] = c, x
    tiers = (([str(i) for i in range(6, 16)], cfg.floor_top15, True), ([str(i) for i in range(1, 6)], cfg.floor_top5, True), (["C"], cfg.floor_champion, False))
    for ranks, floor, contender in tiers:
        for r in list(rows):
            if r["external_rank"] not in ranks or (contender and streak.get(r["competitor"], 0) >= cfg.floor_streak):
                continue
            at = rows.index(r)
            if at > floor - 1:
                rows.insert(floor - 1, rows.pop(at))
    score = [r["rank_score"] for r in rows]
    for i in range(len(rows) - 2, -1, -1):
        score[i] = max(score[i], score[i + 1])
    score = [max(s, score[0]) if r["external_rank"] == "C" else s for s, r in zip(score, rows)]
    return h2h, [(r["competitor"], s) for r, s in zip(rows, score)][:cfg.depth]


def random_case(seed, n=70, champions=1):
    rnd = random.Random(seed)
    ratings = sorted((round(rnd.uniform(1480, 1560), 2) for _ in range(n)), reverse=True)
    ids = rnd.sample(range(1000), n)
    ext = dict(zip(rnd.sample(ids, 15 + champions), ["C"] * champions + [str(i) for i in range(1, 16)]))
    ranked = [{"division": "X", "competitor": c, "pos": i + 1, "final_rating": r, "rank_score": round(r / 20, 2), "external_rank": ext.get(c)}
              for i, (c, r) in enumerate(zip(ids, ratings))]
    edges = []
    for _ in range(45):
        i, j = sorted(rnd.sample(range(n), 2))
        if ratings[i] - ratings[j] <= 50:
            edges.append((ids[j], ids[i], i + 1, j + 1))
    return ranked, list(dict.fromkeys(edges)), {c: rnd.choice([0, 0, 1, 2, 3]) for c in ids}


@pytest.mark.parametrize("seed,champions", [(1, 1), (2, 1), (3, 2), (4, 3), (5, 0)])
def test_reorder_rules(spark, seed, champions):
    cfg = RankingConfig()
    ranked, edges, streak = random_case(seed, champions=champions)
    rdf = spark.createDataFrame([tuple(r.values()) for r in ranked],
                                "division string, competitor bigint, pos int, final_rating double, rank_score double, external_rank string")
    edf = spark.createDataFrame([("X", *e) for e in edges], "division string, winner bigint, loser bigint, loser_pos int, winner_pos int")
    sdf = spark.createDataFrame(list(streak.items()), "competitor bigint, loss_streak int")
    moved = K.apply_edges(rdf, edf)
    want_h2h, want = list_version(ranked, edges, streak, cfg)
    got_h2h = [r["competitor"] for r in K.h2h_positions(moved).orderBy("pos_h2h").collect()]
    assert got_h2h == want_h2h
    got = [(r["competitor"], r["display_score"]) for r in K.finalize(moved, sdf, cfg).orderBy("rank").collect()]
    assert got == want


def test_one_victim_many_winners(spark):
    """Everyone beat the leader: later winners land below earlier ones, nobody is dropped."""
    n = 300
    rdf = spark.createDataFrame([("X", i, i + 1, 1500.0 - i / 10, 50.0, None) for i in range(n)],
                                "division string, competitor bigint, pos int, final_rating double, rank_score double, external_rank string")
    edf = spark.createDataFrame([("X", i, 0, 1, i + 1) for i in range(1, n)], "division string, winner bigint, loser bigint, loser_pos int, winner_pos int")
    got = [r["competitor"] for r in K.h2h_positions(K.apply_edges(rdf, edf)).orderBy("pos_h2h").collect()]
    assert got == list(range(1, n)) + [0]


def test_loss_streak(spark):
    rows = [(1, i, r) for i, r in enumerate("WLLL")] + [(2, i, r) for i, r in enumerate("LLL")] + [(3, 0, "W"), (4, 0, "L"), (4, 1, "D")]
    got = {r["competitor"]: r["loss_streak"] for r in K.loss_streaks(spark.createDataFrame(rows, "competitor int, nth int, result string")).collect()}
    assert got == {1: 3, 2: 3, 3: 0, 4: 0}


def test_memberships(spark):
    ext = spark.createDataFrame([("A", 1, "C"), ("A", 2, "1"), ("A", 3, "2")], "division string, competitor int, rank string")
    over = spark.createDataFrame([(2, "A", "C", None), (3, "B", "NR", "A")], "competitor int, division string, rank string, remove_from string")
    m, removed = K.memberships(ext, over)
    assert {(r["division"], r["competitor"], r["external_rank"], r["seed"]) for r in m.collect()} == {
        ("A", 1, "C", 100), ("A", 2, "C", 100), ("B", 3, "NR", 0)}
    assert [tuple(r) for r in removed.collect()] == [("A", 3)]


def test_movement(spark):
    rows = [("3", 1, "▲2"), ("3", 5, "▼2"), ("3", 3, "="), (None, 4, "NR"), ("NR", 4, "NR"), ("C", 1, None)]
    df = spark.createDataFrame(rows, "e string, s int, want string").select("want", K.movement(F.col("e"), F.col("s")).alias("got"))
    assert all(r["want"] == r["got"] for r in df.collect())
