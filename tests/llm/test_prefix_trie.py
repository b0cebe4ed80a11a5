import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from duelgrid.llm import prefix_trie
from duelgrid.llm.catalog import ORACLES, op12_prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows, rebuild=True):
    """The trie by one dictionary of whole prefixes."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = turns.get(c - c % 20, [])[:h] + own[h:] if rebuild else own
    members = defaultdict(list)
    for c, own in built.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        own = (len(members[key]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        leaves[key] = sum(leaves[k] for k in children[key]) if children[key] else 1
        saved[key] = own + sum(saved[k] for k in children[key])
    out = []
    for key, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(built[c]) == len(key))
        out.append((min(ids), len(key), min(members[key[:-1]]) if key else None, len(ids), len(children[key]), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def invented(seed, convs, words, longest):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(convs * 3), convs):
        for turn in range(rng.randint(1, longest)):
            out.append((c, rng.choice([turn, turn]), rng.choice(["user", None, ""]), rng.choice(words)))
    rng.shuffle(out)
    return out


def test_query_against_dictionary_and_sql(spark, sf, rows):
    data = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = rows(op12_prefix_trie(spark, sf))
    assert got == brute(data)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{sf}/conversations.parquet')")
    assert sorted(con.execute(ORACLES["op12_prefix_trie"]).fetchall(), key=repr) == got


@pytest.mark.parametrize("seed, convs, words, longest", [(1, 120, ["a b", "c", "", None], 4), (2, 60, ["x"], 30), (3, 40, [" \t", "y  z", "ü"], 2)])
def test_branching_tries_over_many_blocks_and_cells(spark, rows, seed, convs, words, longest):
    data = invented(seed, convs, words, longest)
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    assert rows(prefix_trie.shared_head_trie(frame, block=3, cell=7, siblings=5)) == brute(data)


def test_plain_trie_of_copies_and_one_long_conversation(spark, rows):
    data = [(c, t, "user", f"same {t}") for c in range(300, 340) for t in range(3)] + [(7, t, "user", f"same {t}" if t < 2 else "deep") for t in range(500)]
    data += [(9, t, "user", f"same {t}" if t < 2 else "deep") for t in range(250)] + [(11, 0, "user", "alone")]
    frame = spark.createDataFrame(data, SCHEMA).repartition(4)
    assert rows(prefix_trie.prefix_trie(frame, block=64, cell=100)) == brute(data, rebuild=False)


def test_null_repeated_and_turnless(spark, rows):
    data = [(None, 0, "user", "lost"), (21, None, None, None), (21, None, None, None), (21, 3, "user", "a"), (1, 0, "user", "gone"),
            (2, 5, None, "only"), (3, 1, "user", ""), (20, None, "user", "head"), (20, 2, "user", "tail"), (41, 0, "user", "x"), (42, 0, "user", "x"), (-5, 0, "user", "x")]
    data = [r for r in data if r[0] is None or r[0] >= 0]
    frame = spark.createDataFrame(data, SCHEMA)
    want = brute(data)
    assert rows(prefix_trie.shared_head_trie(frame)) == want
    clashing = frame.selectExpr("*", "conv_id as c", "text as a", "1 as depth", "2 as part", "'q' as TEXT_", "3 as pos").withColumnRenamed("TEXT_", "TEXT")
    assert rows(prefix_trie.shared_head_trie(clashing)) == want
    assert rows(prefix_trie.shared_head_trie(spark.createDataFrame([], SCHEMA))) == []
    assert rows(prefix_trie.shared_head_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))) == []
