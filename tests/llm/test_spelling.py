import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from duelgrid.llm import spelling
from duelgrid.llm.catalog import ORACLES, op13_spelling_variants

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: sorted((-words[v], v) for v in words if one_edit(w, v)) for w in words}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= 5 * words[w] else None for w in words}
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def test_query_against_brute_force_and_sql(spark, sf, rows):
    data = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = rows(op13_spelling_variants(spark, sf))
    assert got == brute(data) and any(r[1] for r in got)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    assert sorted(con.execute(ORACLES["op13_spelling_variants"]).fetchall(), key=repr) == got


def invented(seed):
    """Words, misspelt words and misspelt misspelt ones, over few letters, so that buckets are full and chains long."""
    rng = random.Random(seed)
    letters = "abÉéçÿÀ×"
    texts = []
    for _ in range(8):
        word = "".join(rng.choices(letters, k=rng.randint(6, 9)))
        for times in (700, 130, 24, 5):
            texts += [word] * times
            at, kind = rng.randrange(len(word)), rng.randrange(3)
            word = word[:at] + (rng.choice(letters) if kind else "") + word[at + (kind < 2):]
    rng.shuffle(texts)
    return [(i if i % 7 else None, " ".join(texts[i::40])) for i in range(40)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("symbols", [2, 8])
def test_chains_and_full_buckets(spark, documents, rows, seed, symbols):
    data = invented(seed)
    assert rows(spelling.spelling_variants(documents(data).repartition(3), symbols)) == brute(data)


def test_neighbourhood_is_full_and_without_repeats():
    rng, symbols = random.Random(3), 3
    alphabet = "abc"
    for length in (1, 2, 5, 9):
        words = ["".join(rng.choices(alphabet, k=length)) for _ in range(20)]
        own, made = spelling.neighbourhood(words, symbols)
        by_word = {}
        for k, m in zip(own.tolist(), made.tolist()):
            by_word.setdefault(k, []).append(m)
        for word in set(words):
            want = {word} | {word[:i] + word[i + 1:] for i in range(length)}
            want |= {word[:i] + c + word[i + j:] for i in range(length + 1) for c in alphabet for j in (0, 1) if i + j <= length}
            made_of = by_word[spelling.hashes([word])[0].item()]
            assert len(made_of) == len(want) * words.count(word)
            assert set(made_of) == {spelling.hashes([w])[0].item() if w else 0 for w in want}


def test_long_words_and_texts(spark, documents, rows):
    long = "ab" * 30_000
    data = [(i, f"{long} {long[:-1]} plain. {'plainly ' * 400}") for i in range(6)]
    got = rows(spelling.spelling_variants(documents(data)))
    near = {r[0]: r[4] for r in got}
    assert near[long] == near[long[:-1]] == 1 and near["plainly"] == 0


def test_odd_rows(odd, clashing, none, documents, rows):
    few = [(1, None), (2, ""), (3, "×÷×÷×÷ " * 5), (None, "STRANGE straNge " * 3), (4, "strange" * 1), (4, "strange")]
    want = brute(few)
    assert rows(spelling.spelling_variants(documents(few))) == want and {r[0] for r in want} >= {"×÷×÷×÷", "strange"}
    assert rows(spelling.spelling_variants(none)) == []
    extra = documents(few).withColumns({"word": F.lit("x"), "TEXT2": F.lit("y"), "n": F.lit(1), "k": F.lit(2)})
    assert rows(spelling.spelling_variants(extra)) == want
    assert rows(spelling.spelling_variants(clashing)) == rows(spelling.spelling_variants(odd)) == []
