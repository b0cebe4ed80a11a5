import random

from duelgrid.llm import langid

WORDS = {"aa": "kapo tiku moka lapi nako".split(), "bb": "streng schluf brandt krump".split()}


def corpus(n=120, seed=1):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choices(WORDS[lang], k=12)) + ".", lang) for i in range(n) for lang in [rnd.choice(sorted(WORDS))]]


def test_known_words_then_shorter_and_shorter_grams(documents):
    model = langid.fit(documents(corpus()))
    assert model.languages == ["aa", "bb"]
    assert model.predict("kapo moka")[0] == "aa" and model.predict("krump")[0] == "bb"
    assert model.predict("schlump brondt")[0] == "bb"  # unseen words of seen grams
    assert model.predict("mokalapi tikunako")[0] == "aa"
    assert "schlump" not in model.grams[5] and model.predict("kapo " * 50)[1] > 0.99


def test_held_out_rows_do_not_train(documents, rows):
    import zlib

    data = [(i, t if zlib.crc32(str(i).encode()) % 5 else "zzzz qqqq", lang if zlib.crc32(str(i).encode()) % 5 else "zz")
            for i, t, lang in corpus()]
    model = langid.fit(documents(data))
    assert model.languages == ["aa", "bb"]
    for doc_id, held, lang, score in rows(langid.predict(documents(data), model)):
        assert held == (zlib.crc32(str(doc_id).encode()) % 5 == 0) and lang in ("aa", "bb") and 0 <= score <= 1


def test_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.predict(docs, langid.fit(docs)).filter("held_out").join(docs, "doc_id").filter("lang is not null")
    assert found.filter("lang = lang_pred").count() >= 0.98 * found.count() > 0


def test_sample_bound_is_kept(documents):
    assert 10 <= langid.training_rows(documents(corpus(2000)), 100).count() <= 220


def test_odd_rows(odd, clashing, none, documents, rows):
    model = langid.fit(documents(corpus()))
    found = rows(langid.predict(odd, model))
    assert found == rows(langid.predict(clashing, model)) and len(found) == 8
    assert {r[0]: r[2] for r in found if r[0] in (1, 2, 3, 4)} == dict.fromkeys((1, 2, 3, 4), "und")
    assert all(r[1] for r in found if r[0] is None) and langid.predict(none, model).count() == 0
    nothing = langid.fit(none)
    assert {r[2:] for r in rows(langid.predict(odd, nothing))} == {("und", 0.0)}
    assert [r.doc_id for r in langid.keep_identified(odd, model).collect()] == [5, 5, None]
    assert langid.keep_identified(clashing, model).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_forgetting_unseen_words_changes_nothing(documents, monkeypatch):
    model = langid.fit(documents(corpus()))
    texts = [f"mo{chr(97 + i % 26)}ka schl{chr(97 + i % 7)}mp " * 3 for i in range(60)]
    before = [model.predict(t) for t in texts]
    monkeypatch.setattr(langid, "CACHE", 3)
    assert [model.predict(t) for t in texts] == before


def test_a_rare_language_beside_long_texts_of_a_common_one(documents):
    """One language in 3 of 9,000 rows, another with a third of all text in few rows."""
    import zlib

    trains = [i for i in range(20_000, 20_100) if zlib.crc32(str(i).encode()) % 5][:3]
    rnd = random.Random(4)
    invented = [f"{a}{b}{c}o" for a in "bcdfghjklm" for b in "aeiou" for c in "npqrstvwxz"]
    data = corpus(9_000) + [(30_000 + i, " ".join(rnd.choices(invented, k=4_000)), "cc") for i in range(20)] + [(i, "ymyr hwyll gwlad ddraig", "rr") for i in trains]
    model = langid.fit(documents(data), max_rows=200, max_words=1_200)
    assert model.languages == ["aa", "bb", "cc", "rr"]
    assert model.predict("hwyll gwlad")[0] == "rr" and model.predict("kapo moka")[0] == "aa" and model.predict("krump brandt")[0] == "bb"


def test_predictions_equal_a_plain_sum(documents):
    """Word-first backoff, by hand: a known word's row, else the mean row of its longest known n-grams."""
    import math

    model = langid.fit(documents(corpus()))
    known = {w: model.table[i] for w, i in list(model.items())[:model.known]}
    for text in ("kapo schlump zz moka", "Krump, BRANDT! xq", "mokalapi 7 tiku"):
        total = [0.0, 0.0]
        for word in langid.WORD.findall(text.lower()):
            row, weight, padded = known.get(word), 1.0, f" {word} "
            for n in langid.ORDERS if row is None else ():
                hits = [model.grams[n][padded[i:i + n]] for i in range(len(padded) - n + 1) if padded[i:i + n] in model.grams[n]]
                if hits:
                    row = [weight * sum(float(model.gram_table[h][k]) for h in hits) / len(hits) for k in (0, 1)]
                    break
                weight *= langid.STEP
            total = [t + (0.0 if row is None else float(row[k])) for k, t in enumerate(total)]
        best = 0 if total[0] >= total[1] else 1
        lang, score = model.predict(text)
        assert lang == model.languages[best] and abs(score - 1 / (1 + math.exp(total[1 - best] - total[best]))) < 1e-5
