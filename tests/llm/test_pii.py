import random

from hypothesis import given, settings
from hypothesis import strategies as st

from duelgrid.llm import pii
from duelgrid.llm.common import Kept

KEY = b"test"


def told(text):
    return [(k, text[a:b]) for a, b, k, _ in pii.mentions(text)]


def test_detection():
    text = ("Mr John Smith (j.smith99@Mail.Example.com, +1 (017) 555-7713) met Frau Anna Müller. Smith paid 4111 1111 1111 1111 from "
            "97.51.17.173. DE89 3704 0044 0532 0130 00, 078-05-1120. Господин Петров.")
    assert told(text) == [
        ("given-m", "John"), ("surname", "Smith"), ("email", "j.smith99@Mail.Example.com"), ("phone", "+1 (017) 555-7713"),
        ("given-f", "Anna"), ("surname", "Müller"), ("surname", "Smith"), ("card", "4111 1111 1111 1111"), ("ip", "97.51.17.173"),
        ("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "078-05-1120"), ("surname", "Петров")]


def test_what_is_no_entity():
    for text in ("version 1.2.3.4.5", "999.1.1.1", "XX00 ABCD EFGH", "a @ b", "@x", "token 04dbebab91ab85687d33eeaaf9ac699e1188f962", "in 1999 and 2001"):
        assert told(text) == [], text


def test_format_script_gender_and_check_digits():
    for kind, norm in (("card", "4111111111111111"), ("iban", "DE89370400440532013000")):
        new = pii.surrogate(KEY, kind, norm, 0)
        assert len(new) == len(norm) and new != norm
        assert pii.luhn(new) % 10 == 0 if kind == "card" else pii.iban_number(new) % 97 == 1 and new[:2] == "DE"
    for norm in ("anna", "анна"):
        new = pii.surrogate(KEY, "given-f", norm, 0)
        assert new[-1] in "aа" and pii.script_of(new[0]) == pii.script_of(norm[0]) and len(new) == 4
    assert pii.surrogate(KEY, "given-m", "john", 0)[-1] not in "aeiou"
    new = pii.laid_out("+1 (017) 555-7713", "phone", pii.surrogate(KEY, "phone", "10175557713", 0))
    assert [c for c in new if not c.isdigit()] == list("+ () -") and len(new) == 17
    assert all(0 < int(x) < 255 for x in pii.surrogate(KEY, "ip", "8.8.8.8", 0).split("."))
    assert pii.surrogate(KEY, "ip", "192.168.1.1", 0).startswith("192.168.")


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("aB1.@+-() 0é\n")), max_size=60))
def test_mentions_are_ordered_and_apart(text):
    found = pii.mentions(text)
    assert all(x[1] <= y[0] for x, y in zip(found, found[1:])) and all(a < b for a, b, *_ in found)


def test_same_entity_same_surrogate_everywhere(documents):
    data = [(1, "mail a.b1@cd.com or A.B1@CD.com"), (2, "to a.b1@cd.com, 4111 1111 1111 1111"), (3, "4111111111111111"), (4, "nothing here")]
    found = {r.doc_id: r for r in pii.replace(documents(data), KEY).collect()}
    new = found[1].text.split()
    assert new[1].lower() == new[3].lower() == found[2].text.split()[1].strip(",").lower() != "a.b1@cd.com"
    assert new[3].isupper() is False and new[3][0].isupper()
    assert found[2].text.split(", ")[1].replace(" ", "") == found[3].text
    assert found[4].text == "nothing here" and [found[i].n_entities for i in (1, 2, 3, 4)] == [2, 2, 1, 0]
    other = pii.replace(documents(data), b"another key").filter("doc_id = 3").first().text
    assert other != found[3].text


def test_crowded_formats_stay_distinct(spark):
    norms = [f"{a}@{b}.com" for a in "abcdefghijklmnopqrstuvwxyz" for b in "xyzabcdefghi"]  # more than fit the format
    entities = spark.createDataFrame([("email", n) for n in norms], "kind string, norm string")
    found = pii.settled(entities, KEY, Kept(spark, "test")).collect()
    made = [r.surrogate for r in found]
    assert len(found) == len(norms) == len(set(made)) and not set(made) & set(norms) and max(r.attempt for r in found) > 0


def test_redrawn_surrogates_reach_the_texts(documents):
    rnd = random.Random(3)
    norms = [f"{a}{b}@c.com" for a in "aeiou" for b in "aeiou"]
    data = [(i, f"to {rnd.choice(norms)} and {n}") for i, n in enumerate(norms * 2)]
    found = {r.doc_id: r.text for r in pii.replace(documents(data), KEY).collect()}
    to = {}
    for i, text in data:
        for old, new in zip(text.split()[1::2], found[i].split()[1::2]):
            to.setdefault(old, set()).add(new)
    assert all(len(v) == 1 for v in to.values()) and len(set.union(*to.values())) == len(to) and not set.union(*to.values()) & set(to)


def test_odd_rows(odd, clashing, none, rows):
    found = rows(pii.replace(odd, KEY))
    assert found == rows(pii.replace(clashing, KEY)) == sorted(((r.doc_id, r.text, 0, "") for r in odd.collect()), key=repr)
    assert pii.replace(none, KEY).collect() == []


def test_a_long_local_part_goes_as_a_whole():
    local = "a" * 300 + ".b"
    assert pii.mentions(f"to {local}@mail.example now")[0][:3] == (3, 3 + len(local) + len("@mail.example"), "email")
    assert pii.mentions("@" * 2000 + "x@y.example")[0][2] == "email"


def test_names_without_titles():
    assert told("John Smith at 555-123-4567, later Smith") == [("given-u", "John"), ("surname", "Smith"), ("phone", "555-123-4567"), ("surname", "Smith")]
    assert told("Please Contact Ann van der Berg (tel. 555-123-4567)")[:2] == [("given-u", "Ann"), ("surname", "Berg")]
    assert told("my name is Sean O'Neil") == [("given-u", "Sean"), ("surname", "O'Neil")]
    assert told("Anna Müller wrote; mail anna.muller99@x.de")[:2] == [("given-u", "Anna"), ("surname", "Müller")]
    for text in ("Telefon Nummer +49 555 1234567", "Our Help Desk 555-123-4567", "It ended. Monday 555-123-4567"):
        assert [k for k, _ in told(text)] == ["phone"], text
    assert told("Green Park is large. New York, too. The name is long.") == []


def test_letters_keep_their_script():
    import unicodedata
    for word, script in (("田中", "CJK"), ("محمد", "ARABIC"), ("გიორგი", "GEORGIAN"), ("արամ", "ARMENIAN"), ("김", "HANGUL"), ("ひらたん", "HIRAGANA"), ("иван", "CYRILLIC")):
        new = pii.letters_like(word, pii.Draw(KEY, "email", word, 0))
        assert len(new) == len(word) and all(unicodedata.name(c).startswith(script) for c in new), (word, new)


def test_names_are_syllables():
    for kind, norm in (("surname", "schmidt"), ("given-m", "hans"), ("given-f", "ingrid"), ("surname", "петров")):
        vowels = pii.SCRIPTS[pii.script_of(norm[0])][0]
        new = pii.surrogate(KEY, kind, norm, 0)
        assert len(new) == len(norm) and all((a in vowels) != (b in vowels) for a, b in zip(new, new[1:]))


def test_one_person_in_all_spellings(documents):
    data = [(1, "Dr. Anna Schmidt spoke."), (2, "Frau Anna Schmidt, anna.schmidt7@mail.de"), (3, "Anna Schmidt at 555-123-4567; SCHMIDT Schmidt"),
            (4, "ask schmidt.anna@firm.com"), (5, "no one")]
    found = {r.doc_id: r.text for r in pii.replace(documents(data), KEY).collect()}
    given, surname = found[1].removesuffix(" spoke.").split()[1:]
    assert given[-1] == "a" and found[2].startswith(f"Frau {given} {surname}, {given.lower()}.{surname.lower()}")
    assert found[3].startswith(f"{given} {surname} at ") and found[3].endswith(f"SCHMIDT {surname}")
    assert found[4].startswith("ask ") and found[4].split()[1].split("@")[0] == f"{surname.lower()}.{given.lower()}"
    assert found[5] == "no one"


def by_hand(data, key):
    """The same rules one entity at a time: gender by majority, names first, then the rest; ties to the smaller entity."""
    told_by = {i: {(k, n) for _, _, k, n in pii.mentions(t or "")} for i, t in data}
    votes = {}
    for own in told_by.values():
        for k, n in own:
            if k.startswith("given-"):
                votes[n] = votes.get(n, 0) + {"m": 1, "f": -1, "u": 0}[k[-1]]
    gender = {n: "given-m" if v > 0 else "given-f" if v < 0 else "given-u" for n, v in votes.items()}
    entities = {(gender[n] if k.startswith("given-") else k, n) for own in told_by.values() for k, n in own}

    def settle(some, names):
        attempt = dict.fromkeys(some, 0)
        while True:
            new = {e: pii.surrogate(key, *e, attempt[e], names.get(e[1])) for e in some}
            real = {(k.split("-")[0], n) for k, n in some}
            again = [e for e in some if (e[0].split("-")[0], new[e]) in real
                     or any(o[0].split("-")[0] == e[0].split("-")[0] and new[o] == new[e] and o[1] < e[1] for o in some)]
            if not again:
                return new
            for e in again:
                attempt[e] += 1

    people = settle([e for e in entities if e[0].startswith("given-") or e[0] == "surname"], {})
    parts = {}
    for (kind, norm), new in sorted(people.items(), key=lambda x: x[0][1], reverse=True):
        parts[kind == "surname", pii.folded(norm)] = new
    names = {}
    for kind, norm in entities:
        if kind == "email":
            own = [p for p in pii.LETTERS.findall(norm.split("@")[0]) if len(p) > 1]
            both = {p: parts.get((p == own[-1], p)) or parts.get((p != own[-1], p)) for p in own}
            names[norm] = {p: n for p, n in both.items() if n}
    new = people | settle([e for e in entities if e not in people], names)
    out = {}
    for i, text in data:
        made, at = [], 0
        for a, b, k, n in pii.mentions(text or ""):
            made += [(text or "")[at:a], pii.laid_out(text[a:b], k, new[gender[n] if k.startswith("given-") else k, n])]
            at = b
        out[i] = text if text is None else "".join(made) + text[at:]
    return out


def test_against_one_entity_at_a_time(documents):
    rnd = random.Random(11)
    given, last = ["Ann", "Eva", "Max", "Tom", "Kim", "Iris", "Noël"], ["Ott", "Ray", "Diaz", "Weiß", "Groß", "Lee", "Köhl"]
    data = []
    for i in range(120):
        g, s = rnd.choice(given), rnd.choice(last)
        mail = f"{pii.folded(g)}.{pii.folded(s)}{rnd.randrange(3)}@a{rnd.randrange(3)}.com"
        data.append((i, rnd.choice([f"Mr {g} {s} came", f"Frau {g} {s} and {s}", f"Dr. {g} {s}, {mail}", f"{g} {s} on 555-12{rnd.randrange(10)}-4567",
                                    f"write to {mail} or {s.lower()[:2]}.{rnd.randrange(9)}@b.com", "nobody", None, ""])))
    data += [(1000 + i, "Mrs Eva Ray, eva.ray@a0.com") for i in range(40)]
    assert {r.doc_id: r.text for r in pii.replace(documents(data), KEY).collect()} == by_hand(data, KEY)


def test_many_people_in_one_text():
    import time
    names = [f"Dr. Ab{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} Zu{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{chr(97 + i // 676)}" for i in range(5000)]
    at = time.time()
    assert len(pii.mentions(" met ".join(names))) == 10_000 and time.time() - at < 20
