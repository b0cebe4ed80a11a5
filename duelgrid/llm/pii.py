"""Personal data replaced by surrogates: keyed, of the same type and format, distinct and consistent.

Detected are e-mail addresses, IBANs, card numbers, US social security numbers, IPv4 addresses, phone
numbers, and person names.  A name is one to three capitalised words after a title (whose gender the title
tells), or two and more without a title that stand before an address or number (`John Smith at 555-123-4567`),
after a word that announces a person (`Name: John Smith`), or that an address of the text spells as separate parts
(`anna.schmidt@`).  The surname alone counts as the same person further on in the text.  An entity is its
normal form (digits, lower case); all its mentions, in all documents and in whatever spelling, get one
surrogate, laid out like the mention.

A surrogate is drawn from a keyed hash of (type, normal form, attempt): digits stay digits, letters stay
letters of their script, check digits stay valid, names are syllables.  A given name's gender is what most of
its titles in the corpus say (none or a tie: unknown, its last sound is kept), so `Dr. Anna` and `Frau Anna`
are one name.  The parts of an address that are names of the corpus (marks folded) become those names' surrogates.
Distinctness is checked over the whole corpus: where two entities draw the same surrogate, the smaller
keeps it and the others draw again, and so does whoever draws an entity that really occurs.  After `WIDEN`
attempts a surrogate grows by a digit, a name by a letter every second attempt, so a crowded format cannot
run out.  Only entities whose surrogate does not follow from the mention alone (drawn again, gender told
elsewhere, address with names) are joined back to the texts they occur in; all others are drawn where they stand.

Null or empty text stays as it is, without entities.  Repeated rows give repeated rows.  Not found: names
in scripts without capitals, single names without a title, and names run together in an address.
"""

from __future__ import annotations

import hashlib
import hmac
import unicodedata

import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelgrid.llm.common import Kept, map_slices, pick

#: Attempts after which a surrogate may be longer than what it stands for.
WIDEN = 20
#: Parts that the rows of one key are dealt to where they meet the few entities joined back.
SALTS = 8
#: Titles by gender.
TITLES = {"m": ("Mr", "Herr", "Señor", "Monsieur", "Господин"), "f": ("Mrs", "Ms", "Frau", "Señora", "Madame", "Mme", "Госпожа"),
          "u": ("Dr", "Prof", "Mx")}
GENDER = {t: g for g, ts in TITLES.items() for t in ts}
#: Words that announce a person.
CUES = ("name", "name is", "contact", "patient", "customer", "client", "employee", "attn", "dear", "signed", "regards", "sincerely",
        "ansprechpartner", "kontakt", "kunde", "grüßen", "nom", "cordialement", "nombre", "cliente", "имя", "контакт")
#: Words that may stand between a person and an address or number.
BRIDGES = ("at", "on", "via", "under", "can", "be", "is", "reached", "tel", "telephone", "phone", "mobile", "cell", "call", "fax", "email",
           "e-mail", "mail", "ssn", "card", "iban", "ip", "unter", "telefon", "par", "por", "au", "teléfono", "тел", "телефон")
#: Capitalised words that are no part of a name.
NO_NAMES = ("the", "our", "your", "please", "for", "from", "to", "and", "or", "hotline", "support", "service", "services", "center", "centre",
            "office", "team", "department", "number", "nummer", "address", "adresse", "street", "company", "information", "help", "desk",
            "sales", "new", "customer", "us", "me", "write", "text", "und", "die", "der", "das", "rufen", "sie", "les", "los")

#: What stands for the parts of an address that are names.
NAMES = "array<struct<part:string,name:string>>"

LOCAL = regex.compile(r"[\w.+%-]")
LOCAL_END = regex.compile(r"[\w.+%-]+$")
DOMAIN = regex.compile(r"(?:[\w-]+\.)+\p{L}{2,}")
IBAN = regex.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
CARD = regex.compile(r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)")
SSN = regex.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
IP = regex.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\w)")
PHONE = regex.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{8,15}(?!\w)")
WORD = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)?"
WORDS = regex.compile(rf"\b{WORD}\b")
NAME = regex.compile(rf"\b({'|'.join(GENDER)})\.? ({WORD}(?:[ -]{WORD}){{0,2}})\b")
#: A name of two to four words, particles between them, that ends where its follower begins.
FULL = rf"\b({WORD}(?:[ -](?:(?:van|von|de|der|den|la|del|da|di|bin|al) ){{0,2}}{WORD}){{1,3}})\b"
BEFORE = regex.compile(rf"{FULL}[\s,;:(<\[–-]+(?:(?i:{'|'.join(BRIDGES)})\b[\s.,:(<]*){{0,4}}$")
AFTER = regex.compile(rf"\b(?i:{'|'.join(CUES)})\b(?:[:,]\s*|[ \t]+){FULL}")
#: Code points before an address or number in which a name may begin.
REACH = 160
LETTERS = regex.compile(r"[^\W\d_]+")
DIGITS = regex.compile(r"\d")
NUMBERED = (("iban", IBAN), ("card", CARD), ("ssn", SSN), ("ip", IP), ("phone", PHONE))

#: Vowels and consonants by script, lower case.
SCRIPTS = {"latin": ("aeiou", "bcdfghjklmnprstvwz"), "cyrillic": ("аеиоуя", "бвгдзклмнпрстх"), "greek": ("αεηιου", "βγδζκλμνπρστ"),
           "armenian": ("աեիոու", "բգդզլկմնպրստ"), "georgian": ("აეიოუ", "ბგდვზთკლმნპრს")}
#: Blocks of scripts with their own vowels.
BLOCKS = (("cyrillic", "\u0400", "\u04ff"), ("greek", "\u0370", "\u03ff"), ("armenian", "\u0531", "\u0587"), ("georgian", "\u10a0", "\u10ff"))
#: Other scripts, by the letters that stand for any of theirs (first and last).
RANGES = (("\u05d0", "\u05ea"), ("\u0628", "\u063a"), ("\u0915", "\u0939"), ("\u0e01", "\u0e2e"), ("\u3042", "\u3093"), ("\u30a2", "\u30ed"),
          ("\u4e00", "\u9fa5"), ("\uac00", "\ud7a3"))


def script_of(letter: str) -> str:
    return next((name for name, first, last in BLOCKS if first <= letter <= last), "latin")


def like_itself(letter: str) -> tuple[int, int] | None:
    """First code point and number of the letters that may stand for a letter of a script without known vowels."""
    block = ord(letter) >> 7
    for first, last in RANGES:
        if first <= letter <= last or (block == ord(first) >> 7 and letter > "\u0590"):
            return ord(first), ord(last) - ord(first) + 1
    return None


OTHER = frozenset((*CUES, *BRIDGES, *NO_NAMES, *(t.lower() for t in GENDER)))


def luhn(digits: str) -> int:
    """The sum whose remainder by ten is 0 for a valid card number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total


def iban_number(code: str) -> int:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4]))


def folded(word: str) -> str:
    """Lower case without marks, as addresses spell names."""
    return regex.sub(r"\p{M}", "", unicodedata.normalize("NFD", word.lower())).replace("ß", "ss")


def people(text: str, contacts: list[tuple[int, int, str, str]]) -> set[tuple[int, int, str, str]]:
    """Given names and surnames: after titles, before addresses and numbers, after cues, spelled by addresses."""
    found, surnames = set(), set()

    def take(start: int, name: str, gender: str) -> None:
        words = [(start + w.start(), start + w.end(), w[0]) for w in WORDS.finditer(name)]
        if gender == "u-":  # no title
            while words and words[0][2].lower() in OTHER:
                words.pop(0)
            if len(words) < 2 or any(w.lower() in OTHER for _, _, w in words):
                return
        for a, b, word in words[:-1]:
            found.add((a, b, f"given-{gender[0]}", word.lower()))
        found.add((*words[-1][:2], "surname", words[-1][2].lower()))
        surnames.add(words[-1][2])

    for m in NAME.finditer(text):
        take(m.start(2), m[2], GENDER[m[1]])
    titled = {x[0] for x in found}
    loose = [m for m in AFTER.finditer(text)]
    loose += [m for m in (BEFORE.search(text, max(0, x[0] - REACH), x[0]) for x in contacts) if m]
    for m in loose:
        if not any(w.start() in titled for w in WORDS.finditer(text, m.start(1), m.end(1))):
            take(m.start(1), m[1], "u-")
    pairs = set()
    for _, _, kind, norm in contacts:
        if kind == "email":
            parts = [p for p in LETTERS.findall(norm.rsplit("@", 1)[0]) if len(p) > 1]
            pairs.update(zip(parts, parts[1:]))
            pairs.update(zip(parts[1:], parts))
    if pairs or surnames:
        last = None
        for m in WORDS.finditer(text):
            if m[0] in surnames:
                found.add((m.start(), m.end(), "surname", m[0].lower()))
            elif pairs and last and last.end() + 1 == m.start() and text[last.end()] == " " and last.start() not in titled:
                if (folded(last[0]), folded(m[0])) in pairs:
                    take(last.start(), text[last.start():m.end()], "u-")
            last = m
    return found


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form), in order, without overlaps; earlier kinds win."""
    found: list[tuple[int, int, str, str]] = []
    at = text.find("@")
    while at >= 0:
        first = at
        while first and LOCAL.match(text[first - 1]):
            first -= 1
        left, right = LOCAL_END.search(text, first, at), DOMAIN.match(text, at + 1)
        if left and right:
            found.append((left.start(), right.end(), "email", text[left.start():right.end()].lower()))
        at = text.find("@", at + 1)
    if DIGITS.search(text):
        for kind, pattern in NUMBERED:
            for m in pattern.finditer(text):
                digits = "".join(DIGITS.findall(m[0]))
                if kind == "iban":
                    code = m[0].replace(" ", "")
                    if not code.isascii() or iban_number(code) % 97 != 1:
                        continue
                    digits = code
                elif kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                    continue
                elif kind == "ip":
                    digits = m[0]
                found.append((m.start(), m.end(), kind, digits))
    found += people(text, found)
    order = {k: i for i, k in enumerate(("email", "iban", "card", "ssn", "ip", "phone"))}
    out: list[tuple[int, int, str, str]] = []
    for kind in sorted({x[2] for x in found}, key=lambda k: (order.get(k, 9), k)):
        free, at = [], 0
        for x in sorted({x for x in found if x[2] == kind}):
            while at < len(out) and out[at][1] <= x[0]:
                at += 1
            if (at == len(out) or out[at][0] >= x[1]) and (not free or free[-1][1] <= x[0]):
                free.append(x)
        out = sorted(out + free)
    return out


class Draw:
    """Numbers from a keyed hash."""

    def __init__(self, key: bytes, kind: str, norm: str, attempt: int):
        self.key, self.seed, self.round, self.left = key, f"{kind}\0{norm}\0{attempt}".encode(), 0, 0
        self.value = 0

    def __call__(self, n: int) -> int:
        if self.left < 1 << 64:
            block = hmac.digest(self.key, self.seed + self.round.to_bytes(4, "big"), hashlib.sha256)
            self.value, self.left, self.round = self.value * (1 << 256) + int.from_bytes(block, "big"), 1 << 256, self.round + 1
        self.value, out = divmod(self.value, n)
        self.left //= n
        return out


def letters_like(word: str, draw: Draw) -> str:
    """Letters of the same script and kind: a vowel for a vowel, a consonant for a consonant, digits for digits."""
    out = []
    for c in word:
        vowels, consonants = SCRIPTS[script_of(c)]
        own = like_itself(c) if c.isalpha() else None
        if c.isdecimal():
            out.append(str(draw(10)))
        elif own:
            out.append(chr(own[0] + draw(own[1])))
        elif c.isalpha():
            plain = regex.sub(r"\p{M}", "", unicodedata.normalize("NFD", c)) or c
            out.append((vowels if plain in vowels else consonants)[draw(len(vowels if plain in vowels else consonants))])
        else:
            out.append(c)
    return "".join(out)


def name_like(word: str, draw: Draw, gender: str, more: int) -> str:
    """Syllables in the script of the word, as long as the word and `more` letters; hyphens and the like stay."""
    vowels, consonants = SCRIPTS[script_of(word[0])]
    size = sum(c.isalpha() for c in word) + more
    plain = folded(word[-1])[-1:]
    ends_in_vowel = gender == "f" or (gender != "m" and plain in vowels)
    made = []
    for left in range(size - 1, -1, -1):
        some = vowels if (left % 2 == 0) == ends_in_vowel else consonants
        made.append(vowels[0] if not left and gender == "f" else some[draw(len(some))])
    letters = iter(made)
    return "".join(next(letters) if c.isalpha() else c for c in word) + "".join(letters)


def surrogate(key: bytes, kind: str, norm: str, attempt: int, names: dict[str, str] | None = None) -> str:
    """The normal form of the surrogate; `names` holds what stands for the parts of an address that are names."""
    draw = Draw(key, kind.split("-")[0], norm, attempt)
    more = max(0, attempt - WIDEN)
    extra = lambda letters: "".join(letters[draw(len(letters))] for _ in range(min(more, 12)))
    if kind == "email":
        local, domain = norm.rsplit("@", 1)
        *labels, top = domain.split(".")
        parts = (names[p] if names and p in names else letters_like(p, draw) for p in regex.findall(r"[^\W\d_]+|[\W\d_]+", local))
        return f"{''.join(parts)}{extra('0123456789')}@{'.'.join(letters_like(x, draw) for x in labels)}.{top}"
    if kind == "ip":
        own = norm.split(".")
        kept = 1 if own[0] in ("10", "127") else 2 if own[:2] == ["192", "168"] else 0
        return ".".join([*own[:kept], *(str(1 + draw(254)) for _ in range(4 - kept))])
    if kind == "iban":
        body = "".join(str(draw(10)) if c.isdigit() else chr(65 + draw(26)) for c in norm[4:]) + extra("0123456789")
        return f"{norm[:2]}{98 - iban_number(norm[:2] + '00' + body) % 97:02d}{body}"
    if kind in ("card", "ssn", "phone"):
        body = "".join(str(draw(10) if k or c == "0" else 1 + draw(9)) for k, c in enumerate(norm)) + extra("0123456789")
        if kind == "card" and luhn(norm) % 10 == 0:
            body = body[:-1] + str(-luhn(body[:-1] + "0") % 10)
        return body
    gender = kind[6:] if kind.startswith("given-") else ""
    return name_like(norm, draw, gender, attempt // 2)


def laid_out(mention: str, kind: str, norm: str) -> str:
    """The surrogate's normal form in the spelling of the mention."""
    if kind in ("card", "ssn", "phone"):
        digits = iter(norm)
        return "".join(next(digits) if c.isdecimal() else c for c in mention) + "".join(digits)
    if kind == "iban":
        chars = iter(norm)
        return "".join(c if c == " " else next(chars) for c in mention) + "".join(chars)
    if kind == "ip":
        return norm
    out = [c.upper() if o.isupper() else c for c, o in zip(norm, mention)]
    return "".join(out) + norm[len(out):]


def mentioned(docs: DataFrame) -> DataFrame:
    """key (hash of the text), kind, norm: the distinct entities of each text."""

    def work():
        def each(part):
            keys, found = [], []
            for text in part.column(0).to_pylist():
                own = sorted({(k, n) for _, _, k, n in mentions(text)})
                keys.append(text_key(text))
                found.append([{"kind": k, "norm": n} for k, n in own])
            return {"key": keys, "found": found}

        return each

    rows = map_slices(pick(docs, "text").filter("text is not null"), work,
                      "key bigint, found array<struct<kind:string,norm:string>>")
    return rows.select("key", F.explode("found").alias("e")).select("key", "e.kind", "e.norm")


def text_key(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text.encode())
    return h - (1 << 64) if h >> 63 else h


def space(kind):
    """Given names of all genders share one space of surrogates."""
    return F.when(F.col(kind).startswith("given-"), F.lit("given")).otherwise(F.col(kind)).alias("space")


def drawn(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, norm, names, attempt with the surrogate that the attempt gives."""

    def work():
        def each(part):
            kinds, norms, names, attempts = (part.column(i).to_pylist() for i in range(4))
            return {"kind": part.column(0), "norm": part.column(1), "names": names, "attempt": part.column(3),
                    "surrogate": [surrogate(key, k, n, a, {x["part"]: x["name"] for x in own or ()})
                                  for k, n, own, a in zip(kinds, norms, names, attempts)]}

        return each

    return map_slices(entities.select("kind", "norm", "names", "attempt"), work, f"kind string, norm string, names {NAMES}, attempt int, surrogate string")


def settled(entities: DataFrame, key: bytes, kept: Kept) -> DataFrame:
    """kind, norm, names, attempt, surrogate: surrogates distinct within their kind, and none of them an entity."""
    if "names" not in entities.columns:
        entities = entities.withColumn("names", F.lit(None).cast(NAMES))
    now = kept(drawn(entities.withColumn("attempt", F.lit(0)), key))
    while True:
        owners = now.groupBy(space("kind"), "surrogate").agg(F.min("norm").alias("owner"))
        real = entities.select(space("kind"), F.col("norm").alias("surrogate"), F.lit(True).alias("occurs"))
        judged = (now.withColumn("space", space("kind")).join(owners, ["space", "surrogate"]).join(real, ["space", "surrogate"], "left")
                  .withColumn("again", F.col("occurs").isNotNull() | (F.col("norm") != F.col("owner"))))
        again = kept(judged.select("kind", "norm", "names", "attempt", "surrogate", "again"))
        if not again.filter("again").take(1):
            return now
        redrawn = drawn(again.filter("again").select("kind", "norm", "names", (F.col("attempt") + 1).alias("attempt")), key)
        now = kept(again.filter("not again").drop("again").unionByName(redrawn))


def with_names(emails: DataFrame, names: DataFrame) -> DataFrame:
    """kind, norm, names: addresses with the surrogates of those of their parts that are names.  The last part is a
    surname if there is such a one, any other a given name; of names that fold alike the smallest stands."""

    def fold():
        return lambda part: {"kind": part.column(0), "norm": part.column(1), "surrogate": part.column(2),
                             "part": [folded(n) for n in part.column(1).to_pylist()]}

    def split():
        def each(part):
            found = []
            for norm in part.column(0).to_pylist():
                own = [p for p in LETTERS.findall(norm.rsplit("@", 1)[0]) if len(p) > 1]
                found.append([{"part": p, "last": p == own[-1]} for p in sorted(set(own))])
            return {"norm": part.column(0), "own": found}

        return each

    named = F.struct("norm", "surrogate")
    by_part = (map_slices(names.select("kind", "norm", "surrogate"), fold, "kind string, norm string, surrogate string, part string")
               .groupBy("part").agg(F.min(F.when(F.col("kind") == "surname", named)).alias("surname"),
                                    F.min(F.when(F.col("kind") != "surname", named)).alias("given"))
               .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    name = F.when(F.col("last"), F.coalesce("surname.surrogate", "given.surrogate")).otherwise(F.coalesce("given.surrogate", "surname.surrogate"))
    found = (map_slices(emails.select("norm"), split, "norm string, own array<struct<part:string,last:boolean>>")
             .select("norm", F.pmod(F.xxhash64("norm"), F.lit(SALTS)).cast("int").alias("salt"), F.inline("own"))
             .join(by_part, ["part", "salt"]).groupBy("norm").agg(F.sort_array(F.collect_list(F.struct("part", name.alias("name")))).alias("names")))
    return emails.join(found, "norm", "left").select("kind", "norm", "names")


def replace(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with surrogates, n_entities, entities (`type:start:end:surrogate`, code points of the
    original text): one row for each row of docs."""
    kept = Kept(docs.sparkSession, "pii")
    found = kept(mentioned(docs))
    told = F.sum(F.when(F.col("kind") == "given-m", 1).when(F.col("kind") == "given-f", -1).otherwise(0))
    given = (found.filter("kind like 'given-%'").groupBy("norm")
             .agg(F.when(told > 0, "given-m").when(told < 0, "given-f").otherwise("given-u").alias("kind"),
                  (F.min("kind") != F.max("kind")).alias("mixed")))
    others = found.filter("kind not like 'given-%'").select("kind", "norm").distinct()
    given, others = kept(given), kept(others)
    names = settled(given.select("kind", "norm").unionByName(others.filter("kind = 'surname'")), key, kept)
    emails = with_names(others.filter("kind = 'email'"), names)
    rest = others.filter("kind not in ('surname', 'email')").withColumn("names", F.lit(None).cast(NAMES))
    table = names.unionByName(settled(kept(emails.unionByName(rest)), key, kept))
    mixed = given.filter("mixed").select(F.lit("given").alias("space"), "norm", F.lit(True).alias("mixed"))
    changed = (table.select(space("kind"), "norm", "names", "attempt", "surrogate").join(mixed, ["space", "norm"], "left")
               .filter("attempt > 0 or names is not null or mixed")
               .select("space", "norm", "surrogate", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    again = (found.select("key", "kind", "norm", space("kind"), F.pmod("key", F.lit(SALTS)).cast("int").alias("salt"))
             .join(kept(changed), ["space", "norm", "salt"])
             .groupBy("key").agg(F.sort_array(F.collect_set(F.struct("kind", "norm", "surrogate"))).alias("again")))
    again = kept(again).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def keys():
        return lambda part: {"doc_id": part.column(0), "text": part.column(1),
                             "key": [None if t is None else text_key(t) for t in part.column(1).to_pylist()]}

    keyed = map_slices(pick(docs, "doc_id", "text"), keys, "doc_id bigint, text string, key bigint")
    both = (keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
            .join(again, ["key", "salt"], "left").select("doc_id", "text", "again"))

    def work():
        def each(part):
            texts, counts, listed = [], [], []
            for text, redrawn in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                known = {(r["kind"], r["norm"]): r["surrogate"] for r in redrawn or ()}
                out, shown, at = [], [], 0
                for a, b, kind, norm in mentions(text or ""):
                    new = laid_out(text[a:b], kind, known.get((kind, norm)) or surrogate(key, kind, norm, 0))
                    out += [text[at:a], new]
                    shown.append(f"{kind}:{a}:{b}:{new}")
                    at = b
                texts.append(text if not shown else "".join([*out, text[at:]]))
                counts.append(len(shown))
                listed.append(",".join(shown))
            return {"doc_id": part.column(0), "text": texts, "n_entities": counts, "entities": listed}

        return each

    return map_slices(both, work, "doc_id bigint, text string, n_entities bigint, entities string")
