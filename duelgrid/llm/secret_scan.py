"""Secret scanning by assignment-aware lexing.

Every whole text is lexed as source and configuration syntax: names, string literals, bare words,
assignment signs, `+` and line ends.  Statements of the shapes `name = value`, `name: value`,
`"name": value`, `name := value`, `name => value`, `NAME=value`, `x["name"] = value`, `name: type = value`
give name-literal pairs.  A value is a chain of literals and names joined by `+`, or put side by side in
parentheses; it may start on a later line, run over line ends, be quoted threefold or be an indented block; names that were bound to a constant earlier in the text are
replaced by it (constant propagation), so `a = "xy"; password = a + "z"` binds `password` to `xyz`.
Each literal is scored by how sensitive its target name is, and by its own length and variety;
place-holders score nothing.  Literals that reach the threshold become `literal` spans, next to the
three base kinds, which are found by their patterns alone and always stay.

Null text counts as empty: zero counts, the digest of the empty string, no spans.  Positions are code
points, ends exclusive.  Work grows with the length of a text; nothing is cut.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from duelgrid.llm.common import map_slices, pick

#: The base kinds, in the order that ties are listed in.  (?a): only ASCII letters fold.
ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")
SHORTEST_ASSIGNED = 6

#: Words of a target name and how much each says that the value is a secret.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "private": 0.85, "access": 0.4, "api": 0.4, "auth": 0.85, "bearer": 0.8,
    "key": 0.5, "signing": 0.5, "encryption": 0.4, "client": 0.2, "pass": 1.0, "salt": 0.5, "connection": 0.3,
    "dsn": 0.7, "webhook": 0.5, "session": 0.3, "cookie": 0.4, "jwt": 0.9, "pin": 0.4,
}
#: Words that take sensitivity away.
NAME_DAMPERS = {"public": -0.8, "path": -0.6, "file": -0.6, "url": -0.3, "name": -0.5, "id": -0.3, "count": -0.9,
                "length": -0.9, "size": -0.9, "type": -0.8, "limit": -0.9, "max": -0.5, "min": -0.5, "prompt": -0.8}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|%\(.*\)s|\{\{.*\}\}|changeme|none|null|true|false|example|"
                         r"your[-_ ].*|todo|undefined|env|string|test)$")
THRESHOLD = 0.8
SHORTEST_LITERAL = 6

LEXEME = re.compile(r"""(?P<string>\"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*"{3}|'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*'{3}"""
                    r"""|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`)"""
                    r"""|(?P<name>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)"""
                    r"""|(?P<set>:=|=>|==|!=|<=|>=|[:=])"""
                    r"""|(?P<plus>\+)|(?P<end>[;,\n{}()\[\]#])|(?P<bare>[^\s"'`:=+;,{}()\[\]#]+)""")
SETS = frozenset((":=", "=>", ":", "="))
SIGN = re.compile(r"[:=]")
#: Letters before a quote that say how a string is read.
PREFIX = re.compile(r"(?i)(?:[rbufl]|br|rb|fr|rf|u8|[$@]{1,2})$")
#: What follows the sign of a block value, as in YAML; its lines are indented deeper than its name.
BLOCK = re.compile(r"[ \t]*[|>][-+0-9]{0,2}[ \t]*(?:#[^\n]*)?\n")
INDENT = re.compile(r"[ \t]*")
ROW = re.compile(r"([ \t]*)([^\n]*)\n?")
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, leftmost and non-overlapping within each kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= SHORTEST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def sensitivity(name: str) -> float:
    """How much a target name says that its value is a secret, from 0 to 1."""
    words = [w.lower() for w in NAME_PART.findall(name)]
    joined = "".join(words)
    score = sum(NAME_WEIGHTS.get(w, 0) + NAME_DAMPERS.get(w, 0) for w in words)
    if score < 0.9 and any(k in joined for k in ("apikey", "accesskey", "secretkey", "privatekey", "authtoken")):
        score = 1.0 + sum(NAME_DAMPERS.get(w, 0) for w in words)
    return max(0.0, min(1.0, score))


def literal_quality(value: str) -> float:
    """How much a literal looks like a secret by itself, from 0 (place-holder, prose) to 1."""
    if len(value) < SHORTEST_LITERAL or PLACEHOLDER.match(value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9\s]"))
    spaces = sum(c.isspace() for c in value)
    return max(0.0, min(1.0, entropy / 3.2 + 0.12 * (kinds - 1) - 0.35 * spaces))


class Lexemes:
    """(kind, text, start, end) of the lexemes from a place on, made as far as they are asked for."""

    def __init__(self, text: str, start: int):
        self.more, self.made, self.end = LEXEME.finditer(text, start), [], ("end", "", len(text), len(text))

    def __getitem__(self, i: int) -> tuple[str, str, int, int]:
        while len(self.made) <= i:
            m = next(self.more, None)
            if m is None:
                return self.end
            self.made.append((m.lastgroup, m.group(), m.start(), m.end()))
        return self.made[i]

    def over_lines(self, i: int) -> int:
        """The first place from i on that is no line end, nor the sign that carries a line on."""
        while self[i][1] == "\n" or self[i][1] == "\\" and self[i + 1][1] == "\n":
            i += 1
        return i


def indent(text: str, at: int) -> int:
    """Columns before the first sign of the line that holds a place."""
    start = text.rfind("\n", 0, at) + 1
    return INDENT.match(text, start).end() - start


def line_of(text: str, sign: int, at: int) -> tuple[int, int]:
    """(start, end) of the part behind `at` of the line that holds a sign.  Where the sign is its first
    character, the statement starts a line before."""
    start = text.rfind("\n", at, sign) + 1 or at
    if start > at and not text[start:sign].strip():
        start = text.rfind("\n", at, start - 1) + 1 or at
    end = text.find("\n", sign)
    return start, end if end >= 0 else len(text)


def sign_after(lexemes: Lexemes, i: int) -> int:
    """The place of the assignment sign of the target at i, or 0: `name =`, `x["name"] =`, `name?:`."""
    j = i + 1
    while lexemes[j][1] == "]":
        j += 1
    j += lexemes[j][1] in ("?", "!")
    if lexemes[j][1] == "\n" and lexemes[j + 1][1] in SETS:
        j += 1
    return j if lexemes[j][0] == "set" and lexemes[j][1] in SETS else 0


def annotation_end(lexemes: Lexemes, j: int) -> int:
    """The place of the `=` behind the type that follows the `:` at j, on its line, or 0."""
    depth, k = 0, j + 1
    while True:
        kind, word, *_ = lexemes[k]
        if kind == "set":
            return k if word == "=" and depth == 0 and k > j + 1 else 0
        if kind == "plus" or kind == "end" and (word in ("", "\n", ";", "#") or word == "," and not depth):
            return 0
        depth += (word in "([{") - (word in ")]}")
        if depth < 0:
            return 0
        k += 1


def block_value(text: str, sign_end: int, name_at: int):
    """(value, spans, end) of a block value behind a sign, of the lines indented deeper than the name's, or None."""
    m = BLOCK.match(text, sign_end)
    if not m:
        return None
    at, above, parts, spans = m.end(), indent(text, name_at), [], []
    while at < len(text):
        row = ROW.match(text, at)
        own = row[2].rstrip()
        if own and len(row[1]) <= above:
            break
        if own:
            parts.append(own)
            spans.append((row.start(2), row.start(2) + len(own)))
        at = row.end()
    return ("".join(parts), spans, at) if spans else None


def value_at(text: str, lexemes: Lexemes, i: int, j: int, constants: dict):
    """(value, spans, next place) of the value behind the sign at j; no spans if there is none."""
    value, origin = "", []
    k = lexemes.over_lines(j + 1)
    wrapped = lexemes[k][1] == "("
    if wrapped:
        k = lexemes.over_lines(k + 1)
    while True:
        kind, word, a, b = lexemes[k]
        following = lexemes[k + 1]
        if (kind in ("name", "bare") and following[0] == "string" and following[2] == b and PREFIX.match(word)):
            k += 1
            kind, word, a, b = following
            following = lexemes[k + 1]
        after = following[0]
        if kind == "string":
            quotes = 3 if len(word) >= 6 and word[:3] in ('"""', "\'\'\'") else 1
            value, origin = value + word[quotes:-quotes], [*origin, (a + quotes, b - quotes)]
        elif kind == "name" and word in constants and after != "set" and (origin or k == j + 1 or wrapped or after == "plus"):
            value, origin = value + constants[word][0], [*origin, *constants[word][1]]
        elif kind in ("name", "bare") and not origin and not wrapped and (
                k == j + 1 and after in ("end", "string", "name", "bare")
                # alone on its line, deeper than the name
                or k > j + 1 and following[1] in ("\n", "") and indent(text, a) > indent(text, lexemes[i][2])):
            value, origin = value + word, [(a, b)]  # unquoted, as in configuration files
        else:
            break
        k += 1
        then = lexemes.over_lines(k)  # a chain may be carried on behind a `+` or before one
        if lexemes[then][0] == "plus":
            k = lexemes.over_lines(then + 1)
        elif wrapped and lexemes[then][0] in ("string", "name"):
            k = then
        else:
            break
    return value, origin, k


def pairs(text: str):
    """(name, value, [(start, end) of the literals that made it]) for each assignment, in text order.
    Statements begin on lines with an assignment sign and end where their value ends, lines later if need be;
    a constant stays bound until it is bound again."""
    constants: dict[str, tuple[str, tuple]] = {}
    at = 0
    while sign := SIGN.search(text, at):
        begin, end = line_of(text, sign.start(), at)
        lexemes, i, at = Lexemes(text, begin), 0, end
        while lexemes[i][2] < end:
            kind, word, start, _ = lexemes[i]
            j = sign_after(lexemes, i) if kind in ("name", "string") else 0
            if not j:
                i += 1
                continue
            name = word.strip("\"'`")
            typed = annotation_end(lexemes, j) if lexemes[j][1] == ":" else 0
            block = block_value(text, lexemes[j][3], start) if lexemes[j][1] == ":" else None
            if block:
                value, origin, at = block[0], block[1], max(at, block[2])
            else:
                value, origin, k = value_at(text, lexemes, i, typed or j, constants)
            if origin:
                constants[name] = (value, tuple(origin))
                yield name, value, origin
                if block:
                    break
                at = max(at, origin[-1][1] if origin[-1][0] > start else 0)
                i = i + 1 if typed else k  # behind a `:` the last word before `=` may be the name
            else:
                i += 1


def literal_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the literals whose name-literal pair scores as a secret."""
    found = set()
    for name, value, origin in pairs(text):
        weight = sensitivity(name)
        if weight and weight * (0.4 + 0.6 * literal_quality(value)) >= THRESHOLD and literal_quality(value) > 0:
            found.update((a, 3, b) for a, b in origin if b > a)
    return sorted(found)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    return base, sorted({*base, *literal_spans(text)}) if "=" in text or ":" in text else base


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, n_literal, base_sha256 and all spans: one row for each row of docs."""

    def work():
        def each(part):
            base, every = zip(*(scan(t or "") for t in part.column(1).to_pylist()))
            count = lambda rows, kind: [sum(k == kind for _, k, _ in r) for r in rows]
            return {"doc_id": part.column(0), "n_assign": count(base, 0), "n_access": count(base, 1),
                    "n_hex": count(base, 2), "n_literal": count(every, 3),
                    "base_sha256": [hashlib.sha256(listed(b).encode()).hexdigest() for b in base],
                    "spans": [listed(e) for e in every]}

        return each

    return map_slices(pick(docs, "doc_id", "text"), work,
                      "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_literal bigint, "
                      "base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """The text with each run of overlapping spans replaced by one mask."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The rows of docs with every found secret masked in text and n_chars counted anew where it was known.
    Rows without a secret stay as they are."""
    kept = pick(docs, "doc_id", "text", "lang", "source", "n_chars")

    def work():
        def each(part):
            columns = {n: part.column(i) for i, n in enumerate(("doc_id", "text", "lang", "source", "n_chars"))}
            texts, counts = columns["text"].to_pylist(), columns["n_chars"].to_pylist()
            for i, text in enumerate(texts):
                spans = scan(text)[1] if text else []
                if spans:
                    texts[i] = masked(text, spans, mask)
                    counts[i] = counts[i] if counts[i] is None else len(texts[i])
            return columns | {"text": texts, "n_chars": counts}

        return each

    return map_slices(kept, work, "doc_id bigint, text string, lang string, source string, n_chars bigint")
