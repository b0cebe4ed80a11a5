"""Benchmark decontamination: q-gram lemma filter over diagonal bands, then banded alignment.

Texts are compared as their letters and digits, lower-cased, so that case, spacing and punctuation do not
hide a passage.  Each benchmark item is cut into windows of two lengths: the shortest passage that counts,
about ten words, every few characters, with few edits; and twice that, for passages in which words were
changed, with more edits (`WINDOWS`; an item under the first length is one window, and one under the second
has none of those).  So a verbatim quote of 51 characters
is found wherever in the item it stands.  A window occurs in a document if some region of the document is
within the window's edits of it.  The q-gram lemma says that such a region shares at least
`length - q + 1 - q x edits` q-grams with the window, on diagonals that lie within `edits + 1` of each
other.  Documents are scanned once with a rolling hash; shared q-grams are counted per document, item and
diagonal band (bands overlap by half, so no run of diagonals is cut); only bands that reach the bound are
aligned.  The filter loses nothing; the alignment decides.

The benchmark travels to the tasks in blocks of at most `BLOCK_CHARS` characters on average; a larger one
is worked off block by block, each a pass over the documents, and no block is dropped.

Null or empty text is clean.  Items with fewer than `SHORTEST` letters and digits, or null text, match nothing.  Repeated rows give repeated rows; repeated items count once per item_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelgrid.llm.common import Kept, map_slices, pick

Q = 8
SHORTEST = 12
#: Characters of a window, how far apart windows start, and the share of characters that may be edited.
WINDOWS = ((48, 4, 0.084), (96, 8, 0.105))
BLOCK_CHARS = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """Code point -> lower-case code point, 0 for what is neither letter nor digit."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalnum():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kept characters of all texts in one array, where each text begins in it (and its end), and the
    place of each kept character in the joined texts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    low = folding()[codes]
    kept = np.flatnonzero(low)
    ends = np.cumsum([0, *map(len, texts)])
    return low[kept], np.searchsorted(kept, ends), kept


def grams(chars: np.ndarray) -> np.ndarray:
    """Rolling hashes of all runs of Q characters."""
    if len(chars) < Q:
        return np.zeros(0, dtype=np.uint64)
    one = chars.astype(np.uint64)
    with np.errstate(over="ignore"):
        b2 = BASE * BASE
        b4 = b2 * b2
        two = one[:-1] * BASE + one[1:]
        four = two[:-2] * b2 + two[2:]
        return (four[:-4] * b4 + four[4:]) * SPREAD


def windows(length: int) -> list[tuple[int, int, int, int]]:
    """(start, length, edit budget, q-grams that must be shared) of an item's windows."""
    if length < SHORTEST:
        return []
    out = []
    for window, step, rate in WINDOWS:
        if not out or length >= window:
            size = min(length, window)
            budget = min(int(rate * size), (size - Q) // Q)
            starts = sorted({*range(0, length - size + 1, step), length - size})
            out += [(s, size, budget, size - Q + 1 - Q * budget) for s in starts]
    return out


#: Hits of texts and items that are held at once.
PAIRS = 1 << 20


class Index:
    """The q-grams of a block of benchmark items, with their places."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in items]
        self.chars, self.starts, _ = folded([t for _, t in items])
        self.windows = [windows(int(b - a)) for a, b in zip(self.starts, self.starts[1:])]
        self.bounds = [np.array(ws, dtype=np.int64).reshape(-1, 4).T for ws in self.windows]
        self.stride = 1 + max([w[2] for ws in self.windows for w in ws], default=0)
        self.least = np.array([min([w[3] for w in ws], default=1 << 30) for ws in self.windows], dtype=np.int64)
        every = grams(self.chars)
        inside = np.searchsorted(self.starts, np.arange(len(every)), side="right")
        places = np.flatnonzero(np.arange(len(every)) + Q <= self.starts[np.minimum(inside, len(self.starts) - 1)])
        order = np.argsort(every[places], kind="stable")
        self.places = places[order]
        self.hashes, self.first, self.many = np.unique(every[self.places], return_index=True, return_counts=True)
        bits = max(16, min(26, len(self.hashes).bit_length() + 6))
        self.shift = np.uint64(64 - bits)
        self.present = np.zeros(1 << bits, dtype=bool)
        self.present[self.hashes >> self.shift] = True

    def shared(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in chars whose q-gram some item has, and which of the index's q-grams it is."""
        own = grams(chars)
        if not len(self.hashes) or not len(own):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.present[own >> self.shift])
        found = np.minimum(np.searchsorted(self.hashes, own[at]), len(self.hashes) - 1)
        real = self.hashes[found] == own[at]
        return at[real], found[real]

    def find(self, texts: list[str]) -> list[list[tuple[int | None, int, int, int]]]:
        """For each text: (item_id, start, end, edits) of the first region found for each item.

        Texts are taken together as far as their hits stay below `PAIRS`.  One that has more by itself is gone through
        in overlapping parts, each long enough for any window, so a text of repeated letters needs no more memory; items
        that were found in it are not looked for in its later parts."""
        out: list[dict] = [{} for _ in texts]
        chars, starts, place = folded(texts)
        joined = np.cumsum([0, *map(len, texts)])
        at, gram = self.shared(chars)
        doc = np.searchsorted(starts, at, side="right") - 1
        inside = at + Q <= starts[doc + 1] if len(at) else np.zeros(0, dtype=bool)
        at, gram, doc = at[inside], gram[inside], doc[inside]
        many = self.many[gram]
        upto = np.cumsum(many)
        edges = np.searchsorted(doc, np.arange(len(texts) + 1))
        low = 0
        while low < len(texts):
            first = edges[low]
            before = upto[first - 1] if first else 0
            high = low + 1
            while high < len(texts) and (upto[edges[high + 1] - 1] if edges[high + 1] else 0) - before <= PAIRS:
                high += 1
            a, b = first, edges[high]
            if b > a and upto[b - 1] - before > PAIRS:  # one text by itself
                reach = 2 * (max((int(w[1] + w[2]) for ws in self.windows for w in ws), default=0) + 2 * self.stride + Q)
                done: set[int] = set()
                while a < b:
                    c = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, side="right"))
                    c = min(b, max(c, int(np.searchsorted(at, at[a] + 2 * reach))))
                    self.regions(at[a:c], gram[a:c], doc[a:c], chars, starts, place, joined, out, done)
                    a = b if c >= b else max(a + 1, int(np.searchsorted(at, at[c] - reach)))
            elif b > a:
                self.regions(at[a:b], gram[a:b], doc[a:b], chars, starts, place, joined, out, set())
            low = high
        return [sorted(((k, *v) for k, v in o.items()), key=lambda x: (x[1], x[0] is None, x[0])) for o in out]

    def regions(self, at, gram, doc, chars, starts, place, joined, out, done: set[int]) -> None:
        """Puts into `out` what these hits give: counts by text, item and band, and windows that align."""
        many = self.many[gram]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        item_at = self.places[np.repeat(self.first[gram], many) + step]
        at, doc = np.repeat(at, many), np.repeat(doc, many)
        item = np.searchsorted(self.starts, item_at, side="right") - 1
        if done:
            left = ~np.isin(item, list(done))
            at, doc, item, item_at = at[left], doc[left], item[left], item_at[left]
        diagonal = (at - starts[doc]) - (item_at - self.starts[item])
        band = np.floor_divide(diagonal, self.stride)
        # each band covers two strides, so a hit counts for its own and for the one before
        rows = np.concatenate([np.stack([doc, item, band - k, item_at, diagonal]) for k in (0, 1)], axis=1)
        if not rows.shape[1]:
            return
        rows = rows[:, np.lexsort(rows[::-1])]
        new = np.flatnonzero(np.r_[True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)])
        size = np.diff(np.r_[new, rows.shape[1]])
        for a, n in zip(new, size):
            if n < self.least[rows[1, a]]:
                continue
            d, i = int(rows[0, a]), int(rows[1, a])
            if self.ids[i] in out[d]:
                continue
            own = chars[starts[d]:starts[d + 1]]
            found = self.region(own, i, rows[3, a:a + n] - self.starts[i], rows[4, a:a + n])
            if found:
                first, last = (int(place[starts[d] + k] - joined[d]) for k in (found[0], found[1] - 1))
                out[d][self.ids[i]] = (first, last + 1, found[2])
                done.add(i)

    def region(self, own: np.ndarray, i: int, item_at: np.ndarray, diagonal: np.ndarray):
        """The first window of item i that aligns within its budget: (start, end, edits) in own."""
        starts, sizes, _, least = self.bounds[i]
        distinct = np.unique(item_at)
        shared = np.searchsorted(distinct, starts + sizes - Q, side="right") - np.searchsorted(distinct, starts)
        for k in np.flatnonzero(shared >= least):
            start, size, budget, _ = self.windows[i][k]
            inside = (item_at >= start) & (item_at <= start + size - Q)
            low, high = int(diagonal[inside].min()), int(diagonal[inside].max())
            lo = max(0, start + low - budget)
            hi = min(len(own), start + size + high + budget)
            window = self.chars[self.starts[i] + start:self.starts[i] + start + size]
            if not near(window, own[lo:hi], budget):
                continue
            found = aligned(window, own[lo:hi], budget)
            if found:
                return lo + found[0], lo + found[1], found[2]
        return None


def near(window: np.ndarray, region: np.ndarray, budget: int) -> bool:
    """Whether some part of the region is within the budget of the window: a column of the edit table at a
    time, as the bits of two numbers."""
    masks: dict[int, int] = {}
    for k, c in enumerate(window.tolist()):
        masks[c] = masks.get(c, 0) | 1 << k
    m = len(window)
    every, last = (1 << m) - 1, 1 << m - 1
    up, down, edits = every, 0, m
    for c in region.tolist():
        eq = masks.get(c, 0)
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & every
        plus, minus = down | (every & ~(diagonal | up)), up & diagonal
        edits += bool(plus & last) - bool(minus & last)
        if edits <= budget:
            return True
        plus, minus = plus << 1 & every, minus << 1 & every
        up, down = minus | (every & ~(diagonal | plus)), plus & diagonal
    return False


def aligned(window: np.ndarray, region: np.ndarray, budget: int) -> tuple[int, int, int] | None:
    """The best alignment of the whole window with a part of the region, within the budget: start, end and
    edits.  Only the band of diagonals that the region's surplus allows is filled."""
    text = [bytes(x.astype("<u4")).decode("utf-32-le") for x in (window, region)]
    exact = text[1].find(text[0])
    if exact >= 0:
        return exact, exact + len(window), 0
    pattern, target = text
    width = len(target) - len(pattern) + budget + 1  # diagonals -budget .. surplus + budget
    far = budget + 1
    if width <= 0:
        return None
    # cell k of row r stands for column r + k - budget; each holds (edits, where the alignment starts)
    row = [(0, k - budget) if 0 <= k - budget <= len(target) else (far, 0) for k in range(width + budget + 1)]
    for r, p in enumerate(pattern, 1):
        new, left = [], (far, 0)
        for k in range(len(row)):
            column = r + k - budget
            if column < 0 or column > len(target):
                cell = (far, 0)
            else:
                cell = (row[k][0] + (target[column - 1] != p), row[k][1]) if column else (far, 0)
                if k + 1 < len(row) and row[k + 1][0] + 1 < cell[0]:
                    cell = (row[k + 1][0] + 1, row[k + 1][1])
                if left[0] + 1 < cell[0]:
                    cell = (left[0] + 1, left[1])
            new.append(cell)
            left = cell
        row = new
        if min(c[0] for c in row) > budget:
            return None
    best = min(range(len(row)), key=lambda k: (row[k][0], k))
    edits, start = row[best]
    end = len(pattern) + best - budget
    return (start, end, edits) if edits <= budget and end > start >= 0 else None


def blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks whose size does not grow with the benchmark; their number does.  A block is collected when it
    is asked for."""
    items = pick(benchmark, "item_id", "text").filter("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for b in range(n):
        yield sorted(map(tuple, dealt.filter(F.col("block") == b).select("item_id", "text").collect()), key=lambda x: (x[0] is None, x))


def scan(docs: DataFrame, items: list[tuple[int | None, str]], columns: str, result: str, emit) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)
    names = [c.split()[0] for c in columns.split(", ")]

    def work():
        index = Index(sent.value)

        def each(part):
            found = index.find([t or "" for t in part.column(names.index("text")).to_pylist()])
            return emit({n: part.column(i) for i, n in enumerate(names)}, found, part)

        return each

    return map_slices(docs.select(*names), work, result)


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, contaminated, item_ids (sorted), regions (`item:start:end:edits`, code points of the text)."""
    rows, result = pick(docs, "doc_id", "text"), "doc_id bigint, items array<struct<item_id:bigint,a:int,b:int,edits:int>>"

    def emit(columns, found, part):
        return {"doc_id": columns["doc_id"],
                "items": [[dict(zip(("item_id", "a", "b", "edits"), x)) for x in f] for f in found]}

    parts = blocks(benchmark, block_chars)
    first, second = next(parts), next(parts, None)
    if second is None:
        found = scan(rows, first, "doc_id bigint, text string", result, emit)
    else:  # one block is scanned and written at a time; rows get an id so that repeated doc_ids stay apart
        kept = Kept(docs.sparkSession, "decontam")
        rows = kept(rows.withColumn("row", F.monotonically_increasing_id()))
        passes = [kept(scan(rows, p, "row bigint, doc_id bigint, text string", "row bigint, " + result,
                            lambda c, f, x: emit(c, f, x) | {"row": c["row"]})) for p in chain((first, second), parts)]
        union = passes[0]
        for p in passes[1:]:
            union = union.unionByName(p)
        found = (union.groupBy("row", "doc_id").agg(F.flatten(F.collect_list("items")).alias("items"))
                 .select("doc_id", "items"))
    region = lambda x: F.concat_ws(
        ":", F.coalesce(x["item_id"].cast("string"), F.lit("null")), x["a"], x["b"], x["edits"])
    return found.select(
        "doc_id", (F.size("items") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct(F.transform("items", lambda x: x["item_id"]))).alias("item_ids"),
        F.array_join(F.transform(F.array_sort("items"), region), ",").alias("regions"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, with all columns of documents, that hold no passage of the benchmark."""
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = pick(docs, *(c.split()[0] for c in columns.split(", ")))

    def emit(cols, found, part):
        part = part.filter(pa.array([not f for f in found], type=pa.bool_()))
        return {n: part.column(i) for i, n in enumerate(cols)}

    parts = blocks(benchmark, block_chars)
    rows, kept = scan(rows, next(parts), columns, columns, emit), Kept(docs.sparkSession, "decontam")
    for items in parts:  # the pass before is written, so that one block is in memory at a time
        rows = scan(kept(rows), items, columns, columns, emit)
    return rows
