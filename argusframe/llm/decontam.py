"""Operator 2: benchmark decontamination by template canonicalisation.

Numbers, names and quantities become typed placeholders: a run of capitalised words is one name wherever it stands, and a
number with its unit is one quantity. Windows of template tokens carry the values that fill their slots. A window with few
literal tokens goes by the words themselves, so that tables of figures match word for word and not every other table.

1. The benchmark's windows are a table (hash, item, place, values), one item for each text.
2. Documents give the windows that pass a Bloom filter of those hashes, of fixed size: the filter only thins out, the join decides.
3. Both are joined by hash. The documents' side is dealt by hash and a salt, so that a window which stands in many
   documents is split.
4. The windows that a document and an item have in common are chained along near alignments; in a chain each value must stand for one
   value throughout, both ways. A chain that is long enough is a leak.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, kept_by_worker, materialise, slices, spread, text_or_empty

#: Template tokens in a window, literal ones below which it goes by its words, and matched tokens that make a leak.
WINDOW, LITERAL, RUN = 8, 3, 13
#: Of an item too short for that, the share of its tokens that must match, and tokens that an item needs.
SHARE, LEAST = 0.8, 4
#: Tokens that may be skipped, in the document and in the item, between two windows of a chain.
GAP = 4
#: Bits of the filter, and parts that a window's documents are dealt into.
FILTER_BITS, SALTS = 1 << 24, 16
#: Words at which a worker's table of known words is emptied, looked at before each text.
KEPT_WORDS = 200_000

#: Unit words.
UNITS = frozenset(
    "mm cm m km inch inches ft feet mile miles yard yards mg g kg lb lbs ton tons ml l litre litres liter liters s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "percent dollar dollars euro euros pound pounds cent cents degree degrees kmh mph km/h m/s".split()
)

NUMBER, NAME, QUANTITY = 1, 2, 3
_CAPITAL, _STOP, _NUMBER, _UNIT, _QUANTITY, _BLANK = 1, 2, 4, 8, 16, 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)

_MARKS = "\"'`()[]{}<>.,;:!?…¿¡«»“”„*&%$#|~^_=+-/\\"
#: Marks that count as words where they stand alone.
_OPERATORS = frozenset("+ - * / = < > % ^ × ÷ ≤ ≥ ≠ − ·".split())
_SENTENCE = re.compile(r"[.!?…][\"')\]»”]*$").search
_NUMERAL = re.compile(r"[+-]?\d+(?:[.,:/]\d+)*").fullmatch
_MEASURED = re.compile(r"[+-]?\d+(?:[.,]\d+)*([^\W\d].*)").fullmatch
# 12+35*4=? is arithmetic written without spaces
_GLUED = re.compile(r"[-+*/=<>^×÷−·](?<=[\d)].)(?=[\d(?]|$)")


def words_of(text: str) -> list[str]:
    out = text.split()
    if any(c in text for c in "+*=^×÷"):
        out = [x for w in out for x in (_GLUED.sub(lambda m: f" {m[0]} ", w).split() if any(c in w for c in "+*=^×÷") and any(map(str.isdigit, w)) else (w,))]
    return out


def _describe(word: str) -> tuple[int, int, int]:
    """Code of the literal word, flags, and the hash of its value: the word without marks around it, as it is written."""
    import xxhash

    if word in _OPERATORS:
        code = xxhash.xxh64_intdigest(word.encode()) | 1 << 63
        return code, 0, code
    core, flags = word, 0
    if not word.isalpha():
        core = word.strip(_MARKS)
        flags = _STOP if _SENTENCE(word) else 0
        if not core:
            return 0, flags | _BLANK, 0
        if _NUMERAL(core):
            flags |= _NUMBER
        elif (m := _MEASURED(core)) and m[1].lower() in UNITS:
            flags |= _QUANTITY
    lower = core.lower()
    if lower in UNITS:
        flags |= _UNIT
    if len(core) > 1 and core[0] != lower[0] and core[0].isupper() and core[1:] == lower[1:]:
        flags |= _CAPITAL
    return xxhash.xxh64_intdigest(lower.encode()) | 1 << 63, flags, xxhash.xxh64_intdigest(core.encode()) | 1 << 63


class Templates(dict):
    """Numbers the words it has met; template() turns word numbers into typed tokens."""

    def __init__(self):
        self.new: list[tuple[int, int, int]] = []
        self._held = np.empty(0, np.uint64), np.empty(0, np.uint8), np.empty(0, np.uint64)

    def __missing__(self, word: str) -> int:
        out = self[word] = len(self)
        self.new.append(_describe(word))
        return out

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, flags and values of the words met so far; those of earlier calls are arrays already."""
        if self.new:
            new = zip(*self.new, strict=True)
            self._held = tuple(np.concatenate([old, np.array(x, old.dtype)]) for old, x in zip(self._held, new, strict=True))
            self.new.clear()
        return self._held

    def numbers(self, text: str) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def template(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Template tokens, and the hash of the words behind each. Marks alone are left out.

        Capitalised words in a row within a sentence are one name; a number and the unit after it are one quantity.
        """
        codes, flags, values = self.arrays()
        flag = flags[numbers]
        shown = (flag & _BLANK) == 0
        stop = (flag & _STOP) > 0
        if not shown.all():  # a mark standing alone may end the sentence of the word before it
            ended = np.concatenate([[0], np.cumsum(stop)])
            at = np.flatnonzero(shown)
            upto = np.append(at[1:], len(flag))
            stop = ended[upto] > ended[at]
            numbers, flag = numbers[shown], flag[shown]
        n = len(numbers)
        if not n:
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        capital, number = (flag & _CAPITAL) > 0, (flag & _NUMBER) > 0
        after = np.zeros(n, bool)  # a token that goes on with the one before
        after[1:] = (capital[1:] & capital[:-1] & ~stop[:-1]) | (((flag[1:] & _UNIT) > 0) & number[:-1])
        measured = np.zeros(n, bool)
        measured[:-1] = number[:-1] & after[1:]
        t = codes[numbers]
        t = np.where(capital, np.uint64(NAME), t)
        t = np.where(number, np.uint64(NUMBER), t)
        t = np.where(measured | ((flag & _QUANTITY) > 0), np.uint64(QUANTITY), t)
        first = np.flatnonzero(~after)
        v = values[numbers]
        # the words of a token, in order
        place = np.arange(n) - first[np.cumsum(~after) - 1]
        v = np.add.reduceat(v * (np.uint64(2) * place.astype(np.uint64) + np.uint64(1)), first)
        return t[first], v


def _rolled(t: np.ndarray, n: int) -> np.ndarray:
    k = len(t) - n + 1
    h = np.zeros(k, np.uint64)
    for j in range(n):
        h = (h + t[j : j + k]) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


def windows(t: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n tokens in a row: of the template, or of the words where fewer than LITERAL tokens are literal."""
    if len(t) < n:
        return np.empty(0, np.uint64)
    literal = np.concatenate([[0], np.cumsum(t > QUANTITY)])
    poor = literal[n:] - literal[:-n] < min(LITERAL, n)
    h = _rolled(t, n)
    return np.where(poor, ~_rolled(v, n), h) if poor.any() else h


def _slots(t: np.ndarray, v: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """For each window the values in its slots, 0 where it is literal. The lowest bits of a value tell its kind."""
    filled = np.where(t <= QUANTITY, (v & ~np.uint64(3)) | t | np.uint64(1 << 63), np.uint64(0))
    return filled[at[:, None] + np.arange(n)] if len(at) else np.empty((0, n), np.uint64)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([r.shape[1] for r in rows for _ in range(len(r))])]).astype(np.int32) if rows else np.zeros(1, np.int32)
    flat = np.concatenate([r.ravel() for r in rows]) if rows else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(h, item, tokens, q, n, slots): every window of every text; of items with one text the least id stands for all.

    The windows are WINDOW tokens long, or as long as the item if it is shorter; an item of fewer than LEAST tokens has none.
    """
    kind = benchmark.schema[id_col].dataType.simpleString()
    texts = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL").groupBy("text").agg(F.min("item").alias("item"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Templates()
        for b in slices(batches):
            h, own, size, q, n, slots = [], [], [], [], [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                t, v = words.template(words.numbers(text))
                width = min(WINDOW, len(t))
                if width < LEAST:
                    continue
                found = windows(t, v, width)
                at = np.arange(len(found))
                h.append(found)
                own += [k] * len(found)
                size += [len(t)] * len(found)
                q += at.tolist()
                n += [width] * len(found)
                slots.append(_slots(t, v, at, width))
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), b.column("item").take(pa.array(own)), *(pa.array(x, pa.int32()) for x in (size, q, n)), _lists(slots)], names=["h", "item", "tokens", "q", "n", "slots"])

    return materialise(spread(texts).mapInArrow(run, f"h bigint, item {kind}, tokens int, q int, n int, slots array<bigint>"), "leak-items")


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = np.uint64(FILTER_BITS - 1)
    return (h & top).astype(np.int64), ((h >> np.uint64(32)) & top).astype(np.int64)


def _filter(items: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Which bits the items' hashes set, and their window lengths. What reaches the driver is bounded by FILTER_BITS."""
    bit = F.explode(F.array(F.col("h").bitwiseAND(FILTER_BITS - 1), F.shiftrightunsigned("h", 32).bitwiseAND(FILTER_BITS - 1)))
    words = items.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("set")).toPandas()
    held = np.zeros(FILTER_BITS // 64, np.int64)
    held[words["word"].to_numpy(dtype=np.int64)] = words["set"].to_numpy(dtype=np.int64)
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # at most WINDOW
    return np.unpackbits(held.view(np.uint8), bitorder="little").view(bool), lengths


def document_windows(docs: DataFrame, items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tie, p, n, h, slots): the windows of whole texts that pass the items' filter."""
    held, lengths = _filter(items)
    packed = docs.sparkSession.sparkContext.broadcast((np.packbits(held), lengths))  # FILTER_BITS / 8 bytes
    text = text_or_empty(text_col)
    kept = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, lengths = packed.value
        set_ = lambda bit: (raw[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            own, p, n, h, slots = [], [], [], [], []
            for k, numbers in enumerate(_numbers(texts)):
                t, v = _words().template(numbers)
                for width in lengths:
                    found = windows(t, v, width)
                    one, two = _bits(found)
                    at = np.flatnonzero(set_(one))
                    at = at[set_(two[at]) > 0]
                    if len(at):
                        own += [k] * len(at)
                        p.append(at)
                        n += [width] * len(at)
                        h.append(found[at])
                        slots.append(_slots(t, v, at, width))
            if own:
                which = pa.array(own)
                yield pa.RecordBatch.from_arrays([b.column("id").take(which), b.column("tie").take(which), pa.array(np.concatenate(p).astype(np.int32)), pa.array(n, pa.int32()), pa.array(np.concatenate(h).view(np.int64)), _lists(slots)], names=["id", "tie", "p", "n", "h", "slots"])

    return spread(kept).mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, tie bigint, p int, n int, h bigint, slots array<bigint>")


def _words() -> Templates:
    """A worker's table of known words, kept for its later tasks."""
    return kept_by_worker("template words", lambda: [Templates()])[0]


def _numbers(texts: list[str]) -> Iterator[np.ndarray]:
    """Word numbers of each text. Words are numbered for many texts before the first is used, so that the tables of codes grow once for all of them."""
    known = kept_by_worker("template words", lambda: [Templates()])
    if len(known[0]) > KEPT_WORDS:
        known[:] = [Templates()]
    yield from [known[0].numbers(t) for t in texts]


def chains(found: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """(p, q, n) windows in common, as chains of spans (p, q, length): first runs along one alignment, then runs with at most GAP tokens between them on both sides.

    Spans of a chain do not overlap in the document or the item.
    """
    runs = defaultdict(list)
    for p, q, n in sorted(set(found)):
        own = runs[p - q]
        if own and p <= own[-1][0] + own[-1][2]:
            own[-1] = (own[-1][0], own[-1][1], max(own[-1][2], p + n - own[-1][0]))
        else:
            own.append((p, q, n))
    spans = sorted(s for own in runs.values() for s in own)
    score, back = [s[2] for s in spans], [-1] * len(spans)
    first = 0
    ends = [s[0] + s[2] for s in spans]
    longest = max((s[2] for s in spans), default=0)
    for k, (p, q, n) in enumerate(spans):
        while spans[first][0] + longest + GAP < p:
            first += 1
        for j in range(first, k):
            a, b, m = spans[j]
            # where spans meet the later one gives way
            over = max(0, ends[j] - p, b + m - q)
            if over < n and 0 <= p + over - ends[j] <= GAP and 0 <= q + over - (b + m) <= GAP and score[j] + n - over > score[k]:
                score[k], back[k] = score[j] + n - over, j
    used = set(back)
    for k in range(len(spans)):
        if k in used:
            continue
        chain = []
        while k >= 0:
            chain.append(spans[k])
            k = back[k]
        out: list[tuple[int, int, int]] = []
        for p, q, n in reversed(chain):
            over = max(0, out[-1][0] + out[-1][2] - p, out[-1][1] + out[-1][2] - q) if out else 0
            out.append((p + over, q + over, n - over))
        yield out


def consistent(tokens: list[tuple[int, int, int]]) -> tuple[int, int]:
    """The longest stretch [a, z) of (document place, item's value, document's value) in which values stand for each other one to one; 0 is a literal token."""
    here: dict[int, tuple[int, int]] = {}
    there: dict[int, tuple[int, int]] = {}
    best, start = (0, 0), 0
    for k, (_, own, its) in enumerate(tokens):
        if own:
            for table, key, value in ((here, own, its), (there, its, own)):
                known = table.get(key)
                if known and known[0] != value:
                    start = max(start, known[1] + 1)
            for table, key, value in ((here, own, its), (there, its, own)):
                table[key] = (value, k)
        if k + 1 - start > best[1] - best[0]:
            best = start, k + 1
    return best


def _needed(tokens: int) -> int:
    return min(RUN, max(LEAST, int(np.ceil(SHARE * tokens))))


def longest_leak(tokens: int, found: list[tuple]) -> tuple[int, int, int, int] | None:
    """(matched tokens, slots, changed slots, first document token) of the best chain of windows (p, q, n, document's slots, item's slots), None without a leak.

    Of chains alike the one that starts first in the document counts.
    """
    value = {}
    for p, q, n, its, own in found:
        for j in range(n):
            value[p + j, q + j] = own[j] or 0, its[j] or 0
    best = None
    for chain in chains([f[:3] for f in found]):
        placed = [(p + j, *value[p + j, q + j]) for p, q, n in chain for j in range(n)]
        a, z = consistent(placed)
        if z - a >= _needed(tokens) and (best is None or (a - z, placed[a][0]) < (-best[0], best[3])):
            slots = [x for x in placed[a:z] if x[1]]
            best = z - a, len(slots), sum(x[1] != x[2] for x in slots), placed[a][0]
    return best


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """(id, tie, item_id, run_tokens, item_tokens, slots, changed_slots, first_token) with the class's least item id."""
    items = item_windows(benchmark, item_col, item_text)
    kind = docs.schema[id_col].dataType.simpleString()
    found = materialise(document_windows(docs, items, id_col, text_col).distinct(), "leak-windows")
    # a window of many documents is split by salt; Spark broadcasts the items only where they are small
    salted = items.select("h", "item", "tokens", "q", "n", F.col("slots").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = found.withColumn("salt", F.pmod(F.xxhash64("id", "tie"), F.lit(SALTS)).cast("int"))
    common = dealt.join(salted, ["h", "n", "salt"]).select("id", "tie", "item", "tokens", F.struct("p", "q", "n", "slots", "own").alias("w"))
    grouped = common.groupBy("id", "tie", "item", "tokens").agg(F.collect_list("w").alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keep, rows = [], []
            for k, (tokens, ws) in enumerate(zip(b.column("tokens").to_pylist(), b.column("found").to_pylist(), strict=True)):
                leak = longest_leak(tokens, [(w["p"], w["q"], w["n"], w["slots"], w["own"]) for w in ws])
                if leak:
                    keep.append(k)
                    rows.append(leak)
            if keep:
                which = pa.array(keep)
                run_tokens, slots, changed, first = (pa.array(c, pa.int32()) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(which) for c in ("id", "tie", "item")), run_tokens, b.column("tokens").take(which), slots, changed, first], names=["id", "tie", "item_id", "run_tokens", "item_tokens", "slots", "changed_slots", "first_token"])

    item_kind = benchmark.schema[item_col].dataType.simpleString()
    out = materialise(grouped.mapInArrow(run, f"id {kind}, tie bigint, item_id {item_kind}, run_tokens int, item_tokens int, slots int, changed_slots int, first_token int"), "leaks")
    for done in (items, found):
        discard(done)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, run_tokens, item_tokens, slots, changed_slots, first_token, kind): one row for each item that leaked into a document.

    kind is `verbatim` or, with changed slots, `reparameterised`. Null and empty texts and items never match, nor do items
    of fewer than LEAST template tokens; windows poor in literal tokens match word for word only. Rows with one id and one
    text are one document; items with one text each give rows of their own. Other columns, whatever their names, are left
    out. An empty benchmark or corpus gives no rows. Of chains alike the first in the document counts. Texts are read whole.
    """
    found = _leaks(docs, benchmark, id_col, text_col, item_col, item_text)
    texts = benchmark.select(F.col(item_col).alias("item"), F.xxhash64(item_text).alias("a"), F.xxhash64(F.lit(1), item_text).alias("b")).where(F.col(item_text).isNotNull()).distinct()
    same = texts.join(texts.groupBy("a", "b").agg(F.min("item").alias("item_id")), ["a", "b"]).select("item_id", "item")
    out = found.join(same, "item_id").select(F.col("id").alias(id_col), F.col("item").alias("item_id"), "run_tokens", "item_tokens", "slots", "changed_slots", "first_token")
    return out.withColumn("kind", F.when(F.col("changed_slots") > 0, "reparameterised").otherwise("verbatim")).distinct()


def clean_rows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows of docs, all their columns, into which no item leaked."""
    found = _leaks(docs, benchmark, id_col, text_col, item_col, item_text).select("id", "tie").distinct()
    tie = free_name(docs, "tie")
    own = docs.withColumn(tie, F.xxhash64(text_or_empty(text_col)))
    hit = found.select(F.col("id").alias("hit_id"), F.col("tie").alias("hit_tie"))
    return own.join(hit, F.col(f"`{id_col}`").eqNullSafe(F.col("hit_id")) & (F.col(tie) == F.col("hit_tie")), "left_anti").select(*[f"`{c}`" for c in docs.columns])
