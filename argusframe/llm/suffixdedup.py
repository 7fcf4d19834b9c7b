"""Operator 10: byte dedup by a sparse, range-partitioned suffix array.

A byte goes if a LENGTH-byte string that covers it also starts earlier. Suffixes are taken at anchors only: the leftmost
least hash of GRAM bytes among those in a LENGTH-byte string. Equal strings have their anchor at one place, so any two
that match meet at suffixes with equal leading GRAM bytes, and no string lacks an anchor.

1. Splitters are drawn from a sample of documents: a suffix's first bytes, then its leading token of GRAM bytes (by hash), the bytes
   that anchored strings can reach (by hash), and document and place, so that a token of any number of suffixes is spread
   over partitions. One pass makes the suffixes and deals them to the ranges; each range is sorted in that order.
   In a range equal surroundings stand side by side: all but the first are wholly repeated. A token at either end of a range may
   go on in the next: the first ones of its surroundings are compared across boundaries.
2. What remains are the first suffixes of differing surroundings with a token in common, where repeats begin and end. They
   take their bytes along to their ranges, where chunks of whole tokens are sorted by multikey quicksort, to the right and
   reversed to the left; common prefixes on both sides tell, byte by byte, which strings start earlier elsewhere. Of a token
   that lies across a boundary, of ranges or of chunks, each side puts forward the first of its equal strings, and these are
   compared by digest.
3. The strings' spans are united by document and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, release, slices, spread, text_or_empty, trim

LENGTH, GRAM = 100, 32
#: Anchors lie within so many places of a string's start.
REACH = LENGTH - GRAM
#: Suffixes in a range, bytes of text to a suffix at least, and first suffixes that are sorted at once.
PER_PARTITION, SPACING, CHUNK = 1_500_000, 34, 20_000
#: Sampled suffixes for each range, and of all ranges together at most: splitters decide the balance, not the result.
SAMPLED, MOST_SAMPLED = 500, 400_000
#: Rows of a batch that are worked on at once.
ROWS = 500

_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM = 32 bytes at every place, by doubling."""
    h, n = _TABLE[raw], 1
    for odd in _ODD:
        h = h[:-n] * odd + h[n:]
        n *= 2
    return _mixed(h)


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over every `width` entries in a row."""
    n = 1
    while n * 2 <= width:
        x = best(x[:-n], x[n:])
        n *= 2
    return best(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, token hash, surroundings hash) of each anchor; none in texts shorter than LENGTH."""
    n = len(raw)
    if n < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    h = gram_hashes(raw)
    least = _sliding(h, REACH + 1, np.minimum)  # of the string at every place
    reach = np.concatenate([np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64)])
    p = np.flatnonzero(h == _sliding(reach, REACH + 1, np.maximum))
    around = np.minimum(p, REACH).astype(np.uint64) * _ODD[0] + np.minimum(n - p, LENGTH).astype(np.uint64) * _ODD[1]
    for step in (-REACH, -REACH + 32, -REACH + 64, LENGTH - 72, LENGTH - 40, LENGTH - 32):
        at = np.clip(p + step, 0, n - GRAM)
        around = _mixed(around * _ODD[2] + h[at] + (at - p).astype(np.uint64) * _ODD[3])
    return p, h[p], around


def _ordered(id_col: str, docs: DataFrame) -> tuple[Column, Column]:
    """The id as a sort key without nulls, a null first, and the way back from column `doc`."""
    kind, own = docs.schema[id_col].dataType.simpleString(), F.col(f"`{id_col}`")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(own.cast("bigint"), F.lit(-(1 << 63))), F.when(F.col("doc") != -(1 << 63), F.col("doc"))
    return F.when(own.isNull(), "").otherwise(F.concat(F.lit("="), own.cast("string"))), F.when(F.col("doc") != "", F.substring("doc", 2, 1 << 30).cast(kind))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, tie, text): documents in order of their id, then of their text's hash; a null id comes first."""
    text = text_or_empty(text_col)
    return docs.select(_ordered(id_col, docs)[0].alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))


def _numbers(column) -> np.ndarray:
    """A column of ids as integers in the same order."""
    if pa.types.is_integer(column.type):
        return column.to_numpy()
    return np.unique(np.array(column.to_pylist(), dtype=object), return_inverse=True)[1].ravel()


_SIGN = np.uint64(1 << 63)
_KEYS = ["lead", "token", "around", "doc", "tie", "at"]


def _suffixes(batch: pa.RecordBatch) -> pa.Table:
    """(lead, token, around, doc, tie, at) of every anchor in (doc, tie, text). lead has a suffix's first eight bytes, in order as signed integers."""
    texts = [np.frombuffer(t.encode(), np.uint8) for t in batch.column("text").to_pylist()]
    found = [anchors(t) for t in texts]
    at, token, around = (np.concatenate(x) for x in zip(*found, strict=True))
    lead = [np.zeros(0, np.uint64)]
    for raw, (p, _, _) in zip(texts, found, strict=True):
        if len(p):
            lead.append(np.lib.stride_tricks.sliding_window_view(raw, 8)[p].copy().view(">u8").ravel().astype(np.uint64) ^ _SIGN)
    which = pa.array(np.repeat(np.arange(batch.num_rows), [len(x[0]) for x in found]))
    return pa.table({"lead": pa.array(np.concatenate(lead).view(np.int64)), "token": pa.array(token.view(np.int64)), "around": pa.array(around.view(np.int64)), "doc": batch.column("doc").take(which), "tie": batch.column("tie").take(which), "at": pa.array(at.astype(np.int32))})


def suffixes(own: DataFrame, one_in: int = 1) -> DataFrame:
    """The suffixes of documents; with one_in, of about one in so many by hash."""
    kind = own.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ROWS):
            if b.num_rows:
                t = _suffixes(b)
                if one_in > 1:
                    t = t.filter(pa.array(_mixed(t["around"].to_numpy().view(np.uint64) + t["tie"].to_numpy().view(np.uint64)) % np.uint64(one_in) == 0))
                yield from t.combine_chunks().to_batches()

    return spread(own).mapInArrow(run, f"lead bigint, token bigint, around bigint, doc {kind}, tie bigint, at int")


def splitters(own: DataFrame, total: int, parts: int) -> list[tuple]:
    """parts - 1 keys that cut the suffixes of a sample of documents evenly. The sample is bounded by MOST_SAMPLED, give or take its chance."""
    wanted = min(SAMPLED * parts, MOST_SAMPLED)
    expected = max(1, total // SPACING)
    # documents are sampled first, at ten times the share, so that most texts need no pass
    documents = max(1, expected // (10 * wanted))
    some = own.where(F.pmod(F.xxhash64("tie", "doc", F.lit(7)), F.lit(documents)) == 0)
    rows = suffixes(some, max(1, expected // (documents * wanted))).toPandas().sort_values(_KEYS)
    at = np.linspace(0, len(rows), parts + 1)[1:-1].astype(int) if len(rows) else []
    return sorted({tuple(x.item() if hasattr(x, "item") else x for x in rows.iloc[i]) for i in at})


def ranges_of(t: pa.Table, keys: list[tuple]) -> np.ndarray:
    """For each row of t the number of keys that are not beyond it, column by column: rows that equal a key so far go on to the next column."""
    n = t.num_rows
    lo, hi = np.zeros(n, np.int64), np.full(n, len(keys), np.int64)
    if not keys:
        return lo
    open_ = np.arange(n)
    for k, name in enumerate(_KEYS):
        column = np.array([x[k] for x in keys], dtype=object if isinstance(keys[0][k], str) else np.int64)
        values = t[name].take(pa.array(open_))
        values = np.array(values.to_pylist(), dtype=object) if column.dtype == object else values.to_numpy()
        # keys that agree in all columns before are side by side; each such stretch is searched by itself
        for stretch in np.unique(np.stack([lo[open_], hi[open_]], axis=1), axis=0).tolist():
            rows = np.flatnonzero((lo[open_] == stretch[0]) & (hi[open_] == stretch[1]))
            own = column[stretch[0] : stretch[1]]
            at = open_[rows]
            lo[at], hi[at] = stretch[0] + np.searchsorted(own, values[rows], "left"), stretch[0] + np.searchsorted(own, values[rows], "right")
        open_ = open_[lo[open_] < hi[open_]]
        if not len(open_):
            break
    return hi


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted range's suffixes by kind: 0 wholly repeated, 1 first of one of several surroundings of a token, 2 first of a surrounding of a token that may go on in another range.

    Rows stream past; what is held is the range's last token, one row for each of its surroundings, and of others one row.
    """
    part = TaskContext.get().partitionId()

    def out(rows: pa.Table, kind: np.ndarray) -> pa.RecordBatch:
        # who is wholly repeated is known by its place alone
        kept = {c: pa.nulls(rows.num_rows, pa.int64()) if not kind.any() and c in ("lead", "token", "around") else rows[c] for c in _KEYS}
        rows = pa.table(kept)
        return rows.append_column("kind", pa.array(kind.astype(np.int32))).append_column("part", pa.array(np.full(rows.num_rows, part, np.int32))).combine_chunks().to_batches()

    held: pa.Table | None = None  # firsts of the token at hand
    opening, last = None, None  # the range's first token, and (token, around) of the last row
    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([b])
        token, around = rows["token"].to_numpy(), rows["around"].to_numpy()
        opening = token[0] if opening is None else opening
        before = np.concatenate([[token[0] if last is None else last[0]], token[:-1]])
        other = token != before
        other[0] |= last is None
        first = other | (around != np.concatenate([[around[0] if last is None else last[1]], around[:-1]]))
        first[0] |= last is None
        last = token[-1], around[-1]
        if (~first).any():
            yield from out(rows.filter(pa.array(~first)), np.zeros(int((~first).sum())))
        firsts = rows.filter(pa.array(first))
        held = firsts if held is None else pa.concat_tables([held, firsts])
        # all tokens but the last are complete
        token = held["token"].to_numpy()
        done = token != token[-1]
        if done.any():
            yield from _closed(held.filter(pa.array(done)), opening, None, out)
            held = held.filter(pa.array(~done)).combine_chunks()
    if held is not None and held.num_rows:
        yield from _closed(held, opening, last[0], out)
    trim()


def _closed(firsts: pa.Table, opening, closing, out) -> Iterator[pa.RecordBatch]:
    token = firsts["token"].to_numpy()
    group = np.cumsum(np.concatenate([[False], token[1:] != token[:-1]]))
    several = np.bincount(group)[group] > 1
    edge = (token == opening) | (np.zeros(len(token), bool) if closing is None else token == closing)
    kind = np.where(edge, 2, np.where(several, 1, 3))
    if (kind < 3).any():
        yield from out(firsts.filter(pa.array(kind < 3)), kind[kind < 3])


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of rows of words: every segment of equal words so far is split in three by a pivot of its own in its next word, all
    segments at a time; the middle third goes on with the word after, until a row stands alone or has no words left."""
    n, width = words.shape
    order = np.arange(n)
    if n < 2 or not width:
        return order
    place = np.arange(n)  # of the rows still in segments
    segment, depth = np.zeros(n, np.int64), np.zeros(n, np.int64)
    while len(place):
        rows = order[place]
        value = words[rows, depth]
        starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        sizes = np.diff(np.append(starts, len(place)))
        three = np.sort(np.stack([value[starts], value[starts + sizes // 2], value[starts + sizes - 1]]), axis=0)
        pivot = np.repeat(three[1], sizes)
        third = np.where(value < pivot, 0, np.where(value == pivot, 1, 2))
        key = np.repeat(np.arange(len(starts)) * 3, sizes) + third
        moved = np.argsort(key, kind="stable")
        order[place] = rows[moved]
        key, depth = key[moved], depth[moved] + (third[moved] == 1)
        ends = np.concatenate([key[1:] != key[:-1], [True]])
        alone = np.concatenate([[True], ends[:-1]]) & ends
        stay = ~alone & (depth < width)
        place, segment, depth = place[stay], key[stay], depth[stay]
    return order


def _shared(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row in order shares with the one before."""
    differ = rows[order[1:]] != rows[order[:-1]]
    return np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), rows.shape[1])])


def _words(rows: np.ndarray) -> np.ndarray:
    pad = (-rows.shape[1]) % 8
    return np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(">u8").astype(np.uint64)


def classes(token: np.ndarray, context: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(offset, rows, first): of the rows with a string starting offset bytes before the anchor, whether it is the first of its equals.

    Rows are in order of document and place. context holds REACH bytes before and LENGTH bytes from each anchor; left and
    right say how many of them the text has.
    """
    n = len(token)
    own = np.unique(token, return_inverse=True)[1]
    to_right, to_left = context[:, REACH:], np.ascontiguousarray(context[:, :REACH][:, ::-1])
    order_r = multikey_quicksort(np.concatenate([own[:, None].astype(np.uint64), _words(to_right)], axis=1))
    order_l = multikey_quicksort(_words(to_left))
    shared_r = np.where(np.concatenate([[False], own[order_r[1:]] == own[order_r[:-1]]]), _shared(to_right, order_r), -1)
    shared_l = _shared(to_left, order_l)
    r, l = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(REACH + 1):
        rows = np.flatnonzero((left >= offset) & (right >= LENGTH - offset))
        if not len(rows):
            continue
        r[order_r] = np.cumsum(shared_r < LENGTH - offset)
        l[order_l] = np.cumsum(shared_l < offset) if offset else 0
        first = np.zeros(len(rows), bool)
        first[np.unique(r[rows] * (n + 1) + l[rows], return_index=True)[1]] = True
        yield offset, rows, first


_SECOND = np.random.default_rng(71).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def digests(context: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each string that starts offset bytes before the anchor."""
    out = []
    string = context[:, REACH - offset : REACH - offset + LENGTH]
    for table in (_TABLE, _SECOND):
        h, n = table[string], 1
        for odd in _ODD:
            h = h[:, :-n] * odd + h[:, n:]
            n *= 2
        total = np.zeros(len(string), np.uint64)
        for at in (0, GRAM, 2 * GRAM, LENGTH - GRAM):
            total = _mixed(total * _ODD[2] + h[:, at])
        out.append(total)
    return out[0], out[1]


def _contexts(joined: DataFrame) -> DataFrame:
    """(part, open, lead, token, doc, tie, at, context, left, right) of the anchors listed beside each text."""
    kind = joined.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "open", "lead", "token", "doc", "tie", "at", "context", "left", "right"]
        for b in slices(batches, ROWS):
            ats = b.column("ats")
            n = np.array(ats.value_lengths())
            which = pa.array(np.repeat(np.arange(b.num_rows), n))
            flat = ats.flatten()
            at = flat.field("at").to_numpy()
            out, left, right, k = [], [], [], 0
            for text, m in zip(b.column("text").to_pylist(), n.tolist(), strict=True):
                raw = text.encode()
                for p in at[k : k + m].tolist():
                    before, after = raw[max(0, p - REACH) : p], raw[p : p + LENGTH]
                    left.append(len(before))
                    right.append(len(after))
                    out.append(before.rjust(REACH, b"\0") + after.ljust(LENGTH, b"\0"))
                k += m
            for x in range(0, len(out), 20_000):
                s = slice(x, x + 20_000)
                w = which[x : x + 20_000]
                kept = [flat.field(c)[x : x + 20_000] for c in ("part", "open", "lead", "token")]
                yield pa.RecordBatch.from_arrays([*kept, b.column("doc").take(w), b.column("tie").take(w), pa.array(at[s]), pa.array(out[s], pa.binary()), pa.array(left[s], pa.int32()), pa.array(right[s], pa.int32())], names=names)

    return joined.select("doc", "tie", "text", "ats").mapInArrow(run, f"part int, open boolean, lead bigint, token bigint, doc {kind}, tie bigint, at int, context binary, left int, right int")


_SPANS = ["doc", "tie", "start", "end", "d1", "d2"]


def _chunk_spans(rows: pa.Table, open_: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Spans of the strings in a chunk that start earlier in it, without digests; then, of rows in open tokens, the first of equal strings with theirs."""
    order = np.lexsort((rows["at"].to_numpy(), rows["tie"].to_numpy(), _numbers(rows["doc"].combine_chunks())))
    rows, open_ = rows.take(pa.array(order)), open_[order]
    at = rows["at"].to_numpy()
    context = np.frombuffer(b"".join(rows["context"].to_pylist()), np.uint8).reshape(-1, REACH + LENGTH)
    low, high = np.full(len(at), 1 << 40), np.full(len(at), -1)
    parts = []

    def batch(row: np.ndarray, start: np.ndarray, end: np.ndarray, d1=None, d2=None) -> pa.RecordBatch:
        w = pa.array(row)
        empty = pa.nulls(len(row), pa.int64())
        own = [rows[c].take(w).combine_chunks() for c in ("doc", "tie")]
        return pa.RecordBatch.from_arrays([*own, pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), *(empty if d is None else pa.array(d.view(np.int64)) for d in (d1, d2))], names=_SPANS)

    for offset, which, first in classes(rows["token"].to_numpy(), context, rows["left"].to_numpy(), rows["right"].to_numpy()):
        # offsets come in rising order, so starts fall; a span ends where the next string would leave a gap
        hit = which[~first]
        gap = hit[(high[hit] >= 0) & (low[hit] > at[hit] - offset + LENGTH)]
        parts.append((gap, low[gap].copy(), high[gap].copy()))
        high[gap] = -1
        high[hit] = np.where(high[hit] < 0, at[hit] - offset + LENGTH, high[hit])
        low[hit] = at[hit] - offset
        forward = which[first & open_[which]]
        for x in range(0, len(forward), 2000):
            some = forward[x : x + 2000]
            yield batch(some, at[some] - offset, at[some] - offset + LENGTH, *digests(context[some], offset))
    last = np.flatnonzero(high >= 0)
    parts.append((last, low[last], high[last]))
    row, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    if len(row):
        yield batch(row, start, end)


def _in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of a range whose rows come sorted by token: chunks of whole tokens; one that fills more than a chunk is cut, and then open."""
    held: list[pa.Table] = []
    n, cut = 0, None  # rows held, and the token that goes on from the chunk before

    def flush(rows: pa.Table, goes_on) -> Iterator[pa.RecordBatch]:
        token = rows["token"].to_numpy()
        open_ = rows["open"].to_numpy() | (np.zeros(len(token), bool) if cut is None else token == cut) | (np.zeros(len(token), bool) if goes_on is None else token == goes_on)
        yield from _chunk_spans(rows, open_)

    for b in slices(batches, CHUNK):
        held.append(pa.Table.from_batches([b]))
        n += b.num_rows
        if n < 2 * CHUNK:
            continue
        rows = pa.concat_tables(held).combine_chunks()
        token = rows["token"].to_numpy()
        begins = np.flatnonzero(token[1:] != token[:-1]) + 1
        inside = begins[begins <= CHUNK]
        at = int(inside[-1]) if len(inside) else CHUNK
        goes_on = None if len(inside) else token[CHUNK - 1]
        while True:
            yield from flush(rows.slice(0, at), goes_on)
            cut = goes_on
            rows = rows.slice(at)
            if rows.num_rows < 2 * CHUNK:
                break
            token = rows["token"].to_numpy()
            begins = np.flatnonzero(token[1:] != token[:-1]) + 1
            inside = begins[begins <= CHUNK]
            at = int(inside[-1]) if len(inside) else CHUNK
            goes_on = None if len(inside) else token[CHUNK - 1]
        held, n = [rows.combine_chunks()], rows.num_rows
    if n:
        yield from flush(pa.concat_tables(held).combine_chunks(), None)
    trim()


def repeated_spans(own: DataFrame) -> DataFrame:
    """(doc, tie, start, end) of bytes that go, for documents of keyed(). Spans may overlap."""
    spark = own.sparkSession
    kind = own.schema["doc"].dataType.simpleString()
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = max(spark.sparkContext.defaultParallelism, -(-total // (SPACING * PER_PARTITION)))
    keys = splitters(own, total, wanted)
    parts = len(keys) + 1
    cast = spark.sparkContext.broadcast(keys)  # one key a range

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ROWS):
            if b.num_rows:
                t = _suffixes(b)
                yield from t.append_column("part", pa.array(ranges_of(t, cast.value).astype(np.int32))).combine_chunks().to_batches()

    key = f"lead bigint, token bigint, around bigint, doc {kind}, tie bigint, at int"
    dealt = spread(own).mapInArrow(deal, f"{key}, part int").repartitionById(parts, F.col("part")).drop("part").sortWithinPartitions(*_KEYS)
    found = materialise(dealt.mapInArrow(_compared, f"{key}, kind int, part int"), "suffix-kinds")
    release(spark)
    # first suffixes of each range's first and last token, compared across boundaries
    place = F.struct("doc", "tie", "at", "part", "lead")
    edge = found.where("kind = 2")
    best = materialise(edge.groupBy("token", "around").agg(F.min(place).alias("m")), "suffix-edges")
    spans_parts = edge.groupBy("token").agg((F.min("around") < F.max("around")).alias("several"), (F.min("part") < F.max("part")).alias("open"))
    beaten = edge.join(best, ["token", "around"]).where(F.struct("doc", "tie", "at") > F.struct("m.doc", "m.tie", "m.at")).select("doc", "tie", "at")
    covered = found.where("kind = 0").select("doc", "tie", "at").union(beaten)
    met = best.join(spans_parts.where("several"), "token").select("token", "m.doc", "m.tie", "m.at", "m.part", "m.lead", "open")
    firsts = found.where("kind = 1").select("token", "doc", "tie", "at", "part", "lead", F.lit(False).alias("open")).unionByName(met)
    listed = firsts.groupBy("doc", "tie").agg(F.collect_list(F.struct("part", "open", "lead", "token", "at")).alias("ats"))
    contexts = _contexts(own.join(listed, ["doc", "tie"]))
    sorted_ = contexts.repartitionById(parts, F.col("part")).sortWithinPartitions("lead", "token")
    spans = materialise(sorted_.mapInArrow(_in_chunks, f"doc {kind}, tie bigint, start int, end int, d1 bigint, d2 bigint"), "suffix-strings")
    release(spark)
    # equal strings on both sides of a boundary: the first of all stays
    forward = spans.where("d1 IS NOT NULL")
    firsts_of = forward.groupBy("d1", "d2").agg(F.min(F.struct("doc", "tie", "start")).alias("first"), F.max(F.struct("doc", "tie", "start")).alias("last")).where("first < last").select("d1", "d2", "first")
    later = forward.join(firsts_of, ["d1", "d2"]).where(F.struct("doc", "tie", "start") > F.col("first")).select("doc", "tie", "start", "end")
    whole = covered.select("doc", "tie", (F.col("at") - REACH).alias("start"), (F.col("at") + LENGTH).alias("end"))
    out = materialise(spans.where("d1 IS NULL").select("doc", "tie", "start", "end").union(later).union(whole), "suffix-spans")
    for x in (found, best, spans):
        discard(x)
    release(spark)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary): each document without the bytes that repeat earlier ones.

    Earlier is a smaller id or, in one document, an earlier start. Rows with one id and one text are one document and
    share its result; of rows with one id and several texts the text with the smaller hash is earlier; null ids come
    first. Integer ids are ordered as numbers, others by their text. Null and empty texts, and those shorter than LENGTH
    bytes, lose nothing. Kept bytes may split characters. Other columns, whatever their names, are left out.
    """
    back = _ordered(id_col, docs)[1]
    own = keyed(docs, id_col, text_col)
    kind = own.schema["doc"].dataType.simpleString()
    spans = repeated_spans(own).groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ROWS):
            total, removed, runs, kept = [], [], [], []
            for text, cuts in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw = text.encode()
                n = len(raw)
                edges = np.zeros(n + 1, np.int32)
                if cuts:
                    s = np.clip([c["start"] for c in cuts], 0, n)
                    e = np.clip([c["end"] for c in cuts], 0, n)
                    np.add.at(edges, s, 1)
                    np.add.at(edges, e, -1)
                gone = np.cumsum(edges[:n]) > 0
                total.append(n)
                removed.append(int(gone.sum()))
                runs.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if n else 0)
                kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = own.join(spans, ["doc", "tie"], "left").select("doc", "text", "spans")
    out = joined.mapInArrow(run, f"doc {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.select(back.alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
