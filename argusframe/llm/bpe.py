"""Operator 1: byte-level BPE encoding and decoding.

The tokenizers library applies the merges to Arrow batches; bytes stand as printable characters as in every byte-level
vocabulary. The rank file names tokens only. Its merges follow from it: a token's last merge is the one that the rank
order itself makes inside that token alone, and no other pair can ever form the token, so the library's list of pairs
and the rank order give the same ids. Decoding reverses the byte table over the joined bytes, so characters split over
several tokens come back whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_by_worker, slices, spread, text_or_empty

#: Entries at which a worker's tables of encoded pieces and words are emptied, and characters of texts that are encoded together.
KEPT, AT_ONCE = 250_000, 1 << 20


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        options = [(ranks[both], i) for i in range(len(parts) - 1) if (both := parts[i] + parts[i + 1]) in ranks]
        if not options:
            return None
        i = min(options)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def tokenizer_json(ranks: dict[bytes, int]) -> str:
    """The tokenizers library's form of a rank file, for pieces that are split already."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    chars = byte_characters()
    shown = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = [(shown[m[0]], shown[m[1]]) for t in sorted(ranks, key=ranks.get) if len(t) > 1 and (m := _last_merge(t, ranks))]
    out = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return out.to_str()


class Codec:
    """Encodes and decodes on one worker."""

    def __init__(self, spec: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # an executor's cores are shared out by Spark
        import regex
        from tokenizers import Tokenizer

        # the rank files' users read \s as White_Space, which Python's \s goes beyond
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall if pattern else None
        self.tangled = regex.compile(r"\p{White_Space} (?:\p{White_Space}|\Z)").search
        self.tokenizer = Tokenizer.from_str(spec)
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}  # what stands between two spaces, encoded with the space before it
        back = {c: b for b, c in enumerate(byte_characters())}
        vocab = json.loads(spec)["model"]["vocab"]
        self.tokens = [b""] * (max(vocab.values(), default=-1) + 1)
        for shown, i in vocab.items():
            self.tokens[i] = bytes(back[c] for c in shown)
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)

    def _learn(self, pieces: set[str]) -> None:
        some = [p for p in pieces if p not in self.pieces]
        found = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
        self.pieces.update((p, struct.pack(f"<{len(e.ids)}I", *e.ids)) for p, e in zip(some, found, strict=True))

    def encode(self, texts: list[str], by_words: bool = False) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        by_words says that in the pattern a space begins a piece unless white space stands on both its sides, as in
        public_tokenizers.PATTERN. Then a text without such a space can be cut at its spaces, and each word is split once.
        Texts are taken together up to AT_ONCE characters, so that the library gets each of their pieces once.
        """
        at = 0
        while at < len(texts):
            upto, n = at, 0
            while upto < len(texts) and (upto == at or n + len(texts[upto]) <= AT_ONCE):
                n += len(texts[upto])
                upto += 1
            yield from self._encode(texts[at:upto], by_words)
            at = upto

    def _encode(self, texts: list[str], by_words: bool) -> Iterator[bytes]:
        for table in (self.pieces, self.words):
            if len(table) > KEPT:
                table.clear()
        cut = [t.split(" ") if by_words and not self.tangled(t) else [t] for t in texts]
        heads = [self.split(head) for head, *_ in cut]
        new = {w: self.split(" " + w) for w in {w for words in cut for w in words[1:]} if w not in self.words}
        self._learn({p for found in (*heads, *new.values()) for p in found})
        get = self.pieces.__getitem__
        self.words.update((w, b"".join(map(get, found))) for w, found in new.items())
        word = self.words.__getitem__
        for head, words in zip(heads, cut, strict=True):
            yield b"".join([*map(get, head), *map(word, words[1:])])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join([self.tokens[i] for i in ids.tolist()])

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """The byte offset at which each token ends."""
        return np.cumsum(self.lengths[ids])


def _codec(spec: str, pattern: str) -> Codec:
    """A worker's codec; it stays, with the pieces it knows, for the worker's later tasks."""
    return kept_by_worker(f"codec {hashlib.sha256(f'{pattern} {spec}'.encode()).hexdigest()}", lambda: Codec(spec, pattern))


def character_offsets(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last character of each token, from byte ends; a token that holds part of a character covers it."""
    first = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    upto = np.concatenate([[0], np.cumsum(first)])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    return upto[np.minimum(starts + 1, len(raw))] - 1, upto[ends]


def _spec(spark: SparkSession, path: str, pattern: str):
    """Broadcast: some two megabytes, the size of the vocabulary file, whatever the corpus."""
    return spark.sparkContext.broadcast((tokenizer_json(read_ranks(path)), pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, by_words: bool = False) -> DataFrame:
    """(id, ids array<int>[, char_start, char_end arrays]): every whole text by the ranks in the file at path.

    A null text counts as empty and has no ids. Rows keep their number and may repeat; other columns are left out,
    whatever their names. by_words is a shortcut for patterns in which a space begins a piece (see Codec.encode); any
    other pattern needs it off.
    """
    cast = _spec(docs.sparkSession, path, pattern)
    kept = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    schema = f"id {kept.schema['id'].dataType.simpleString()}, ids array<int>" + (", char_start array<int>, char_end array<int>" if offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*cast.value)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            found = [np.frombuffer(b, "<u4").astype(np.int32) for b in codec.encode(texts, by_words)]
            columns = [batch.column("id"), _lists(found)]
            if offsets:
                spans = [character_offsets(t.encode(), codec.ends(x)) for t, x in zip(texts, found, strict=True)]
                columns += [_lists([s[0] for s in spans]), _lists([s[1] for s in spans])]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "char_start", "char_end"][: len(columns)])

    return spread(kept).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.empty(0, np.int32)]).astype(np.int32)))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary): the bytes of each id list joined. Null lists decode to no bytes; unknown ids are an error."""
    cast = _spec(encoded.sparkSession, path, "")
    kept = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*cast.value)
        for batch in slices(batches):
            raw = [codec.decode(np.array(x or [], dtype=np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(raw, pa.binary())], names=["id", "decoded"])

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, decoded binary").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, by_words: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, n_chars_covered): encodes each text, decodes its ids, and digests both in one pass.

    n_chars_covered is the last token's end in characters: the text's length if offsets hold. keep_ids adds ids array<int>;
    by_words is as in encode().
    """
    cast = _spec(docs.sparkSession, path, pattern)
    kept = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*cast.value)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in slices(batches):
            n, ids_sha, raw_sha, covered, kept_ids = [], [], [], [], []
            for packed in codec.encode(batch.column("text").to_pylist(), by_words):
                ids = np.frombuffer(packed, "<u4")
                raw = codec.decode(ids)
                _, last = character_offsets(raw, codec.ends(ids))
                n.append(len(ids))
                ids_sha.append(sha(packed))
                raw_sha.append(sha(raw))
                covered.append(int(last[-1]) if len(ids) else 0)
                if keep_ids:
                    kept_ids.append(ids.astype(np.int32))
            columns = [batch.column("id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string()), pa.array(covered, pa.int64()), *([_lists(kept_ids)] if keep_ids else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chars_covered", "ids"][: len(columns)])

    schema = f"id {kept.schema['id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_chars_covered bigint" + (", ids array<int>" if keep_ids else "")
    return spread(kept).mapInArrow(run, schema).withColumnRenamed("id", id_col)
