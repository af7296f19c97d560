"""Byte-level BPE: encoding and decoding with a public tokenizer file.

A text is cut at special tokens, then by the file's pattern; each piece's bytes become symbols of a doubly linked
list, and a priority queue of merge ranks joins neighbours, lowest rank and leftmost first; an entry whose neighbours
have changed since is stale and skipped. Decoding concatenates vocabulary strings. The vocabulary, of fixed size, is
read once on the driver and sent to the executors; pieces already seen are kept in a bounded table of each worker.

Defined results: null or empty text: no tokens, decoded to the empty text; a null array of ids as well. Unknown ids are an error. Repeated rows
are encoded each; extra columns are kept, an empty table gives no rows."""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import text as T
from .common import small_arrow_batches

#: Fixed value: the pattern of byte-level tokenizers of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker keeps, the longest of them, and the length from which a text's pieces are not listed all at once.
KEPT, LONGEST, LONG_TEXT = 250_000, 48, 1 << 20


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in such vocabularies: itself where printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def checked(text: str) -> dict:
    """A tokenizer file's content, if it is of the kind read here."""
    spec = json.loads(text)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec["normalizer"] or pre["add_prefix_space"]:
        raise ValueError("not a plain byte-level BPE file")
    return spec


class Encoder:
    """Of a tokenizer file what encoding needs: symbols of bytes, ranks of symbol pairs, special tokens."""

    def __init__(self, text: str, kept: int = KEPT, long_text: int = LONG_TEXT):
        spec = checked(text)
        self.long_text = long_text
        vocab = spec["model"]["vocab"]
        self.symbol = [vocab[c] for c in byte_letters()]
        self.rank: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]  # of a pair: by its left symbol, then by its right
        self.joined = []  # by rank
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[vocab[a]][vocab[b]] = rank
            self.joined.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.known = Known(self, kept)

    def merged(self, piece: str) -> list[int]:
        rank, joined = self.rank, self.joined
        symbol = [*map(self.symbol.__getitem__, piece.encode())]
        # an entry is the rank and, in its low 32 bits, the place of the left symbol
        queue = [r << 32 | i for i, (a, b) in enumerate(zip(symbol, symbol[1:])) if (r := rank[a].get(b)) is not None]
        if not queue:
            return symbol
        heapify(queue)
        n = len(symbol)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j < 0 or (left := symbol[i]) < 0 or rank[left].get(symbol[j]) != entry >> 32:
                continue  # stale
            symbol[i] = new = joined[entry >> 32]
            symbol[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank[new].get(symbol[k])) is not None:
                    heappush(queue, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank[symbol[h]].get(new)) is not None:
                heappush(queue, r << 32 | h)
        return [s for s in symbol if s >= 0]

    def ids(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        pieces = self.pattern.findall(text) if len(text) < self.long_text else (m[0] for m in self.pattern.finditer(text))
        return b"".join(map(self.known.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        """Ids as consecutive 32-bit integers."""
        if self.split is None or not self.split.search(text):
            return self.ids(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [self.ids(text[at : m.start()]), np.int32(self.special[m[0]]).tobytes()]
            at = m.end()
        return b"".join([*out, self.ids(text[at:])])


class Decoder:
    """Of a tokenizer file what decoding needs: the bytes of every id, one after the other, and where each begins."""

    def __init__(self, text: str):
        spec = checked(text)
        of = {c: b for b, c in enumerate(byte_letters())}
        strings = {i: bytes(of[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        strings |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.data = np.frombuffer(b"".join(strings.get(i, b"") for i in range(max(strings) + 1)), np.uint8)
        self.size = np.array([len(strings[i]) if i in strings else -1 for i in range(max(strings) + 1)])
        self.start = np.concatenate([[0], np.cumsum(np.maximum(self.size, 0))])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of ids[offsets[i]:offsets[i+1]]; bytes that are no UTF-8 become replacement characters."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or self.size[ids].min() < 0):
            raise ValueError("unknown token id")
        size = self.size[ids]
        end = np.concatenate([[0], np.cumsum(size)])
        data = self.data[np.arange(end[-1]) + np.repeat(self.start[ids] - end[:-1], size)]
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(end[offsets].astype(np.int64)), pa.py_buffer(data)])
        try:
            return texts.cast(pa.string())  # checks
        except pa.ArrowInvalid:
            return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


class Known(dict):
    """Ids of pieces seen, in two generations: when the young one is full, it becomes the old one, and pieces met again
    come back from there. Memory stays bounded, and frequent pieces stay known."""

    def __init__(self, encoder: Encoder, kept: int):
        self.encoder, self.kept, self.old = encoder, kept, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            found = self.encoder.merged(piece)
            ids = pack(f"={len(found)}i", *found)
        if len(piece) <= LONGEST:
            if len(self) >= self.kept:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def read_file(spark: SparkSession, path: str) -> str:
    """The tokenizer file's text, from any file system that Spark reads."""
    return "".join(r.value for r in spark.read.text(path, wholetext=True).collect())


_made: dict[type, tuple[str, Encoder | Decoder]] = {}


def made(kind: type, sent: Sent):
    """One encoder and decoder for each worker, of the file it had last."""
    if kind not in _made or _made[kind][0] != sent.id:
        _made[kind] = (sent.id, kind(sent.value))
    return _made[kind][1]


class Sent:
    """A broadcast file, with an id that the executors see as well."""

    def __init__(self, spark: SparkSession, path: str):
        held = spark.sparkContext.broadcast(read_file(spark, path))
        self.id, self.held = path, held

    @property
    def value(self) -> str:
        return self.held.value


def encoding(sent: Sent, text: str, ids: str):
    """The task that adds the array of token ids to each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = made(Encoder, sent)
        for batch in batches:
            found = [encoder.encode(t) if t else b"" for t in batch.column(text).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, ids])
        T.give_back()

    return run


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the array of token ids of each whole text."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    schema = S.StructType([*docs.schema.fields, S.StructField(ids, S.ArrayType(S.IntegerType(), False))])
    return docs.mapInArrow(encoding(Sent(spark, path), text, ids), schema)


def token_chunks(lists: pa.ListArray, size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` ids (a longer row stands alone)."""
    offsets = lists.offsets.to_numpy()
    at = 0
    while at < len(lists):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(to, len(lists))
        at = to


def decoding(sent: Sent, ids: str, text: str):
    """The task that adds the text of each array of token ids to each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = made(Decoder, sent)
        for batch in batches:
            lists = batch.column(ids)
            for lo, hi in token_chunks(lists):
                part = lists[lo:hi]
                offsets = part.offsets.to_numpy()
                texts = decoder.decode(part.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0])
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in batch.columns), texts], names=[*batch.schema.names, text])
        T.give_back()

    return run


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of each array of token ids."""
    spark = rows.sparkSession
    small_arrow_batches(spark)
    schema = S.StructType([*rows.schema.fields, S.StructField(text, S.StringType())])
    return rows.mapInArrow(decoding(Sent(spark, path), ids, text), schema)


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Token ids of each whole text and the text they decode to, in place of the text itself.

    Both steps run in one worker, batch by batch: the ids don't go through the JVM in between, and a task needs no second worker."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    sent = Sent(spark, path)
    to_ids, to_text = encoding(sent, text, ids), decoding(sent, ids, decoded)
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = S.StructType([*kept, S.StructField(ids, S.ArrayType(S.IntegerType(), False)), S.StructField(decoded, S.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return to_text(batch.drop_columns([text]) for batch in to_ids(batches))

    return docs.mapInArrow(run, schema)


def joined_ids(ids: str) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(F.col(ids).cast("array<string>"), ",")
