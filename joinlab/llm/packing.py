"""Packing along a space-filling curve.

1. Each text becomes a hashed vector of its byte trigrams, projected to three dimensions; its Hilbert key
   orders documents so that neighbours on the curve are alike. A hash of the id breaks ties, so a large
   group of copies can spread over partitions.
2. Rows are range-partitioned by key. The bounds are quantiles of a bounded sample (SAMPLE_ROWS at most,
   weighted by text length); they balance partitions and decide nothing else.
3. Inside a partition documents are sorted by key, tokenised and laid end to end into sequences of
   ``length`` ids, cut where a sequence is full. A partition's last, open sequence is cut into powers of
   two, so no sequence needs padding.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; null ids are
packed; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlab.llm.common import partitions, small_batches, table, whole_text

LENGTH, END_ID = 2048, 1
SAMPLE_ROWS = 50_000
DIMS, DEPTH, HASHES = 3, 10, 512

_PROJECT = np.random.default_rng(11).choice([-1.0, 1.0], (HASHES, DIMS))


def coordinates(raw: bytes) -> np.ndarray:
    """The text's place in the cube of side 2 ** DEPTH."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(DIMS, np.int64)
    h = (b[:-2] * 0x9E3779B1 ^ b[1:-1] * 0x85EBCA77 ^ b[2:] * 0xC2B2AE3D) & 0xFFFFFFFF
    v = np.sqrt(np.bincount((h >> 16) % HASHES, minlength=HASHES))
    z = (v - v.mean()) @ _PROJECT / max(float(np.linalg.norm(v - v.mean())), 1e-9)
    return np.clip((np.tanh(z) + 1) * 2 ** (DEPTH - 1), 0, 2**DEPTH - 1).astype(np.int64)


def hilbert(x: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Hilbert keys of points (rows of non-negative coordinates below 2 ** depth), after Skilling."""
    x = x.T.astype(np.int64).copy()
    n, top = len(x), 1 << (depth - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(depth - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit) & 1
    return key


def curve_keys(texts: list[bytes], ids: list) -> np.ndarray:
    points = np.array([coordinates(t) for t in texts], np.int64).reshape(-1, DIMS)
    ties = np.array([zlib.crc32(str(i).encode()) for i in ids], np.int64)
    return hilbert(points) << 32 | ties


_BYTE_CHARS = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
_BYTE_CHARS |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _BYTE_CHARS)}
_TAIL = ".,!?;:*#$%&|()"


class WordTokenizer:
    """Ids of texts under a tokenizer that drops white space: words are encoded one by one and remembered.

    The memory has two generations of bounded size. Letters with trailing punctuation, the usual word,
    are split here; everything else goes through the tokenizer's whole path."""

    def __init__(self, path: str, entries: int = 250_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.entries = self.whole.model, entries
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _letters(self, core: str) -> bytes:
        known = core.encode()
        ids = self.now.get(known) or self.before.get(known)
        if ids is None:
            text = "".join(map(_BYTE_CHARS.__getitem__, known))
            ids = np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()
        self.now[known] = ids
        return ids

    def _learn(self, word: bytes) -> bytes:
        if len(self.now) >= self.entries:
            self.before, self.now = self.now, {}
        ids = self.before.get(word)
        if ids is None:
            text = word.decode()
            core = text.rstrip(_TAIL)
            tail = text[len(core) :]
            if core.isalpha() and max(core) < "ƀ" and "İ" not in core:
                low = core.lower()
                if low == text:
                    return self._letters(low)
                ids = self._letters(low) + (self.word(tail.encode()) if tail else b"")
            else:
                ids = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self.now[word] = ids
        return ids

    def word(self, word: bytes) -> bytes:
        ids = self.now.get(word)
        return self._learn(word) if ids is None else ids

    def encode(self, raw: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        get, learn = self.now.get, self._learn
        out = []
        for w in raw.split():
            ids = get(w)
            if ids is None:
                ids = learn(w)
                get = self.now.get  # a new generation may have begun
            out.append(ids)
        return b"".join(out)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Packer:
    """Lays documents end to end; yields pieces (document, start, length, crc32, tokens, sequence, offset)."""

    def __init__(self, first_sequence: int, length: int = LENGTH):
        self.sequence, self.length, self.at = first_sequence, length, 0
        self.open: list[tuple] = []

    def add(self, doc, ids: bytes):
        total, start = len(ids) // 4, 0
        while start < total:
            n = min(total - start, self.length - self.at)
            self.open.append((doc, start, ids[4 * start : 4 * (start + n)], total, self.at))
            start, self.at = start + n, self.at + n
            if self.at == self.length:
                for d, s, part, t, off in self.open:
                    yield d, s, len(part) // 4, zlib.crc32(part), t, self.sequence, off
                self.open, self.at, self.sequence = [], 0, self.sequence + 1

    def close(self):
        """Cuts the open sequence into powers of two, the largest first."""
        room, size = 0, 0
        left = self.at
        for doc, start, part, total, _ in self.open:
            while part:
                if room == 0:
                    size = room = 1 << (left.bit_length() - 1)
                    left -= size
                n = min(room, len(part) // 4)
                yield doc, start, n, zlib.crc32(part[: 4 * n]), total, self.sequence, size - room
                start, part, room = start + n, part[4 * n :], room - n
                if room == 0:
                    self.sequence += 1
        self.open, self.at = [], 0


def on_curve(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, t, curve, part: rows range-partitioned along the curve and sorted on it."""
    spark = docs.sparkSession
    small_batches(spark)
    kind, parts = docs.schema[key].dataType.simpleString(), partitions(spark)
    rows = docs.select(F.col(key).alias("id"), whole_text(text).alias("t"))

    def keys(batches):
        for b in batches:
            k = curve_keys([v.as_py().encode() for v in b.column(1)], b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array([len(v.as_py()) + 1 for v in b.column(1)], pa.int64())], names=["curve", "n"])

    want = min(SAMPLE_ROWS, 100 * parts)
    span = 1 << 20
    share = max(1, int(span * min(1.0, want / max(rows.count(), 1))))
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(span)) < share).mapInArrow(keys, "curve long, n long").orderBy("curve").limit(2 * SAMPLE_ROWS).toPandas()
    weight = drawn.n.to_numpy().cumsum()
    cuts = np.searchsorted(weight, weight[-1] * np.arange(1, parts) / parts) if len(drawn) else np.zeros(0, int)
    bounds = np.unique(drawn.curve.to_numpy()[cuts]) if len(drawn) else np.zeros(0, np.int64)

    def place(batches):
        for b in batches:
            k = curve_keys([v.as_py().encode() for v in b.column(1)], b.column(0).to_pylist())
            p = pa.array(np.searchsorted(bounds, k, side="right").astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k), p], names=["id", "t", "curve", "part"])

    placed = rows.mapInArrow(place, f"id {kind}, t string, curve long, part int")
    return placed.repartitionById(parts, F.col("part")).sortWithinPartitions("curve", "id")


PIECES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: PIECES (the first under the name of the key). Reruns give the same pieces."""
    path = tokenizer_path or default_tokenizer()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        packer, encode = None, tokenizer(path).encode
        end = np.array([END_ID], "<u4").tobytes()
        id_type = None

        def batch(rows):
            cols = list(zip(*rows, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["key", *PIECES[1:]])

        for b in batches:
            id_type, made = b.schema.field(0).type, []
            if b.num_rows and packer is None:
                packer = Packer(b.column(3)[0].as_py() << 40, length)
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                made += packer.add(i, encode(t.as_py().encode()) + end)
            yield batch(made)
        if packer is not None:
            yield batch(list(packer.close()))

    schema = f"key {kind}, " + ", ".join(f"{n} long" for n in PIECES[1:])
    return on_curve(docs, key, text).mapInArrow(run, schema).withColumnRenamed("key", key)


def op6_pack_on_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))
