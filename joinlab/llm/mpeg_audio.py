"""Media columns for MPEG audio: frame walk with resynchronisation, tags, variable-bitrate tables,
checksums, exact durations and frame seek offsets.

``parse`` reads any byte string. ``wrap`` stores arbitrary bytes losslessly in a valid MPEG-1 Layer III
stream: silent frames (all part lengths zero) whose main-data area holds the payload, each frame with its
CRC-16, behind an ID3v2 tag with the exact sizes and a Xing frame with counts and a seek table. If the payload
puts "TAG" where an ID3v1 tag would start, an empty ID3v1 tag closes the stream, so that no reader takes payload for one.

Defined results: null and empty texts give a payload of 64 zero bytes, null media read as no bytes; very long texts are
as many frames as they take; repeated rows and equal texts (ties) give equal media and fields; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlab.llm.common import small_batches, store, table, whole_text

# Fixed values of the format: kbit/s by (MPEG-1?, layer), samples a second by version bits.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@lru_cache(4096)
def header(word: int) -> tuple[int, int, int, bool, int, int, int] | None:
    """Frame bytes, samples, sample rate, protected?, side-information bytes, layer, kbit/s; None if not a header."""
    if word >> 21 != 0x7FF:
        return None
    version, layer, rate_index, speed = (word >> 19) & 3, 4 - ((word >> 17) & 3), (word >> 12) & 15, (word >> 10) & 3
    if version == 1 or layer == 4 or rate_index in (0, 15) or speed == 3 or word & 3 == 2:
        return None
    first = version == 3
    kbit, hertz, pad = BITRATES[first, layer][rate_index], RATES[version][speed], (word >> 9) & 1
    mono = (word >> 6) & 3 == 3
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12000 * kbit // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbit // hertz + pad
    side = ((17 if mono else 32) if first else (9 if mono else 17)) if layer == 3 else 0
    return size, samples, hertz, not (word >> 16) & 1, side, layer, kbit


_CRC = []
for _i in range(256):
    _r = _i << 8
    for _ in range(8):
        _r = (_r << 1) ^ (0x8005 if _r & 0x8000 else 0)
    _CRC.append(_r & 0xFFFF)


@lru_cache(65536)
def crc16(data: bytes) -> int:
    r = 0xFFFF
    for b in data:
        r = ((r << 8) & 0xFFFF) ^ _CRC[(r >> 8) ^ b]
    return r


def crc16_bits(data: bytes, bits: int) -> int:
    """The checksum over the first so many bits."""
    r = crc16(data[: bits // 8])
    for i in range(bits % 8):
        r = ((r << 1) ^ (0x8005 if (r >> 15 ^ data[bits // 8] >> (7 - i)) & 1 else 0)) & 0xFFFF
    return r


#: Fixed values of the format: bits of an allocation by subband, as (subbands, bits) in order, for layer II.
ALLOCATIONS = {
    "a": ((3, 4), (8, 4), (12, 3), (4, 2)),
    "b": ((3, 4), (8, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "lsf": ((4, 4), (7, 3), (19, 2)),
}


def checked_bits(word: int, body: bytes) -> int:
    """Bits after the checksum that it covers in layers I and II: the allocations, and layer II's scale factor choices.
    ``body`` begins after the checksum."""
    _, _, hertz, _, _, layer, kbit = header(word)
    mode, bound = (word >> 6) & 3, ((word >> 4) & 3) * 4 + 4
    channels = 1 if mode == 3 else 2
    if layer == 1:
        widths = [4] * 32
    else:
        each = kbit // channels
        if not word >> 19 & 1:
            name = "lsf"
        elif hertz == 48000 and each >= 56 or 56 <= each <= 80:
            name = "a"
        elif hertz != 48000 and each >= 96:
            name = "b"
        else:
            name = "c" if hertz != 32000 and each <= 48 else "d"
        widths = [w for n, w in ALLOCATIONS[name] for _ in range(n)]
    fields = [(w, channels if sb < bound else 1) for sb, w in enumerate(widths)] if mode == 1 else [(w, channels) for w in widths]
    total = sum(w * n for w, n in fields)
    if layer == 2:
        all_bits, at, chosen = int.from_bytes(body[: total // 8 + 1], "big"), (total // 8 + 1) * 8, 0
        for w, n in fields:
            for _ in range(n):
                at -= w
                chosen += ((all_bits >> at) & ((1 << w) - 1) != 0) * (channels if n < channels else 1)
        total += 2 * chosen
    return total


def _synchsafe(raw: bytes) -> int:
    return sum((b & 0x7F) << s for b, s in zip(raw, (21, 14, 7, 0), strict=True))


def _tags(data: bytes) -> tuple[dict[str, str], int]:
    """Text tags of the leading ID3v2 tags (2.2 to 2.4), and the first byte after them."""
    found, at = {}, 0
    while data[at : at + 3] == b"ID3" and at + 10 <= len(data):
        major, flags = data[at + 3], data[at + 5]
        size = _synchsafe(data[at + 6 : at + 10])
        body, p = data[at + 10 : at + 10 + size], 0
        if flags & 0x80 and major < 4:
            body = body.replace(b"\xff\0", b"\xff")  # unsynchronised as a whole
        if flags & 0x40 and major > 2 and len(body) >= 4:
            p = _synchsafe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
        letters, head = (3, 6) if major == 2 else (4, 10)
        while p + head <= len(body) and body[p : p + letters].isalnum():
            raw = body[p + letters : p + 2 * letters]
            n = _synchsafe(raw) if major == 4 else int.from_bytes(raw, "big")
            name, value = body[p : p + letters].decode("latin-1"), body[p + head : p + head + n]
            if major == 4 and body[p + 9] & 2:
                value = value[4 if body[p + 9] & 1 else 0 :].replace(b"\xff\0", b"\xff")
            if name[0] == "T" and value:
                text = value[1:].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1"), "replace")
                key, _, text = text.partition("\0") if name in ("TXXX", "TXX") else (name, "", text)
                found[key] = text.rstrip("\0")
            p += head + n
        at += 10 + size + (10 if flags & 0x10 else 0)
    return found, at


def _trailer(data: bytes, at: int, tags: dict[str, str]) -> None:
    """Adds what an ID3v1 tag at this place says; ID3v2 tags win."""
    for key, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
        if text := data[at + a : at + b].rstrip(b"\0 ").decode("latin-1"):
            tags.setdefault(key, text)


def _vbr(data: bytes, at: int, side: int, protected: bool) -> dict | None:
    for p in (at + 4 + side, at + 6 + side):
        kind = data[p : p + 4]
        if kind in (b"Xing", b"Info"):
            flags, p, out = int.from_bytes(data[p + 4 : p + 8], "big"), p + 8, {"kind": kind.decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 4:
                out["toc"] = list(data[p : p + 100])
            return out
    p = at + 36
    if data[p : p + 4] == b"VBRI" and p + 26 <= len(data):
        n_bytes, frames, entries, scale, width, step = struct.unpack_from(">IIHHHH", data, p + 10)
        sizes = [int.from_bytes(data[p + 26 + i * width : p + 26 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": n_bytes, "toc": sizes, "step": step}
    return None


def parse(data: bytes) -> dict:
    """Everything the media columns hold, and the bytes of the frames' main-data areas joined.

    A header counts if the next frame, an ID3v1 tag or the end follows where its length says; otherwise the walk
    looks for the next sync word. "TAG" 128 bytes before the end is a tag only where no frame lies over it. Cut last
    frames and free-format frames (no rate in the header) are skipped and counted.
    """
    tags, at = _tags(data)
    end = len(data)
    trailer = end - 128 if end - 128 >= at and data[end - 128 : end - 125] == b"TAG" else -1
    offsets, bodies, kbits = [], [], set()
    skipped, good, bad, samples, hertz, layers, vbr = 0, 0, 0, Fraction(0), 0, set(), None
    synced = False
    while at < end:
        if at == trailer:
            _trailer(data, at, tags)
            at = end
            break
        info = header(int.from_bytes(data[at : at + 4], "big")) if at + 4 <= end else None
        nxt = at + info[0] if info else 0
        sure = info and nxt <= end and (synced or nxt + 4 > end or nxt == trailer or header(int.from_bytes(data[nxt : nxt + 4], "big")))
        if not sure:
            synced, step = False, data.find(b"\xff", at + 1, end)
            step = step if step > 0 else end
            step = trailer if at < trailer < step else step
            skipped, at = skipped + step - at, step
            continue
        size, n, rate, protected, side, layer, kbit = info
        start = at + 4 + 2 * protected + side
        if not offsets and not vbr and layer == 3 and (vbr := _vbr(data, at, side, protected)):
            at, synced = nxt, True  # a frame that only describes the rest
            continue
        if protected:
            bits = 8 * side if layer == 3 else checked_bits(int.from_bytes(data[at : at + 4], "big"), data[at + 6 : nxt])
            part = data[at + 2 : at + 4] + data[at + 6 : min(nxt, at + 7 + bits // 8)]
            right = len(part) * 8 >= 16 + bits and crc16_bits(part, 16 + bits) == int.from_bytes(data[at + 4 : at + 6], "big")
            good, bad = good + right, bad + (not right)
        offsets.append(at)
        bodies.append(data[start:nxt])
        samples += Fraction(n, rate)
        kbits.add(kbit)
        layers.add(layer)
        hertz, at, synced = rate, nxt, True
    return {
        "tags": tags, "vbr": vbr, "offsets": offsets, "body": b"".join(bodies), "duration": samples, "sample_rate": hertz,
        "crc_good": good, "crc_bad": bad, "skipped": skipped, "kbits": sorted(kbits), "layers": sorted(layers),
        "vbr_agrees": vbr is not None and vbr.get("frames") == len(offsets),
    }


_SIDE = 32
_LEAD = 4 + 2 + _SIDE
#: Frame size of a 32 kHz stereo frame at each rate index.
_SIZES = [BITRATES[True, 3][i] * 144000 // 32000 for i in range(15)]


@lru_cache(16)
def _silent(index: int) -> bytes:
    head = (0x7FF << 21 | 3 << 19 | 1 << 17 | index << 12 | 2 << 10).to_bytes(4, "big")
    return head + crc16(head[2:] + bytes(_SIDE)).to_bytes(2, "big") + bytes(_SIDE)


def _text_frame(name: str, value: object) -> bytes:
    body = b"\3" + name.encode() + b"\0" + str(value).encode()
    return b"TXXX" + bytes((len(body) >> s) & 0x7F for s in (21, 14, 7, 0)) + b"\0\0" + body


def wrap(payload: bytes, text_bytes: int) -> bytes:
    """The payload as an MPEG-1 Layer III stream; the same payload always gives the same bytes."""
    lead, room, frames, at = _silent(14), _SIZES[14] - _LEAD, [], 0
    while len(payload) - at >= room:
        frames.append(lead + payload[at : at + room])
        at += room
    if rest := payload[at:]:
        index = next(i for i in range(1, 15) if _SIZES[i] - _LEAD >= len(rest))
        frames.append(_silent(index) + rest + bytes(_SIZES[index] - _LEAD - len(rest)))
    audio = b"".join(frames)
    starts = [_SIZES[7] + min(i * _SIZES[14], len(audio)) for i in range(len(frames))]
    total = _SIZES[7] + len(audio)
    toc = bytes(min(255, starts[p * len(frames) // 100] * 256 // total) for p in range(100))
    table_ = _silent(7) + b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    table_ += bytes(_SIZES[7] - len(table_))
    tag = _text_frame("payload_bytes", len(payload)) + _text_frame("text_bytes", text_bytes)
    close = b"TAG" + bytes(125) if audio[-128:-125] == b"TAG" else b""
    return b"ID3\4\0\0" + bytes((len(tag) >> s) & 0x7F for s in (21, 14, 7, 0)) + tag + table_ + audio + close


def pad64(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def wrap_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every whole text (null: empty), padded to a positive multiple of 64 bytes, as a media column."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            media = []
            for v in b.column(1):
                raw = v.as_py().encode()
                media.append(wrap(pad64(raw), len(raw)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], names=["key", "media"])

    return docs.select(F.col(key).alias("key"), whole_text(text).alias("t")).mapInArrow(run, f"key {kind}, media binary").select(F.col("key").alias(key), "media")


FIELDS = [
    ("n_bytes", "long", pa.int64()), ("payload_bytes", "long", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "long", pa.int64()),
    ("media_bytes", "long", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string()),
    ("frames", "long", pa.int64()), ("duration_num", "long", pa.int64()), ("duration_den", "long", pa.int64()), ("sample_rate", "int", pa.int32()),
    ("crc_good", "long", pa.int64()), ("crc_bad", "long", pa.int64()), ("skipped_bytes", "long", pa.int64()), ("vbr_frames", "long", pa.int64()),
    ("seek_offsets", "array<long>", pa.list_(pa.int64())),
]


def describe(media: bytes | None) -> tuple:
    """The fields of one media value; null media read as no bytes at all."""
    media = media or b""
    p = parse(media)
    size = p["tags"].get("payload_bytes", "")
    payload = p["body"][: int(size)] if size.isdigit() else p["body"]
    text = p["tags"].get("text_bytes", "")
    d, vbr = p["duration"], p["vbr"]
    feature = f"layers={p['layers']} kbits={p['kbits']} seconds={d} frames={len(p['offsets'])} crc={p['crc_good']}/{p['crc_bad']} skipped={p['skipped']} vbr={(vbr or {}).get('kind')}:{p['vbr_agrees']}"
    return (
        int(text) if text.isdigit() else None, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]),
        len(media), hashlib.sha256(media).hexdigest(), feature,
        len(p["offsets"]), d.numerator, d.denominator, p["sample_rate"], p["crc_good"], p["crc_bad"], p["skipped"], (vbr or {}).get("frames"), p["offsets"],
    )


def media_columns(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per media value: the key and FIELDS. Nothing in the bytes makes it fail: what is not a
    frame is skipped and counted, wrong checksums are counted, an empty value has no frames."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [describe(v.as_py()) for v in b.column(1)]
            cols = [pa.array([r[i] for r in rows], t) for i, (_, _, t) in enumerate(FIELDS)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["key", *(n for n, _, _ in FIELDS)])

    schema = ", ".join([f"key {kind}", *(f"{n} {t}" for n, t, _ in FIELDS)])
    return df.select(F.col(key).alias("key"), F.col(media).alias("media")).mapInArrow(run, schema).withColumnRenamed("key", key)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every document's payload as MPEG audio in a table and describes what is read back from it."""
    small_batches(spark)
    media = store(wrap_texts(table(spark, sf_dir, "documents", "doc_id", "text")), "media")
    return media_columns(media)
