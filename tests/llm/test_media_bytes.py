"""MPEG audio that ``wrap`` did not write: tags, variable-bitrate tables, checksums of all layers, trailers."""

import struct

import pytest

from joinlab.llm import mpeg_audio as M


def plain_crc(bits):
    r = 0xFFFF
    for b in bits:
        r = ((r << 1) ^ (0x8005 if (r >> 15) ^ b else 0)) & 0xFFFF
    return r


def to_bits(data):
    return [x >> (7 - i) & 1 for x in data for i in range(8)]


def frame(layer, rate_index, mode=3, extension=0, allocations=None, version=3, protected=True, fill=0x55):
    """A frame whose checksum is computed bit by bit, and the bits that it covers."""
    word = 0x7FF << 21 | version << 19 | (4 - layer) << 17 | (not protected) << 16 | rate_index << 12 | mode << 6 | extension << 4
    size = M.header(word)[0]
    body = bytearray([fill]) * (size - 6)
    bits = allocations or []
    for i, b in enumerate(bits):
        body[i // 8] = body[i // 8] & ~(128 >> i % 8) | (128 >> i % 8) * b
    head = word.to_bytes(4, "big")
    crc = plain_crc(to_bits(head[2:]) + to_bits(body)[: len(bits)])
    return head + crc.to_bytes(2, "big") + bytes(body)


@pytest.mark.parametrize("mode, extension, n", [(3, 0, 128), (0, 0, 256), (1, 0, 144), (1, 2, 176)])
def test_layer_one_checksum(mode, extension, n):
    good = frame(1, 9, mode, extension, [i * 7 % 3 % 2 for i in range(n)])
    flipped = bytearray(good)
    flipped[6 + n // 8 - 1] ^= 1
    outside = bytearray(good)
    outside[6 + n // 8] ^= 1
    for data, want in ((good, (3, 0)), (bytes(flipped), (0, 3)), (bytes(outside), (3, 0))):
        p = M.parse(data * 3)
        assert (p["crc_good"], p["crc_bad"]) == want and p["layers"] == [1]


def test_layer_two_checksum():
    # 192 kbit/s mono at 44.1 kHz: 30 subbands; every second one has an allocation and so a scale factor choice.
    widths = [4] * 11 + [3] * 12 + [2] * 7
    allocation = [b for sb, w in enumerate(widths) for b in ([1] + [0] * (w - 1) if sb % 2 else [0] * w)]
    good = frame(2, 10, 3, 0, allocation + [1, 0] * 15)
    flipped = bytearray(good)
    at = len(allocation) + 29
    flipped[6 + at // 8] ^= 128 >> at % 8
    assert M.parse(good * 3)["crc_good"] == 3 and M.parse(bytes(flipped) * 3)["crc_bad"] == 3


def tagged(major, flags, frames):
    return b"ID3" + bytes([major, 0, flags]) + bytes((len(frames) >> s) & 0x7F for s in (21, 14, 7, 0)) + frames


def test_id3_versions():
    audio = M.wrap(b"x" * 500, 500)
    audio = audio[10 + sum((b & 0x7F) << s for b, s in zip(audio[6:10], (21, 14, 7, 0))) :]
    two = b"TT2\0\0\6\0title" + b"TXX\0\0\6\0a\0b c"
    three = b"TIT2\0\0\0\6\0\0\0title"
    unsynchronised = b"TIT2\0\0\0\6\0\0\0t\xff\0t\xe0\xe1"  # six bytes once FF 00 is FF
    extended = b"\0\0\0\6" + bytes(6) + three
    for data, want in ((tagged(2, 0, two), {"TT2": "title", "a": "b c"}), (tagged(3, 0, three), {"TIT2": "title"}), (tagged(3, 0x80, unsynchronised), {"TIT2": "t\xfft\xe0\xe1"}), (tagged(3, 0x40, extended), {"TIT2": "title"})):
        p = M.parse(data + audio)
        assert p["tags"] == want and p["skipped"] == 0 and p["offsets"], data


def test_trailer_and_frames():
    whole = M.wrap(b"p" * 4000, 4000)
    old = b"TAG" + b"song".ljust(30, b"\0") + b"singer".ljust(30, b"\0") + bytes(65)
    assert len(old) == 128
    base = M.parse(whole)
    for data, skipped in ((whole + old, 0), (whole + b"junk" + old, 4), (whole + b"\xff\xfbjunk" * 3 + old, 18)):
        p = M.parse(data)
        assert p["offsets"] == base["offsets"] and p["tags"]["TIT2"] == "song" and p["tags"]["TPE1"] == "singer" and p["skipped"] == skipped
    frames = frame(1, 9, 3, 0, [0] * 128) * 4
    inside = bytearray(frames)
    inside[-128:-125] = b"TAG"
    p = M.parse(bytes(inside))
    assert len(p["offsets"]) == 4 and p["skipped"] == 0 and not p["tags"]


def test_vbri():
    plain = M.wrap(b"q" * 9000, 9000)
    p = M.parse(plain)
    first = bytearray(plain[p["offsets"][0] : p["offsets"][1]])
    sizes = [b - a for a, b in zip(p["offsets"], [*p["offsets"][1:], len(plain)])]
    first[36:62] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, sum(sizes), len(sizes), len(sizes), 1, 2, 1)
    first[62 : 62 + 2 * len(sizes)] = b"".join(struct.pack(">H", s) for s in sizes)
    got = M.parse(bytes(first) + plain[p["offsets"][0] :])
    assert got["vbr"] == {"kind": "VBRI", "frames": len(sizes), "bytes": sum(sizes), "toc": sizes, "step": 1} and got["vbr_agrees"] and len(got["offsets"]) == len(sizes)


def test_free_format_is_counted():
    data = bytearray(frame(1, 9, 3, 0, [0] * 128) * 2)
    data[2] &= 0x0F
    p = M.parse(bytes(data))
    assert len(p["offsets"]) == 1 and p["skipped"] > 0
