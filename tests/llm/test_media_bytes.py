"""Files worked out by hand from the formats' definitions, and a second decoder that shares nothing with the first."""

from __future__ import annotations

import struct

import numpy as np

from tidelake.llm import media

#: A lossless JPEG frame of 2 x 2 samples. Huffman codes: category 0 is 0, category 1 is 10. Predictor 1, restart after two samples (a line).
#: Line 1: 128 (difference 0 from 128: 0), 129 (+1: 10, then 1): 0101, filled with ones: 0x5F. Line 2: 127 (-1: 10, then 0), 127 (0): 1000 1111: 0x8F.
FRAME = bytes.fromhex(
    "FFD8"
    "FFC4 0015 00 01010000000000000000000000000000 00 01"
    "FFC3 000B 08 0002 0002 01 01 11 00"
    "FFDD 0004 0002"
    "FFDA 0008 01 01 00 01 00 00"
    "5F FFD0 8F FFD9".replace(" ", "")
)


def riff(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def by_hand(frames: list[bytes], micros: int, from_file: bool = False) -> bytes:
    """A RIFF AVI file with an unknown chunk, a main header, the frames and an index whose offsets count from the list's kind or from the file's start."""
    header = riff(b"LIST", b"hdrl" + riff(b"avih", struct.pack("<14I", micros, *[0] * 13)))
    lead = riff(b"JUNK", b"odd") + header
    at, index, body = 12 + len(lead) + 8 if from_file else 0, b"", b"movi"
    for f in frames:
        index += b"00dc" + struct.pack("<III", 16, at + len(body), len(f))
        body += riff(b"00dc", f)
    content = b"AVI " + lead + riff(b"LIST", body) + riff(b"idx1", index)
    return b"RIFF" + struct.pack("<I", len(content)) + content


def test_frames_worked_out_by_hand():
    for from_file in (False, True):
        ((frames, payload, micros),) = media.decode_frames([by_hand([FRAME, FRAME], 50_000, from_file)])
        assert frames.tolist() == [[[128, 129], [127, 127]]] * 2 and payload == -1 and micros == 50_000


def plain_frame(data: bytes) -> list[list[int]]:
    """A lossless JPEG frame, one bit after the other, from the standard's text."""
    assert data[:2] == b"\xff\xd8" and data[-2:] == b"\xff\xd9"
    at, codes = 2, {}
    while True:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            code, k = 0, 17
            for n in range(1, 17):
                for _ in range(body[n]):
                    codes[format(code, f"0{n}b")] = body[k]
                    code, k = code + 1, k + 1
                code *= 2
        elif marker == 0xC3:
            assert body[0] == 8 and body[5] == 1
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        elif marker == 0xDD:
            assert int.from_bytes(body, "big") == width
        elif marker == 0xDA:
            assert body[3] == 1
            break
    lines = []
    for y in range(height):
        bits = ""
        while True:
            b = data[at]
            at += 1
            if b == 0xFF:
                follow = data[at]
                at += 1
                if follow:
                    assert follow == (0xD9 if y == height - 1 else 0xD0 + y % 8)
                    break
            bits += format(b, "08b")
        line, i = [], 0
        for x in range(width):
            j = i + 1
            while bits[i:j] not in codes:
                j += 1
            c = codes[bits[i:j]]
            extra = bits[j : j + c]
            i = j + c
            difference = 0 if not c else int(extra, 2) if extra[0] == "1" else int(extra, 2) - 2**c + 1
            line.append(((line[x - 1] if x else 128) + difference) % 65536)
        assert len(bits) - i < 8 and set(bits[i:]) <= {"1"}
        lines.append(line)
    return lines


def plain_file(data: bytes) -> list[bytes]:
    """The frames of an AVI file by its list of chunks; the index has to say the same."""
    assert data[:4] == b"RIFF" and int.from_bytes(data[4:8], "little") == len(data) - 8
    at, frames, index = 12, [], []
    while at < len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if name == b"LIST" and body[:4] == b"movi":
            k = 4
            while k < len(body):
                n = int.from_bytes(body[k + 4 : k + 8], "little")
                frames.append((k, body[k + 8 : k + 8 + n]))
                k += 8 + n + n % 2
        elif name == b"idx1":
            index = [struct.unpack_from("<4sIII", body, k) for k in range(0, size, 16)]
        at += 8 + size + size % 2
    assert [(x[2], x[3]) for x in index] == [(k, len(f)) for k, f in frames]
    return [f for _, f in frames]


def test_files_are_read_by_a_second_decoder():
    rng = np.random.default_rng(9)
    payloads = [bytes(64), rng.integers(0, 256, 64 * 40, dtype=np.uint8).tobytes(), ("Ünïcode text with a few lines\n" * 70).encode()[:1920], b"\xff" * 128]
    for payload, file in zip(payloads, media.encode(payloads), strict=True):
        samples = bytes(x for f in plain_file(file) for line in plain_frame(f) for x in line)
        assert samples[: len(payload)] == payload and not any(samples[len(payload) :])
