"""Small PNG files made with the standard library."""

import struct
import zlib


def png(path, pixel, width=96, height=72):
    raw = b"".join(b"\x00" + b"".join(bytes(pixel(x, y)) for x in range(width)) for y in range(height))

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def cluster_pixel(cluster, variant):
    def warm(x, y):
        return min(255, 150 + x + variant), 60 + y % 60, 20

    def cool(x, y):
        return 20, 60 + y % 60, min(255, 140 + x + variant)

    def board(x, y):
        return (20, 200 - variant, 40) if (x // 12 + y // 12) % 2 else (10, 60, 15 + variant)

    def grey(x, y):
        v = (x * 3 + y * 5 + variant * 2) % 200
        return v, v, v

    return [warm, cool, board, grey][cluster]
