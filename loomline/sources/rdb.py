"""Reading dump files of the public RDB format (versions 8 to 12) as rows of keyspace structures.

One row per string, list element, set member, hash field or sorted-set member: ``db, key, family, expires_ms, pos, field, value,
score``; bytes stay bytes. A file is one sequential stream, so a file is one task; many files are read side by side.

Defined cases: a file that is cut, has a wrong checksum or an unknown type fails as a whole; streams hold consumer state that has no
rows here, so they fail unless they are waived, and are then passed over; an empty dump gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "db int, key binary, family string, expires_ms bigint, pos bigint, field binary, value binary, score double"
# Operation codes of the format, and the polynomial of its checksum (reflected).
EOF, SELECT, RESIZE, AUX, EXPIRE_S, EXPIRE_MS, IDLE, FREQUENCY = 0xFF, 0xFE, 0xFB, 0xFA, 0xFD, 0xFC, 0xF8, 0xF9
POLYNOMIAL = 0x95AC9329AC4BC9B5
# Value types, by family and by how their elements are written.
TYPES = {
    0: ("string", "plain"), 1: ("list", "plain"), 2: ("set", "plain"), 3: ("zset", "text scores"), 4: ("hash", "plain"), 5: ("zset", "plain"), 10: ("list", "ziplist"), 11: ("set", "intset"), 12: ("zset", "ziplist"),
    13: ("hash", "ziplist"), 14: ("list", "quicklist of ziplists"), 15: ("stream", 1), 16: ("hash", "listpack"), 17: ("zset", "listpack"), 18: ("list", "quicklist"), 19: ("stream", 2), 20: ("set", "listpack"), 21: ("stream", 3),
}


class RdbError(ValueError):
    pass


def _table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (POLYNOMIAL if i & 1 else 0)
        out.append(i)
    return out


_CRC = _table()


def crc64(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = _CRC[(crc ^ b) & 0xFF] ^ (crc >> 8)
    return crc


def unpack_lzf(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        control = data[i]
        i += 1
        if control < 32:
            out += data[i : i + control + 1]
            i += control + 1
            continue
        n = control >> 5
        if n == 7:
            n += data[i]
            i += 1
        start = len(out) - ((control & 31) << 8) - data[i] - 1
        i += 1
        if start < 0:
            raise RdbError("a reference before the start")
        for at in range(start, start + n + 2):  # it may overlap what it writes
            out.append(out[at])
    if len(out) != size:
        raise RdbError("a compressed text of another size")
    return bytes(out)


def listpack(data: bytes) -> list[bytes]:
    """Elements behind a header of 6 bytes; each is followed by its own length, written backwards."""
    out, i = [], 6
    while data[i] != 0xFF:
        head, start = data[i], i
        if head < 0x80:
            item, i = str(head).encode(), i + 1
        elif head < 0xC0:
            item, i = data[i + 1 : i + 1 + (head & 63)], i + 1 + (head & 63)
        elif head < 0xE0:
            n = (head & 31) << 8 | data[i + 1]
            item, i = str(n - (1 << 13 if n >> 12 else 0)).encode(), i + 2
        elif head < 0xF0:
            n = (head & 15) << 8 | data[i + 1]
            item, i = data[i + 2 : i + 2 + n], i + 2 + n
        elif head == 0xF0:
            n = int.from_bytes(data[i + 1 : i + 5], "little")
            item, i = data[i + 5 : i + 5 + n], i + 5 + n
        elif head <= 0xF4:
            width = (2, 3, 4, 8)[head - 0xF1]
            item, i = str(int.from_bytes(data[i + 1 : i + 1 + width], "little", signed=True)).encode(), i + 1 + width
        else:
            raise RdbError("an unknown element of a list pack")
        out.append(item)
        size = i - start
        i += next(n for n in range(1, 6) if size < 1 << (7 * n))
    return out


def ziplist(data: bytes) -> list[bytes]:
    """Elements behind a header of 10 bytes; each begins with the length of the one before."""
    out, i = [], 10
    while data[i] != 0xFF:
        i += 5 if data[i] == 0xFE else 1
        head = data[i]
        if head >> 6 == 0:
            n, i = head & 63, i + 1
        elif head >> 6 == 1:
            n, i = (head & 63) << 8 | data[i + 1], i + 2
        elif head >> 6 == 2:
            n, i = int.from_bytes(data[i + 1 : i + 5], "big"), i + 5
        else:
            width = {0xC0: 2, 0xD0: 4, 0xE0: 8, 0xF0: 3, 0xFE: 1}.get(head, 0)
            if not width and not 0xF1 <= head <= 0xFD:
                raise RdbError("an unknown element of a zip list")
            number = int.from_bytes(data[i + 1 : i + 1 + width], "little", signed=True) if width else (head & 15) - 1
            out.append(str(number).encode())
            i += 1 + width
            continue
        out.append(data[i : i + n])
        i += n
    return out


def intset(data: bytes) -> list[bytes]:
    width, n = struct.unpack_from("<II", data)
    return [str(int.from_bytes(data[8 + i * width : 8 + (i + 1) * width], "little", signed=True)).encode() for i in range(n)]


PACKED = {"listpack": listpack, "ziplist": ziplist, "intset": intset}


class Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise RdbError("the file is cut")
        self.at += n
        return self.data[self.at - n : self.at]

    def length(self) -> tuple[int, bool]:
        """A length, or with True the kind of a special text."""
        head = self.take(1)[0]
        if head >> 6 == 0:
            return head & 63, False
        if head >> 6 == 1:
            return (head & 63) << 8 | self.take(1)[0], False
        if head >> 6 == 3:
            return head & 63, True
        if head not in (0x80, 0x81):
            raise RdbError("an unknown length")
        return int.from_bytes(self.take(8 if head & 1 else 4), "big"), False

    def count(self) -> int:
        n, special = self.length()
        if special:
            raise RdbError("a text where a length is due")
        return n

    def text(self) -> bytes:
        n, special = self.length()
        if not special:
            return self.take(n)
        if n < 3:
            return str(int.from_bytes(self.take(1 << n), "little", signed=True)).encode()
        if n > 3:
            raise RdbError("an unknown text")
        packed, size = self.count(), self.count()
        return unpack_lzf(self.take(packed), size)

    def score(self, text: bool) -> float:
        if not text:
            return struct.unpack("<d", self.take(8))[0]
        n = self.take(1)[0]
        return {253: float("nan"), 254: float("inf"), 255: float("-inf")}[n] if n > 252 else float(self.take(n))

    def stream(self, version: int) -> None:
        """Passes over a stream: entries, last ids, and groups with their pending entries and consumers."""
        for _ in range(self.count()):
            self.text()
            self.text()
        for _ in range(3 if version == 1 else 8):
            self.count()
        for _ in range(self.count()):
            self.text()
            for _ in range(2 if version == 1 else 3):
                self.count()
            for _ in range(self.count()):
                self.take(16 + 8)
                self.count()
            for _ in range(self.count()):
                self.text()
                self.take(8 if version < 3 else 16)
                self.take(16 * self.count())

    def elements(self, family: str, form: str) -> list[tuple[bytes | None, bytes | None, float | None]]:
        """``(field, value, score)`` of every element of a structure."""
        if family == "string":
            return [(None, self.text(), None)]
        if form.startswith("quicklist"):
            items = []
            for _ in range(self.count()):
                plain = form == "quicklist" and self.count() == 1
                node = self.text()
                items += [node] if plain else listpack(node) if form == "quicklist" else ziplist(node)
        elif form in PACKED:
            items = PACKED[form](self.text())
        elif family == "zset":
            return [(self.text(), None, self.score(form == "text scores")) for _ in range(self.count())]
        else:
            items = [self.text() for _ in range(self.count() * (2 if family == "hash" else 1))]
        if family in ("list", "set"):
            return [(None, item, None) for item in items]
        if len(items) % 2:
            raise RdbError("a field without a value")
        both = zip(items[::2], items[1::2])
        return [(f, v, None) for f, v in both] if family == "hash" else [(m, None, float(s)) for m, s in both]


def parse(data: bytes, waived: tuple[str, ...] = (), verify: bool = True) -> Iterator[tuple]:
    """Rows of one dump, as in ``SCHEMA``."""
    if data[:5] != b"REDIS" or not data[5:9].isdigit() or not 8 <= int(data[5:9]) <= 12:
        raise RdbError("no dump of versions 8 to 12")
    r, db, expires = Reader(data), 0, None
    r.at = 9
    while True:
        op = r.take(1)[0]
        if op == EOF:
            break
        if op == SELECT:
            db = r.count()
        elif op == RESIZE:
            r.count(), r.count()
        elif op == AUX:
            r.text(), r.text()
        elif op == EXPIRE_S:
            expires = 1000 * int.from_bytes(r.take(4), "little")
        elif op == EXPIRE_MS:
            expires = int.from_bytes(r.take(8), "little", signed=True)
        elif op == IDLE:
            r.count()
        elif op == FREQUENCY:
            r.take(1)
        elif op not in TYPES:
            raise RdbError(f"type {op}")
        else:
            family, form = TYPES[op]
            key = r.text()
            if family == "stream":
                if family not in waived:
                    raise RdbError("a stream, which is not waived")
                r.stream(form)
            else:
                for pos, (field, value, score) in enumerate(r.elements(family, form)):
                    if score is not None and score != score:
                        raise RdbError("a score that is no number")
                    yield db, key, family, expires, pos, field, value, score
            expires = None
    end, sum_ = r.at, int.from_bytes(r.take(8), "little")
    if verify and sum_ and crc64(data[:end]) != sum_:
        raise RdbError("a wrong checksum")


def read_rdb(spark: SparkSession, path: str, waived: tuple[str, ...] = (), verify: bool = True) -> DataFrame:
    """The rows of all dumps at ``path``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for frame in frames:
            for data in frame["content"]:
                rows = list(parse(bytes(data), waived, verify))
                for i in range(0, len(rows), 50_000):
                    yield pd.DataFrame(rows[i : i + 50_000], columns=names).astype({"expires_ms": "Int64", "db": "int32"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)
