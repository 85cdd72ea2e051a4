import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.sources import rdb


def size(n):
    return bytes([n]) if n < 64 else struct.pack(">H", n | 0x4000) if n < 1 << 14 else b"\x80" + struct.pack(">I", n)


def text(b):
    return size(len(b)) + b


def pack(items):
    """A list pack; numbers as numbers."""
    out = b""
    for x in items:
        if isinstance(x, int) and 0 <= x < 128:
            e = bytes([x])
        elif isinstance(x, int) and -4096 <= x < 4096:
            e = struct.pack(">H", 0xC000 | x & 0x1FFF)
        elif isinstance(x, int):
            e = b"\xf4" + struct.pack("<q", x)
        else:
            e = bytes([0x80 | len(x)]) + x if len(x) < 64 else struct.pack(">H", 0xE000 | len(x)) + x
        n = len(e)
        out += e + (bytes([n]) if n < 128 else bytes([n >> 7, n & 127 | 128]))
    return struct.pack("<IH", len(out) + 7, len(items)) + out + b"\xff"


def zip_list(items):
    out, before = b"", 0
    for x in items:
        head = b"\xfe" + struct.pack("<b", x) if isinstance(x, int) and not 0 <= x <= 12 else bytes([0xF1 + x]) if isinstance(x, int) else bytes([len(x)]) + x
        e = bytes([before]) + head
        out, before = out + e, len(e)
    return struct.pack("<IIH", len(out) + 11, 0, len(items)) + out + b"\xff"


def dump(*parts, version=b"0011"):
    body = b"REDIS" + version + b"\xfa" + text(b"made") + text(b"by hand") + b"\xfe\x00\xfb\x07\x01" + b"".join(parts) + b"\xff"
    return body + struct.pack("<Q", rdb.crc64(body))


def rows(data, **more):
    return [r[1:] for r in rdb.parse(data, **more)]


def test_every_family():
    stream = b"\x15" + text(b"log") + size(1) + text(b"x" * 16) + text(pack([1, b"a"])) + b"\x01" * 8 + size(1) + text(b"g") + b"\x01\x02\x03" + size(1) + b"\x00" * 24 + b"\x01" + size(1) + text(b"c") + b"\x00" * 16 + size(1) + b"\x00" * 16
    data = dump(
        b"\x00" + text(b"s") + text(b"plain"), b"\xfc" + struct.pack("<q", 1234) + b"\x00" + text(b"n") + b"\xc1" + struct.pack("<h", -300), b"\x00" + text(b"z") + b"\xc3" + size(6) + size(8) + b"\x02abc\x60\x02",
        b"\x04" + text(b"h") + size(1) + text(b"f") + text(b"v"), b"\x10" + text(b"hp") + text(pack([b"f", -7, b"long" * 40, 99999])), b"\x12" + text(b"q") + size(2) + size(2) + text(pack([b"a", 5])) + size(1) + text(b"big"),
        b"\x0e" + text(b"qz") + size(1) + text(zip_list([b"a", 5, -100])), b"\x0b" + text(b"i") + text(struct.pack("<IIhhh", 2, 3, -1, 0, 300)), b"\x05" + text(b"zs") + size(1) + text(b"m") + struct.pack("<d", 2.5),
        b"\x03" + text(b"zt") + size(2) + text(b"m") + b"\x03-.5" + text(b"x") + b"\xfe", b"\x11" + text(b"zp") + text(pack([b"m", 3])), b"\x02" + text(b"e") + size(1) + text(b"one"), stream,
    )
    with pytest.raises(rdb.RdbError, match="waived"):
        rows(data)
    assert rows(data, waived=("stream",)) == [
        (b"s", "string", None, 0, None, b"plain", None), (b"n", "string", 1234, 0, None, b"-300", None), (b"z", "string", None, 0, None, b"abcabcab", None)[:5] + (b"abcabcab", None),
        (b"h", "hash", None, 0, b"f", b"v", None), (b"hp", "hash", None, 0, b"f", b"-7", None), (b"hp", "hash", None, 1, b"long" * 40, b"99999", None), (b"q", "list", None, 0, None, b"a", None), (b"q", "list", None, 1, None, b"5", None), (b"q", "list", None, 2, None, b"big", None),
        (b"qz", "list", None, 0, None, b"a", None), (b"qz", "list", None, 1, None, b"5", None), (b"qz", "list", None, 2, None, b"-100", None), (b"i", "set", None, 0, None, b"-1", None), (b"i", "set", None, 1, None, b"0", None), (b"i", "set", None, 2, None, b"300", None),
        (b"zs", "zset", None, 0, b"m", None, 2.5), (b"zt", "zset", None, 0, b"m", None, -0.5), (b"zt", "zset", None, 1, b"x", None, float("inf")), (b"zp", "zset", None, 0, b"m", None, 3.0), (b"e", "set", None, 0, None, b"one", None),
    ]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=300), st.integers(-(2**63), 2**63 - 1)), max_size=30))
def test_list_packs(items):
    assert rdb.listpack(pack(items)) == [str(x).encode() if isinstance(x, int) else x for x in items]


def test_refusals():
    good = dump(b"\x00" + text(b"s") + text(b"x"))
    assert rdb.crc64(b"123456789") == 0xE9C6D914C4B8D9CA  # the published check value
    for bad in (good[:-9], b"RADIS0011", dump(version=b"0007"), good[:-1] + b"\x99", dump(b"\x06" + text(b"m")), dump(b"\x05" + text(b"z") + size(1) + text(b"m") + struct.pack("<d", float("nan")))):
        with pytest.raises(rdb.RdbError):
            rows(bad)
    assert rows(dump()) == []


def test_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.rdb").write_bytes(dump(b"\x00" + text(b"k%d" % i) + text(b"\xff\x00"), b"\xfd" + struct.pack("<I", 7) + b"\x01" + text(b"l") + size(2) + text(b"a") + text(b"b")))
    got = rdb.read_rdb(spark, str(tmp_path)).collect()
    assert len(got) == 9 and {bytes(r["value"]) for r in got if r["family"] == "string"} == {b"\xff\x00"} and {r["expires_ms"] for r in got} == {None, 7000}
