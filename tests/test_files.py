import struct

import pytest

from tidelog.sources import files


def test_wal_round_trip_and_damage(spark, tmp_path):
    rows = [("k1", 1, 1, b"v1", -1), ("k1", 2, 2, None, -1), ("é", 3, 1, b"", 50)]
    good = files.wal_bytes([rows[:2], rows[2:]])
    (tmp_path / "wal.log").write_bytes(good + b"\0\0\0\5\0")
    got = files.read_wal(spark, str(tmp_path / "wal.log")).orderBy("seq").collect()
    assert [(r["key"], r["seq"], r["vtype"], r["value"] and bytes(r["value"]) or (b"" if r["vtype"] == 1 else None), r["expire_at_ms"]) for r in got] == rows
    first = files.wal_bytes([rows[:2]])
    for bad in (b"", b"\0\0", struct.pack(">iI", 0, 0), struct.pack(">iI", 40 << 20, 0), first[:-1], first[:10] + bytes([first[10] ^ 1]) + first[11:]):
        assert files.wal_rows(bad) == []
    assert files.wal_rows(first + good[:9]) == rows[:2]


def test_sorted_table():
    entry = struct.pack(">i", 1) + b"a" + struct.pack(">qbq", 7, 1, -1) + struct.pack(">i", 2) + b"vv"
    body = struct.pack(">ii", files.TABLE_HEAD, 1) + struct.pack(">i", 1) + entry
    index = struct.pack(">i", 1) + struct.pack(">i", 1) + b"a" + struct.pack(">qq", 7, 8)
    data = body + index + files.FOOT.pack(len(body), len(index), 1, 1, files.TABLE_FOOT)
    assert files.table_rows(data) == [("a", 7, 1, b"vv", -1)]
    for bad in (data[:20], data[:-1] + b"x", b"xxxx" + data[4:]):
        with pytest.raises(ValueError):
            files.table_rows(bad)


def test_bloom_file():
    data = struct.pack(">iiiii", files.BLOOM_HEAD, 1, 64, 7, 2) + b"\x01\x80"
    assert files.bloom_bits(data) == (64, 7, 1 | 1 << 15)
    with pytest.raises(ValueError):
        files.bloom_bits(b"\0" * 24)


def test_tables_are_written_and_read(spark, tmp_path):
    rows = [(f"k{i % 70:03d}", i, 1 + (i % 9 == 0), None if i % 9 == 0 else f"v{i}".encode(), i % 3 - 1) for i in range(1, 300)] + [("\ue000", 400, 1, b"", -1), ("\U0001F600", 401, 1, b"x", -1)]
    data = files.table_bytes(rows, 16)
    want = sorted(rows, key=lambda r: (r[0].encode("utf-16-be"), -r[1]))
    assert files.table_rows(data) == want and want[-1][0] == "\ue000"  # UTF-16 order
    with pytest.raises(ValueError):
        files.table_bytes([])
    empty = struct.pack(">ii", files.TABLE_HEAD, 1) + struct.pack(">i", 0) + files.FOOT.pack(8, 4, 0, 0, files.TABLE_FOOT)
    with pytest.raises(ValueError):
        files.table_rows(empty)
    log = spark.createDataFrame([(*r, 0, r[1] // 100) for r in rows], files.LOG_DDL + ", level int, file_id long")
    names = files.write_tables(log, str(tmp_path))
    assert len(names) == 8 and "sst-0-L0.sst" in names and "sst-4-L0.sst.bf" in names
    got = [(r["key"], r["seq"], r["vtype"], None if r["value"] is None else bytes(r["value"]), r["expire_at_ms"]) for r in files.read_tables(spark, str(tmp_path / "*.sst")).collect()]
    assert sorted(got, key=files.entry_order) == [r if r[2] == 1 else (*r[:3], None, r[4]) for r in want]


def test_filter_files_agree_with_the_filter(spark):
    from tidelog.functions import bloom

    keys = [f"key{i}" for i in range(200)] + ["é", ""]
    data = files.bloom_bytes(keys)
    bits, k, held = files.bloom_bits(data)
    df = spark.createDataFrame([(x,) for x in keys], "key string")
    assert {r["bit"] for r in bloom.build(df, bits, k).collect()} == {b for b in range(bits) if held >> b & 1}
    assert all(files.might_contain(data, x) for x in keys) and sum(files.might_contain(data, f"no{i}") for i in range(1000)) < 50
    assert files.might_contain(None, "x") and files.might_contain(data[:10], "x") and files.might_contain(b"\0" * 30, "x")
