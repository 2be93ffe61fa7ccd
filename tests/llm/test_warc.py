import gzip
import hashlib
import io
import random

from pyspark.sql import functions as F

from strataflow.llm import warc
from tests.llm.util import frame


def archive(n=40, plain=False):
    r = random.Random(3)
    parts = []
    for i in range(n):
        payload = bytes(r.choice(b"abc <>\n") for _ in range(r.choice([0, 10, 3000])))
        record = warc.serialise(i, f"http://x/{i}", payload, None, False)
        parts.append(record if plain else warc.member(record))
    return parts


def salvage(data):
    found = list(warc.salvage(io.BytesIO(data)))
    return [x["page_id"] for k, x in found if k == "record"], [(x["offset"], x["length"]) for k, x in found if k == "gap"]


def test_whole_archives():
    for plain in (False, True):
        assert salvage(b"".join(archive(plain=plain))) == (list(range(40)), [])
    assert salvage(b"") == ([], [])


def test_damage_costs_only_the_damaged_member():
    for plain in (False, True):
        parts = archive(plain=plain)
        starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
        for i in (0, 7, 39):
            bad = bytearray(parts[i])
            bad[len(bad) // 2] ^= 0xFF
            ids, gaps = salvage(b"".join([*parts[:i], bytes(bad), *parts[i + 1 :]]))
            assert ids == [x for x in range(40) if x != i]
            assert gaps == [(starts[i], len(parts[i]))]


def test_cut_missing_and_foreign_bytes():
    parts = archive()
    data = b"".join(parts)
    ids, gaps = salvage(data[:-3])
    # The record is whole by its own digests; that the member's end is missing is logged.
    assert ids == list(range(40)) and gaps == [(len(data) - len(parts[-1]), len(parts[-1]) - 3)]
    ids, gaps = salvage(data[:-40])
    assert ids == list(range(39)) and gaps[0][0] == len(data) - len(parts[-1])
    ids, gaps = salvage(parts[0] + b"junk \x1f\x8b\x08 more junk" + b"".join(parts[1:]))
    assert ids == list(range(40)) and gaps == [(len(parts[0]), len(b"junk \x1f\x8b\x08 more junk"))]
    ids, gaps = salvage(b"x" * 3_000_000 + b"".join(parts))
    assert ids == list(range(40)) and gaps == [(0, 3_000_000)]


def test_round_trip_with_revisits(spark):
    same, long = "é" * 600, "y" * 3_000_000
    rows = [(1, "u1", same), (2, "u2", same), (3, None, None), (4, "u4", "z" * 999), (5, "u5", "z" * 999), (6, "a\nb", long), (7, "u7", ""), (2, "u2", same), (None, "n", same)]
    pages = frame(spark, rows, "page_id bigint, url string, html string").withColumn("payload", F.lit(1))
    got = warc.query(spark, pages).collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        by.setdefault(x.page_id, []).append(x)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    assert all(x.payload_digest == sha(dict((a, c) for a, _, c in rows)[x.page_id]) for x in got)
    assert [x.payload_bytes for x in by[1]] == [1200] and by[6][0].payload_bytes == 3_000_000 and by[3][0].payload_bytes == 0
    assert {k: sorted((x.record_type, x.refers_to) for x in v) for k, v in by.items() if k != 2} == {1: [("revisit", 2)], 3: [("response", None)], 4: [("response", None)], 5: [("response", None)], 6: [("response", None)], 7: [("response", None)], None: [("revisit", 2)]}
    assert [x.record_type for x in by[2]] == ["response"] * 2


def test_empty_table(spark):
    assert warc.query(spark, frame(spark, [], "page_id bigint, url string, html string")).collect() == []


def test_reading_damaged_files_logs_gaps(spark, tmp_path):
    data = bytearray(b"".join(archive()))
    data[len(data) // 2] ^= 0xFF
    (tmp_path / "a.warc.gz").write_bytes(data)
    found = warc.read(frame(spark, [(str(tmp_path / "a.warc.gz"),)], "archive string"))
    assert warc.records(found).count() == 39
    assert warc.gaps(found).count() == 1


def test_other_readers_can_read_ours():
    assert gzip.decompress(b"".join(archive())).count(b"WARC/1.1") == 40


def test_damage_inside_a_member_of_several_records():
    records = [warc.serialise(i, f"http://x/{i}", random.Random(i).randbytes(5000), None, False) for i in range(6)]
    whole = warc.member(b"".join(records))
    before, after = warc.member(warc.serialise(100, "a", b"", None, False)), warc.member(warc.serialise(101, "b", b"", None, False))
    bad = bytearray(b"".join(records))
    bad[sum(map(len, records[:3])) + 3000] ^= 0xFF  # a block that fails its digest in a member that is whole
    ids, gaps = salvage(before + warc.member(bytes(bad)) + after)
    assert ids == [100, 0, 1, 2, 4, 5, 101] and gaps == [(len(before), len(warc.member(bytes(bad))))]
    torn = bytearray(whole)
    torn[len(torn) * 3 // 4] ^= 0xFF  # a member that cannot be inflated to its end, or fails its CRC
    ids, gaps = salvage(before + bytes(torn) + after)
    assert ids[:4] == [100, 0, 1, 2] and ids[-1] == 101 and gaps == [(len(before), len(whole))]
    ids, gaps = salvage(before + whole[: len(whole) // 2])
    assert ids[:3] == [100, 0, 1] and gaps == [(len(before), len(whole) // 2)]


def test_a_false_length_does_not_read_on(spark):
    bad = warc.serialise(1, "u", b"x" * 100, None, False).replace(b"Content-Length: 1", b"Content-Length: 999999999991", 1)
    good = warc.serialise(2, "u", b"y" * 100, None, False)
    data = bad + good
    for size in (None, len(data)):
        found = list(warc.salvage(io.BytesIO(data), size))
        assert [x["page_id"] for k, x in found if k == "record"] == [2]


def test_records_of_any_size():
    payload = bytes(300 << 20)
    found = list(warc.salvage(io.BytesIO(warc.member(warc.serialise(1, "u", payload, None, False), 1))))
    assert [k for k, _ in found] == ["record"] and found[0][1]["payload_bytes"] == len(payload)
