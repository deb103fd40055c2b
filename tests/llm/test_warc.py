import gzip
import zlib

from quarrystone.llm.warc import digest_of, read_archives, record, salvage, write_archives

PAGES = [
    (1, "http://a/1", "<p>one</p>"),
    (2, "http://a/2", "<p>two</p>"),
    (3, None, "<p>one</p>"),
    (4, "http://a/ 4\r\nX: y", None),
    (5, "http://a/5", ""),
    (6, "http://a/6", "é\x00WARC/1.0\r\n\r\nContent-Length: 3\r\n\r\n\nWARC/1.1\r\nx" * 3),
    (7, "http://a/7", "long " * 200_000),
    (7, "http://a/7", "long " * 200_000),
    (None, "http://a/8", "<p>one</p>"),
]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "more", 3) for p in PAGES], "page_id long, url string, html string, path string, keeper int")
    for roll in (1, 1 << 25):
        archives = write_archives(pages, f"file://{tmp_path}/{roll}", roll_bytes=roll)
        rows = read_archives(archives).collect()
        assert len(rows) == len(PAGES) and all(r.gap is None for r in rows)
        got = sorted(((r.record_id[12:-1] if "x-page" in r.record_id else None, r.record_type, bytes(r.payload), r.headers.get("warc-refers-to")) for r in rows), key=str)
        keeper = {}
        for i, _, html in PAGES:
            keeper[html or ""] = max(keeper.get(html or "", -1), i if i is not None else -1)
        want = []
        for i, _, html in PAGES:
            again = i is not None and i < keeper[html or ""]
            want.append((str(i) if i is not None else None, "revisit" if again else "response", b"" if again else (html or "").encode(), f"<urn:x-page:{keeper[html or '']}>" if again else None))
        assert got == sorted(want, key=str)


def test_least_size_of_revisits_and_empty_table(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    archives = write_archives(pages, f"file://{tmp_path}/a", min_bytes=11)
    assert read_archives(archives).where("record_type = 'revisit'").count() == 0
    none = write_archives(pages.limit(0), f"file://{tmp_path}/b")
    assert none.count() == 0 and read_archives(none).count() == 0


def raw(i, payload=b"<p>text of a page</p>"):
    return record("response", f"<urn:x-page:{i}>", "http://a", "2024-01-01T00:00:00Z", payload, digest_of(payload), None)


def ids(data):
    return [h["warc-record-id"] for _, _, gap, h, _ in salvage(data) if not gap]


def gaps(data):
    return [(a, b) for a, b, gap, _, _ in salvage(data) if gap]


def test_salvage_of_members():
    members = [gzip.compress(raw(i) * (2 if i == 4 else 1)) for i in range(6)]
    whole = b"".join(members)
    start = sum(map(len, members[:2]))
    assert len(ids(whole)) == 7 and not gaps(whole)
    broken = bytearray(whole)
    broken[start + 30] ^= 0xFF
    assert ids(bytes(broken)) == ids(b"".join(members[:2] + members[3:]))
    assert gaps(bytes(broken)) == [(start, start + len(members[2]))]
    junk = b"".join(members[:2]) + b"\x1f\x8b\x08 noise" + b"".join(members[2:])
    assert ids(junk) == ids(whole) and gaps(junk) == [(start, start + 9)]
    short = whole[:-5]  # but the trailer's end is lost: the last record is whole, its member is a gap
    assert ids(short) == ids(whole) and gaps(short) == [(len(whole) - len(members[5]), len(short))]


def test_salvage_of_plain_records():
    parts = [raw(i) for i in range(4)]
    bad = parts[1].replace(b"text", b"tex")  # too short
    other = parts[1].replace(b"text", b"tixt")  # digest differs
    for wrong in (bad, other, b"garbage\n", parts[1].replace(b"Content-Length", b"Content-Width")):
        data = parts[0] + wrong + parts[2] + parts[3]
        assert ids(data) == ["<urn:x-page:0>", "<urn:x-page:2>", "<urn:x-page:3>"]
        assert gaps(data) == [(len(parts[0]), len(parts[0] + wrong))]
    assert list(salvage(b"")) == [] and gaps(b"nothing") == [(0, 7)]
    mixed = parts[0] + zlib.compress(b"x") + gzip.compress(parts[1]) + parts[2]
    assert ids(mixed) == [f"<urn:x-page:{i}>" for i in range(3)]


def test_salvage_inside_members():
    parts = [raw(i, f"<p>{i * 7919 % 1000003}</p>".encode() * (20 + i % 50)) for i in range(200)]
    names = [f"<urn:x-page:{i}>" for i in range(200)]
    bad = [*parts]
    bad[1] = bad[1].replace(b"<p>", b"<q>", 1)  # digest differs
    content = b"".join(bad)
    data = gzip.compress(raw(300)) + gzip.compress(content) + gzip.compress(raw(301))
    assert ids(data) == ["<urn:x-page:300>", names[0], *names[2:], "<urn:x-page:301>"]
    ((a, b, why),) = [(a, b, why) for a, b, why, _, _ in salvage(data) if why]
    first = len(gzip.compress(raw(300)))
    assert (a, b) == (first, first + len(gzip.compress(content))) and f"bytes {len(bad[0])} to {len(bad[0] + bad[1])} of" in why

    whole = gzip.compress(b"".join(parts))
    wrong_sum = bytearray(whole)
    wrong_sum[-6] ^= 0xFF
    assert ids(bytes(wrong_sum) + gzip.compress(raw(301))) == [*names, "<urn:x-page:301>"]
    assert gaps(bytes(wrong_sum) + gzip.compress(raw(301))) == [(0, len(whole))]
    assert ids(whole[:-3]) == names and gaps(whole[:-3]) == [(0, len(whole) - 3)]
    for size in (len(whole) // 4, len(whole) // 2):
        done = len(zlib.decompressobj(31).decompress(whole[:size]))
        complete = sum(len(b"".join(parts[: i + 1])) <= done for i in range(200))
        assert complete > 1 and ids(whole[:size]) == names[:complete]


def test_cut_member_of_one_record():
    one = gzip.compress(raw(1))
    assert ids(one[:-4]) == ["<urn:x-page:1>"] and gaps(one[:-4]) == [(0, len(one) - 4)]
    assert ids(one[: len(one) // 2]) == [] and gaps(one[: len(one) // 2]) == [(0, len(one) // 2)]


def test_many_broken_members_take_linear_time():
    import os
    import time

    def wrong(i):
        return gzip.compress(raw(i, os.urandom(1900)).replace(b"sha1:", b"sha1:A"), 1)

    some = [wrong(i) for i in range(20_000)]
    data = b"".join(some) + gzip.compress(raw(7))
    began = time.time()
    assert ids(data) == ["<urn:x-page:7>"] and gaps(data) == [(0, len(data) - len(gzip.compress(raw(7))))]
    lines = b"WARC/1.1\nno header\n" * 50_000
    assert ids(lines + raw(8)) == ["<urn:x-page:8>"]
    assert ids(gzip.compress(lines + raw(9))) == ["<urn:x-page:9>"]
    assert time.time() - began < 60
