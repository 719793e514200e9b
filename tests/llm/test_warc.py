import gzip
import hashlib
import io

import pytest

from hedgerow.llm import warc
from hedgerow.llm.shared import new_folder
from hedgerow.llm.warc import Warc, members, record

SCHEMA = "page_id long, url string, html string, record_type int"


def pages():
    same, trap = "s" * 150, "\x1f\x08" + "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n" * 30
    rows = [(k, f"http://a/{k}", same, 1) for k in range(5, 30)]
    return rows + [(1, "http://b c\r\nX: y", "é" * 49, 1), (2, None, "é" * 49, 1), (3, "u", None, 1), (4, "u", "", 1), (40, "v", trap, 1),
                   (41, "v", "é" * 50, 1), (42, "v", "é" * 50, 1), (None, "n", "lost", 1), (43, "w", "x" * 300_000, 1)]


@pytest.mark.parametrize("how", [Warc(), Warc(split=64, read=50, file=500), Warc(split=1000, read=100)])
def test_round_trip(spark, how):
    rows = [r for r in pages() if r[0] is not None]
    made = warc.round_trip(spark.createDataFrame(pages(), SCHEMA), how).collect()
    assert sorted(r.page_id for r in made) == sorted(r[0] for r in rows)
    first = {}
    for i, _, h, _ in sorted(rows):
        first.setdefault(h or "", i)
    by = {r.page_id: r for r in made}
    for i, url, h, _ in rows:
        body, r = (h or "").encode(), by[i]
        again = len(body) >= 100 and first[h or ""] < i
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first[h]) if again else ("response", None))
        assert r.payload is None if again else bytes(r.payload) == body
    assert by[1].url == "http://b%20c%0D%0AX:%20y"


def test_archives_are_plain_gzip(spark):
    folder = new_folder(spark, "warc")
    made = warc.write(spark.createDataFrame(pages()[:3], SCHEMA), folder).collect()
    assert all(path.startswith(folder) for path, _ in made)
    text = b"".join(gzip.open(p.removeprefix("file://")).read() for p, _ in made)
    assert text.count(b"WARC/1.1\r\n") == 3 and text.count(b"WARC-Type: revisit") == 2


def test_magic_inside_a_member_is_no_record():
    inner = record(7, "u", b"inner", hashlib.sha256(b"inner").hexdigest(), None)
    noise = b"\x1f\x8b\x08" + bytes(range(200))
    data = inner + record(8, "u", noise * 3, hashlib.sha256(noise * 3).hexdigest(), None) + inner
    every = [at for at, _, _ in members(io.BytesIO(data), 0, len(data), Warc(read=37))]
    assert len(every) == 3
    for size in (1, 13, 100):
        cut = [at for lo in range(0, len(data), size) for at, _, _ in members(io.BytesIO(data), lo, min(len(data), lo + size), Warc(read=37))]
        assert cut == every


def test_damage_is_an_error():
    whole = record(1, "u", b"x" * 9000, "d", None)
    with pytest.raises(ValueError):
        list(members(io.BytesIO(whole[:-9]), 0, len(whole), Warc()))


def test_no_rows(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("how", [Warc(), Warc(split=500, read=100)])
def test_long_urls_are_read(spark, how):
    noise = "".join(hashlib.sha256(str(k).encode()).hexdigest() for k in range(5000))  # 320 KB that hardly shrink
    rows = [(1, "http://a/1", "one", 1), (2, "data:" + "x" * 100_000, "two", 1), (3, noise, "three", 1), (4, " " * 100_000, "four", 1), (5, "u", "five", 1)]
    got = warc.round_trip(spark.createDataFrame(rows, SCHEMA).coalesce(1), how).collect()
    assert {(r.page_id, r.url.replace("%20", " "), bytes(r.payload).decode()) for r in got} == {r[:3] for r in rows} and len(got) == 5


def test_bytes_that_are_no_record_are_an_error():
    one = record(1, "u", b"one", hashlib.sha256(b"one").hexdigest(), None)
    other = gzip.compress(b"no record at all")
    for data in (one + other + one, one + b"plain" + one, other + one):
        for size in (len(data), len(one)):
            with pytest.raises(ValueError):
                [list(members(io.BytesIO(data), lo, min(len(data), lo + size), Warc())) for lo in range(0, len(data), size)]
