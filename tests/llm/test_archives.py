import base64
import hashlib
import struct
from collections import Counter

import pytest
import zstandard

from marginalia.llm import archives, common
from marginalia.llm.archives import read_archives, record_at, write_archives

SCHEMA = "page_id long, url string, html string, size long, same string, sha1 string, path string"


def plain(rows, least_bytes=0):
    groups = {}
    for page_id, _, html in rows:
        groups.setdefault(html or "", []).append(page_id)
    out = []
    for html, ids in groups.items():
        raw = html.encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        ids = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        for k, own in enumerate(ids):
            revisit = k > 0 and len(raw) >= least_bytes
            out.append((own, len(raw), digest, "revisit" if revisit else "response", ids[0] if revisit else None))
    return Counter(out)


ROWS = [
    (1, "http://a.example/1", "<html>one</html>"), (2, None, "<html>one</html>"), (3, "http://a.example/ 3\r\nX: y", "<html>one</html>"), (4, "u", None), (5, "u", ""),
    (6, "u", "été 日本語 \u0000\r\n\r\nWARC/1.1 \U0001f600"), (None, "u", "<html>one</html>"), (None, "u", "alone"), (7, "u", "same id"), (7, "v", "same id"), (7, "v", "same id"), (8, "u", "x" * 3_000_000),
    *[(100 + i, f"http://b.example/{i}", f"<html><head><title>Page {i}</title></head><body><p>This is the text of page {i % 40}.</p></body></html>") for i in range(300)],
    *[(500 + i, "u", "copied " * 20) for i in range(200)],
]


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, "s", "h", "p") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("least_bytes", [0, 10, 1 << 30])
def test_round_trip(spark, pages, least_bytes):
    folder = common.new_folder(spark, "archives")
    files = write_archives(pages(ROWS), folder, least_bytes, file_bytes=20_000)
    found = read_archives(files, folder, payloads=True).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == plain(ROWS, least_bytes)
    texts = Counter(html or "" for _, _, html in ROWS)
    kept = Counter(r.html for r in found if r.record_type == "response")
    assert set(kept) == set(texts) and all(r.html is None for r in found if r.record_type == "revisit")
    assert sum(f.n_records for f in files.collect()) == len(ROWS) and files.count() > 3


def test_shuffled_groups_and_hot_ones_give_the_same_rows(spark, pages, monkeypatch):
    looked_up = common.looked_up
    monkeypatch.setattr(common, "looked_up", lambda rows, known, keys, how: looked_up(rows, known, keys, how, most=2, least_hot=100))
    folder = common.new_folder(spark, "archives")
    found = read_archives(write_archives(pages(ROWS), folder), folder).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == plain(ROWS)


def test_the_dictionary_leads_and_any_record_can_be_read_alone(spark, pages):
    folder = common.new_folder(spark, "archives")
    files = write_archives(pages(ROWS), folder)
    for path in (f.path for f in files.collect()):
        raw = open(path, "rb").read()
        magic, size = struct.unpack("<II", raw[:8])
        assert magic == archives.DICTIONARY_FRAME
        dictionary = zstandard.ZstdCompressionDict(zstandard.decompress(raw[8 : 8 + size]))
        assert dictionary.dict_id()
        # the frame after it needs the dictionary
        assert zstandard.get_frame_parameters(raw[8 + size :]).dict_id == dictionary.dict_id()
    for row in read_archives(files, folder, payloads=True).collect()[::50]:
        fields, block = record_at(f"file://{row.path}", row.offset)
        assert fields["WARC-Type"] == row.record_type and fields["WARC-Payload-Digest"] == f"sha1:{row.payload_digest}"
        assert row.html is None or block.endswith(row.html.encode())


def test_revisits_name_a_record_that_is_there(spark, pages):
    folder = common.new_folder(spark, "archives")
    files = write_archives(pages(ROWS), folder)
    ids, refers = set(), []
    for f in files.collect():
        with open(f.path, "rb") as stream:
            for _, record in archives.frames(stream, 1000):
                fields, _ = archives.fields_of(record)
                assert fields["WARC-Record-ID"] not in ids
                ids.add(fields["WARC-Record-ID"])
                if "WARC-Refers-To" in fields:
                    refers.append(fields["WARC-Refers-To"])
                assert "X" not in fields
    assert refers and set(refers) <= ids


def test_the_dictionary_makes_files_smaller(spark, pages):
    samples = [archives.page_record(i, "http://c.example/x", f"<html><body>{i} {'some words ' * (i % 7)}</body></html>".encode(), 50, b"0" * 20, archives.record_id(b"s", i, i), None, "d") for i in range(400)]
    packed = lambda **o: sum(len(zstandard.ZstdCompressor(**o).compress(s)) for s in samples[300:])
    assert packed(dict_data=zstandard.ZstdCompressionDict(archives.trained(samples[:300]))) * 2 < packed()


def test_damage_is_told(spark, pages):
    folder = common.new_folder(spark, "archives")
    files = write_archives(pages(ROWS[:40]).coalesce(1), folder)
    path = files.first().path
    raw = bytearray(open(path, "rb").read())
    raw[-5] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(Exception):  # noqa: B017, PT011  Spark's own class
        read_archives(files, folder).collect()
    raw[-5] ^= 1
    open(path, "wb").write(raw[:-7])
    with pytest.raises(Exception, match="cut short"):
        read_archives(files, folder).collect()


def test_empty_table(spark, pages):
    folder = common.new_folder(spark, "archives")
    files = write_archives(pages([]), folder)
    assert files.collect() == [] and read_archives(files, folder).collect() == []
    few = [(1, "u", "a")]
    folder = common.new_folder(spark, "archives")
    assert Counter(tuple(r)[:1] for r in read_archives(write_archives(pages(few), folder), folder).collect()) == Counter([(1,)])
