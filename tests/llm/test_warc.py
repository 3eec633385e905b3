import hashlib
import uuid

from tideline.llm import warc
from tideline.session import shared_folder

SCHEMA = "page_id bigint, url string, html string, digest string, bytes int"


def archived(spark, rows, **options):
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    path = warc.write_archives(pages, f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}", **options)
    return warc.read_archives(spark, path)


def brute(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        first = min(ids) if len(data) >= 100 and ids else None
        revisit = first is not None and (i is None or i > first)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(map(str, out))


def test_odd_payloads_survive_the_round_trip(spark):
    same = "payload ä " * 20
    rows = [
        (1, "http://a/", same), (2, None, same), (3, "http://b\r\nX: y/", same), (3, "http://b/", same), (None, "http://c/", same), (4, "u", None), (5, "u", ""),
        (6, "u", "short"), (7, "u", "short"), (8, "u", "\r\n\r\n" * 60), (9, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 5), (10, "u", "ends with\r\n" * 20),
        (11, "u", "ends with\r" * 20), (12, "u", "\r\n\r\n" * 60), (13, "u", "long 🎈" * 200_000), (None, "u", None), (-5, "u", "minus" * 30),
    ]
    read = archived(spark, rows)
    got = warc.follow_revisits(read).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)
    texts = {r["page_id"]: r["payload"] for r in read.where("record_type = 'response' AND page_id > 4").collect()}
    assert texts == {i: h or "" for i, _, h in rows if i in texts} and texts[8] == "\r\n\r\n" * 60
    assert {r["url"] for r in read.where("page_id = 3").collect()} == {"http://b%0D%0AX: y/", "http://b/"}


def test_revisits_hold_no_payload_and_headers_agree(spark):
    rows = [(i, "u", "copy" * 100) for i in range(50)]
    read = archived(spark, rows)
    assert read.where("record_type = 'response'").count() == 1
    assert read.where("payload_digest <> stated_digest").count() == 0
    assert read.where("record_type = 'revisit' AND payload IS NULL AND refers_to = 0").count() == 49


def test_empty_table(spark):
    assert archived(spark, []).count() == 0
