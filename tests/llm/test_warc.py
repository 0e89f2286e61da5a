import base64
import hashlib
import struct

import pytest
import zstandard

from phyllon.llm import warc
from phyllon.llm.common import shared_dir

SCHEMA = "page_id long, url string, html string"


def test_round_trip(spark):
    rows = [(i, f"http://x/{i}", f"<p>{'page text ' * (i % 9)}{i % 40}</p>") for i in range(400)]
    rows += [(900, None, None), (901, "u\r\nWARC-Type: fake", ""), (902, "u", "é" * 30_000), (None, "n", rows[0][2]), (None, "n", "nobody"), (7, "again", rows[7][2])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    folder = f"{shared_dir(spark)}/warc-test"
    manifest = warc.write_archives(df, folder, archive_bytes=20_000)
    (spark.createDataFrame([(b"left by a lost task",)], "b binary").write.mode("overwrite").parquet(f"{folder}/lost"))
    got = warc.read_archives(spark, folder, manifest).collect()
    assert manifest.count() > 3 and len(got) == len(rows)
    best = {}
    for i, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), -1 if i is None else i)
    want = []
    for i, _, html in rows:
        b, top = (html or "").encode(), best[html or ""]
        again = top >= 0 and i != top
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", top if again else None))
    key = lambda r: str(tuple(r))
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got), key=key) == sorted(want, key=key)
    assert {bytes(r["payload"]).decode() for r in got if r["record_type"] == "response"} == {html or "" for _, _, html in rows}


def test_archive_format():
    records = [warc.record(i, "u", b"body %d " % i * 50, "response", None, "2000-01-01T00:00:00Z") for i in range(50)]
    data = warc.archive(records)
    magic, n = struct.unpack_from("<II", data)
    assert magic == warc.DICTIONARY_FRAME
    assert list(warc.records_of(data)) == records
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n]))
    frames = list(warc.frames(data, 8 + n))
    assert len(frames) == 50 and d.decompress(frames[31]) == records[31]  # each by itself
    assert list(warc.records_of(warc.archive(records[:1]))) == records[:1]  # too few to train
    with pytest.raises(ValueError):
        warc.parsed(records[0].replace(b"body 0", b"body 9"))


def test_small_payloads_do_not_revisit(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], SCHEMA)
    folder = f"{shared_dir(spark)}/warc-small"
    got = warc.read_archives(spark, folder, warc.write_archives(df, folder, min_bytes=2)).collect()
    assert {r["record_type"] for r in got} == {"response"}
    none = warc.archive_round_trip(df.limit(0))
    assert none.count() == 0


def test_large_and_hot_payloads_null_ids_and_clashing_columns(spark):
    big = "<p>" + "large page " * 500_000
    rows = [(1, "u", big), (2, "u", big)] + [(i, "u", None) for i in range(10, 60)] + [(None, "u", big), (None, "u", big), (None, "u", "own"), (None, "u", "own")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", digest string, best int").repartition(4)
    folder = f"{shared_dir(spark)}/warc-large"
    got = warc.read_archives(spark, folder, warc.write_archives(df, folder)).collect()
    assert len(got) == len(rows)
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] == len(big)) == [(0, "revisit", 2), (0, "revisit", 2), (1, "revisit", 2), (2, "response", None)]
    assert {(r["page_id"], r["record_type"]) for r in got if r["payload_bytes"] == 0} == {(59, "response"), *((i, "revisit") for i in range(10, 59))}
    assert [r["record_type"] for r in got if r["payload_bytes"] == 3] == ["response"] * 2
    assert len({warc.record(None, "u", b"", "response", None, "d") for _ in range(3)}) == 3  # ids are unique
