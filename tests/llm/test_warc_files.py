"""Archives are closed by bytes: no file holds more than its share, and what is read back is the same."""

import gzip
import hashlib
from pathlib import Path

from velonet.llm import store, warc


def rows(spark):
    sizes = [0, 1, 40, 90, 99, 100, 101, 250, 999, 1000, 1001, 5000, 20_000] * 3 + [1200] * 4
    html = [(i, f"http://h/{i}", chr(97 + i % 26) * n if n != 1200 else "r" * n) for i, n in enumerate(sizes)]
    return spark.createDataFrame([*html, (900, None, None)], "page_id long, url string, html string")


def test_files_are_closed_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "SIZES", (0, 100, 1000))
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    assert [warc.file_records(s) for s in warc.SIZES] == [20, 2, 1]
    df = rows(spark)
    path = store.new_path(spark, "sized")
    warc.write_captures(df, path)
    payloads = []
    for file in Path(path.removeprefix("file://")).glob("part-*"):
        of_file = [len(warc._payload(h, b)) for h, b in warc.parse(gzip.decompress(file.read_bytes())) if h["warc-type"][0] in ("response", "revisit")]
        assert len(of_file) == 1 or sum(of_file) <= 2000
        payloads.append(of_file)
    assert sum(map(len, payloads)) == 44 and max(map(len, payloads)) > 1
    got = warc.resolve_revisits(warc.assemble(warc.read_records(spark, path))).collect()
    want = sorted((r.page_id, len(r.html or ""), hashlib.sha1((r.html or "").encode()).hexdigest()) for r in df.collect())
    assert sorted((int(bytes(r.metadata[0].payload).split(b": ")[1]), r.payload_bytes, r.payload_digest) for r in got) == want
    assert sum(r.type == "revisit" for r in got) >= 3


def test_one_class_and_none(spark):
    for df in (rows(spark), rows(spark).limit(0), rows(spark).filter("html is null")):
        path = store.new_path(spark, "plain")
        warc.write_captures(df, path)
        assert warc.assemble(warc.read_records(spark, path)).count() == df.count()
