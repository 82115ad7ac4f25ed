import base64
import gzip
import hashlib
import os

from prismrank.llm import warc

SCHEMA = "page_id long, url string, html string, shard int, digest string"
ROWS = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "http://c/\r\nX: y", ""), (5, "http://d/", "é" * 300_000), (6, "http://e/", "one"), (6, "http://e/", "one"), (6, "http://f/", "two"), (None, "http://n/", "null"), (None, "http://n/", "null"), (None, None, "same")]


def expected(rows):
    of = {}
    for i, _, h in rows:
        of.setdefault(h or "", []).append(i)
    out, done = [], set()
    for i, _, h in rows:
        p = (h or "").encode()
        top = max((x for x in of[h or ""] if x is not None), default=None)
        first = i == top and h not in done
        done |= {h} if first else set()
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first else "revisit", None if first else top))
    return sorted(out, key=str)


def frame(spark):
    return spark.createDataFrame([(*r, 1, "clash") for r in ROWS], SCHEMA)


def test_round_trip(spark):
    assert sorted(map(tuple, warc.pages_digest(frame(spark).repartition(3)).collect()), key=str) == expected(ROWS)


def test_files_are_the_same_however_rows_are_dealt(spark, tmp_path):
    found = []
    for k in (1, 4):
        folder = f"file://{tmp_path}/{k}"
        m = warc.write_warc(frame(spark).repartition(k), folder, roll_bytes=400)
        names = sorted(r.name for r in m.collect())
        assert sorted(x for x in os.listdir(tmp_path / str(k)) if x[0] != "_") == names and not (tmp_path / str(k) / "_temporary").exists()
        found.append({n: (tmp_path / str(k) / n).read_bytes() for n in names})
        assert len(names) > 3
    assert found[0] == found[1]
    assert b"X: y" not in [x for x in b"".join(gzip.decompress(x) for x in found[0].values()).split(b"\r\n")]


def test_files_do_not_depend_on_shuffle_partitions(spark, tmp_path):
    rows = [(i, f"http://{i}/", str(i % 50) * 500) for i in range(300)]
    pages = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    kept, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for k in ("3", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", k)
            m = warc.write_warc(pages, f"file://{tmp_path}/{k}", shard_bytes=40_000, roll_bytes=4000)
            read = warc.read_warc(m, f"file://{tmp_path}/{k}")
            assert read.rdd.getNumPartitions() == m.count() > 3
            assert sorted(map(tuple, read.collect()), key=str) == expected(rows)
            found.append({r.name: (tmp_path / k / r.name).read_bytes() for r in m.collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert found[0] == found[1] and len({n.split("-")[1] for n in found[0]}) > 3


def test_payloads_below_the_least_size_are_all_responses(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    got = warc.read_warc(warc.write_warc(frame(spark), folder, least=4), folder).collect()
    assert sum(r.record_type == "revisit" for r in got) == 3  # two of "same", one of "null"


def test_empty(spark):
    assert warc.pages_digest(spark.createDataFrame([], SCHEMA)).count() == 0
