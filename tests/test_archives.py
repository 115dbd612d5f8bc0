"""Archives as files, against the standard library."""

import io
import os
import random
import zipfile

from pyspark.sql import functions as F

from docflow.catalog import files
from docflow.sources import archives
from docflow.storage import filesystem

RNG = random.Random(3)
FILES = [("t 1/ü", f"images/{i}.png", RNG.randbytes(RNG.randrange(0, 3000))) for i in range(40)]
FILES += [("t2", "text.md", b"# a\n" * 500), ("t2", "text.md", b"# a\n" * 500), ("t2", "text.md", b"other"), ("t2", "text.md", b"third"), ("t2", "no extension", b""), ("t2", "no extension", b"x"), ("t2", "v1.2/no extension", b"y"), ("t2", "v1.2/no extension", b"z")]
FILES += [("t2", "naïve 漢.txt", b"n"), ("t2", "gone", None), (None, "a", b"of no task")]


def _frame(spark, rows=FILES):
    return spark.createDataFrame(rows, "task_id string, path string, content binary").withColumn("crc", F.lit("mine"))


def _named(rows):
    """What the archives are to hold."""
    out = {}
    for task, path in sorted({(str(t).replace("None", "null"), p) for t, p, c in rows if c is not None}):
        import hashlib

        contents = sorted({c for t, p, c in rows if str(t).replace("None", "null") == task and p == path and c is not None}, key=lambda c: hashlib.sha256(c).hexdigest())
        for n, c in enumerate(contents, 1):
            folder, slash, name = path.rpartition("/")
            stem, dot, ext = name.rpartition(".") if "." in name else (name, "", "")
            out[task, path if n == 1 else f"{folder}{slash}{stem}-{n}{dot}{ext}"] = c
    return out


def test_archives_are_what_the_library_reads(spark, tmp_path):
    want = _named(FILES)
    raws = []
    for k in range(2):
        found = archives.write_archives(_frame(spark).repartition(3 + k), str(tmp_path / f"out{k}"))
        assert found.columns == ["task_id", "file", "members", "bytes"]
        got = {}
        for r in found.collect():
            where, root = filesystem(r["file"])
            with where.open_input_file(root) as f:
                raw = f.readall()
            assert len(raw) == r["bytes"]
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                assert z.testzip() is None and z.namelist() == sorted(z.namelist(), key=lambda n: n.encode()) and len(z.namelist()) == r["members"]
                got |= {(r["task_id"], n): z.read(n) for n in z.namelist()}
            raws.append((r["task_id"], raw))
        assert got == want
        assert sorted(os.listdir(tmp_path / f"out{k}")) == sorted(os.path.basename(r["file"]) for r in found.collect())
    assert sorted(raws[: len(raws) // 2]) == sorted(raws[len(raws) // 2 :])
    back = archives.contents(archives.archive_members(spark, str(tmp_path / "out0")).repartition(4)).collect()
    assert {(r["task_id"], r["path"]): r["content"] for r in back} == want and all(r["error"] is None for r in back)
    assert archives.write_archives(_frame(spark).limit(0), str(tmp_path / "none")).count() == 0


def test_foreign_and_broken_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("stored", b"as it is", zipfile.ZIP_STORED)
        z.writestr("small", b"x" * 1000, zipfile.ZIP_DEFLATED)
        z.writestr("other", b"x" * 1000, zipfile.ZIP_BZIP2)
        z.writestr("bad", b"will not check", zipfile.ZIP_STORED)
    raw = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "a.zip").write_bytes(raw.replace(b"will not", b"will NOT"))
    (tmp_path / "b.zip").write_bytes(b"no archive")
    got = {(r["task_id"], r["path"]): (r["content"], r["error"]) for r in archives.contents(archives.archive_members(spark, str(tmp_path))).collect()}
    assert got["a", "stored"] == (b"as it is", None) and got["a", "small"] == (b"x" * 1000, None)
    assert got["a", "other"][1].startswith("ValueError: method") and got["a", "bad"] == (None, "ValueError: checksum")
    assert got["b", None][0] is None and got["b", None][1]


def test_large_directories(tmp_path, monkeypatch):
    """Records beyond 16 and 32 bits, with the limits lowered so that small files have them."""
    monkeypatch.setattr(archives, "_MAX16", 5)
    a = archives._Archive(str(tmp_path), "many")
    rows = []
    for i in range(9):
        body = zipfile.zlib.compress(b"abc", 6)[2:-4]
        rows.append((f"{i}".encode(), zipfile.crc32(b"abc"), 3, body, a.at))
        a.member(*rows[-1])
    a.member(*rows[0])  # a copy is passed over
    for name, crc, size, body, at in rows:
        a.entry(name, crc, size, len(body), at)
    _, file, count, _ = a.close()
    raw = open(file, "rb").read()
    assert count == 9 and archives._END64 in raw and archives._AT64 in raw
    # the library looks for the wide record where the narrow one is full
    wide = raw.replace(archives._END + b"\0\0\0\0\5\0\5\0", archives._END + b"\0\0\0\0\xff\xff\xff\xff")
    with zipfile.ZipFile(io.BytesIO(wide)) as z:
        assert z.namelist() == [str(i) for i in range(9)] and z.read("8") == b"abc"


def test_ten_thousand_members_of_one_task(spark, tmp_path):
    n = 10_000
    rows = spark.range(n).select(F.lit("t").alias("task_id"), F.format_string("p/%05d", "id").alias("path"), F.encode(F.repeat(F.col("id").cast("string"), 20), "UTF-8").alias("content"))
    r = archives.write_archives(rows, str(tmp_path)).first()
    assert r["members"] == n
    back = archives.contents(archives.archive_members(spark, str(tmp_path)))
    assert back.where("error is not null").count() == 0
    assert back.select("path", "content").exceptAll(rows.select("path", "content")).count() == 0


def test_archives_query_has_one_archive_a_nation(spark, tmp_path):
    rows = [(k, f"n{k % 7}", k % 3) for k in range(400)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = files.archives(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((str(n), f"images/picture-{k}.png", name) for k, name, n in rows)
