"""Archives as a data source in batch and stream, and bundles with their manifest."""

import hashlib
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from marlstone.sources import archives, bundles, readers


def make_zip(path, members, stored=False):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        for n, c in members:
            z.writestr(n, c)


def test_members_and_files(spark, tmp_path):
    make_zip(tmp_path / "a.zip", [("docs/", b""), ("docs/one.md", b"# 1"), ("__MACOSX/docs/one.md", b"x"), (".hidden.md", b"x"), ("docs/.git/c.md", b"x"), ("pic.PNG", b"\x89"), ("run.exe", b"x"), ("noend", b"x"), ("t.csv", b"a,b\n1,2")])
    (tmp_path / "plain.html").write_bytes(b"<p>hi</p>")
    (tmp_path / "_skipped.md").write_bytes(b"x")
    (tmp_path / "broken.zip").write_bytes(b"PK no archive")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "big.txt").write_bytes(b"y" * 5000)
    rows = {r["path"][len(str(tmp_path)) + 1 :]: r for r in archives.read_documents(spark, str(tmp_path), max_bytes=4000).collect()}
    assert set(rows) == {"a.zip!docs/one.md", "a.zip!pic.PNG", "a.zip!t.csv", "plain.html", "broken.zip", "sub/big.txt"}
    one = rows["a.zip!docs/one.md"]
    assert (one["name"], one["extension"], one["size"], bytes(one["content"]), one["error"]) == ("one.md", "md", 3, b"# 1", None)
    assert rows["a.zip!pic.PNG"]["extension"] == "png" and rows["plain.html"]["archive"] is None
    assert rows["broken.zip"]["error"] and rows["broken.zip"]["content"] is None and "4000" in rows["sub/big.txt"]["error"]
    assert len(archives.read_documents(spark, str(tmp_path), extensions="*").collect()) == 8
    converted = {r["path"].rpartition("!")[2]: r["text"] for r in readers.convert_files(archives.read_documents(spark, str(tmp_path / "a.zip"))).collect()}
    assert converted["t.csv"] == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    with pytest.raises(Exception, match="nowhere"):
        archives.read_documents(spark, str(tmp_path / "nowhere")).collect()


def test_large_archives_are_dealt_by_members(spark, tmp_path):
    """No task reads more of an archive than its range, and all ranges make the whole."""
    members = [(f"m{i:03d}.txt", os.urandom(20_000)) for i in range(200)] + [("zero.txt", b"")]
    make_zip(tmp_path / "big.zip", members, stored=True)
    make_zip(tmp_path / "small.zip", [("s.txt", b"s")])
    df = archives.read_documents(spark, str(tmp_path), partition_bytes=500_000)
    per_task = df.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    assert len(per_task) == 9 and max(r["size"] for r in per_task) <= 500_000
    got = {r["name"]: r["h"] for r in df.select("name", F.sha2("content", 256).alias("h")).collect()}
    assert got == {n: hashlib.sha256(c).hexdigest() for n, c in [*members, ("s.txt", b"s")]}


def test_broken_member(spark, tmp_path):
    path = tmp_path / "c.zip"
    make_zip(path, [("ok.txt", b"fine"), ("bad.txt", b"content to break")], stored=True)
    raw = path.read_bytes()
    path.write_bytes(raw.replace(b"content to break", b"content t0 break"))
    rows = {r["name"]: r for r in archives.read_documents(spark, str(tmp_path)).collect()}
    assert bytes(rows["ok.txt"]["content"]) == b"fine" and "CRC" in rows["bad.txt"]["error"]


def test_stream_takes_files_once(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    source.mkdir()

    def run():
        q = archives.stream_documents(spark, str(source), files_per_batch=2).select("path", F.length("content").alias("n")).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
        q.processAllAvailable()
        q.stop()
        return sorted((r["path"].rpartition("/")[2], r["n"]) for r in spark.read.parquet(out).collect())

    for i in range(5):
        (source / f"f{i}.txt").write_bytes(b"x" * i)
        os.utime(source / f"f{i}.txt", (1000, 1000))  # one time for all: batches part them by name
    assert run() == [(f"f{i}.txt", i) for i in range(5)]
    make_zip(source / "z.zip", [("in.md", b"12345")])
    (source / "late.txt").write_bytes(b"late")
    os.utime(source / "late.txt", (1000, 1000))
    assert run() == sorted([*((f"f{i}.txt", i) for i in range(5)), ("late.txt", 4), ("z.zip!in.md", 5)])


def files(spark, rows, parts=3):
    return spark.createDataFrame(rows, "path string, text string").repartition(parts)


def test_bundle_is_replaced_and_verified(spark, tmp_path):
    folder = str(tmp_path / "b")
    rows = [(f"concepts/c{i}.md", f"# C{i}\né" * i) for i in range(40)] + [("INDEX.md", None), (None, "x")]
    manifest = bundles.write_bundle_files(files(spark, rows), folder, root="kb")
    want = {p: ((t or "").encode()) for p, t in rows if p}
    assert (manifest["files"], manifest["bytes"], manifest["root"], len(manifest["parts"])) == (41, sum(map(len, want.values())), "kb", 3)
    listed = {r["path"]: (r["size"], r["sha256"]) for r in bundles.bundle_listing(spark, folder).collect()}
    assert listed == {p: (len(c), hashlib.sha256(c).hexdigest()) for p, c in want.items()}
    assert {r["path"]: bytes(r["content"]) for r in bundles.bundle_files(spark, folder).collect()} == want
    for p in manifest["parts"]:
        text = open(f"{folder}/.okf/files-{p['name']}.jsonl", "rb").read()
        assert hashlib.sha256(text).hexdigest() == p["listing_sha256"] and text.count(b"\n") == p["files"]
    assert {r["state"] for r in bundles.verified(spark, folder).collect()} == {"ok"}
    bundles.write_bundle_files(files(spark, [("a.md", "new"), ("a.md", "twice")], 1), folder)
    assert sorted(f for f in os.listdir(folder) if f.endswith(".zip")) == [f"part-{p['name']}.zip" for p in bundles.read_manifest(folder)["parts"]]
    assert [tuple(r) for r in bundles.repeated_paths(spark, folder).collect()] == [("a.md", 2)]
    log = [json.loads(x) for x in open(f"{folder}/.okf/log.jsonl")]
    assert [(x["event"], x["files"]) for x in log] == [("created", 41), ("replaced", 2)]
    name = bundles.read_manifest(folder)["parts"][0]["name"]
    make_zip(f"{folder}/part-{name}.zip", [("bundle/a.md", b"changed"), ("bundle/z.md", b"more")])
    assert sorted((r["path"], r["state"]) for r in bundles.verified(spark, folder).collect()) == [("a.md", "changed"), ("a.md", "changed"), ("z.md", "unlisted")]


def test_failed_job_leaves_the_bundle_before(spark, tmp_path):
    folder = str(tmp_path / "b")
    fails = files(spark, [(f"f{i}.md", "x") for i in range(20)], 4).withColumn("text", F.when(F.col("path") == "f7.md", F.raise_error(F.lit("stop"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stop"):
        bundles.write_bundle_files(fails, folder)
    assert not os.path.exists(f"{folder}/.okf/manifest.json")
    with pytest.raises(FileNotFoundError):
        bundles.read_manifest(folder)
    before = bundles.write_bundle_files(files(spark, [("a.md", "1")]), folder)
    with pytest.raises(Exception, match="stop"):
        bundles.write_bundle_files(fails, folder)
    assert bundles.read_manifest(folder) == before and [bytes(r["content"]) for r in bundles.bundle_files(spark, folder).collect()] == [b"1"]
    empty = bundles.write_bundle_files(files(spark, [("a.md", "1")]).limit(0), folder)
    assert empty["files"] == 0 and bundles.bundle_listing(spark, folder).collect() == [] and bundles.bundle_files(spark, folder).collect() == []
