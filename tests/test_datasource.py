"""The data source gives what the loader gives, and its stream takes each change once."""

import os
import time

import pytest

from corpusloom.sources import datasource, files

NAMES = {"a/guide.md": "# Guide\n\nKafka topic setup.", "a/my-notes_x.TXT": "text", ".git/x.md": "x", "a/api_token_guide.md": "x", "a/b.png": "x", "a/blank.txt": "  \n", "b/t.csv": "k,v\n" + "1,x\n" * 120, "b/bad.docx": "no", "b/no_extension": "x", "b/.env": "A=1"}


@pytest.fixture
def root(tmp_path):
    for name, data in NAMES.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(data)
    return tmp_path / "in"


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def test_read(spark, root, tmp_path):
    datasource.register(spark)
    want = rows(files.load(files.discover(spark, str(root))))
    read = spark.read.format("corpusloom_units").option("group_bytes", 200)
    found = read.load(str(root))
    assert rows(found) == want and found.rdd.getNumPartitions() >= 2
    assert rows(read.load(f"file://{root}")) == want
    assert rows(files.reports(found)) == rows(files.reports(files.load(files.discover(spark, str(root)))))
    assert read.load(str(tmp_path / "none")).count() == 0


def test_stream(spark, root, tmp_path):
    datasource.register(spark)

    def taken():
        stream = spark.readStream.format("corpusloom_units").option("settled", 0).load(str(root))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return sorted({r.path for r in spark.read.schema(files._UNITS).parquet(str(tmp_path / "out")).collect()}), spark.read.schema(files._UNITS).parquet(str(tmp_path / "out")).count()

    paths, n = taken()
    assert paths == sorted(NAMES)
    assert taken() == (paths, n)  # nothing new
    (root / "a/new.md").write_text("more")
    later = time.time() + 1
    os.utime(root / "a/new.md", (later, later))
    time.sleep(1.2)
    assert taken() == (sorted([*paths, "a/new.md"]), n + 1)
