"""Worked examples."""

import io
import json
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import answers, chunking, diagnostics, governance, retrieval, scope
from corpusloom.plans import rebuild
from corpusloom.sources import files, sinks
from corpusloom.streaming import events


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_ids(spark):
    path = F.lit("developer_support/project_a/readme.md")
    sha = T.content_sha256(F.lit("x"))
    unit = T.unit_id(F.lit(""), path, sha, F.lit(0), F.lit("file"))
    chunk = T.chunk_id(F.lit(0), T.content_sha256(F.lit("hello world")), unit)
    r = one(spark, T.document_id(path).alias("a"), unit.alias("b"), chunk.alias("c"))
    assert r.a == "6259ba093d7bf40fbd27"
    assert r.b == "d0d44fb8c5c057c8153c1e194336a59e528a1b2946a0eb8813e993e7327e7bae"
    assert r.c == "fe33ffe587c2c04daf9ad37ecbd208d429b02aa99b05ebd137c666710e5adbb1"
    assert one(spark, T.uuid5(uuid.NAMESPACE_URL.hex, F.lit("näme")))[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, "näme"))
    assert one(spark, T.uuid5(T.POINT_NAMESPACE, F.lit(r.c)))[0] == str(uuid.uuid5(uuid.UUID("922127d7-5c34-47bb-a627-8a2c1df2b56e"), r.c))
    assert one(spark, T.rebuild_id(F.lit("2026-06-22 09:18:26").cast("timestamp")))[0] == "20260622T091826Z_1d68fd9b"


@pytest.mark.parametrize("x, language", [("Kafka topic", "en"), ("สวัสดี", "th"), ("topic ชื่ออะไร", "mixed"), ("12345", "other"), ("é", "other"), ("été", "en")])
def test_language(spark, x, language):
    assert one(spark, T.detect_language(F.lit(x)))[0] == language


@pytest.mark.parametrize("m, history, scope, route", [("hello!", False, "", "greeting"), ("What is the admin password?", False, "", "unsupported"), ("anything else", False, "strict_selected", "document_qa"), ("What about Plant B?", True, "", "follow_up"), ("What about Plant B?", False, "", "kafka_iot_support"), ("What is the capital of France?", False, "", "developer_support"), ("Summarise chapter two", False, "prefer_selected", "document_qa"), ("Summarise chapter two", False, "", None)])
def test_route(spark, m, history, scope, route):
    assert one(spark, answers.route(F.lit(m), F.lit(history), F.lit(scope)).alias("r")).r.route == route


@pytest.mark.parametrize("a, issue", [("", "empty answer"), ("too short", "suspiciously short answer"), ("This is **bold text without end", "unmatched bold markdown marker"), ("Run the `command now please ok", "unmatched inline-code marker"), ("The list of values is as follows:", "answer ends with dangling punctuation"), ("It works in live and replay.", "answer appears truncated after conjunction or field name"), ("It works in live and replay modes today", "ok")])
def test_quality(spark, a, issue):
    assert one(spark, answers.quality_issue(F.lit(a), F.lit("")))[0] == issue


def test_citations(spark):
    r = one(spark, answers.cited_ids(F.lit("a [S1, S2] b [S2] [S9] [S1 S2]")).alias("c"), answers.keep_citations(F.lit("a [S1, S2] b [S2] [S9]"), F.array(F.lit("S1"), F.lit("S2"))).alias("k"))
    assert r.c == ["S1", "S2", "S9"] and r.k == "a [S1, S2] b [S2]"


def test_fusion(spark):
    dense = spark.createDataFrame([(1, "a", 0.8, 1), (1, "b", 0.6, 2), (1, "c", 0.5, 3)], "query_id long, point_id string, score double, rank long")
    lexical = spark.createDataFrame([(1, "c", 0.7, 1), (1, "d", 0.2, 2), (1, "b", 0.1, 3)], "query_id long, point_id string, score double, rank long")
    rows = retrieval.accept(retrieval.fuse(dense, lexical, 8), 0.58, 4).orderBy("rank").collect()
    assert [(r.point_id, round(r.rrf, 6), round(r.score, 2), r.match_type, r.accepted) for r in rows] == [("c", 0.032266, 0.99, "hybrid", True), ("b", 0.032002, 0.6, None, True), ("a", 0.016393, 0.8, None, True), ("d", 0.016129, 0.55, "lexical", False)]


@pytest.mark.parametrize("budget, shown", [(1000, [(400, False), (400, False)]), (1200, [(400, False), (400, False), (196, True)])])
def test_context(spark, budget, shown):
    hits = spark.createDataFrame([(1, i, str(i), "x" * 400) for i in (1, 2, 3)], "query_id long, rank long, point_id string, text string")
    rows = retrieval.pack_context(hits, budget, F.lit(63)).orderBy("rank").collect()
    assert [(len(r.block_text), r.truncated) for r in rows] == shown
    with pytest.raises(ValueError):
        retrieval.pack_context(hits, 499, F.lit(63))


def test_safety(spark):
    rows = [("a/batch2_sample_credentials.txt", "x"), ("a/novel.txt", "cormac mccarthy"), ("a/plain.txt", None), ("a/key.txt", "api_key = abcdefgh1234")]
    got = {r.path: r for r in governance.scan(spark.createDataFrame(rows, "path string, text string"), True).collect()}
    assert got["a/batch2_sample_credentials.txt"].status == "rejected" and got["a/batch2_sample_credentials.txt"].secret_hits == ["credential_filename"]
    assert got["a/novel.txt"].status == "quarantined" and got["a/plain.txt"].status == "accepted" and got["a/key.txt"].secret_hits == ["api_key_assignment"]


def test_chunks():
    table = "\n".join(["| a |", "| --- |", *(f"| {i} |" for i in range(45))])
    got = chunking.chunk_unit("u", table, chunking.Config(max_chars=5000), row_start=51)
    assert [(c["row_start"], c["row_end"]) for c in got] == [(51, 70), (71, 90), (91, 95)]
    got = chunking.chunk_unit("u", "# A\n## B\nbody\n# C\nmore")
    assert [c["heading_path"] for c in got] == [["A", "B"], ["C"]] and got[0]["chunk_count"] == 2
    assert all(len(c["text"]) <= 1600 for c in chunking.chunk_unit("u", "word " * 3000))
    with pytest.raises(ValueError):
        chunking.Config(max_chars=100)


def test_rebuild(spark, tmp_path):
    root = tmp_path / "docs"
    for name, data in {"a/guide.md": b"# Guide\n\nKafka topic setup.", "a/copy.md": b"# Guide\n\nKafka topic setup.", ".git/x.md": b"x", "a/_notes.md": b"x", "a/api_token_guide.md": b"x", "a/b.png": b"x", "a/blank.txt": b"  \n", "b/t.csv": "﻿k,v\n".encode() + b"".join(b"%d,x\n" % i for i in range(120)), "b/bad.docx": b"not a zip"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    with zipfile.ZipFile(root / "b/ok.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body text</w:t></w:r></w:p></w:body></w:document>')
    report = {r.path: r for r in files.reports(files.load(files.discover(spark, str(root)))).collect()}
    assert {k: r.status for k, r in report.items()} == {".git/x.md": "skipped_hidden", "a/_notes.md": "failed", "a/guide.md": "loaded", "a/copy.md": "loaded", "a/api_token_guide.md": "skipped_sensitive", "a/b.png": "skipped_unsupported", "a/blank.txt": "loaded_empty", "b/t.csv": "loaded", "b/bad.docx": "failed", "b/ok.docx": "loaded"}
    assert report["b/t.csv"].units_created == 3
    hidden = spark.createDataFrame([(".git/x.md", bytearray(b"x"))], "path string, content binary")
    assert files.load(hidden).first().status == "skipped_hidden"
    tables = rebuild.plan(spark, str(root))
    assert {r.path: r.status for r in tables["safety"].collect()}["a/api_token_guide.md"] == "rejected"
    points = tables["points"]
    index = str(tmp_path / "index")
    sinks.write_index(points, index)
    n = sinks.read_index(spark, index).count()
    assert n == points.count() and points.filter("source_path = 'a/guide.md'").count() == 0  # copy.md comes first
    sinks.upsert_index(points.limit(1), index)
    assert sinks.read_index(spark, index).count() == n


def test_queries_come_in_blocks(spark):
    points = spark.createDataFrame([(i, [float(i % 7), float(i % 5) + 1]) for i in range(40)], "point_id long, embedding array<float>")
    asked = points.select(F.col("point_id").alias("query_id"), F.col("embedding").alias("vector"))
    blocks = retrieval.query_blocks(asked, 10)
    assert len(blocks) == 8 and sorted(r.query_id for b in blocks for r in b.collect()) == list(range(40))
    assert len(retrieval.query_blocks(asked, 40)) == 1


def test_phrases_in_marked_tokens(spark):
    """The score of phrases is that of looking for them in the whole text."""
    texts = ["run app/main.py --fast now", "xapp/main.pyx", "a--fast", "app / main.py", "nothing", ""]
    chunks = spark.createDataFrame(list(enumerate(texts)), "point_id long, text string")
    asked = spark.createDataFrame([(0, "app/main.py --fast --fast")], "query_id long, query string")
    got = {r.point_id: r.score for r in retrieval.lexical_search(chunks, asked, 10).collect()}
    alone = {0: 1.0, 1: 0.75, 2: 0.85}  # a path: 0.65 + 0.10; a flag given twice: 0.65 + 0.20
    assert got == alone


def test_safety_scan_reads_whole_texts(spark):
    files = spark.createDataFrame([("a/long.txt", "x " * 150_000 + "sk-abcdefghijklmnop1234")], "path string, text string")
    assert governance.scan(files, True).first().status == "rejected"
    assert governance.scan(files, True, window=200_000).first().status == "accepted"


def test_missing_folder_has_no_files(spark, tmp_path):
    assert files.discover(spark, str(tmp_path / "none")).count() == 0


def _xlsx(sheets):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{n}"/>' for n, _, _ in sheets) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{n}" Target="worksheets/{f}"/>' for n, f, _ in sheets) + "</Relationships>")
        for _, f, rows in sheets:
            z.writestr(f"xl/worksheets/{f}", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join("<row>" + "".join(f'<c r="{"ABC"[i]}1"><v>{v}</v></c>' for i, v in enumerate(r)) + "</row>" for r in rows) + "</sheetData></worksheet>")
    return out.getvalue()


def test_sheets_by_their_relations():
    """Sheets stand under other numbers once one was moved or deleted."""
    units, _ = files.load_xlsx(_xlsx([("first", "sheet3.xml", [["k"], ["1"]]), ("second", "sheet1.xml", [["k"], ["2"]])]), "t")
    assert [(u["sheet_name"], u["text"].splitlines()[-1]) for u in units] == [("first", "| 1 |"), ("second", "| 2 |")]


def test_index_versions(spark, tmp_path):
    index = str(tmp_path / "index")
    first = sinks.write_index(spark.createDataFrame([("a", "1"), ("b", "2")], "point_id string, text string"), index)
    sinks.upsert_index(spark.createDataFrame([("b", "3"), ("b", "4"), ("c", "5")], "point_id string, text string"), index)
    assert sorted(map(tuple, sinks.read_index(spark, index).collect())) == [("a", "1"), ("b", "4"), ("c", "5")]
    assert first in sinks.versions(spark, index) and len(sinks.versions(spark, index)) == 2
    assert sinks.restore_index(spark, index, first).first().snapshot_name == first
    assert sinks.read_index(spark, index).count() == 2


def test_staging(spark, tmp_path):
    stage, docs = str(tmp_path / "stage"), str(tmp_path / "docs")
    for rows in ([("a", bytearray(b"1")), ("b", bytearray(b"1"))], [("a", bytearray(b"2"))]):
        sinks.stage(spark.createDataFrame(rows, "path string, content binary"), stage)
        assert sinks.staged(spark, stage).count() == len(rows)
        sinks.promote(spark, stage, docs)
        assert sinks.staged(spark, stage).count() == 0
    assert sorted((r.path, bytes(r.content)) for r in sinks.read_index(spark, docs).collect()) == [("a", b"2"), ("b", b"1")]


def test_reports(spark, tmp_path):
    results = spark.createDataFrame([(f"c{i}", ["x"] if i else []) for i in range(3)], "case_id string, failures array<string>")
    assert sinks.markdown_report(results, 2).splitlines()[-1] == "| … 1 more | | |"
    sinks.json_report(results, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 3
    sinks.release_manifest(spark, str(tmp_path / "m.json"), {"a": results.limit(1), "b": results.filter("false")})
    found = diagnostics.read_json_files(spark, str(tmp_path)).first()
    assert json.loads(found.json) == {"a": {"case_id": "c0", "failures": []}, "b": None}


def test_settings_of_a_file(spark, tmp_path):
    (tmp_path / ".env").write_text("# c\nA = 'x=y'\nB=1\n\nB=2\nnothing\n")
    assert {r.key: r.value for r in diagnostics.read_settings(spark, str(tmp_path / ".env")).collect()} == {"A": "x=y", "B": "2"}
    assert diagnostics.read_settings(spark, str(tmp_path / "none")).count() == 0


def test_answers_are_repaired_once(spark, tmp_path):
    class Model:
        """Answers badly at first, and well when it is told why."""

        def chat_json(self, prompt, schema):
            if "broken" in prompt:
                raise RuntimeError("no model")
            good = "failed validation" in prompt and "never" not in prompt
            return {"answer": "All of the machines run on one line [S1]." if good else "All of the machines and", "answerable": True, "cited_source_ids": ["S1"] if good else []}

    rows = [(1, "q", "en", "p", ["S1"]), (2, "q", "en", "never", ["S1"]), (3, "q", "th", "broken", ["S1"])]
    asked = spark.createDataFrame(rows, "query_id long, question string, language string, prompt string, allowed array<string>")

    def store(df):
        path = str(tmp_path / uuid.uuid4().hex)
        df.write.parquet(path)
        return spark.read.parquet(path)

    got = {r.query_id: r for r in scope.answer(asked, Model, store).collect()}
    assert got[1].answerable and got[1].answer == "All of the machines run on one line [S1]." and got[1].cited_ids == ["S1"]
    assert not got[2].answerable and got[2].answer.startswith("I could not find")
    assert not got[3].answerable and got[3].limitations == ["RuntimeError: no model"]


def test_retrieve_checks_its_arguments(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0], "kafka topic", "s", 1, "a.md"), (2, [0.0, 1.0], "other words", "s", 2, "a.md")], "point_id long, embedding array<double>, text string, source string, place long, source_path string")
    asked = spark.createDataFrame([(1, "kafka topic", [1.0, 0.0])], "query_id long, query string, vector array<double>")
    assert [r.point_id for r in retrieval.retrieve(points, asked, 2, 1, 0.5).filter("accepted").collect()] == [1]
    both = {r.point_id: r.match_type for r in retrieval.retrieve(points, asked, 2, 2, 0.1, {"source_path": "a.md"}).collect()}
    assert set(both) == {1, 2}
    for bad in ((0, 1, 0.5), (2, 3, 0.5), (2, 1, 7)):
        with pytest.raises(ValueError):
            retrieval.retrieve(points, asked, *bad)
    with pytest.raises(ValueError):
        retrieval.retrieve(points, asked.withColumn("query", F.lit("  ")), 2, 1, 0.5)


def test_phrases_of_quotes_and_expansions(spark):
    got = one(spark, T.phrases(F.lit('Is "Exact Words" in `a b` of the mqtt check?')))[0]
    assert got == ["exact words", "a b", "docker logs mqtt_to_ml_kafka -f", "mqtt_broker"]
    chunks = spark.createDataFrame([(1, "there are exact  words"), (2, "there are EXACT words"), (3, "nothing")], "point_id long, text string")
    asked = spark.createDataFrame([(0, "'exact words'")], "query_id long, query string")
    scores = {r.point_id: (r.score, r.matched) for r in retrieval.lexical_search(chunks, asked, 10).collect()}
    assert scores[2][0] > scores[1][0] and scores[1][1] == 2 and 3 not in scores


def test_plans(spark):
    """A search by terms is an equi-join, pruned columns reach the scan, and nothing is a nested loop."""
    chunks = spark.createDataFrame([(1, "kafka topic")], "point_id long, text string")
    asked = spark.createDataFrame([(0, "kafka")], "query_id long, query string")
    plan = retrieval.lexical_search(chunks, asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
