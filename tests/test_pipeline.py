import json
import threading
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quirework.config import RunConfig
from quirework.functions.sql import register_functions
from quirework.operators import generate, split
from quirework.operators.pages import body_text, clean_pages
from quirework.plans.pipeline import Engine
from quirework.sinks import export
from quirework.sources import documents
from quirework.streaming.gate_stream import gate_stream


def test_split_sizes():
    sizes = {n: split.sizes(n, RunConfig()) for n in (3, 4, 5, 15, 20, 25)}
    assert sizes == {3: (1, 1, 1), 4: (2, 1, 1), 5: (3, 1, 1), 15: (11, 2, 2), 20: (16, 2, 2), 25: (21, 2, 2)}
    with pytest.raises(ValueError):
        RunConfig(val_ratio=0.6, test_ratio=0.6).check_ratios()


def test_seeded_split_order(spark):
    docs = spark.createDataFrame([(f"src{k}",) for k in range(20)], "source_doc string")
    got = {r.source_doc: r.split for r in split.split_documents(docs, mode="seeded").collect()}
    assert all(got[d] == "train" for d in ("src9", "src13", "src4", "src12")) and all(got[d] == "test" for d in ("src0", "src11")) and all(got[d] == "val" for d in ("src15", "src16"))


def test_seeded_split_never_changes_its_order(spark, monkeypatch):
    docs = spark.createDataFrame([(f"src{k}",) for k in range(6)], "source_doc string")
    monkeypatch.setattr(split, "SHUFFLED_ON_DRIVER", 5)
    with pytest.raises(ValueError, match="at most 5 documents, not 6"):
        split.split_documents(docs, mode="seeded")
    assert split.split_documents(docs).count() == 6 and split.split_documents(docs.limit(5), mode="seeded").count() == 5


def test_split_fallback_and_counts(spark):
    rows = spark.range(25).selectExpr("id AS record_seq", "concat('d', id % 2) AS source_doc")
    placed = split.split_records(rows)
    assert {r["split"]: r["n"] for r in split.split_counts(placed).collect()} == {"train": 21, "val": 2, "test": 2}
    assert {r["split"]: r["n"] for r in split.split_counts(split.split_records(rows.limit(9))).collect()} == {"train": 9, "val": 0, "test": 0}


def test_page_stages(spark):
    blocks = spark.createDataFrame([("d", 1, 0, 0.0, 0.0, 9.0, 9.0, "kept"), ("d", 1, 1, 0.0, 20.0, 9.0, 29.0, "gone"), ("d", 1, 2, 0.0, 40.0, 9.0, 49.0, "touches")], "source_doc string, page_num int, block_no int, x0 double, y0 double, x1 double, y1 double, text string")
    boxes = spark.createDataFrame([("d", 1, 5.0, 25.0, 8.0, 40.0)], "source_doc string, page_num int, x0 double, y0 double, x1 double, y1 double")
    assert body_text(blocks, boxes).first()["raw_text"] == "kept\ntouches"
    raw = spark.createDataFrame([("d", 1, "scan", []), ("d", 2, "scan", ["a | ﬁ"]), ("d", 3, "INDEX and a long enough text", None), ("d", 4, None, None)], "source_doc string, page_num int, raw_text string, tables array<string>")
    assert [(r.page_num, list(r.tables)) for r in clean_pages(raw).orderBy("page_num").collect()] == [(2, ["a | fi"]), (3, [])]


def chunk_rows(spark, n):
    return spark.createDataFrame([(k, f"b_c{k:05d}", "b", 1, 1, f"text {k}", False, 50) for k in range(n)], "chunk_seq long, chunk_id string, source_doc string, page_start int, page_end int, text string, is_table boolean, token_count int")


def test_replayed_generation(spark):
    good = lambda q, a="an answer": json.dumps({"question": q, "answer": a})
    recorded = {
        "0#0": [(good("Q0?"), 5)], "0#1": [(good("q0?"), 1)], "1#0": [("{bad", 2), (good("Q1?"), 3)], "1#1": [(good("Other?"), 1)], "2#0": [("[1]", 1), (good("Q2?"), 1)], "3#0": [("{bad", 1), ("{bad", 1)],
        "4#0": [("{}", 1)], "5#0": [('{"question": "q"}', 1)], "6#0": [('{"question": null, "answer": "a"}', 1)], "7#0": [(good("Q7?", "Insufficient Context."), 1)], "8#0": [(None, 0), (good("Q8?"), 4)],
    }
    records, primary = generate.build_candidates(chunk_rows(spark, 9), RunConfig(), generate.replay_generator(recorded))
    assert {r.record_seq: r.question for r in records.collect()} == {0: "Q0?", 2: "Q1?", 3: "Other?", 4: "Q2?", 12: "None", 16: "Q8?"}
    reasons = {r.chunk_seq: (r.skip_reason, r.tokens) for r in primary.collect()}
    assert reasons[1] == (None, 5) and reasons[3] == ("generation failed", 2) and reasons[4][0] == "generation failed" and reasons[5][0] == "missing question/answer field" and reasons[7][0] == "insufficient context"
    assert len({r.system for r in records.collect()}) > 2


def test_run_writes_everything(spark, tmp_path):
    docs = documents.queue(spark, ["/in/a.pdf", "/in/b.pdf", "/in/a.pdf", "/in/c.pdf"])
    assert docs.count() == 3
    body = "\n\n".join(" ".join(f"word{k}x{j}" for k in range(30)) + "." for j in range(5))
    raw = docs.select("source_doc", F.explode(F.array(F.lit(1), F.lit(2))).alias("page_num"), F.concat(F.lit(body), F.col("source_doc")).alias("raw_text"), F.array(F.lit("h | v\n" + "x | y\n" * 30)).alias("tables"))
    seen = []
    result = Engine(spark, RunConfig(output_dir=str(tmp_path))).run(raw, docs, progress=seen.append)
    assert result.total_pages == 6 and result.total_chunks > 6 and result.total_qc_passed > 0 and result.total_examples_generated == result.total_qc_passed + result.total_qc_rejected
    out = Path(result.output_dir)
    assert out.name.endswith("a_plus2_gemma4_12b") and sum(result.split_counts.values()) == result.total_qc_passed and [p.stage for p in seen] == ["extract", "extract", "generate", "generate"]
    for name, n in result.split_counts.items():
        for kind in ("alpaca", "chatml"):
            lines = (out / f"{name}_{kind}.jsonl").read_text().splitlines()
            assert len(lines) == n and all(set(json.loads(x)["metadata"]) == {"source_doc", "page_start", "page_end", "chunk_id"} for x in lines)
    book = zipfile.ZipFile(result.review_workbook_path)
    assert {f"xl/worksheets/sheet{k}.xml" for k in (1, 2, 3)} <= set(book.namelist())
    assert json.loads((out / "run_info.json").read_text())["results"]["split_counts"] == result.split_counts
    stop = threading.Event()
    stop.set()
    assert Engine(spark, RunConfig(output_dir=str(tmp_path))).run(raw, docs, stop=stop).total_qc_passed == 0


def test_a_stop_keeps_what_is_done(spark, tmp_path):
    docs = documents.queue(spark, [f"/in/{n}.pdf" for n in "abcd"])
    raw = docs.select("doc_seq", "source_doc", F.lit(1).alias("page_num"), F.concat(F.lit("word " * 60), "source_doc").alias("raw_text"), F.array().cast("array<string>").alias("tables"))
    stop, seen = threading.Event(), []

    def progress(event):
        seen.append(event)
        if event.stage == "generate" and event.counts["done"] == 2:
            stop.set()

    result = Engine(spark, RunConfig(output_dir=str(tmp_path))).run(raw, docs, progress=progress, stop=stop, document_block=2, chunk_block=2)
    assert result.stopped and result.total_pages == 4 and result.total_chunks == 4 and result.total_examples_generated == 4
    assert [p.counts["documents_done"] for p in seen[:4]] == [0, 2, 2, 4] and seen[-1].counts["done"] == 2 and seen[-1].counts["total"] == 4
    assert sum(result.split_counts.values()) == result.total_qc_passed > 0
    early = Engine(spark, RunConfig(output_dir=str(tmp_path))).run(raw, docs, progress=lambda e: None, stop=stop)
    assert early.stopped and early.total_pages == 0 and (Path(early.output_dir) / "train_alpaca.jsonl").exists()


def test_part_files_rejects_and_skips(spark, tmp_path):
    docs = documents.queue(spark, [f"/in/{n}/same.pdf" for n in "abcdef"])
    raw = docs.select("doc_seq", "source_doc", F.lit(1).alias("page_num"), F.concat(F.lit("word " * 60), F.when(F.col("doc_seq") == 5, "insufficient context").otherwise(F.col("doc_seq").cast("string"))).alias("raw_text"), F.array().cast("array<string>").alias("tables"))
    parts = f"file://{tmp_path}/parts"
    result = Engine(spark, RunConfig(output_dir=str(tmp_path / "out"))).run(raw, docs, parts_dir=parts)
    lines = {name: spark.read.text(f"{parts}/{name}").collect() for name in ("alpaca", "chatml")}
    assert result.total_chunks == 6 and result.total_qc_passed > 0 and all(len(x) == result.total_qc_passed for x in lines.values())
    assert set(json.loads(lines["alpaca"][0]["value"])) == {"instruction", "input", "output", "metadata"}
    assert [r.skip_reason for r in spark.read.json(f"{parts}/skipped").collect()] == ["insufficient context"]
    assert spark.read.json(f"{parts}/rejected").count() == result.total_qc_rejected


FAKE_PDF = """
class Table:
    bbox = (0, 0, 10, 10)
    def __init__(self, rows): self.rows = rows
    def extract(self):
        if self.rows is None: raise ValueError
        return self.rows
class Found: pass
class Page:
    def __init__(self, number): self.number = number
    def get_text(self, kind): return [(0, 0, 5, 5, "in the table", 0, 0), (0, 20, 5, 25, f"body {self.number} of the page, long enough", 1, 0)]
    def find_tables(self):
        if self.number == 1: raise RuntimeError
        f = Found(); f.tables = [Table([["a", None], [" b ", "c"]]), Table([["one row"]]), Table(None)]; return f
class Doc:
    page_count = 2
    def __enter__(self): return self
    def __exit__(self, *a): pass
    def __iter__(self): return iter([Page(0), Page(1)])
def open(path):
    if "bad" in path: raise RuntimeError("broken file")
    return Doc()
"""


def test_pages_of_files(spark, tmp_path):
    (tmp_path / "pymupdf.py").write_text(FAKE_PDF)
    spark.sparkContext.addPyFile(str(tmp_path / "pymupdf.py"))
    docs = documents.queue(spark, ["/a/x.pdf", "/b/x.pdf", "/a/bad.pdf"])
    read = documents.read_pdf(spark, docs, ignore_errors=True)
    pages = documents.raw_pages(read).orderBy("doc_seq", "page_num").collect()
    assert [(p.doc_seq, p.page_num) for p in pages] == [(0, 1), (0, 2), (1, 1), (1, 2)] and pages[0].raw_text == "body 0 of the page, long enough"
    assert pages[0].tables == ["a | \nb | c"] and pages[1].tables == [] and pages[1].raw_text.startswith("in the table\n")
    assert [(r.doc_seq, r.error) for r in documents.failed_files(read).collect()] == [(2, "RuntimeError: broken file")]
    counts = documents.page_counts(documents.read_pdf(spark, docs, ignore_errors=True, count_only=True))
    assert {r.path: r.page_count for r in counts.collect()} == {"/a/x.pdf": 2, "/b/x.pdf": 2}
    with pytest.raises(Exception, match="broken file"):
        documents.read_pdf(spark, docs).count()


def test_workbook_limits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(export, "SHEET_ROWS", 3)
    monkeypatch.setattr(export, "CELL_SIGNS", 10)
    rows = [(k, "train", "q" * (5 + 10 * (k == 4)), "a", "s", "d", 1, 1, "c", False) for k in range(5)]
    book = zipfile.ZipFile(export.write_workbook(spark.createDataFrame(rows, "record_seq long, split string, question string, answer string, system string, source_doc string, page_start int, page_end int, chunk_id string, is_table boolean"), str(tmp_path)))
    names = [x.split('"')[0] for x in book.read("xl/workbook.xml").decode().split('sheet name="')[1:]]
    assert names == ["train", "train 2", "train 3", "val", "test"] and [book.read(f"xl/worksheets/sheet{k}.xml").decode().count("<row ") for k in range(1, 6)] == [3, 3, 2, 1, 1]
    last = book.read("xl/worksheets/sheet3.xml").decode()
    assert "q" * 10 in last and "q" * 11 not in last and "cut at 1" in last


def test_sql_functions(spark):
    assert "quire_words" in register_functions(spark)
    row = spark.sql("SELECT quire_words('a  b\u00a0c') AS n, quire_strip('\u00a0 x y\n') AS s, quire_key(' What, IS it? ') AS k, quire_lines('a\n\n b ') AS l, quire_paragraphs('a\nb\n \nc') AS p").first()
    assert (row.n, row.s, row.k, row.l, row.p) == (3, "x y", "what is it", ["a", "b"], ["a\nb", "c"])


def test_command_line(spark, sf_dir, tmp_path, capsys):
    from quirework.__main__ import main

    assert main(["queries"]) == 0 and "gate_verdicts" in capsys.readouterr().out
    assert main(["query", "no_such", sf_dir]) == 2 and main(["query", "run_stats", sf_dir, "--out", str(tmp_path / "stats")]) == 0
    assert spark.read.parquet(str(tmp_path / "stats")).count() == 1
    pages = [("a.pdf", 1, "word " * 60, None), ("b.pdf", 1, "text " * 50, ["h | v\n" + "x | y\n" * 30])]
    spark.createDataFrame(pages, "source_doc string, page_num int, text string, tables array<string>").write.parquet(str(tmp_path / "pages"))
    capsys.readouterr()
    assert main(["run"]) == 2 and main(["run", "--pages", str(tmp_path / "pages"), "--output-dir", str(tmp_path / "out"), "--min-answer-tokens", "5"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["total_chunks"] == 3


def test_run_lists_all_documents(spark, tmp_path):
    docs = documents.queue(spark, [f"/in/d{k:04}.pdf" for k in range(1203)])
    raw = docs.where("doc_seq < 2").select("source_doc", F.lit(1).alias("page_num"), F.lit("word " * 60).alias("raw_text"), F.array().cast("array<string>").alias("tables"))
    stop = threading.Event()
    stop.set()
    out = Path(Engine(spark, RunConfig(output_dir=str(tmp_path))).run(raw, docs, stop=stop).output_dir)
    info = json.loads((out / "run_info.json").read_text())
    assert out.name.endswith("d0000_plus1202_gemma4_12b") and info["source_pdfs"] == [f"d{k:04}.pdf" for k in range(1203)]
    assert (out / "run_info.json").read_text() == json.dumps(info, indent=2, ensure_ascii=False)


def test_sources(spark):
    lines = spark.createDataFrame([("100, 200",), ("bad",), ("x, 3",), ("50, 100",)], "value string")
    assert tuple(documents.sum_memory(lines).first()) == (150.0, 300.0) and documents.sum_memory(lines.limit(0)).count() == 0
    assert [r.name for r in documents.model_names(spark.createDataFrame([('{"models": [{"name": "m:1"}]}',), ("{",)], "raw string")).collect()] == ["m:1"]
    assert not documents.is_reachable("http://127.0.0.1:9", 0.2) and documents.list_models("http://127.0.0.1:9") == []


def test_stream_keeps_first_accepted(spark, tmp_path):
    schema = "record_seq long, system string, question string, answer string, source_doc string, page_start int, page_end int, chunk_id string, chunk_token_count int, is_table boolean"
    rows = lambda *ids: spark.createDataFrame([(k, "s", f"What is {k % 2}?", "word " * 12, "d", 1, 1, "c", 0, False) for k in ids], schema)
    for ids in ((2, 4), (6, 7)):
        rows(*ids).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        gate_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.record_seq for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 7]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
