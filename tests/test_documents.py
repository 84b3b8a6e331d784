import random

import pytest
from pyspark.sql import functions as F

from quillbook.operators import documents, layout, registry, retrieval
from quillbook.plans.corpus import answer_questions, index_documents
from quillbook.plans.uploads import process_uploads
from quillbook.sources import files


def windows_by_rule(text, size, overlap):
    """From all places of all breaks: a window ends after the last one of the first kind that has any beyond its middle."""
    places = {m: [k for k in range(len(text)) if text.startswith(m, k)] for m in documents.BREAKS}
    ends, start = [], 0
    while start < len(text):
        last = [max((k + len(m) for k in places[m] if start + size / 2 < k <= start + size - len(m)), default=0) for m in documents.BREAKS]
        ends.append((start, next(filter(None, last), start + size) if start + size < len(text) else start + size))
        start = ends[-1][1] - overlap
    return [text[a:b].strip() for a, b in ends]


def test_windows_follow_the_rule(spark):
    draw = random.Random(1)
    rows = []
    for _ in range(200):
        size = draw.choice([5, 8, 10, 20, 50])
        overlap = min(draw.choice([0, 1, 2, 3, size // 2 - 1]), (size - 1) // 2)
        rows.append(("".join(draw.choice("ab. \n") for _ in range(draw.randint(1, 200))), size, overlap))
    df = spark.createDataFrame(rows, "text string, size int, overlap int")
    got = df.select("*", F.expr(documents.windows("text", "size", "overlap")).alias("w")).collect()
    assert all(r.w == windows_by_rule(r.text, r.size, r.overlap) for r in got)


@pytest.mark.parametrize("rows_per_block", [1, 1 << 16])
def test_chunk_index_runs_through_the_document(spark, rows_per_block):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b " * 900), (1, 2, "c"), (2, 0, "d")], "document_id long, element_no long, text string")
    got = documents.chunk_structured(df, rows_per_block=rows_per_block).orderBy("document_id", "chunk_index").collect()
    assert [(r.document_id, r.chunk_index) for r in got] == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 0)]
    documents.register_chunk_function(spark)
    assert spark.sql("SELECT count(*) FROM chunk_text(repeat('b ', 900), 1000, 200)").first()[0] == 3  # the last one repeats the tail


def test_fixed_chunks(spark):
    text = "".join(chr(97 + i % 26) for i in range(25))
    df = spark.createDataFrame([(1, text), (2, "   ")], "document_id int, text string")
    got = documents.chunk_fixed(df, 10, 4)
    assert [r.text for r in got.orderBy("chunk_no").collect()] == [text[i : i + 10] for i in range(0, 25, 6)]
    assert [r.document_id for r in documents.unchunked(df, got).collect()] == [2]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfDate,"Desc, x",Amount\n\n01/02/2024,"two\nlines ""q""",5.00\n,,\na,b\n')
    (tmp_path / "b.txt").write_bytes(b" \n\t\n")
    (tmp_path / "c.txt").write_bytes(b"%PDF one\xff\n\ftwo")
    (tmp_path / "big.txt").write_bytes(b"x" * 2000)
    read = files.read_files(spark, str(tmp_path), 1000)
    kinds = {r.file_name: (r.size, r.looks_like_statement, r.loader, r.content_hash is None) for r in files.file_inventory(read).collect()}
    assert kinds["c.txt"] == (14, True, "pdf", False) and kinds["big.txt"] == (2000, True, "text", True)
    lines, empty = files.text_statements(read)
    assert [(r.page_no, r.text) for r in lines.filter("file_name = 'c.txt'").orderBy("line_no").collect()] == [(1, "%PDF one"), (1, "two")]
    rejected = {r.file_name: r.error for r in empty.collect()}
    assert rejected == {"b.txt": "The uploaded bank statement is empty.", "big.txt": "File exceeds size limit (2000 bytes)"}
    assert lines.join(empty, "file_name").count() == 0 and {r.file_name for r in lines.select("file_name").distinct().collect()} == {"a.csv", "c.txt"}
    assert files.read_files(spark, str(tmp_path)).filter("content IS NULL").count() == 0
    rows = files.delimited_rows(read.filter("file_name = 'a.csv'"))[0].orderBy("row_no").collect()
    assert [(r.row_no, r.cells) for r in rows] == [
        (1, ["Date", "Desc, x", "Amount"]), (3, ["01/02/2024", 'two\nlines "q"', "5.00"]), (4, ["", "", ""]), (5, ["a", "b"]),
    ]


def test_stray_quotes(spark):
    text = 'a,5" pipe,1\nb,plain,2\nc,6" pipe,3\n"say ""hi""",x"y"z,4\n"glued"tail,,5\n"open, and\nnever closed'
    read = spark.createDataFrame([("q.csv", text.encode()), ("e.csv", b" \n"), ("l.csv", None)], "file_name string, content binary").withColumn("size", F.lit(1))
    rows, rejects = files.delimited_rows(read)
    assert [r.cells for r in rows.filter("file_name = 'q.csv'").orderBy("row_no").collect()] == [
        ["a", '5" pipe', "1"], ["b", "plain", "2"], ["c", '6" pipe', "3"], ['say "hi"', 'x"y"z', "4"], ["gluedtail", "", "5"],
        ["open, and\nnever closed"]]
    assert sorted(r.file_name for r in rejects.collect()) == ["e.csv", "l.csv"]


def test_exports_agree(spark, tmp_path):
    df = spark.sql(
        "SELECT 'f' file_name, 1L pos, 0 sub, '2024-01-01' date, 'A, \"b\"' description, 5.00BD debit_amount, 0.00BD credit_amount,"
        " 1.00BD balance, 'Food' category, 0.93456D confidence UNION ALL SELECT 'f', 2L, 0, 'bad', 'B', 5.00BD, 0.00BD, 1.00BD, 'Food', 1D"
    )
    for fmt in ("csv", "parquet"):
        files.write_transactions(df, str(tmp_path / fmt), fmt)
    as_csv = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "csv")).first()
    as_parquet = spark.read.parquet(str(tmp_path / "parquet")).first()
    assert [str(v) for v in as_csv] == [str(v) for v in as_parquet] and as_parquet.confidence == 0.935
    with pytest.raises(ValueError):
        files.write_transactions(df, str(tmp_path / "x"), "xls")


def tokens(spark, *boxes):
    rows = [("f", 1, i, t, cx - 5.0, cx + 5.0, cy - h / 2, cy + h / 2, float(cx), float(cy)) for i, (t, cx, cy, h) in enumerate(boxes)]
    return spark.createDataFrame(rows, "file_name string, page_no int, token_no long, text string, x0 double, x1 double, y0 double, y1 double, cx double, cy double")


def test_lines_follow_the_running_mean(spark):
    boxes = [("b", 50, 101, 20.0), ("a", 10, 100, 20.0), ("c", 90, 107, 20.0), ("next", 10, 130, 20.0), ("tiny", 20, 145, 2.0)]
    got = layout.token_lines(tokens(spark, *boxes)).orderBy("line_no").collect()
    assert [r.text for r in got] == ["a b c", "next", "tiny"]


def test_a_page_of_many_tokens(spark):
    df = spark.range(20_000).selectExpr("'f' file_name", "1 page_no", "id token_no", "concat('w', id) text", "id % 10 * 50D - 5 x0", "id % 10 * 50D + 5 x1",
                                        "(id div 10) * 20D - 9 y0", "(id div 10) * 20D + 9 y1", "id % 10 * 50D cx", "(id div 10) * 20D + id % 3 cy")
    got = layout.token_lines(df).orderBy("line_no").collect()
    assert len(got) == 2000 and got[7].text == " ".join(f"w{i}" for i in range(70, 80))


def test_exact_top_k_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    stored, asked = rng.normal(size=(300, 8)), rng.normal(size=(5, 8))
    frame = lambda key, m: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{key} long, embedding array<float>")
    got = retrieval.vector_top_k(frame("chunk_id", stored).repartition(4), frame("query_id", asked), 3).collect()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    distance = 1 - unit(asked) @ unit(stored).T
    wanted = {(q, r + 1): int(c) for q in range(5) for r, c in enumerate(np.argsort(distance[q])[:3])}
    assert {(r.query_id, r["rank"]): r.chunk_id for r in got} == wanted
    with pytest.raises(ValueError):
        retrieval.vector_top_k(frame("chunk_id", stored), frame("query_id", asked), 21)


def test_near_ties_and_repeated_questions(spark):
    chunks = spark.createDataFrame([(1, [1.0, 5e-4]), (2, [1.0, 0.0])], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [3.0, 0.0])], "query_id long, embedding array<double>")
    assert retrieval.vector_top_k(chunks, asked, 1).first().chunk_id == 2  # nearer by 1.25e-7
    assert [r.chunk_id for r in retrieval.vector_top_k_lsh(chunks, asked, 2).orderBy("rank").collect()] == [2, 1]  # of another length
    parts = spark.createDataFrame([(1, n, f"some words {n}") for n in range(6)], "document_id long, chunk_no long, text string")
    twice = spark.createDataFrame([(10, 1, "words"), (11, 1, "words")], "query_id long, document_id long, question string")
    assert sorted(r.query_id for r in retrieval.keyword_top(parts, twice).collect()) == [10] * 4 + [11] * 4
    odd = spark.createDataFrame([(1, 0, None, "a"), (1, 1, "s", None), (1, 2, "s", "b")], "document_id long, n long, section string, text string")
    assert retrieval.section_context(odd, "n").first().context == "[]\na\n\n[s]\n\n\n[s]\nb"


def test_add_chunks_needs_equal_ids(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 1, {"p": "1"}), ("b", 1, {})], "chunk_id string, document_id long, m map<string,string>")
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "chunk_id string, embedding array<float>")
    store = str(tmp_path / "store")
    for _ in range(2):  # a retry replaces its own run
        registry.add_chunks(chunks, vectors, store, F.col("m"), run="one")
        assert registry.stored_chunks(spark, store).count() == 2
    wanted = spark.createDataFrame([(1,), (5,)], "document_id long")
    assert registry.stored_chunks(spark, store, wanted).count() == 2 and registry.stored_chunks(spark, store, wanted.filter("document_id = 5")).count() == 0
    with pytest.raises(ValueError):
        registry.add_chunks(chunks.unionByName(chunks), vectors.unionByName(vectors), store)
    with pytest.raises(ValueError):
        registry.add_chunks(chunks, vectors.limit(1), store)
    assert spark.read.parquet(store).count() == 2


def test_index_and_answer(spark, tmp_path):
    uploads = spark.createDataFrame(
        [(1, "a.txt", "alpha\nbeta", 10, 1), (2, "statement.pdf", "x", 1, 1), (3, "c.exe", "x", 1, 1), (4, "d.md", " ", 1, 1),
         (5, "e.md", "gamma\nunreadable", 1, 1), (6, "f.md", "alpha\nbeta", 1, 1)],
        "document_id long, filename string, text string, size long, ts long",
    )

    def vectors(texts):
        if any("unreadable" in t for t in texts):
            raise RuntimeError("no vector")
        return [[float("alpha" in t), float("beta" in t), 0.1] for t in texts]

    def reply(prompts):
        if "fail" in prompts[0]:
            raise RuntimeError("down")
        return ["ok"]

    store = str(tmp_path / "store")
    indexed = index_documents(uploads, vectors, store, run="first")
    state = {r.document_id: (r.status, r.chunk_count, r.error_message) for r in registry.registry_state(indexed.registry_log).collect()}
    assert state == {1: ("indexed", 2, None), 4: ("error", 0, "The uploaded document is empty."), 5: ("error", 0, "no vector"), 6: ("indexed", 2, None)}
    assert [r.document_id for r in indexed.rejected.collect()] == [3]
    assert sorted((r.document_id, r.text) for r in registry.stored_chunks(spark, store).collect()) == [
        (1, "alpha"), (1, "beta"), (6, "alpha"), (6, "beta")]
    chunks = indexed.chunks.filter("document_id = 1").withColumn("section", F.lit("s"))
    asked = spark.createDataFrame([(1, "beta?"), (2, "fail alpha")], "query_id long, question string")
    got = {r.query_id: r for r in answer_questions(asked, chunks, vectors, reply, 1).collect()}
    assert got[1].context == "[Source: a.txt, Section: s]\nbeta" and got[1].answer == "ok"
    assert (got[2].answer, got[2].answer_error) == (None, "down")


def test_upload_job(spark, tmp_path):
    statement = "Date Description Debit Credit Balance\n01/02/2024 SHOP 5.00 0.00 95.00\n02/02/2024 PAY 5.00 0.00 90.00\n"
    sent = [(1, "statement_a.txt", statement), (2, "bank_statement.txt", "nothing of that kind"), (3, "notes.md", "alpha"), (4, "x.exe", "x"),
            (5, "empty.txt", " "), (6, "statement_a.txt", statement)]
    uploads = spark.createDataFrame([(i, n, t.encode(), len(t), 1) for i, n, t in sent], "document_id long, filename string, content binary, size long, ts long")
    done = process_uploads(uploads, lambda texts: [[1.0] for _ in texts], str(tmp_path / "store"))
    state = {r.document_id: (r.status, r.chunk_count) for r in registry.registry_state(done.registry_log).collect()}
    assert state == {1: ("indexed", 2), 2: ("indexed", 1), 3: ("indexed", 1), 5: ("error", 0), 6: ("indexed", 2)}
    assert [r.document_id for r in done.rejected.collect()] == [4]
    assert sorted(r.document_id for r in done.chunks.collect()) == [2, 3]
    files.write_statement_export(done.statements, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "transactions")).count() == 4
    assert spark.read.parquet(str(tmp_path / "out" / "summary")).count() == 3 and spark.read.parquet(str(tmp_path / "out" / "validation")).count() == 15


def test_structured_query_checks_names(spark):
    df = spark.range(3).withColumn("g", F.col("id") % 2)
    with pytest.raises(ValueError):
        registry.structured_query(df, "group", {"by": ["nope"], "measures": {}})
    with pytest.raises(ValueError):
        registry.structured_query(df, "drop", {})
    total = registry.structured_query(df, "aggregate", {"where": [("id", ">", 0)], "measures": {"s": ("sum", "id")}})
    assert total.first().s == 3
