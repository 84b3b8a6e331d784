"""Files read by ranges of bytes against the same files read whole."""

import random

import pytest

from quillbook.sources import files

FILES = {
    "plain.csv": b"a,b\n1,2\n\n3,4\n",
    "breaks.csv": b'x,"one\ntwo, ""three""\n\nfour",y\r\nnext,"line\r\nbreak"\r\nlast,1',
    "stray.csv": b'5" pipe,a"b\n"closed"tail"s,z\nq,"open\nto the end, "" of\nthe file\n',
    "open.csv": b'a,"never closed',
    "returns.csv": b'a,b\rc,"d\re"\r\r\nf\r\rg\n\r\n',
    "marked.csv": "﻿\"q,\n\",z\n﻿kept,1\n".encode(),
    "bytes.csv": b"caf\xc3\xa9,\xff\xfe,1\n\xe2\x82,2\n",
    "one.csv": b"\"",
    "empty.csv": b"",
    "blank.csv": b" \n\n\t\n",
}


def random_file(draw):
    return "".join(draw.choice(['"', '"', ",", "\n", "\n", "\r\n", "\r", "a", "bc", "é"]) for _ in range(draw.randint(1, 80))).encode()


@pytest.fixture
def ranges(spark, monkeypatch):
    """Sets the bytes of a range for the files themselves, and no longer for the tables made of them."""
    original, known = files._file_lines, spark.conf.get("spark.sql.files.maxPartitionBytes")

    def of(size):
        def lines(*arguments):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            try:
                return original(*arguments)
            finally:
                spark.conf.set("spark.sql.files.maxPartitionBytes", known)

        monkeypatch.setattr(files, "_file_lines", lines)

    return of


@pytest.mark.parametrize("size", ["7b", "1m"])
def test_equal_to_whole_files(spark, tmp_path, ranges, size):
    draw = random.Random(4)
    every = FILES | {f"random{i}.csv": random_file(draw) for i in range(20)}
    for name, content in every.items():
        (tmp_path / name).write_bytes(content)
    whole, bad = files.delimited_rows(files.read_files(spark, str(tmp_path)))
    wanted = {(r.file_name, r.row_no): r.cells for r in whole.collect()}
    ranges(size)
    rows, rejects = files.delimited_scan(spark, str(tmp_path))
    got = {(r.file_name, r.row_no): r.cells for r in rows.collect()}
    rejected = {r.file_name for r in rejects.collect()}
    assert {k: (got.get(k), wanted.get(k)) for k in got.keys() | wanted.keys() if got.get(k) != wanted.get(k)} == {}
    assert rejected == {r.file_name for r in bad.collect()}


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path, ranges):
    with open(tmp_path / "large.csv", "w") as file:
        for i in range(20_000):
            file.write(f'{i},"text {i}\nmore",{"x" * (i % 30)}\n')
    ranges("64k")
    assert files._file_lines(spark, str(tmp_path)).select("split").distinct().count() > 5
    rows = files.delimited_scan(spark, str(tmp_path))[0].collect()
    assert len(rows) == 20_000 and all(int(r.cells[0]) == r.row_no - 1 and r.cells[1] == f"text {r.row_no - 1}\nmore" for r in rows)
