"""WARC bundles and chat formatting: exact round trips."""

import hashlib
import os

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillbook.llm import chat, warc


@pytest.fixture
def folder(tmp_path):
    return f"file:{tmp_path}/bundles"


def odd_pages(spark):
    big = "x" * 1500
    rows = [(1, "http://a/", big), (9, "http://b/é \r\nX: y", big), (9, "http://b/é \r\nX: y", big), (5, None, big), (None, "u", big), (2, "u", "small"),
            (3, "u", "small"), (4, "u", None), (6, "u", ""), (7, "u", "é\r\n\r\nWARC/1.1\r\n" * 200_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("digest", F.lit(2))


def test_round_trip(spark, folder):
    pages = odd_pages(spark)
    index = warc.write(pages.repartition(2), folder, frame_bytes=4000, bundle_bytes=1)
    found = warc.read_back(index, folder).collect()
    rows = pages.collect()
    assert len(found) == len(rows) == index.count()
    payloads = {(str(r.page_id), r.html or "") for r in rows}
    for r in found:
        full = next(h for p, h in payloads if p == str(r.page) and hashlib.sha1(h.encode()).hexdigest() == r.payload_digest)
        assert r.payload_bytes == len(full.encode())
        assert (bytes(r.payload).decode() == full) if r.record_type == "response" else r.payload is None
    kinds = sorted((str(r.page), r.record_type, r.refers_to) for r in found)
    assert kinds == [("1", "revisit", "9"), ("2", "response", None), ("3", "response", None), ("4", "response", None), ("5", "revisit", "9"),
                     ("6", "response", None), ("7", "response", None), ("9", "response", None), ("9", "response", None), ("None", "revisit", "9")]


def test_bundles_are_seekable(spark, folder):
    index = warc.write(odd_pages(spark), folder, frame_bytes=4000)
    for name in {r.bundle for r in index.collect()}:
        reader = warc.Reader(folder, name)
        with open(f"{folder.removeprefix('file:')}/{name}", "rb") as file:
            whole = zstandard.ZstdDecompressor().stream_reader(file.read(), read_across_frames=True).read()
        assert whole == b"".join(reader.frame(i) for i in range(len(reader.entries)))
        assert whole.count(b"WARC-Record-ID: ") == sum(r.bundle == name for r in index.collect())
    row = index.filter("page = '2'").first()
    found = warc.fetch(index, folder, index.filter("page = '2'")).collect()
    assert [bytes(r.payload) for r in found] == [b"small"]
    data = warc.Reader(folder, row.bundle).frame(row.frame)[row.place:row.place + row.length]
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"small\r\n\r\n")


def test_damage_is_noticed(spark, folder):
    index = warc.write(odd_pages(spark).filter("page_id = 2"), folder)
    path = f"{folder.removeprefix('file:')}/{index.first().bundle}"
    data = bytearray(open(path, "rb").read())
    data[-10] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception):
        warc.Reader(folder, os.path.basename(path)).frame(0)


def test_empty_table(spark, folder):
    index = warc.write(odd_pages(spark).limit(0), folder)
    assert index.count() == 0 and warc.read_back(index, folder).count() == 0


CONTROL_TEXT = st.lists(st.sampled_from([*chat.INSTRUCT.controls, "\\", "[", "<", "/", "S", "]", ">", " ", "\n", "é", "INST]", "s>"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(CONTROL_TEXT, st.sampled_from(["system", "user", "assistant", "tool", ""]) | CONTROL_TEXT)
def test_escapes_come_back(text, role):
    parts = chat.INSTRUCT.segments(role, text)
    assert chat.INSTRUCT.unescape(chat.INSTRUCT.escape(text)) == text
    assert not any(c in chat.INSTRUCT.escape(text) for c in chat.INSTRUCT.controls)
    assert chat.INSTRUCT.parse("".join(p for p, _ in parts)) == (role, text)


def test_machine_and_digests(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b</s>"), (1, 2, "user", None), (1, 3, "assistant", "c"), (2, 0, "assistant", "x"),
            (2, 1, "user", "y"), (3, None, "user", "first"), (3, 0, "tool", "t"), (3, 1, None, "n"), (None, 0, "system", "s"), (None, 1, "user", "u"),
            (None, 2, "assistant", "é" * 100_000), (4, 0, "user", "same"), (4, 0, "user", "same"), (2**60 + 1, 0, "user", "u")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(1)).withColumn("state", F.lit(1))
    turns = chat.format_turns(frame)
    found = {r.conv: r for r in chat.read_turns(turns).collect()}
    by_conv = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or "")):
        by_conv.setdefault(None if c is None else str(c), []).append((role or "", text or ""))
    assert set(found) == set(by_conv)
    for c, own in by_conv.items():
        r = found[c]
        learned = "".join(t for role, t in own if role == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(learned)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert r.formatted_chars == sum(len(t) for a, b in own for t, _ in chat.INSTRUCT.segments(a, b))
    assert {c: (r.valid, r.fault_turn) for c, r in found.items()} == {
        "1": (True, None), "2": (False, 0), "3": (False, 1), None: (True, None), "4": (False, 1), str(2**60 + 1): (False, None)}
    assert chat.read_turns(chat.format_turns(frame.limit(0))).count() == 0


def test_long_conversation_streams(spark):
    frame = spark.range(30_000).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "repeat('w ', 20) AS text")
    (r,) = chat.read_turns(chat.format_turns(frame)).collect()
    assert (r.n_turns, r.loss_chars, r.valid) == (30_000, 15_000 * 40, True)
