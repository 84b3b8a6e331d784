"""Token alignment against whole-text encodings and every pair of byte ranges."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillbook.llm import alignment

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(alignment.BYTE_LEVEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    with open(alignment.BYTE_LEVEL) as file:
        vocab = {i: t for t, i in json.load(file)["model"]["vocab"].items()}
    return a, b, vocab


def plain_ranges(tools, text):
    """[(id, start, end)] of both tokenizers, or None."""
    a, b, vocab = tools
    if not text:
        return None
    table = alignment.byte_of_character()
    sides = []
    for ids, bytes_of in (
        (a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(table[c] for c in vocab[i])),
        (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())):
        at, out, joined = 0, [], b""
        for i in ids:
            out.append((i, at, at + len(bytes_of(i))))
            joined += bytes_of(i)
            at = out[-1][2]
        if joined != (" " + text).encode():
            return None
        sides.append(out)
    return sides


def plain_align(tools, rows):
    found = [(i, plain_ranges(tools, t)) for i, t in rows]
    links = {n: [(x[0], y[0]) for x in r[0] for y in r[1] if x[1] < y[2] and y[1] < x[2]] for n, (_, r) in enumerate(found) if r}
    count = Counter(p for some in links.values() for p in some)
    highest = defaultdict(int)
    for (_, y), n in count.items():
        highest[y] = max(highest[y], n)
    out = []
    for n, (i, r) in enumerate(found):
        if not r:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({x[2] for x in r[0]} & {y[2] for y in r[1]})
        groups = ";".join("|".join(",".join(str(x[0]) for x in side if start < x[2] <= end) for side in r)
                          for start, end in zip([0, *ends], ends, strict=False))
        mine = links[n]
        out.append((i, len(r[0]), len(r[1]), len(ends), len(mine), sum(count[p] == highest[p[1]] for p in mine),
                    sum(count[p] for p in mine), hashlib.sha256(groups.encode()).hexdigest()))
    return sorted(out, key=str)


ODD = ["", None, " ", "  ", "\n", "a ", " a", "a  b\t c\r\n", "<|endoftext|> <s> x</s><unk>", "▁", "x ▁y", "naïve café ﬁne", "日本語 と 中文。", "👩‍👩‍👧 ok",
       "a b  c", "zero\x00byte", "don't we'll I'M", "12345 678,90", "  　x", "\x1c \x1f a", "é" * 50, "ab" * 300, "x" * 3000]


def random_texts(n):
    draw = random.Random(3)
    letters = list("abc dE '1 2.\n\t ") + ["é", "ß", "日", " ", " ", "👍", " ", "▃", "\x1d"]
    return ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(n)]


def test_galloping_search():
    draw = random.Random(5)
    for _ in range(300):
        longer = sorted(draw.sample(range(400), draw.randint(1, 200)))
        shorter = sorted({*draw.sample(range(longer[-1] + 1), min(longer[-1], draw.randint(0, 20))), longer[-1]})
        assert alignment.gallop(shorter, longer) == np.searchsorted(longer, shorter).tolist()


def test_chunks_are_encoded_as_whole_texts_are(tools):
    a, b, _ = tools
    with open(alignment.BYTE_LEVEL, "rb") as x, open(alignment.PIECES, "rb") as y:
        pair = alignment.Pair(x.read(), y.read())
    assert pair.cuts
    for text in ODD + random_texts(3000):
        ids, plain = pair.encode(text or ""), plain_ranges(tools, text)
        assert (ids is None) == (plain is None), repr(text)
        if ids:
            assert [i.tolist() for i in ids] == [[x[0] for x in side] for side in plain], repr(text)


def test_against_every_pair_of_ranges(spark, tools, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 2000)
    rows = [(n % 40, t) for n, t in enumerate(ODD + random_texts(60))] + [(None, "a  b"), (None, "a  b"), (7, "a  b")]
    docs = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, block int, pair string")
    got = alignment.align(docs).collect()
    assert sorted(map(tuple, got), key=str) == plain_align(tools, rows)
    assert alignment.align(docs.limit(0)).count() == 0


def test_given_documents(spark, tools, monkeypatch):
    monkeypatch.setattr(alignment, "LINKS_AT_ONCE", 5000)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.filter("length(text) < 4000").collect()]
    got = alignment.align(docs.filter("length(text) < 4000"), with_groups=True).collect()
    assert sorted((tuple(r)[:8] for r in got), key=str) == plain_align(tools, rows)
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got if r.groups)
