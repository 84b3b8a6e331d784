"""Source divergence against SQL and a plain version; transducers against sorted lists."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quillbook.llm import divergence
from quillbook.llm.transducer import Transducer

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_audit(rows, least):
    """Rows (lang, source, part, item, value, rank) of (text, lang, source)."""
    rows = [(t or "", lang or "", s or "") for t, lang, s in rows]
    seen, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        seen[lang].update(set(plain_terms(text)))
        sources[lang].add(source)
    kept = {lang: sorted((t for t, n in c.items() if n >= least), key=str.encode) for lang, c in seen.items()}
    for text, lang, source in rows:
        for t in plain_terms(text):
            if seen[lang][t] >= least:
                counts[lang, source][t] += 1
    out = []
    for lang, names in sources.items():
        terms = kept.get(lang, [])

        def share(c, terms=terms):
            total = sum(c.values())
            return {t: 1 + 10 ** 9 * (c[t] + 2) // (total + 2 * len(terms)) for t in terms}

        p = {s: share(counts[lang, s]) for s in names}
        q = share(sum((counts[lang, s] for s in names), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in names:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in terms), o.encode(), o) for o in names if o != s]
            first = [(-f(p[s][t], q[t]), t.encode(), t) for t in terms if counts[lang, s][t] and p[s][t] > q[t]]
            for part, some in (("pair", sorted(pairs)), ("term", sorted(first)[:10])):
                out += [(lang, s, part, item, -v, rank) for rank, (v, _, item) in enumerate(some, 1)]
    return sorted(out)


def test_transducer_gives_places_in_byte_order():
    draw = random.Random(1)
    for n in (0, 1, 2, 50, 2000):
        terms = sorted({"".join(draw.choice("abcé日") for _ in range(draw.randint(1, 9))) for _ in range(n)}, key=str.encode)
        made = Transducer.unpack(*Transducer.of([t.encode() for t in terms]).pack())
        asked = [t.encode() for t in terms] + [b"zz", b"a" * 12, "é".encode()[:1], b"abcabcabcabcd"]
        wanted = [terms.index(a.decode(errors="replace")) if a.decode(errors="replace") in terms else -1 for a in asked]
        assert made.ordinals(np.array(asked, "S40")).tolist() == wanted
        assert n < 2000 or len(made.final) < sum(len(t.encode()) for t in terms) / 2


def test_shares_are_exact_for_large_counts():
    draw = random.Random(2)
    total = np.array([draw.randrange(1, 2 ** 52) for _ in range(500)] + [1, 7])
    counts = np.array([draw.randrange(t + 1) for t in total.tolist()])
    assert divergence.shares(counts, total).tolist() == [1 + 10 ** 9 * c // t for c, t in zip(counts.tolist(), total.tolist(), strict=True)]


@pytest.mark.parametrize("small", [False, True])
def test_against_a_plain_version(spark, monkeypatch, small):
    if small:  # many transducers, passes and blocks
        for name, value in (("TERMS_A_SHARD", 7), ("PASS_BYTES", 900), ("COUNTS_AT_ONCE", 20), ("BLOCK_TERMS", 5)):
            monkeypatch.setattr(divergence, name, value)
    draw = random.Random(3)
    words = ["the", "The", "THE", "é", "É", "ñandú", "日本", "a1b", "x_y", "don't", "l’eau", "ab", "abc", "abcd", "K"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(draw.choices(words, k=draw.randint(0, 40))), draw.choice(["en", "fr", "", None]), draw.choice(["a", "b", "Ç", "", None])) for _ in range(120)]
    rows += [(None, "de", "only"), ("", "es", "x"), (None, "es", "y"), ("lone words here", "es", None), ("w" * 5000 + " the", "en", "a")] + [rows[0]] * 5
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "text string, lang string, source string, ordinal int, kept string")
    got = sorted(map(tuple, divergence.audit(docs, least=4).collect()))
    assert got == plain_audit(rows, 4)
    if small:
        assert divergence.audit(docs.limit(0)).count() == 0
        assert divergence.audit(docs.select(docs.text.cast("string"), "lang", "source"), least=1000).filter("value <> 0 or part = 'term'").count() == 0


def test_given_documents_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = sorted(map(tuple, divergence.audit(spark.read.parquet(f"{folder}/documents.parquet")).select(
        "lang", "source", "part", "item", "value", "rank").collect()))
    with duckdb.connect() as connection:
        connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        assert got == sorted(connection.sql(divergence.expected_sql()).fetchall()) and len(got) > 100
