"""Licence scan, line dedup, quality rules and token counts against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import compare
from quillbook.llm import licenses, line_dedup, quality, token_counts

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def plain_scan(text):
    words = re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for p in licenses.PHRASES:
        for i in range(len(words)):
            if words[i:i + len(p.words)] == p.words:
                starts.append(i)
                labels.add(p.label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_scan_matches_brute_force(spark, docs):
    texts = ["x " * i + t.text.upper() + "\nMIT  licence" for i, t in enumerate(licenses.TEXTS)]
    texts += [None, "", "Apache LICENSE apache-license cc-by CC\nBY; gnu General\npublic   license GPL MIT license", "MIT K license İ mit license",
              "cc by " * 30_000, "é" * 70_000]
    some = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    found = licenses.scan(some).collect()
    assert len(found) == docs.count() + len(texts)
    for r in found:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_scan(r.text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert (r.score == 1.0) if r.n_base else (0 <= r.score <= 1)
    labels = {r.text: r.labels for r in found}
    for t, text in zip(licenses.TEXTS, texts, strict=False):
        assert t.label in labels[text].split(",")


def test_scan_needs_key_phrases_and_reports_share(spark):
    mit = licenses.TEXTS[0].words
    moved = mit[:9] + ["now"] + mit[9:]
    rows = [(1, " ".join(moved)), (2, " ".join(mit).replace("free of charge", "for a fee")), (3, " ".join(mit[3:])), (4, " ".join(mit[:12]))]
    found = {r.k: r for r in licenses.scan(spark.createDataFrame(rows, "k long, text string")).collect()}
    assert found[1].labels == "mit-text" and 0 < found[1].score < 1
    assert found[2].labels == "" and found[2].score == 0 and found[2].spans == []
    assert found[3].labels == ""
    assert licenses.scan(spark.createDataFrame([], "text string, labels int")).columns[:2] == ["text", "labels"]


def test_scan_is_native(docs):
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def plain_lines(html):
    text = re.sub(line_dedup.HIDDEN, "", html or "")
    text = re.sub(line_dedup.BREAKS, "\n", text)
    text = re.sub(line_dedup.SPACES, " ", re.sub(line_dedup.TAGS, "", text))
    return [x.strip(" ") for x in text.split("\n") if x.strip(" ")]


def test_boilerplate_matches_brute_force(spark):
    rows = [(i, "http://User@Site.example:80/x", f"<p>Menu</p><p>page {i}</p><script>x</script><P>Menu</P>") for i in range(6)]
    rows += [(i, "https://small.example/?q", "<p>only</p>") for i in (20, 21)] + [(22, "https://alone.example/", "<p>kept</p>")]
    rows += [(i, "https://three.example/", f"<p>text {i}</p><footer>Imprint</footer>") for i in (23, 24, 25)]
    rows += [(30, None, "<p>Menu</p>"), (31, "http://site.example/", None), (32, "no url", ""), (33, "http://site.example", "<b>un\x0b closed"),
             (None, "http://site.example/", "<li>other<li>page 1"), (1, "http://User@Site.example:80/x", rows[1][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lines", F.lit(1)).withColumn("page", F.lit(2))
    hosts = [(re.match(line_dedup.HOST, (u or "").lower()) or [None, ""])[1] for _, u, _ in rows]
    wanted = []
    for (page, _, html), host in zip(rows, hosts, strict=True):
        own = [plain_lines(h) for (_, _, h), x in zip(rows, hosts, strict=True) if x == host]
        lines = plain_lines(html)
        bad = {x for x in lines if host and len(own) >= 2 and sum(x in o for o in own) > 0.5 * len(own)}
        kept = [x for x in lines if x not in bad]
        wanted.append((page, host, len(lines), len(lines) - len(kept), "\n".join(kept)))
    found = [tuple(r) for r in line_dedup.drop_boilerplate(pages).collect()]
    assert sorted(map(str, found)) == sorted(map(str, wanted)) and any(r[3] for r in found)
    assert line_dedup.drop_boilerplate(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op3_line_dedup", "op4_warc", "op8_chat_format"])
def test_queries_match_sql(spark, name):
    assert compare.run(spark, compare.connect(FOLDER), FOLDER, name) is None


def plain_counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dups = set(), 0
    for line in lines:
        dups += line in seen
        seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    again = {w for w in set(windows) if windows.count(w) > 1} if len(windows) < 3000 else None
    covered = {i + k for i, w in enumerate(windows) if again is not None and w in again for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(covered)


def test_rule_counts_match_brute_force(docs):
    texts = [r.text for r in docs.select("text").collect()] + ["", " \n ", "a a a", "a a a a", "x\ny\nx\n\nx", "a b c", "é # ||\x1c", "a b c a b c"]
    for text in texts:
        if len(text or "") < 15_000:
            assert tuple(quality.statistics(text or "")[0]) == plain_counts(text)
    assert quality.statistics("word " * 100_000)[0] == [100_000, 400_000, 0, 0, 100_000]


def test_verdicts_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    forest = quality.fit(docs, labels.filter("doc_id % 2 = 0"))
    judged = quality.judge(docs, forest).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").collect()
    good, bad = ([r.kept for r in judged if r.quality == q] for q in (1, 0))
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.2


def test_forest_scores_match_path_walks():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(300, 3))
    forest = quality.grow(x, x.min(0), x.max(0), trees=5, sample=64)
    for row, score in zip(x[:20], forest.scores(x[:20]), strict=True):
        lengths = []
        for feature, split, length in zip(forest.feature, forest.split, forest.length, strict=True):
            node = 0
            while feature[node] >= 0:
                node = 2 * node + (2 if row[feature[node]] >= split[node] else 1)
            lengths.append(length[node])
        assert score == pytest.approx(2 ** (-np.mean(lengths) / quality.mean_path(np.array([64]))[0]))
    assert forest.scores(np.array([[50.0, 50, 50]]))[0] > forest.scores(x).mean()


def test_judging_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "plain words here " + " ".join(f"w{i}" for i in range(100)), 2), (4, "x " * 80, 3), (4, "x " * 80, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, KEPT int")
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, labels) is None and quality.fit(docs.limit(0), labels.limit(0)) is None
    judged = quality.judge(docs, None)
    assert judged.columns[:3] == docs.columns and len(judged.columns) == 11
    assert sorted((str(r[0]), r[-1]) for r in judged.collect()) == [("1", False), ("2", False), ("4", False), ("4", False), ("None", True)]
    assert quality.passing(docs, labels).columns == docs.columns and quality.passing(docs, labels).count() == 1
    assert quality.judge(docs.limit(0), None).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.Vocabulary.load()


ALPHABET = ["a", "B", " ", " ", "\n", "'s", "'l", "é", "9", "12", "!", "…", "　", "\x1c", "word ", "漢字", "\t", "  ", "🙂"]


def test_edits_match_full_counts(vocabulary):
    draw = random.Random(2)
    for trial in range(120):
        text = "".join(draw.choice(ALPHABET) for _ in range(draw.choice([0, 3, 300, 3000])))
        tree = token_counts.Tree(text, *token_counts.Tree.sums(text, vocabulary))
        assert tree.tokens[1] == vocabulary.count(text) and tree.chars[1] == len(text)
        for _ in range(12):
            start, length = draw.randint(-3, len(text) + 5), draw.choice([0, 1, 5, 400, 5000])
            new = "".join(draw.choice(ALPHABET) for _ in range(draw.choice([0, 1, 4, 900])))
            at = max(0, min(start, len(text)))
            text = text[:at] + new + text[min(at + length, len(text)):]
            tree.edit(start, length, new, vocabulary)
            assert tree.text() == text and tree.tokens[1] == vocabulary.count(text) and tree.chars[1] == len(text)


def test_edits_encode_little(vocabulary):
    text = "some plain words, again and again. " * 3000
    tree = token_counts.Tree(text, *token_counts.Tree.sums(text, vocabulary))
    assert tree.edit(50_000, 4, "more", vocabulary) < 1000


def test_recount_and_edit_table(spark, docs, vocabulary):
    rows = [r for r in docs.select("doc_id", "text").limit(40).collect()]
    todo = {r.doc_id: [(3, 2, "new words "), (10, 0, None), (-1, 5, "x"), (10**6, 1, " end")] for r in rows[:30]}

    def edited(text, edits):
        for start, length, new in edits:
            at = max(0, min(start, len(text)))
            text = text[:at] + (new or "") + text[min(at + length, len(text)):]
        return text

    wanted = {r.doc_id: (vocabulary.count(r.text), vocabulary.count(edited(r.text, todo.get(r.doc_id, [])))) for r in rows}
    some = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
    edits = spark.createDataFrame([(i, k, *e) for i, es in todo.items() for k, e in enumerate(es)] + [(None, 0, 0, 0, "x"), (-9, 0, 0, 0, "x")],
                                  "doc_id long, seq int, start int, length int, text string")
    found = token_counts.apply_edits(some, edits).collect()
    assert {r.doc_id: (r.n_tokens, r.new_tokens) for r in found} == wanted
    assert {r.n_edits for r in found} == {0, 4}
    arrays = spark.createDataFrame([(i, es) for i, es in todo.items()], f"doc_id long, tree {token_counts.EDITS}")
    trees = token_counts.with_trees(some.join(arrays, "doc_id", "left"))
    assert {r.doc_id: (r.n_tokens, r.new_tokens) for r in token_counts.recount(trees, "tree").collect()} == wanted


def test_token_edge_rows(spark):
    rows = [(None, None, None), (1, "", [(0, 0, "hello")]), (1, "", [(0, 0, "hello")]), (2, "a" * 200_000, [None, (5, 1, "b")]), (3, "one two", [])]
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {token_counts.EDITS}")
    found = token_counts.recount(token_counts.with_trees(df), "edits").collect()
    assert sorted((str(r.doc_id), r.new_chars) for r in found) == [("1", 5), ("1", 5), ("2", 200_000), ("3", 7), ("None", 0)]
    assert token_counts.with_trees(df.limit(0)).count() == 0
    none = spark.createDataFrame([], "doc_id long, seq int, start int, length int, text string")
    assert token_counts.apply_edits(df.limit(0), none).count() == 0
    assert token_counts.apply_edits(df, none).count() == len(rows)


def test_op10_matches_full_counts(spark, vocabulary):
    from quillbook.llm.queries import op10_token_counts

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = op10_token_counts(spark, FOLDER).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {i: vocabulary.count(t or "") for i, t in texts.items()}
    # the edits once more, on whole texts
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    places = docs.select("doc_id", *[F.pmod(F.xxhash64("doc_id", F.lit(i)), F.length(text) + 1).alias(f"p{i}") for i in range(4)])
    new = {}
    for r in places.collect():
        t = texts[r.doc_id] or ""
        t = t[:r.p0] + t[r.p1:r.p1 + 40] + t[r.p0:]
        at = min(r.p2, len(t))
        t = t[:at] + t[at + 24:]
        at = min(r.p3, len(t))
        t = t[:at] + "edited words" + t[at + 8:]
        new[r.doc_id] = (vocabulary.count(t), len(t))
    assert {r.doc_id: (r.new_tokens, r.new_chars) for r in found} == new


def test_threshold_and_trees_come_from_all_labelled_rows(spark):
    """More rows than the 20,000 that were once taken."""
    import numpy as np

    n = 24_000
    docs = spark.range(n).selectExpr(
        "id AS doc_id", "array_join(transform(sequence(1, 60), i -> concat('w', hash(id, i) % (10 + id % 37), repeat('x', cast(id % 11 AS int)))), ' ') AS text")
    forest = quality.fit(docs, docs.selectExpr("doc_id", "1 AS quality"))
    passed = [(c, x) for c, x in (quality.statistics(r.text) for r in docs.collect())]
    failed = quality.base_failed(np.array([c for c, _ in passed]))
    scores = np.sort(forest.scores(np.array([x for _, x in passed])[~failed]))
    assert len(scores) > 20_000
    assert forest.threshold == pytest.approx((scores[int(np.ceil(0.998 * len(scores))) - 1] + 1) / 2, abs=1e-12)
    values = spark.createDataFrame([(float(v),) for v in np.random.default_rng(5).integers(0, 50, 400) / 7], "score double")
    ordered = sorted(r.score for r in values.collect())
    assert [quality.value_at(values, rank) for rank in (0, 1, 200, 399)] == [ordered[rank] for rank in (0, 1, 200, 399)]
