"""Categories: keyword rules, a Naive Bayes model kept in tables, and both combined."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbook.functions import patterns as p
from quillbook.functions.text import word_tokens
from quillbook.operators.lets import let
from quillbook.session import materialize

Rules = Sequence[tuple[str, Sequence[str]]]


def rule_pick(rules: Rules = p.CATEGORY_KEYWORDS) -> Column:
    """'category|confidence' from ``_haystack`` and the two amounts.

    The first rule with a keyword inside the lower-cased description wins;
    Salary needs a credit. No join: one alternation per category.
    """
    haystack = F.col("_haystack")
    credit, debit = F.col("credit_amount"), F.col("debit_amount")
    hits = []
    for category, keywords in rules:
        hit = haystack.rlike("|".join(re.escape(k).replace("\\ ", " ") for k in keywords))
        if category == "Salary":
            hit = hit & (credit > 0)
        confidence = p.TRANSFER_CONFIDENCE if category == "Transfer" else p.RULE_CONFIDENCE
        hits.append((hit, category, confidence))
    hits.append(((credit > 0) & (debit == 0), "Income", p.FALLBACK_CONFIDENCE))
    hits.append((debit > 0, "Other Expense", p.FALLBACK_CONFIDENCE))
    pick = F.lit(f"Unknown|{p.UNKNOWN_CONFIDENCE}")
    for hit, category, confidence in reversed(hits):
        pick = F.when(hit, f"{category}|{confidence}").otherwise(pick)
    return pick


def with_rules(rows: DataFrame, rules: Rules = p.CATEGORY_KEYWORDS) -> DataFrame:
    """Add rule_category and rule_confidence."""
    padded = F.concat(F.lit(" "), F.lower("description"), F.lit(" "))
    return (
        let(let(rows, _haystack=padded), _pick=F.split(rule_pick(rules), "\\|"))
        .withColumns({"rule_category": F.col("_pick")[0], "rule_confidence": F.col("_pick")[1].cast("double")})
        .drop("_pick", "_haystack")
    )


def with_rule_table(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``with_rules`` for rules of any number in a table (priority, category, keyword).

    A category stands at its smallest priority. Distinct descriptions and
    keywords meet on the keyword's first three characters (all, if it has
    fewer), and then the whole keyword is looked for; no rule meets a
    description that has no such characters in common with it.
    """
    ranks = rules.groupBy("category").agg(F.min("priority").alias("rank"))
    keyed = rules.join(ranks, "category").select(
        "rank", "category", F.lower("keyword").alias("keyword"), F.left(F.lower("keyword"), F.lit(3)).alias("gram")
    ).filter("keyword <> ''").distinct()
    padded = F.concat(F.lit(" "), F.lower("description"), F.lit(" "))
    grams = F.expr(
        "array_distinct(flatten(transform(sequence(1, 3), n -> transform(sequence(1, length(padded) - n + 1), i -> substr(padded, i, n)))))")
    texts = rows.select("description").distinct().filter("description IS NOT NULL").withColumn("padded", padded)
    first = F.min(F.struct("rank", "category"))
    hits = (
        texts.select("description", "padded", F.explode(grams).alias("gram")).join(keyed, "gram")
        .filter(F.contains("padded", "keyword")).groupBy("description")
        .agg(first.alias("_any"), F.min(F.when(F.col("category") != "Salary", F.struct("rank", "category"))).alias("_plain"))
    )
    credit, debit = F.col("credit_amount"), F.col("debit_amount")
    hit = F.when(credit > 0, F.col("_any.category")).otherwise(F.col("_plain.category"))
    category = (
        F.when(hit.isNotNull(), hit).when((credit > 0) & (debit == 0), "Income").when(debit > 0, "Other Expense").otherwise("Unknown")
    )
    confidence = (
        F.when(hit == "Transfer", p.TRANSFER_CONFIDENCE).when(hit.isNotNull(), p.RULE_CONFIDENCE)
        .when(category == "Unknown", p.UNKNOWN_CONFIDENCE).otherwise(p.FALLBACK_CONFIDENCE)
    )
    return rows.join(hits, "description", "left").select(
        *rows.columns, category.alias("rule_category"), confidence.cast("double").alias("rule_confidence"))


def training_texts(spark: SparkSession) -> DataFrame:
    """The built-in labelled texts: label, class_order, text."""
    rows = [(label, i, text) for i, (label, texts) in enumerate(p.TRAINING_TEXTS) for text in texts]
    return spark.createDataFrame(rows, "label string, class_order int, text string")


class NaiveBayesTables:
    """Word counts per class and class totals of a labelled table.

    ``labelled``: label, class_order (rank of the class, decides ties), text.
    """

    def __init__(self, labelled: DataFrame) -> None:
        tokens = labelled.select("label", "class_order", F.explode(F.expr(word_tokens("text"))).alias("token"))
        self.words = tokens.groupBy("label", "class_order", "token").agg(F.count("*").alias("n"))
        docs = labelled.groupBy("label", "class_order").agg(F.count("*").alias("docs"))
        sizes = self.words.groupBy("label").agg(
            F.sum("n").alias("token_total"), F.count("*").alias("distinct_tokens")
        )
        self.classes = docs.join(sizes, "label", "left").na.fill(0, ["token_total", "distinct_tokens"])
        self.vocabulary = self.words.agg(F.count_distinct("token").alias("size"))

    def class_array(self) -> Column:
        """Scalar: classes in rank order, with log prior and the denominators."""
        size = self.vocabulary.select(F.greatest("size", F.lit(1)).alias("size")).scalar()
        listed = self.classes.agg(
            F.array_sort(F.collect_list(F.struct("class_order", "label", "docs", "token_total"))).alias("c"),
            F.sum("docs").alias("n"),
            F.count("*").alias("k"),
        )
        prepared = listed.withColumn("_v", size).select(
            F.expr("""transform(c, x -> named_struct('class_order', x.class_order, 'label', x.label,
                'prior', ln((x.docs + 1) / (n + k)), 'denominator', cast(x.token_total + _v as double)))""").alias("c")
        )
        return prepared.scalar()

    def token_scores(self, classes: Column) -> DataFrame:
        """token, scores: log likelihood per class, in rank order."""
        counts = F.map_from_entries(F.collect_list(F.struct("class_order", "n")))
        return (
            self.words.groupBy("token").agg(counts.alias("_n"))
            .withColumn("_classes", classes)
            .select("token", F.expr(
                "transform(_classes, c -> ln((coalesce(try_element_at(_n, c.class_order), 0) + 1) / c.denominator))"
            ).alias("scores"))
        )


def score_descriptions(descriptions: DataFrame, model: NaiveBayesTables) -> DataFrame:
    """description, nb_category, nb_confidence of each distinct description.

    Each distinct text is scored once; tokens meet the model in one join.
    """
    classes = model.class_array()
    tokens = descriptions.select("description").distinct().select(
        "description", F.explode_outer(F.expr(word_tokens("description"))).alias("token")
    )
    matched = tokens.join(model.token_scores(classes), "token", "left").withColumn("_classes", classes)
    unseen = F.expr("transform(_classes, c -> ln(1 / c.denominator))")
    each = F.when(F.col("token").isNotNull(), F.coalesce("scores", unseen))
    summed = (
        matched.groupBy("description").agg(F.collect_list(each).alias("_each"))
        .withColumn("_classes", classes)
        .withColumn("_score", F.expr(
            "aggregate(_each, transform(_classes, c -> c.prior), (acc, x) -> zip_with(acc, x, (a, b) -> a + b))"
        ))
    )
    weights = summed.withColumn("_weight", F.expr("transform(_score, s -> exp(s - array_max(_score)))"))
    best = F.expr("cast(array_position(_weight, array_max(_weight)) as int)")
    total = F.expr("aggregate(_weight, 0D, (acc, w) -> acc + w)")
    return weights.select(
        "description",
        F.element_at("_classes", best)["label"].alias("nb_category"),
        (F.array_max("_weight") / total).alias("nb_confidence"),
    )


def classify(rows: DataFrame, model: NaiveBayesTables, rules: Rules = p.CATEGORY_KEYWORDS) -> DataFrame:
    """Add category, classification_method, confidence.

    A rule of .72 or more stands; otherwise the model decides from .45 on, and
    the rule's fallback below that. Rows that a rule decides take no part in the
    scoring and in its join.
    """
    ruled = materialize(with_rules(rows, rules))
    decided = ruled.filter(F.col("rule_confidence") >= p.RULE_ACCEPT)
    undecided = ruled.filter(F.col("rule_confidence") < p.RULE_ACCEPT)
    scored = score_descriptions(undecided.select("description"), model)
    by_model = F.coalesce(F.col("nb_confidence") >= p.MODEL_ACCEPT, F.lit(False))

    def chosen(df: DataFrame, category: Column, method: Column, confidence: Column) -> DataFrame:
        return df.select(*rows.columns, category.alias("category"), method.alias("classification_method"), confidence.alias("confidence"))

    return chosen(decided, F.col("rule_category"), F.lit("heuristic"), F.col("rule_confidence")).unionByName(chosen(
        undecided.join(scored, "description", "left"),
        F.when(by_model, F.col("nb_category")).otherwise(F.col("rule_category")),
        F.when(by_model, "machine_learning").otherwise("heuristic"),
        F.when(by_model, F.col("nb_confidence")).otherwise(F.col("rule_confidence")),
    ))
