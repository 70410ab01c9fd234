"""Licence scans by ordered signature rules, in DataFrame operations only.

A cheap search for anchor words in the raw text decides whether a text is looked at closely. Its
words are then joined by single spaces, and each rule whose keyword is there gives the intervals its
regular expression matches. Intervals are sorted by start, then longest first, then by priority; one
that lies inside an interval already taken is suppressed. Labels and the greatest confidence of the
intervals that are left are the verdict. Everything happens inside a row: no shuffle, no join.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, n_pieces, table
from .license_rules import ANCHORS, CC_BY, rules

BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"  # between words, before A-Z are lower case

#: The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def _places(phrase: str) -> Column:
    """The word positions at which a phrase stands in the words ws."""
    parts = phrase.split()
    hit = " and ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(parts))
    found = f"filter(sequence(0, size(ws) - {len(parts)}), i -> {hit})"
    return F.expr(f"if(contains(norm, ' {phrase} '), {found}, cast(array() as array<int>))")


def _hits() -> Column:
    """The rules that match norm: priority, label, confidence, and the texts between matches and of
    the matches. Keywords and patterns are constants of the plan, so each pattern is compiled once a
    task; rules of one keyword share its search. A match starts where the last one and the text
    between end (\\G), so a search goes over the text once."""
    by_keyword = defaultdict(list)
    for r in rules():
        by_keyword[r["keyword"]].append(r)
    norm = F.col("norm")
    groups = []
    for keyword, its in by_keyword.items():
        found = []
        for r in its:
            steps = F.lit(f"(?s)\\G(.*?)({r['pattern']})")
            hit = F.struct(
                F.lit(r["priority"]).alias("priority"), F.lit(r["label"]).alias("label"), F.lit(r["confidence"]).alias("confidence"),
                F.regexp_extract_all(norm, steps, F.lit(1)).alias("between"), F.regexp_extract_all(norm, steps, F.lit(2)).alias("match"),
            )
            found.append(F.when(norm.rlike(r["pattern"]), hit))
        groups.append(F.when(F.contains(norm, F.lit(keyword)), F.array(*found)))
    return F.filter(F.flatten(F.filter(F.array(*groups), lambda g: g.isNotNull())), lambda h: h.isNotNull())


def _detections() -> Column:
    """Every interval of the rules in hits: (start, minus end, priority, label, confidence). Starts
    are running sums of lengths, by blocks of 512 matches and then over the blocks, so a rule with
    very many matches costs no square of them."""
    return F.expr("""
        flatten(transform(hits, h -> aggregate(
          transform(sequence(0, (size(h.match) - 1) div 512), b -> aggregate(
            arrays_zip(slice(h.between, int(b * 512 + 1), 512), slice(h.match, int(b * 512 + 1), 512)),
            named_struct('at', 0, 'out', cast(array() as array<struct<start:int,length:int>>)),
            (s, z) -> named_struct('at', s.at + length(z.`0`) + length(z.`1`),
              'out', concat(s.out, array(named_struct('start', s.at + length(z.`0`), 'length', length(z.`1`))))))),
          named_struct('at', 0, 'out', cast(array() as array<struct<start:int,minus_end:int,priority:int,label:string,confidence:double>>)),
          (s, b) -> named_struct('at', s.at + b.at,
            'out', concat(s.out, transform(b.out, x -> named_struct('start', s.at + x.start, 'minus_end', -(s.at + x.start + x.length),
              'priority', h.priority, 'label', h.label, 'confidence', h.confidence)))),
          s -> s.out)))
        """)


def _kept() -> Column:
    """Labels and greatest confidence of the intervals that no taken interval contains."""
    return F.expr(
        """
        aggregate(array_sort(found), named_struct('end', -1, 'labels', cast(array() as array<string>), 'score', 0.0D),
          (s, d) -> if(-d.minus_end <= s.end, s, named_struct('end', -d.minus_end, 'labels', array_union(s.labels, array(d.label)), 'score', greatest(s.score, d.confidence))))
        """
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score (the greatest confidence, 0 where nothing is found).

    Null and empty texts have no word and no label (first_word and last_word null, labels empty);
    rows with equal ids each have their own row; null ids stay null. Extra columns are not read. An
    empty table gives no rows. Texts are searched whole at any length; detections of the same words
    go to the rule further up."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    low = rows.withColumn("low", F.lower("text"))
    gate = F.contains("low", F.lit("cc")) & F.col("low").rlike(CC_BY)
    for anchor in ANCHORS:
        gate = gate | F.contains("low", F.lit(anchor))
    low = low.select("doc_id", n_pieces(F.col("text"), BETWEEN).alias("n_words"), F.when(gate, F.col("text")).alias("close"))
    ws = low.withColumn("ws", F.when(F.col("close").isNotNull(), F.filter(F.split(F.translate("close", UPPER, LOWER), BETWEEN, -1), lambda w: w != "")))
    norm = ws.withColumn("norm", F.concat(F.lit(" "), F.array_join("ws", " "), F.lit(" ")))
    base = norm.select(
        "doc_id", "n_words", *[F.when(F.col("norm").isNotNull(), _places(p)).alias(label) for p, label in PHRASES.items()],
        F.when(F.col("norm").isNotNull(), _hits()).alias("hits"),
    )
    base = base.select("*", F.when(F.size("hits") > 0, _detections()).alias("found"))
    all_places = F.array_sort(F.concat(*[F.coalesce(f"`{label}`", F.array().cast("array<int>")) for label in PHRASES.values()]))
    labels = F.array_compact(F.array(*[F.when(F.size(F.col(f"`{label}`")) > 0, F.lit(label)) for label in PHRASES.values()]))
    out = base.select(
        "doc_id", "n_words", all_places.alias("at"), labels.alias("its"), F.when(F.col("found").isNotNull(), _kept()).alias("kept"),
    )
    every = F.array_union("its", F.coalesce("kept.labels", F.array().cast("array<string>")))
    return out.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort("its"), ",").alias("base_labels"), F.array_join(F.array_sort(every), ",").alias("labels"), F.coalesce("kept.score", F.lit(0.0)).alias("score"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
