"""Fielded keyword search, semantic ranking and their merge."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import padded_id, search_text, whole_word
from .vectors import dot

#: Fields of a query, bare numbers of a family, and words that say nothing about a title (Q1, Q4).
FIELD = r'(?<![A-Za-z0-9_])(research\s+family|family|id|subject|topic|lean)\s*:\s*(?:"([^"]+)"|(\S+))'
NUMBER = r"(?<![A-Za-z0-9_])(?:research\s+)?family\s+#?(\d+)(?![A-Za-z0-9_])"
QUIET = tuple("how what why can does do is are a an the of to in for with about well closely mathematical result theorem".split())


@dataclass
class Query:
    fields: dict[str, str] = field(default_factory=dict)
    words: list[str] = field(default_factory=list)
    plain: str = ""
    raw: str = ""


def parse_query(text: str) -> Query:
    """``key:value`` and ``key:"a b"`` become fields, the last of a key counts, and so does ``family #7``; the rest are words (Q1)."""
    fields: dict[str, str] = {}

    def take(m: re.Match) -> str:
        fields["family" if m[1].startswith("research") else m[1]] = m[2] or m[3]
        return " "

    def number(m: re.Match) -> str:
        fields["family"] = m[1]
        return " "

    rest = re.sub(NUMBER, number, re.sub(FIELD, take, search_text(text)))
    return Query(fields, rest.split(), rest.strip(), text or "")


def title_words(query: Query) -> list[str]:
    """Words of a query that count for a title, each as often as it occurs."""
    return [w for w in re.findall("[a-z]+", search_text(query.raw)) if w not in QUIET]


def wants_semantic(query: Query, backend: bool = True) -> bool:
    """Whether a query is worth an embedding: no field, a letter and three characters (Q3)."""
    return backend and not query.fields and len(query.raw.strip()) >= 3 and bool(re.search("[a-zA-Zπ]", query.raw))


def lexical_search(items: DataFrame, query: Query) -> DataFrame:
    """items(id, title, subject, lean, body; texts normalised) -> id, score. Every word must match; one filter in one scan (Q2).

    A family's number goes before an id, a subject before a topic. The id is part of the text.
    """
    text = F.concat_ws(" ", "id", "title", "subject", "body")
    title, topic = F.coalesce("title", F.lit("")), F.coalesce("subject", F.lit(""))
    own = padded_id(F.col("id"))
    where: Column = F.lit(True)
    if number := query.fields.get("family") or query.fields.get("id"):
        where &= own == number.rjust(3, "0")
    if subject := query.fields.get("subject") or query.fields.get("topic"):
        where &= topic.contains(subject)
    if "lean" in query.fields:
        where &= F.coalesce("lean", F.lit(False)) == F.lit(query.fields["lean"] in ("1", "true", "yes"))
    score: Column = F.lit(0)
    for w in query.words:
        same = own == w.rjust(3, "0")
        where &= same | text.contains(w) if re.fullmatch("[0-9]+", w) else whole_word(text, w) if len(w) <= 3 else text.contains(w)
        score = score + F.when(same, 100).otherwise(0) + F.when(title.contains(w), 10).otherwise(0) + F.when(topic.contains(w), 5).otherwise(0)
    return items.where(where).select("id", score.cast("long").alias("score"))


def semantic_search(items: DataFrame, vector: list[float], title_words: list[str], k: int = 20) -> DataFrame:
    """Cosine with the item's search vector, or its vector without one, plus a bonus per query word in the title; the best 20 (Q4)."""
    if "search_vector" in items.columns:
        items = items.withColumn("vector", F.coalesce("search_vector", "vector"))
    bonus: Column = F.lit(0.0)
    for w in title_words:
        bonus = bonus + F.when(whole_word(F.col("title"), w), 0.12 if w == "pi" else 0.025).otherwise(0.0)
    score = F.round(dot(F.col("vector"), F.array(*(F.lit(float(x)) for x in vector))) + bonus, 6)
    return items.where("vector IS NOT NULL").select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def combine(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Literal hits first, then semantic ones not among them (Q5): id, part, score."""
    rest = semantic.join(lexical.select("id"), "id", "left_anti")
    return lexical.select("id", F.lit(0).cast("long").alias("part"), F.col("score").cast("double").alias("score")).unionByName(rest.select("id", F.lit(1).cast("long").alias("part"), "score"))


def anchor(items: DataFrame, text: str) -> DataFrame:
    """The item of this id in any case, else the first whose title contains the text (Q6)."""
    t = search_text(text)
    exact, title = F.lower(F.col("id").cast("string")) == t, F.lower("title").contains(t)
    hits = items.where(exact | title)
    return hits.agg(F.min_by("id", F.struct(F.when(exact, 0).otherwise(1), "id")).alias("id"))
