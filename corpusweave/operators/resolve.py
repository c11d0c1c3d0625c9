"""Conservative entity resolution of citation records.

Merging depends on the order of records: a veto looks at the groups as they are by then. Candidate edges without any
veto give components, and inside each the rules are replayed in record order, which equals replaying them globally
because no merge crosses a component. What is replayed is narrow (identifiers, hashes, surname, year); texts stay in
their table, and the search for known titles inside citations is a join on each title's rarest word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import arxiv, ascii_words, doi
from ..sources.parsers import plain_tex
from .graph import components
from .tables import cut

#: Records of a key in a part, and pairs made by one task.
RECORDS_OF_KEY, PAIRS_OF_TASK = 4096, 1 << 22
#: Identifiers in a raw citation (F7), and a year (F8).
RAW_DOI = r"10\.\d{4,9}/[^\s{}\"<>\\]+"
RAW_ARXIV = r"(?i)(?:arxiv\.org/(?:abs|pdf|html)/|arxiv\s*:\s*)([^\s{}\"<>\\]+)"
WHOLE_DOI = r"10\.\d{4,9}/\S+"
YEAR = r"\b(?:18|19|20)\d{2}\b"
#: Reasons of a merge, in the order of their rules.
IDENTIFIER, CITATION, TITLE, INSIDE = "identifier", "identical citation", "title and author", "exact title in citation"


def norm(value: str) -> str:
    """TeX as text, then lower-case ASCII letters and digits, one blank between words (F2)."""
    return ascii_words(plain_tex(value))


def identifiers(declared_doi: str, declared_arxiv: str, raw: str) -> set[str]:
    """doi: and arxiv: keys of a record; none at all where it names several of a kind, as a collection does.

    A declared DOI counts alone, otherwise all in the raw text do; what is no whole DOI is none.
    """
    dois = {doi(x) for x in ([declared_doi] if declared_doi else re.findall(RAW_DOI, raw or ""))}
    dois = {x for x in dois if re.fullmatch(WHOLE_DOI, x)}
    found = {arxiv(x) for x in (declared_arxiv, *re.findall(RAW_ARXIV, raw or ""))} - {""}
    if max(len(dois), len(found)) > 1:
        return set()
    return {f"doi:{x}" for x in dois} | {f"arxiv:{x}" for x in found}


def first_surname(authors: str) -> str:
    """Of the first author the last word of two letters or more, before a comma if there is one."""
    first = re.split(r"\s+and\s+|;", authors or "")[0].partition(",")
    return next((w for w in reversed(norm(first[0]).split()) if len(w) > 1), "")


KEYS = T.StructType([T.StructField("ids", T.ArrayType(T.StringType())), *(T.StructField(c, T.StringType()) for c in ("text", "title", "surname")), T.StructField("year", T.IntegerType())])


def keys(title: str, authors: str, year: str, citation: str, raw: str, declared_doi: str, declared_arxiv: str) -> dict:
    """What a record can be matched by. The year is that of its field alone."""
    found = re.search(YEAR, year or "")
    return {"ids": sorted(identifiers(declared_doi, declared_arxiv, raw)), "text": norm(citation), "title": norm(title), "surname": first_surname(authors), "year": int(found[0]) if found else None}


@F.pandas_udf(KEYS)
def match_keys(title: pd.Series, authors: pd.Series, year: pd.Series, citation: pd.Series, raw: pd.Series, d: pd.Series, a: pd.Series) -> pd.DataFrame:
    made = [keys(*(v or "" for v in x)) for x in zip(title, authors, year, citation, raw, d, a, strict=True)]
    out = pd.DataFrame(made, columns=["ids", "text", "title", "surname", "year"])
    return out.astype({"year": "Int32"})


class Groups:
    """Union-find whose merges, unless by identifier, are refused between groups of disjoint DOIs or disjoint arXiv ids.

    The later record's group takes the other in; ``merged`` counts by reason, ``refused`` lists what was turned down.
    """

    def __init__(self, ids: list[Iterable[str]]):
        self.parent, self.ids = list(range(len(ids))), [set(x) for x in ids]
        self.merged: Counter = Counter()
        self.refused: list[tuple[int, int, str]] = []

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def apart(self, a: int, b: int) -> bool:
        for kind in ("doi:", "arxiv:"):
            x, y = ({k for k in self.ids[r] if k.startswith(kind)} for r in (a, b))
            if x and y and not x & y:
                return True
        return False

    def merge(self, i: int, j: int, reason: str) -> None:
        a, b = self.find(i), self.find(j)
        if a == b:
            return
        if reason != IDENTIFIER and self.apart(a, b):
            self.refused.append((i, j, reason))
            return
        self.parent[b] = a
        self.ids[a] |= self.ids[b]
        self.merged[reason] += 1


def titled(title: str, surname: str) -> bool:
    """Long enough to be matched together with its author (E5)."""
    return len(title.split()) >= 3 and len(title) >= 20 and bool(surname)


def replay(records: list[dict]) -> Groups:
    """Merge records, given in order with ids, text, title, surname, year and inside: by identifier, by equal citation, by
    title and surname with years at most 3 apart or unknown; then each record of ``inside``, the known titles its citation
    holds (places of their first records), into the one group that has them, if it is one (E3-E6)."""
    groups = Groups([r["ids"] for r in records])
    by_id: dict[str, int] = {}
    by_text: dict[str, int] = {}
    by_title: dict[tuple, list[int]] = {}
    for i, r in enumerate(records):
        for x in sorted(r["ids"]):
            groups.merge(i, by_id.setdefault(x, i), IDENTIFIER)
        groups.merge(i, by_text.setdefault(r["text"], i), CITATION)
        if titled(r["title"], r["surname"]):
            same = by_title.setdefault((r["title"], r["surname"]), [])
            for j in same:
                if r["year"] is None or records[j]["year"] is None or abs(r["year"] - records[j]["year"]) <= 3:
                    groups.merge(i, j, TITLE)
            same.append(i)
    for i, r in enumerate(records):
        hit = {groups.find(j) for j in r["inside"]}
        if len(hit) == 1:
            groups.merge(i, hit.pop(), INSIDE)
    return groups


def known_titles(keyed: DataFrame) -> DataFrame:
    """v, title, surname: the first record of each title of at least four words and 28 characters with an author."""
    long = (F.size(F.split("title", " ")) >= 4) & (F.length("title") >= 28) & (F.col("surname") != "")
    return keyed.where(long).groupBy("title", "surname").agg(F.min("record").alias("v"))


def titles_inside(keyed: DataFrame) -> DataFrame:
    """u, v for each untitled record u whose citation holds the known title of v as a phrase, and its author as a word.

    Joined on the title's rarest word among those of more than three letters; a title without such a word is not sought.
    Texts are joined to the candidates only, so none is repeated for each of its words.
    """
    untitled = keyed.where("untitled").select(F.col("record").alias("u"), "text")
    long = lambda c: F.filter(F.array_distinct(F.split(c, " ")), lambda w: F.length(w) > 3)
    known = cut(known_titles(keyed).select("v", "title", "surname", F.explode(long("title")).alias("word")))
    words = untitled.select("u", F.explode(long("text")).alias("word"))
    words = cut(words.join(known.select("word").distinct(), "word", "left_semi"))
    count = words.groupBy("word").agg(F.count("*").alias("n"))
    rare = known.join(count, "word", "left").groupBy("v", "title", "surname").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return words.join(rare, "word").join(untitled, "u").where(spaced("text").contains(spaced("title")) & spaced("text").contains(spaced("surname"))).select("u", "v")


def near_years(records: DataFrame, most: int) -> DataFrame:
    """records(id, title, surname, y: a whole number or null) -> a < b of one title and surname whose years are at most ``most`` apart or unknown (E5).

    A record meets others under each year near its own, so only pairs of the result are made; a key's records are dealt
    to parts of ``RECORDS_OF_KEY``, and keys to as many tasks as the pairs ask for.
    """
    key = ["title", "surname", "y"]
    rows = cut(records.where("title IS NOT NULL AND surname IS NOT NULL").select("id", *key), "records")
    # Under the year null, a record meets those of any year; of two without a year, the pair is made once.
    known, unknown = rows.where("y IS NOT NULL"), rows.where("y IS NULL")
    near = F.explode(F.sequence(F.col("y").cast("long") - most, F.col("y").cast("long") + most))
    sides = []
    for left, right, by in ((known.withColumn("by", F.col("y").cast("long")), known.select("id", "title", "surname", near.alias("by")), ["title", "surname", "by"]),
                            (unknown, rows, ["title", "surname"])):
        n = right.groupBy(*by).agg(F.count("*").alias("n"))
        met = left.groupBy(*by).agg(F.count("*").alias("m")).join(n.hint("merge"), by).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
        each = left.groupBy(*by).agg(F.count("*").alias("n")).hint("merge")  # by sorting: neither side is to go through the driver
        parts = F.ceil(F.col("n") / RECORDS_OF_KEY).cast("int")
        dealt = left.join(each, by).select(F.col("id").alias("a"), F.col("y").alias("ya"), *by, F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
        copies = right.join(each, by).select(F.col("id").alias("b"), *by, *(["y"] if "y" in right.columns else []), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        tasks = max(1, -(-met // PAIRS_OF_TASK))
        both = dealt.repartition(tasks, *by, "part").join(copies.repartition(tasks, *by, "part").hint("merge"), [*by, "part"])
        if "by" in by:
            sides.append(both.where("a < b").select("a", "b"))
        else:
            sides.append(both.where("a <> b AND (y IS NOT NULL OR a < b)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return sides[0].unionAll(sides[1])


OUTCOME = "kind string, a long, b long, reason string"


def _replayed(records: list[dict]) -> Iterator[tuple]:
    """member: record and the first of its group; merge: number by reason; refused: record, the other, reason."""
    place = {r["record"]: i for i, r in enumerate(records)}
    groups = replay([r | {"inside": [place[v] for v in r["inside"] or ()], "ids": r["ids"] or ()} for r in records])
    first: dict[int, int] = {}
    for i, r in enumerate(records):
        yield "member", r["record"], first.setdefault(groups.find(i), r["record"]), None
    for reason, n in groups.merged.items():
        yield "merge", n, None, reason
    for i, j, reason in groups.refused:
        yield "refused", records[i]["record"], records[j]["record"], reason


@dataclass
class Resolution:
    """records as keyed, members(record, first), merges(reason, n) and conflicts(record, other, reason)."""

    records: DataFrame
    members: DataFrame
    merges: DataFrame
    conflicts: DataFrame


def resolution(records: DataFrame) -> Resolution:
    """records(record, title, authors, year, citation, raw, doi, arxiv, url, source, families) -> the replayed merges."""
    keyed = records.withColumn("k", match_keys("title", "authors", "year", "citation", "raw", "doi", "arxiv"))
    own = [c for c in records.columns if c not in ("title", "year")]
    keyed = keyed.select(*own, F.col("title").alias("shown"), F.col("year").alias("shown_year"), "k.ids", "k.text", "k.title", "k.surname", "k.year",
                         (F.coalesce("title", F.lit("")) == "").alias("untitled"), F.sha2(F.concat(F.lit("text:"), "k.text"), 256).alias("digest"))
    keyed = cut(keyed)
    inside = cut(titles_inside(keyed))
    long = (F.size(F.split("title", " ")) >= 3) & (F.length("title") >= 20) & (F.col("surname") != "")
    name = F.when(long, F.array(F.sha2(F.concat_ws("|", F.lit("title"), "title", "surname"), 256))).otherwise(F.array().cast("array<string>"))
    stars = keyed.select("record", F.explode(F.concat("ids", F.array("digest"), name)).alias("key"))
    edges = stars.join(stars.groupBy("key").agg(F.min("record").alias("v")), "key").select(F.col("record").alias("u"), "v")
    roots = components(edges.unionAll(inside).where("u <> v")).withColumnRenamed("node", "record")
    held = inside.groupBy(F.col("u").alias("record")).agg(F.array_sort(F.collect_set("v")).alias("inside"))
    narrow = keyed.select("record", "ids", F.col("digest").alias("text"), "title", "surname", "year").join(roots, "record").join(held, "record", "left")
    parted = narrow.repartition("root").sortWithinPartitions("root", "record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            group, at = [], None
            for batch in batches:
                for row in batch.to_pylist():
                    root = row.pop("root")
                    if group and root != at:
                        yield from _replayed(group)
                        group = []
                    at = root
                    group.append(row)
            if group:
                yield from _replayed(group)

        rows = made()
        while part := list(islice(rows, 10_000)):
            kind, a, b, reason = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(reason, pa.string())], names=["kind", "a", "b", "reason"])

    done = cut(parted.mapInArrow(run, OUTCOME))
    grouped = done.where("kind = 'member'").select(F.col("a").alias("record"), F.col("b").alias("first"))
    alone = keyed.select("record", F.col("record").alias("first")).join(roots.select("record"), "record", "left_anti")
    merges = done.where("kind = 'merge'").groupBy("reason").agg(F.sum("a").alias("n"))
    conflicts = done.where("kind = 'refused'").select(F.col("a").alias("record"), F.col("b").alias("other"), "reason")
    return Resolution(keyed, cut(grouped.unionAll(alone)), merges, conflicts)


@F.pandas_udf(T.StringType())
def _search_address(title: pd.Series) -> pd.Series:
    return title.map(lambda t: "https://scholar.google.com/scholar?q=" + quote((t or "")[:220]))


def link(key: Column, url: Column, title: Column) -> Column:
    """The DOI's address, else the arXiv paper's, else the group's first http address, else a search for the title."""
    plain = F.replace(F.replace(url, F.lit("\\_"), F.lit("_")), F.lit("\\%"), F.lit("%"))
    return (F.when(key.startswith("doi:"), F.concat(F.lit("https://doi.org/"), F.substring(key, F.lit(5), F.length(key))))
            .when(key.startswith("arxiv:"), F.concat(F.lit("https://arxiv.org/abs/"), F.substring(key, F.lit(7), F.length(key))))
            .when(F.length(plain) > 0, plain).otherwise(_search_address(title)))


def works(found: Resolution) -> DataFrame:
    """A canonical work per group (E8, E9, A8-A10): work, title, authors, year, url, identifiers, families, sources (the first
    record's source for each family), records.

    The key is the least DOI, else the least identifier, else the best record's normalised citation. Best is the record with a
    title, identifiers, authors and the longest citation, the first of equals; an untitled work is called by its citation.
    """
    rows = found.records.join(found.members, "record")
    text = lambda c: F.coalesce(c, F.lit(""))
    rank = F.struct((text("shown") != "").alias("t"), (F.size("ids") > 0).alias("i"), (text("authors") != "").alias("a"), F.length(text("citation")).alias("c"), (-F.col("record")).alias("r"))
    web = F.when(F.coalesce(F.col("url").startswith("http://") | F.col("url").startswith("https://"), F.lit(False)), F.col("record"))
    best = F.max_by(F.struct("shown", "authors", "shown_year", "citation", "digest"), rank).alias("best")
    main = rows.groupBy("first").agg(best, F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("identifiers"), F.min_by("url", web).alias("url"), F.array_sort(F.collect_list("record")).alias("records"))
    each = rows.select("first", "record", "source", F.explode("families").alias("family")).groupBy("first", "family").agg(F.min_by(text("source"), F.col("record")).alias("source"))
    sides = each.groupBy("first").agg(F.sort_array(F.collect_list(F.struct("family", "source"))).alias("pairs"))
    main = main.join(sides, "first", "left")
    doi_key = F.try_element_at(F.filter("identifiers", lambda x: x.startswith("doi:")), F.lit(1))
    key = F.coalesce(doi_key, F.try_element_at("identifiers", F.lit(1)), F.lit(""))
    main = main.withColumn("key", key).withColumn("title", F.when(text("best.shown") != "", F.col("best.shown")).otherwise(text("best.citation")))
    pairs = F.coalesce("pairs", F.array().cast("array<struct<family:string,source:string>>"))
    return main.select(
        F.substring(F.when(F.col("key") != "", F.sha2("key", 256)).otherwise(F.col("best.digest")), 1, 16).alias("work"), "title", F.col("best.authors").alias("authors"), F.col("best.shown_year").alias("year"),
        link(F.col("key"), F.coalesce("url", F.lit("")), F.col("title")).alias("url"), "identifiers", F.transform(pairs, lambda p: p["family"]).alias("families"), F.map_from_entries(pairs).alias("sources"), "records")


def audit(found: Resolution) -> DataFrame:
    """A row per record: first (its group's first record), record, citation, source and families, so that variants of a work lie side by side."""
    return found.records.join(found.members, "record").select("first", "record", "citation", "source", "families")


def resolve(records: DataFrame) -> DataFrame:
    """records -> canonical works."""
    return works(resolution(records))
