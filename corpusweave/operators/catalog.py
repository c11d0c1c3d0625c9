"""Catalogue upkeep and display data: filters, gates, prefixes, places on a map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import whole_word


def changed_views(events: DataFrame, names: tuple[str, ...], most: int = 100) -> DataFrame:
    """events(id, client, ts, name, value) of the listed names, without those equal to the client's one before.

    Values are cut to ``most`` characters, as the feature asks.
    """
    fine = events.where(F.col("name").isin(*names)).withColumn("value", F.substring("value", 1, most))
    before = F.lag(F.struct("name", "value")).over(Window.partitionBy("client").orderBy("ts", "id"))
    return fine.withColumn("before", before).where(~F.col("before").eqNullSafe(F.struct("name", "value"))).select("id", "client", "name", "value")


def viewport(points: DataFrame, width: float, height: float, pad_x: float = 65.0, pad_y: float = 110.0, drop: float = 15.0) -> DataFrame:
    """points(id, x, y) -> id, x, y on a screen: one scale for both axes, centred; ``drop`` moves all down."""
    box = points.agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("low", F.min), ("high", F.max))))
    span = lambda c, size: size / (F.col(f"high_{c}") - F.col(f"low_{c}"))
    box = box.withColumn("scale", F.least(span("x", width - pad_x), span("y", height - pad_y)))
    place = lambda c, mid: F.round(mid + (F.col(c) - (F.col(f"high_{c}") + F.col(f"low_{c}")) / 2) * F.col("scale"), 6).alias(c)
    return points.crossJoin(F.broadcast(box)).select("id", place("x", width / 2), place("y", height / 2 + drop))  # the box is one row


def nearest_within(queries: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """queries(id, x, y), points(id, x, y) -> id, hit, distance: the nearest other point closer than ``radius``, the least id first.

    Cells as wide as the radius turn the search into an equi-join with the nine cells around a query.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    p = points.select(F.col("id").alias("hit"), F.col("x").alias("px"), F.col("y").alias("py"), cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.array(*(F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    q = queries.select("id", "x", "y", F.explode(around).alias("c")).select("id", "x", "y", "c.cx", "c.cy")
    d = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2)
    near = q.join(p, ["cx", "cy"]).where(F.col("id") != F.col("hit")).withColumn("distance", F.round(d, 6)).where(F.col("distance") < radius)
    best = F.min(F.struct("distance", "hit"))
    return near.groupBy("id").agg(best.alias("b")).select("id", "b.hit", "b.distance")


def extremes(scores: DataFrame, key: str, k: int = 8) -> DataFrame:
    """scores(key, id, score) -> the k best (side ``top``) and k worst (side ``bottom``) of each key."""
    def side(name: str, order: Column) -> DataFrame:
        by = Window.partitionBy(key).orderBy(order, "id")
        return scores.select(key, "id", "score", F.lit(name).alias("side"), F.row_number().over(by).cast("long").alias("rank")).where(F.col("rank") <= k)

    return side("top", F.desc("score")).unionAll(side("bottom", F.asc("score")))


def cited_entries(entries: DataFrame, cites: DataFrame) -> DataFrame:
    """entries(directory, file, key, ...) without the unused: those of a ``.bib`` file whose directory has cite keys, none of them ``*``, and not this one."""
    cites = cites.select("directory", "key").distinct()
    known = cites.groupBy("directory").agg(F.max(F.col("key") == "*").alias("__all"))
    used = cites.withColumn("__used", F.lit(True))
    unused = F.col("file").endswith(".bib") & F.col("__all").isNotNull() & ~F.col("__all") & F.col("__used").isNull()
    joined = entries.join(known, "directory", "left").join(used, ["directory", "key"], "left")
    return joined.where(~F.coalesce(unused, F.lit(False))).select(*entries.columns)


def release_gate(entries: DataFrame, key: str) -> DataFrame:
    """entries(key, complete, identity, sound) -> key, total, complete, identities, released: all complete and sound under one identity."""
    done, sound = F.coalesce("complete", F.lit(False)), F.coalesce("sound", F.lit(False))
    gate = entries.groupBy(key).agg(F.count("*").alias("total"), F.count_if(done).alias("complete"), F.count_distinct("identity").alias("identities"), F.count_if(done & ~sound).alias("unsound"))
    return gate.select(key, "total", "complete", "identities", ((F.col("total") == F.col("complete")) & (F.col("identities") == 1) & (F.col("unsound") == 0)).alias("released"))


def coverage(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Each key's distinct values of the columns, sorted and comma-joined."""
    return rows.groupBy(key).agg(*(F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",").alias(c) for c in columns))


def unique_prefix(asked: DataFrame, directories: DataFrame) -> DataFrame:
    """asked(prefix), directories(name) -> prefix, name, matches: itself where it exists, else the one directory it starts, else null.

    Directories are expanded to their prefixes, so this is an equi-join.
    """
    d = directories.select("name").distinct()
    up = d.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.substring(F.col("name"), F.lit(1), n))).alias("prefix"))
    found = up.join(asked.select("prefix").distinct(), "prefix").groupBy("prefix").agg(F.count("*").alias("matches"), F.min("name").alias("one"), F.max(F.col("name") == F.col("prefix")).alias("same"))
    name = F.when(F.col("same"), F.col("prefix")).when(F.col("matches") == 1, F.col("one"))
    return asked.select("prefix").distinct().join(found, "prefix", "left").select("prefix", name.alias("name"), F.coalesce("matches", F.lit(0)).cast("long").alias("matches"))


#: Files of references, and main files.
REFERENCES = r"\.bib$|(?i:referenc|bibliograph|refs)[^/]*(?i:\.tex)$"
MAIN = r"/(main|paper|manuscript)\.tex$"


def manuscript_files(files: DataFrame, papers: DataFrame) -> DataFrame:
    """files(path), papers(family, directory) -> family, directory, path of the files to read for references.

    A directory that isn't there stands for the one that it begins; null where that isn't one. Its files of references are
    taken, and the shortest main file; without either its shortest file, the least path of equals.
    """
    every = files.select("path", F.split_part("path", F.lit("/"), F.lit(1)).alias("directory")).distinct()
    place = unique_prefix(papers.select(F.col("directory").alias("prefix")), every.select(F.col("directory").alias("name"))).select("prefix", F.col("name").alias("directory"))
    is_reference = F.when(F.col("path").rlike(REFERENCES), F.col("path"))
    short = F.struct(F.length("path").alias("n"), "path")
    best = every.groupBy("directory").agg(F.collect_set(is_reference).alias("references"), F.min(F.when(F.col("path").rlike(MAIN), short)).alias("main"), F.min(short).alias("least"))
    one = F.when(F.col("main").isNotNull(), F.array("main.path")).when(F.size("references") == 0, F.array("least.path")).otherwise(F.array().cast("array<string>"))
    best = best.select("directory", F.array_union("references", one).alias("paths"))
    asked = papers.select("family", F.col("directory").alias("prefix")).distinct().join(place, "prefix").join(best, "directory", "left")
    return asked.select("family", "directory", F.explode_outer("paths").alias("path")).distinct()


def missing_keys(wanted: DataFrame, stored: DataFrame, key: str = "key") -> DataFrame:
    """Distinct wanted keys that are not stored yet: what a content-addressed cache still has to make."""
    return wanted.select(key).distinct().join(stored.select(key).distinct(), key, "left_anti")


def annotate(pairs: DataFrame, notes: DataFrame) -> DataFrame:
    """pairs(a, b, ...), notes(a, b, note) -> the pairs with the note of their unordered key, null where there is none."""
    low, high = F.least("a", "b").alias("__low"), F.greatest("a", "b").alias("__high")
    return pairs.select("*", low, high).join(notes.select(low, high, "note"), ["__low", "__high"], "left").drop("__low", "__high")


def first_existing(asked: DataFrame, existing: DataFrame) -> DataFrame:
    """asked(id, candidates), existing(path) -> id, path: the first candidate that exists, null for none."""
    each = asked.select("id", F.posexplode_outer("candidates").alias("pos", "path"))
    found = each.join(existing.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    return found.groupBy("id").agg(F.min_by("path", F.when(F.col("there"), F.col("pos"))).alias("path"))


def without_self_references(entries: DataFrame, word: str, address: str, head: int = 100) -> DataFrame:
    """entries(authors, citation, raw, ...) without those whose authors or citation's first ``head`` characters name ``word``, or that hold ``address``."""
    own = whole_word(F.lower("authors"), word) | whole_word(F.lower(F.substring("citation", 1, head)), word) | F.contains("raw", F.lit(address))
    return entries.where(~F.coalesce(own, F.lit(False)))


def build_states(entries: DataFrame) -> DataFrame:
    """entries(id, hash, stored_hash, stored_state, built, extracted, used, permitted) -> id, state, unexpected.

    An entry resolved before with the same hash is cached; a failed build, a failed extraction and axioms that are not
    permitted (sorted in ``unexpected``) follow in this order; what is left is resolved.
    """
    none = F.array().cast("array<string>")
    extra = F.array_sort(F.array_except(F.coalesce("used", none), F.coalesce("permitted", none)))
    cached = (F.col("hash") == F.col("stored_hash")) & (F.col("stored_state") == "resolved")
    state = (F.when(cached, "cached").when(~F.coalesce("built", F.lit(False)), "build-failed").when(~F.coalesce("extracted", F.lit(False)), "extraction-failed")
             .when(F.size(extra) > 0, "rejected").otherwise("resolved"))
    return entries.select("id", state.alias("state"), F.when(state == "rejected", extra).otherwise(none).alias("unexpected"))
