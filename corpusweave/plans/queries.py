"""Named queries on the driver tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


from ..functions import text as tx
from ..operators import analysis, catalog, coupling, graph, resolve, search, vectors
from ..operators.tables import cut, new_path
from ..sources import files, parsers
from ..streaming import counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- coupling: families are customers, works are parts ---------------------------------------------------------------

def _families(spark, d) -> tuple[DataFrame, DataFrame]:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    edges = o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(F.col("o_custkey").alias("family"), F.col("l_partkey").alias("work"))
    return edges, table(spark, d, "customer").select(F.col("c_custkey").alias("family"))


_EDGES = "e AS (SELECT DISTINCT o_custkey AS family, l_partkey AS work FROM orders JOIN lineitem ON o_orderkey = l_orderkey), "
_COUPLING = _EDGES + """n AS (SELECT count(*) AS n FROM customer), i AS (SELECT work, count(*) AS df, 1 + ln((max(n) + 1)::DOUBLE / (count(*) + 1)) AS idf FROM e, n GROUP BY work),
w AS (SELECT family, work, idf FROM e JOIN i USING (work)), m AS (SELECT family, sqrt(sum(idf * idf)) AS norm FROM w GROUP BY family),
p AS (SELECT a.family AS fa, b.family AS fb, count(*) AS shared, sum(a.idf * a.idf) AS dot FROM w a JOIN w b ON a.work = b.work AND a.family < b.family GROUP BY ALL),
s AS (SELECT fa, fb, shared, round(dot / (x.norm * y.norm) * shared / (shared + 2), 6) AS score FROM p JOIN m x ON x.family = fa JOIN m y ON y.family = fb)"""
_ALL = _COUPLING


@query(f"WITH {_ALL}, b AS (SELECT fa AS family, fb AS neighbor, shared, score FROM s UNION ALL SELECT fb, fa, shared, score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score DESC, shared DESC, neighbor) AS rank FROM b) SELECT family, neighbor, shared, score, rank FROM r WHERE rank <= 8")
def coupling_topk(spark, d):
    return coupling.nearest(*_families(spark, d))


@query(f"WITH {_ALL} SELECT * FROM s")
def coupling_pairs(spark, d):
    return coupling.pairs(*_families(spark, d))


@query(f"WITH {_ALL} SELECT work, df, round(idf, 6) AS idf FROM i")
def coupling_idf(spark, d):
    return coupling.weights(*_families(spark, d)).withColumn("idf", F.round("idf", 6))


@query(f"WITH {_ALL}, a AS (SELECT c_custkey AS family FROM customer WHERE c_custkey NOT IN (SELECT fa FROM s UNION SELECT fb FROM s)), t AS (SELECT count(*) AS m FROM a) SELECT family, row_number() OVER (ORDER BY family) - 1 AS place, round((row_number() OVER (ORDER BY family) - 1 - (m - 1) / 2.0) * 0.13::DOUBLE, 6) AS x FROM a, t")
def coupling_isolates(spark, d):
    """Families that share no work; whole tables have few, or none."""
    edges, families = _families(spark, d)
    return coupling.isolates(edges, families)


@query(f"WITH {_ALL}, k AS (SELECT family, count(*) AS works FROM e GROUP BY family) SELECT (SELECT count(*) FROM s) AS pairs, (SELECT count(*) FROM (SELECT work FROM e GROUP BY work HAVING count(*) > 1)) AS shared_works, (SELECT string_agg(family::VARCHAR, ',' ORDER BY works DESC, family) FROM (SELECT * FROM k ORDER BY works DESC, family LIMIT 10)) AS largest")
def coupling_report(spark, d):
    edges, families = _families(spark, d)
    edges = edges.distinct()
    big = edges.groupBy("family").agg(F.count("*").alias("works")).orderBy(F.desc("works"), "family").limit(10)
    largest = big.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("works")).alias("w"), "family"))), lambda x: x["family"].cast("string")), ",").alias("largest"))
    shared = edges.groupBy("work").count().where("count > 1").agg(F.count("*").alias("shared_works"))
    return coupling.pairs(edges, families).agg(F.count("*").alias("pairs")).crossJoin(shared).crossJoin(largest)


@query(f"WITH {_ALL}, c AS (SELECT fa, fb FROM s ORDER BY score DESC, shared DESC, fa, fb LIMIT 20) SELECT fa, fb, row_number() OVER (PARTITION BY fa, fb ORDER BY round(x.idf, 6) DESC, x.work) AS rank, x.work, round(x.idf, 6) AS idf FROM c JOIN w x ON x.family = fa JOIN w y ON y.family = fb AND y.work = x.work")
def shared_works_evidence(spark, d):
    edges, families = _families(spark, d)
    chosen = coupling.pairs(edges, families).orderBy(F.desc("score"), F.desc("shared"), "fa", "fb").limit(20).select("fa", "fb")
    return coupling.evidence(edges, families, chosen)


# --- vectors ---------------------------------------------------------------------------------------------------------

def _items(spark, d, first: int | None = None) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    v = F.slice(v, F.lit(1), F.lit(first)) if first else v
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), v.alias("vector"), F.col("label").cast("long").alias("label"))


_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label::BIGINT AS label FROM embeddings), c AS (SELECT a.id, b.id AS nb, a.label AS la, b.label AS lb, round(list_inner_product(a.v, b.v), 6) AS score FROM v a JOIN v b ON a.id <> b.id), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, nb) AS rank FROM c)"


@query(f"WITH {_V} SELECT id, rank, nb AS neighbor, score FROM k WHERE rank <= 8")
def knn_cosine_top8(spark, d):
    return vectors.knn(_items(spark, d).select("id", "vector"))


def _ortho(name: str, prompt: int, before: str) -> str:
    """SQL of the next row of an orthonormal basis: a prompt less the mean, less its parts along the rows before."""
    step = f"{name}0 AS (SELECT list_transform(list_zip(p.v, m.v), lambda x: x[1] - x[2]) AS x FROM v p, mean m WHERE p.id = {prompt})"
    last = f"{name}0"
    for nth, u in enumerate(before, 1):
        step += f", {name}{nth} AS (SELECT list_transform(list_zip(a.x, u.x), lambda z: z[1] - list_inner_product(a.x, u.x) * z[2]) AS x FROM {last} a, {u} u)"
        last = f"{name}{nth}"
    return f"{step}, {name} AS (SELECT list_transform(x, lambda z: z / sqrt(list_inner_product(x, x))) AS x FROM {last})"


@query(f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), mean AS (SELECT list(x ORDER BY pos) AS v FROM (SELECT pos, avg(x) AS x FROM (SELECT unnest(v) AS x, unnest(range(64)) AS pos FROM v WHERE id < 4) GROUP BY pos)),
{_ortho('p', 0, '')}, {_ortho('q', 1, 'p')}, {_ortho('r', 2, 'pq')}, w AS (SELECT id, [list_inner_product(v, p.x), list_inner_product(v, q.x), list_inner_product(v, r.x)] AS c FROM v, p, q, r),
n AS (SELECT id, list_transform(c, lambda z: z / sqrt(list_inner_product(c, c))) AS v FROM w WHERE sqrt(list_inner_product(c, c)) > 1e-9),
k AS (SELECT a.id, b.id AS nb, round(list_inner_product(a.v, b.v), 6) AS score, row_number() OVER (PARTITION BY a.id ORDER BY round(list_inner_product(a.v, b.v), 6) DESC, b.id) AS rank FROM n a JOIN n b ON a.id <> b.id) SELECT id, rank, nb AS neighbor, score FROM k WHERE rank <= 8""")
def knn_lens_projected(spark, d):
    """Neighbours through a lens of four prompts, the first four vectors: what differs between them spans three directions (V4, V5)."""
    items = _items(spark, d).select("id", "vector")
    prompts = [r["vector"] for r in items.where("id < 4").orderBy("id").collect()]
    basis, _ = vectors.lens_basis(prompts)
    return vectors.knn(items.select("id", vectors.project(F.col("vector"), basis).alias("vector")))


@query(f"WITH {_V}, f AS (SELECT id, nb, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, nb) AS r FROM c WHERE la <> lb) SELECT id AS a, nb AS b, score FROM f WHERE r = 1 AND id < nb ORDER BY score DESC, a LIMIT 12")
def nearest_other_subject(spark, d):
    items = _items(spark, d).select("id", "vector", "label")
    near = vectors.knn(items, 1, apart="label").where("id < neighbor")
    return near.select(F.col("id").alias("a"), F.col("neighbor").alias("b"), "score").orderBy(F.desc("score"), "a").limit(12)



_CONCEPT = "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label::BIGINT AS label FROM embeddings), l AS (SELECT label, unnest(v) AS x, unnest(range(64)) AS pos FROM v), e AS (SELECT label, pos, avg(x) AS x FROM l GROUP BY ALL), q AS (SELECT label AS concept, list(x ORDER BY pos) AS q FROM e GROUP BY label), s AS (SELECT id, concept, list_inner_product(v, q) / sqrt(list_inner_product(q, q)) AS s FROM v, q), m AS (SELECT concept, avg(s) AS mean FROM s GROUP BY concept)"


def _concepts(spark, d) -> DataFrame:
    """A concept is the mean direction of a label; all of them are one row, an array with an entry per label."""
    items = _items(spark, d)
    means = items.select("label", F.posexplode("vector").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"))
    means = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("q"))
    every = means.agg(F.collect_list(F.struct(F.col("label").alias("concept"), "q")).alias("concepts"))
    s = items.crossJoin(F.broadcast(every)).select("id", "vector", F.explode("concepts").alias("c"))
    s = s.select(F.col("c.concept").alias("concept"), "id", (vectors.dot(F.col("vector"), F.col("c.q")) / vectors.norm(F.col("c.q"))).alias("s"))
    return s.join(s.groupBy("concept").agg(F.avg("s").alias("mean")), "concept")


@query(f"{_CONCEPT} SELECT concept, id, round(s, 6) AS score, round(s - mean, 6) AS delta FROM s JOIN m USING (concept)")
def concept_scores(spark, d):
    return _concepts(spark, d).select("concept", "id", F.round("s", 6).alias("score"), F.round(F.col("s") - F.col("mean"), 6).alias("delta"))


@query(f"{_CONCEPT}, a AS (SELECT round(abs(s - mean), 6) AS x FROM s JOIN m USING (concept)), r AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM a) SELECT round(ceil(round(x / 0.01::DOUBLE, 6)) * 0.01::DOUBLE, 6) AS extent FROM r WHERE i = floor(n * 98 / 100)")
def concept_extent(spark, d):
    return analysis.empirical_quantile(_concepts(spark, d).select(F.round(F.abs(F.col("s") - F.col("mean")), 6).alias("x")), "x", 98, 100)


@query(f"{_CONCEPT}, r AS (SELECT concept AS label, id, round(s, 6) AS score, row_number() OVER (PARTITION BY concept ORDER BY round(s, 6) DESC, id) AS rank FROM s JOIN v USING (id) WHERE label = concept) SELECT label, id, score, rank FROM r WHERE rank <= 4")
def representatives(spark, d):
    """The four items of each label nearest to its mean direction."""
    own = _concepts(spark, d).join(_items(spark, d).select("id", "label"), "id").where("label = concept").select("label", "id", F.round("s", 6).alias("score"))
    order = Window.partitionBy("label").orderBy(F.desc("score"), "id")
    return own.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 4")


@query("WITH l AS (SELECT label::BIGINT AS label, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS pos FROM embeddings), m AS (SELECT label, pos, avg(x) AS x FROM l GROUP BY ALL), s AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label) SELECT label, pos, round(x / n, 6) AS value FROM m JOIN s USING (label)")
def module_mean_vectors(spark, d):
    return vectors.mean_vectors(_items(spark, d), "label")


@query("WITH r AS (SELECT label::BIGINT AS family, vec_id % 7 AS path, max_by(embedding::DOUBLE[], vec_id) AS v FROM embeddings GROUP BY ALL), c AS (SELECT family, count(*) AS modules FROM r GROUP BY family), l AS (SELECT family, unnest(v) AS x, unnest(range(64)) AS pos FROM r), m AS (SELECT family, pos, avg(x) AS x FROM l GROUP BY ALL), s AS (SELECT family, sqrt(sum(x * x)) AS n FROM m GROUP BY family) SELECT family, pos, round(x / n, 6) AS value, modules FROM m JOIN s USING (family) JOIN c USING (family)")
def module_vectors(spark, d):
    """The last vector of each of a label's seven paths counts."""
    rows = _items(spark, d).select(F.col("label").alias("family"), (F.col("id") % 7).cast("string").alias("path"), F.col("id").alias("ordinal"), "vector")
    return vectors.module_vectors(rows).select("family", F.posexplode("vector").alias("pos", "x"), "modules").select("family", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("value"), "modules")


@query()
def flat_layout(spark, d):
    return vectors.flat_layout(_items(spark, d).select("id", "vector"))


@query()
def chunk_embeddings(spark, d):
    """A vector for each document: the mean over its different chunks' vectors, of the stand-in encoder."""
    chunks = _chunks(spark, d).select("doc_id", tx.short_hash(F.col("chunk")).alias("key"), F.col("chunk").alias("text"))
    vector = vectors.embed(chunks.groupBy("key").agg(F.first("text").alias("text")))
    return vectors.chunk_vectors(chunks.select("doc_id", "key").join(vector, "key"), "doc_id", "key")


_TWO = "u AS (SELECT id, v[1:{n}] AS v FROM v), c2 AS (SELECT a.id, b.id AS nb, round(list_inner_product(a.v, b.v), 6) AS score FROM u a JOIN u b ON a.id <> b.id), k2 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, nb) AS rank FROM c2)"


@query(f"WITH {_V}, {_TWO.format(n=32)} SELECT k.id, k.nb AS neighbor, k2.rank AS rank_a FROM k JOIN k2 ON k.id = k2.id AND k.nb = k2.nb WHERE k.rank = 1")
def rank_audit(spark, d):
    first = vectors.knn(_items(spark, d).select("id", "vector"), 1)
    return vectors.ranks(_items(spark, d, 32), first).withColumnRenamed("rank", "rank_a")


@query(f"WITH {_V}, {_TWO.format(n=2)}, n AS (SELECT count(*) AS n FROM v) SELECT round(1 - 2.0::DOUBLE * sum(greatest(k.rank - 10, 0))::DOUBLE / (max(n) * 10 * (2 * max(n) - 31)), 6) AS trustworthiness, round(count(*) FILTER (k.rank <= 10) / (max(n) * 10)::DOUBLE, 6) AS recall FROM k2 JOIN k ON k.id = k2.id AND k.nb = k2.nb, n WHERE k2.rank <= 10")
def trustworthiness(spark, d):
    items = _items(spark, d)
    low = vectors.knn(_items(spark, d, 2).select("id", "vector"), 10)
    high = vectors.ranks(items, low).withColumnRenamed("rank", "high")
    n = items.agg(F.count("*").alias("n"))
    x = high.agg(F.sum(F.greatest(F.col("high") - 10, F.lit(0))).alias("p"), F.count_if(F.col("high") <= 10).alias("same")).crossJoin(n)
    return x.select(F.round(1 - 2.0 * F.col("p") / (F.col("n") * 10 * (2 * F.col("n") - 31)), 6).alias("trustworthiness"), F.round(F.col("same") / (F.col("n") * 10), 6).alias("recall"))


@query(f"WITH {_V}, {_TWO.format(n=32)} SELECT round(count(*) / ((SELECT count(*) FROM v) * 5)::DOUBLE, 6) AS overlap FROM k JOIN k2 ON k.id = k2.id AND k.nb = k2.nb WHERE k.rank <= 5 AND k2.rank <= 5")
def neighbor_overlap(spark, d):
    a, b = (vectors.knn(_items(spark, d, n).select("id", "vector"), 5).select("id", "neighbor") for n in (None, 32))
    return a.join(b, ["id", "neighbor"]).agg(F.count("*").alias("s")).crossJoin(_items(spark, d).agg(F.count("*").alias("n"))).select(F.round(F.col("s") / (F.col("n") * 5), 6).alias("overlap"))


@query(f"WITH {_V} SELECT round(count(*) FILTER (la = lb) / count(*)::DOUBLE, 6) AS share FROM k WHERE rank <= 5")
def same_subject_share(spark, d):
    items = _items(spark, d)
    lab = items.select("id", "label")
    near = vectors.knn(items.select("id", "vector"), 5).join(lab, "id").join(lab.select(F.col("id").alias("neighbor"), F.col("label").alias("other")), "neighbor")
    return near.agg(F.round(F.count_if(F.col("label") == F.col("other")) / F.count("*"), 6).alias("share"))


@query("""WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS rx, embedding[4]::DOUBLE AS ry FROM embeddings),
c AS (SELECT id, x - (SELECT avg(x) FROM p) AS x, y - (SELECT avg(y) FROM p) AS y, rx - (SELECT avg(rx) FROM p) AS rx, ry - (SELECT avg(ry) FROM p) AS ry FROM p),
s AS (SELECT id, x / (SELECT sqrt(avg(x * x + y * y)) FROM c) AS x, y / (SELECT sqrt(avg(x * x + y * y)) FROM c) AS y, rx / (SELECT sqrt(avg(rx * rx + ry * ry)) FROM c) AS rx, ry / (SELECT sqrt(avg(rx * rx + ry * ry)) FROM c) AS ry FROM c),
f AS (SELECT id, f, x, y * f AS y, rx, ry FROM s, (VALUES (1.0::DOUBLE), (-1.0::DOUBLE)) t(f)), a AS (SELECT f, atan2(sum(x * ry - y * rx), sum(x * rx + y * ry)) AS t FROM f GROUP BY f),
r AS (SELECT id, f, x * cos(t) - y * sin(t) AS x, x * sin(t) + y * cos(t) AS y, rx, ry FROM f JOIN a USING (f)),
b AS (SELECT f FROM r GROUP BY f ORDER BY round(sum((x - rx) ** 2 + (y - ry) ** 2), 9), f DESC LIMIT 1) SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM r JOIN b USING (f)""")
def procrustes_align(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.procrustes(e.select(F.col("vec_id").alias("id"), *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(("x", "y", "rx", "ry")))))


# --- search and text -------------------------------------------------------------------------------------------------

def _catalogue(spark, d) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", F.lit(True).alias("has"))
    text = tx.search_normalize(F.col("text"))
    docs = docs.join(labels.distinct(), "doc_id", "left").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("subject"), F.coalesce("has", F.lit(False)).alias("lean"), text.alias("body"))
    return docs.withColumn("title", F.split_part("body", F.lit("."), F.lit(1)))


_NORMAL = "replace(lower(strip_accents({})), 'π', 'pi')"
_CAT = f"i AS (SELECT d.doc_id::VARCHAR AS id, {_NORMAL.format('text')} AS body, source AS subject, l.doc_id IS NOT NULL AS lean FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id), j AS (SELECT *, split_part(body, '.', 1) AS title FROM i), t AS (SELECT *, concat_ws(' ', id, title, subject, body) AS txt FROM j)"


def _word_score(*words: str) -> str:
    part = lambda c, w, n: f"(CASE WHEN contains(coalesce({c}, ''), '{w}') THEN {n} ELSE 0 END)"
    return "(" + " + ".join([part(c, w, n) for w in words for c, n in (("title", 10), ("subject", 5))] + [f"(CASE WHEN lpad(id, greatest(3, length(id))::INT, '0') = '{w.rjust(3, '0')}' THEN 100 ELSE 0 END)" for w in words]) + ")::BIGINT AS score"


_THE = "regexp_matches(txt, '(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])')"


@query(f"WITH {_CAT} SELECT id, {_word_score('thonre', 'the')} FROM t WHERE contains(txt, 'thonre') AND {_THE}")
def lexical_search(spark, d):
    return search.lexical_search(_catalogue(spark, d), search.parse_query("Thonré the"))


@query(f"WITH {_CAT} SELECT id, {_word_score('17')} FROM t WHERE lpad(id, greatest(3, length(id))::INT, '0') = '017' OR contains(txt, '17')")
def number_search(spark, d):
    """A number is an id, or is somewhere in the text, the id included."""
    return search.lexical_search(_catalogue(spark, d), search.parse_query("17"))


@query(f"WITH {_CAT} SELECT id, {_word_score('tion')} FROM t WHERE contains(subject, 'src1') AND lean AND contains(txt, 'tion')")
def faceted_search(spark, d):
    return search.lexical_search(_catalogue(spark, d), search.parse_query('topic:"src2" subject : src1 lean:yes tion'))


@query(f"""WITH {_CAT}, v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS q FROM v WHERE id = 0), l AS (SELECT id::BIGINT AS id, 0::BIGINT AS part, 10.0::DOUBLE * contains(title, 'thonre')::INT + 5 * contains(subject, 'thonre')::INT AS score FROM t WHERE contains(txt, 'thonre')),
b AS (SELECT id::BIGINT AS id, 0.025::DOUBLE * (regexp_matches(title, '(^|[^A-Za-z0-9_])thonre($|[^A-Za-z0-9_])')::INT) AS bonus FROM t), s AS (SELECT v.id, 1::BIGINT AS part, round(list_inner_product(v, q) + coalesce(bonus, 0), 6) AS score FROM v CROSS JOIN q LEFT JOIN b ON b.id = v.id ORDER BY score DESC, v.id LIMIT 20) SELECT * FROM l UNION ALL SELECT * FROM s WHERE id NOT IN (SELECT id FROM l)""")
def combined_search(spark, d):
    """Literal hits, then the nearest vectors to the first one, with the bonus for a title that has the query's word."""
    query, cat = search.parse_query("the Thonre"), _catalogue(spark, d)
    titles = cat.select(F.col("id").cast("long").alias("id"), "title")
    items = _items(spark, d).select("id", "vector").join(titles, "id", "left").withColumn("title", F.coalesce("title", F.lit("")))
    vector = items.where("id = 0").first()["vector"]
    literal = search.lexical_search(cat, search.parse_query("thonre")).select(F.col("id").cast("long").alias("id"), "score")
    return search.combine(literal, search.semantic_search(items, vector, search.title_words(query)))


@query("SELECT min(p_partkey) AS id FROM part WHERE lower(p_name) LIKE '%a%'")
def anchor_lookup(spark, d):
    return search.anchor(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), "A")


@query("SELECT lang AS subject, count(*) AS families, sum(n)::BIGINT AS papers, count(l.doc_id) AS linked FROM (SELECT doc_id, lang, len(string_split(text, chr(10))) AS n FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY lang")
def subject_rollup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.size(F.split("text", "\n")).cast("long").alias("n"))
    links = table(spark, d, "labels").select("doc_id", F.lit(1).alias("one")).distinct()
    return docs.join(links, "doc_id", "left").groupBy(F.col("lang").alias("subject")).agg(F.count("*").alias("families"), F.sum("n").alias("papers"), F.count("one").alias("linked"))


@query("SELECT count(*) AS families, count(DISTINCT source) AS subjects, (SELECT count(*) FROM conversations) AS papers FROM documents")
def coverage_counts(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("families"), F.count_distinct("source").alias("subjects")).crossJoin(table(spark, d, "conversations").agg(F.count("*").alias("papers")))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def subject_histogram(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE n_chars IS NOT NULL) SELECT source, n_chars AS median FROM r WHERE i = n // 2")
def median_position(spark, d):
    return analysis.upper_median(table(spark, d, "documents"), ["source"], "n_chars")


@query("SELECT conv_id, string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) AS topic FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def topic_text(spark, d):
    turns = table(spark, d, "conversations").where(F.trim("text") != "")
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.trim("text").alias("t")))), lambda x: x["t"]), "\n\n").alias("topic"))


_CHUNK = r"w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents), c AS (SELECT doc_id, unnest(range(0, greatest(len(ws), 1), 56)) AS pos, ws FROM w), k AS (SELECT doc_id, pos // 56 AS nth, array_to_string(ws[pos + 1:pos + 64], ' ') AS chunk FROM c)"


def _chunks(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(tx.token_windows(F.col("text"), 64, 8)).alias("nth", "chunk"))


@query(f"WITH {_CHUNK} SELECT doc_id, nth, sha256(coalesce(chunk, ''))[1:16] AS key, length(coalesce(chunk, '')) AS size FROM k")
def token_chunks(spark, d):
    return _chunks(spark, d).select("doc_id", F.col("nth").cast("long").alias("nth"), tx.short_hash(F.col("chunk")).alias("key"), F.length("chunk").cast("long").alias("size"))


@query(f"WITH {_CHUNK} SELECT sha256(coalesce(chunk, ''))[1:16] AS key, count(*) AS uses, min(doc_id) AS first_doc FROM k GROUP BY 1")
def chunk_dedup(spark, d):
    return _chunks(spark, d).groupBy(tx.short_hash(F.col("chunk")).alias("key")).agg(F.count("*").alias("uses"), F.min("doc_id").alias("first_doc"))


_STOP = ", ".join(f"'{w}'" for w in analysis.STOP_WORDS)


@query(f"""WITH l AS (SELECT doc_id, lang AS cluster, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pN_]{{2,}}'), lambda x: x NOT IN ({_STOP})) AS ws FROM documents),
t AS (SELECT doc_id, cluster, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM l), f AS (SELECT doc_id, cluster, term, count(*) AS tf FROM t GROUP BY ALL),
g AS (SELECT term, count(*) AS df, sum(tf) AS total FROM f GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 4000), w AS (SELECT doc_id, cluster, term, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM f JOIN g USING (term), (SELECT count(*) AS n FROM documents)),
s AS (SELECT doc_id, sqrt(sum(w * w)) AS size FROM w GROUP BY doc_id), m AS (SELECT lang AS cluster, count(*) AS m FROM documents GROUP BY lang), a AS (SELECT cluster, term, round(sum(w / size) / max(m), 6) AS weight FROM w JOIN s USING (doc_id) JOIN m USING (cluster) GROUP BY cluster, term),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term) AS rank FROM a) SELECT cluster, rank, term, weight FROM r WHERE rank <= 6""")
def tfidf_keywords(spark, d):
    """One- and two-word terms of each language."""
    return analysis.tfidf_keywords(table(spark, d, "documents").select("doc_id", F.col("lang").alias("cluster"), "text"))


@query()
def kmeans_sweep(spark, d):
    return analysis.kmeans_sweep(_items(spark, d).select("id", "vector"))


@query("WITH c AS (SELECT label AS a, (vec_id % 10)::INT AS b, count(*) AS n FROM embeddings GROUP BY ALL), x AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS ij, sum(n)::DOUBLE AS n FROM c), a AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS s FROM (SELECT sum(n)::DOUBLE AS n FROM c GROUP BY a)), b AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS s FROM (SELECT sum(n)::DOUBLE AS n FROM c GROUP BY b)) SELECT round((ij - a.s * b.s / (n * (n - 1) / 2)) / ((a.s + b.s) / 2 - a.s * b.s / (n * (n - 1) / 2)), 6) AS ari FROM x, a, b")
def label_ari(spark, d):
    """Agreement of labels and last digits: the formula on two given partitions."""
    return analysis.rand_index(table(spark, d, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 10).cast("int").alias("b")))


@query()
def seed_ari(spark, d):
    """Agreement of two fits of ten clusters that differ in their seed."""
    return analysis.rand_index(analysis.seed_assignments(_items(spark, d).select("id", "vector"), 10))


@query("""WITH b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS w FROM benchmark), t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS w FROM documents), s AS (SELECT item_id, doc_id, count(*) AS n FROM b JOIN t USING (w) GROUP BY ALL),
e AS (SELECT item_id, doc_id FROM benchmark JOIN documents ON contains(lower(documents.text), lower(benchmark.text))), r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS rank FROM s), q AS (SELECT item_id, min(rank) AS rank FROM r JOIN e USING (item_id, doc_id) GROUP BY item_id)
SELECT count(*) AS queries, count(*) FILTER (rank = 1) AS top1, count(*) FILTER (rank <= 3) AS top3, round(avg(1.0::DOUBLE / rank), 6) AS mrr FROM q""")
def retrieval_eval(spark, d):
    items, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    return analysis.retrieval_scores(analysis.best_ranks(items, docs, cut(analysis.containing_pairs(items, docs), "expected")))


# --- links, records, graphs ------------------------------------------------------------------------------------------

@query(r"SELECT page_id, regexp_extract(url, '^https?://(?:www\.|m\.)?([^/?#]+)', 1) AS host, regexp_replace(split_part(url, '?', 1), '^https?://(?:www\.|m\.)?', '') AS canonical FROM pages")
def url_canonical(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(url, r"^https?://(?:www\.|m\.)?([^/?#]+)", 1).alias("host"), F.regexp_replace(F.split_part(url, F.lit("?"), F.lit(1)), r"^https?://(?:www\.|m\.)?", "").alias("canonical"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, 'href=\"[^\"]+\"'))::BIGINT AS links FROM pages")
def page_title_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit('href="[^"]+"')).cast("long").alias("links"))


@query(r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS digest FROM pages")
def html_clean(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(tx.clean_markup(F.col("html")), 256).alias("digest"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}'))), ',') AS ids, regexp_extract(text, '((?:18|19|20)[0-9][0-9])', 1) AS year FROM documents")
def identifier_extract(spark, d):
    ids = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), F.lit(0))))
    return table(spark, d, "documents").select("doc_id", F.array_join(ids, ",").alias("ids"), tx.year(F.col("text")).alias("year"))


@query("WITH r AS (SELECT p_partkey AS id, p_name AS title, p_brand AS surname, p_size AS y FROM part) SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.title = b.title AND a.surname = b.surname AND a.id < b.id AND (a.y IS NULL OR b.y IS NULL OR abs(a.y - b.y) <= 3)")
def title_author_year_join(spark, d):
    r = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("surname"), F.col("p_size").alias("y"))
    return resolve.near_years(r, 3)


_RECORD = ("record", "title", "authors", "year", "citation", "raw", "doi", "arxiv", "url", "source", "families")


def _records(rows: DataFrame, **given) -> DataFrame:
    """Citation records with the given columns, blank in all others."""
    blank = {c: F.lit("") for c in _RECORD[1:-1]} | {"families": F.array().cast("array<string>")}
    made = blank | {k: F.expr(v) for k, v in given.items()}
    return rows.select(*(made[c].alias(c) for c in _RECORD))


def _text_records(spark, d) -> DataFrame:
    return _records(table(spark, d, "documents"), record="doc_id", citation="text", source="source", families="array(source)")


@query("WITH k AS (SELECT array_to_string(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9]+'), ' ') AS k, doc_id, source FROM documents) SELECT min(doc_id) AS first_record, count(*) AS records, count(DISTINCT source) AS families FROM k GROUP BY k")
def resolve_entities(spark, d):
    """Whole texts as citations: equal ones are a work."""
    w = resolve.resolve(_text_records(spark, d))
    return w.select(F.array_min("records").alias("first_record"), F.size("records").cast("long").alias("records"), F.size("families").cast("long").alias("families"))


def _named_records(spark, d) -> DataFrame:
    """Records told apart by their identifiers alone: DOIs and arXiv ids in many forms, some of them none."""
    return _records(
        table(spark, d, "part"), record="p_partkey", citation="concat('entry number ', p_partkey)", source="p_type", families="array(p_brand)",
        doi="CASE p_partkey % 6 WHEN 0 THEN concat('https://doi.org/10.1000/A', p_partkey % 97, '.') WHEN 1 THEN 'n/a' ELSE '' END",
        arxiv="CASE WHEN p_partkey % 6 = 2 THEN concat('2101.', lpad(cast(p_partkey % 89 AS string), 5, '0'), 'v2') ELSE '' END",
        raw=r"""CASE p_partkey % 6 WHEN 3 THEN concat('see \\url{https://doi.org/10.1000/a', p_partkey % 97, '}, 1999') WHEN 4 THEN concat('arXiv: math/', lpad(cast(p_partkey % 83 AS string), 7, '0'), '. \\url{https://arxiv.org/pdf/2101.', lpad(cast(p_partkey % 89 AS string), 5, '0'), 'v1.pdf}')
            WHEN 5 THEN concat('10.1000/a', p_partkey % 97, ' and 10.1000/b', p_partkey) ELSE '' END""",
        url="CASE WHEN p_partkey % 2 = 1 THEN concat('http://a.test/x\\_', p_partkey) ELSE '' END")


_NAMED = """r AS (SELECT p_partkey AS record, p_brand, CASE p_partkey % 6 WHEN 0 THEN 'doi:10.1000/a' || (p_partkey % 97) WHEN 3 THEN 'doi:10.1000/a' || (p_partkey % 97)
WHEN 2 THEN 'arxiv:2101.' || lpad((p_partkey % 89)::VARCHAR, 5, '0') ELSE 'text:entry number ' || p_partkey END AS key, CASE WHEN p_partkey % 2 = 1 THEN 'http://a.test/x_' || p_partkey ELSE '' END AS url FROM part)"""


@query(f"""WITH {_NAMED}, g AS (SELECT key, min(record) AS first_record, count(*) AS records, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS families, min_by(url, record) FILTER (url <> '') AS url FROM r GROUP BY key)
SELECT sha256(key)[1:16] AS work, first_record, records, families, CASE WHEN key LIKE 'doi:%' THEN 'https://doi.org/' || key[5:] WHEN key LIKE 'arxiv:%' THEN 'https://arxiv.org/abs/' || key[7:]
ELSE coalesce(url, 'https://scholar.google.com/scholar?q=entry%20number%20' || first_record) END AS url FROM g""")
def identifier_works(spark, d):
    """Works by identifier (E3, E8, E9, F4, F5, F7, P15): a record of two arXiv ids or two DOIs has none, and so has 'n/a'."""
    return resolve.resolve(_named_records(spark, d)).select("work", F.array_min("records").alias("first_record"), F.size("records").cast("long").alias("records"), F.array_join("families", ",").alias("families"), "url")


def _title_records(spark, d) -> DataFrame:
    """Records of one title and author belong together where their years are near."""
    return _records(table(spark, d, "part"), record="p_partkey", title="concat('On {the} theory of ', p_name, ' objects')", authors="concat('Ada ', replace(p_brand, '#', ''), ' and Bo Li')",
                    year="CASE WHEN p_size % 13 = 0 THEN 'forthcoming' ELSE concat('(', 1900 + 2 * p_size, ')') END", citation="concat('entry ', p_partkey)", source="p_type", families="array(p_type)")


_TITLED = """r AS (SELECT p_partkey AS record, p_name AS t, p_brand AS a, CASE WHEN p_size % 13 = 0 THEN NULL ELSE 1900 + 2 * p_size END AS y FROM part),
k AS (SELECT *, bool_or(y IS NULL) OVER (PARTITION BY t, a) AS open, CASE WHEN y - lag(y) OVER (PARTITION BY t, a ORDER BY y, record) > 3 THEN 1 ELSE 0 END AS new FROM r),
i AS (SELECT *, CASE WHEN open THEN 0 ELSE sum(new) OVER (PARTITION BY t, a ORDER BY y, record) END AS island FROM k)"""


@query(f"WITH {_TITLED} SELECT min(record) AS first_record, count(*) AS records FROM i GROUP BY t, a, island")
def title_works(spark, d):
    """Works by title, first author and a chain of years at most 3 apart; a record without a year joins all of its title."""
    return resolve.resolve(_title_records(spark, d)).select(F.array_min("records").alias("first_record"), F.size("records").cast("long").alias("records"))


def _cited_records(spark, d) -> DataFrame:
    """Titled records of suppliers, and untitled ones that cite them whole."""
    known = _records(table(spark, d, "supplier"), record="s_suppkey", title="concat('Collected studies of the maker ', s_name)", authors="concat('Byron', s_suppkey, ', A.')", citation="concat('item ', s_suppkey)", source="'a'", families="array('a')")
    n = table(spark, d, "supplier").agg(F.max("s_suppkey").alias("last"))
    cites = _records(table(spark, d, "part").crossJoin(F.broadcast(n)), record="1000000000 + p_partkey", source="'b'", families="array('b')",
                     citation="concat('A. Byron', p_partkey % (last + 3), ', {Collected} Studies of the Maker Supplier#', lpad(cast(p_partkey % (last + 1) AS string), 9, '0'), '. Entry ', p_partkey)")
    return known.unionByName(cites)


@query("WITH n AS (SELECT max(s_suppkey) AS last FROM supplier), c AS (SELECT 1000000000 + p_partkey AS record, CASE WHEN p_partkey % (last + 3) = p_partkey % (last + 1) THEN p_partkey % (last + 1) ELSE 1000000000 + p_partkey END AS g FROM part, n UNION ALL SELECT s_suppkey, s_suppkey FROM supplier) SELECT min(record) AS first_record, count(*) AS records FROM c GROUP BY g")
def title_inside_works(spark, d):
    """An untitled citation joins the work whose title it holds, if the author is named as well."""
    return resolve.resolve(_cited_records(spark, d)).select(F.array_min("records").alias("first_record"), F.size("records").cast("long").alias("records"))


def _rival_records(spark, d) -> DataFrame:
    """Two records for each supplier with one title and author; every other pair has two DOIs."""
    twice = table(spark, d, "supplier").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    return _records(twice, record="2 * s_suppkey + side", title="concat('A long enough title about ', s_name)", authors="'Ada Byron'", citation="concat('c', s_suppkey, 'x', side)", source="concat('s', side)",
                    doi="CASE WHEN s_suppkey % 2 = 0 THEN concat('10.1000/', s_suppkey, 'x', side) ELSE '' END", families="array('f', concat('g', side))")


@query("SELECT 2 * s_suppkey + 1 AS record, 2 * s_suppkey AS other, 'title and author' AS reason FROM supplier WHERE s_suppkey % 2 = 0")
def merge_conflicts(spark, d):
    """Merges refused, as both groups have DOIs and none in common."""
    return resolve.resolution(_rival_records(spark, d)).conflicts


@query("SELECT 'title and author' AS reason, count(*) AS n FROM supplier WHERE s_suppkey % 2 = 1 HAVING count(*) > 0")
def merge_reasons(spark, d):
    return resolve.resolution(_rival_records(spark, d)).merges


@query("WITH r AS (SELECT 2 * s_suppkey + side AS record, CASE WHEN s_suppkey % 2 = 1 THEN 2 * s_suppkey ELSE 2 * s_suppkey + side END AS g, side FROM supplier, (VALUES (0), (1)) t(side)), e AS (SELECT g, record, side, unnest(['f', 'g' || side]) AS family FROM r) SELECT g AS first_record, family, min_by('s' || side, record) AS source FROM e GROUP BY ALL")
def family_sources(spark, d):
    """Of each work and family the source of the first record that names it (A10)."""
    w = resolve.resolve(_rival_records(spark, d))
    return w.select(F.array_min("records").alias("first_record"), F.explode("sources").alias("family", "source"))


def mixed_records(spark, d) -> DataFrame:
    """All kinds of records together, so that every rule meets every other."""
    texts = _text_records(spark, d).withColumn("record", F.col("record") + 4_000_000_000)
    named = _named_records(spark, d).withColumn("record", F.col("record") + 5_000_000_000)
    titled = _title_records(spark, d).withColumn("record", F.col("record") + 6_000_000_000).withColumn("doi", F.when(F.col("record") % 4 == 0, F.concat(F.lit("10.1000/a"), F.col("record") % 97)).otherwise(F.lit("")))
    return texts.unionByName(named).unionByName(titled).unionByName(_cited_records(spark, d)).unionByName(_rival_records(spark, d).withColumn("record", F.col("record") + 7_000_000_000))


@query()
def canonical_works(spark, d):
    """Works of all kinds of records (E3-E9); held to a plain sequential reading of the rules in the tests."""
    w = resolve.resolve(mixed_records(spark, d))
    return w.select("work", "url", F.array_join("families", ",").alias("families"), F.size("records").alias("records"), F.array_min("records").alias("first_record"))


@query(r"""SELECT p_partkey, '10.1000/a' || p_partkey || '+b' AS doi, CASE WHEN p_partkey % 2 = 0 THEN '2101.' || lpad((p_partkey % 89)::VARCHAR, 5, '0') ELSE 'math.ag/' || lpad((p_partkey % 89)::VARCHAR, 7, '0') END AS arxiv, CASE WHEN p_partkey % 2 = 0 THEN lower(replace(p_brand, '#', '')) ELSE 'berg' END AS surname, '19' || lpad((p_partkey % 100)::VARCHAR, 2, '0') AS year FROM part""")
def identifier_columns(spark, d):
    """Identifiers, surnames and years by column functions."""
    even = F.col("p_partkey") % 2 == 0
    pad = lambda n: F.lpad((F.col("p_partkey") % 89).cast("string"), n, "0")
    return table(spark, d, "part").select(
        "p_partkey", tx.canonical_doi(F.concat(F.lit(" https://doi.org/10.1000%2FA"), "p_partkey", F.lit("+B.,"))).alias("doi"),
        tx.arxiv_id(F.when(even, F.concat(F.lit("arXiv:2101."), pad(5), F.lit("v3"))).otherwise(F.concat(F.lit("math.AG/"), pad(7)))).alias("arxiv"),
        tx.surname(F.when(even, F.concat(F.lit("Ada Q. "), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(" and Bo Li"))).otherwise(F.lit("van der Berg, A.; Li, B."))).alias("surname"),
        tx.year(F.concat(F.lit("in 19"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lit(", not 2001"))).alias("year"))


# --- files: bibliographies and source code written from parts -----------------------------------------------------------

def _bibliography(spark, d) -> DataFrame:
    text = r"""CASE WHEN p_partkey % 2 = 0 THEN concat('% @book{no, title={Commented}}\n@comment{@article{in, title={Inside}}}\n@Article{k', p_partkey, ', Title = {The {', p_name, '} in $\\mathbb{R}^', p_size, '$}, odd, author="Ring, A. and {Bo}lt", journal={J. of "Things"}, year = ', 1900 + p_size, ', doi={10.1000/', p_partkey, '}}\n@misc{bare}\n@misc{untitled, year=1}')
        ELSE concat('\\begin{thebibliography}{9}\n% \\bibitem{no} A commented entry that is long\n\\bibitem[R]{k', p_partkey, '} A.~Ring, \\emph{Notes on ', p_name, '}--', p_size, '. \\url{http://a.test/', p_partkey, '}\n\\bibitem{s} short\\end{thebibliography} after') END"""
    return table(spark, d, "part").select(F.expr("concat('b', p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '.bib' ELSE '.tex' END)").alias("path"), F.expr(text).alias("text"))


@query(r"""SELECT 'b' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.bib' ELSE '.tex' END AS path, 'k' || p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN 'The ' || p_name || ' in $\mathbb{R}^' || p_size || '$' ELSE '' END AS title, CASE WHEN p_partkey % 2 = 0 THEN 'Ring, A. and Bolt' ELSE '' END AS authors,
CASE WHEN p_partkey % 2 = 0 THEN (1900 + p_size)::VARCHAR ELSE '' END AS year, CASE WHEN p_partkey % 2 = 0 THEN 'Ring, A. and Bolt. The ' || p_name || ' in $\mathbb{R}^' || p_size || '$. J. of "Things". ' || (1900 + p_size) ELSE 'A. Ring, Notes on ' || p_name || '–' || p_size || '.' END AS citation,
CASE WHEN p_partkey % 2 = 0 THEN '10.1000/' || p_partkey ELSE '' END AS doi, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'http://a.test/' || p_partkey END AS url FROM part""")
def bibliography_scan(spark, d):
    """Citation records of generated files (SRC6, SRC7, F3, F20)."""
    return parsers.scan_bibliographies(_bibliography(spark, d)).drop("raw", "arxiv")


def _sources(spark, d) -> DataFrame:
    text = """concat('/- import Bad\n/- nested -/ import Worse -/\nimport M.P', floor(p_partkey / 2), ' Std.X', p_partkey % 7, ' -- import Tail\n  public import M.P', floor(p_partkey / 3), '\nnamespace N', p_partkey % 5,
        '\nnoncomputable section\n@[simp] theorem step_number_', p_partkey, ' : True := step_number_', floor(p_partkey / 2), ' /- a -/ step_number_', floor(p_partkey / 3), '\nend\nend N', p_partkey % 5, '\nprivate def _root_.d', p_partkey, '.{u} := "-- text"\n')"""
    files = table(spark, d, "part").select(F.concat(F.lit("lean/M/P"), "p_partkey", F.lit(".lean")).alias("path"), F.expr(text).alias("text"))
    return parsers.scan_sources(files)


@query("SELECT 'M.P' || p_partkey AS module, array_to_string(list_sort(list_distinct(['M.P' || (p_partkey // 2), 'M.P' || (p_partkey // 3), 'Std.X' || (p_partkey % 7)])), ',') AS imports FROM part")
def source_imports(spark, d):
    """Imports outside comments (SRC9, G1, F10)."""
    return _sources(spark, d).select("module", F.array_join("imports", ",").alias("imports"))


@query("""SELECT 'M.P' || p_partkey AS module, 'N' || (p_partkey % 5) || '.step_number_' || p_partkey AS name, 7::BIGINT AS line, sha256('@[simp] theorem step_number_' || p_partkey || ' : True := step_number_' || (p_partkey // 2) || '      step_number_' || (p_partkey // 3) || chr(10) || 'end' || chr(10) || 'end N' || (p_partkey % 5))[1:16] AS digest FROM part
UNION ALL SELECT 'M.P' || p_partkey, 'd' || p_partkey, 10, sha256('private def _root_.d' || p_partkey || '.{u} := "-- text"')[1:16] FROM part""")
def source_declarations(spark, d):
    """Qualified names, lines and bodies."""
    return parsers.scan_declarations(_sources(spark, d)).select("module", "name", "line", tx.short_hash(F.col("text")).alias("digest"))


_IMPORTS = "e AS (SELECT p_partkey AS src, unnest([p_partkey // 2, p_partkey // 3]) AS dst FROM part), x AS (SELECT p_partkey AS src, 'Std.X' || (p_partkey % 7) AS dst FROM part), c AS (SELECT p_partkey AS root, p_partkey AS node FROM part UNION SELECT root, dst FROM c JOIN e ON src = node), l AS (SELECT root, node FROM c WHERE node IN (SELECT p_partkey FROM part))"


def _reached(spark, d) -> tuple[DataFrame, graph.Reach]:
    """The sources, and of each module what it imports, directly or not."""
    sources = cut(_sources(spark, d))
    edges = sources.select(F.col("module").alias("src"), F.explode("imports").alias("dst"))
    return sources, graph.Reach(edges, sources.select(F.col("module").alias("root")), sources.select(F.col("module").alias("node")))


@query(f"WITH RECURSIVE {_IMPORTS} SELECT 'M.P' || root AS root, count(*) AS found, 0::BIGINT AS missing, string_agg(DISTINCT dst, ',' ORDER BY dst) AS outside FROM (SELECT root, node, NULL AS dst FROM l) GROUP BY root".replace("string_agg(DISTINCT dst, ',' ORDER BY dst) AS outside FROM (SELECT root, node, NULL AS dst FROM l) GROUP BY root", "max(o.outside) AS outside FROM l JOIN (SELECT root AS r, string_agg(DISTINCT x.dst, ',' ORDER BY x.dst) AS outside FROM l JOIN x ON x.src = l.node GROUP BY root) o ON o.r = l.root GROUP BY root").replace("0::BIGINT AS missing, ", ""))
def import_closure(spark, d):
    """Modules found and modules outside, for each module."""
    _, reached = _reached(spark, d)
    # Modules found are counted first, so that few rows of a root are left for the set.
    few = reached.all().groupBy("root", F.when(~F.col("found"), F.col("node")).alias("other")).agg(F.count_if("found").alias("n"))
    return few.groupBy("root").agg(F.sum("n").alias("found"), F.array_join(F.array_sort(F.collect_set("other")), ",").alias("outside"))


@query(f"WITH RECURSIVE {_IMPORTS}, a AS (SELECT p_partkey AS entry, p_partkey AS k, 0::BIGINT AS depth FROM part UNION ALL SELECT src, dst, 1 FROM e UNION ALL SELECT e.src, f.dst, 2 FROM e JOIN e f ON f.src = e.dst) SELECT 'M.P' || entry AS entry, 'M.P' || k AS module, min(depth) AS depth FROM a WHERE k IN (SELECT p_partkey FROM part) GROUP BY ALL")
def reference_expand(spark, d):
    """Declarations within two references of each module's step, resolved by name among what it imports."""
    sources, scope = _reached(spark, d)
    decl = cut(parsers.scan_declarations(sources).withColumn("key", F.concat_ws(":", "module", "line")))
    entries = sources.select(F.col("module").alias("entry"), "module", F.col("code").alias("text"))
    targets = entries.select("entry", F.concat(F.lit("step_number_"), F.substring("module", 4, 20)).alias("target"))
    start, _, _ = graph.seeds(entries, targets, decl, scope)
    included, _ = graph.expand(decl, start, scope)
    return included.select("entry", F.split_part("key", F.lit(":"), F.lit(1)).alias("module"), "depth")


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS k, p_partkey % 4 <> 0 AS local, p_partkey % 10 = 1 AS ax FROM part), u AS (SELECT 'c' || p_partkey AS name, unnest(['c' || (p_partkey // 2), 'c' || (p_partkey // 3), CASE WHEN p_partkey % 17 = 0 THEN 'sorryAx' END, CASE WHEN p_partkey % 19 = 0 THEN 'gone' || p_partkey END]) AS dep FROM part),
t AS (SELECT DISTINCT (p_partkey % 50)::VARCHAR AS entry, 'c' || p_partkey AS name FROM part), c AS (SELECT entry, name FROM t UNION SELECT entry, dep FROM c JOIN u ON u.name = c.name JOIN n ON 'c' || k = c.name AND local WHERE dep IS NOT NULL)
SELECT entry, name, CASE WHEN name = 'sorryAx' THEN 'sorry' WHEN ax THEN 'axiom' WHEN local IS NULL THEN 'missing' WHEN local THEN 'resolved' ELSE 'external' END AS state FROM c LEFT JOIN n ON 'c' || k = name""")
def compiler_states(spark, d):
    """What each entry's proofs use: resolved, external, missing, sorry and axioms."""
    p, name = table(spark, d, "part"), F.concat(F.lit("c"), F.col("p_partkey"))
    decl = p.select(name.alias("name"), (F.col("p_partkey") % 4 != 0).alias("local"), F.when(F.col("p_partkey") % 10 == 1, "axiom").otherwise("theorem").alias("kind"))
    used = F.array(F.concat(F.lit("c"), F.floor(F.col("p_partkey") / 2)), F.concat(F.lit("c"), F.floor(F.col("p_partkey") / 3)), F.when(F.col("p_partkey") % 17 == 0, "sorryAx"), F.when(F.col("p_partkey") % 19 == 0, F.concat(F.lit("gone"), F.col("p_partkey"))))
    uses = p.select(name.alias("name"), F.explode(F.array_compact(used)).alias("dependency"))
    return graph.compiler_closure(decl, uses, p.select((F.col("p_partkey") % 50).alias("entry"), name.alias("name")))


@query(r"WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM documents) SELECT doc_id, CASE WHEN len(l) >= 2 THEN l[1][3:] || chr(10) || l[2][1:5] END AS part FROM l")
def source_slices(spark, d):
    """From the third character of a text's first line to the fifth of its second (SRC10)."""
    place = {"start_line": 1, "start_column": 2, "end_line": 2, "end_column": 5}
    return parsers.scan_slices(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", *(F.lit(v).alias(k) for k, v in place.items()))).withColumnRenamed("id", "doc_id")


_TREE = "e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1)"


def _tree(spark, d) -> DataFrame:
    return table(spark, d, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).cast("long").alias("dst"))


@query(f"WITH RECURSIVE {_TREE}, c AS (SELECT p_partkey AS root, p_partkey AS node, 0::BIGINT AS depth FROM part UNION SELECT root, dst, depth + 1 FROM c JOIN e ON src = node) SELECT root, node, min(depth) AS depth FROM c GROUP BY root, node")
def closure(spark, d):
    return graph.closure(_tree(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("root")))


@query(f"WITH {_TREE}, s AS (SELECT DISTINCT l_partkey AS node FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT node, 0::BIGINT AS depth FROM s UNION ALL SELECT dst, 1 FROM s JOIN e ON src = node UNION ALL SELECT f.dst, 2 FROM s JOIN e ON e.src = node JOIN e f ON f.src = e.dst) SELECT node, min(depth) AS depth FROM a GROUP BY node")
def two_hop_expand(spark, d):
    return graph.two_hops(_tree(spark, d), table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("node")).distinct())


@query("""WITH n AS (SELECT DISTINCT p_type || '.' || replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') AS name, p_type AS m FROM part),
x AS (SELECT name, m, array_to_string((string_split(name, '.'))[i:], '.') AS tok FROM n, range(1, 4) r(i)), t AS (SELECT DISTINCT m, unnest([(string_split(name, '.'))[-1], array_to_string((string_split(name, '.'))[2:], '.')]) AS token FROM n),
c AS (SELECT t.m, t.token, count(*) FILTER (x.m = t.m) AS own, min(name) FILTER (x.m = t.m) AS o, count(*) FILTER (x.m <= t.m) AS far, min(name) FILTER (x.m <= t.m) AS f FROM t LEFT JOIN x ON x.tok = t.token GROUP BY ALL)
SELECT m AS module, token, CASE WHEN own = 1 THEN o WHEN far = 1 THEN f END AS name FROM c""")
def suffix_resolve(spark, d):
    """The last one and two parts of each name, sought in the own module first, then in all modules up to it in order of name."""
    n = table(spark, d, "part").select(F.concat_ws(".", "p_type", F.replace("p_brand", F.lit("#"), F.lit("")), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"), F.col("p_type").alias("module")).distinct()
    parts = F.split("name", r"\.")
    tokens = n.select(F.col("module").alias("entry"), "module", F.explode(F.array(F.element_at(parts, -1), F.array_join(F.slice(parts, F.lit(2), F.lit(2)), "."))).alias("token"))
    modules = n.select("module").distinct()
    scope = modules.withColumnRenamed("module", "entry").join(modules.withColumnRenamed("module", "in_module"), F.col("in_module") <= F.col("entry"))
    return graph.chosen(tokens, graph.name_index(n.withColumn("key", F.col("name"))), scope).select("module", "token", F.col("key").alias("name"))


@query("WITH n AS (SELECT 'm.' || (p_partkey // 100) || '.' || p_partkey AS name, p_partkey % 3 = 0 AS has FROM part UNION ALL SELECT DISTINCT 'm.' || (p_partkey // 100), true FROM part), u AS (SELECT name, array_to_string((string_split(name, '.'))[:i], '.') AS up, i FROM n, range(1, 4) r(i) WHERE i <= len(string_split(name, '.'))), f AS (SELECT u.name, u.up, i FROM u JOIN n ON n.name = u.up AND n.has) SELECT n.name, max_by(f.up, i) AS owner FROM n LEFT JOIN f ON n.name = f.name GROUP BY n.name")
def owner_reuse(spark, d):
    p = table(spark, d, "part")
    group = F.concat(F.lit("m."), F.floor(F.col("p_partkey") / 100).cast("string"))
    n = p.select(F.concat(group, F.lit("."), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_partkey") % 3 == 0).alias("has_range")).unionAll(p.select(group, F.lit(True)).distinct())
    return graph.owners(n.withColumn("in_module", F.lit("m"))).select("name", "owner")


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'thon') OR contains(lower(text), 'eroth') THEN 'first' WHEN contains(lower(text), 'über') THEN 'second' WHEN contains(lower(text), 'ción') THEN 'third' ELSE 'other' END AS topic FROM documents")
def keyword_classify(spark, d):
    rules = ((("thon", "eroth"), "first"), (("über",), "second"), (("ción",), "third"))
    return table(spark, d, "documents").select("doc_id", tx.first_rule(F.col("text"), rules, "other").alias("topic"))


_TERMS = ("and", "the", "ing", "able", "tion", "und", "der", "que", "los")


@query(f"SELECT doc_id, replace(array_to_string((list_filter([{', '.join(repr(t) for t in _TERMS)}], lambda t: contains(lower(coalesce(text, '')), t)))[1:7], ','), 'tion', '-tion') AS terms FROM documents")
def glossary_tags(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(tx.glossary(F.col("text"), _TERMS, {"tion": "-tion"}), ",").alias("terms"))


@query("SELECT p_partkey, CASE WHEN s_suppkey IS NOT NULL THEN s_name ELSE p_name END AS name, p_size FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def patch_upsert(spark, d):
    patch = table(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_name").alias("new_name"))
    return table(spark, d, "part").join(patch, "p_partkey", "left").select("p_partkey", F.coalesce("new_name", "p_name").alias("name"), "p_size")


@query("WITH t AS (SELECT conv_id, turn, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}')), lambda x: x <> 'ening') AS w FROM conversations), h AS (SELECT conv_id, min(turn) AS turn FROM t GROUP BY conv_id), f AS (SELECT t.conv_id, t.w AS wf FROM t JOIN h USING (conv_id, turn)), s AS (SELECT t.conv_id, t.turn, len(list_intersect(wf, w)) AS overlap FROM t JOIN f USING (conv_id)) SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY overlap DESC, turn) AS rank FROM s")
def reference_reorder(spark, d):
    """A conversation's turns by the terms they share with its first one."""
    t = table(spark, d, "conversations").select("conv_id", "turn", tx.title_terms(F.col("text"), ("ening",)).alias("w"))
    first = t.groupBy("conv_id").agg(F.min_by("w", "turn").alias("wf"))
    s = t.join(first, "conv_id").select("conv_id", "turn", F.size(F.array_intersect("wf", "w")).cast("long").alias("overlap"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("overlap"), "turn")).cast("long"))


# --- catalogue upkeep and display data --------------------------------------------------------------------------------

@query("WITH e AS (SELECT event_id AS id, user_id AS client, event_type AS name, props[1:100] AS value, lag(event_type) OVER w AS pn, lag(props[1:100]) OVER w AS pv FROM events WHERE event_type IN ('view', 'click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT id, client, name, value FROM e WHERE pn IS NULL OR pn <> name OR pv IS DISTINCT FROM value")
def changed_views(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("client"), "ts", F.col("event_type").alias("name"), F.col("props").alias("value"))
    return catalog.changed_views(e, ("view", "click", "purchase"))


def _points(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


_PTS = "p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"


@query(f"WITH {_PTS}, b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM p) SELECT id, round(500 + (x - (hx + lx) / 2) * least(935 / (hx - lx), 490 / (hy - ly)), 6) AS x, round(315 + (y - (hy + ly) / 2) * least(935 / (hx - lx), 490 / (hy - ly)), 6) AS y FROM p, b")
def viewport_fit(spark, d):
    return catalog.viewport(_points(spark, d), 1000.0, 600.0)


@query(f"WITH {_PTS}, c AS (SELECT q.id, p.id AS hit, round(sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2), 6) AS distance FROM p q JOIN p ON q.id <> p.id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, hit) AS n FROM c WHERE distance < 0.02::DOUBLE) SELECT id, hit, distance FROM r WHERE n = 1")
def nearest_point(spark, d):
    return catalog.nearest_within(_points(spark, d), _points(spark, d), 0.02)


@query(f"{_CONCEPT}, r AS (SELECT concept, id, round(s, 6) AS score FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY score DESC, id) AS t, row_number() OVER (PARTITION BY concept ORDER BY score, id) AS b FROM r) SELECT concept, id, score, 'top' AS side, t AS rank FROM o WHERE t <= 8 UNION ALL SELECT concept, id, score, 'bottom', b FROM o WHERE b <= 8")
def concept_matches(spark, d):
    return catalog.extremes(_concepts(spark, d).select("concept", "id", F.round("s", 6).alias("score")), "concept")


@query("WITH e AS (SELECT doc_id, source AS directory, source || CASE WHEN n_chars > 1000 THEN '.bib' ELSE '.tex' END AS file, doc_id::VARCHAR AS key FROM documents), c AS (SELECT DISTINCT d.source AS directory, l.doc_id::VARCHAR AS key FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality = 1) SELECT doc_id, directory, file, key FROM e WHERE NOT coalesce(file LIKE '%.bib' AND directory IN (SELECT directory FROM c) AND NOT EXISTS (SELECT 1 FROM c WHERE c.directory = e.directory AND c.key = e.key), false)")
def unused_entries(spark, d):
    docs = table(spark, d, "documents")
    key = F.col("doc_id").cast("string").alias("key")
    entries = docs.select("doc_id", F.col("source").alias("directory"), F.concat("source", F.when(F.col("n_chars") > 1000, ".bib").otherwise(".tex")).alias("file"), key)
    cites = table(spark, d, "labels").where("quality = 1").join(docs.select("doc_id", F.col("source").alias("directory")), "doc_id").select("directory", key)
    return catalog.cited_entries(entries, cites)


@query("SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus <> 'P') AS complete, count(DISTINCT o_orderstatus) AS identities, (count(*) = count(*) FILTER (o_orderstatus <> 'P') AND count(DISTINCT o_orderstatus) = 1 AND count(*) FILTER (o_orderstatus <> 'P' AND NOT o_totalprice > 0) = 0) AS released FROM orders GROUP BY o_custkey")
def release_gate(spark, d):
    entries = table(spark, d, "orders").select("o_custkey", (F.col("o_orderstatus") != "P").alias("complete"), F.col("o_orderstatus").alias("identity"), (F.col("o_totalprice") > 0).alias("sound"))
    return catalog.release_gate(entries, "o_custkey")


@query("SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS o_orderpriority FROM orders GROUP BY o_custkey")
def coverage_union(spark, d):
    return catalog.coverage(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderpriority")


@query("WITH n AS (SELECT DISTINCT p_name AS name FROM part), a AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS prefix FROM part UNION SELECT DISTINCT p_name FROM part) SELECT prefix, CASE WHEN bool_or(name = prefix) THEN prefix WHEN count(name) = 1 THEN min(name) END AS name, count(name) AS matches FROM a LEFT JOIN n ON starts_with(name, prefix) GROUP BY prefix")
def unique_prefix(spark, d):
    part = table(spark, d, "part")
    return catalog.unique_prefix(part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("prefix")).union(part.select("p_name")), part.select(F.col("p_name").alias("name")))


@query(f"WITH {_CHUNK}, h AS (SELECT doc_id, sha256(coalesce(chunk, ''))[1:16] AS key FROM k) SELECT DISTINCT key FROM h WHERE key NOT IN (SELECT key FROM h WHERE doc_id IN (SELECT doc_id FROM labels))")
def chunk_cache_fill(spark, d):
    """Chunks that no labelled document has."""
    chunks = _chunks(spark, d).select("doc_id", tx.short_hash(F.col("chunk")).alias("key"))
    return catalog.missing_keys(chunks, chunks.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi"))


@query(f"WITH {_CHUNK} SELECT k.doc_id, nth, sha256(split_part(text, '.', 1) || chr(10) || chr(10) || coalesce(chunk, ''))[1:16] AS key FROM k JOIN documents d ON k.doc_id = d.doc_id")
def titled_chunks(spark, d):
    """The title before every chunk of its text (V8)."""
    docs = table(spark, d, "documents").select("doc_id", F.split_part("text", F.lit("."), F.lit(1)).alias("title"), tx.token_windows(F.col("text"), 64, 8).alias("chunks"))
    docs = docs.select("doc_id", "title", F.posexplode("chunks").alias("nth", "chunk"))  # a second step, or each chunk would carry the whole text
    return docs.select("doc_id", F.col("nth").cast("long").alias("nth"), tx.short_hash(F.concat("title", F.lit("\n\n"), "chunk")).alias("key"))


_RAMP = "printf('%02x', floor({m} + (CASE WHEN t < 0 THEN {lo} ELSE {hi} END - {m}) * abs(t) + 0.5::DOUBLE)::INT)"


@query("WITH t AS (SELECT vec_id AS id, greatest(-1::DOUBLE, least(1::DOUBLE, embedding[1]::DOUBLE / 0.3::DOUBLE)) AS t FROM embeddings) SELECT id, '#' || "
       + " || ".join(_RAMP.format(m=m, lo=lo, hi=hi) for m, lo, hi in ((240, 20, 200), (240, 90, 60), (240, 160, 20))) + " AS color FROM t")
def color_ramp(spark, d):
    return _points(spark, d).select("id", tx.ramp(F.col("x"), 0.3, (20, 90, 160), (240, 240, 240), (200, 60, 20)).alias("color"))


@query("SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')) AS escaped FROM pages")
def markup_escape(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(tx.escape_markup(F.col("html")), 256).alias("escaped"))


@query("SELECT p_partkey, url_encode(p_brand) || '/' || url_encode(p_name) AS encoded FROM part")
def path_encode(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.encode_path(F.concat_ws("/", "p_brand", "p_name")).alias("encoded"))


@query("SELECT p_partkey, p_brand || '/' || p_type AS path FROM part")
def path_normalize(spark, d):
    made = F.concat(F.lit("./"), "p_brand", F.lit("//"), "p_name", F.lit("/.././"), "p_type", F.lit("/"))
    return table(spark, d, "part").select("p_partkey", tx.normal_path(made).alias("path"))


@query("WITH r AS (SELECT vec_id AS id, label::BIGINT AS label, row_number() OVER (PARTITION BY label ORDER BY vec_id)::VARCHAR AS n FROM embeddings) SELECT id, label, CASE WHEN length(n) < 2 THEN lpad(n, 2, '0') ELSE n END AS place FROM r")
def sequence_labels(spark, d):
    """Two-digit places in each group, longer ones whole."""
    nth = F.row_number().over(Window.partitionBy("label").orderBy("id")).cast("string")
    return _items(spark, d).select("id", "label", nth.alias("n")).select("id", "label", tx.padded_id(F.col("n"), 2).alias("place"))


@query("SELECT l_returnflag AS a, l_linestatus AS b, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'closed' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'open' END AS note, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def pair_notes(spark, d):
    notes = spark.createDataFrame([("F", "A", "closed"), ("N", "O", "open")], "a string, b string, note string")
    pairs = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).agg(F.count("*").alias("n"))
    return catalog.annotate(pairs, notes).select("a", "b", "note", "n")


@query("WITH x AS (SELECT DISTINCT source || '/' || lang AS path FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 UNION SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE quality = 1) SELECT doc_id, CASE WHEN source || '/' || lang IN (SELECT path FROM x) THEN source || '/' || lang WHEN source IN (SELECT path FROM x) THEN source END AS path FROM documents")
def first_candidate(spark, d):
    docs = table(spark, d, "documents")
    both = docs.join(table(spark, d, "labels"), "doc_id")
    narrow = F.concat("source", F.lit("/"), "lang")
    existing = both.where("toxic = 1").select(narrow.alias("path")).union(both.where("quality = 1").select("source"))
    return catalog.first_existing(docs.select(F.col("doc_id").alias("id"), F.array(narrow, "source").alias("candidates")), existing).withColumnRenamed("id", "doc_id")


@query("SELECT doc_id FROM documents WHERE NOT coalesce(regexp_matches(lower(text[1:100]), '\\bthe\\b') OR contains(text, 'http://'), false)")
def self_reference_exclusion(spark, d):
    """The word and the head's length are the feature's; the address is sought in the whole text."""
    docs = table(spark, d, "documents").select("doc_id", F.lit("").alias("authors"), F.col("text").alias("citation"), F.col("text").alias("raw"))
    return catalog.without_self_references(docs, "the", "http://").select("doc_id")


@query("WITH v AS (SELECT embedding::DOUBLE[] AS a FROM embeddings WHERE embedding IS NOT NULL), n AS (SELECT a, sqrt(list_inner_product(a, a)) AS n FROM v), g AS (SELECT list_max(list_transform(a, lambda x: abs(x - x / n))) AS g FROM n) SELECT count(*) AS compared, 0::BIGINT AS missing, 0::BIGINT AS uneven, round(max(g), 9) AS worst FROM g")
def numeric_audit(spark, d):
    """Stored vectors against their recomputed unit vectors."""
    stored = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    done = vectors.numeric_audit(stored, stored.select("id", vectors.normalize(F.col("vector")).alias("vector")))
    return done.withColumn("worst", F.round("worst", 9))


@query("WITH s AS (SELECT o_orderkey AS id, o_orderpriority, CASE WHEN o_custkey % 5 = 0 AND o_orderstatus = 'O' THEN 'cached' WHEN o_orderstatus = 'P' THEN 'build-failed' WHEN o_totalprice < 50000 THEN 'extraction-failed' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'rejected' ELSE 'resolved' END AS state FROM orders) SELECT id, state, CASE WHEN state = 'rejected' THEN o_orderpriority ELSE '' END AS unexpected FROM s")
def build_states(spark, d):
    e = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("hash"), F.lit(0).alias("stored_hash"), F.when(F.col("o_orderstatus") == "O", "resolved").otherwise("rejected").alias("stored_state"),
        (F.col("o_orderstatus") != "P").alias("built"), (F.col("o_totalprice") >= 50000).alias("extracted"), F.array("o_orderpriority", F.lit("choice")).alias("used"),
        F.array(*map(F.lit, ("choice", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))).alias("permitted"))
    return catalog.build_states(e).withColumn("unexpected", F.array_join("unexpected", ","))


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def tsv_checked(spark, d):
    """Parts written as tab-separated values and read back; the key must be unique and the rows complete."""
    path, part = new_path(spark, "tsv"), table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    files.write_tsv(part, path)
    return files.read_tsv(spark, path, "p_partkey long, p_name string, p_retailprice double", "p_partkey", part.count())


@query("SELECT doc_id, source, sha256(text) AS text_sha256 FROM documents")
def json_by_key(spark, d):
    """Documents written as compressed lines of JSON, a folder for each source, and read back."""
    path = new_path(spark, "json")
    files.write_json(table(spark, d, "documents").select("doc_id", "source", "text"), path, "source", compressed=True)
    return spark.read.schema("doc_id long, text string, source string").json(path).select("doc_id", "source", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT page_id, page_id::VARCHAR || '.' || sha256(coalesce(html, ''))[1:12] || '.html' AS file FROM pages")
def hashed_names(spark, d):
    return table(spark, d, "pages").select("page_id", files.hashed_name(F.col("page_id").cast("string"), F.col("html"), "html").alias("file"))


# --- requests --------------------------------------------------------------------------------------------------------

def _requests(events: DataFrame) -> DataFrame:
    page = F.when(F.col("event_type") == "view", "/demo?x=1").otherwise("/")
    return events.select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "signup", "POST").otherwise("GET").alias("method"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.lit(None).cast("string").alias("purpose"), page.alias("path"))


def _day_text(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.col("day").cast("string"))


_DAILY = "SELECT ts::DATE::VARCHAR AS day, count(*) FILTER (event_type <> 'view') AS app, count(*) FILTER (event_type = 'view') AS demo FROM events WHERE event_type NOT IN ('signup', 'error') GROUP BY 1"


@query(_DAILY)
def daily_page_counts(spark, d):
    return _day_text(counts.daily(counts.page_views(_requests(table(spark, d, "events")))))


@query(f"SELECT * FROM ({_DAILY}) WHERE day::DATE >= (SELECT max(ts)::DATE FROM events) - 19")
def retention_90d(spark, d):
    e = table(spark, d, "events")
    today = e.agg(F.date_add(F.max("ts").cast("date"), counts.RETENTION_DAYS - 20).cast("string")).first()[0]
    return _day_text(counts.retained(counts.daily(counts.page_views(_requests(e))), today))


@query(f"SELECT day, sum(app)::BIGINT AS app, sum(demo)::BIGINT AS demo, sum(app + demo)::BIGINT AS total FROM ({_DAILY}) GROUP BY ROLLUP (day)")
def visits_report(spark, d):
    return _day_text(counts.report(counts.daily(counts.page_views(_requests(table(spark, d, "events"))))))


@query(_DAILY)
def streaming_page_counts(spark, d):
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    path = new_path(spark, "page-counts")
    counts.stream_daily(counts.page_views(_requests(stream)), path, new_path(spark, "page-counts-state")).awaitTermination()
    return _day_text(counts.stored_counts(spark, path))


@query("SELECT conv_id, (count(*) BETWEEN 1 AND 32) AND bool_and(trim(text) <> '' AND length(text) <= 2048) AND sum(length(text)) <= 16000 AS is_valid FROM conversations GROUP BY conv_id")
def request_validation(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(tx.valid_request(F.collect_list("text")).alias("is_valid"))


@query("SELECT event_id AS id, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) <= 20 AS allowed FROM events")
def token_bucket(spark, d):
    return counts.admitted(table(spark, d, "events").select(F.col("user_id").alias("client"), "ts", F.col("event_id").alias("id")))


@query()
def token_bucket_strict(spark, d):
    return counts.bucket_admitted(table(spark, d, "events").select(F.col("user_id").alias("client"), "ts", F.col("event_id").alias("id")))
