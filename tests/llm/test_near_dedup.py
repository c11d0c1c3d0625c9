"""Near-duplicates: odd ids, repeated rows, empty tables, many copies, very long texts."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from corpusweave.llm import near_dedup
from corpusweave.llm import textbytes as tb

RNG = np.random.default_rng(12)
SCHEMA = "doc_id long, text string, near_id string, near_digest string, Near_Own string"


def text(n):
    return " ".join(f"w{i}" for i in RNG.integers(0, 4000, n))


def near(t):
    return " ".join([*t.split()[:-1], "changed"])


def test_one_row_of_each_component_stays(spark):
    a, b, c, d, e = (text(80) for _ in range(5))
    data = [(1, a), (1, a), (1, near(a)), (2, a), (3, b), (3, c), (None, d), (None, near(d)), (None, e), (9, near(e)), (5, None), (5, None), (6, ""), (7, " "), (None, None), (8, "one"), (8, "one")]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in data], SCHEMA)
    got = near_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    assert sum(n for (_, t), n in kept.items() if not (t or "").strip()) == 5
    told = {t: n for (_, t), n in kept.items() if t and t.strip()}
    assert set(told.values()) == {1} and {b, c, "one"} <= set(told)
    assert len({a, near(a)} & set(told)) == 1 and len({d, near(d)} & set(told)) == 1 and kept[(9, near(e))] == 1 and len(told) == 6
    again = Counter((r.doc_id, r.text) for r in near_dedup.deduplicated(docs.repartition(5)).collect())
    assert again == kept


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.deduplicated(empty).collect() == []


def test_many_copies_and_a_large_near_group(spark):
    a, words = text(60), [f"v{i}" for i in range(70)]
    copies = spark.range(100_000).selectExpr("id AS doc_id").crossJoin(spark.createDataFrame([(a,)], "text string"))
    several = spark.createDataFrame([(200_000 + i, " ".join([*words, f"end{i}"])) for i in range(300)] + [(300_000, text(60))], "doc_id long, text string")
    got = near_dedup.near_duplicates(copies.unionByName(several)).groupBy("component_id").count().collect()
    assert {(r.component_id, r["count"]) for r in got} == {(0, 100_000), (200_000, 300), (300_000, 1)}


def test_signatures_of_slices_equal_those_of_the_whole(monkeypatch):
    sets = [np.unique(RNG.integers(0, 2**63, n, dtype=np.uint64)) for n in (0, 1, 700, 3, 0, 900)]
    elements, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    whole = near_dedup.super_min_hash(elements, starts)
    monkeypatch.setattr(near_dedup, "SLICE", 64)
    assert (near_dedup.super_min_hash(elements, starts) == whole).all()
    texts = pa.array([text(300), None, "a b", text(40)])
    h, at = near_dedup.shingle_sets(texts, 5)
    monkeypatch.undo()
    g, to = near_dedup.shingle_sets(texts, 5)
    one = near_dedup.shingle_sets(texts.slice(0, 1), 5)[0]
    assert (h == g).all() and (at == to).all() and (one == g[:to[1]]).all()


def test_a_very_long_text_takes_bounded_memory():
    long = pa.array([" ".join(np.array([f"w{i}" for i in range(5000)])[RNG.integers(0, 5000, 4_000_000)])])  # 23 MB
    tracemalloc.start()
    sets, starts = near_dedup.shingle_sets(long, 5)
    near_dedup.super_min_hash(sets, starts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(sets) > 3_900_000 and peak < 200 << 20


def test_words_are_the_same_in_stretches(monkeypatch):
    texts = pa.array([text(50), None, "", "é " + text(30), "x" * 500, " y"])
    want = tb.words(texts, tb.SPACED)
    monkeypatch.setattr(tb, "PIECE", 64)
    got = tb.words(texts, tb.SPACED)
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all()


def test_every_pair_of_roots_meets_in_one_tile(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 8)
    monkeypatch.setattr(near_dedup, "TILE_SHINGLES", 1000)
    rows = [(k, n, 0, 5) for k in (1, 4) for n in range(30)] + [(k, 100 + n, 100 + n, 5) for k in (1, 4) for n in range(20)] + [(2, n, 0, 5) for n in range(40)] + [(3, 7, 7, 3000), (3, 8, 8, 9), (3, 9, 8, 9)]
    table = spark.createDataFrame(rows, "key long, node long, root long, size long")
    tiles = {}
    for r in near_dedup.tiled(table).collect():
        tiles.setdefault((r.key, r.low, r.high), []).append(r)
    met = Counter()
    for (key, low, high), members in tiles.items():
        assert len(members) <= 34 and {m.block for m in members} <= {low, high}
        for i, a in enumerate(members):
            for b in members[:i]:
                if a.root != b.root and (low == high or a.block != b.block):
                    met[(key, *sorted((a.node, b.node)))] += 1
    want = {(k, *sorted((n, m))) for k, n, r, _ in rows for j, m, q, _ in rows if k == j != 4 and r != q}  # bucket 4 has the nodes of bucket 1
    assert set(met) == want and set(met.values()) == {1}
    assert not any(k in (2, 4) for k, *_ in tiles) and not any(low == high and low.startswith("0:") for _, low, high in tiles)


def test_dropped_ids_are_sent_and_texts_stay_in_place(spark, monkeypatch):
    texts = [text(60) for _ in range(40)]
    docs = spark.createDataFrame([(i, texts[i % 40], "x", "y", "z") for i in range(120)] + [(1, texts[1], "x", "y", "z")], SCHEMA)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = near_dedup.deduplicated(docs)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
        rows = Counter(got.collect())
        monkeypatch.setattr(near_dedup, "SENT_ROWS", 0)
        shuffled = near_dedup.deduplicated(docs)
        assert "SortMergeJoin" in shuffled._jdf.queryExecution().executedPlan().toString()
        assert Counter(shuffled.collect()) == rows and sorted(r.doc_id for r in rows) == list(range(40)) and set(rows.values()) == {1}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
