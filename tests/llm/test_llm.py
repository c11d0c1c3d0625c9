"""The training-data operators against brute force, on small tables with every odd case."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusweave.llm import chat, decontaminate, language_id, mixing, near_dedup, quality_crf, quality_rules, sharding, simple8b, store, suffix_dedup, token_files

RNG = np.random.default_rng(5)
WORDS = {lang: [a + b + c for a in x for b in y for c in z] for lang, x, y, z in (
    ("en", ["th", "wh", "st", "an"], ["ing", "ere", "on", "at"], ["", "s", "ly", "ed"]), ("de", ["sch", "über", "ge", "zu"], ["ein", "ung", "keit", "ach"], ["", "en", "er", "st"]))}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string"


def prose(lang, n):
    w = RNG.choice(WORDS[lang], n)
    return ". ".join(" ".join(w[i:i + 9]) for i in range(0, n, 9))


@pytest.fixture(scope="module")
def rows():
    out = [(prose(lang, int(RNG.integers(30, 120))), lang, f"s{i % 4}") for i in range(40) for lang in ("en", "de")]
    base = out[0][0]
    words = base.split()
    out += [(base, "en", "s0")] * 3 + [(" ".join([*words[:-1], "changed"]), "en", "s1"), ("x " + base[20:200] + " y", "en", "s2")]
    out += [(None, "en", "s0"), ("", "de", None), (" \n ", None, "s1"), ("a", "en", "s3"), ("12 34", "en", "s3"), (prose("en", 20000), "en", "s2"), ("line one here\n" * 30, "en", "s1"), ("WORD!! " * 40, "de", "s1")]
    return [(i, t, lang, s, None if t is None else len(t), "clash", "clash") for i, (t, lang, s) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows + [rows[3]] + [(None, "a text without an id " * 5, "en", "s0", 1, "", "")], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_sharding(docs, empty):
    got = sharding.place_documents(docs, 5, 256).toPandas()
    assert len(got) == docs.count() and sharding.place_documents(empty).count() == 0
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got.dropna(subset=["doc_id"]).itertuples():
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    slot = got.groupby("virtual_slot").agg(n=("size", "sum"), shards=("shard", "nunique"))
    load = got.groupby("shard")["size"].sum().reindex(range(5), fill_value=0)
    # Bytes are even as far as whole slots allow: no shard is over its share by more than one slot.
    assert slot.shards.max() == 1 and (load - got["size"].sum() / 5).max() <= slot.n.max()
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all()


def test_bytes_are_even_where_no_record_is_large(spark):
    """Within 1 % with 8,192 slots, though a third of all rows has one text."""
    table = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same text' ELSE repeat('x', int(id % 90)) END AS text")
    got = sharding.place_documents(table, 24).groupBy("shard").agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.max("slot").alias("last")).toPandas()
    assert len(got) == 24 and got.n.max() < 1.01 * got.n.mean() and got.n.min() > 0.99 * got.n.mean() and (got["last"] + 1 == got["rows"]).all()


def test_assigned_shards_keep_all_columns(spark, docs, empty):
    odd = docs.withColumnRenamed("size", "Virtual_Slot").withColumnRenamed("key", "shard")
    got = sharding.assign_shards(odd, 5, 256)
    assert got.count() == docs.count() and got.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "virtual_slot"] and sharding.assign_shards(empty).count() == 0


def test_growing_a_map_moves_slots_into_the_new_shard_only(docs):
    size = docs.select(sharding.virtual_slot(F.col("doc_id"), F.col("text"), 64).alias("virtual_slot"), sharding.size_bytes(F.col("text")).alias("size"))
    first = sharding.edit_map(sharding.first_map(sharding.slot_totals(size), 3, 64), 3, 2)
    grown = sharding.edit_map(first, 4, 3, only_into=3)
    a, b = ({r.virtual_slot: r.shard for r in m.collect()} for m in (first, grown))
    assert len(b) == 64 and all(b[s] in (a[s], 3) for s in b) and 3 in b.values()


def test_quality_counts(docs, empty):
    got = quality_rules.apply_rules(docs, prior=5).collect()
    assert len(got) == docs.count() and quality_rules.apply_rules(empty).count() == 0
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        if r.doc_id is None:
            continue
        w, lines = spaced(text[r.doc_id]), [x for x in (text[r.doc_id] or "").split("\n") if spaced(x)]
        seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_thresholds_are_the_merged_quartiles(spark):
    """A group's fences from its own values, its language's as ten rows, and all rows' as ten of the language's."""
    values = {("en", "a"): [0] * 30 + [5, 900], ("en", None): [700, 800], (None, "a"): [100] * 4}
    rows = [(g[0], g[1], v) for g, x in values.items() for v in x]
    sketch = spark.createDataFrame(rows, "lang string, source string, bucket long").groupBy("lang", "source", "bucket").agg(F.count("*").alias("n")).withColumn("metric", F.lit("repeats"))
    got = {(r.lang, r.source): r.repeats_max for r in quality_rules.thresholds(sketch, 10).collect()}
    every = Counter(v for _, _, v in rows)
    for (lang, source), own in values.items():
        mine = Counter(v for a, _, v in rows if a == lang)
        blend = {v: mine[v] + 10 * every[v] / len(rows) for v in every}
        final = {v: own.count(v) + 10 * blend[v] / sum(blend.values()) for v in every}
        at = lambda q: next(v for v in sorted(final) if sum(final[x] for x in final if x <= v) >= q * sum(final.values()) - 1e-9)
        assert got[(lang, source)] == at(0.75) + 4 * max(at(0.75) - at(0.25), 60)


def test_sketch_buckets_keep_order_and_precision(spark):
    v = spark.range(0, 200000, 37).select("id", quality_rules.bucket(F.col("id")).alias("b")).toPandas()
    assert (v.b <= v.id).all() and ((v.id - v.b) <= v.id / 500).all() and v.b.is_monotonic_increasing


def brute_hits(text, items):
    """Word count, hit words and items with an occurring window."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    words, hit, ids = split(text), set(), set()
    for i, t in items:
        w = split(t)
        n = min(13, len(w))
        windows = {tuple(w[j:j + n]) for j in range(len(w) - n + 1)} if w else set()
        for j in range(len(words) - n + 1):
            if tuple(words[j:j + n]) in windows:
                hit |= set(range(j, j + n))
                ids.add(str(i))
    return len(words), len(hit), ids


def affected(text, items):
    """Whether a text holds a whole 13-word window, or hits of shorter items that are 5 % of its words."""
    words, hit, _ = brute_hits(text, items)
    return brute_hits(text, [(i, t) for i, t in items if len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))) >= 13])[1] > 0 or (hit > 0 and 20 * hit >= words)


def test_decontamination(spark, docs, empty):
    text = [r.text for r in docs.orderBy("doc_id").collect() if r.text and len(r.text) > 300]
    items = [(1, " ".join(re.findall(r"\w+", text[4])[5:25])), (2, "no such words " * 9), (3, None), (4, "..."), (5, "12 34"), (6, text[7].upper()), (6, text[9][:150])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(docs, bench).collect()
    by_id = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        words, hit, ids = brute_hits(by_id[r.doc_id], items)
        want = (words, hit, len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), hit > 0 and 20 * hit >= words)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want
    clean = {r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()}
    assert clean == {i for i, t in by_id.items() if not affected(t, items)} and clean < set(by_id)
    assert decontaminate.clean_documents(docs, bench).columns == docs.columns
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0 and decontaminate.find_contamination(empty, bench).count() == 0


def test_suffix_array_order():
    tokens = RNG.integers(0, 3, 300)
    order = decontaminate.suffix_array(tokens, 3, 64)
    assert [tuple(tokens[i:i + 64]) for i in order] == sorted(tuple(tokens[i:i + 64]) for i in range(300))


def test_language(docs, empty):
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    want = {r.doc_id: r for r in docs.collect()}
    for i, r in got.items():
        t = want[i].text
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
        if not t or not any(c.isalpha() for c in t):
            assert r.lang_pred == "und"
        elif len(t) > 60:
            assert r.lang_pred == want[i].lang or want[i].text.startswith(("WORD", "line"))
    kept = {r.doc_id for r in language_id.accepted(docs).collect()}
    assert all(i in kept for i, r in got.items() if r.score > 0.9) and language_id.accepted(empty).count() == 0


def test_language_scores_are_the_mean_of_subword_rows():
    """The model read byte by byte: every 2- to 4-gram of folded bytes that parts no border of words, hashed, averaged."""
    names, rng = ["a", "b", "c"], np.random.default_rng(3)
    model = language_id.Model(names, rng.normal(size=(language_id.BUCKETS + 1, 4)), rng.normal(size=3), 0.7)
    model.logits[:-1, -1], model.logits[-1] = 1, 0

    def slow(text):
        raw, fold = text.encode(), []
        for i, c in enumerate(raw):
            low = c | 0x20 if 65 <= c <= 90 else c
            if i and raw[i - 1] == 0xC3 and 0x80 <= c <= 0x9E and c != 0x97:
                low = c | 0x20
            fold.append(low if 97 <= low <= 122 or low >= 128 else 0)
        total, n = np.zeros(3), 0
        for k in (2, 3, 4):
            for i in range(len(fold) - k + 1):
                g = fold[i:i + k]
                if 0 in g[1:-1] or (g[0] == 0 and g[-1] == 0):
                    continue
                code = g[0]
                for j in range(1, k):
                    code = (code * 0x01000193 + g[j] + j + 1) % 2**32
                h = ((code ^ (code >> 15)) * 0x2C1B3C6D % 2**32) >> 16
                total, n = total + model.logits[h, :3], n + 1
        z = (total / max(n, 1) + model.bias) / 0.7
        e = np.exp(z - z.max())
        return int(z.argmax()), e.max() / e.sum()

    texts = ["The quick É Über fox", "x", "", "a-b 12c", prose("de", 40), "日本 ×÷ Ü"]
    best, score = model.predict(pa.array(texts))
    for t, b, s in zip(texts, best, score, strict=True):
        assert slow(t) == (b, pytest.approx(s))


def test_tokens_round_trip(docs, empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = token_files.read_files(token_files.write_files(docs, path)).orderBy("start").collect()
    library = token_files.Encoder(path).tokenizer
    ordered = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    at = 0
    for r, d in zip(got, ordered, strict=True):
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.read_files(token_files.write_files(empty, path)).count() == 0


def test_pre_tokens_part_as_the_library_does():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    coder = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["it's we'll  they've 'd 's'll x's' 're-do '", " a  b\n\n c \t", "   ", "", "é'sé ''s 12'm !'s a<|endoftext|>b", "x　y ½ ²", "a 's", "'", "'re", "日本語 ４"]
    ids, n = coder.encode(odd)
    assert np.split(ids, np.cumsum(n)[:-1])[0].tolist() == coder.tokenizer.encode(odd[0]).ids
    assert ids.tolist() == [i for t in odd for i in coder.tokenizer.encode(t, add_special_tokens=False).ids]


def test_long_texts_are_encoded_in_stretches(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    coder = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    odd = "".join(str(RNG.choice(["it's", " ", "  ", "we'll", "\n", " \n", "é!", "12", " <|endoftext|>", "日本", "'", "\t "])) for _ in range(3000))
    monkeypatch.setattr(token_files, "STRETCH", 50)
    assert "".join(token_files.stretches(odd)) == odd and len(list(token_files.stretches(odd))) > 20
    ids, n = coder.encode([odd, "", "x" * 300])
    assert coder.plain and np.split(ids, np.cumsum(n)[:-1])[0].tolist() == coder.tokenizer.encode(odd, add_special_tokens=False).ids and n[1] == 0


def test_other_tokenizers_go_to_the_library_whole():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import normalizers

    coder = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    coder.tokenizer.normalizer = normalizers.Lowercase()
    coder.plain = False
    ids, n = coder.encode(["Some WORDS", "more"])
    assert ids.tolist() == [i for t in ("some words", "more") for i in coder.tokenizer.encode(t).ids] and n.sum() == len(ids)


def test_simple8b():
    for n in (0, 1, 511, 512, 513, 4000):
        v = RNG.integers(0, 2**63, n, dtype=np.uint64) >> RNG.integers(0, 63, n).astype(np.uint64)
        v[::3] = 0
        v[5:6] = 2**64 - 1
        assert (simple8b.from_image(simple8b.to_image(np.array([7]), np.array([n]), v))[2] == v).all()


def fair_targets(sizes):
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, open_, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] > 2 * sizes[s]}
        if not over:
            return target | part
        target |= {s: 2.0 * sizes[s] for s in over}
        left, open_ = left - sum(2 * sizes[s] for s in over), open_ - over


def check_taken(sizes, copies):
    """sizes: (source, size) of each row; copies: how often each is taken. Whether the targets are met as far as documents allow."""
    totals, taken = Counter(), Counter()
    for (s, n), c in zip(sizes, copies, strict=True):
        totals[s] += n
        taken[s] += n * c
    assert max(copies, default=0) <= 2
    for s, goal in fair_targets(totals).items():
        left = goal - taken[s]
        # A row taken less than its source's fullest could be taken once more; none of these fits what is owed.
        most = int(goal // max(totals[s], 1)) + 1
        spare = [n for (x, n), c in zip(sizes, copies, strict=True) if x == s and n > 0 and c < most]
        assert left >= -1e-6 and (left < min(spare) if spare else left < 1 or goal >= 2 * totals[s] - 1e-6)


def test_mix(docs, empty):
    got = mixing.mix_counts(docs).toPandas()
    assert len(got) == docs.count() and mixing.mix_counts(empty).count() == 0 and got.copies.max() <= 2
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(spaced(r.text))
    target = fair_targets(sizes)
    for r in got.itertuples():
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source] and r.taken == r.copies * r.size
    check_taken([(r.source, r.size) for r in got.itertuples()], got.copies.tolist())
    again = mixing.mix_counts(docs.repartition(7)).toPandas()
    assert got.sort_values(["doc_id", "size"])["taken"].tolist() == again.sort_values(["doc_id", "size"])["taken"].tolist()
    mixed = mixing.mix(docs, n_shards=4).toPandas()
    assert len(mixed) == got.copies.sum() and mixed.out_shard.between(0, 3).all()


def test_mixed_documents_agree_with_the_counts_row_by_row(spark, docs, empty):
    rows = [(i, " ".join(["w"] * (1 + i % 50)), s, "x", "y") for i in range(40) for s in ("a", None)] * 10 + [(None, "no id " * 4, "a", "x", "y")] * 5 + [(1, "another text " * 9, "a", "x", "y"), (99, None, "a", "x", "y")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_at string, Mix_Shard string")
    for table in (docs, odd):
        counts, mixed = mixing.mix_counts(table).collect(), mixing.mixed_documents(table)
        assert mixed.columns == table.columns
        want, got = Counter(), Counter((r.doc_id, r.source, len(spaced(r.text))) for r in mixed.collect())
        for r in counts:
            want[(r.doc_id, r.source, r.size)] += r.copies
        assert +want == got
        check_taken([(r.source, r.size) for r in counts], [r.copies for r in counts])
    assert mixing.mixed_documents(empty).count() == 0


def test_mix_counts_come_from_the_tree(docs, monkeypatch):
    seen = []
    tree = mixing.split_tree
    monkeypatch.setattr(mixing, "split_tree", lambda *a: seen.append(a) or tree(*a).where("shard <> 0"))
    part = mixing.mix_counts(docs).toPandas().copies.sum()
    monkeypatch.undo()
    assert seen and 0 < part < mixing.mix_counts(docs).toPandas().copies.sum()


def test_mixed_documents_lie_in_their_shards(docs, monkeypatch):
    table = docs.where("doc_id IS NOT NULL").distinct()
    seen, extra = [], []
    plan, fill = mixing.shard_plan, mixing.fill
    monkeypatch.setattr(mixing, "shard_plan", lambda *a: seen.append(plan(*a)) or seen[-1])
    monkeypatch.setattr(mixing, "fill", lambda *a: extra.append(fill(*a)) or extra[-1])
    mixed = mixing.mixed_documents(table, n_shards=4)
    filled = {r.doc_id for r in extra[0].collect()}
    seats = {(r.source, r.block, r.out_shard) for r in seen[0].collect()}
    got = mixed.select("doc_id", "source", (mixing.uniform(F.lit(7), F.col("doc_id")) % 256).alias("block"), F.spark_partition_id().alias("shard")).collect()
    assert {r.shard for r in got} == {0, 1, 2, 3} and all((r.source, r.block, r.shard) in seats or r.doc_id in filled for r in got)
    for shard in range(4):
        ids = [r.doc_id for r in got if r.shard == shard]
        assert len(ids) < 3 or ids != sorted(ids)


def test_shards_draw_disjoint_seats_and_exact_quotas(docs):
    _, blocks, _ = mixing.plan(docs)
    drawn = {(r.source, r.block): r.copies + (r.owed > 0) for r in blocks.collect()}
    seats = mixing.shard_plan(blocks, 8).collect()
    assert len({(r.source, r.block, r.copy) for r in seats}) == len(seats) == sum(drawn.values())
    assert Counter((r.source, r.block) for r in seats) == Counter({k: n for k, n in drawn.items() if n})
    per_shard = Counter(r.out_shard for r in seats)
    assert max(per_shard.values()) - min(per_shard.values()) <= 1


def test_a_long_document_in_the_cut_block_leaves_no_target_unmet(spark):
    size = {i: 10 for i in range(60)} | {60: 400}
    table = spark.createDataFrame([(i, " ".join(["w"] * n), "en", "s", 0) for i, n in size.items()], "doc_id long, text string, lang string, source string, n_chars long")
    tagged, _, _ = mixing.plan(table, n_blocks=4)
    assert tagged.where("owed > 0 AND doc_id = 60").count() == 1
    copies = Counter(r.doc_id for r in mixing.mixed_documents(table, n_blocks=4).collect())
    assert sum(size[i] * n for i, n in copies.items()) == 1500 and max(copies.values()) == 2


def test_blocks_grow_with_the_root_of_the_rows():
    assert [mixing.block_count(n) for n in (0, 1, 65536, 65537, 10**6, 10**10)] == [256, 256, 256, 512, 1024, 1 << 17]


def test_draws_have_the_hypergeometric_mean_and_spread(spark):
    quota = spark.createDataFrame([(0, 3000), (1, 1000)], "rank int, blocks long")
    left = [mixing.split_tree(quota, 2, seed).where("rank = 1 AND shard = 0").first().blocks for seed in range(12)]
    assert len(set(left)) > 6 and abs(np.mean(left) - 500) < 15 and 3 < np.std(left) < 40


def test_split_tree_is_exact(spark):
    quota = spark.createDataFrame([(0, 37), (1, 5), (2, 0), (3, 64)], "rank int, blocks long")
    tree = mixing.split_tree(quota, 8, 3).toPandas()
    assert tree.groupby("rank").blocks.sum().to_dict() == {0: 37, 1: 5, 2: 0, 3: 64}
    assert tree.blocks.min() >= 0 and tree.groupby("shard").blocks.sum().between(13, 14).all()


def test_suffix_dedup(docs, empty):
    data = [(r.doc_id if r.doc_id is not None else 2**63 - 1, (r.text or "").encode()) for r in docs.collect()]
    first = {}
    for i, t in sorted(data):
        for p in range(len(t) - 49):
            first.setdefault(t[p:p + 50], i)
    want = Counter()
    for i, t in data:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p:p + 50]] < i:
                gone[p:p + 50] = b"\1" * 50
        spans = sum(1 for p, g in enumerate(gone) if g and not (p and gone[p - 1]))
        want[(None if i == 2**63 - 1 else i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest())] += 1
    assert Counter(map(tuple, suffix_dedup.removed_passages(docs).collect())) == want
    assert suffix_dedup.removed_passages(empty).count() == 0


def turns(spark, x):
    return spark.createDataFrame(x, "conv_id long, turn long, role string, text string")


def test_chat(spark):
    data = [(1, 0, "user", "q"), (1, 1, "assistant", "good"), (1, 2, "user", "more"), (1, 3, "assistant", "é best"), (1, 4, "user", "thanks"), (2, 0, "user", "alone"), (3, 0, None, None), (3, 1, "assistant", "x"), (None, 0, "user", "lost"),
            (4, 0, "assistant", "same"), (4, 1, "assistant", "same")]
    got = {r.pair_id: r for r in chat.format_pairs(chat.reply_pairs(turns(spark, data))).collect()}
    assert set(got) == {1, 2, 3, 4}
    one = got[1]
    assert one.prompt_turns == 1 and one.prompt == "<|user|>\nq<|end|>\n"
    assert one.chosen == "<|assistant|>\ngood<|end|>\n<|user|>\nmore<|end|>\n<|assistant|>\né best<|end|>\n<|user|>\nthanks<|end|>\n"
    assert [one.chosen[a:z] for a, z in one.chosen_mask] == ["good<|end|>\n", "é best<|end|>\n"] and [one.rejected[a:z] for a, z in one.rejected_mask] == ["é best<|end|>\n"] * 2
    assert got[2].prompt == "<|user|>\nalone<|end|>\n" and (got[2].chosen, got[2].chosen_mask) == ("", []) == (got[2].rejected, got[2].rejected_mask)
    assert got[3].prompt == "<|unknown|>\n<|end|>\n" and got[3].rejected == "<|assistant|>\n<|end|>\n" and got[4].prompt_turns == 2
    assert chat.format_pairs(chat.reply_pairs(turns(spark, []))).count() == 0


def test_pairs_part_anywhere(spark):
    """Any two conversations: the prompt is what they share, completions are all the rest, masks cover the replies."""
    talk = lambda: [(str(RNG.choice(["user", "assistant"])), str(RNG.choice(["a", "é b", ""]))) for _ in range(int(RNG.integers(0, 6)))]
    pairs = [(i, x := talk(), talk() if i % 3 else x[:i % 5] + talk()) for i in range(60)]
    kind = "array<struct<role:string,text:string>>"
    got = {r.pair_id: r for r in chat.format_pairs(spark.createDataFrame(pairs, f"pair_id long, chosen {kind}, rejected {kind}")).collect()}
    show = lambda t: "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in t)
    for i, a, b in pairs:
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        r = got[i]
        assert (r.prompt_turns, r.prompt, r.chosen, r.rejected) == (n, show(a[:n]), show(a[n:]), show(b[n:]))
        for text, mask, rest in ((r.chosen, r.chosen_mask, a[n:]), (r.rejected, r.rejected_mask, b[n:])):
            assert [text[s:e] for s, e in mask] == [f"{x}<|end|>\n" for role, x in rest if role == "assistant"]


def brute_groups(data, k, sim):
    sets = []
    for _, t in data:
        w = spaced(lower(t))
        sets.append({tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= sim * (len(sets[i]) + len(sets[j]) - n):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return sets, root


@pytest.mark.parametrize("k,sim,tile", [(3, 85, 2048), (5, 80, 4)])
def test_near_duplicates(spark, rows, monkeypatch, k, sim, tile):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    monkeypatch.setattr(near_dedup, "TILE_SHINGLES", 200 * tile)
    data = [(r[0], r[1]) for r in rows]
    words = prose("en", 100).split()
    for n in range(12):  # a chain: neighbours are near, the ends are not
        data.append((1000 + n, " ".join([f"w{j}" if j < 3 * n else w for j, w in enumerate(words)])))
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), k, sim).collect()}
    sets, root = brute_groups(data, k, sim)
    for i, (doc, _) in enumerate(data):
        least = min(data[j][0] for j in range(len(data)) if root[j] == root[i])
        assert (got[doc].n_shingles, got[doc].component_id, got[doc].kept) == (len(sets[i]), least, least == doc)


def test_super_min_hash_estimates_similarity():
    a = RNG.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:300], RNG.integers(0, 2**63, 100, dtype=np.uint64)])
    sig = near_dedup.super_min_hash(np.concatenate([a, b, a[:1]]), np.array([0, 400, 800, 801]))
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.15 and (sig[2] < 2**63).all()
    assert sorted((sig[2] >> np.uint64(32)).tolist()) == list(range(near_dedup.SIGNATURE))


def test_crf(spark, docs, empty):
    good = [(i, prose("en", 60).replace(". ", ".\n")) for i in range(90)]
    bad = [(100 + i, "\n".join(" ".join(w.upper() + "!!" for w in prose("en", 9).split()) for _ in range(5))) for i in range(90)]
    table = spark.createDataFrame(good + bad + [(500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_crf.score_documents(table, labels).collect()}
    assert len(got) == 182 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(got[i].predicted == int(i < 100) for i, _ in good + bad)
    assert quality_crf.score_documents(empty, labels).count() == 0
    assert {r.score for r in quality_crf.score_documents(docs, labels.limit(0)).collect()} == {0.5}


def test_forward_backward_matches_enumeration():
    score, tie = RNG.normal(size=5), RNG.normal(size=(2, 2))
    paths = [[(s >> t) & 1 for t in range(5)] for s in range(32)]
    weight = np.array([np.exp(sum(score[t] * p[t] for t in range(5)) + sum(tie[p[t], p[t + 1]] for t in range(4))) for p in paths])
    good, pairs, log = quality_crf.forward_backward(np.concatenate([score, score[:1]]), np.array([0, 5, 6]), tie)
    assert np.allclose(good[:5], [(weight * [p[t] for p in paths]).sum() / weight.sum() for t in range(5)]) and np.isclose(log[0], np.log(weight.sum()))
    assert np.isclose(pairs.sum(), 4)


def test_crf_scores_are_the_length_weighted_marginals():
    """A document's score from its lines' marginals by enumeration, line lengths and the scale."""
    rng = np.random.default_rng(6)
    model = quality_crf.Model(rng.normal(size=quality_crf.WIDTH) * 0.2, 0.1, rng.normal(size=(2, 2)), (1.3, -0.2))
    texts = ["one line\nTWO!! lines\n\nthree | # $ 12", "", "same\nsame\nsame", None]
    features, size, at = quality_crf.line_features(pa.array(texts))
    got = model.score(pa.array(texts))
    for d, t in enumerate(texts):
        lines = (t or "").split("\n")
        f = features[at[d]:at[d + 1]]
        assert len(f) == len(lines) and size[at[d]:at[d + 1]].tolist() == [len(x.encode()) for x in lines]
        own = [model.weight[f[i]].sum() + model.bias for i in range(len(lines))]
        paths = [[(p >> i) & 1 for i in range(len(lines))] for p in range(2 ** len(lines))]
        w = np.array([np.exp(sum(o * x for o, x in zip(own, p)) + sum(model.tie[x, y] for x, y in zip(p, p[1:]))) for p in paths])
        good = [sum(w[k] * p[i] for k, p in enumerate(paths)) / w.sum() for i in range(len(lines))]
        q = sum(g * (len(x.encode()) + 1) for g, x in zip(good, lines)) / sum(len(x.encode()) + 1 for x in lines)
        assert got[d] == pytest.approx(1 / (1 + np.exp(-(1.3 * np.log(q / (1 - q)) - 0.2))))
    bins = lambda t: quality_crf.line_features(pa.array([t]))[0][0, :quality_crf.METRICS] - np.arange(quality_crf.METRICS) * (quality_crf.EACH + 1)
    plain, loud = bins("a few plain words here"), bins("LOUD!!! $$$ ### 123 || LOUD!!! LOUD!!!")
    assert plain[:4].tolist() == [0, 0, 0, 0] and (loud[:4] > 0).all() and loud[7] > plain[7] == 0


def test_features_of_neighbours_and_repeats():
    f = quality_crf.line_features(pa.array(["x\ny !\nx"]))[0] - np.tile(np.arange(3 * quality_crf.METRICS) * (quality_crf.EACH + 1), (3, 1))
    m, edge = quality_crf.METRICS, quality_crf.EACH
    assert (f[0, m:2 * m] == edge).all() and (f[2, 2 * m:] == edge).all() and (f[1, m:2 * m] == f[0, :m]).all() and (f[0, 2 * m:] == f[1, :m]).all()
    assert f[:, 10].tolist() == [0, 0, 1]


def test_the_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "some benchmark text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_sample_is_the_first_of_each_label(spark):
    from corpusweave.llm import sampling

    table = spark.range(6000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    labelled = table.selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN 'a' WHEN doc_id % 1000 = 1 THEN 'b' ELSE 'c' END AS label")
    got = sampling.labelled_sample(table, labelled, 300, 100).to_pylist()
    learn = labelled.where(~sampling.held_out(F.col("doc_id"))).selectExpr("doc_id", "label", "xxhash64(doc_id) AS h").collect()
    for name in "abc":
        want = [f"t{r.doc_id}" for r in sorted((r for r in learn if r.label == name), key=lambda r: r.h)][:100]
        assert [r["text"] for r in got if r["label"] == name] == want


def test_stored_tables_use_the_session_folder(spark):
    assert store.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert store.materialize(spark.range(3), "t").count() == 3


def test_pipeline_stages_match_brute_force(spark, tmp_path, docs):
    """Each stage is judged on its own input; the language model's verdicts are taken as given."""
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix", "shard"] and corpus_pipeline.ORACLE_SQL is None
    table = docs.where("doc_id IS NOT NULL").distinct().drop("size", "key")
    text = {r.doc_id: r.text for r in table.collect()}
    planted = " ".join(re.findall(r"\w+", text[10])[8:38])
    bench = [(1, "no such benchmark words at all"), (2, planted), (3, "line one")]
    long, words = 2000, prose("en", 1500).split()
    words[700:700] = planted.split()[4:17]  # 13 words of an item, under 1 % of the text
    text[long] = " ".join(words)
    table = table.unionByName(spark.createDataFrame([(long, text[long], "en", "s1", len(text[long]))], table.schema))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        outs[name] = now.collect()
        assert now.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and all(r.text == text[r.doc_id] for r in outs[name])
    ids = {name: sorted(r.doc_id for r in x) for name, x in outs.items()}

    verdict = {r.doc_id: r.rejected for r in language_id.identify(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert ids["language_id"] == sorted(i for i, gone in verdict.items() if not gone)
    assert not any(not any(c.isalpha() for c in text[i] or "") for i in ids["language_id"])

    left = ids["language_id"]
    _, root = brute_groups([(i, text[i]) for i in left], 5, 80)
    groups = {}
    for i, r in zip(left, root, strict=True):
        groups.setdefault(r, []).append(i)
    assert ids["near_dedup"] == sorted(map(min, groups.values())) and len(groups) < len(left)

    assert ids["decontaminate"] == [i for i in ids["near_dedup"] if not affected(text[i], bench)] and not {10, long} & set(ids["decontaminate"])
    assert {10, long} <= set(ids["near_dedup"])

    source = {r.doc_id: r.source for r in outs["decontaminate"]}
    size, copies = {i: len(spaced(text[i])) for i in source}, Counter(ids["mix"])
    assert set(copies) <= set(source) and max(copies.values()) <= 2
    check_taken([(source[i], size[i]) for i in source], [copies[i] for i in source])

    assert ids["shard"] == ids["mix"] and all(0 <= r.shard < 24 for r in outs["shard"])
    place = {}
    for r in outs["shard"]:
        assert place.setdefault(r.virtual_slot, r.shard) == r.shard
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "virtual_slot"]
    assert Counter((r.doc_id, r.shard) for r in whole.collect()) == Counter((r.doc_id, r.shard) for r in outs["shard"])


def test_words_of_long_spans():
    from corpusweave.llm import textbytes as tb

    long = "x" * (3 << 20)
    h, at = tb.words(pa.array([long, "x y", long + " x", None]), tb.SPACED)
    assert at.tolist() == [0, 1, 3, 5, 5] and h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 3
