import hashlib
import json
import math
import os
from collections import Counter
from urllib.parse import quote

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusweave.functions import text as tx
from corpusweave.operators import analysis, catalog, coupling, graph, resolve, search, vectors
from corpusweave.plans.queries import QUERIES, SQL, mixed_records
from corpusweave.sources import files, parsers
from corpusweave.streaming import counts

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return con


def rows(df):
    c = sorted(df.columns)
    return sorted(map(repr, df[c].astype(object).where(df[c].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", ["coupling_topk", "identifier_works", "title_works", "title_inside_works", "merge_conflicts", "merge_reasons", "family_sources", "identifier_columns", "bibliography_scan", "source_imports", "source_declarations", "import_closure", "reference_expand", "compiler_states", "source_slices", "number_search", "faceted_search", "retrieval_eval", "module_vectors", "label_ari", "color_ramp", "markup_escape", "path_encode", "path_normalize", "first_candidate", "self_reference_exclusion", "numeric_audit", "build_states", "json_by_key", "coupling_isolates", "shared_works_evidence", "knn_cosine_top8", "knn_lens_projected", "trustworthiness", "rank_audit", "nearest_other_subject", "representatives", "reference_reorder", "procrustes_align", "lexical_search",
                                  "combined_search", "token_chunks", "tfidf_keywords", "resolve_entities", "closure", "owner_reuse", "glossary_tags", "changed_views", "viewport_fit", "nearest_point", "concept_matches", "unused_entries", "release_gate", "coverage_union", "unique_prefix", "chunk_cache_fill", "titled_chunks", "visits_report", "streaming_page_counts"])
def test_query_matches_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def edges(spark, families):
    e = [(f, w) for f, works in families.items() for w in works]
    return spark.createDataFrame(e, "family string, work string"), spark.createDataFrame([(f,) for f in families], "family string")


def test_coupling_prefers_rare_works_and_ignores_duplicates(spark):
    once = {r.fa + r.fb: r.score for r in coupling.pairs(*edges(spark, {"a": ["x", "r"], "b": ["x", "r"], "c": ["x"], "d": ["x"], "e": []})).collect()}
    twice = {r.fa + r.fb: r.score for r in coupling.pairs(*edges(spark, {"a": ["x", "x", "r"], "b": ["x", "r", "r"], "c": ["x"], "d": ["x"], "e": []})).collect()}
    assert once == twice and once["ab"] > once["ac"] and not any("e" in k for k in once)
    one = coupling.pairs(*edges(spark, {"a": ["x"], "b": ["x"]})).collect()
    assert [r.score for r in one] == [round(1 / 3, 6)]


def test_neighbours_and_ranks_are_the_same_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 6))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).round(2)
    items = spark.createDataFrame([(i, x.tolist(), i % 4) for i, x in enumerate(v)] + [(200, None, 0)], "id long, vector array<double>, label int")
    score = np.round(v @ v.T, 6)
    order = {i: sorted((j for j in range(90) if j != i), key=lambda j: (-score[i, j], j)) for i in range(90)}
    for limit, tile in ((vectors.BROADCAST_BYTES, vectors.TILE), (0, 32)):
        monkeypatch.setattr(vectors, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(vectors, "TILE", tile)
        near = vectors.knn(items, 5)
        assert {(r.id, r["rank"]): r.neighbor for r in near.collect()} == {(i, n + 1): j for i, o in order.items() for n, j in enumerate(o[:5])}
        assert {r.id: r.neighbor for r in vectors.knn(items, 1, apart="label").collect()} == {i: next(j for j in o if j % 4 != i % 4) for i, o in order.items()}
        asked = spark.createDataFrame([(i, (i * 7 + 1) % 90) for i in range(90) if (i * 7 + 1) % 90 != i], "id long, neighbor long")
        assert all(order[r.id].index(r.neighbor) + 1 == r["rank"] for r in vectors.ranks(items, asked).collect())


def test_lens_basis():
    rng = np.random.default_rng(0)
    basis, share = vectors.lens_basis(rng.normal(size=(6, 10)).tolist())
    assert np.allclose(basis @ basis.T, np.eye(len(basis))) and math.isclose(share, 1)
    assert len(vectors.lens_basis(np.eye(3).tolist())[0]) == 2
    for bad in ([[1, 2]] * 5, [[1, 0], [0, 1]], [[1, float("nan")]] * 3):
        with pytest.raises(ValueError):
            vectors.lens_basis(bad)


def test_knn_skips_self_and_null_and_tiles_agree(spark, monkeypatch):
    rng = np.random.default_rng(1)
    data = [(i, (v / np.linalg.norm(v)).tolist() if i != 5 else None) for i, v in enumerate(rng.normal(size=(40, 6)))]
    items = spark.createDataFrame(data, "id long, vector array<double>")
    whole = sorted(map(tuple, vectors.knn(items, 3).collect()))
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(vectors, "TILE", 9)
    assert whole == sorted(map(tuple, vectors.knn(items, 3).collect()))
    assert len(whole) == 39 * 3 and not any(5 in (r[0], r[2]) or r[0] == r[2] for r in whole)


def test_closure_of_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "out")], "src string, dst string")
    got = {r.node: r.depth for r in graph.closure(e, spark.createDataFrame([("a",)], "root string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "out": 3}


def record(i, **x):
    return {"record": i, "title": "", "authors": "", "year": "", "citation": "", "raw": "", "doi": "", "arxiv": "", "url": "", "source": "", "families": [f"f{i}"], **x}


RECORDS = "record long, title string, authors string, year string, citation string, raw string, doi string, arxiv string, url string, source string, families array<string>"


def in_order(records):
    """A plain sequential reading of the merge rules: groups as sets, each record in turn against all before it."""
    found = [resolve.keys(*(r[c] for c in ("title", "authors", "year", "citation", "raw", "doi", "arxiv"))) for r in records]
    group, ids, count, refused = {i: {i} for i in range(len(records))}, {i: set(k["ids"]) for i, k in enumerate(found)}, Counter(), []
    kinds = lambda x, p: {k for k in x if k.startswith(p)}

    def join(i, j, reason):
        if group[i] is group[j]:
            return
        x, y = set().union(*(ids[k] for k in group[i])), set().union(*(ids[k] for k in group[j]))
        if reason != "identifier" and any(kinds(x, p) and kinds(y, p) and not kinds(x, p) & kinds(y, p) for p in ("doi:", "arxiv:")):
            refused.append((i, j, reason))
            return
        whole = group[i] | group[j]
        for k in whole:
            group[k] = whole
        count[reason] += 1

    long = lambda k, words, chars: len(k["title"].split()) >= words and len(k["title"]) >= chars and k["surname"]
    for i, k in enumerate(found):
        for x in k["ids"]:
            if (j := next(j for j in range(i + 1) if x in found[j]["ids"])) < i:
                join(i, j, "identifier")
        join(i, next(j for j in range(i + 1) if found[j]["text"] == k["text"]), "identical citation")
        for j in range(i) if long(k, 3, 20) else ():
            same = (found[j]["title"], found[j]["surname"]) == (k["title"], k["surname"])
            if same and (k["year"] is None or found[j]["year"] is None or abs(k["year"] - found[j]["year"]) <= 3):
                join(i, j, "title and author")
    known = {}
    for j, k in enumerate(found):
        if long(k, 4, 28) and any(len(w) > 3 for w in k["title"].split()):
            known.setdefault((k["title"], k["surname"]), j)
    for i, k in enumerate(found):
        hit = [j for (t, a), j in known.items() if f" {t} " in f" {k['text']} " and a in k["text"].split()] if not records[i]["title"] else []
        if len({id(group[j]) for j in hit}) == 1:
            join(i, hit[0], "exact title in citation")
    return found, [sorted(x) for x in {id(g): g for g in group.values()}.values()], count, refused


def best_work(records, found, members):
    ids = sorted({x for i in members for x in found[i]["ids"]})
    best = max(members, key=lambda i: (bool(records[i]["title"]), bool(found[i]["ids"]), bool(records[i]["authors"]), len(records[i]["citation"]), -i))
    key = next((x for x in ids if x.startswith("doi:")), ids[0] if ids else "text:" + found[best]["text"])
    title = records[best]["title"] or records[best]["citation"]
    web = next((records[i]["url"].replace("\\_", "_") for i in members if records[i]["url"].startswith("http")), "")
    url = "https://doi.org/" + key[4:] if key.startswith("doi:") else "https://arxiv.org/abs/" + key[6:] if key.startswith("arxiv:") else web or "https://scholar.google.com/scholar?q=" + quote(title[:220])
    families = sorted({f for i in members for f in records[i]["families"]})
    return (hashlib.sha256(key.encode()).hexdigest()[:16], title, records[best]["authors"], records[best]["year"], url, ids, families, {f: next(records[i]["source"] for i in members if f in records[i]["families"]) for f in families}, members)


def test_resolution_rules():
    title = "A long enough title about groups"
    def merged(*records):
        return [set(g) for g in in_order([record(i, citation=f"c{i}") | r for i, r in enumerate(records)])[1]]
    years = [{"title": title, "authors": a, "year": y} for a, y in (("Ada Byron", "1999"), ("Byron, A.", "(2001)"), ("A. Byron", "1990"))]
    assert merged(*years) == [{0, 1}, {2}] and merged(*years, {"title": title, "authors": "Byron"}) == [{0, 1, 2, 3}]
    assert merged({"doi": "n/a"}, {"doi": "n/a"}) == [{0}, {1}]
    assert resolve.identifiers("", "", "10.1000/a and 10.1000/b") == set() == resolve.identifiers("n/a", "", "10.1000/a")
    assert resolve.identifiers("", "", "arXiv:math/0112017 \\url{https://arxiv.org/pdf/math/0112017v2}") == {"arxiv:math/0112017"}
    assert resolve.identifiers("10.1234/ABC", "2102.11818v4", "") == resolve.identifiers("", "", r"\url{https://doi.org/10.1234/abc} \url{https://arxiv.org/pdf/2102.11818v1.pdf}") == {"doi:10.1234/abc", "arxiv:2102.11818"}
    assert resolve.norm(r"\v{C}ech and Erd\H{o}s, π-groups {\it of} $x_{i}$") == "cech and erdos groups of x i"
    assert resolve.first_surname("van der Berg, A. and X") == "berg" and resolve.first_surname("Ada Q. Byron; Y") == "byron" == resolve.first_surname("A Byron B")


def some_records(n, seed):
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(0, len(x)))]
    titles = [f"On the theory of objects of kind number {i}" for i in range(4)] + ["one two odd six its who can how"]
    out = []
    for i in range(n):
        t = pick("", "", *titles)
        out.append(record(i, title=t, authors=pick("Ada Byron", "Byron, Ada and X", "Emmy Noether", ""), year=pick("", str(rng.integers(1990, 2000)), "c. 1995"), citation=f"{pick('Byron', 'Noether')} {pick(*titles)} {pick('', i % 7)}",
                          raw=pick("", "", "see arXiv:2101.00001v1", "10.1000/x."), doi=pick("", "", "", "10.1000/x", "10.1000/Y.", "n/a"), arxiv=pick("", "", "2101.00001", "2101.00002v3"), url=pick("", "http://a.test/x\\_y", "ftp://b"), source=f"s{i % 3}", families=[f"f{i % 4}", "g"][:i % 3]))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_resolution_equals_a_sequential_reading(spark, seed):
    recs = some_records(60, seed)
    found, groups, count, refused = in_order(recs)
    done = resolve.resolution(spark.createDataFrame([tuple(r.values()) for r in recs], RECORDS).repartition(3))
    got = sorted(tuple(r) for r in resolve.works(done).collect())
    assert got == sorted(best_work(recs, found, g) for g in groups)
    assert {r.reason: r.n for r in done.merges.collect()} == dict(count)
    assert Counter((r.record, r.reason) for r in done.conflicts.collect()) == Counter((i, reason) for i, _, reason in refused)
    variants = {r.record: r.first for r in resolve.audit(done).collect()}
    assert all({variants[i] for i in g} == {g[0]} for g in groups)


def test_every_kind_of_record_together(spark):
    """The records of the query without SQL, at the smallest scale, against a sequential reading."""
    table = mixed_records(spark, DATA)
    recs = sorted((r.asDict() for r in table.collect()), key=lambda r: r["record"])
    found, groups, _, _ = in_order([r | {c: r[c] or "" for c in r if c not in ("record", "families")} for r in recs])
    want = sorted((recs[min(g)]["record"], len(g)) for g in groups)
    assert sorted((r.first_record, r.records) for r in QUERIES["canonical_works"](spark, DATA).collect()) == want


def test_resolution_of_no_records_and_nulls(spark):
    none = spark.createDataFrame([], RECORDS)
    assert resolve.resolve(none).count() == 0
    blank = spark.createDataFrame([(i, *[None] * 9, None) for i in range(3)], RECORDS)
    assert [sorted(r.records) for r in resolve.resolve(blank).collect()] == [[0, 1, 2]]


def test_bibliography_records():
    bib = '@comment{x @book{in, title={T}}} @string{s = "x"} @misc{nocomma}\n% @book{out, title={T}}\n@Article{k1, odd, Title = {A {Nested} $x_{i}$ title}, author="B, C and D", year = 1999, doi={10.1/A}, eprint=2101.00001, archivePrefix={arXiv}}\n@book{k2, title={T}, editor={E}, publisher={P}}\n@book{k3, year=1}'
    assert [e["key"] for e in parsers.bib_entries(bib)] == ["out", "k1", "k2", "k3"]
    one, two = parsers.citation_records("a.bib", bib)
    assert one[:6] == ("a.bib", "k1", "A Nested $x_{i}$ title", "B, C and D", "1999", "B, C and D. A Nested $x_{i}$ title. 1999") and one[7:9] == ("10.1/A", "2101.00001")
    assert json.loads(one[6])["title"] == "A {Nested} $x_{i}$ title" and two[3:6] == ("E", "", "E. T. P")
    assert list(parsers.citation_records("a.bib", "")) == [] and parsers.bib_fields('a = {x\\}y}, b = "q\\"r", c = z') == {"a": "x\\}y", "b": 'q\\"r', "c": "z"}
    items = list(parsers.bib_items("%\\bibitem{no} commented entry that is long enough\n\\bibitem[A]{k} Some Author, {\\em A title}. \\url{ftp://x} \\url{http://a.b}\n\\bibitem{s} short\\end{thebibliography}"))
    assert [x["key"] for x in items] == ["k"] and items[0]["url"] == "http://a.b"
    assert parsers.plain_tex(r"\v{C}ech, Erd\H{o}s \& \'Etude~\$5 \textbf{b}--c $\alpha_{1}$\url{http://x}") == "Cech, Erdos & Etude $5 b–c $\\alpha_{1}$"
    assert parsers.cite_keys(r"\citep*[p. 3]{a, b} % \cite{no}" + "\n\\cite{c}") == ["a", "b", "c"]
    legacy = "\\bibitem{a} Some Author, \\emph{A title of a paper}. \\href{http://b.test/x\\_y}{link}\n\\bibitem{b} Another Author, a paper without any link\n\\bibitem{c} Own Name, some paper that is long enough\\end{thebibliography}"
    assert [(r[1], r[2], r[3]) for r in parsers.legacy_references("p/refs.tex", legacy, "Own Name")] == [
        ("Some Author, A title of a paper.", "http://b.test/x_y", "source-link"),
        ("Another Author, a paper without any link", "https://scholar.google.com/scholar?q=Another%20Author%2C%20a%20paper%20without%20any%20link", "literature-search")]
    assert [r[2] for r in parsers.legacy_references("x.bib", "@article{k, title={A title that is long}, doi = {10.1/x}, url={http://c.test}}")] == ["https://doi.org/10.1/x"]


def test_source_scans(spark):
    code = "import A B.C' -- import No\npublic import C\n/- /- nested -/ import No -/\n-- import No\nnamespace N\ntheorem t : True := x\nsection\nnoncomputable def _root_.d := \"-- s /- \"\nend\nlemma u : t\nnamespace M.K\nsection S\nend M.K\ndef v.{w} : X\nend N\n@[simp] private abbrev out := a/-x-/b\n"
    assert parsers.imports(code) == ["A", "B.C'", "C"]
    found = parsers.declarations(code, "Q")
    assert [(d["name"], d["line"]) for d in found] == [("N.t", 6), ("d", 8), ("N.u", 10), ("N.v", 14), ("out", 16)] and '"-- s /- "' in found[1]["text"]
    assert found[-1]["text"].endswith("a  b") and parsers.strip_comments("a/-x\n-/b") == "a  \nb" and parsers.strip_comments("/- --/ x") == "    x"
    files = spark.createDataFrame([("lean/A/B.lean", code), ("lean/C.lean", None)], "path string, text string")
    sources = parsers.scan_sources(files)
    assert {r.module: r.imports for r in sources.collect()} == {"A.B": ["A", "B.C'", "C"], "C": []}
    assert sorted((r.module, r.name, r.line) for r in parsers.scan_declarations(sources).collect()) == sorted(("A.B", d["name"], d["line"]) for d in found)
    assert files.select(parsers.module_path(parsers.module_name(F.col("path"))).alias("p")).first().p == "lean/A/B.lean"
    assert parsers.source_slice("aé\nbcd\nef", 1, 1, 2, 2) == "é\nbc"
    with pytest.raises(ValueError):
        parsers.source_slice("a", 1, 0, 2, 1)
    texts = ["aé\nbcd\nef", "one", "", "x\n\ny\n"]
    places = [(i, t, a, b, c, e) for i, t in enumerate(texts) for a, b, c, e in ((1, 1, 2, 2), (1, 0, 1, 2), (2, 1, 3, 1), (1, 0, 3, 9))]
    table = spark.createDataFrame([(10 * n, *p[1:]) for n, p in enumerate(places)], "id int, text string, start_line int, start_column int, end_line int, end_column int")
    for r in parsers.scan_slices(table).collect():
        lines = places[r.id // 10][1].split("\n")
        _, t, a, b, c, e = places[r.id // 10]
        want = None if c > len(lines) else lines[a - 1][b:e] if a == c else "\n".join([lines[a - 1][b:], *lines[a:c - 1], lines[c - 1][:e]])
        assert r.part == want


def test_catalogue_scan(spark):
    text = "**001. One &amp; all.** ([Lean](lean/doc.md)) A summary. &emsp; [Paper <b>one</b>](preprints/a/p.tex) About it. &emsp; [else](other/x) no\n**002. Two** plain"
    one, two = parsers.catalogue(text, "preprints/")
    assert (one["title"], one["summary"], one["document"], one["papers"]) == ("One & all", ") A summary.", "lean/doc.md", [{"title": "Paper one", "path": "preprints/a/p.tex", "abstract": "About it."}])
    assert two["papers"] == [] and two["document"] is None and one["links"] == ["lean/doc.md", "preprints/a/p.tex", "other/x"]
    got = parsers.scan_catalogue(spark.createDataFrame([("c.md", text)], "path string, text string")).collect()
    assert [(r.id, r.papers) for r in got] == [("001", ["preprints/a/p.tex", "other/x"]), ("002", [])]
    tex = spark.createDataFrame([("o.tex", r"\sec{A}{1} \item{001} \item{002} \sec{B}{2} \item{003}")], "path string, text string")
    assert {r.item: r.subject for r in parsers.subjects(tex, r"\\sec\{([^}]+)\}\{\d+\}", r"\\item\{(\d+)\}").collect()} == {"001": "A", "002": "A", "003": "B"}


def test_texts_are_read_in_order_of_path(spark, tmp_path):
    for name in ("b/2.lean", "a/1.lean", "a/0.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    assert [r.text for r in parsers.ordered(parsers.read_texts(spark, str(tmp_path), "*.lean")).collect()] == ["a/1.lean", "b/2.lean"]


def test_citations_are_followed_through_inputs(spark):
    files = {"d/main.tex": r"\input{sec/one} \cite{a} % \input{no}", "d/sec/one.tex": r"\include{two} \cite{b,c}", "d/two.tex": r"\input{sec/one}", "d/sec/two.tex": r"\cite{hidden}", "e/main.tex": r"\subfile{../d/sec/two}\input{gone}"}
    scanned = parsers.scan_citations(spark.createDataFrame(list(files.items()), "path string, text string"))
    reach = graph.cite_reach(scanned, spark.createDataFrame([("d", "d/main.tex"), ("e", "e/main.tex"), ("f", "none.tex")], "directory string, path string"))
    got = {}
    for r in reach.collect():
        got.setdefault(r.directory, set()).add(r.path)
    assert got == {"d": {"d/main.tex", "d/sec/one.tex", "d/two.tex"}, "e": {"e/main.tex", "d/sec/two.tex"}}


def test_manuscript_files(spark):
    files = ["d/main.tex", "d/sub/main.tex", "d/x.bib", "d/My-References.tex", "e/long-name.tex", "e/b.tex", "gx/paper.tex", "gx/other.tex", "h1/a.tex", "h2/a.tex"]
    papers = spark.createDataFrame([("1", "d"), ("2", "d"), ("2", "e"), ("3", "g"), ("4", "h")], "family string, directory string")
    got = catalog.manuscript_files(spark.createDataFrame([(f,) for f in files], "path string"), papers).collect()
    by = {}
    for r in got:
        by.setdefault((r.family, r.directory), set()).add(r.path)
    d = {"d/main.tex", "d/x.bib", "d/My-References.tex"}
    assert by == {("1", "d"): d, ("2", "d"): d, ("2", "e"): {"e/b.tex"}, ("3", "gx"): {"gx/paper.tex"}, ("4", None): {None}}


def test_closure_in_and_outside(spark):
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C"), ("B", "Lib.X"), ("C", "A")], "src string, dst string")
    got = graph.local_closure(edges, spark.createDataFrame([("A",), ("Z",)], "root string"), spark.createDataFrame([("A",), ("B",), ("C",)], "node string"))
    assert sorted((r.root, r.node, r.found) for r in got.collect()) == [("A", "A", True), ("A", "B", True), ("A", "C", True), ("A", "Lib.X", False), ("Z", "Z", False)]


def test_names_are_chosen_when_they_are_one(spark):
    decl = [("m:1", "N.first_one", "m", "uses N.dup and second_name and tiny N.first_one"), ("m:2", "N.dup", "m", ""), ("o:1", "P.second_name", "o", "third_name Q.twice"), ("p:1", "third_name", "p", "fourth_name"),
            ("p:2", "fourth_name", "p", ""), ("q:1", "tiny", "q", ""), ("o:2", "A.Q.twice", "p", ""), ("o:3", "B.Q.twice", "q", ""), ("z:1", "second_name", "unreached", "")]
    table = spark.createDataFrame(decl, "key string, name string, module string, text string")
    scope = spark.createDataFrame([("e", m) for m in "mopq"] + [("g", "m")], "entry string, in_module string")
    entries = spark.createDataFrame([("e", "m", "own text"), ("g", "m", "bare")], "entry string, module string, text string")
    start, unresolved, fallback = graph.seeds(entries, spark.createDataFrame([("e", "_root_.first_one"), ("e", "nowhere"), ("g", "Q.twice")], "entry string, target string"), table, scope)
    assert sorted(map(tuple, start.collect())) == [("e", "m:1"), ("g", "m:entry")] and sorted(map(tuple, unresolved.collect())) == [("e", "nowhere"), ("g", "Q.twice")]
    assert [(r.key, r.text) for r in fallback.collect()] == [("m:entry", "bare")]
    included, unclear = graph.expand(table, start, scope)
    assert {(r.entry, r.key): r.depth for r in included.collect()} == {("e", "m:1"): 0, ("e", "m:2"): 1, ("e", "o:1"): 1, ("e", "p:1"): 2, ("g", "m:entry"): 0}
    assert list(map(tuple, unclear.collect())) == [("e", "Q.twice")]


def test_reach_in_tasks_and_in_rounds_is_the_same(spark, monkeypatch):
    """Cycles, a root that reaches all, unknown and null roots, parts of the roots; a graph too large for a task is closed in rounds."""
    rng = np.random.default_rng(9)
    links = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 60, (90, 2))] + [("hub", f"n{i}") for i in range(60)] + [(None, "n1"), ("n2", None)]
    e = spark.createDataFrame(links, "src string, dst string").repartition(3)
    roots = spark.createDataFrame([(f"n{i}",) for i in range(60)] + [("hub",), ("unknown",)], "root string")
    local = spark.createDataFrame([(f"n{i}",) for i in range(0, 60, 2)] + [("hub",)], "node string")

    def walk(root, follow):
        depth, new = {root: 0}, [root]
        while new:
            new = [b for b in dict.fromkeys(b for a, b in links if a in new and a is not None and follow(a)) if b not in depth]
            depth |= {b: max(depth.values()) + 1 for b in new}
        return depth

    names, kept = [r.root for r in roots.collect()], {r.node for r in local.collect()}
    want = {(r, n): d for r in names for n, d in walk(r, lambda a: True).items() if n is not None}
    inner = {(r, n): n in kept for r in names for n in walk(r, kept.__contains__) if n is not None}
    for reached, graph_size in ((graph.REACHED, graph.GRAPH), (20, graph.GRAPH), (20, 0)):
        monkeypatch.setattr(graph, "REACHED", reached)
        monkeypatch.setattr(graph, "GRAPH", graph_size)
        assert {(r.root, r.node): r.depth for r in graph.closure(e, roots).where("node IS NOT NULL").collect()} == want
        assert {(r.root, r.node): r.found for r in graph.local_closure(e, roots, local).where("node IS NOT NULL").collect()} == inner
        asked = spark.createDataFrame([(a, f"n{i}") for a in ("n1", "n2", "hub", "unknown") for i in range(60)], "entry string, in_module string")
        got = graph.Reach(e, roots, local).within(asked, "entry", "in_module")
        assert {tuple(r) for r in got.collect()} == {p for p, found in inner.items() if found and p[0] in ("n1", "n2", "hub", "unknown") and p[1] != "hub"}
    monkeypatch.setattr(graph, "GRAPH", 1 << 25)
    assert "Join" not in graph.closure(e, roots)._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    small = graph._Graph.__new__(graph._Graph)
    small.nodes, small.begin, small.ends = e.toArrow().slice(0, 4), np.array([0, 3, 4, 4, 4]), np.array([1, 2, 3, 0])
    monkeypatch.setattr(graph, "REACHED", 3)
    assert sorted((int(a), int(n), int(d)) for x in small.reach(np.array([0, 1, 2]), 9) for a, n, d in zip(*x)) == [(0, 0, 0), (0, 1, 1), (0, 2, 1), (0, 3, 1), (1, 0, 1), (1, 1, 0), (1, 2, 2), (1, 3, 2), (2, 2, 0)]


def test_records_of_near_years(spark, monkeypatch):
    rng = np.random.default_rng(6)
    recs = [(i, ["t", "u", None][int(rng.integers(0, 3))], "ab"[int(rng.integers(0, 2))], None if i % 9 == 0 else int(rng.integers(0, 20))) for i in range(160)]
    want = Counter((a[0], b[0]) for a in recs for b in recs if a[0] < b[0] and a[1] == b[1] and a[1] and a[2] == b[2] and (a[3] is None or b[3] is None or abs(a[3] - b[3]) <= 3))
    table = spark.createDataFrame(recs, "id long, title string, surname string, y int")
    for of_key, of_task in ((4096, 1 << 22), (3, 200)):
        monkeypatch.setattr(resolve, "RECORDS_OF_KEY", of_key)
        monkeypatch.setattr(resolve, "PAIRS_OF_TASK", of_task)
        got = resolve.near_years(table, 3)
        assert Counter(map(tuple, got.collect())) == want
    assert got.rdd.getNumPartitions() > 8  # a task for so many pairs, however few titles there are


def test_isolates_are_placed_in_a_row(spark):
    e, f = edges(spark, {"a": ["x"], "b": ["x"], "c": ["y"], "d": [], "z": ["w"]})
    got = {r.family: (r.place, r.x) for r in coupling.isolates(e, f, coupling.pairs(e, f)).collect()}
    assert got == {"c": (0, -0.13), "d": (1, 0.0), "z": (2, 0.13)}


def test_neighbours_of_copies_and_odd_vectors_are_bounded_and_exact(spark, monkeypatch):
    """Copies tie by the thousand, blocks are small, lengths and numbers are odd; no matrix of all scores is made."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(150, 5)) * rng.choice([1e-3, 1, 30], 150)[:, None]
    v[40:110], v[7], v[8] = v[3], np.nan, 0
    items = spark.createDataFrame([(i * 3 % 151, x.tolist(), i % 3) for i, x in enumerate(v)], "id long, vector array<double>, label int").repartition(5)
    at = {i * 3 % 151: i for i in range(150) if i != 7}
    score = {(a, b): round(float(v[at[a]] @ v[at[b]]), 6) for a in at for b in at if a != b}
    order = {a: sorted((b for b in at if b != a), key=lambda b: (-score[a, b], b)) for a in at}
    for rows, columns, again in ((512, 8192, 1 << 17), (16, 32, 10)):
        for c, x in (("ROWS", rows), ("COLUMNS", columns), ("AGAIN", again)):
            monkeypatch.setattr(vectors, c, x)
        for limit in (vectors.BROADCAST_BYTES, 0):
            monkeypatch.setattr(vectors, "BROADCAST_BYTES", limit)
            near = vectors.knn(items, 4).collect()
            assert {(r.id, r["rank"]): r.neighbor for r in near} == {(a, n + 1): b for a, o in order.items() for n, b in enumerate(o[:4])}
            apart = {(r.id, r["rank"]): r.neighbor for r in vectors.knn(items, 2, apart="label").collect()}
            assert apart == {(a, n + 1): b for a, o in order.items() for n, b in enumerate([b for b in o if at[b] % 3 != at[a] % 3][:2])}
            pairs = [(a, o[n]) for a, o in order.items() for n in {a % 149, 3, 90} if n < len(o) and a % 4]
            got = vectors.ranks(items, spark.createDataFrame(pairs, "id long, neighbor long")).collect()
            assert {(r.id, r.neighbor): r["rank"] for r in got} == {(a, b): order[a].index(b) + 1 for a, b in pairs}
    side = vectors._Side(items.toArrow())
    assert {x[2].shape for x in vectors._blocks(side, side, 16, 32)} <= {(r, c) for r in (16, 5) for c in (32, 21)}


def test_pairs_are_counted_where_their_family_is(spark, monkeypatch):
    """Lists of a common work are cut, families lie over several batches, and no pair goes through a shuffle."""
    rng = np.random.default_rng(7)
    works = {f"f{i:03}": {"all", *rng.choice(40, 6)} for i in range(70)} | {"alone": {"own"}, "none": set()}
    works = {f: [str(w) for w in x] for f, x in works.items()}
    e, f = edges(spark, works)
    idf = {w: 1 + math.log((len(works) + 1) / (sum(w in x for x in works.values()) + 1)) for x in works.values() for w in x}
    norm = {a: math.sqrt(sum(idf[w] ** 2 for w in set(x))) for a, x in works.items()}
    both = {(a, b): set(works[a]) & set(works[b]) for a in works for b in works if a != b}
    want = {p: (len(x), round(sum(idf[w] ** 2 for w in x) / norm[p[0]] / norm[p[1]] * len(x) / (len(x) + 2), 6)) for p, x in both.items() if x}
    ranked = {a: sorted((b for x, b in want if x == a), key=lambda b: (-want[a, b][1], -want[a, b][0], b))[:3] for a in works}
    for limit in (coupling.PAIRS_AT_ONCE, 50):
        monkeypatch.setattr(coupling, "PAIRS_AT_ONCE", limit)
        monkeypatch.setattr(coupling, "LIST", limit)
        monkeypatch.setattr(coupling, "PAIRS_PER_TASK", 1000)
        near, every = coupling.nearest(e, f, 3), coupling.pairs(e, f)
        assert {(r.fa, r.fb): (r.shared, r.score) for r in every.collect()} == {p: v for p, v in want.items() if p[0] < p[1]}
        assert {(r.family, r["rank"]): r.neighbor for r in near.collect()} == {(a, n + 1): b for a, x in ranked.items() for n, b in enumerate(x)}
        assert "near" in (last := every._jdf.queryExecution().executedPlan().toString().split("Exchange")[1]) and "shared" not in last
    assert [r.family for r in coupling.isolates(e, f).collect()] == ["alone", "none"]


def test_module_vectors_take_the_last_and_refuse_the_bad(spark):
    schema = "family string, path string, ordinal long, vector array<double>"
    make = lambda *rows: vectors.module_vectors(spark.createDataFrame(list(rows), schema)).collect()
    (one,) = make(("f", "a", 1, [9.0, 9.0]), ("f", "a", 2, [1.0, 0.0]), ("f", "b", 0, [0.0, 1.0]))
    assert np.allclose(one.vector, [0.5 ** 0.5] * 2) and one.modules == 2
    for bad in (("f", None, 1, [1.0]), ("f", "a", 1, None), ("f", "a", 1, []), ("f", "a", 1, [float("nan"), 1.0]), ("f", "a", 1, [0.0, 0.0])):
        with pytest.raises(Exception, match="in family f"):
            make(bad)
    with pytest.raises(Exception, match="invalid vector"):
        make(("f", "a", 1, [1.0]), ("f", "b", 1, [1.0, 2.0]))


def test_embedding_and_layout(spark):
    chunks = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, None)], "key long, text string")
    got = {r.key: r.vector for r in vectors.embed(chunks).collect()}
    assert got[1] == got[2] != got[3] and all(math.isclose(sum(x * x for x in v), 1) for v in got.values())
    with pytest.raises(Exception, match="encoder"):
        vectors.embed(chunks, lambda texts: np.zeros((len(texts), 3))).collect()
    m = np.random.default_rng(5).normal(size=(50, 4)) * [5, 3, 1, 1]
    flat = {r.id: (r.x, r.y) for r in vectors.flat_layout(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>")).collect()}
    c = m - m.mean(axis=0)
    _, _, axes = np.linalg.svd(c)
    for n in range(2):
        own = axes[n] * np.sign(axes[n][np.abs(axes[n]).argmax()])
        assert np.allclose([flat[i][n] for i in range(50)], c @ own, atol=1e-5)


def test_seed_agreement(spark):
    rng = np.random.default_rng(2)
    items = spark.createDataFrame([(i, (rng.normal(size=3) * 0.01 + [i % 3, 0, 1]).tolist()) for i in range(60)], "id long, vector array<double>")
    both = analysis.seed_assignments(items, 3)
    assert both.count() == 60 and both.columns == ["id", "a", "b"] and analysis.rand_index(both).first().ari == 1.0


def test_texts_that_hold_an_item(spark):
    items = [(1, "Beta gamma del"), (2, "the"), (3, "nowhere found here"), (4, None), (5, ""), (6, "alpha beta"), (7, "Über große Wörter")]
    docs = [(1, "alpha beta gamma delta"), (2, "The other"), (3, None), (4, "xalpha betax"), (5, "über große wörter"), (6, "alpha  beta")]
    got = analysis.containing_pairs(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    want = {(i, j) for i, q in items for j, t in docs if q and t and q.lower() in t.lower()}
    assert Counter((r.item_id, r.doc_id) for r in got.collect()) == Counter(want)


def test_markup_text(spark):
    df = spark.createDataFrame([("<p>a &amp; b</p>\n $`x`$ &nbsp;&eacute;",)], "t string")
    assert df.select(tx.markup_text(F.col("t")).alias("x")).first().x.replace("\xa0", " ").split() == ["a", "&", "b", "$x$", "é"]


def test_search_parsing():
    q = search.parse_query('Topic:"Number Theory" lean : yes family #7 prime gaps research  family 9 Research Family:12')
    assert q.fields == {"topic": "number theory", "lean": "yes", "family": "9"} and q.words == ["prime", "gaps"]
    assert search.parse_query("id:3 family 5").fields == {"id": "3", "family": "5"} and search.title_words(search.parse_query("How is Pi related to pi")) == ["pi", "related", "pi"]
    assert not search.wants_semantic(search.parse_query("éé")) and search.wants_semantic(search.parse_query("π 1"))
    assert search.wants_semantic(search.parse_query("primes")) and not search.wants_semantic(search.parse_query("12")) and not search.wants_semantic(q)
    assert tx.search_text("Poincaré π") == "poincare pi"


def test_text_functions(spark):
    df = spark.createDataFrame([("https://doi.org/10.1/A+B.", "arXiv:1234.56789v2", "Noether, Emmy and X", "7")], "a string, b string, c string, d string")
    got = df.select(tx.canonical_doi(F.col("a")), tx.arxiv_id(F.col("b")), tx.surname(F.col("c")), tx.padded_id(F.col("d")), tx.ramp(F.lit(2.0), 1.0, (0, 0, 0), (255, 255, 255), (16, 32, 255))).first()
    assert tuple(got) == ("10.1/a+b", "1234.56789", "noether", "007", "#1020ff")


def test_token_bucket_matches_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    at = {c: np.cumsum(rng.integers(0, 900_000, 80)) for c in ("a", "b", None)}
    asked = [(c, int(t), i * 100 + n) for i, (c, ts) in enumerate(at.items()) for n, t in enumerate(ts)]
    want = {}
    for i, ts in enumerate(at.values()):
        tokens, last = 8_000_000, int(ts[0])
        for n, t in enumerate(map(int, ts)):
            tokens, last = min(8_000_000, tokens + t - last), t
            want[i * 100 + n] = tokens >= 1_000_000
            tokens -= 1_000_000 * want[i * 100 + n]
    rows = spark.createDataFrame(asked, "client string, us long, id long").repartition(3).select("client", F.timestamp_micros("us").alias("ts"), "id")
    assert {r.id: r.allowed for r in counts.bucket_admitted(rows).collect()} == want and set(want.values()) == {True, False}
    assert counts.bucket_admitted(rows.limit(0)).count() == 0


def test_paths_and_escapes(spark):
    cases = {"a/./b//c": "a/b/c", "a/../b": "b", "../a/..": "..", "../../x": "../../x", "": ".", "./": ".", "a/..": "."}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "p string")
    assert {r.p: r.n for r in df.select("p", tx.normal_path(F.col("p")).alias("n")).where("p IS NOT NULL").collect()} == cases
    one = spark.createDataFrame([("<a b=\"c\">'&amp;", "a b/c+d/é")], "h string, p string").select(tx.escape_markup(F.col("h")).alias("h"), tx.encode_path(F.col("p")).alias("p")).first()
    assert one.h == "&lt;a b=&quot;c&quot;&gt;&#39;&amp;amp;" and one.p == "a%20b/c%2Bd/%C3%A9"


def test_catalogue_edge_cases(spark):
    entries = spark.createDataFrame([("d", "a.bib", "k1"), ("d", "a.bib", "k2"), ("d", "a.tex", "k3"), ("e", "b.bib", "k4"), ("f", "c.bib", "k5"), ("d", None, "k6")], "directory string, file string, key string")
    cites = spark.createDataFrame([("d", "k1"), ("d", "k1"), ("e", "*"), ("e", "z")], "directory string, key string")
    assert sorted(r.key for r in catalog.cited_entries(entries, cites).collect()) == ["k1", "k3", "k4", "k5", "k6"]
    gate = spark.createDataFrame([("x", True, "i", True), ("x", True, "i", True), ("y", True, "i", True), ("y", True, "j", True), ("z", None, "i", True), ("w", True, "i", None)], "g string, complete boolean, identity string, sound boolean")
    assert {r.g: r.released for r in catalog.release_gate(gate, "g").collect()} == {"x": True, "y": False, "z": False, "w": False}
    asked = spark.createDataFrame([("ab",), ("abc",), ("q",), ("abx",)], "prefix string")
    found = catalog.unique_prefix(asked, spark.createDataFrame([("abc",), ("abcd",), ("abxy",)], "name string"))
    assert {r.prefix: r.name for r in found.collect()} == {"ab": None, "abc": "abc", "q": None, "abx": "abxy"}
    views = spark.createDataFrame([(1, "u", 1, "v", None), (2, "u", 2, "v", None), (3, "u", 3, "hidden", "p"), (4, "u", 4, "v", "p"), (5, "t", 1, "v", "p")], "id long, client string, ts long, name string, value string")
    assert sorted(r.id for r in catalog.changed_views(views, ("v",)).collect()) == [1, 4, 5]


def test_terms_and_medians(spark):
    df = spark.createDataFrame([("Alpha the beta gamma",), ("one",), ("",), (None,)], "t string")
    got = [r.x for r in df.select(analysis.terms(F.col("t")).alias("x")).collect()]
    assert got == [["alpha", "beta", "gamma", "alpha beta", "beta gamma"], ["one"], [], []]
    g = spark.createDataFrame([("a", v) for v in (5, 1, 1, 9)] + [("b", 3), ("b", None), ("c", None), (None, 2)], "g string, v long")
    assert {r.g: r["median"] for r in analysis.upper_median(g, ["g"], "v").collect()} == {"a": 5, "b": 3, None: 2}


def test_long_citations_are_matched_whole(spark):
    title = "On the spectral gap of random regular graphs"
    long = "filler " * 170_000
    recs = [record(0, title=title, authors="Ada Byron", citation="c0"), record(1, citation=f"{long} Byron {title}"), record(2, citation=f"{long} x"), record(3, citation=f"{long} y")]
    done = resolve.resolve(spark.createDataFrame([tuple(r.values()) for r in recs], RECORDS))
    assert sorted(r.records for r in done.collect()) == [[0, 1], [2], [3]]


def test_quantile_is_the_sorted_place(spark):
    for values in ([0.5], [0.25] * 90 + [0.75] * 10, [((i * 37) % 1000) / 1000 for i in range(1000)], [1.0, None, 2.0]):
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
        own = sorted(v for v in values if v is not None)
        want = math.ceil(round(own[len(own) * 98 // 100] / 0.01, 6)) * 0.01
        assert analysis.empirical_quantile(df, "x", 98, 100).first().extent == pytest.approx(want)
    assert analysis.empirical_quantile(spark.createDataFrame([], "x double"), "x", 98, 100).first().extent is None


def test_notes_and_candidates(spark):
    pairs = spark.createDataFrame([("b", "a", 1), ("a", "b", 2), ("a", "c", 3), (None, "a", 4)], "a string, b string, n int")
    notes = spark.createDataFrame([("a", "b", "both")], "a string, b string, note string")
    assert {r.n: r.note for r in catalog.annotate(pairs, notes).collect()} == {1: "both", 2: "both", 3: None, 4: None}
    asked = spark.createDataFrame([(1, ["x", "y", "z"]), (2, ["q"]), (3, []), (4, None), (5, [None, "z"])], "id int, candidates array<string>")
    got = catalog.first_existing(asked, spark.createDataFrame([("y",), ("z",), ("z",)], "path string"))
    assert {r.id: r.path for r in got.collect()} == {1: "y", 2: None, 3: None, 4: None, 5: "z"}


def test_self_references_and_build_states(spark):
    e = [(1, "Acme Labs", "", ""), (2, "", "by acme, 1999", ""), (3, "", "x" * 120 + " acme", ""), (4, "acmes", "", ""), (5, None, None, "see acme.test/repo"), (6, None, None, None)]
    kept = catalog.without_self_references(spark.createDataFrame(e, "id int, authors string, citation string, raw string"), "acme", "acme.test/repo")
    assert sorted(r.id for r in kept.collect()) == [3, 4, 6]
    b = [(1, "h", "h", "resolved", False, False, ["z"], []), (2, "h", "g", "resolved", None, True, [], []), (3, "h", None, None, True, False, [], []),
         (4, "h", "h", "rejected", True, True, ["q", "p", "a"], ["a"]), (5, "h", None, None, True, True, None, None)]
    schema = "id int, hash string, stored_hash string, stored_state string, built boolean, extracted boolean, used array<string>, permitted array<string>"
    got = {r.id: (r.state, r.unexpected) for r in catalog.build_states(spark.createDataFrame(b, schema)).collect()}
    assert got == {1: ("cached", []), 2: ("build-failed", []), 3: ("extraction-failed", []), 4: ("rejected", ["p", "q"]), 5: ("resolved", [])}


def test_numeric_audit_counts_what_it_cannot_compare(spark):
    schema = "id int, vector array<double>"
    ours = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0]), (3, [1.0]), (4, None)], schema)
    theirs = spark.createDataFrame([(1, [1.0, 2.5]), (2, [0.0, 1.0]), (4, [1.0])], schema)
    assert tuple(vectors.numeric_audit(ours, theirs).first()) == (2, 2, 1, 0.5)


def test_files_are_checked(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b", None), (2, 'q "x"', 0.5)], "id int, name string, x double")
    files.write_tsv(rows, f"{tmp_path}/t")
    read = lambda path, n: files.read_tsv(spark, path, "id int, name string, x double", "id", n)
    assert sorted(map(tuple, read(f"{tmp_path}/t", 2).collect())) == [(1, "a b", None), (2, 'q "x"', 0.5)]
    with pytest.raises(ValueError):
        read(f"{tmp_path}/t", 3)
    files.write_tsv(rows.union(rows), f"{tmp_path}/twice")
    with pytest.raises(ValueError):
        read(f"{tmp_path}/twice", None)
    with pytest.raises(Exception, match="separator"):
        files.write_tsv(spark.createDataFrame([(1, "a\tb")], "id int, name string"), f"{tmp_path}/bad")
    files.write_json(rows, f"{tmp_path}/j", "name", compressed=True)
    assert sorted(r.id for r in spark.read.schema("id int, name string").json(f"{tmp_path}/j").collect()) == [1, 2]


def test_upper_median_of_large_small_and_null_groups(spark):
    groups = {"big": [(i * 37) % 501 for i in range(500)], "tied": [7] * 60 + [9] * 40, "one": [3], None: [4, 1, 2, 3]}
    data = [(k, v) for k, values in groups.items() for v in values] + [("big", None), ("none", None)]
    got = {r.k: r.median for r in analysis.upper_median(spark.createDataFrame(data, "k string, v int"), ["k"], "v").collect()}
    assert got == {k: sorted(v)[len(v) // 2] for k, v in groups.items()}


def test_kmeans_sweep_query_tries_every_k_from_twenty_starts(spark, monkeypatch):
    from types import SimpleNamespace

    tried, real = [], analysis.KMeans
    never = SimpleNamespace(fit=lambda rows: SimpleNamespace(summary=SimpleNamespace(trainingCost=math.inf)))

    def start(k, seed, maxIter):
        tried.append((k, seed))
        return real(k=k, seed=seed, maxIter=2) if seed == 42 else never

    monkeypatch.setattr(analysis, "KMeans", start)
    got = QUERIES["kmeans_sweep"](spark, DATA).collect()
    ks = [6, 8, 10, 12, 14, 17, 20]
    assert [r.k for r in got] == ks and sum(r.best for r in got) == 1
    assert len(set(tried)) == len(tried) == 20 * len(ks) and {k for k, _ in tried} == set(ks)
