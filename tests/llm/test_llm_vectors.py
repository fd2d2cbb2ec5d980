"""Operators over vectors and URLs, and the pipeline, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintry.llm import hnsw, topk, url_cascade

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, n_links string"


def cluster(n, dim, spread, seed):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(max(n // 30, 1), dim))
    return (centres[draw.integers(len(centres), size=n)] + spread * draw.normal(size=(n, dim))).astype(np.float32)


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, a large group of one label, copies, and rows that take no part."""
    x = cluster(600, 16, 0.06, 1)
    rows = [(i, v.tolist(), int(i % 4) if i < 400 else 1, "s", "n") for i, v in enumerate(x)]
    rows += [(1000 + i, x[3].tolist(), 3, "s", "n") for i in range(20)]
    rows += [rows[7], (2000, None, 1, "s", "n"), (2001, [0.0] * 16, 1, "s", "n"), (2002, [], 1, "s", "n")]
    rows += [(2003, [None] + [1.0] * 15, 1, "s", "n"), (2020, [float("nan")] + [1.0] * 15, 1, "s", "n")]
    rows += [(2005, [float("inf")] * 16, 1, "s", "n"), (2006, x[0].tolist(), None, "s", "n")]
    rows += [(None, x[0].tolist(), 0, "s", "n"), (2008, [1.0, 2.0], 1, "s", "n"), (2040, [1.0, 2.0], 1, "s", "n")]
    return spark.createDataFrame(rows, SCHEMA)


def fit(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def brute_links(rows, threshold):
    rows = [(i, r) for i, r in enumerate(rows)]
    near: dict = {i: set() for i, _ in rows}
    for i, a in rows:
        for j, b in rows:
            ok = all(fit(r["embedding"]) and any(r["embedding"]) and r["label"] is not None and r["vec_id"] is not None for r in (a, b))
            if j < i and ok and a["label"] == b["label"] and len(a["embedding"]) == len(b["embedding"]):
                x, y = np.array(a["embedding"], float), np.array(b["embedding"], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    near[i].add(j)
                    near[j].add(i)
    return near


@pytest.mark.parametrize("shard_rows", [100, 16_384])
def test_hnsw_by_brute_force(vectors, shard_rows):
    rows = vectors.collect()
    near = brute_links(rows, 0.98)
    assert sum(map(len, near.values())) > 3000
    component: dict = {}
    for i in near:
        if i not in component:
            group, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()] - group:
                    group.add(j)
                    todo.append(j)
            ids = [rows[k]["vec_id"] for k in group if rows[k]["vec_id"] is not None]
            component |= {k: min(ids) if ids else None for k in group}
    expected = sorted(
        (-1 if r["vec_id"] is None else r["vec_id"], len(near[i]), component[i] if component[i] is not None else -1,
         r["vec_id"] is not None and component[i] == r["vec_id"])
        for i, r in enumerate(rows)
    )
    found = hnsw.near_duplicates(vectors, shard_rows=shard_rows)
    assert found.columns == ["vec_id", "label", "score", "n_links", "component_id", "kept"]
    got = sorted(
        (-1 if r["vec_id"] is None else r["vec_id"], r["n_links"], -1 if r["component_id"] is None else r["component_id"], r["kept"])
        for r in found.collect()
    )
    assert got == expected


def test_hnsw_of_nothing(vectors):
    assert hnsw.near_duplicates(vectors.where("vec_id < 0")).count() == 0
    assert hnsw.near_duplicates(vectors.where("label is null")).first()["n_links"] == 0


def test_beam_widens_until_the_audit_passes():
    x = hnsw._unit(cluster(800, 8, 0.02, 2).astype(np.float64))
    graph = hnsw.Graph.build(x.astype(np.float32))
    # With all links at the bottom cut, only ever wider beams up to the whole find any.
    graph.bottom[:] = -1
    found = hnsw._searched(graph, x, x[:50], 0.98, 4, np.arange(50))
    assert all((np.flatnonzero(x @ x[i] >= 0.98) == f).all() for i, f in enumerate(found))


def planted(n, dim, pairs, seed):
    """Far vectors, and a few near copies among them, in two halves."""
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(2, n, dim))
    at = draw.permutation(n)[:pairs]
    x[1, at] = x[0, at] + 0.1 * draw.normal(size=(pairs, dim))
    return hnsw._unit(x[0]), hnsw._unit(x[1])


def test_made_copies_widen_the_beam_where_the_table_has_no_links():
    a, b = planted(900, 16, 9, 5)
    graph = hnsw.Graph.build(b.astype(np.float32))
    # With the links at the bottom cut the search finds next to nothing.
    graph.bottom[:] = -1
    beam = hnsw._own_beam(graph, b, 0.98, 4)
    assert beam >= len(b)
    found = hnsw._searched(graph, b, a, 0.98, beam, hnsw._drawn(len(a)))
    assert [f.tolist() for f in found] == [np.flatnonzero(b @ q >= 0.98).tolist() for q in a]


def test_the_graph_answers_and_finds_what_links(monkeypatch):
    """Recall over 4,096 vectors, where few queries are compared with all of them."""
    draw = np.random.default_rng(3)
    base = draw.normal(size=(3700, 32))
    copies = base[draw.integers(0, len(base), 396)]
    b = hnsw._unit(np.concatenate([base, copies + 0.1 * draw.normal(size=copies.shape)]))
    a = hnsw._unit(b + 0.025 * draw.normal(size=b.shape))
    graph = hnsw.Graph.build(b.astype(np.float32))
    compared, truth_of = [], hnsw._truth

    def counted(exact, queries, some, threshold):
        compared.append(len(some))
        return truth_of(exact, queries, some, threshold)

    monkeypatch.setattr(hnsw, "_truth", counted)
    beam = hnsw._own_beam(graph, b, 0.98, hnsw.BEAM)
    found = list(hnsw._searched(graph, b, a, 0.98, beam, hnsw._drawn(len(a))))
    true = a @ b.T >= 0.98
    hits = sum(true[i, near].sum() for i, near in enumerate(found))
    assert true.sum() > 3000 and hits >= 0.98 * true.sum()
    assert all(true[i, near].all() for i, near in enumerate(found))
    assert sum(compared) <= 2 * hnsw.AUDITED + hnsw.AUDITED_QUERIES and beam < 1000


@pytest.mark.parametrize("own", [False, True])
def test_a_link_found_from_one_side_counts_for_both(monkeypatch, own):
    x = hnsw._unit(cluster(300, 8, 0.05, 7).astype(np.float64))
    a, b = (x, x) if own else (x[:140], x[140:])
    true = a @ b.T >= 0.98
    if own:
        np.fill_diagonal(true, False)
    calls = []

    def half(graph, exact, queries, *rest):
        """From one side all links are found; in the own shard from lower to higher ones."""
        calls.append(len(queries))
        for i, q in enumerate(queries):
            near = np.flatnonzero(exact @ q >= 0.98)
            yield near[near >= i] if own else near if len(calls) == 1 else near[:0]

    monkeypatch.setattr(hnsw, "_searched", half)
    bits = hnsw._linked((None, a, 1), (None, b, 1), 0.98, own)
    kept, count_a, count_b = hnsw._reduced(bits, np.full(len(a), 2), np.full(len(b), 3), own)
    assert count_a.tolist() == (3 * true.sum(axis=1)).tolist() and count_b.tolist() == (2 * true.sum(axis=0)).tolist()
    shift = 0 if own else len(a)
    parts = brute_groups(len(a) + (0 if own else len(b)), [(i, j + shift) for i, j in zip(*np.nonzero(true))])
    assert brute_groups(len(parts), [(i, j + shift) for i, j in kept]) == parts
    assert len(kept) == len(parts) - len(set(parts))


def brute_groups(n, pairs):
    group = list(range(n))
    for a, b in pairs:
        if group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = [low if g == high else g for g in group]
    return group


def test_graph_survives_its_bytes():
    x = hnsw._unit(cluster(500, 8, 0.5, 3).astype(np.float64)).astype(np.float32)
    graph = hnsw.Graph.build(x)
    again = hnsw.Graph.from_bytes(x, **graph.to_bytes())
    for q in x[:40]:
        assert graph.within(q, 0.9, 16).tolist() == again.within(q, 0.9, 16).tolist()


@pytest.mark.parametrize("k", [1, 20, 5000])
def test_top_k_by_brute_force(vectors, k, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rows = vectors.collect()
    held = [
        (r["vec_id"], [int(np.floor(float(x) * 64)) for x in r["embedding"]])
        for r in rows if r["vec_id"] is not None and fit(r["embedding"])
    ]
    expected = []
    for q, v in {(i, tuple(v)) for i, v in held if i % 20 == 0}:
        scored = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in held if i != q and len(w) == len(v)]
        expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    found = topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=k)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert topk.top_k(vectors, vectors.where("vec_id < 0")).count() == 0
    assert topk.top_k(vectors.where("vec_id < 0"), vectors.where("vec_id % 20 = 0")).count() == 0


def test_top_k_with_very_many_ties(spark):
    rows = [(i, [0.5, 0.25]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(8)
    found = topk.top_k(df, df.where("vec_id in (0, 40)"), k=5).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in found] == [
        (0, i, i, 32 * 32 + 16 * 16) for i in range(1, 6)
    ] + [(40, i + 1, i, 32 * 32 + 16 * 16) for i in range(5)]


RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]
URLS = [
    None, "", "no scheme", "http://", "http://example.org", "http://example.org/", "HTTP://A.Example.ORG/es/x?q#f",
    "https://badexample.org/es/x", "https://example.org/en/12", "https://example.org/en/2", "ftp://x.com/fr/1://",
    "http://x.com/de/", "http://com/de/", "http://x.com?/de/", "http://x.com#a", "http://x.com/DE/", "http://.com/de/1",
    "a://b://c.org/", "http://x.net/de/\nline", "http://x..org/é",
]


def brute_verdict(url, rules):
    rest = url.partition("://")[2] if url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut], rest[cut:]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [
        (len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules
        if host and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    _, _, _, rule, verdict = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, rule, verdict


def test_urls_by_brute_force(spark):
    urls = [*URLS, URLS[6]]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id bigint, url string, Verdict string")
    found = {r["page_id"]: tuple(r)[2:] for r in url_cascade.judge(df, RULES).collect()}
    assert found == {i: brute_verdict(u, RULES) for i, u in enumerate(urls)}
    assert url_cascade.judge(df.where("page_id < 0"), RULES).count() == 0
    assert url_cascade.judge(df, []).where("verdict != 'allow' or rule is not null").count() == 0


def test_cascade_of_many_levels_is_exact(spark, monkeypatch):
    draw = random.Random(6)
    hosts = [f"h{i}.{draw.choice(['com', 'org'])}" for i in range(1500)]
    rules = [(draw.choice(["allow", "block"]), h, "/") for h in hosts[:500]]
    df = spark.createDataFrame([(i, f"http://w.{h}/x") for i, h in enumerate(hosts)], "page_id bigint, url string")
    built = []
    whole = url_cascade.build
    monkeypatch.setattr(url_cascade, "build", lambda *a: built.append(whole(*a)) or built[-1])
    found = {r["page_id"]: tuple(r)[2:] for r in url_cascade.judge(df, rules).collect()}
    assert found == {i: brute_verdict(f"http://w.{h}/x", rules) for i, h in enumerate(hosts)}
    assert max(len(c.levels) for c in built) > 2


def test_pipeline_by_its_stages(spark, tmp_path):
    """The pipeline keeps what each operator, applied by itself, says should stay."""
    import corpus_pipeline
    from conftest import SF_DIR

    from vintry.llm import quality, simhash, toxicity
    from vintry.llm.queries import WORD_VOCABULARY
    from vintry.llm.words import word_encoder

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash", "packing"]
    pieces = corpus_pipeline.run(spark, SF_DIR).collect()
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    mild = docs.join(toxicity.scored(docs, labels).where("predicted = 0").select("doc_id"), "doc_id", "left_semi")
    good = mild.join(quality.classified(mild, labels).where("predicted = 1").select("doc_id"), "doc_id", "left_semi")
    rows = good.select("doc_id", "text").collect()
    prints = [simhash.fingerprint(r["text"]) for r in rows]
    kept, component = [], {}
    for i in sorted(range(len(rows)), key=lambda i: rows[i]["doc_id"]):
        if i not in component:
            kept.append(rows[i])
            todo = [i]
            while todo:
                j = todo.pop()
                component[j] = i
                todo += [k for k in range(len(rows)) if k not in component and (prints[k] ^ prints[j]).bit_count() <= 4]
    expected = {}
    for r in kept:
        expected[r["doc_id"]] = len(word_encoder(WORD_VOCABULARY).encode_batch([r["text"]])[0]) + 1
    got: dict = {}
    for p in pieces:
        got[p["doc_id"]] = got.get(p["doc_id"], 0) + p["length"]
    assert got == expected


def test_contract_names():
    import __spark_entry__ as contract

    names = [n for n in contract.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert "pipeline" in contract.queries()
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", ["op2_licenses", "op3_hnsw", "op4_topk", "op9_url_cascade"])
def test_queries_match_sql(spark, name):
    import __spark_entry__ as contract
    from compare import compare, open_tables
    from conftest import SF_DIR

    result = compare(contract.queries()[name](spark, SF_DIR), open_tables(SF_DIR), contract.oracle_sql()[name])
    assert result["columns"] and result["values"] and not result["types"], result


@pytest.mark.parametrize("name", ["op1_quality", "op2_licenses", "op5_simhash", "op6_byte_bpe", "op7_token_counts", "op10_toxicity"])
def test_queries_give_a_row_per_document(spark, name):
    import __spark_entry__ as contract
    from conftest import SF_DIR

    found = contract.queries()[name](spark, SF_DIR)
    ids = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id")
    assert found.select("doc_id").exceptAll(ids).count() == ids.exceptAll(found.select("doc_id")).count() == 0


def test_a_host_of_very_many_labels(spark):
    rows = [(1, "http://" + "a." * 50_000 + "Example.org/en/12"), (2, "http://x.com" + "/de/" * 9000), (3, "http://" + "." * 90_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    rules = [("allow", "org", "/"), ("block", "example.org", "/en/1"), ("block", "com", "/de/")]
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_cascade.judge(pages, rules).collect()}
    assert found == {1: ("example.org/en/1", "block"), 2: ("com/de/", "block"), 3: (None, "allow")}
