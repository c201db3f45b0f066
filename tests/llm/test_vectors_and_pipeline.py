"""Vector operators against brute force, components, and the pipeline stage by stage."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nilas.llm import embedding_join, topk
from nilas.llm.common import row_key
from nilas.llm.ngram_join import similar
from nilas.llm.components import components, forest
from tests.llm.hard import SCHEMA, rows
from tests.llm.test_text_operators import brute_links, check_packing, least_reached

VECTORS = "vec_id long, embedding array<float>, label int, score double, rank string, kept string"


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for i in range(1, n):
        if rng.random() < 0.5:
            x[i] = x[rng.integers(0, i)] + rng.standard_normal(dim) * rng.choice([0.0, 0.1, 0.25])
    out = [(i, [float(np.float32(v)) for v in r / np.linalg.norm(r)], 1, 0.0, "a", "b") for i, r in enumerate(x)]
    bad = [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] * dim, [None] * dim, [1.0] * (dim + 1), [3e38] * dim]
    out += [(1000 + 50 * i, v, None, None, None, None) for i, v in enumerate(bad)]
    return [*out, out[0], (None, out[1][1], 1, 0.0, "a", "b")]


def test_far_shards_are_left_out(spark):
    """Two far clusters: a query of one never visits the other's shards."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((400, 6)) + 50, rng.standard_normal((400, 6)) - 50])
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    seen = []
    cells = topk.within_reach

    def watched(blocks, boxes, **options):
        out = cells(blocks, boxes, **options)
        seen.append((blocks.count() * boxes.count(), out.count()))
        return out

    topk.within_reach = watched
    try:
        got = topk.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=50, block_rows=4).collect()
    finally:
        topk.within_reach = cells
    assert len(got) == 16 * 5 and all((r["query_id"] < 400) == (r["vec_id"] < 400) for r in got)
    assert 0 < seen[0][1] <= seen[0][0] / 2


@pytest.mark.parametrize(("shard", "block"), [(8192, 1024), (60, 3), (20, 5)])
def test_top_k(spark, shard, block):
    data = vectors(300, 8, 1)
    got = topk.top_k(spark.createDataFrame(data, VECTORS).repartition(3), F.col("vec_id") % 50 == 0, shard_rows=shard, block_rows=block).collect()
    good = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(object) for i, v, *_ in data if i is not None and v and all(c is not None and np.isfinite(c) for c in v)}
    ref = Counter()
    for q in (i for i in good if i % 50 == 0):
        best = sorted((-min(max(sum(int(a) * int(b) for a, b in zip(good[q], v, strict=True)), -(2**63)), 2**63 - 1), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
        ref.update((q, n + 1, i, -s) for n, (s, i) in enumerate(best))
    assert Counter(tuple(r) for r in got) == ref
    assert topk.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize(("blocks", "options"), [(4, {}), (2, {"tile_rows": 40}), (3, {"tile_rows": 9, "cell_rows": 20})])
def test_embedding_join(spark, blocks, options):
    data = vectors(250, 12, 2)
    df = spark.createDataFrame(data, VECTORS)
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_join.near(df, blocks=blocks, **options).collect())
    null_id = df.where("vec_id IS NULL").select((-F.lit(1) - F.shiftrightunsigned(F.xxhash64(F.col("embedding").cast("array<double>")), 1))).first()[0]
    ids = [null_id if i is None else i for i, *_ in data]
    x = [np.array(v, dtype=np.float32).astype(float) if v and all(c is not None and np.isfinite(c) for c in v) and any(v) else None for _, v, *_ in data]
    links = [set() for _ in x]
    for i, a in enumerate(x):
        for j in range(i):
            b = x[j]
            if a is not None and b is not None and len(a) == len(b):
                a1, b1 = a / abs(a).max(), b / abs(b).max()
                if a1 @ b1 / np.linalg.norm(a1) / np.linalg.norm(b1) >= 0.9:
                    links[i].add(j)
                    links[j].add(i)
    least = least_reached(ids, links)
    assert got == Counter((i, len(m), c, c == i) for i, m, c in zip(ids, links, least, strict=True))
    assert sum(map(len, links)) > 100
    assert embedding_join.near(spark.createDataFrame([], VECTORS)).count() == 0


def test_cells_hold_all_partners():
    rng = np.random.default_rng(3)
    y, pivots = rng.standard_normal((300, 3)), rng.standard_normal((12, 3))
    row, cell = embedding_join.cells_of(y, pivots, 0.4)
    home, at = cell[:300], set(zip(row.tolist(), cell.tolist(), strict=True))
    for i, j in np.argwhere(((y[:, None] - y[None]) ** 2).sum(axis=2) <= 0.16):
        last = max(home[i], home[j])
        assert (i, last) in at and (j, last) in at
    assert len(at) == len(row) < 300 * 12 / 2


def test_an_id_on_several_vectors(spark):
    data = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.99, 0.1, 0.0]), (3, [0.0, 0.0, 1.0]), (3, [0.0, 0.0, 1.0])]
    for kind in ("float", "double"):
        got = Counter(tuple(r) for r in embedding_join.near(spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>")).collect())
        assert got == {(1, 1, 1, True): 1, (1, 0, 1, True): 1, (2, 1, 1, False): 1, (3, 1, 3, True): 2}
    found = Counter((r["query_id"], r["vec_id"]) for r in topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<float>"), F.col("vec_id") == 2).collect())
    assert found == {(2, 1): 2, (2, 3): 1}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 260)] + [(500, i) for i in range(501, 600)]
    links = {}
    for a, b in edges:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    for start in {x for e in edges if e[0] != e[1] for x in e}:
        todo, seen = [start], {start}
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        assert got[start] == min(seen)
    a, b = np.array([x for x, _ in edges]), np.array([y for _, y in edges])
    roots = forest(601, a, b, step=7)
    assert all(roots[x] == got.get(x, x) for x in range(601))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- pipeline


@pytest.fixture(scope="module")
def stages(spark):
    sf_dir, docs, out = "/root/testdata/sf0.001", spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, sf_dir)
        out.append((name, docs.collect(), result.collect(), result.columns))
        docs = spark.createDataFrame(out[-1][2], result.schema) if out[-1][2] else result
    return out


def test_columns_of_stages(stages):
    assert all(c == ["doc_id", "text", "lang", "source", "n_chars"] for _, _, _, c in stages[:-1])


def test_toxic_documents_go(stages, spark):
    _, before, after, _ = stages[0]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    clean = [r["doc_id"] for r in before if labels.get(r["doc_id"]) == 0]
    assert gone and sum(d in gone for d in clean) <= 0.05 * len(clean)
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_frequent_lines_go(stages):
    _, before, after, _ = stages[1]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    seen = Counter(k for r in before for k in {key(x) for x in r["text"].split("\n")} if k)
    ref = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if seen[key(x)] < 10) for r in before}
    assert {r["doc_id"]: r["text"] for r in after} == ref
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_one_of_each_group_stays(stages):
    _, before, after, _ = stages[2]
    texts = [(r["doc_id"], r["text"]) for r in before]
    least = least_reached([i for i, _ in texts], brute_links(texts))
    assert sorted(r["doc_id"] for r in after) == sorted(set(least)) and len(after) < len(before)


def test_mix_reaches_its_targets(stages):
    _, before, after, _ = stages[3]
    words = lambda rows_: Counter(s for r in rows_ for s in [r["source"]] * len((r["text"] or "").split()))
    have, got = words(before), words(after)
    assert abs(sum(got.values()) - sum(have.values())) < 0.02 * sum(have.values())
    text = {r["doc_id"]: r["text"] for r in before}
    whole = Counter(r["doc_id"] for r in after if r["text"] == text[r["doc_id"]])
    assert max(whole.values()) <= 3 and set(r["doc_id"] for r in after) <= set(text)


def test_packing_stage(stages):
    _, before, after, _ = stages[4]
    used, least = check_packing(after, [(r["doc_id"], r["text"]) for r in before])
    assert used <= least + 2


def test_unlike_documents_of_one_id_stay(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = spark.createDataFrame([(1, a), (1, b), (2, b + " end"), (3, c), (3, c), (4, c), (None, ""), (None, None), (5, "")], "doc_id long, text string")
    got = Counter(tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got.pop((1, a)) == 1 and got.pop((1, b), 0) + got.pop((2, b + " end"), 0) == 1
    assert got == {(3, c): 1, (None, ""): 1, (None, None): 1, (5, ""): 1}


def test_an_id_on_several_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (2, a + " x"), (3, "")], "doc_id long, text string")
    got = Counter(tuple(r) for r in similar(docs).collect())
    assert got == {(1, 1, 2, True): 1, (1, 1, 0, True): 1, (2, 1, 2, False): 2, (3, 3, 0, True): 1}


def test_mix_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "en", "a", 5)] * 4 + [(2, text, "en", "b", 5), (None, "x y", "en", "b", 5)], SCHEMA.split(", score")[0])
    got = corpus_pipeline.mix_sources(spark, docs, "").collect()
    assert abs(sum(len(r["text"].split()) for r in got) - 302) <= 16
    assert max(Counter(r["doc_id"] for r in got if r["text"] == text).values()) <= 12


def test_stages_take_hard_and_empty_tables(spark):
    for table in (rows(), []):
        docs = spark.createDataFrame(table, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            docs.count()
    assert spark.range(1).select(row_key(F.lit(None), F.lit(None))).first()[0] < 0
