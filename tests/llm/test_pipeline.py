"""The pipeline and the registered queries on the smallest tables."""

import hashlib

import duckdb
import numpy as np
import pytest
from cases import components, empty, frame, rows

import corpus_pipeline
from check import compare, connect
from postloom.llm import jaccard
from postloom.llm.jaccard import jaccard_links
from postloom.llm.queries import ORACLES, QUERIES
from postloom.llm.simhash import simhash

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES if q.startswith("op")) == list(range(1, 14))
    assert "pipeline" in QUERIES and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    assert compare(QUERIES[name](spark, SF).toPandas(), connect(SF).execute(ORACLES[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if q.startswith("op") and q[:4] != "op12"))
def test_queries_return_every_document(spark, name):
    found = QUERIES[name](spark, SF)
    table, key = ("embeddings", "vec_id") if name.startswith("op9") else ("documents", "doc_id")
    n = duckdb.execute(f"select count(*) from '{SF}/{table}.parquet'").fetchone()[0]
    assert found.select(key).distinct().count() == n


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], SF).cache())
    names = docs.columns
    assert all(s.columns == names for s in steps[:-1])
    start, clean, unique, apart, mixed, packed = (s.toPandas() for s in steps)
    bad = "loser idiot pathetic scum worthless moron trash clown disgusting stupid".split()
    toxic = start.text.str.lower().str.contains(r"\b(?:" + "|".join(bad) + r")\b")
    left = set(clean.doc_id)
    assert len(left & set(start.doc_id[toxic])) <= 1 and len(left) >= 0.97 * (len(start) - toxic.sum()) - 3
    want = clean.sort_values("doc_id").drop_duplicates("text", keep="last")
    assert set(unique.doc_id) == set(want.doc_id)
    prints = np.array([simhash(t.encode()) for t in apart.text], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :])
    np.fill_diagonal(near, 64)
    assert near.min() > 3
    assert set(mixed.doc_id) <= set(apart.doc_id)
    assert set(packed.doc_id) == set(mixed.doc_id) and packed.groupby("sequence_id").length.sum().max() <= 1024
    n = QUERIES["pipeline"](spark, SF).count()
    assert n == len(packed)


def test_stages_awkward(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = frame(spark)
    for data in (docs, empty(spark)):
        now = data
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path)).cache()
            assert now.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() >= now.count()
    texts = {r[1] or "" for r in rows()}
    kept = corpus_pipeline.drop_copies(spark, docs, str(tmp_path)).collect()
    assert sorted(hashlib.md5((r["text"] or "").encode()).hexdigest() for r in kept) == sorted(
        hashlib.md5(t.encode()).hexdigest() for t in texts)


def test_near_copies_go_by_row(spark, tmp_path):
    """Of the rows with an id only the near copy goes, and rows without an id go too."""
    base = " ".join(f"w{n}" for n in range(400))
    other = " ".join(f"v{n}" for n in range(400))
    data = [(1, base), (2, base.upper()), (2, other), (None, base.title()), (3, "another text of its own")]
    docs = frame(spark, [(i, t, "en", "s1", None, "", "", "", "", None, "") for i, t in data])
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, base), (2, other), (3, "another text of its own")]


def test_near_copies_of_five_word_shingles(spark, tmp_path):
    """Planted copies of Jaccard 0.8 to 0.95 go, also those found only through another, and less similar texts stay."""
    rng = np.random.default_rng(5)

    def words(n):
        return [f"w{x}" for x in rng.integers(0, 10 ** 9, n)]

    def jaccard(a, b):
        a, b = ({tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        return len(a & b) / len(a | b)

    data, want, near = [], set(), []
    for n in range(60):
        base = words(300)
        data.append((10 * n, base))
        want.add(10 * n)
        for k in range(1, 4):
            text = list(base)
            for at in rng.choice(60, int(rng.integers(1, 7)), replace=False):
                text[5 * at] = "changed" + str(k)
            near.append(jaccard(base, text))
            assert near[-1] >= 0.8
            data.append((10 * n + k, text))
        far = words(60) + base[60:]
        assert jaccard(base, far) < 0.75
        data.append((10 * n + 9, far))
        want.add(10 * n + 9)
    assert min(near) < 0.85 and max(near) > 0.9
    docs = frame(spark, [(i, " ".join(t), "en", "s1", None, "", "", "", "", None, "") for i, t in data])
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()}
    assert kept == want


def test_dense_group_of_borderline_copies(spark):
    """Copies of one text with a few edits each, most not similar to the first: no link is lost, and shared
    passages make no pairs."""
    rng = np.random.default_rng(8)
    base, passage = [f"w{x}" for x in range(150)], [f"p{x}" for x in range(40)]
    texts = []
    for n in range(120):
        text = list(base)
        for k in rng.choice(30, int(rng.integers(1, 7)), replace=False):
            text[5 * k] = f"e{n}x{k}"
        texts.append(text)
    texts += [[f"q{n}x{k}" for k in range(30)] + passage for n in range(60)]
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {(r["a"], r["b"]) for r in jaccard_links(rows).collect()}
    assert found <= {*links, *((j, i) for i, j in links)}
    assert components(len(texts), found) == components(len(texts), links)
    assert 1 < len(set(components(len(texts), links))) < len(texts)


def test_chunks_meet_once_and_find_all_links(spark, monkeypatch):
    """Every pair of different groups of a bucket shares a unit; the chunks of one large group do not."""
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    rnd = np.random.default_rng(2)
    data = [(1, i, 0 if i < 40 else 1 if i < 60 else i) for i in range(90)] + [(2, i, i) for i in range(5)]
    members = spark.createDataFrame(data, "key long, id long, root long")
    units = jaccard._chunk_units(members).toPandas()
    met = set()
    for (key, u, v), part in units.groupby(["key", "u", "v"]):
        left, right = (part, part) if u == v else (part[~part.side], part[part.side])
        met |= {(key, a, b) for a in left.id for b in right.id}
        big = {r for r in part.root if key == 1 and r < 2}
        assert len(part) > 0 and (u != v or not big)
    root = {(k, i): r for k, i, r in data}
    want = {(k, a, b) for k, a, r in data for x, b, q in data if x == k and r != q}
    assert want <= met | {(k, b, a) for k, a, b in met}
    assert not any(root[k, a] == root[k, b] < 2 and k == 1 for k, a, b in met)
    texts = {i: [f"w{x}" if rnd.random() > .04 else f"e{i}x{x}" for x in range(80)] for i in range(90)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id long, text string")
    sets = {i: {tuple(t[k:k + 5]) for k in range(len(t) - 4)} for i, t in texts.items()}
    near = {(root[1, a], root[1, b]) for a in range(90) for b in range(90) if root[1, a] < root[1, b]
            and 10 * len(sets[a] & sets[b]) >= 6 * len(sets[a] | sets[b])}
    found = jaccard._unit_links(docs, jaccard._chunk_units(members.where("key = 1")), 5, 0.6).collect()
    got = {tuple(sorted((root[1, r["a"]], root[1, r["b"]]))) for r in found}
    assert got == near and len(near) > 20
