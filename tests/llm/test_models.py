"""Mixing, toxicity, word pieces and the pivot index."""

import random

import numpy as np
import pytest
from cases import empty, frame, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postloom.llm.mixing import mix_documents, mix_plan, mix_slots, mixed_texts, permuted, shard_counts, source_targets
from postloom.llm.pivots import near_vectors
from postloom.llm.toxicity import CATEGORIES, fit_chain, score_chain, toxicity
from postloom.llm.wordpieces import END, PieceCounter, byte_level_pieces, piece_counts


@pytest.mark.parametrize("n", [1, 2, 3, 100, 1000])
def test_permutation(spark, n):
    there = spark.range(n).select("id", permuted(F.col("id"), F.lit(n), F.lit(7)).alias("p"))
    found = there.select("id", "p", permuted(F.col("p"), F.lit(n), F.lit(7), inverse=True).alias("back")).collect()
    assert sorted(r["p"] for r in found) == list(range(n)) and all(r["back"] == r["id"] for r in found)


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    left, total, target = set(order), float(sum(sizes.values())), {}
    while left:
        share = {s: total * weight[s] / sum(weight[x] for x in left) for s in left}
        above = {s for s in left if share[s] > 3 * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = 3.0 * sizes[s]
            total -= target[s]
        left -= above
    return target


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text(min_size=0, max_size=3)), st.integers(0, 1000), min_size=1, max_size=9))
def test_targets(spark, sizes):
    found = source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    want = plain_targets(sizes)
    assert {r["source"]: pytest.approx(r["target"], abs=1e-6) for r in found} == want


def test_mix(spark):
    docs = frame(spark)
    found = mix_documents(docs, block=16).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mix_documents(docs, block=16).collect()), key=str)
    sizes = {}
    for r in rows():
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").encode().split())
    want = plain_targets(sizes)
    source = {(r[0], len((r[1] or "").encode().split())): r[3] for r in rows()}
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        s = source[r["id"], r["size"]] if r["id"] != 500 else None
        assert r["taken"] <= 3 * r["size"]
        if s in sizes and r["id"] not in (500, None):
            assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
    by_target = {}
    for r in found:
        by_target.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
    for (_, target), parts in by_target.items():
        assert abs(sum(parts) - target) <= 16
    assert len(found) == len(rows()) and mix_documents(empty(spark)).count() == 0
    assert taken.keys() == want.keys()


def test_mixed_texts_have_the_words_taken(spark):
    docs = frame(spark)
    mixed = mixed_texts(docs, block=16)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].encode().split())
    taken = {}
    for r in mix_documents(docs, block=16).collect():
        taken[r["id"]] = taken.get(r["id"], 0) + r["taken"]
    # Rows that repeat an id and have the same source may swap places.
    assert words == {i: n for i, n in taken.items() if n}
    assert mixed_texts(empty(spark)).count() == 0


def test_shards_draw_every_slot_once(spark):
    targets = source_targets(spark.createDataFrame([("a", 5000), ("b", 300), ("c", 900)], "source string, size long"))
    plan = mix_plan(targets, block=10)
    slots = mix_slots(plan, shard_slots=64).cache()
    n = slots.count()
    assert sorted(r["shard"] * 64 + r["slot"] for r in slots.collect()) == list(range(n))
    assert shard_counts(slots).agg(F.sum("n")).first()[0] == n
    uses = slots.groupBy("sid", "block").count().agg(F.max("count")).first()[0]
    assert uses <= 3


CLEAN = "the a of to and in it is was for on that by this with from at be an or".split()


def toxic_data(n=400, seed=2):
    rnd = random.Random(seed)
    bad = ["grumble", "snarlish", "zorky"]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(CLEAN) + rnd.choice(["", "", "x", "ing", "ed"]) for _ in range(rnd.randint(20, 80))]
        toxic, low = rnd.random() < 0.25, rnd.random() < 0.2
        if low:
            words = [rnd.choice(words[:2]) for _ in words]
        if toxic:
            for _ in range(rnd.randint(1, 4)):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad) + rnd.choice(["", "s", "ness", "!"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 0 if low else 1, int(toxic)))
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = toxic_data()
    frame_ = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = fit_chain(frame_, marks.where("doc_id < 250"), CATEGORIES)
    got = {r["doc_id"]: list(r["flags"]) for r in score_chain(frame_, chain, ["doc_id"]).collect()}
    for k, truth in ((0, {i: q == 0 for i, q, _ in labels}), (1, {i: t == 1 for i, _, t in labels})):
        held = [i for i in truth if i >= 250]
        assert sum(got[i][k] == truth[i] for i in held) / len(held) >= 0.97
    # The chain passes its first category on.
    assert len(chain.models[1][3]) == 1 and len(chain.models[0][3]) == 0


def test_toxicity_awkward(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(1, 1, 0), (4, None, 1), (None, 0, 1), (7, 0, 1), (10, 1, 0), (10, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    found = toxicity(docs, labels).collect()
    assert len(found) == len(rows()) and all(0 <= r["p_toxic"] <= 1 and not r["toxic"] for r in found)
    assert all(r["p_toxic"] == 0 for r in found if r["id"] in (-5, -2, 1, 4))
    assert len(toxicity(docs, labels.limit(0)).collect()) == len(rows())
    assert toxicity(empty(spark), labels).count() == 0


def greedy(word, pieces):
    symbols, n, i = (*word, END), 0, 0
    while i < len(word):
        for j in range(len(symbols), i, -1):
            if symbols[i:j] in pieces:
                break
        else:
            return 1
        n, i = n + 1, j
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.lists(st.sampled_from([97, 98, 99, END]), min_size=1, max_size=5).map(tuple), max_size=12),
       st.lists(st.sampled_from([97, 98, 99]), max_size=10).map(bytes))
def test_automaton_is_greedy_longest_match(pieces, word):
    assert PieceCounter(pieces).count(word) == greedy(word, pieces)


def test_piece_counts(spark):
    pieces = byte_level_pieces()
    plain, cache = set(pieces), {}
    longest = max(map(len, pieces))

    def count(word):
        if word not in cache:
            symbols, n, i = (*word, END), 0, 0
            while i < len(word):
                i = [j for j in range(i + 1, min(len(symbols), i + longest) + 1) if symbols[i:j] in plain][-1]
                n += 1
            cache[word] = n
        return cache[word]

    found = sorted(map(tuple, piece_counts(frame(spark)).collect()), key=str)
    want = [(r[0], len(w := (r[1] or "").lower().encode().split()), sum(map(count, w))) for r in rows()]
    assert found == sorted(want, key=str)
    assert piece_counts(empty(spark)).count() == 0


def vectors(seed=4):
    rng = np.random.default_rng(seed)
    out, n = [], 0
    for label in (0, 1, None):
        for _ in range(40):
            base = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 6))):
                out.append((n, (base + rng.normal(size=16) * 0.05).tolist(), label))
                n += 1
    base = rng.normal(size=16)
    out += [(n + i, (base + rng.normal(size=16) * 0.03).tolist(), 1) for i in range(80)]
    n += 80
    out += [(n + i, out[5][1], out[5][2]) for i in range(4)] + [(n + 10, [x * 2 for x in out[6][1]], out[6][2])]
    out += [(n + 20, None, 1), (n + 21, [], 1), (n + 22, [0.0] * 16, 1), (n + 23, [float("nan")] * 16, 1),
            (n + 24, [None] + [1.0] * 15, 1), (n + 25, [float("inf")] * 16, 1), (n + 26, [1.0] * 3, 1), (None, out[5][1], 0),
            (3, out[3][1], out[3][2])]
    return out


@pytest.mark.parametrize("chunk", [1024, 16])
def test_near_vectors(spark, chunk):
    data = [(*r, "clash", "clash") for r in vectors()]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, id string, near string")
    found = near_vectors(table, chunk=chunk).collect()
    good = [r for r in data if r[0] is not None and r[2] is not None and r[1] and None not in r[1]
            and np.isfinite(r[1]).all() and np.any(r[1])]
    ids = sorted({r[0] for r in good})
    links, total = {i: set() for i in ids}, 0
    degree = {}
    for i, a in enumerate(good):
        for b in good[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) / (
                    np.linalg.norm(a[1]) * np.linalg.norm(b[1])) >= 0.98:
                total += 2
                for x, y in ((a[0], b[0]), (b[0], a[0])):
                    degree[x] = degree.get(x, 0) + 1
                    links[x].add(y)
    # Recall of the links, none beside them.
    got = {}
    for r in found:
        got[r["id"]] = r["n_links"]
    assert all(got[i] <= degree.get(i, 0) for i in ids)
    assert sum(r["n_links"] for r in found) >= 0.97 * total
    assert len(found) == len(data)
    for r in found:
        if r["id"] not in links:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, r["id"], True)
        else:
            assert r["kept"] == (r["id"] == r["component_id"])
    assert near_vectors(table.limit(0)).count() == 0


def test_near_vectors_dense_group(spark):
    """A third of the rows is one group of near, not equal, vectors: many of the sampled pivots lie in it."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=64) / 8
    vec = rng.normal(size=(3000, 64))
    vec[:1000] = base + rng.normal(size=(1000, 64)) * (0.0155 ** 0.5 / 8)
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vec)],
                                  "vec_id long, embedding array<double>, label int")
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(1) - 1
    assert want[:1000].mean() > 500
    found = near_vectors(table, pivots=512).toPandas().set_index("id").n_links
    assert (found.sort_index().to_numpy() == want).all()
