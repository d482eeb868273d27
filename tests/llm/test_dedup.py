"""Exact, SimHash, line and substring dedup against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from cases import components, empty, frame, rows

from postloom.llm import exact, substrings
from postloom.llm.exact import Bucket, CuckooFilter, exact_groups, text_digests, update_index
from postloom.llm.lines import candidate_sets, dedup_lines, line_sets, set_classes, without_lines, word_ranks
from postloom.llm.simhash import forest, simhash, simhash_groups
from postloom.llm.substrings import dedup_substrings

SPACE = r"[^\x20\x09-\x0D]+"


def test_cuckoo_filter_inserts_deletes_and_overflows():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    bucket = Bucket()
    for i, k in enumerate(keys):
        bucket.insert(k, i, 1)
    assert bucket.filter.rows > 64 and all(map(bucket.filter.maybe, keys))
    for k in keys[::2]:
        bucket.delete(k)
    bucket.delete(keys[0])
    assert all(map(bucket.filter.maybe, keys[1::2])) and sum(map(bucket.filter.maybe, keys[::2])) < 30
    again = CuckooFilter.from_bytes(bucket.filter.to_bytes())
    assert all(map(again.maybe, keys[1::2]))
    bucket.insert(keys[1], 7_000, 2)
    assert bucket.live[keys[1]] == (7_000, 3) and bucket.filter.maybe(keys[1])


def test_exact_groups(spark):
    groups = defaultdict(list)
    for r in rows():
        groups[r[1] or ""].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids)
    assert Counter(map(tuple, exact_groups(frame(spark)).collect())) == want
    assert exact_groups(empty(spark)).count() == 0


def test_exact_index_grows_and_forgets(spark):
    def index(texts, first=0):
        return text_digests(spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))

    old = update_index(index(["a", "b", "c", "a"]), buckets=4).cache()
    new = update_index(index(["a", "d"], 10), old, index(["b", "z"]).select("digest")).where("digest is not null")
    name = {hashlib.sha256(t.encode()).digest(): t for t in "abcd"}
    assert {name[bytes(r["digest"])]: (r["keep_id"], r["group_size"]) for r in new.collect()} == {
        "a": (10, 3), "c": (2, 1), "d": (11, 1)}


def test_exact_copies_of_several_tasks_meet_in_the_index(spark):
    """A hot digest and null ids, in every order of arrival: combined per task, verified and replaced in buckets."""
    data = [(i if i % 7 else None, "hot" if i % 3 == 0 else f"t{i % 40}" if i % 2 else "no id") for i in range(600)]
    data = [(None if t == "no id" else i, t) for i, t in data]
    want = defaultdict(lambda: (None, 0))
    for i, t in data:
        keep, n = want[hashlib.sha256(t.encode()).digest()]
        want[hashlib.sha256(t.encode()).digest()] = (max((x for x in (keep, i) if x is not None), default=None), n + 1)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    found = update_index(text_digests(docs), buckets=8).where("digest is not null").collect()
    assert {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in found} == want


def test_exact_combines_run_by_run(monkeypatch):
    monkeypatch.setattr(exact, "RUN_ROWS", 4)
    batches = [pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "digest": pa.array(keys, pa.binary())})
               for ids, keys in (([1, None], [b"a", b"b"]), ([5, 3], [b"a", b"a"]), ([], []), ([None, 2], [b"b", b"a"]))]
    got = [sorted(zip(*(c.to_pylist() for c in b.columns), strict=True)) for b in exact.combined(iter(batches))]
    assert got == [[(b"a", 5, 3), (b"b", None, 1)], [(b"a", 2, 1), (b"b", None, 1)]]
    assert list(exact.combined(iter([]))) == []


def plain_simhash(text):
    words = re.findall(SPACE.encode(), text.encode().lower())
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_groups(spark):
    found = simhash_groups(frame(spark)).collect()
    data = [r for r in rows() if r[0] is not None]
    prints = [plain_simhash(r[1] or "") for r in data]
    assert prints == [simhash((r[1] or "").encode()) for r in data]
    root = components(len(data), [(i, j) for j in range(len(data)) for i in range(j)
                                  if bin(prints[i] ^ prints[j]).count("1") <= 3])
    least = {}
    for i, r in enumerate(data):
        least[root[i]] = min(least.get(root[i], r[0]), r[0])
    want = Counter((r[0], f"{prints[i]:016x}", least[root[i]]) for i, r in enumerate(data))
    assert Counter(tuple(r) for r in found if r["id"] is not None) == want
    # Rows without an id take the component of their fingerprint.
    base = next(r[1] for r in rows() if r[0] == 22)
    component = {tuple(r)[1]: tuple(r)[2] for r in found if r["id"] is not None}
    alone = [tuple(r)[1:] for r in found if r["id"] is None]
    assert sorted(alone) == sorted((f"{p:016x}", component.get(f"{p:016x}")) for p in map(
        plain_simhash, (base, "", "only without id")))
    assert simhash_groups(empty(spark)).count() == 0


def test_simhash_forest_in_chunks():
    rng = np.random.default_rng(1)
    fp = []
    for _ in range(60):
        x = int(rng.integers(0, 2 ** 63))
        for _ in range(int(rng.integers(1, 40))):
            for b in rng.choice(64, int(rng.integers(0, 4)), replace=False):
                x ^= 1 << int(b)
            fp.append(x)
    fp = np.array(sorted(set(fp)), np.uint64)
    unit = np.arange(len(fp)) // 150
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    want = components(len(fp), [(i, j) for i, j in zip(*np.where(np.triu(near, 1))) if unit[i] == unit[j]])
    a, b = forest(unit, np.arange(len(fp)), fp.view(np.int64))
    assert components(len(fp), list(zip(a.tolist(), b.tolist()))) == want


def plain_lines(data):
    sets = [(i, k, hash(t), frozenset(re.findall(SPACE, line))) for i, t in data for k, line in enumerate(t.split("\n"))]
    sets = [s for s in sets if s[3]]
    first = {}
    for i, k, h, s in sets:
        first[s] = min(first.get(s, (i, k)), (i, k))
    similar = {s: [t for t in first if t != s and 5 * len(s & t) >= 4 * len(s | t)] for s in first}
    out = []
    for i, t in data:
        gone, links = [], 0
        for k, line in enumerate(t.split("\n")):
            s = frozenset(re.findall(SPACE, line))
            if s:
                links += len(similar[s])
                if first[s] != (i, k) or any(first[o] < first[s] for o in similar[s]):
                    gone.append(k)
        out.append((i, t.count("\n") + 1, len(gone), links, tuple(gone)))
    return Counter(out)


def line_rows():
    rnd = random.Random(5)
    vocabulary = [f"v{i}" for i in range(60)]
    data = []
    for i in range(60):
        lines = []
        for _ in range(rnd.randint(0, 6)):
            line = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 14))]
            lines.append(" ".join(line))
            if rnd.random() < 0.5 and line:
                line[rnd.randrange(len(line))] = rnd.choice(vocabulary)
                lines.append("  ".join(rnd.sample(line, len(line))))
        data.append((i * 7 % 60, "\n".join(lines)))
    return data


def test_lines_random(spark):
    data = line_rows()
    found = dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).drop("key").collect()
    assert Counter((r[0], r[1], r[2], r[3], tuple(r[4])) for r in found) == plain_lines(data)


def test_lines_awkward(spark):
    docs = frame(spark)
    found = dedup_lines(docs).cache()
    data = [(r[0], r[1] or "") for r in rows() if r[0] is not None]
    assert Counter((r["id"], r["n_lines"], r["n_removed"], r["n_links"], tuple(r["removed"])) for r in found.collect()
                   if r["id"] is not None) == plain_lines(data)
    assert found.where("id is null").agg({"n_removed": "sum"}).first()[0] == 0
    kept = without_lines(docs, found)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    text = {r["doc_id"]: r["text"] for r in kept.collect()}
    want = next(r for r in rows() if r[1] and r[1].startswith("same line"))
    assert text[want[0]].split("\n") == ["same line of words here now", "other"]
    assert dedup_lines(empty(spark)).count() == 0


def test_lines_that_share_only_rare_words_are_no_candidates(spark):
    """Sets that meet at each of five rare words and have nothing else in common: ruled out where they meet."""
    own = [[f"own{i}x{k}" for k in range(25)] for i in range(40)]
    data = [(i, " ".join([*(f"rare{k}" for k in range(5)), *words])) for i, words in enumerate(own)]
    data.append((40, data[0][1] + " tail"))
    often = spark.createDataFrame([(" ".join(words * 50),) for words in own], "text string")
    texts = spark.createDataFrame([(i, i, t) for i, t in data], "id long, key long, text string")
    classes = set_classes(line_sets(texts, word_ranks(often))).cache()
    found = candidate_sets(classes)
    number = {r["first"]["id"]: r["cid"] for r in classes.collect()}
    assert [{r["a"], r["b"]} for r in found.collect()] == [{number[0], number[40]}]


def test_large_lines_keep_their_links(spark):
    """Sets with both halves of the bit map, with one, and pairs of one of each; some pairs just at the limit."""
    rnd = random.Random(11)
    data = []
    for i, n in enumerate([5, 8, 9, 17, 36, 57, 62, 64, 65, 66, 72, 90, 130, 200] * 3):
        words = [f"q{i}w{k}" for k in range(n)]
        for change in (0, 1, n // 9, n // 9 + 1, n // 5):
            less = words[:n - change]
            data += [" ".join(less + [f"z{rnd.random()}" for _ in range(change)]), " ".join(less), " ".join(words + less)]
    data = list(enumerate(data))
    found = dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).drop("key").collect()
    assert Counter((r[0], r[1], r[2], r[3], tuple(r[4])) for r in found) == plain_lines(data)


def plain_substrings(data):
    first, split = {}, []
    for i, t in data:
        words = t.encode().split()
        split.append(words)
        for k in range(len(words) - 12):
            w = tuple(words[k:k + 13])
            first[w] = min(first.get(w, i), i)
    out = []
    for (i, _), words in zip(data, split):
        gone = [False] * len(words)
        for k in range(len(words) - 12):
            if first[tuple(words[k:k + 13])] < i:
                gone[k:k + 13] = [True] * 13
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_substrings(spark, monkeypatch):
    monkeypatch.setattr(substrings, "LEAST_BITS", 1 << 17)
    data = [(r[0], r[1] or "") for r in rows() if r[0] is not None]
    found = dedup_substrings(frame(spark), with_text=True).collect()
    assert Counter(tuple(r)[:4] for r in found if r["id"] is not None) == plain_substrings(data)
    assert all(r["n_removed"] == 0 for r in found if r["id"] is None) and len(found) == len(rows())
    for r in found:
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
        assert sum(s["stop"] - s["start"] for s in r["removed"]) == r["n_removed"]
    assert dedup_substrings(empty(spark)).count() == 0


def test_substrings_with_a_full_sketch(spark):
    # A sketch far too small lets everything through and loses nothing.
    rnd = random.Random(8)
    vocabulary = [f"q{i}" for i in range(30)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    data = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 200))) + " " + passage * (i % 3 == 0))
            for i in range(120)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert Counter(map(tuple, dedup_substrings(docs, bits=1 << 17).collect())) == plain_substrings(data)
