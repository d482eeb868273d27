"""The manifest, the divergence audit and the quality rules against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import comb

import pytest
from cases import empty, frame, rows
from pyspark.sql import functions as F

from postloom.llm import divergence, merkle, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    i, text, lang, source, n = row[:5]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def parents(nodes):
    return [sha("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]


def climb(nodes, at):
    """Siblings (left, right) of a node level by level, and the root."""
    path = []
    while len(nodes) > 1:
        low = at - at % 3
        path.append(("".join(nodes[low:at]), "".join(nodes[at + 1:low + 3])))
        nodes, at = parents(nodes), at // 3
    return path, nodes[0]


def plain_manifest(data, shown):
    groups = defaultdict(list)
    for row in data:
        groups[row[3]].append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    subroots = [climb([leaf(r) for r in groups[n]], 0)[1] for n in names]
    out = []
    for k, name in enumerate(names):
        top, root = climb(subroots, k)
        nodes = [leaf(r) for r in groups[name]]
        for at, row in enumerate(groups[name]):
            path = climb(nodes, at)[0] + top
            node = leaf((row[0], shown(row), *row[2:]))
            for left, right in path:
                node = sha(left + node + right)
            out.append((row[0], nodes[at], subroots[k], root, sha("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


def stripped(row):
    return row[1].replace("\n", "") if row[1] is not None and (row[0] or 1) % 2 == 0 else row[1]


def manifest(docs):
    shown = F.when(F.coalesce(F.nullif("doc_id", F.lit(0)), F.lit(1)) % 2 == 0, F.translate("text", "\n", "")
                   ).otherwise(F.col("text"))
    found = merkle.verified_manifest(docs, {"text": shown})
    return sorted(map(tuple, found.collect()), key=repr)


def test_manifest_awkward(spark):
    assert manifest(frame(spark)) == plain_manifest(rows(), stripped)
    assert merkle.verified_manifest(empty(spark)).count() == 0
    one = rows()[7:8]
    assert manifest(frame(spark, one)) == plain_manifest(one, stripped)


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_of_many_tiers(spark, monkeypatch, levels):
    """Blocks of three and nine nodes: trees of several tiers, groups of every size, and many groups."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3 ** levels)
    data, n = [], 0
    for k, size in enumerate([1, 2, 3, 4, 9, 10, 27, 28, 60, *[1] * 12]):
        for _ in range(size):
            data.append((n, f"a{n}\nb", "en", None if k == 2 else f"s{k}", n, "", "", "", "", None, ""))
            n += 1
    random.Random(1).shuffle(data)
    got = manifest(frame(spark, data).repartition(7))
    assert got == plain_manifest(data, stripped)
    assert 0 < sum(r[-1] for r in got) < len(got)


def plain_divergence(data, least, ranks):
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[1] or "") for r in data]
    terms = [[t.translate({c: c + 32 for c in range(65, 91)}) for t in ts] for ts in terms]
    of, docs = defaultdict(Counter), defaultdict(Counter)
    for r, ts in zip(data, terms, strict=True):
        lang, source = r[2] or "", r[3] or ""
        of[lang, source].update(ts)
        docs[lang].update(set(ts))
    out = []
    for (lang, source), counts in of.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + int(Fraction(10 ** 9 * (counts[t] + 2), total + 2 * len(kept))) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        p = shares(counts)
        q = shares(sum((c for (x, _), c in of.items() if x == lang), Counter()))
        pairs = [(-sum(f(p[t], s[t]) for t in kept), other) for (x, other), c in of.items()
                 if x == lang and other != source for s in [shares(c)]]
        best = sorted((-f(p[t], q[t]), t.encode(), t) for t in kept if counts[t] and p[t] > q[t])[:ranks]
        out += [(lang, source, "pair", o, -v, k + 1) for k, (v, o) in enumerate(sorted(pairs))]
        out += [(lang, source, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(best)]
    return sorted(out)


def test_divergence(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE_BYTES", 4000)
    rnd = random.Random(4)
    data = [(*r[:2], rnd.choice(["en", "de", None, "xx"]) if k < 60 else "yy", *r[3:]) for k, r in enumerate(rows() * 3)]
    data += [(0, "Ab1cd ab É é éa x_y", "zz", s, *rows()[0][4:]) for s in ("", None, "B", "a", "B")]
    data += [(1, None, "lone", "s", *rows()[0][4:])]
    for least, ranks in ((1, 3), (3, 10)):
        got = divergence.source_divergence(frame(spark, data), least_docs=least, ranks=ranks).collect()
        assert sorted(map(tuple, got)) == plain_divergence(data, least, ranks)
    assert divergence.source_divergence(empty(spark)).count() == 0


def test_share_of_huge_counts(spark):
    """Products beyond a long, and values that doubles would round."""
    big = 10 ** 15 + 7
    row = spark.range(1).select(divergence.share(F.lit(big), F.lit(3 * big), F.lit(5)).alias("p")).first()
    assert row["p"] == 1 + 10 ** 9 * (big + 2) // (3 * big + 10)


def plain_figures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    covered = {i + o for i, w in enumerate(windows) if counts[w] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)),
            len(covered), sum("A" <= c <= "Z" for c in text), sum(c.isascii() and c.isalpha() for c in text))


def test_figures(spark, monkeypatch):
    monkeypatch.setattr(quality, "SLICE_BYTES", 3000)
    data = rows() + [(900, "a b c a b c a b", "en", "s", None, *[""] * 4, None, ""),
                     (901, "z z z z\nz z \nz z \n \n\n#<b>| é%", "en", "s", None, *[""] * 4, None, "")]
    found = quality.text_figures(frame(spark, data), "doc_id", "text", "lang").collect()
    got = Counter((r["id"], *(r[f] for f in quality.FIGURES)) for r in found)
    assert got == Counter((r[0], *plain_figures(r[1])) for r in data)


def test_allowed_is_exact():
    for n, share, error in ((0, .1, .05), (10, .05, .05), (59, .05, .05), (200, .03, .01), (1000, .02, .05)):
        best = quality.allowed(n, share, error)
        a, e = Fraction(share), Fraction(error)
        tail = [sum(comb(n, i) * a ** i * (1 - a) ** (n - i) for i in range(k + 1)) for k in range(min(n, 40) + 1)]
        assert best == max([k for k, t in enumerate(tail) if t <= e], default=-1)


def make_docs(seed, n, noisy):
    """Good documents; bad ones with symbols; of the good ones in `noisy` languages a fifth has symbols too."""
    rnd = random.Random(seed)
    data, labels = [], []
    for i in range(n):
        lang, bad = rnd.choice(["aa", "bb", "cc"]), rnd.random() < .2
        words = [f"w{rnd.randrange(10 ** 6)}" for _ in range(rnd.randint(60, 80))]
        if bad or lang in noisy and rnd.random() < .2:
            words = [w + "%%%" for w in words]
        data.append((i, " ".join(words), lang, "s", None, *[""] * 4, None, ""))
        labels.append((i, 0 if bad else 1))
    return data, labels


def test_cutoffs_hold_their_promise(spark):
    data, labels = make_docs(6, 1500, {"bb"})
    few = [(5000 + i, " ".join(f"v{i}x{k}" for k in range(70)), "dd", "s", None, *[""] * 4, None, "") for i in range(6)]
    marks = spark.createDataFrame(labels + [(5000 + i, i % 2) for i in range(6)] + [(None, 1), (3, None), (9, 0), (9, 1)],
                                  "doc_id long, quality int")
    found = quality.quality_verdicts(frame(spark, data + few), marks).toPandas()
    bad = {i for i, q in labels if q == 0}
    lang = {r[0]: r[2] for r in data}
    kept = dict(zip(found.id, found.kept, strict=True))
    for name in ("aa", "cc"):
        assert all(kept[i] == (i not in bad) for i in lang if lang[i] == name)
    # A rule that would reject a fifth of the good documents of a language is not certified there.
    assert all(kept[i] for i in lang if lang[i] == "bb")
    assert all(kept[r[0]] for r in few)
    figures = quality.text_figures(frame(spark, data), "doc_id", "text", "lang")
    table = {r["stratum"]: r for r in quality.certified_cutoffs(figures, marks).collect()}
    assert table["aa"]["n_rejected"] == 0 and table["aa"]["cutoffs"][0] is not None
    assert (table["bb"]["cutoffs"][0] or 1000) >= 300


def test_quality_awkward(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    found = quality.quality_verdicts(frame(spark), labels).collect()
    assert len(found) == len(rows())
    for r in found:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed)
    assert quality.quality_verdicts(empty(spark), labels).count() == 0
    assert quality.quality_verdicts(frame(spark), labels.limit(0)).count() == len(rows())
