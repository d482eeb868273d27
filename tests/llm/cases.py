"""Small inputs with every awkward case, and plain versions of the operators to compare with."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, key string, `a.b` string, "
          "size string, features string, places string")

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


def rows(seed=3):
    """Null, empty and blank texts, copies, near copies, shared passages, repeated rows, null ids, a long text."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéß日") for _ in range(rnd.randint(1, 9))) for _ in range(400)]

    def text(n):
        return " ".join(rnd.choice(vocabulary) + rnd.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))

    passage, base = text(40), text(120)
    words = base.split(" ")
    out = [None, "", " ", "\n\n", "One", "one", "a b", "it's 'tis  two  spaces \n here ", "<|endoftext|> x", base, base,
           base + " tail", " ".join(words[:60] + ["changed"] + words[61:]), passage, "Intro. " + passage + " End.",
           text(20) + "\n" + passage + "\n" + text(20), passage.upper(), LONG, "same " * 500, "same " * 700, "\t\x0b x\x1cy",
           "x" * 3000, "same line of words here now\n" * 3 + "other", "same line of words here now", None]
    out += [text(rnd.randint(1, 90)) for _ in range(12)]
    made = [(i * 3 - 5, t) for i, t in enumerate(out)]
    made += [(500, "twice the row"), (500, "twice the row"), (None, base), (None, None), (None, "only without id")]
    sources = ["s1", "é", "Z", None, "s1", "s1"]
    return [(i, t, "en", sources[n % 6], None, "clash", "clash", "dot", "clash", None, "clash")
            for n, (i, t) in enumerate(made)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
