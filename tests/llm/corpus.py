"""Small corpora with the cases that every operator must stand."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def texts(seed: int = 1, n: int = 30) -> list[str]:
    """Prose, copies, near copies, a shared passage, repetition, blanks and a long text."""
    rng, out = random.Random(seed), []
    passage = " ".join(words(rng, 60)) + "."
    for _ in range(n):
        lines = [" ".join(words(rng, rng.randint(1, 30))) + "." for _ in range(rng.randint(1, 8))]
        out.append("\n".join(lines))
    out += [out[0], out[0], out[1]]
    for k in range(6):
        each = out[2].split(" ")
        each[rng.randrange(len(each))] = f"edit{k}"
        out.append(" ".join(each))
    out += [f"{' '.join(words(rng, 5))} {passage} {' '.join(words(rng, 5))}" for _ in range(5)]
    out += ["", " ", "\n\n", "one", "one two three", "one two three", "A b C d E f", "a B c D e F", "be " * 300, "ß日本語 текст 😀 " * 20, "x" * 500, " ".join(words(rng, 6000))]
    return out


def rows(seed: int = 1, n: int = 30) -> list[tuple]:
    found = [(10 * i + 3, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts(seed, n))]
    return found + [(9991, None, None, None, None), (None, "text without id", "en", None, 15), (None, None, None, "s", 0)]


def frame(spark, found=None):
    return spark.createDataFrame(rows() if found is None else found, SCHEMA)


def some(seed=4) -> dict:
    """Documents of known fate for the pipeline: toxic ones, one-line near copies, leaks, and clean ones."""
    rng = random.Random(seed)
    common = words(rng, 300)
    prose = lambda n: [rng.choice(common) for _ in range(n)]
    documents, labels, toxic = [], [], set()
    for i in range(500):
        each = prose(rng.randint(20, 90)) + [f"own{i}a", f"own{i}b"]
        if rng.random() < 0.2:
            toxic.add(i)
            for _ in range(3):
                each.insert(rng.randrange(len(each)), rng.choice(["vilestuff", "awfulness", "nastiness"]))
        documents.append((i, " ".join(each)))
        labels.append((i, 1, int(i in toxic)))
    copies, at = [], 1000
    for n in (2, 3, 8):
        base, group = words(rng, 120), set()
        for k in range(n):
            each = list(base)
            each[(7 * k) % 120] = f"edit{k}"
            documents.append((at, " ".join(each)))
            group.add(at)
            at += 1
        copies.append(group)
    benchmark = [(i, " ".join(words(rng, 30))) for i in range(6)]
    leaks = set()
    for i, text in benchmark:
        documents.append((2000 + i, " ".join([*prose(25), *text.split(), *prose(25)])))
        leaks.add(2000 + i)
    clean = {i for i in range(500) if i not in toxic}
    found = [(i, t, "en", "s", len(t)) for i, t in documents] + [(3000, None, None, None, None), (3001, "", "en", "s", 0)]
    return {"documents": found, "labels": labels, "benchmark": benchmark, "toxic": toxic, "copies": copies, "leaks": leaks, "clean": clean}
