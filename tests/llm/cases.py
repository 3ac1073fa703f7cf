"""Documents with the awkward cases, and brute force over plain Python."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block_id long, kept string, score double"


def texts(seed: int = 3, n: int = 60) -> list:
    """Random prose with shared passages, copies, near copies, repeated lines, empty and very long texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñß") for _ in range(rng.randint(1, 6))) for _ in range(90)]
    words = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passages, lines = [words(30) for _ in range(4)], [words(6) for _ in range(3)]
    out = []
    for i in range(n):
        kind = i % 6
        t = words(rng.randint(1, 80))
        if kind == 1:
            t = t + " " + rng.choice(passages) + "\n" + rng.choice(lines)
        elif kind == 2 and out:
            t = out[rng.randrange(len(out))] or "x"
        elif kind == 3 and out:
            w = (rng.choice(out) or "y z").split(" ")
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
            t = " ".join(w)
        elif kind == 4:
            t = "\n".join([rng.choice(lines), t, " \t" + rng.choice(lines).upper() + " ", ""])
        out.append(t)
    out += [None, "", " \n\t ", "one", "one", "ONE", words(4000), "\n".join(words(3) for _ in range(300)), passages[0], passages[0]]
    return out


def documents(spark, rows=None, seed: int = 3):
    """A frame whose other columns are null or clash with names that operators use. rows: (doc_id, text)."""
    if rows is None:
        rows = [(i * 7 % 101, t) for i, t in enumerate(texts(seed))]
    data = [(i, t, None if k % 3 else "en", None, len(t) if t and k % 2 else None, k, "kept", None) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)
