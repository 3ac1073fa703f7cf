import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from terraframe.llm import _blocks as B
from terraframe.llm import decontaminate, jaccard_join, line_dedup, substring_dedup, suffix_dedup
from tests.llm.cases import documents, texts

SPACE = "[^\x20\x09-\x0d]+"
KEY = lambda i: 1 << 70 if i is None else i


def rows():
    return [(i * 7 % 101, t) for i, t in enumerate(texts())] + [(None, texts()[1]), (5, texts()[1]), (5, texts()[1]), (-3, texts()[8])]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_substring_dedup(spark):
    data, first = rows(), {}
    words = [re.findall(SPACE, t or "") for _, t in data]
    for (i, _), w in zip(data, words):
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, 1 << 80), KEY(i))
    want = []
    for (i, _), w in zip(data, words):
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < KEY(i) for j in range(13)}
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = collected(substring_dedup.substring_dedup(documents(spark, data)))
    assert got == sorted(want, key=repr)
    assert sum(x[2] for x in got) > 200


def test_difference_cover():
    p, cover = substring_dedup.PERIOD, substring_dedup.COVER
    assert all(any((a + s) % p in cover and (b + s) % p in cover for s in range(p)) for a in range(p) for b in range(p))


def removed_bytes(data, length):
    first = {}
    raw = [(t or "").encode() for _, t in data]
    for (i, _), b in zip(data, raw):
        for k in range(len(b) - length + 1):
            first[b[k : k + length]] = min(first.get(b[k : k + length], 1 << 80), KEY(i))
    out = []
    for (i, _), b in zip(data, raw):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < KEY(i):
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), spans, bytearray(kept)))
    return out


@pytest.mark.parametrize("hot", [1000, 3])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BATCH", 64)
    data = rows() + [(200, "\x00" * 60), (201, "\x00" * 70 + "a"), (202, "ab" * 80), (203, "ab" * 40)]
    got = [(*r[:4], bytearray(r[4])) for r in suffix_dedup.suffix_dedup(documents(spark, data)).collect()]
    assert sorted(got, key=repr) == sorted(removed_bytes(data, 50), key=repr)


def test_suffix_family():
    rng, seen = np.random.default_rng(1), set()
    data = np.concatenate([rng.integers(97, 99, 3000), np.tile(rng.integers(97, 123, 60), 20), np.full(300, 97)]).astype(np.uint8)
    family, at = suffix_dedup.SuffixFamily(data, 50), lambda p: data[p : p + 50].tobytes()
    for _ in range(40):
        pos = rng.integers(0, len(data) - 49, rng.integers(1, 90))
        sa, new = family.array(pos)
        assert [at(p) for p in pos[sa]] == sorted(at(p) for p in pos)
        distinct = pos[sa[new]]
        assert len(distinct) == len({at(p) for p in pos})
        level = distinct, suffix_dedup.words_at(data)[distinct].astype(np.uint64)
        found = family.scan(level)
        assert found.tolist() == [at(p) in seen for p in distinct]
        family.insert((level[0][~found], level[1][~found]))
        seen |= {at(p) for p in distinct}
        for p, _ in family.levels:
            assert [at(x) for x in p] == sorted({at(x) for x in p})
    sizes = [len(x[0]) for x in family.levels]
    assert sum(sizes) == len(seen) and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))


def thue_morse(n, a, b):
    """Two different strings of 2**n characters that collide under every polynomial modulo 2**64, from n = 10 on."""
    x, y = a, b
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("n", [3, 6, 9, 10, 11, 12])
def test_hashes_tell_thue_morse_strings_apart(n):
    x, y = thue_morse(n, "a", "b")
    block = B.Block.of([1, 2, 3], [x.encode(), y.encode(), x.encode()])
    h = block.words()[2]
    assert h[0] == h[2] != h[1]
    numbers = np.array([ord(c) for c in x + y + x], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    size = len(x)
    spans = B.span_hashes(numbers, np.arange(3) * size, np.arange(3) * size + size)
    assert spans[0] == spans[2] != spans[1]
    runs = B.run_hashes(numbers, size)
    assert runs[0] == runs[2 * size] != runs[size]


def test_dedup_of_thue_morse_strings(spark):
    x, y = thue_morse(10, "a", "b")
    data = [(i, x) for i in range(9)] + [(10 + i, y) for i in range(9)] + [(30, "plain")]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(documents(spark, data)).collect()}
    assert not any(got.values()) and len(got) == 19
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(documents(spark, data)).collect()}
    assert got == {**{i: 0 for i in range(9)}, **{10 + i: 10 for i in range(9)}, 30: 30}
    words = lambda t: " ".join(["same"] * 12 + [t])
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(documents(spark, [(1, words(x)), (2, words(y)), (3, words(x))])).collect()}
    assert got == {1: 0, 2: 0, 3: 13}
    items = spark.createDataFrame([("i", x)], "item_id string, text string")
    got = {r["doc_id"]: r["n_hit"] for r in decontaminate.scan(documents(spark, [(1, x), (2, y)]), items).collect()}
    assert got == {1: 1, 2: 0}


def strip(line):
    return line.encode().strip(b" \t\n\x0b\x0c\r").lower()


@pytest.mark.parametrize(("keep", "least"), [("none", 3), ("first", 3), ("none", 10), ("first", 2)])
def test_line_dedup(spark, keep, least):
    data = [(i * 7 % 101, t) for i, t in enumerate(texts())] + [(None, "x\nx"), (None, "x")]
    docs = defaultdict(set)
    for n, (_, t) in enumerate(data):
        for line in (t or "").split("\n"):
            docs[strip(line)].add(n)
    first = {k: min(v, key=lambda n: KEY(data[n][0])) for k, v in docs.items()}
    want = []
    for n, (i, t) in enumerate(data):
        stay, seen = [], set()
        for line in (t or "").split("\n"):
            k = strip(line)
            hot = k and len(docs[k]) >= least
            if not hot or keep == "first" and first[k] == n and k not in seen:
                stay.append(line)
            seen.add(k)
        want.append((i, len((t or "").split("\n")), len((t or "").split("\n")) - len(stay), "\n".join(stay)))
    got = collected(line_dedup.line_dedup(documents(spark, data), min_docs=least, keep=keep))
    if keep == "first":  # which row of a null id is first is open
        got, want = [x for x in got if x[0] is not None], [x for x in want if x[0] is not None]
    assert got == sorted(want, key=repr)


def test_drop_lines_keeps_columns(spark):
    docs = documents(spark, [(i, "same line") for i in range(5)] + [(9, None), (8, ""), (7, "own\nsame line")])
    out = line_dedup.drop_lines(docs, min_docs=3)
    assert out.schema.names == docs.schema.names
    assert sorted((r["doc_id"], r["text"], r["kept"]) for r in out.collect()) == [(0, "same line", "kept"), (7, "own", "kept"), (8, "", "kept"), (9, None, "kept")]


def test_columns_named_like_inner_ones_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", True, 3), (2, None, False, None)], "doc_id long, text string, __text_is_null boolean, block_id long")
    want = sorted((tuple(r) for r in docs.collect()), key=repr)
    assert collected(line_dedup.drop_lines(docs)) == want and collected(jaccard_join.near_dedup(docs)) == want


def test_bloom():
    keys = np.random.default_rng(2).integers(0, 1 << 63, 20000).astype(np.uint64)
    f = line_dedup.Bloom(10000)
    f.add(keys[:10000])
    assert f.has(keys[:10000]).all() and f.has(keys[10000:]).mean() < 0.03


def shingles(text, size):
    w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def components(data, size, percent):
    sets = [shingles(t, size) for _, t in data]
    root = {i: i for i, _ in data}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(data[a][0]), find(data[b][0])))
                root[y] = x
    return sorted((i, len(s), find(i)) for (i, _), s in zip(data, sets))


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (2, 50), (5, 80)])
def test_jaccard_components(spark, size, percent):
    data = [(i * 7 % 101, t) for i, t in enumerate(texts(seed=5, n=80))]
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    data += [(300 + k, " ".join(base[k:] + [f"w{k}"] * k + base[:k])) for k in range(12)] + [(400 + k, " ".join([*base, *base[::-1], *base[::2], f"v{k}"])) for k in range(8)]
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(documents(spark, data), size, percent).collect())
    assert got == components(data, size, percent)


def test_adaptive_prefix_shares_matches():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(5, 60))
        x = rng.choice(200, n, replace=False)
        y = np.union1d(np.delete(x, rng.choice(n, rng.integers(0, max(1, n // 8)), replace=False)), rng.choice(200, rng.integers(0, 4)))
        if len(np.intersect1d(x, y)) * 100 < 80 * len(np.union1d(x, y)):
            continue
        df = {t: int(t) % 7 + 1 for t in range(200)}
        order = lambda s: sorted(s.tolist(), key=lambda t: (df[t], t))
        cut = []
        for s in (x, y):
            l, p = jaccard_join.adaptive_prefix(np.array([df[t] for t in order(s)]), len(s), 80)
            cut.append((l, set(order(s)[:p])))
        assert len(cut[0][1] & cut[1][1]) >= min(cut[0][0], cut[1][0])


def test_near_dedup(spark):
    base = [f"w{i}" for i in range(60)]
    near = base[:-1] + ["other"]
    docs = documents(spark, [(3, " ".join(near)), (1, " ".join(base)), (2, " ".join(base)), (1, " ".join(base)), (9, "lone text here"), (8, None), (None, "lone other"), (None, "lone other")])
    out = jaccard_join.near_dedup(docs)
    assert out.schema.names == docs.schema.names
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted([(1, " ".join(base)), (9, "lone text here"), (8, None), (None, "lone other")], key=repr)


def test_empty_tables(spark):
    empty = documents(spark, [])
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    assert line_dedup.line_dedup(empty).count() == 0
    assert line_dedup.drop_lines(empty).count() == 0
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert jaccard_join.near_dedup(empty).count() == 0
    blank = documents(spark, [(1, None), (2, ""), (None, None)])
    assert substring_dedup.substring_dedup(blank).count() == 3
    assert suffix_dedup.suffix_dedup(blank).count() == 3
    assert collected(jaccard_join.jaccard_components(blank)) == [(1, 0, 1), (2, 0, 2), (None, 0, None)]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


@pytest.mark.parametrize("local", [10**6, 0])
def test_few_links_join_in_one_task(spark, monkeypatch, local):
    rng, made = random.Random(3), []
    frame, n = type(spark.range(0)), 200
    kept = frame.checkpoint
    B.ensure_checkpoint_dir(spark)
    monkeypatch.setattr(jaccard_join, "LOCAL", local, raising=False)
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a, **k: made.append(1) or kept(self, *a, **k))
    pairs = [(i, i - 1) for i in range(1, 60)] + [(rng.randrange(60, n), rng.randrange(60, n)) for _ in range(60)]
    labels = {i: i - i % 2 for i in range(n)}
    least, before = dict(labels), None
    while before != least:
        before = dict(least)
        for a, b in pairs + list(labels.items()):
            least[a] = least[b] = min(least[a], least[b])
    got = jaccard_join.components(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(list(labels.items()), "doc_id long, c long"))
    assert dict(map(tuple, got.collect())) == least and (not local or len(made) <= 4)
    nothing = jaccard_join.components(spark.createDataFrame([], "a long, b long"), spark.createDataFrame([(5, 4), (4, 4)], "doc_id long, c long"))
    assert sorted(map(tuple, nothing.collect())) == [(4, 4), (5, 4)]
