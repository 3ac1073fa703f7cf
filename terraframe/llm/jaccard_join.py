"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its connected components.

A document's set is that of its distinct word shingles. Two documents link if the Jaccard similarity of their sets is at
least ``percent``/100.

1. Documents of equal sets form a class; its smallest id stands for it (a digest of 128 bits, grouped).
2. Each shingle's document frequency is summed exactly, by hashed keys, once per block. It gives the order of all
   prefixes: rare shingles first, ties by hash. A shingle of one document can't match and is not sent.
3. Multi-match prefixes: of sets x and y that link, the first |x| - o + l shingles of x and |y| - o + l of y share l or
   more, where o is the overlap that x needs at least. Each document picks its own l from 1 to ``DEPTH``, the one of the
   least estimated cost: the posting entries that its prefix meets, and the candidates left to verify, at most those
   entries divided by l. A pair must share the smaller of both l's.
   A set's shingles that no other class has bound its overlap with all others; lists drop what can't link by that.
4. Candidates are verified in rounds. In a round, each posting list whose documents lie in two or more components links
   them to one hub, the document with the fewest shingles of its own that wasn't a hub before; of these stars the pairs
   that share the smaller of both l's are verified, and the components joined. A group of thousands of near copies so takes about one pair per copy, not all pairs. When
   a round closes few lists, all pairs of different components in the open lists are formed, each once, their shared
   shingles counted against l, and verified. So no link between components is missed; only pairs that are connected already aren't formed.
5. To verify, each document that others ask for hands out its set once; a join deals it to the blocks of its partners.

Components come from alternating large and small stars (Kiveris et al., 2014), checkpointed; nothing is collected. A round's
links of at most ``LOCAL``, counted, are joined in one task instead: stages of many tasks for few rows took most of the time.

Defined results: a document without words (or null) has an empty set, links with nothing and stands for itself. Fewer
words than a shingle has make one shingle. A null doc_id counts as the largest id. Rows of one doc_id (also of a null one)
are one node, which links if one of them does; each row is returned with its own set's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.llm import _blocks as B
from terraframe.llm._session import table

U64 = np.uint64
#: Most matches that a document asks for, and the cost of a verification in posting entries.
DEPTH, VERIFY = 8, 16
SIZE, PERCENT = 4, 85
#: Star rounds go on while each leaves at most this share of the open posting entries; then all pairs left are taken.
CLOSED = 0.7
#: Shingles of its own that an entry carries at most when all pairs are made.
CARRIED = 512
#: Most links that one task joins, and whose ends are broadcast.
LOCAL = 200_000
NODE_SCHEMA = "doc_id long, block_id long, row int, n_shingles long, d1 long, d2 long"


def shingle_sets(block: B.Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document and the documents' indexes, sorted by document, then hash."""
    _, _, h, doc = block.words(lower=True)
    at, key = B.windows(h, doc, size)
    n = np.bincount(doc, minlength=len(block.ids))
    short = np.flatnonzero((n > 0) & (n < size))
    first = np.searchsorted(doc, short)
    key = np.concatenate([key, B.span_hashes(h, first, first + n[short])])
    d = np.concatenate([doc[at], short])
    o = np.lexsort((key, d))
    key, d = key[o], d[o]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (d[1:] != d[:-1])
    return key[new], d[new]


def need(n: np.ndarray | int, percent: int):
    """The least overlap of a set of n with any set that it links with: at least percent of its own size."""
    return -(-n * percent // 100)


def enough(overlap, a, b, percent: int):
    return 100 * overlap >= percent * (a + b - overlap)


def digests(blocks: DataFrame, size: int) -> DataFrame:
    def run(block):
        key, d = shingle_sets(block, size)
        n = np.bincount(d, minlength=len(block.ids))
        sums = []
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            c = np.concatenate([np.zeros(1, U64), np.cumsum(B.mix(key ^ U64(salt)), dtype=U64)])
            end = np.cumsum(n)
            sums.append((c[end] - c[end - n]).view(np.int64))
        m = len(block.ids)
        yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array(np.full(m, block.block_id)), pa.array(np.arange(m, dtype=np.int32)), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1])], names=["doc_id", "block_id", "row", "n_shingles", "d1", "d2"])

    return B.map_blocks(blocks, run, NODE_SCHEMA)


def adaptive_prefix(df: np.ndarray, n: int, percent: int, depth: int = DEPTH) -> tuple[int, int]:
    """(l, prefix length) of a set of n shingles whose frequencies, rare first, are df (0: in no other class)."""
    base = n - need(n, percent)
    most = min(depth, n - base)
    meets = np.cumsum(df[: base + most])[base:]
    cost = meets + VERIFY * meets / np.arange(1, most + 1)
    best = int(np.argmin(cost)) + 1
    return best, base + best


POST_SCHEMA = "bucket long, blob binary"


def postings(blocks: DataFrame, answers: DataFrame, frequent: B.Buckets, exact: B.Buckets, size: int, percent: int) -> DataFrame:
    """(bucket, blob of token, document, set size, l, block, shared size) of all prefix shingles of class representatives.
    The answers hold the frequencies (0), the rows that aren't representatives (1), and the sizes of classes (2). The
    shared size counts the shingles that documents outside the class have."""
    schema = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])

    def run(block, got):
        key, d = shingle_sets(block, size)
        found, total = B.merged([a[1:] for a in got if a[0] == 0])[:2]
        skip = {int(x) for a in got if a[0] == 1 for x in np.frombuffer(a[1:], np.int32)}
        copies = np.ones(len(block.ids), np.int64)
        for a in got:
            if a[0] == 2:
                row, n = np.frombuffer(a[1:], np.int32).reshape(-1, 2).T
                copies[row] = n
        hit, at = B.among(frequent.cut(key), found)
        df = np.ones(len(key), np.int64)
        df[hit] = total[at[hit]].astype(np.int64)
        o = np.lexsort((key, df, d))
        key, df = key[o], df[o]
        shared = df > copies[d]
        bounds = np.searchsorted(d, np.arange(len(block.ids) + 1)).tolist()
        take, rows, least = [], [], []
        for i in range(len(block.ids)):
            a, n = bounds[i], bounds[i + 1] - bounds[i]
            if n == 0 or i in skip or not shared[a : a + n - need(n, percent) + 1].any():
                continue  # nobody shares a shingle of the prefix that one match needs
            best, length = adaptive_prefix(np.where(shared[a : a + n], df[a : a + n], 0), n, percent)
            use = a + np.flatnonzero(shared[a : a + length])
            take.append(use)
            rows.append(np.full(len(use), i))
            least.append(np.full(len(use), best))
        if not take:
            return pa.Table.from_batches([], schema=schema)
        take, rows, least = (np.concatenate(x) for x in (take, rows, least))
        sizes, common = np.bincount(d, minlength=len(block.ids)), np.bincount(d[shared], minlength=len(block.ids))
        o = np.argsort(key[take], kind="stable")
        key, rows, least = key[take][o], rows[o], least[o]
        arrays = key, block.ids[rows].view(U64) ^ U64(1 << 63), sizes[rows], least, np.full(len(o), block.block_id), common[rows]
        return pa.Table.from_batches([B.batch(schema, [(i, B.pack_arrays(*(x[a:b] for x in arrays))) for i, a, b in exact.split(key)])])

    return B.answer_blocks(blocks, answers, run, POST_SCHEMA)


LIST_SCHEMA = "token long, doc_id long, n int, l int, block_id long, s int"


def lists(posted: DataFrame, percent: int) -> DataFrame:
    """One row for each entry of a posting list of two or more documents that may link by their sizes."""

    def run(t: pa.Table) -> pa.Table:
        key, ids, n, least, block, common = (np.concatenate(x) for x in zip(*(B.unpack_arrays(r["blob"]) for r in B.rows_of(t))))
        o = np.lexsort((ids, n, key))
        key, ids, least, block = key[o], (ids[o] ^ U64(1 << 63)).view(np.int64), least[o], block[o]
        n, common = n[o].astype(np.int64), common[o].astype(np.int64)
        for _ in range(2):  # what goes may leave others alone
            # the list is cut where the next larger set is too large
            cut = np.ones(len(key), bool)
            cut[1:] = (key[1:] != key[:-1]) | (100 * n[:-1] < percent * n[1:])
            group = np.cumsum(cut) - 1
            first = np.flatnonzero(cut)
            last = np.append(first[1:], len(key)) - 1
            # of a set's partners the best is the largest that isn't above what it shares, or the smallest that is
            place = group * (1 << 32)
            at = np.searchsorted(place + n, place + common, side="right")
            below, above = n[np.maximum(at - 1, 0)], n[np.minimum(at, len(n) - 1)]
            ok = (at > first[group]) & (100 * below >= percent * n) | (at <= last[group]) & (100 * common >= percent * (n + above - common))
            ok &= (last > first)[group]
            key, ids, least, block, n, common, group = (x[ok] for x in (key, ids, least, block, n, common, group))
        token = B.mix(key + group.astype(U64)).view(np.int64)
        return pa.table({"token": token, "doc_id": ids, "n": pa.array(n, pa.int32()), "l": pa.array(least.astype(np.int32)), "block_id": block.astype(np.int64), "s": pa.array(common, pa.int32())})

    return posted.groupBy("bucket").applyInArrow(run, LIST_SCHEMA)


def verify(blocks: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of pairs (a, block_a, b, block_b) whose sets link. A block hands out each set once, however many blocks ask for
    it; the join by (a, block_a) copies it row by row, so no task holds a hub's copies."""
    asked = pairs.select("a", "block_a", "block_b").distinct()
    ask = asked.select(F.col("block_a").alias("block_id"), "a").distinct()
    set_schema = "block_a long, a long, hashes binary"

    def sets_of(block: B.Block, wanted: set[int]) -> dict[int, list[np.ndarray]]:
        rows = np.flatnonzero(np.isin(block.ids, np.fromiter(wanted, np.int64, len(wanted))))
        part = B.Block.of(block.ids[rows], [block.text(i) for i in rows])
        key, d = shingle_sets(part, size)
        bounds = np.searchsorted(d, np.arange(len(rows) + 1))
        sets: dict[int, list[np.ndarray]] = {}
        for i in range(len(rows)):
            sets.setdefault(int(part.ids[i]), []).append(key[bounds[i] : bounds[i + 1]])
        return sets

    def out(left: pa.Table, right: pa.Table) -> pa.Table:
        asks = right.column("a").to_pylist()
        rows = []
        for block in B.blocks_in(left) if asks else ():
            rows += [(block.block_id, a, one.tobytes()) for a, own in sets_of(block, set(asks)).items() for one in own]
        return pa.Table.from_batches([B.batch(pa.schema([("block_a", pa.int64()), ("a", pa.int64()), ("hashes", pa.binary())]), rows)])

    sets = blocks.groupBy("block_id").cogroup(ask.groupBy("block_id")).applyInArrow(out, set_schema)
    dealt = asked.join(sets, ["a", "block_a"]).withColumnRenamed("block_b", "block_id")
    told = dealt.select("block_id", F.struct("a", "hashes").alias("set"), F.lit(None).cast("struct<a:long,b:long>").alias("pair"))
    told = told.unionByName(pairs.select(F.col("block_b").alias("block_id"), F.lit(None).cast("struct<a:long,hashes:binary>").alias("set"), F.struct("a", "b").alias("pair")))

    def test(left: pa.Table, right: pa.Table) -> pa.Table:
        sets, wanted = {}, []
        for r in B.rows_of(right):
            if r["set"]:
                sets.setdefault(r["set"]["a"], []).append(np.frombuffer(r["set"]["hashes"], U64))
            else:
                wanted.append((r["pair"]["a"], r["pair"]["b"]))
        a, b = [], []
        for block in B.blocks_in(left) if wanted else ():
            own = sets_of(block, {y for _, y in wanted})
            for x, y in wanted:
                if any(enough(int(B.among(v, u)[0].sum()), len(u), len(v), percent) for u in sets[x] for v in own[y]):
                    a.append(x)
                    b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return blocks.groupBy("block_id").cogroup(told.groupBy("block_id")).applyInArrow(test, "a long, b long")


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of links a, b, sorted, and the least one that each reaches."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while ((x := root[u]) != (y := root[v])).any():
        # roots hang on smaller ones, so there is no circle
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    return ids, ids[root]


def _joined(batches):
    """(c, to): of all links, what isn't the least of its component, and that."""
    held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    if held:
        ids, to = least_reached(*(np.concatenate(c) for c in zip(*held)))
        yield pa.RecordBatch.from_pydict({"c": pa.array(ids[ids != to]), "to": pa.array(to[ids != to])})


def components(links: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (doc_id, c), with c the least label reachable over the links (a, b)."""
    links = links.checkpoint()
    if links.count() <= LOCAL:
        ends = links.select(F.explode(F.array("a", "b")).alias("doc_id"))
        known = labels.join(F.broadcast(ends), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("c").alias("b")).checkpoint()
        to = links.select("a", "b").unionByName(known).coalesce(1).mapInArrow(_joined, "c long, to long").checkpoint()
        return labels.join(F.broadcast(to), "c", "left").select("doc_id", F.coalesce("to", "c").alias("c")).checkpoint()
    edges = links.join(labels.select(F.col("doc_id").alias("a"), F.col("c").alias("x")), "a").join(labels.select(F.col("doc_id").alias("b"), F.col("c").alias("y")), "b")
    edges = edges.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).where("lo <> hi").distinct().checkpoint()
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
    before, now = None, state(edges)
    while now != before:
        near = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        large = near.join(near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("lo")), "u").where("v > u").select("lo", F.col("v").alias("hi")).distinct()
        small = large.join(large.groupBy("hi").agg(F.min("lo").alias("m")), "hi").select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi")).where("lo <> hi")
        edges = small.distinct().checkpoint()
        before, now = now, state(edges)
    return labels.join(edges.select(F.col("hi").alias("c"), F.col("lo").alias("to")), "c", "left").select("doc_id", F.coalesce("to", "c").alias("c")).checkpoint()


def near(a: str, b: str, percent: int) -> str:
    """SQL: whether sets of n shingles, s of them shared, may link: their overlap is at most the smaller s."""
    most = f"least({a}.s, {b}.s)"
    return f"100 * {most} >= {percent} * ({a}.n + {b}.n - {most})"


def star_pairs(entries: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, block_a, b, block_b) of each list's hub with its documents of other components, and whether they have
    enough matches: as many shared tokens as one of both asks for. entries: token, doc_id, n, l, s, block_id, c. The hub is
    the document with the fewest shingles of its own, of those not tried as hubs. As both are in different components, all
    tokens that they share are in entries."""
    e = entries.join(tried.withColumn("again", F.lit(1)), "doc_id", "left").withColumn("e", F.struct("doc_id", "block_id", "n", "s", "c"))
    hubs = e.groupBy("token").agg(F.min_by("e", F.struct(F.coalesce("again", F.lit(0)).alias("again"), (F.col("n") - F.col("s")).alias("own"), F.col("doc_id").alias("i"))).alias("h"))
    pairs = e.join(hubs, "token").where(f"h.c <> e.c and {near('h', 'e', percent)}")
    pairs = pairs.select(F.col("h.doc_id").alias("a"), F.col("h.block_id").alias("block_a"), F.col("e.doc_id").alias("b"), F.col("e.block_id").alias("block_b")).distinct()
    own = entries.groupBy("doc_id").agg(F.collect_set("token").alias("t"), F.min("l").alias("l"))
    side = lambda x: own.select(F.col("doc_id").alias(x), F.col("t").alias(f"t_{x}"), F.col("l").alias(f"l_{x}"))
    shared = F.size(F.array_intersect("t_a", "t_b"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "block_a", "b", "block_b", (shared >= F.least("l_a", "l_b")).alias("enough"))


def open_lists(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries with their component, of lists that span two or more components."""
    e = entries.join(labels, "doc_id")
    several = e.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token")
    return e.join(several, "token")


def rest_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """All pairs of documents of different components that share the matches that both ask for. entries as above, with l.
    A pair is made in the list of its least common shingle only, which each entry can tell as it carries the others of its
    document; documents with more than CARRIED of them carry none, and their pairs are made distinct afterwards."""
    own = entries.groupBy("doc_id").agg(F.collect_list("token").alias("t")).select("doc_id", F.when(F.size("t") <= CARRIED, F.col("t")).alias("t"))
    e = entries.join(own, "doc_id")
    x = e.select("token", F.struct("doc_id", "block_id", "n", "s", "l", "c", "t").alias("x"))
    y = e.select("token", F.struct("doc_id", "block_id", "n", "s", "l", "c", "t").alias("y"))
    both = "array_intersect(x.t, y.t)"
    once = f"(x.t is null or y.t is null or array_min({both}) = token and size({both}) >= least(x.l, y.l))"
    pairs = x.join(y, "token").where(f"x.doc_id < y.doc_id and x.c <> y.c and {near('x', 'y', percent)} and {once}")
    return pairs.select(F.col("x.doc_id").alias("a"), F.col("x.block_id").alias("block_a"), F.col("y.doc_id").alias("b"), F.col("y.block_id").alias("block_b")).distinct()


def jaccard_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach, for each row of docs."""
    _, nodes = _clusters(docs, size, percent, id_col, text_col, False)
    null = lambda c: F.when(F.col(c) != B.NULL_ID, F.col(c))
    return nodes.select(null("doc_id").alias("doc_id"), "n_shingles", null("c").alias("component_id"))


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the smallest id (rows of that id with other texts stay)."""
    mark = B.free_name(docs, "__text_is_null")
    docs = docs.withColumn(mark, F.col(text_col).isNull())
    blocks, nodes = _clusters(docs, size, percent, id_col, text_col, True)
    stay = nodes.where("doc_id = c").groupBy("doc_id", "n_shingles", "d1", "d2").agg(F.min(F.struct("block_id", "row")).alias("r")).select("r.block_id", "r.row")

    def pick(block, answers):
        rows = np.sort(np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(a[1:], np.int32) for a in answers)]))
        null = block.rest.column(mark).to_pylist()
        return block.carried(rows, text_col, [None if null[i] else block.text(i) for i in rows.tolist()]).drop_columns([mark])

    return B.answer_blocks(blocks, _row_answers(stay), pick, docs.drop(mark).schema)


def _clusters(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str, carry: bool) -> tuple[DataFrame, DataFrame]:
    """The blocks of docs, and NODE_SCHEMA with c, the component's smallest id."""
    spark = docs.sparkSession
    blocks = B.text_blocks(docs, id_col, text_col, carry)
    n_tokens = B.raw_bytes(blocks) // 5
    frequent, exact = B.Buckets(spark, n_tokens, False), B.Buckets(spark, n_tokens // 5, True)

    nodes = digests(blocks, size).checkpoint()
    classes = nodes.where("n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(F.min(F.struct("doc_id", "block_id", "row")).alias("r"), F.count("*").alias("copies"))

    def send_tokens(block):
        key, _ = shingle_sets(block, size)
        keys, count = np.unique(frequent.cut(key), return_counts=True)
        yield B.send(block.block_id, frequent, keys, count)

    counted = B.count_answers(B.map_blocks(blocks, send_tokens, B.KEY_SCHEMA))
    member = nodes.join(classes.where("copies > 1"), ["n_shingles", "d1", "d2"]).select("doc_id", "block_id", "row", F.col("r.doc_id").alias("rep"), F.col("copies").cast("int").alias("copies"), ((F.col("r.block_id") != F.col("block_id")) | (F.col("r.row") != F.col("row"))).alias("copy")).checkpoint()
    told = counted.withColumn("blob", F.concat(F.lit(b"\x00"), "blob")).unionByName(_row_answers(member.where("copy"))).unionByName(_row_answers(member.where("not copy"), "copies"))
    entries = lists(postings(blocks, told, frequent, exact, size, percent), percent).checkpoint()

    # documents of a class share a label; so do rows of one doc_id
    labels = nodes.select("doc_id").distinct().withColumn("c", F.col("doc_id"))
    labels = components(member.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct(), labels)
    tried, before = spark.createDataFrame([], "doc_id long"), None
    while True:
        open_ = open_lists(entries, labels).checkpoint()
        left = open_.count()
        if not left:
            break
        last = before is not None and left > CLOSED * before
        pairs = (rest_pairs(open_, percent).withColumn("enough", F.lit(True)) if last else star_pairs(open_, tried, percent)).checkpoint()
        labels = components(verify(blocks, pairs.where("enough"), size, percent), labels)
        if last:
            break
        tried, before = tried.unionByName(pairs.select(F.col("a").alias("doc_id"))).distinct(), left
    return blocks, nodes.join(labels, "doc_id")


def _row_answers(rows: DataFrame, value: str | None = None) -> DataFrame:
    """(block_id, blob): a byte 1 and the block's row numbers as 32-bit numbers; or 2 and pairs of these and a value."""

    def run(t: pa.Table) -> pa.Table:
        columns = [t.column(c).to_numpy().astype(np.int32) for c in ("row", value) if c]
        at = np.stack([c[np.argsort(columns[0])] for c in columns], axis=1)
        return pa.table({"block_id": pa.array([t.column("block_id")[0].as_py()], pa.int64()), "blob": pa.array([bytes([len(columns)]) + at.tobytes()], pa.binary())})

    return rows.groupBy("block_id").applyInArrow(run, B.ANSWER_SCHEMA)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM t WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM t UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT t.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM t LEFT JOIN z USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
