"""Quality rules: base counts, and the log-likelihood ratio of hashed n-grams. DataFrame and SQL functions only.

Unigrams and bigrams of words are hashed into ``BUCKETS`` buckets. Two multinomials are counted over all documents: the
raw corpus, and the trusted target, the documents with ``quality`` 1 in the labels. Each bucket gets ``PSEUDO`` more
n-grams in the raw corpus, and the target's share of them in the target, so that what is rare weighs little. A document's
score is the mean over its n-grams of log(p_target / p_raw); it is kept if it passes the base rules and its score is at
least the cut of its language. Every document gets a score; equal inputs give equal verdicts.

An unlabelled document's n-grams count in raw only, which lowers its score the more, the fewer trusted documents its
language has. The cut allows for that: each trusted document is scored as if it weren't in the target, and the cut of a
language is ``THRESHOLD``, or, where that is lower, the mean of these scores less 3 + 6 / n of their deviations, with n such
documents. Without any, nothing is known of a language, and the base rules decide.

The counts are pre-aggregated to at most BUCKETS rows in each task. The weights, BUCKETS doubles whatever the input, come
in by a scalar subquery, so the texts are never shuffled or joined for scoring. Labels are broadcast for the target's
count where they have at most ``BROADCAST_ROWS`` rows, else joined by a shuffle of doc_id and n-gram buckets.

Defined results: null languages are one language; a null text has no words; documents without words score 0 and fail the
base rules; rows that repeat count each. Other columns stay, whatever their names. Empty tables give empty results. Null labels, and
labels of unknown documents, are ignored; without any trusted document all weights are 0, and the base rules decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.llm._session import table
from terraframe.model import checkpointed

BUCKETS = 1 << 16
PSEUDO = 10
THRESHOLD = -0.1
BROADCAST_ROWS = 1_000_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
#: Repeated windows of a text that are looked up one by one.
FEW = 64
OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def shifted(a: Column, by: int, n: Column) -> Column:
    """The n elements of a from the one at ``by`` on, by at least 0; none where n is negative."""
    return F.slice(a, F.lit(by + 1), F.greatest(n, F.lit(0)))


def bucket(*c: Column) -> Column:
    return bucket_of(F.xxhash64(*c))


def bucket_of(h: Column) -> Column:
    """The hash's remainder, as BUCKETS is a power of two."""
    return h.bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")


def window_hashes(hashes: Column, n: Column) -> Column:
    """Hashes of the windows of three words, from the n words' hashes."""
    two = F.zip_with(shifted(hashes, 0, n - 2), shifted(hashes, 1, n - 2), lambda a, b: F.xxhash64(a, b))
    return F.zip_with(two, shifted(hashes, 2, n - 2), lambda a, b: F.xxhash64(a, b))


def pairs_of(a: Column, f) -> Column:
    """f of each two neighbours."""
    return F.zip_with(shifted(a, 0, F.size(a) - 1), shifted(a, 1, F.size(a) - 1), f)


def barrier() -> list[Column]:
    """A column that is not deterministic: a condition that refers to it stays above the projection that makes it, so the
    optimizer doesn't copy the projection's expressions into the condition, texts' splitting and all."""
    return [F.monotonically_increasing_id().alias("_barrier")]


def n_repeat_words(df: DataFrame, windows: str) -> DataFrame:
    """df with n_repeat_words: words in windows found twice or more, from the windows' hashes in order. Where few windows
    repeat, each is looked up among those; else the windows are sorted with their places."""
    present = lambda a: F.filter(a, lambda x: x.isNotNull())
    w = F.col(windows)
    df = df.withColumn("_order", F.sort_array(w)).withColumn("_twice", F.array_distinct(present(pairs_of(F.col("_order"), lambda a, b: F.when(a == b, a)))))
    looked_up = present(F.transform(w, lambda h, i: F.when(F.array_contains("_twice", h), i)))
    s = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_out = F.sort_array(F.array_distinct(F.flatten(present(pairs_of(s, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))))))
    starts = F.when(F.size("_twice") == 0, F.array().cast("array<int>")).when(F.size("_twice") <= FEW, looked_up).otherwise(sorted_out)
    df = df.withColumn("_starts", starts)
    covered = F.aggregate(pairs_of(F.col("_starts"), lambda a, b: F.least(b - a, F.lit(3))), F.lit(3), lambda n, x: n + x)
    df = df.withColumn("_covered", F.when(F.size("_starts") > 0, covered).otherwise(0).cast("long")).drop("_order", "_twice", "_starts")
    return df.select("*", *barrier()).withColumn("n_repeat_words", F.when(F.col("_barrier") >= 0, F.col("_covered"))).drop("_covered", "_barrier")


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the words as _words, their hashes as _hashes, and the counts n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.size("_words")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn("_words", words(text)).withColumns({"_hashes": F.transform("_words", lambda x: F.xxhash64(x)), "_lines": lines})
    df = n_repeat_words(df.withColumn("_windows", window_hashes(F.col("_hashes"), n)), "_windows")
    return df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    }).drop("_lines", "_windows")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(_good): ids of trusted documents, to be broadcast where the labels are few."""
    good = labels.where("quality = 1").select(F.col("doc_id").alias("_good")).where("_good is not null").distinct()
    return F.broadcast(good) if labels.count() <= BROADCAST_ROWS else good


def gram_counts(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (x, r, t): raw and target counts of each bucket, and their sums."""
    own = docs.select(F.col(id_col).alias("_id"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("_words"))
    marked = own.join(good, F.col("_id") == F.col("_good"), "left").select(F.col("_good").isNotNull().cast("long").alias("t"), F.explode(grams()).alias("b"))
    counts = marked.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    full = every.join(counts, "b", "left").na.fill(0, ["raw", "target"])
    return full.agg(F.array_sort(F.collect_list(F.struct("b", "raw", "target"))).alias("x"), F.sum("raw").alias("r"), F.sum("target").alias("t"))


def gram_weights(counts: DataFrame) -> DataFrame:
    """One row (weights): log(p_target / p_raw) of each bucket."""
    share = F.col("t") / F.col("r")
    ratio = lambda x: F.log((x["target"] / share + PSEUDO) / (x["raw"] + PSEUDO))
    return counts.select(F.when(F.col("t") > 0, F.transform("x", ratio)).otherwise(F.array_repeat(F.lit(0.0), BUCKETS)).alias("weights"))


def grams(c: str = "_words", hashes: str | None = None) -> Column:
    """Buckets of all unigrams, then of all bigrams. hashes: those of the words, where they are known."""
    single = F.transform(hashes, bucket_of) if hashes else F.transform(c, lambda x: bucket(x))
    return F.concat(single, pairs_of(F.col(c), lambda a, b: bucket(a, b)))


def language(docs: DataFrame, lang_col: str) -> Column:
    return F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col in docs.columns else F.lit("")


def held_out_scores(docs: DataFrame, good: DataFrame, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(_lang, s): the score of each trusted document of MIN_WORDS words or more, its own n-grams not in the target."""
    own = docs.select(F.col(id_col).alias("_id"), language(docs, lang_col).alias("_lang"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    own = own.join(good, F.col("_id") == F.col("_good"), "left_semi").select("_lang", words(F.col("_text")).alias("_words"))
    own = own.select("_lang", F.size("_words").alias("_size"), F.concat(F.sort_array(grams()), F.array(F.lit(-1))).alias("_sorted"), *barrier()).where(f"_size >= {MIN_WORDS} and _barrier >= 0")
    # the place before the first bucket, and the last place of each one's run
    last = F.transform(F.slice("_sorted", 1, F.size("_sorted") - 1), lambda b, i: F.when(F.col("_sorted")[i + 1] != b, i))
    ends = F.concat(F.array(F.lit(-1)), F.filter(last, lambda i: i.isNotNull()))
    own = own.select("_lang", (2 * F.col("_size") - 1).alias("_n"), "_sorted", ends.alias("_ends"), *barrier()).where("_barrier >= 0").drop("_barrier")
    arrays = counts.select(F.transform("x", lambda x: x["target"]).alias("target"), F.transform("x", lambda x: x["raw"] + PSEUDO).alias("raw"), "r", "t")
    # the counts are referred to once, as are the weights below
    view = docs.sparkSession.sql("SELECT *, (SELECT target FROM {c}) AS _target, (SELECT raw FROM {c}) AS _raw, (SELECT r FROM {c}) AS _r, (SELECT t FROM {c}) AS _t FROM {d}", c=arrays, d=own).where("_t > _n")
    share = (F.col("_t") - F.col("_n")) / F.col("_r")
    bucket_at = lambda c, i: F.col(c)[F.col("_sorted")[i]]
    term = lambda p, q: (q - p) * F.log(((bucket_at("_target", q) - (q - p)) / share + PSEUDO) / bucket_at("_raw", q))
    total = F.aggregate(pairs_of(F.col("_ends"), term), F.lit(0.0), lambda acc, x: acc + x)
    return view.select("_lang", (total / F.col("_n")).alias("s"))


def cuts(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(_lang, _cut) of the languages that have trusted documents."""
    low = F.avg("s") - (3 + 6 / F.count("*")) * F.stddev_pop("s")
    return scores.groupBy("_lang").agg(F.least(low, F.lit(threshold)).alias("_cut"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with the base counts, base_failed, score and kept. Columns of docs of these names are called input_ and the
    name. Without a column lang_col, all documents are of one language."""
    out = _judged(docs, labels, threshold, id_col, text_col, lang_col)
    return out.select(*[F.col("_row")[c].alias(f"input_{c}" if c in OWN else c) for c in docs.columns], *OWN)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with the columns of docs."""
    return _judged(docs, labels, threshold, id_col, text_col, lang_col).where("kept").select("_row.*")


def _judged(docs: DataFrame, labels: DataFrame, threshold: float, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(_row, *OWN); as all columns of docs are in _row, none clashes with others."""
    base = base_counts(docs.select(F.struct("*").alias("_row"), language(docs, lang_col).alias("_of"), F.col(text_col).alias("_text")), "_text").drop("_text")
    base = base.withColumn("_grams", grams(hashes="_hashes")).drop("_words", "_hashes")
    good = trusted_ids(labels)
    counts = checkpointed(gram_counts(docs, good, id_col, text_col))
    limit = F.broadcast(checkpointed(cuts(held_out_scores(docs, good, counts, id_col, text_col, lang_col), threshold)))
    # the weights are referred to once, so that they stay an expression and no row gets a copy of them
    view = docs.sparkSession.sql("SELECT *, (SELECT weights FROM {w}) AS _weights FROM {d}", w=gram_weights(counts), d=base)
    total = F.aggregate("_grams", F.lit(0.0), lambda acc, b: acc + F.col("_weights")[b])
    out = view.withColumn("score", F.when(F.col("n_words") > 0, total / F.size("_grams")).otherwise(0.0)).drop("_weights", "_grams")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed).join(limit, F.col("_of") == F.col("_lang"), "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= F.col("_cut"), F.lit(True))).select("_row", *OWN)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
