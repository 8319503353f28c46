"""Quality rules: countable defects, and a hashed n-gram log-likelihood ratio between a trusted and the raw corpus. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
#: Hash buckets of the two multinomials: the table that is broadcast has this many rows at any size of input.
BUCKETS = 1 << 14
#: Nats a feature. A document that draws on the trusted corpus as much as the average one lies near 0.
THRESHOLD = -0.08
#: Added to every bucket's count.
SMOOTHING = 1.0
#: Words or pairs that each bucket is given besides its own, trusted in the share of the whole corpus: a bucket that is hardly seen says nothing.
PRIOR = 4.0
_MARK = "_quality_"


def _hashed_words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def _features(hashes: str) -> Column:
    """Buckets of the words and of the pairs of neighbours in an array of word hashes."""
    words = F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    pairs = F.transform(F.sequence(F.lit(1), F.size(hashes) - 1), lambda i: F.pmod(F.xxhash64(F.get(hashes, i - 1), F.get(hashes, i)), F.lit(BUCKETS)).cast("int"))
    return F.concat(words, F.when(F.size(hashes) > 1, pairs).otherwise(F.array().cast("array<int>")))


def _ids(trusted: DataFrame, id_col: str) -> DataFrame:
    """(_none, _id, _trusted) of the trusted ids."""
    return trusted.select(F.lit(False).alias("_none"), F.col(id_col).cast("long").alias("_id")).filter("_id IS NOT NULL").distinct().withColumn("_trusted", F.lit(1))


def _dealt(row_id: Column, other: Column) -> list[Column]:
    """Join keys of a row: its id, or for one without, another value that meets no id, so that such rows are spread over all tasks."""
    return [row_id.isNull().alias("_none"), F.coalesce(row_id, other).alias("_id")]


def bucket_counts(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, _raw, _good, _all_raw, _all_good) for every bucket: its count in all documents and in the trusted ones, and the totals.

    trusted has the ids of trusted documents in the column id_col (repeated ids count once). All documents are counted; each
    task sums by bucket before the shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(*_dealt(F.col(id_col).cast("long"), F.xxhash64(text)), text.alias("_text"))
    # A sort-merge join at every size: the ids grow with the corpus, and one plan for all sizes shuffles in proportion.
    hashed = texts.join(_ids(trusted, id_col).hint("merge"), ["_none", "_id"], "left").select(F.coalesce("_trusted", F.lit(0)).alias("_trusted"), _hashed_words(F.col("_text")).alias("_h"))
    counted = hashed.select("_trusted", F.explode(_features("_h")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("_raw"), F.sum("_trusted").alias("_good"))
    spark = docs.sparkSession
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counted, "bucket", "left").fillna(0, ["_raw", "_good"])
    totals = every.agg(F.sum("_raw").alias("_all_raw"), F.sum("_good").alias("_all_good"))
    return every.join(F.broadcast(totals), F.lit(True))


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, ratio) for every bucket: log of its share in the trusted documents over its share in all documents."""
    share = lambda n, total: (F.col(n) + SMOOTHING) / (F.col(total) + SMOOTHING * BUCKETS)
    return bucket_counts(docs, trusted, id_col, text_col).select("bucket", (F.log(share("_good", "_all_good")) - F.log(share("_raw", "_all_raw"))).alias("ratio"))


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and _h, the hashes of the words."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_h", _hashed_words(F.col("_text")))
    lines = F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.transform(F.sequence(F.lit(1), F.size("_h") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_h", i, WINDOW)))
    rows = rows.select(
        "doc_id",
        "_h",
        F.size("_h").cast("long").alias("n_words"),
        (F.length("_text") - F.regexp_count("_text", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.when(F.size("_h") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("_g"),
    )
    # Windows in order of their hash, only where one comes twice.
    ordered = F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    rows = rows.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), ordered))
    same = lambda s, other: F.coalesce(s["g"] == other["g"], F.lit(False))
    twice = F.filter("_s", lambda s, k: same(s, F.get("_s", k - 1)) | same(s, F.get("_s", k + 1)))
    starts = F.sort_array(F.transform(twice, lambda s: s["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    rows = rows.select(
        "doc_id", "_h", "n_words", "word_chars", "n_symbols", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and ratio for every row of docs.

    ratio: the mean over a text's words and pairs of neighbouring words (hashed to BUCKETS buckets) of log_ratios. kept: not
    base_failed, and ratio >= threshold; there is no chance in it. A text's features are summed in the task that reads it, so
    that a few numbers a document are all that is shuffled. A null text is empty: no words, base_failed, ratio 0. Repeated
    rows are judged one by one, null ids stay, other columns are ignored; an empty table gives an empty result.
    """
    ratios = log_ratios(docs, trusted, id_col, text_col)
    base = base_rules(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id())
    keys = ["_row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    told = base.select(*keys, F.explode_outer(_features("_h")).alias("bucket"))
    # One row per bucket: BUCKETS rows at any size.
    summed = told.join(F.broadcast(ratios), "bucket", "left").groupBy(*keys).agg(F.sum("ratio").alias("_sum"), F.count("ratio").alias("_n"))
    ratio = F.coalesce(F.col("_sum") / F.col("_n"), F.lit(0.0))
    return summed.select(*keys[1:], (~F.col("base_failed") & (ratio >= threshold)).alias("kept"), ratio.alias("ratio"))


def _counted(rows: DataFrame) -> DataFrame:
    """rows with _size, the number of the features of _h, and _counts, each bucket with its number."""
    rows = rows.withColumn("_s", F.sort_array(_features("_h")))
    starts = F.transform("_s", lambda b, i: F.when(~F.get("_s", i - 1).eqNullSafe(b), i))
    rows = rows.withColumn("_starts", F.filter(starts, lambda i: i.isNotNull()))
    counts = F.transform("_starts", lambda i, k: F.struct(F.get("_s", i).alias("bucket"), (F.coalesce(F.get("_starts", k + 1), F.size("_s")) - i).alias("n")))
    return rows.withColumn("_size", F.size("_s")).withColumn("_counts", counts)


def quality_apart(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of quality for every row of docs, with a ratio that does not know whether the row itself is trusted.

    A row's own words and pairs are taken from both corpora before it is judged. Of a bucket's count left, the trusted share is
    smoothed towards that of the whole corpus (PRIOR) and compared with it, so that a small corpus moves no ratio by its size. Without
    any other trusted document the ratio is 0. Both ratios of a row, as trusted and as not, are summed in the task that reads it; which one
    holds is told by a join of the few numbers that are left.
    """
    base = _counted(base_rules(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()))
    keys = ["_row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_size"]
    told = base.select(*keys, F.explode_outer("_counts").alias("_c")).select(*keys, "_c.bucket", "_c.n")

    def mean(own: int) -> Column:
        part = F.try_divide(F.col("_all_good") - own * F.col("_size"), F.col("_all_raw") - F.col("_size"))
        return F.sum(F.col("n") * F.log(F.try_divide(F.col("_good") - own * F.col("n") + PRIOR * part, (F.col("_raw") - F.col("n") + PRIOR) * part))) / F.nullif(F.first("_size"), F.lit(0))

    # One row per bucket: BUCKETS rows at any size.
    summed = told.join(F.broadcast(bucket_counts(docs, trusted, id_col, text_col)), "bucket", "left").groupBy(*keys).agg(mean(0).alias("_other"), mean(1).alias("_own"))
    known = summed.select("*", *_dealt(F.col("doc_id"), F.col("_row"))).join(_ids(trusted, id_col).hint("merge"), ["_none", "_id"], "left")
    ratio = F.coalesce(F.when(F.col("_trusted") == 1, F.col("_own")).otherwise(F.col("_other")), F.lit(0.0))
    return known.select(*keys[1:-1], (~F.col("base_failed") & (ratio >= threshold)).alias("kept"), ratio.alias("ratio"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled as good."""
    return labels.filter("quality = 1").select("doc_id")
