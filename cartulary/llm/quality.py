"""Operator 1, quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Everything is a DataFrame expression; no Python runs on the executors.

* Word counts: words are ``[^\\x20\\x09-\\x0D]+``. Uni- and bigrams of words are hashed into ``buckets`` cells.
* Two multinomials are counted: the raw corpus (every document) and the trusted target (documents whose label row says quality 1). Both
  are smoothed by ``alpha`` counts a cell on the target's scale, so a cell that is too rare to be expected in the target says nothing
  against a document. Counting is a grouped sum on (bucket), combined before the shuffle, so the
  shuffle holds at most ``buckets`` rows a task whatever the skew of words or sources.
* The model is one row: an array of ``buckets`` log ratios. ``buckets`` bounds its size; it reaches the rows by a scalar
  subquery.
* score = sum of log(p_target / p_raw) over the document's n-grams, divided by their number. kept = score >= threshold, fixed and
  the same for every document, unless a base rule fails.

Nulls and edges: a null text has no words, so all counts are 0, score is null and base_failed is true; an empty text is alike. Documents
without a label row train the raw side only. With no trusted row at all the ratio has no meaning and every document that passes
the base rules is kept. Repeated rows give repeated results and count as often as they occur; a null doc_id is returned as
null. Extra input columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 32768
THRESHOLD = -0.066
ALPHA = 20.0
MAX_TRUSTED = 16384
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Array of words; empty for null and blank texts. Splitting at one literal character is much cheaper than at a class."""
    spaced = F.coalesce(text, F.lit(""))
    for c in SPACES[1:]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " ", -1), "")


def repeated_words(hashes: Column, starts: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more.

    hashes: window hashes by start. starts: the same as structs (h, i), sorted, or null where no hash repeats. Sorted by hash,
    equal windows are neighbours; the starts kept are put back in text order and each adds the words not covered by the last.
    """
    hit = F.filter(
        starts,
        lambda x, i: (F.coalesce(F.get(starts, i - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(starts, i + 1)["h"] == x["h"], F.lit(False))),
    )
    order = F.array_sort(F.transform(hit, lambda x: x["i"]))
    covered = F.aggregate(
        order,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    return F.coalesce(covered, F.lit(0).cast("long"))


def base_counts(docs: DataFrame, row: Column, text_col: str = "text") -> DataFrame:
    """``_row`` as given, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the word array ``_w``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    one = docs.select(
        row.alias("_row"),
        words_of(F.col(text_col)).alias("_w"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_l"),
    )
    two = one.select(
        "_row",
        "_w",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("_w") >= 4,
            F.transform(F.slice("_w", 1, F.size("_w") - 2), lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2))),
        ).alias("_h"),
    )
    three = two.withColumn(
        "_s",
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))),
    )
    counted = three.withColumn("n_repeat_words", repeated_words(F.col("_h"), F.col("_s"))).drop("_h", "_s")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _cell(first: Column, second: Column | None, buckets: int) -> Column:
    return F.pmod(F.xxhash64(first) if second is None else F.xxhash64(first, second), F.lit(buckets)).cast("int")


def ngram_cells(words: Column, buckets: int) -> Column:
    """Cells of all unigrams, then of all bigrams, of an array column of words."""
    return F.concat(
        F.transform(words, lambda x: _cell(x, None, buckets)),
        F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda x, i: _cell(F.get(words, i), x, buckets)),
    )


def cell_counts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, buckets: int, max_trusted: int) -> DataFrame:
    """cell, raw, target: occurrences of each cell's n-grams in all documents and in the trusted ones, in one pass.

    The trusted ids are the ``max_trusted`` labelled rows of quality 1 with the lowest hash, so their broadcast is bounded.
    """
    ids = (
        labels.where("quality = 1").select(F.col("doc_id").alias("_t")).distinct().orderBy(F.xxhash64("_t"), "_t").limit(max_trusted)
        .withColumn("_good", F.lit(1).cast("long"))
    )
    flagged = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(ids), F.col("_id") == F.col("_t"), "left")
    worded = flagged.select(words_of(F.col("_text")).alias("_w"), F.coalesce("_good", F.lit(0).cast("long")).alias("_good"))
    pairs = worded.select(F.inline(F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", 2, 2**31 - 1).alias("b"))), "_good")
    cells = pairs.select(F.explode(F.array(_cell(F.col("a"), None, buckets), F.when(F.col("b").isNotNull(), _cell(F.col("a"), F.col("b"), buckets)))).alias("cell"), "_good").where("cell is not null")
    return cells.groupBy("cell").agg(F.count(F.lit(1)).alias("raw"), F.sum("_good").alias("target"))


def log_ratios(counts: DataFrame, buckets: int, alpha: float) -> DataFrame:
    """One row, one array of ``buckets`` smoothed log ratios; all zero where nothing is trusted."""
    full = counts.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("cell")).join(counts, "cell", "left")
    row = full.agg(
        F.sort_array(F.collect_list(F.struct("cell", F.coalesce("target", F.lit(0)).alias("t"), F.coalesce("raw", F.lit(0)).alias("r")))).alias("c"),
        F.coalesce(F.sum("target"), F.lit(0)).alias("nt"),
        F.coalesce(F.sum("raw"), F.lit(0)).alias("nr"),
    )
    expected = lambda x: F.col("nt") * x["r"] / F.col("nr")
    return row.select(F.transform("c", lambda x: F.when(F.col("nt") == 0, F.lit(0.0)).otherwise(F.log(x["t"] + alpha) - F.log(expected(x) + alpha))).alias("m"))


def judged(docs: DataFrame, labels: DataFrame, row: Column, id_col: str, text_col: str, buckets: int, threshold: float, alpha: float, max_trusted: int) -> DataFrame:
    """``_row`` with the columns of quality_rules."""
    model = log_ratios(cell_counts(docs, labels, id_col, text_col, buckets, max_trusted), buckets, alpha)
    counted = base_counts(docs, row, text_col).withColumn("_m", model.scalar())
    total = F.aggregate(ngram_cells(F.col("_w"), buckets), F.lit(0.0), lambda acc, c: acc + F.get("_m", c))
    scored = counted.withColumn("score", F.when(F.col("n_words") > 0, total / (2 * F.col("n_words") - 1)))
    passed = F.coalesce(~F.col("base_failed") & (F.col("score") >= threshold), F.lit(False))
    return scored.withColumn("kept", passed).drop("_w", "_m")


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
    alpha: float = ALPHA,
    max_trusted: int = MAX_TRUSTED,
) -> DataFrame:
    """One row a document: doc_id, base counts, base_failed, kept and score."""
    found = judged(docs, labels, F.col(id_col), id_col, text_col, buckets, threshold, alpha, max_trusted)
    return found.select(
        F.col("_row").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def keep_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of docs that the rules keep, in docs' own columns."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = judged(docs, labels, F.struct(*[docs[f"`{c}`"] for c in docs.columns]), "doc_id", "text", BUCKETS, THRESHOLD, ALPHA, MAX_TRUSTED)
    # the row number keeps the filter where it is: pushed down, it would repeat the array expressions inside one another
    return found.withColumn("_n", F.monotonically_increasing_id()).where("kept and _n >= 0").select("_row.*")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
