"""Operator 11, toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic examples and unlabelled text are learnt from. Features are whole words, beginnings of words of 4 to 9 characters and character
5-grams of words with their ends marked, each present in a text or not.

* Candidates: features that more positive examples hold than unlabelled ones do, by a sample. How many documents hold each is then counted over all documents, in one pass that keeps a count a
  candidate in each task. A feature's ``share`` estimates how many of the documents that hold it are toxic: the class prior times its frequency in positives
  over its frequency in all documents, drawn towards the prior by ``SHRINK`` documents and lowered by ``CAUTION`` standard errors of the count in positives.
* A text is described by how many of its features fall into each of a few bins of that share, as logarithms, and by how many distinct words it has. So what is
  learnt of frequent words holds for rare ones of other languages too. A positive example is described by shares that the other half of the positives gave.
* The class prior is the part of positives among the rows whose label may be learnt; without a labelled 0 it is the least ratio of a feature's two
  frequencies over those that a fifth of the positives hold, which bounds it from above.
* A linear classifier is fitted with numpy to the risk pi E_p[l(g)] + max(0, E_u[l(-g)] - pi E_p[l(-g)]) with the logistic loss: where the estimate of the
  negatives' risk falls below zero, which it does when the fit starts to learn the unlabelled rows by heart, the step goes back up that part instead. Its
  sample is bounded by ``MAX_POSITIVE`` and ``MAX_UNLABELLED`` rows, those of the least hash of their id; prior, counts and scores are of all rows.
* score is the classifier's probability, predicted is 1 from ``LIMIT`` on.

Rows whose crc32(doc_id as text) mod 4 is 2 are held out: their labels are not read and they are in neither sample; their texts are counted among all.

Nulls and edges: a null text counts as empty; an empty text gets the score of a text without features; labels of null ids, null labels and labels of ids
that no document has say nothing, an id labelled both ways is positive; without any positive every score is 0; a null doc_id is returned as null
and is not held out; repeated rows give repeated results; an empty table gives no rows; extra columns are ignored, whatever their names. A text
is read in pieces cut between words, so a long text takes memory for its distinct words only.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cartulary.llm.batches import map_texts, no_tables, worker_tables
from cartulary.scratch import cut, drop

HELD_OUT = 2
LIMIT = 0.3
MAX_POSITIVE = 8192
MAX_UNLABELLED = 16384
MAX_CANDIDATES = 1 << 17
LEAST_POSITIVE = 7
LEAST_CONTRAST = 1.5
SHRINK = 10.0
CAUTION = 2.0
BINS = (0.2, 0.35, 0.5, 0.65, 0.8)
GRAM = 5
BEGINNINGS = range(4, 10)
LONG_WORD = 64
PIECE = 1 << 20
CACHE = 400_000
STEPS, RATE, L2, BACK = 1500, 0.02, 1e-3, 1.0

#: Bytes of words; all others a blank.
WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
BLANK = re.compile(r"[\x00-\x7f](?<![A-Za-z0-9])")


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            end = m.start() if (m := BLANK.search(text, end)) else len(text)
        yield text[at:end]
        at = end


def words_of(text: str | None) -> set[bytes]:
    """Distinct lower-case words of a whole text, as UTF-8: runs of ASCII letters and digits and of all characters beyond ASCII."""
    found: set[bytes] = set()
    for piece in _pieces(text or ""):
        found.update(piece.lower().encode("utf-8", "replace").translate(WORD_BYTES).split())
    return found


def features_of(word: bytes) -> list[str]:
    """A word with its ends marked, its beginnings and character n-grams, some twice. Words of more than ``LONG_WORD`` characters (scripts without blanks) are
    no features as a whole."""
    marked = f"<{word.decode()}>"
    size = len(marked)
    found = [marked[k : k + GRAM] for k in range(size - GRAM + 1)]
    found += [marked[: k + 1] for k in BEGINNINGS if k < size - 2]
    if size <= LONG_WORD + 2:
        found.append(marked)
    return found


class Places:
    """Numbers of a vocabulary's features in texts; what a word holds is remembered."""

    def __init__(self, vocabulary: list[str]):
        self.number = {f: k for k, f in enumerate(vocabulary)}
        self.known: dict[bytes, tuple[int, ...]] = {}

    def of_text(self, text: str | None) -> tuple[np.ndarray, int]:
        """The places of its features, sorted, and the number of its distinct words."""
        found: set[int] = set()
        known = self.known
        words = words_of(text)
        for word in words:
            own = known.get(word)
            if own is None:
                if len(known) >= CACHE:
                    known.clear()
                own = known[word] = tuple(self.number[f] for f in features_of(word) if f in self.number)
            if own:
                found.update(own)
        return np.array(sorted(found), dtype=np.int64), len(words)


@dataclass
class Model:
    """The bin of each feature (from 1), the weights of the bins, of the number of words and of one, and the prior. Without positives to learn from there are no
    weights and every score is 0."""

    bins: dict[str, int]
    weights: np.ndarray
    prior: float


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def _candidates(sampled: DataFrame, positive: int, plain: int) -> list[str]:
    """Features of ``LEAST_POSITIVE`` or more positive texts that these hold ``LEAST_CONTRAST`` times as often as a part of the unlabelled sample, in the order of that
    contrast. sampled: text, role. positive, plain: how many rows there are of both kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_tables()
        counts: tuple[Counter, Counter] = Counter(), Counter()

        def out() -> Iterator[pa.RecordBatch]:
            for k, own in enumerate(counts):
                if own:
                    number = pa.array(list(own.values()), pa.int64())
                    none = pa.array(np.zeros(len(own), dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), *((none, number) if k else (number, none))], names=["feature", "n", "m"])
                own.clear()

        for batch in batches:
            for text, role in zip(batch.column("text").to_pylist(), batch.column("role").to_pylist(), strict=True):
                held: set[str] = set()
                for word in words_of(text):
                    held.update(features_of(word))
                if role[0] == "p":
                    counts[0].update(held)
                if role[-1] == "v":
                    counts[1].update(held)
            if len(counts[0]) + len(counts[1]) > CACHE:
                yield from out()
        yield from out()

    summed = sampled.select("text", "role").mapInArrow(run, "feature string, n long, m long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    contrast = (F.col("n") / positive) / ((F.col("m") + 1) / (plain + 1))
    rows = summed.where(F.col("n") >= LEAST_POSITIVE).withColumn("contrast", contrast).where(F.col("contrast") >= LEAST_CONTRAST)
    return [r.feature for r in rows.orderBy(F.desc("contrast"), "feature").limit(MAX_CANDIDATES).select("feature").collect()]


def _counted(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """One pass over all documents: documents by feature (place, n) from each task, those of place -1 being all; and of each sampled row its role, its number of
    distinct words (n) and the places of its features."""
    mark = uuid.uuid4().hex
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)  # MAX_CANDIDATES short strings
    names = ["place", "n", "role", "held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = worker_tables(("toxicity", mark), lambda: Places(shared.value))
        total, n = np.zeros(len(shared.value), dtype=np.int64), 0
        for batch in batches:
            roles, sizes, found = [], [], []
            for text, role in zip(batch.column("text").to_pylist(), batch.column("role").to_pylist(), strict=True):
                held, size = places.of_text(text)
                total[held] += 1
                n += 1
                if role is not None:
                    roles.append(role)
                    sizes.append(size)
                    found.append(held)
            if roles:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(roles), pa.int32()), pa.array(sizes, pa.int64()), pa.array(roles, pa.string()), pa.array(found, pa.list_(pa.int32()))], names=names)
        some = np.flatnonzero(total)
        columns = [pa.array([*some, -1], pa.int32()), pa.array([*total[some], n], pa.int64()), pa.nulls(len(some) + 1, pa.string()), pa.nulls(len(some) + 1, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, "place int, n long, role string, held array<int>")


def shares(in_positive: np.ndarray, in_all: np.ndarray, positive: int, every: int, rows: int, prior: float) -> np.ndarray:
    """Of the documents that hold a feature, the part that is toxic by a cautious estimate. ``positive`` of ``every`` positives are counted in in_positive."""
    likely = in_positive / max(positive, 1)
    sure = np.maximum(0.0, 1 - CAUTION / np.sqrt(np.maximum(likely * every, 1.0)))
    toxic = np.minimum(in_all, prior * rows * likely) * sure
    return (toxic + SHRINK * prior) / (in_all + SHRINK)


def described(bins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of features for the classifier, from numbers of features by bin and of distinct words."""
    return np.column_stack([np.log1p(bins), np.log1p(sizes) / 10, np.ones(len(sizes))])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> np.ndarray:
    """Weights of the least non-negative risk, by Adam on the full sample."""
    theta = np.zeros(positive.shape[1])
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        gp, gu = np.clip(positive @ theta, -30, 30), np.clip(unlabelled @ theta, -30, 30)
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        down = su @ unlabelled / len(unlabelled) - prior * (sp @ positive) / len(positive)
        g = prior * ((sp - 1) @ positive) / len(positive) + down if negative >= 0 else -BACK * down
        g[:-1] += L2 * theta[:-1]
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None,
    max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
) -> Model:
    """The classifier of a table of documents and of labels (doc_id, label)."""
    nothing = Model({}, np.empty(0), 0.0)
    allowed = F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1) & ~_held_out(F.col("doc_id"))
    known = cut(labels.where(allowed).groupBy(F.col("doc_id").alias("_i")).agg(F.max(label_col).alias("_y")), "labels")
    ones, every = known.agg(F.coalesce(F.sum("_y"), F.lit(0)), F.count(F.lit(1))).collect()[0]
    if not ones:
        drop(known)
        return nothing
    ids = docs.select(F.col(id_col).alias("_i")).where(F.col("_i").isNotNull() & ~_held_out(F.col("_i"))).distinct()
    drawn = lambda rows, salt, most: rows.orderBy(F.xxhash64(F.lit(salt), "_i"), "_i").limit(most)
    half = F.when(F.pmod(F.xxhash64(F.lit(13), "_i"), F.lit(2)) == 0, "p0").otherwise("p1")
    positive = drawn(known.where("_y = 1").select("_i").join(ids, "_i", "left_semi"), 11, max_positive).withColumn("_p", half)
    # a row may be drawn for both
    some = F.when(F.pmod(F.xxhash64(F.lit(14), "_i"), F.lit(4)) == 0, "uv").otherwise("u")
    sample = cut(positive.join(drawn(ids, 12, max_unlabelled).withColumn("_u", some), "_i", "full").select("_i", F.concat_ws("", "_p", "_u").alias("role")), "sample")
    drop(known)
    flagged = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("_id") == F.col("_i"), "left").select("text", "role")
    n_positive, n_plain = sample.agg(F.count_if(F.col("role").startswith("p")), F.count_if(F.col("role").endswith("v"))).collect()[0]
    vocabulary = _candidates(flagged.where("role like 'p%' or role like '%v'"), n_positive, n_plain) if n_positive else []
    if not vocabulary:
        drop(sample)
        return nothing
    table = cut(_counted(flagged, vocabulary), "features")
    drop(sample)
    in_all, rows = np.zeros(len(vocabulary), dtype=np.int64), 0
    for r in table.where("role is null").groupBy("place").agg(F.sum("n").alias("n")).collect():  # a row a candidate
        if r.place < 0:
            rows = r.n
        else:
            in_all[r.place] = r.n
    halves, sizes = np.zeros((2, len(vocabulary)), dtype=np.int64), np.zeros(2, dtype=np.int64)
    positives = table.where("role like 'p%'").select(F.substring("role", 2, 1).cast("int").alias("half"), "held")
    for r in positives.groupBy("half").count().collect():
        sizes[r.half] = r["count"]
    for r in positives.select("half", F.explode("held").alias("place")).groupBy("half", "place").count().collect():  # two rows a candidate
        halves[r.half, r.place] = r["count"]
    both = halves.sum(axis=0)
    if prior is None:
        frequent = both >= 0.2 * sizes.sum()
        bound = np.min(in_all[frequent] / rows / (both[frequent] / sizes.sum()), initial=0.5)
        prior = ones / every if ones < every else float(bound)
    prior = min(max(prior, 1e-4), 0.9)
    part = lambda counts, n: np.digitize(shares(counts, in_all, n, sizes.sum(), rows, prior), BINS).astype(np.int8)
    # a positive row is described by what the other half says
    sides = [part(halves[1], sizes[1]), part(halves[0], sizes[0]), part(both, sizes.sum())]
    shared = docs.sparkSession.sparkContext.broadcast(sides)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, counts = batch.column("role").to_pylist(), []
            for role, held in zip(roles, batch.column("held"), strict=True):
                own = shared.value[int(role[1]) if role[0] == "p" else 2]
                counts.append(np.bincount(own[held.values.to_numpy()], minlength=len(BINS) + 1)[1:].tolist())
            yield pa.RecordBatch.from_arrays([batch.column("role"), batch.column("n"), pa.array(counts, pa.list_(pa.int64()))], names=["role", "n", "counts"])

    found = table.where("role is not null").select("role", "n", "held").mapInArrow(describe, "role string, n long, counts array<long>").collect()  # the sample's rows, a few numbers each
    drop(table)
    x = described(np.array([r.counts for r in found]).reshape(-1, len(BINS)), np.array([r.n for r in found]))
    roles = np.array([r.role for r in found])
    # the order of rows from Spark is not fixed: sums shall be
    x_p, x_u = (m[np.lexsort(m.T)] for m in (x[np.char.startswith(roles, "p")], x[np.char.find(roles, "u") >= 0]))
    if not len(x_p) or not len(x_u):
        return nothing
    weights = fit(x_p, x_u, prior)
    return Model({vocabulary[k]: int(sides[2][k]) for k in np.flatnonzero(sides[2])}, weights, prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", limit: float = LIMIT) -> DataFrame:
    """One row a document: doc_id, score, predicted, n_features (those of the model that its text holds)."""
    mark = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast((list(model.bins), np.array([*model.bins.values()], dtype=np.int64), model.weights))

    def make():
        names, bins, weights = shared.value
        places = worker_tables(("toxicity", mark), lambda: Places(names))

        def work(texts: list) -> list[list]:
            counts, sizes = np.zeros((len(texts), len(BINS)), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
            for k, text in enumerate(texts):
                held, sizes[k] = places.of_text(text)
                counts[k] = np.bincount(bins[held], minlength=len(BINS) + 1)[1:]
            scores = 1 / (1 + np.exp(-np.clip(described(counts, sizes) @ weights, -30, 30))) if len(weights) else np.zeros(len(texts))
            return [scores, (scores >= limit).astype(np.int32), counts.sum(axis=1)]

        return work

    return map_texts(docs, make, "score double, predicted int, n_features long", id_col, text_col)


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score(docs, learn(docs, labels))
    return found.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_features")
