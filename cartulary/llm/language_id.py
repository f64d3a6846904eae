"""Operator 8, language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its labelled text. A text is cross-parsed against each
automaton: from the current place the longest match with the language's text is one phrase; a character that no match starts with is
a phrase of its own. Few phrases mean that the language's text explains the text well. The language with the fewest phrases per
letter wins; ties go to the first name.

Phrases are parsed within a word (with its leading blank) and do not run over blanks, so a word's phrase counts are a property of the
word alone: they are found once and kept in a bounded table, and a text's counts are sums over all its words. The whole text is used.
Text is lower-cased, and everything but letters separates words; the sample is treated alike.

Learning. ``learn`` takes text and language only. Each language's sample is ``sample_chars`` characters at most, from its rows with the lowest hash;
candidate rows are first thinned by a hash limit derived from the language's row count, so at most about ``sample_rows``
rows a language reach the window that orders them. The model, at most ``total_chars`` characters over all languages, is broadcast.

score: 1 - best / second best phrase count (0 to 1): the margin. With one learned language it is 1 - phrases / letters.

Nulls and edges: a null text or one without a letter is ``und`` with score 0; so is everything if nothing was learned. Rows with a null
language or id teach nothing; repeated rows give repeated results; a null doc_id is returned as null with held_out null; extra columns
are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window, functions as F

from cartulary.llm.batches import map_rows, map_texts, worker_tables

SAMPLE_CHARS = 60_000
SAMPLE_ROWS = 400
TOTAL_CHARS = 1_200_000
FOLDS = 5
KEPT_WORDS = 250_000
FIELD = 40
LETTERS = re.compile(r"[^\W\d_]+")


class SuffixAutomaton:
    def __init__(self, text: str):
        go: list[dict[str, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for ch in text:
            new = len(go)
            go.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and ch not in go[p]:
                go[p][ch] = new
                p = link[p]
            if p >= 0:
                q = go[p][ch]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(go)
                    go.append(dict(go[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[new] = clone
                    while p >= 0 and go[p].get(ch) == q:
                        go[p][ch] = clone
                        p = link[p]
            last = new
        self.go = go

    def phrases(self, word: str) -> int:
        """Phrases of the cross-parsing: the longest match from each phrase's start, or one character."""
        go, state, n = self.go, 0, 0
        for ch in word:
            nxt = go[state].get(ch)
            if nxt is None:
                if state:
                    n += 1
                nxt = go[0].get(ch)
                if nxt is None:
                    n += 1
                    nxt = 0
            state = nxt
        return n + (state != 0)


class Languages:
    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.names = [name for name, _ in samples]
        self.automata = [SuffixAutomaton(" " + " ".join(LETTERS.findall(text.lower()))) for _, text in samples]
        #: word -> phrase counts of all languages, FIELD bits each, in one integer
        self.kept: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def _counts(self, word: str) -> int:
        found = self.older.get(word)
        if found is None:
            found = 0
            for k, a in enumerate(self.automata):
                found |= a.phrases(" " + word) << (FIELD * k)
        self.kept[word] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and phrases per letter of the winner."""
        words = LETTERS.findall(text.lower()) if text else []
        if not words or not self.names:
            return "und", 0.0, 0.0
        if len(self.kept) > KEPT_WORDS:
            self.kept, self.older = {}, self.kept
        known, total = self.kept.get, 0
        for w in words:
            c = known(w)
            total += self._counts(w) if c is None else c
        mask = (1 << FIELD) - 1
        counts = sorted((total >> (FIELD * k) & mask, name) for k, name in enumerate(self.names))
        letters = sum(map(len, words))
        best = counts[0][0]
        other = counts[1][0] if len(counts) > 1 else letters + len(words)
        return counts[0][1], max(0.0, min(1.0, 1.0 - best / other)) if other else 0.0, best / letters


def learn(labelled: DataFrame, text_col: str, lang_col: str, key_col: str, sample_chars: int = SAMPLE_CHARS, sample_rows: int = SAMPLE_ROWS, total_chars: int = TOTAL_CHARS) -> tuple[tuple[str, str], ...]:
    """(language, sample text) by name. Bounded: sample_chars a language and total_chars over all, whatever the table's size."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(key_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(key_col)).alias("h")
    )
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    thin = rows.join(F.broadcast(sizes), "lang").where(share * F.col("n") <= sample_rows)
    order = Window.partitionBy("lang").orderBy("h", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    taken = thin.withColumn("before", F.coalesce(F.sum(F.length("text")).over(order), F.lit(0))).where(F.col("before") < sample_chars)
    cut_off = taken.select("lang", "before", F.expr(f"substring(text, 1, cast({sample_chars} - before as int))").alias("text"))
    samples: dict[str, list[str]] = {}
    for row in cut_off.orderBy("lang", "before").collect():
        samples.setdefault(row["lang"], []).append(row["text"])
    most = total_chars // max(1, len(samples))
    return tuple((lang, "\n".join(texts)[:most]) for lang, texts in sorted(samples.items()))


def _predictor(docs: DataFrame, samples: tuple[tuple[str, str], ...]):
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    samples_id = hash(samples)

    def make():
        model = worker_tables(("languages", samples_id), lambda: Languages(shared.value))
        return lambda texts: list(zip(*map(model.predict, texts))) if texts else [[] for _ in range(3)]

    return make


def language_id(docs: DataFrame, samples: tuple[tuple[str, str], ...], id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score, phrases_per_letter."""
    found = map_texts(docs, _predictor(docs, samples), "lang_pred string, score double, phrases_per_letter double", id_col, text_col)
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % folds == 0).alias("held_out"), "lang_pred", "score", "phrases_per_letter")


def _training(docs: DataFrame) -> DataFrame:
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return language_id(docs, learn(_training(docs), "text", "lang", "doc_id"))


#: Prose in a learned language has long phrases and a clear margin; other text has neither.
STAGE_SCORE, STAGE_PHRASES = 0.02, 0.6


def keep_identified(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows whose text is in a learned language, columns unchanged; all rows where nothing could be learned."""
    samples = learn(_training(docs), "text", "lang", "doc_id")
    if not samples:
        return docs
    found, names = map_rows(docs, _predictor(docs, samples), "lang_pred string, score double, phrases double", "text")
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= STAGE_SCORE) & (F.col("phrases") <= STAGE_PHRASES))
    return kept.select(*names).toDF(*docs.columns)
