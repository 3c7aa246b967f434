"""Language identification by unigram pieces, summed over all segmentations.

A word's probability in a language is the sum over all ways to cut it into pieces of a
fixed public vocabulary of the product of the pieces' probabilities; a forward pass over
the word's letters adds them up. The probabilities are learned by expectation
maximisation over words counted by language: tasks give expected piece counts, the driver
sees one number for each language and piece.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spinledger.llm.common import materialize

#: Pieces of at most so many signs, the word mark included; longer words are cut into so many letters.
LONGEST_PIECE, LONGEST_WORD = 8, 32
#: Probability of a letter that no piece of one sign stands for.
UNKNOWN = 1e-7
#: So many words count as evidence at most: the words of a text depend on each other.
EVIDENCE = 20
_WORD = re.compile(r"[^\W\d_]+")
_MARK = "▁"
_REMEMBERED = 400_000
UNDETERMINED = "und"
#: A text is in none of the learned languages if its best one costs it so many times the bits a sign of the learned texts.
WORST_FIT = 2.5


class Pieces:
    """The lower-case letter pieces of a sentencepiece vocabulary."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        every = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        self.names = sorted({p for p in every if len(p) <= LONGEST_PIECE and _lower_letters(p)})
        self.unknown, self.none = len(self.names), len(self.names) + 1
        self._weights = np.random.default_rng(11).integers(1, 2**63, LONGEST_PIECE, dtype=np.uint64) | np.uint64(1)
        keys = np.array([self._key(p) for p in self.names], dtype=np.uint64)
        self._order = np.argsort(keys)
        self._keys = keys[self._order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a key")

    def _key(self, piece: str) -> int:
        return sum(int(w) * ord(c) for w, c in zip(self._weights, piece)) % 2**64

    def ids(self, words: list[str]) -> np.ndarray:
        """For words of one length: the piece of each length that ends at each sign, the word mark first."""
        signs = np.array([[ord(c) for c in _MARK + w] for w in words], dtype=np.uint64)
        n, length = signs.shape
        out = np.full((length, LONGEST_PIECE, n), self.none, dtype=np.int64)
        for size in range(1, min(LONGEST_PIECE, length) + 1):
            key = np.zeros((n, length - size + 1), dtype=np.uint64)
            for k in range(size):
                key += self._weights[k] * signs[:, k : length - size + 1 + k]
            at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            found = np.where(self._keys[at] == key, self._order[at], self.unknown if size == 1 else self.none)
            out[size - 1 :, size - 1] = found.T
        return out


def _lower_letters(piece: str) -> bool:
    body = piece.removeprefix(_MARK)
    return (body == "" and piece == _MARK) or (body.isalpha() and body == body.lower())


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def full_table(probabilities: np.ndarray) -> np.ndarray:
    """Rows of pieces, then the unknown letter, then none."""
    languages = probabilities.shape[1]
    return np.vstack((probabilities, np.full((1, languages), UNKNOWN), np.zeros((1, languages))))


def forward(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Probability of each prefix, summed over its segmentations: [length + 1, word, language]."""
    length, sizes, n = ids.shape
    alpha = np.zeros((length + 1, n, table.shape[1]))
    alpha[0] = 1
    for j in range(1, length + 1):
        for size in range(1, min(sizes, j) + 1):
            alpha[j] += alpha[j - size] * table[ids[j - 1, size - 1]]
    return alpha


def cut_words(text: str | None) -> list[str]:
    found = _WORD.findall(text.lower()) if text else []
    if any(len(w) > LONGEST_WORD for w in found):
        found = [w[k : k + LONGEST_WORD] for w in found for k in range(0, len(w), LONGEST_WORD)]
    return found


def by_length(words: list[str]) -> Iterator[list[int]]:
    """Positions of words of one length, in blocks."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(words) else []:
        for k in range(0, len(part), 20_000):
            yield part[k : k + 20_000].tolist()


def word_scores(words: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), table.shape[1]))
    for block in by_length(words):
        out[block] = np.log(forward(pieces.ids([words[i] for i in block]), table)[-1])
    return out


def expected_counts(words: list[str], languages: np.ndarray, counts: np.ndarray, pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """[piece, language] counts expected under ``table``, from forward and backward sums."""
    k = table.shape[1]
    total = np.zeros(len(table) * k)
    for block in by_length(words):
        ids, lang = pieces.ids([words[i] for i in block]), languages[block]
        length, sizes, n = ids.shape
        share = [[table[ids[j, s], lang] for s in range(sizes)] for j in range(length)]
        alpha, beta = np.zeros((length + 1, n)), np.zeros((length + 1, n))
        alpha[0] = beta[length] = 1
        for j in range(1, length + 1):
            for size in range(1, min(sizes, j) + 1):
                alpha[j] += alpha[j - size] * share[j - 1][size - 1]
        for j in range(length, 0, -1):
            for size in range(1, min(sizes, j) + 1):
                beta[j - size] += beta[j] * share[j - 1][size - 1]
        weight = counts[block] / alpha[length]
        for j in range(1, length + 1):
            for size in range(1, min(sizes, j) + 1):
                part = alpha[j - size] * share[j - 1][size - 1] * beta[j] * weight
                total += np.bincount(ids[j - 1, size - 1] * k + lang, weights=part, minlength=len(total))
    return total.reshape(-1, k)


def held_out(id_col: str = "doc_id"):
    """Documents that no model learns from: the remainder of crc32 of the id by 4 is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, vocabulary: str, docs_per_language: int = 1000, rounds: int = 3, smoothing: float = 0.01) -> tuple[list[str], np.ndarray]:
    """Languages and [piece, language] probabilities; see ``learn``."""
    return learn(docs, vocabulary, docs_per_language, rounds, smoothing)[:2]


def learn(
    docs: DataFrame, vocabulary: str, docs_per_language: int = 1000, rounds: int = 3, smoothing: float = 0.01, with_fit: bool = False
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, [piece, language] probabilities and, for ``with_fit``, each language's mean log probability a sign of its learned texts.

    Learns from ``text`` and non-null ``lang`` of documents that are not held out: whole
    texts of about ``docs_per_language`` of each language, chosen by a hash of the id. The
    result has one row for each piece and grows with neither texts nor documents.
    """
    spark = docs.sparkSession
    usable = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row for a language
    languages = sorted(sizes)
    pieces = pieces_of(vocabulary)
    if not languages:
        return [], np.zeros((len(pieces.names), 0)), np.zeros(0)
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, docs_per_language / sizes[lang])))])
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter[tuple[str, str]] = Counter()
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                found.update((lang, w) for w in cut_words(text))
            rows = [(lang, w, n) for (lang, w), n in found.items()]
            yield pd.DataFrame(rows, columns=["lang", "word", "n"])

    counted = chosen.select("lang", "text").mapInPandas(count, "lang string, word string, n bigint")
    words = materialize(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    number = {lang: i for i, lang in enumerate(languages)}
    probabilities = np.full((len(pieces.names), len(languages)), 1 / len(pieces.names))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(full_table(probabilities))

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, table = pieces_of(vocabulary), shared.value  # noqa: B023
            total = np.zeros(table.shape)
            for batch in batches:
                langs = batch["lang"].map(number).to_numpy()
                total += expected_counts(batch["word"].tolist(), langs, batch["n"].to_numpy(np.float64), own, table)
            piece, lang = np.nonzero(total[: len(own.names)])
            yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})

        rows = words.mapInPandas(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full(probabilities.shape, smoothing)
        counts[rows["piece"], rows["lang"]] += rows["n"]
        probabilities = counts / counts.sum(0)
    fit = np.zeros(len(languages))
    if with_fit:
        last = spark.sparkContext.broadcast(full_table(probabilities))

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = pieces_of(vocabulary)
            for batch in batches:
                langs, n = batch["lang"].map(number).to_numpy(), batch["n"].to_numpy(np.float64)
                scores = word_scores(batch["word"].tolist(), own, last.value)[np.arange(len(batch)), langs]
                yield pd.DataFrame({"lang": langs, "score": scores * n, "signs": n * signs(batch["word"])})

        measured = words.mapInPandas(measure, "lang int, score double, signs double").groupBy("lang")
        for r in measured.agg(F.sum("score").alias("score"), F.sum("signs").alias("signs")).collect():  # one row for a language
            fit[r["lang"]] = r["score"] / r["signs"]
    return languages, probabilities, fit


def signs(words: list[str] | pd.Series) -> np.ndarray:
    """Letters of each word and its mark."""
    return np.array([len(w) + 1 for w in words], dtype=np.float64)


def posterior(total: np.ndarray, n: int) -> np.ndarray:
    """Language probabilities from the summed log probabilities of ``n`` words, languages alike beforehand."""
    scaled = (total - total.max()) * (min(n, EVIDENCE) / n)
    weights = np.exp(scaled)
    return weights / weights.sum()


def language_column(spark: SparkSession, languages: list[str], probabilities: np.ndarray, vocabulary: str) -> Callable[[str], Column]:
    """A function of the text column that gives struct (lang_pred, score, fit).

    ``fit`` is the mean log probability of a letter or word mark in the language. ``und``
    with score 0 and fit 0 where the text is null or has no letter, or nothing was learned;
    ties go to the language that sorts first.
    """
    shared = spark.sparkContext.broadcast(full_table(probabilities))

    @F.pandas_udf("lang_pred string, score double, fit double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces, table = pieces_of(vocabulary), shared.value
        known: dict[str, int] = {}
        scores = np.zeros((0, len(languages)))
        for batch in batches:
            out, texts = [], batch.tolist()
            for k in range(0, len(texts), 500):
                rows = [cut_words(t) if languages else [] for t in texts[k : k + 500]]
                if len(known) > _REMEMBERED:
                    known, scores = {}, scores[:0]
                new = list(set().union(*rows).difference(known))
                known.update(zip(new, range(len(known), len(known) + len(new))))
                scores = np.vstack((scores, word_scores(new, pieces, table))) if new else scores
                for words in rows:
                    if not any(c.isalpha() for w in words for c in w):
                        out.append((UNDETERMINED, 0.0, 0.0))
                        continue
                    total = scores[[known[w] for w in words]].sum(0)
                    chances = posterior(total, len(words))
                    best = int(chances.argmax())
                    out.append((languages[best], float(chances[best]), float(total[best] / signs(words).sum())))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "fit"])

    return guess


def predict(docs: DataFrame, languages: list[str], probabilities: np.ndarray, vocabulary: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each document, from its whole text alone.

    Repeated rows give repeated rows; a null id is kept; columns other than doc_id and text
    are not read.
    """
    guess = language_column(docs.sparkSession, languages, probabilities, vocabulary)
    doc_id = F.col("doc_id").cast("bigint").alias("doc_id")
    return docs.select(doc_id, held_out().alias("held_out"), guess("text").alias("g")).select("doc_id", "held_out", "g.lang_pred", "g.score")


def identify(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Learn from ``docs`` and predict the language of each of them."""
    languages, probabilities = train(docs, vocabulary)
    return predict(docs, languages, probabilities, vocabulary)


def keep_identified(docs: DataFrame, vocabulary: str, least: float = 0.5) -> DataFrame:
    """``docs`` without those whose language is undetermined, less certain than ``least`` or none of the learned ones.

    The posterior compares the learned languages with each other only, so a text must also
    cost no more than ``WORST_FIT`` times the bits a sign of its language's learned texts.
    """
    languages, probabilities, fit = learn(docs, vocabulary, with_fit=True)
    guess = language_column(docs.sparkSession, languages, probabilities, vocabulary)
    limits = F.coalesce(*[F.when(F.col("__guess.lang_pred") == lang, F.lit(float(WORST_FIT * fit[k]))) for k, lang in enumerate(languages)], F.lit(0.0))
    return (
        docs.withColumn("__guess", guess("text"))
        .filter((F.col("__guess.lang_pred") != UNDETERMINED) & (F.col("__guess.score") >= least) & (F.col("__guess.fit") >= limits))
        .drop("__guess")
    )
