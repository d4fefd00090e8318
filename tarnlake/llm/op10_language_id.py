"""Language ID: unigram models over the pieces of a fixed public vocabulary, summed over all segmentations.

Each language has a probability for every piece. A word's probability in a language is the sum over all its
segmentations into pieces, computed by a forward algorithm for all words of a batch at once; a text's is the product
over its words. The piece probabilities are learned by expectation maximisation (forward-backward) from the words of
labelled ids, of each language in the whole labelled table the first by a seeded hash of the id: an equal share of
`sample`, where small languages leave room for the others, and `least` where languages are many (so at most the larger
of `sample` and `least` times the languages). Whole texts are read, in learning and in scoring.

Words are lower-cased runs of letters with a word-begin mark in front, whole whatever their length; pieces are all
lower-case ones of letters, up to the vocabulary's longest. A letter outside the vocabulary has one small fixed probability, the same in all languages. Null texts and texts
without a letter are `und` with score 0. Ties go to the language first in order of name. Without any labelled row all
documents are `und`. Rows that repeat are scored each; rows with a null doc_id are scored and never learned from.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held, letter_words, row_columns, save, scored, segment_sum, slices, table

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = 1e-7
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
KINDS = {"lang_pred": "string", "score": "double", "fit": "double"}


class Pieces(NamedTuple):
    """Sorted numbers of the pieces and of all their ends; the piece that is each end, or -1; the longest piece's length."""

    keys: np.ndarray
    tails: np.ndarray
    of: np.ndarray
    longest: int


def step(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    h = (h ^ codes.astype(np.uint64)) * MULTIPLIER
    return h ^ h >> np.uint64(29)


def hashes(codes: np.ndarray) -> np.ndarray:
    """Rows of character codes to one number each, from the last character to the first."""
    h = np.zeros(len(codes), np.uint64)
    for c in codes.T[::-1]:
        h = step(h, c)
    return h


def vocabulary(path: str) -> Pieces:
    """All lower-case pieces of letters."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    names = {p for p in names if p and p == p.lower() and (p.strip(MARK).isalpha() or p == MARK)}
    number = lambda found: np.unique(np.fromiter((hashes(np.array([[ord(c) for c in x]], np.uint32))[0] for x in found), np.uint64, len(found)))
    keys, tails = number(names), number({p[-k:] for p in names for k in range(1, len(p) + 1)})
    i = np.minimum(np.searchsorted(keys, tails), len(keys) - 1)
    return Pieces(keys, tails, np.where(keys[i] == tails, i, -1), max(map(len, names)))


class Lattice:
    """The pieces that end at each character of a set of words, which have one length after padding."""

    def __init__(self, words: list[str], pieces: Pieces | np.ndarray):
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        n, width = len(words), int(self.lengths.max())
        self.codes = np.zeros((width, n), np.uint32)
        self.codes.T[np.arange(width) < self.lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.width, self.ends = width, isinstance(pieces, Pieces)
        self.pieces = pieces if self.ends else Pieces(pieces, pieces, np.arange(len(pieces)), width)

    def at(self, j: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(k, words, piece) for the pieces of the k characters up to j; piece len(keys) is an unknown letter."""
        keys, tails, of, longest = self.pieces
        live, out = np.flatnonzero(self.lengths > j), []
        h = np.zeros(len(live), np.uint64)
        for k in range(1, min(longest, j + 1) + 1):
            h = step(h, self.codes[j - k + 1, live])
            t = np.searchsorted(tails, h)
            t[t == len(tails)] = 0
            known = tails[t] == h
            piece = np.where(known, of[t], -1)
            if k == 1:
                out.append((1, live, np.where(piece < 0, len(keys), piece)))
            elif (hit := piece >= 0).any():
                out.append((k, live[hit], piece[hit]))
            if self.ends:  # a longer piece ends in this one's characters
                live, h = live[known], h[known]
            if not len(live):
                break
        return out

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Log probability of each word and language; p: piece by language, with rows for unknown letters and no piece."""
        n = len(self.lengths)
        past = [np.ones((n, p.shape[1]))]
        scale, out = np.zeros((n, p.shape[1])), np.zeros((n, p.shape[1]))
        for j in range(self.width):
            now = np.zeros((n, p.shape[1]))
            for k, rows, piece in self.at(j):
                now[rows] += past[-k][rows] * p[piece]
            past = [*past[-self.pieces.longest + 1 :], now] if self.pieces.longest > 1 else [now]
            if j % 8 == 7:
                top = np.maximum.reduce(past)
                top[top == 0] = 1
                past, scale = [x / top for x in past], scale + np.log(top)
            done = self.lengths == j + 1
            if done.any():
                out[done] = np.log(np.maximum(past[-1][done], 1e-300)) + scale[done]
        return out

    def expected(self, p: np.ndarray, language: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected number of each (piece, language) in words of one language each. Sums are scaled every eight letters; log scales are kept by place."""
        n, reach, own = len(self.lengths), self.pieces.longest, np.arange(len(self.lengths))
        a, b = np.zeros((self.width + 1, n)), np.zeros((self.width + 1, n))
        log_a, log_b = np.zeros_like(a), np.zeros_like(b)
        a[0], b[self.lengths, own] = 1, 1
        steps = [[(k, rows, piece, p[piece, language[rows]]) for k, rows, piece in self.at(j)] for j in range(self.width)]
        for j, found in enumerate(steps):
            log_a[j + 1] = log_a[j]
            for k, rows, _, prob in found:
                a[j + 1, rows] += a[j + 1 - k, rows] * prob
            if j % 8 == 7:
                near = slice(max(0, j + 2 - reach), j + 2)
                top = a[near].max(axis=0)
                top[top == 0] = 1
                a[near] /= top
                log_a[near] += np.log(top)
        now = np.zeros(n)
        for j in range(self.width - 1, -1, -1):
            log_b[j + 1] = now
            for k, rows, _, prob in steps[j]:
                b[j + 1 - k, rows] += b[j + 1, rows] * prob
            if j % 8 == 0:
                near = slice(max(0, j + 1 - reach), j + 1)
                top = np.where(self.lengths > j, b[near].max(axis=0), 1)
                top[top == 0] = 1
                b[near] /= top
                now = now + np.log(top)
        whole = np.log(np.maximum(a[self.lengths, own], 1e-300)) + log_a[self.lengths, own]
        total = np.zeros(p.shape)
        for j, found in enumerate(steps):
            for k, rows, piece, prob in found:
                scale = np.exp(log_a[j + 1 - k, rows] + log_b[j + 1, rows] - whole[rows])
                np.add.at(total, (piece, language[rows]), a[j + 1 - k, rows] * prob * b[j + 1, rows] * scale * counts[rows])
        return total


def lattices(words: list[str], pieces: Pieces, cells: int = 600_000) -> Iterator[tuple[np.ndarray, Lattice]]:
    """Marked words by length, so many letters with padding at a time, and where they were."""
    marked = [MARK + w for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    order = np.argsort(size, kind="stable")
    a = 0
    while a < len(order):
        fits = size[order[a : a + 20_000]] * np.arange(1, min(20_000, len(order) - a) + 1) <= cells
        b = a + max(1, int(fits.sum()))
        yield order[a:b], Lattice([marked[i] for i in order[a:b]], pieces)
        a = b


class Scorer:
    """Log probabilities of words, kept for up to `keep` of them."""

    def __init__(self, pieces: Pieces, p: np.ndarray, keep: int = 300_000):
        self.pieces, self.p, self.keep = pieces, p, keep
        self.at: dict[str, int] = {"": 0}
        self.scores = np.zeros((1, p.shape[1]))

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.at) + len(words) > self.keep:
            self.at, self.scores = {"": 0}, self.scores[:1]
        if new := [w for w in words if w not in self.at]:
            found = np.zeros((len(new), self.p.shape[1]))
            for where, lattice in lattices(new, self.pieces):
                found[where] = lattice.forward(self.p)
            self.at.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
            self.scores = np.concatenate([self.scores, found])
        return self.scores[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]


def sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of labelled documents, summed over a slice."""
    for whole in batches:
        for batch in slices(whole, "text"):
            which, words, bounds = letter_words(batch.column("text"))
            lang = batch.column("lang").dictionary_encode()
            code = np.repeat(lang.indices.to_numpy(), np.diff(bounds)).astype(np.int64)
            pairs, n = np.unique(code * len(words) + which, return_counts=True)
            yield pa.RecordBatch.from_arrays([pc.take(lang.dictionary, pa.array(pairs // max(1, len(words)))), pa.array([words[i] for i in pairs % max(1, len(words))], pa.string()), pa.array(n)], names=["lang", "word", "n"])


def expecter(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, p = shared.value
        code = {x: i for i, x in enumerate(names)}
        total = np.zeros(p.shape)
        for b in batches:
            words = b.column("word").to_pylist()
            language = np.array([code[x] for x in b.column("lang").to_pylist()], np.int64)
            n = b.column("n").to_numpy()
            for where, lattice in lattices(words, pieces):
                total += lattice.expected(p, language[where], n[where])
        piece, language = np.nonzero(total[:-2])
        yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int64)), pa.array(language.astype(np.int64)), pa.array(total[piece, language])], names=["piece", "language", "n"])

    return run


def quota(counts: list[int], sample: int, least: int) -> int:
    """The largest equal share per language with which a sample holds at most so many, and never under `least`."""
    share, left, rest = 0, sample, sorted(counts)
    for k, n in enumerate(rest):
        share = left // (len(rest) - k)
        if n > share:
            break
        left -= n
        share = n
    return max(share, least)


def fit(spark: SparkSession, docs: DataFrame, path: str, learn_from, sample: int = 4000, rounds: int = 3, smooth: float = 0.05, seed: int = 5, least: int = 200) -> tuple[list[str], Pieces, np.ndarray]:
    """Languages, pieces and probabilities. What reaches the driver is bounded by pieces times languages."""
    pieces = vocabulary(path)
    keys = pieces.keys
    known = docs.where(learn_from & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"[\p{L}\p{M}]"))
    ids = save(spark, known.select(F.col("doc_id").cast("long").alias("label_id"), F.col("lang").cast("string").alias("label_lang")).distinct(), "labelled")
    counts = {r[0]: r[1] for r in ids.groupBy("label_lang").count().collect()}
    each = quota(list(counts.values()), sample, least)
    # a language's first ids by hash lie below this share of the hashes all but surely; the window sees no more than these
    cut = spark.createDataFrame([(x, int(min(1.0, (2 * each + 200) / n) * ((1 << 31) - 1))) for x, n in counts.items()], "cut_lang string, cut long")
    order = F.xxhash64("label_id", F.lit(seed))
    low = ids.join(F.broadcast(cut), F.col("label_lang") == F.col("cut_lang")).withColumn("h", order).where(F.col("h").bitwiseAND((1 << 31) - 1) <= F.col("cut"))
    first = low.withColumn("place", F.row_number().over(Window.partitionBy("label_lang").orderBy(F.col("h").bitwiseAND((1 << 31) - 1), "h", "label_id")))
    chosen = save(spark, first.where(F.col("place") <= each).select("label_id", "label_lang"), "learned")
    chosen = known.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").join(F.broadcast(chosen), (F.col("doc_id") == F.col("label_id")) & (F.col("lang") == F.col("label_lang")), "left_semi")
    words = save(spark, chosen.select("lang", "text").mapInArrow(sample_words, "lang string, word string, n long").where("word <> ''").groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition(24), "language-words")
    names = sorted(r[0] for r in words.select("lang").distinct().collect())
    p = np.full((len(keys) + 2, len(names)), 1.0 / len(keys))
    p[-2], p[-1] = UNKNOWN, 0
    for _ in range(rounds if names else 0):
        shared = spark.sparkContext.broadcast((pieces, p))
        got = words.mapInArrow(expecter(shared, names), "piece long, language long, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas()
        total = np.full((len(keys), len(names)), smooth)
        total[got.piece, got.language] += got.n
        p = np.concatenate([total / total.sum(axis=0) * (1 - UNKNOWN), np.full((1, len(names)), UNKNOWN), np.zeros((1, len(names)))])
    return names, pieces, p


def predictor(shared, names: list[str], model: str):
    def score(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        scorer = held(f"language {model}", lambda: Scorer(*shared.value))
        which, words, bounds = letter_words(texts)
        total = segment_sum(scorer(words)[which], bounds)
        letters = segment_sum((np.fromiter(map(len, words), np.float64, len(words)) + 1)[which], bounds)  # and the mark
        some = letters > 0
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        best = total.argmax(axis=1)
        fits = total.max(axis=1) / np.maximum(letters, 1)
        return pa.array([names[i] if s else "und" for i, s in zip(best, some)], pa.string()), pa.array(np.where(some, 1 / odds.sum(axis=1), 0.0)), pa.array(fits)

    return score


def predict(spark: SparkSession, rows: DataFrame, docs: DataFrame, learn_from=None, path: str | None = None, keep_text: bool = False, **fitted) -> DataFrame:
    """(row, [text,] lang_pred, score, fit), as scored() gives them, for all rows; learned from docs. fit: log probability a letter."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    names, pieces, p = fit(spark, docs, path, F.lit(True) if learn_from is None else learn_from, **fitted)
    if not names:
        return scored(rows, None, KINDS, keep_text, {"lang_pred": F.lit("und"), "score": F.lit(0.0), "fit": F.lit(0.0)})
    return scored(rows, predictor(spark.sparkContext.broadcast((pieces, p)), names, uuid.uuid4().hex), KINDS, keep_text)


def remainder(n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def accepted(spark: SparkSession, docs: DataFrame, least: float = 0.35, least_fit: float = -4.0) -> DataFrame:
    """Documents in a known language, with the columns of docs; lang becomes the predicted one.

    Texts without letters are rejected, and so are those whose language is a toss-up (score below `least`), and those that
    no language fits: below `least_fit` a letter is less likely in the best of them than one drawn from fifty at random.
    """
    out = predict(spark, docs, docs, keep_text=True)
    kept = out.where((F.col("lang_pred") != "und") & (F.col("score") >= least) & (F.col("fit") >= least_fit))
    return kept.select(*(F.col("lang_pred").cast(docs.schema["lang"].dataType).alias("lang") if n == "lang" else c.alias(n) for n, c in zip(docs.columns, row_columns(docs))))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(spark, docs.select("doc_id", "text"), docs, remainder(4) != 2)
    return out.select("row.doc_id", "lang_pred", "score").select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
