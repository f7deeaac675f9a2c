"""Language identification by unigram piece models that sum over all segmentations.

Each language has probabilities over the pieces of a fixed public vocabulary. A word's probability is the sum over all
ways to cut it into pieces, found by a forward pass over its lattice; a text's is the product over its words. The
probabilities are fitted by expectation maximisation over the same lattices.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_START = "▁"
#: Longer runs of letters are cut into words of this length, so that no probability underflows.
WORD_CHARS = 24
#: About so many labelled rows of each language, chosen by a hash of the row's key, train it.
TRAIN_ROWS = 600
ROUNDS = 2
SMOOTHING = 0.01
#: More languages than this (or more rows of counts than that many vocabularies) are refused rather than collected.
MAX_LANGUAGES = 500
WORDS_REMEMBERED = 400_000
UNDETERMINED = "und"
LETTER, WORD = regex.compile(r"\p{L}"), regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Numbers that a lattice of words holds at once, over all positions and languages.
LATTICE_CELLS = 2_000_000


@lru_cache(maxsize=2)
def pieces(vocabulary: str) -> tuple[dict[str, int], int]:
    """Piece to number, and the greatest piece length. The number after the last stands for any other single character."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    found: dict[str, int] = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            found.setdefault(sp.id_to_piece(i), len(found))
    return found, min(WORD_CHARS + 1, max(map(len, found)))


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters (and the marks on them), long ones cut."""
    words = WORD.findall(text.lower())
    if len(text) > WORD_CHARS and max(map(len, words), default=0) > WORD_CHARS:
        return [w[i : i + WORD_CHARS] for w in words for i in range(0, len(w), WORD_CHARS)]
    return words


def words_at_once(languages: int) -> int:
    """Words whose lattice keeps within LATTICE_CELLS."""
    return max(1, LATTICE_CELLS // ((WORD_CHARS + 2) * max(1, languages)))


class Lattice:
    """All pieces that fit into some words: for each end position, arrays of word, start and piece."""

    def __init__(self, words: list[str], vocabulary: str):
        known, longest = pieces(vocabulary)
        other, get = len(known), known.get
        by_end: list[tuple[list, list, list]] = [([], [], []) for _ in range(WORD_CHARS + 2)]
        self.length = np.empty(len(words), np.int64)
        for i, word in enumerate(words):
            marked = WORD_START + word
            n = self.length[i] = len(marked)
            for end in range(1, n + 1):
                w, s, p = by_end[end]
                for start in range(max(0, end - longest), end):
                    piece = get(marked[start:end])
                    if piece is None:
                        if start < end - 1:
                            continue
                        piece = other
                    w.append(i)
                    s.append(start)
                    p.append(piece)
        self.edges = [tuple(np.array(x, np.int64) for x in e) for e in by_end]

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """alpha (words, positions, languages) for prob (pieces, languages)."""
        alpha = np.zeros((len(self.length), WORD_CHARS + 2, prob.shape[1]))
        alpha[:, 0] = 1
        for end, (w, s, p) in enumerate(self.edges):
            if len(w):
                at = np.flatnonzero(np.diff(w, prepend=-1))
                alpha[w[at], end] = np.add.reduceat(alpha[w, s] * prob[p], at, axis=0)
        return alpha

    def totals(self, prob: np.ndarray) -> np.ndarray:
        return self.forward(prob)[np.arange(len(self.length)), self.length]

    def expected(self, prob: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected piece counts (pieces, languages) for word counts (words, languages)."""
        alpha = self.forward(prob)
        rows = np.arange(len(self.length))
        beta = np.zeros_like(alpha)
        beta[rows, self.length] = counts / alpha[rows, self.length]
        out = np.zeros_like(prob)
        for end in range(len(self.edges) - 1, 0, -1):
            w, s, p = self.edges[end]
            if len(w):
                np.add.at(out, p, alpha[w, s] * prob[p] * beta[w, end])
                np.add.at(beta, (w, s), prob[p] * beta[w, end])
        return out


def fit(df: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAIN_ROWS, rounds: int = ROUNDS) -> dict:
    """Learns from rows with text, language and key. Returns {"languages", "prob" (pieces, languages), "prior" (log)}.

    About `rows` rows a language are used (all, where it has fewer). What reaches the driver is bounded by languages x
    vocabulary. Without any labelled row the model is empty and predicts `und`.
    """
    from .common import settle

    labelled = df.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.col(key).alias("k")).dropna()
    counts = {r["l"]: r["count"] for r in labelled.groupBy("l").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    n_pieces = len(pieces(vocabulary)[0]) + 1
    languages = sorted(counts)
    if not languages:
        return {"languages": [], "prob": np.zeros((n_pieces, 0)), "prior": np.zeros(0)}
    share = F.create_map(*[F.lit(x) for i, c in enumerate(languages) for x in (c, float(min(1.0, rows / counts[c])))])
    number = F.create_map(*[F.lit(x) for i, c in enumerate(languages) for x in (c, i)])
    chosen = F.pmod(F.xxhash64(F.lit("train"), "k"), F.lit(1_000_003)) < F.element_at(share, F.col("l")) * 1_000_003
    sample = settle(labelled.where(chosen).select("t", F.element_at(number, F.col("l")).alias("l")))
    prob = np.full((n_pieces, len(languages)), 1.0 / n_pieces)
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], prob=prob) -> Iterator[pa.RecordBatch]:
            out = np.zeros_like(prob)
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    seen: dict[str, Counter] = {}
                    for t, i in zip(batch.column(0)[at : at + 200].to_pylist(), batch.column(1)[at : at + 200].to_pylist(), strict=True):
                        for w, c in Counter(words_of(t)).items():
                            seen.setdefault(w, Counter())[i] += c
                    words = list(seen)
                    step = words_at_once(prob.shape[1])
                    for lo in range(0, len(words), step):
                        part = words[lo : lo + step]
                        held = np.zeros((len(part), prob.shape[1]))
                        for r, w in enumerate(part):
                            for i, c in seen[w].items():
                                held[r, i] = c
                        out += Lattice(part, vocabulary).expected(prob, held)
            p, i = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(i), pa.array(out[p, i])], names=["p", "i", "x"])

        found = sample.mapInArrow(expect, "p long, i long, x double").groupBy("p", "i").agg(F.sum("x").alias("x")).toPandas()
        prob = np.full_like(prob, SMOOTHING)
        prob[found["p"].to_numpy(), found["i"].to_numpy()] += found["x"].to_numpy()
        prob /= prob.sum(axis=0)
    total = np.array([counts[c] for c in languages], float)
    return {"languages": languages, "prob": prob, "prior": np.log(total / total.sum())}


class Scorer(dict):
    """Log probabilities of words in every language; remembers a bounded number of words."""

    def __init__(self, model: dict, vocabulary: str):
        super().__init__()
        self.model, self.vocabulary = model, vocabulary
        self.scores = np.empty((0, len(model["languages"])))

    def learn(self, words: set[str]) -> None:
        if len(self) + len(words) > WORDS_REMEMBERED:
            self.clear()
            self.scores = self.scores[:0]
        new = [w for w in words if w not in self]
        parts = [self.scores]
        step = words_at_once(self.scores.shape[1])
        for at in range(0, len(new), step):
            part = new[at : at + step]
            parts.append(np.log(Lattice(part, self.vocabulary).totals(self.model["prob"])))
            for w in part:
                self[w] = len(self)
        self.scores = np.concatenate(parts)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        languages, out = self.model["languages"], []
        for at in range(0, len(texts), 100):
            part = [words_of(t) if t and languages and LETTER.search(t) else None for t in texts[at : at + 100]]
            unknown = {w for words in part if words for w in words if w not in self}
            if unknown:
                self.learn({w for words in part if words for w in words} if len(self) + len(unknown) > WORDS_REMEMBERED else unknown)
            for words in part:
                if words is None:
                    out.append((UNDETERMINED, 0.0))
                    continue
                total = self.model["prior"] + self.scores[np.fromiter(map(self.__getitem__, words), np.int64, len(words))].sum(axis=0)
                best = int(total.argmax())
                out.append((languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def identify(df: DataFrame, model: dict, vocabulary: str, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds `lang_pred` and `score`, the posterior of that language (0 to 1), for every whole text.

    `und` and 0 where the text is null, empty or has no letter. Ties go to the first language by name. Equal texts get
    equal results. Other columns stay; namesakes of the two are replaced. No shuffle; the model is broadcast (its size is
    bounded by vocabulary x languages).
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c not in (lang_pred, score)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value, vocabulary)
        for batch in batches:
            found = scorer.predict(batch.column(batch.schema.get_field_index(text)).to_pylist())
            made = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + made, names=[*kept, lang_pred, score])

    return df.mapInArrow(run, schema)
