"""Operator 3: language by unigram pieces, summed over all segmentations of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .tables import map_texts, read

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD_START = "▁"
MOST_PIECE = 12          # longer pieces of the vocabulary are not used
MOST_WORD = 32           # longer words are scored in parts
TRAIN_DOCUMENTS = 1500   # per language: bound of the labelled sample
EM_ROUNDS = 3
SMOOTHING = 0.1          # added to every piece's expected count
UNKNOWN = 1e-9           # chance of a character that no piece covers
UNDETERMINED = "und"
BLOCK = 20_000           # words whose lattices are held at once
LETTERS = re.compile(r"[^\W\d_]+")
HASH_BASE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary(NamedTuple):
    """Pieces as polynomial hashes of their characters, sorted; a piece's id is its place."""
    hashes: np.ndarray
    slots: np.ndarray    # for each value of the hashes' top bits, the first place
    longest: int


def load_vocabulary(path: str = VOCABULARY) -> list[str]:
    """The pieces of a public vocabulary that can occur in lower-case words."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    usable = {p.lower() for p in pieces if len(p) <= MOST_PIECE}
    return sorted(p for p in usable if re.fullmatch(rf"{WORD_START}?(?:[^\W\d_]+)?", p) and p)


def piece_hash(piece: str) -> int:
    """Hash of a piece; ``lattices`` computes the same for all spans of a word."""
    h = 0
    for c in piece:
        h = (h + ord(c) + 1) * int(HASH_BASE) % (1 << 64)
    return h


SLOT_BITS = 18


def vocabulary_of(pieces: Sequence[str]) -> Vocabulary:
    hashes = np.sort(np.array([piece_hash(p) for p in pieces], np.uint64))
    slots = np.searchsorted(hashes >> np.uint64(64 - SLOT_BITS),
                            np.arange((1 << SLOT_BITS) + 1, dtype=np.uint64))
    return Vocabulary(hashes, slots.astype(np.int32), max(map(len, pieces), default=1))


def lookup(v: Vocabulary, h: np.ndarray) -> np.ndarray:
    """Place of each hash in the vocabulary, or -1."""
    place = np.full(h.shape, -1, np.int32)
    if not len(v.hashes):
        return place
    top = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    at, end = v.slots[top], v.slots[top + 1]
    open_ = np.flatnonzero(at < end)
    while len(open_):
        here = at[open_]
        hit = v.hashes[here] == h[open_]
        place[open_[hit]] = here[hit]
        at[open_] += 1
        open_ = open_[~hit & (at[open_] < end[open_])]
    return place


class Lattice(NamedTuple):
    """All pieces in words of one length: ``ids[l - 1][:, i]`` spans characters i to i + l."""
    length: int
    words: np.ndarray    # places of the words
    ids: list[np.ndarray]


def lattices(words: Sequence[str], v: Vocabulary) -> Iterator[Lattice]:
    """Words (their start mark included) by length, with the piece at every span."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        codes = np.array([words[i] for i in own], f"<U{n}").view(np.uint32).reshape(-1, n)
        ids, h = [], None
        for size in range(1, min(v.longest, n) + 1):
            last = codes[:, size - 1:].astype(np.uint64) + np.uint64(1)
            h = (last if h is None else h[:, :-1] + last) * HASH_BASE
            ids.append(lookup(v, h.ravel()).reshape(h.shape))
        yield Lattice(int(n), own, ids)


def forward(lattice: Lattice, chance: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of every prefix: (length + 1) x words x languages.

    ``chance`` is (pieces + 1) x languages; its last row, for no piece, is 0. A character is
    also reachable by itself at the price of an unknown one. MOST_WORD of them still are far
    from underflow, so no logarithms are needed.
    """
    alpha = np.zeros((lattice.length + 1, len(lattice.words), chance.shape[1]))
    alpha[0] = 1
    for j in range(1, lattice.length + 1):
        np.multiply(alpha[j - 1], UNKNOWN, out=alpha[j])
        for size in range(1, min(len(lattice.ids), j) + 1):
            alpha[j] += alpha[j - size] * chance[lattice.ids[size - 1][:, j - size]]
    return alpha


def word_scores(words: Sequence[str], v: Vocabulary, chance: np.ndarray) -> np.ndarray:
    """Log probability of every word in every language, all segmentations summed."""
    out = np.empty((len(words), chance.shape[1]))
    for low in range(0, len(words), BLOCK):
        for lattice in lattices(words[low:low + BLOCK], v):
            out[low + lattice.words] = np.log(forward(lattice, chance)[-1])
    return out


def expected_counts(words: Sequence[str], times: np.ndarray, v: Vocabulary,
                    chance: np.ndarray) -> np.ndarray:
    """How often each piece is used, averaged over all segmentations (one language)."""
    counts = np.zeros(len(v.hashes) + 1)  # the last place gathers what is no piece: nothing
    one = np.append(chance, 0.0)
    for low in range(0, len(words), BLOCK):
        for lattice in lattices(words[low:low + BLOCK], v):
            n = lattice.length
            alpha = forward(lattice, one[:, None])[:, :, 0]
            beta = np.zeros_like(alpha)
            beta[n] = 1
            weight = times[low + lattice.words] / alpha[n]
            for i in range(n - 1, -1, -1):
                beta[i] = beta[i + 1] * UNKNOWN
                for size in range(1, min(len(lattice.ids), n - i) + 1):
                    ids = lattice.ids[size - 1][:, i]
                    step = one[ids] * beta[i + size]
                    beta[i] += step
                    counts += np.bincount(ids + (ids < 0) * len(counts),
                                          alpha[i] * step * weight, len(counts))
    return counts[:-1]


def parts(word: str) -> list[str]:
    """A word with its start mark, cut into parts of at most MOST_WORD characters."""
    marked = WORD_START + word
    return [marked[i:i + MOST_WORD] for i in range(0, len(marked), MOST_WORD)]


def words_in(text: str) -> list[str]:
    """Lower-case words; none where only number signs such as a superscript look like letters."""
    words = LETTERS.findall(text.lower())
    return words if any(w.isalpha() or any(map(str.isalpha, w)) for w in words) else []


class Model(NamedTuple):
    languages: list[str]
    vocabulary: Vocabulary
    chance: np.ndarray   # (pieces + 1) x languages, the last row 0


def scored(texts: list[str], model: Model) -> dict[str, list]:
    """Best language and its share of the total probability for every text."""
    found = [words_in(t) for t in texts]
    sizes = np.array([len(w) for w in found])
    langs = model.languages
    if not len(langs) or not sizes.sum():
        return {"lang_pred": [UNDETERMINED] * len(texts), "score": [0.0] * len(texts)}
    codes, distinct = pd.factorize(np.array([w for ws in found for w in ws], dtype=object))
    pieces = [parts(w) for w in distinct]
    values = word_scores([p for ps in pieces for p in ps], model.vocabulary, model.chance)
    starts = np.cumsum([0, *map(len, pieces)])[:-1]
    by_word = np.add.reduceat(values, starts, axis=0)
    some = np.flatnonzero(sizes)
    firsts = (np.cumsum(sizes) - sizes)[some]
    totals = np.add.reduceat(by_word[codes], firsts, axis=0)
    best = totals.argmax(axis=1)
    score = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
    names, values = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    for i, b, s in zip(some, best, score, strict=True):
        names[i], values[i] = langs[b], float(s)
    return {"lang_pred": names, "score": values}


def fit(labelled: DataFrame, text: str, lang: str, key: str,
        vocabulary: str = VOCABULARY) -> Model:
    """Piece probabilities per language by expectation maximisation.

    Of each language about TRAIN_DOCUMENTS documents, drawn by a hash of their key, are used
    whole; this bound is the only one, and prediction reads everything. Words are counted in
    Spark and each language is fitted in a task of its own.
    """
    rows = labelled.select(F.col(key).alias("key"), F.col(lang).alias("lang"),
                           F.col(text).alias("text")).where("lang is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], vocabulary_of([]), np.zeros((1, 0)))
    share = F.create_map(*[F.lit(x) for name, n in sizes.items()
                           for x in (name, min(1.0, TRAIN_DOCUMENTS / n))])
    draw = F.pmod(F.xxhash64("key", F.length("text")), F.lit(1_000_000)) / 1_000_000
    sample = rows.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text")
    v = vocabulary_of(load_vocabulary(vocabulary))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = batch["text"].fillna("").map(words_in)
            long = pd.DataFrame({"lang": batch["lang"], "word": words}).explode("word").dropna()
            yield long.groupby(["lang", "word"]).size().rename("n").reset_index()

    counted = stored(sample.mapInPandas(split, "lang string, word string, n long")
                     .groupBy("lang", "word").agg(F.sum("n").alias("n")))

    def maximise(own: pd.DataFrame) -> pd.DataFrame:
        cut = [parts(w) for w in own["word"]]
        words = [p for ps in cut for p in ps]
        times = np.repeat(own["n"].to_numpy(float), [len(ps) for ps in cut])
        chance = np.full(len(v.hashes), 1 / len(v.hashes))
        for _ in range(EM_ROUNDS):
            counts = expected_counts(words, times, v, chance) + SMOOTHING
            chance = counts / counts.sum()
        return pd.DataFrame({"lang": [own["lang"].iloc[0]], "chance": [chance]})

    fitted = counted.groupBy("lang").applyInPandas(maximise, "lang string, chance array<double>")
    by_lang = {r.lang: r.chance for r in stored(fitted).collect()}
    langs = sorted(by_lang)  # a language whose sample has no letters cannot be predicted
    chance = np.zeros((len(v.hashes) + 1, len(langs)))
    for i, name in enumerate(langs):
        chance[:-1, i] = by_lang[name]
    return Model(langs, v, chance)


def learnable(key: str) -> Column:
    """Rows a model may learn from: crc32 of the key as text leaves 0 or 2 modulo 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def identify_languages(docs: DataFrame, text: str = "text", lang: str = "lang",
                       key: str = "doc_id", vocabulary: str = VOCABULARY,
                       keep: Sequence[str] = ()) -> DataFrame:
    """``key, held_out, lang_pred, score`` for every document.

    With ``keep``, those columns instead, then ``__lang_pred`` and ``__score``.

    The text's words are scored by summing, with a forward pass, the probabilities of all
    their segmentations into pieces of a fixed public vocabulary; ``score`` is the best
    language's share of the total. Only the model (pieces x languages) is sent to the tasks,
    whose size the vocabulary bounds; there is no shuffle of texts.

    ``lang_pred`` is ``und`` with score 0 if the text is NULL or has no letter, or if there is
    nothing to learn from. Equal scores go to the language first in order. A NULL key is held
    out. Repeated rows get the same answer each, an empty table gives no rows, extra columns
    are left out.
    """
    model = fit(docs.where(learnable(key)), text, lang, key, vocabulary)
    if keep:
        def carried(texts: list[str]) -> dict[str, list]:
            return {f"__{name}": values for name, values in scored(texts, model).items()}

        return map_texts(docs, carried, "__lang_pred string, __score double", keep, text)
    rows = docs.select(F.col(key).alias(key), (~learnable(key)).alias("held_out"),
                       F.col(text).alias(text))
    return map_texts(rows, lambda texts: scored(texts, model), "lang_pred string, score double",
                     (key, "held_out"), text)


def op3_segmentation_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every whole document text."""
    return identify_languages(read(spark, folder, "documents"))
