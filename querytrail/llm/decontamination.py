"""Operator 1: benchmark passages in documents, found in a latent space and then verified."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from itertools import batched, chain, repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import drop_folder, scratch_path, spread, stored
from .tables import chunks, col, map_texts, read

WINDOW, STRIDE = 64, 32  # words of a passage, and from one to the next
# Items longer than WINDOW are judged piece by piece too. From one piece to the next are fewer
# words than twice what VERBATIM lets go, so any WINDOW words of an item hold enough of a piece.
PIECE_STRIDE = 24
BLOCK_CHARS = 120_000    # benchmark text that shares a latent space
PASS_BLOCKS = 8          # latent spaces searched in one pass over the documents
RANK, OVERSAMPLING, ROUNDS = 192, 16, 2
FIT_TASKS = 4            # that the rows of a block's space are spread over
BLOCK_PASSAGES = 330     # passages of a block that RANK serves; the rank of more grows alike
# All distinct texts help to fit the spaces: their rows have this weight against those of the
# benchmark. From so many documents on, all together weigh as that many do.
TEXT_WEIGHT, FULL_WEIGHT_DOCUMENTS = 0.1, 2000
# Terms in more than COMMON of all documents (and COMMON_LEAST more) carry no weight in the
# space. Items that this leaves too few terms are searched by all their words (Frequent).
COMMON, COMMON_LEAST = 0.1, 50
LEAST_TERMS = 2          # weighted terms in a passage that is searched
# A passage is a candidate from this cosine on, if its part along the item's vector has at
# least this share of its length: half an item in a passage gives half.
COSINE, CONTAINED = 0.3, 0.4
VERBATIM = 0.8           # share of an item's words found in order: contaminated at once
PARAPHRASE, ANSWER = 0.65, 0.8  # less of the item, if so much of its answer is there
# Fewer words than SHORT stand in many texts by chance. Such an item counts where it is a whole
# line, and not even there with fewer than SHORT_LINE words ("True", "Yes").
SHORT, SHORT_LINE = 8, 3
SLAB = 4_000_000         # cosines held at once
CHUNK_BYTES = 300_000    # of coded texts that are worked on at once
LAYERS = 16              # rows of a run that are added one after the other
RUNS = 512               # runs that are summed at once, so that their sums stay in the cache
WORD = re.compile(r"\w+")
# What WORD takes of ASCII, in lower case; the rest as blanks.
ASCII_WORDS = "".join(c.lower() if WORD.match(c) else " " for c in map(chr, range(128)))
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def spaced(texts: Sequence[str]) -> list[str]:
    """The words of each text (as ``words_of`` finds them) between blanks."""
    out = [t.translate(ASCII_WORDS) if t.isascii() else t.lower() for t in texts]
    wide = [i for i, t in enumerate(texts) if not t.isascii()]
    if wide:
        points = np.frombuffer("".join(out[i] for i in wide).encode("utf-32-le"), "<u4")
        kept = np.arange(points.max() + 1, dtype="<u4")
        kept[[c for c in np.unique(points).tolist() if not WORD.match(chr(c))]] = ord(" ")
        blanked, begin = kept[points].tobytes().decode("utf-32-le"), 0
        for i in wide:
            end = begin + len(out[i])
            out[i], begin = blanked[begin:end], end
    return out


def answer_of(text: str) -> list[str]:
    """The default answer of an item: the words of its last sentence, if it has several."""
    sentences = [s for s in SENTENCE.split(text.strip()) if words_of(s)]
    return words_of(sentences[-1]) if len(sentences) > 1 else []


class Item(NamedTuple):
    item: str            # digest of text and answer, which equal items share
    words: list          # as texts, or as the codes of a pass
    answer: list
    whole: int           # its number in the block, or that of the item it is a piece of


class Frequent(NamedTuple):
    """Items of like length with too few weighted terms, to be found by the words they hold."""
    items: np.ndarray    # their numbers
    vocabulary: dict[str, int]
    words: np.ndarray    # terms x items, 1 where the item has the word
    least: np.ndarray    # distinct words of the item that a stretch with it must hold
    stride: int          # any two item lengths lie within a stretch of two strides


class Space(NamedTuple):
    """A block of items with its weighted vocabulary and latent basis."""
    items: list[Item]
    vocabulary: dict[str, int]
    basis: np.ndarray    # terms x rank, each row times the term's weight
    vectors: np.ndarray  # items' passages x rank
    owner: np.ndarray    # item of each passage
    frequent: list[Frequent]


def numbered(found: Sequence[Sequence], vocabulary: dict) -> np.ndarray:
    """The numbers of the words of all texts, -1 for other words. Codes in arrays are looked up
    in a table."""
    if not len(found) or not isinstance(found[0], np.ndarray):
        return np.fromiter(map(vocabulary.get, chain.from_iterable(found), repeat(-1)), np.int64)
    flat = np.concatenate(found)
    known = np.fromiter(vocabulary, np.int64, len(vocabulary))
    table = np.full(max(known.max(initial=0), flat.max(initial=0)) + 1, -1)
    table[known] = np.fromiter(vocabulary.values(), np.int64, len(vocabulary))
    return table[flat]


def strides(found: Sequence[Sequence[str]], vocabulary: dict[str, int], stride: int
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted terms of the strides of several texts, in order.

    Gives for every term its stride and its number, and for every stride its text and the
    place of its first word.
    """
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    steps = np.maximum(1, -(-sizes // stride))
    offsets = np.cumsum(steps) - steps
    flat = numbered(found, vocabulary)
    hit = np.flatnonzero(flat >= 0)
    text = np.repeat(np.arange(len(sizes)), sizes)[hit]
    here = offsets[text] + (hit - (np.cumsum(sizes) - sizes)[text]) // stride
    stride_text = np.repeat(np.arange(len(sizes)), steps)
    return here, flat[hit], stride_text, (np.arange(steps.sum()) - offsets[stride_text]) * stride


def run_sums(matrix: np.ndarray, numbers: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of the rows ``numbers`` of a matrix, over the runs that start at ``begins``.

    The first rows of many runs are taken at once, then the second rows and so on, which is
    several times faster than ``np.add.reduceat``. Long runs are summed in parts first.
    """
    sizes = np.diff(np.append(begins, len(numbers)))
    if sizes.max(initial=0) > LAYERS:
        parts = -(-sizes // LAYERS)
        firsts = np.cumsum(parts) - parts
        within = np.arange(parts.sum()) - np.repeat(firsts, parts)
        sums = run_sums(matrix, numbers, np.repeat(begins, parts) + LAYERS * within)
        return run_sums(sums, np.arange(len(sums)), firsts)
    order = np.argsort(-sizes, kind="stable")
    out = np.empty((len(order), matrix.shape[1]), matrix.dtype)
    added = np.empty((min(RUNS, len(order)), matrix.shape[1]), matrix.dtype)
    for low in range(0, len(order), RUNS):
        own = order[low:low + RUNS]
        starts, falling = begins[own], -sizes[own]
        sums = matrix[numbers[starts]]
        for j in range(1, -falling[0]):
            live = np.searchsorted(falling, -j)
            np.take(matrix, numbers[starts[:live] + j], axis=0, out=added[:live], mode="clip")
            sums[:live] += added[:live]
        out[own] = sums
    return out


def passages(found: Sequence[Sequence[str]], vocabulary: dict[str, int], stride: int = STRIDE
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted terms of the passages of several texts, ordered by passage.

    Gives for every term its passage and its number, and for every passage its text and the
    place of its first word. A passage has two strides; every word lies in two passages, but
    for the first stride.
    """
    here, numbers, text, first = strides(found, vocabulary, stride)
    both, terms = paired(here, numbers, first)
    order = np.argsort(both, kind="stable")
    return both[order], terms[order], text, first


def paired(here: np.ndarray, numbers: np.ndarray, first: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray]:
    """Passage and number of the terms of strides, in no order: each lies in two passages."""
    again = first[here] > 0
    return np.concatenate([here, here[again] - 1]), np.concatenate([numbers, numbers[again]])


def projected(found: Sequence[Sequence[str]], vocabulary: dict[str, int], basis: np.ndarray,
              least: int = LEAST_TERMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latent vectors of all passages with ``least`` terms; their texts and places.

    Every stride is summed once; a passage is the sum of its two strides.
    """
    here, numbers, text, first = strides(found, vocabulary, STRIDE)
    some, begins, sizes = np.unique(here, return_index=True, return_counts=True)
    if not len(some):
        return np.empty((0, basis.shape[1]), np.float32), text[:0], first[:0]
    own = run_sums(basis, numbers, begins)
    later = first[some] > 0
    at = np.union1d(some, some[later] - 1)
    vectors, counts = np.zeros((len(at), basis.shape[1]), np.float32), np.zeros(len(at), np.int64)
    for place, part, n in ((np.searchsorted(at, some), own, sizes),
                           (np.searchsorted(at, some[later] - 1), own[later], sizes[later])):
        vectors[place] += part
        counts[place] += n
    keep = (counts >= least) & vectors.any(axis=1)
    return vectors[keep], text[at[keep]], first[at[keep]]


def common_subsequence(masks: dict[str, int], size: int, words: Sequence[str]) -> int:
    """Length of the longest common subsequence; ``masks`` has each word's places as bits."""
    state = full = (1 << size) - 1
    for word in words:
        places = masks.get(word)
        if places:
            shared = state & places
            state = ((state + shared) | (state - shared)) & full
    return size - state.bit_count()


def masks_of(words: Sequence[str]) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, word in enumerate(words):
        masks[word] = masks.get(word, 0) | 1 << i
    return masks


class Check(NamedTuple):
    size: int
    masks: dict[str, int]
    answer_size: int
    answer_masks: dict[str, int]


def check_of(item: Item) -> Check:
    return Check(len(item.words), masks_of(item.words), len(item.answer), masks_of(item.answer))


def verified(check: Check, words: Sequence[str], first: int) -> tuple[float, float] | None:
    """Shares of item and answer found around a passage, if they make it contaminated.

    The item may begin up to its own length before the passage and end as much after it. What
    is found must lie within twice the item's length, so that words scattered over a long
    stretch do not add up.
    """
    n = check.size
    return judged(check, words[max(0, first - n):first + WINDOW + n])


def judged(check: Check, region: Sequence[str]) -> tuple[float, float] | None:
    """The best shares of item and answer in a region, if they make it contaminated."""
    n = check.size
    # No more words are in order than there are at all.
    if sum(check.masks[w].bit_count() for w in check.masks.keys() & set(region)) < PARAPHRASE * n:
        return None
    if common_subsequence(check.masks, n, region) < PARAPHRASE * n:
        return None
    best = None
    for k in range(0, max(1, len(region) - n), max(1, n // 2)):
        part = region[k:k + 2 * n]
        found = common_subsequence(check.masks, n, part)
        if found < PARAPHRASE * n or (best and found / n < best[0]):
            continue
        answer = (common_subsequence(check.answer_masks, check.answer_size, part)
                  / check.answer_size) if check.answer_size else 0.0
        if (found / n >= VERBATIM or answer >= ANSWER) and (
                best is None or (found / n, answer) > best):
            best = found / n, answer
    return best


def unmatched(size: int) -> int:
    """Words of an item that a contaminated document may lack."""
    return int(size - np.ceil(PARAPHRASE * size))


def frequent(items: Sequence[Item], weighted: dict[str, int]) -> list[Frequent]:
    """Items of which a paraphrase may keep fewer than LEAST_TERMS weighted terms.

    So are all whose words are common, as those of an item that many documents hold. What
    lacks so many words of an item lacks at most as many distinct ones, so a stretch without
    ``least`` of them cannot hold the item, and no other is left out.
    """
    by_stride: dict[int, list[int]] = {}
    for i, item in enumerate(items):
        size = len(item.words)
        if size >= SHORT and sum(w in weighted for w in item.words) - unmatched(size) < LEAST_TERMS:
            by_stride.setdefault(max(STRIDE, 2 << (size - 1).bit_length()), []).append(i)
    out = []
    for stride, numbers in sorted(by_stride.items()):
        sets = [set(items[i].words) for i in numbers]
        vocabulary = {w: k for k, w in enumerate(sorted(set().union(*sets)))}
        words = np.zeros((len(vocabulary), len(numbers)), np.float32)
        for k, own in enumerate(sets):
            words[[vocabulary[w] for w in own], k] = 1
        least = np.array([max(1, len(own) - unmatched(len(items[i].words)))
                          for i, own in zip(numbers, sets, strict=True)], np.float32)
        out.append(Frequent(np.array(numbers), vocabulary, words, least, stride))
    return out


def holding(found: Sequence[Sequence[str]], group: Frequent) -> Iterator[tuple[int, int, int]]:
    """Text, item and first word of every stretch with enough distinct words of an item."""
    at, numbers, text, first = passages(found, group.vocabulary, group.stride)
    some, begins = np.unique(at, return_index=True)
    bounds = np.append(begins, len(at))
    rows = max(1, SLAB // max(group.words.shape))
    for low in range(0, len(some), rows):
        part = some[low:low + rows]
        own = slice(bounds[low], bounds[low + len(part)])
        held = np.zeros((len(part), len(group.vocabulary)), np.float32)
        held[np.searchsorted(part, at[own]), numbers[own]] = 1
        row, item = np.nonzero(held @ group.words >= group.least)
        for r, i in zip(part[row].tolist(), group.items[item].tolist(), strict=True):
            yield int(text[r]), i, int(first[r])


def lines_of(items: Iterable[Item]) -> dict[tuple[str, ...], list[str]]:
    """The items of few words by their words: they are found as whole lines."""
    lines: dict[tuple[str, ...], list[str]] = {}
    for item in items:
        if SHORT_LINE <= len(item.words) < SHORT:
            lines.setdefault(tuple(item.words), []).append(item.item)
    return lines


def as_lines(text: str, lines: dict[tuple[str, ...], list[str]]) -> list[str]:
    """The items whose words, and no others, a line of the text has."""
    if not lines:
        return []
    return sorted({item for line in text.split("\n") for item in lines.get(tuple(words_of(line)), ())})


def matches(found: Sequence[Sequence], spaces: Sequence[Space], checks: Sequence[Sequence[Check]],
            cosine: float = COSINE) -> Iterator[tuple[int, Item, float, float, float]]:
    """Text, item, cosine and both shares for every item found in a text, given by its words.

    The cosine is None where only the words of a frequent item led to it.
    """
    bodies: dict[int, list] = {}

    def body(t: int) -> list:
        if t not in bodies:
            bodies[t] = found[t].tolist() if isinstance(found[t], np.ndarray) else found[t]
        return bodies[t]

    for space, own in zip(spaces, checks, strict=True):
        vectors, text, first = projected(found, space.vocabulary, space.basis)
        best: dict[tuple[int, int], tuple] = {}
        tried: set[tuple[int, int, int]] = set()
        lengths = np.linalg.norm(space.vectors, axis=1)
        rows = max(1, SLAB // max(1, len(space.vectors)))
        for low in range(0, len(vectors), rows):
            part = vectors[low:low + rows]
            own_lengths = np.linalg.norm(part, axis=1)
            products = part @ space.vectors.T
            at, passage = np.nonzero(products >= CONTAINED * lengths ** 2)
            near = products[at, passage] >= cosine * own_lengths[at] * lengths[passage]
            at, passage = at[near], passage[near]
            for a, p in zip(at.tolist(), passage.tolist(), strict=True):
                t, i = int(text[low + a]), int(space.owner[p])
                if (t, i, place := int(first[low + a])) in tried:
                    continue
                tried.add((t, i, place))
                pair = t, space.items[i].whole
                shares = verified(own[i], body(t), place)
                if shares and shares > best.get(pair, (0.0, 0.0, 0.0))[1:]:
                    best[pair] = (float(products[a, p] / own_lengths[a] / lengths[p]), *shares)
        for group in space.frequent:
            for t, i, place in holding(found, group):
                shares = judged(own[i], body(t)[place:place + 2 * group.stride])
                pair = t, space.items[i].whole
                old = best.get(pair, (None, 0.0, 0.0))
                if shares and shares > old[1:]:
                    best[pair] = (old[0], *shares)
        for (t, i), value in best.items():
            yield t, space.items[i], *value


def coded(rows: DataFrame, codes: dict[str, int], lines: dict[tuple[str, ...], list[str]]
          ) -> DataFrame:
    """``__key, digest``, the words of ``text`` as codes (0: of no item) and the short items.

    ``codes`` numbers its words from 1 on, in their order. Texts are split into words once a pass; the fit and the search read the codes.
    """
    words = list(codes)

    def work(texts: list[str]) -> dict[str, list]:
        return {"codes": codes_of(texts, words), "lines": [as_lines(t, lines) for t in texts]}

    return map_texts(rows, work, "codes binary, lines array<string>", ("__key", "digest"))


def codes_of(texts: Sequence[str], words: Sequence[str]) -> list[bytes]:
    """The words of each text as codes: places among ``words`` from 1 on, 0 for all others."""
    bodies = pc.ascii_trim(pa.array(spaced(texts), pa.large_string()), " ")
    split = pc.ascii_split_whitespace(bodies)
    places = pc.index_in(split.values, pa.array(words, split.type.value_type))
    kind = code_type(len(words))
    raw = (pc.fill_null(places, -1).to_numpy() + 1).astype(kind).tobytes()
    bounds = (split.offsets.to_numpy() * kind.itemsize).tolist()
    # An empty text is split into one empty word.
    return [raw[begin:end] if full else b"" for begin, end, full in zip(
        bounds, bounds[1:], pc.greater(pc.binary_length(bodies), 0).to_pylist(), strict=False)]


def code_type(n: int) -> np.dtype:
    return np.dtype("<u2" if n < 1 << 16 else "<u4")


def document_frequencies(coded_docs: DataFrame, n_codes: int) -> dict[int, int]:
    """In how many documents each code occurs; the number of documents under 0."""
    kind = code_type(n_codes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n_codes + 1, np.int64)
        for batch in batches:
            total[0] += len(batch)
            for codes in batch["codes"]:
                own = np.unique(np.frombuffer(codes, kind))
                total[own[own > 0]] += 1
        used = np.flatnonzero(total)
        yield pd.DataFrame({"term": used, "n": total[used]})

    partial = coded_docs.select("codes").mapInPandas(count, "term long, n long")
    return {r.term: r.n for r in partial.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def moments(found: Sequence[Sequence], vocabulary: dict, idf: np.ndarray, base: np.ndarray,
            total: np.ndarray) -> None:
    """Adds A'A ``base`` to ``total``, where A has the texts' TF-IDF passages as unit rows.

    A passage is the sum of its two strides, so every word is gathered once on the way to the
    passages and once on the way back.
    """
    here, numbers, _, first = strides(found, vocabulary, STRIDE)
    if not len(here):
        return
    at, terms = paired(here, numbers, first)
    cells, counts = np.unique(at * len(idf) + terms, return_counts=True)
    squares = np.bincount(cells // len(idf), (counts * idf[cells % len(idf)]) ** 2, len(first))
    some, begins = np.unique(here, return_index=True)
    sums = np.zeros((len(first), base.shape[1]), base.dtype)
    sums[some] = run_sums(base * idf[:, None].astype(base.dtype), numbers, begins)
    follows = (first[1:, None] > 0).astype(base.dtype)
    whole = sums.copy()
    whole[:-1] += sums[1:] * follows
    whole *= np.divide(1.0, squares, out=np.zeros(len(first)), where=squares > 0
                       ).astype(base.dtype)[:, None]
    back = whole.copy()
    back[1:] += whole[:-1] * follows
    order = np.argsort(numbers, kind="stable")
    used, begins = np.unique(numbers[order], return_index=True)
    added = np.zeros(total.shape, base.dtype)
    added[used] = run_sums(back, here[order], begins)
    total += idf[:, None] * added


def document_rows(texts: DataFrame, n_codes: int, vocabulary: dict[int, int], idf: np.ndarray,
                  base: np.ndarray) -> np.ndarray:
    """Rows R such that R'R stands for A'A, A having the passages of all ``texts`` as unit rows.

    One pass: every task multiplies its own passages with ``base`` (terms x rank) and back, and
    Spark adds the products by term. R'R equals A'A along ``base`` (Nystroem's approximation).
    """
    n_terms, width = base.shape
    kind, narrow = code_type(n_codes), base.astype(np.float32)
    names = [f"v{i}" for i in range(width)]
    schema = "term int, " + ", ".join(f"{n} float" for n in names)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n_terms, width))
        for batch in batches:
            codes = batch["text"].tolist()
            for begin, end in chunks(codes, CHUNK_BYTES):
                moments([np.frombuffer(c, kind) for c in codes[begin:end]],
                        vocabulary, idf, narrow, total)
        used = np.flatnonzero(total.any(axis=1))
        out = pd.DataFrame(total[used].astype(np.float32), columns=names)
        out.insert(0, "term", used.astype(np.int32))
        yield out

    # As many products as cores, however many files there are.
    tasks = spread(texts).coalesce(texts.sparkSession.sparkContext.defaultParallelism)
    product = np.zeros((n_terms, width))
    for r in tasks.mapInPandas(multiply, schema).groupBy("term").agg(
            *[F.sum(n).alias(n) for n in names]).collect():
        product[r[0]] = r[1:]
    inner = base.T @ product
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    keep = values > max(1e-6 * values.max(), 1e-12)
    return ((product @ turn[:, keep]) / np.sqrt(values[keep])).T


def randomised_svd(rows: DataFrame, n_terms: int, rank: int) -> np.ndarray:
    """Right singular vectors (terms x rank) of a matrix whose rows Spark holds.

    ``rows`` has ``terms`` (each once) and ``weights`` arrays. Each round, every task multiplies its own
    rows with the broadcast range (terms x rank) and back, Spark adds the tasks' products by
    term, and the driver makes the sum orthonormal; only matrices of terms x rank move.
    """
    width = min(rank + OVERSAMPLING, n_terms)
    names = [f"v{i}" for i in range(width)]
    schema = "term int, " + ", ".join(f"{n} double" for n in names)

    def product(base: np.ndarray) -> np.ndarray:
        def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((n_terms, width))
            for batch in batches:
                for terms, weights in zip(batch["terms"], batch["weights"], strict=True):
                    total[terms] += np.outer(weights, weights @ base[terms])
            used = np.flatnonzero(total.any(axis=1))
            out = pd.DataFrame(total[used], columns=names)
            out.insert(0, "term", used.astype(np.int32))
            yield out

        added = rows.mapInPandas(multiply, schema).groupBy("term").agg(
            *[F.sum(n).alias(n) for n in names])
        out = np.zeros((n_terms, width))
        for r in added.collect():
            out[r[0]] = r[1:]
        return out

    rng = np.random.default_rng(7)
    base = np.linalg.qr(rng.standard_normal((n_terms, width)))[0]
    for _ in range(ROUNDS):
        base = np.linalg.qr(product(base))[0]
    values, turn = np.linalg.eigh(base.T @ product(base))
    order = np.argsort(-values)[:rank]
    return base @ turn[:, order[values[order] > 1e-9 * values.max()]]


def rank_for(n_passages: int) -> int:
    """The rank of a block's space: hashing may give it more than BLOCK_PASSAGES."""
    return max(RANK, -(-n_passages * RANK // BLOCK_PASSAGES))


def sample_of(docs: DataFrame, text: str, n_docs: int | None = None) -> DataFrame:
    """The texts that help to fit every space: all distinct ones, written once for all blocks.

    Nothing is drawn, whatever the number of documents. Copies are merged where they are read,
    before the shuffle.
    """
    return stored(docs.where(col(text).isNotNull()).select(
        col(text).alias("text")).dropDuplicates())


def fitted(texts: DataFrame, n_codes: int, items: list[Item], seen: dict[int, int]) -> Space:
    """Weights from the frequencies over all documents, and the latent space of one block.

    The space is that of the items' passages and, with less weight, of the passages of all
    distinct ``texts``. Short items take no part in it: they are looked up as lines.
    """
    n_docs = seen.get(0, 0)
    words = [item.words if len(item.words) >= SHORT else [] for item in items]
    terms = sorted({w for own in words for w in own
                    if seen.get(w, 0) <= COMMON_LEAST + COMMON * n_docs})
    vocabulary = {w: i for i, w in enumerate(terms)}
    if not terms:
        return Space(items, {}, np.zeros((0, 1), np.float32), np.zeros((0, 1), np.float32),
                     np.zeros(0, np.int64), frequent(items, vocabulary))
    idf = np.array([np.log((1 + n_docs) / (1 + seen.get(w, 0))) + 1 for w in terms])

    at, numbers, _, _ = passages(words, vocabulary)
    begins = np.unique(at, return_index=True)[1]
    rows = []
    for part in np.split(numbers, begins[1:]):
        distinct, counts = np.unique(part, return_counts=True)
        weights = counts * idf[distinct]
        rows.append((distinct, weights / np.linalg.norm(weights)))

    # The texts are summed up along the leading directions of the items.
    rank = rank_for(len(rows))
    base = np.random.default_rng(7).standard_normal(
        (len(terms), min(rank + OVERSAMPLING, len(terms))))
    for _ in range(ROUNDS):
        turned = np.zeros_like(base)
        moments(words, vocabulary, idf, np.linalg.qr(base)[0], turned)
        base = np.linalg.qr(turned)[0]
    weight = TEXT_WEIGHT * np.sqrt(min(1.0, FULL_WEIGHT_DOCUMENTS / max(1, n_docs)))
    rows += [(np.flatnonzero(r), weight * r[r != 0])
             for r in document_rows(texts, n_codes, vocabulary, idf, base)]
    local = pa.table({"terms": pa.array([t for t, _ in rows], pa.list_(pa.int32())),
                      "weights": pa.array([w for _, w in rows], pa.list_(pa.float64()))})
    rows = stored(texts.sparkSession.createDataFrame(local).coalesce(FIT_TASKS))
    basis = (randomised_svd(rows, len(terms), rank) * idf[:, None]).astype(np.float32)
    vectors, owner, _ = projected(words, vocabulary, basis, least=1)
    return Space(items, vocabulary, basis, vectors, owner, frequent(items, vocabulary))


def keyed_items(benchmark: DataFrame, text: str, key: str, answer: str | None) -> DataFrame:
    """``key, text, answer, item`` of every item with a text; equal items share ``item``."""
    given = F.coalesce(col(answer) if answer else F.lit(None).cast("string"), F.lit(""))
    return benchmark.where(col(text).isNotNull()).select(
        col(key).alias("key"), col(text).alias("text"), given.alias("answer"),
        F.md5(F.concat(col(text), F.lit("\0"), given).cast("binary")).alias("item"))


def item_blocks(keyed: DataFrame) -> Iterator[list[Item]]:
    """The distinct items in blocks of about BLOCK_CHARS or BLOCK_PASSAGES, whichever is less.

    PASS_BLOCKS of them are fetched at a time, so the driver never holds the whole benchmark.
    The pieces of a long item follow it; they have no answer. A given answer makes up for the
    words that a short item lacks: both together are then the item.
    """
    words = F.size(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0)))
    rows = stored(keyed.select("item", "text", "answer").dropDuplicates(["item"]))
    sizes = rows.agg(
        F.sum(F.length("text")).alias("chars"),
        F.sum(F.ceil(words / STRIDE) + F.when(
            words > WINDOW, 2 + 2 * F.ceil((words - WINDOW) / PIECE_STRIDE)).otherwise(0))
        .alias("passages")).first()
    n = max((sizes.chars or 0) // BLOCK_CHARS, (sizes.passages or 0) // BLOCK_PASSAGES) + 1
    placed = rows.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n)))
    for low in range(0, n, PASS_BLOCKS):
        blocks: dict[int, list[Item]] = {}
        for r in placed.where(F.col("block").between(low, low + PASS_BLOCKS - 1)).orderBy(
                "block", "item").collect():
            own, answered = words_of(r.text), words_of(r.answer)
            if 0 < len(own) < SHORT:
                own = own + answered
            if own:
                block = blocks.setdefault(r.block, [])
                whole, last = len(block), len(own) - WINDOW
                block.append(Item(r.item, own, answered or answer_of(r.text), whole))
                block += [Item(r.item, own[k:k + WINDOW], [], whole)
                          for k in ([*range(0, last, PIECE_STRIDE), last] if last > 0 else ())]
        yield from blocks.values()


def searched(rows: DataFrame, blocks: Sequence[list[Item]], added: str) -> DataFrame:
    """``__key, digest`` and what is found of the items of one pass, written as a table."""
    spark = rows.sparkSession
    words = sorted({w for b in blocks for i in b for w in (*i.words, *i.answer)})
    codes = {w: k for k, w in enumerate(words, 1)}
    path = scratch_path(spark, "codes")
    coded(rows if words else rows.where(F.lit(False)), codes,
          lines_of(chain.from_iterable(blocks))).write.parquet(path)
    pass_rows = spark.read.parquet(path)
    texts = sample_of(pass_rows, "codes")
    seen = document_frequencies(pass_rows, len(codes))
    spaces = [fitted(texts, len(codes), [i._replace(
        words=[codes[w] for w in i.words], answer=[codes[w] for w in i.answer])
        for i in items], seen) for items in blocks]
    checks = [[check_of(item) for item in space.items] for space in spaces]
    kind = code_type(len(codes))

    schema = T.StructType([*pass_rows.select("__key", "digest").schema.fields,
                           *T._parse_datatype_string(added).fields])
    arrow = to_arrow_schema(schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column("codes").to_pylist()
            found = [[{"item": item, "cosine": None, "item_share": 1.0, "answer_share": 0.0}
                      for item in own] for own in batch.column("lines").to_pylist()]
            for begin, end in chunks(bodies, CHUNK_BYTES):
                for t, item, cosine, share, answered in matches(
                        [np.frombuffer(c, kind) for c in bodies[begin:end]], spaces, checks):
                    found[begin + t].append({"item": item.item, "cosine": cosine,
                                             "item_share": share, "answer_share": answered})
            some = pa.array([i for i, f in enumerate(found) if f], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name).take(some) for name in ("__key", "digest")),
                 pa.array([f for f in found if f], arrow.field("found").type)], schema=arrow)

    hits = stored(pass_rows.mapInArrow(search, schema).select(
        "__key", "digest", F.explode("found").alias("f")))
    drop_folder(spark, path)
    return hits


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id",
               item_text: str = "text", item_key: str = "item_id",
               answer: str | None = None) -> DataFrame:
    """``key, digest, item_id, cosine, item_share, answer_share`` for each item in a document.

    The benchmark is the stated query set: it is searched in blocks of bounded size, PASS_BLOCKS
    of them in one pass over the documents. A block's terms are weighted by their document
    frequency over all documents; a randomised SVD over its TF-IDF passages, together with
    those of all distinct texts, gives the latent space. Every passage of every
    document is projected and compared with the items; passages above the cosine threshold
    are verified: VERBATIM of the item's words must be there in order, or PARAPHRASE of them
    and ANSWER of its answer (the ``answer`` column, else the last sentence of the item).
    Of an item longer than WINDOW, VERBATIM of one piece of WINDOW words is enough, and
    ``item_share`` is then the share of that piece. Items with too few weighted terms are found
    by the share of their distinct words in a stretch instead, before the same check; their
    cosine may be NULL. An item of fewer than SHORT words is taken together with its given
    answer. If that is still short, it is found only where its words are a whole line of the
    text, and not at all with fewer than SHORT_LINE words, which prove nothing.

    Texts are read once a pass and not shuffled: their words are written as codes, which are
    counted, made distinct for the fit, searched, and dropped. ``digest`` is the text's MD5, by
    which repeated keys can be told apart. NULL and empty texts and items match nothing; equal items
    are searched once, and repeated documents or items are each reported; of several places of
    an item in a text the best counts, ties by the first; an empty table gives no rows; extra
    columns are left out.
    """
    keyed = keyed_items(benchmark, item_text, item_key, answer)
    rows = docs.select(col(key).alias("__key"), col(text).alias("text"),
                       F.md5(col(text).cast("binary")).alias("digest"))
    added = "found array<struct<item: string, cosine: double, item_share: double, answer_share: double>>"
    hits = []
    passes = batched(item_blocks(keyed), PASS_BLOCKS)
    for some in chain([next(passes, ())], passes):
        hits.append(searched(rows, some, added))
    out = reduce(DataFrame.union, hits)
    named = keyed.select("item", F.col("key").alias("item_id"))
    return out.select("__key", "digest", "f.*").join(named, "item").select(
        col("__key").alias(key), "digest", "item_id", "cosine", "item_share", "answer_share")


def op1_latent_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the evidence."""
    return find_leaks(read(spark, folder, "documents"), read(spark, folder, "benchmark")).select(
        "doc_id", "item_id", "cosine", "item_share", "answer_share")
