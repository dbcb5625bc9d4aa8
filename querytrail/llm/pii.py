"""Operator 9: personal data by base patterns and a semi-Markov conditional random field."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .tables import col, least_hashed, map_texts, read

# The base kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
PATTERNS = {
    # No match can begin within a run of digits, so runs are tried once, from their start.
    "ip": re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
MOST_IP_PART = 255
CARD_DIGITS, PHONE_DIGITS = (16, 19), (8, 15)

# The model. A candidate segment has at most so many parts and characters.
MOST_TOKENS = 6
MOST_CHARS = 64
JOINTS = re.compile(r"[\s().-]+")
TRAIN_DOCUMENTS = 400    # bound of the sample the weights are fitted on
TRAIN_ISLANDS = 500
TRAIN_STEPS = 25
LEAST_SEEN = 5           # features rarer than this in the sample are not told apart
RATE, SHRINK = 0.5, 1e-4
MARGIN = 1.0             # log-odds against no entity that an added span must reach
# Islands are stretches of tokens with a digit or an at sign; nothing else can be an entity.
CHUNK = re.compile(r"\S+")
SIGN = re.compile("[0-9@]")
MOST_ISLAND = 64         # tokens whose segments are held at once
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\W\d_]+|\S")
WORD_BEFORE = re.compile(r"([^\W\d_]+)\W*$")


class Span(NamedTuple):
    start: int
    end: int
    kind: str


def luhn(numerals: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(numerals)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def numerals_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def passes(kind: str, match: str) -> bool:
    """The check that a base match must pass."""
    if kind == "ip":
        parts = [p.lstrip("0") for p in match.split(".")]
        return all(len(p) <= 3 and int(p or "0") <= MOST_IP_PART for p in parts)
    if kind == "card":
        numerals = numerals_of(match)
        return CARD_DIGITS[0] <= len(numerals) <= CARD_DIGITS[1] and luhn(numerals)
    if kind == "phone":
        return PHONE_DIGITS[0] <= len(numerals_of(match)) <= PHONE_DIGITS[1]
    return True


def email_spans(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping ``local@domain``, searched from each at sign outwards.

    The local part is the run of its characters that ends at the sign, so a long run without
    a sign costs nothing.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            done = domain.end()
            yield Span(begin, done, "email")
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Base matches by kind as listed, then start."""
    found = list(email_spans(text))
    for kind, pattern in PATTERNS.items():
        if kind != "phone" or "+" in text:
            found += [Span(*m.span(), kind) for m in pattern.finditer(text)
                      if passes(kind, m[0])]
    return found


def shape(text: str) -> str:
    """The kind of characters in order: 9 digits, a letters, and marks as they are."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub("[0-9]", "9", text)))


def span_features(segment: str, before: str, after: str) -> list[str]:
    """Features of a whole candidate segment; no feature looks at single tokens."""
    numerals = numerals_of(segment)
    parts = segment.split(".")
    octets = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 for p in parts)
    found = [f"shape={shape(segment)[:12]}", f"digits={min(len(numerals), 20)}",
             f"ends={shape(segment[:1])}{shape(segment[-1:])}",
             f"marks={''.join(sorted(set(re.sub(r'[0-9A-Za-z]', '', segment))))[:6]}"]
    groups = [str(len(g)) for g in re.findall("[0-9]+", segment)]
    if len(groups) > 1:
        found.append(f"tail={'-'.join(groups[-3:])[:8]}")
    if octets:
        found.append(f"octets={all(int(p) <= MOST_IP_PART for p in parts)}")
    if len(numerals) >= 12:
        found.append(f"luhn={luhn(numerals)}")
    if segment.count("@") == 1:
        found.append(f"domain={'.' in segment.split('@')[1]}")
    if before and re.match(r"[0-9@+._%-]", before[-1:]):
        found.append("cut-left")
    if after and re.match(r"[0-9@._%-][0-9A-Za-z]|[0-9A-Za-z@]", after[:2]):
        found.append("cut-right")
    word = WORD_BEFORE.search(before[-24:])
    if word:
        found.append(f"before={word[1].lower()[:12]}")
    return found


class Island(NamedTuple):
    segments: list[tuple[int, int]]  # token bounds, end exclusive
    spans: list[tuple[int, int]]     # characters in the text
    features: list[list[str]]
    n_tokens: int


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Runs of words with a digit or an at sign, one blank between them."""
    begin = end = -1
    for word in CHUNK.finditer(text) if SIGN.search(text) else ():
        if SIGN.search(word[0]) is None:
            continue
        if begin >= 0 and word.start() == end + 1 and text[end] == " ":
            end = word.end()
            continue
        if begin >= 0:
            yield begin, end
        begin, end = word.span()
    if begin >= 0:
        yield begin, end


def islands(text: str, settled: Sequence[Span] = (), most: int | None = None) -> Iterator[Island]:
    """Islands with their candidate segments: up to MOST_TOKENS parts, edges no blank.

    A long island comes whole, or in runs of ``most`` tokens. ``settled`` spans are entities already; what is left around
    them makes islands.
    """
    for start, stop in free_stretches(text, settled):
        tokens = [m.span() for m in TOKEN.finditer(text, start, stop)]
        for low in range(0, len(tokens), most or max(1, len(tokens))):
            part = tokens[low:low + most] if most else tokens
            yield _island(text, part, 0, len(part))


def free_stretches(text: str, settled: Sequence[Span]) -> Iterator[tuple[int, int]]:
    """Bounds of the islands: what ``settled`` spans leave of the stretches."""
    taken = sorted(settled)
    for start, stop in stretches(text):
        free, at = [], start
        for span in taken:
            if span.end > start and span.start < stop:
                free.append((at, max(at, span.start)))
                at = max(at, span.end)
        for a, b in [*free, (at, stop)]:
            if SIGN.search(text, a, b):
                yield a, b


def _island(text: str, tokens: Sequence[tuple[int, int]], low: int, high: int) -> Island:
    """The candidate segments that begin in tokens ``low`` to ``high``, wherever they end."""
    segments, spans, features = [], [], []
    for i in range(low, high):
        for j in range(i + 1, len(tokens) + 1):
            begin, end = tokens[i][0], tokens[j - 1][1]
            if end - begin > MOST_CHARS:
                break
            segment = text[begin:end]
            if len(JOINTS.split(segment)) > MOST_TOKENS:
                break
            if not SIGN.search(segment):
                continue
            segments.append((i, j))
            spans.append((begin, end))
            features.append(span_features(segment, text[max(0, begin - 24):begin],
                                          text[end:end + 2]))
    return Island(segments, spans, features, len(tokens))


class Model(NamedTuple):
    index: dict[str, int]
    weights: np.ndarray              # features x kinds; a token outside entities scores 0


def segment_scores(model: Model, island: Island) -> np.ndarray:
    scores = np.empty((len(island.segments), len(KINDS)))
    for s, names in enumerate(island.features):
        known = [model.index[f] for f in names if f in model.index]
        unknown = len(names) - len(known)
        scores[s] = model.weights[known].sum(axis=0) + model.weights[0] * unknown
    return scores


def forward_backward(island: Island, scores: np.ndarray) -> tuple[np.ndarray, float]:
    """Chance of every (segment, kind) over all segmentations of the island."""
    n = island.n_tokens
    starting, ending = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for s, (i, j) in enumerate(island.segments):
        starting[i].append(s)
        ending[j].append(s)
    any_kind = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.empty(0)
    alpha, beta = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        alpha[j] = np.logaddexp.reduce(
            [alpha[j - 1], *[alpha[island.segments[s][0]] + any_kind[s] for s in ending[j]]])
    for i in range(n - 1, -1, -1):
        beta[i] = np.logaddexp.reduce(
            [beta[i + 1], *[beta[island.segments[s][1]] + any_kind[s] for s in starting[i]]])
    chance = np.empty_like(scores)
    for s, (i, j) in enumerate(island.segments):
        chance[s] = np.exp(alpha[i] + scores[s] + beta[j] - alpha[n])
    return chance, float(alpha[n])


def best_path(n: int, pieces: Iterable[tuple[Island, np.ndarray]]
              ) -> list[tuple[int, int, int]]:
    """Piece, segment and kind index of the best segmentation of ``n`` tokens.

    Pieces hold the segments in the order of their first tokens and are read one at a time.
    An entity has at most MOST_TOKENS parts, so the search is linear in the island. Each
    entity must beat leaving its tokens out by MARGIN.
    """
    best, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
    at = 0

    def settle(upto: int) -> None:
        nonlocal at
        while at < upto:
            at += 1
            if best[at] <= best[at - 1]:
                best[at], back[at] = best[at - 1], None

    for p, (island, scores) in enumerate(pieces):
        top = scores.argmax(axis=1) if len(scores) else []
        for s, (i, j) in enumerate(island.segments):
            settle(i)
            value = best[i] + scores[s][top[s]] - MARGIN
            if value > best[j]:
                best[j], back[j] = value, (i, p, s, int(top[s]))
    settle(n)
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            j, *chosen = back[j]
            out.append(tuple(chosen))
    return out[::-1]


def decode(island: Island, scores: np.ndarray) -> list[tuple[int, int]]:
    """Segments and kinds of the best segmentation, as (segment, kind index)."""
    return [(s, kind) for _, s, kind in best_path(island.n_tokens, [(island, scores)])]


def labelled(text: str) -> Iterator[tuple[Island, list[tuple[int, int]]]]:
    """Islands with their true segments as base patterns find them; longer spans win.

    They are a sample to fit on, so long ones come in runs that a task can hold.
    """
    known: dict[tuple[int, int], int] = {}
    for span in base_spans(text):
        known.setdefault((span.start, span.end), KINDS.index(span.kind))
    chosen: list[tuple[int, int]] = []
    for bounds in sorted(known, key=lambda b: b[0] - b[1]):
        if all(bounds[1] <= a or b <= bounds[0] for a, b in chosen):
            chosen.append(bounds)
    for island in islands(text, most=MOST_ISLAND):
        yield island, [(s, known[b]) for s, b in enumerate(island.spans) if b in chosen]


def fit(texts: Sequence[str]) -> Model:
    """Weights that make the labelled segmentations of the islands most likely.

    Gradient ascent with adaptive steps on the conditional log-likelihood; the expected
    counts come from the forward-backward pass over all segmentations.
    """
    sample = [(island, truth) for text in texts for island, truth in labelled(text)
              if island.segments][:TRAIN_ISLANDS]
    counts: dict[str, int] = {}
    for island, _ in sample:
        for names in island.features:
            for f in names:
                counts[f] = counts.get(f, 0) + 1
    # Place 0 is shared by all that is rare, and so by what is unknown.
    common = [f for f in sorted(counts) if counts[f] >= LEAST_SEEN]
    index = {f: i for i, f in enumerate(common, start=1)}
    weights = np.zeros((len(index) + 1, len(KINDS)))
    weights[0] = -1.0
    squares = np.full_like(weights, 1e-8)
    model = Model(index, weights)
    ids = np.array([index.get(f, 0) for island, _ in sample for names in island.features
                    for f in names], dtype=np.int64)
    widths = np.array([len(names) for island, _ in sample for names in island.features])
    firsts = np.cumsum(widths) - widths
    for _ in range(TRAIN_STEPS if sample else 0):
        scores = np.add.reduceat(weights[ids], firsts, axis=0)
        error, at = np.empty_like(scores), 0
        for island, truth in sample:
            end = at + len(island.segments)
            error[at:end], _ = forward_backward(island, scores[at:end])
            for s, k in truth:
                error[at + s, k] -= 1
            at = end
        slope = -SHRINK * len(sample) * weights
        np.subtract.at(slope, ids, np.repeat(error, widths, axis=0))
        squares += slope * slope
        weights += RATE * slope / np.sqrt(squares)
        weights[0] = np.minimum(weights[0], -1.0)  # what is unknown speaks against an entity
    return model


def added_spans(text: str, base: list[Span], model: Model) -> list[Span]:
    """Entities of the best segmentation of what the base spans leave.

    The segments of MOST_ISLAND first tokens are scored at a time and only their bounds kept,
    so a line of any length is searched whole.
    """
    found = []
    for start, stop in free_stretches(text, base):
        tokens = [m.span() for m in TOKEN.finditer(text, start, stop)]
        bounds: list[list[tuple[int, int]]] = []

        def pieces(tokens=tokens, bounds=bounds) -> Iterator[tuple[Island, np.ndarray]]:
            for low in range(0, len(tokens), MOST_ISLAND):
                island = _island(text, tokens, low, min(len(tokens), low + MOST_ISLAND))
                bounds.append(island.spans)
                yield island, segment_scores(model, island)

        found += [Span(*bounds[p][s], KINDS[kind])
                  for p, s, kind in best_path(len(tokens), pieces())]
    return found


def listed(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda s: (KINDS.index(s.kind), s.start, s.end))
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in order)


def marked(texts: list[str], model: Model) -> dict[str, list]:
    out: dict[str, list] = {f"n_{k}": [] for k in KINDS} | {
        "base_sha256": [], "spans": [], "n_added": []}
    for text in texts:
        base = base_spans(text)
        more = added_spans(text, base, model)
        for kind in KINDS:
            out[f"n_{kind}"].append(sum(s.kind == kind for s in base))
        out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
        out["spans"].append(listed(base + more))
        out["n_added"].append(len(more))
    return out


def fitted(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """The model, fitted by one task on a bounded sample of documents with islands.

    Every distinct text with a digit or an at sign may be drawn: those of the TRAIN_DOCUMENTS
    least hashes, and of these the first TRAIN_ISLANDS islands. Copies count once, and only
    keys and hashes are shuffled to draw them; only the drawn texts reach the task.
    """
    able = docs.where(F.col(text).rlike("[0-9@]")).select(
        F.xxhash64(text).alias("hash"), col(key).alias("key"), F.col(text).alias("text"))
    names = stored(able.groupBy("hash").agg(F.min("key").alias("first")))
    _, drawn = least_hashed(names, "hash", TRAIN_DOCUMENTS)
    drawn = F.broadcast(stored(drawn))  # TRAIN_DOCUMENTS rows of two numbers
    sample = stored(able.join(drawn, "hash").where(F.col("key").eqNullSafe(F.col("first")))
                    .select("hash", "text"))

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows that repeat a key and text whole are one.
        parts = list(batches)
        if not parts:
            return
        rows = pd.concat(parts).drop_duplicates("hash").sort_values("hash")
        model = fit(list(rows["text"]))
        names = ["", *model.index]
        yield pd.DataFrame({"feature": names, "weights": list(model.weights)})

    rows = stored(sample.coalesce(1).mapInPandas(
        train, "feature string, weights array<double>")).collect()
    if not rows:
        return fit([])
    rows = sorted(rows, key=lambda r: r.feature)  # the shared place comes first
    index = {r.feature: i for i, r in enumerate(rows)}
    weights = np.array([r.weights for r in rows]).reshape(-1, len(KINDS))
    return Model({f: i for f, i in index.items() if f}, weights)


def find_personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, counts of the base kinds, the digest of the base spans, and all spans.

    Base spans follow the fixed patterns. The field then scores every candidate segment of
    each island by features of the whole segment and its surroundings; the best joint choice
    of boundaries and kinds adds entities where no base span lies. It is fitted on a bounded
    sample labelled by the base patterns and learns from context and form, so that it also
    finds entities that miss a pattern by a sign.

    NULL and empty texts have no spans; repeated rows get the same answer each; an empty table
    gives no rows (the field is then empty and adds nothing); extra columns are left out.
    """
    model = fitted(docs, text, key)
    added = ("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
             "spans string, n_added long")
    return map_texts(docs, lambda texts: marked(texts, model), added, (key,), text)


def op9_semicrf_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every whole document text."""
    return find_personal_data(read(spark, folder, "documents"))
