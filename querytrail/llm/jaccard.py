"""Operator 6: n-gram Jaccard join with Bayesian pruning of MinHash candidates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .components import components
from .tables import map_texts, partitions, read

WORDS = 5                # words of a shingle
THRESHOLD = 0.8
BANDS, ROWS = 32, 4      # a pair at the threshold shares no band once in 20 million times
HASHES = BANDS * ROWS
STEP = 16                # MinHash values compared before the posterior is looked at again
TOLERANCE = 1e-10        # chance of reaching the threshold below which a pair is dropped
BLOCK = 256              # classes of a block; pairs are made between blocks that share a bucket
HASH_CHUNK = 60_000      # shingles hashed at once
COLUMNS = 8192           # shingles of a block pair compared at once

SHINGLE_BASE = 0x9E3779B97F4A7C15
_random = np.random.default_rng(20240607)
MULTIPLIERS = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[str]:
    """Lower-case words between white space."""
    return text.lower().split()


def shingle_hashes(found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word windows of several texts, one after the other, and their numbers.

    A text of fewer words has itself as only shingle; a text without words has none.
    """
    sizes = np.array([len(w) for w in found], np.int64)
    numbers = np.where(sizes >= WORDS, sizes - WORDS + 1, np.minimum(sizes, 1))
    if not sizes.sum():
        return np.empty(0, np.uint64), numbers
    codes, distinct = pd.factorize(np.array([w for ws in found for w in ws], dtype=object))
    by_word = pd.util.hash_array(distinct, categorize=False)[codes]
    padded = np.concatenate([by_word, np.zeros(WORDS, np.uint64)])
    ends = np.cumsum(sizes)
    # Place of each shingle's first word, and how many of its five words are in the text.
    starts = np.repeat(ends - sizes, numbers) + (
        np.arange(numbers.sum()) - np.repeat(np.cumsum(numbers) - numbers, numbers))
    room = np.repeat(ends, numbers) - starts
    h = np.zeros(len(starts), np.uint64)
    for k in range(WORDS):
        word = np.where(room > k, padded[starts + k], np.uint64(k))
        h = (h + word) * np.uint64(SHINGLE_BASE)
    return mixed(h), numbers


def min_hashes(shingles: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """MinHash values, texts x HASHES; texts without shingles have the largest value."""
    out = np.full((len(numbers), HASHES), np.iinfo(np.uint64).max, np.uint64)
    some = np.flatnonzero(numbers)
    firsts = (np.cumsum(numbers) - numbers)[some]
    # Texts in runs of bounded size, so that the work stays in the processor's cache.
    low = 0
    while low < len(some):
        high = max(low + 1, int(np.searchsorted(firsts, firsts[low] + HASH_CHUNK)))
        end = firsts[high] if high < len(some) else len(shingles)
        part, at = shingles[firsts[low]:end], firsts[low:high] - firsts[low]
        for k in range(HASHES):
            out[some[low:high], k] = np.minimum.reduceat(
                part * MULTIPLIERS[k] + OFFSETS[k], at)
        low = high
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One key per band, the band's number mixed in, texts x BANDS, as signed values."""
    rows = signatures.reshape(len(signatures), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(ROWS):
        h = mixed(h * np.uint64(SHINGLE_BASE) + rows[:, :, k])
    return h.view(np.int64)


def sketched(texts: list[str]) -> dict[str, list]:
    """The class of equal word sequences, and its band keys (none without words)."""
    found = [words_of(t) for t in texts]
    shingles, numbers = shingle_hashes(found)
    keys = band_keys(min_hashes(shingles, numbers))
    return {"class": [blake2b(" ".join(w).encode(), digest_size=16).digest() for w in found],
            "keys": [k if n else [] for k, n in zip(keys, numbers, strict=True)]}


def shingled(texts: list[str]) -> dict[str, list]:
    """MinHash values and sorted distinct shingles."""
    shingles, numbers = shingle_hashes([words_of(t) for t in texts])
    ends = np.cumsum(numbers)
    return {"signature": list(min_hashes(shingles, numbers).view(np.int64)),
            "shingles": [np.unique(shingles[e - n:e].view(np.int64))
                         for e, n in zip(ends, numbers, strict=True)]}


def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """After 16, 32, ... values: the fewest matches that keep a pair.

    With an even prior on the similarity, m matches of n leave it Beta(m + 1, n - m + 1)
    distributed; its upper tail at the threshold is the chance of at most m successes in
    n + 1 trials of that probability.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
        out.append(m)
    return tuple(out)


def surviving(a: np.ndarray, b: np.ndarray,
              looks: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature matrices that share a band and pass every look.

    The matches are counted step by step; a pair is dropped as soon as its posterior chance of
    reaching the threshold falls below the tolerance, which ``looks`` (see least_matches) says.
    """
    keys_a, keys_b = band_keys(a.view(np.uint64)), band_keys(b.view(np.uint64))
    shared = np.zeros((len(a), len(b)), bool)
    for k in range(BANDS):
        shared |= keys_a[:, k, None] == keys_b[None, :, k]
    i, j = np.nonzero(shared)
    matches = np.zeros(len(i), np.int64)
    for turn, least in enumerate(looks):
        part = slice(turn * STEP, (turn + 1) * STEP)
        matches += (a[i, part] == b[j, part]).sum(axis=1)
        keep = matches >= least
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def intersections(sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of incidence matrices in runs of columns."""
    values = np.unique(np.concatenate(sets_a)) if sets_a else np.empty(0, np.int64)
    common = np.intersect1d(values, np.concatenate(sets_b)) if sets_b else values[:0]
    places = [[np.searchsorted(common, s[np.isin(s, common, assume_unique=True)])
               for s in sets] for sets in (sets_a, sets_b)]
    out = np.zeros((len(sets_a), len(sets_b)), np.float64)
    for low in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - low)
        dense = []
        for own in places:
            matrix = np.zeros((len(own), width), np.float32)
            for r, p in enumerate(own):
                inside = p[np.searchsorted(p, low):np.searchsorted(p, low + width)]
                matrix[r, inside - low] = 1
            dense.append(matrix)
        out += dense[0] @ dense[1].T  # counts up to 8192 are exact in 32 bits
    return out


def linked(ids_a: np.ndarray, sig_a: np.ndarray, sets_a: list[np.ndarray],
           ids_b: np.ndarray, sig_b: np.ndarray, sets_b: list[np.ndarray], same: bool,
           threshold: float, looks: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Exactly verified pairs (rows of a and b) of one block pair."""
    i, j = surviving(sig_a, sig_b, looks)
    if same:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return i, j
    rows, cols = np.unique(i), np.unique(j)
    common = intersections([sets_a[r] for r in rows], [sets_b[c] for c in cols])[
        np.searchsorted(rows, i), np.searchsorted(cols, j)]
    size_a = np.array([len(s) for s in sets_a])[i]
    size_b = np.array([len(s) for s in sets_b])[j]
    keep = common >= threshold * (size_a + size_b - common) - 1e-9
    return i[keep], j[keep]


def _forest(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the links suffice to connect what they connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    needed = np.zeros(len(i), bool)
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        a, b = root(x), root(y)
        if a != b:
            parent[a] = b
            needed[k] = True
    return needed


def _verified(threshold: float, tolerance: float):
    """Links of every block pair: per class how many documents it gained, and a forest of edges.

    The rows come sorted by block pair, so a task holds two blocks at a time.
    """
    looks = least_matches(threshold, tolerance)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, rows = None, []

        def finished() -> pd.DataFrame:
            seen, sides = set(), {0: [], 1: []}
            for r in rows:  # a repeated row (same document twice) counts once
                if (r.side, r.id) not in seen:
                    seen.add((r.side, r.id))
                    sides[r.side].append(r)
            same = pair[0] == pair[1]
            a, b = sides[0], sides[0] if same else sides[1]
            empty = pd.DataFrame({"id": [], "links": [], "other": []}).astype("int64")
            if not a or not b:
                return empty
            ids = [np.array([r.id for r in side]) for side in (a, b)]
            sigs = [np.stack([r.signature for r in side]) for side in (a, b)]
            sets = [[r.shingles for r in side] for side in (a, b)]
            times = [np.array([r.n for r in side]) for side in (a, b)]
            i, j = linked(ids[0], sigs[0], sets[0], ids[1], sigs[1], sets[1], same,
                          threshold, looks)
            if not len(i):
                return empty
            ends = np.concatenate([ids[0][i], ids[1][j]])
            gained = np.concatenate([times[1][j], times[0][i]])
            nodes, place = np.unique(ends, return_inverse=True)
            needed = _forest(ids[0][i], ids[1][j])
            counts = pd.DataFrame({"id": nodes, "other": nodes, "links": np.bincount(
                place, gained).astype(np.int64)})
            edges = pd.DataFrame({"id": ids[0][i][needed], "other": ids[1][j][needed],
                                  "links": 0})
            return pd.concat([counts, edges])

        for batch in batches:
            for r in batch.itertuples(index=False):
                if (r.a, r.b) != pair:
                    if rows:
                        yield finished()
                    pair, rows = (r.a, r.b), []
                rows.append(r)
        if rows:
            yield finished()

    return run


def ranked(member: Column) -> Column:
    """A document as a value that orders NULL keys last and has no NULL in it."""
    return F.struct(member["key"].isNull().alias("none"),
                    F.coalesce(member["key"], F.lit(0)).alias("key"),
                    member["digest"].alias("digest"))


def jaccard_join(docs: DataFrame, text: str = "text", key: str = "doc_id",
                 threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """``key, digest, class_id, n_links, first`` for every document.

    ``n_links`` is the number of other documents whose sets of five-word shingles (lower case)
    have a Jaccard similarity of ``threshold`` or more; ``class_id`` is the least key among all
    documents connected by such links, directly or not; ``first`` marks one of each class (the
    least key, then digest; rows equal in both are all marked). ``digest`` is the text's MD5.

    Equal word sequences are counted as one class before anything is paired. MinHash bands
    put classes in buckets, whose least members are found by a pre-aggregated count. Classes
    with a bucket mate are gathered in blocks of bounded size around that member, and two
    blocks meet in a task if they share a bucket: there the candidates are pruned by the
    posterior over their MinHash values, step by step, and the rest is verified exactly by
    shingle sets. A task emits link counts and a spanning forest, never all pairs, so groups
    of thousands of near copies cost no more rows than they have members. Only rows of ids and
    band keys are shuffled; texts move once, and only those of classes with a bucket mate are
    shingled again.

    A NULL text counts as empty. Texts without words link to nothing but to one another as
    copies; texts of one to four words have one shingle. Repeated rows are copies. A NULL key
    stays NULL and is the least only where a class has no other. An empty table gives no rows;
    extra columns are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"),
                       F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("digest"),
                       F.col(text).alias("text"))
    sketches = stored(map_texts(rows, sketched, "class binary, keys array<long>",
                                ("key", "digest")))

    # One row per class; its id is fixed once written.
    classes = stored(sketches.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("least_key"),
        F.min(ranked(F.struct("key", "digest"))).alias("member"),
        F.first("keys").alias("keys")).withColumn("id", F.monotonically_increasing_id()))
    keyed = classes.select("id", F.explode("keys").alias("bucket"))
    buckets = stored(keyed.groupBy("bucket").agg(
        F.min("id").alias("root"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    mates = stored(keyed.join(buckets, "bucket").select("bucket", "id", "root"))

    # Blocks: classes that share their least bucket root, cut by a hash where they are many.
    rooted = mates.groupBy("id").agg(F.min("root").alias("root"))
    sizes = rooted.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    blocks = stored(rooted.join(sizes, "root").select("id", F.xxhash64(
        "root", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block")))
    placed = mates.select("bucket", "id").join(blocks, "id").select("bucket", "block").distinct()
    left, right = placed.withColumnRenamed("block", "a"), placed.withColumnRenamed("block", "b")
    pairs = stored(left.join(right, "bucket").where("a <= b").select("a", "b").distinct())

    # The texts of one member of each class that has mates, shingled once and dealt to pairs.
    members = classes.join(blocks, "id").select(
        "id", "n", "block", F.when(~F.col("member.none"), F.col("member.key")).alias("key"),
        F.col("member.digest").alias("digest"))
    wanted = rows.withColumnRenamed("key", "k").withColumnRenamed("digest", "d")
    texts = wanted.join(members, F.col("k").eqNullSafe(F.col("key"))
                        & (F.col("d") == F.col("digest"))).select(
                            "id", "n", "block", "text").dropDuplicates(["id"])
    shingles = stored(map_texts(texts, shingled, "signature array<long>, shingles array<long>",
                                ("id", "n", "block")))
    sides = pairs.select("a", "b", F.explode(F.when(
        F.col("a") == F.col("b"), F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("block"))))
        .otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("block")),
                           F.struct(F.lit(1).alias("side"), F.col("b").alias("block"))))).alias("s")
    ).select("a", "b", "s.side", "s.block")
    dealt = (sides.join(shingles, "block").select("a", "b", "side", "id", "n", "signature",
                                                  "shingles")
             .repartition(partitions(spark), "a", "b").sortWithinPartitions("a", "b"))
    links = stored(dealt.mapInPandas(_verified(threshold, tolerance),
                                     "id long, other long, links long"))

    counts = links.where("id = other").groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(links.where("id <> other"), "id", "other").withColumnRenamed("node", "id")
    grouped = classes.select("class", "id", "n", "least_key", "member").join(
        counts, "id", "left").join(roots, "id", "left").withColumn(
            "root", F.coalesce("root", "id"))
    best = grouped.groupBy("root").agg(
        F.min("least_key").alias("class_id"), F.min("member").alias("chosen"))
    named = grouped.join(best, "root").select(
        "class", "class_id", "chosen",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    return sketches.select("key", "digest", "class").join(named, "class").select(
        F.col("key").alias(key), "digest", "class_id", "n_links",
        (ranked(F.struct("key", "digest")) == F.col("chosen")).alias("first"))


def op6_bayes_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Class and number of links of every document."""
    return jaccard_join(read(spark, folder, "documents")).select("doc_id", "class_id", "n_links")
