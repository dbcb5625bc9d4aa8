"""Operator 12: ranked search by sequential reads of impact-sorted postings (no random access)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import drop_folder, scratch_path, stored
from .tables import col, map_texts, read

# What separates terms, and the constants of the score.
SEPARATORS = (*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))
LENGTH_SHARE = 75        # per cent of the length norm that depends on the length
UNIT, SATURATION, NORM = 1_000_000_000, 1000, 8
TOP = 10

BLOCK_TERMS = 100_000    # query terms looked up in one pass over the texts
BROADCAST_ROWS = 200_000   # rows (query, term) or blocks up to which they go to every task
STEPS_PER_OCTAVE = 2     # postings of a list whose impacts are this close make a block
BITS = 62                # lists whose bits share a number
FEW_PAIRS = 100          # documents a query that are few enough to read all the rest at once
FIRST_READ = 500         # postings a query of the first read
GROWTH = 3               # each next read ends where so many times the postings are read

# One byte each: separators become blanks, capital letters A to Z small ones.
FOLDED = bytes(0x20 if b in SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b
               for b in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text in UTF-8; only A to Z are lower-cased."""
    return text.encode().translate(FOLDED).split()


def counted(texts: Sequence[str], known: Mapping[bytes, int] | None) -> dict[str, list]:
    """Per text the number of its terms, and the counts of those that are known (or of all)."""
    out: dict[str, list] = {"n": [], "hits": []}
    for text in texts:
        found = terms(text)
        out["n"].append(len(found))
        if known is None:
            out["hits"].append([{"t": t.decode(), "tf": k} for t, k in Counter(found).items()])
        else:
            ids = Counter(map(known.get, found))
            del ids[None]
            out["hits"].append([{"t": t, "tf": k} for t, k in ids.items()])
    return out


def weight(n_documents: Column, df: Column) -> Column:
    ratio = (2 * n_documents + 2).cast("double") / (2 * df + 1).cast("double")
    return F.floor(1000 * F.log(ratio)).cast("long")


class Index(NamedTuple):
    postings: DataFrame      # t, row, impact, turn: by falling turn within each file
    lists: DataFrame         # t, turn, rows, most: blocks of each list and their best impact
    documents: DataFrame     # row, doc, n, hits: documents with terms


def indexed(docs: DataFrame, vocabulary: DataFrame, text: str, key: str) -> Index:
    """Impact-sorted postings of every query term in every text, in the order of reading.

    The vocabulary is looked up in blocks of about BLOCK_TERMS terms, one pass over the texts
    each; a single block, the usual case, reads them once. Impacts need the number and length
    of all documents, so the counts are written first.

    A list is cut into blocks of similar impact. What a block is worth is how far reading it
    lowers the greatest impact left in its list, a posting; its turn is the logarithm of
    that, or of the least of the blocks before it, so every list is read from its greatest
    impact down. Short lists of rare terms thus come first, and the long lists of common words
    last. The postings are sorted by turn inside their files, whose page statistics let a read
    skip the others; nothing is shuffled but one row per block.
    """
    spark = docs.sparkSession
    blocks = -(-vocabulary.count() // BLOCK_TERMS) or 1
    rows = docs.select(F.monotonically_increasing_id().alias("row"), col(key).alias("doc"),
                       col(text).alias("text"))
    if blocks > 1:
        rows = stored(rows)  # row numbers must be the same in every pass
    parts, documents, totals = [], None, None
    for block in range(blocks):
        mine = vocabulary.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block)
        known = {r.term.encode(): r.t for r in mine.toLocalIterator()}
        counts = stored(map_texts(
            rows, lambda texts, known=known: counted(texts, known),
            "n long, hits array<struct<t long, tf long>>", ("row", "doc")).where("n > 0"))
        if documents is None:
            documents = counts
            totals = counts.agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L")).first()
        hits = counts.select("row", "n", F.inline("hits"))
        # At most a block's terms, so it may go to every task.
        weights = stored(hits.groupBy("t").agg(F.count(F.lit(1)).alias("df")).select(
            "t", weight(F.lit(totals["N"]), F.col("df")).alias("w")))
        norm = (f"({100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * {totals['N']}L) "
                f"div {totals['L'] or 1}L)")
        impact = f"w * (({UNIT}L * tf) div ({SATURATION} * tf + {NORM} * {norm}))"
        parts.append(hits.join(F.broadcast(weights), "t").select(
            "t", "row", F.expr(impact).cast("long").alias("impact")))
    step = F.floor(F.log2("impact") * STEPS_PER_OCTAVE).cast("int")
    found = reduce(DataFrame.unionByName, parts).where("impact > 0").withColumn("step", step)
    down = Window.partitionBy("t").orderBy(F.desc("step"))  # at most 128 steps a list
    worth = (F.col("most") - F.lead("most", 1, 0).over(down)) / F.col("rows")
    lists = stored(found.groupBy("t", "step").agg(
        F.count(F.lit(1)).alias("rows"), F.max("impact").alias("most")).withColumn(
            "worth", worth).select("t", "step", "rows", "most", F.floor(F.log2(F.min("worth").over(
                down.rowsBetween(Window.unboundedPreceding, 0)))).cast("int").alias("turn")))
    turns = lists.select("t", "step", "turn")
    if lists.count() <= BROADCAST_ROWS:
        turns = F.broadcast(turns)
    postings = stored(found.join(turns, ["t", "step"]).select(
        "t", "row", "impact", "turn").sortWithinPartitions(F.desc("turn")))
    return Index(postings, lists, documents)


def reads(sizes: Sequence[tuple[int, int]], first: int) -> list[int]:
    """The lowest turn of each read; ``sizes`` gives each turn's postings over all queries."""
    lows, total, wanted = [], 0, first
    for turn, size in sorted(sizes, reverse=True):
        total += size
        if total >= wanted:
            lows.append(turn)
            wanted = total * GROWTH
    if sizes and (not lows or lows[-1] != min(sizes)[0]):
        lows.append(min(sizes)[0])
    return lows


def best_lists(index: Index, wants: DataFrame, top: int) -> DataFrame:
    """``q, row, doc, score``: the documents that may be among the ``top`` of each query, each
    with its final score.

    Every read takes the next blocks of all lists. A document's lower bound is what was
    read of it; its upper bound adds, for each list in which it was not met, the greatest
    impact left there. A query is open while a document never met could still reach its
    ``top``-th lower bound; postings of open queries are read for all documents. A closed
    query needs only the documents whose upper bound reaches that bound (equal scores
    included); its lists are read on for these alone, until no list has anything left, so that
    lower and upper bounds meet and all scores are final. A document that fell behind may be
    met again while its query is open; its true score lies below the bound, so it stays out.

    A pair's state is one row: its lower bound and one bit for each list in which it was met.
    """
    spark = wants.sparkSession
    place = Window.partitionBy("q").orderBy("t")
    wants = stored(wants.withColumn("place", F.row_number().over(place) - 1))
    few = wants.count() <= BROADCAST_ROWS

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    users = wants.groupBy("t").agg(F.count(F.lit(1)).alias("users"))
    sizes = index.lists.join(users, "t").groupBy("turn").agg(
        F.sum(F.col("rows") * F.col("users")))
    n_queries, longest = wants.agg(F.countDistinct("q"), F.max("place")).first()
    # One row per turn, at most 128.
    lows = reads([tuple(r) for r in sizes.collect()], FIRST_READ * n_queries)
    if not lows:
        return spark.createDataFrame([], "q long, row long, doc long, score long")
    masks = [f"met_{i}" for i in range(longest // BITS + 1)]
    added = [F.expr("times * impact").alias("lower"), *[
        F.expr(f"CASE WHEN place div {BITS} = {i} THEN shiftleft(1L, place % {BITS}) ELSE 0L END")
        .alias(m) for i, m in enumerate(masks)]]
    state, queries, old, high = None, None, [], max(t for t, in index.lists.select("turn").distinct()
                                                     .collect()) + 1
    while lows:
        low, *lows = lows
        step = index.postings.where((F.col("turn") >= low) & (F.col("turn") < high))
        high = low
        if queries is None:
            pieces = [step.join(small(wants), "t").select("q", "row", *added)]
        else:
            live = state.join(small(queries), "q").where("upper >= bound")
            opened = wants.join(queries.where("open").select("q"), "q")
            pairs = live.where("NOT open").select("q", "row")
            pieces = [live.select("q", "row", "lower", *masks),
                      step.join(small(opened), "t").select("q", "row", *added),
                      step.join(pairs, "row").join(small(wants), ["q", "t"]).select(
                          "q", "row", *added)]
        left = index.lists.where(F.col("turn") < low).groupBy("t").agg(F.max("most").alias("most"))
        fronts = wants.join(left, "t", "left").groupBy("q").agg(F.sort_array(F.collect_list(F.struct(
            "place", (F.col("times") * F.coalesce("most", F.lit(0))).alias("front")))).alias("l"))
        fronts = stored(fronts.select("q", F.expr("transform(l, x -> x.front)").alias("fronts")))
        # What the lists in which a pair was not met may still add.
        rest = [f"aggregate(transform(slice(fronts, {i * BITS + 1}, {BITS}), (f, j) -> IF("
                f"shiftright({m}, j) & 1L = 1L, 0L, f)), 0L, (x, y) -> x + y)"
                for i, m in enumerate(masks)]
        sums = reduce(DataFrame.unionByName, pieces).groupBy("q", "row").agg(
            *[F.sum(c).alias(c) for c in ("lower", *masks)])
        scored = sums.join(small(fronts), "q").select(
            "q", "row", "lower", *masks, F.expr(f"lower + {' + '.join(rest)}").alias("upper"))
        path = scratch_path(spark, "bounds")
        scored.write.parquet(path)
        state = spark.read.schema(scored.schema).parquet(path)
        order = Window.partitionBy("q").orderBy(F.desc("lower"))
        bounds = state.select("q", "lower").withColumn("i", F.row_number().over(order)).where(
            f"i <= {top}").groupBy("q").agg(F.when(
                F.count(F.lit(1)) == top, F.min("lower")).otherwise(0).alias("bound"))
        unread = F.expr("aggregate(fronts, 0L, (x, y) -> x + y)")
        bound = F.coalesce("bound", F.lit(0))
        queries = stored(fronts.join(bounds, "q", "left").select(
            "q", bound.alias("bound"), ((unread > 0) & (unread >= bound)).alias("open")))
        # The bounds of the read before are no longer needed by any frame.
        for stale in old:
            drop_folder(spark, stale)
        old = [path]
        if lows and queries.where("open").isEmpty() and state.join(small(queries), "q").where(
                "upper >= bound").count() <= FEW_PAIRS * n_queries:
            lows = lows[-1:]
    final = state.join(small(queries), "q").where("upper >= bound").select(
        "q", "row", F.col("lower").alias("score"))
    return final.join(index.documents.select("row", "doc"), "row")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, text: str = "text",
                  key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """``item_key, rank, key, score``: the ``top`` best documents of every item, exact.

    Every whole text and item is read. Equal item texts are searched once; every item row
    gets its own ranks. Work between reads is joins and sums over the documents met so far:
    a word that a third of all documents hold has a low impact and is read last, then only
    for documents that can still matter. The ``top`` per query is cut inside the tasks before
    the shuffle, so no query gathers its documents.

    Equal scores rank by ascending ``key`` (NULL first); rows with equal keys are documents
    of their own. NULL and empty texts have no terms: such documents count nowhere and such
    items get no row, as do items that share no term with a document, and items get fewer
    rows where fewer documents score above 0. Empty tables give no rows; other columns are
    left out. ``key`` is an integer.
    """
    given = stored(items.select(col(item_key).alias("item"), F.coalesce(
        col(text), F.lit("")).alias("body")))
    texts = stored(given.select("body").distinct().withColumn(
        "q", F.monotonically_increasing_id()))
    spelled = stored(map_texts(texts, lambda batch: counted(batch, None),
                               "n long, hits array<struct<t string, tf long>>", ("q",), "body")
                     .select("q", F.inline("hits")).withColumnsRenamed({"t": "term", "tf": "times"}))
    vocabulary = stored(spelled.select("term").distinct().withColumn(
        "t", F.monotonically_increasing_id()))
    wants = stored(spelled.join(vocabulary, "term").select("q", "t", "times"))
    best = best_lists(indexed(docs, vocabulary, text, key), wants, top)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("doc"), "row")
    ranks = best.withColumn("rank", F.row_number().over(order)).where(f"rank <= {top}")
    named = given.join(texts, "body").select("item", "q")
    return named.join(ranks, "q").select(F.col("item").alias(item_key), "rank",
                                         F.col("doc").alias(key), "score")


def op12_nra_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked_search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
