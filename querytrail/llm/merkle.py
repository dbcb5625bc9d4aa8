"""Operator 11: a Merkle manifest whose stored levels a recursive query climbs from every leaf."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .tables import col, partitions, read

FAN = 16                 # consecutive nodes that become one
TAMPERED_EVERY = 5       # the query tampers with documents whose checksum this divides
WIDE_SHARE = 256         # a node above more than 1 / 256 of all leaves is wide
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
GROUP, SALT, PART, RANK = "__group", "__salt", "__part", "__rank"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` for NULL, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the same group that lie before each row in its own sorted partition."""
    part = TaskContext.get().partitionId()
    last, before = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        groups = batch.column(batch.schema.get_field_index(GROUP))
        codes = groups.dictionary_encode().indices.to_numpy()
        begins = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
        at = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
        first_end = begins[1] if len(begins) > 1 else n
        if groups[0].as_py() == last:
            at[:first_end] += before
        last, before = groups[n - 1].as_py(), int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(at.astype(np.int64))],
            names=[*batch.schema.names, PART, RANK])


def _placed(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` with its partition and rank, and the rows of each (partition, group).

    The rows are range-partitioned and sorted by group and ``order``; a salt tells equal rows
    apart, so no group and no run of equal rows has to lie in one task.
    """
    keys = [F.col(GROUP), *[col(c) for c in order], F.col(SALT)]
    ranged = (df.withColumn(SALT, F.monotonically_increasing_id())
              .repartitionByRange(partitions(df.sparkSession), *keys)
              .sortWithinPartitions(*keys).drop(SALT))
    schema = T.StructType([*ranged.schema.fields,
                           T.StructField(PART, T.LongType()), T.StructField(RANK, T.LongType())])
    ranked = stored(ranged.mapInArrow(_ranked, schema))
    return ranked, ranked.groupBy(PART, GROUP).agg(F.count(F.lit(1)).alias("rows"))


def numbered(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``df`` with ``tree`` (number of its group, NULL first), ``at`` (place in the group, from
    0) and ``n`` (rows of the group). No group is gathered; only one row per partition and
    group is summed up."""
    # NULL sorts before every value, and the key itself is never NULL.
    marked = df.withColumn(GROUP, F.coalesce(F.concat(F.lit("="), col(group)), F.lit("")))
    ranked, counts = _placed(marked, order)
    totals = stored(counts)
    groups, sums = _placed(
        totals.select(F.col(GROUP).alias("name")).distinct().withColumn(GROUP, F.lit("")), ["name"])
    earlier = Window.partitionBy(GROUP).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)

    def before(rows: str) -> Column:
        return F.coalesce(F.sum(rows).over(earlier), F.lit(0))

    trees = groups.join(sums.select(PART, before("rows").alias("shift")), PART).select(
        F.col("name").alias(GROUP), (F.col("shift") + F.col(RANK)).alias("tree"))
    offsets = stored(totals.select(
        PART, GROUP, before("rows").alias("shift"),
        F.sum("rows").over(Window.partitionBy(GROUP)).alias("n")).join(trees, GROUP))
    return ranked.join(offsets, [PART, GROUP]).select(
        *[col(c) for c in df.columns], "tree", (F.col("shift") + F.col(RANK)).alias("at"), "n")


class Manifest(NamedTuple):
    """Stored levels of a tree over trees.

    ``runs`` holds the leaves, up to 16 consecutive ones a row: ``node`` (name of what they
    become), ``digest``, ``n`` (leaves of the tree) and ``members`` (place, digest and the
    carried columns of each leaf). ``links`` has a row for every node but the root: its
    ``parent``, the digests of its siblings ``before`` and ``after`` it, whether it is the
    root of its own tree (``top``), and whether it and its parent are ``wide``.
    """
    runs: DataFrame
    links: DataFrame
    root: str
    root_digest: str


def _levels(nodes: DataFrame, label: Column, most: int, level: int
            ) -> tuple[list[DataFrame], list[DataFrame]]:
    """Link rows and last nodes of trees built upwards from ``nodes`` (tree, at, m, ...).

    ``m`` is the number of a tree's nodes on the present level. The levels are written one by
    one, so a lost executor costs at most one of them.
    """
    links, tops = [], []
    while True:
        tops.append(nodes.where("m = 1"))
        if most <= 1:
            return links, tops
        level += 1
        place = F.expr(f"at div {FAN}")
        runs = stored(nodes.where("m > 1").groupBy("tree", place.alias("at")).agg(
            F.sort_array(F.collect_list(F.struct("at", "node", "digest", "leaves")))
            .alias("members"), F.sum("leaves").alias("leaves"), F.first("m").alias("m")).select(
                "*", F.concat_ws(".", label, F.lit(level), "at").alias("parent")))
        members = F.col("members")
        links.append(runs.select("parent", F.col("leaves").alias("above"), "members",
                                 F.posexplode(members).alias("place", "child")).select(
            F.col("child.node").alias("node"), "parent", F.col("child.leaves").alias("leaves"),
            "above", _joined(members, F.col("place"), "digest", 0).alias("before"),
            _joined(members, F.col("place"), "digest", 1).alias("after")))
        nodes = runs.select(
            "tree", "at", F.col("parent").alias("node"), "leaves",
            digest(F.array_join(F.transform(members, lambda x: x["digest"]), "")).alias("digest"),
            F.expr(f"(m + {FAN - 1}) div {FAN}").alias("m"))
        most = -(-most // FAN)


def _joined(members: Column, place: Column, name: str, side: int) -> Column:
    """Digests of the members before (0) or after (1) a place, one after the other."""
    piece = F.slice(members, place + 2, F.lit(FAN)) if side else F.slice(members, 1, place)
    return F.array_join(F.transform(piece, lambda x: x[name]), "")


def build_manifest(leaves: DataFrame, group: str, order: Sequence[str]) -> Manifest | None:
    """The manifest of leaves (a column ``leaf`` and any others), None if there are none.

    Leaves of one group make one tree, in the given order; the roots of the trees, ordered by
    group (NULL first, UTF-8 bytewise), make the tree above. Rows that tie in ``order`` and
    ``leaf`` are told apart by their place alone.
    """
    kept = [c for c in leaves.columns if c != group]
    placed = numbered(stored(leaves), group, [*order, "leaf"])
    members = F.col("members")
    runs = stored(placed.groupBy("tree", F.expr(f"at div {FAN}").alias("run")).agg(
        F.sort_array(F.collect_list(F.struct("at", F.struct(*kept).alias("row"))))
        .alias("members"), F.first("n").alias("n")).select(
            "tree", F.col("run").alias("at"), "n", F.transform(
                members, lambda x: x["row"]).alias("members"),
            F.concat_ws(".", "tree", F.lit(1), "run").alias("node")).withColumn(
                # A lone leaf is the root of its tree as it is.
                "digest", F.when(F.col("n") == 1, members[0]["leaf"]).otherwise(
                    digest(F.array_join(F.transform(members, lambda x: x["leaf"]), "")))))
    seen = runs.agg(F.max("n"), F.sum(F.size("members"))).first()
    if seen[0] is None:
        return None
    links, tops = _levels(
        runs.select("tree", "at", "node", "digest", F.size("members").cast("long").alias("leaves"),
                    F.expr(f"(n + {FAN - 1}) div {FAN}").alias("m")),
        F.col("tree"), -(-seen[0] // FAN), 1)
    inner = [link.withColumn("top", F.lit(False)) for link in links]
    subroots = stored(reduce(DataFrame.unionByName, tops))
    trees = subroots.count()
    links, tops = _levels(
        subroots.select(F.lit(-1).alias("tree"), F.col("tree").alias("at"), "node", "digest",
                        "leaves", F.lit(trees).cast("long").alias("m")), F.lit("top"), trees, 0)
    outer = [link.withColumn("top", F.lit(i == 0)) for i, link in enumerate(links)]
    wide = seen[1] // WIDE_SHARE

    last = reduce(DataFrame.unionByName, tops).first()
    schema = ("node string, parent string, leaves long, above long, before string, "
              "after string, top boolean")
    empty = leaves.sparkSession.createDataFrame([], schema)
    joined = reduce(DataFrame.unionByName, [empty, *inner, *outer])
    return Manifest(runs, stored(joined.select(
        "node", "parent", "before", "after", "top", (F.col("leaves") > wide).alias("wide"),
        (F.col("above") > wide).alias("parent_wide"))), last["node"], last["digest"])


CLIMB = """
    WITH RECURSIVE climb(start, fold, node, wide, folded, subroot, proof) AS (
        SELECT start, fold, node, wide, folded, subroot, proof FROM {starts}
        UNION ALL
        SELECT c.start, c.fold, l.parent, l.parent_wide,
               sha2(concat(l.before, c.folded, l.after), 256),
               CASE WHEN l.top THEN c.folded ELSE c.subroot END,
               concat(c.proof, l.before, l.after)
        FROM climb c JOIN {links} l ON l.node = c.node)
    SELECT * FROM climb WHERE """


def climbed(starts: DataFrame, links: DataFrame, until: str) -> DataFrame:
    """Climbs carried on over ``links`` by a recursive query, to the nodes of ``until``."""
    spark = starts.sparkSession
    limit = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")  # the recursion ends at the root; its rows are the climbs
    try:
        return stored(spark.sql(CLIMB + until, starts=starts, links=links))
    finally:
        spark.conf.set(ROW_LIMIT, limit)


def verify(manifest: Manifest, claimed: str) -> DataFrame:
    """Every leaf's columns with ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and
    ``verified``: the root recomputed from the leaf's ``claimed`` digest and its siblings.

    A leaf and its siblings fold to a digest of their run; from there a recursive query
    ascends the stored links, appending siblings and folding. Leaves of one run that fold to
    the same digest share one climb, and one climb per run, that of the recorded digest,
    gathers the siblings, as they are the same for all its leaves. The first climb goes over
    nodes of at most 1 / 256 of all leaves each, by a shuffle on the node without a hot key;
    the second over the wide nodes above, which are at most 256 a level and so broadcast.
    """
    members = F.col("members")

    def fold(x: Column, i: Column) -> Column:
        return F.when(F.col("n") == 1, x[claimed]).otherwise(digest(
            _joined(members, i, "leaf", 0), x[claimed], _joined(members, i, "leaf", 1)))

    runs = stored(manifest.runs.select("node", "n", "digest", "members",
                                       F.transform(members, fold).alias("folds")))
    narrow = manifest.links.where("NOT wide")
    broad = manifest.links.where("wide")
    flags = manifest.links.select("node", "wide")
    marked = runs.select("node", "digest", "folds").join(flags, "node", "left").select(
        F.col("node").alias("start"), F.explode(F.array_distinct(F.concat(
            F.array("digest"), "folds"))).alias("fold"), "node",
        F.coalesce("wide", F.lit(True)).alias("wide"), F.col("fold").alias("folded"),
        F.lit(None).cast("string").alias("subroot"),
        F.when(F.col("fold") == F.col("digest"), F.lit("")).alias("proof"))
    high = climbed(stored(marked), narrow, "wide")
    ends = climbed(high, F.broadcast(broad), f"node = '{manifest.root}'")
    by_run = ends.groupBy("start").agg(
        F.max("proof").alias("proof"),
        F.max(F.when(F.col("proof").isNotNull(), F.coalesce("subroot", "folded"))).alias("subroot"),
        F.map_from_entries(F.collect_list(F.struct("fold", "folded"))).alias("roots"))
    joined = runs.join(by_run, runs["node"] == by_run["start"])

    def judged(x: Column, i: Column) -> Column:
        return F.struct(x.alias("row"), F.when(F.col("n") == 1, F.sha2("proof", 256)).otherwise(
            digest(_joined(members, i, "leaf", 0), _joined(members, i, "leaf", 1),
                   F.col("proof"))).alias("proof_sha256"),
            F.col("roots")[F.col("folds")[i]].alias("folded_root"))

    leaves = joined.select("subroot", F.inline(F.transform(members, judged)))
    return leaves.select("row.*", "subroot", F.lit(manifest.root_digest).alias("root"),
                         "proof_sha256", "folded_root",
                         (F.col("folded_root") == F.lit(manifest.root_digest)).alias("verified"))


def op11_merkle_climb(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, subroot, root, proof and verification of every document; a fifth are tampered with.

    Only digests are kept and shuffled, never texts. A NULL doc_id sorts first and is not
    tampered with; documents equal in source and doc_id lie in the order of their leaves, and
    fully equal rows are leaves of their own. NULL and empty texts give different leaves. An
    empty table gives no rows. Columns beyond the five are left out.
    """
    docs = read(spark, folder, "documents")
    names = ("doc_id", "source", "lang", "n_chars", "text")
    parts = [field(F.col(c)) for c in names]
    lowered = field(F.translate("text", UPPER, LOWER))
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    leaves = docs.select("doc_id", "source", digest(*parts).alias("leaf"), F.when(
        checksum % TAMPERED_EVERY == 0, digest(*parts[:-1], lowered)).alias("claimed"))
    leaves = leaves.withColumn("claimed", F.coalesce("claimed", "leaf"))
    manifest = build_manifest(leaves, "source", ["doc_id"])
    if manifest is None:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, "
                                         "proof_sha256 string, folded_root string, verified boolean")
    return verify(manifest, "claimed").drop("claimed")
