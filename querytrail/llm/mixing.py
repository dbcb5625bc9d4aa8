"""Operator 4: raking token weights to source, language and topic marginals, then sampling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .tables import col, read

DIMENSIONS = ("source", "lang", "topic")
# A target share is proportional to the tokens there are, raised to this power.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
TOLERANCE = 1e-5         # raking ends when no marginal is further off than this share
MOST_SWEEPS = 50
TOKEN_SHARE = 0.7        # of all tokens, the expected size of the sample
SEED = 20240607
NONE = "(none)"


def token_count(text: Column) -> Column:
    """Words between white space; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def register(text: Column) -> Column:
    """The default topic: what kind of writing a text is, by its form."""
    words = F.greatest(token_count(text), F.lit(1))
    cells = F.regexp_count(text, F.lit(r"\|"))
    marks = F.regexp_count(text, F.lit(r"[#*$%&<>]"))
    shouts = F.regexp_count(text, F.lit("!!"))
    lines = F.regexp_count(text, F.lit(r"\n")) + 1
    return (F.when(cells * 5 > words, "table").when(marks * 3 > words, "symbols")
            .when(shouts * 3 > words, "shouting").when(words < 50, "snippet")
            .when(lines * 12 > words, "list").when(words >= 1000, "long prose")
            .otherwise("prose"))


def whole_target(cells: DataFrame, name: str, target: DataFrame) -> DataFrame:
    """``name, target`` of every value that occurs in ``cells``; the targets sum to 1.

    A value without a target keeps its present share of the tokens, and those with one divide
    what is left in proportion to their targets. Targets of values that do not occur are left
    out; those of a value given twice add up; NULL is the value ``(none)``. Targets that are
    all 0, with no other value to take the tokens, say nothing: shares stay as they are.
    """
    total = cells.agg(F.sum("tokens").alias("tokens")).scalar()
    given = target.select(F.coalesce(F.col(name).cast("string"), F.lit(NONE)).alias(name),
                          F.col("target").cast("double").alias("given")).groupBy(name).agg(
                              F.sum("given").alias("given"))
    shares = cells.groupBy(name).agg((F.sum("tokens") / total).alias("share")).join(
        given, name, "left")
    sums = shares.agg(F.struct(
        F.coalesce(F.sum("given"), F.lit(0.0)).alias("given"),
        F.coalesce(F.sum(F.when(F.col("given").isNull(), F.col("share"))), F.lit(0.0))
        .alias("free"))).scalar()
    left_over = F.when(F.col("sums.given") > 0, 1 - F.col("sums.free")).otherwise(0.0)
    part = F.when(F.col("given").isNull(), F.col("share")).otherwise(
        F.coalesce(F.try_divide("given", F.col("sums.given")), F.lit(0.0)) * left_over)
    said = (F.col("sums.given") > 0) | (F.col("sums.free") > 0)
    return shares.withColumn("sums", sums).select(name, F.when(
        said, part / (F.col("sums.free") + left_over)).otherwise(F.col("share")).alias("target"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], tolerance: float = TOLERANCE,
         most_sweeps: int = MOST_SWEEPS) -> DataFrame:
    """``cells`` with ``mass``: token shares fitted to the target marginals in turn.

    Iterative proportional fitting over the cells (one row per combination that occurs, with
    ``tokens``): each step scales the masses of one dimension's values to their targets. The
    sums are pre-aggregated and joined back by the value, so a dimension with many values
    stays distributed. Every step is written, so that plans stay small and a lost executor
    costs one step; the sweeps end when no value is scaled by more than ``tolerance``.

    Targets need not name every value (``whole_target``), so no cell is lost. They may ask for
    what the cells that occur cannot give; then the sweeps end after ``most_sweeps``, and
    ``marginal_error``, the same in every row, says how far off the worst marginal is left.
    """
    total = cells.agg(F.sum("tokens").alias("tokens")).scalar()
    fitted = cells.withColumn("mass", F.col("tokens") / total)
    for name, target in targets.items():
        fitted = fitted.join(whole_target(cells, name, target).withColumnRenamed(
            "target", f"__{name}"), name)
    fitted = stored(fitted.withColumn("moved", F.lit(0.0)))
    for _ in range(most_sweeps):
        for i, name in enumerate(targets):
            # A value whose cells all have no mass left cannot be scaled.
            scales = fitted.groupBy(name).agg(F.coalesce(
                F.try_divide(F.first(f"__{name}"), F.sum("mass")), F.lit(1.0)).alias("scale"))
            moved = F.abs(F.col("scale") - 1)
            fitted = stored(fitted.join(scales, name).withColumns({
                "mass": F.col("mass") * F.col("scale"),
                "moved": F.greatest("moved", moved) if i else moved}).drop("scale"))
        most = fitted.agg(F.max("moved")).first()[0]
        if most is None or most <= tolerance:
            break
    errors = [fitted.groupBy(name).agg(F.abs(F.sum("mass") - F.first(f"__{name}")).alias("off"))
              .agg(F.max("off").alias("off")).scalar() for name in targets]
    return fitted.withColumn("marginal_error", F.greatest(F.lit(0.0), *errors)).drop(
        "moved", *[f"__{name}" for name in targets])


def calibrated(cells: DataFrame, token_share: float) -> DataFrame:
    """``cells`` with ``probability``: proportional to mass over tokens, at most 1.

    The factor is set so that the expected tokens are ``token_share`` of all. Cells whose
    probability would exceed 1 are taken whole and the rest is scaled anew, until none does.
    """
    sums = cells.agg(F.sum("tokens")).first()[0] or 0
    wanted = token_share * sums
    ratio = F.col("mass") / F.col("tokens")
    factor, whole = 0.0, -1
    for _ in range(MOST_SWEEPS):
        full = ratio * factor >= 1
        found = cells.agg(
            F.count_if(full).alias("whole"),
            F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("taken"),
            F.sum(F.when(~full, F.col("mass")).otherwise(0.0)).alias("open")).first()
        if found["whole"] == whole or not found["open"]:
            break
        whole, factor = found["whole"], max(factor, (wanted - found["taken"]) / found["open"])
    return cells.withColumn("probability", F.least(F.lit(1.0), ratio * factor))


def draw(*columns: Column) -> Column:
    """A number from 0 up to 1 that depends on the values alone."""
    return F.pmod(F.xxhash64(F.lit(SEED), *columns), F.lit(1 << 53)) / float(1 << 53)


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", topic: Column | None = None,
        powers: Mapping[str, float] = POWERS, token_share: float = TOKEN_SHARE,
        targets: Mapping[str, DataFrame] | None = None,
        keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, source, lang, topic, n_tokens, weight, probability, kept, marginal_error`` of
    every document.

    The tokens of each (source, language, topic) are raked to target marginals; a cell's
    ``weight`` is its fitted share over its present share. Documents are drawn with the
    cell's calibrated ``probability`` by a hash of key and text, so a rerun draws the same
    and copies with one key share a fate.

    ``targets`` gives frames of a dimension's value and ``target`` share; otherwise the
    target is proportional to the tokens at hand to the power in ``powers``. Values without a
    target keep their present share; only a target of 0 takes documents out. Targets that
    cannot all be met leave a ``marginal_error`` above ``TOLERANCE``: how far the worst marginal
    share is from its target (NULL for documents without tokens). ``topic`` is any
    column, by default the register of the text. ``keep`` names columns to carry along.

    Counting is one aggregate that is combined before its shuffle, the raking works on the
    cells alone, and the cells are joined back by their three values, where adaptive execution
    may split a cell of a third of all rows; no document is gathered or dropped.

    A NULL source or language is a value of its own, shown as ``(none)``. Texts without
    tokens (NULL, empty) carry no weight: their weight and probability are 0 and they are not
    kept. An empty table gives no rows. Extra columns are left out unless kept.
    """
    body = F.col(text)
    extra = [c for c in keep if c not in (key,)]
    rows = docs.select(
        col(key).alias("__key"), F.coalesce(F.col("source"), F.lit(NONE)).alias("__source"),
        F.coalesce(F.col("lang"), F.lit(NONE)).alias("__lang"),
        F.coalesce(register(body) if topic is None else topic, F.lit(NONE)).alias("__topic"),
        token_count(body).alias("__tokens"), draw(col(key), body).alias("__draw"),
        *[col(c).alias(f"__keep_{i}") for i, c in enumerate(extra)])
    if not extra:
        rows = stored(rows)  # narrow: read for the cells and again for the result
    names = {d: f"__{d}" for d in DIMENSIONS}
    cells = stored(rows.where("__tokens > 0").groupBy(*names.values()).agg(
        F.sum("__tokens").alias("tokens")).select(
            *[F.col(c).alias(d) for d, c in names.items()], "tokens"))
    goals = {}
    for name in DIMENSIONS:
        if targets and name in targets:
            goals[name] = stored(targets[name].select(name, "target"))
            continue
        sums = cells.groupBy(name).agg(F.pow(F.sum("tokens"), F.lit(powers[name])).alias("part"))
        goals[name] = stored(sums.select(
            name, (F.col("part") / sums.agg(F.sum("part").alias("all")).scalar()).alias("target")))
    fitted = calibrated(rake(cells, goals), token_share)
    total = cells.agg(F.sum("tokens").alias("all")).scalar()
    weights = stored(fitted.select(
        *[F.col(d).alias(c) for d, c in names.items()], "probability", "marginal_error",
        (F.col("mass") * total / F.col("tokens")).alias("weight")))
    chance = F.when(F.col("__tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0)
    return rows.join(weights, list(names.values()), "left").select(
        F.col("__key").alias(key), *[F.col(f"__keep_{i}").alias(c) for i, c in enumerate(extra)],
        *[F.col(c).alias(f"mix_{d}" if d in extra else d) for d, c in names.items()],
        F.col("__tokens").alias("n_tokens"),
        F.when(F.col("__tokens") > 0, F.coalesce("weight", F.lit(0.0))).otherwise(0.0)
        .alias("weight"), chance.alias("probability"), (F.col("__draw") < chance).alias("kept"),
        "marginal_error")


def op4_raking_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Weight, probability and draw of every document."""
    return mix(read(spark, folder, "documents"))
