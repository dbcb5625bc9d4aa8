"""Operator 2: secrets by pattern and by a battery of randomness tests."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase, digits

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .tables import read

# The base patterns, in the order in which kinds are listed.
KEYWORDS = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = KEYWORDS + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 8, 16, 32

RANDOM = "random"
LEAST_CHARS = 20        # below this the tests have no power against words
FALSE_DISCOVERIES = 0.05
P_BINS = 50
LENGTH_BANDS = 8        # half octaves: 20-28, 29-39, 40-56, ...; the last is open
# A token may follow an equals sign, as in NAME=token; only after it they are padding.
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST_CHARS},}}={{0,2}}(?![A-Za-z0-9+/_=-])"

# Encoding: alphabet, pattern of its members. The first that fits is inferred; tokens of
# letters of one case or of digits alone are words and numbers, not codes.
ENCODINGS = (
    ("hex", digits + "abcdef", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$"),
    ("HEX", digits + "ABCDEF", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$"),
    ("base32", ascii_uppercase + "234567", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$"),
    ("base36", ascii_lowercase + digits, r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$"),
    ("BASE36", ascii_uppercase + digits, r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$"),
    ("base62", ascii_uppercase + ascii_lowercase + digits,
     r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$"),
    ("base64", ascii_uppercase + ascii_lowercase + digits + "+/",
     r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$"),
    ("base64url", ascii_uppercase + ascii_lowercase + digits + "-_",
     r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+$"),
)

# Matches that are placed one after the other before their run is moved as a whole.
RUN = 256


def match_spans(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, match>>`` of the leftmost non-overlapping matches.

    Offsets count code points. What lies between matches is what splitting gives, so the
    offsets are running sums of two arrays of lengths. Appending copies an array, so matches
    are placed in runs of RUN, and the runs are then moved to where they begin: the work
    grows with the number of matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    kind = "array<struct<start:int,end:int,match:string>>"
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("match"))

    def named(value: Column, use) -> Column:
        """``use`` of a value that is computed once, however often it is named."""
        return F.transform(F.array(value), use)[0]

    def place(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match"))
        return F.struct(end.alias("at"), F.array_append(state["out"], span).alias("out"))

    def run(own: Column) -> Column:
        return F.aggregate(own, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
                           place)

    def runs(all_pairs: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(all_pairs), F.lit(1)), F.lit(RUN))
        return F.transform(firsts, lambda first: run(F.slice(all_pairs, first, RUN)))

    def begins(placed: Column) -> Column:
        return F.aggregate(
            placed, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda state, own: F.struct(
                (state["at"] + own["at"]).alias("at"),
                F.array_append(state["out"], state["at"]).alias("out")),
            lambda state: state["out"])

    def moved(own: Column, begin: Column) -> Column:
        return F.transform(own["out"], lambda s: F.struct(
            (s["start"] + begin).alias("start"), (s["end"] + begin).alias("end"),
            s["match"].alias("match")))

    spans = named(named(pairs, runs), lambda placed: F.flatten(
        F.zip_with(placed, begins(placed), moved)))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(kind))


def normal_tail(z: Column) -> Column:
    """Chance that a standard normal value exceeds ``z``, to about 1.5e-4 (a logistic fit)."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def inferred_encoding(token: Column) -> Column:
    """Index into ENCODINGS, or NULL."""
    branch = None
    for i, (_, _, pattern) in enumerate(ENCODINGS):
        fits = token.rlike(pattern)
        branch = F.when(fits, i) if branch is None else branch.when(fits, i)
    return branch


def class_change(alphabet: str) -> float:
    """Chance that two characters drawn evenly from an alphabet differ in class."""
    classes = (ascii_lowercase, ascii_uppercase, digits, "+/-_")
    return 1 - sum((sum(c in own for c in alphabet) / len(alphabet)) ** 2 for own in classes)


def bounded(z: Column) -> Column:
    return F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))


def unevenness(token: Column, alphabet: Column, size: Column, change: Column) -> list[Column]:
    """Three standard deviates of a token against even draws from its alphabet.

    Chi-squared of the character counts (its cube root is nearly normal), runs of equal
    character class (letter or digit, with case), and correlation of neighbouring places in
    the alphabet.
    """
    n = F.length(token).cast("double")
    counts = F.transform(F.split(alphabet, ""),
                         lambda s: n - F.length(F.replace(token, s, F.lit(""))))
    squares = F.aggregate(counts, F.lit(0.0), lambda total, c: total + c * c)
    spread = F.lit(2.0) / (9 * (size - 1))
    ratio = F.greatest((size * squares / n - n) / (size - 1), F.lit(0.0))
    even = (F.pow(ratio, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)

    classes = F.translate(token, ascii_lowercase + ascii_uppercase + digits + "+/-_",
                          "a" * 26 + "A" * 26 + "0" * 10 + "++++")
    runs = F.length(F.regexp_replace(classes, r"(.)\1*", "r")).cast("double")
    mixed = ((F.abs(runs - 1 - (n - 1) * change) - 0.5)
             / F.sqrt(F.greatest((n - 1) * change * (1 - change), F.lit(0.25))))

    places = F.transform(F.split(token, ""), lambda s: F.instr(alphabet, s) - (size + 1) / 2)
    products = F.zip_with(F.slice(places, F.lit(1), F.length(token) - 1),
                          F.slice(places, F.lit(2), F.length(token) - 1), lambda a, b: a * b)
    serial = F.aggregate(products, F.lit(0.0), lambda total, p: total + p)
    free = F.abs(serial * 12 / (size * size - 1)) / F.sqrt(n - 1)
    return [bounded(even).alias("even"), bounded(mixed).alias("mixed"),
            bounded(free).alias("free")]


def battery(z: Column) -> Column:
    """Chance that an even draw is as uneven as a token with these deviates.

    The least of the three tests' chances, corrected for being the least of three: spread
    evenly for random codes, near 0 for words.
    """
    least = F.least(F.lit(1.0), normal_tail(z["even"]), 2 * normal_tail(z["mixed"]),
                    2 * normal_tail(z["free"]))
    return 1 - F.pow(1 - least, F.lit(3))


def length_band(n: Column) -> Column:
    """Tokens are judged among those of like length: half octaves from LEAST_CHARS up."""
    return F.least(F.floor(2 * F.log2(n / LEAST_CHARS)), F.lit(LENGTH_BANDS - 1)).cast("int")


def candidates(text: Column) -> Column:
    """``array<struct<start, end, stratum, token, chance>>`` of tokens with an inferred encoding.

    ``token`` is the hash of the token without its padding.

    Each step names what the next one uses, so nothing is computed twice.
    """
    alphabets = F.array(*[F.lit(a) for _, a, _ in ENCODINGS])
    changes = F.array(*[F.lit(class_change(a)) for _, a, _ in ENCODINGS])

    def named(span: Column) -> Column:
        return F.struct(span["start"].alias("start"), span["end"].alias("end"),
                        F.regexp_replace(span["match"], "=+$", "").alias("token"))

    def coded(t: Column) -> Column:
        return F.struct(t["start"].alias("start"), t["end"].alias("end"),
                        t["token"].alias("token"), inferred_encoding(t["token"]).alias("code"))

    def placed(t: Column) -> Column:
        alphabet = F.get(alphabets, t["code"])
        return F.struct(
            t["start"].alias("start"), t["end"].alias("end"), t["token"].alias("token"),
            alphabet.alias("alphabet"), F.length(alphabet).cast("double").alias("size"),
            F.get(changes, t["code"]).alias("change"),
            (t["code"] * LENGTH_BANDS + length_band(F.length(t["token"]))).alias("stratum"))

    def tested(t: Column) -> Column:
        return F.struct(t["start"].alias("start"), t["end"].alias("end"),
                        t["stratum"].alias("stratum"),
                        F.xxhash64(t["token"]).alias("token"),
                        *unevenness(t["token"], t["alphabet"], t["size"], t["change"]))

    def judged(t: Column) -> Column:
        return F.struct(t["start"].alias("start"), t["end"].alias("end"),
                        t["stratum"].alias("stratum"), t["token"].alias("token"),
                        battery(t).alias("chance"))

    known = F.filter(F.transform(F.transform(match_spans(text, CANDIDATE), named), coded),
                     lambda t: t["code"].isNotNull())
    return F.transform(F.transform(F.transform(known, placed), tested), judged)


def thresholds(found: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """``stratum, least``: chance from which tokens of a stratum count as random.

    Random tokens spread evenly over the chances, ordinary ones crowd near 0. The upper half
    of a stratum therefore tells how many random tokens each bin should hold; what exceeds
    that from a bin upwards are ordinary tokens taken for random. The threshold is the lowest
    bin from which their share stays within ``rate``. A stratum is an encoding and a band of
    lengths, so short tokens, which words match more easily, are judged among themselves.
    Strata and bins are few, whatever the corpus. Copies of a token are no further tests, so
    each distinct token counts once; copies are merged before the shuffle.
    """
    distinct = found.groupBy(F.col("c.stratum").alias("stratum"), F.col("c.token").alias("token")
                             ).agg(F.min("c.chance").alias("chance"))
    hist = distinct.select(
        "stratum",
        F.least(F.floor(F.col("chance") * P_BINS), F.lit(P_BINS - 1)).cast("int").alias("bin")
    ).groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n"))
    strata = hist.groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by_bin"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(P_BINS - 1)), lambda b: F.coalesce(
        F.try_element_at("by_bin", b), F.lit(0)).cast("double"))

    def total(a: Column, first: Column) -> Column:
        return F.aggregate(F.slice(a, first + 1, P_BINS), F.lit(0.0), lambda s, v: s + v)

    per_bin = total(F.col("n"), F.lit(P_BINS // 2)) / (P_BINS - P_BINS // 2)

    def acceptable(b: Column) -> Column:
        above = total(F.col("n"), b)
        return (above > 0) & (above - per_bin * (P_BINS - b) <= rate * above)

    lowest = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(P_BINS - 1)), acceptable))
    return strata.select("stratum", counts.alias("n")).select(
        "stratum", (lowest / P_BINS).alias("least")).where("least is not null")


def joined(spans: Column, kinds: Column) -> Column:
    """Spans of (start, rank, end), ordered, as ``kind:start:end`` with commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """``keep`` columns, ``spans array<struct<start, rank, end>>`` and ``random`` likewise.

    ``spans`` holds the base kinds (rank 0 assign, 1 access, 2 hex), ``random`` the tokens
    that the randomness tests add (rank 3) and that lie in no base span. Texts are scanned
    once; the spans of each document are written, the few strata's thresholds are one scalar
    value of the plan, and no document is shuffled.

    NULL and empty texts have no spans; repeated rows get the same answer each; an empty
    table gives no rows; extra columns are left out.
    """
    kind = "array<struct<start:int,rank:int,end:int>>"
    body = F.coalesce(F.col(text), F.lit(""))

    def base(pattern: str, rank: int, fits) -> Column:
        return F.transform(F.filter(match_spans(body, pattern), fits), lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))

    scanned = stored(docs.select(
        *keep,
        F.concat(
            F.when(body.rlike(KEYWORDS), base(ASSIGN, 0, lambda s: F.length(
                F.regexp_extract(s["match"], ASSIGN, 1)) >= ASSIGN_CHARS)).otherwise(
                    F.array().cast(kind)),
            base(ACCESS, 1, lambda s: F.length(s["match"]) >= ACCESS_CHARS),
            # Shorter runs fail anyway and no match can begin within one.
            base(HEX.replace("+", f"{{{HEX_CHARS},}}"), 2, lambda s: F.lit(True))
        ).cast(kind).alias("spans"),
        candidates(body).alias("found")))
    least = thresholds(scanned.select(F.explode("found").alias("c")), rate)
    by_stratum = least.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "least")))
                           .alias("by_stratum")).scalar()

    def accepted(c: Column) -> Column:
        limit = F.coalesce(F.try_element_at(F.col("limits"), c["stratum"]), F.lit(2.0))
        inside = F.exists("spans", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
        return (c["chance"] >= limit) & ~inside

    return scanned.withColumn("limits", by_stratum).select(
        *keep, "spans", F.transform(F.filter("found", accepted), lambda c: F.struct(
            c["start"].alias("start"), F.lit(3).alias("rank"), c["end"].alias("end")))
        .cast(kind).alias(RANDOM))


def op2_randomness_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every whole document text, with counts, digest and all spans."""
    found = find_secrets(read(spark, folder, "documents"))
    kinds = F.array(*[F.lit(k) for k in ("assign", "access", "hex", RANDOM)])

    def count(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.col("spans"), kinds), 256).alias("base_sha256"),
        joined(F.concat("spans", RANDOM), kinds).alias("spans"),
        F.size(RANDOM).cast("long").alias("n_random"))
