"""Log tables derived, whole, from the given star-schema and document tables.

The rules are written down in ``FIXTURES.md``.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import null_safe_join
from ..operators.ordered import with_sum_before
from ..session import spread

WORD_BREAK = "[ \n]+"


# Fixed values of the fixture: characters per query, and room for an event's rows in row ids.
QUERY_CHARS = 30
ROWS_OF_EVENT = 1_000_000


class Tables:
    """The given Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._sizes: dict[str, int] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, table)
        return table

    def rows(self, name: str) -> int:
        """Rows of a table, from the file footers alone."""
        if name not in self._sizes:
            self._sizes[name] = getattr(self, name).count()
        return self._sizes[name]


def _session(user: Column, ts: Column) -> Column:
    return F.concat(user.cast("string"), F.lit("-"), F.date_format(ts, "yyyyMMdd"))


def _visits(t: Tables, doc: Column) -> Column:
    """Events that visit a document: event e visits document e % D, ids running from 0."""
    n_docs, n_events = t.rows("documents"), t.rows("events")
    return F.greatest(F.floor((F.lit(n_events - 1) - doc) / n_docs).cast("long") + 1, F.lit(0))


def _queries(visits: Column) -> Column:
    """Queries of one visit, by the document's length alone, so that no text is read for it.

    NULL for a document without a visit, as where documents outnumber events.
    """
    share = F.floor(F.coalesce("n_chars", F.lit(0)) / F.nullif(visits, F.lit(0)))
    return (F.floor(share / QUERY_CHARS) + 1).cast("int")


def _stamp(event: Column, ts: Column) -> Column:
    seconds = F.unix_seconds(ts)
    return (F.when(event % 301 == 0, F.lit(0).cast("long"))
            .when(event % 13 == 0, seconds * 1000).otherwise(seconds))


def _event_rows(t: Tables) -> DataFrame:
    """One row per event: its session, the rows it has in the log and those before it there."""
    event, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    visits = _visits(t, F.col("doc_id"))
    lengths = t.documents.select("doc_id", visits.alias("visits"),
                                 _queries(visits).alias("n_queries"))
    events = (t.events.select("event_id", ts.alias("event_ts"), _session(F.col("user_id"), ts)
                              .alias("sid"), (event % t.rows("documents")).alias("doc_id"))
              .join(lengths, "doc_id"))
    # Every seventeenth event has one query more, which is missing.
    sized = events.withColumns({
        "MESSAGE_ID": (event % 2).cast("string"),
        "n_rows": F.col("n_queries") + (event % 17 == 0).cast("int")})
    return with_sum_before(sized, ["sid", "MESSAGE_ID"], ["event_ts", "event_id"],
                           F.col("n_rows"), "before", rows_at_most=t.rows("events"))


def _log_rows(events: DataFrame, *extra: Column) -> DataFrame:
    """The log's rows, exploded from the events, which are numbered already."""
    event, position = F.col("event_id"), F.col("before") + F.col("j") + 1
    rows = events.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))).withColumn(
        "ts", F.timestamp_add("SECOND", F.col("j"), F.col("event_ts")))
    return rows.select(
        (event * ROWS_OF_EVENT + F.col("j")).alias("row_id"),
        F.when(event % 211 != 0, F.col("sid")).alias("JOB_ID"),
        "MESSAGE_ID",
        (position + F.when(event % 50 == 0, 1).otherwise(0)).alias("QUERY_COUNTER"),
        _stamp(event, F.col("ts")).alias("TIMESTAMP"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("TIMESTAMP_FORMATTED"), *extra)


def event_log(t: Tables) -> DataFrame:
    """The query log without its queries; no text is read for it."""
    return _log_rows(_event_rows(t))


def query_log(t: Tables) -> DataFrame:
    """The whole log: every word of every visited document, cut into queries.

    The visits of a document take contiguous slices of its words in turn, the queries of a
    visit contiguous parts of its slice. Where there are fewer words than parts, neighbours
    share a word. Documents and events are joined before the queries are exploded, so the
    rows of the log are not shuffled.
    """
    # Texts are shuffled and sorted as they are, and split after that, below the join: arrays
    # of words take several times their room. A document is split once, not for every query.
    words = t.documents.select("doc_id", "text").repartition("doc_id").sortWithinPartitions(
        "doc_id").select("doc_id", F.split(F.lower("text"), WORD_BREAK).alias("words"))

    def cut(low: Column, high: Column, part: Column, parts: Column) -> tuple[Column, Column]:
        begin = low + F.floor((high - low) * part / parts)
        end = low + F.floor((high - low) * (part + 1) / parts)
        return begin, F.greatest(end, begin + 1)

    visit = F.floor(F.col("event_id") / t.rows("documents"))
    low, high = cut(F.lit(0), F.size("words"), visit, F.col("visits"))
    # Texts are never broadcast, however small their file: each stays in its own task.
    events = _event_rows(t).join(words.hint("merge"), "doc_id").withColumn("w", F.explode(F.array(
        F.slice("words", (low + 1).cast("int"), (high - low).cast("int"))))).drop("words")
    first, last = cut(F.lit(0), F.size("w"), F.col("j"), F.col("n_queries"))
    part = F.slice("w", (first + 1).cast("int"), (last - first).cast("int"))
    kind = F.col("event_id") + F.col("j")
    query = (F.when(F.col("j") == F.col("n_queries"), F.lit(None).cast("string"))
             .when(kind % 5 == 0, F.array_join(part, " and "))
             .when(kind % 7 == 0, F.concat(F.lit("+"), F.array_join(part, " "), F.lit("*")))
             .otherwise(F.array_join(part, " ")))
    return _log_rows(events, query.alias("QUERY"))


def response_log(t: Tables) -> DataFrame:
    event, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    kind = (F.when(event % 97 == 0, F.lit(None).cast("int"))
            .when(F.col("event_type") == "purchase", 1)
            .when(F.col("event_type") == "signup", 2).otherwise(0))
    return t.events.where(F.col("event_type") != "view").select(
        event.alias("row_id"),
        _session(F.col("user_id"), ts).alias("JOB_ID"),
        F.when(event % 89 != 0, event).alias("CV_ID"),
        _stamp(event, ts).alias("TIMESTAMP"),
        kind.alias("RESPONSE_TYPE"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("TIMESTAMP_FORMATTED"))


def industry_session(t: Tables) -> DataFrame:
    event, user = F.col("event_id"), F.col("user_id")
    name = (F.when(user % 23 == 0, F.lit(None).cast("string"))
            .when(event % 10 == 0, F.lit("sector_x"))
            .otherwise(F.concat(F.lit("sector"), (user % 12).cast("string"))))
    return t.events.select(event.alias("row_id"),
                           _session(user, F.col("ts").cast("timestamp")).alias("JOB_ID"),
                           name.alias("INDUSTRY_SECTOR_NAME"))


def job_ads(t: Tables) -> DataFrame:
    kind = F.col("doc_id") % 4
    ending = (F.when(kind == 0, F.lit(" mailto:hr@example.com end"))
              .when(kind == 1, F.lit(" see http://jobs.example/1 now"))
              .when(kind == 2, F.lit(" a\u0096b\u0092s")).otherwise(F.lit("")))
    return spread(t.documents.select("doc_id", "text"), "doc_id").select(
        F.col("doc_id").alias("row_id"), F.col("doc_id").alias("job_id"),
        F.concat(F.lit("  "), F.col("text"), ending).alias("text"))


def skills_raw(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", (F.col("doc_id") % t.rows("benchmark")).alias("item_id"))
    tags = t.benchmark.select(F.col("item_id"), F.split("text", WORD_BREAK).alias("w"))
    words = docs.join(tags, "item_id").select("doc_id", F.posexplode("w").alias("i", "k"))
    n, k = F.col("doc_id") + F.col("i"), F.col("k")
    skill = (F.when(n % 31 == 0, F.lit("NA"))
             .when(n % 29 == 0, F.lit("  "))
             .when(n % 3 == 0, F.concat(
                 F.lit(" "), F.translate(F.substring(k, 1, 1), ascii_lowercase, ascii_uppercase),
                 F.expr("substring(k, 2)"), F.lit(" ")))
             .when(n % 7 == 0, F.concat(F.substring(k, 1, 2), F.lit("-"),
                                        F.expr("substring(k, 3)")))
             .otherwise(k))
    return words.select(F.col("doc_id").alias("job_id"), skill.alias("skill"))


def job_queries(t: Tables) -> DataFrame:
    """What was searched for per job: the whole document text."""
    return spread(t.documents.select("doc_id", "text"), "doc_id").select(
        F.col("doc_id").alias("job_id"), F.col("text").alias("query"))


def industry_raw(t: Tables) -> DataFrame:
    doc = F.col("doc_id")
    low = doc % 7 * 50
    size = F.when(doc % 9 == 0, F.lit("NA")).otherwise(
        F.concat(F.lit(" "), low.cast("string"), F.lit("-"), (low + 49).cast("string"),
                 F.lit(" ")))
    base = t.documents.select(
        doc.alias("job_id"), (doc % 100).alias("company_id"),
        F.concat(F.lit("Company "), (doc % 100).cast("string")).alias("company_name"),
        F.when(doc % 23 != 0, F.col("source")).alias("industry_sector_name"),
        F.col("lang").alias("industry_division_name"),
        size.alias("employee_count"))
    # Every tenth job has a second row.
    second = F.struct(F.lit("src_extra").alias("industry_sector_name"),
                      F.lit(" 10-19 ").alias("employee_count"))
    first = F.struct("industry_sector_name", "employee_count")
    rows = F.when(F.col("job_id") % 10 == 0, F.array(first, second)).otherwise(F.array(first))
    return (base.withColumn("row", F.explode(rows))
            .select("job_id", "company_id", "company_name",
                    F.col("row.industry_sector_name"), "industry_division_name",
                    F.col("row.employee_count")))


def area_raw(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    low = key % 500 + 1000
    name = (F.when(key % 10 == 0, F.col("n_name"))
            .when(key % 10 == 1, F.concat_ws("", low.cast("string"), F.lit("-"),
                                             (low + 499).cast("string"), F.lit(" "),
                                             F.col("n_name")))
            .otherwise(F.concat_ws(" ", (key % 9000 + 1000).cast("string"), F.col("n_name"))))
    nations = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return (t.customer.select("c_custkey", "c_nationkey").join(nations, "c_nationkey")
            .select(key.alias("location_id"), name.alias("location_name")))


def job_locations(t: Tables, areas: DataFrame) -> DataFrame:
    """A city per job: location ids run from 1, jobs take them in turn."""
    job = F.col("doc_id")
    jobs = t.documents.select(job.alias("job_id"),
                              (job % t.rows("customer") + 1).alias("location_id"))
    cities = areas.select("location_id", F.col("city_full").alias("location_name"))
    return null_safe_join(jobs, cities, ["location_id"]).select("job_id", "location_name")
