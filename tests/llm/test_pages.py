"""WARC bundles, url verdicts and components."""

from __future__ import annotations

import base64
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from querytrail.llm import redirects, warc
from querytrail.llm.components import components
from querytrail.llm.statements import STATEMENTS
from querytrail.llm.tables import read
from querytrail.session import scratch_path

from .conftest import SMALL

PAGES = "page_id long, url string, html string, digest string, best long"


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_warc_round_trip(spark, pages):
    big = "<p>" + "é😀x" * 200_000
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, None),
            (4, "http://a/\r\nx", ""), (5, "u", big), (None, "u", "same"), (None, "u", "only"),
            (6, "u", "twice"), (6, "u", "twice"), (7, "http://a/2", "own\r\n\r\nbody")]
    path = scratch_path(spark, "test")
    warc.write_bundles(pages(rows), path)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
                   None if r.payload is None else bytes(r.payload).decode())
                  for r in warc.read_bundles(spark, path).collect()), key=str)
    expected = []
    for page, _, html in rows:
        other = max((p for p, _, h in rows if (h or "") == (html or "") and p is not None),
                    default=None)
        refers = other if other is not None and (page is None or page < other) else None
        expected.append((page, len((html or "").encode()), b32(html),
                         "revisit" if refers is not None else "response", refers,
                         None if refers is not None else html or ""))
    assert got == sorted(expected, key=str)
    some = warc.fetch_records(spark, path, [5, 7]).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in some) == [
        (5, big), (7, "own\r\n\r\nbody")]


def test_frames_stand_alone_and_the_footer_finds_them(spark, pages):
    rows = [(i, f"http://a/{i}", f"{i} " * 20_000) for i in range(40)]
    path = scratch_path(spark, "test")
    warc.write_bundles(pages(rows).coalesce(1), path)
    bundles = spark.read.parquet(path).collect()
    frames = [(bytes(b.archive), span) for b in bundles
              for span in warc.frame_spans(bytes(b.archive))]
    assert len(frames) > 3
    for archive, span in frames:
        assert warc.read_frame(archive, span).startswith(b"WARC/1.1\r\n")
    for b in bundles:
        archive = bytes(b.archive)
        spans = warc.frame_spans(archive)
        for e in b.entries:
            record = warc.read_frame(archive, spans[e.frame])[e["at"]:e["at"] + e["length"]]
            assert f"WARC-Record-ID: <{e.record_id}>".encode() in record


def test_warc_query_reports_every_page(spark):
    rows = warc.op10_seekable_warc(spark, SMALL).collect()
    assert sorted(r.page_id for r in rows) == sorted(
        r.page_id for r in read(spark, SMALL, "pages").collect())


def test_empty_pages(spark, pages):
    empty = pages([(1, "u", "h")]).where("false")
    path = scratch_path(spark, "test")
    warc.write_bundles(empty, path)
    assert warc.read_bundles(spark, path).count() == 0
    assert redirects.redirect_verdicts(empty).count() == 0


def plain_rule(host, path):
    fitting = [r for r in redirects.RULES
               if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fitting, key=lambda r: len(r.host + r.path), default=None)


def test_rules_and_parts_of_urls(spark, pages):
    urls = [None, "", "example.org/es/", "http://EXAMPLE.org/es/1", "x://a.example.org/en/1#f",
            "http://example.org/en/2?q=/es/", "http://org", "http://org/", "http://a.com/fr/",
            "http://com/de/x", "http://notcom/de/x", "https://É.COM/fr/x", "http://a.b?x://c/d",
            "http://u@example.org:80/es/", "a://b://c", "http:///es/", "http://.example.org/es/"]
    rows = redirects.redirect_verdicts(pages([(i, u, "") for i, u in enumerate(urls)])).collect()
    assert len(rows) == len(urls)
    for r in rows:
        url = urls[r.page_id]
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:].split("?")[0].split("#")[0]
        rule = plain_rule(host, path)
        assert (r.host, r.path) == (host, path), url
        assert r.rule == (rule.host + rule.path if rule else None), url
        assert r.verdict == (rule.verdict if rule else "allow"), url


def test_decisions_spread_over_links_with_allow_first(spark, pages):
    canonical = '<LINK href="{0}" rel=canonical>'
    refresh = "<meta http-equiv='refresh' content='0; url={0}'>"
    rows = [
        (1, "http://a.net/x", canonical.format("http://b.net/y")),
        (2, "https://b.net/y#top", refresh.format("/z")),
        (3, "http://b.net/z", canonical.format("https://example.org/es/1")),   # blocked target
        (4, "http://c.net/", canonical.format("http://www.com/de/1")),         # blocked target
        (5, "http://c.net", canonical.format("http://www.com/fr/1")),          # allowed alias
        (6, "http://a.com/fr/9", canonical.format("http://b.net/y")),          # own rule: allow
        (7, "http://lone.net/1", "no link canonical"),
        (8, None, canonical.format("http://example.org/es/1")),
        (9, "http://a.net/x", ""), (9, "http://a.net/x", ""),
        (10, "http://d.net/a/b", canonical.format("c") + canonical.format("mailto:x@y")),
        (11, "http://d.net/a/c", ""),
    ]
    got = sorted((r.page_id, r.verdict, r.decided_by)
                 for r in redirects.redirect_verdicts(pages(rows)).collect())
    # Page 6 carries an allow rule, so the whole group of aliases 1, 2, 3 and 9 is allowed.
    assert got == [(1, "allow", "alias"), (2, "allow", "alias"), (3, "allow", "alias"),
                   (4, "allow", "alias"), (5, "allow", "alias"), (6, "allow", "rule"),
                   (7, "allow", "default"), (8, "allow", "default"), (9, "allow", "alias"),
                   (9, "allow", "alias"), (10, "allow", "default"), (11, "allow", "default")]
    without = [r for r in rows if r[0] != 6]
    got = {r.page_id: r.verdict for r in redirects.redirect_verdicts(pages(without)).collect()}
    assert [got[i] for i in (1, 2, 3, 9)] == ["block"] * 4
    duck = duckdb.connect()
    duck.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    duck.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    by_sql = duck.execute(f"SELECT page_id, verdict, decided_by FROM ({STATEMENTS['op8_redirect_equivalence']})")
    assert sorted(by_sql.fetchall()) == [g for g in sorted(
        (r.page_id, r.verdict, r.decided_by) for r in redirects.redirect_verdicts(pages(rows)).collect())]
    moved = spark.createDataFrame([("http://lone.net/1", "http://example.org/es/")],
                                  "src string, dst string")
    got = {r.page_id: (r.verdict, r.decided_by)
           for r in redirects.redirect_verdicts(pages(rows), redirects=moved).collect()}
    assert got[7] == ("block", "alias")


def test_components_match_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    edges += [(i, i + 1) for i in range(1000, 1200)]           # a path in order
    edges += [(5000, 5000 + i) for i in range(1, 400)]         # a hub
    edges += [(7, 7), (9000, 9000), (None, 3)]
    frame = spark.createDataFrame(edges, "a long, b long")
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            parent[root(a)] = root(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(root(x), set()).add(x)
    got = {}
    for r in components(frame).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))
    assert all(k in v for k, v in got.items())
    assert components(frame.where("false")).count() == 0


def test_allow_goes_before_block_of_one_length(spark):
    """Whatever the order of the rules; a longer rule still wins."""
    rules = [redirects.Rule("block", "a.org", "/x"), redirects.Rule("allow", "a.org", "/x"),
             redirects.Rule("block", "a.org", "/xyz"), redirects.Rule("allow", "b.org", "/x"),
             redirects.Rule("block", "b.org", "/x")]
    rows = [("a.org", "/x1"), ("a.org", "/xyz"), ("b.org", "/x"), ("c.org", "/x")]
    frame = spark.createDataFrame(rows, "host string, path string")
    for order in (rules, rules[::-1]):
        got = frame.withColumn("r", redirects.matching_rule(
            F.col("host"), F.col("path"), order)).collect()
        assert [r.r and r.r.verdict for r in got] == ["allow", "block", "allow", None]
