"""Secrets and personal data against plain regular expressions."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from querytrail.llm import pii, secrets
from querytrail.llm.tables import read

from .conftest import SMALL

SECRET_PATTERNS = {
    "assign": re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
                         r"([A-Za-z0-9+/_.=-]+)", re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
PII_PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_secrets(text):
    out = []
    for rank, (kind, pattern) in enumerate(SECRET_PATTERNS.items()):
        for m in pattern.finditer(text or ""):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def plain_personal(text):
    out = []
    for kind, pattern in PII_PATTERNS.items():
        for m in pattern.finditer(text or ""):
            numerals = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                doubled = [sum(divmod(int(c) * 2, 10)) if i % 2 else int(c)
                           for i, c in enumerate(numerals[::-1])]
                if not 16 <= len(numerals) <= 19 or sum(doubled) % 10:
                    continue
            if kind == "phone" and not 8 <= len(numerals) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def sha(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def odd_texts(seed, pieces, n=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


SECRET_PIECES = ["password", "PassWd", "api_key", "ApiKey", "token", "secret", "ſecret", "=", ":",
                 " ", '"', "'", "abcdef0123456789", "AKIA", "ABCDEFGH1234", "é😀", "\n", "x-y.z/",
                 "deadbeefdeadbeefdeadbeefdeadbeef", "K"]
PII_PIECES = ["a.b", "@", "x-1.com", ".", "1.2.3.4", "256", "+", "+1 (555)", " 555-1234", "-", " ",
              "4111 1111 1111 1111", "4111111111111111", "00001", "é😀", "\n", "9", "(", ")"]


def test_base_secrets_match_plain_expressions(spark, documents):
    texts = [None, "", *odd_texts(1, SECRET_PIECES)]
    long = "word " * 60_000 + "token=abcdefgh1 " * 50
    frame = documents([(i, t) for i, t in enumerate([*texts, long, long])])
    rows = {r.doc_id: r for r in secrets.find_secrets(frame).collect()}
    kinds = list(SECRET_PATTERNS)
    for i, text in enumerate([*texts, long, long]):
        got = [f"{kinds[s.rank]}:{s.start}:{s.end}" for s in sorted(rows[i].spans)]
        assert got == plain_secrets(text), text


def test_secret_query_columns(spark, folder, documents):
    table = read(spark, SMALL, "documents")
    rows = secrets.op2_randomness_secrets(spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in table.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        expected = plain_secrets(texts[r.doc_id])
        assert r.base_sha256 == sha(expected)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(
            sum(e.startswith(k) for e in expected) for k in SECRET_PATTERNS)
        assert set(filter(None, expected)) <= set(r.spans.split(","))


def test_random_tokens_found_and_words_left(spark, documents):
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = ["the", "Of", "and", "Thing", "house", "Water", "line", "under"]
    codes = ["".join(rng.choices(alphabet, k=40)) for _ in range(200)]
    ordinary = ["".join(rng.choices(words, k=9)) + "2024" for _ in range(200)]
    frame = documents([(i, f"see {t} here") for i, t in enumerate(codes + ordinary)])
    rows = {r.doc_id: r.random for r in secrets.find_secrets(frame).collect()}
    hits = sum(bool(rows[i]) for i in range(200))
    wrong = sum(bool(rows[i]) for i in range(200, 400))
    assert hits >= 150
    assert wrong <= 0.1 * max(1, hits)
    assert all((s.start, s.end) == (4, 44) for i in range(200) for s in rows[i])


def test_tokens_after_an_equals_sign(spark, documents):
    rng = random.Random(8)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows, spans = [], {}
    for i in range(150):
        token = "".join(rng.choices(alphabet, k=40))
        before, padding = [("AWS_SECRET_ACCESS_KEY=", ""), ("http://a.b/?sig=", ""),
                           ("LONG_NAME_OF_A_VALUE==", "==")][i % 3]
        rows.append((i, f"set {before}{token}{padding} here"))
        spans[i] = 4 + len(before), 44 + len(before) + len(padding)
    found = {r.doc_id: r for r in secrets.find_secrets(documents(rows)).collect()}
    assert not any(r.spans for r in found.values())
    got = {i: [(s.start, s.end) for s in r.random] for i, r in found.items()}
    for kind in range(3):
        assert sum(bool(got[i]) for i in range(kind, 150, 3)) >= 40
    assert all(g in ([], [spans[i]]) for i, g in got.items())


def test_copies_change_no_other_document(spark, documents):
    rng = random.Random(14)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = ["the", "Of", "and", "Thing", "house", "Water", "line", "under"]
    tokens = ["".join(rng.choices(alphabet, k=40)) for _ in range(100)]
    tokens += ["".join(rng.choices(words, k=9)) + "2024" for _ in range(60)]
    rows = [(i, f"see {t} here") for i, t in enumerate(tokens)]

    def spans(rows):
        return {(r.doc_id, *((s.start, s.end) for s in r.random))
                for r in secrets.find_secrets(documents(rows)).collect()}

    alone = spans(rows)
    chances = spark.createDataFrame(rows, "id long, text string").select(
        "id", secrets.candidates(F.col("text"))[0]["chance"].alias("p")).collect()
    for goal in (0.3, 0.7):
        one = min(chances, key=lambda r: abs(r.p - goal)).id
        assert spans(rows + [rows[one]] * 80) == alone


def test_chances_of_random_tokens_are_even(spark):
    rng = random.Random(11)
    tokens = [("".join(rng.choices("0123456789abcdef", k=40)),) for _ in range(400)]
    frame = spark.createDataFrame(tokens, "text string")
    found = frame.select(secrets.candidates(frame["text"])[0]["chance"].alias("p")).collect()
    values = sorted(r.p for r in found)
    assert 0.35 < values[len(values) // 2] < 0.65


def test_empty_tables(spark, documents):
    empty = documents([]).where("false")
    assert secrets.find_secrets(empty).count() == 0
    assert pii.find_personal_data(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_base_personal_data_matches_plain_expressions(seed):
    for text in odd_texts(seed, PII_PIECES, 200):
        got = [f"{s.kind}:{s.start}:{s.end}" for s in pii.base_spans(text)]
        assert got == plain_personal(text), text


def test_personal_data_query(spark, documents):
    rows = pii.op9_semicrf_pii(spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in read(spark, SMALL, "documents").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        expected = plain_personal(texts[r.doc_id])
        assert r.base_sha256 == sha(expected)
        assert set(expected) <= set(filter(None, r.spans.split(",")))


def test_field_finds_what_a_pattern_misses_and_leaves_numbers():
    rng = random.Random(3)

    def card():
        digits = [rng.randrange(10) for _ in range(15)]
        total = sum(sum(divmod(d * 2, 10)) if i % 2 == 0 else d
                    for i, d in enumerate(digits[::-1]))
        return "".join(map(str, digits)) + str(-total % 10)

    train = [f"paid with {card()} and mail a{i}.b@mail{i % 9}.example.com or call "
             f"+1 ({200 + i}) 555-{1000 + i} in {2000 + i % 20} for {i} items at "
             f"{i % 255}.{i % 99}.7.9 today" for i in range(120)]
    model = pii.fit(train)
    text = f"cards {card()} {card()} seen in 2024 by 12 people"
    base = pii.base_spans(text)
    assert not base  # two cards in a row make one match of 32 digits, which fails
    added = pii.added_spans(text, base, model)
    assert [s.kind for s in added] == ["card", "card"]
    assert pii.added_spans("in 2024 we had 12,000 cases, 3.14 each", [], model) == []


def test_long_lines_are_searched_whole():
    def line(n):
        return " ".join(f"+1 ({200 + i}) 555-{1000 + i}" for i in range(n))

    model = pii.fit([f"call {line(1)} in 2{i:03} or {i % 255}.{i % 99}.7.9 now" for i in range(120)])
    for lead in ("", "7 ", "7 8 ", "7 8 9 "):  # entities at other offsets
        text = lead + line(60)
        whole, = pii.islands(text)
        assert whole.n_tokens > 400
        scores = pii.segment_scores(model, whole)
        expected = [(*whole.spans[s], pii.KINDS[k]) for s, k in pii.decode(whole, scores)]
        got = [tuple(s) for s in pii.added_spans(text, [], model)]
        assert got == expected
        phones = {(m.start(), m.end()) for m in re.finditer(r"\+1 \(\d+\) 555-\d+", text)}
        assert {s[:2] for s in got if s[2] == "phone"} >= phones


def test_decoding_matches_enumeration():
    model = pii.fit(["a1@b.com 10.0.0.1 x"] * 3)
    text = "q 1.2 7@8.9 3"
    for island in pii.islands(text):
        scores = pii.segment_scores(model, island) + 2.5
        best = 0.0
        chosen = [(v, 0, 0.0) for v in [0]]
        stack = [(0, 0.0)]
        while stack:
            at, value = stack.pop()
            best = max(best, value) if at == island.n_tokens else best
            if at < island.n_tokens:
                stack.append((at + 1, value))
                stack += [(j, value + scores[s].max() - pii.MARGIN)
                          for s, (i, j) in enumerate(island.segments) if i == at]
        got = sum(scores[s][k] - pii.MARGIN for s, k in pii.decode(island, scores))
        assert abs(got - best) < 1e-9, chosen


def test_copies_do_not_change_what_is_found_elsewhere(spark):
    """500 copies of the text that is drawn first leave the spans of all others as they were."""
    docs = read(spark, SMALL.replace("0.001", "0.01"), "documents")
    able = docs.where(F.col("text").rlike("[0-9@]"))
    first = pii.least_hashed(able.select(F.xxhash64("text").alias("hash"), "doc_id").dropDuplicates(
        ["hash"]), "hash", 1)[1].first().doc_id
    copies = docs.where(F.col("doc_id") == first).crossJoin(spark.range(500)).select(
        (F.col("id") + 10 ** 9).alias("doc_id"), *[c for c in docs.columns if c != "doc_id"])

    def found(frame):
        rows = pii.find_personal_data(frame).where("doc_id < 1000000000").collect()
        return sorted((r.doc_id, r.spans, r.n_added) for r in rows)

    alone = found(docs)
    assert alone == found(docs.unionByName(copies))
    assert sum(n for _, _, n in alone) > 0


def test_spans_of_many_matches(spark):
    """Runs of matches meet without a seam, whatever lies between them; in linear time."""
    rng = random.Random(12)
    texts = ["", "x", "7", "77 7"]
    for n in (255, 256, 257, 512, 1000):
        texts.append("".join("é\U0001f600 ab"[rng.randrange(5)] * rng.randrange(1, 4)
                             + str(rng.randrange(1000)) for _ in range(n)))
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = frame.select("i", secrets.match_spans(F.col("t"), "[0-9]+").alias("s")).collect()
    for r in got:
        assert [tuple(s) for s in r.s] == [
            (m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", texts[r.i])]


def test_a_text_of_very_many_tokens(spark):
    rng = random.Random(13)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    tokens = ["".join(rng.choices(letters, k=24)) for _ in range(20_000)]
    frame = spark.createDataFrame([(1, " ".join(tokens))], "doc_id long, text string")
    start = time.monotonic()
    found = secrets.find_secrets(frame).select(F.size(secrets.RANDOM).alias("n")).first()
    assert found.n > 15_000
    assert time.monotonic() - start < 30
