"""The Merkle manifest, the ranked search and the attention classifier against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from querytrail.llm import attention, merkle, ranking
from querytrail.llm.tables import least_hashed, read

from .conftest import SMALL

LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- Merkle manifest ---------------------------------------------------------------------

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    cells = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return sha(*["-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells])


def tree_of(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha(*low[i:i + 16]) for i in range(0, len(low), 16)])
    return levels


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        leaf = plain_leaf(r, r.text)
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        groups[r.source].append((r.doc_id, leaf, plain_leaf(
            r, r.text.translate(LOWERED)) if hit and r.text is not None else leaf))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: tree_of([x[1] for x in groups[s]]) for s in names}
    top = tree_of([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, (key, leaf, claimed) in enumerate(groups[s]):
            proof, folded = "", claimed
            for levels, j in ((trees[s], i), (top, k)):
                for level in levels[:-1]:
                    low = j // 16 * 16
                    before, after = "".join(level[low:j]), "".join(level[j + 1:low + 16])
                    proof, folded, j = proof + before + after, sha(before, folded, after), j // 16
            yield (key, leaf, trees[s][-1][0], top[-1][0], sha(proof), folded,
                   folded == top[-1][0])


PROVEN = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def proven(df):
    return sorted((tuple(r) for r in df.select(*PROVEN).collect()), key=str)


def test_manifest_of_hot_lone_and_null_sources(spark, documents, folder):
    """5,200 leaves, so that climbs go over narrow and wide nodes; one source has a third."""
    rng = random.Random(3)
    rows = [(i, rng.choice([f"Text {i}", f"é{i} B", "", None, "same"]), None if i % 7 == 0 else "en",
             None if i % 50 == 0 else "hot" if i % 3 == 0 else f"s{i % 19:02}É") for i in range(5200)]
    rows += [(10, "Text A", "en", "hot"), (10, "Text A", "en", "hot"), (None, "Null Key", None, "hot"),
             (None, None, None, None), (7000, "Alone", "en", "lone"), (7005, "Alone B", "en", "zlone")]
    tables = folder(documents=documents(rows))
    got = proven(merkle.op11_merkle_climb(spark, tables))
    want = sorted(plain_manifest(read(spark, tables, "documents").collect()), key=str)
    assert got == want
    assert 0.05 < sum(not r[-1] for r in got) / len(got) < 0.1  # two in five have capitals


def test_manifest_of_one_leaf_one_source_and_none(spark, documents, folder):
    one = folder(documents=documents([(5, "A lone Leaf", "en", None)]))
    got = proven(merkle.op11_merkle_climb(spark, one))
    assert got == list(plain_manifest(read(spark, one, "documents").collect()))
    assert got[0][1] == got[0][2] == got[0][3]
    source = folder(documents=documents([(i, "Ä" * 3000, "de", "s") for i in range(17)]))
    assert proven(merkle.op11_merkle_climb(spark, source)) == sorted(
        plain_manifest(read(spark, source, "documents").collect()), key=str)
    none = folder(documents=documents([]))
    assert merkle.op11_merkle_climb(spark, none).count() == 0


def test_places_are_numbered_without_gaps(spark, frame):
    rows = [(None if i % 4 == 0 else f"g{i % 3}", i % 50) for i in range(3000)]
    got = merkle.numbered(frame(rows, "g string, k int"), "g", ["k"]).collect()
    names = sorted({r.g for r in got}, key=lambda g: (g is not None, g or ""))
    for r_tree, g in enumerate(names):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r["at"])
        assert [r["at"] for r in mine] == list(range(len(mine)))
        assert [r.k for r in mine] == sorted(r.k for r in mine)
        assert {(r.tree, r.n) for r in mine} == {(r_tree, len(mine))}


# --- ranked search -----------------------------------------------------------------------

def plain_terms(text):
    word, out = "", []
    for c in (text or "").translate(LOWERED) + " ":
        if c.isascii() and not c.isalnum():
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def plain_search(docs, items):
    counts = [Counter(plain_terms(text)) for _, text in docs]
    sizes = [sum(c.values()) for c in counts]
    n_docs, n_words = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scores = Counter()
        for term, times in Counter(plain_terms(text)).items():
            if not df[term]:
                continue
            w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
            for i, c in enumerate(counts):
                if c[term]:
                    m = 25 + 75 * sizes[i] * n_docs // n_words
                    scores[i] += times * w * (10 ** 9 * c[term] // (1000 * c[term] + 8 * m))
        order = sorted((-s, docs[i][0] is not None, docs[i][0] or 0) for i, s in scores.items() if s)
        out += [(item, rank, key if known else None, -s)
                for rank, (s, known, key) in enumerate(order[:10], 1)]
    return sorted(out, key=str)


def ranked(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_terms_split_at_ascii_marks_only():
    text = "Ab-c_d'É x9\x7fZ\x00ÀB 中文。ok"
    assert [t.decode() for t in ranking.terms(text)] == plain_terms(text)
    assert "É x9" in plain_terms(text)


@pytest.mark.parametrize("settings", [
    {}, {"FIRST_READ": 1, "GROWTH": 2}, {"BLOCK_TERMS": 9, "BROADCAST_ROWS": 0, "BITS": 3, "FIRST_READ": 5}])
def test_search_matches_plain_scores(spark, documents, frame, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(ranking, name, value)
    rng = random.Random(4)
    vocabulary = [f"w{int(rng.expovariate(0.05))}" for _ in range(300)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 40, 400]))) + " The hot word")
            for i in range(150)]
    copied = docs[0][1]
    docs += [(i, copied) for i in range(200, 260)] + [(3, copied), (None, copied), (400, None),
                                                      (401, " .!"), (402, "word " * 20_000)]
    items = [(1, "w1 w2 w3 w40 the HOT hot"), (2, copied[:200]), (3, copied[:200]), (3, "w5 w6"),
             (4, None), (5, "unseen"), (6, "the"), (None, "w7 w7 w7 w90"), (8, "")]
    got = ranked(ranking.ranked_search(documents(docs), frame(items, "item_id long, text string")))
    assert got == plain_search(docs, items)
    assert {r[0] for r in got} == {1, 2, 3, 6, None}


def test_search_of_empty_tables(spark, documents, frame):
    items = frame([(1, "a b")], "item_id long, text string")
    assert ranking.ranked_search(documents([]), items).count() == 0
    assert ranking.ranked_search(documents([(1, None)]), items).count() == 0
    assert ranking.ranked_search(documents([(1, "a"), (2, "c")]), items.where("false")).count() == 0


def test_reads_grow_and_reach_the_last_step():
    assert ranking.reads([], 10) == []
    assert ranking.reads([(5, 4), (4, 4), (3, 4), (2, 30), (1, 1)], 8) == [4, 2, 1]


# --- attention classifier ----------------------------------------------------------------

def test_slopes_match_differences():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(k, attention.WIDTH)) for k in (1, 3, 5)]
    model = attention.fit([], np.zeros(0), np.zeros(0))._replace(c=rng.normal(size=attention.CODE + 1))
    x, bag = np.concatenate(bags), np.repeat([0, 1, 2], [1, 3, 5])
    target, cost = np.array([0, 1, 1.0]), np.array([1, 2, 0.5])
    loss, slopes = attention.slopes(model, x, bag, target, cost)
    for name, slope in slopes.items():
        value = getattr(model, name)
        for place in [tuple(rng.integers(0, s) for s in value.shape) for _ in range(5)]:
            moved = value.copy()
            moved[place] += 1e-5
            other, _ = attention.slopes(model._replace(**{name: moved}), x, bag, target, cost)
            assert (other - loss) / 1e-5 == pytest.approx(slope[place], rel=1e-2, abs=1e-3)


def test_passages_hold_every_word():
    text = " ".join(f"w{i}" for i in range(64 * 3 + 5))
    got = attention.passages(text)
    assert got.shape == (4, attention.WIDTH)
    assert np.expm1(got[:, -1]).round().tolist() == [64, 64, 64, 5]
    assert attention.passages("").tolist() == attention.passages(" \n").tolist() == [[0] * attention.WIDTH]
    scores, weights = attention.bag_scores(attention.fit([], np.zeros(0), np.zeros(0)), [got, got[:1]])
    assert scores.tolist() == [0.5, 0.5] and weights[:4].sum() == pytest.approx(1) and weights[4] == 1


def test_held_out_labels_are_predicted(spark):
    middle = SMALL.replace("0.001", "0.01")
    rows = attention.op13_attention_quality(spark, middle).join(
        read(spark, middle, "labels"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    assert sum(r.predicted for r in held if r.quality == 1) >= 0.99 * sum(r.quality for r in held)


def test_held_out_labels_teach_nothing(spark, folder):
    docs, labels = (read(spark, SMALL, n) for n in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    got = [sorted((r.doc_id, round(r.score, 6)) for r in attention.op13_attention_quality(
        spark, folder(documents=docs, labels=table)).collect()) for table in (labels, turned)]
    assert got[0] == got[1]


def test_odd_rows_and_labels(spark, documents, frame, folder):
    docs = documents([(1, None), (2, ""), (None, "text here"), (1, None), (4, "word " * 60_000),
                      (5, "Clean prose here.")])
    kinds = "doc_id long, quality int, toxic int"
    for labels in ([], [(1, None, 0), (2, 7, 0), (99, 1, 0)], [(2, 1, 0), (2, 0, 0), (5, 1, 0), (5, 1, 1)]):
        rows = attention.op13_attention_quality(spark, folder(
            documents=docs, labels=frame(labels, kinds))).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 1}) == 1
        if len(labels) < 4:
            assert {r.score for r in rows} == {0.5}
    assert attention.op13_attention_quality(spark, folder(
        documents=documents([]), labels=frame([], kinds))).count() == 0


def test_sample_of_least_hashes(spark):
    rows = spark.range(5000).withColumn("hash", F.xxhash64("id"))
    n, drawn = least_hashed(rows, "hash", 40)
    again = least_hashed(rows.repartition(7), "hash", 40)[1]
    assert n == 5000 and drawn.count() == 40
    assert {r.id for r in drawn.collect()} == {r.id for r in again.collect()}
    assert least_hashed(rows.limit(30), "hash", 40)[1].count() == 30
