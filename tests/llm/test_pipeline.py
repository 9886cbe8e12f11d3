"""The stages of the pipeline against plain Python, and the whole run on hard cases and on an empty table."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from roomweave.llm import pii, quality
from tests.llm.test_queries import DOCS, HARD, LOWER, SPANS, WORD, graded, holds, linked, plain_estimate

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


@pytest.fixture(scope="module", params=["tables", "hard", "empty"])
def folder(request, spark, sf_dir, tmp_path_factory):
    if request.param == "tables":
        return sf_dir
    rows = [(i, t, "en", "s", 0, "k", 1, "r") for i, t in HARD] if request.param == "hard" else []
    path = str(tmp_path_factory.mktemp("stages"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def ordered(rows):
    return sorted(rows, key=repr)


def pairs(df, *columns):
    return ordered(tuple(r) for r in df.select(*(columns or ("doc_id", "text"))).collect())


def test_quality(spark, docs):
    got = cp.quality_rules(spark, docs, "")
    assert got.columns == docs.columns
    kept = quality.judge(docs).where("kept").select("row.doc_id", "row.text")
    assert pairs(got) == pairs(kept)
    assert not [t for _, t in pairs(got) if len((t or "").split()) < 50]


def test_quality_plainly(spark, docs):
    """The rows that stay, by plain counts, votes and estimation."""
    rows = pairs(docs)
    read = [graded(t or "") for _, t in rows]
    post = plain_estimate(Counter(v for v, _ in read)) if rows else {}
    want = [r for r, (v, failed) in zip(rows, read) if not failed and post[v] >= 0.5]
    assert pairs(cp.quality_rules(spark, docs, "")) == ordered(want)


def test_pii_plainly(spark, docs):
    """Nothing that the plain patterns would find is left; texts in which they and the added kinds could find nothing stay as they are."""
    got = {r[0]: r[1] for r in pairs(cp.pii_masking(spark, docs, "").where("doc_id IS NOT NULL"))}
    for i, t in pairs(docs.where("doc_id IS NOT NULL")):
        if len(t or "") < 20_000:
            assert not [m.group() for k, p in SPANS.items() for m in re.finditer(p, got[i]) if holds(k, m.group())]
        if not re.search("[0-9@=:]", t or ""):
            assert got[i] == (t or "")


def test_lines(spark, docs):
    got = cp.line_dedup_stage(spark, docs, "")
    assert got.columns == docs.columns
    rows, first, held = pairs(docs), {}, defaultdict(set)
    key = lambda line: line.strip(SPACE).translate(LOWER)
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                held[key(line)].add(i)
    first = {k: min(ids) for k, ids in held.items() if len(k) >= 10 and len(ids) > 1}
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or first.get(key(x), i) == i]
        if len(kept) == len(lines) or "\n".join(kept).strip(SPACE):
            want.append((i, "\n".join(kept), len("\n".join(kept))))
    assert pairs(got, "doc_id", "text", "n_chars") == ordered(want)


def test_near_duplicates(spark, docs):
    docs = docs.where("doc_id IS NOT NULL")
    got = cp.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    rows = {i: t or "" for i, t in pairs(docs)}
    component = linked(sorted(rows.items()), 5, 80)
    assert pairs(got, "doc_id") == ordered((i,) for i in rows if component[i] == i)


def test_pii(spark, docs):
    got = cp.pii_masking(spark, docs, "")
    assert got.columns == docs.columns and got.count() == docs.count()
    before = {r.doc_id: r.spans for r in pii.find_spans(docs).where("row.doc_id IS NOT NULL").select("row.doc_id", "spans").collect()}
    texts = dict(pairs(docs.where("doc_id IS NOT NULL")))
    for i, t in pairs(got.where("doc_id IS NOT NULL")):
        spans = before[i]
        assert (t != (texts[i] or "")) == bool(spans)
        assert not [s for s in spans if s.kind == "email" and texts[i][s.start : s.end] in t]


def test_run(spark, folder, docs):
    out = cp.run(spark, folder)
    per = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("offset").alias("o"))
    assert per.where("n > 2048 OR o <> 0").count() == 0
    whole = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("d")).where("n <> d")
    assert whole.count() == 0
    assert out.select("doc_id").join(docs, "doc_id", "left_anti").count() == 0


def test_near_duplicates_of_odd_ids(spark):
    """Rows without an id stay; an id with texts in different groups keeps one row in each group that it leads."""
    words = lambda name: " ".join(f"{name}{k}" for k in range(60))
    a, b, c = words("a"), words("b"), words("c")
    rows = [(None, a), (None, a), (None, None), (1, a), (2, a + " end"), (2, b), (3, b), (4, c), (4, c + " end"), (4, b), (5, ""), (5, c), (6, None), (6, None), (7, a), (7, words("d"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pairs(cp.near_duplicates(spark, docs, ""))
    four = [r for r in got if r[0] == 4]
    assert len(four) == 1 and four[0][1] in (c, c + " end")
    assert [r for r in got if r[0] != 4] == ordered([(None, a), (None, a), (None, None), (1, a), (2, b), (5, ""), (6, None), (7, words("d"))])
