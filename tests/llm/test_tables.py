"""Vectors, archive, hosts, components, the pipeline and the SQL twins."""

import base64
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oracle import compare, connect
from recspark.llm import archive, catalog, hosts, vectors
from recspark.llm.components import connected_components

SMALL = "/root/testdata/sf0.001"


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(60)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert all(got.get(x, x) == root(x) for x in list(parent))


def test_near_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "_BLOCK", 16)
    monkeypatch.setattr(vectors, "_FEW", 20)
    draw = np.random.default_rng(2)
    rows = []
    for g in range(12):
        base = draw.standard_normal(32)
        for _ in range(40 if g == 0 else 6):
            rows.append((len(rows), (base + 0.05 * draw.standard_normal(32)).tolist(), g % 3))
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(3)]
    odd = [None, [], [0.0] * 32, [math.nan] * 32, [None] * 32, [1.0, 2.0], [math.inf] * 32]
    rows += [(1000 + k, v, 0) for k, v in enumerate(odd)] + [(2000, rows[0][1], None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r["vec_id"]: r for r in vectors.near_vectors(frame).collect()}
    good = [r for r in rows if r[0] < 1000]
    x = np.array([r[1] for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in good])
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    found = sum(got[r[0]]["n_links"] for r in good)
    assert found >= 0.9 * near.sum()
    assert all(got[r[0]]["n_links"] <= near[i].sum() for i, r in enumerate(good))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in got if i >= 1000)
    assert all(r["component_id"] <= i for i, r in got.items())
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def all_pairs(rows, cosine=0.98):
    """Links of each vector by comparing all of one label and length."""
    unit = {i: (len(v), label, np.array(v) / np.linalg.norm(v)) for i, v, label in rows}
    return {i: sum(j != i and unit[j][:2] == (d, label) and float(unit[j][2] @ x) >= cosine for j in unit) for i, (d, label, x) in unit.items()}


def test_near_vectors_of_several_lengths(spark, monkeypatch):
    monkeypatch.setattr(vectors, "_FEW", 30)
    draw = np.random.default_rng(3)
    rows = [(0, [1.0, 2.0, 3.0], 0), (1, [1.0, 2.0, 3.0], 0), (2, [2.0, 4.0, 6.0], 0), (3, [1.0, 2.0, 3.0], 1), (4, [1.0, 2.0], 0)]
    for d, groups in ((4, 8), (16, 20), (24, 2)):
        for _ in range(groups):
            base = draw.standard_normal(d)
            rows += [(len(rows) + k, (base + 0.02 * draw.standard_normal(d)).tolist(), 0) for k in range(5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("d", F.lit(7)).withColumn("data", F.lit("x"))
    got = {r["vec_id"]: r for r in vectors.near_vectors(frame.repartition(3)).collect()}
    want = all_pairs(rows)
    assert [got[i]["n_links"] for i in range(5)] == [2, 2, 2, 0, 0]
    assert got[2]["component_id"] == 0 and got[3]["kept"] and got[4]["kept"]
    assert all(got[i]["n_links"] == want[i] for i, v, _ in rows if len(v) in (3, 24))  # few of a length: compared in full
    assert all(got[i]["n_links"] <= want[i] for i in want)
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * sum(want.values())


def test_near_vectors_compare_in_full_where_codes_miss_the_recall(spark, monkeypatch):
    monkeypatch.setattr(vectors, "_FEW", 10)
    monkeypatch.setattr(vectors, "_BLOCK", 8)
    draw = np.random.default_rng(4)
    rows = [(i, draw.standard_normal(3).tolist(), i % 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(frame, recall=1.1).collect()}
    assert got == all_pairs(rows)


def test_archive_round_trip(spark):
    rows = [(1, "http://a", "x"), (2, None, None), (3, "u", ""), (5, "v", "é"), (4, "w", "é"), (None, "w", "é"), (None, "q", "only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    written = archive.write_archive(pages)
    records = {(r["page_id"], r["target"]): r for r in archive.read_records(spark, written).collect()}
    assert len(records) == len(rows)
    for i, url, html in rows:
        r, data = records[i, url], (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert records[5, "v"]["refers_to"] == 4 and records[None, "w"]["refers_to"] == 4 and records[None, "q"]["record_type"] == "response"
    assert records[3, "u"]["refers_to"] == 2
    whole = {(r["page_id"], bytes(r["payload"])) for r in archive.original_records(spark, written).collect()}
    assert whole == {(i, (h or "").encode()) for i, _, h in rows}
    large = archive.read_records(spark, archive.write_archive(pages, least_bytes=2)).where("record_type = 'revisit'")
    assert {r["page_id"] for r in large.collect()} == {5, None}
    assert archive.read_records(spark, archive.write_archive(pages.limit(0))).count() == 0


def test_hosts(spark):
    def links(*urls):
        return "".join(f'<a class="x" href="{u}">y</a>' for u in urls)

    rows = [
        (1, "https://WWW.good.com/", links("http://friend.org/a", "//pal.org/")),
        (2, "http://x.net/es/1", links("http://q.org/")),
        (3, "http://linker.org/", links("http://x.net/es/1")),
        (5, "http://q.org/", None),
        (6, "http://pal.org", ""),
        (7, "nope", None),
        (8, "http://ring.org", links("http://LINKER.org")),
        (9, None, links("http://x.net/")),
        (10, "http://example.com/en/a?b", ""),
        (11, "http://www.example.com/en/a", ""),
        (12, "http://example.com", ""),
        (12, "http://example.com", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in hosts.judged_urls(pages).collect()}
    assert got[1] == ("www.good.com", "/", "com/", "allow")
    assert got[2] == ("x.net", "/es/1", "net/es/", "block")
    assert got[3][2:] == (None, "block") and got[8][2:] == (None, "block")
    assert got[5][2:] == (None, "allow") and got[6] == ("pal.org", "", None, "allow")
    assert got[7] == got[9] == ("", "", None, "allow")
    assert got[10][2:] == ("example.com/en/", "block") and got[11][2:] == ("www.example.com/en/", "allow")
    assert got[12] == ("example.com", "", None, "allow")
    assert hosts.judged_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.SQL_TWINS))
def test_twins(spark, name):
    assert compare(spark, connect(SMALL), SMALL, name, catalog.QUERIES[name], catalog.SQL_TWINS[name]) > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        assert 0 < docs.count() <= before, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in last.collect())
