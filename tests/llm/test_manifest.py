"""The manifest against a tree that is built anew for every version, in plain Python."""

import hashlib
import random
import zlib

import pytest

from oracle import compare, connect
from recspark.llm import catalog, manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root int, pos int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row[:5]))


def root_of(nodes):
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0]


def siblings(nodes, at):
    out = ""
    while len(nodes) > 1:
        start = at // 8 * 8
        out += "".join(h for i, h in enumerate(nodes[start : start + 8], start) if i != at)
        nodes, at = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)], at // 8
    return out


def plain_manifest(rows):
    """A sorted list of what the query returns, building the whole tree again for every tampered row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    nodes = {g: [leaf_of(r) for r in groups[g]] for g in order}
    subroots = [root_of(nodes[g]) for g in order]
    root, out = root_of(subroots), []
    for p, g in enumerate(order):
        for at, r in enumerate(groups[g]):
            leaf = other = nodes[g][at]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                other = leaf_of((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            changed = root_of([*nodes[g][:at], other, *nodes[g][at + 1 :]])
            folded = root_of([*subroots[:p], changed, *subroots[p + 1 :]])
            proof = sha(siblings(nodes[g], at) + siblings(subroots, p))
            out.append((r[0], leaf, subroots[p], root, proof, folded, folded == root))
    return sorted(out, key=str)


def rows_of(seed, sizes):
    draw, out = random.Random(seed), []
    for lang, n in sizes.items():
        for _ in range(n):
            text = draw.choice(["", "Ab é", "lower", "X" * 3000, None, f"Word {draw.random()}"])
            out.append((draw.randrange(10**6), draw.choice(["s", None, ""]), lang, draw.choice([None, 3]), text, "x", 1, 2))
    out.append(out[0])
    out += [(out[1][0], "other", out[1][2], 1, "T", "x", 1, 2), (None, None, out[0][2], None, None, None, None, None)]
    draw.shuffle(out)
    return out


@pytest.mark.parametrize(
    "seed,levels,sizes",
    [(1, 1, {"en": 140, "de": 9, None: 8, "é": 1, "": 2}), (2, 2, {"en": 600, "z": 64, "fr": 65}), (3, 3, {"en": 30}), (4, 1, {f"l{k}": 2 for k in range(70)})],
)
def test_manifest_equals_rebuilt_trees(spark, seed, levels, sizes):
    rows = rows_of(seed, sizes)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = manifest.manifest(frame, levels)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == plain_manifest(rows)
    n_levels = got.selectExpr("max(size(copies)) as n").first()["n"]
    copied = manifest.version_nodes(got)
    tampered = sum(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 for r in rows)
    assert copied.count() <= tampered * n_levels < tampered * 8


def test_manifest_of_one_and_none(spark):
    one = spark.createDataFrame([(5, "s", "en", 1, "A", "", 0, 0)], SCHEMA)
    row = manifest.manifest(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == sha("")
    assert manifest.manifest(one.limit(0)).count() == 0


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    name = "op12_merkle_manifest"
    assert compare(spark, connect(folder), folder, name, catalog.QUERIES[name], catalog.SQL_TWINS[name]) == 1000
