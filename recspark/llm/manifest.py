"""Merkle manifest of a dataset, with a version of the tree for every tampered row.

Method: a persistent tree by path copying. Rows of a language are leaves in the order of their ids; each run of
eight nodes has a parent. Aligned blocks of ``8 ** LEVELS`` leaves are built in one pass each, and their roots are the
leaves of the blocks above, until one block is left; the roots of the languages make up a last tree. A tampered leaf makes a
version: it copies only the ancestors of that leaf, first within its block, then along the path from the block's root
up, and shares all other nodes with the first version. So a version costs as many hashes as the tree has levels.

Positions come from a sort by ranges with counts per part, so no group lies in one task, however many rows a
language has. A task holds one block at a time; the paths above blocks are joined by block number, and Spark picks the
join by their size.

Null columns are hashed as ``-``, empty texts as a value of no bytes; long texts are hashed whole. Rows without a
language are a group of their own that comes first; rows without an id come first in theirs and are never
tampered with. Rows that repeat an id go by their leaf hash, so equal rows are in no order that matters. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recspark.session import materialize

#: Nodes of a run, and levels of a block.
FAN, LEVELS = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_PATH = "array<struct<l:string,r:string>>"


def leaf_hash(fields: dict[str, Column]) -> Column:
    """Lowercase hex sha256 of a row: each field ``-`` if null, else its byte count, a colon and its value."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(fields[c]) for c in FIELDS]), 256)


def is_tampered(doc_id: Column) -> Column:
    """Whether a row is tampered with: 3 divides the unsigned crc32 of its decimal id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, leaf, forged``: the hash of each row, and of the tampered row where it is tampered with."""
    plain = {c: F.col(c) for c in FIELDS}
    forged = plain | {"text": F.translate("text", _UPPER, _LOWER)}
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf_hash(plain).alias("leaf"),
        F.when(is_tampered(F.col("doc_id")), leaf_hash(forged)).alias("forged"),
    )


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``pos``, the place of each row in its group (from 0), and ``size``, the rows of the group.

    Rows are sorted by ranges of all order columns, so a large group spreads over many parts; what is counted
    and summed has a row for each part and group in it.
    """
    names = rows.columns

    def count(batches):
        part, at, now = TaskContext.get().partitionId(), 0, object()
        for batch in batches:
            places = []
            for g in batch.column(names.index(group)).to_pylist():
                at, now = (at + 1, now) if g == now else (0, g)
                places.append(at)
            extra = [pa.array([part] * batch.num_rows, pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*names, "part", "place"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    # very many equal rows spread too: any order of theirs gives the same
    salted = rows.withColumn("salt", F.rand(1))
    ordered = salted.repartitionByRange(parts, *order, "salt").sortWithinPartitions(*order).drop("salt")
    placed = materialize(ordered.mapInArrow(count, f"{kinds}, part int, place long"), "placed")
    held = placed.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"))
    each = Window.partitionBy(group)
    before = F.coalesce(F.sum("n").over(each.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = materialize(held.select(F.col(group).alias("g"), F.col("part").alias("p"), before.alias("base"), F.sum("n").over(each).alias("size")), "places")
    found = placed.join(held, F.col(group).eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return found.select(*names, (F.col("base") + F.col("place")).alias("pos"), "size")


# -- a block


def node_hash(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def levels_of(size: int) -> int:
    """Levels above the leaves of a tree of ``size`` leaves."""
    n = 0
    while size > 1:
        size, n = -(-size // FAN), n + 1
    return n


def block_levels(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of a block, level by level from its leaves up."""
    out = [nodes]
    for _ in range(levels):
        nodes = [node_hash(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
        out.append(nodes)
    return out


def path_of(tree: list[list[str]], at: int) -> list[tuple[str, str]]:
    """The siblings left and right of a leaf's ancestors within a block, from its own up; each side as one text."""
    out = []
    for nodes in tree[:-1]:
        start = at // FAN * FAN
        out.append(("".join(nodes[start:at]), "".join(nodes[at + 1 : start + FAN])))
        at //= FAN
    return out


def copied_path(leaf: str, path: list[tuple[str, str]]) -> list[str]:
    """The ancestors that a version with another leaf copies, from the leaf's parent to the root."""
    out = []
    for left, right in path:
        leaf = hashlib.sha256(f"{left}{leaf}{right}".encode()).hexdigest()
        out.append(leaf)
    return out


# -- trees of any size


def _blocks(rows: DataFrame, levels: int) -> DataFrame:
    """``lang, block, size, root, keys, leaves, forged``: a row for each aligned block.

    ``rows`` have ``lang, pos, size, key, leaf, forged``. Lists are as long as a block at most.
    """
    width = FAN**levels

    def build(batches):
        now, held = None, []

        def row():
            lang, block, size = now
            tree = block_levels([h[1] for h in held], min(levels, levels_of(size)))
            return {
                "lang": lang, "block": block, "size": size, "root": tree[-1][0],
                "keys": [h[0] for h in held], "leaves": [h[1] for h in held], "forged": [h[2] for h in held],
            }

        schema = pa.schema([
            ("lang", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("root", pa.string()),
            ("keys", pa.list_(pa.int64())), ("leaves", pa.list_(pa.string())), ("forged", pa.list_(pa.string())),
        ])
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("lang", "block", "size", "key", "leaf", "forged")]
            for lang, block, size, *rest in zip(*columns, strict=True):
                if (lang, block, size) != now:
                    if held:
                        yield pa.RecordBatch.from_pylist([row()], schema)
                    now, held = (lang, block, size), []
                held.append(rest)
        if held:
            yield pa.RecordBatch.from_pylist([row()], schema)

    block = F.floor(F.col("pos") / width).cast("long")
    dealt = rows.withColumn("block", block).repartition("lang", "block").sortWithinPartitions("lang", "block", "pos")
    schema = "lang string, block long, size long, root string, keys array<long>, leaves array<string>, forged array<string>"
    return dealt.select("lang", "block", "size", "key", "leaf", "forged").mapInArrow(build, schema)


def _tree(rows: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The tables of blocks from the rows up, and ``lang, root`` of each group.

    A table has ``FAN ** levels`` times fewer rows than the one below, so there are few.
    """
    tables = []
    while True:
        blocks = materialize(_blocks(rows, levels), "blocks")
        tables.append(blocks)
        if blocks.where("block > 0").isEmpty():
            return tables, blocks.select("lang", "root")
        width = FAN**levels
        rows = blocks.select(
            "lang", F.col("block").alias("pos"), F.ceil(F.col("size") / width).cast("long").alias("size"),
            F.col("block").alias("key"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("forged"),
        )


def _paths(blocks: DataFrame, levels: int) -> DataFrame:
    """``lang, key, up`` of each leaf of blocks with ``up``: its path to the top of the last tree."""

    def run(batches):
        kind = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                tree = block_levels(r["leaves"], min(levels, levels_of(r["size"])))
                ups = [[{"l": a, "r": b} for a, b in path_of(tree, i)] + r["up"] for i in range(len(r["leaves"]))]
                columns = pa.array([r["lang"]] * len(ups), pa.string()), pa.array(r["keys"], pa.int64()), pa.array(ups, kind)
                yield pa.RecordBatch.from_arrays(list(columns), ["lang", "key", "up"])

    return blocks.select("lang", "size", "keys", "leaves", "up").mapInArrow(run, f"lang string, key long, up {_PATH}")


def _descend(tables: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """The lowest table of blocks, each with ``up``: the path from its root to the top of the last tree.

    ``tops`` has ``lang, up`` for each group.
    """
    above = tops.select(F.col("lang").alias("g"), F.lit(0).cast("long").alias("b"), "up")
    same = F.col("lang").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b"))
    for blocks in reversed(tables[1:]):
        found = materialize(_paths(blocks.join(above, same), levels), "paths")
        above = found.select(F.col("lang").alias("g"), F.col("key").alias("b"), "up")
    return tables[0].join(above, same).drop("g", "b")


_PROVEN = "doc_id long, lang string, leaf string, proof_sha256 string, copies array<string>, folded_root string"


def _prove(blocks: DataFrame, levels: int) -> DataFrame:
    """A row for each leaf of blocks with ``up``: the digest of its proof, and its version of the tree."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                tree = block_levels(r["leaves"], min(levels, levels_of(r["size"])))
                up = [(x["l"], x["r"]) for x in r["up"]]
                above = "".join(a + b for a, b in up)
                out = [], [], [], [], [], []
                for i, (key, leaf, forged) in enumerate(zip(r["keys"], r["leaves"], r["forged"], strict=True)):
                    path = path_of(tree, i)
                    proof = "".join(a + b for a, b in path) + above
                    start = leaf if forged is None else forged
                    nodes = copied_path(start, path + up)
                    copies, folded = None if forged is None else nodes, nodes[-1] if nodes else start
                    for column, x in zip(out, (key, r["lang"], leaf, hashlib.sha256(proof.encode()).hexdigest(), copies, folded), strict=True):
                        column.append(x)
                kinds = pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], [c.split()[0] for c in _PROVEN.split(", ")])

    return blocks.select("lang", "size", "keys", "leaves", "forged", "up").mapInArrow(run, _PROVEN)


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``doc_id, lang, leaf, subroot, root, proof_sha256, copies, folded_root, verified`` of each row.

    ``copies`` are the nodes that the version of a tampered row doesn't share with the first version, from the
    parent of its leaf to its root; null for other rows. ``proof_sha256`` is the digest of all siblings from the leaf up.
    """
    rows = numbered(leaves(docs), "lang", ["lang", "doc_id", "leaf", "forged"])
    tables, subroots = _tree(rows.withColumnRenamed("doc_id", "key"), levels)
    # the subroots in the order of their languages are the leaves of the last tree; its one group is named by the empty text
    langs = materialize(numbered(subroots.select(F.lit("").alias("all"), "lang", "root"), "all", ["all", "lang"]), "languages")
    none = F.lit(None).cast("string").alias("forged")
    upper, roots = _tree(langs.select(F.col("all").alias("lang"), "pos", "size", F.col("pos").alias("key"), F.col("root").alias("leaf"), none), levels)
    start = roots.select("lang", F.array().cast(_PATH).alias("up"))
    ups = _paths(_descend(upper, start, levels), levels).select(F.col("key").alias("pos"), "up")
    whole = roots.select(F.col("lang").alias("all"), F.col("root").alias("top"))
    tops = langs.join(ups, "pos").join(whole, "all").select("lang", F.col("root").alias("subroot"), "up", F.col("top").alias("root"))
    tops = materialize(tops, "tops")
    proven = _prove(_descend(tables, tops.select("lang", "up"), levels), levels)
    named = tops.select(F.col("lang").alias("g"), "subroot", "root")
    return proven.join(named, F.col("lang").eqNullSafe(F.col("g"))).select(
        "doc_id", "lang", "leaf", "subroot", "root", "proof_sha256", "copies", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def version_nodes(proven: DataFrame) -> DataFrame:
    """``lang, doc_id, level, node``: the copied nodes of each version, level 1 above the leaf; all others are shared."""
    copied = proven.where("copies is not null")
    return copied.select("lang", "doc_id", F.posexplode("copies").alias("level", "node")).withColumn("level", F.col("level") + 1)
