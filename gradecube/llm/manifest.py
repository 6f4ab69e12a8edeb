"""Operator 13: a Merkle manifest of a table, with the authentication path of every row.

Rows are leaves of one tree for each group, whose roots are leaves of a tree over the groups. Every two consecutive
nodes become their digest; a last one that is alone becomes a digest alone.

Leaves are numbered in their order by a range shuffle and parted into aligned blocks of 2^BLOCK leaves. A task walks the
leaves of a block by fractal traversal: the levels of the block are parted into layers of subtrees SUBTREE levels high;
of each layer it keeps the existing subtree, which holds the siblings of the current leaf's ancestors, and grows the
desired one, which is next, by two steps a leaf, so that it is there when needed. Paths of successive leaves are read off
the existing subtrees. The roots of blocks are leaves of the same work one storey up, until one block is left; their
paths are appended by a join on the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, stored
from .spelling import crc32_sql

#: Levels of a block, so 4,096 leaves; levels of a subtree in it.
BLOCK, SUBTREE = 12, 3
#: The columns of documents that a leaf covers, in this order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<left: boolean, node: string>>"


def digest(*nodes: str | None) -> str:
    return hashlib.sha256("".join(n for n in nodes if n).encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """The digest of fields, each its UTF-8 byte count, a colon and its value as text, or a dash if null."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*said).cast("binary"), 256)


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """The rows with pos, their number from 0 in their tree in this order, and n, the tree's number of leaves."""
    ordered = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    names = rows.columns
    at = names.index(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, k = TaskContext.get().partitionId(), None, 0
        for b in batches:
            ks = []
            for t in b.column(at).to_pylist():
                last, k = t, k + 1 if t == last else 0
                ks.append(k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([task] * len(ks), pa.int32()), pa.array(ks, pa.int64())], names=[*names, "_task", "_k"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = stored(ordered.mapInArrow(run, schema + ", _task int, _k long"))
    tasks = out.groupBy(tree, "_task").agg(F.count("*").alias("_c"))
    through = Window.partitionBy(tree)
    before = stored(tasks.select(tree, "_task", (F.sum("_c").over(through.orderBy("_task")) - F.col("_c")).alias("_before"), F.sum("_c").over(through).alias("n")))
    return out.join(before, [tree, "_task"]).select(*names, (F.col("_before") + F.col("_k")).alias("pos"), "n")


def grown(leaf: Callable[[int], str | None], height: int, root: int, keep: Callable[[int, int, str | None], None]) -> Iterator[None]:
    """Grow the subtree of this height above leaves from root << height on, a digest a step; keep sees every node."""
    stack: list[str | None] = []
    for i in range(root << height, (root + 1) << height):
        node, level, at = leaf(i), 0, i
        keep(level, at, node)
        while at & 1 and level < height:
            left = stack.pop()
            node, level, at = digest(left, node) if left else None, level + 1, at >> 1
            keep(level, at, node)
            yield
        stack.append(node)
        yield


def paths(leaves: list[str], height: int, layer: int = SUBTREE) -> Iterator[tuple[list[tuple[bool, str | None]], str]]:
    """The path of each leaf in turn, by fractal traversal, and the root; a node that is alone has a null sibling.

    leaves: at most 2^height; missing ones at the end leave nodes alone.
    """
    leaf = lambda i: leaves[i] if i < len(leaves) else None
    layers = -(-height // layer)
    existing: list[dict] = [{} for _ in range(layers)]
    desired: list[dict] = [{} for _ in range(layers)]
    growing: list[Iterator[None]] = [iter(()) for _ in range(layers)]
    root: list[str | None] = []

    def first(level: int, at: int, node: str | None) -> None:
        if level == height:
            root.append(node)
        elif not at >> layer - level % layer:
            existing[level // layer][level, at] = node

    for _ in grown(leaf, height, 0, first):
        pass

    def desire(k: int, at: int) -> None:
        desired[k] = {}
        top, low = layer * (k + 1), layer * k
        if top < height and at << top < len(leaves):
            growing[k] = grown(leaf, top, at, lambda level, i, node: desired[k].__setitem__((level, i), node) if low <= level < top else None)

    for k in range(layers):
        desire(k, 1)
    for i in range(len(leaves)):
        for k in range(layers):
            if i and not i & (1 << layer * (k + 1)) - 1:
                for _ in growing[k]:  # it has grown in time; at most its last digest is left
                    pass
                existing[k] = desired[k]
                desire(k, (i >> layer * (k + 1)) + 1)
        yield [(bool(i >> level & 1), existing[level // layer].get((level, i >> level ^ 1))) for level in range(height)], root[0]
        for k in range(layers):
            next(growing[k], None)
            next(growing[k], None)


def storey(nodes: DataFrame, carried: list[str], block: int = BLOCK) -> DataFrame:
    """tree, pos, n, the carried columns, node, path in the block and, with its first leaf, the block's root.

    nodes: tree, pos, n, node and the carried ones. The last block of a tree of several is as high as the others.
    """
    names = ["tree", "pos", "n", *carried, "node"]
    rows = nodes.select(*names, (F.col("pos").bitwiseAND(F.lit(-1 << block))).alias("_block")).repartition("tree", "_block").sortWithinPartitions("tree", "_block", "pos").select(*names)
    of = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("left", pa.bool_()), ("node", pa.string())]))

        def solved(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts).combine_chunks()
            n = rows.column("n")[0].as_py()
            height = min(block, (n - 1).bit_length())
            found, roots = zip(*paths(rows.column("node").to_pylist(), height), strict=True)
            made = pa.array([[{"left": left, "node": node} for left, node in p] for p in found], kind)
            cols = [*(c.combine_chunks() for c in rows.columns), made, pa.array([roots[0], *[None] * (len(roots) - 1)], pa.string())]
            return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols], names=[*names, "path", "root"])

        parts: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            begin = 0
            for i, key in enumerate(zip(b.column("tree").to_pylist(), (p >> block for p in b.column("pos").to_pylist()), strict=True)):
                if key != last:
                    if i > begin:
                        parts.append(b.slice(begin, i - begin))
                    if parts:
                        yield solved(parts)
                    parts, begin, last = [], i, key
            if begin < b.num_rows:
                parts.append(b.slice(begin))
        if parts:
            yield solved(parts)

    return rows.mapInArrow(run, ", ".join(f"`{c}` {of[c]}" for c in names) + f", path {PATH}, root string")


def proved(nodes: DataFrame, carried: list[str], block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """tree, the carried columns, node and path up to the tree's root; and tree, root of each tree."""
    ground = stored(storey(nodes, carried, block))
    storeys = [ground]
    while (most := storeys[-1].agg(F.max("n")).first()[0]) and most > 1 << block:
        top = storeys[-1]
        up = top.where("root IS NOT NULL").select("tree", F.shiftright("pos", block).alias("pos"), F.ceil(F.col("n") / (1 << block)).cast("long").alias("n"), F.col("root").alias("node"))
        storeys.append(stored(storey(up, [], block)))
    above = None
    for part in reversed(storeys):
        own = part
        if above is not None:
            upper = above.select("tree", F.col("pos").alias("_block"), F.col("path").alias("_more"))
            own = own.withColumn("_block", F.shiftright("pos", block)).join(upper, ["tree", "_block"]).withColumn("path", F.concat("path", "_more"))
        above = own.select("tree", "pos", *(carried if part is ground else []), "node", "path")
    return above.drop("pos"), storeys[-1].where("root IS NOT NULL").select("tree", "root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""

    def step(node: Column, x: Column) -> Column:
        other = F.coalesce(x["node"], F.lit(""))
        return F.sha2(F.when(x["left"], F.concat(other, node)).otherwise(F.concat(node, other)).cast("binary"), 256)

    return F.aggregate(path, leaf, step)


def merkle_manifest(docs: DataFrame, fields: list[str], key: str = "doc_id", group: str = "lang", carried: dict[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """key, leaf, path (siblings from the leaf to the root, with their side), subroot, root and the carried columns.

    A leaf covers the named fields. In each group leaves ascend by key, rows without one first, those that share a key
    by leaf; groups ascend by name, null first. The path of a leaf has an entry a level, with a null node where the node
    is alone. Null and empty fields give different leaves; repeated rows are leaves of their own with equal digests.
    Columns that are not named are not read. Empty tables give no rows. Rows alike in every field, key included, are
    sorted by one task.
    """
    carried = carried or {}
    tree = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit(">"), F.col(group).cast("string")))
    rows = stored(docs.select(tree.alias("tree"), F.col(key).alias("_key"), leaf_of(*[F.col(f) for f in fields]).alias("node"), *[c.alias(f"_{name}") for name, c in carried.items()]))
    names = [f"_{name}" for name in carried]
    low, subroots = proved(numbered(rows, "tree", ["_key", "node"]), ["_key", *names], block)
    top = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("root").alias("node")), "tree", ["group"])
    high, root = proved(top, ["group"], block)
    whole = high.join(root, "tree").select(F.col("group").alias("tree"), F.col("path").alias("_more"), F.col("node").alias("subroot"), "root")
    out = low.join(whole, "tree")
    return out.select(F.col("_key").alias(key), F.col("node").alias("leaf"), F.concat("path", "_more").alias("path"), "subroot", "root", *[F.col(f"_{name}").alias(name) for name in carried])


def op13_rows(docs: DataFrame) -> DataFrame:
    """The manifest of documents as a digest of each proof, checked against rows of which one in seven is tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    other = leaf_of(*[F.try_add(F.col(f), F.lit(1)) if f == "n_chars" else F.col(f) for f in FIELDS])
    out = merkle_manifest(docs, FIELDS, carried={"tampered": F.when(tampered, other)})
    proof = F.sha2(F.array_join(F.transform("path", lambda x: x["node"]), "").cast("binary"), 256)
    out = out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_sql(n_chars: str) -> str:
    said = lambda c: f"coalesce(concat(octet_length(encode({c}::varchar))::varchar, ':', {c}::varchar), '-')" if c != "" else ""
    return "sha256(concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE {said(c)} END" for c in ["doc_id", "source", "lang", n_chars, "text"]) + "))"


_FOLD = "sha256(CASE WHEN s.node IS NULL THEN f.h WHEN f.pos % 2 = 1 THEN concat(s.node, f.h) ELSE concat(f.h, s.node) END)"
ORACLE = f"""WITH RECURSIVE rows AS (SELECT doc_id, coalesce('>' || lang, '') AS tree, {_leaf_sql("n_chars")} AS leaf,
  CASE WHEN {crc32_sql("doc_id::varchar")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} END AS tampered FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS id FROM rows),
nodes AS (SELECT tree, 0 AS level, pos, leaf AS node FROM leaves
  UNION ALL SELECT tree, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM nodes) n WHERE c > 1 GROUP BY ALL),
tops AS (SELECT tree, max(level) AS height, arg_max(node, level) AS subroot FROM nodes GROUP BY 1),
groups AS (SELECT *, row_number() OVER (ORDER BY tree) - 1 AS place FROM tops),
high AS (SELECT 0 AS level, place AS pos, subroot AS node FROM groups
  UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS c FROM high) n WHERE c > 1 GROUP BY ALL),
top AS (SELECT max(level) AS height, arg_max(node, level) AS root FROM high),
low_fold AS (SELECT id, tree, 0 AS level, pos, coalesce(tampered, leaf) AS h, '' AS proof FROM leaves
  UNION ALL SELECT f.id, f.tree, f.level + 1, f.pos // 2, {_FOLD}, concat(f.proof, s.node) FROM low_fold f JOIN tops t ON t.tree = f.tree AND f.level < t.height LEFT JOIN nodes s ON s.tree = f.tree AND s.level = f.level AND s.pos = xor(f.pos, 1)),
high_fold AS (SELECT f.id, 0 AS level, place AS pos, f.h, f.proof FROM low_fold f JOIN groups g ON g.tree = f.tree AND f.level = g.height
  UNION ALL SELECT f.id, f.level + 1, f.pos // 2, {_FOLD}, concat(f.proof, s.node) FROM high_fold f JOIN top t ON f.level < t.height LEFT JOIN high s ON s.level = f.level AND s.pos = xor(f.pos, 1))
SELECT l.doc_id, l.leaf, g.subroot, t.root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = t.root AS verified
FROM leaves l JOIN groups g ON g.tree = l.tree CROSS JOIN top t JOIN high_fold f ON f.id = l.id AND f.level = t.height"""
