"""Merkle manifest of a table: every row's leaf, its proof up to one root, and the check of rows that were changed.

A tree of fan-out 8 stands over the leaves of each group in order, and one over the groups' roots. The leaves are dealt in
aligned blocks of 8^3, so that a block is a whole subtree; the roots of blocks are the leaves of the next storey, until one
is left. Going down again, a task walks each block leaf by leaf: treehash stacks prepare the nodes of the coming
authentication paths while the present ones are in use, and the path that all leaves of a block share is appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlens.llm.common import CRC_TABLE, column_list, crc_sql, map_arrow, prepared, table
from shotlens.operators.places import placed
from shotlens.session import materialise

#: Nodes of a run, and levels of runs in a block.
FAN, LEVELS = 8, 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SIDES = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int, levels: int) -> int:
    """Levels of runs in a block whose group has n nodes: a block of a larger group always has `levels`, even the last."""
    up = 0
    while up < levels and FAN**up < n:
        up += 1
    return up


def fold(node: str, sides: Sequence[tuple[str, str]]) -> str:
    """The root that a node and what stands beside it at each level give."""
    for left, right in sides:
        node = digest(left + node + right)
    return node


class Treehash:
    """Takes leaves from `start` on and keeps the nodes of one run at level `top`; below, at most FAN - 1 nodes a level."""

    def __init__(self, leaves: Sequence[str], top: int, start: int):
        self.leaves, self.top, self.at = leaves, top, start
        self.end = min(start + FAN ** (top + 1), len(leaves))
        self.open: list[list[str]] = [[] for _ in range(top + 1)]

    def tail(self) -> float:
        """Level of the lowest node that still waits for others; of a stack that has none its own; of a full one none."""
        if self.at >= self.end:
            return float("inf")
        return next((k for k in range(self.top) if self.open[k]), self.top)

    def step(self) -> None:
        self.open[0].append(self.leaves[self.at])
        self.at += 1
        for k in range(self.top):
            if len(self.open[k]) == FAN or self.at == len(self.leaves) and self.open[k]:
                self.open[k + 1].append(digest("".join(self.open[k])))
                self.open[k] = []

    def run(self) -> list[str]:
        while self.at < self.end:
            self.step()
        return self.open[self.top]


class Traversal:
    """The authentication paths of a block's leaves, one after another.

    Held are the present run of each level and, below the highest, a stack that builds the next one. A stack of level k has
    FAN^(k+1) leaves to take while as many go by; for each leaf that goes by there is one step for each stack, given to
    the stack with the lowest tail, so that few unfinished nodes exist at a time: O(FAN x levels) digests."""

    def __init__(self, leaves: Sequence[str], levels: int):
        self.leaves, self.levels = leaves, levels
        self.now = [Treehash(leaves, k, 0).run() for k in range(levels)]
        self.next = [Treehash(leaves, k, FAN ** (k + 1)) for k in range(levels - 1)]
        self.root = digest("".join(self.now[-1])) if levels else leaves[0]
        self.most = 0

    def _advance(self, i: int) -> None:
        for _ in self.next:
            k = min(range(len(self.next)), key=lambda k: self.next[k].tail())
            if self.next[k].at < self.next[k].end:
                self.next[k].step()
        for k, stack in enumerate(self.next):
            if i % FAN ** (k + 1) == 0:
                self.now[k] = stack.run()
                self.next[k] = Treehash(self.leaves, k, i + FAN ** (k + 1))
        self.most = max(self.most, sum(len(x) for s in self.next for x in s.open) + sum(map(len, self.now)))

    def __iter__(self) -> Iterator[list[tuple[str, str]]]:
        for i in range(len(self.leaves)):
            if i:
                self._advance(i)
            sides = []
            for k, run in enumerate(self.now):
                own = i // FAN**k % FAN
                sides.append(("".join(run[:own]), "".join(run[own + 1 :])))
            yield sides


def _root(nodes: Sequence[str], levels: int) -> str:
    return digest("".join(Treehash(nodes, levels - 1, 0).run())) if levels else nodes[0]


def _blocks(spark: SparkSession, nodes: DataFrame, extra: Sequence[str], levels: int, name: str) -> DataFrame:
    """One row for each block of at most FAN^levels nodes: grp, block, size (nodes of the group) and the items in order."""
    by = nodes.groupBy("grp", F.floor(F.col("place") / FAN**levels).cast("long").alias("block"))
    return materialise(spark, by.agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("place", "node", *extra))).alias("items")), name)


def _roots(blocks: DataFrame, levels: int) -> DataFrame:
    """The blocks' roots as nodes of the next storey."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = column_list(b, "size")
            found = [_root([x["node"] for x in items], height(n, levels)) for items, n in zip(column_list(b, "items"), sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("grp")), b.column(b.schema.get_field_index("block")), pa.array([-(-n // FAN**levels) for n in sizes], pa.int64()), pa.array(found, pa.string())], names=["grp", "place", "size", "node"])

    return map_arrow(blocks, run, "grp string, place long, size long, node string")


def _storeys_above(spark: SparkSession, nodes: DataFrame, extra: Sequence[str], levels: int, name: str) -> list[DataFrame]:
    """The blocks of the nodes, of their roots, and so on, until every group is one block."""
    most = nodes.agg(F.max("size")).head()[0] or 0
    found = [_blocks(spark, nodes, extra, levels, name)]
    while most > FAN**levels:
        most = -(-most // FAN**levels)
        found.append(_blocks(spark, _roots(found[-1], levels), (), levels, f"{name}-{len(found)}"))
    return found


def _paths_down(spark: SparkSession, blocks: DataFrame, levels: int, name: str) -> DataFrame:
    """From blocks with `up` (what stands beside the block's root up to the root of all), subroot and root: the same for
    each of their items, under the key (grp, block) that the item's own block has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            out = []
            for r in rows:
                up = r["up"] or []
                for item, sides in zip(r["items"], Traversal([x["node"] for x in r["items"]], height(r["size"], levels)), strict=True):
                    out.append({"grp": r["grp"], "block": item["place"], "up": [{"left": left, "right": right} for left, right in sides] + up, "subroot": r["subroot"], "root": r["root"]})
            yield pa.RecordBatch.from_pylist(out, schema=to)

    sides = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    to = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("up", sides), ("subroot", pa.string()), ("root", pa.string())])
    return materialise(spark, map_arrow(blocks, run, f"grp string, block long, up {SIDES}, subroot string, root string"), name)


def _group_paths(tops: DataFrame, levels: int) -> DataFrame:
    """For each group (an item's `name`) what stands beside its root, from the blocks over the groups' roots with `up` and `root`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                for item, sides in zip(r["items"], Traversal([x["node"] for x in r["items"]], height(r["size"], levels)), strict=True):
                    out.append({"grp": item["name"], "up": [{"left": left, "right": right} for left, right in sides] + (r["up"] or []), "subroot": item["node"], "root": r["root"]})
            yield pa.RecordBatch.from_pylist(out, schema=to)

    sides = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    to = pa.schema([("grp", pa.string()), ("up", sides), ("subroot", pa.string()), ("root", pa.string())])
    return map_arrow(tops, run, f"grp string, up {SIDES}, subroot string, root string")


def leaf_of(values: Sequence[Column]) -> Column:
    """sha256 of the values, each "-" if null, else its UTF-8 byte count, ":" and itself."""
    coded = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in values]
    return F.sha2(F.concat(*coded).cast("binary"), 256)


def manifest(spark: SparkSession, docs: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang", changed: tuple[Column, dict[str, Column]] | None = None, levels: int = LEVELS) -> DataFrame:
    """For each row: the id, `lang` (the group), leaf, subroot, root, proof (an array of what stands left and right at each
    level, leaf first), proof_sha256, folded_root and verified. `changed` is where rows were tampered with and which values
    the columns have then: there folded_root comes from the changed row's leaf and the proof of the row as it was.

    Leaves ascend by id, null ids first, rows of one id by their leaf; null groups come first, then groups by their bytes; a
    null or empty text is a leaf like any other; repeated rows are leaves of their own; an empty table has no row; columns
    beside `columns` and the id are not read."""
    prepared(spark)
    where, new = changed or (F.lit(False), {})
    group = F.col(group_col).cast("string")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("grp"),
        F.col(id_col).alias("id"),
        leaf_of([F.col(c) for c in columns]).alias("node"),
        F.when(where, leaf_of([new.get(c, F.col(c)) for c in columns])).alias("other"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    rows = placed(spark, materialise(spark, rows, "leaves"), ["grp"], ["id", "node"], "leaves-in-order")
    own = _storeys_above(spark, rows, ("id", "other"), levels, "blocks")
    subroots = _roots(own[-1], levels).select(F.lit("").alias("all"), F.col("grp").alias("name"), "node")
    groups = placed(spark, subroots, ["all"], ["name"], "groups").select(F.col("all").alias("grp"), "place", "size", "node", "name")
    over = _storeys_above(spark, groups, ("name",), levels, "groups-blocks")
    top = _roots(over[-1], levels).select("grp", F.col("place").alias("block"), F.array().cast(SIDES).alias("up"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    for k, blocks in enumerate(over[:0:-1]):
        top = _paths_down(spark, blocks.join(top, ["grp", "block"]), levels, f"groups-paths-{k}")
    down = materialise(spark, _group_paths(over[0].join(top, ["grp", "block"]), levels), "paths-of-groups").withColumn("block", F.lit(0).cast("long"))
    for k, blocks in enumerate(own[:0:-1]):
        down = _paths_down(spark, blocks.join(down, ["grp", "block"]), levels, f"paths-{k}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():  # a row is a block: at most FAN^levels leaves
                up = [(x["left"], x["right"]) for x in r["up"]]
                ids, out = [], []
                for item, sides in zip(r["items"], Traversal([x["node"] for x in r["items"]], height(r["size"], levels)), strict=True):
                    path = sides + up
                    folded = fold(item["other"] or item["node"], path)
                    ids.append(item["id"])
                    out.append({"lang": r["grp"][1:] if r["grp"] else None, "leaf": item["node"], "subroot": r["subroot"], "root": r["root"], "proof": [{"left": a, "right": c} for a, c in path], "proof_sha256": digest("".join(a + c for a, c in path)), "folded_root": folded, "verified": folded == r["root"]})
                made = pa.RecordBatch.from_pylist(out, schema=to)
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("items").type.value_type.field("id").type), *made.columns], names=["id", *to.names])

    sides = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    to = pa.schema([("lang", pa.string()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof", sides), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])
    out = map_arrow(own[0].join(down, ["grp", "block"]), run, f"id {kind}, lang string, leaf string, subroot string, root string, proof {SIDES}, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumnRenamed("id", id_col)


def tampered() -> tuple[Column, dict[str, Column]]:
    """The rows of the query's contract that are changed: a third of the ids, the text's A-Z in lower case."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return hit, {"text": F.translate("text", letters, letters.lower())}


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, table(spark, sf_dir, "documents"), changed=tampered()).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _coded(columns: dict[str, str]) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR), '-')" for x in columns.values()) + ")"


OP11_SQL = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}), d AS (SELECT *, row_number() OVER () AS u FROM documents),
leaf AS (SELECT u, doc_id, lang, {_coded({c: c for c in COLUMNS})} AS leaf, CASE WHEN {crc_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_coded({c: c for c in COLUMNS} | {"text": "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"})} END AS other FROM d, crc),
first AS (SELECT u, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
own AS (SELECT 0 AS level, lang, i, node, n FROM first UNION ALL SELECT any_value(level) + 1, lang, i // 8, sha256(string_agg(node, '' ORDER BY i)), any_value((n + 7) // 8) FROM own WHERE n > 1 GROUP BY lang, i // 8),
sub AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM own WHERE n = 1),
top AS (SELECT 100 AS level, i, subroot AS node, n FROM sub UNION ALL SELECT any_value(level) + 1, i // 8, sha256(string_agg(node, '' ORDER BY i)), any_value((n + 7) // 8) FROM top WHERE n > 1 GROUP BY i // 8),
own_side AS (SELECT a.level, a.lang, a.i, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r FROM own a JOIN own b ON a.level = b.level AND a.lang IS NOT DISTINCT FROM b.lang AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY ALL),
top_side AS (SELECT a.level, a.i, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r FROM top a JOIN top b ON a.level = b.level AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY ALL),
path AS (SELECT f.u, s.level, s.l, s.r FROM first f JOIN own_side s ON s.lang IS NOT DISTINCT FROM f.lang AND s.i = f.i // CAST(pow(8, s.level) AS BIGINT)
  UNION ALL SELECT f.u, s.level, s.l, s.r FROM first f JOIN sub ON sub.lang IS NOT DISTINCT FROM f.lang JOIN top_side s ON s.i = sub.i // CAST(pow(8, s.level - 100) AS BIGINT)),
proof AS (SELECT u, sha256(string_agg(l || r, '' ORDER BY level)) AS proof_sha256, list({{'l': l, 'r': r}} ORDER BY level) AS sides FROM path GROUP BY u)
SELECT leaf.doc_id, leaf.leaf, sub.subroot, whole.node AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
  list_reduce([coalesce(other, leaf)] || list_transform(coalesce(sides, []), lambda s: s.l || '|' || s.r), lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root, folded_root = whole.node AS verified
FROM leaf JOIN sub ON sub.lang IS NOT DISTINCT FROM leaf.lang LEFT JOIN proof USING (u), (SELECT node FROM top WHERE n = 1) whole
"""
