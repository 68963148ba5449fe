"""Merkle manifest of a dataset: 16-ary hash trees per group under one root, with proofs, and a version of the tree for each tampered leaf."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut

#: Children of a node, and levels of a block: FAN ** DEPTH consecutive nodes of one tree, held by one task at a time.
FAN, DEPTH = 16, 3
#: Rows of an output batch.
ROWS = 4096


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


@dataclass(frozen=True, slots=True)
class Node:
    """A node is never changed; a version of a tree is a new root that shares every node off the changed path."""

    digest: str
    children: tuple[Node, ...] = ()

    def copy(self, path: tuple[int, ...], leaf: str) -> Node:
        """This tree with another leaf at path: only the nodes on the path are new."""
        if not path:
            return Node(leaf)
        i, kids = path[0], self.children
        kids = (*kids[:i], kids[i].copy(path[1:], leaf), *kids[i + 1 :])
        return Node(digest("".join([k.digest for k in kids])), kids)

    def beside(self, path: tuple[int, ...]) -> list[tuple[str, str]]:
        """What stands before and after the path's node among its siblings, from the leaf up."""
        out, node = [], self
        for i in path:
            out.append(("".join([k.digest for k in node.children[:i]]), "".join([k.digest for k in node.children[i + 1 :]])))
            node = node.children[i]
        return out[::-1]

    def along(self, path: tuple[int, ...]) -> list[str]:
        """Digests on the path, from the leaf up."""
        out, node = [self.digest], self
        for i in path:
            node = node.children[i]
            out.append(node.digest)
        return out[::-1]


def levels(n: int) -> int:
    """Levels of nodes above n nodes until one is left."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
    return k


def grow(digests: list[str], height: int) -> list[list[Node]]:
    """Levels of a block, its leaves first: `height` times every FAN nodes become one."""
    out = [[Node(x) for x in digests]]
    for _ in range(height):
        low = out[-1]
        runs = [tuple(low[i : i + FAN]) for i in range(0, len(low), FAN)]
        out.append([Node(digest("".join([k.digest for k in run])), run) for run in runs])
    return out


def route(pos: int, height: int) -> tuple[int, ...]:
    """Child numbers from a block's top to its leaf at pos."""
    return tuple((pos // FAN**k) % FAN for k in range(height - 1, -1, -1))


def leaf_digest(*fields: Column) -> Column:
    """SHA-256, as hexadecimal text, of the fields in order: `-` for null, else the number of UTF-8 bytes, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*parts), 256)


def ranked(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with pos, their place in their `grp` by the columns of order from 0 (nulls first), and n, the group's rows.

    Rows are sorted over range partitions; a partition's rows of a group are counted, and the counts before them added: no task orders a group.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order)]
    placed = cut(rows.repartitionByRange(*keys, F.monotonically_increasing_id()).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), name).withColumn("part", F.expr("shiftright(at, 33)"))
    by_group = Window.partitionBy("grp").orderBy("part")
    spans = placed.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("k"))  # a group has at most as many as there are partitions
    spans = spans.select("grp", "part", "first", F.coalesce(F.sum("k").over(by_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("k").over(Window.partitionBy("grp")).alias("n"))
    p, s = placed.alias("p"), spans.alias("s")
    joined = p.join(s, F.col("p.grp").eqNullSafe(F.col("s.grp")) & (F.col("p.part") == F.col("s.part")))
    return joined.select(*[F.col(f"p.{c}") for c in rows.columns], (F.col("at") - F.col("first") + F.col("before")).alias("pos"), F.col("n"))


def blocks(depth: int, nodes: DataFrame, *rest: DataFrame) -> DataFrame:
    """nodes (and rows to go before them) with the rows of a block together, in order."""
    for r in rest:
        nodes = r.unionByName(nodes, allowMissingColumns=True)
    nodes = nodes.withColumn("block", F.expr(f"case when pos >= 0 then pos div {FAN**depth} else -1 - pos end"))  # block b's context has pos -1 - b
    return nodes.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, list[dict]]]:
    """(group, block, rows) of sorted rows."""
    rows = (r for batch in batches for k in range(0, batch.num_rows, ROWS) for r in batch.slice(k, ROWS).to_pylist())
    for (grp, block), of in groupby(rows, key=lambda r: (r["grp"], r["block"])):
        yield grp, block, list(of)


def _mapped(rows: DataFrame, schema: T.StructType, fn) -> DataFrame:
    def run(batches):
        arrow = to_arrow_schema(schema)
        out: list[dict] = []
        for row in (x for run_ in runs(batches) for x in fn(*run_)):
            out.append(row)
            if len(out) == ROWS:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema)


def climb(nodes: DataFrame, name: str, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """(nodes of each round, the first as given, and the manifest's inner nodes) of trees over nodes (grp, pos, digest, n), a written table.

    A round folds blocks of FAN ** depth nodes to their tops, so rounds are as many as the largest tree's levels divided by depth. inner: (grp, level, idx,
    digest, top boolean), level from 1.
    """
    spark, kind = nodes.sparkSession, nodes.schema["grp"].dataType.simpleString()
    schema = T._parse_datatype_string(f"grp {kind}, level int, idx long, digest string, n long, top boolean")
    most = nodes.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    rounds, inner, base = [nodes], spark.createDataFrame([], schema), 0
    while most > 1:

        def fold(grp, block, rows, base=base):
            n = rows[0]["n"]
            height = min(depth, levels(n))
            for k, level in enumerate(grow([r["digest"] for r in rows], height)[1:], 1):
                at = block * FAN ** (depth - k)
                for i, node in enumerate(level):
                    yield {"grp": grp, "level": base + k, "idx": at + i, "digest": node.digest, "n": -(-n // FAN**depth), "top": k == height}

        made = cut(_mapped(blocks(depth, rounds[-1].where("n > 1").select("grp", "pos", "digest", "n")), schema, fold), f"{name}-inner")
        inner = inner.unionByName(made)
        rounds.append(made.where("top").select("grp", F.col("idx").alias("pos"), "digest", "n"))
        most, base = -(-most // FAN**depth), base + depth
    return rounds, inner.drop("n")


CONTEXT = "before array<string>, after array<string>, subroot string, root string"


def descend(rounds: list[DataFrame], tops: DataFrame, name: str, depth: int) -> DataFrame:
    """Context of every block of the first round: (grp, pos, siblings before and after the path at each level above, subroot, root).

    tops: the context of each whole tree (grp, before, after, subroot, root). Going down, a block's nodes give theirs to the blocks below them; a sibling is
    sent once for a block, however many leaves it has. pos of block b is -1 - b.
    """
    kind = tops.schema["grp"].dataType.simpleString()
    schema = T._parse_datatype_string(f"grp {kind}, pos long, {CONTEXT}")
    held = None
    for k in range(len(rounds) - 1, -1, -1):
        # trees whose last round this is: one block, or a lone leaf
        ending = rounds[k].where((F.col("n") <= FAN**depth) & (F.col("pos") == 0) & ((F.col("n") > 1) | F.lit(k == 0))).select("grp")
        e, t = ending.alias("e"), tops.alias("t")
        whole = e.join(t, F.col("e.grp").eqNullSafe(F.col("t.grp"))).select("t.grp", F.lit(-1).cast("long").alias("pos"), "before", "after", "subroot", "root")
        held = whole if held is None else held.unionByName(whole)
        if k == 0:
            return held

        def hand_down(grp, block, rows):
            up, nodes = rows[0], rows[1:]
            height = min(depth, levels(nodes[0]["n"]))
            top = grow([r["digest"] for r in nodes], height)[-1][0]
            for r in nodes:
                own = top.beside(route(r["pos"], height))
                yield {"grp": grp, "pos": -1 - r["pos"], "before": [b for b, _ in own] + up["before"], "after": [a for _, a in own] + up["after"], "subroot": up["subroot"], "root": up["root"]}

        held = cut(_mapped(blocks(depth, rounds[k].where("n > 1"), held), schema, hand_down), name)
    return held


def prove(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """One row per document: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, copied array<string>).

    A document's leaf is leaf_digest of its fields. A group's leaves ascend by id; while several nodes are left, every FAN consecutive ones, the last run
    also fewer, become the SHA-256 of their digests' text. The one left is the subroot; the groups' subroots, by group, give the root in the same way.
    proof_sha256 is that of the siblings' digests on the way to the root, level by level, left to right. Where `tampered` (a condition on docs) is true, the
    text's A-Z are lower-cased after the proof was made, and a version of the tree is made that shares all nodes but the leaf's ancestors: these are `copied`,
    from the leaf's parent to the root. folded_root is the version's root, else that of the leaf as it is; verified tells whether it is the root.

    Blocks of FAN ** depth leaves are trees of one task, in which a version copies the path (Node.copy); the part of a version above its block is made by the same
    task from the siblings that were sent down to the block, so versions are spread like the blocks, whatever one group holds. No group is ordered,
    folded or proved by one task.

    Null fields are hashed as `-`; a null group is a group, and the first; null ids come first; rows of one id are ordered by leaf, and equal rows stand
    beside each other. An empty table gives no rows. Other columns are ignored, whatever their names; a text is hashed whole by one task.
    """
    spark = docs.sparkSession
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    other = leaf_digest(*[lower if c == text_col else F.col(c) for c in fields])
    hit = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    rows = docs.select(F.col(group_col).alias("grp"), F.col(id_col).alias("doc_id"), leaf_digest(*[F.col(c) for c in fields]).alias("digest"), F.when(hit, other).alias("other"))
    leaves = cut(ranked(cut(rows, "merkle-leaves"), "merkle-order", "doc_id", "digest"), "merkle-ranked")
    rounds, _ = climb(leaves, "merkle", depth)
    ends = rounds[0].where("n = 1").select("grp", "digest")
    for r in rounds[1:]:
        ends = ends.unionByName(r.where("n = 1").select("grp", "digest"))
    # the root's tree stands over the subroots
    tops = cut(ranked(ends.select(F.lit(0).alias("grp"), F.col("grp").alias("own"), "digest"), "merkle-subroots", "own"), "merkle-tops")
    upper, _ = climb(tops, "merkle-root", depth)
    root = upper[-1].where("n = 1").select("digest").first()
    whole = spark.createDataFrame([(0, [], [], None, root["digest"] if root else None)], f"grp int, {CONTEXT}")
    contexts = cut(handed(depth, tops, descend(upper, whole, "merkle-root-down", depth)), "merkle-contexts")
    held = descend(rounds, contexts, "merkle-down", depth)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = T._parse_datatype_string(f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, copied array<string>")

    def verify(grp, block, rows):
        up, leaves = rows[0], rows[1:]
        height = min(depth, levels(leaves[0]["n"]))
        top = grow([r["digest"] for r in leaves], height)[-1][0]
        above = list(zip(up["before"], up["after"], strict=True))

        def onward(at: str) -> list[str]:
            out = []
            for before, after in above:
                at = digest(before + at + after)
                out.append(at)
            return out

        high = "".join([b + a for b, a in above])
        kept = (onward(top.digest) or [top.digest])[-1]
        for r in leaves:
            path = route(r["pos"], height)
            beside = "".join([b + a for b, a in top.beside(path)])
            folded, copied = kept, None
            if r["other"] is not None:
                version = top.copy(path, r["other"])
                copied = version.along(path)[1:] + onward(version.digest)
                folded = copied[-1] if copied else r["other"]
            yield {
                "doc_id": r["doc_id"], "leaf": r["digest"], "subroot": up["subroot"], "root": up["root"], "proof_sha256": digest(beside + high), "folded_root": folded, "verified": folded == up["root"], "copied": copied,
            }

    return _mapped(blocks(depth, leaves, held), schema, verify)


def handed(depth: int, tops: DataFrame, blocks_up: DataFrame) -> DataFrame:
    """Context of each group's whole tree, from the blocks of the root's tree: (grp, before, after, subroot, root)."""
    kind = tops.schema["own"].dataType.simpleString()
    schema = T._parse_datatype_string(f"grp {kind}, {CONTEXT}")

    def hand(grp, block, rows):
        up, nodes = rows[0], rows[1:]
        height = min(depth, levels(nodes[0]["n"]))
        top = grow([r["digest"] for r in nodes], height)[-1][0]
        for r in nodes:
            own = top.beside(route(r["pos"], height))
            yield {"grp": r["own"], "before": [b for b, _ in own] + up["before"], "after": [a for _, a in own] + up["after"], "subroot": r["digest"], "root": up["root"]}

    return _mapped(blocks(depth, tops, blocks_up), schema, hand)


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source", depth: int = DEPTH) -> DataFrame:
    """The inner nodes of every group's tree: (grp, level, idx, digest), level 1 above the leaves; the top one is the group's subroot. A group of one
    document has none. Nulls, ties and other columns as in prove()."""
    rows = docs.select(F.col(group_col).alias("grp"), F.col(id_col).alias("doc_id"), leaf_digest(*[F.col(c) for c in fields]).alias("digest"))
    leaves = cut(ranked(cut(rows, "merkle-leaves"), "merkle-order", "doc_id", "digest"), "merkle-ranked")
    return climb(leaves.select("grp", "pos", "digest", "n"), "merkle", depth)[1].drop("top")
