"""Merkle manifest of a table with tampered versions (operator 12).

Every row is a leaf; the leaves of a language, in the order of their ids, form a
tree of eight children a node, and the languages' roots form the tree above.

1. Leaves are hashed by Spark and numbered within their language by exact
   positions, so a language with most of the rows is spread over many tasks.
2. The numbered nodes are cut into aligned blocks of ``8 ** HEIGHT``.  One task
   builds the subtree of a block; its root is a node of the next round, until
   one node of the language is left.  The subroots are climbed in the same way.
3. On the way down each block gets the siblings on the path above it: one short
   row a block, made from the path of the block above.
4. The blocks of leaves meet their paths.  A block's tree is persistent: a
   tampered leaf makes a version of it by copying the ancestors of the leaf and
   sharing every other node; above the block the version goes on with the
   siblings of the path.  Proofs are hashed in the same place, so no row ever
   carries its siblings through a shuffle.

A group holds at most ``8 ** HEIGHT`` nodes and one path; the number of rounds
grows with the logarithm of the rows.

Defined cases: null columns are hashed as ``-``; rows without a language are a
tree of their own, before the others; rows without an id come first in their
tree and are never tampered with; rows with equal ids are ordered by their
leaf, and equal rows are equal leaves next to each other; a lone leaf is its
language's root; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recspark.llm.common import ascii_lower, small, stored
from recspark.operators.ordering import global_positions
from recspark.session import configure

CHILDREN, HEIGHT = 8, 3
BLOCK = CHILDREN ** HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "left array<string>, right array<string>, subroot string, root string"


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(text: Column) -> Column:
    return F.sha2(F.concat(*[_field(text if c == "text" else F.col(c)) for c in FIELDS]).cast("binary"), 256)


def is_tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


# ---- one block ----

def digest(inputs: str) -> str:
    return hashlib.sha256(inputs.encode()).hexdigest()


def tree_height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    height = 0
    while n > 1:
        n, height = -(-n // CHILDREN), height + 1
    return height


class Node(tuple):
    """An immutable node: (hash, children)."""

    __slots__ = ()

    @classmethod
    def over(cls, children: tuple) -> Node:
        return cls((digest("".join(c[0] for c in children)), children))


def subtree(hashes: list[str], levels: int) -> Node:
    nodes = [Node((h, ())) for h in hashes]
    for _ in range(levels):
        nodes = [Node.over(tuple(nodes[i:i + CHILDREN])) for i in range(0, len(nodes), CHILDREN)]
    return nodes[0]


def places(at: int, levels: int) -> list[int]:
    """The child to take at each node from the root of a block to leaf ``at``."""
    return [at // CHILDREN ** k % CHILDREN for k in reversed(range(levels))]


def siblings(root: Node, way: list[int]) -> Iterator[tuple[str, str]]:
    """Hashes before and after each node of the way, from the leaf up."""
    found = []
    for i in way:
        children = root[1]
        found.append(("".join(c[0] for c in children[:i]), "".join(c[0] for c in children[i + 1:])))
        root = children[i]
    return reversed(found)


def changed(root: Node, way: list[int], leaf: str) -> Node:
    """A version of the tree with another leaf: the nodes of the way are copied,
    all others shared."""
    if not way:
        return Node((leaf, ()))
    i, children = way[0], root[1]
    return Node.over((*children[:i], changed(children[i], way[1:], leaf), *children[i + 1:]))


def folded(node: str, path) -> list[str]:
    """The ancestors of a node along its siblings."""
    out = []
    for left, right in path:
        node = digest(left + node + right)
        out.append(node)
    return out


# ---- all blocks ----

def _levels(n: Column) -> Column:
    """Levels that one round builds: ``tree_height(n)``, at most ``HEIGHT``."""
    return sum(((n > CHILDREN ** k).cast("int") for k in range(HEIGHT)), F.lit(0))


def _block() -> Column:
    return F.expr(f"pos div {BLOCK}").alias("block")


def climb(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Nodes are (tree, pos, hash, n), n being the tree's nodes in that round.
    Returns the nodes of each round and the roots (tree, hash)."""
    def build(key, group):
        import pyarrow as pa

        rows = group.sort_by("pos")
        n = rows["n"][0].as_py()
        root = subtree(rows["hash"].to_pylist(), min(HEIGHT, tree_height(n)))
        return pa.table({"tree": [key[0].as_py()], "pos": [key[1].as_py()], "hash": [root[0]], "n": [-(-n // BLOCK)]})

    rounds, roots = [nodes], None
    while True:
        nodes = rounds[-1]
        done = nodes.where("n = 1").select("tree", "hash")
        roots = done if roots is None else roots.unionByName(done)
        if not nodes.where("n > 1").limit(1).count():
            return rounds, roots
        above = nodes.where("n > 1").select("tree", _block(), "pos", "hash", "n").groupBy("tree", "block")
        rounds.append(stored(above.applyInArrow(build, "tree string, pos long, hash string, n long"), f"{name}-round"))


def _paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, pos) and the path of every node, from the paths of their blocks."""
    def work(key, group, path):
        import pyarrow as pa

        rows = group.sort_by("pos")
        levels = min(HEIGHT, tree_height(rows["n"][0].as_py()))
        root = subtree(rows["hash"].to_pylist(), levels)
        up = path.to_pylist()[0]
        left, right = [], []
        for at in range(rows.num_rows):
            own = list(siblings(root, places(at, levels)))
            left.append([x for x, _ in own] + up["left"])
            right.append([y for _, y in own] + up["right"])
        strings = pa.list_(pa.string())
        return pa.table({"tree": rows["tree"], "pos": rows["pos"], "left": pa.array(left, strings), "right": pa.array(right, strings),
                         "subroot": [up["subroot"]] * len(left), "root": [up["root"]] * len(left)})

    nodes = nodes.select("tree", _block(), "pos", "hash", "n")
    return (nodes.groupBy("tree", "block").cogroup(above.groupBy("tree", "block"))
            .applyInArrow(work, f"tree string, pos long, {_PATH}"))


def descend(rounds: list[DataFrame], ends: DataFrame, name: str) -> DataFrame:
    """(tree, block) and the path above each block of the first round; ``ends``
    holds the path above each tree."""
    above = None
    for k in reversed(range(len(rounds))):
        tops = rounds[k].where("n = 1").select("tree").join(ends, "tree").withColumn("block", F.lit(0).cast("long"))
        # columns of their own: the nodes meet these rows again
        tops = tops.select(*[F.col(c).alias(c) for c in ("tree", "block", "left", "right", "subroot", "root")])
        above = tops if above is None else tops.unionByName(above.withColumnRenamed("pos", "block"))
        if k:
            above = stored(_paths(rounds[k], above), f"{name}-paths")
    return above


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, pos, doc_id, hash, other, n); ``other`` is the tampered leaf."""
    text = F.col("text")
    rows = docs.select(F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0")).alias("tree"), "doc_id",
                       leaf_hash(text).alias("hash"),
                       F.when(is_tampered(F.col("doc_id")), leaf_hash(ascii_lower(text))).alias("other"))
    # written before the ranges are sampled, so that texts are read and hashed once
    rows = stored(rows, "merkle-leaves")
    rows = stored(global_positions(rows, ["doc_id", "hash"], by=["tree"]), "merkle-positions")
    return rows.join(small(stored(rows.groupBy("tree").agg(F.count("*").alias("n")), "merkle-trees")), "tree")


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified, and ``copied``: the hashes of the nodes that the
    tampered version copies, from the leaf up (null without tampering)."""
    configure(docs.sparkSession)
    rows = leaves(docs.select(*FIELDS))
    rounds, subroots = climb(rows.select("tree", "pos", "hash", "n"), "merkle")
    subroots = stored(subroots, "merkle-subroots")

    top, n = global_positions(subroots, ["tree"], with_total=True)
    top = stored(top.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "pos", "hash", F.lit(n).cast("long").alias("n")), "merkle-top")
    top_nodes = top.select("tree", "pos", "hash", "n")
    top_rounds, root = climb(top_nodes, "merkle-top")
    none = F.array().cast("array<string>")
    ends = root.select("tree", none.alias("left"), none.alias("right"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    up = _paths(top_nodes, descend(top_rounds, ends, "merkle-top")).drop("tree", "subroot")
    ends = stored(top.join(up, "pos").select(F.col("of").alias("tree"), "left", "right", F.col("hash").alias("subroot"), "root"), "merkle-ends")
    above = descend(rounds, ends, "merkle")

    def work(key, group, path):
        import pyarrow as pa

        rows = group.sort_by("pos")
        levels = min(HEIGHT, tree_height(rows["n"][0].as_py()))
        tree = subtree(rows["hash"].to_pylist(), levels)
        up = path.to_pylist()[0]
        beyond = list(zip(up["left"], up["right"]))
        rest = "".join(x + y for x, y in beyond).encode()
        proof, end, copied = [], [], []
        same = folded(tree[0], beyond)[-1:] or [tree[0]]  # untampered leaves all fold to this
        for at, other in enumerate(rows["other"].to_pylist()):
            way = places(at, levels)
            own = hashlib.sha256("".join(x + y for x, y in siblings(tree, way)).encode())
            own.update(rest)
            proof.append(own.hexdigest())
            if other is None:
                end.append(same[0])
                copied.append(None)
                continue
            version = changed(tree, way, other)
            ancestors = folded(version[0], beyond)
            nodes = [version]
            for i in way:
                nodes.append(nodes[-1][1][i])
            copied.append([x[0] for x in reversed(nodes)] + ancestors)
            end.append(copied[-1][-1])
        m = len(proof)
        return pa.table({"doc_id": rows["doc_id"], "leaf": rows["hash"], "subroot": [up["subroot"]] * m, "root": [up["root"]] * m,
                         "proof_sha256": proof, "folded_root": end, "verified": [x == up["root"] for x in end],
                         "copied": pa.array(copied, pa.list_(pa.string()))})

    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.StringType()) for c in (
        "leaf", "subroot", "root", "proof_sha256", "folded_root")), T.StructField("verified", T.BooleanType()),
        T.StructField("copied", T.ArrayType(T.StringType()))])
    rows = rows.select("tree", _block(), "pos", "doc_id", "hash", "other", "n")
    return rows.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(work, schema)


_SQL_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_SQL_LEAF = "sha256(" + " || ".join(_SQL_FIELD.format(c) for c in FIELDS) + ")"
_SQL_OTHER = _SQL_LEAF.replace("text::", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')::")

#: crc32 of an ASCII string s, bit by bit
SQL_CRC32 = """xor(list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(range(0, length({s})), lambda i: ascii(substr({s}, i::INT + 1, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)),
    lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT)"""

SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_SQL_LEAF} AS leaf,
    CASE WHEN {SQL_CRC32.format(s="doc_id::VARCHAR")} % 3 = 0 THEN {_SQL_OTHER} ELSE {_SQL_LEAF} END AS other
  FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
             count(*) OVER (PARTITION BY lang) AS n FROM d),
t(lang, lvl, i, h, n) AS (
  SELECT lang, 0, pos, leaf, n FROM p
  UNION ALL
  SELECT lang, any_value(lvl) + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), any_value(n + 7) // 8
  FROM t WHERE n > 1 GROUP BY lang, i // 8),
s AS (SELECT lang, h, lvl AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, i, h, n) AS (
  SELECT 0, pos, h, n FROM s
  UNION ALL
  SELECT any_value(lvl) + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), any_value(n + 7) // 8 FROM u WHERE n > 1 GROUP BY i // 8),
-- all nodes; those above a language's root carry on its levels
a AS (
  SELECT p.doc_id, p.leaf, t.lvl, t.i, t.h, p.pos // (8 ** t.lvl)::BIGINT AS own FROM p JOIN t
    ON t.lang IS NOT DISTINCT FROM p.lang AND t.n > 1 AND t.i // 8 = p.pos // (8 ** (t.lvl + 1))::BIGINT
  UNION ALL
  SELECT p.doc_id, p.leaf, s.height + u.lvl, u.i, u.h, s.pos // (8 ** u.lvl)::BIGINT FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang
    JOIN u ON u.n > 1 AND u.i // 8 = s.pos // (8 ** (u.lvl + 1))::BIGINT),
q AS (SELECT doc_id, leaf, lvl, coalesce(string_agg(h, '' ORDER BY i) FILTER (i < own), '') AS l,
             coalesce(string_agg(h, '' ORDER BY i) FILTER (i > own), '') AS r FROM a GROUP BY doc_id, leaf, lvl),
proof AS (SELECT doc_id, leaf, sha256(string_agg(l || r, '' ORDER BY lvl)) AS h FROM q GROUP BY doc_id, leaf),
f(doc_id, leaf, lvl, h) AS (
  SELECT doc_id, leaf, 0, other FROM p
  UNION ALL
  SELECT f.doc_id, f.leaf, f.lvl + 1, sha256(q.l || f.h || q.r) FROM f JOIN q
    ON q.doc_id = f.doc_id AND q.leaf = f.leaf AND q.lvl = f.lvl),
e AS (SELECT doc_id, leaf, arg_max(h, lvl) AS h FROM f GROUP BY doc_id, leaf)
SELECT p.doc_id, p.leaf, s.h AS subroot, top.h AS root, coalesce(proof.h, sha256('')) AS proof_sha256, e.h AS folded_root,
       e.h = top.h AS verified
FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang JOIN e ON e.doc_id = p.doc_id AND e.leaf = p.leaf
  LEFT JOIN proof ON proof.doc_id = p.doc_id AND proof.leaf = p.leaf, (SELECT h FROM u WHERE n = 1) top
"""
