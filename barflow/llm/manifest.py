"""Merkle manifest of a dataset: a leaf per row, a binary tree per lang, a tree over the langs, and a proof per row.

A leaf is the sha256 of doc_id, source, lang, n_chars and text, each ``-`` if NULL, else its bytes in UTF-8, ``:``
and the value. Leaves of a lang ascend by doc_id; while several nodes remain, every two neighbours become the hash of
both (a last one alone, its own hash). What remains is the lang's subroot; subroots in order of lang (NULL first) make
the root alike.

Nested-struct rollup. A leaf's rank in its lang is split into a block (``1 << LEVELS`` leaves at most) and binary digits.
Inside a block, which one exchange brings together, the digits are grouped away one after the other, lowest first: each
grouping nests the children it joins, so a block ends as one struct that holds its tree. The tops of the blocks are
the leaves of the next tier, until one node is left. Back down, a tier's blocks and the paths of their tops are
stacked and grouped by block; then nested transforms hand the siblings down the struct, and an explode emits each
leaf with its whole path. No join takes part in the tree, and nothing larger than a block is held.

Ranks come from one range partitioning by (lang, doc_id), row numbers of its partitions, and a running count over
(partition, lang), as many rows as partitions and langs; that table is joined to the rows.

A path's entries tell the sibling (NULL where a node was alone) and whether it stands left, from leaf to root, so
``folded`` recomputes a root from any leaf.

NULL values take part as ``-``; rows with a NULL doc_id come last in their lang, rows that share an id are ordered by
leaf. Equal rows have equal leaves, at places of their own. An empty table has no rows and no root. Texts are hashed whole. Further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barflow.llm.common import stage, table
from barflow.llm.registry import query

#: Levels of a block: it holds 1 << LEVELS nodes at most.
LEVELS = 8
ENTRY = "array<struct<h:string,left:boolean>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(fields: dict[str, Column]) -> Column:
    """The hash of a row; ``fields`` in order."""
    parts = []
    for value in fields.values():
        shown = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-")))
    return digest(F.concat(*parts))


def tampered_fields(fields: dict[str, Column]) -> tuple[Column, dict[str, Column]]:
    """Which rows are tampered with (7 divides the crc32 of doc_id), and their fields: n_chars grows by one."""
    hit = F.coalesce(F.pmod(F.crc32(fields["doc_id"].cast("string").cast("binary")), F.lit(7)) == 0, F.lit(False))
    return hit, fields | {"n_chars": fields["n_chars"].cast("long") + 1}


def ranked(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with rank (from 0) and n (rows) of their group, in ``order``, which tells unequal rows apart."""
    keys = [F.col(group).asc_nulls_first(), *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stage(dealt.withColumn("at", F.monotonically_increasing_id()))  # partition and row, as written
    part = F.shiftright("at", 33)
    counts = placed.groupBy(F.col(group).alias("of"), part.alias("of_part")).agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    every = Window.partitionBy("of")
    before = every.orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("of", "of_part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(every).alias("n"))
    joined = placed.join(counts, F.col(group).eqNullSafe(F.col("of")) & (part == F.col("of_part")))
    return joined.withColumn("rank", F.col("at") - F.col("first") + F.col("before")).drop("at", "of", "of_part", "first", "before")


def _exists(level: int) -> Column:
    """Whether the group's tree has the level that joins nodes of ``level`` - 1."""
    return F.col("n") > F.lit(1 << (level - 1)).cast("long")


def rolled(nodes: DataFrame, group: list[str], levels: int) -> DataFrame:
    """From (group, n, rank, node) to one row per block: (group, n, block, node), node nesting the tree of its block."""
    nodes = nodes.withColumn("block", F.shiftright("rank", levels))
    digits = [f"digit{i}" for i in range(levels)]
    nodes = nodes.select(*group, "n", "block", "node", *[F.shiftright("rank", i).bitwiseAND(F.lit(1).cast("long")).cast("int").alias(d) for i, d in enumerate(digits)])
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = nodes.repartition(parts, *group, "block")
    for i in range(levels):
        kids = F.transform(F.array_sort(F.collect_list(F.struct(F.col(digits[i]).alias("digit"), F.col("node")))), lambda x: x["node"])
        nodes = nodes.groupBy(*group, "n", "block", *digits[i + 1 :]).agg(kids.alias("kids"))
        hashes = F.array_join(F.transform("kids", lambda x: x["h"]), "")
        h = F.when(_exists(i + 1), digest(hashes)).otherwise(F.col("kids")[0]["h"])
        nodes = nodes.withColumn("node", F.struct(h.alias("h"), F.col("kids"))).drop("kids")
    return nodes


def _handed(node: Column, level: int, path: Column, n: Column, rank: Column, leaf: Callable[[Column, Column, Column], Column]) -> Column:
    """An array of the leaves under ``node``, each with its rank and its path (nearest sibling first)."""
    if level == 0:
        return F.array(leaf(node, rank, path))
    kids = node["kids"]

    def below(kid: Column, i: Column) -> Column:
        entry = F.array(F.struct(F.get(kids, F.lit(1) - i)["h"].alias("h"), (i == 1).alias("left")))
        step = F.when(n > F.lit(1 << (level - 1)).cast("long"), entry).otherwise(F.array().cast(ENTRY))
        return _handed(kid, level - 1, F.concat(step, path), n, rank * 2 + i, leaf)

    return F.flatten(F.transform(kids, below))


def paths(leaves: DataFrame, group: list[str], payload: list[str], levels: int = LEVELS, above: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """From (group, n, rank, h, payload) the same rows with subroot, root and path.

    ``above`` turns (group, subroot) into (group, subroot, root, path): the tree over the groups. Without it a group's root is its subroot.
    """
    most = leaves.agg(F.max("n")).first()[0]  # one number
    # NULL groups stay groups of their own through every grouping.
    nodes = leaves.select(*group, "n", "rank", F.struct("h", *payload).alias("node"))
    tiers = []
    while True:
        blocks = stage(rolled(nodes, group, levels))
        tiers.append(blocks)
        if (most or 0) <= 1 << levels:
            break
        most = -(-most // (1 << levels))
        n = F.ceil(F.col("n") / F.lit(1 << levels)).cast("long")
        nodes = blocks.select(*group, n.alias("n"), F.col("block").alias("rank"), F.struct(F.col("node.h").alias("h")).alias("node"))
    tops = tiers[-1].select(*group, F.col("block").alias("rank"), F.col("node.h").alias("subroot"))
    state = above(tops) if above else tops.withColumn("root", F.col("subroot")).withColumn("path", F.array().cast(ENTRY))
    for tier in range(len(tiers) - 1, -1, -1):
        blocks, kept = tiers[tier], payload if tier == 0 else []
        known = state.select(*group, F.col("rank").alias("block"), F.lit(None).cast("long").alias("n"), F.lit(None).cast(blocks.schema["node"].dataType).alias("node"), "subroot", "root", "path")
        trees = blocks.select(*group, "block", "n", "node", F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"), F.lit(None).cast(ENTRY).alias("path"))
        one = trees.union(known).groupBy(*group, "block").agg(
            F.first("n", ignorenulls=True).alias("n"), F.first("node", ignorenulls=True).alias("node"), F.max("subroot").alias("subroot"),
            F.max("root").alias("root"), F.first("path", ignorenulls=True).alias("path"))

        def leaf(node: Column, rank: Column, path: Column) -> Column:
            return F.struct(rank.alias("rank"), node["h"].alias("h"), path.alias("path"), *[node[p].alias(p) for p in kept])

        handed = _handed(F.col("node"), levels, F.col("path"), F.col("n"), F.col("block"), leaf)
        state = one.select(*group, "subroot", "root", F.explode(handed).alias("leaf")).select(*group, "subroot", "root", "leaf.*")
    return state


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    def step(h: Column, x: Column) -> Column:
        return digest(F.when(x["h"].isNull(), h).when(x["left"], F.concat(x["h"], h)).otherwise(F.concat(h, x["h"])))

    return F.aggregate(path, leaf, step)


def proof(path: Column) -> Column:
    """The hash of all siblings, nearest first."""
    return digest(F.array_join(F.transform(path, lambda x: x["h"]), ""))


def proofs(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Per row: doc_id, lang, rank, leaf, changed (its leaf after tampering, else NULL), subroot, root, path."""
    fields = {name: F.col(name) for name in FIELDS}
    hit, changed = tampered_fields(fields)
    rows = docs.select("lang", F.col("doc_id").cast("long").alias("doc_id"), leaf_of(fields).alias("h"), F.when(hit, leaf_of(changed)).alias("changed"))
    leaves = stage(ranked(rows, "lang", [F.col("doc_id").asc_nulls_last(), F.col("h").asc()]))

    def langs(tops: DataFrame) -> DataFrame:
        subroots = ranked(tops.select("lang", "subroot", F.lit(0).alias("all")), "all", [F.col("lang").asc_nulls_first()])
        top = paths(subroots.select("all", "n", "rank", F.col("subroot").alias("h"), "lang"), ["all"], ["lang"], levels)
        return top.select("lang", F.lit(0).cast("long").alias("rank"), F.col("h").alias("subroot"), "root", "path")

    return paths(leaves, ["lang"], ["doc_id", "changed"], levels, langs).withColumnRenamed("h", "leaf")


SQL = r"""
WITH RECURSIVE bits AS (
  SELECT doc_id, lang, source, n_chars, text,
    CASE WHEN doc_id IS NULL THEN NULL ELSE list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda crc, x: CASE WHEN (xor(crc, x) & 1) = 1 THEN xor(xor(crc, x) >> 1, 3988292384) ELSE xor(crc, x) >> 1 END) END AS crc
  FROM documents),
hashed AS (
  SELECT doc_id, lang,
    sha256(p_id || p_source || p_lang || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || p_text) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(p_id || p_source || p_lang || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || p_text) END AS changed
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS p_id, coalesce(strlen(source) || ':' || source, '-') AS p_source,
    coalesce(strlen(lang) || ':' || lang, '-') AS p_lang, coalesce(strlen(text) || ':' || text, '-') AS p_text FROM bits)),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
nodes AS (
  SELECT lang, 0 AS level, place, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, level + 1, place // 2, (n + 1) // 2, sha256(h || coalesce(other, '')) FROM (
    SELECT *, lead(h) OVER (PARTITION BY lang ORDER BY place) AS other FROM nodes WHERE n > 1) WHERE place % 2 = 0),
subroots AS (
  SELECT lang, h, level AS depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, place, n, h FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, (n + 1) // 2, sha256(h || coalesce(other, '')) FROM (
    SELECT *, lead(h) OVER (ORDER BY place) AS other FROM tops WHERE n > 1) WHERE place % 2 = 0),
steps AS (
  SELECT l.lang, l.place AS leaf_place, x.level, x.h, (l.place >> x.level) % 2 = 1 AS at_right
  FROM leaves l JOIN nodes x ON x.lang IS NOT DISTINCT FROM l.lang AND x.place = xor(l.place >> x.level, 1)
  UNION ALL
  SELECT l.lang, l.place, s.depth + x.level, x.h, (s.place >> x.level) % 2 = 1
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN tops x ON x.place = xor(s.place >> x.level, 1)),
ways AS (SELECT lang, leaf_place, string_agg(h, '' ORDER BY level) AS siblings FROM steps GROUP BY ALL),
sizes AS (SELECT s.lang, s.depth + (SELECT max(level) FROM tops) AS depth FROM subroots s),
folds AS (
  SELECT l.lang, l.place, 0 AS level, coalesce(changed, leaf) AS h FROM leaves l
  UNION ALL
  SELECT f.lang, f.place, f.level + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.at_right THEN s.h || f.h ELSE f.h || s.h END)
  FROM folds f JOIN sizes z ON z.lang IS NOT DISTINCT FROM f.lang AND f.level < z.depth
  LEFT JOIN steps s ON s.lang IS NOT DISTINCT FROM f.lang AND s.leaf_place = f.place AND s.level = f.level)
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(coalesce(w.siblings, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN (SELECT h FROM tops WHERE n = 1) r
LEFT JOIN ways w ON w.lang IS NOT DISTINCT FROM l.lang AND w.leaf_place = l.place
JOIN sizes z ON z.lang IS NOT DISTINCT FROM l.lang
JOIN folds f ON f.lang IS NOT DISTINCT FROM l.lang AND f.place = l.place AND f.level = z.depth
"""


@query("op12_manifest", SQL)
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and whether it holds after tampering."""
    made = proofs(table(spark, sf_dir)).withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    return made.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
