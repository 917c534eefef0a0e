"""Merkle manifest of a dataset with incremental witnesses.

A leaf is the hash of a row's fields.  The leaves of a group (``source``) stand
in the order of their ids; every ``FAN`` consecutive nodes become their hash,
level by level, until one is left, the group's subroot; the subroots, in the
order of their groups, likewise give the root.

Trees are built by aligned append.  Nodes of a group are dealt out in blocks of
``FAN ** DEPTH`` consecutive ones; a task takes the nodes of a block one by one,
in order, and holds only the open subtrees.  A node that is appended starts with an
empty witness; when a run of siblings is complete, each of its subtrees
gets the others of the run added to its witness (held once for the subtree, not
once for each leaf), and the run's hash is appended one level up.  The roots of
blocks are then appended as nodes of the next round, until each group is one
block; groups' subroots are the nodes of a last tree.  Witnesses come back the
other way: a block's own witness is handed to the task that appends its nodes
again, which ends theirs with it.

Scale: the text is read once, in a native projection; after that only narrow
rows move.  Leaves are range-sorted by (group, id, leaf, row number), which are unique, so
neither a large group nor a repeated id lies in one task; a block is a bounded
number of rows.  Rounds grow with the logarithm of the largest group; each
has a ``FAN ** DEPTH``-th of the rows of the one before.  Only counts reach the driver.

Cases: a null field is hashed as ``-``, so it differs from an empty one; a null
group is a group of its own, before all others; null ids come first in their group; equal
ids stand in the order of their leaves; rows that repeat are leaves
each; a group of one leaf has that leaf as its subroot, and a dataset of one
group that group's subroot as its root; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.scratch import written

FAN, DEPTH = 3, 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<at: int, siblings: array<string>>>"


def leaf_hash(fields: Sequence[Column]) -> Column:
    """Hash of fields, each with its length in bytes; a null field is ``-``."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(one(c.cast("string")) for c in fields)), 256)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its witness lead to."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(
        F.array_join(F.slice(s["siblings"], 1, s["at"]), ""), h, F.array_join(F.slice(s["siblings"], s["at"] + 1, FAN), "")), 256))


def siblings(steps: Column) -> Column:
    """All siblings of a witness, level by level, as one text."""
    return F.array_join(F.flatten(F.transform(steps, lambda s: s["siblings"])), "")


class Appender:
    """The open subtrees of one block.  A node is ``[run, place]`` once its run
    is complete; a run is (hashes, node above)."""

    def __init__(self):
        self.open: list[list[tuple[str, list]]] = [[]]

    def append(self, digest: str, level: int = 0) -> list:
        """Put a node behind the others of its level; complete its run if it is full."""
        node: list = []
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((digest, node))
        if len(self.open[level]) == FAN:
            self._complete(level)
        return node

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        hashes = [h for h, _ in run]
        above = self.append(sha256("".join(hashes).encode()).hexdigest(), level + 1)
        for place, (_, node) in enumerate(run):
            node += (hashes, above), place

    def close(self, levels: int) -> str:
        """Complete the last run of every level below ``levels``, short or not; the root."""
        for level in range(levels):
            if level < len(self.open) and self.open[level]:
                self._complete(level)
        return self.open[levels][0][0]


def witness(node: list) -> list[dict]:
    """The completed runs above a node: its place and the others of the run."""
    steps = []
    while node:
        (hashes, above), place = node
        steps.append({"at": place, "siblings": hashes[:place] + hashes[place + 1:]})
        node = above
    return steps


def levels_of(n: int, depth: int = DEPTH) -> int:
    """Levels of a block in a group of ``n`` nodes."""
    levels = 0
    while n > 1 and levels < depth:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _blocks(batches):
    """Rows of each block, as ``(key, n, rows)``; they come sorted by block."""
    key, n, rows = None, 0, []
    for b in batches:
        for r in b.to_pylist():
            of = (r["grp"], r["block"])
            if of != key:
                if rows:
                    yield key, n, rows
                key, n, rows = of, 0, []
            n = r["n"] or n
            rows.append(r)
    if rows:
        yield key, n, rows


def _by_block(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / FAN ** depth).cast("long"))


def _sorted_by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def _batched(rows, schema: Callable[[], pa.Schema], size: int = 512):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema())
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema())


def block_roots(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The roots of blocks as the nodes ``grp, pos, n, digest`` of the next round."""
    schema = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def run(batches):
        def roots():
            for (grp, block), n, rows in _blocks(batches):
                tree = Appender()
                for r in rows:
                    tree.append(r["digest"])
                yield {"grp": grp, "pos": block, "n": -(-n // FAN ** depth), "digest": tree.close(levels_of(n, depth))}
        yield from _batched(roots(), lambda: schema)

    rows = _sorted_by_block(_by_block(nodes.select("grp", "pos", "n", "digest"), depth))
    return rows.mapInArrow(run, "grp string, pos long, n long, digest string")


def witnesses(nodes: DataFrame, above: DataFrame, carry: Sequence[str] = (), depth: int = DEPTH) -> DataFrame:
    """``grp, pos``, the ``carry`` columns and ``steps, subroot, root`` for each of
    ``nodes``; ``above`` has ``grp, pos`` (the block), ``steps, subroot, root`` of
    the blocks' own roots."""
    given = [f for f in nodes.schema if f.name in carry]
    made = [("steps", STEPS), ("subroot", "string"), ("root", "string")]

    def run(batches):
        types = {}

        def typed():
            for b in batches:
                types.update(zip(b.schema.names, b.schema.types, strict=True))
                yield b

        def out():
            for _, n, (top, *rows) in _blocks(typed()):
                tree = Appender()
                leaves = [tree.append(r["digest"]) for r in rows]
                tree.close(levels_of(n, depth))
                for r, node in zip(rows, leaves, strict=True):
                    yield r | {"steps": witness(node) + top["steps"], "subroot": top["subroot"], "root": top["root"]}

        names = ["grp", "pos", *(f.name for f in given), *(n for n, _ in made)]
        yield from _batched(out(), lambda: pa.schema([(n, types[n]) for n in names]))

    none = lambda kind: F.lit(None).cast(kind)
    own = _by_block(nodes, depth).select("grp", "block", "pos", "n", "digest", *(f.name for f in given), *(none(t).alias(n) for n, t in made))
    first = above.select("grp", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"),
                         none("string").alias("digest"), *(none(f.dataType).alias(f.name) for f in given), "steps", "subroot", "root")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given)
    return _sorted_by_block(own.unionByName(first)).mapInArrow(
        run, f"grp string, pos long, {fields + ', ' if fields else ''}" + ", ".join(f"{n} {t}" for n, t in made))


def positions(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``pos`` (from 0) and ``n`` (all) of each row in its ``grp``, in ``order``
    (nulls first).  Rows are sorted in ranges; the ranges' counts by group go before."""
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order)]
    run = leaves.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    run = written(run.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "manifest-sorted")
    sizes = run.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("m"), F.min("at").alias("first"))
    of = Window.partitionBy("grp").orderBy("part")
    sizes = sizes.select("grp", "part", "first", F.sum("m").over(Window.partitionBy("grp")).alias("n"),
                         (F.sum("m").over(of) - F.col("m")).alias("before"))
    joined = run.alias("r").join(sizes.alias("s"), F.expr("r.grp <=> s.grp AND r.part = s.part"))
    return joined.select("r.*", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "n").drop("at", "part")


def tree(nodes: DataFrame, above: Callable[[DataFrame], DataFrame] | None = None, carry: Sequence[str] = (), depth: int = DEPTH) -> DataFrame:
    """Witnesses of ``grp, pos, n, digest`` nodes with their ``carry`` columns.
    ``above`` maps the groups' subroots (``grp, digest``) to ``grp, steps, subroot,
    root``; without it a subroot is the root."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > FAN ** depth:
        rounds.append(written(block_roots(rounds[-1], depth), "manifest-round"))
    tops = written(block_roots(rounds[-1], depth), "manifest-round").select("grp", "digest")
    if above is None:
        top = tops.select("grp", F.array().cast(STEPS).alias("steps"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    else:
        top = above(tops)
    top = top.withColumn("pos", F.lit(0).cast("long"))
    for own in reversed(rounds[1:]):
        top = written(witnesses(own, top, depth=depth), "manifest-witnesses")
    return witnesses(nodes, top, carry, depth)


def _of_all(subroots: DataFrame, depth: int) -> DataFrame:
    """Witnesses of the groups' subroots in the tree over them."""
    groups = written(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), "manifest-subroots")
    groups = written(positions(groups, ["name"]).withColumn("own", F.col("digest")), "manifest-groups")
    found = tree(groups, carry=["name", "own"], depth=depth)
    return written(found.select(F.col("name").alias("grp"), "steps", F.col("own").alias("subroot"), "root"), "manifest-top")


def manifest(leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``leaves`` (a written table with ``grp`` string, ``id``, ``leaf``, ``row``
    unique, and more) with ``steps`` (the witness), ``subroot`` and ``root``."""
    placed = positions(leaves.withColumn("digest", F.col("leaf")), ["id", "digest", "row"])
    nodes = written(placed, "manifest-nodes")
    carry = [c for c in leaves.columns if c != "grp"]
    return tree(nodes, lambda subroots: _of_all(subroots, depth), carry, depth).drop("pos", "row")


def leaves_of(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", id_col: str = "doc_id", **more: Column) -> DataFrame:
    """``grp, id, leaf, row`` of each row, written, with ``more`` columns."""
    out = docs.select(F.col(group).cast("string").alias("grp"), F.col(id_col).alias("id"), leaf_hash([F.col(f) for f in fields]).alias("leaf"),
                      *(c.alias(n) for n, c in more.items()))
    return written(out.withColumn("row", F.monotonically_increasing_id()), "manifest-leaves")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    cut = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & (F.instr("text", "\n") > 0)
    fields = [F.replace("text", F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in FIELDS]
    leaves = leaves_of(docs, tampered=F.when(cut, leaf_hash(fields)))
    made = manifest(leaves).withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("steps")))
    return made.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("steps")), 256).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(leaf_levels: int = 14, group_levels: int = 9) -> str:
    """DuckDB SQL, one step a level: enough for 3 ** leaf_levels rows a source
    and 3 ** group_levels sources.  A level of one node is carried on as it is."""
    def climb(name: str, levels: int) -> list[str]:
        out = []
        for i in range(levels):
            out.append(f"""{name}r{i} AS MATERIALIZED (SELECT grp, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM {name}{i} WHERE cnt > 1 GROUP BY ALL)""")
            out.append(f"""{name}{i + 1} AS MATERIALIZED (
  SELECT grp, run AS pos, sha256(array_to_string(hs, '')) AS h, (SELECT (any_value(cnt) + 2) // 3 FROM {name}{i} x WHERE x.grp = r.grp) AS cnt FROM {name}r{i} r
  UNION ALL SELECT grp, pos, h, cnt FROM {name}{i} WHERE cnt <= 1)""")
        return out

    def walk(name: str, runs: str, levels: int) -> list[str]:
        return [f"""{name}{i + 1} AS MATERIALIZED (
  SELECT w.* EXCLUDE (pos, proof, folded), CASE WHEN hs IS NULL THEN pos ELSE pos // 3 END AS pos,
         CASE WHEN hs IS NULL THEN proof ELSE proof || array_to_string(hs[1:pos % 3], '') || array_to_string(hs[pos % 3 + 2:], '') END AS proof,
         CASE WHEN hs IS NULL THEN folded ELSE sha256(array_to_string(hs[1:pos % 3], '') || folded || array_to_string(hs[pos % 3 + 2:], '')) END AS folded
  FROM {name}{i} w LEFT JOIN {runs}r{i} r ON r.grp = w.grp AND r.run = w.pos // 3)""" for i in range(levels)]

    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    row = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    steps = [
        # checksum of the id's digits, bit by bit: bytes are mixed in, -1 shifts
        """i AS (SELECT *, coalesce(list_reduce([4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT)] || list_transform(range(8), lambda x: -1::BIGINT))),
          lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) % 2 = 1, false) AS cut FROM documents)""",  # the last xor turns the lowest bit
        f"""l AS MATERIALIZED (SELECT doc_id, source, {row("text")} AS leaf, CASE WHEN cut THEN {row("replace(text, chr(10), '')")} ELSE {row("text")} END AS told FROM i)""",
        """s AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
          count(*) OVER (PARTITION BY source) AS cnt FROM l)""",
        "n0 AS MATERIALIZED (SELECT grp, pos, leaf AS h, cnt FROM s)", *climb("n", leaf_levels),
        f"g0 AS MATERIALIZED (SELECT 0 AS grp, grp AS pos, h, count(*) OVER () AS cnt FROM n{leaf_levels})", *climb("g", group_levels),
        "w0 AS MATERIALIZED (SELECT doc_id, leaf, grp, pos, '' AS proof, told AS folded FROM s)", *walk("w", "n", leaf_levels),
        f"v0 AS MATERIALIZED (SELECT doc_id, leaf, g0.h AS subroot, 0 AS grp, w.grp AS pos, proof, folded FROM w{leaf_levels} w JOIN g0 ON g0.pos = w.grp)", *walk("v", "g", group_levels)]
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM v{group_levels}, (SELECT h AS root FROM g{group_levels})"""


SQL = _sql()
