"""A Merkle manifest of a table of documents as a postorder append log.

Leaves of one tree stand in order; while several nodes remain, every ``ARITY`` consecutive ones (the last run may be
shorter, even one) become the digest of their concatenation. An append log holds a tree's nodes in the order in which
they are completed, which is postorder, and the position of any node follows from the sizes of the full subtrees before
it (``postorder``): nothing but a number addresses a sibling.

* ``leaves`` digests each row where it stands; texts are never shuffled.
* ``numbered`` sorts the digests by ranges and numbers the leaves of each tree from counts by partition.
* ``build`` runs aligned builders: builder b of a tree takes the leaves b * ALIGNED .. and writes that subtree's segment of
  the log in completion order. The builders' last nodes are the leaves of the next round, so a task never holds more than
  ALIGNED nodes however large a tree is, and rounds are a logarithm of the number of leaves.
* ``proofs`` goes back from the root: each segment takes the path of its own last node and adds the siblings below it,
  found in the segment by their positions.
* ``log`` is the append log as rows (tree, position, level, at, digest); ``proof_at`` extracts single proofs from it by an
  equi-join on positions alone.

Defined cases: a null value is ``-`` in a leaf, an empty text has length 0; a null lang is a tree of its own, before all
others; null ids come first, repeated ids go by their leaf, repeated rows are leaves each; long texts are digested where
they stand; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, cut

ARITY = 8
#: Levels that one builder makes, and so its leaves: ARITY ** LEVELS.
LEVELS = 4
ALIGNED = ARITY**LEVELS

_PATH = "array<struct<left string, right string>>"


# --- the shape of a tree -----------------------------------------------------------------------------


def widths(n: int) -> list[int]:
    """Nodes on each level of a tree of n leaves; none for no leaf."""
    out = [n] if n else []
    while out and out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def postorder(n: int, level: int, at):
    """The position in the log of node ``at`` (a number or an array) of ``level`` in a tree of n leaves.

    Before it stand all nodes of its level and below up to its own end, and those above that end before its beginning.
    """
    before = 0
    for k, width in enumerate(widths(n)):
        before = before + (np.minimum((at + 1) * ARITY ** (level - k), width) if k <= level else at // ARITY ** (k - level))
    return before - 1


def rounds(n: int) -> int:
    """Rounds of builders until one node remains."""
    return max(1, -(-(len(widths(n)) - 1) // LEVELS))


# --- leaves ------------------------------------------------------------------------------------------


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tree_of(value: Column) -> Column:
    """A name of the tree that sorts null before all values, and those by their bytes."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(tree, doc_id, digest, told): each document's leaf in the tree of its lang, and what a tampered copy would give."""
    docs = docs.select(*[F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("source", "string"), ("lang", "string"), ("n_chars", "long"), ("text", "string"))])
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    told = F.lit(None).cast("string") if tampered is None else F.when(tampered, leaf(*own, lower_ascii(F.col("text"))))
    return docs.select(tree_of(F.col("lang")).alias("tree"), "doc_id", leaf(*own, F.col("text")).alias("digest"), told.alias("told"))


def _counted(columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            trees = np.array(b.column("tree").to_pylist(), object)
            starts = np.flatnonzero(np.concatenate([[True], trees[1:] != trees[:-1]]))
            at = np.arange(len(trees)) - np.repeat(starts, np.diff([*starts, len(trees)]))
            if trees[0] == last:
                at[: starts[1] if len(starts) > 1 else len(at)] += seen
            last, seen = trees[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(np.full(len(at), part), pa.int64()), pa.array(at, pa.int64())], [*columns, "_part", "_at"])

    return run


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows(tree, digest, ...)`` with ``at``, the number from 0 in its tree by ``order`` and digest, and ``n``, the tree's leaves.

    Ranges of (tree, order, digest) are sorted and counted in their tasks and written; what stands before a range comes from
    the counts alone, one row for each range and tree. Equal rows are told apart by their place in the input, so no key of
    the ranges holds many rows.
    """
    rows = cut(rows).withColumn("_row", F.monotonically_increasing_id())
    keys, columns = ["tree", *order, "digest", "_row"], rows.columns[:-1]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*columns)
    told = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema) + ", _part long, _at long"
    held = cut(ranged.mapInArrow(_counted(columns), told))
    parts = held.groupBy("tree", "_part").agg(F.count("*").alias("_c"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_c").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("tree", "_part", before.alias("_before"), F.sum("_c").over(tree).alias("n"))
    return held.join(parts, ["tree", "_part"]).withColumn("at", F.col("_at") + F.col("_before")).select(*columns, "at", "n")


# --- builders ----------------------------------------------------------------------------------------

_SEGMENT = "tree string, n long, block long, ids array<long>, told array<string>, nodes binary, digest string"


def _hash(digests: np.ndarray) -> str:
    return hashlib.sha256(digests.tobytes()).hexdigest()


def subtree(digests: np.ndarray) -> np.ndarray:
    """The nodes over ``digests`` (S64) in completion order."""
    shape, level = widths(len(digests)), digests
    out = np.empty(sum(shape), "S64")
    for k, width in enumerate(shape):
        if k:
            level = np.array([_hash(level[i * ARITY : (i + 1) * ARITY]) for i in range(width)], "S64")
        out[postorder(len(digests), k, np.arange(width))] = level
    return out


def _builder(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by("at")
    digests = np.array(table.column("digest").to_pylist(), "S64")
    nodes = subtree(digests)
    n, block = table.column("n")[0].as_py(), table.column("at")[0].as_py() // ALIGNED
    made, last = nodes.tobytes(), nodes[-1].decode()
    if n > ALIGNED:  # a last builder with few leaves still ends at its own level
        for _ in range(LEVELS - len(widths(len(digests))) + 1):
            last = _hash(np.array([last], "S64"))
            made += last.encode()
    told = {"tree": ([table.column("tree")[0].as_py()], pa.string()), "n": ([n], pa.int64()), "block": ([block], pa.int64())}
    told |= {"ids": ([table.column("doc_id").to_pylist()], pa.list_(pa.int64())), "told": ([table.column("told").to_pylist()], pa.list_(pa.string())), "nodes": ([made], pa.binary()), "digest": ([last], pa.string())}
    return pa.Table.from_batches([batch(told)])


def build(rows: DataFrame) -> list[DataFrame]:
    """The written segments of each round over ``numbered`` rows(tree, at, n, digest, doc_id, told)."""
    most = rows.agg(F.max("n")).first()[0] or 0
    out = []
    while not out or most > 1:
        dealt = rows.withColumn("block", F.expr(f"at div {ALIGNED}"))
        out.append(cut(dealt.groupBy("tree", "block").applyInArrow(_builder, _SEGMENT)))
        above = out[-1].where(F.col("n") > ALIGNED)
        rows = above.select("tree", F.col("block").alias("at"), F.expr(f"(n + {ALIGNED - 1}) div {ALIGNED}").alias("n"), "digest", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("told"))
        most = -(-most // ALIGNED)
    return out


def roots(segments: list[DataFrame]) -> DataFrame:
    """(tree, digest): the last node of each tree."""
    out = None
    for part in segments:
        ended = part.where(F.col("n") <= ALIGNED).select("tree", "digest")
        out = ended if out is None else out.union(ended)
    return out


# --- the log and its proofs --------------------------------------------------------------------------


def log(segments: list[DataFrame]) -> DataFrame:
    """(tree, position, level, at, digest): the append log as rows. The first round's nodes and those of later rounds meet
    at positions that follow from the number of leaves alone."""
    out = None
    leaves_of = segments[0].groupBy("tree").agg(F.max("n").alias("leaves"))
    for step, part in enumerate(segments):

        def run(batches: Iterator[pa.RecordBatch], base: int = step * LEVELS) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for tree, n, leaves, block, nodes in zip(*(b.column(c).to_pylist() for c in ("tree", "n", "leaves", "block", "nodes")), strict=True):
                    held, own = np.frombuffer(nodes, "S64"), min(ALIGNED, n - block * ALIGNED)
                    shape = [*widths(own), *[1] * (len(held) - sum(widths(own)))]
                    level = np.repeat(np.arange(len(shape)), shape)
                    i = np.concatenate([np.arange(w) for w in shape])
                    inner = np.concatenate([postorder(own, k, np.arange(w)) for k, w in enumerate(widths(own))] + [np.arange(sum(widths(own)), len(held))])
                    at = i + block * (ALIGNED // ARITY**level)
                    position = np.concatenate([postorder(leaves, base + k, at[level == k]) for k in range(len(shape))])
                    new = (level > 0) | (base == 0)  # a later round's leaves are in the log already
                    yield batch({"tree": ([tree] * int(new.sum()), pa.string()), "position": (position[new], pa.int64()), "level": (level[new] + base, pa.int64()), "at": (at[new], pa.int64()), "digest": ([x.decode() for x in held[inner][new]], pa.string())})

        rows = part.join(leaves_of, "tree").select("tree", "n", "leaves", "block", "nodes").mapInArrow(run, "tree string, position long, level long, at long, digest string")
        out = rows if out is None else out.union(rows)
    return out


def proof_at(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(tree, at, siblings array<string>) of wanted(tree, at, n): the siblings of some leaves, from a log by positions alone."""

    @F.udf("array<struct<i int, position long>>")
    def places(at: int, n: int) -> list[tuple[int, int]]:
        out = []
        for level, width in enumerate(widths(n)[:-1]):
            mine = at // ARITY**level
            run = range(mine // ARITY * ARITY, min((mine // ARITY + 1) * ARITY, width))
            out += [int(postorder(n, level, j)) for j in run if j != mine]
        return list(enumerate(out))

    asked = wanted.select("tree", "at", F.explode_outer(places("at", "n")).alias("p")).select("tree", "at", F.col("p.i").alias("i"), F.col("p.position").alias("position"))
    found = asked.join(nodes.select("tree", "position", "digest"), ["tree", "position"], "left")
    return found.groupBy("tree", "at").agg(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "digest")))).alias("s")).select("tree", "at", F.transform("s", lambda x: x["digest"]).alias("siblings"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for tree, n, block, ids, told, nodes, above in zip(*(b.column(c).to_pylist() for c in ("tree", "n", "block", "ids", "told", "nodes", "above")), strict=True):
            own = len(ids)
            held, shape = np.frombuffer(nodes, "S64"), widths(own)
            # levels whose runs this segment holds; the last one alone has no siblings, but a long tree's builder goes on to its end
            alone = [{"left": "", "right": ""}] * (LEVELS - len(shape) + 1 if n > ALIGNED else 0)
            path, at = [], np.arange(own)
            for k in range(len(shape) - 1):
                level = held[postorder(own, k, np.arange(shape[k]))].tobytes().decode()
                i = at // ARITY**k
                path.append([(level[64 * (j - j % ARITY) : 64 * j], level[64 * (j + 1) : 64 * (j - j % ARITY + ARITY)]) for j in i.tolist()])
            digests = held[postorder(own, 0, at)] if own else []
            rest = [*alone, *(above or [])]
            out = [[*({"left": x, "right": y} for x, y in own_path), *rest] for own_path in (zip(*path, strict=True) if path else [()] * own)]
            yield batch({
                "tree": ([tree] * own, pa.string()), "at": (at + block * ALIGNED, pa.int64()), "doc_id": (ids, pa.int64()), "leaf": ([x.decode() for x in digests], pa.string()),
                "told": (told, pa.string()), "path": (out, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))),
            })


def proofs(segments: list[DataFrame], top: DataFrame | None = None) -> DataFrame:
    """(tree, at, doc_id, leaf, told, path) of every leaf: for each level the digests left and right of it in its run.

    ``top(tree, path)`` is what stands above each tree's last node. Joins are on single segments, never on many rows.
    """
    above = None
    for part in reversed(segments):
        ends = part.where(F.col("n") <= ALIGNED).select("tree", "block")
        ends = ends.join(top.select("tree", F.col("path").alias("above")), "tree", "left") if top is not None else ends.withColumn("above", F.array().cast(_PATH))
        above = ends if above is None else ends.unionByName(above)
        rows = part.join(above, ["tree", "block"]).mapInArrow(_paths, f"tree string, at long, doc_id long, leaf string, told string, path {_PATH}")
        above = rows.select("tree", F.col("at").alias("block"), F.col("path").alias("above"))
    return rows


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, digest, lambda x, p: F.sha2(F.concat(p["left"], x, p["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, told, path) of ``docs(doc_id, source, lang, n_chars, text)``: a tree for each lang, and
    one over their roots. ``tampered`` marks rows for which ``told`` is the leaf of an altered text."""
    forest = build(numbered(leaves(docs, tampered), ["doc_id"]))
    # the trees' names order their roots; what stands above a tree is the path of its root in the top tree
    subroots = numbered(roots(forest).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("told")), ["name"])
    top = build(subroots)
    root = roots(top).first()
    named = cut(proofs(top).select("at", "path").join(subroots.select("at", F.col("name").alias("tree"), F.col("digest").alias("subroot")), "at").drop("at"))
    rows = proofs(forest, named).join(named.select("tree", "subroot"), "tree")
    return rows.select("doc_id", "leaf", "subroot", F.lit(root.digest if root else None).cast("string").alias("root"), "told", "path")


def verified(rows: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of ``manifest`` rows: each leaf, or its tampered
    form, folded along the stored path."""
    again = folded(F.coalesce("told", "leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
