"""A Merkle manifest of a dataset, and versions of it that copy only the path of a changed leaf.

Digests are SHA-256 in lower-case hex; a node is the digest of its children's
digests as text. Every row is a leaf. The leaves of a language ascend by
``doc_id`` (nulls first, ties by digest) under a tree of arity 8, and the roots
of the languages (null first, then by their bytes) are the leaves of a last such
tree. A lone leaf is its own root; a run of one node has a parent of its own.

Blocks of 512 leaves, aligned to the tree, are rows of a table. A round turns
each block into one node of the next round, until a language has one node. Then
what stands beside each block's path to the root comes down round by round, so a
block can finish the upper part of any version of its leaves by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked
from .tables import written

ARITY = 8
LEVELS = 3
#: Leaves of an aligned block.
BLOCK = ARITY**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def joined_hash(parts: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


class Tree:
    """The levels of an aligned block, from its leaves to its top.

    ``whole``: the block is all that is left of its tree, so it ends with one
    node. Other blocks have all their levels, whatever they hold.
    """

    def __init__(self, leaves: list[bytes], whole: bool):
        self.levels = [leaves]
        while len(self.levels[-1]) > 1 if whole else len(self.levels) <= LEVELS:
            last = self.levels[-1]
            self.levels.append([joined_hash(last[i : i + ARITY]) for i in range(0, len(last), ARITY)])

    @property
    def top(self) -> bytes:
        return self.levels[-1][0]

    def beside(self, slot: int) -> list[tuple[bytes, bytes]]:
        """Siblings to the left and to the right of a leaf's path, level by level."""
        found = []
        for level in self.levels[:-1]:
            first = slot - slot % ARITY
            found.append((b"".join(level[first:slot]), b"".join(level[slot + 1 : first + ARITY])))
            slot //= ARITY
        return found

    def version(self, slot: int, leaf: bytes) -> dict[tuple[int, int], bytes]:
        """Nodes of the version in which ``leaf`` stands at ``slot``: only the path is new, by (level, place).

        All other nodes are those of the tree itself, see :meth:`node`.
        """
        copies = {(0, slot): leaf}
        for k in range(1, len(self.levels)):
            below, first = self.levels[k - 1], slot - slot % ARITY
            run = [*below[first:slot], copies[k - 1, slot], *below[slot + 1 : first + ARITY]]
            slot //= ARITY
            copies[k, slot] = joined_hash(run)
        return copies

    def node(self, version: dict[tuple[int, int], bytes], level: int, place: int) -> bytes:
        """A node of a version: its own copy, or the shared one."""
        return version.get((level, place)) or self.levels[level][place]


def climbed(node: bytes, path: list[tuple[bytes, bytes]]) -> list[bytes]:
    """Copies of the ancestors of ``node`` along the siblings of its path."""
    copies = []
    for left, right in path:
        node = joined_hash([left, node, right])
        copies.append(node)
    return copies


# Leaves


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """Digest of a row of ``documents`` with this text, as 32 bytes."""
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    return F.unhex(F.sha2(F.concat(*[_field(f) for f in fields]), 256))


def leaves_of(docs: DataFrame, tampered: Column) -> DataFrame:
    """``key`` (orders languages, null first), ``lang``, ``doc_id``, ``node`` and ``changed`` (null: untouched)."""
    lowered = leaf_digest(F.translate("text", UPPER, LOWER))
    return docs.select(
        F.when(F.col("lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), "lang")).alias("key"),
        "lang",
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest(F.col("text")).alias("node"),
        F.when(tampered, lowered).alias("changed"),
    )


def changed_third() -> Column:
    """True where 3 divides the CRC-32 of the decimal ``doc_id``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))


# Rounds


def _blocks(nodes: DataFrame, held: list[str], label: str) -> DataFrame:
    """``key``, ``block``, ``total`` and the at most 512 ``nodes`` of each aligned block, in order."""
    entry = F.struct("rank", "node", *held)
    grouped = nodes.groupBy("key", F.expr(f"rank div {BLOCK}").alias("block"))
    return written(grouped.agg(F.max("total").alias("total"), F.array_sort(F.collect_list(entry)).alias("nodes")), label)


def _hex(value: bytes) -> bytes:
    return value.hex().encode()


def _trees(batch: pa.RecordBatch) -> Iterator[tuple[dict, Tree]]:
    for row in batch.to_pylist():
        yield row, Tree([_hex(n["node"]) for n in row["nodes"]], row["total"] <= BLOCK)


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(row["key"], row["block"], -(-row["total"] // BLOCK), bytes.fromhex(tree.top.decode())) for row, tree in _trees(batch)]
        keys, ranks, totals, nodes = (list(c) for c in zip(*rows)) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array(ranks, pa.int64()), pa.array(totals, pa.int64()), pa.array(nodes, pa.binary())],
            ["key", "rank", "total", "node"],
        )


def grown(nodes: DataFrame, held: list[str], label: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round, from the leaves on, and the one node (``key``, ``node``) that is left of each key."""
    rounds = []
    while True:
        rounds.append(_blocks(nodes, held if not rounds else [], f"{label}-blocks"))
        nodes = written(rounds[-1].mapInArrow(_tops, "key string, rank long, total long, node binary"), f"{label}-tops")
        if (nodes.agg(F.max("total")).first()[0] or 1) == 1:
            return rounds, nodes.select("key", "node")


PATH_SCHEMA = "key string, rank long, `left` array<binary>, `right` array<binary>, subroot binary, root binary"
PATH_TYPE = pa.schema(
    [("key", pa.string()), ("rank", pa.int64()), ("left", pa.list_(pa.binary())), ("right", pa.list_(pa.binary())), ("subroot", pa.binary()), ("root", pa.binary())]
)


def _beside_each(own_key: bool):
    """What stands beside the path of each node of the blocks, up to the root.

    With ``own_key`` the nodes are the roots of languages, and ``left`` of a top
    block is null as nothing stands above it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, tree in _trees(batch):
                above = list(zip(row["left"] or [], row["right"] or []))
                root = row["root"] or tree.top
                for slot, n in enumerate(row["nodes"]):
                    path = tree.beside(slot) + above
                    rows.append(
                        {
                            "key": n["name"] if own_key and "name" in n else row["key"],
                            "rank": 0 if own_key and "name" in n else n["rank"],
                            "left": [p[0] for p in path],
                            "right": [p[1] for p in path],
                            "subroot": _hex(n["node"]) if own_key else row["subroot"],
                            "root": root,
                        }
                    )
            yield pa.RecordBatch.from_pylist(rows, PATH_TYPE)

    return run


def _with_above(blocks: DataFrame, above: DataFrame | None) -> DataFrame:
    if above is None:
        nothing = F.lit(None).cast("array<binary>")
        return blocks.withColumns({"left": nothing, "right": nothing, "subroot": F.lit(None).cast("binary"), "root": F.lit(None).cast("binary")})
    return blocks.join(above.withColumnRenamed("rank", "block"), ["key", "block"])


def _came_down(rounds: list[DataFrame], above: DataFrame | None, own_key: bool, label: str) -> DataFrame | None:
    """The path above each block of the first of ``rounds``."""
    for blocks in reversed(rounds):
        above = written(_with_above(blocks, above).mapInArrow(_beside_each(own_key), PATH_SCHEMA), f"{label}-paths")
    return above


RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("lang", pa.string()),
        ("leaf", pa.string()),
        ("subroot", pa.string()),
        ("root", pa.string()),
        ("proof_sha256", pa.string()),
        ("copied", pa.list_(pa.string())),
        ("folded_root", pa.string()),
        ("verified", pa.bool_()),
    ]
)


def _versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, tree in _trees(batch):
            above, rows = list(zip(row["left"], row["right"])), []
            shared_above = climbed(tree.top, above)
            for slot, n in enumerate(row["nodes"]):
                leaf, copied, top = tree.levels[0][slot], None, tree.top
                proof = hashlib.sha256()
                for left, right in tree.beside(slot) + above:
                    proof.update(left)
                    proof.update(right)
                if n["changed"] is not None:
                    copies = tree.version(slot, _hex(n["changed"]))
                    top = copies[len(tree.levels) - 1, 0]
                    copied = [*copies.values(), *climbed(top, above)]
                    folded = copied[-1]
                else:
                    folded = shared_above[-1] if shared_above else top
                rows.append(
                    {
                        "doc_id": n["doc_id"],
                        "lang": n["lang"],
                        "leaf": leaf.decode(),
                        "subroot": row["subroot"].decode(),
                        "root": row["root"].decode(),
                        "proof_sha256": proof.hexdigest(),
                        "copied": copied and [c.decode() for c in copied],
                        "folded_root": folded.decode(),
                        "verified": folded == row["root"],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, RESULT)


def versions(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Leaf, proof and root of every row, and the version that its tampered text makes.

    ``tampered`` marks the rows whose text is lower-cased (A-Z; null texts
    stay); None marks none. Each such leaf makes a version of the tree of its
    own: ``copied`` holds the new nodes from the leaf to the root (null: no
    version), every other node is shared. ``folded_root`` is the root of the
    version, or of the tree itself, and ``verified`` says whether it is ``root``.
    Null fields count as ``-``; equal rows are leaves beside each other; a row
    whose id or language is null comes first; no row gives no row. Further
    columns of ``docs`` are ignored.
    """
    leaves = ranked(leaves_of(docs, F.lit(False) if tampered is None else tampered), "key", ["doc_id", "node", "changed"], "merkle-leaves")
    rounds, roots = grown(leaves, ["lang", "doc_id", "changed"], "merkle")
    names = roots.select(F.lit("").alias("key"), F.col("key").alias("name"), "node")
    top_rounds, _ = grown(ranked(names, "key", ["name"], "merkle-roots"), ["name"], "merkle-top")
    above = _came_down(top_rounds, None, True, "merkle-top")
    above = _came_down(rounds[1:], above, False, "merkle")
    dealt = _with_above(rounds[0], above)
    fields = ", ".join(f"{f.name} {'array<string>' if f.name == 'copied' else {'int64': 'long', 'bool': 'boolean'}.get(str(f.type), 'string')}" for f in RESULT)
    return dealt.mapInArrow(_versions, fields)
