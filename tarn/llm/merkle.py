"""Merkle manifest of a dataset by a rollup of nested structs.

Leaves are hashed where they are read; only ids and 32-byte digests travel. Within a group (a language) a leaf's
rank is split into digits of the fan-out. Blocks of ``fanout ** DEPTH`` leaves are dealt to tasks, and inside a block the
digit columns are grouped away one after the other, lowest first, each grouping nesting the children in their parent's struct;
all of them use the one partitioning by block. Blocks become the leaves of the next tree, and so on up to the root of
the group; the groups' roots make a tree of their own. On the way down a block meets the proof of its own
node in one grouping, and is exploded level by level, each step adding the siblings: no level is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.ranks import ranked
from tarn.llm.store import save, scope

#: Levels of a block: a row holds at most ``fanout ** DEPTH`` leaves, with a fan-out of eight 4096.
DEPTH = 4
PROOF = "array<struct<before: array<string>, after: array<string>>>"


def hashed(text: Column) -> Column:
    """SHA-256 of a text as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row: no two different rows of values are written alike."""
    return hashed(F.concat(*map(field, values)))


def _up(nodes: DataFrame, fanout: int) -> DataFrame:
    """``g, rank, n, node<hash, own>`` to blocks: ``g, block, n, node<hash, kids>``, nested ``DEPTH`` deep."""
    digits = [F.floor(F.col("rank") / fanout**k) % fanout for k in range(DEPTH)]
    names = [f"d{k}" for k in range(DEPTH)]
    block = F.floor(F.col("rank") / fanout**DEPTH).alias("block")
    at = nodes.select("g", block, "n", *[d.cast("int").alias(c) for d, c in zip(digits, names)], "node").repartition("g", "block")
    for level, digit in enumerate(names):
        run = F.sort_array(F.collect_list(F.struct(digit, "node")))  # at most ``fanout`` entries with different digits
        at = at.groupBy("g", "block", "n", *names[level + 1 :]).agg(run.alias("run"))
        kids = F.transform("run", lambda x: x["node"])
        joint = hashed(F.array_join(F.transform("run", lambda x: hex_of(x["node"]["hash"])), ""))
        # the rule holds while several nodes of the group remain
        mine = F.when(F.col("n") > fanout**level, joint).otherwise(F.col("run")[0]["node"]["hash"])
        at = at.select("g", "block", "n", *names[level + 1 :], F.struct(mine.alias("hash"), kids.alias("kids")).alias("node"))
    return at


def _down(blocks: DataFrame, fanout: int) -> DataFrame:
    """Blocks with their own ``proof`` and ``top``, exploded to ``g, node, proof, top, rank`` of every leaf."""
    at = blocks.withColumn("rank", F.col("block"))
    for level in reversed(range(DEPTH)):
        at = at.select("g", "n", "proof", "top", "rank", F.transform("node.kids", lambda x: x["hash"]).alias("hashes"), F.col("node.kids").alias("kids"))
        at = at.select("g", "n", "proof", "top", "rank", "hashes", F.posexplode("kids").alias("i", "node"))
        step = F.struct(
            F.transform(F.slice("hashes", F.lit(1), F.col("i")), hex_of).alias("before"),
            F.transform(F.slice("hashes", F.col("i") + 2, F.lit(fanout)), hex_of).alias("after"),
        )
        proof = F.when(F.col("n") > fanout**level, F.concat(F.array(step), F.col("proof"))).otherwise(F.col("proof"))
        at = at.select("g", "n", proof.alias("proof"), "top", (F.col("rank") * fanout + F.col("i")).alias("rank"), "node")
    return at


def _tree(nodes: DataFrame, fanout: int) -> tuple[DataFrame, DataFrame]:
    """(saved blocks, ``g, block, proof, top`` of each block's node) of ranked nodes."""
    blocks = save(_up(nodes, fanout), "blocks", keep=True)
    size = fanout**DEPTH
    tops = blocks.select("g", F.col("block").alias("rank"), F.ceil(F.col("n") / size).alias("n"), F.struct(F.col("node.hash").alias("hash")).alias("node"))
    if (tops.agg(F.max("n")).first()[0] or 0) > 1:
        proofs = _leaves(*_tree(tops, fanout), fanout).select("g", F.col("rank").alias("block"), "proof", "top")
    else:
        proofs = tops.select("g", F.col("rank").alias("block"), F.array().cast(PROOF).alias("proof"), F.col("node.hash").alias("top"))
    return blocks, save(proofs, "proofs", keep=True)


def _leaves(blocks: DataFrame, proofs: DataFrame, fanout: int) -> DataFrame:
    """Each leaf of the blocks with its whole proof. A block and its node's proof meet in one grouping."""
    there = blocks.unionByName(proofs, allowMissingColumns=True).groupBy("g", "block").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("n", "node", "proof", "top")]
    )
    return _down(there, fanout)


def manifest(
    docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), by: str = "lang", id_col: str = "doc_id",
    claim: Column | None = None, fanout: int = 8,
) -> DataFrame:
    """``doc_id, group, rank, leaf, claim, subroot, root, proof`` of every row.

    A leaf is the digest of a row's ``columns``. In each group of ``by`` leaves ascend by id (nulls first, ties by
    digest), and runs of ``fanout`` nodes become one until one is left, the ``subroot``; the subroots in order of
    their groups (null first, bytewise) likewise give ``root``. ``proof`` lists, from the leaf upwards, the nodes before and
    after in each run. Digests are 32 bytes, those in proofs lower-case hexadecimal. ``claim`` is a digest of each row to be carried along,
    such as that of a copy to be verified with ``fold``.

    Null values, ids and groups are values of their own. Equal rows are leaves each. Empty tables give no rows. Columns of any
    other name are never read; texts are read once.
    """
    with scope():
        rows = docs.select(
            F.col(by).alias("g"), F.col(id_col).alias("doc_id"), leaf(*map(F.col, columns)).alias("hash"),
            (F.lit(None).cast("binary") if claim is None else claim).alias("claim"),
        )
        # ranges are sampled first: digests are made once, and only they are read again
        placed = ranked(save(rows, "leaves"), ["g"], ["doc_id", "hash"])
        node = F.struct("hash", F.struct("doc_id", "claim").alias("own")).alias("node")
        blocks, proofs = _tree(placed.select("g", "rank", "n", node), fanout)
        roots = proofs.where("block = 0").select("g", F.col("top").alias("hash"))
        node = F.struct("hash", F.struct(F.col("g").alias("of")).alias("own")).alias("node")
        tops, above = _tree(ranked(roots, [], ["g"]).select(F.lit(0).alias("g"), "rank", "n", node), fanout)
        upper = _leaves(tops, above, fanout).select(F.col("node.own.of").alias("of"), F.col("proof").alias("upper"), F.col("top").alias("root"))
        own = F.struct(F.col("top").alias("subroot"), "root").alias("top")
        proofs = proofs.join(upper, F.col("g").eqNullSafe(F.col("of"))).select("g", "block", F.concat("proof", "upper").alias("proof"), own)
        proofs = save(proofs, "whole-proofs", keep=True)
    out = _leaves(blocks, proofs, fanout)
    return out.select(
        F.col("node.own.doc_id").alias("doc_id"), F.col("g").alias("group"), "rank", F.col("node.hash").alias("leaf"),
        F.col("node.own.claim").alias("claim"), F.col("top.subroot").alias("subroot"), F.col("top.root").alias("root"), "proof",
    )


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and a proof lead to."""
    return F.aggregate(
        proof, leaf,
        lambda at, step: hashed(F.concat(F.array_join(step["before"], ""), hex_of(at), F.array_join(step["after"], ""))),
    )


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, from the leaf upwards, left to right."""
    return hashed(F.array_join(F.flatten(F.transform(proof, lambda s: F.concat(s["before"], s["after"]))), ""))
