"""Manifests against a tree built by loops, and ranks against sorting."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tarn.llm import merkle, ranks

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rank int, n int, g string, block int, node string, hash string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves, fanout):
    """(root, siblings of each leaf as (before, after) by level)."""
    steps, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // fanout * fanout : i // fanout * fanout + fanout]
            steps[k].append((run[: i % fanout], run[i % fanout + 1 :]))
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], steps


def want(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf(r)))
    key = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    order = sorted(groups, key=key)
    built = {}
    for g in order:
        groups[g].sort(key=lambda x: (key(x[0]), x[1]))
        built[g] = tree([x[1] for x in groups[g]], fanout)
    root, upper = tree([built[g][0] for g in order], fanout)
    return sorted(
        ((g, k, i, h, built[g][0], root, built[g][1][k] + upper[j]) for j, g in enumerate(order) for k, (i, h) in enumerate(groups[g])), key=repr
    )


def got(spark, rows, fanout):
    docs = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], 0, 0, "g", 0, "n", "h") for r in rows], SCHEMA)
    out = merkle.manifest(docs, COLUMNS, fanout=fanout)
    hexed = out.select("group", "rank", "doc_id", *[merkle.hex_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], "proof", (merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok"))
    found = hexed.collect()
    assert all(r["ok"] for r in found)
    return sorted(((r["group"], r["rank"], r["doc_id"], r["leaf"], r["subroot"], r["root"], [(list(s["before"]), list(s["after"])) for s in r["proof"]]) for r in found), key=repr)


@pytest.mark.parametrize(("fanout", "n", "langs"), [(8, 9, 3), (2, 150, 2), (2, 40, 21), (3, 300, 1)])
def test_trees_equal_loops(spark, fanout, n, langs):
    """Blocks of 16 and 81 leaves, so that groups have several levels of blocks; null groups, ids and texts, repeated rows."""
    rng = random.Random(n)
    names = [None, "", "é", "zz", *[f"l{k}" for k in range(langs)]][:langs]
    rows = [(k if rng.random() < 0.95 else None, rng.choice(["a", None]), rng.choice(names), rng.choice([None, k]), rng.choice([None, "", "Text", "é 😀", f"t{k}"])) for k in range(n)]
    rows += rows[:3]
    assert got(spark, rows, fanout) == want(rows, fanout)


def test_one_leaf_and_none(spark):
    row = (5, "s", "en", 1, "x")
    assert got(spark, [row], 8) == want([row], 8)
    assert got(spark, [row], 8)[0][3] == got(spark, [row], 8)[0][5] == leaf(row)
    assert got(spark, [], 8) == []


def test_fields_of_equal_joins_differ(spark):
    a, b = spark.range(1).select(merkle.leaf(F.lit("ab"), F.lit("c")), merkle.leaf(F.lit("a"), F.lit("bc"))).first()
    assert a != b


def test_tampered_claims_fail(spark):
    docs = spark.createDataFrame([(k, "s", "en", 1, "T") for k in range(20)], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    claim = F.when(F.col("doc_id") % 4 == 0, merkle.leaf(*[F.col(c) for c in COLUMNS[:-1]], F.lower("text")))
    out = merkle.manifest(docs, COLUMNS, claim=claim).select("doc_id", (merkle.fold(F.coalesce("claim", "leaf"), F.col("proof")) == F.col("root")).alias("ok"))
    assert {r["doc_id"] for r in out.collect() if not r["ok"]} == {0, 4, 8, 12, 16}


def test_ranks_of_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"), (F.col("id") % 7).alias("v"))
    out = ranks.ranked(df, ["k"], ["v"]).where("k = 'hot'").orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(len(out))) and {r["n"] for r in out} == {len(out)}
    assert [r["v"] for r in out] == sorted(r["v"] for r in out)
    assert ranks.ranked(df.where("false"), ["k"], ["v"]).count() == 0
    assert sorted(r["rank"] for r in ranks.ranked(df.limit(10), [], ["v"]).collect()) == list(range(10))
