"""The registered queries of this subpackage, and their DuckDB equivalents where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe, chat, exact_dedup, langid, merkle, mixing, ngram_join, packing, periodic, shardmap, spotsigs, token_count, toxicity

#: Production parameters of the queries.
SHARDS = [f"shard-{i:02d}" for i in range(64)]
TOKEN_LIMIT = 4096
PACK = 2048
MIX = mixing.Mix(max_repeats=2.0)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, folded from a log of drafts, edits, deltas and regenerations, rendered and read back."""
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said,
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = chat.read_back(chat.format_conversations(chat.streamed_events(rows.unionByName(extra))))
    nl = F.lit("\n")
    turns = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], nl, m["text"], nl)), "")
    loss = F.array_join("loss_texts", "")
    return out.select(
        "conv_id", F.size("messages").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *,
    length(replace(replace(replace(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '</s>', '<\/s>'), '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'))
    + length(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '</s>', '<\/s>'), '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'))
    + length('<|im_start|><|im_sep|><|im_end|>') AS n
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id", (~toxicity.may_learn(F.col("doc_id"))).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst",
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as the mixed stream reads it."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_documents(docs, MIX).drop("text")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint against its edit's and the next document's."""
    out = spotsigs.compare_with_next(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next",
    )


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; imported late, as only the two token queries need it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text, encoded and decoded again."""
    coded = bpe.encode(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), decoded=True)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    return shardmap.place(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", SHARDS)


def op6_sql() -> str:
    table = ",".join(map(str, shardmap.lookup_table(SHARDS)))
    return f"""
WITH k AS (
  SELECT doc_id, source, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {shardmap.SLOTS} AS INTEGER) AS slot
  FROM documents
), owner AS (SELECT [{table}] AS o)
SELECT doc_id, source, slot, 'shard-' || lpad(CAST(o[slot + 1] AS VARCHAR), 2, '0') AS shard FROM k, owner
"""


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, in two batches by id through an index that starts empty."""
    out = exact_dedup.dedup(_table(spark, sf_dir, "documents"), exact_dedup.new_index(spark), "documents", batches=2)
    return out.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""

def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.fit(docs))
    return out.select("doc_id", (~langid.may_learn(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text."""
    out = token_count.count_tokens(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of similar shingle sets."""
    return ngram_join.link_groups(_table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), PACK)


def repeating(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of all documents; in a tenth of them the words from some place on become periodic."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1))
    cut = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    cut = cut.withColumn("p", F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("int") + 1)
    tail = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("a") - 1), lambda i: F.col("words")[F.col("a") + i % F.col("p")])
    edited = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), edited).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text, and what is left when each keeps one period."""
    out = periodic.find_runs(repeating(_table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return out.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"), F.floor(-1000 * F.col("best.l") / F.col("best.p")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document, folded again with a text that was tampered with in a third of them."""
    docs = _table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    claim = F.when(tampered, merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))
    out = merkle.manifest(docs, claim=claim).withColumn("folded", merkle.fold(F.coalesce("claim", "leaf"), F.col("proof")))
    return out.select(
        "doc_id", *[merkle.hex_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        merkle.hex_of(merkle.proof_digest(F.col("proof"))).alias("proof_sha256"), merkle.hex_of(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def op13_sql(levels: int = 10, group_levels: int = 6) -> str:
    """Trees of up to ``8 ** levels`` leaves a group and ``8 ** group_levels`` groups, a level a pair of common tables."""
    value = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(value, ("doc_id", "source", "lang", "n_chars")), value(text)]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        # CRC-32 (polynomial 0xEDB88320) of the digits of an id
        "bits AS (SELECT list_transform(range(256), lambda k: list_reduce(list_prepend(k, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)",
        "d AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 3 = 0 AS tampered FROM documents, bits)",
        f"l AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN tampered THEN {leaf(lower)} ELSE {leaf('text')} END AS claim FROM d)",
        "p0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, claim AS fold, '' AS proof FROM l)",
        "n0 AS (SELECT lang AS g, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM p0)",
    ]

    def climb(p: str, n: str, group: str, k: int) -> None:
        parts.append(f"r{n}{k} AS (SELECT g, i // 8 AS i, n, list(h ORDER BY i) AS run FROM {n}{k} GROUP BY g, i // 8, n)")
        parts.append(f"{n}{k + 1} AS (SELECT g, i, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h FROM r{n}{k})")
        left, right = f"array_to_string(run[1 : {p}{k}.i % 8], '')", f"array_to_string(run[{p}{k}.i % 8 + 2 :], '')"
        parts.append(
            f"{p}{k + 1} AS (SELECT {p}{k}.* EXCLUDE (i, h, fold, proof), {p}{k}.i // 8 AS i, '' AS h, proof || {left} || {right} AS proof, "
            f"CASE WHEN n > 1 THEN sha256({left} || fold || {right}) ELSE fold END AS fold "
            f"FROM {p}{k} JOIN r{n}{k} r ON {group} IS NOT DISTINCT FROM r.g AND {p}{k}.i // 8 = r.i)"
        )

    for k in range(levels):
        climb("p", "n", "lang", k)
    parts += [
        f"s AS (SELECT g AS lang, h AS subroot FROM n{levels})",
        "m0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, subroot AS h, count(*) OVER () AS n FROM s)",
        "a AS (SELECT lang, subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS at FROM s)",
        f"q0 AS (SELECT p.doc_id, p.leaf, a.subroot, 0 AS one, a.at AS i, '' AS h, p.fold, p.proof FROM p{levels} p JOIN a ON p.lang IS NOT DISTINCT FROM a.lang)",
    ]
    for k in range(group_levels):
        climb("q", "m", "one", k)
    return "WITH " + ",\n".join(parts) + (
        f"\nSELECT doc_id, leaf, subroot, m.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = m.h AS verified "
        f"FROM q{group_levels}, m{group_levels} m"
    )


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_fingerprints": op4_fingerprints,
    "op5_bpe": op5_bpe,
    "op6_sharding": op6_sharding,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_langid": op8_langid,
    "op9_token_counts": op9_token_counts,
    "op10_ngram_join": op10_ngram_join,
    "op11_packing": op11_packing,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
}


def oracles() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op6_sharding": op6_sql(), "op7_exact_dedup": OP7_SQL, "op13_merkle_manifest": op13_sql()}
