"""One registered query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from nightjar.llm import chat_format, fertility, fuzzy_lines, html_model, lm_scoring, merkle, mixing, ngram_join, one_bit_search, piece_lattice, secret_ledger, sharding, whitening
from nightjar.llm.common import shared_folder, table, word_count, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# ------------------------------------------------------------------------------------------------ 1 pieces
@query
def op1_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded: best ids, the four best segmentations, and whether decoding gives back the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piece_lattice.encode(docs, keep_text=False)
    return coded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "nbest", "decoded")


# ------------------------------------------------------------------------------------------------ 2 chat
@query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations rendered and read back; every row is one message event, ordered by turn."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    events = rows.unionByName(planted).withColumn("turn", place).withColumn("seq", F.col("turn")).withColumn("kind", F.lit("message"))
    back = chat_format.read_back(chat_format.render(chat_format.fold_events(events)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


CHECKS["op2_chat_format"] = """
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(replace(replace(replace(role, '\\', '\\b'), '<', '\\l'), '>', '\\g')) + length(replace(replace(text, '\\', '\\b'), '<', '\\l')) + 16 AS chars FROM told
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


# ------------------------------------------------------------------------------------------------ 3 near duplicates
@query
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


CHECKS["op3_ngram_join"] = r"""
WITH RECURSIVE texts AS MATERIALIZED (SELECT text, min(doc_id) AS text_id FROM documents WHERE text IS NOT NULL GROUP BY text),
worded AS MATERIALIZED (SELECT text_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
shingles AS MATERIALIZED (
  SELECT DISTINCT text_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT text_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM worded WHERE len(w) > 0)
),
sizes AS MATERIALIZED (SELECT text_id, count(*) AS n FROM shingles GROUP BY text_id),
common AS (SELECT a.text_id AS x, b.text_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.text_id <> b.text_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM common JOIN sizes p ON p.text_id = x JOIN sizes q ON q.text_id = y WHERE c >= 0.8 * (p.n + q.n - c)),
reach AS (SELECT text_id AS x, text_id AS y FROM texts UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
classes AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x),
degrees AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT d.doc_id, coalesce(t.text_id, d.doc_id) AS text_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(g.n, 0) AS n_links
FROM documents d LEFT JOIN texts t ON d.text = t.text LEFT JOIN classes c ON c.x = t.text_id LEFT JOIN degrees g ON g.x = t.text_id
"""


# ------------------------------------------------------------------------------------------------ 4 shards
@query
def op4_shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents uniformly shuffled into 40 shards whose counts are one apart at most."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    dealt = sharding.shuffle_to_shards(rows, ["doc_id", "text_crc32", "size"], 40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# ------------------------------------------------------------------------------------------------ 5 lines
@query
def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat an earlier one."""
    return fuzzy_lines.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), wide=True)


# ------------------------------------------------------------------------------------------------ 6 secrets
@query
def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; each row is a version of the path that its id names, and the ledger starts empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_ledger.scan_versions(docs, shared_folder(spark, "ledger"), "doc_id")
    spans = lambda rows: F.array_join(F.transform(rows, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    base = F.filter("findings", lambda f: f["nth"] < len(secret_ledger.BASE_RULES))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(spans(base), 256).alias("base_sha256"), spans(F.col("findings")).alias("spans"))


# ------------------------------------------------------------------------------------------------ 7 pages
@query
def op7_html_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_model.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


# ------------------------------------------------------------------------------------------------ 8 neighbours
@query
def op8_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest other vectors of every vector whose id is divisible by 20."""
    return one_bit_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


CHECKS["op8_one_bit_search"] = """
WITH good AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM good q JOIN good c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
"""


# ------------------------------------------------------------------------------------------------ 9 quality
@query
def op9_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, tokeniser measures and the verdict on every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return fertility.fertility_rules(docs, keep_text=False).drop("lang")


# ------------------------------------------------------------------------------------------------ 10 mixing
@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words, no source above twice its size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    mixed = mixing.mix(written(docs, "words"), "words")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


# ------------------------------------------------------------------------------------------------ 11 whitening
@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on the 16 leading axes of the covariance of the distinct ones."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


# ------------------------------------------------------------------------------------------------ 12 manifest
@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, digest of the proof and verification of every document; a fifth of them tampered with."""
    docs = table(spark, sf_dir, "documents").select(*merkle.LEAF_FIELDS)
    fifth = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    made = merkle.manifest(docs, fifth).leaves
    folded = merkle.fold(F.coalesce("tampered_leaf", "leaf"), F.col("path"))
    out = made.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def merkle_levels(name: str, rows: str, tree: str, levels: int) -> str:
    """CTEs ``<name>0`` to ``<name><levels>``: the nodes of every level of all trees of ``rows`` (tree, r, h, n)."""
    ctes = [f"{name}0 AS MATERIALIZED ({rows})"]
    for i in range(1, levels + 1):
        ctes.append(f"""{name}{i} AS MATERIALIZED (
  SELECT {tree}, r // 16 AS r, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY r)) ELSE max(h) END AS h, (max(n) + 15) // 16 AS n
  FROM {name}{i - 1} GROUP BY {tree}, r // 16)""")
    return ",\n".join(ctes)


def merkle_siblings(name: str, tree: str, levels: int) -> str:
    """CTEs with the digests left and right of every node in its run; empty in a level that is not grouped."""
    return ",\n".join(f"""{name}s{i} AS MATERIALIZED (
  SELECT {tree}, r, h, n, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS a,
    CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS b
  FROM {name}{i} WINDOW run AS (PARTITION BY {tree}, r // 16 ORDER BY r))""" for i in range(levels))


def merkle_check(levels: int = 6, top: int = 5) -> str:
    """SQL over trees of up to 16 ** levels leaves and 16 ** top sources."""
    framed = lambda c, v: f"coalesce(octet_length(encode(CAST({v} AS VARCHAR))) || ':' || CAST({v} AS VARCHAR), '-')"
    digest = lambda text: "sha256(" + " || ".join(framed(c, text if c == "text" else c) for c in merkle.LEAF_FIELDS) + ")"
    bits = "flatten([[CAST(unicode(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] for c in string_split(CAST(doc_id AS VARCHAR), '')])"
    crc = f"xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bits}), lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))))"
    low = f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')"
    joins = [f"JOIN ts{i} s{i} ON s{i}.k = l.k AND s{i}.r = l.r // {16 ** i}" for i in range(levels)]
    joins += [f"JOIN us{i} u{i} ON u{i}.r = o.r // {16 ** i}" for i in range(top)]
    steps = [f"s{i}" for i in range(levels)] + [f"u{i}" for i in range(top)]
    folds = []
    for i, step in enumerate(steps):
        folds.append(f"f{i + 1} AS MATERIALIZED (SELECT * EXCLUDE (v, l{i}, r{i}, n{i}), CASE WHEN n{i} > 1 THEN sha256(l{i} || v || r{i}) ELSE v END AS v FROM f{i})")
    sides = ", ".join(f"{s}.a AS l{i}, {s}.b AS r{i}, {s}.n AS n{i}" for i, s in enumerate(steps))
    return f"""
WITH leaves AS MATERIALIZED (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '+' || source END AS k, {digest('text')} AS h,
    CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {digest(low)} END AS forged FROM documents
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS r, count(*) OVER (PARTITION BY k) AS n FROM leaves
), {merkle_levels('t', 'SELECT k, r, h, n FROM placed', 'k', levels)},
subroots AS MATERIALIZED (SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS r, count(*) OVER () AS n FROM t{levels}),
{merkle_levels('u', "SELECT 0 AS z, r, h, n FROM subroots", 'z', top)},
{merkle_siblings('t', 'k', levels)}, {merkle_siblings('u', 'z', top)},
f0 AS MATERIALIZED (
  SELECT l.doc_id, l.h AS leaf, o.h AS subroot, (SELECT h FROM u{top}) AS root, coalesce(l.forged, l.h) AS v,
    sha256({' || '.join(f'{s}.a || {s}.b' for s in steps)}) AS proof_sha256, {sides}
  FROM placed l JOIN subroots o ON o.k = l.k {' '.join(joins)}
), {', '.join(folds)}
SELECT doc_id, leaf, subroot, root, proof_sha256, v AS folded_root, v = root AS verified FROM f{len(steps)}
"""


CHECKS["op12_merkle_manifest"] = merkle_check()


# ------------------------------------------------------------------------------------------------ 13 language model
@query
def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of six sevenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    taught = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 != 2
    return lm_scoring.score_texts(docs, taught)
