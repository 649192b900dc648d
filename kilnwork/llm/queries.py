"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.llm import bpe, chat, divergence, language, lines, manifest, media, mixing, packing, quality, simhash, topk, toxicity
from kilnwork.llm.sampling import held_out
from kilnwork.plans.stored import spread

#: Score from which a label is predicted.
CUT = 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def word_vocabulary() -> str:
    """Path of the public word-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_documents(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = quality.score_quality(docs, quality.fit_quality(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.media_features(media.encode_media(_table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("hash")).alias("feature"),
    )


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    read = chat.read_chats(chat.format_chats(turns.unionByName(extra)))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(every, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(bpe.encode_documents(_table(spark, sf_dir, "documents"), word_vocabulary()))


def token_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    proven = manifest.prove_documents(_table(spark, sf_dir, "documents"), F.when(changed, manifest.lowered_leaf()))
    return proven.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), word_vocabulary())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_mix, op2_language, op3_quality, op4_lines, op5_simhash, op6_media, op7_topk, op8_toxicity, op9_chat, op10_bpe, op11_manifest, op12_packing, op13_divergence, pipeline)}

def _manifest_sql(fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), depth: int = 9) -> str:
    """SQL of ``op11_manifest``: each level a table, a key with one node staying as it is; ``depth`` levels of 8 are enough for 8**9 leaves a key."""
    sizes = ["coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')".format(f) for f in fields]
    shown = [s.replace("(text AS", "(lower_text AS") for s in sizes]
    parts = [f"""
d AS (
  SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text,
    list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, lang, sha256({" || ".join(sizes)}) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256({" || ".join(shown)}) END AS shown FROM d
), a0 AS (
  SELECT *, leaf AS node, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
), n0 AS (SELECT lang, place, node FROM a0)"""]

    def level(k: int, name: str, key: str) -> str:
        return f"""
, {name}r{k} AS (
  SELECT {key}, place // 8 AS place, string_agg(node, '' ORDER BY place) AS run, max(total) AS total
  FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS total FROM {name}{k}) GROUP BY {key}, place // 8
), {name}{k + 1} AS (
  SELECT {key}, place, CASE WHEN total = 1 THEN run ELSE sha256(run) END AS node FROM {name}r{k}
)"""

    parts += [level(k, "n", "lang") for k in range(depth)]
    parts.append(f", m0 AS (SELECT 0 AS one, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, node FROM n{depth})")
    parts += [level(k, "m", "one") for k in range(depth)]

    def path(k: int, before: str, after: str, name: str, key: str, place: str) -> str:
        at = f"64 * (({place} // {8 ** k}) % 8)"
        other = "r.total > 1"
        left, right = f"CASE WHEN {other} THEN substr(r.run, 1, {at}) ELSE '' END", f"CASE WHEN {other} THEN substr(r.run, {at} + 65) ELSE '' END"
        return f"""
, {after} AS (
  SELECT b.* REPLACE (b.proof || {left} || {right} AS proof,
    CASE WHEN {other} THEN sha256({left} || b.folded || {right}) ELSE b.folded END AS folded)
  FROM {before} AS b JOIN {name}r{k} AS r ON b.{key} IS NOT DISTINCT FROM r.{key} AND {place} // {8 ** (k + 1)} = r.place
)"""

    parts.append("""
, p0 AS (
  SELECT a0.doc_id, a0.lang, a0.leaf, a0.place, coalesce(a0.shown, a0.leaf) AS folded, '' AS proof, m0.node AS subroot, m0.place AS tree, 0 AS one
  FROM a0 JOIN m0 ON a0.lang IS NOT DISTINCT FROM m0.lang
)""")
    parts += [path(k, f"p{k}", f"p{k + 1}", "n", "lang", "b.place") for k in range(depth)]
    parts.append(f", q0 AS (SELECT * FROM p{depth})")
    parts += [path(k, f"q{k}", f"q{k + 1}", "m", "one", "b.tree") for k in range(depth)]
    return f"""WITH {"".join(parts)}
SELECT doc_id, leaf, subroot, m{depth}.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = m{depth}.node AS verified
FROM q{depth}, m{depth}"""


ORACLE_SQL = {
    "op11_manifest": _manifest_sql(),
    "op1_mix": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s
), f AS (
  SELECT *,
    sum(source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS s_to,
    sum(w) OVER (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS w_to,
    sum(source_size) OVER () AS s_all, sum(w) OVER () AS w_all
  FROM w
), h AS (
  SELECT *, 3 * source_size * (w_all - w_to + w) < w * (s_all - 3 * (s_to - source_size)) AS held FROM f
), t AS (
  SELECT source, source_size,
    CASE WHEN held THEN CAST(3 * source_size AS DOUBLE)
      ELSE CAST((s_all - 3 * coalesce(sum(source_size) FILTER (WHERE held) OVER (), 0)) * w AS DOUBLE)
        / CAST(sum(w) FILTER (WHERE NOT held) OVER () AS DOUBLE) END AS target
  FROM h
), u AS (
  SELECT doc_id, source, size, count(*) AS n FROM d GROUP BY doc_id, source, size
), r AS (
  SELECT u.*, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST(CAST('0x' || substr(md5('mix:' || coalesce(u.source, '')), 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE) AS shift,
    sum(u.n) OVER (PARTITION BY u.source ORDER BY u.size, u.doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) AS place
  FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT r.*, CAST(floor(CAST(place AS DOUBLE) * rate + shift) - floor(CAST(place - n AS DOUBLE) * rate + shift) AS BIGINT) AS total FROM r
)
SELECT c.doc_id, c.size, c.source_size, c.target, CAST((total // n + CASE WHEN each_row.range < total % n THEN 1 ELSE 0 END) * c.size AS BIGINT) AS taken
FROM c, range(c.n) AS each_row
""",
    "op4_lines": r"""
WITH s AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM s
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), m AS (
  SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op7_topk": r"""
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS c FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), p AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.c, v.c) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op13_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS of_lang FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term
), v AS (
  SELECT lang, CAST(count(*) AS HUGEINT) AS terms, sum(of_lang) AS total FROM k GROUP BY lang
), g AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source
), s AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.total + 2 * v.terms) AS p,
    1 + 1000000000::HUGEINT * (k.of_lang + 2) // (v.total + 2 * v.terms) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), f AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
  FROM s AS x JOIN s AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), u AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g AS x JOIN g AS y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM s WHERE n > 0 AND p > q
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u
)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
""",
    "op9_chat": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *,
    length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?(s>|INST\]|sep>))', '\1\\\2', 'g')) AS body,
    length(regexp_replace(replace(role, '\', '\\'), '([<\[])(/?(s>|INST\]|sep>))', '\1\\\2', 'g')) AS head,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + CASE WHEN before IS NULL THEN 16 + head WHEN before = role THEN 5 ELSE 20 + head END) + 4 AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
}
