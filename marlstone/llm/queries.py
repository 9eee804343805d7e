"""The thin queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import alignment, chat, embedding_dedup, html_extract, line_dedup, lm_scoring, mixing, ngram_join, packing, quality, structure, substring_dedup, toxicity
from marlstone.sources import pieces

#: The vocabulary that packing counts tokens in; a parameter of the operator.
VOCABULARY = "word_bpe_49k.json"
#: The vocabularies that are aligned: byte-level, and pieces.
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")
Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, which are work for every core."""
    return pieces.spread(read(spark, sf_dir, name))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(texts(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.similar_groups(texts(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(texts(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_lines(texts(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "text", "n_lines", "n_removed")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    out = chat.format_turns(turns.unionByName(more))
    out = out.withColumns({"turns": chat.parse(F.col("formatted")), "under": chat.loss_text(F.col("formatted"), F.col("loss"))})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2(F.col("under"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").withColumn("low_quality", 1 - F.col("quality"))
    return toxicity.score(texts(spark, sf_dir, "documents"), labels)


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(texts(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.measure(texts(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_chars")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = structure.summary(structure.repair(structure.damage(turns)))
    every = turns.select("conv_id").distinct().withColumnRenamed("conv_id", "id")
    rows = every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    absent = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return rows.select(F.col("id").alias("conv_id"), *(F.coalesce(c, absent.get(c, F.lit(0).cast("long"))).alias(c) for c in found.columns[1:]))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(texts(spark, sf_dir, "documents"), *map(public_tokenizers.path, ALIGNED))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(texts(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict[str, Query]:
    found = [op1_lm_scoring, op2_ngram_join, op3_retrieval_packing, op4_line_dedup, op5_embedding_dedup, op6_chat_format, op7_toxicity_chain, op8_html_extract, op9_quality_rules, op10_mix_sources, op11_structure_repair, op12_token_alignment, op13_substring_dedup]
    return {f.__name__: f for f in found}



def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


LINE_FAILS = f"""(NOT regexp_matches(s, {quoted(quality.LETTER_RE)}) OR length(regexp_replace(s, {quoted(quality.NOT_SYMBOLS)}, '', 'g')) * 10 > length(s)
  OR (len(regexp_extract_all(s, {quoted(quality.WORD)})) < 3 AND NOT regexp_matches(s, {quoted(quality.TERMINAL_RE)})) OR regexp_matches(s, {quoted(quality.SEPARATORS_RE)})
  OR (len(regexp_extract_all(s, {quoted(quality.WORD)})) <= {quality.NAVIGATION_WORDS} AND regexp_matches(s, {quoted(quality.NAVIGATION_RE)}) AND NOT regexp_matches(s, {quoted(quality.TERMINAL_RE)}))
  OR {" OR ".join(f"contains(lower(s), {quoted(w)})" for w in quality.BOILERPLATE)})"""
EDGES = rf"'^{quality.SPACE}+|{quality.SPACE}+$'"
QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{quality.SPACE}+'), lambda x: x <> '') AS ws FROM d),
 tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
 twice AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
 rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
 ls AS (SELECT doc_id, pos, line, regexp_replace(line, {EDGES}, '', 'g') AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d)),
 lj AS (SELECT doc_id, count(*) FILTER (s <> '') - count(DISTINCT line) FILTER (s <> '') AS dups,
   sum(CASE WHEN s <> '' AND {LINE_FAILS} THEN 0 ELSE length(regexp_replace(line, '{quality.SPACE}+', '', 'g')) END)::BIGINT AS clean FROM ls GROUP BY doc_id),
 m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '{quality.SPACE}+', '', 'g')) AS word_chars, length(regexp_replace(text, {quoted(quality.NOT_SYMBOLS)}, '', 'g')) AS n_symbols,
   lj.dups AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, lj.clean AS clean_chars FROM w JOIN lj USING (doc_id) LEFT JOIN rep USING (doc_id)),
 b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ((word_chars - clean_chars) * 100 > 50 * word_chars) AS kept, clean_chars FROM b"""

LINES = rf"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
 t AS (SELECT *, regexp_replace(line, {EDGES}, '', 'g') AS s FROM l),
 wide AS (SELECT s, min((doc_id, pos)) AS first FROM t WHERE s <> '' GROUP BY s HAVING count(DISTINCT coalesce(source, '')) >= 5),
 j AS (SELECT t.*, wide.s IS NOT NULL AND (doc_id, pos) <> wide.first AS gone FROM t LEFT JOIN wide USING (s)),
 g AS (SELECT doc_id, count(*) FILTER (s <> '') AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM j GROUP BY doc_id)
SELECT doc_id, source, g.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM documents LEFT JOIN g USING (doc_id)"""

ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '|', '&#124;')"
CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, * FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]')) t),
 g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS under,
  sum(length({ESCAPED.format('role')}) + length({ESCAPED.format('text')}) + 11)::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(under) AS loss_chars, sha256(under) AS loss_sha256, formatted_chars FROM g"""

REACH = """
 reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT reach.a, links.v FROM reach JOIN links ON reach.b = links.u),
 comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""
NGRAMS = rf"""
WITH RECURSIVE w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{quality.SPACE}+'), lambda x: x <> '') AS ws FROM documents),
 sh AS (SELECT DISTINCT id, g FROM (SELECT id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5) UNION ALL SELECT id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4)),
 n AS (SELECT id, count(*) AS n FROM sh GROUP BY id), nodes AS (SELECT id FROM w),
 both_ AS (SELECT a.id AS u, b.id AS v, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
 links AS (SELECT u, v FROM both_ JOIN n x ON x.id = u JOIN n y ON y.id = v WHERE 100 * k >= 75 * (x.n + y.n - k)), {REACH}
SELECT w.id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (id) JOIN comp USING (id)"""
VECTORS = f"""
WITH RECURSIVE e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings), nodes AS (SELECT id FROM e),
 links AS (SELECT a.id AS u, b.id AS v FROM e a JOIN e b ON a.label = b.label AND a.id <> b.id WHERE list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.93), {REACH},
 n AS (SELECT u AS id, count(*) AS n FROM links GROUP BY u)
SELECT nodes.id AS vec_id, coalesce(n.n, 0) AS n_links, component_id, nodes.id = component_id AS kept FROM nodes JOIN comp USING (id) LEFT JOIN n USING (id)"""

MIX = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {quoted(quality.WORD)}))::BIGINT AS size FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
 r(source, w, cap, done, share, step) AS (SELECT source, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3, 3 * total, false, 0.0::DOUBLE, 0 FROM s
  UNION ALL SELECT source, w, cap, done OR share > cap, share, step FROM (SELECT source, w, cap, done, step + 1 AS step,
   (sum(cap) OVER () / 3 - coalesce(sum(cap) FILTER (done) OVER (), 0))::DOUBLE * w / sum(w) FILTER (NOT done) OVER () AS share FROM r WHERE step <= (SELECT count(*) FROM s))),
 t AS (SELECT source, cap // 3 AS total, CASE WHEN done THEN cap::DOUBLE ELSE share END AS target FROM r QUALIFY step = max(step) OVER ()),
 p AS (SELECT *, least(floor(target + 0.5)::BIGINT, 3 * total) AS wanted FROM t),
 q AS (SELECT d.*, p.total, p.target, p.wanted, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('17:' || doc_id::VARCHAR), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, total AS source_size, target, CASE WHEN total = 0 THEN 0 ELSE (wanted // total) * size + least(size, greatest(0, wanted % total - before)) END::BIGINT AS taken FROM q"""


STRUCTURE = r"""
WITH RECURSIVE bits(k, c, step) AS (SELECT k, k, 0 FROM range(256) t(k) UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
 tab AS (SELECT list(c ORDER BY k) AS t FROM bits WHERE step = 8),
 src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
 way AS (SELECT src.*, xor(list_reduce([4294967295] || list_transform(string_split(k, ''), lambda x: unicode(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS w FROM src, tab),
 dam AS (SELECT conv_id, turn, CASE WHEN w = 4 THEN 'user' ELSE role END AS role, CASE WHEN w = 1 THEN '' WHEN w = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE w WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM way),
 num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(role, 32), left(text, 64), md5(role || chr(10) || text)) AS i, left(role, 1) AS ini FROM dam),
 rows_ AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
   WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM num),
 tot AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
   count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id),
 cost AS (SELECT conv_id, i, role, text, ini, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM rows_),
 best(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, n, {'c': 0, 'a': '', 'r': []::VARCHAR[]}, {'c': 10, 'a': 'II', 'r': ['user:', 'assistant:']}, {'c': 5, 'a': 'I', 'r': ['assistant:']}, {'c': 0, 'a': '', 'r': []::VARCHAR[]} FROM tot
  UNION ALL
  SELECT conv_id, i, least(b0, {'c': d2.c + 5, 'a': 'I' || d2.a, 'r': ['user:'] || d2.r}), least(b1, {'c': d2.c + 5, 'a': 'I' || d2.a, 'r': ['user:'] || d2.r}), d2, d3 FROM (
   SELECT *, least(b2, {'c': b3.c + 5, 'a': 'I' || b3.a, 'r': ['assistant:'] || b3.r}) AS d2, least(b3, {'c': b2.c + 5, 'a': 'I' || b2.a, 'r': ['user:'] || b2.r}) AS d3 FROM (
    SELECT conv_id, i,
     least({'c': s0.c + 2, 'a': 'D' || s0.a, 'r': s0.r}, {'c': s1.c + more + CASE ini WHEN 's' THEN 0 ELSE 1000000000 END, 'a': 'K' || s1.a, 'r': [own] || s1.r}, u) AS b0,
     least({'c': s1.c + 2, 'a': 'D' || s1.a, 'r': s1.r}, u) AS b1,
     least({'c': s2.c + 2, 'a': 'D' || s2.a, 'r': s2.r}, {'c': s3.c + more + CASE ini WHEN 'a' THEN 0 ELSE 1 END, 'a': CASE ini WHEN 'a' THEN 'K' ELSE 'R' END || s3.a, 'r': [CASE ini WHEN 'a' THEN own ELSE 'assistant:' || text END] || s3.r}) AS b2,
     least({'c': s3.c + 2, 'a': 'D' || s3.a, 'r': s3.r}, u) AS b3 FROM (
      SELECT b.conv_id, b.i - 1 AS i, s0, s1, s2, s3, more, ini, text, role || ':' || text AS own,
       {'c': s2.c + more + CASE ini WHEN 'u' THEN 0 ELSE 1 END, 'a': CASE ini WHEN 'u' THEN 'K' ELSE 'R' END || s2.a, 'r': [CASE ini WHEN 'u' THEN role ELSE 'user' END || ':' || text] || s2.r} AS u
      FROM best b JOIN cost c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.i = b.i) x) y) z)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 coalesce(s0.c, 0)::BIGINT AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(array_to_string(s0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN tot ON tot.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id AND best.i = 0"""


PASSAGES = rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{quality.SPACE}+'), lambda x: x <> '') AS ws FROM documents),
 g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
 cut AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i FROM g QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id) t, (SELECT unnest(range(13)) AS k) s),
 gone AS (SELECT doc_id, list(i) AS gone FROM cut GROUP BY doc_id),
 kept AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(list_zip(ws, list_transform(range(1, len(ws) + 1), lambda i: NOT list_contains(gone, i))), lambda x: x[2]), lambda x: x[1]) END AS ws FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(ws, ' ')) AS kept_sha256 FROM kept"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that it can express; the others are tested against brute force."""
    return {"op2_ngram_join": NGRAMS, "op4_line_dedup": LINES, "op5_embedding_dedup": VECTORS, "op6_chat_format": CHAT, "op9_quality_rules": QUALITY, "op10_mix_sources": MIX, "op11_structure_repair": STRUCTURE, "op13_substring_dedup": PASSAGES}
