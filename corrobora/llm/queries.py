"""Registered queries of this package and their oracle SQL."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.llm import forced_bpe
from corrobora.llm.common import read_table
from corrobora.llm.exact_dedup import exact_dedup
from corrobora.llm.mixing import mix_sources
from corrobora.llm.phrases import collocations
from corrobora.llm.pieces import default_vocabulary, encode_texts
from corrobora.llm.quality import THRESHOLD as QUALITY_THRESHOLD
from corrobora.llm.quality import fit_quality, score_quality
from corrobora.llm.quotes import reply_order
from corrobora.llm.simhash import simhash_classes
from corrobora.llm.suffix_dedup import removal_report
from corrobora.llm.surrogates import replace_personal_data
from corrobora.llm.topk import top_k
from corrobora.llm.toxicity import THRESHOLD as TOXIC_THRESHOLD
from corrobora.llm.toxicity import fit_toxicity, in_fold, score_toxicity
from corrobora.llm.turns import damage, repair_report

Plan = Callable[[SparkSession, str], DataFrame]


def _scored(scores: DataFrame, folds: int, fold: int, threshold: float) -> DataFrame:
    return scores.select(
        "doc_id",
        in_fold(F.col("doc_id"), folds, fold).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, ~in_fold(F.col("__id"), 4, 2))
    return _scored(score_toxicity(docs, model), 4, 2, TOXIC_THRESHOLD)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(read_table(spark, sf_dir, "documents"), default_vocabulary())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels, ~in_fold(F.col("__id"), 5, 0))
    return _scored(score_quality(docs, model), 5, 0, QUALITY_THRESHOLD)


#: Replacements depend on the secret in this setting; without it each run draws its own, so that nobody can repeat them.
SURROGATE_KEY = "spark.corrobora.surrogate.key"


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal_data(read_table(spark, sf_dir, "documents"), spark.conf.get(SURROGATE_KEY, None) or secrets.token_hex(32))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(read_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(read_table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH words AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM words GROUP BY source),
levels AS (
  SELECT *, source_size * 2.0::DOUBLE AS most,
         (sum(source_size) OVER () * 1.5::DOUBLE
          - coalesce(sum(source_size * 2.0::DOUBLE) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS try
  FROM sources WINDOW o AS (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST)),
targets AS (
  SELECT source, source_size,
         least(most, coalesce(max(CASE WHEN try * w <= most THEN try END) OVER () * w, most)) AS target
  FROM levels),
plan AS (
  SELECT *, floor(least(2.0, target / greatest(source_size, 1)))::INT AS base FROM targets),
hashed AS (
  SELECT p.source, h, sum(size) AS words, any_value(target - base * source_size) AS budget
  FROM words JOIN plan p ON words.source IS NOT DISTINCT FROM p.source GROUP BY p.source, h),
running AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS run FROM hashed),
chosen AS (
  SELECT source, h,
         run <= budget OR (run - words <= budget AND run - budget < budget - (run - words)) AS extra
  FROM running)
SELECT doc_id, size, source_size, target,
       (least(base + CASE WHEN extra THEN 1 ELSE 0 END, 2) * size)::BIGINT AS taken
FROM words JOIN plan p ON words.source IS NOT DISTINCT FROM p.source
JOIN chosen c ON c.source IS NOT DISTINCT FROM words.source AND c.h = words.h
"""


def op9_reply_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(read_table(spark, sf_dir, "conversations"))


OP9_SQL = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS id, conv_id, turn, role, text, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS parts
  FROM conversations),
l AS (SELECT id, conv_id, turn, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM m),
b AS (
  SELECT id, conv_id, turn, i, len(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
         regexp_replace(line, '^(?:[ \t]*>)+ ?', '') AS body FROM l),
n AS (
  SELECT *, coalesce(lead(level) OVER w, 0) AS after, level IS DISTINCT FROM lag(level) OVER w AS fresh
  FROM b WINDOW w AS (PARTITION BY id ORDER BY i)),
own AS (
  SELECT id, conv_id, turn, trim(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0 AND NOT (after > 0
         AND regexp_matches(body, '(?i)^[^\n]{0,200}\b(?:wrote|schrieb|a écrit|escribió)[^\n]{0,100}:\s*$'))), '')) AS own
  FROM n GROUP BY ALL),
r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY id ORDER BY i) AS run FROM n),
p AS (
  SELECT id, conv_id, turn, run, level, string_agg(body, chr(10) ORDER BY i) AS quoted
  FROM r WHERE level > 0 GROUP BY ALL),
a AS (
  SELECT DISTINCT conv_id, turn, level, quoted, trim(regexp_replace(lower(unnest(list_concat(string_split(quoted, chr(10)), regexp_split_to_array(quoted, '\n[ \t]*\n'), [quoted]))), '[^\p{L}\p{N}]+', ' ', 'g')) AS line
  FROM p WHERE turn IS NOT NULL),
o AS (
  SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(unnest(list_concat(string_split(own, chr(10)), regexp_split_to_array(own, '\n[ \t]*\n'), [own]))), '[^\p{L}\p{N}]+', ' ', 'g')) AS line
  FROM own WHERE turn IS NOT NULL),
k AS (
  SELECT a.conv_id, a.turn, a.level, a.quoted, a.line, max(o.turn) AS source
  FROM a JOIN o ON a.conv_id IS NOT DISTINCT FROM o.conv_id AND a.line = o.line AND o.turn < a.turn
  WHERE a.line <> '' GROUP BY ALL),
v AS (SELECT conv_id, turn, level, source, sum(len(line)) AS letters FROM k GROUP BY ALL),
best AS (SELECT conv_id, turn, arg_max(source, (-level, letters, source)) AS reply_to FROM v GROUP BY ALL),
known AS (SELECT conv_id, turn, count(DISTINCT (level, quoted)) AS n_linked FROM k GROUP BY ALL),
up AS (
  SELECT conv_id, turn, reply_to AS thread, 1 AS depth FROM best
  UNION ALL
  SELECT up.conv_id, up.turn, b.reply_to, up.depth + 1
  FROM up JOIN best b ON b.conv_id IS NOT DISTINCT FROM up.conv_id AND b.turn = up.thread),
threads AS (SELECT conv_id, turn, arg_max(thread, depth) AS thread, max(depth) AS depth FROM up GROUP BY ALL)
SELECT m.conv_id, row_number() OVER (PARTITION BY m.conv_id ORDER BY coalesce(threads.thread, m.turn) NULLS LAST, m.turn NULLS LAST, m.role NULLS FIRST, m.text NULLS FIRST) AS position,
       m.turn, m.role, own.own AS text, best.reply_to, coalesce(threads.thread, m.turn) AS thread, coalesce(threads.depth, 0)::BIGINT AS depth,
       coalesce((SELECT count(*) FROM p WHERE p.id = m.id), 0) AS n_quotes, coalesce(known.n_linked, 0) AS n_linked
FROM m JOIN own ON own.id = m.id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM m.conv_id AND best.turn = m.turn
LEFT JOIN threads ON threads.conv_id IS NOT DISTINCT FROM m.conv_id AND threads.turn = m.turn
LEFT JOIN known ON known.conv_id IS NOT DISTINCT FROM m.conv_id AND known.turn = m.turn
"""


def quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op9_reply_order`` over the conversations with quotes put in: two of three messages quote the one before, or the one before that within it."""
    said = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    texts = said.groupBy("conv_id", "turn").agg(F.max("text").alias("quoted"))
    back = lambda n: texts.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("quoted").alias(f"q{n}"))
    joined = said.join(back(1), ["conv_id", "turn"], "left").join(back(2), ["conv_id", "turn"], "left")
    marked = lambda c, mark: F.concat(F.lit(mark), F.replace(c, F.lit("\n"), F.lit("\n" + mark)))
    nested = F.concat(marked(F.col("q2"), "> > "), F.lit("\n> "), F.split_part("q1", F.lit("\n"), F.lit(1)), F.lit("\n"), F.col("text"))
    text = F.when(F.col("turn") % 3 == 1, F.concat(marked(F.col("q1"), "> "), F.lit("\n"), F.col("text"))).when(F.col("turn") % 3 == 2, nested)
    return reply_order(joined.select("conv_id", "turn", "role", F.coalesce(text, "text").alias("text")))


QUOTED_SQL = OP9_SQL.replace(
    "FROM conversations",
    """FROM (SELECT c.conv_id, c.turn, c.role, coalesce(CASE c.turn % 3 WHEN 1 THEN '> ' || replace(q1.q, chr(10), chr(10) || '> ') || chr(10) || c.text
    WHEN 2 THEN '> > ' || replace(q2.q, chr(10), chr(10) || '> > ') || chr(10) || '> ' || split_part(q1.q, chr(10), 1) || chr(10) || c.text END, c.text) AS text FROM conversations c
    LEFT JOIN (SELECT conv_id, turn + 1 AS turn, max(text) AS q FROM conversations GROUP BY ALL) q1 ON q1.conv_id = c.conv_id AND q1.turn = c.turn
    LEFT JOIN (SELECT conv_id, turn + 2 AS turn, max(text) AS q FROM conversations GROUP BY ALL) q2 ON q2.conv_id = c.conv_id AND q2.turn = c.turn)""",
)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(read_table(spark, sf_dir, "documents"), keep="max")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op11_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    coded = forced_bpe.encode_texts(docs, forced_bpe.default_merges(), decoded=True)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"), size=3, least=10, best=2000, swallow=50)


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (
  SELECT lang, 1 AS size, w[i] AS phrase FROM spots
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM spots WHERE i + 1 <= len(w)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM spots WHERE i + 2 <= len(w)),
f AS (SELECT lang, size, phrase, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, count(*) AS n FROM spots GROUP BY lang),
c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
longer AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, a, w[1] || ' ' || w[2] AS phrase FROM c WHERE size = 3
    UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM c WHERE size = 3) GROUP BY ALL),
cuts AS (
  SELECT lang, phrase, a, w, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:], ' ') AS s
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
scored AS (
  SELECT u.lang, u.phrase, u.a, k, l.n AS l, r.n AS r,
         ((1000000::HUGEINT * u.a * u.a) // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM cuts u JOIN f l ON l.lang = u.lang AND l.phrase = u.p JOIN f r ON r.lang = u.lang AND r.phrase = u.s),
worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, total.n AS n, score
FROM worst LEFT JOIN longer USING (lang, phrase) JOIN total USING (lang)
WHERE most IS NULL OR 100 * most < 50 * a
QUALIFY rank <= 2000
"""


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damage(read_table(spark, sf_dir, "conversations")))


#: States are 1 nothing yet, 2 after system, 3 after user, 4 after assistant; [3, 3, 4, 3] follow by an insert.
OP13_SQL = r"""
WITH RECURSIVE c AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS cid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS name
  FROM conversations),
h AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, name), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
         lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 20 AS fault FROM c),
d AS (
  SELECT cid, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
o AS (
  SELECT *, row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 AS seen,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS final
  FROM n),
r AS (
  SELECT *, CASE WHEN final = '' THEN 'b' WHEN seen THEN 'd' WHEN final NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS kind,
         lag(left(role, 1)) OVER (PARTITION BY cid ORDER BY i) || left(role, 1) AS pair
  FROM o),
e AS (
  SELECT *, list_transform([1, 2, 3, 4], lambda s: CASE WHEN fault IN ('b', 'd') THEN 0
         WHEN kind = 1 AND s = 1 THEN 2 WHEN kind = 2 AND s <> 3 THEN 3 WHEN kind = 3 AND s = 3 THEN 4 ELSE 0 END) AS kept,
         CASE fault WHEN 't' THEN 5 ELSE 0 END AS stays, CASE WHEN fault IN ('b', 'd') THEN 100000000 ELSE 1 END AS reroled
  FROM r),
v AS (
  SELECT cid, max(i) + 1 AS i, [0, 10, 5, 0]::BIGINT[] AS v FROM r GROUP BY cid
  UNION ALL
  SELECT cid, i, list_transform([1, 2, 3, 4], lambda s: least(base[s], 5 + base[[3, 3, 4, 3][s]], 10 + base[[3, 3, 4, 3][[3, 3, 4, 3][s]]]))
  FROM (
    SELECT e.cid, e.i, list_transform([1, 2, 3, 4], lambda s: least(2 + v.v[s], stays + reroled + v.v[[3, 3, 4, 3][s]],
           CASE WHEN kept[s] > 0 THEN stays + v.v[kept[s]] ELSE 100000000 END)::BIGINT) AS base
    FROM v JOIN e ON e.cid = v.cid AND e.i = v.i - 1)),
w AS (
  SELECT cid, 1::BIGINT AS i, 1 AS s, 0::BIGINT AS cost, '' AS audit, '' AS repaired, (SELECT max(i) FROM v x WHERE x.cid = q.cid) AS n
  FROM (SELECT DISTINCT cid FROM r) q
  UNION ALL
  SELECT cid, i + (edit <> 'I')::INT, CASE edit WHEN 'D' THEN s WHEN 'K' THEN keeps ELSE nxt END,
         cost + CASE edit WHEN 'D' THEN 2 WHEN 'I' THEN 5 WHEN 'K' THEN stays ELSE stays + 1 END, audit || edit,
         repaired || CASE edit WHEN 'D' THEN '' ELSE CASE repaired WHEN '' THEN '' ELSE chr(10) END ||
           CASE WHEN edit = 'K' THEN role WHEN nxt = 3 THEN 'user' ELSE 'assistant' END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END END, n
  FROM (
    SELECT w.*, e.role, e.text, e.stays, [3, 3, 4, 3][w.s] AS nxt, e.kept[w.s] AS keeps,
           CASE WHEN w.i < n AND a.v[w.s] = 2 + b.v[w.s] THEN 'D' WHEN a.v[w.s] = 5 + a.v[nxt] THEN 'I'
                WHEN keeps > 0 AND a.v[w.s] = stays + b.v[keeps] THEN 'K' ELSE 'R' END AS edit
    FROM w JOIN v a ON a.cid = w.cid AND a.i = w.i
    LEFT JOIN e ON e.cid = w.cid AND e.i = w.i LEFT JOIN v b ON b.cid = w.cid AND b.i = w.i + 1
    WHERE w.i < n OR w.s IN (2, 3))),
f AS (SELECT * FROM w WHERE i = n AND s IN (1, 4)),
t AS (
  SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY cid)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT cid, conv_id FROM c) q LEFT JOIN t USING (cid) LEFT JOIN f USING (cid)
"""


def plans() -> dict[str, Plan]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_quality": op3_quality,
        "op4_surrogates": op4_surrogates,
        "op5_suffix_array": op5_suffix_array,
        "op6_simhash": op6_simhash,
        "op7_top_k": op7_top_k,
        "op8_mixing": op8_mixing,
        "op9_reply_order": op9_reply_order,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_forced_bpe": op11_forced_bpe,
        "op12_phrases": op12_phrases,
        "op13_turns": op13_turns,
        "quoted_replies": quoted_replies,
    }


def oracles() -> dict[str, str]:
    return {
        "op7_top_k": OP7_SQL,
        "op8_mixing": OP8_SQL,
        "op9_reply_order": OP9_SQL,
        "op10_exact_dedup": OP10_SQL,
        "op12_phrases": OP12_SQL,
        "op13_turns": OP13_SQL,
        "quoted_replies": QUOTED_SQL,
    }
