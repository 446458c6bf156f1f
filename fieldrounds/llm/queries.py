"""One query per operator over its whole table, each beside its SQL where SQL can express it."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import stored
from . import chat, decontaminate, jaccard, lexical, licences, mixing, quality, runs, secrets, tokens, topk, toxicity, warc
from .common import id_remainder, let, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return wrap


OP1 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS place
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight,
             source_size * 3 AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE
                / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(coalesce((SELECT arg_min(level, cap / weight) FROM l WHERE level * weight <= cap) * weight, cap::DOUBLE), cap::DOUBLE) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
b AS (SELECT source, floor(place * 4096)::INT AS bin, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
u AS (SELECT b.*, sum(words) OVER (PARTITION BY b.source ORDER BY bin) AS upto, r.target - r.whole * r.source_size AS rest
      FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source),
e AS (SELECT source, arg_min(bin + (rest - upto + words) / words, bin) AS edge FROM u WHERE rest > 0 AND words > 0 AND upto > rest GROUP BY source)
SELECT d.doc_id, d.size, r.source_size, r.target,
       (r.whole + CASE WHEN d.place * 4096 < coalesce(e.edge, 0) THEN 1 ELSE 0 END)::BIGINT AS copies,
       ((r.whole + CASE WHEN d.place * 4096 < coalesce(e.edge, 0) THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""


@query("op1_mix_to_weights", OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op2_quality_pu")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_table(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query("op3_toxicity_pu")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_table(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


@query("op4_exact_topk", OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP5 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
         length(replace(replace(text, '\', '\s'), '<', '\l')) AS text_chars,
         length(replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g')) AS role_chars
  FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       sum(text_chars + CASE WHEN before IS NOT DISTINCT FROM role THEN 6 ELSE 15 + role_chars END)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""


@query("op5_chat_format", OP5)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    return chat.digests(chat.format_chats(rows.unionByName(extra)))


OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, encode(coalesce(html, '')) AS payload FROM pages),
f AS (SELECT *, sha1(payload) AS h, min(page_id) OVER (PARTITION BY html) AS first_id FROM p),
g AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(h, (5 * i + 1)::INT, 5))::BIGINT) AS parts FROM f)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
       array_to_string(list_transform(parts, lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((b >> 15) & 31)::INT + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((b >> 10) & 31)::INT + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((b >> 5) & 31)::INT + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (b & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM g
"""


@query("op6_warc_dictionary", OP6)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = warc.new_folder(spark)
    manifest = warc.write(pages, folder, warc.build_dictionary(pages))
    return warc.check_revisits(stored(warc.read(manifest, folder, with_payload=False).drop("payload"), "records"))


@query("op7_decontaminate")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(line: str) -> str:
    plain = f"trim(regexp_replace(lower({line}), '{licences.PLAIN}', ' ', 'g'), ' ')"
    for said, same in licences.SPELLINGS:
        plain = f"replace({plain}, {_quoted(said)}, {_quoted(same)})"
    return f"CASE WHEN regexp_matches(lower({line}), {_quoted(licences.COPYRIGHT)}) THEN '' ELSE {plain} END"


def _lines_sql(text: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({text}, ''), chr(10)), lambda x: {_canonical_sql('x')}), lambda x: x <> '')"


OP8 = f"""
WITH k(licence, text) AS (VALUES {', '.join(f'({_quoted(i)}, {_quoted(t)})' for i, t in licences.KNOWN)}),
known AS (SELECT min(licence) AS licence, array_to_string({_lines_sql('text')}, ' ') AS form FROM k GROUP BY form),
l AS (SELECT doc_id, {_lines_sql('text')} AS lines FROM documents),
u AS (SELECT doc_id, NULL::INT AS line, array_to_string(lines, ' ') AS form FROM l WHERE len(lines) > 0
      UNION ALL SELECT doc_id, i::INT, lines[i] FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l WHERE len(lines) > 1))
SELECT doc_id, CASE WHEN line IS NULL THEN 'text' ELSE 'line' END AS scope, licence, line FROM u JOIN known USING (form)
"""


@query("op8_licence_digests", OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def _spans_sql(rule: secrets.Rule, rank: int) -> str:
    pattern = _quoted(rule.pattern)
    return f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, pos AS start, pos + length(part) AS "end" FROM (
      SELECT doc_id, part, i, (sum(length(part)) OVER (PARTITION BY row ORDER BY i) - length(part))::BIGINT AS pos FROM (
        SELECT doc_id, row, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (
          SELECT doc_id, row, string_split(regexp_replace(text, {pattern}, chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS parts FROM d)))
      WHERE i % 2 = 0 AND length(regexp_extract(part, {pattern}, {rule.group})) >= {rule.least}"""


OP9 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, replace(coalesce(text, ''), chr(1), chr(2)) AS text FROM documents),
s AS ({' UNION ALL '.join(_spans_sql(r, i) for i, r in enumerate(secrets.RULES))}),
f AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) AS spans,
             count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f ON d.doc_id = f.doc_id
"""


@query("op9_secret_ledger", OP9)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.report(docs, secrets.scanned(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


OP10 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b, inter = x.n AND inter = y.n AS same FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE inter / (x.n + y.n - inter) >= 0.8),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
m AS (SELECT node, min(seen) AS class_id FROM r GROUP BY node),
k AS (SELECT doc_id, md5(string_agg(s, '|' ORDER BY s)) AS k FROM g GROUP BY doc_id),
c AS (SELECT a, count(*) AS links, count(DISTINCT CASE WHEN NOT same THEN k.k END) AS set_links FROM e JOIN k ON e.b = k.doc_id GROUP BY a)
SELECT d.doc_id, coalesce(m.class_id, d.doc_id) AS class_id, coalesce(c.links, 0)::BIGINT AS links, coalesce(c.set_links, 0)::BIGINT AS set_links
FROM documents d LEFT JOIN m ON d.doc_id = m.node LEFT JOIN c ON d.doc_id = c.a
"""


@query("op10_jaccard_paths", OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents")).drop("text_key")


OP11 = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
t AS MATERIALIZED (
  SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d),
n AS (SELECT row, count(*)::BIGINT AS n FROM t GROUP BY row),
s AS MATERIALIZED (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
p AS MATERIALIZED (SELECT row, doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p CROSS JOIN s GROUP BY term),
b AS MATERIALIZED (SELECT row_number() OVER () AS item, item_id, text FROM benchmark),
q AS (
  SELECT item, item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM b)
  GROUP BY ALL),
r AS (
  SELECT q.item, q.item_id, p.row, p.doc_id,
         sum(q.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * n.n * s.docs) // s.terms))))::BIGINT AS score
  FROM q JOIN w ON q.term = w.term JOIN p ON p.term = q.term JOIN n ON n.row = p.row CROSS JOIN s GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM r WHERE score > 0 AND doc_id IS NOT NULL QUALIFY rank <= 20
"""


@query("op11_lexical_search", OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


@query("op12_token_counts")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


OP13 = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o,
         xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS h
  FROM documents),
p AS (SELECT *, len(o) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(o) > 0 THEN (h // 10) % len(o) END AS a FROM d),
q AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM p),
w AS MATERIALIZED (
  SELECT row, i, CASE WHEN a IS NULL OR i < a THEN o[i + 1] ELSE o[a + (i - a) % p + 1] END AS w
  FROM (SELECT *, unnest(range(n)) AS i FROM q)),
e AS MATERIALIZED (
  SELECT row, i, hash(string_agg(w, ' ') OVER (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) AS s FROM w),
c AS MATERIALIZED (
  SELECT row, period FROM (SELECT x.row, y.i - x.i AS period FROM e x JOIN e y ON x.row = y.row AND x.s = y.s AND y.i > x.i WHERE x.i % 8 = 0)
  GROUP BY row, period HAVING count(*) >= greatest(1, (2 * period - 7) // 8)),
m AS (SELECT c.row, period, x.i, x.i - row_number() OVER (PARTITION BY c.row, period ORDER BY x.i) AS island
      FROM c JOIN w x ON c.row = x.row JOIN w y ON y.row = x.row AND y.i = x.i + period WHERE x.w = y.w),
f AS (SELECT * FROM (SELECT row, period, min(i) AS start, count(*) + period AS length FROM m GROUP BY row, period, island) WHERE length >= greatest(24, 3 * period)),
r AS MATERIALIZED (SELECT row, start::BIGINT AS start, length::BIGINT AS length, min(period)::BIGINT AS period FROM f GROUP BY row, start, length),
s AS (SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text FROM r GROUP BY row),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY row ORDER BY length::DOUBLE / period DESC, start, period) = 1),
x AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT w.row, string_agg(w, ' ' ORDER BY w.i) AS text FROM w ANTI JOIN x ON w.row = x.row AND w.i = x.i GROUP BY w.row)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start, b.length, b.period, (1000 * b.length) // b.period AS exponent_milli,
       sha256(coalesce(s.text, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM d LEFT JOIN s ON d.row = s.row LEFT JOIN b ON d.row = b.row LEFT JOIN k ON d.row = k.row
"""


def with_loops(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of documents, where a tenth of them, by a hash of the id, repeat the words after a place over and over."""
    h = F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10).cast("long")

    def looped(words: Column) -> Column:
        n = F.size(words)
        start = F.pmod(g, n)
        period = 1 + F.floor((n - start) / (3 + g % 8)).cast("long")
        source = lambda i: F.when(i < start, i).otherwise(start + (i - start) % period)
        return F.when(n > 0, F.array_join(F.transform(words, lambda _, i: F.element_at(words, (source(i) + 1).cast("int"))), " ")).otherwise("")
    words = F.regexp_extract_all(F.coalesce(docs["text"], F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return docs.select(docs["doc_id"], F.when(id_remainder(docs["doc_id"], 10) == 0, let(words, looped)).otherwise(docs["text"]).alias("text"))


@query("op13_periodic_runs", OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(with_loops(table(spark, sf_dir, "documents"))).withColumn("best", runs.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.col("digest").alias("collapsed_sha256"))
