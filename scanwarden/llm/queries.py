"""The registered queries of the corpus operators, with their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanwarden.llm import audit, contamination, exact, html, licences, lines, packing, pii, quality, simhash, toxicity, variants, warc
from scanwarden.llm.shared import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql.strip()
        return fn
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(quality.document_statistics(table(spark, sf_dir, "documents")))
    model = quality.fit(rows, table(spark, sf_dir, "labels"))
    value = model.score(F.col("statistics")) if model else F.lit(1.0)
    out = rows.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), value.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op2_line_dedup", r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT d.doc_id, d.pos, d.line, (o.k IS NOT NULL AND d.doc_id <> o.last) AS gone FROM keyed d LEFT JOIN often o USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::int) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op3_decontamination", r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
parts AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM items)),
sizes AS (SELECT item_id, count(*) AS n FROM parts GROUP BY item_id)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS item_shingles, count(*) AS matched, count(*) / n AS containment
FROM shingles JOIN parts USING (s) JOIN sizes USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) >= ceil(0.8 * n - 1e-9)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("body")


@query("op4_warc", r"""
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
bits AS (SELECT h, string_agg(CAST(CAST(('0x' || substr(h, k, 1))::INT AS BIT) AS VARCHAR)[-4:], '' ORDER BY k) AS b
         FROM (SELECT DISTINCT h, unnest(range(1, 41)) AS k FROM d) GROUP BY h),
code AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           16 * substr(b, k, 1)::INT + 8 * substr(b, k + 1, 1)::INT + 4 * substr(b, k + 2, 1)::INT
           + 2 * substr(b, k + 3, 1)::INT + substr(b, k + 4, 1)::INT AS INT), 1), '' ORDER BY k) AS c
         FROM (SELECT h, b, unnest(range(1, 161, 5)) AS k FROM bits) GROUP BY h),
o AS (SELECT h, max(page_id) AS owner FROM d GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, c AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM d JOIN code USING (h) JOIN o USING (h)""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op6_html_extraction")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).withColumn("held_out", quality.held_out(F.col("doc_id")))


@query("op9_license_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.licences(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


@query("op10_exact_dedup", """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS s FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256 FROM t""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op11_filter_audit", r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
f AS (SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
        100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t) AS c,
        regexp_matches(t, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY t) AS e FROM w),
m AS (SELECT part, [a, b, c, d, e] AS fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
      FROM f LEFT JOIN labels USING (doc_id)),
cells AS (SELECT part, fails, good, toxic, count(*) AS n FROM m GROUP BY ALL),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
orders AS (SELECT [p.k, q.k, r.k, s.k, t.k] AS o FROM letters p, letters q, letters r, letters s, letters t
           WHERE len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5),
steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
x AS (SELECT part, o, step, n, good, toxic, fails[o[step]] AS failing,
        len(list_filter(o[1:step - 1], lambda k: fails[k])) > 0 AS gone, len(list_filter(fails, lambda v: v)) AS failed FROM cells, steps),
y AS (SELECT part, o, step, sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN failing AND gone THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN failing AND failed = 1 THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN failing AND NOT gone AND good THEN n ELSE 0 END) AS good_lost,
        sum(CASE WHEN failing AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost FROM x GROUP BY part, o, step)
SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, step, CAST(kept AS BIGINT) AS kept,
  CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, o[step]) AS BIGINT) AS shapley FROM y""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_pii")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitised(table(spark, sf_dir, "documents"))


    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(pii.PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


@query("op13_spelling_variants", r"""WITH RECURSIVE steps AS (SELECT n AS b, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
  FROM (SELECT unnest(range(256)) AS n)),
crc AS (SELECT list(v ORDER BY b) AS t FROM steps),
docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
runs AS (SELECT id, run, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(t, '[a-z\x{C0}-\x{FF}]+')) AS run FROM docs) WHERE length(run) >= 6 GROUP BY id, run),
bytes AS (SELECT id, run, n, hex(encode(id || ':' || run)) AS x FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
             lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)])), 4294967295) AS h FROM bytes, crc),
made AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (SELECT word, n, length(word) AS size, i, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS r FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.l || c.r
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.l || c.r),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, encode(other)) AS other, max(n) AS other_n FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form,
  CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
way AS (SELECT word, word AS at FROM forms UNION ALL SELECT way.word, f.form FROM way JOIN forms f ON f.word = way.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN way w ON w.word = f.word JOIN forms e ON e.word = w.at WHERE e.form IS NULL""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(variants.word_counts(table(spark, sf_dir, "documents")))
