"""The queries of the text operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_tokens import public_path
from .common import table
from .decontaminate import contamination
from .exact_dedup import exact_groups
from .html_text import extract_text
from .line_dedup import remove_boilerplate
from .near_dup import near_duplicates
from .negatives import hard_negatives
from .packing import pack_documents
from .quality import judge_texts
from .resample import importance_scores
from .sharding import shard_documents
from .warc import read_records, write_archives
from .wavelet import read_documents, write_shards
from .word_bpe import encode_documents


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that five sources show or more are taken out."""
    cleaned = remove_boilerplate(table(spark, sf_dir, "documents"), sites=5)
    text = F.coalesce("text", F.lit(""))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(text.cast("binary"), 256).alias("text_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_texts(table(spark, sf_dir, "documents"), ["doc_id"])


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract_text(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return texts.select("page_id", "url", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "text")


def op6_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_shards(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))
    return read_documents(manifest).withColumnRenamed("id", "doc_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), 40, seed=7)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_records(write_archives(table(spark, sf_dir, "pages")))
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents of 20 words or more, drawn towards the benchmark's words and pairs of words."""
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    scores = importance_scores(docs, target, n=2, buckets=10_000, percent=25, min_words=20, seed=7)
    return scores.select(F.col("id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 50; labels of rows divisible by 7 are moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95, scale=256)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside windows of ten words of the benchmark's items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_quality, op3_bpe, op4_exact_dedup, op5_html_text, op6_wavelet, op7_sharding, op8_near_dedup, op9_warc, op10_packing, op11_resampling, op12_hard_negatives, op13_decontamination)}


SPACE = "chr(32) || chr(9) || chr(11) || chr(12) || chr(13) || chr(10)"

OP1 = f"""
WITH d AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines, text IS NULL AS no_text FROM documents),
l AS (SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, trim(line, {SPACE}) AS key FROM l),
b AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= 5),
s AS (
  SELECT doc_id, count(*) AS n_lines, count(b.key) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE b.key IS NULL), '') AS kept
  FROM k LEFT JOIN b ON k.key = b.key GROUP BY doc_id)
SELECT doc_id, CASE WHEN no_text THEN 0 ELSE n_lines END AS n_lines, n_removed, sha256(kept) AS text_sha256
FROM s JOIN d USING (doc_id)
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


#: Base32 of a SHA-1: five hexadecimal digits are four letters.
OP9 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def _crc(c: int) -> int:
    for _ in range(8):
        c = c >> 1 ^ 0xEDB88320 * (c & 1)
    return c


#: What each byte adds to a crc32, 8 hexadecimal digits for each.
CRCS = "".join(f"{_crc(c):08x}" for c in range(256))
#: 2**64: products are taken in 128 bits.
WORD = "18446744073709551616::UHUGEINT"


def _mixed(start: str, rows: str) -> str:
    """rows with y = start modulo 2**64 and mixed, the network's mix of y."""
    return f"""SELECT *, xor(d, d >> 32) AS mixed FROM (SELECT *, c * {0xC4CEB9FE1A85EC53}::UHUGEINT % {WORD} AS d FROM (
  SELECT *, xor(b, b >> 29) AS c FROM (SELECT *, a * {0xFF51AFD7ED558CCD}::UHUGEINT % {WORD} AS b FROM (
  SELECT *, xor(y, y >> 33) AS a FROM (SELECT *, ({start}) % {WORD} AS y FROM {rows})))))"""


#: Rows walk through rounds of the network until one sixth round ends below n.
OP7 = f"""
WITH RECURSIVE
k AS (SELECT i AS step, mixed AS key FROM ({_mixed(f"i::UHUGEINT + 7::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT", "range(6) t(i)")})),
b AS (SELECT doc_id, encode(coalesce(text, '')) AS bytes FROM documents),
s AS (
  SELECT doc_id, octet_length(bytes) + 16 AS size, xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(bytes), '..'), lambda h: ('0x' || h)::UBIGINT)),
    lambda c, v: xor(c >> 8, ('0x' || substr('{CRCS}', (1 + 8 * (xor(c, v) & 255))::BIGINT, 8))::UBIGINT))) AS text_crc32
  FROM b),
n AS (SELECT count(*)::UHUGEINT AS n, (2 ** ((length(bin(greatest(count(*) - 1, 1))) + 1) // 2))::UHUGEINT AS span FROM documents),
m AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::UHUGEINT AS x FROM documents),
f AS (
  SELECT doc_id, x // span AS l, x % span AS r, 0 AS step FROM m, n
  UNION ALL
  SELECT doc_id, r, xor(l, mixed % span), step + 1
  FROM ({_mixed("r + key", "(SELECT f.*, key, span FROM f JOIN k ON k.step = f.step % 6, n WHERE f.step % 6 > 0 OR f.step = 0 OR l * span + r >= n)")})),
o AS (SELECT doc_id, (l * span + r)::BIGINT AS place FROM f, n WHERE step > 0 AND step % 6 = 0 AND l * span + r < n)
SELECT s.doc_id, size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (place % 40)::INT AS shard, place // 40 AS slot, NULL::INT AS grown_shard
FROM s JOIN o USING (doc_id)
"""


#: All pairs that share a shingle: for tables of some thousand documents.
OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, len(words) AS n_words, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
s AS (
  SELECT doc_id, n_words, pos, string_agg(word, ' ') OVER (
    PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS shingle FROM u),
e AS (SELECT DISTINCT doc_id, shingle FROM s WHERE pos <= greatest(1, n_words - 4)),
n AS (SELECT d.doc_id, count(e.shingle) AS n_shingles FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id GROUP BY d.doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both
  FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * n_both >= 85 * (a.n_shingles + b.n_shingles - n_both)),
links AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, links.y FROM r JOIN links ON links.x = r.y)
SELECT n.doc_id, n_shingles, min(r.y) AS component_id, n.doc_id = min(r.y) AS kept
FROM n JOIN r ON r.x = n.doc_id GROUP BY n.doc_id, n_shingles
"""



def _words(text: str) -> str:
    """The words of a text, A-Z in lower case."""
    return f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


#: The crc32 of each different feature is taken once.
OP11 = f"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, {_words("coalesce(text, '')")} AS words FROM documents UNION ALL
  SELECT 'b', row_number() OVER (), {_words("coalesce(text, '')")} FROM benchmark),
n AS (SELECT id, len(words) AS n_words FROM w WHERE side = 'd'),
f AS (
  SELECT side, id, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS feature FROM w),
e AS (SELECT DISTINCT feature FROM f),
c AS (
  SELECT feature, (xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(feature)), '..'), lambda h: ('0x' || h)::UBIGINT)),
    lambda c, v: xor(c >> 8, ('0x' || substr('{CRCS}', (1 + 8 * (xor(c, v) & 255))::BIGINT, 8))::UBIGINT))) % 10000)::INT AS bucket
  FROM e),
k AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f JOIN c USING (feature) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM k) + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM k) + 10000)::DOUBLE)))::BIGINT AS gain FROM k),
p AS (
  SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS total
  FROM f JOIN c USING (feature) JOIN g USING (bucket) WHERE side = 'd' GROUP BY id),
s AS (
  SELECT n.id AS doc_id, n_words, coalesce(n_features, 0) AS n_features,
    coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
    ('0x' || substr(sha256('7:' || n.id), 1, 8))::BIGINT AS h
  FROM n LEFT JOIN p ON p.id = n.id),
x AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM s),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 25 * count(*) OVER () // 100 AS drawn FROM x WHERE n_words >= 20)
SELECT x.doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank
FROM x LEFT JOIN r ON r.doc_id = x.doc_id
"""

OP12 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id AS id, list_dot_product(a.vec, r.vec)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same),
m AS (
  SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score
  WHERE place <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM m WHERE rank <= 3
"""

OP13 = f"""
WITH d AS (SELECT doc_id, {_words("coalesce(text, '')")} AS words FROM documents),
i AS (SELECT item_id::VARCHAR AS item_id, {_words("coalesce(text, '')")} AS words FROM benchmark),
b AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS size,
    unnest(list_transform(range(0, len(words) - least(10, len(words)) + 1), lambda p: array_to_string(words[p + 1 : p + least(10, len(words))], ' '))) AS win
  FROM i WHERE len(words) > 0),
z AS (SELECT DISTINCT size FROM b),
w AS (SELECT doc_id, size, words, unnest(range(0, len(words) - size + 1)) AS p FROM d JOIN z ON len(words) >= size),
h AS (SELECT DISTINCT doc_id, p, b.size, item_id FROM w JOIN b ON b.size = w.size AND b.win = array_to_string(words[p + 1 : p + w.size], ' ')),
c AS (SELECT doc_id, count(DISTINCT hit) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS hit FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1, "op4_exact_dedup": OP4, "op7_sharding": OP7, "op8_near_dedup": OP8, "op9_warc": OP9, "op11_resampling": OP11, "op12_hard_negatives": OP12, "op13_decontamination": OP13}
