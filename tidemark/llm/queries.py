"""The queries of the corpus operators: each applies one operator with production parameters to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import anagram, language, motion_jpeg, quality, secrets, toxicity
from tidemark.llm.common import id_crc, table
from tidemark.llm.decontaminate import contaminated
from tidemark.llm.jaccard_join import jaccard_components
from tidemark.llm.mixing import mix
from tidemark.llm.token_files import token_output
from tidemark.llm.url_filter import verdicts
from tidemark.llm.warc import round_trip
from tidemark.llm.word_runs import word_runs


def held_out(parts: int, part: int) -> Column:
    """Whether crc32(doc_id as text) has this remainder; false for a null id, whose document teaches nothing either."""
    return F.coalesce(id_crc("doc_id") % parts == part, F.lit(False)).alias("held_out")


def op1_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clips' times are told as JSON."""
    found = motion_jpeg.digests(motion_jpeg.stored(motion_jpeg.store_texts(table(spark, sf_dir, "documents"))))
    return found.withColumn("clips", F.to_json("clips"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.learn(docs.where(id_crc("doc_id") % 4 != 2)))
    return found.select("doc_id", held_out(4, 2), "lang_pred", "score")


def op4_toxicity_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.learn(toxicity.training(docs, table(spark, sf_dir, "labels"), "toxic")))
    return found.select("doc_id", held_out(5, 0), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op6_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.learn(toxicity.training(docs, table(spark, sf_dir, "labels"), "quality", quality.CURVE_ROWS)))
    return found.select("doc_id", held_out(5, 0), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), percent=80, k=5)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of 4 for src0 and 2 for src1; others get about 1, by the square root of their sizes."""
    return mix(table(spark, sf_dir, "documents"), weights={"src0": 4.0, "src1": 2.0}, block_docs=16)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Dated entries that op10's list has for a host and for a path prefix, and their verdicts (none is a removal).
HOST_ENTRIES, PREFIX_ENTRIES, VERDICTS = 24, 3, ("block", "review", "allow", None, "block")


def url_list(pages: DataFrame) -> DataFrame:
    """(key, verdict, dated): thousands of entries for half of the hosts and path prefixes in pages (url), with days and verdicts by an MD5 of the key, as the tables
    have no list."""
    url = F.lower("url")
    keys = pages.select(F.explode(F.array(F.regexp_extract(url, "://([^/?#]*)", 1), F.regexp_extract(url, "://([^?#]*/)", 1))).alias("key")).where("key <> ''").distinct()
    keys = keys.where(F.substring(F.md5("key"), 1, 1) < "8")
    times = F.when(F.col("key").endswith("/"), PREFIX_ENTRIES).otherwise(HOST_ENTRIES)
    dated = keys.select("key", F.explode(F.sequence(F.lit(1), times)).alias("nth")).withColumn("h", F.md5(F.concat_ws("#", "key", F.col("nth").cast("string"))))
    number = lambda at, n: F.conv(F.substring("h", at, 6), 16, 10).cast("int") % n
    day = F.date_add(F.lit("2023-10-01").cast("date"), number(1, 450))
    return dated.select("key", F.array(*(F.lit(v) for v in VERDICTS))[number(7, len(VERDICTS))].alias("verdict"), day.alias("dated"))


def op10_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's day of capture is derived from its page_id, as the table has none."""
    pages = table(spark, sf_dir, "pages")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int"))
    captures = pages.select("page_id", "url", day.alias("fetched"))
    found = verdicts(captures, url_list(pages))
    return found.select("page_id", F.date_format("fetched", "yyyy-MM-dd").alias("fetched"), F.coalesce("verdict", F.lit("unlisted")).alias("verdict"), "matched_key")


#: What op11 takes for words, and how many of the runs lose a letter: one in SPOILED, by their hash.
WORD_LETTERS, WORD_COUNT, SPOILED = 7, 2, 31


def spoiled(runs: DataFrame) -> DataFrame:
    """(word) for each of runs (doc_id, run): without the letter at h % length, from 0, where SPOILED divides h, the crc32 of `<doc_id>:<run>`. A null id has no digits."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(h % SPOILED == 0, shorter).otherwise(F.col("run")).alias("word"))


def op11_anagram_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spoiled(anagram.runs_of(table(spark, sf_dir, "documents"), WORD_LETTERS))
    return anagram.variants(anagram.counted(words, WORD_LETTERS, WORD_COUNT))


def made_periodic(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in which texts with words whose id's crc32, h, is divisible by 10 repeat themselves: word i from a on becomes word a + (i - a) % p, where
    a = g % n, p = 1 + (n - a) div (3 + g % 8) and g = h div 10. Others and those of null ids stay as they are."""
    words, h = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), id_crc("doc_id")
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.expr("crc32(cast(cast(doc_id as string) as binary)) div 10").alias("g"))
    chosen = chosen.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    chosen = chosen.withColumn("p", 1 + F.expr("(n - a) div (3 + g % 8)"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    again = F.array_join(F.transform("w", lambda _, i: F.get("w", place(i))), " ")
    return chosen.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs(made_periodic(table(spark, sf_dir, "documents")))
    higher = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    found = found.withColumn("best", F.aggregate("runs", F.get("runs", F.lit(0)), higher))
    line = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    lines = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}") for c in ("start", "length", "period")), F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.BASE + secrets.MORE)
    kinds = [r.kind for r in secrets.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(of, kinds), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
q AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS keep FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keep <> page_id THEN keep END AS refers_to FROM q
"""

# hosts by splitting at marks, verdicts by the last entry up to the day, keys by comparing all of them
OP10_SQL = f"""
WITH keys AS (
  SELECT DISTINCT key FROM (SELECT split_part(split_part(split_part(split_part(lower(url), '://', 2), '/', 1), '?', 1), '#', 1) AS key FROM pages
    UNION SELECT regexp_extract(lower(url), '://([^?#]*/)', 1) FROM pages) WHERE key <> '' AND substr(md5(key), 1, 1) < '8'
), listed AS (
  SELECT key, md5(key || '#' || nth) AS h FROM (SELECT key, unnest(generate_series(1, CASE WHEN ends_with(key, '/') THEN {PREFIX_ENTRIES} ELSE {HOST_ENTRIES} END)) AS nth FROM keys)
), entries AS (
  SELECT key, (DATE '2023-10-01' + CAST(CAST('0x' || substr(h, 1, 6) AS INTEGER) % 450 AS INTEGER)) AS dated,
    [{", ".join(f"'{v}'" if v else "NULL" for v in VERDICTS)}][1 + CAST('0x' || substr(h, 7, 6) AS INTEGER) % {len(VERDICTS)}] AS verdict FROM listed
), daily AS (
  SELECT key, dated, CASE WHEN count(verdict) = count(*) THEN max(verdict) END AS verdict FROM entries GROUP BY key, dated
), captures AS (
  SELECT page_id, DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INTEGER) AS d, rtrim(regexp_replace(regexp_replace(string_split(rest, '/')[1], '.*@', ''), ':[0-9]*$', ''), '.') AS host,
    CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
  FROM (SELECT page_id, split_part(split_part(split_part(lower(trim(url)), '://', 2), '?', 1), '#', 1) AS rest FROM pages)
), latest AS (
  SELECT c.page_id, e.key, e.verdict, row_number() OVER (PARTITION BY c.page_id, e.key ORDER BY e.dated DESC) AS r
  FROM captures c JOIN daily e ON e.dated <= c.d AND c.host <> '' AND (c.host = e.key OR ends_with(c.host, '.' || e.key) OR (ends_with(e.key, '/') AND starts_with(c.host || c.path, e.key)))
), hits AS (
  SELECT page_id, key, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(key) DESC, key DESC) AS r FROM latest WHERE r = 1 AND verdict IS NOT NULL
)
SELECT c.page_id, strftime(c.d, '%Y-%m-%d') AS fetched, coalesce(h.verdict, 'unlisted') AS verdict, h.key AS matched_key
FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id AND h.r = 1
"""

OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM words
), tokens AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, CAST(any_value(len(s.s)) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM sets s JOIN reach r ON s.doc_id = r.a GROUP BY s.doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_motion_jpeg": op1_motion_jpeg,
    "op2_decontaminate": op2_decontaminate,
    "op3_language_mixture": op3_language_mixture,
    "op4_toxicity_kneser_ney": op4_toxicity_kneser_ney,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality_nbsvm": op6_quality_nbsvm,
    "op7_token_files": op7_token_files,
    "op8_mix_sources": op8_mix_sources,
    "op9_warc": op9_warc,
    "op10_temporal_url_filter": op10_temporal_url_filter,
    "op11_anagram_variants": op11_anagram_variants,
    "op12_word_runs": op12_word_runs,
    "op13_secret_scan": op13_secret_scan,
}
ORACLES: dict[str, str] = {"op5_jaccard_join": OP5_SQL, "op9_warc": OP9_SQL, "op10_temporal_url_filter": OP10_SQL}
