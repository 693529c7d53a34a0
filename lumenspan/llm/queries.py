"""One registered query per operator of this folder, over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm import (
    compression, decontamination, filter_audit, langid, lexical, licenses, linededup, lm, mixing, pages, quality, simhash, toxicity,
)
from lumenspan.llm.base import WORD, documents, prepare, table
from lumenspan.llm.license_rules import rules
from lumenspan.llm.training import learnable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: function(prepare(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op8_simhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(documents(spark, sf_dir), shingle=3)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


CLOSING_SQL = quality.CLOSING.replace("'", "''")
OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS run
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
repeated AS (SELECT doc_id, unnest(range(i, i + 8)) AS p
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM repeated GROUP BY doc_id),
split AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM d)),
counted AS (SELECT *, len(regexp_extract_all(line, '{WORD}')) AS n,
  length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars,
  row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS copy FROM split),
judged AS (SELECT *, CASE WHEN n = 0 THEN NULL
  WHEN len(regexp_extract_all(line, '{quality.BARS}')) >= 2 THEN 'navigation'
  WHEN NOT regexp_matches(line, '{CLOSING_SQL}') THEN 'punctuation'
  WHEN len(regexp_extract_all(line, '{quality.MARKS}')) > 0.25 * n THEN 'punctuation'
  WHEN len(regexp_extract_all(line, '{quality.SYMBOLS}')) > 0.5 * n THEN 'punctuation'
  WHEN n <= 12 AND regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '{quality.BOILERPLATE}') THEN 'boilerplate' END AS fault FROM counted),
lines AS (SELECT doc_id, count(*) FILTER (n > 0 AND copy > 1) AS n_dup_lines,
  CAST(coalesce(sum(chars) FILTER (fault IS NOT NULL), 0) AS BIGINT) AS lost_chars,
  CAST(coalesce(sum(chars) FILTER (fault = 'punctuation'), 0) AS BIGINT) AS lost_punctuation,
  CAST(coalesce(sum(chars) FILTER (fault = 'navigation'), 0) AS BIGINT) AS lost_navigation,
  CAST(coalesce(sum(chars) FILTER (fault = 'boilerplate'), 0) AS BIGINT) AS lost_boilerplate
  FROM judged GROUP BY doc_id),
base AS (SELECT d.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
  len(regexp_extract_all(text, '{quality.SYMBOLS}')) AS n_symbols, n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, lost_chars, lost_punctuation, lost_navigation, lost_boilerplate
  FROM d JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_chars <= 0.3 * word_chars AS kept FROM base
"""


@query("op1_quality_rules", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.assess(documents(spark, sf_dir).select("doc_id", "text"))
    columns = [part.split()[0] for part in quality.COLUMNS.split(", ")]
    return rated.select("doc_id", *[F.col("quality")[c].alias(c) for c in columns if c != "cleaned"])


OP7_SQL = f"""
WITH split AS (SELECT doc_id, unnest(lines) AS raw, generate_subscripts(lines, 1) - 1 AS pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)),
counted AS (SELECT *, regexp_replace(raw, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS line,
  CAST(len(regexp_extract_all(raw, '{WORD}')) AS BIGINT) AS w FROM split),
full_lines AS (SELECT *, CAST(sum(w) OVER (PARTITION BY doc_id ORDER BY pos) - w AS BIGINT) AS done FROM counted WHERE w > 0),
runs AS (
  SELECT doc_id, pos AS first, max(pos) OVER s AS last, array_to_string(list(line) OVER s, chr(10)) AS run, sum(w) OVER s AS total,
    'forward' AS kind FROM full_lines WINDOW s AS (PARTITION BY doc_id ORDER BY done RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, min(pos) OVER e, pos, array_to_string(list(line) OVER e, chr(10)), sum(w) OVER e, 'backward'
    FROM full_lines WINDOW e AS (PARTITION BY doc_id ORDER BY done + w RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
later AS (SELECT doc_id, first, last FROM (
  SELECT *, row_number() OVER (PARTITION BY kind, run ORDER BY doc_id, first) AS n FROM runs WHERE total >= 50) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM later),
marked AS (SELECT counted.*, gone.pos IS NOT NULL AND w > 0 AS out FROM counted LEFT JOIN gone USING (doc_id, pos)),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (out) AS n_removed,
  coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT out), '') AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, kept.text
FROM documents d LEFT JOIN kept USING (doc_id)
"""


@query("op7_line_dedup", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.size(F.split("text", "\n")).alias("n"))
    found = linededup.dedup_lines(docs)
    lines = F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).cast("bigint")
    return found.select("doc_id", lines.alias("n_lines"), F.size("removed").cast("bigint").alias("n_removed"), "text")


@query("op5_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "first_word", "n_compared", "n_equal", "best_window")


def _op9_sql() -> str:
    quoted = lambda x: "'" + str(x).replace("'", "''") + "'"
    values = ",\n".join(
        f"({quoted(r.rule)}, {quoted(r.label)}, {r.priority}, {r.confidence}::DOUBLE, {quoted(r.keyword)}, {quoted(r.pattern)})" for r in rules()
    )
    phrases = " UNION ALL ".join(f"SELECT {quoted(p)} AS phrase, {quoted(x)} AS label" for p, x in licenses.PHRASES.items())
    return rf"""
WITH rules(rule, label, priority, confidence, keyword, pattern) AS (VALUES {values}),
phrases AS ({phrases}),
d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d),
places AS (SELECT doc_id, i - 1 AS place, label FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) p
  JOIN phrases ON ws[i] = string_split(phrase, ' ')[1]
  AND list_slice(ws, i, i + len(string_split(phrase, ' ')) - 1) = string_split(phrase, ' ')),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels
  FROM places GROUP BY doc_id),
squeezed AS (SELECT *, regexp_replace(text, '[\s\x0B]+', ' ', 'g') AS plain FROM d),
tried AS (SELECT doc_id, text, rules.* FROM squeezed JOIN rules ON contains(plain, keyword)),
pieces AS (SELECT * EXCLUDE (text, keyword, pattern), regexp_extract_all(text, pattern) AS m, string_split_regex(text, pattern) AS b FROM tried),
each AS (SELECT * EXCLUDE (m, b), unnest(range(1, len(m) + 1)) AS k, m, b FROM pieces WHERE len(m) > 0),
placed AS (SELECT doc_id, rule, label, priority, confidence,
  list_sum(list_transform(b[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:k - 1], lambda x: length(x))), 0) AS first,
  list_sum(list_transform(b[:k], lambda x: length(x))) + list_sum(list_transform(m[:k], lambda x: length(x))) AS last FROM each),
stay AS (SELECT * FROM placed i WHERE NOT EXISTS (SELECT 1 FROM placed j WHERE j.doc_id = i.doc_id AND j.first <= i.first
  AND j.last >= i.last AND (j.priority > i.priority OR j.priority = i.priority AND j.last - j.first > i.last - i.first))),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(confidence) AS best FROM stay GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
  greatest(CASE WHEN n_base > 0 THEN {licenses.PHRASE_SCORE} ELSE 0 END, coalesce(best, 0))::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


@query("op9_license_scan", _op9_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


OP4_SQL = """
WITH counts AS (SELECT source, count(*) AS n, sqrt(count(*)) AS weight FROM documents GROUP BY source),
rates AS (SELECT source, weight / sum(weight) OVER () * sum(n) OVER () / n AS rate FROM counts),
odds AS (SELECT source, k, rate, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS upto
  FROM (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM rates)),
limits AS (SELECT source, list(upto ORDER BY k) AS upto FROM odds GROUP BY source),
drawn AS (SELECT d.*, len(list_filter(upto, lambda c: c <= u)) AS times FROM (
  SELECT *, ('0x' || substr(md5('17:' || doc_id || ':1'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents) d
  JOIN limits ON d.source IS NOT DISTINCT FROM limits.source),
copies AS (SELECT *, CAST(unnest(range(0, times)) AS INTEGER) AS replica FROM drawn)
SELECT doc_id, text, lang, source, n_chars, replica,
  ('0x' || substr(md5('17:' || doc_id || ':' || replica || ':order'), 1, 13))::BIGINT AS shuffle_key FROM copies
"""


@query("op4_mix_sources", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


@query("op10_compression_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(learnable(F.col("doc_id"), 3, 1))
    scored = compression.score(docs, compression.train(docs, labels))
    return scored.select(
        "doc_id", (~learnable(F.col("doc_id"), 3, 1)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op3_toxicity_pu")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    own = learnable(F.col("doc_id"), 4, 2)
    model = toxicity.train(docs.where(own), table(spark, sf_dir, "labels").where(own))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (~own).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op6_cross_parsing_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    own = learnable(F.col("doc_id"), 3, 1)
    model = langid.train(docs.where(own))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (~own).alias("held_out"), "language.lang_pred", "language.score")


@query("op2_deleted_interpolation")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(documents(spark, sf_dir))


@query("op11_page_differencing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "main.*")
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_lines", "n_shared")


TERMS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
OP12_SQL = f"""
WITH folded AS (SELECT row_number() OVER () AS row, doc_id,
  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERMS}') AS ts FROM documents),
d AS (SELECT *, len(ts) AS n FROM folded WHERE len(ts) > 0),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(ts) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
items AS (SELECT item_id, text AS item, term, count(*) AS times FROM (SELECT item_id, text,
  unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERMS}')) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
scores AS (SELECT item_id, item, row, doc_id, CAST(sum(times
    * CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n * docs) // terms))))) AS BIGINT) AS score
  FROM items JOIN df USING (term) JOIN tf USING (term), whole GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, item ORDER BY score DESC, doc_id NULLS LAST, row) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op12_reversed_search", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


OP13_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
marked AS (SELECT doc_id, part, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws),
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'),
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails FROM d),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
counts AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM marked LEFT JOIN known USING (doc_id) GROUP BY part, fails),
f AS (SELECT unnest(range(1, 6)) AS f),
orders AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS fs FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
walked AS (SELECT part, fs, step, n, good, toxic, fails, fails[fs[step]] AS fail,
  len(list_filter(fs[:step - 1], lambda x: fails[x])) > 0 AS gone,
  len(list_filter(fails, lambda x: x)) = 1 AS single FROM counts, orders, (SELECT unnest(range(1, 6)) AS step)),
steps AS (SELECT part, array_to_string(list_transform(fs, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step,
  substr('ABCDE', fs[step], 1) AS name,
  coalesce(sum(n) FILTER (NOT fail AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fail AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fail AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fail AND single), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fail AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fail AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM walked GROUP BY part, fs, step)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, name) AS BIGINT) AS shapley FROM steps
"""


@query("op13_filter_paths", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_audit.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return found.select(
        "part", "filter_order", "step", "name", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
