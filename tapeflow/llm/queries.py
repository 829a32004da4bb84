"""One registered query for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeflow.llm import decontaminate, divergence, language, lm, mixture, near_duplicates, neighbours, periodic, pii, quality, simhash, substrings, token_files
from tapeflow.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


@query("op1_quality")
def op1(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    model = quality.train(docs, table(spark, d, "labels"))
    return quality.scored(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", quality.FOLDS) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op4_contaminated", f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS_SQL} AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS w
  FROM (SELECT item_id, ws, least(10, len(ws)) AS m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS ws FROM documents),
own AS (SELECT r, m, i, array_to_string(ws[i:i + m - 1], ' ') AS w
  FROM (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(ws) >= m)),
hit AS (SELECT own.r, own.i, own.m, win.item_id FROM own JOIN win ON win.m = own.m AND win.w = own.w),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, i, m FROM hit)) GROUP BY r),
k AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN k USING (r)""")
def op4(spark: SparkSession, d: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op8_language")
def op8(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return language.predicted(docs, *language.prototypes(docs))


@query("op3_nearest")
def op3(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op6_personal_data")
def op6(spark: SparkSession, d: str) -> DataFrame:
    found = pii.detected(table(spark, d, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).select("doc_id", "spans")
    base = pii.KINDS[:4]

    def count(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in base], F.sha2(pii.joined(F.filter("spans", lambda s: s.kind.isin(base))), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def _dealt_sql(name: str, parents: list[str], level: str, weights: str, above: str) -> str:
    """Budgets of one level of the tree, by the water level of each parent."""
    keys, by = ", ".join([*parents, level]), ", ".join([*parents, "goal"])
    return f"""
{name}_n AS (SELECT {keys}, goal, w, CASE WHEN w > 0 THEN supply ELSE 0 END AS supply FROM (
  SELECT *, {weights} AS w FROM (SELECT {keys}, sum(tokens) * 2.0::DOUBLE AS supply FROM leaf GROUP BY {keys}) {above})),
{name}_l AS (SELECT *, CASE WHEN after > 0 THEN greatest(0, goal - coalesce(before, 0)) / after ELSE 0 END AS lev FROM (
  SELECT *, sum(supply) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
  FROM {name}_n WINDOW o AS (PARTITION BY {by} ORDER BY CASE WHEN w > 0 THEN supply / w ELSE 0 END, {level}))),
{name} AS (SELECT {keys}, CASE WHEN supply <= lev * w THEN supply ELSE least(supply, water * w) END AS goal FROM (
  SELECT *, max(CASE WHEN NOT supply <= lev * w THEN lev END) OVER (PARTITION BY {by}) AS water FROM {name}_l))"""


def _case(level: str) -> str:
    known = mixture.Plan().weights[level]
    return f"CASE {level} {' '.join(f"WHEN '{k}' THEN {v}" for k, v in known.items())} ELSE 1.0 END::DOUBLE" if known else "1.0::DOUBLE"


@query("op7_mixture", """
WITH d AS (SELECT *, 'd' || (('0x' || substr(md5(origin), 1, 8))::BIGINT % 4) AS domain FROM (
  SELECT doc_id, lang, source, coalesce(lang, 'unknown') AS language, coalesce(source, 'unknown') AS origin, coalesce(CAST(ceil(strlen(text) / 4.0) AS BIGINT), 0) AS n_tokens FROM documents)),
leaf AS (SELECT domain, language, origin, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d WHERE n_tokens > 0 GROUP BY 1, 2, 3),""" + ",".join([
    _dealt_sql("top", [], "domain", _case("domain"), ", (SELECT floor(sum(tokens) * 0.5)::DOUBLE AS goal FROM leaf)"),
    _dealt_sql("mid", ["domain"], "language", _case("language"), "JOIN (SELECT domain, goal FROM top) USING (domain)"),
    _dealt_sql("low", ["domain", "language"], "origin", _case("origin"), "JOIN (SELECT domain, language, goal FROM mid) USING (domain, language)")]) + """,
plan AS (SELECT domain, language, origin, tokens, b // tokens AS epochs, b % tokens AS rest
  FROM (SELECT *, CAST(floor(goal + 1e-6) AS BIGINT) AS b FROM leaf JOIN low USING (domain, language, origin))),
p AS (SELECT d.*, epochs, rest, ('0x' || substr(md5('7-' || (epochs + 1) || '-' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS place
  FROM d LEFT JOIN plan USING (domain, language, origin)),
u AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, origin ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto,
  sum(n_tokens) OVER (PARTITION BY domain, language, origin, place) AS same FROM p WHERE n_tokens > 0 AND rest > 0),
cut AS (SELECT domain, language, origin, min(CASE WHEN 2 * upto - same <= 2 * rest THEN place ELSE place - 1 END) AS cutoff FROM u WHERE upto >= rest AND upto - same < rest GROUP BY 1, 2, 3)
SELECT doc_id, domain, lang, source, n_tokens, CAST(CASE WHEN n_tokens > 0 THEN coalesce(epochs, 0) + coalesce(CAST(place <= cutoff AS INTEGER), 0) ELSE 0 END AS INTEGER) AS copies
FROM p LEFT JOIN cut USING (domain, language, origin)""")
def op7(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixed(table(spark, d, "documents").select("doc_id", "text", "lang", "source")).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


@query("op10_token_files")
def op10(spark: SparkSession, d: str) -> DataFrame:
    return token_files.encoded(table(spark, d, "documents"))


@query("op9_lm_score")
def op9(spark: SparkSession, d: str) -> DataFrame:
    return lm.scored(table(spark, d, "documents"))


@query("op2_repeated_substrings")
def op2(spark: SparkSession, d: str) -> DataFrame:
    return substrings.without_repeats(table(spark, d, "documents"), keep_text=False).drop("kept")


@query("op5_jaccard_join", f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents WHERE doc_id IS NOT NULL),
key AS (SELECT doc_id, md5(array_to_string(ws, ' ')) AS k FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
link AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
class AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
copies AS (SELECT k, count(*) AS n FROM key GROUP BY 1),
deg AS (SELECT a, count(*) AS n_links, count(DISTINCT CASE WHEN kb.k <> ka.k THEN kb.k END) AS n_similar FROM link JOIN key ka ON ka.doc_id = a JOIN key kb ON kb.doc_id = b GROUP BY 1)
SELECT d.doc_id, coalesce(class.c, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_similar, 0) AS n_similar, coalesce(copies.n, 1) AS n_copies, CAST(1 AS BIGINT) AS n_rows
FROM d LEFT JOIN class ON class.a = d.doc_id LEFT JOIN deg ON deg.a = d.doc_id LEFT JOIN key USING (doc_id) LEFT JOIN copies USING (k)""")
def op5(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.joined(table(spark, d, "documents"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, d: str) -> DataFrame:
    found = periodic.detected(table(spark, d, "documents").select("doc_id", "text"), seed=F.crc32(F.col("doc_id").cast("string").cast("binary")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    length, period = best.getField("length"), -best.getField("period")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-best.getField("start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_simhash")
def op12(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.components(table(spark, d, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op13_source_divergence", f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {TERMS_SQL} AS ws FROM documents),
w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
size AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY 1),
own AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
  1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (coalesce(own.total, 0) + 5 * size.v)::HUGEINT AS p,
  1 + (1000000000 * (kept.lang_n + 5)::HUGEINT) // (size.total + 5 * size.v)::HUGEINT AS q
  FROM g JOIN size USING (lang) JOIN kept USING (lang) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pair.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms) WHERE rank <= 50""")
def op13(spark: SparkSession, d: str) -> DataFrame:
    return divergence.audited(table(spark, d, "documents"))
