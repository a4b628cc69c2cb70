"""Queries of the rule, detection, quality and comparison families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import rules as R
from ledgerloom.plans.registry import query, table

PROFILES = [
    ("en", "the", 0.5),
    ("en", "of", 0.3),
    ("en", "and", 0.2),
    ("fr", "les", 0.5),
    ("fr", "des", 0.3),
    ("fr", "et", 0.2),
    ("de", "und", 0.5),
    ("de", "der", 0.3),
    ("de", "ist", 0.2),
    ("es", "que", 0.5),
    ("es", "los", 0.3),
    ("es", "una", 0.2),
    ("latin", "et", 0.7),
    ("latin", "de", 0.1)
]
_PROFILE_SQL = ", ".join(f"('{p}', '{v}', {w})" for p, v, w in PROFILES)
_WORDS_SQL = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D.,!?|#*$%&<>]+')"


def _word_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D.,!?|#*$%&<>]+"), F.lit(0)))
    wanted = F.array(*[F.lit(v) for v in sorted({v for _, v, _ in PROFILES})])
    # only signals leave the row
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.lit("word").alias("kind"),
        F.explode(F.filter(words, lambda w: F.array_contains(wanted, F.lower(w)))).alias("value")
    )


@query(f"""WITH p AS (SELECT * FROM (VALUES {_PROFILE_SQL}) t(profile_id, value, weight)), s AS (SELECT DISTINCT doc_id, unnest({_WORDS_SQL}) AS value FROM documents),
c AS (SELECT doc_id, profile_id, least(round(sum(weight), 6), 1.0)::DOUBLE AS confidence FROM s JOIN p ON lower(s.value) = p.value GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, profile_id) AS n, lead(confidence) OVER (PARTITION BY doc_id ORDER BY confidence DESC, profile_id) AS second FROM c),
k AS (SELECT doc_id, arg_min(profile_id, n) AS picked FROM r WHERE confidence >= 0.75 GROUP BY doc_id)
SELECT r.doc_id, profile_id, confidence, coalesce(abs(confidence - second) < 0.05 AND confidence > 0.3, false) AS ambiguous, coalesce(picked, 'generic') AS picked FROM r LEFT JOIN k ON k.doc_id = r.doc_id WHERE n = 1""")
def weighted_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile each document's signals speak for (JN11, AG8, SO5, WN13, RL6)."""
    profiles = R.rule_table(spark, [(p, "word", v, w) for p, v, w in PROFILES], "profile_id string, kind string, value string, weight double")
    scores = R.weighted_scores(_word_signals(spark, sf_dir), ["doc_id"], profiles)
    least = R.rule_table(spark, [(p, 0.75) for p in sorted({p for p, _, _ in PROFILES})], "profile_id string, min_confidence double")
    return R.detected(scores, ["doc_id"], least)


#: tag, code, U(nsupported) or W(arning)
ISSUE_RULES = [
    ("br", "unsupported_environment", "U"),
    ("b", "limited_environment", "W"),
    ("ul", "limited_package", "W"),
    ("script", "unsupported_package", "U"),
    ("nav", "unsupported_environment", "U")
]


@query(f"""WITH r AS (SELECT * FROM (VALUES {", ".join(map(str, ISSUE_RULES))}) t(tag, code, severity)), i AS (SELECT DISTINCT page_id, code, r.tag, severity FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) p JOIN r ON r.tag = p.tag),
m AS (SELECT page_id, len(list_distinct(regexp_extract_all(html, 'class="([^"]*)"', 1)))::BIGINT AS macros FROM pages),
n AS (SELECT m.page_id, macros, count(*) FILTER (severity = 'U') AS u, count(*) FILTER (severity = 'W') AS w FROM m LEFT JOIN i ON i.page_id = m.page_id GROUP BY ALL)
SELECT page_id, u AS unsupported, w + (macros > 0)::INT AS warnings, (100 - least(100, 18 * u + 6 * (w + (macros > 0)::INT) + least(12, 2 * macros)))::BIGINT AS score FROM n""")
def compat_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of each page, once for each code and feature, and its score (RL7, AG9, AG10, AG11, JN16)."""
    pages = table(spark, sf_dir, "pages")
    rules = R.rule_table(spark, ISSUE_RULES, "tag string, code string, severity string")
    found = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1)))).alias("tag")).join(rules, "tag")
    counts = found.groupBy("page_id").agg(F.count_if(F.col("severity") == "U").alias("unsupported"), F.count_if(F.col("severity") == "W").alias("w"))
    macros = pages.select("page_id", F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('class="([^"]*)"'), F.lit(1)))).cast("long").alias("macros"))
    met = macros.join(counts, "page_id", "left").na.fill(0, ["unsupported", "w"])
    return met.select(
        "page_id",
        "unsupported",
        (F.col("w") + F.when(F.col("macros") > 0, 1).otherwise(0)).alias("warnings"),
        R.penalty_score(F.col("unsupported"), F.col("w"), F.col("macros")).alias("score")
    )


@query("""WITH d AS (SELECT d.doc_id, n_chars, quality, toxic, len(string_split(text, chr(10))) AS lines FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
c AS (SELECT doc_id, 'error' AS severity, coalesce(n_chars > 0, false) AS passed FROM d UNION ALL SELECT doc_id, 'error', coalesce(quality = 1, false) FROM d UNION ALL SELECT doc_id, 'warning', coalesce(toxic = 0, false) FROM d UNION ALL SELECT doc_id, 'warning', lines >= 3 FROM d),
n AS (SELECT doc_id, count(*) FILTER (severity = 'error' AND NOT passed) AS e, count(*) FILTER (severity = 'warning' AND NOT passed) AS w, count(*) AS t FROM c GROUP BY doc_id)
SELECT doc_id, CASE WHEN e > 0 THEN 'Failed' WHEN w > 0 THEN 'PassedWithWarnings' ELSE 'Passed' END AS status, t - e AS passed_checks, CASE WHEN e > 0 THEN 1 ELSE 0 END AS exit_code FROM n""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks in long form and the gate over them (Q12, Q13, AG12)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.size(F.split("text", "\n", -1)).alias("lines"))
    met = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    named = {
        "non_empty": ("error", F.col("n_chars") > 0),
        "label": ("error", F.col("quality") == 1),
        "tone": ("warning", F.col("toxic") == 0),
        "lines": ("warning", F.col("lines") >= 3)
    }
    return R.gate(R.checks(met, ["doc_id"], named), ["doc_id"])


_METRICS_SQL = """m AS (SELECT d.doc_id, d.lang, strlen(text) AS bytes, len(string_split(text, chr(10))) AS paragraphs, length(text) - length(translate(text, '#*$%&|<>', '')) AS residue, 100 - least(100, 18 * (coalesce(quality, 1) = 0)::INT + 6 * (coalesce(toxic, 0) = 1)::INT) AS score,
(l.doc_id IS NULL)::INT AS unresolved FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
_GRADE_SQL = """CASE WHEN bytes = 0 THEN 'F' WHEN bytes < 20480 / 64 OR paragraphs < 20 / 10 THEN 'D' WHEN residue > 80 THEN 'D' WHEN score < 60 OR residue > 25 THEN 'C' WHEN unresolved > 20 THEN 'C' WHEN score >= 80 AND residue <= 5 AND unresolved = 0 THEN 'A' ELSE 'B' END"""


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("known", F.lit(True))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        F.octet_length("text").alias("bytes"),
        F.size(F.split("text", "\n", -1)).alias("paragraphs"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).alias("residue")
    )
    met = docs.join(labels, "doc_id", "left")
    score = 100 - F.least(F.lit(100), 18 * (F.coalesce("quality", F.lit(1)) == 0).cast("int") + 6 * (F.coalesce("toxic", F.lit(0)) == 1).cast("int"))
    met = met.select("doc_id", "lang", "bytes", "paragraphs", "residue", score.alias("score"), F.col("known").isNull().cast("int").alias("unresolved"))
    c = F.col
    return met.withColumn("grade", R.grade(c("bytes") > 0, F.lit(0), c("bytes") * 64, c("paragraphs") * 10, c("residue"), c("score"), c("unresolved"))).withColumn(
        "issues",
        F.array_join(R.issues({"small": c("bytes") < 320, "residue": c("residue") > 25, "score": c("score") < 80, "unresolved": c("unresolved") > 0}), ",")
    )


@query(
    f"WITH {_METRICS_SQL} SELECT doc_id, {_GRADE_SQL} AS grade, array_to_string(list_filter([CASE WHEN bytes < 320 THEN 'small' END, CASE WHEN residue > 25 THEN 'residue' END, CASE WHEN score < 80 THEN 'score' END, CASE WHEN unresolved > 0 THEN 'unresolved' END], lambda x: x IS NOT NULL), ',') AS issues FROM m"
)
def grade_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades A to F with the issues that led there (Q14)."""
    return _graded(spark, sf_dir).select("doc_id", "grade", "issues")


@query(
    f"WITH {_METRICS_SQL} SELECT lang, count(*) FILTER (g = 'A') AS a, count(*) FILTER (g = 'B') AS b, count(*) FILTER (g = 'C') AS c, count(*) FILTER (g = 'D') AS d, count(*) FILTER (g = 'F') AS f FROM (SELECT lang, {_GRADE_SQL} AS g FROM m) GROUP BY lang"
)
def grade_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade counts by profile (AG20)."""
    return _graded(spark, sf_dir).groupBy("lang").pivot("grade", ["A", "B", "C", "D", "F"]).count().na.fill(0).toDF("lang", "a", "b", "c", "d", "f")


#: name, priority, position, output: later and higher ones replace earlier ones
RULES = [
    ("click", 0, 0, "InlineText"),
    ("view", 0, 1, "Ignore"),
    ("signup", 0, 2, "Heading"),
    ("signup", 0, 3, "Paragraph"),
    ("view", 1, 0, "Citation"),
    ("click", 2, 0, "AuthorList"),
    ("unused", 0, 4, "Verbatim")
]
_RULES_SQL = f"r AS (SELECT name, arg_max(output, priority * 100 + position) AS output FROM (VALUES {', '.join(map(str, RULES))}) t(name, priority, position, output) GROUP BY name)"


@query(f"""WITH {_RULES_SQL} SELECT event_type, coalesce(output, 'InlineText') AS output, CASE WHEN output IS NULL THEN 'Fallback' ELSE 'Loaded' END AS source, CASE WHEN output IN ('Heading') THEN 'heading' WHEN output IN ('Paragraph', 'Citation', 'AuthorList') THEN 'paragraph' WHEN output = 'Verbatim' THEN 'raw' END AS block,
count(*) AS n, count(DISTINCT user_id) AS users FROM events LEFT JOIN r ON r.name = event_type GROUP BY ALL""")
def rule_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules looked up by name, the last registration holds, unknown names fall back (RL1, RL2, RL4, RL5, JN14, JN15, AG15, SE3)."""
    rules = R.registry(spark.createDataFrame(RULES, "name string, priority int, position int, output string").coalesce(1))
    rows = R.applied(table(spark, sf_dir, "events"), "event_type", rules)
    return rows.groupBy(
        "event_type",
        "output",
        "source",
        R.routed(F.col("output")).alias("block")
    ).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


ALIASES = [("MACHINERY", "nature"), ("FURNITURE", "springer"), ("BUILDING", "missing"), ("nature", "nature")]
SPECS = [("nature", 0.75), ("springer", 0.6), ("AUTOMOBILE", 0.5)]


@query(f"""SELECT c_custkey, coalesce(d.profile_id, s.profile_id) AS profile_id, coalesce(d.c, s.c) AS min_confidence FROM customer LEFT JOIN (VALUES {', '.join(map(str, SPECS))}) d(profile_id, c) ON d.profile_id = c_mktsegment
LEFT JOIN (VALUES {', '.join(map(str, ALIASES))}) a(alias, profile_id) ON a.alias = c_mktsegment LEFT JOIN (VALUES {', '.join(map(str, SPECS))}) s(profile_id, c) ON s.profile_id = a.profile_id""")
def profile_alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name as an id, else as an alias of one (JN20, SRC14)."""
    specs = lambda n: R.rule_table(spark, SPECS, f"{n} string, {n}_c double")
    aliases = R.rule_table(spark, ALIASES, "alias string, canonical string")
    met = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(specs("d"), F.col("d") == F.col("c_mktsegment"), "left").join(aliases, F.col("alias") == F.col("c_mktsegment"), "left").join(specs("s"), F.col("s") == F.col("canonical"), "left")
    return met.select("c_custkey", F.coalesce("d", "s").alias("profile_id"), F.coalesce("d_c", "s_c").cast("double").alias("min_confidence"))



@query(
    """WITH c AS (SELECT conv_id, role AS kind, CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS rank, min(turn) AS turn FROM conversations GROUP BY ALL) SELECT conv_id, arg_min(kind, rank) AS chosen, arg_min(turn, rank) AS turn, count(*) AS available FROM c GROUP BY conv_id"""
)
def ordered_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first available of ranked candidates (SO11, SE2, JN21, JN22)."""
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "role", rank.alias("rank")).agg(F.min("turn").alias("turn"))
    return c.groupBy("conv_id").agg(F.min_by("role", "rank").alias("chosen"), F.min_by("turn", "rank").alias("turn"), F.count("*").alias("available"))


def _vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 100 + 100).alias("v"))
    return scaled.join(scaled.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")


_PAIRS_SQL = "p AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 100 + 100) AS v FROM embeddings), q AS (SELECT p.vec_id, p.v, w.v AS w, len(p.v)::DOUBLE AS n FROM p JOIN p w ON w.vec_id = p.vec_id + 1)"


@query(f"WITH {_PAIRS_SQL} SELECT vec_id, round(list_sum(list_transform(list_zip(v, w), lambda z: abs(z[1] - z[2]))) / n, 6) AS mad FROM q")
def vector_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute difference of consecutive pages (AG18, Q11)."""
    return _vector_pairs(spark, sf_dir).select("vec_id", F.round(R.mean_abs_difference(F.col("v"), F.col("w")), 6).alias("mad"))


@query(f"""WITH {_PAIRS_SQL}, m AS (SELECT vec_id, list_sum(v) / n AS a, list_sum(w) / n AS b, list_sum(list_transform(v, lambda x: x * x)) / n AS aa, list_sum(list_transform(w, lambda x: x * x)) / n AS bb, list_sum(list_transform(list_zip(v, w), lambda z: z[1] * z[2])) / n AS ab FROM q)
SELECT vec_id, round(greatest(0.0, least(1.0, (2 * a * b + 6.5025) * (2 * (ab - a * b) + 58.5225) / ((a * a + b * b + 6.5025) * (aa - a * a + bb - b * b + 58.5225)))), 6) AS ssim FROM m""")
def vector_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural similarity of consecutive pages (AG17, Q11)."""
    return _vector_pairs(spark, sf_dir).select("vec_id", F.round(R.ssim(F.col("v"), F.col("w")), 6).alias("ssim"))


@query(f"""WITH {_PAIRS_SQL}, r AS (SELECT vec_id, v, list_transform(list_zip(v, w), lambda z: z[1] + (z[2] - z[1]) * (vec_id % 10) / 10) AS w, n FROM q),
m AS (SELECT *, list_sum(v) / n AS a, list_sum(w) / n AS b, list_sum(list_transform(v, lambda x: x * x)) / n AS aa, list_sum(list_transform(w, lambda x: x * x)) / n AS bb, list_sum(list_transform(list_zip(v, w), lambda z: z[1] * z[2])) / n AS ab FROM r),
k AS (SELECT vec_id // 8 AS report, (2 * a * b + 6.5025) * (2 * (ab - a * b) + 58.5225) / ((a * a + b * b + 6.5025) * (aa - a * a + bb - b * b + 58.5225)) >= 0.95 AS alike, list_sum(list_transform(list_zip(v, w), lambda z: abs(z[1] - z[2]))) / n <= 3 AS near FROM m)
SELECT report, round(avg(alike::INT), 6) AS ssim_rate, round(avg(near::INT), 6) AS diff_rate FROM k GROUP BY report""")
def visual_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a report's pages that are alike and near, pages between equal and wholly another (Q11)."""
    part = F.col("vec_id") % 10 / 10
    pages = _vector_pairs(spark, sf_dir).withColumn("w", F.zip_with("v", "w", lambda x, y: x + (y - x) * part))
    each = pages.select(F.floor(F.col("vec_id") / 8).alias("report"), (R.ssim(F.col("v"), F.col("w")) >= 0.95).alias("alike"), (R.mean_abs_difference(F.col("v"), F.col("w")) <= 3).alias("near"))
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return each.groupBy("report").agg(share("alike").alias("ssim_rate"), share("near").alias("diff_rate"))


@query(
    """SELECT user_id, day, CASE WHEN count(o) = 0 THEN 'view' WHEN min(o) <> max(o) THEN 'Mixed' ELSE min(o) END AS kind FROM (SELECT user_id, ts::DATE::VARCHAR AS day, CASE WHEN event_type <> 'view' THEN event_type END AS o FROM events) GROUP BY user_id, day"""
)
def page_kind_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each page: one, none or mixed (AG19)."""
    return table(spark, sf_dir, "events").groupBy(
        "user_id",
        F.col("ts").cast("date").cast("string").alias("day")
    ).agg(R.folded_kind(F.col("event_type"), "view").alias("kind"))


THRESHOLDS = [("paragraphs", ">=", 5.0), ("links", "=", 5.0), ("headings", "=", 1.0), ("bytes", "<", 5242880.0)]


@query(f"""WITH m AS (SELECT page_id, unnest(['paragraphs', 'links', 'headings', 'bytes']) AS metric, unnest([len(regexp_extract_all(html, '<p[ >]')), len(regexp_extract_all(html, '<a ')), len(regexp_extract_all(html, '<h1')), strlen(html)])::DOUBLE AS actual FROM pages)
SELECT page_id, m.metric, actual, expected, CASE op WHEN '>=' THEN actual >= expected WHEN '<' THEN actual < expected ELSE actual = expected END AS passed FROM m JOIN (VALUES {', '.join(map(str, THRESHOLDS))}) t(metric, op, expected) ON t.metric = m.metric""")
def structural_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted elements, one row each, against thresholds (Q9, Q10, Q15, AG16, AG22)."""
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("double")
    wide = table(spark, sf_dir, "pages").select(
        "page_id",
        count("<p[ >]").alias("paragraphs"),
        count("<a ").alias("links"),
        count("<h1").alias("headings"),
        F.octet_length("html").cast("double").alias("bytes")
    )
    long = wide.unpivot("page_id", ["paragraphs", "links", "headings", "bytes"], "metric", "actual")
    met = long.join(R.rule_table(spark, THRESHOLDS, "metric string, op string, expected double"), "metric")
    passed = F.when(F.col("op") == ">=", F.col("actual") >= F.col("expected")).when(F.col("op") == "<", F.col("actual") < F.col("expected")).otherwise(F.col("actual") == F.col("expected"))
    return met.select("page_id", "metric", "actual", "expected", passed.alias("passed"))


@query(
    """SELECT r.lang, r.n - l.n AS rows_delta, r.c - l.c AS chars_delta FROM (SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS c FROM documents GROUP BY lang) r JOIN (SELECT d.lang, count(*) AS n, sum(n_chars)::BIGINT AS c FROM documents d JOIN labels USING (doc_id) GROUP BY d.lang) l ON l.lang = r.lang"""
)
def delta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two sides' counts (AG25, AG14, Q16)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    sums = lambda df, s: df.groupBy("lang").agg(F.count("*").alias(f"n_{s}"), F.sum("n_chars").alias(f"c_{s}"))
    both = sums(docs, "r").join(sums(docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id"), "l"), "lang")
    return both.select("lang", (F.col("n_r") - F.col("n_l")).alias("rows_delta"), (F.col("c_r") - F.col("c_l")).alias("chars_delta"))


@query(
    "SELECT p_partkey, abs(p_size - e) / e <= 0.20 AS within, round(p_retailprice * 56.6929133858)::BIGINT AS twips, greatest(p_size, 1) AS span FROM (SELECT *, greatest(p_partkey % 60 / 6.0, 1.0) AS e FROM part)"
)
def unit_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative tolerances, unit conversions, spans of at least one (MA3, MA4, AG24)."""
    e = F.greatest(F.col("p_partkey") % 60 / 6.0, F.lit(1.0))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        (F.abs(F.col("p_size") - e) / e <= 0.20).alias("within"),
        F.round(F.col("p_retailprice") * 56.6929133858).cast("long").alias("twips"),
        F.greatest("p_size", F.lit(1)).alias("span")
    )
