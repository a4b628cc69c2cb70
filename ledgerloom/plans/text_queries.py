"""Queries over text: normal forms, coverage, extraction, sequences, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import graph as G
from ledgerloom.operators import sequences as S
from ledgerloom.plans.registry import query, table
from ledgerloom.sources.needles import contained

_WHITE = T.WHITE
#: DuckDB text of the same normal form.
def _norm(x: str) -> str:
    quotes = "'--''''\"\"'"
    return f"regexp_replace(translate({x}, '{T.DASHES}{T.QUOTES}', {quotes}), '[{_WHITE}]', '', 'g')"


_ODD = ("\u201c", "\u00a0\u2014\u2019")
_ODD_TEXT = f"'{_ODD[0]}' || text || '{_ODD[1]}'"


@query(
    f"SELECT doc_id, length({_norm('(' + _ODD_TEXT + ')')})::BIGINT AS n_normal, CASE WHEN length({_norm('text')}) = 0 THEN 0.0 ELSE round(length({_norm("replace(text, 'e', '')")})::DOUBLE / length({_norm('text')}), 6) END AS ratio, md5({_norm('(' + _ODD_TEXT + ')')}) AS digest FROM documents"
)
def normalize_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized lengths and the ratio of a text without one letter to its whole (ST1, Z1)."""
    odd = F.concat(F.lit(_ODD[0]), F.col("text"), F.lit(_ODD[1]))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.length(T.normalize(odd)).cast("long").alias("n_normal"),
        F.round(T.char_ratio(F.replace("text", F.lit("e"), F.lit("")), F.col("text")), 6).alias("ratio"),
        F.md5(T.normalize(odd)).alias("digest")
    )


@query(
    f"SELECT a.conv_id, a.turn, CASE WHEN length({_norm('b.text')}) = 0 THEN 0.0 ELSE round(length({_norm('a.text')})::DOUBLE / length({_norm('b.text')}), 6) END AS ratio FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"
)
def turn_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio of each turn's whole text to the next turn's (ST5, Z1)."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    pairs = turns.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after")), ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.round(T.char_ratio(F.col("text"), F.col("after")), 6).alias("ratio"))


@query(
    f"SELECT doc_id, regexp_replace(trim(regexp_replace(text, '[{_WHITE}]+', ' ', 'g')), '^(.{{{{60}}}}).+$', '\\1...') AS preview, length(regexp_replace(text, '[{_WHITE}()\\x{{FF08}}\\x{{FF09}}]', '', 'g'))::BIGINT AS n_canonical FROM documents".replace("{{60}}", "{60}")
)
def text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews and canonical lengths (ST2, ST3, ST4)."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        T.preview(F.col("text"), 60).alias("preview"),
        F.length(T.canonical(F.col("text"))).cast("long").alias("n_canonical")
    )


MARKERS = ["License", "reserved", "token", "GNU", "CC BY", "the", "und", "les", "ción"]


@query(
    "SELECT doc_id, sum(hit::INT)::BIGINT AS hits, round(avg(hit::INT), 6) AS coverage FROM (SELECT doc_id, contains(text, m) AS hit FROM documents, (SELECT unnest(" + str(MARKERS) + ") AS m)) GROUP BY doc_id"
)
def marker_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of fixed markers each text holds, in one projection without a join (JN18, AG13, Q7, Q8)."""
    hits = F.size(F.filter(F.array(*[F.lit(m) for m in MARKERS]), lambda m: F.contains(F.col("text"), m)))
    return table(spark, sf_dir, "documents").select("doc_id", hits.cast("long").alias("hits"), F.round(hits / len(MARKERS), 6).alias("coverage"))


@query("SELECT item_id, count(*) AS n_documents, min(doc_id) AS first_doc FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id")
def benchmark_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold each passage verbatim (JN18, JN23)."""
    return contained(
        table(spark, sf_dir, "documents"),
        "text",
        table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle")),
        "needle"
    ).groupBy("item_id").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_doc"))


@query("SELECT coalesce(CASE WHEN lang <> 'es' THEN lang END, '(none)') AS style, source, count(*) AS n FROM documents GROUP BY ALL")
def style_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by style, null as (none) (AG6)."""
    style = F.coalesce(F.when(F.col("lang") != "es", F.col("lang")), F.lit("(none)"))
    return table(spark, sf_dir, "documents").groupBy(style.alias("style"), "source").agg(F.count("*").alias("n"))


@query(
    "SELECT conv_id, string_agg(role || ' x' || n, '; ' ORDER BY role) AS signature FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY conv_id"
)
def run_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset signatures: kinds with their counts, sorted (AG7, MP1)."""
    counts = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    return counts.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("role", F.lit(" x"), "n"))), "; ").alias("signature"))


@query(
    "SELECT doc_id, length(string_agg(regexp_replace(line, '%.*$', ''), chr(10) ORDER BY i))::BIGINT AS n_left, count(*) FILTER (contains(line, '%')) AS n_comments FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) GROUP BY doc_id"
)
def comment_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without comments (ST6)."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.length(T.without_comments(F.col("text"))).cast("long").alias("n_left"),
        F.regexp_count("text", F.lit("%[^\\n]*")).cast("long").alias("n_comments")
    )


@query(r"""SELECT page_id, len(regexp_extract_all(regexp_replace(html, '<[^<>]*>', '', 'g'), '\\[A-Za-z]+|\$[^$\n]+\$|</?[A-Za-z][^<>]*>|&[a-z]+;'))::BIGINT AS residue,
len(regexp_extract_all(html, '\\[A-Za-z]+|\$[^$\n]+\$|</?[A-Za-z][^<>]*>|&[a-z]+;'))::BIGINT AS before FROM pages""")
def residue_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of markup before and after tags are stripped (ST17, ST33)."""
    stripped = F.regexp_replace("html", "<[^<>]*>", "")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        T.residue_count(stripped).cast("long").alias("residue"),
        T.residue_count(F.col("html")).cast("long").alias("before")
    )


@query("""SELECT c_custkey, n AS normal, regexp_replace(regexp_replace(n, '(.{4})', '\\1-', 'g'), '-$', '') AS grouped, CASE WHEN length(n) <= 12 THEN n ELSE left(n, 8) || '****' || right(n, 4) END AS preview, sha256('pepper:' || n) AS hash, right(n, 4) AS batch,
substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', (('0x' || left(sha256(n), 4))::INT >> 11) + 1, 1) || substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', ((('0x' || left(sha256(n), 4))::INT >> 6) & 31) + 1, 1) AS checksum
FROM (SELECT c_custkey, translate(upper(regexp_replace(c_name || ' o-i l', '[\\s-]', '', 'g')), 'OIL', '011') AS n FROM customer)""".replace("\\\\", "\\"))
def redeem_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes: normal form, groups, preview, peppered hash, batch and checksum (ST27-ST30, HS2-HS4)."""
    n = F.col("normal")
    return table(spark, sf_dir, "customer").select("c_custkey", T.code_normal(F.concat("c_name", F.lit(" o-i l"))).alias("normal")).select(
        "c_custkey",
        "normal",
        T.code_grouped(n).alias("grouped"),
        T.code_preview(n).alias("preview"),
        T.peppered(n, "pepper").alias("hash"),
        F.right(n, F.lit(4)).alias("batch"),
        T.code_checksum(n).alias("checksum")
    )


@query("SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of each kind on a page (AG16, AG21)."""
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag")
    ).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


_LINKS = """links AS (SELECT page_id, u.pos::BIGINT AS pos, u.href FROM (SELECT page_id, unnest(list_transform(list_zip(regexp_extract_all(html, 'href="([^"]*)"', 1), range(len(regexp_extract_all(html, 'href="([^"]*)"', 1)))), lambda z: {'href': z[1], 'pos': z[2]})) AS u FROM pages))"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href")
    ).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {_LINKS} SELECT page_id, pos, href, regexp_extract(href, '^https?://([^/]+)', 1) AS host FROM links")
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments of a repeated command in order (ST8, ST11, AR1)."""
    return _links(spark, sf_dir).withColumn("host", F.regexp_extract("href", "^https?://([^/]+)", 1))


@query(
    f"WITH {_LINKS}, l AS (SELECT href, min(page_id) AS target FROM links WHERE pos = 0 GROUP BY href) SELECT page_id, pos, links.href, target IS NOT NULL AS resolved, coalesce(target::VARCHAR, '??') AS target FROM links LEFT JOIN l ON l.href = links.href WHERE pos > 0"
)
def resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later links of pages as references to the first page that begins with one (JN9, JN13, WN3, GR3)."""
    links = _links(spark, sf_dir)
    labels = links.filter("pos = 0").select("href", "page_id", "pos", F.col("page_id").cast("string").alias("value"))
    return G.resolved(links.filter("pos > 0"), labels, "href", ["page_id", "pos"])


@query(f"WITH {_LINKS} SELECT page_id, count(*) AS unresolved FROM links WHERE pos > 0 AND href NOT IN (SELECT href FROM links WHERE pos = 0) GROUP BY page_id")
def unresolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to nothing, counted (JN10, AG14)."""
    links = _links(spark, sf_dir)
    return G.unresolved(links.filter("pos > 0"), links.filter("pos = 0"), "href").groupBy("page_id").agg(F.count("*").alias("unresolved"))


@query(f"""WITH {_LINKS}, num AS (SELECT href, row_number() OVER (PARTITION BY regexp_extract(href, '^https?://([^/]+)', 1) ORDER BY href) AS n FROM (SELECT DISTINCT href FROM links WHERE pos = 0)), hit AS (SELECT DISTINCT page_id, n FROM links LEFT JOIN num USING (href)),
runs AS (SELECT page_id, min(n) AS lo, max(n) AS hi FROM (SELECT page_id, n, n - row_number() OVER (PARTITION BY page_id ORDER BY n) AS g FROM hit WHERE n IS NOT NULL) GROUP BY page_id, g),
txt AS (SELECT page_id, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ',' ORDER BY lo) AS t FROM runs GROUP BY page_id)
SELECT p.page_id, '[' || coalesce(t, '?') || ']' AS citation FROM (SELECT DISTINCT page_id FROM links) p LEFT JOIN txt ON txt.page_id = p.page_id""")
def citation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of numbered entries as compressed ranges, [?] without any (JN12, WN7)."""
    links = _links(spark, sf_dir)
    numbers = links.filter("pos = 0").select("href").distinct().withColumn(
        "n",
        F.row_number().over(Window.partitionBy(F.regexp_extract("href", "^https?://([^/]+)", 1)).orderBy("href"))
    )
    met = links.join(numbers, "href", "left").groupBy("page_id").agg(F.collect_set("n").alias("ns"))
    text = T.compressed_ranges(F.col("ns"))
    return met.select("page_id", F.concat(F.lit("["), F.when(F.size("ns") == 0, "?").otherwise(text), F.lit("]")).alias("citation"))


@query(
    "SELECT conv_id, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ',' ORDER BY lo) AS ranges FROM (SELECT conv_id, min(turn) AS lo, max(turn) AS hi FROM (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations WHERE role = 'user' OR turn < 3) GROUP BY conv_id, g) GROUP BY conv_id"
)
def compress_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers of each group as ranges (WN7)."""
    return S.ranges(table(spark, sf_dir, "conversations").filter("role = 'user' OR turn < 3"), ["conv_id"], "turn")


@query(
    "SELECT user_id, event_type, island, count(*) AS n, min(event_id) AS first_event FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS island FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL"
)
def adjacent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent rows of one kind as one (WN5, WN6)."""
    return S.merged_runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"], n=F.count("*"), first_event=F.min("event_id"))


@query(
    "SELECT event_id, CASE WHEN event_type = 'signup' THEN '(' || n || ')' ELSE n::VARCHAR END AS number FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events)"
)
def running_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running numbers by kind, in brackets for one of them (WN1)."""
    return S.running_numbers(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", equation="signup").select("event_id", "number")


_LEVEL = "CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'click' THEN 3 ELSE 4 END"


@query(f"""WITH e AS (SELECT event_id, user_id, ts, {_LEVEL} AS lv FROM events),
a AS (SELECT *, sum((lv = 1)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n1 FROM e), b AS (SELECT *, sum((lv = 2)::INT) OVER (PARTITION BY user_id, n1 ORDER BY ts, event_id) AS n2 FROM a),
c AS (SELECT *, sum((lv = 3)::INT) OVER (PARTITION BY user_id, n1, n2 ORDER BY ts, event_id) AS n3 FROM b), d AS (SELECT *, sum((lv = 4)::INT) OVER (PARTITION BY user_id, n1, n2, n3 ORDER BY ts, event_id) AS n4 FROM c)
SELECT event_id, array_to_string(([n1, n2, n3, n4]::VARCHAR[])[1:lv], '.') AS number FROM d""")
def heading_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchical numbers, deeper levels begin anew under each heading (WN2)."""
    level = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 3).otherwise(4)
    return S.heading_numbers(table(spark, sf_dir, "events").withColumn("level", level), ["user_id"], ["ts", "event_id"], "level").select("event_id", "number")


@query(
    "SELECT user_id, (arg_min(event_id, event_id)) AS first_event, max(event_id) AS last_event, arg_max(event_type, event_id) AS last_type, arg_min(event_type, event_id) AS first_type FROM events GROUP BY user_id"
)
def first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First definition and last definition of each key (WN3, WN4, Z12)."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    first = S.first_occurrence(events, ["user_id"], ["event_id"]).toDF("user_id", "first_event", "first_type")
    return first.join(S.last_occurrence(events, ["user_id"], ["event_id"]).toDF("user_id", "last_event", "last_type"), "user_id")


@query("""WITH RECURSIVE edges AS (SELECT 'r' || r_regionkey AS parent, 'n' || n_nationkey AS child FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
walk AS (SELECT 'r' || r_regionkey AS node, 0 AS depth FROM region UNION SELECT child, depth + 1 FROM walk JOIN edges ON parent = node) SELECT node, max(depth) AS depth FROM walk GROUP BY node""")
def include_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything reached from the roots, with the depth that orders it topologically (GR1, GR2, SO8)."""
    region, nation, customer = (table(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = nation.select(
        name("r", "n_regionkey").alias("parent"),
        name("n", "n_nationkey").alias("child")
    ).union(customer.select(name("n", "c_nationkey"), name("c", "c_custkey")))
    return G.include_levels(edges, region.select(name("r", "r_regionkey").alias("node")))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal contents by digest (HS1, HS6)."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query("SELECT conv_id, sha256(string_agg(sha256(text), '' ORDER BY turn)) AS cache_key FROM conversations GROUP BY conv_id")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key for each project from the digests of its files in order (HS7)."""
    files = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("d"))
    return files.groupBy("conv_id").agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "d"))), lambda x: x["d"]), ""), 256).alias("cache_key")
    )


@query(
    """SELECT page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped, CASE WHEN lower(url) LIKE '%fig%' THEN 'figure' ELSE 'unknown' END AS kind, len(list_filter(list_transform(string_split(url, '/'), lambda k: trim(k)), lambda k: k <> ''))::BIGINT AS parts FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'Fig:' || url ELSE url END AS url FROM pages)"""
)
def label_and_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escapes, label kinds and trimmed parts (ST25, ST26, ST32, ST11)."""
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("Fig:"), F.col("url"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        T.xml_escaped(url).alias("escaped"),
        F.when(T.label_kind(url) == "figure", "figure").otherwise("unknown").alias("kind"),
        F.size(T.split_keys(F.replace(url, F.lit("/"), F.lit(",")))).cast("long").alias("parts")
    )
