"""Quality rules, line first: rules are evaluated for each line, failing lines go, and so do documents that lose too much.

A line with words fails by
* navigation: at least two separators (`|`, `>`, `»`, `›`, `•`) and one for every three words;
* symbols: more than one of `#*$%&|<>` for every two words;
* shouting: at least ten A-Z letters and more of them than a-z;
* punctuation: more exclamation and question marks than one for every two words, or fewer than MIN_LINE_WORDS words and
  no terminal punctuation;
* bullets: a bullet in front, fewer than MIN_BULLET_WORDS words and no terminal punctuation;
* ellipsis: dots at the end and at most BOILERPLATE_WORDS words, as teasers have;
* boilerplate: one of BOILERPLATE, between characters that are no letters or digits, and at most BOILERPLATE_WORDS words.
Lines without words stay.  A document is rejected when its text fails the base rules (fewer than MIN_WORDS words, or
more than half of them in repeated windows of three), or when the lines left hold less than MIN_KEPT_PERCENT of its words.
Thresholds are sharp: a document with exactly MIN_WORDS words, half of them repeated, or MIN_KEPT_PERCENT left is kept.

Null and empty texts have no words and are rejected; null stays null.  All columns of the input stay, but for those
the operator makes, which replace any of that name.  Every row is judged by itself and as a whole, so repeated rows get
one verdict, texts may have any length, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
SYMBOLS, SEPARATORS = "#*$%&|<>", "|>»›•"
MIN_WORDS, MIN_KEPT_PERCENT, BOILERPLATE_WORDS = 50, 50, 20
MIN_LINE_WORDS, MIN_BULLET_WORDS = 3, 5
#: What navigation, cookie banners and footers say in the languages of the corpus.
BOILERPLATE = (
    "accept cookies", "add to cart", "all rights reserved", "click here", "cookie policy", "enable javascript", "forgot your password",
    "lorem ipsum", "powered by", "privacy policy", "read more", "share this", "sign in", "sign up", "skip to content", "subscribe to our",
    "terms of service", "terms of use",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "in den warenkorb", "hier klicken", "jetzt anmelden", "passwort vergessen", "weiterlesen",
    "accepter les cookies", "ajouter au panier", "cliquez ici", "lire la suite", "mentions légales", "mot de passe oublié", "politique de confidentialité", "tous droits réservés",
    "aceptar cookies", "aviso legal", "añadir al carrito", "haga clic aquí", "iniciar sesión", "leer más", "política de privacidad", "todos los derechos reservados",
)
_BOILERPLATE = r"(?:^|[^\p{L}\p{N}])(?:" + "|".join(BOILERPLATE) + r")(?:\z|[^\p{L}\p{N}])"
_TERMINAL, _BULLET, _ELLIPSIS = r"[.!?:;…\"'»”’)\]][\x20\x09-\x0D]*\z", r"^[\x20\x09-\x0D]*[•·‣▪*–-][\x20\x09-\x0D]", r"(?:…|[.]{3})[\x20\x09-\x0D]*\z"
_MARK, _TEN_CAPITALS = r"[#*$%&|<>»›•!?]", r"^[^A-Z]*+(?:[A-Z][^A-Z]*+){10}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WHITE, -1), lambda w: w != "")


def count_of(text: Column, characters: str) -> Column:
    """How many of a text's characters are among `characters`, few of which a text usually has."""
    return F.regexp_count(text, F.lit(f"[{characters}]"))


def line_fails(line: Column) -> Column:
    """Whether a line fails one of the rules.  What most lines don't have is asked for before anything is counted."""

    def marks(n: Column) -> Column:
        separators = count_of(line, SEPARATORS)
        return let(separators, lambda k: (k >= 2) & (3 * k >= n)) | (2 * count_of(line, SYMBOLS) > n) | (2 * count_of(line, "!?") > n)

    def rules(n: Column) -> Column:
        return (n > 0) & (
            (line.rlike(_MARK) & marks(n))
            | (line.rlike(_TEN_CAPITALS) & (count_of(line, "A-Z") > F.length(F.regexp_replace(line, "[^a-z]+", ""))))
            | ((n < MIN_LINE_WORDS) & ~line.rlike(_TERMINAL))
            | ((n < MIN_BULLET_WORDS) & line.rlike(_BULLET) & ~line.rlike(_TERMINAL))
            | ((n <= BOILERPLATE_WORDS) & (line.rlike(_ELLIPSIS) | line.rlike("(?iu)" + _BOILERPLATE)))
        )

    return let(F.regexp_count(line, F.lit(WORD)), rules)


def repeated_words(words: Column, size: int = 3) -> Column:
    """Words covered by windows of `size` words that occur twice or more among `words`.

    Most texts have no two equal windows, which a set of their hashes tells.  In the others windows are sorted by hash with
    their places, so that equal ones are neighbours: n log n for a text of n words.
    """
    last = F.size(words) - size
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    windows = lambda hs: F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    same = lambda s, i, j: F.get(s, i)["h"].eqNullSafe(F.get(s, j)["h"])
    places = lambda s: F.array_sort(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ((i > 0) & same(s, i, i - 1)) | ((i + 1 < F.size(s)) & same(s, i, i + 1))),
            lambda i: F.get(s, i)["p"]
        )
    )
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(size), p - a["end"] + size)).alias("n"), (p + size).alias("end"))
    # a window adds the words behind the end of the one before it
    covered = lambda ps: F.aggregate(ps, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"])
    among = lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(windows(hs), lambda s: let(places(s), covered)))
    return F.when(last < 1, F.lit(0)).otherwise(let(hashes, among))


def with_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept_words, kept, clean_text."""
    t = F.col(text)
    safe = F.coalesce(t, F.lit(""))
    word_lines = lambda lines: F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    measured = docs.withColumns(
        {
            "__words": let(words_of(safe), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("repeated"))),
            "word_chars": F.length(F.regexp_replace(safe, WHITE, "")).cast("long"),
            "n_symbols": count_of(safe, SYMBOLS).cast("long"),
            "__lines": let(
                F.split(safe, "\n", -1),
                lambda lines: F.struct(
                    let(word_lines(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"),
                    F.array_join(F.filter(lines, lambda x: ~line_fails(x)), "\n").alias("clean"),
                ),
            ),
        }
    )
    n = F.col("__words.n")
    full = measured.withColumns(
        {
            "n_words": n,
            "n_dup_lines": F.col("__lines.dup"),
            "n_repeat_words": F.col("__words.repeated"),
            "base_failed": (n < MIN_WORDS) | (100 * F.col("__words.repeated") > 50 * n),
            "kept_words": F.regexp_count("__lines.clean", F.lit(WORD)).cast("long"),
            "clean_text": F.when(t.isNotNull(), F.col("__lines.clean")),
        }
    )
    return full.withColumn("kept", ~F.col("base_failed") & (100 * F.col("kept_words") >= MIN_KEPT_PERCENT * n)).drop("__words", "__lines")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the measures, base_failed and kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept_words", "kept")


_LINE_WORDS = r"len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda w: w <> ''))"


def _sql_count(column: str, characters: str) -> str:
    return f"(length({column}) - length(translate({column}, '{characters}', '')))"


def _sql_text(x: str) -> str:
    """A literal of SQL text that goes through str.format."""
    return "'" + x.replace("'", "''").replace("{", "{{").replace("}", "}}") + "'"


#: Common table expressions that end in `quality`, over the table `{docs}` with doc_id and text.
QUALITY_SQL = rf"""
t AS (SELECT doc_id, coalesce(text, '') AS s, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM {{docs}}),
lines AS (SELECT doc_id, s, words, string_split(s, chr(10)) AS all_lines, list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS word_lines FROM t),
clean AS (
  SELECT *, list_filter(all_lines, lambda x: NOT ({_LINE_WORDS} > 0 AND (
      ({_sql_count("x", SEPARATORS)} >= 2 AND 3 * {_sql_count("x", SEPARATORS)} >= {_LINE_WORDS})
      OR 2 * {_sql_count("x", SYMBOLS)} > {_LINE_WORDS}
      OR 2 * {_sql_count("x", "!?")} > {_LINE_WORDS}
      OR (length(regexp_replace(x, '[^A-Z]+', '', 'g')) >= 10 AND length(regexp_replace(x, '[^A-Z]+', '', 'g')) > length(regexp_replace(x, '[^a-z]+', '', 'g')))
      OR ({_LINE_WORDS} < {MIN_LINE_WORDS} AND NOT regexp_matches(x, {_sql_text(_TERMINAL)}))
      OR ({_LINE_WORDS} < {MIN_BULLET_WORDS} AND regexp_matches(x, {_sql_text(_BULLET)}) AND NOT regexp_matches(x, {_sql_text(_TERMINAL)}))
      OR ({_LINE_WORDS} <= {BOILERPLATE_WORDS} AND (regexp_matches(x, {_sql_text(_ELLIPSIS)}) OR regexp_matches(x, {_sql_text("(?i)" + _BOILERPLATE)})))))) AS kept_lines
  FROM lines),
grams AS (SELECT doc_id, i, words[i:i+2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM t WHERE len(words) > 2)),
marked AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) > 1 AS twice FROM grams),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM marked WHERE twice) GROUP BY doc_id),
measured AS (
  SELECT c.doc_id, s, len(words)::BIGINT AS n_words, length(regexp_replace(s, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    {_sql_count("s", SYMBOLS)}::BIGINT AS n_symbols, (len(word_lines) - len(list_distinct(word_lines)))::BIGINT AS n_dup_lines,
    coalesce(v.n, 0)::BIGINT AS n_repeat_words, array_to_string(kept_lines, chr(10)) AS clean_text
  FROM clean c LEFT JOIN covered v ON v.doc_id = c.doc_id),
judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    len(list_filter(string_split_regex(clean_text, '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS kept_words
  FROM measured),
quality AS (SELECT *, NOT base_failed AND 100 * kept_words >= {MIN_KEPT_PERCENT} * n_words AS kept FROM judged)
"""

ORACLE = f"WITH {QUALITY_SQL.format(docs='documents')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept_words, kept FROM quality"
