r"""Personal data: keyed surrogates that keep type, format, script and gender, distinctness and coreference.

Detected are e-mail and IPv4 addresses, phone, card and social security numbers, keys (runs of 32 to 64 hex digits) and
names behind a title or with a given name of GIVEN_NAMES, in Latin, Cyrillic and Greek letters.  An entity's canonical form
(case folded; for numbers the digits alone) and the secret key decide its surrogate, so one entity gets one surrogate in
all documents, however it is written, and it is written the way the entity was: separators stay, upper case stays upper
case, digits stay digits, an address keeps its number of labels.  Surrogates can't be real: addresses end in .example, IP
addresses lie in 240.0.0.0/4, card numbers begin with 9 and pass the Luhn test if the entity did.  Names get names of
syllables of their script; given names end as the title or the given name demands, Cyrillic surnames too.  A surname known
in a document is replaced there without a title as well, in whatever case it is written.

Distinctness is checked over the whole corpus: where two entities of a type meet in a surrogate, or a surrogate is an
entity itself, all but the smallest entity (ties can't be, forms are distinct) draw again with the next number, until no
two meet.  Later draws are longer, so there are always enough: names and addresses from the second draw on, numbers from
draw LONGER on, when IPv4 addresses get addresses in 2001:db8::/32 instead.

Null and empty texts stay as they are; texts of any length are read whole.  Rows are told apart by id and text, so repeated
rows and null ids are safe.  All columns of the input stay, but for n_entities and clean_text, which replace any of that
name.  An empty table gives an empty result.

The entities found travel, grouped by kind and form with a minimum taken before the shuffle, and the documents once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm._shared import saved
from ledgerloom.llm.op5_quality_rules import let

#: Titles by gender.
TITLES = {
    "m": ["Mr", "Herr", "Herrn", "Sr", "Señor", "Monsieur", "Don", "Господин"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Sra", "Señora", "Mme", "Madame", "Doña", "Госпожа"],
    "n": ["Dr", "Prof"],
}
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|(?:\+?[0-9]{1,3}[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,4})(?![0-9A-Za-z])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9A-Za-z])"
SECRET = r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,64}(?![0-9A-Za-z])"
_LETTERS = r"\p{IsLatin}\p{IsCyrillic}\p{IsGreek}"
_NAME_WORD = rf"(?=\p{{Lu}})[{_LETTERS}][{_LETTERS}'’-]+"
#: Given names by gender that make a name without a title.
GIVEN_NAMES = {
    "m": "James John Robert Michael William David Thomas Daniel Hans Klaus Jürgen Wolfgang Stefan Matthias Pierre Jacques François Juan José Carlos Luis Miguel Иван Сергей Александр Дмитрий Γιώργος Νίκος".split(),
    "f": "Mary Elizabeth Jennifer Linda Susan Jessica Sarah Emma Anna Ursula Monika Petra Sabine Katrin Françoise Nathalie Isabelle María Carmen Lucía Ana Isabel Мария Ольга Анна Елена Μαρία Ελένη".split(),
}
TITLE = "(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.?"
NAME = rf"(?<!\p{{L}})(?:{TITLE} {_NAME_WORD}(?: {_NAME_WORD})?|(?:" + "|".join(n for ns in GIVEN_NAMES.values() for n in ns) + rf") {_NAME_WORD})"
#: The draw from which on numbers grow.
LONGER = 8
KINDS = {"email": EMAIL, "ip": IP, "secret": SECRET, "ssn": SSN, "card": CARD, "phone": PHONE, "name": NAME}
PATTERN = "(?:" + "|".join(KINDS.values()) + ")"

SYLLABLES = {
    "latin": "ba da fe ga ka la le ma mi na ne no ra ri ro sa se ta te va ve vi za zo",
    "cyrillic": "ба ва га да ка ла ле ма ми на не но ра ри ро са се та те ве ви за зо фа",
    "greek": "βα γα δα κα λα λε μα μι να νε νο ρα ρι ρο σα σε τα τε βε ζα ζο φα χα ψα"
}
ENDINGS = {
    ("given", "m"): {"latin": "n", "cyrillic": "н", "greek": "ς"},
    ("given", "f"): {"latin": "lia", "cyrillic": "лия", "greek": "λια"},
    ("given", "n"): {"latin": "l", "cyrillic": "ль", "greek": "λ"},
    ("surname", "m"): {"latin": "rd", "cyrillic": "ров", "greek": "ρης"},
    ("surname", "f"): {"latin": "rd", "cyrillic": "рова", "greek": "ρη"},
    ("surname", "n"): {"latin": "rd", "cyrillic": "рен", "greek": "ρη"}
}


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn test's sum; a number passes if it is divisible by ten."""
    twice = lambda d: F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.try_cast("int"), lambda d: F.when(i % 2 == 1, twice(d)).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _gender(name: Column) -> Column:
    """That of a known given name, whatever title stands before it, so that a name is one entity with and without titles; else the title's."""
    first, words = F.regexp_extract(name, r"^([^ .]+)", 1), F.initcap(F.get(_name_words(name), F.lit(0)))
    known = lambda word, names: F.when(word.isin(names["m"]), "m").when(word.isin(names["f"]), "f")
    return F.coalesce(known(words, GIVEN_NAMES), known(first, TITLES), F.lit("n"))


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _name_words(name: Column) -> Column:
    return F.split(F.regexp_replace(name, f"^{TITLE} ", ""), " ")


def entity_kind(e: Column) -> Column:
    out = F.when(e.rlike(f"^{EMAIL}$"), "email")
    for kind in list(KINDS)[1:]:
        out = out.when(e.rlike(f"^{KINDS[kind]}$"), kind)
    return out.otherwise("secret")


def parts_of(e: Column) -> Column:
    """The (kind, form) an entity is made of: itself, or a name's words (a woman's and a man's Cyrillic surname are two)."""
    number = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), digits_of(e).alias("form")))
    folded = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), F.lower(e).alias("form")))

    def words(w: Column) -> Column:
        role = lambda i: F.when(i == F.size(w) - 1, "surname").otherwise("given")
        gender = lambda x, i: F.when((role(i) == "surname") & (_script(x) == "latin"), "n").otherwise(_gender(e))
        return F.transform(w, lambda x, i: F.struct(F.concat_ws("-", role(i), gender(x, i), _script(x)).alias("kind"), F.lower(x).alias("form")))

    def by_kind(k: Column) -> Column:
        out = F.when(k == "ip", F.array(F.struct(F.lit("ip").alias("kind"), e.alias("form"))))
        for kind in ("email", "secret"):
            out = out.when(k == kind, folded(kind))
        for kind in ("ssn", "card", "phone"):
            out = out.when(k == kind, number(kind))
        return out.otherwise(let(_name_words(e), words))

    return let(entity_kind(e), by_kind)


def surrogate(key: str, kind: Column, form: Column, attempt: Column) -> Column:
    """The surrogate of a canonical form, itself canonical."""
    hexed = F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(key), kind, form, attempt.cast("string"), F.lit(str(i))), 256) for i in range(2)])

    def drawn(stream: Column) -> Column:
        value = lambda i: F.conv(F.substr(stream, F.pmod(2 * i, F.lit(126)) + 1, F.lit(2)), 16, 10).cast("int")
        letters = lambda x, digits: F.array_join(
            F.transform(
                F.split(x, ""),
                lambda c, i: F.when(c.rlike("[0-9]"), (value(i + digits) % 10).cast("string")).when(c.rlike("[a-z]"), F.chr(97 + value(i + digits) % 26)).otherwise(c)
            ),
            ""
        )
        # later draws are longer, as marks alone can't be drawn anew
        more = F.when(
            attempt > 0,
            F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), lambda i: F.chr(97 + value(i + 47) % 26)), "")
        ).otherwise(F.lit(""))
        digits = F.when(
            attempt >= LONGER,
            F.array_join(F.transform(F.sequence(F.lit(LONGER), F.greatest(attempt, F.lit(LONGER))), lambda i: (value(i + 53) % 10).cast("string")), "")
        ).otherwise(F.lit(""))
        email = F.concat(letters(F.substring_index(form, "@", 1), 0), more, F.lit("@"), letters(F.regexp_extract(form, r"@(.*)\.[^.]*$", 1), 31), F.lit(".example"))
        ip = F.concat_ws(".", (240 + value(F.lit(0)) % 15).cast("string"), *[(value(F.lit(i))).cast("string") for i in (1, 2, 3)])
        ip = F.when(attempt < LONGER, ip).otherwise(F.concat_ws(":", F.lit("2001:db8"), *[F.substring(stream, 4 * i + 1, 4) for i in range(6)]))
        numbers = lambda keep: F.concat(F.substring(form, 1, keep), letters(F.substr(form, F.lit(keep + 1)), 0), digits)
        secret = F.array_join(F.transform(F.split(form, ""), lambda c, i: F.substr(stream, F.pmod(i, F.lit(128)) + 1, F.lit(1))), "")
        head = F.concat(F.lit("9"), letters(F.substr(form, F.lit(2), F.length(form) - 2), 0), digits)
        check = let(
            F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(head, F.lit("0"))), F.lit(10)), F.lit(10)),
            lambda d: F.when(F.pmod(luhn_sum(form), F.lit(10)) == 0, d).otherwise(F.pmod(d + 1 + value(F.lit(60)) % 9, F.lit(10)))
        )
        role, gender, script = (F.split_part(kind, F.lit("-"), F.lit(i)) for i in (1, 2, 3))
        syllable = lambda s, i: F.get(F.array(*[F.lit(x) for x in SYLLABLES[s].split()]), value(F.lit(i)) % 24)
        # later draws are longer, so that there always are enough
        stem = lambda s: F.concat(
            syllable(s, 40),
            syllable(s, 41),
            F.when(role == "surname", F.concat(syllable(s, 42), syllable(s, 43))).otherwise(F.lit("")),
            *[F.when(attempt >= i, syllable(s, 43 + i)).otherwise(F.lit("")) for i in range(1, 9)]
        )
        ending = lambda s: F.coalesce(*[F.when((role == r) & (gender == g), F.lit(e[s])) for (r, g), e in ENDINGS.items()], F.lit(""))
        name = F.when(
            script == "cyrillic",
            F.concat(stem("cyrillic"), ending("cyrillic"))
        ).when(script == "greek", F.concat(stem("greek"), ending("greek"))).otherwise(F.concat(stem("latin"), ending("latin")))
        return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "secret", secret).when(kind == "ssn", numbers(0)).when(kind == "phone", numbers(1)).when(kind == "card", F.concat(head, check.cast("string"))).otherwise(name)

    return let(hexed, drawn)


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, form, surrogate) for the distinct (kind, form) of entities, no two of a kind alike and none of them an entity."""
    forms = saved(entities.select("kind", "form").distinct(), "entities")
    kept = None
    waiting = forms.withColumn("attempt", F.lit(0))
    while True:
        drawn = saved(waiting.withColumn("surrogate", surrogate(key, F.col("kind"), F.col("form"), F.col("attempt"))), "surrogates")
        taken = forms.select("kind", F.col("form").alias("surrogate"))
        if kept is not None:
            taken = taken.union(kept.select("kind", "surrogate")).distinct()
        free = drawn.join(taken.hint("merge"), ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min("form").alias("form")).select("kind", "form", "surrogate")
        kept = saved(won if kept is None else kept.union(won), "kept")
        waiting = drawn.join(kept.select("kind", "form").hint("merge"), ["kind", "form"], "left_anti").select("kind", "form", (F.col("attempt") + 1).alias("attempt"))
        if waiting.isEmpty():
            return kept


def written_like(e: Column, s: Column) -> Column:
    """Surrogate s (canonical) in the format of the entity or name word e."""
    places = F.array_join(
        F.transform(F.split(e, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(s, F.length(digits_of(F.substr(e, F.lit(1), i + 1))), F.lit(1))).otherwise(c)),
        ""
    )
    places = F.concat(places, F.substr(s, F.length(digits_of(e)) + 1))  # a longer surrogate's last digits
    cased = F.when((F.upper(e) == e) & (F.lower(e) != e), F.upper(s)).when(
        e.rlike(r"^\p{Lu}"),
        F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))
    ).otherwise(s)
    return F.when(e.rlike(r"^[0-9 ().+-]+$") & ~e.rlike(f"^{IP}$") & ~e.rlike(f"^{SECRET}$"), places).otherwise(cased)


def with_surrogates(docs: DataFrame, key: str, text: str = "text", doc_key: str = "doc_id") -> DataFrame:
    """docs with n_entities and clean_text; key is the secret that decides the surrogates."""
    docs = docs.drop(*[c for c in ("n_entities", "clean_text") if c not in (text, doc_key)])
    safe = F.coalesce(F.col(text), F.lit(""))
    found = F.regexp_extract_all(safe, F.lit(PATTERN), F.lit(0))
    row = F.struct(F.col(doc_key).cast("string").alias("id"), F.xxhash64(text).alias("hash"))
    parts = saved(docs.select(row.alias("row"), F.explode(F.array_distinct(F.flatten(F.transform(found, parts_of)))).alias("part")).select("row", "part.*"), "parts")
    known = distinct_surrogates(parts, key)
    table = parts.join(known.hint("merge"), ["kind", "form"]).groupBy(F.col("row").alias("__row")).agg(
        F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "kind", "form").alias("k"), "surrogate"))).alias("__known")
    )
    met = docs.withColumn("__own", row).join(table.hint("shuffle_hash"), F.col("__own").eqNullSafe(F.col("__row")), "left").drop("__own", "__row")
    k = F.col("__known")

    def replaced(e: Column) -> Column:
        def by_parts(ps: Column) -> Column:
            one = lambda p, word: written_like(word, F.coalesce(F.try_element_at(k, F.concat_ws(":", p["kind"], p["form"])), word))
            name = F.concat(F.regexp_extract(e, f"^({TITLE} )", 1), F.array_join(F.zip_with(ps, _name_words(e), one), " "))
            return F.when(F.get(ps, F.lit(0))["kind"].rlike("^(given|surname)-"), name).otherwise(one(F.get(ps, F.lit(0)), e))

        return let(parts_of(e), by_parts)

    # the longest first, so that a name goes before one it begins with
    surnames = F.transform(
        F.filter(F.map_entries(k), lambda x: x["key"].startswith("surname-")),
        lambda x: F.struct(F.split_part(x["key"], F.lit(":"), F.lit(2)).alias("form"), x["value"].alias("value"))
    )
    surnames = F.reverse(F.array_sort(F.transform(surnames, lambda x: F.struct(F.length(x["form"]).alias("n"), x["form"].alias("form"), x["value"].alias("value")))))

    def bare(segment: Column, names: Column) -> Column:
        """A segment between entities with the document's surnames replaced."""
        pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.transform(names, lambda x: x["form"]), "|"), F.lit(r")(?!\p{L})"))
        known = lambda form: F.get(F.filter(names, lambda x: x["form"] == form), F.lit(0))["value"]
        other = lambda m: written_like(m, F.coalesce(known(F.lower(m)), known(F.lower(F.upper(m))), m))
        both = F.zip_with(
            F.split(segment, pattern, -1),
            F.transform(F.regexp_extract_all(segment, pattern, F.lit(0)), other),
            lambda s, m: F.concat(s, F.coalesce(m, F.lit("")))
        )
        return F.when(F.size(names) > 0, F.array_join(both, "")).otherwise(segment)

    def rebuilt(es: Column) -> Column:
        between = lambda names: F.transform(F.split(safe, PATTERN, -1), lambda s: bare(s, names))
        mixed = lambda segments: F.zip_with(segments, F.transform(es, replaced), lambda s, r: F.concat(s, F.coalesce(r, F.lit(""))))
        return F.struct(F.size(es).alias("n"), F.array_join(mixed(let(surnames, between)), "").alias("text"))

    made = F.when(k.isNotNull(), let(found, rebuilt))
    out = met.withColumn("__made", made).withColumns(
        {"n_entities": F.coalesce(F.col("__made.n"), F.lit(0)).cast("long"), "clean_text": F.coalesce(F.col("__made.text"), F.col(text))}
    )
    return out.drop("__known", "__made")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_entities, clean_text; the secret is the session's ledgerloom.pii.key, if it has one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    key = spark.conf.get("ledgerloom.pii.key", "surrogates of these documents")
    return with_surrogates(docs, key=key).select("doc_id", "n_entities", "clean_text")
