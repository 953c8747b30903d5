"""PII surrogates: detected entities get keyed replacements of the same type, gender, script and format.

A surrogate is drawn from SHA-256 over key, kind, entity and attempt, so an entity gets the same one wherever it
stands, in any of its spellings. All distinct entities of the input are drawn once and checked: where two draw
the same surrogate, all but the first draw again, and so does each that draws what is an entity of the input itself,
until all are distinct and none is real. Entities that needed more than one attempt are few; they go to the texts as a
constant while they are at most INLINE, else by a join on the entities of each text.

Kinds: email, card, ssn, phone, ip, and given and family names (their gender is that of the title, of a listed given
name, or of their ending). Digits stay digits and separators stay; a card keeps its first digit and its Luhn
validity, a phone number its country code or leading zero; names keep script (Latin, Cyrillic), gender and capitals;
an email keeps the presence of digits and moves to a reserved domain.

A name is one or two capitalised words after a title, or one after a listed given name. A card is any run of 13 to 19
digits with single spaces or hyphens between them, whether or not its check digit holds, so lists of short numbers
can be taken for one. A phone number starts with a plus or 00, or is of the separated 3-3-4 shape, or has a leading
zero and two or more groups. Numbers with different country codes are different entities; one with a leading zero is not
linked to its form with a country code, as the country is unknown. Not detected: phone numbers in other national
shapes, cards with other separators, names without a title or listed given name, postal addresses, bank accounts,
identity numbers other than the ssn, IPv6.

Rules for odd input: null text stays null; an empty text stays empty; a very long text is searched whole, in one task's
memory, in time in proportion to its length; where two kinds fit one place, the first in the order email, ip, ssn, phone,
card, name wins; repeated rows each give a row with the same surrogates; an empty table gives no rows; columns other
than the text pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import input_columns, materialize, scratch, unused
from .expressions import at, let, matches, numbers

#: Entities with a second attempt that travel as a constant; and the most attempts.
INLINE = 256
ATTEMPTS = 30

#: Titles and the gender that they tell.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "г-жа", "госпожа")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "господин")
#: Given names that need no title before them, by gender; none that is also a common word.
GIVEN_FEMALE = (
    "Alice", "Amélie", "Ana", "Andrea", "Anna", "Barbara", "Beatriz", "Camille", "Carmen", "Caroline", "Catherine", "Charlotte", "Chloé", "Claudia", "Elena", "Elizabeth", "Emily", "Emma",
    "Fatima", "Franziska", "Hannah", "Heike", "Ingrid", "Isabel", "Jennifer", "Jessica", "Julia", "Karen", "Katharina", "Laura", "Linda", "Lucía", "Margaret", "Maria", "María", "Marie",
    "Mary", "Nathalie", "Olga", "Olivia", "Patricia", "Petra", "Sabine", "Sarah", "Sofia", "Sophie", "Susan", "Ursula", "Анна", "Елена", "Мария", "Наталья", "Ольга", "Татьяна",
)
GIVEN_MALE = (
    "Alejandro", "Alexander", "Andreas", "Antoine", "Antonio", "Carlos", "Charles", "Daniel", "David", "Diego", "Edward", "Etienne", "Felipe", "Fernando", "François", "George", "Guillaume",
    "Hans", "Heinrich", "James", "Javier", "Jean", "John", "Joseph", "José", "Juan", "Jürgen", "Karl", "Klaus", "Laurent", "Luis", "Manuel", "Matthew", "Michael", "Miguel", "Mohammed", "Nicolas",
    "Pablo", "Paul", "Pedro", "Peter", "Philippe", "Pierre", "Richard", "Robert", "Stefan", "Steven", "Thomas", "William", "Wolfgang", "Александр", "Дмитрий", "Иван", "Михаил", "Сергей",
)

# A run of letters is tried once, at its start, and never again from inside: time stays linear in long texts without spaces.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IP = rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])"
# Usual groupings; any grouping of 13 to 19 digits that stand alone; else, in longer runs, any grouping that starts before no usual one.
USUAL = r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{3}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{8}[ -][0-9]{8}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9])(?![0-9])"
GROUPED = r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
CARD = rf"(?<![0-9])(?:(?<![0-9][ -]){GROUPED}(?![ -][0-9])|{USUAL}|(?!(?:[0-9]{{1,18}}[ -]){{1,18}}{USUAL}){GROUPED})"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
# After a plus or 00: ten digits after 1, else 8 to 15 digits with the country code; without one 3-3-4, or groups after a zero.
DIGIT = r"[ ./\u00a0\u202f-]?\(?[0-9]\)?"
LOCAL = r"(?:\+[0-9]{1,3}[ .-]?)?(?<![0-9])(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
TRUNK = r"(?<![0-9][ ./-])(?:0[1-9](?:[ .-][0-9]{2}){4}|0[1-9][0-9]{1,3}[ /-][0-9]{3,4}[ -][0-9]{3,4}|0[1-9][0-9]{1,3}[ /][0-9]{6,8})(?![ ./-]?[0-9])"
PHONE = rf"(?<![0-9])(?:\+|00)(?:1(?:{DIGIT}){{10}}|[2-9](?:{DIGIT}){{7,14}})(?![0-9])|{LOCAL}|(?<![0-9]){TRUNK}"
#: Country codes; a trunk zero after them stays too.
CODE = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
CODED = "^[0-9]+-"
TITLE = rf"(?:{'|'.join(FEMALE + MALE)})\.? "
GIVEN = rf"(?:{'|'.join(GIVEN_FEMALE + GIVEN_MALE)})"
WORD = r"[\p{Lu}][\p{L}'-]+"
# Most capitals are followed by a small word: that is looked at before any list of names.
BEFORE = r"(?=[\p{L}-]+\.? \p{Lu})"
NAME = rf"(?<![\p{{L}}]){BEFORE}(?:{TITLE}{WORD}(?: {WORD})?|{GIVEN} {WORD})"
#: What a name or title begins with, as ranges: the class is tried at every place of a text.
_HEADS = "A-ZÀ-ÞА-Яг"
KINDS = {"email": EMAIL, "ip": IP, "ssn": SSN, "phone": PHONE, "card": CARD, "name": NAME}
#: All kinds but emails; what a number or a name can begin with is looked at first, so that other places cost one step.
PLAIN = rf"(?=[0-9+(])(?:{'|'.join(KINDS[k] for k in ('ip', 'ssn', 'phone', 'card'))})|(?=[{_HEADS}]){NAME}"
#: All kinds, for texts with an @.
ANY = rf"{EMAIL}|{PLAIN}"

CYRILLIC = "бцдфгхйклмнпрствзаеиоу"
LATIN = "bcdfghjklmnprstvzaeiou"


def kind_of(match: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed([kv for kv in KINDS.items() if kv[0] != "name"]):
        out = F.when(match.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _name_words(match: Column) -> Column:
    return F.split(F.regexp_replace(match, f"^{TITLE}", ""), " ", -1)


def _gender(match: Column) -> Column:
    """That of the title, else of the listed name."""
    listed = match.rlike(rf"^(?:{'|'.join(GIVEN_FEMALE)}) ") & ~match.rlike(f"^{TITLE}")
    return F.when(match.rlike(rf"^(?:{'|'.join(FEMALE)})\b") | listed, "f").otherwise("m")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "c").otherwise("l")


def entities(match: Column) -> Column:
    """The entities of a match: one, but for a name, whose words are entities of their own."""

    def of(kind: Column) -> Column:
        digits = _digits(match)
        abroad = F.regexp_replace(digits, "^00", "")
        code = F.regexp_extract(abroad, CODE, 0)
        # Country code (or zero), hyphen, number; without the code where it is that of the 3-3-4 shape.
        phone = F.when(match.startswith("+") | match.startswith("00"), F.when(abroad.rlike("^1[0-9]{10}$"), F.substring(abroad, 2, 10)).otherwise(F.concat(code, F.lit("-"), F.regexp_replace(abroad, CODE + "0?", ""))))
        phone = phone.when(match.rlike(f"^{TRUNK}$"), F.concat(F.lit("0-"), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(F.substring(digits, -10, 10))
        canonical = F.when(kind == "email", F.lower(match)).when(kind == "phone", phone).when(kind == "ip", match).otherwise(digits)
        one = F.array(F.struct(kind.alias("kind"), canonical.alias("id")))
        named = let(_name_words(match), lambda w: F.transform(w, lambda x, i: F.struct(
            F.when(i < F.size(w) - 1, F.concat(F.lit("given_"), _gender(match), F.lit("_"), _script(x))).otherwise(
                F.concat(F.lit("family_"), _script(x), F.when(x.rlike("(?:ова|ева|ина|ая)$"), "_f").otherwise(""))).alias("kind"),
            F.lower(x).alias("id"),
        )))
        return F.when(kind == "name", named).otherwise(one)

    return let(kind_of(match), of)


def _hex(key: str, entity: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), entity["kind"], entity["id"], attempt.cast("string")), 256)


def _decimal(hexed: Column) -> Column:
    """48 decimal digits of a hash."""
    return F.concat(*[F.lpad(F.substring(F.conv(F.substring(hexed, 1 + 15 * k, 15), 16, 10), -12, 12), 12, "0") for k in range(4)])


def _syllables(hexed: Column, first: int, n: int) -> Column:
    """Consonant-vowel syllables, one for every two hex digits."""
    pairs = [F.concat(F.translate(F.substring(hexed, first + 2 * k, 1), "0123456789abcdef", "bcdfghjklmnprstv"), F.translate(F.substring(hexed, first + 2 * k + 1, 1), "0123456789abcdef", "aeiouaeiouaeioua")) for k in range(n)]
    return F.concat(*pairs)


def surrogate(key: str, entity: Column, attempt: Column) -> Column:
    """The canonical surrogate: digits for numbers, a lower-case word for names, an address for emails and IPs."""

    def drawn(h: Column) -> Column:
        kind, own, d = entity["kind"], entity["id"], _decimal(h)
        email = F.concat(_syllables(h, 1, 5), F.when(own.rlike("^[^@]*[0-9]"), F.concat(F.lit("."), F.substring(d, 1, 2))).otherwise(""), F.lit("@"), F.translate(F.substring(h, 20, 6), "0123456789abcdef", "bcdfghjklmnprstv"), F.lit(".example.org"))
        ip = F.concat_ws(".", (F.conv(F.substring(h, 1, 4), 16, 10).cast("int") % 223 + 1).cast("string"), *[F.conv(F.substring(h, 5 + 2 * k, 2), 16, 10) for k in range(3)])
        card = F.concat(F.substring(own, 1, 1), F.substring(d, F.lit(1), F.length(own) - 2))
        card = let(card, lambda c: F.concat(c, F.when(_luhn(own) == 0, ((10 - _luhn(F.concat(c, F.lit("0"))) % 10) % 10).cast("string")).otherwise(F.substring(d, 40, 1))))
        ssn = F.concat(F.lit("9"), F.substring(d, 1, 8))
        phone = F.concat(F.regexp_extract(own, CODED, 0), F.translate(F.substring(d, 1, 1), "01", "23"), F.substring(d, F.lit(2), F.length(F.regexp_replace(own, CODED, "")) - 1))
        latin = F.when(kind.startswith("given_f"), F.concat(_syllables(h, 1, 4), F.lit("na"))).when(kind.startswith("given_m"), F.concat(_syllables(h, 1, 4), F.lit("n"))).otherwise(F.concat(_syllables(h, 1, 5), F.when(kind.endswith("_f"), "va").otherwise("r")))
        name = F.when(kind.rlike("_c(?:_f)?$"), F.translate(latin, LATIN, CYRILLIC)).otherwise(latin)
        return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "ssn", ssn).when(kind == "phone", phone).otherwise(name)

    return let(_hex(key, entity, attempt), drawn)


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 (0: valid)."""
    n = F.length(digits)

    def weigh(i: Column) -> Column:
        d = F.substring(digits, i + 1, F.lit(1)).cast("int")
        twice = (n - i) % 2 == 0
        return F.when(twice, F.when(d >= 5, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(numbers(0, n - 1), weigh), F.lit(0), lambda a, x: a + x) % 10


def _refill(match: Column, digits: Column) -> Column:
    """The match with its last digits replaced by these, separators and leading digits kept."""
    between = F.split(match, "[0-9]", -1)
    own = F.concat(F.substring(_digits(match), F.lit(1), F.length(_digits(match)) - F.length(digits)), digits)
    return let(F.struct(between.alias("b"), own.alias("d")), lambda s: F.array_join(F.transform(s["b"], lambda x, i: F.concat(x, F.substring(s["d"], i + 1, F.lit(1)))), ""))


def _recase(model: Column, word: Column) -> Column:
    return F.when(F.upper(model) == model, F.upper(word)).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word))))


def render(match: Column, found: Column, drawn: Column) -> Column:
    """A match rewritten with its entities' canonical surrogates."""
    kind = at(found, 0)["kind"]
    named = F.concat(F.regexp_extract(match, f"^{TITLE}", 0), F.array_join(F.zip_with(_name_words(match), drawn, _recase), " "))
    return F.when(kind.isin("email", "ip"), at(drawn, 0)).when(kind.isin("card", "ssn", "phone"), _refill(match, F.regexp_replace(at(drawn, 0), CODED, ""))).otherwise(named)


def _all(text: Column) -> Column:
    """All matches in a text."""
    return F.when(F.contains(text, F.lit("@")), matches(text, ANY)).otherwise(matches(text, PLAIN))


def _found(text: Column) -> Column:
    """struct<whole, between> of a text; null without a match."""
    between = F.when(F.contains(text, F.lit("@")), F.split(text, ANY, -1)).otherwise(F.split(text, PLAIN, -1))
    return let(_all(text), lambda whole: F.when(F.size(whole) > 0, F.struct(whole.alias("whole"), between.alias("between"))))


def collisions(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """kind, id, attempt of the entities whose first draw was taken. Every distinct entity of the texts is checked."""
    found = input_columns(docs, text=text).select(F.explode(_all(F.col("text"))).alias("m")).distinct().select(F.explode(entities(F.col("m"))).alias("e")).select("e.*").distinct()
    entity = F.struct("kind", "id")
    with scratch(docs.sparkSession):
        drawn = materialize(found.select("kind", "id", F.lit(0).alias("attempt"), surrogate(key, entity, F.lit(0)).alias("s")), "entities")
        real = drawn.select("kind", F.col("id").alias("s"), F.lit(None).cast("struct<attempt:int,id:string>").alias("who"), F.lit(True).alias("real"))
        for attempt in range(1, ATTEMPTS + 1):
            every = drawn.select("kind", "s", F.struct("attempt", "id").alias("who"), F.lit(False).alias("real")).unionByName(real)
            held = every.groupBy("kind", "s").agg(F.count("who").alias("n"), F.min("who").alias("keeps"), F.bool_or("real").alias("real"))
            taken = held.where("n > 1 or real and n > 0").select("kind", "s", "keeps", "real")
            losers = drawn.join(taken, ["kind", "s"]).where((F.col("id") != F.col("keeps.id")) | F.col("real")).select("kind", "id", F.lit(attempt).alias("attempt"), surrogate(key, entity, F.lit(attempt)).alias("s"))
            losers = materialize(losers, "entities-again")
            if not losers.take(1):
                return materialize(drawn.where("attempt > 0").select("kind", "id", "attempt"), "entities-kept", keep=True)
            drawn = materialize(drawn.join(losers.select("kind", "id"), ["kind", "id"], "left_anti").unionByName(losers), "entities")
    raise ValueError(f"surrogates still collide after {ATTEMPTS} attempts")


def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The documents with all entities in their texts replaced; other columns as they are."""
    again = collisions(docs, key, text)
    n = again.count()
    own = F.col(f"`{text}`")
    found = _found(own)

    def rebuilt(f: Column, drawn) -> Column:
        made = F.transform(f["whole"], lambda m: let(entities(m), lambda e: render(m, e, F.transform(e, drawn))))
        return F.array_join(F.zip_with(f["between"], made, lambda b, m: F.concat(b, F.coalesce(m, F.lit("")))), "")

    if n <= INLINE:
        rows = again.collect()  # at most INLINE
        if rows:
            known = F.create_map(*[F.lit(v) for r in rows for v in (f"{r['kind']}\x1f{r['id']}", r["attempt"])])
            attempt = lambda e: F.coalesce(F.element_at(known, F.concat_ws("\x1f", e["kind"], e["id"])), F.lit(0))
        else:
            attempt = lambda e: F.lit(0)
        new = let(found, lambda f: F.when(f.isNotNull(), rebuilt(f, lambda e: surrogate(key, e, attempt(e)))))
        return docs.withColumn(text, F.coalesce(new, own))
    row, held = unused(docs, "pii_row"), unused(docs, "pii_map")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "pii-docs")
    each = numbered.select(row, F.explode(found["whole"]).alias("m")).select(row, F.explode(entities(F.col("m"))).alias("e")).select(row, "e.kind", "e.id").distinct()
    maps = each.join(again, ["kind", "id"]).groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "id").alias("k"), "attempt"))).alias(held))
    joined = numbered.join(maps, row, "left").withColumn(held, F.coalesce(held, F.create_map().cast("map<string,int>")))
    attempt = lambda e: F.coalesce(F.element_at(F.col(held), F.concat_ws("\x1f", e["kind"], e["id"])), F.lit(0))
    new = let(found, lambda f: F.when(f.isNotNull(), rebuilt(f, lambda e: surrogate(key, e, attempt(e)))))
    return joined.withColumn(text, F.coalesce(new, own)).drop(row, held)


def census(docs: DataFrame, text: str = "text") -> list[Column]:
    """Columns with the number of matches of each kind in a text."""
    kinds = F.coalesce(F.transform(_found(F.col(f"`{text}`"))["whole"], kind_of), F.array().cast("array<string>"))
    return [F.size(F.array_remove(F.transform(kinds, lambda k: F.when(k == kind, 1).otherwise(0)), 0)).cast("long").alias(f"n_{kind}") for kind in KINDS]
