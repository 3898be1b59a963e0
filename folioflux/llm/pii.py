"""Surrogates for personal data in Spark expressions: keyed, of the same type and form, distinct and coreferent.

Detected entities are brought to a normal form (the digits of a number, the lower-cased address). A keyed
hash of kind and normal form draws the surrogate, so every mention of an entity, in whatever spelling, gets the
same one without a join. Letters stay letters of their script, digits stay digits, separators stay.

A name is found behind a title. Its words are entities of their own, family and given names, so that with and without
given names, initials and title, or with the title in another form, the same person keeps the same family name. The
gender of the title decides the list of given names and is part of their key. In the text that names a person, the
family name is then also found without the title, alone or behind given names of that text and initials. Title,
particles, script and spacing stay; initials are moved along their alphabet by a keyed distance.

Collisions are settled on the distinct entities: a surrogate that another entity has drawn too, or that is itself
an entity of the corpus, is drawn again with the next attempt, which from the fourth on also lengthens it, or from the
twelfth on if it is a number. Only the entities with a later attempt are joined back to the texts that mention them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from folioflux.llm.rows import quoted, table

KINDS = ["email", "card", "phone", "ssn", "ip", "name"]
# What the words of a name are drawn as.
NAME_KINDS = ["given_f", "given_m", "family"]
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
TITLES_F = "Mrs|Ms|Miss|Madame|Mme|Frau|Señora|Sra|Госпожа"
TITLES_M = "Mr|Monsieur|Herr|Señor|Sr|Господин"
WORDS = 6               # words of a name, and of what stands before a family name
# An address is no longer than a thousand characters before and behind its sign.
# A word of a name, without a possessive ending; initials may stand together.
# Loops over groups are possessive or bounded: Java walks any other with a stack frame a turn.
WORD = r"\p{Lu}\p{L}+(?:['’-](?!s\b)\p{L}++)*+|\p{Lu}['’]\p{L}{2,}+(?:-\p{L}++)*+"
WORD = f"(?:{WORD})"
INITIAL = r"(?:\p{Lu}\.(?: +|(?=\p{Lu}))|\p{Lu} +)"
PARTICLE = "(?:van|von|vom|zu|zur|de|den|der|del|della|di|da|do|dos|du|la|le|el|al|bin|ibn|ten|ter)"
TITLE = rf"^(?:{TITLES_F}|{TITLES_M})\.? +"
TOKEN = rf"{WORD}|\p{{Lu}}(?!\p{{L}})|(?<!\p{{L}}){PARTICLE}(?!\p{{L}})"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9À-ÖØ-öø-ÿ._%+-])[A-Za-z0-9À-ÖØ-öø-ÿ._%+-]{1,1000}+@(?=[A-Za-z0-9-])[A-Za-z0-9.-]{0,1000}(?<!\.)\.[A-Za-z]{2,}+",
    "card": r"(?<![\w.-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\w-])",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w.])\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])",
    "ssn": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "name": rf"\b(?:{TITLES_F}|{TITLES_M})\.? +(?:{INITIAL}|{PARTICLE} +|{WORD} +){{0,{WORDS - 1}}}{WORD}",
}
ANY = "(?:" + ")|(?:".join(PATTERNS[k] for k in KINDS) + ")"

# First names by gender and script.
FIRST = {("f", "latin"): "Anna Clara Elena Emma Julia Laura Lena Lucia Maria Marta Nora Paula Rosa Sara Sofia Vera",
         ("m", "latin"): "Adam Carlo Daniel David Erik Felix Hugo Jan Leon Luis Marco Martin Oscar Paul Simon Victor",
         ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга", ("m", "cyrillic"): "Антон Борис Виктор Денис Иван Олег Павел Юрий"}
SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se ta te to".split(),
             "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се та те то ва ве во".split()}
LENGTHENED = 12         # attempt from which a number, whose space may be full, gets further digits
ATTEMPTS = 200
SMALL = 200_000         # later attempts that may be sent to every task


def byte(digest: Column, i: Column) -> Column:
    """The i-th byte (from 0) of a hexadecimal digest of 32 bytes, going round with a shift."""
    return F.conv(F.substring(digest, 2 * F.pmod(i, F.lit(32)) + 1, F.lit(2)), 16, 10).cast("int") + i


def characters(x: Column) -> Column:
    return F.split(x, "(?!^)(?!$)")


def check_digit(body: Column) -> Column:
    """The digit that makes 15 digits a card number."""
    def weighed(c, i):
        digit = c.try_cast("int")
        return F.when(i % 2 == 0, F.floor(digit / 5).cast("int") + digit * 2 % 10).otherwise(digit)
    total = F.aggregate(F.transform(characters(body), weighed), F.lit(0), lambda a, x: a + x)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def pick(choices: list[str], at: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in choices]), F.pmod(at, F.lit(len(choices))).cast("int"))


def kind_of(x: Column) -> Column:
    out = F.lit("name")
    for kind in reversed(KINDS[:-1]):
        out = F.when(x.rlike("^(?:" + PATTERNS[kind].replace(r"(?<![\w.-])", "").replace(r"(?<![\w.])", "") + ")$"), F.lit(kind)).otherwise(out)
    return out


def normal(kind: Column, x: Column) -> Column:
    return F.when(kind.isin("card", "phone", "ssn"), F.regexp_replace(x, r"\D", "")).otherwise(F.lower(x))


def keyed(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string")), 256)


def drawn(digest: Column, kind: Column, norm: Column, attempt: Column) -> Column:
    """The surrogate of a normal form, itself in normal form."""
    longer = F.when(attempt >= 4, F.substring(F.translate(digest, DIGITS, "ghijklmnop"), 1, attempt)).otherwise(F.lit(""))
    accented = "àáâäãçèéêëìíîïñòóôöõùúûüý"

    def letter(c, i):
        return F.when(F.instr(F.lit(LOWER), c) > 0, pick(list(LOWER), byte(digest, i))) \
            .when(F.instr(F.lit(DIGITS), c) > 0, pick(list(DIGITS), byte(digest, i))) \
            .when(F.instr(F.lit(accented), c) > 0, pick(list(accented), byte(digest, i))).otherwise(c)
    # The last label of an address stays, as does every separator.
    body, tail = F.regexp_extract(norm, r"^(.*)(\.[^.]*)$", 1), F.regexp_extract(norm, r"^(.*)(\.[^.]*)$", 2)
    email = F.concat(longer, F.array_join(F.transform(characters(body), letter), ""), tail)
    # Numbers keep their first digit, which tells the network or the country. Where a form is full they grow at the end.
    more = F.when(attempt >= LENGTHENED, F.substring(F.translate(digest, "abcdef", "012345"), 1, F.floor((attempt - LENGTHENED) / 4).cast("int") + 1)).otherwise(F.lit(""))
    plain = F.array_join(F.transform(characters(norm), lambda c, i: F.when(i == 0, c).otherwise(pick(list(DIGITS), byte(digest, i)))), "")
    # A card number whose last digit checks the others gets one whose last digit does.
    body16 = F.substring(plain, 1, 15)
    checked = F.when((kind == "card") & (check_digit(F.substring(norm, 1, 15)) == F.substring(norm, 16, 1)), F.concat(body16, check_digit(body16))).otherwise(plain)
    number = F.concat(checked, more)
    ip = F.array_join(F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: (F.pmod(byte(digest, i), F.lit(254)) + 1).cast("string")), ".")
    cyrillic = norm.rlike(r"\p{IsCyrillic}")

    def syllables(script, n):
        return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: pick(SYLLABLES[script], byte(digest, i))), "")

    def given(gender, script):
        names = FIRST[gender, script].lower().split()
        first, second = pick(names, byte(digest, F.lit(0))), pick(names, byte(digest, F.lit(1)))
        return F.when(attempt == 0, first).when(attempt < 4, F.concat(first, F.lit("-"), second)) \
            .otherwise(F.concat(first, F.lit("-"), syllables(script, F.lit(1) + F.floor(attempt / 4).cast("int"))))

    def by_script(of):
        return F.when(cyrillic, of("cyrillic")).otherwise(of("latin"))
    return F.when(kind == "email", email).when(kind == "ip", ip) \
        .when(kind == "family", by_script(lambda x: syllables(x, F.lit(3) + F.floor(attempt / 4).cast("int")))) \
        .when(kind == "given_f", by_script(lambda x: given("f", x))).when(kind == "given_m", by_script(lambda x: given("m", x))).otherwise(number)


def moved(key: str, initial: Column) -> Column:
    """An initial moved along its alphabet, never to itself, so that no two initials become one."""
    at, to = "", ""
    for letters in (UPPER, "ÀÁÂÄÃÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜÝ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"):
        n = 1 + int(hashlib.sha256(f"{key}\x1finitial\x1f{letters}".encode()).hexdigest(), 16) % (len(letters) - 1)
        at, to = at + letters, to + letters[n:] + letters[:n]
    return F.translate(initial, at, to)


def formatted(kind: Column, x: Column, sur: Column) -> Column:
    """A normal surrogate in the form of the mention: its separators, or its use of capitals."""
    def place(c, i):
        nth = F.length(F.regexp_replace(F.substring(x, F.lit(1), i + 1), r"\D", ""))
        return F.when(c.rlike(r"\d"), F.substring(sur, nth, F.lit(1))).otherwise(c)
    digits = F.length(F.regexp_replace(x, r"\D", ""))
    number = F.concat(F.array_join(F.transform(characters(x), place), ""), F.substring(sur, digits + 1, F.length(sur)))
    cased = F.when(x == F.upper(x), F.upper(sur)).when(x == F.lower(x), sur).otherwise(F.array_join(F.transform(F.split(sur, "-"), F.initcap), "-"))
    return F.when(kind.isin("card", "phone", "ssn"), number).when(kind == "email", F.when(x == F.upper(x), F.upper(sur)).otherwise(sur)) \
        .when(kind.isin(NAME_KINDS), cased).otherwise(sur)


def mentions(text: Column) -> Column:
    return F.when(text.rlike(ANY), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def tokens(name: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(name, TITLE, ""), F.lit(TOKEN), F.lit(0))


def titled(mention: Column) -> Column:
    """(gender, family, given): what a name behind a title tells."""
    words = F.filter(tokens(mention), lambda w: w.rlike(rf"^{WORD}$"))
    return F.struct(F.when(mention.rlike(rf"^(?:{TITLES_F})\b"), "f").otherwise("m").alias("gender"), F.element_at(words, -1).alias("family"),
                    F.slice(words, F.lit(1), F.size(words) - 1).alias("given"))


def bare(names: Column) -> Column:
    """The pattern of the family names, alone or behind given names and initials of the text, as they stand or in capitals."""
    def either(words):
        words = F.array_distinct(F.concat(words, F.transform(words, F.upper)))
        # Longer ones first, as the first that fits is taken.
        return F.array_join(F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda e: e["w"]), "|")
    family, given = either(F.transform(names, lambda n: n["family"])), either(F.flatten(F.transform(names, lambda n: n["given"])))
    before = F.when(given == "", F.lit("")).otherwise(F.concat(F.lit("(?:"), given, F.lit(") +|")))
    return F.concat(F.lit(r"(?<![\p{L}\p{N}_'’-])(?:"), before, F.lit(rf"{INITIAL}|{PARTICLE} +){{0,{WORDS}}}(?:"), family, F.lit(r")(?![\p{L}\p{N}_]|-\p{L})"))


def with_mentions(docs: DataFrame, body: Column) -> DataFrame:
    """The rows with __found (mentions in text order), __gaps (what stands around them) and __names (of persons behind titles)."""
    text = F.coalesce(body, F.lit(""))
    # Texts without a title, most of them, take no part in what names need.
    people = F.transform(F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0)), titled)
    rows = docs.withColumn("__names", F.when(text.rlike(PATTERNS["name"]), F.array_distinct(people)))
    rows = rows.withColumn("__any", F.when(F.col("__names").isNotNull(), F.concat(F.lit(ANY + "|"), bare(F.col("__names")))))
    named = F.col("__any").isNotNull()
    return rows.withColumn("__found", F.when(named, F.regexp_extract_all(text, F.col("__any"), F.lit(0))).otherwise(mentions(text))) \
        .withColumn("__gaps", F.when(named, F.split(text, F.col("__any"), -1)).when(F.size("__found") > 0, F.split(text, ANY, -1)))


def parts(mention: Column, kind: Column, names: Column) -> Column:
    """(form, kind, norm) of what is drawn for a mention: a name's words one by one, all else as a whole."""
    person = titled(mention)
    title = F.regexp_extract(mention, TITLE, 0) != ""

    def gender(word, family):
        def told(of):
            return F.exists(names, lambda n: (n["gender"] == "f") & of(n)), F.exists(names, lambda n: of(n))
        same = lambda n: F.exists(n["given"], lambda g: F.lower(g) == F.lower(word))
        f_here, here = told(lambda n: same(n) & (F.lower(n["family"]) == F.lower(family)))
        f_any, _ = told(same)
        return F.when(F.when(title, person["gender"] == "f").when(here, f_here).otherwise(f_any), "given_f").otherwise("given_m")

    def word(w, family, last):
        form = F.when(~w.rlike(rf"^(?:{WORD}|\p{{Lu}})$"), "particle").when(F.length(w) == 1, "initial").when(last, "family").otherwise(gender(w, family))
        return F.struct(w.alias("form"), form.alias("kind"), F.lower(w).alias("norm"))
    words = tokens(mention)
    of_name = F.transform(words, lambda w, i: word(w, F.element_at(words, -1), i == F.size(words) - 1))
    whole = F.array(F.struct(mention.alias("form"), kind.alias("kind"), normal(kind, mention).alias("norm")))
    return F.when(kind == "name", of_name).otherwise(whole)


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, attempt, sur) with distinct surrogates, none of which is an entity of its kind."""
    def draw() -> Column:
        return drawn(keyed(key, F.col("kind"), F.col("norm"), F.col("attempt")), F.col("kind"), F.col("norm"), F.col("attempt"))

    now = entities.withColumn("attempt", F.lit(0))
    now = table(now.withColumn("sur", draw()), "entities")
    for _ in range(ATTEMPTS):
        # Of those that share a surrogate the one with the fewest attempts keeps it.
        keeps = now.groupBy("kind", "sur").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "norm")).alias("first")).filter(F.col("n") > 1)
        real = entities.select("kind", F.col("norm").alias("sur"), F.lit(True).alias("real"))
        judged = now.join(keeps, ["kind", "sur"], "left").join(real, ["kind", "sur"], "left")
        again = F.coalesce("real", F.lit(False)) | F.coalesce(F.col("first.norm") != F.col("norm"), F.lit(False))
        judged = judged.withColumn("again", again)
        if judged.filter("again").isEmpty():
            return now
        attempt = F.col("attempt") + F.col("again").cast("int")
        moved = judged.select("kind", "norm", attempt.alias("attempt"), "sur", "again")
        now = table(moved.select("kind", "norm", "attempt", F.when(F.col("again"), draw()).otherwise(F.col("sur")).alias("sur")), "entities")
    raise ValueError(f"surrogates still collide after {ATTEMPTS} attempts")


def replace_entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Every input row with its text rewritten, and ``entities``: an array of (kind, mention, surrogate) in text order.

    A null text stays null and has no entities; an empty one stays empty. Repeated rows and ties get the same
    surrogates, as do equal entities anywhere. An input column named entities is replaced. An empty table gives
    an empty result.
    """
    body = quoted(text)
    found = with_mentions(docs.select(body.alias("__text")), F.col("__text")) \
        .select(F.xxhash64("__text").alias("th"), "__names", F.explode(F.array_distinct("__found")).alias("mention")) \
        .withColumn("kind", kind_of(F.col("mention")))
    found = found.select("th", F.explode(parts(F.col("mention"), F.col("kind"), F.col("__names"))).alias("x"))
    # Initials and particles are not drawn.
    found = table(found.select("th", "x.kind", "x.norm").filter(~F.col("kind").isin("initial", "particle")).distinct(), "mentions")
    later = assigned(found.select("kind", "norm").distinct(), key).filter(F.col("attempt") > 0)
    entry = F.struct(F.concat_ws("\x1f", "kind", "norm").alias("key"), F.col("attempt").alias("value"))
    # A row for each distinct text with such entities. Copies of a text share one, so where there are few it goes to every task.
    tries = table(found.join(later, ["kind", "norm"]).groupBy("th").agg(F.map_from_entries(F.collect_set(entry)).alias("__tries")), "tries")
    size = tries.agg(F.sum(F.size("__tries"))).first()[0] or 0
    joined = docs.withColumn("__th", F.xxhash64(body)).join(F.broadcast(tries) if size <= SMALL else tries, F.col("__th") == F.col("th"), "left")
    rows = with_mentions(joined, body)

    # One step at a time, so that no expression is evaluated twice.
    step = lambda column, name, of: F.transform(column, lambda e: e.withField(name, of(e)))

    def surrogates(drawings):
        drawings = step(drawings, "attempt", lambda e: F.coalesce(F.col("__tries")[F.concat_ws("\x1f", e["kind"], e["norm"])], F.lit(0)))
        drawings = step(drawings, "digest", lambda e: keyed(key, e["kind"], e["norm"], e["attempt"]))
        drawings = step(drawings, "drawn", lambda e: drawn(e["digest"], e["kind"], e["norm"], e["attempt"]))
        return F.transform(drawings, lambda e: F.when(e["kind"] == "initial", moved(key, e["form"])).when(e["kind"] == "particle", e["form"])
                           .otherwise(formatted(e["kind"], e["form"], e["drawn"])))

    def whole(e):
        # The title and what stands between the words stay.
        rest = F.regexp_replace(e["mention"], TITLE, "")
        joined = F.array_join(F.zip_with(F.split(rest, TOKEN, -1), e["new"], lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")
        return F.when(e["kind"] == "name", F.concat(F.regexp_extract(e["mention"], TITLE, 0), joined)).otherwise(F.get(e["new"], 0))
    found = F.transform("__found", lambda x: F.struct(x.alias("mention"), kind_of(x).alias("kind")))
    found = step(found, "parts", lambda e: parts(e["mention"], e["kind"], F.col("__names")))
    found = step(found, "new", lambda e: surrogates(e["parts"]))
    found = F.transform(found, lambda e: F.struct(e["kind"].alias("kind"), e["mention"].alias("mention"), whole(e).alias("surrogate")))
    rows = rows.withColumn("entities", found)
    pieces = F.zip_with("__gaps", "entities", lambda gap, e: F.concat(gap, F.coalesce(e["surrogate"], F.lit(""))))
    new = F.when(F.size("__found") > 0, F.array_join(pieces, "")).otherwise(body)
    return rows.withColumn(text, new).select(*[quoted(c) for c in docs.columns if c != "entities"], "entities")
