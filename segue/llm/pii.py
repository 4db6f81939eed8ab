"""PII surrogates, with DataFrame functions only.

Detected entities (e-mail addresses, phone numbers, IPv4 addresses, card numbers, social security
numbers, IBANs, secrets, names of people) are replaced by keyed surrogates of the same type and
format. An entity is a row of symbols, each from an alphabet (digits, hex digits, capital or small
letters; for names vowels and consonants of its script); a Feistel network over even and odd places,
keyed by sha256, permutes the symbols within their alphabets. It is one-to-one on entities of a
format, so distinct entities keep distinct surrogates, and equal ones get equal surrogates in all
documents (coreference). A card's check digit keeps the checksum of the card; the last label of an
e-mail domain, a phone's country code and a key's prefix stay; a given name becomes another one of
the same gender and script by a keyed rotation of its list.

Coreference goes on within a document: where it names a person in full, later mentions of the given name
or the surname alone get the same part of the surrogate (of several full names with that word the first
counts). An e-mail address of the form given.surname becomes that of the person's surrogate, in any document.

Collision checks then run over all distinct entities: a surrogate must not be an entity of the corpus
or the surrogate of another entity. An entity that fails gets the next key, for ATTEMPTS rounds. Where a
format has so many entities that this does not end, all entities of that format take the first key: the
permutation keeps them distinct, but a surrogate may then be an entity of the corpus (`within` says so).

Defined results: null text stays null and empty text empty; texts without entities are unchanged;
equal rows get equal texts; texts of any length are scanned in time in proportion to it; other columns pass
through, internal ones cannot clash with them; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut

DIGITS, HEX, LOWER, UPPER = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Given names by gender and script, and the alphabets of surnames.
FEMALE = ["Maria", "Anna", "Emma", "Laura", "Sarah", "Julia", "Sofia", "Elena", "Claire", "Linda", "Susan", "Karen", "Emily", "Jessica", "Camille", "Carmen", "Lucia", "Ingrid", "Helga", "Monique"]
MALE = ["James", "John", "Robert", "Michael", "David", "Thomas", "Peter", "Daniel", "Carlos", "Pierre", "Hans", "Klaus", "Juan", "Miguel", "Pablo", "Jean", "Louis", "William", "Richard", "George"]
FEMALE_CYRILLIC = ["Анна", "Мария", "Ольга", "Елена", "Наталья", "Татьяна", "Ирина", "Светлана"]
MALE_CYRILLIC = ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Андрей", "Михаил", "Николай"]
NAME_ALPHABETS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ"]
GIVEN = FEMALE + MALE + FEMALE_CYRILLIC + MALE_CYRILLIC

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: What the types look like. Possessive runs and look-behinds keep matching linear in the text.
TYPES = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*+(?<=\.[A-Za-z]{2,24})",
    "ip": rf"(?=[0-9])(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])",
    "card": r"(?=[0-9])(?<![0-9A-Za-z+\-])(?:[0-9]{16}|[0-9]{4}(?:[ \-][0-9]{4}){3})(?![0-9A-Za-z])",
    "phone": r"(?=[+])(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}(?![0-9A-Za-z])|(?=[(0-9])(?<![0-9A-Za-z+.\-])(?:\([0-9]{3}\) ?|[0-9]{3}[.\-])[0-9]{3}[.\-][0-9]{4}(?![0-9A-Za-z])",
    "ssn": r"(?=[0-9])(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])",
    "iban": r"(?=[A-Z])(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "secret": r"(?=A)(?<![0-9A-Za-z])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|(?=[spgx])(?<![0-9A-Za-z])(?:sk|pk|ghp|gho|xox[bp])[\-_][0-9A-Za-z_\-]{20,}+|(?<=[=: \"'])(?<=(?:password|passwd|secret|api_key|apikey|token) ?[=:] ?[\"']?)[0-9A-Za-z_\-/+]{8,}+|(?=[0-9a-f])(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])",
    "name": rf"(?=[{''.join(sorted({g[0] for g in GIVEN}))}])(?<!\p{{L}})(?:{'|'.join(GIVEN)}) \p{{Lu}}\p{{Ll}}++(?!\p{{L}})",
}
ANY = "|".join(TYPES.values())
#: For texts without an at sign, in which no word need be tried as an e-mail address.
ANY_BUT_EMAIL = "|".join(v for k, v in TYPES.items() if k != "email")
#: An e-mail name made of a given name and a surname, both small or both with a capital.
PERSON_MAIL = [rf"\A({'|'.join(f(g) for g in FEMALE + MALE)})([._\-])({first}[a-z]+)([0-9]*)\z" for f, first in ((str.lower, "[a-z]"), (str, "[A-Z]"))]
#: What any entity has: a digit or an at sign, a word that names a secret, a key's prefix, a run of hex letters, or a given name.
KEYWORDS = ["password", "passwd", "secret", "api_key", "apikey", "token", "AKIA", "ASIA", "sk-", "sk_", "pk-", "pk_", "ghp", "gho", "xox"]
INITIALS = "".join(sorted({g[0] for g in GIVEN}))
#: Halves are mixed so many times.
ROUNDS = 4
#: Keys that are tried for entities whose surrogates collide.
ATTEMPTS = 6
#: Distinct entities of a task: each costs some milliseconds of hashing.
ENTITIES_OF_A_TASK = 2000


def _by_pattern(text: Column, use) -> Column:
    return F.when(F.contains(text, F.lit("@")), use(ANY)).otherwise(use(ANY_BUT_EMAIL))


def entities(text: Column) -> Column:
    """Entities of a text in order (array of string); empty for null."""
    return F.coalesce(_by_pattern(text, lambda p: F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1))), F.array().cast("array<string>"))


def may_have(text: Column) -> Column:
    """False only for texts without entities; scans for single characters and words, so that few texts meet the full pattern."""
    out = text.rlike("[0-9@]") | text.rlike(f"(?=[{INITIALS}])(?:{'|'.join(GIVEN)}) ") | text.rlike("[a-f]{32}")
    for word in KEYWORDS:
        out = out | F.contains(text, F.lit(word))
    return out


def type_of(entity: Column) -> Column:
    """By the entity alone; the context that made it a secret is gone, so what fits nothing else is one."""
    out = F.lit("secret")
    for name in reversed([t for t in TYPES if t != "secret"]):
        out = F.when(entity.rlike(rf"\A(?:{TYPES[name]})\z"), F.lit(name)).otherwise(out)
    return out


def _hash(*parts: Column) -> Column:
    """A number of 48 bits from sha256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 12), 16, 10).cast("long")


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _feistel(symbols: Column, bases: Column, key: Column) -> Column:
    """symbols: array of places in alphabets of the sizes `bases`, -1 for what stays."""

    def round_of(s: Column, r: Column) -> Column:
        other = F.array_join(F.filter(s, lambda x, i: i % 2 != r % 2).cast("array<string>"), ",")
        more = lambda i: _hash(key, r.cast("string"), i.cast("string"), F.array_join(bases.cast("array<string>"), ","), other)
        return F.transform(s, lambda x, i: F.when((i % 2 == r % 2) & (x >= 0), F.pmod(x + more(i), F.get(bases, i))).otherwise(x))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), symbols, round_of)


def _permute(text: Column, alphabet_of, key: Column) -> Column:
    """A text with its characters permuted within the alphabets that alphabet_of(char) names ('' stays)."""
    chars = F.transform(F.regexp_extract_all(text, F.lit("((?s:.))"), F.lit(1)), lambda c: F.struct(c.alias("c"), alphabet_of(c).alias("a")))

    def run(cs: Column) -> Column:
        places = F.transform(cs, lambda x: (F.position(x["c"], x["a"]) - 1).cast("long"))
        done = _feistel(places, F.transform(cs, lambda x: F.length(x["a"]).cast("long")), key)
        back = F.zip_with(done, cs, lambda x, c: F.when(x < 0, c["c"]).otherwise(F.substring(c["a"], (x + 1).cast("int"), F.lit(1))))
        return F.array_join(back, "")

    return _let(chars, run)


def _plain(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), DIGITS).when(c.rlike("[a-z]"), LOWER).when(c.rlike("[A-Z]"), UPPER).otherwise("")


def _name_letters(c: Column) -> Column:
    out = F.lit("")
    for a in NAME_ALPHABETS:
        out = F.when(F.contains(F.lit(a), c), F.lit(a)).otherwise(out)
    return out


def _luhn(digits: Column) -> Column:
    """The checksum (mod 10) of an array of 16 digits."""
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda s, d: (s + d).cast("int")) % 10


def _card(text: Column, key: Column) -> Column:
    """15 digits are permuted; the last one keeps the checksum as it was."""
    numbers = lambda t: F.regexp_extract_all(t, F.lit("([0-9])"), F.lit(1)).cast("array<int>")
    last = lambda head: F.pmod(_luhn(numbers(text)) - _luhn(numbers(head)), F.lit(10)).cast("string")
    return _let(_permute(F.substring(text, F.lit(1), F.length(text) - 1), _plain, key), lambda head: F.concat(head, last(head)))


def _ip(text: Column, key: Column) -> Column:
    octets = F.split(text, r"\.").cast("array<long>")
    return F.array_join(_feistel(octets, F.array_repeat(F.lit(256).cast("long"), 4), key).cast("array<string>"), ".")


def _person(text: Column, key: Column) -> Column:
    given, rest = F.substring_index(text, " ", 1), F.substring_index(text, " ", -1)
    out = given
    for names in (FEMALE, MALE, FEMALE_CYRILLIC, MALE_CYRILLIC):
        at = F.array_position(F.lit(names), given)
        shift = 1 + F.pmod(_hash(key, F.lit("given"), rest), F.lit(len(names) - 1))  # another name than the own one
        out = F.when(at > 0, F.element_at(F.lit(names), (F.pmod(at - 1 + shift, F.lit(len(names))) + 1).cast("int"))).otherwise(out)
    return F.concat(out, F.lit(" "), _permute(rest, _name_letters, F.concat_ws("\x1f", key, F.lit("surname"))))


def _mail(head: Column, own: Column, name_key: Column) -> Column:
    """The part of an e-mail address before its last label; a person's name becomes that of the person's surrogate."""
    local, domain = F.substring_index(head, "@", 1), F.substring_index(head, "@", -1)
    out = _permute(head, _plain, own)
    for pattern, written in zip(PERSON_MAIL, (F.lower, lambda c: c)):
        given, sep, surname, number = (F.regexp_extract(local, pattern, k) for k in (1, 2, 3, 4))
        other = _person(F.concat(F.initcap(given), F.lit(" "), F.initcap(surname)), name_key)
        name = F.replace(written(other), F.lit(" "), sep)
        out = F.when(given != "", F.concat(name, _permute(number, _plain, own), F.lit("@"), _permute(domain, _plain, own))).otherwise(out)
    return out


def surrogate(entity: Column, key: Column) -> Column:
    """The replacement of an entity under a key (which includes the attempt)."""
    kind = type_of(entity)
    own = F.concat_ws("\x1f", key, kind)
    after = lambda prefix: F.substring(entity, F.length(prefix) + 1, F.length(entity))
    country = F.regexp_extract(entity, r"\A(\+[0-9]{1,3}(?=[ .\-(]))?", 1)
    prefix = F.regexp_extract(entity, r"\A((?:AKIA|ASIA|(?:sk|pk|ghp|gho|xox[bp])[\-_])?)", 1)
    hexes = entity.rlike(r"\A[0-9a-f]+\z")
    top = F.concat(F.lit("."), F.substring_index(entity, ".", -1))
    head = F.substring(entity, F.lit(1), F.length(entity) - F.length(top))
    plain = lambda t: _permute(t, _plain, own)
    return (
        F.when(kind == "email", F.concat(_mail(head, own, F.concat_ws("\x1f", key, F.lit("name"))), top))
        .when(kind == "ip", _ip(entity, own))
        .when(kind == "card", _card(entity, own))
        .when(kind == "phone", F.concat(country, plain(after(country))))
        .when(kind == "iban", F.concat(F.substring(entity, 1, 2), plain(F.substring(entity, F.lit(3), F.length(entity)))))
        .when(kind == "name", _person(entity, own))
        .when(kind == "ssn", plain(entity))
        .when(hexes, _permute(entity, lambda c: F.lit(HEX), own))
        .otherwise(F.concat(prefix, plain(after(prefix))))
    )


def _key(secret: str, attempt: Column) -> Column:
    return F.concat_ws("\x1f", F.lit(secret), attempt.cast("string"))


def format_of(entity: Column) -> Column:
    """The same for entities that one permutation may map to each other (and coarser than that at times)."""
    kind = type_of(entity)
    given = F.substring_index(entity, " ", 1)
    group = F.lit(0)
    for k, names in enumerate((FEMALE, MALE, FEMALE_CYRILLIC, MALE_CYRILLIC)):
        group = F.when(given.isin(names), k).otherwise(group)
    rest = F.substring_index(entity, " ", -1)
    letters = rest
    for k, alphabet in enumerate(NAME_ALPHABETS):
        letters = F.regexp_replace(letters, f"[{alphabet}]", str(k))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(entity, "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "9")
    hexes = entity.rlike(r"\A[0-9a-f]+\z")
    own = F.when(kind == "name", F.concat_ws(":", group, letters)).when(kind == "ip", "").when((kind == "secret") & hexes, F.length(entity).cast("string")).otherwise(shape)
    return F.concat_ws(":", kind, own)


def checked(known: DataFrame, secret: str, max_attempts: int = ATTEMPTS) -> DataFrame:
    """entity, attempt, surrogate, within for distinct entities (entity): all surrogates differ, and none is an entity unless `within`."""
    of = lambda d: d.withColumn("surrogate", surrogate(F.col("entity"), _key(secret, F.col("attempt")))).withColumn("within", F.lit(False))
    dealt = lambda d: d.repartition(max(1, min(20_000, -(-d.count() // ENTITIES_OF_A_TASK))))
    now = cut(of(dealt(known).withColumn("attempt", F.lit(0))))
    bad = None
    for _ in range(max_attempts):
        real = now.select(F.col("entity").alias("surrogate"))
        first = now.groupBy("surrogate").agg(F.count("*").alias("c"), F.min("entity").alias("first")).filter(F.col("c") > 1).drop("c")
        taken = now.join(real, "surrogate", "left_semi").select("entity")
        twice = now.join(first, "surrogate").filter(F.col("entity") != F.col("first")).select("entity")
        bad = cut(taken.unionByName(twice).distinct())
        if bad.isEmpty():
            return now
        redo = cut(now.join(bad, "entity", "left_semi").select("entity", (F.col("attempt") + 1).alias("attempt")))
        now = cut(now.join(bad, "entity", "left_anti").unionByName(of(dealt(redo))))
    shaped = now.withColumn("__format", format_of(F.col("entity")))
    full = shaped.join(bad, "entity", "left_semi").select("__format").distinct()
    inside = cut(shaped.join(full, "__format", "left_semi").select("entity", F.lit(0).alias("attempt")))
    return cut(shaped.join(full, "__format", "left_anti").drop("__format").unionByName(of(dealt(inside)).withColumn("within", F.lit(True))))


def _mentions(gap: Column, words: Column, others: Column) -> Column:
    """Text between entities, with each word that is one of `words` replaced by the one at its place in `others`."""
    parts = F.regexp_extract_all(gap, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda w: F.coalesce(F.get(others, F.nullif(F.array_position(words, w), F.lit(0)).cast("int") - 1), w)), "")


def pseudonymise(docs: DataFrame, secret: str, text_col: str = "text") -> DataFrame:
    """`docs` with the entities of its whole texts replaced, and __n_entities (long), how many there were."""
    names = docs.columns
    text = F.col(f"`{text_col}`")
    found = entities(text)
    has = F.coalesce(may_have(text) & _by_pattern(text, lambda p: text.rlike(p)), F.lit(False))
    hit = docs.filter(has)
    known = cut(hit.select(F.explode(found).alias("entity")).distinct())
    again = checked(known, secret).filter(F.col("attempt") > 0).select("entity", "attempt")
    marked = docs.withColumn("__found", F.when(has, found))
    attempt = None
    if not again.isEmpty():
        # Only documents with an entity that needed another key; equal texts have equal exceptions.
        own = hit.select(F.sha2(text, 256).alias("__sha"), F.explode(F.array_distinct(found)).alias("entity")).join(again, "entity")
        maps = own.groupBy("__sha").agg(F.map_from_entries(F.collect_set(F.struct("entity", "attempt"))).alias("__attempts"))
        marked = marked.withColumn("__sha", F.sha2(text, 256)).join(maps, "__sha", "left")
        attempt = lambda e: F.coalesce(F.try_element_at(F.col("__attempts"), e), F.lit(0))
    of = lambda e: surrogate(e, _key(secret, attempt(e) if attempt else F.lit(0)))
    gaps = _by_pattern(text, lambda p: F.split(text, p, -1))

    def put(pairs: Column) -> Column:
        people = F.filter(pairs, lambda x: x["e"].rlike(rf"\A(?:{TYPES['name']})\z"))
        both = lambda side: F.concat(F.transform(people, lambda x: F.substring_index(x[side], " ", 1)), F.transform(people, lambda x: F.substring_index(x[side], " ", -1)))
        joined = lambda use: F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), pairs.alias("p")), lambda x: F.concat(use(x["g"]), F.coalesce(x["p"]["s"], F.lit("")))), "")
        mentioned = _let(F.struct(both("e").alias("w"), both("s").alias("o")), lambda m: joined(lambda g: _mentions(g, m["w"], m["o"])))
        return F.when(F.size(people) > 0, mentioned).otherwise(joined(lambda g: g))

    new = _let(F.transform("__found", lambda e: F.struct(e.alias("e"), of(e).alias("s"))), put)
    out = F.when(F.col("__found").isNotNull(), new).otherwise(text)
    n = F.coalesce(F.size("__found"), F.lit(0)).cast("long")
    return marked.select(*[out.alias(c) if c == text_col else F.col(f"`{c}`") for c in names], F.when(F.col("__found").isNull(), F.lit(0).cast("long")).otherwise(n).alias("__n_entities"))
