"""Personal data replaced by surrogates, in DataFrame expressions only.

Detection: one pattern finds mail addresses, keys and tokens, bank accounts,
social security numbers, network addresses, payment cards, telephone numbers and
titled names; a hexadecimal secret needs a word such as token or key before it,
and an undivided card number of other than 16 digits a right check digit. In a
text with a titled name, its words are names wherever else they stand. A
mention's entity is its type and its spelling without case or separators; for a
name, each of its words is one. So all spellings of an entity share one
surrogate, and a person keeps it under another title or none.

Surrogates: a keyed hash of the entity yields characters of the same kind at the
same places; cards keep their issuer digit and the validity of their check
digit, accounts get right check digits, names are spelled from syllables of
their script with the ending of their gender, which all mentions of the word
tell (none if they disagree). A mention's own case, title and separators, hyphens
and apostrophes are then put back.

Collisions: a surrogate is rejected if it equals an entity of the corpus, one
given out in an earlier round, or another candidate of the round (the smallest
entity keeps it); those rejected try again with the next attempt, in a wider
space: private addresses in that of the largest private network, and from
attempt ``WIDER`` on with more characters than the entity has, so that the rounds
end however full a space is. So different entities have different surrogates and
none is a real entity; equal entities have equal ones in all documents.

Texts are read by the pattern once: documents are written with their mentions, so
that only those that have any are read again. Mentions are gathered once per
distinct text, entities once per corpus; both are aggregated before they are
shuffled. Texts without a mention are not shuffled.

Defined results: a null text stays null, an empty one empty; texts without a
mention are returned unchanged; equal texts get equal results; mentions do not
overlap (the leftmost wins, then the order of ``TYPES``). Other columns of the
documents are returned as they are. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# Titles by gender, and given names that tell a gender where the title does not.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")
OTHER_TITLES = ("Dr", "Prof")
MALE_GIVEN = ("james", "john", "robert", "michael", "david", "thomas", "peter", "paul", "hans", "karl", "jean", "pierre", "luis", "carlos", "jose", "juan", "иван", "алексей", "дмитрий")
FEMALE_GIVEN = ("mary", "anna", "linda", "susan", "sarah", "laura", "julia", "marie", "claire", "ingrid", "sofia", "maria", "carmen", "lucia", "elena", "мария", "анна", "ольга")
# Syllables that surrogate names are spelled from, and endings by gender.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke la le lo lu ma me mi mo na ne ni no pa pe ra re ri ro sa se si ta te va ve wi".split(),
    "greek": "βα βε γα γε δα δε ζα θε κα κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε τα τε φα φε".split(),
    "armenian": "բա բե գա գե դա դե զա թե կա կո լա լե լի լո մա մե մի մո նա նե նի նո պա պե ռա ռե սա սե տա տե վա վե".split(),
    "cyrillic": "ба бе бо ва ве ви га го да де до жа за зо ка ке ко ла ле ло ма ме ми мо на не ни но па пе ра ре ри ро са се та те фе ха".split(),
}
ENDINGS = {
    ("latin", "m"): "n r l d s".split(), ("latin", "f"): "na ra la da sa".split(), ("latin", "u"): "m k t x z".split(), ("latin", "family"): "man ton ler sen dell".split(),
    ("greek", "m"): "νος ρος λος δος σος".split(), ("greek", "f"): "να ρα λα δα σα".split(), ("greek", "u"): "μ κ τ ξ ζ".split(), ("greek", "family"): "νιδης ρας λιος δακης κος".split(),
    ("armenian", "m"): "ն ր լ դ ս".split(), ("armenian", "f"): "նա րա լա դա սա".split(), ("armenian", "u"): "մ կ տ խ զ".split(), ("armenian", "family"): "նյան րյան լյան դյան սյան".split(),
    ("cyrillic", "m"): "н р л д с".split(), ("cyrillic", "f"): "на ра ла да са".split(), ("cyrillic", "u"): "м к т х з".split(), ("cyrillic", "family"): "нов рин лев дин сон".split(),
}

#: Letters by script, where it is not Latin.
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "armenian": r"\p{IsArmenian}"}
#: Attempts from which on surrogates are longer than their entities.
WIDER = 10
_TITLE = "|".join(sorted((*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES), key=len, reverse=True))
# In capitals, short titles need their dot, as many abbreviations look alike.
_SHOUTED = "|".join(t.upper() + (r"\." if len(t) < 5 and t not in ("Herr", "Frau") else r"\.?") for t in sorted((*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES), key=len, reverse=True))
# A surname or given name that is not itself a title; initials may stand before each.
_FULL = rf"(?!(?:{_TITLE})(?!\p{{L}}))\p{{Lu}}[\p{{L}}'’-]{{1,30}}+"
_CAPITALS = r"\p{Lu}[\p{Lu}'’-]{1,30}+(?!\p{L})"
_INITIALS = r"(?:\p{Lu}\.){1,3}"
_TITLES = rf"(?:(?:(?:{_TITLE})\.?|(?:{_SHOUTED})) ){{1,3}}"
# Telephone numbers: a digit after a single separator only if another follows, so that each unit is one digit and counts.
_NEXT = r"(?:(?:[ ./-](?=[0-9]{2}))?[0-9])"
_LOCAL = r"(?:(?:[ -](?=[0-9]{2}))?[0-9])"
_PHONES = (
    # North American, so that a number that follows stays out of it.
    r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}",
    # With a country code: 8 to 15 digits in groups of any size, or with an area code or a trunk zero in brackets.
    rf"(?:\+|(?<![0-9][ ./-])00)[1-9][0-9]{{0,2}} ?\([0-9]{{1,4}}\)(?:[ ./-])?[0-9]{_NEXT}{{4,11}}",
    rf"(?:\+|(?<![0-9][ ./-])00(?=[1-9][0-9]{{0,2}}[ ./-]))[1-9](?:[0-9]{{0,2}}[ ./-][0-9](?![0-9])|[0-9])?{_NEXT}{{7,13}}",
    # German, with the area code's zero; four and four digits with a hyphen are serials' numbers.
    rf"\(0[1-9][0-9]{{1,4}}\)[ /-]?[0-9]{_LOCAL}{{3,8}}",
    rf"0[1-9][0-9]{{1,2}}(?: ?[/-] ?| )[0-9]{_LOCAL}{{4,8}}|0[1-9][0-9]{{3,4}}(?: ?[/-] ?| )[0-9]{_LOCAL}{{3,7}}",
    # French in pairs, Spanish in 3-2-2-2 and 3-3-3.
    r"0[1-9](?<pair>[ .-])[0-9]{2}(?:\k<pair>[0-9]{2}){3}",
    r"(?<![0-9][ .,-])[6-9][0-9]{2}(?<gap>[ -])(?:[0-9]{2}\k<gap>[0-9]{2}\k<gap>[0-9]{2}|[0-9]{3}\k<gap>[0-9]{3})(?![ .,-]?[0-9])",
)
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Patterns by type; at one place the first that fits wins. Every repetition is bounded or possessive, so that long texts cost linear time.
TYPES: dict[str, str] = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}){1,8}(?![A-Za-z0-9-])",
    "secret": r"(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,255}+|sk-[0-9A-Za-z_-]{20,200}+|xox[abprs]-[0-9A-Za-z-]{10,200}+"
    # Hexadecimal ones after a word that tells what they are.
    r"|(?=[0-9A-Fa-f]{32})(?<=(?i:key|token|secret|passw|pwd|auth|bearer|credential|signature|api)[\w-]{0,12}[\"'`]{0,1}\s{0,2}[:=]{0,2}>{0,1}\s{0,2}[\"'`]{0,1})(?:[0-9a-f]{32,128}+|[0-9A-F]{32,128}+))(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}+| [0-9A-Z]{4} (?:[0-9]{4} ){1,6}[0-9]{1,4})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9])(?!\.[0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}(?![0-9A-Fa-f:])"
    # Compressed: a first group of three or four digits, two to seven colons, and a digit below ten, so that program text stays.
    r"|(?<![\p{L}\p{N}:.])(?=(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\p{L}\p{N}:]))(?=[A-Fa-f:]{0,40}[0-9])[0-9A-Fa-f]{3,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?",
    "card": r"(?<![0-9])(?<![0-9]\.)(?:[0-9]{4}(?<sep>[ -])[0-9]{4}\k<sep>[0-9]{4}\k<sep>[0-9]{4}|[0-9]{4}(?<long>[ -])[0-9]{6}\k<long>[0-9]{4,5}|[0-9]{13,19}+)(?![0-9])",
    "phone": rf"(?<![0-9+])(?:{'|'.join(_PHONES)}|" r"\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\+[0-9]{1,3}[ .-][0-9]{1,4}(?:[ .-][0-9]{2,4}){1,4}|\+[0-9]{8,15}+|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])",
    "name": rf"(?<!\p{{L}})(?:(?:(?:{_SHOUTED}) ){{1,3}}(?:{_INITIALS} ){{0,3}}{_CAPITALS}(?: (?:{_INITIALS} ){{0,2}}{_CAPITALS})?|{_TITLES}(?:{_INITIALS} ){{0,3}}{_FULL}(?: (?:{_INITIALS} ){{0,2}}{_FULL}){{0,2}})",
}
ANY = "|".join(TYPES.values())
#: Every mention has one of these, so that most texts need no closer look.
HINT = rf"@|[0-9]{{2}}|:[0-9A-Fa-f]{{0,4}}:|[0-9]\.[0-9]|AKIA|ASIA|gh[pousr]_|sk-|xox|[0-9A-Fa-f]{{32}}|(?:{_TITLE}|{_SHOUTED})\.? \p{{Lu}}"
#: What a mention is by itself; what is none of these is a name.
ALONE = TYPES | {"secret": r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]+|sk-[0-9A-Za-z_-]+|xox[abprs]-[0-9A-Za-z-]+|[0-9a-f]{32,}|[0-9A-F]{32,}"}
WORD = r"\p{L}{2,}"

_PRIVATE = r"10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|169\.254"
_HEX, _LOWER, _DIGITS = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _byte(stream: Column, i) -> Column:
    """Byte i (from 0) of a stream of hex digits."""
    return F.conv(F.substring(stream, F.lit(1) + i * 2, F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, number: Column) -> Column:
    return F.substring(F.lit(letters), number % len(letters) + 1, F.lit(1))


def _front(raw) -> Column:
    """The titles of a name, '' if it has none."""
    return F.regexp_extract(raw, rf"^{_TITLES}", 0)


def _words(raw: Column) -> Column:
    """The words of a name after its titles, without initials."""
    return F.regexp_extract_all(F.regexp_replace(raw, rf"^{_TITLES}", ""), F.lit(WORD), F.lit(0))


def _trunk(raw: str) -> Column:
    """A telephone number with a country code, its leading 00 and bracketed zero as signs that are no digits."""
    out = F.regexp_replace(F.regexp_replace(raw, "^00", "\ue000"), r"^([+\ue000].*?)\(0\)", "$1\ue001")
    return F.when(F.col(raw).rlike(r"^(?:\+|00)"), out).otherwise(F.col(raw))


def _parsed(raws: DataFrame) -> DataFrame:
    """(raw, n, kind, entity, given, gender): the parts of each mention; a name has one for each of its words. Kind ``none`` is no mention."""
    kind = reduce(lambda rest, x: F.when(F.col("raw").rlike(rf"^(?:{x[1]})$"), x[0]).otherwise(rest), reversed(ALONE.items()), F.lit("name"))
    flat = F.regexp_replace("raw", r"[^\p{L}\p{N}]", "")
    entity = (
        F.when(F.col("kind") == "email", F.lower("raw"))
        .when(F.col("kind").isin("ssn", "card"), flat)
        .when(F.col("kind") == "phone", F.concat(F.when(F.col("raw").rlike(r"^(?:\+|00)"), "+").otherwise(""), F.regexp_replace(_trunk("raw"), r"[^0-9]", "")))
        .when(F.col("kind") == "iban", F.upper(flat))
        .when((F.col("kind") == "ip") | F.col("raw").rlike("^[0-9A-F]{32,}$"), F.lower("raw"))
        .otherwise(F.col("raw"))
    )
    typed = raws.withColumn("kind", kind)
    unsure = (F.col("kind") == "card") & F.col("raw").rlike("^[0-9]+$") & (F.length("raw") != 16)
    typed = typed.withColumn("kind", F.when(unsure, F.when(_luhn(F.col("raw")) == 0, "card").otherwise("none")).otherwise(F.col("kind")))
    other = F.lit(None).cast("string").alias("gender")
    plain = typed.where("kind != 'name'").select("raw", F.lit(0).alias("n"), "kind", entity.alias("entity"), F.lit(False).alias("given"), other)
    names = typed.where("kind = 'name'").select("raw", F.lower(_front("raw")).alias("front"), _words(F.col("raw")).alias("words"))
    names = names.withColumn("titles", F.split(F.regexp_replace("front", r"\.? ", " "), " "))
    names = names.select("raw", "titles", F.posexplode("words").alias("n", "word"), (F.col("n") < F.size("words") - 1).alias("given"))
    lower = lambda own: [x.lower() for x in own]
    gender = (
        F.when(F.lower("word").isin(*MALE_GIVEN), "m")
        .when(F.lower("word").isin(*FEMALE_GIVEN), "f")
        .when(F.arrays_overlap("titles", F.array(*map(F.lit, lower(MALE_TITLES)))), "m")
        .when(F.arrays_overlap("titles", F.array(*map(F.lit, lower(FEMALE_TITLES)))), "f")
    )
    script = reduce(lambda rest, x: F.when(F.col("word").rlike(x[1]), x[0]).otherwise(rest), SCRIPTS.items(), F.lit("latin"))
    names = names.select("raw", "n", F.concat(F.lit("name:"), script).alias("kind"), F.lower("word").alias("entity"), "given", F.when(F.col("given"), gender).alias("gender"))
    return plain.unionByName(names)


def _entities(parts: DataFrame) -> DataFrame:
    """(kind, entity, form) of the distinct entities; the form of a name is family, m, f or u, by all of its mentions."""
    told = lambda g: F.coalesce(F.max(F.col("gender") == g), F.lit(False))
    found = parts.where("kind != 'none'").groupBy("kind", "entity").agg(F.max("given").alias("given"), told("m").alias("m"), told("f").alias("f"))
    form = F.when(~F.col("given"), "family").when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").otherwise("u")
    return found.select("kind", "entity", F.when(F.col("kind").startswith("name:"), form).otherwise("").alias("form"))


def _shaped(mask: Column, stream: Column, at: Column, hexed: bool = False) -> Column:
    """``mask`` with each letter and digit replaced by one of its kind; byte ``at`` + place of the stream decides."""

    def one(c, i):
        b = _byte(stream, i + at)
        out = F.when(c.rlike("[0-9]"), _pick(_DIGITS, b))
        if hexed:
            out = F.when(c.rlike("[0-9a-f]"), _pick(_HEX, b))
        return out.when(c.rlike("[A-Z]"), _pick(_LOWER.upper(), b)).when(c.rlike(r"\p{Ll}"), _pick(_LOWER, b)).otherwise(c)

    return F.array_join(F.transform(F.split(mask, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""

    def add(total, x):
        d = x.getField("c").cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return (total + F.when(x.getField("i") % 2 == 1, twice).otherwise(d)).cast("int")

    chars = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.aggregate(chars, F.lit(0), add) % 10


def _mod97(text: Column) -> Column:
    """The number that an account's letters and digits stand for, modulo 97."""

    def add(total, c):
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (total * 10 + c.cast("int")) % 97).otherwise((total * 100 + letter) % 97).cast("int")

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _spelled(syllables: list[str], endings: list[str], stream: Column, attempt: int) -> Column:
    """A name of some syllables and an ending; later attempts are longer."""
    own, ends = F.array(*map(F.lit, syllables)), F.array(*map(F.lit, endings))
    many = F.sequence(F.lit(1), _byte(stream, F.lit(8)) % 2 + 2 + attempt)
    stem = F.array_join(F.transform(many, lambda i: F.element_at(own, _byte(stream, i) % len(syllables) + 1)), "")
    return F.concat(stem, F.element_at(ends, _byte(stream, F.lit(9)) % len(endings) + 1))


def _candidates(entities: DataFrame, key: str, attempt: int) -> DataFrame:
    """``entities`` (kind, entity, form) with ``surrogate``, the one that the key and the attempt yield."""
    entity, kind = F.col("entity"), F.col("kind")

    def stream(name: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(F.length(name) / 16, F.lit(1)).cast("int"))
        return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", F.lit(key), kind, name, F.lit(str(attempt)), b.cast("string")).cast("binary"), 256)), "")

    zero = F.lit(0)
    rows = entities.withColumn("s", stream(entity))
    # Mail: the local part from the whole address, the domain from the domain alone.
    host = F.substring_index(entity, "@", -1)
    label = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), host).cast("binary"), 256)
    top = F.when(F.substring_index(host, ".", -1).isin("com", "net", "org"), F.substring_index(host, ".", -1)).otherwise("org")
    longer = "x" * max(0, attempt - 2)
    local = F.concat(_shaped(F.substring_index(entity, "@", 1), F.col("s"), zero), F.lit(longer))
    email = F.concat(local, F.lit("@"), _shaped(F.substring_index(host, ".", 1), label, zero), F.lit(".example."), top)
    prefix = F.regexp_extract(entity, r"^(AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-)", 1)
    rest = F.substring(entity, F.length(prefix) + 1, F.length(entity))
    secret = F.when(entity.rlike("^[0-9a-f]{32,}$"), _shaped(entity, F.col("s"), zero, True)).otherwise(F.concat(prefix, _shaped(rest, F.col("s"), zero)))
    body = _shaped(F.substring(entity, F.lit(5), F.length(entity)), F.col("s"), zero)
    land = F.substring(entity, 1, 2)
    check = F.lpad((F.lit(98) - _mod97(F.concat(body, land, F.lit("00")))).cast("string"), 2, "0")
    iban = F.concat(land, check, body)
    ssn = F.concat(F.lit("9"), _shaped(F.substring(entity, F.lit(2), F.length(entity)), F.col("s"), zero))
    octets = [(_byte(F.col("s"), F.lit(k)) % n + low).cast("string") for k, (n, low) in enumerate(((110, 11), (256, 0), (256, 0), (254, 1)))]
    # The other private networks are small: later attempts take the largest one.
    private = F.when(F.regexp_extract(entity, rf"^(?:{_PRIVATE})\.", 0) != "", "10").otherwise("") if attempt > 2 else F.regexp_extract(entity, rf"^({_PRIVATE})\.", 1)
    kept = F.when(F.length(private) > 0, F.size(F.split(private, r"\."))).otherwise(0)
    ip4 = F.when(kept == 0, F.concat_ws(".", *octets)).when(kept == 1, F.concat_ws(".", private, *octets[1:])).otherwise(F.concat_ws(".", private, *octets[2:]))
    ip = F.when(entity.contains(":"), _shaped(entity, F.col("s"), zero, True)).otherwise(ip4)
    if attempt >= WIDER:  # short addresses of either kind have few spellings: a whole one has enough
        ip = F.concat(F.lit("fd00:"), F.concat_ws(":", *[F.substring("s", 4 * k + 1, 4) for k in range(7)]))
    number = F.concat(F.substring(entity, 1, 1), _shaped(F.substring(entity, F.lit(2), F.length(entity)), F.col("s"), zero))
    stem = F.substring(number, F.lit(1), F.length(number) - 1)
    right = (F.lit(10) - _luhn(F.concat(stem, F.lit("0")))) % 10
    last = F.substring(number, -1, 1).cast("int")
    wrong = F.when(last == right, (last + 1) % 10).otherwise(last)
    card = F.concat(stem, F.when(_luhn(entity) == 0, right).otherwise(wrong).cast("string"))
    land_digits = F.when(entity.startswith("+1"), 2).when(entity.startswith("+"), 3).when(entity.startswith("0"), 1).otherwise(0)
    line = _shaped(F.substring(entity, land_digits + 2, F.length(entity)), F.col("s"), F.lit(1))
    first = (_byte(F.col("s"), zero) % 8 + 2).cast("string")
    phone = F.concat(F.substring(entity, F.lit(1), land_digits), first, line)
    if attempt < 4:  # numbers of a fictional exchange stay in it while there is room
        at = land_digits + 4
        fictional = (F.length(entity) - land_digits == 10) & (F.substring(entity, at, F.lit(3)) == "555")
        phone = F.when(fictional, F.concat(F.substring(phone, F.lit(1), at - 1), F.lit("555"), F.substring(phone, at + 3, F.lit(4)))).otherwise(phone)
    more = F.lit("")
    if attempt >= WIDER:
        more = _shaped(F.lit("0" * (attempt - WIDER + 2)), F.reverse(F.col("s")), zero)
    out = F.when(kind == "email", email)
    for name, own in {"secret": secret, "iban": iban, "ssn": ssn, "card": card, "phone": phone}.items():
        out = out.when(kind == name, F.concat(own, more))
    out = out.when(kind == "ip", ip)
    for (script, form), endings in ENDINGS.items():
        out = out.when((kind == f"name:{script}") & (F.col("form") == form), _spelled(SYLLABLES[script], endings, F.col("s"), attempt))
    return rows.withColumn("surrogate", out).drop("s")


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate): distinct surrogates for the distinct ``entities`` (kind, entity, form), none of them an entity itself."""
    real = entities.select("kind", F.col("entity").alias("surrogate"))
    waiting, given, attempt = entities, None, 0
    while True:
        tried = _candidates(waiting, key, attempt)
        free = tried.join(real, ["kind", "surrogate"], "left_anti")
        if given is not None:
            free = free.join(given.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity")).withColumn("won", F.lit(True))
        tried = stored(tried.join(won, ["kind", "surrogate", "entity"], "left"), "surrogates")
        done = tried.where("won").select("kind", "entity", "surrogate")
        given = done if given is None else given.unionByName(done)
        waiting = tried.where("won IS NULL").select("kind", "entity", "form")
        attempt += 1
        if not waiting.limit(1).count():
            return given


def _rendered(parts: DataFrame) -> DataFrame:
    """(raw, replacement) from rows (raw, n, kind, surrogate): the surrogate in the mention's own case and with its separators."""
    by_raw = parts.groupBy("raw").agg(F.min("kind").alias("kind"), F.transform(F.array_sort(F.collect_list(F.struct("n", "surrogate"))), lambda x: x["surrogate"]).alias("s"))
    plain = F.regexp_replace(F.col("s")[0], r"[^\p{L}\p{N}]", "")
    chars = F.split(F.when(F.col("kind") == "phone", _trunk("raw")).otherwise(F.col("raw")), "")
    # Letters and digits of the surrogate fill those of the mention in turn.
    place = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("n"), F.lit("").alias("out")),
        lambda a, c: F.struct(
            F.when(c.rlike(r"[\p{L}\p{N}]"), a["n"] + 1).otherwise(a["n"]).alias("n"),
            F.concat(a["out"], F.when(c.rlike(r"[\p{L}\p{N}]"), F.substring(plain, a["n"] + 1, F.lit(1))).otherwise(c)).alias("out"),
        ),
    )["out"]
    # A surrogate with more characters than the mention has places goes on after them.
    places = F.length(F.regexp_replace("raw", r"[^\p{L}\p{N}]", "")) - F.when((F.col("kind") == "phone") & F.col("raw").rlike("^00"), 2).otherwise(0)
    places = places - F.when((F.col("kind") == "phone") & F.col("raw").rlike(r"^(?:\+|00).*\(0\)"), 1).otherwise(0)
    place = F.concat(place, F.substring(plain, places + 1, F.length(plain)))
    phone = F.regexp_replace(F.regexp_replace(place, "\ue000", "00"), "\ue001", "(0)")
    shouted = F.col("raw") == F.upper("raw")
    cased = F.when(shouted, F.upper(F.col("s")[0])).otherwise(F.col("s")[0])
    # The words of a name are put in the places of its words; initials are that of the new family name.
    front, words = _front("raw"), _words(F.col("raw"))
    gaps = F.split(F.regexp_replace("raw", rf"^{_TITLES}", ""), WORD, -1)
    gaps = F.transform(gaps, lambda g: F.regexp_replace(g, F.lit(r"\p{Lu}(?=\.)"), F.upper(F.substring(F.element_at("s", -1), 1, 1))))
    cased_words = F.zip_with(words, F.col("s"), lambda w, x: F.when(w == F.upper(w), F.upper(x)).when(w == F.lower(w), x).otherwise(F.initcap(x)))
    names = F.array_join(F.zip_with(gaps, F.concat(cased_words, F.array(F.lit(""))), lambda g, x: F.concat(g, x)), "")
    out = (
        F.when(F.col("kind").startswith("name"), F.concat(front, names))
        .when(F.col("kind") == "phone", phone)
        .when(F.col("kind").isin("ssn", "card", "iban"), place)
        .when(F.col("kind") == "secret", F.when(F.col("raw").rlike("^[0-9A-F]+$"), F.upper(F.col("s")[0])).otherwise(F.col("s")[0]))
        .otherwise(cased)
    )
    return by_raw.select("raw", out.alias("replacement"), "kind")


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """(h1, h2, gone): the replacements, in order, for each distinct text of ``found`` (h1, h2, raws); h1 and h2 name the text."""
    mentions = stored(found.dropDuplicates(["h1", "h2"]), "mentions")
    each = mentions.select("h1", "h2", F.posexplode("raws").alias("at", "raw"))
    parts = stored(_parsed(each.select("raw").distinct()), "parts")
    assigned = assign(_entities(parts), key)
    rendered = _rendered(parts.join(assigned, ["kind", "entity"]))
    same = parts.where("kind = 'none'").select("raw", F.col("raw").alias("replacement"), "kind")
    rendered = stored(rendered.unionByName(same), "rendered")
    joined = each.join(rendered, "raw").groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("at", "replacement", "kind"))).alias("gone"))
    return stored(joined, "replacements")


def _pattern(raws: str) -> Column:
    """The pattern for a text with these mentions: ``ANY``, and the words of its titled names wherever they stand."""
    own = F.flatten(F.transform(F.filter(raws, lambda r: r.rlike(rf"^{_TITLES}")), _words))
    own = F.array_distinct(F.flatten(F.transform(own, lambda w: F.array(w, F.upper(w), F.initcap(w)))))
    longer = F.concat(F.lit(ANY + r"|(?<!\p{L})(?:"), F.array_join(own, "|"), F.lit(r")(?!\p{L})"))
    return F.when(F.size(own) > 0, longer).otherwise(F.lit(ANY))


def replace(docs: DataFrame, key: str = "spanmill") -> DataFrame:
    """(row, text, entities): each document as a struct, its text with surrogates, and what was replaced, in order."""
    none = F.array().cast("array<string>")
    raws = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(none)
    scanned = stored(docs.select(F.struct("*").alias("row"), F.coalesce(raws, none).alias("raws")), "scanned")
    kinds = "array<struct<at:int,replacement:string,kind:string>>"
    clean = scanned.where(F.size("raws") == 0).select("row", F.col("row.text").alias("text"), F.array().cast(kinds).alias("entities"))
    found = scanned.where(F.size("raws") > 0).select("row", F.col("row.text").alias("text"), _pattern("raws").alias("pattern"))
    found = found.select("row", "text", "pattern", F.regexp_extract_all("text", F.col("pattern"), F.lit(0)).alias("raws"), F.xxhash64("text").alias("h1"), F.crc32(F.col("text").cast("binary")).alias("h2"))
    gone = surrogates(found.select("h1", "h2", "raws"), key)
    gaps = F.split("text", F.col("pattern"), -1)
    fills = F.concat(F.transform("gone", lambda g: g["replacement"]), F.array(F.lit("")))
    text = F.array_join(F.zip_with(gaps, fills, lambda a, b: F.concat(a, b)), "")
    entities = F.filter("gone", lambda g: g["kind"] != "none").cast(kinds).alias("entities")
    return clean.unionByName(found.join(gone, ["h1", "h2"]).select("row", text.alias("text"), entities))


def replace_documents(docs: DataFrame, key: str = "spanmill") -> DataFrame:
    """``docs`` with surrogates in ``text``; all columns as before."""
    out = replace(docs, key)
    return out.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
