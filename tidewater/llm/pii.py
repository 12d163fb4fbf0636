"""Surrogates for personal data, with DataFrame functions only.

Entities are found by patterns. Each gets a surrogate derived from SHA-2 over key, type, attempt
and the entity's normal form (lower case, or its digits), so every mention of an entity reads the
same wherever it stands. The surrogate keeps the entity's shape: digits become digits, letters
letters of the same script and case, hexadecimal stays hexadecimal, e-mail domains keep their last
label, card numbers keep their checksum residue, addresses stay in range, and after a title the first of
two names becomes a given name of the same gender. Where a text names a person with a title, the
full name and the family name are replaced in the rest of that text as well.

Normal forms of all surrogates are checked over the whole corpus: where two entities would read the
same, or a surrogate equals an entity that really occurs, all but the first are derived again with
the next attempt until every entity has its own; after MAX_ATTEMPTS, or a round that settles none,
a surrogate is longer than its entity, by one character more each attempt. Only those exceptions are joined back to texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.tables import materialise, new_path

MAX_ATTEMPTS = 64
ENTITIES_PER_TASK = 4096

# What counts as an entity, tried in this order.
TITLES_M = "Mr|Herr|Monsieur|Señor|Don|Sir|Lord"
TITLES_F = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Doña|Lady"
TITLES = "Dr|Prof|Professor|Doctor|Docteur|Doktor"
PARTICLES = "von|vom|van|der|den|de|del|della|di|da|dos|du|la|le|zu|zur|ten|ter|bin|ibn|al|el"
NAME = r"\p{Lu}[\p{L}'’-]+"
INITIAL = r"\p{Lu}\.?"
SECRET_WORDS = "(?i:token|secret|password|passwd|api_key|apikey|access_key)"
MAIL = r"\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{N}_.+%-"
DOMAIN = r"[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+"
# a title as it stands or in capitals, up to three given names or initials, particles, the family name
TITLED = "(?:" + "|".join(t for group in (TITLES_M, TITLES_F, TITLES) for name in group.split("|") for t in (name, name.upper())) + r")\.?"
PERSON = rf"{TITLED} (?:{TITLED} )?(?:(?:{NAME}|{INITIAL}) ){{0,3}}(?:(?:{PARTICLES}) ){{0,3}}{NAME}"
PATTERNS = {
    "email": rf"(?<![{MAIL}])[{MAIL}]++@{DOMAIN}",
    "named_secret": rf"(?=[tspaTSPA]){SECRET_WORDS} ?[=:] ?[\"']?(?![{MAIL}]++@[\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_-])(?=[_+/=.-]*+[a-zA-Z0-9])[\w+/=.-]{{8,}}",
    "jwt": r"eyJ[\w-]{8,}\.[\w-]{4,}\.[\w-]{4,}",
    "ipv6": r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:])|(?=[a-fA-F:]*+[0-9])(?:[0-9a-fA-F]{1,4}:){1,6}:(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5})?(?![\w:])",
    "key": r"(?:AKIA|ASIA|ghp_|gho_|sk-|sk_live_|xox[abp]-|AIza)[\w-]{12,}",
    "hexadecimal": r"(?=[0-9]*+[a-fA-F])(?=[a-fA-F]*+[0-9])[0-9a-fA-F]{32,}+(?![\p{L}\p{N}])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ipv4": r"(?<!\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)",
    "ssn": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "card": r"\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}])",
    "phone": r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\p{L}\p{N}])"
    r"|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\p{L}\p{N}])"
    r"|(?<![.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\p{L}\p{N}]|[.-]\d)"
    r"|(?<![.-])0\d{3,4} \d{6,7}(?![\p{L}\p{N}]|[ .-]\d)",
    "person": PERSON,
}
GIVEN_M = [
    "James", "Peter", "Louis", "Carlos", "Martin", "Paul", "Oscar", "Hugo", "Felix", "David", "Simon", "Victor",
    "Adam", "Bruno", "Daniel", "Emil", "Frank", "Gabriel", "Henry", "Ivan", "Jacob", "Leo", "Marco", "Nicolas",
    "Omar", "Philip", "Robert", "Samuel", "Thomas", "William",
]
GIVEN_F = [
    "Maria", "Anna", "Julia", "Clara", "Laura", "Helena", "Sofia", "Emma", "Alice", "Nora", "Irene", "Lucia",
    "Amelia", "Bianca", "Carla", "Diana", "Elisa", "Flora", "Grace", "Hanna", "Ida", "Judith", "Lena", "Marta",
    "Nina", "Olga", "Paula", "Rosa", "Silvia", "Vera",
]
# alphabets: a character of the first is replaced by one of the second
LETTERS = [
    ("0123456789", "0123456789"),
    ("abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("абвгдежзийклмнопрстуфхцчшщъыьэюяё", "абвгдежзийклмнопрстуфхцчшщъыьэюя"),
    ("АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"),
    ("αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώ", "αβγδεζηθικλμνξοπρστυφχψω"),
    ("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩΆΈΉΊΌΎΏ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
]
# other scripts by their property and a range of letters
SCRIPTS = [
    ("IsHan", 0x4E00, 0x4EC0), ("IsHiragana", 0x3042, 0x3094), ("IsKatakana", 0x30A2, 0x30F4), ("IsHangul", 0xAC00, 0xACC0),
    ("IsArabic", 0x0628, 0x063A), ("IsHebrew", 0x05D0, 0x05EA), ("IsDevanagari", 0x0915, 0x0939), ("IsThai", 0x0E01, 0x0E2E),
    ("IsArmenian", 0x0561, 0x0586), ("IsGeorgian", 0x10D0, 0x10F0),
]
# end of fixed values

# e-mails and named secrets have their own start (a name may precede `token`); all others start where no word goes on
BOUND = [p for name, p in PATTERNS.items() if name not in ("email", "named_secret")]
ANY = rf"(?:{PATTERNS['email']}|{PATTERNS['named_secret']}|(?<![\p{{L}}\p{{N}}])(?:" + "|".join(BOUND) + "))"
# no entity is without one of these; a text that has none is not searched further
HINT = "[0-9@]"
WORD_HINT = rf"{TITLED} [\p{{L}}]|eyJ|::|{SECRET_WORDS} ?[=:]|(?:AKIA|ASIA|ghp_|gho_|sk-|sk_live_|xox[abp]-|AIza)"


def key_of(spark: SparkSession) -> str:
    """The secret of registered queries: the session's tidewater.surrogate.key, and where none is set a name that keeps nothing secret."""
    return spark.conf.get("tidewater.surrogate.key", "no secret")


def kind_of(entity: Column) -> Column:
    """Type of a string that the combined pattern has matched."""
    shapes = {
        "secret": rf"^{SECRET_WORDS} ?[=:]",
        "email": "^[^@ ]+@[^@ ]+$",
        "person": f"^{PERSON}$",
        "ipv6": "^[0-9a-fA-F]{1,4}:[0-9a-fA-F:]+$",
        "ipv4": r"^\d{1,3}(\.\d{1,3}){3}$",
        "ssn": r"^\d{3}-\d{2}-\d{4}$",
        "card": r"^\d(?:[ -]?\d){12,18}$",
        "iban": r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$",
        "phone": r"^[+(\d][\d ().-]+$",
    }
    out = F.lit("secret")
    for name, shape in reversed(shapes.items()):
        out = F.when(entity.rlike(shape), name).otherwise(out)
    return out


def _named(entity: Column) -> Column:
    """What stands before the value of a named secret, such as `token = "`; empty for other entities."""
    return F.regexp_extract(entity, rf"^({SECRET_WORDS} ?[=:] ?[\"']?)", 1)


def normal_form(entity: Column, kind: Column) -> Column:
    """What makes two mentions one entity."""
    digits = F.regexp_replace(entity, r"[^0-9]", "")
    return (
        F.when(kind.isin("card", "phone", "ssn"), digits)
        .when(kind.isin("email", "ipv6"), F.lower(entity))
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .when(kind == "person", F.regexp_replace(entity, r"\.", ""))
        .otherwise(F.substring(entity, F.length(_named(entity)) + 1, F.length(entity)))
    )


def _digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 512)


def _marks(k: int) -> str:
    """A private character that stands for the k-th alphabet."""
    return chr(0xE000 + k)


_TABLES = [choice for _, choice in LETTERS] + ["".join(map(chr, range(a, b + 1))) for _, a, b in SCRIPTS] + ["abcdef", "ABCDEF"]
_FROM = "".join(chars for chars, _ in LETTERS)
_TO = "".join(_marks(k) * len(chars) for k, (chars, _) in enumerate(LETTERS))


def _shape(text: Column) -> Column:
    """`text` with the mark of its alphabet in place of every letter and digit."""
    out = F.translate(text, _FROM, _TO)
    other = F.when(~out.rlike(r"[\p{L}\p{M}]"), out)
    full = out
    for k, (script, _, _) in enumerate(SCRIPTS, len(LETTERS)):
        full = F.regexp_replace(full, rf"[\p{{{script}}}&&[\p{{L}}\p{{M}}]]", _marks(k))
    full = F.regexp_replace(F.regexp_replace(full, r"\p{Lu}", _marks(2)), r"\p{L}", _marks(1))
    return F.coalesce(other, full)


def _hex_shape(text: Column) -> Column:
    lower, upper = len(_TABLES) - 2, len(_TABLES) - 1
    return F.translate(text, "0123456789abcdefABCDEF", _marks(0) * 10 + _marks(lower) * 6 + _marks(upper) * 6)


def _filled(shape: Column, digest: Column) -> Column:
    """Every mark of `shape` replaced by a keyed character of its alphabet; all else stays."""
    tables = F.array(*map(F.lit, _TABLES))
    known = "".join(map(_marks, range(len(_TABLES))))

    def one(c: Column, i: Column) -> Column:
        table = F.get(tables, F.when(c != "", F.instr(F.lit(known), c) - 1))
        return F.coalesce(F.substring(table, (F.pmod(F.xxhash64(digest, i), F.length(table)) + 1).cast("int"), F.lit(1)), c)

    return F.array_join(F.transform(F.split(shape, ""), one), "")


def _recoded(text: Column, digest: Column) -> Column:
    """Each letter and digit replaced by a keyed one of its own alphabet; other characters stay."""
    return _filled(_shape(text), digest)


def _drawn(digest: Column, n: int, salt: int) -> Column:
    """A keyed number below n."""
    return F.pmod(F.xxhash64(digest, F.lit(salt)), F.lit(n)).cast("int")


def _luhn(digits: Column) -> Column:
    """Checksum residue of a digit string, every second digit from the right doubled."""
    values = F.reverse(F.transform(F.split(digits, ""), lambda c: c.cast("int")))

    def doubled(v: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, v).otherwise(2 * v - F.when(v > 4, 9).otherwise(0))

    return F.pmod(F.aggregate(F.transform(values, doubled), F.lit(0), lambda a, v: a + v), F.lit(10))


def _poured(shape: Column, filling: Column, places: str) -> Column:
    """`filling` written into the places of `shape` that match `places`; what is longer follows."""
    chars = F.split(shape, "")

    def place(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(shape, F.lit(1), i + 1), f"[^{places}]", ""))
        return F.when(c.rlike(f"^[{places}]$"), F.substring(filling, before, F.lit(1))).otherwise(c)

    taken = F.length(F.regexp_replace(shape, f"[^{places}]", ""))
    return F.concat(F.array_join(F.transform(chars, place), ""), F.substring(filling, taken + 1, F.length(filling)))


def _let(value: Column, then) -> Column:
    """`then(value)` with `value` computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _given(title: Column, word: Column, digest: Column) -> Column:
    """A given name of the title's gender, in the word's script and capitals; a title that tells none takes either."""
    male = F.get(F.array(*map(F.lit, GIVEN_M)), _drawn(digest, len(GIVEN_M), 0))
    female = F.get(F.array(*map(F.lit, GIVEN_F)), _drawn(digest, len(GIVEN_F), 0))
    either = F.get(F.array(*map(F.lit, GIVEN_M + GIVEN_F)), _drawn(digest, len(GIVEN_M + GIVEN_F), 0))
    of = lambda titles: title.rlike(rf"(?i)^(?:{titles})\.?$")
    name = F.when(of(TITLES_M), male).when(of(TITLES_F), female).otherwise(either)
    name = F.when((F.upper(word) == word) & (F.length(word) > 1), F.upper(name)).otherwise(name)
    return F.when(word.rlike(r"^[\p{IsLatin}'’-]+$"), name).otherwise(_recoded(word, digest))


def _renamed(entity: Column, attempt: Column, key: str, more: Column) -> Column:
    """A person with titles and particles kept, given names drawn, initials and the family name recoded.

    Of two titles the first that tells a gender counts, as in `Herr Dr`.
    """
    words = F.split(entity, " ")
    titles = F.filter(words, lambda w: w.rlike(f"^{TITLED}$"))
    title = F.coalesce(F.get(F.filter(titles, lambda t: t.rlike(rf"(?i)^(?:{TITLES_M}|{TITLES_F})\.?$")), F.lit(0)), F.lit(""))

    def made(word: Column, i: Column) -> Column:
        family = F.concat(_recoded(word, _digest(key, "family", attempt, word)), more)
        return (
            F.when(i == F.size(words) - 1, family)
            .when((i < 2) & word.rlike(f"^{TITLED}$") | word.rlike(f"^(?:{PARTICLES})$"), word)
            .when(word.rlike(rf"^{INITIAL}$"), _recoded(word, _digest(key, "initial", attempt, word)))
            .otherwise(_given(title, word, _digest(key, "given", attempt, word)))
        )

    return F.array_join(F.transform(words, made), " ")


def surrogate(entity: Column, kind: Column, normal: Column, attempt: Column, key: str) -> Column:
    """The surrogate of one mention: the same for every mention of its entity, but for layout."""
    digest = _digest(key, kind, attempt, normal)

    def longer(char: str) -> Column:
        """Keyed characters of the alphabet of `char`, one more with each attempt after the last of equal length."""
        size = attempt - (MAX_ATTEMPTS - 1)
        return F.when(size > 0, _filled(F.repeat(F.lit(char), size), _digest(key, "longer", kind, attempt, normal))).otherwise("")

    digit, letter = _marks(0), _marks(1)

    def of_digits(fresh: Column) -> Column:
        """Cards, phone numbers, social security numbers and account numbers from recoded normal forms."""
        # what stands before ten digits is a country code and stays
        code = F.when(F.length(normal).between(11, 13), F.length(normal) - 10).otherwise(F.lit(0))
        phone = F.concat(F.substring(normal, F.lit(1), code), F.substring(fresh, code + 1, F.length(normal)))
        body = F.concat(F.substring(fresh, F.lit(1), F.length(fresh) - 1), longer(digit))
        check = F.pmod(_luhn(normal) - _luhn(F.concat(body, F.lit("0"))), F.lit(10))
        iban = F.concat(F.substring(normal, 1, 2), F.substring(fresh, F.lit(3), F.length(fresh)))
        filling = F.when(kind == "card", F.concat(body, check.cast("string"))).otherwise(
            F.concat(F.when(kind == "phone", phone).when(kind == "iban", iban).otherwise(fresh), longer(digit))
        )
        return F.when(kind == "iban", _poured(entity, filling, "0-9A-Z")).otherwise(_poured(entity, filling, "0-9"))

    domain = F.substring_index(normal, "@", -1)
    label = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1)
    email = F.concat(
        _recoded(F.substring_index(normal, "@", 1), digest), longer(letter), F.lit("@"),
        _recoded(label, _digest(key, "domain", label)), F.lit("."), F.substring_index(domain, ".", -1),
    )
    ip = F.concat_ws(".", *((_drawn(digest, 254, i) + 1).cast("string") for i in range(4)))
    ip = F.concat(ip, F.when(attempt >= MAX_ATTEMPTS, F.concat(F.lit("."), longer(digit))).otherwise(""))

    person = _renamed(entity, attempt, key, longer(letter))

    prefix = F.regexp_extract(normal, r"^(AKIA|ASIA|ghp_|gho_|sk-|sk_live_|xox[abp]-|AIza)", 1)
    rest = F.substring(normal, F.length(prefix) + 1, F.length(normal))
    shape = F.when(rest.rlike("^[0-9a-fA-F]+$"), _hex_shape(rest)).otherwise(_shape(rest))
    secret = F.concat(_named(entity), prefix, _filled(shape, digest), longer(digit))
    return (
        F.when(kind == "email", email)
        .when(kind == "person", person)
        .when(kind == "ipv4", ip)
        .when(kind == "ipv6", F.concat(_filled(_hex_shape(normal), digest), longer(digit)))
        .when(kind.isin("card", "phone", "ssn", "iban"), _let(_recoded(normal, digest), of_digits))
        .otherwise(secret)
    )


def found_in(text: Column) -> Column:
    """All entities of a text in order; none, as an empty array, where no hint of one stands."""
    hinted = text.rlike(HINT) | text.rlike(WORD_HINT)
    return F.when(hinted, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def exceptions(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(kind, normal, attempt) of the entities whose first surrogate is not their own.

    Each round derives the candidates of the entities still open, gives a candidate to the
    entity that comes first among those that want it, and leaves the others to the next attempt.
    What was given in all rounds is kept in one folder.
    """
    spark = docs.sparkSession
    mention = docs.select(F.explode(found_in(F.col(text_col))).alias("e")).distinct()
    mention = mention.select("e", kind_of(F.col("e")).alias("kind"))
    entity = mention.select("kind", normal_form(F.col("e"), F.col("kind")).alias("normal"), "e")
    entity = materialise(entity.groupBy("kind", "normal").agg(F.min("e").alias("e")), "entities")
    given = new_path(spark, "surrogates")
    schema = "kind string, want string, normal string, attempt int"
    entity.select("kind", F.col("normal").alias("want"), F.lit("").alias("normal"), F.lit(-1).alias("attempt")).write.parquet(given)
    opened, attempt, settled = entity, 0, 0
    while left := opened.count():
        wants = opened.repartition(-(-left // ENTITIES_PER_TASK), "kind", "normal").select("kind", "normal", "e", F.lit(attempt).alias("attempt"))
        made = _let(surrogate(F.col("e"), F.col("kind"), F.col("normal"), F.col("attempt"), key), lambda m: normal_form(m, F.col("kind")))
        wants = wants.withColumn("want", made)
        taken = spark.read.schema(schema).parquet(given).select("kind", "want").withColumn("taken", F.lit(True))
        first = Window.partitionBy("kind", "want").orderBy("normal")
        # a candidate is wanted by few: the window's groups are the collisions themselves
        ranked = wants.join(taken, ["kind", "want"], "left").withColumn("nth", F.row_number().over(first))
        ranked = materialise(ranked, "candidates")
        won = ranked.where("taken is null and nth = 1")
        won.select("kind", "want", "normal", "attempt").write.mode("append").parquet(given)
        opened = ranked.where("taken is not null or nth > 1").select("kind", "normal", "e")
        # where a round settles none, the values of equal length are used up
        settled = left - opened.count()
        attempt = attempt + 1 if settled or attempt >= MAX_ATTEMPTS else MAX_ATTEMPTS
    return spark.read.schema(schema).parquet(given).where("attempt > 0").select("kind", "normal", "attempt")


def _names(entity: Column) -> tuple[Column, Column]:
    """Full name, or nothing where there is one name only, and family name of a person with a title."""
    name = F.regexp_replace(entity, f"^{TITLED} (?:{TITLED} )?", "")
    return F.when(name.contains(" "), name).otherwise(""), F.regexp_extract(entity, r"(\S+)$", 1)


def _without_names(part: Column, people: Column) -> Column:
    """`part` with the names of `people` (e, made), known by their titles, replaced where they stand without one."""

    def one(text: Column, x: Column) -> Column:
        for name, new in zip(_names(x.e), _names(x.made), strict=True):
            text = F.when(name != "", F.regexp_replace(text, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), name, F.lit(r"\E(?![\p{L}\p{N}])")), new)).otherwise(text)
        return text

    return F.aggregate(people, part, one)


def replace(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """`docs` with every entity in `text_col` replaced, plus `count_col`; all other columns as they are.

    `key` is the caller's secret: who has it can tell which surrogate stands for a known value. Null
    text stays null with 0 entities, text without entities stays as it is, rows are neither lost nor
    merged; repeated rows read alike. An empty table gives an empty result. A column of the name
    `count_col` must not be there before; column names starting with `__` are taken by the operator.
    """
    if count_col in docs.columns:
        raise ValueError(f"the table has a column {count_col} already: name another one for the count")
    odd = exceptions(docs, key, text_col)
    text = F.col(text_col)
    with_found = docs.withColumn("__found", F.when(text.isNotNull(), found_in(text)))
    if odd.take(1):
        # rows with an exceptional mention get the attempts of their entities as a map
        at = with_found.withColumn("__row", F.monotonically_increasing_id())
        at = materialise(at, "found")
        one = at.select("__row", F.explode("__found").alias("e")).distinct()
        one = one.withColumn("kind", kind_of(F.col("e")))
        one = one.withColumn("normal", normal_form(F.col("e"), F.col("kind"))).join(odd, ["kind", "normal"])
        maps = one.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("e", "attempt"))).alias("__attempts"))
        with_found = at.join(materialise(maps, "attempts"), "__row", "left").drop("__row")
        attempt = lambda e: F.coalesce(F.try_element_at(F.col("__attempts"), e), F.lit(0))
    else:
        attempt = lambda e: F.lit(0)
    parts = F.split(text, ANY, -1)
    facts = F.transform("__found", lambda e: F.struct(e.alias("e"), kind_of(e).alias("kind")))
    facts = F.transform(facts, lambda x: F.struct(x.e.alias("e"), x.kind.alias("kind"), normal_form(x.e, x.kind).alias("normal")))
    made = F.transform(facts, lambda x: F.struct(x.e.alias("e"), x.kind.alias("kind"), surrogate(x.e, x.kind, x.normal, attempt(x.e), key).alias("made")))
    with_made = with_found.withColumn("__parts", F.when(F.size("__found") > 0, parts)).withColumn("__made", made)
    people = F.array_distinct(F.filter("__made", lambda m: m.kind == "person"))
    plain = F.when(F.exists("__made", lambda m: m.kind == "person"), F.transform("__parts", lambda p: _without_names(p, people))).otherwise(F.col("__parts"))
    joined = F.array_join(F.flatten(F.zip_with(plain, "__made", lambda p, m: F.array(p, F.coalesce(m.made, F.lit(""))))), "")
    changed = with_made.withColumn(text_col, F.when(F.size("__found") > 0, joined).otherwise(text))
    changed = changed.withColumn(count_col, F.greatest(F.coalesce(F.size("__found"), F.lit(0)), F.lit(0)))
    return changed.select(*docs.columns, count_col)
