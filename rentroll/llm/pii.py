"""Personal data replaced by surrogates.

Found are e-mail and IPv4 addresses, phone, card, social security and bank account numbers, access keys, passwords and
tokens in assignments, and names of people: after a title, a known given name with a family name, two or three
capitalised words after a word like "contact" or "signed by", and such words after a name and "and". Once a name is found
in a row, each of its words is replaced wherever the row has it alone, with the surrogate that it has in the name.

A surrogate comes from a keyed hash of the entity in its plain form (digits only, lower case, ...), so the same entity
gets the same surrogate in every document and in every spelling. It keeps type and format: letters stay letters, digits
digits, hex hex, punctuation, case and length as they are; country codes, card networks and check digits, top-level
domains and octet widths hold. Given names keep their gender, all names their script; a family name has one surrogate
with and without a given name.

Every distinct entity of the corpus is one row of a table. Where two entities got the same surrogate, or one got a
surrogate that is itself an entity of the corpus, all but the smallest are drawn again with the next attempt, until no
collision is left; so distinct entities stay distinct. A family name is one syllable longer with every attempt, and a late
attempt lengthens given names, local parts of addresses and secrets too, and a later one numbers and access keys (an IPv4
address becomes a private IPv6 address), so no format is used up. Only column functions run.
"""

from pyspark.sql import functions as F

from rentroll.llm.shared import save, whole

# Titles by the gender they tell.
TITLES = {
    "m": ["Mr", "Herr", "Sr", "Señor", "Monsieur", "Sir"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Sra", "Señora", "Madame", "Mme", "Lady"],
    "n": ["Dr", "Prof"],
}

# Common given names by script and gender.
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Richard Thomas Daniel Matthew Hans Peter Klaus Stefan Juan"
    " Carlos Miguel Pablo Pierre Jacques Philippe Laurent".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Susan Jessica Sarah Karen Emily Anna Ursula Sabine Petra Maria"
    " Carmen Lucia Sofia Marie Sophie Camille Isabelle".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Николай Михаил Андрей".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Екатерина".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παναγιώτης".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Αγγελική Βασιλική".split(),
}

# Syllables that family names are made of.
SYLLABLES = {
    "latin": "bar bel cor dan del far gar hal jor kel lan lor mar mel nor pal ros sal tor van ver wal wen zan".split(),
    "cyrillic": "бар бел вер гор дан кор лан лор мар мел нов пал рос сал тар яр".split(),
    "greek": "βαρ γαλ δελ θεο καλ λαμ μαρ νικ παν ροσ σταθ τζα φιλ χατ".split(),
}
FULL = 24  # from this attempt on a number is longer than the one it stands for
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}

ALL_TITLES = [t for ts in TITLES.values() for t in ts]
ALL_GIVEN = [n for ns in GIVEN.values() for n in ns]
# Words before a name.
CUES = [
    "contact", "attn", "attention", "dear", "regards", "sincerely", "signature", "signed", "signed by", "written by", "reported by",
    "sent by", "on behalf of", "name", "name is", "ask for", "speak to", "c/o",
]
# Words before a phone number without its country code.
PHONE_CUES = "tel telephone phone ph call mobile mob cell fax".split()
# Capitalised words that stand where a family name may.
NO_NAMES = (
    "The This That These Those It We You They He She And Or But If When Please Thank Thanks Sir Madam All Team Customer Customers"
    " Us Me Your Our My Info Support Service Services Sales Office Department Company Board Committee Street Road Avenue University Hospital License"
    " Foundation Inc Ltd Corp Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July"
    " August September October November December"
).split()
WORD = r"\p{Lu}(?=\p{L}|['’-]\p{L})\p{L}*+(?:['’-](?!s(?!\p{L}))\p{L}++){0,9}+"  # not the s of a genitive
AFTER = rf"(?!(?:{'|'.join(ALL_TITLES)})(?!\p{{L}})){WORD}"
LIKELY = rf"(?!(?:{'|'.join(NO_NAMES + ALL_TITLES)})(?!\p{{L}})){WORD}"
CUE = rf"(?<=(?<!\p{{L}})(?i:{'|'.join(CUES)})[:,]?\s{{1,3}})"
ALSO = r"(?<=\G(?: and | & | or ))(?<=\p{L}(?: and | & | or ))"  # what was found last ended just before, with a letter
NAME = (
    rf"(?:\b(?:{'|'.join(ALL_TITLES)})\.? {AFTER}(?: {AFTER}){{0,2}}|\b(?:{'|'.join(ALL_GIVEN)})(?: {AFTER}){{1,2}}"
    rf"|(?=\p{{Lu}})(?:{CUE}|{ALSO}){LIKELY}(?: {LIKELY}){{1,2}})"
)
NEAR_PHONE = rf"(?<=(?<!\p{{L}})(?i:{'|'.join(PHONE_CUES)})(?!\p{{L}})[^\p{{L}}\n]{{1,40}})"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Where an address may begin: not inside a run of its characters, so a long run is read once; after another entity, anywhere.
START = r"(?:(?<![A-Za-z0-9])(?<![A-Za-z0-9][._%+-])|(?<=\G[._%+-]{0,1}))"
TLD = r"\.(?:[Xx][Nn]--[A-Za-z0-9-]+|[A-Za-z]{2,})"
KEYWORDS = r"(?i:password|passwd|pwd|secret|token|api_?key)"
PATTERNS = [
    rf"{START}[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){{0,126}}{TLD}",  # a domain has 127 labels at most
    r"\bAKIA[0-9A-Z]{16}\b",
    rf"(?<=[=: \"'])(?<=(?<![A-Za-z]){KEYWORDS} ?[=:] ?[\"']?)[A-Za-z0-9+/_.!@#-]{{6,}}+",
    rf"(?=[\d(+])(?:(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)"  # numbers, looked for only where one may begin
    r"|(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)"
    r"|(?<![\d-])(?:\(\d{3}\) ?|\d{3}-)\d{3}-\d{4}(?![\d-])"
    r"|(?<![\d.,/+-])(?:0\d{2} \d{4} \d{4}|0\d{3} \d{3} ?\d{4}|0\d{4}[ -]\d{6}|0\d{4} \d{3} \d{3}|0[1-9](?:[ .]\d\d){4})(?![\d-])"
    rf"|(?<![\d.,/+-])(?=\d{{3}}[-. ]\d|0\d)(?:{NEAR_PHONE}(?:\d{{3}}-\d{{4}}|\d{{3}}[ .]\d{{3}}[ .]\d{{4}}|0\d{{1,4}}[ /-]\d{{3,8}}|0\d{{8,11}}))(?![\d-])"
    r"|(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))",
    r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    r"(?<![\d-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d-])",
    NAME,
]
ENTITY = "|".join(PATTERNS)
HINT = rf"[0-9@]|{KEYWORDS}|\b(?:{'|'.join(ALL_TITLES + ALL_GIVEN)})\b|(?=\p{{Lu}}){CUE}"  # the capital first: few places look back
# Marks around what was found and before a typed word of a name; a text that has such characters carries them escaped.
FOUND, TYPED, ESCAPE = "\x01", "\x02", "\x03"
ESCAPED = {ESCAPE: "\x03\x06", FOUND: "\x03\x04", TYPED: "\x03\x05"}


def kind_of(raw):
    """Type of a found entity, by its shape."""
    kinds = [
        ("email", rf"^[^@]+@[^@]+{TLD}$"),
        ("access_key", r"^AKIA[0-9A-Z]{16}$"),
        ("ip", r"^\d{1,3}(?:\.\d{1,3}){3}$"),
        ("phone", r"^(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|(?:\(\d{3}\) ?|\d{3}-)\d{3}-\d{4}"
         r"|0\d[\d ./-]{6,14}|\d{3}-\d{4}|\d{3}[ .]\d{3}[ .]\d{4})$"),
        ("ssn", r"^\d{3}-\d{2}-\d{4}$"),
        ("iban", r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$"),
        ("card", r"^\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}$"),
        ("name", r"^\p{Lu}[\p{L}.'’-]+ \p{Lu}[\p{L}'’ -]*$"),
    ]
    out = F.lit("secret")
    for name, pattern in reversed(kinds):
        out = F.when(raw.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def plain(kind, raw):
    """The form in which spellings of one entity agree."""
    digits = F.regexp_replace(raw, r"[^0-9]", "")
    return (
        F.when(kind.isin("phone", "ssn", "card"), digits)
        .when(kind == "iban", F.regexp_replace(raw, " ", ""))
        .when((kind == "email") | kind.startswith("given") | kind.startswith("family"), F.lower(raw))
        .otherwise(raw)
    )


def script_of(word):
    out = F.lit("latin")
    for name, pattern in SCRIPTS.items():
        out = F.when(word.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def name_words(raw):
    """A name word by word as (kind, raw, lead); ``lead`` stands before the word."""
    words_ = F.split(raw, " ")
    title = F.regexp_replace(words_[0], r"\.", "")
    titled = title.isin(ALL_TITLES)
    told = F.when(title.isin(TITLES["m"]), "m").when(title.isin(TITLES["f"]), "f").otherwise("n")
    last = F.size(words_) - 1

    def one(word, i):
        gender = F.coalesce(*[F.when(word.isin(ns), F.lit(g)) for (_, g), ns in GIVEN.items()])
        first = F.when(titled, 1).otherwise(0)
        given = F.coalesce(gender, F.when((i == first) & (i < last), told))
        what = F.when(given.isNotNull(), F.concat(F.lit("given_"), given)).otherwise(F.lit("family"))
        what = F.when(titled & (i == 0), F.lit("title")).otherwise(F.concat(what, F.lit("_"), script_of(word)))
        return F.struct(what.alias("kind"), word.alias("raw"), F.when(i == 0, "").otherwise(" ").alias("lead"))

    return F.transform(words_, one)


def escaped(text):
    for char, code in ESCAPED.items():
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescaped(text):
    for char, code in reversed(ESCAPED.items()):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def is_name(entity):
    return entity.rlike(r"^\p{Lu}[\p{L}.'’-]+ \p{Lu}")


def let(value, use):
    """``use`` of a value that is evaluated once, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def odd(parts):
    return F.filter(parts, lambda _, i: i % 2 == 1)


def known_words(entities):
    """Word in lower case -> kind of the words of these entities' names; a given name of known gender comes first."""
    words_ = F.flatten(F.transform(F.filter(entities, is_name), name_words))
    words_ = F.filter(words_, lambda w: w["kind"] != "title")
    ranked = F.transform(words_, lambda w: F.struct(
        F.lower(w["raw"]).alias("word"),
        F.when(w["kind"].rlike("^given_[mf]"), 0).when(w["kind"].startswith("given"), 1).otherwise(2).alias("rank"),
        w["kind"].alias("kind"),
    ))

    def first_of_each(sorted_):
        first = F.filter(sorted_, lambda w, i: (i == 0) | (F.get(sorted_, i - 1)["word"] != w["word"]))
        return F.map_from_entries(F.transform(first, lambda w: F.struct(w["word"], w["kind"])))

    return let(F.array_sort(F.array_distinct(ranked)), first_of_each)


def with_lone_words(parts, known):
    """Texts and entities by turns -> the same with names as typed words, those that stand alone in the texts too."""

    def typed(kind, lead, raw):
        return F.concat(F.lit(TYPED), kind, F.lit("|"), lead, raw)

    def named(entity):
        words_ = F.transform(name_words(entity), lambda w: typed(
            F.when(w["kind"] == "title", "title").otherwise(F.coalesce(F.try_element_at(known, F.lower(w["raw"])), w["kind"])),
            w["lead"], w["raw"],
        ))
        return F.array_join(words_, "")

    def lone(word):
        kind = F.try_element_at(known, F.lower(word))
        return F.coalesce(F.concat(F.lit(FOUND), typed(kind, F.lit(""), word), F.lit(FOUND)), word)

    def in_text(text):
        pieces = F.split(F.regexp_replace(text, WORD, f"{FOUND}$0{FOUND}"), FOUND, -1)
        return F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, lone(x)).otherwise(x)), "")

    def one(x, i):
        return F.when(i % 2 == 0, in_text(x)).otherwise(F.concat(F.lit(FOUND), F.when(is_name(x), named(x)).otherwise(x), F.lit(FOUND)))

    return F.split(F.array_join(F.transform(parts, one), ""), FOUND, -1)


def parts_of(entity):
    """The entity as (kind, raw, lead): names word by word, all else whole."""
    words_ = F.transform(F.split(F.substring(entity, 2, 2**31 - 1), TYPED, -1), lambda w: F.struct(
        F.substring_index(w, "|", 1).alias("kind"),
        F.regexp_replace(w, r"^[^|]*\| ?", "").alias("raw"),
        F.when(w.contains("| "), " ").otherwise("").alias("lead"),
    ))
    whole_ = F.array(F.struct(kind_of(entity).alias("kind"), entity.alias("raw"), F.lit("").alias("lead")))
    return F.when(entity.startswith(TYPED), words_).otherwise(whole_)


def number(hash_, i, n):
    """A number below n from place i of a hex string."""
    return F.pmod(F.conv(F.substring(hash_, F.pmod(i, F.lit(120)) * 4 + 1, F.lit(4)), 16, 10).cast("int"), F.lit(n))


def pick(hash_, i, items):
    return F.element_at(F.array(*[F.lit(x) for x in items]), number(hash_, i, len(items)) + 1)


def char_like(hash_, c, i, hexed):
    """A character of the same class as ``c``."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return (
        F.when(hexed & c.rlike("[0-9a-f]"), F.substring(F.lit("0123456789abcdef"), number(hash_, i, 16) + 1, F.lit(1)))
        .when(c.rlike("[0-9]"), number(hash_, i, 10).cast("string"))
        .when(c.rlike("[a-z]"), F.substring(F.lit(letters), number(hash_, i, 26) + 1, F.lit(1)))
        .when(c.rlike("[A-Z]"), F.substring(F.lit(letters.upper()), number(hash_, i, 26) + 1, F.lit(1)))
        .otherwise(c)
    )


def reshaped(hash_, text, hexed=None):
    hexed = F.lit(False) if hexed is None else hexed
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: char_like(hash_, c, i, hexed)), "")


def digit(char):
    return F.coalesce(char.try_cast("int"), F.lit(0))


def with_check_digit(digits):
    """The last digit set so that the card number passes the usual check."""
    body = F.split(F.reverse(F.expr(f"left({digits}, length({digits}) - 1)")), "")
    doubled = F.transform(body, lambda d, i: digit(d) * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))
    return F.concat(F.expr(f"left({digits}, length({digits}) - 1)"), F.pmod(10 - total % 10, F.lit(10)).cast("string"))


def valid_card(digits):
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: digit(d) * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def remainder(text):
    """A bank account number in its order of checking, letters as 10 to 35, modulo 97."""
    moved = F.split(F.concat(F.expr(f"substring({text}, 5)"), F.expr(f"left({text}, 4)")), "")

    def add(s, c):
        return F.when(c.rlike("[0-9]"), s * 10 + digit(c)).otherwise(s * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(moved, F.lit(0), add)


def drawn(entities, key):
    """Entities with ``surrogate`` for their ``attempt``."""
    seed = F.concat_ws("|", F.lit(key), "kind", "plain", F.col("attempt").cast("string"))
    stream = F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{n}")), 256) for n in range(8)])  # 480 hex digits and more
    df = entities.withColumn("h", stream)
    h, p, kind = F.col("h"), F.col("plain"), F.col("kind")
    at = F.instr(p, ".")
    late = F.greatest(F.col("attempt") - 7, F.lit(0))  # their own lengths are used up
    zeros = F.repeat(F.lit("0"), F.greatest(F.col("attempt") - (FULL - 1), F.lit(0)))
    longer = F.concat(p, zeros)
    grown = F.concat(F.repeat(F.lit("a"), late), F.regexp_replace(p, f"{TLD}$", ""))
    email = F.concat(reshaped(h, grown), F.regexp_extract(p, f"{TLD}$", 0))
    octets = F.transform(F.split(p, r"\."), lambda o, i: (
        F.when(F.length(o) == 1, 1 + number(h, i, 9))
        .when(F.length(o) == 2, 10 + number(h, i, 90))
        .otherwise(100 + number(h, i, 156))
    ).cast("string"))
    wide = F.transform(F.split(p, r"\."), lambda o, i: (100 + number(h, i, 156)).cast("string"))
    every = F.transform(F.split(p, r"\."), lambda o, i: number(h, i, 256).cast("string"))
    ip = F.when(F.col("attempt") < 8, octets).when(F.col("attempt") < 16, wide).otherwise(every)  # too few of that width
    other = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.substring(h, i * 4 + 1, F.lit(4))), ":")
    ip = F.when(F.col("attempt") < FULL, F.array_join(ip, ".")).otherwise(F.concat(F.lit("fd00::"), other))
    kept = F.greatest(F.length(p) - 10, F.when(p.startswith("0"), 1).otherwise(0))  # country code or the zero of a trunk call
    phone = F.concat(F.left(p, kept), (2 + number(h, F.lit(100), 8)).cast("string"),
                     reshaped(h, F.substring(longer, kept + 2, F.length(longer))))
    family = F.lit(None)
    given = F.lit(None)
    for script, syllables in SYLLABLES.items():
        made = F.array_join(F.transform(F.sequence(F.lit(0), F.col("attempt") + 3), lambda i: pick(h, i, syllables)), "")
        family = F.when(kind == f"family_{script}", made).otherwise(family)
        extra = F.when(F.col("attempt") < 4, F.lit("")).otherwise(F.concat(F.lit("-"), made))  # the list is used up
        for gender in "mfn":
            names = [n.lower() for (s, g), ns in GIVEN.items() if s == script and gender in (g, "n") for n in ns]
            given = F.when(kind == f"given_{gender}_{script}", F.concat(pick(h, F.lit(9), names), extra)).otherwise(given)
    hexed = ~p.rlike("[^0-9a-f]") & p.rlike("[a-f]")
    more = F.when(p.rlike("[a-z]"), "a").when(p.rlike("[A-Z]"), "A").when(p.rlike("[0-9]"), "0")
    secret = F.concat(p, F.when(more.isNull(), F.repeat(F.lit("a"), F.col("attempt"))).otherwise(F.repeat(more, late)))
    body = reshaped(h, F.substring(longer, 2, 100))
    df = df.withColumn("card", F.concat(F.substring(p, 1, 1), body)).withColumn("card_ok", valid_card(p))
    card = F.when(F.col("card_ok"), with_check_digit("card")).otherwise(F.col("card"))
    body = F.concat(F.substring(p, 1, 2), F.lit("00"), reshaped(h, F.substring(longer, 5, 100)))
    df = df.withColumn("iban", body).withColumn("iban_ok", remainder("plain") == 1).withColumn("rest", remainder("iban"))
    checked = F.when(F.col("iban_ok"), F.lpad((98 - F.col("rest")).cast("string"), 2, "0")).otherwise(reshaped(h, F.substring(p, 3, 2)))
    iban = F.concat(F.substring(p, 1, 2), checked, F.substring("iban", 5, 100))
    surrogate = (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "phone", phone)
        .when(kind == "card", card)
        .when(kind == "access_key", F.concat(F.lit("AKIA"), reshaped(h, F.substring(longer, 5, 100))))
        .when(kind == "ssn", reshaped(h, longer))
        .when(kind == "iban", iban)
        .when(kind.startswith("family"), family)
        .when(kind.startswith("given"), given)
        .otherwise(reshaped(h, secret, hexed))
    )
    return df.withColumn("surrogate", surrogate).select("kind", "plain", "attempt", "surrogate")


def surrogates(entities, key, attempts=60):
    """(kind, plain, surrogate), one row per distinct entity, surrogates distinct within a kind and never an entity."""
    table = save(drawn(entities.select("kind", "plain", F.lit(0).alias("attempt")).distinct(), key), "surrogates")
    real = table.select("kind", F.col("plain").alias("surrogate"))
    for _ in range(attempts):
        first = table.groupBy("kind", "surrogate").agg(
            F.min(F.struct("attempt", "plain")).alias("first"), F.count(F.lit(1)).alias("n")
        )
        clash = table.join(first.filter("n > 1"), ["kind", "surrogate"]).filter(F.struct("attempt", "plain") != F.col("first"))
        taken = table.join(real, ["kind", "surrogate"], "left_semi")
        again = save(clash.select("kind", "plain").union(taken.select("kind", "plain")).distinct(), "collisions")
        if again.isEmpty():
            return table.select("kind", "plain", "surrogate")
        redrawn = table.join(again, ["kind", "plain"], "left_semi").withColumn("attempt", F.col("attempt") + 1).drop("surrogate")
        table = save(table.join(again, ["kind", "plain"], "left_anti").unionByName(drawn(redrawn, key)), "surrogates")
    raise RuntimeError(f"surrogates still collide after {attempts} attempts")


def rendered(kind, raw, surrogate):
    """The surrogate in the spelling of this occurrence."""
    digits = F.split(surrogate, "")
    none = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))

    def fill(s, c, takes):
        used = F.get(digits, s["at"])
        return F.when(takes, F.struct(F.concat(s["text"], used).alias("text"), (s["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(s["text"], c).alias("text"), s["at"].alias("at"))
        )

    def filled(s):  # and what is longer than the entity
        return F.concat(s["text"], F.substring(surrogate, s["at"] + 1, F.length(surrogate)))

    in_digits = F.aggregate(F.split(raw, ""), none, lambda s, c: fill(s, c, c.rlike("[0-9]")), filled)
    spaced = F.aggregate(F.split(raw, ""), none, lambda s, c: fill(s, c, c != " "), filled)
    cased = F.array_join(F.zip_with(F.split(raw, ""), digits, lambda a, b: F.when(a.rlike("[A-Z]"), F.upper(b)).otherwise(b)), "")
    named = F.when(raw == F.upper(raw), F.upper(surrogate)).when(raw == F.lower(raw), surrogate).otherwise(
        F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, F.lit(2), F.length(surrogate)))
    )
    return (
        F.when(surrogate.isNull(), raw)
        .when(kind.isin("phone", "ssn", "card"), in_digits)
        .when(kind == "iban", spaced)
        .when(kind == "email", cased)
        .when(kind.startswith("given") | kind.startswith("family"), named)
        .otherwise(surrogate)
    )


def replace(documents, key):
    """One row per row of ``documents`` (doc_id, text): doc_id, text with surrogates, n_entities, kinds.

    ``kinds`` lists the distinct types found, sorted and comma-joined. Null text counts as empty. Repeated rows are
    replaced alike; rows that share a doc_id are kept apart. An empty table gives an empty result; further columns are
    ignored. Surrogates depend on the key and on which entities the corpus holds.
    """
    rows = documents.select("doc_id", whole("text").alias("text"))
    may = F.col("text").rlike(HINT)
    found = rows.filter(may).select("doc_id", F.split(F.regexp_replace(escaped(F.col("text")), ENTITY, f"{FOUND}$0{FOUND}"), FOUND, -1).alias("p"))
    names = F.exists(odd(F.col("p")), is_name)
    found = found.withColumn("p", F.when(names, let(known_words(odd(F.col("p"))), lambda known: with_lone_words(F.col("p"), known))).otherwise(F.col("p")))
    found = save(found.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.transform(F.filter("p", lambda _, i: i % 2 == 0), unescaped).alias("between"),
        odd(F.col("p")).alias("entities"),
    ), "found")
    each = found.select("row", F.posexplode("entities").alias("place", "entity"))
    type_ = F.when(F.col("entity").startswith(TYPED), F.lit("name")).otherwise(kind_of(F.col("entity")))
    parts = each.withColumn("type", type_).select("row", "place", "type", F.posexplode(parts_of(F.col("entity"))).alias("part", "x"))
    parts = parts.select("row", "place", "part", "type", "x.*").withColumn("plain", plain(F.col("kind"), F.col("raw")))
    drawn_ = surrogates(parts.filter("kind != 'title'").select("kind", "plain").distinct(), key)
    spoken = parts.join(drawn_, ["kind", "plain"], "left").withColumn(
        "said", F.concat("lead", rendered(F.col("kind"), F.col("raw"), F.col("surrogate")))
    )
    per_entity = spoken.groupBy("row", "place", "type").agg(F.sort_array(F.collect_list(F.struct("part", "said"))).alias("said"))
    per_row = per_entity.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("place", F.array_join("said.said", "").alias("said")))).alias("said"),
        F.count(F.lit(1)).alias("n_entities"),
        F.array_join(F.sort_array(F.collect_set("type")), ",").alias("kinds"),
    )
    filled = F.zip_with("between", F.col("said.said"), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    changed = found.filter(F.size("entities") > 0).join(per_row, "row").select(
        "doc_id", F.array_join(filled, "").alias("text"), "n_entities", "kinds"
    )
    none = found.filter(F.size("entities") == 0).select(
        "doc_id", F.array_join("between", "").alias("text"), F.lit(0).cast("bigint").alias("n_entities"), F.lit("").alias("kinds")
    )
    same = rows.filter(~may).select("doc_id", "text", F.lit(0).cast("bigint").alias("n_entities"), F.lit("").alias("kinds"))
    return same.unionByName(none).unionByName(changed)
