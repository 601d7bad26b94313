"""Surrogates for personal data: keyed, of the same type and shape, distinct, and the same wherever an entity recurs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, skew_join, stored

#: Titles before a name, by gender; they stay as they are.
TITLES = {
    "woman": "Mrs Ms Miss Madam Frau Madame Mademoiselle Mme Mlle Señora Señorita Sra Srta Госпожа г-жа Κυρία".split(),
    "man": "Mr Mister Sir Herr Herrn Monsieur Señor Sr Господин г-н Κύριος".split(),
    "person": "Dr Doctor Prof Professor Профессор Доктор".split(),
}
WORD = r"[\p{Lu}\p{Lo}](?:['’]\p{Lu})?[\p{L}\p{M}]*+"
NAME = rf"{WORD}(?:[ -]{WORD}){{0,4}}"
#: Signs of a secret, which stay as they are, and what it looks like.
LABEL = r"(?i:api|access|auth|client|private|secret)?[_-]?(?i:key|token|secret)"
PASSWORD = r"(?i:passwords?|passwd|passphrase|pwd)"
ASSIGNS = r"[\"']? {0,3}[=:] {0,3}[\"']?"
TOKEN = r"[A-Za-z0-9_+/.~=-]"
#: First digits of payment cards' numbers by issuer, for numbers of four groups.
ISSUER = r"(?:4\d{3}|5[1-5]\d\d|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)|6(?:011|5\d\d|4[4-9]\d)|35(?:2[89]|[3-8]\d))"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
GROUP = r"[0-9A-Fa-f]{1,4}"
#: Prefix and core of entities by type; of those that begin at the same place the first in this order is taken.
#: Nothing is repeated without a bound but single characters, which the regex engine takes in a loop: no text is too long for its stack.
PATTERNS = {
    "email": ("", r"(?<![._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}][\p{L}\p{N}.-]*\.\p{L}{2,}"),
    "token": (r"(?:AKIA|ASIA|gh[pousr]_|github_pat_|sk-|xox[abprs]-|AIza|(?i:bearer) (?=[^\s]{16}))", rf"(?=[^\d\s]{{0,100}}\d){TOKEN}{{16,}}"),
    "jwt": ("", r"eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}(?:\.[A-Za-z0-9_-]+)?"),
    "password": (rf"{PASSWORD}{ASSIGNS}", r"(?=[^\d\s\"'<>]{0,100}\d)[^\s\"'<>,;]{6,}(?<![.)\]}])"),
    "secret": (rf"{LABEL}{ASSIGNS}", rf"(?=[^\d\s]{{0,200}}\d){TOKEN}{{12,}}"),
    "hex": ("", r"(?=[a-fA-F]{0,31}\d)(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])"),
    "iban": ("", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "card": ("", rf"(?<![.-])(?:\d{{4}}[ -]\d{{4}}[ -]\d{{4}}[ -]\d{{4}}|{ISSUER}\d{{12}}|3[47]\d\d[ -]?\d{{6}}[ -]?\d{{5}})(?![\d-])"),
    "ssn": ("", r"(?<![.-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "ip": ("", rf"(?<!\.)(?<!(?i:version|release|ver\.?) )(?:{OCTET}\.){{3}}{OCTET}(?![\p{{L}}\d]|\.\d)"),
    "ipv6": ("", rf"(?<![:.])(?:(?:{GROUP}:){{7}}{GROUP}|(?=[0-9A-Fa-f:]{{0,30}}\d)(?:{GROUP}:){{1,6}}(?::{GROUP}){{1,6}})(?![\p{{L}}\d:])"),
    "phone": (
        "",
        r"(?:(?<![+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![(+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]))",
    ),
    **{gender: (rf"(?:{'|'.join(titles)})\.?[  ]", NAME) for gender, titles in TITLES.items()},
}
NAMES = tuple(TITLES)
#: What the alternatives can begin with; most places in a text begin none of them.
_BEGINS = {"token": "[AgsxbB]", "jwt": "e", "password": "[pP]", "secret": "[aAcCkKpPsStT_-]", "hex": "[0-9a-fA-F]", "iban": "[A-Z]", "card": r"\d", "ssn": r"\d", "ip": r"\d", "ipv6": "[0-9A-Fa-f]", "phone": r"[+(\d]", **{g: f"[{''.join(sorted({t[0] for t in titles}))}]" for g, titles in TITLES.items()}}
ENTITY = r"(?<![\p{L}\p{N}])(?:" + "|".join((f"(?={_BEGINS[k]})" if k in _BEGINS else "") + f"{prefix}(?:{core})" for k, (prefix, core) in PATTERNS.items()) + ")"
#: A name after a title, and in texts with one also each word that may be a part of it.
TITLED = r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?={_BEGINS[g]}){PATTERNS[g][0]}{NAME}" for g in NAMES) + ")"
ENTITY_OR_WORD = rf"{ENTITY}|(?<![\p{{L}}\p{{N}}]){WORD}(?![\p{{N}}@])"
#: Every entity but a name has one of these, every name one of the titles: what texts are looked through for first.
SIGNS = "[0-9@=:]"
#: Syllables of surrogate names, and their endings by gender.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi ga ge ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se so ta te to va ve vi".split(),
    "cyrillic": "ба бе би бо да де ди до фа фе га ге ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се со та те то ва ве ви".split(),
    "greek": "βα βε βι βο δα δε δι δο φα φε φι γα γε κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σο τα τε το ζα ζε ζι".split(),
}
ENDINGS = {
    ("latin", "woman"): ["na", "lia", "ra", "sa"], ("latin", "man"): ["n", "rd", "lt", "k"], ("latin", "person"): ["s", "m", "th", "l"],
    ("cyrillic", "woman"): ["на", "лия", "ра", "са"], ("cyrillic", "man"): ["н", "рд", "лт", "к"], ("cyrillic", "person"): ["с", "м", "ш", "л"],
    ("greek", "woman"): ["να", "λια", "ρα", "σα"], ("greek", "man"): ["νος", "ρος", "κος", "λος"], ("greek", "person"): ["ξ", "ψ", "ρ", "ν"],
}
SCRIPTS = {"latin": r"\p{IsLatin}", "cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}
#: Characters by pattern: the first code point and the number of those from it on that stand in for them.
LETTERS = [
    (r"^\d$", 0x30, 10), (r"^[\p{Lu}&&\p{IsLatin}]$", 0x41, 26), (r"^\p{IsLatin}$", 0x61, 26), (r"^[\p{Lu}&&\p{IsCyrillic}]$", 0x410, 32), (r"^\p{IsCyrillic}$", 0x430, 32),
    (r"^[\p{Lu}&&\p{IsGreek}]$", 0x391, 17), (r"^\p{IsGreek}$", 0x3B1, 17), (r"^\p{IsHan}$", 0x4E00, 20000), (r"^\p{IsHangul}$", 0xAC00, 11172), (r"^\p{IsHiragana}$", 0x3042, 80), (r"^\p{IsKatakana}$", 0x30A2, 80),
    (r"^\p{IsHebrew}$", 0x5D0, 27), (r"^\p{IsArabic}$", 0x628, 19), (r"^\p{IsDevanagari}$", 0x915, 37), (r"^\p{IsThai}$", 0xE01, 46), (r"^[\p{Lu}&&\p{IsArmenian}]$", 0x531, 38), (r"^\p{IsArmenian}$", 0x561, 38), (r"^\p{IsGeorgian}$", 0x10D0, 33),
]
#: After so many attempts, and again after as many, surrogates are a syllable, letter or digit longer: there is always room.
ATTEMPTS = 4


def split_entity(entity: Column) -> Column:
    """(kind, prefix, core) of what ENTITY finds; the kind is null for a number that only looks like a card's."""
    kind, prefix = F.lit(None).cast("string"), F.lit("")
    for name, (before, core) in reversed(PATTERNS.items()):
        here = entity.rlike(f"^{before}(?:{core})$")
        if name == "card":
            here = here & (entity.rlike("[ -]") | (F.substr(entity, F.lit(-1), F.lit(1)) == _check_digit(entity)))
        kind = F.when(here, F.lit(name)).otherwise(kind)
        if before:
            prefix = F.when(here, F.regexp_extract(entity, f"^{before}", 0)).otherwise(prefix)
    return F.struct(kind.alias("kind"), prefix.alias("prefix"), F.substr(entity, F.length(prefix) + 1).alias("core"))


def _byte(i: str) -> str:
    """SQL for the i-th byte of column ``stream``, which starts again at its end."""
    return f"CAST(conv(substr(stream, ({i}) % 256 * 2 + 1, 2), 16, 10) AS INT)"


def _pick(names: list[str], i: str) -> str:
    return f"element_at(split('{' '.join(names)}', ' '), {_byte(i)} % {len(names)} + 1)"


def _letters(of: str, letter: str) -> str:
    """SQL for a text whose characters c at places i are replaced."""
    return f"array_join(transform(split({of}, ''), (c, i) -> {letter}), '')"


#: A digit or letter of the same script and case; any other character as it is.
SHAPED = "CASE " + " ".join(f"WHEN c RLIKE r'{pattern}' THEN decode(unhex(lpad(hex({first} + {_byte('i') if many <= 256 else f'({_byte("i")} * 256 + {_byte("i + 97")})'} % {many}), 4, '0')), 'UTF-16BE')" for pattern, first, many in [*LETTERS, (r"^\p{L}$", 0x61, 26)]) + " ELSE c END"


def _check_digit(number: Column) -> Column:
    """Luhn's check digit for all digits but the last."""
    digits = F.split(F.reverse(F.regexp_replace(number, r"\D", "")), "")
    worth = F.transform(digits, lambda c, i: F.when(i == 0, 0).when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
    return ((10 - F.aggregate(worth, F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0))) % 10) % 10).cast("string")


def _name(gender: str) -> str:
    """SQL for a word of the core's script with an ending of the gender; scripts without syllables of their own keep length and script."""
    words = (f"WHEN core RLIKE r'{letters}' THEN concat(array_join(transform(sequence(0, more + 2), i -> {_pick(SYLLABLES[script], 'i')}), ''), {_pick(ENDINGS[script, gender], '200')})" for script, letters in SCRIPTS.items())
    return f"CASE {' '.join(words)} ELSE plain END"


def with_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, core, attempt, ...) with a surrogate, which follows from these three and the key alone.

    Parts of names are syllables of their script with an ending of the person's gender; IP
    addresses four numbers of a byte; cards that have a right check digit keep one; phone
    numbers keep the country code, e-mail addresses the top-level domain, hexadecimal strings
    their alphabet.  Anything else, and the rest of these, keeps signs, script and case, and
    the length but for what later attempts add (see ATTEMPTS).
    """
    said = F.concat_ws("\u0000", F.lit(key), "kind", "core", F.col("attempt").cast("string"))
    core, plain, kind = F.col("core"), F.col("plain"), F.col("kind")
    country = F.when(kind == "phone", F.regexp_extract("core", r"^\+\d{1,3}(?=[ .(-])", 0)).otherwise("")
    ending = F.regexp_extract("core", r"\.\p{L}{2,}$", 0)
    right = F.substr(core, F.lit(-1), F.lit(1)) == _check_digit(core)
    streamed = entities.withColumn("stream", F.concat(*(F.sha2(F.concat(F.lit(f"{i}\u0000"), said).cast("binary"), 512) for i in range(4))))
    streamed = streamed.withColumns({"more": F.floor(F.col("attempt") / ATTEMPTS).cast("int"), "country": country}).withColumn("rest", F.substr(core, F.length("country") + 1))
    more, rest = F.col("more"), F.col("rest")
    longer = F.when(more > 0, F.concat(F.regexp_extract(rest, r"^[^\p{L}\p{N}]*", 0), F.repeat(F.regexp_extract(rest, r"[\p{L}\p{N}]", 0), more), F.regexp_replace(rest, r"^[^\p{L}\p{N}]+", ""))).otherwise(rest)
    shaped = streamed.withColumn("rest", longer).withColumn("plain", F.expr(_letters("rest", SHAPED)))
    of = {digits: F.expr(_letters("rest", f"substr('{digits}', {_byte('i')} % 16 + 1, 1)")) for digits in ("0123456789abcdef", "0123456789ABCDEF")}
    made = (
        F.when(kind.isin("hex", "secret", "token", "password"), F.when(rest.rlike("^[0-9a-f]+$"), of["0123456789abcdef"]).when(rest.rlike("^[0-9A-F]+$"), of["0123456789ABCDEF"]).otherwise(plain))
        .when((kind == "ip") & (more == 0), F.expr("concat_ws('.', " + ", ".join(f"CAST({_byte(str(i))} % 254 + 1 AS STRING)" for i in range(4)) + ")"))
        .when(kind.isin("ip", "ipv6"), F.expr("concat_ws(':', " + ", ".join(f"substr(stream, {4 * i + 1}, 4)" for i in range(8)) + ")"))
        .when((kind == "card") & right, F.concat(F.substr(plain, F.lit(1), F.length("plain") - 1), _check_digit(plain)))
        .when(kind == "jwt", F.concat(F.lit("eyJ"), F.substr(plain, F.lit(4))))
        .when(kind == "email", F.concat(F.substr(plain, F.lit(1), F.length("plain") - F.length(ending)), ending))
    )
    for gender in NAMES:
        made = made.when(kind == gender, F.expr(_name(gender)))
    return shaped.withColumn("surrogate", made.otherwise(F.concat("country", plain))).drop("stream", "plain", "rest", "country", "more")


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, core, ...) of distinct entities with surrogates that are distinct too, over all kinds, and are no entity of any.

    Of entities with the same surrogate the first in order keeps it; the others, and those
    whose surrogate is an entity or taken, make another attempt.  Only these are worked on
    again; as surrogates grow with the attempts, there comes a round that leaves none.
    """
    waiting, made = entities.withColumn("attempt", F.lit(0)), []
    while True:
        tried = stored(with_surrogates(waiting, key), "tried_surrogates")
        taken = reduce(DataFrame.unionByName, (m.select("surrogate") for m in made), entities.select(F.col("core").alias("surrogate")))
        clash = taken.join(tried.select("surrogate").distinct(), "surrogate", "left_semi").distinct()
        first = tried.groupBy("surrogate").agg(F.min(F.struct("kind", "core")).alias("first"))
        free = tried.join(first, "surrogate").where((F.col("kind") == F.col("first.kind")) & (F.col("core") == F.col("first.core"))).drop("first")
        made.append(stored(free.join(clash, "surrogate", "left_anti").select(*tried.columns), "surrogates"))
        waiting = stored(tried.join(made[-1], ["kind", "core"], "left_anti").withColumn("attempt", F.col("attempt") + 1).drop("surrogate"), "collisions")
        if waiting.isEmpty():
            return reduce(DataFrame.unionByName, made).drop("attempt")


def _parts(core: Column) -> Column:
    """A name's words and what stands between them, in order."""
    return F.split(core, "(?<=[ -])|(?=[ -])")


def replace_entities(docs: DataFrame, *, key: str, id_col: str = "doc_id", text_col: str = "text", count_out: str = "n_entities") -> DataFrame:
    """The table with each entity in its texts replaced by a surrogate, and the number of entities.

    Entities (PATTERNS) are e-mail addresses, secrets, account, card, social-security and
    phone numbers, IP addresses, and names after a title.  An entity has the same surrogate
    in all documents, different ones have different ones, and without the key they can't be
    told.  The entities of names are their words, by the gender of the title: so a part of a
    name has the surrogate that it has in the whole name, and where it stands alone in a
    document that has the name after a title, it is replaced as well.  A title without gender
    takes the gender that the document gives the word elsewhere.

    A text is searched twice (whether it has an entity; then which) and put together again
    in one pass over its pieces, in time in proportion to its length.  Texts without
    entities are not shuffled.  Distinct entities are counted before they are shuffled, and
    one that very many rows have is looked up by broadcast (``skew_join``).

    Null text: null, with 0 entities.  Rows that agree in id and text get the same text.
    A column named as the new one is replaced.  An empty table gives no rows.  Numbers of 16
    digits in a row without an issuer's first digits and a right check digit, and dotted
    numbers after "v" or "version", are no entities.
    """
    spare = docs.drop(*(c for c in docs.columns if c.lower() == count_out.lower()))
    mark, said, found, pieces = fresh(spare, "text_mark", "said", "found", "pieces")
    text = F.col(text_col)
    likely = reduce(lambda a, t: a | text.contains(t), (t for titles in TITLES.values() for t in titles), text.rlike(SIGNS))
    has = F.coalesce(likely & text.rlike(ENTITY), F.lit(False))
    titled = text.rlike(TITLED)
    rows = spare.where(has).withColumns({
        mark: F.xxhash64(text_col),
        found: F.when(titled, F.regexp_extract_all(text, F.lit(ENTITY_OR_WORD), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))),
        pieces: F.when(titled, F.split(text, ENTITY_OR_WORD, -1)).otherwise(F.split(text, ENTITY, -1)),
    })
    rows = stored(rows, "texts_with_entities")

    at = rows.select(F.col(id_col).alias("id"), F.col(mark).alias("mark"), F.col(found).alias("found")).distinct().select("id", "mark", F.posexplode("found").alias("at", "entity"))
    at = at.withColumn("split", split_entity(F.col("entity"))).select("id", "mark", "at", "entity", "split.*")
    parts = at.select("id", "mark", "at", "kind", "prefix", F.when(F.col("kind").isNotNull() & ~F.col("kind").isin(*NAMES), F.array("core")).otherwise(_parts(F.col("core"))).alias("parts"))
    parts = stored(parts.select("id", "mark", "at", "kind", "prefix", F.posexplode("parts").alias("sub", "part")).withColumn("core", F.when(F.col("kind").isNull() | F.col("kind").isin(*NAMES), F.lower("part")).otherwise(F.col("part"))), "entity_parts")
    is_word = F.col("part").rlike(r"\p{L}")
    named = parts.where(F.col("kind").isin(*NAMES) & is_word).groupBy("id", "mark", "core").agg(F.min("kind").alias("least"), F.max("kind").alias("most"), F.min(F.when(F.col("kind") != "person", F.col("kind"))).alias("gendered"))
    named = named.select(F.col("id").alias("named_id"), F.col("mark").alias("named_mark"), F.col("core").alias("named_core"), F.coalesce("gendered", "least").alias("known"))
    same = F.col("id").eqNullSafe(F.col("named_id")) & (F.col("mark") == F.col("named_mark")) & (F.col("core") == F.col("named_core"))
    told = parts.join(named, same, "left").withColumn("kind", F.when(~is_word & F.col("kind").isin(*NAMES), F.lit(None)).when(F.col("kind").isNull() | (F.col("kind") == "person"), F.col("known")).otherwise(F.col("kind")))
    told = stored(told.select("id", "mark", "at", "sub", "prefix", "part", "kind", "core"), "told_parts")

    known = assign(stored(told.where("kind IS NOT NULL").groupBy("kind", "core").agg(F.count("*").alias("n")), "distinct_entities"), key)
    meant = skew_join(told.where("kind IS NOT NULL"), stored(known, "known_surrogates"), ["kind", "core"], "n")
    cased = F.when(~F.col("kind").isin(*NAMES), F.col("surrogate")).when((F.col("part") == F.upper("part")) & (F.length("part") > 1), F.upper("surrogate")).otherwise(F.initcap("surrogate"))
    new = meant.select("id", "mark", "at", "sub", "prefix", cased.alias("new"), F.lit(True).alias("is_entity"))
    new = new.unionByName(told.where("kind IS NULL").select("id", "mark", "at", "sub", "prefix", F.col("part").alias("new"), F.lit(False).alias("is_entity")))
    whole = new.groupBy("id", "mark", "at").agg(F.first("prefix").alias("prefix"), F.array_sort(F.collect_list(F.struct("sub", "new"))).alias("news"), F.max("is_entity").alias("is_entity"))
    whole = whole.select("id", "mark", "at", "is_entity", F.concat("prefix", F.array_join("news.new", "")).alias("new"))
    by_text = whole.groupBy("id", "mark").agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias(said), F.count_if("is_entity").alias(count_out))
    by_text = by_text.withColumnsRenamed({"id": f"{said}_id", "mark": f"{said}_mark"})
    joined = rows.join(by_text, F.col(id_col).eqNullSafe(F.col(f"{said}_id")) & (F.col(mark) == F.col(f"{said}_mark")))
    put = F.array_join(F.zip_with(pieces, F.col(f"{said}.new"), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    changed = joined.withColumn(text_col, put)
    return spare.where(~has).withColumn(count_out, F.lit(0).cast("long")).unionByName(changed.select(*spare.columns, count_out))
