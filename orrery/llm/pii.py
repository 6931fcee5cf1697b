"""Personal data replaced by keyed surrogates, in DataFrame functions only.

Detection is one alternation of patterns over the whole text, once; card numbers and IBANs count only if their check digits
are right. Every distinct entity gets a surrogate of its own type and format: digits become digits, letters letters of the
same case and script, marks stay, and so do a country code, a key's prefix and a top-level domain; check digits are right
again. Names stand after one or more titles, which stay. Each of their words is an entity of its own (so is each half of a
double name): it is replaced by an invented word of the same script and case. A word's gender is what the titles of all its
mentions as a given name agree on; it decides the ending, not the identity.

The draw is keyed: it follows from the secret, the type, the entity's canonical form and the number of the attempt, so
one entity has one surrogate in the whole corpus (coreference), and nobody without the key can link them. A draw fails if it
is not of its type, if another entity drew it (the smallest canonical form wins), if it was given out before, or if it is a
real entity of the corpus; who failed draws again, until nobody has to. From attempt ``WIDEN`` on surrogates of types without
a fixed length grow. From ``TOLERANT`` on, which only a format whose values nearly all occur can reach, a surrogate may be a
real entity, but never one that was given out.

Tables. The input is stored once with its matches; only texts with entities are ever shuffled. Distinct entities and distinct
entity lists are combined before they are shuffled, and hot ones are looked up by broadcast (``with_group``).

Defined results. Null texts stay null, empty ones empty. Repeated rows are replaced alike. Empty tables give empty results.
Columns beside the text stay as they are, whatever their names; the result adds (or, if the input has it, sets) ``n_replaced``.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh, stored, table, with_group

#: Titles by gender, before names; those of DOTTED only with a full stop (other words are written alike).
MALE = ("Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Fräulein", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Doña", "Signora", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof", "Professor", "Mx")
DOTTED = ("Sr", "Sra")
#: Small words inside names; they stay.
PARTICLES = "af al da de del den der di du la le van von y zu zur".split()
#: From these attempts on surrogates grow, and may be real entities.
WIDEN, TOLERANT = 6, 40

_ALL_TITLES = (*MALE, *FEMALE, *NEUTRAL)
_TITLES = "|".join(t + (r"\." if t in DOTTED else r"\.?") for t in sorted(_ALL_TITLES, key=lambda x: (-len(x), x)))
_NAME_WORD = rf"(?!(?:{_TITLES}) )\p{{Lu}}[\p{{L}}\p{{M}}'’-]{{1,40}}"
_PARTICLES = "|".join(PARTICLES)
#: (type, pattern); where several match at one place the first counts.
PATTERNS = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}"),
    ("aws", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("hex", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])"),
    ("secret", r"(?<![A-Za-z0-9])(?:ghp_|gho_|github_pat_|sk-|xox[abp]-)[A-Za-z0-9_-]{16,128}"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ssn", r"(?<![\d.-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d-])"),
    ("ip", r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d]|\.\d)"),
    ("mac", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])"),
    ("phone", r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"),
    ("name", rf"(?<![\p{{L}}\p{{N}}])(?:(?:{_TITLES}) ){{1,3}}(?:(?:{_PARTICLES}) ){{0,2}}{_NAME_WORD}(?: (?:(?:{_PARTICLES}) ){{0,2}}{_NAME_WORD}){{0,2}}"),
)
_PATTERN = dict(PATTERNS)
ENTITY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: What any entity holds: a cheap test before the alternation.
HINT = rf"[0-9@]|{'|'.join(sorted(_ALL_TITLES))}|[A-Fa-f]{{32}}|ghp_|gho_|github_pat_|sk-|xox|AKIA|ASIA"

#: Alphabets by Unicode script: first small letter, how many, first capital (the small one again where there is no case).
ALPHABETS = {
    "Latin": (0x61, 26, 0x41), "Cyrillic": (0x430, 32, 0x410), "Greek": (0x3B1, 17, 0x391), "Armenian": (0x561, 38, 0x531), "Georgian": (0x10D0, 33, 0x10D0), "Hebrew": (0x5D0, 27, 0x5D0),
    "Arabic": (0x628, 19, 0x628), "Devanagari": (0x915, 37, 0x915), "Thai": (0xE01, 46, 0xE01), "Hiragana": (0x304B, 60, 0x304B), "Katakana": (0x30AB, 60, 0x30AB), "Hangul": (0xAC00, 196, 0xAC00), "Han": (0x4E00, 196, 0x4E00),
}
#: Consonants and vowels that make the syllables of invented names, and feminine, masculine and other endings.
NAMES = {
    "Latin": ("bdfghklmnprst", "aeo", "lia", "rik", "nel"),
    "Cyrillic": ("бдфгхклмнпрст", "аео", "лия", "рик", "нель"),
    "Greek": ("βδφγχκλμνπρτθ", "αεο", "λια", "ρης", "νελ"),
    "Armenian": ("բդֆգհկլմնպրստ", "աեո", "ուհի", "արդ", "յան"),
}


def _kind(value: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS:
        test = value.rlike(f"^(?:{pattern})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("other")


def _bare(value: Column) -> Column:
    return F.regexp_replace(value, r"[^\p{L}\p{N}]", "")


def _mod97(code: Column) -> Column:
    """The remainder of letters (A is 10) and digits read as one number."""
    step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(code, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)))


def _is_entity(value: Column) -> Column:
    """Whether a match has right check digits, where its type has any."""
    bare = _bare(value)
    iban = _mod97(F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))) == 1
    return F.when(value.rlike(rf"^(?:{_PATTERN['card']})$"), F.call_function("luhn_check", bare)).when(value.rlike(rf"^(?:{_PATTERN['iban']})$"), iban).otherwise(F.lit(True))


def _canonical(kind: Column, value: Column) -> Column:
    """Spellings of one entity alike: marks and case do not tell numbers and addresses apart."""
    bare = _bare(value)
    return F.when(kind.isin("card", "phone", "ssn"), bare).when(kind.isin("iban", "mac"), F.upper(bare)).when(kind.isin("email", "name", "hex"), F.lower(value)).otherwise(value)


_WORD = r"[\p{L}\p{M}]+"


def _entities(matches: DataFrame) -> DataFrame:
    """From distinct ``value``: rows (``value``, ``kind``, ``gaps``, ``pos``, ``word``, ``goes``, ``gender``), one for each word of a name and one for anything else.

    ``gaps`` lie around the words; words that do not ``goes`` stay: titles, particles and single letters.
    """
    rows = matches.withColumn("kind", F.when(_is_entity(F.col("value")), _kind(F.col("value"))).otherwise("none"))
    is_name = F.col("kind") == "name"
    words = F.when(is_name, F.regexp_extract_all("value", F.lit(_WORD), F.lit(0))).otherwise(F.array("value"))
    gaps = F.when(is_name, F.split("value", _WORD, -1)).otherwise(F.array(F.lit(""), F.lit("")))
    rows = rows.withColumns({"words": words, "gaps": gaps})
    stays = lambda w: w.isin(*_ALL_TITLES) | w.isin(*PARTICLES) | (F.char_length(w) < 2)
    gender = F.when(F.exists("words", lambda w: w.isin(*MALE)), "m").when(F.exists("words", lambda w: w.isin(*FEMALE)), "f")
    # what follows the last space is a family name, whatever the title: Mr and Mrs Smith stay one family
    family = F.array_max(F.transform("gaps", lambda g, i: F.when(g.contains(" "), i)))
    placed = F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
    rows = rows.select("value", "kind", "gaps", gender.alias("gender"), family.alias("family"), F.explode(placed).alias("p"))
    goes = F.when(F.col("kind") == "none", F.lit(False)).when(is_name, ~stays(F.col("p.word"))).otherwise(F.lit(True))
    own = F.when(is_name & goes & (F.col("p.pos") < F.col("family")), F.col("gender"))
    return rows.select("value", "kind", "gaps", F.col("p.pos").alias("pos"), F.col("p.word").alias("word"), goes.alias("goes"), own.alias("gender"))


def _letters(first: int, n: int) -> Column:
    return F.lit("".join(chr(first + i) for i in range(n)))


def _drawn(key: str) -> tuple[Column, Column, Column, Column]:
    """The surrogate of (``kind``, ``gender``, ``canonical``, ``shape``) at ``attempt``; ``shape`` is the spelling whose format is kept.

    ``stream``, ``head`` and ``tail`` are columns that the surrogate refers to.
    """
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "canonical", F.col("attempt").cast("string")), 256)
    # 64 draws of one byte from each of eight further digests
    stream = F.concat(*(F.sha2(F.concat(seed, F.lit(str(i))), 256) for i in range(8)))
    byte = lambda i: F.conv(F.substring("stream", (i % 256) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    is_hex = F.col("kind").isin("hex", "mac")
    # the part in front that stays: key prefix, country of an IBAN, country code of a phone number, first digit of a card
    head = F.length(F.regexp_extract("shape", r"^(AKIA|ASIA|ghp_|gho_|github_pat_|sk-|xox[abp]-)", 1))
    head = F.when(F.col("kind").isin("aws", "secret"), head).when(F.col("kind") == "iban", 2).when(F.col("kind") == "card", 1).when(F.col("kind") == "phone", F.length(F.regexp_extract("shape", r"^(\+\d{1,3}(?=[ .(-]))", 1))).otherwise(0)
    tail = F.when(F.col("kind") == "email", F.length("shape") - F.length(F.regexp_extract("shape", r"(\.\p{L}+)$", 1))).otherwise(F.length("shape"))

    def char(c: Column, i: Column) -> Column:
        b = byte(i)
        pick = lambda first, n: F.substring(_letters(first, n), b % n + 1, F.lit(1))
        fresh_one = F.when(c.rlike("[0-9]"), (b % 10).cast("string"))
        for script, (small, n, capital) in ALPHABETS.items():
            of = c.rlike(rf"\p{{Is{script}}}")
            wide = 6 if script == "Latin" else n
            fresh_one = fresh_one.when(of & c.rlike(r"\p{Lu}"), F.when(is_hex, pick(capital, wide)).otherwise(pick(capital, n))).when(of & c.rlike(r"\p{L}"), F.when(is_hex, pick(small, wide)).otherwise(pick(small, n)))
        fresh_one = fresh_one.when(c.rlike(r"\p{L}"), pick(0x61, 26)).otherwise(c)
        return F.when((i < F.col("head")) | (i >= F.col("tail")), c).otherwise(fresh_one)

    plain = F.array_join(F.transform(F.filter(F.split("shape", ""), lambda c: c != ""), char), "")
    more = F.greatest(F.lit(0), F.col("attempt") - WIDEN + 1)
    wider = F.substring(F.translate("stream", "abcdef", "012345"), 400, 6)
    email = F.when(more > 0, F.concat(wider, plain)).otherwise(plain)
    secret = F.when(more > 0, F.concat(plain, wider)).otherwise(plain)
    front = F.substring(plain, F.lit(1), F.length(plain) - 1)
    digits = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string"))
    card = F.concat(front, F.element_at(F.filter(digits, lambda d: F.call_function("luhn_check", F.concat(front, d))), 1))
    body, country = F.substring(plain, 5, 64), F.substring(plain, 1, 2)
    iban = F.concat(country, F.lpad((F.lit(98) - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0"), body)
    octet = lambda i: (byte(F.lit(i)) % 254 + 1).cast("string")
    ip = F.concat_ws(".", octet(0), octet(1), octet(2), octet(3))

    def syllable(consonants: str, vowels: str):
        return lambda i: F.concat(F.substring(F.lit(consonants), byte(i * 2) % len(consonants) + 1, F.lit(1)), F.substring(F.lit(vowels), byte(i * 2 + 1) % len(vowels) + 1, F.lit(1)))

    name = plain
    for script, (consonants, vowels, *ends) in NAMES.items():
        syllables = F.array_join(F.transform(F.sequence(F.lit(0), F.least(F.lit(30), F.lit(3) + more)), syllable(consonants, vowels)), "")
        end = F.when(F.col("gender") == "f", ends[0]).when(F.col("gender") == "m", ends[1]).otherwise(ends[2])
        name = F.when(F.col("canonical").rlike(rf"\p{{Is{script}}}"), F.concat(syllables, end)).otherwise(name)
    kinds = {"name": name, "ip": ip, "email": email, "secret": secret, "card": card, "iban": iban}
    out = plain
    for kind, made in kinds.items():
        out = F.when(F.col("kind") == kind, made).otherwise(out)
    return stream, head, tail, out


def assign(entities: DataFrame, key: str) -> DataFrame:
    """``surrogate`` for every distinct (``kind``, ``canonical``) with its ``gender`` and ``shape``, no two alike and none a real entity.

    Each round settles all draws that hold; the others draw again.
    """
    identity = ["kind", "canonical"]
    taken = entities.select(F.col("canonical").alias("canonical_out"), F.lit(True).alias("real")).distinct()
    stream, head, tail, surrogate = _drawn(key)
    pending, settled = entities.select(*identity, "gender", "shape", F.lit(0).alias("attempt")), None
    attempt = 0
    while True:
        drawn = pending.withColumns({"stream": stream, "head": head, "tail": tail}).withColumn("surrogate", surrogate).drop("stream", "head", "tail")
        drawn = drawn.withColumn("canonical_out", _canonical(F.col("kind"), F.col("surrogate")))
        fits = F.lit(True) if attempt >= TOLERANT else (F.col("kind") == "name") | (_kind(F.col("surrogate")) == F.col("kind"))
        # a growing table is never broadcast
        drawn = stored(drawn.withColumn("fits", fits).join(taken.hint("merge"), "canonical_out", "left"), "drawn")
        free = F.col("real").isNull() | F.col("real") if attempt >= TOLERANT else F.col("real").isNull()
        first = drawn.filter(free & F.col("fits")).groupBy("canonical_out").agg(F.min(F.struct(*identity)).alias("who"))
        judged = drawn.join(first.hint("merge"), "canonical_out", "left").withColumn("won", F.coalesce((F.col("who") == F.struct(*identity)) & F.col("fits"), F.lit(False)))
        judged = stored(judged.select(*identity, "gender", "shape", "attempt", "surrogate", "canonical_out", "won"), "judged")
        won = judged.filter("won").select(*identity, "surrogate")
        settled = won if settled is None else settled.unionByName(won)
        pending = judged.filter(~F.col("won")).select(*identity, "gender", "shape", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return settled
        attempt += 1
        given = judged.filter("won").select("canonical_out", F.lit(False).alias("real"))
        taken = taken.unionByName(given).groupBy("canonical_out").agg(F.min("real").alias("real"))


def _respelled(word: Column, surrogate: Column, kind: Column) -> Column:
    """The surrogate in the spelling of a mention: the marks of numbers, the case of letters."""
    pure = _bare(surrogate)
    held = lambda c: c.rlike(r"[\p{L}\p{N}]")
    step = F.aggregate(
        F.split(word, ""),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, c: F.when(held(c), F.struct(F.concat(acc["out"], F.substring(pure, acc["at"] + 1, F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))
        ),
    )
    marked = F.concat(step["out"], F.substring(pure, step["at"] + 1, F.length(pure)))
    shouted = (word == F.upper(word)) & (word != F.lower(word))
    capital = lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))
    # an address that grew has its new characters in front
    shift = F.length(surrogate) - F.length(word)
    same_case = F.array_join(F.transform(F.filter(F.split(surrogate, ""), lambda c: c != ""), lambda c, i: F.when(F.substring(word, i - shift + 1, F.lit(1)).rlike(r"\p{Lu}") & (i >= shift), F.upper(c)).otherwise(c)), "")
    return (
        F.when(kind.isin("card", "phone", "ssn", "iban", "mac"), marked)
        .when(kind == "email", same_case)
        .when(kind == "hex", F.when(shouted, F.upper(surrogate)).otherwise(surrogate))
        .when(kind == "name", F.when(shouted, F.upper(surrogate)).otherwise(capital(surrogate)))
        .otherwise(surrogate)
    )


def replace_entities(df: DataFrame, key: str, *, text_col: str = "text") -> DataFrame:
    """``df`` with surrogates in ``text_col`` and ``n_replaced``. Whoever sees the plan sees the key's digest."""
    secret = key_digest(key)
    df = df.drop("n_replaced")
    found, listed, new, count, n_rows = fresh(df, "pii_found", "pii_list", "pii_new", "pii_count", "pii_rows")
    text = F.col(f"`{text_col}`")
    matches = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))
    marked = df.withColumn(found, matches).withColumn(found, F.when(F.exists(found, _is_entity), F.col(found)))
    # the only pass over all texts
    marked = stored(marked, "marked")
    columns = [F.col(f"`{c}`") for c in df.columns]
    clean = marked.filter(F.col(found).isNull()).select(*columns, F.lit(0).alias("n_replaced"))
    dirty = marked.filter(F.col(found).isNotNull()).withColumn(listed, F.sha2(F.array_join(found, "\x1e"), 256))
    lists = stored(dirty.groupBy(listed).agg(F.first(found).alias("values"), F.count(F.lit(1)).alias("n")), "lists")
    placed = lists.select(F.col(listed).alias("key"), F.posexplode("values").alias("pos", "value"))
    values = stored(placed.groupBy("value").agg(F.count(F.lit(1)).alias("n")), "values")
    words = stored(_entities(values.select("value")).withColumn("canonical", _canonical(F.col("kind"), F.col("word"))), "entities")
    shape = F.when(F.col("kind").isin("card", "iban", "email", "hex", "name"), F.col("canonical")).otherwise(F.col("word"))
    genders = F.collect_set("gender")
    entities = words.filter("goes").groupBy("kind", "canonical").agg(F.min(shape).alias("shape"), F.when(F.size(genders) == 1, F.element_at(genders, 1)).otherwise("n").alias("gender"))
    given = assign(stored(entities, "distinct"), secret)
    parts = words.join(given.hint("merge"), ["kind", "canonical"], "left").withColumn("out", F.when(F.col("goes"), _respelled(F.col("word"), F.col("surrogate"), F.col("kind"))).otherwise(F.col("word")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "out"))), lambda x: x["out"])
    spelled = lambda gaps, outs: F.array_join(F.zip_with(gaps, F.array_append(outs, F.lit("")), lambda g, s: F.concat(g, s)), "")
    whole = parts.groupBy("value", "kind").agg(F.first("gaps").alias("gaps"), ordered.alias("outs")).select("value", spelled("gaps", F.col("outs")).alias("surrogate"), (F.col("kind") != "none").cast("int").alias("counts"))
    whole = stored(whole.join(values.hint("merge"), "value"), "surrogates")
    total = values.agg(F.sum("n")).first()[0] or 0
    lines = with_group(placed, whole, ["value"], "n", total).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "surrogate"))), lambda x: x["surrogate"]).alias(new), F.sum("counts").alias(count))
    lines = stored(lines.join(lists.select(F.col(listed).alias("key"), "n").hint("merge"), "key").select(F.col("key").alias(listed), new, count, F.col("n").alias(n_rows)), "lines")
    rows = lines.agg(F.sum(n_rows)).first()[0] or 0
    changed = with_group(dirty, lines, [listed], n_rows, rows)
    replaced = spelled(F.split(text, ENTITY, -1), F.col(new)).alias(text_col)
    return clean.unionByName(changed.select(*(replaced if c == text_col else F.col(f"`{c}`") for c in df.columns), F.col(count).cast("int").alias("n_replaced")))


def key_digest(key: str) -> str:
    """What goes into the plan instead of the key."""
    return hashlib.blake2b(key.encode(), digest_size=32, person=b"surrogates").hexdigest()


def session_key(spark: SparkSession) -> str:
    """The secret ``orrery.pii.key`` of the session. Where it has none, a random one is drawn and kept there: surrogates then agree in this session only."""
    key = spark.conf.get("orrery.pii.key", None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set("orrery.pii.key", key)
    return key


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data."""
    return replace_entities(table(spark, sf_dir, "documents"), session_key(spark)).select("doc_id", "text", "n_replaced")
