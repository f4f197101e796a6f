"""PII surrogates with built-in expressions alone: no Python on the executors.

Each entity found by PATTERNS gets a replacement from a keyed hash: digits for digits,
letters of the same case and script for letters. A name keeps its title, its number of words and
their script; a family name has one surrogate with whatever title or given name it stands, given
names are of the title's gender. A telephone number keeps its country code, an IBAN its country;
check digits of cards and IBANs that hold in the text hold in the surrogate. The
same entity gets the same surrogate everywhere; entities whose surrogates collide, or equal
an entity of the corpus, take the next attempt, and after the last a longer, numbered one. Null
text stays null with no entities, empty text empty; of overlapping entities the first in the
text goes, of two at one place the kind that PATTERNS names first; null or repeated doc_ids and
repeated rows stay, each row with its own columns; an empty table gives no rows; a column that
bears the name of the count is replaced by it. Patterns hold no unbounded repeated group, so
that neither their stack nor, by look-behinds, their time grows faster than a text.
"""
from functools import reduce

from pyspark.sql import functions as F, Window as W

from .common import written

#: Given names by script, men's and women's (fixed values).
GIVEN = {
    "Latin": ("James John Robert Michael William David Thomas Peter Paul Hans".split(), "Mary Anna Linda Susan Karen Laura Sarah Emma Marie Julia".split()),
    "Cyrillic": ("Иван Пётр Павел Сергей Андрей Алексей Дмитрий Михаил Николай Юрий".split(), "Анна Мария Ольга Елена Ирина Наталья Татьяна Светлана Вера Юлия".split()),
    "Greek": ("Γιώργος Δημήτρης Νίκος Κώστας Γιάννης Παύλος Πέτρος Ανδρέας Σπύρος Μιχάλης".split(), "Μαρία Ελένη Άννα Σοφία Ειρήνη Κατερίνα Γεωργία Δέσποινα Ιωάννα Βασιλική".split()),
}
#: Sixteen consonants and sixteen rhymes by script: a family name is three syllables of them.
FAMILY = {
    "Latin": ("b d f g h k l m n p r s t v w z".split(), "a e i o u al an ar el en er il in or on un".split()),
    "Cyrillic": ("б в г д ж з к л м н п р с т ф х".split(), "а е и о у ал ан ар ел ен ер ил ин ор он ун".split()),
    "Greek": ("β γ δ ζ θ κ λ μ ν ξ π ρ σ τ φ χ".split(), "α ε ι ο ου αλ αν αρ ελ εν ερ ιλ ιν ορ ον υν".split()),
}
#: Words within a name that stay as they are.
PARTICLES = "de|del|la|las|los|von|van|der|den|zu|du|di|da"
#: Titles of the four languages, of Russian and of Greek; a name is found only after one.
MEN = r"Mr|MR|Mister|Sir|Herrn?|HERR|M\.|Monsieur|monsieur|Sr|SR|Señor|señor|Don|don|Г-н|г-н|Господин|господин|Κύριος|κύριος|Κύριε|κύριε|Κος|κος|κ\."
WOMEN = r"Mrs|MRS|Ms|MS|Miss|Frau|FRAU|Fräulein|Mme|MME|Mlle|Madame|madame|Mademoiselle|mademoiselle|Sra|SRA|Srta|Señora|señora|Señorita|señorita|Doña|doña|Г-жа|г-жа|Госпожа|госпожа|Κυρία|κυρία|Κα|κα"
TITLE = rf"(?:{MEN}|{WOMEN})\.?[ \u00A0]"
_WORD = r"\p{Lu}[\p{L}\p{M}]*+(?:['’-]\p{Lu}[\p{L}\p{M}]*+){0,3}"
NAMES = rf"(?<![\p{{L}}\p{{N}}])(?=[MSHFDmsdГгΚκ]){TITLE}(?:\p{{Lu}}\.[ \u00A0]?){{0,5}}{_WORD}(?: (?:(?:{PARTICLES}) ){{0,3}}{_WORD}){{0,2}}"
#: Alphabets by the pattern of a letter; the first that fits is taken, so a surrogate keeps script and case.
ALPHABETS = [
    ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("[\\\\p{IsCyrillic}&&\\\\p{Ll}]", "абвгдежзиклмнопрстуфхцчшщэюя"), ("[\\\\p{IsCyrillic}&&\\\\p{Lu}]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"),
    ("[\\\\p{IsGreek}&&\\\\p{Ll}]", "αβγδεζηθικλμνξοπρστυφχψω"), ("[\\\\p{IsGreek}&&\\\\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    ("\\\\p{Ll}", "àáâäèéêëìíîïòóôöùúûü"), ("\\\\p{Lu}", "ÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ"),
    ("\\\\p{IsHan}", "天地人山水火木金土日月星风云雨雪花草江河"), ("\\\\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてと"), ("\\\\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテト"),
    ("\\\\p{IsHangul}", "가나다라마바사아자차카타파하고노도로모보"), ("\\\\p{IsArabic}", "ابتثجحخدذرزسشصضطظعغف"), ("\\\\p{IsHebrew}", "אבגדהוזחטיכלמנסעפצקר"), ("\\\\p{L}", "abcdefghijklmnopqrstuvwxyz"),
    ("\\\\p{N}", "0123456789"),
]
#: kind, pattern; the order decides where two could start at one place.
PATTERNS = [
    ("email", r"(?<![\p{L}\p{M}\p{N}_.+-])[\p{L}\p{M}\p{N}_.+-]++@[\p{L}\p{M}\p{N}_-]++\.[\p{L}\p{M}\p{N}_.-]*[\p{L}\p{M}\p{N}_-]"), ("aws_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("secret", r"(?<![\p{L}\p{N}])(?=[tTpPsSaAcCmM])(?iu:token|password|passwort|passwd|pwd|secret|api[_-]?key|contraseña|mot de passe)[\"']?\s*[=:]\s*[\"']?(?=[_\-]*[\p{L}\p{N}])[\p{L}\p{M}\p{N}_\-]{8,}[\"']?"),
    ("phone", r"(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}\b|\b\d{3}[.-]\d{3}[.-]\d{4}\b"),
    ("ip", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"), ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?\d{1,3})?\b"), ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("card", r"\b\d(?:[ -]?\d){12,18}\b"), ("name", NAMES),
]
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: Where an entity may begin; single characters are looked up faster than classes.
_BEGIN = r"(?<![\p{L}\p{N}])"
_TITLES = f"{MEN}|{WOMEN}".split("|")


def _names(begins, titles):
    return NAMES.replace(_BEGIN + "(?=[MSHFDmsdГгΚκ])", f"(?=[{begins}]){_BEGIN}").replace(TITLE, rf"(?:{'|'.join(titles)})\.?[ \u00A0]")


#: Patterns that together find something where ANY does, each with strings of which such a text holds one (none: any text).
HINTS = [
    (["@"], dict(PATTERNS)["email"]), (["AKIA", "ASIA"], dict(PATTERNS)["aws_key"]), (["=", ":"], dict(PATTERNS)["secret"]),
    ([], "(?=[0123456789+(])(?:" + "|".join(f"(?:{p})" for k, p in PATTERNS if k in ("phone", "ip", "ssn", "card")) + ")"),
    ([], "(?=[ABCDEFGHIJKLMNOPQRSTUVWXYZ])" + dict(PATTERNS)["iban"]), ([], _names("MSHFDmsd", [t for t in _TITLES if t[0].isascii()])),
    (list("ГгΚκ"), _names("ГгΚκ", [t for t in _TITLES if not t[0].isascii()])),
]


def holds_any():
    """Whether ANY finds something in text, without its alternation: each of HINTS is looked for alone, which is several
    times faster, and only where the strings that it needs are there. Null text: false."""
    either = lambda xs: reduce(lambda a, b: a | b, xs)
    hit = [either([F.contains("text", F.lit(x)) for x in held]) & F.col("text").rlike(p) if held else F.col("text").rlike(p) for held, p in HINTS]
    return F.coalesce(either(hit), F.lit(False))


def kind_of(e):
    return F.coalesce(*[F.when(e.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS])


def surrogate(e, kind, key, attempt):
    """A keyed, format-preserving replacement of the string column e."""
    salt = lambda n: F.sha2(F.concat(F.lit(f"{key}:{n}:{attempt}:"), kind, F.lit(":"), e), 256)
    pool = F.concat(*[salt(n) for n in range(4)])  # 256 hexadecimal digits
    keep = F.when(kind == "secret", F.regexp_extract(e, r"^[^=:]+[=:]\s*[\"']?", 0)).when(kind == "aws_key", F.substring(e, 1, 4)).when(kind == "iban", F.substring(e, 1, 2)).when(kind == "card", F.substring(e, 1, 1)).when(kind == "phone", F.regexp_extract(e, r"^(?:\+(?:\d{1,3}(?=[ .(-])|\d{2}))?", 0)).otherwise(F.lit(""))
    body = F.expr("substring(e, length(keep) + 1)")
    num = "conv(substr(pool, 1 + (2 * i) % 254, 2), 16, 10)"
    letters = " ".join(f"WHEN c RLIKE '{p}' THEN substr('{x}', 1 + int({num}) % {len(x)}, 1)" for p, x in ALPHABETS)
    swap = f"""array_join(transform(split(body, ''), (c, i) -> CASE
      WHEN kind = 'ip' AND c RLIKE '[0-9]' THEN CAST(1 + int({num}) % 9 AS STRING)
      WHEN c RLIKE '[0-9]' THEN CAST(int({num}) % 10 AS STRING)
      WHEN kind = 'secret' AND c RLIKE '[a-f]' THEN substr('abcdef', 1 + int({num}) % 6, 1)
      {letters} ELSE c END), '')"""
    octets = "concat_ws('.', transform(sequence(0, 3), i -> CAST(1 + int(conv(substr(pool, 1 + 4 * i, 4), 16, 10)) % 254 AS STRING)))"
    return F.struct(e.alias("e"), kind.alias("kind"), pool.alias("pool"), keep.alias("keep")), body, f"CASE WHEN kind = 'ip' THEN {octets} WHEN kind = 'name' THEN {name_of(key, attempt)} ELSE concat(keep, {swap}) END"


def name_of(key, attempt):
    """SQL for the surrogate of a name: word by word, so that a family name has the same one everywhere.

    A further attempt changes the given names, or the family name where there is no other word.
    """
    quoted = lambda x: x.replace("\\", "\\\\")
    title, bare = quoted(f"regexp_extract(e, '^{TITLE}', 0)"), quoted(f"regexp_replace(e, '^{TITLE}', '')")
    lists = lambda xs: "array(" + ",".join(f"'{x}'" for x in xs) + ")"
    woman = quoted(f"e RLIKE '^(?:{WOMEN})[.  ]'")
    at = lambda h, i, xs: f"element_at({lists(xs)}, 1 + int(conv(substr({h}, {i}, 1), 16, 10)))"
    hashed = lambda what, n: f"sha2(concat('{key}:{what}:', lower(w), ':', {n}), 256)"
    syllables = lambda h, k, n: "concat(" + ", ".join(at(h, 2 * j + 1, FAMILY[k][0]) + ", " + at(h, 2 * j + 2, FAMILY[k][1]) for j in range(n)) + ")"
    picked = lambda h, xs: f"element_at({lists(xs)}, 1 + int(conv(substr({h}, 1, 4), 16, 10)) % {len(xs)})"
    def word(k):
        family = syllables(hashed("family", f"CASE WHEN i = 0 THEN '{{0}}' ELSE '0' END".format(attempt)), k, 3)
        given = f"CASE WHEN {woman} THEN {picked(hashed('given', 0), GIVEN[k][1])} ELSE {picked(hashed('given', 0), GIVEN[k][0])} END" if attempt == 0 else syllables(hashed("given", attempt), k, 2)
        return f"CASE WHEN i < n - 1 AND w RLIKE '\\\\.$' THEN concat(upper(substr({syllables(hashed('given', attempt), k, 1)}, 1, 1)), '.') WHEN i < n - 1 THEN initcap({given}) WHEN length(w) > 1 AND upper(w) = w THEN upper({family}) ELSE initcap({family}) END"
    script = f"CASE WHEN w RLIKE '^(?:{PARTICLES})$' THEN w WHEN w RLIKE '\\\\p{{IsCyrillic}}' THEN {word('Cyrillic')} WHEN w RLIKE '\\\\p{{IsGreek}}' THEN {word('Greek')} ELSE {word('Latin')} END"
    return f"concat({title}, array_join(transform(transform(split({bare}, ' '), (w, i) -> named_struct('w', w, 'i', i, 'n', size(split({bare}, ' ')))), x -> {script.replace('lower(w)', 'lower(x.w)').replace('w RLIKE', 'x.w RLIKE').replace('(w)', '(x.w)').replace('= w', '= x.w').replace('THEN w ', 'THEN x.w ').replace('i < n', 'x.i < x.n').replace('WHEN i = 0', 'WHEN x.n = 1')}), ' '))"


#: SQL that puts the check digits of a card (Luhn) and an IBAN (remainder 97) right.
_DIGITS = "filter(split(regexp_replace(s0, '[^0-9]', ''), ''), x -> x <> '')"
_LUHN = f"""concat(substr(s0, 1, length(s0) - 1), CAST((10 - aggregate(transform({_DIGITS}, (x, i) -> CASE
  WHEN i = size({_DIGITS}) - 1 THEN 0 WHEN (size({_DIGITS}) - 1 - i) % 2 = 0 THEN int(x) WHEN int(x) < 5 THEN 2 * int(x) ELSE 2 * int(x) - 9 END), 0, (a, x) -> a + x) % 10) % 10 AS STRING))"""
_IBAN = """concat(keep, lpad(CAST(98 - aggregate(filter(split(concat(substr(replace(s0, ' ', ''), 5), keep, '00'), ''), x -> x <> ''), 0, (a, x) -> CASE
  WHEN x RLIKE '[0-9]' THEN (a * 10 + int(x)) % 97 ELSE (a * 100 + ascii(x) - 55) % 97 END) AS STRING), 2, '0'), substr(s0, 5))"""


def with_surrogates(entities, key, attempt):
    """entities(e, kind, ...) -> adds s."""
    st, body, text = surrogate(F.col("e"), F.col("kind"), key, attempt)
    cols = [c for c in entities.columns if c not in ("pool", "keep", "body", "s")]
    x = entities.select(*cols, st["pool"].alias("pool"), st["keep"].alias("keep")).withColumn("body", body).withColumn("s0", F.expr(text))
    return x.select(*cols, F.expr(f"CASE WHEN kind = 'card' THEN {_LUHN} WHEN kind = 'iban' THEN {_IBAN} ELSE s0 END").alias("s"))


def surrogate_table(found, key, attempts=8):
    """found(m: the entities of a text) -> e, kind, s, n: each distinct entity once, with a surrogate of its own."""
    found = found.select(F.explode("m").alias("e"))
    todo = written(found.groupBy("e").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.coalesce(kind_of(F.col("e")), F.lit("other"))), "entities")
    all_e, done = todo.select(F.col("e").alias("s")), None
    for k in range(attempts):
        got = with_surrogates(todo, key, k)
        taken = all_e if done is None else all_e.unionByName(done.select("s"))
        first = F.row_number().over(W.partitionBy("s").orderBy("e")) == 1
        got = written(got.withColumn("first", first).join(taken.distinct().withColumn("taken", F.lit(True)), "s", "left").withColumn("ok", F.col("first") & F.col("taken").isNull()), "surrogates")
        good = got.where("ok").select("e", "kind", "s", "n")
        done = good if done is None else done.unionByName(good)
        todo = got.where("NOT ok").select("e", "n", "kind")
        if todo.isEmpty():
            return done
    # the rest get a number of fixed width, distinct within what would be equal; a width over every taken string ends it
    width = 12
    while True:
        taken = all_e.unionByName(done.select("s")).distinct().withColumn("taken", F.lit(True))
        number = F.row_number().over(W.partitionBy("s").orderBy("e"))
        got = with_surrogates(todo, key, attempts - 1).withColumn("s", F.concat("s", F.lpad(number.cast("string"), width, "0")))
        got = written(got.join(taken, "s", "left").withColumn("ok", F.col("taken").isNull()), "surrogates")
        done = done.unionByName(got.where("ok").select("e", "kind", "s", "n"))
        todo = got.where("NOT ok").select("e", "n", "kind")
        if todo.isEmpty():
            return done
        width *= 2


def replaced(docs, key="drydock", hot=1000, salts=16, counted="n_entities"):
    """docs with text rewritten and the number of entities added as `counted`; other columns stay."""
    names = [c for c in docs.columns if c.lower() != counted.lower()]
    # texts that hold nothing, most of them, are told by single patterns; ANY reads the others alone
    d = docs.where(holds_any()).select(F.struct(*names).alias("r"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("m"), F.expr("uuid()").alias("u"), F.split("text", ANY, -1).alias("p"))
    d = written(d, "found")
    table = surrogate_table(d, key)
    # every entity of the hot ones meets one of `salts` copies of its row in the table
    many = table.withColumn("salt", F.explode(F.when(F.col("n") >= hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    each = d.select("u", F.posexplode("m").alias("i", "e"))
    plain = each.join(many.where(F.col("n") < hot).select("e", "s"), "e")
    warm = each.withColumn("salt", F.pmod(F.xxhash64("u", "i"), F.lit(salts)).cast("int")).join(many.where(F.col("n") >= hot).select("e", "salt", "s"), ["e", "salt"]).select("e", "u", "i", "s")
    back = plain.unionByName(warm).groupBy("u").agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("x"))
    text = F.expr("concat_ws('', transform(p, (a, i) -> concat(a, coalesce(get(x, i).s, ''))))")
    new = d.join(back, "u").select(*[(text if c == "text" else F.col("r")[c]).alias(c) for c in names], F.size("m").cast("long").alias(counted))
    rest = docs.where(~holds_any()).select(*names, F.lit(0).cast("long").alias(counted))
    return new.unionByName(rest)
