"""Personal data replaced by keyed surrogates, with DataFrame functions only.

Detected kinds: secrets (long hexadecimal strings, assigned tokens and passwords with a digit, of any length), e-mail addresses, IBANs, IPv4
addresses, social security numbers, telephone and card numbers, and names after a title.

A mention is split into a part that stays (label of a secret, country code, top-level domain, title) and a body. The
letters and digits of the body, lower-cased, are the entity: every spelling of it, in any case and punctuation, gets
the same replacement, so coreference holds. A replacement is a function of a secret key and the entity: digits for
digits, letters of the same script for letters, a valid address for an address, a valid check digit for a card number
that had one, a name of the gender that the title tells for a name. The mention's capitals and punctuation are laid over it.

Collisions: replacements of all entities of the corpus are compared with each other and with all original entities;
one that is taken is derived again with the next attempt number until every entity has its own. A format whose values
are used up (after ``ATTEMPTS``) gets longer replacements, one character more at each further attempt,
so none is left without.

Only rows that hold a mention are shuffled; their mentions and replacements meet by a hash of the text, so copies share them.

Cases: a null or empty text, or one without a mention, passes unchanged; null doc_ids and repeated rows are treated like
others; an empty table gives no row. ``replace_pii`` keeps all other columns whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import stage

KEY = "surrogates-1"
ATTEMPTS = 40
# Patterns of the kinds, tried in this order.
MALE = "Mr|Mister|Herr|Herrn|Sr|Señor|Monsieur|г-н|господин"
FEMALE = "Mrs|Ms|Miss|Frau|Sra|Srta|Señora|Señorita|Madame|Mme|Mlle|г-жа|госпожа"
# looked back from its end, a number after a plus sign has 7 to 15 digits in all (no group: Java wants a plain look-behind)
DIALLED = r"(?<=\+" + r"[ .\-()]{0,2}[0-9]" * 7 + r"[ .\-()]{0,2}[0-9]?" * 8 + ")"
KINDS = {
    "secret": r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}(?![0-9A-Za-z])"
              r"|(?i:(?<![\p{L}\p{N}])(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth)[\"']?[ ]?[=:][ ]?[\"']?)"
              r"(?=[A-Za-z+/_.\-]*+[0-9])[A-Za-z0-9+/_.\-]{12,}+",
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@(?:[\p{L}\p{N}\-]{1,63}+\.){1,8}\p{L}{2,24}",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[0-9]{1,4})?(?![A-Z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,5}){1,5}(?![0-9])" + DIALLED +
             r"|(?<![0-9])\([0-9]{3}\)[ ]?[0-9]{3}[ .\-][0-9]{4}(?![0-9])|(?<![0-9.\-])[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:{MALE}|{FEMALE})\.?[ ]\p{{Lu}}\p{{Ll}}+(?:[ ]\p{{Lu}}\p{{Ll}}+)?",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
GROUPS = "|".join(f"({p})" for p in KINDS.values())
MARK, OTHER = "\u0001", "\u0002"  # no pattern tells these two characters apart, and no mention holds one
MAYBE = rf"[0-9@]|(?:{MALE}|{FEMALE})\.?[ ]\p{{Lu}}"  # every mention has one of these
LATIN, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
CYRILLIC, GREEK, ACCENTED = "абвгдежзиклмнопрстуфхцчшщэюя", "αβγδεζηθικλμνξοπρστυφχψω", "áéíóúàèâêîôûäëïöüñç"
CJK = "天地人山川水火木金土日月星風雨雪花鳥魚林森石田海河春夏秋冬東西南北中"
GIVEN = {"male": {"latin": ["james", "oscar", "henry", "louis", "pablo", "anton", "felix", "simon", "bruno", "peter", "martin", "jonas"],
                  "cyrillic": ["иван", "пётр", "олег", "игорь", "борис", "павел", "антон", "сергей"]},
         "female": {"latin": ["alice", "clara", "emma", "julia", "laura", "marie", "nora", "paula", "sofia", "helen", "ida", "rosa"],
                    "cyrillic": ["анна", "ольга", "мария", "елена", "вера", "нина", "дарья", "софья"]}}
SYLLABLES = {"latin": ["ba", "der", "lin", "mor", "ta", "vel", "son", "gar", "ki", "ren", "so", "hal", "wen", "du", "fa", "ler"],
             "cyrillic": ["ба", "ло", "ми", "нор", "та", "вел", "сон", "гар", "ки", "рен", "со", "хал", "вен", "ду", "фа", "лер"]}


def _byte(h: str, i: str) -> str:
    """SQL for the i-th (from 1) byte of a hexadecimal string column; its 64 bytes go round."""
    return f"int(conv(substring({h}, 2 * (({i} - 1) % 64) + 1, 2), 16, 10))"


def _pick(alphabet: str, h: str, i: str) -> str:
    return f"substring('{alphabet}', {_byte(h, i)} % {len(alphabet)} + 1, 1)"


def _one_of(words: list[str], h: str, i: str) -> str:
    return f"element_at(array({', '.join(repr(w) for w in words)}), {_byte(h, i)} % {len(words)} + 1)"


def found_in(text: str = "text") -> Column:
    """Array of (i, kind, mention): the mentions of a text in order, each with the kind whose pattern found it there."""
    step = len(KINDS) + 1  # a mention becomes one cell for each kind, all empty but its own; the text before it is another cell
    marked = F.regexp_replace(F.translate(F.col(text), MARK, OTHER), F.lit(GROUPS), F.lit(MARK + MARK.join(f"${g}" for g in range(1, step)) + MARK))
    kinds = F.array(*map(F.lit, KINDS))
    cells = F.transform(F.split(marked, MARK, -1), lambda c, j: F.struct(
        F.floor(j / step).cast("int").alias("i"), F.get(kinds, j % step - 1).alias("kind"), c.alias("mention")))
    return F.filter(cells, lambda x: x["kind"].isNotNull() & (x["mention"] != ""))


def parts(mentions: DataFrame) -> DataFrame:
    """Add gender, prefix, body, suffix and entity to (kind, mention)."""
    out = mentions
    prefix = (F.when(F.col("kind") == "secret", F.regexp_extract("mention", r"^(.*?[=:][ ]?[\"']?)[^=:]+$", 1))
              .when(F.col("kind") == "phone", F.regexp_extract("mention", r"^(\+[0-9]{1,3})[ .\-(]", 1))
              .when(F.col("kind") == "iban", F.substring("mention", 1, 2))
              .when(F.col("kind") == "person", F.regexp_extract("mention", r"^(\S+[ ])", 1)).otherwise(F.lit("")))
    suffix = F.when(F.col("kind") == "email", F.regexp_extract("mention", r"(\.[^.@]+)$", 1)).otherwise(F.lit(""))
    out = out.withColumn("prefix", prefix).withColumn("suffix", suffix)
    out = out.withColumn("body", F.expr("substring(mention, length(prefix) + 1, length(mention) - length(prefix) - length(suffix))"))
    gender = F.when(F.col("kind") != "person", "").when(F.col("prefix").rlike(rf"^(?:{FEMALE})\.?[ ]$"), "female").otherwise("male")
    entity = (F.when(F.col("kind") == "ip", F.col("body")).when(F.col("kind") == "person", F.lower("body"))
              .otherwise(F.regexp_replace(F.lower("body"), r"[^\p{L}\p{N}]", "")))
    return out.withColumn("gender", gender).withColumn("entity", entity)


def _check_digit(number: str) -> str:
    """SQL for the Luhn sum modulo 10 of a string of digits."""
    digit = f"int(substring({number}, i, 1))"
    return (f"aggregate(sequence(1, length({number})), 0, (s, i) -> s + if((length({number}) - i) % 2 = 1, "
            f"if(2 * {digit} > 9, 2 * {digit} - 9, 2 * {digit}), {digit})) % 10")


def with_replacement(entities: DataFrame, attempt: int, key: str, extra: int = 0) -> DataFrame:
    """Add ``made``, the replacement of (kind, gender, entity) at an attempt, ``extra`` characters (octets, syllables) longer."""
    out = entities.withColumn("h", F.sha2(F.concat_ws("|", F.lit(key), "kind", "gender", F.lit(str(attempt)), "entity"), 512))
    # the further characters are like the last one
    chars = f"concat(split(entity, ''), array_repeat(right(entity, 1), {extra}))"
    letters = (f"case when ch rlike '[0-9]' then {_pick(DIGITS, 'h', '(j + 1)')} when ch rlike '[a-z]' then {_pick(LATIN, 'h', '(j + 1)')} "
               f"when ch rlike '\\\\p{{IsCyrillic}}' then {_pick(CYRILLIC, 'h', '(j + 1)')} when ch rlike '\\\\p{{IsGreek}}' then {_pick(GREEK, 'h', '(j + 1)')} "
               f"when ch rlike '\\\\p{{IsHan}}' then {_pick(CJK, 'h', '(j + 1)')} when ch rlike '\\\\p{{N}}' then {_pick(DIGITS, 'h', '(j + 1)')} "
               f"else {_pick(ACCENTED, 'h', '(j + 1)')} end")
    each = f"array_join(transform({chars}, (ch, j) -> {{}}), '')"
    hexes = each.format(_pick(HEX, "h", "(j + 1)"))
    plain = each.format(letters)
    octets = "concat_ws('.', " + ", ".join(f"string(1 + {_byte('h', str(i))} % 254)" for i in range(1, 5 + extra)) + ")"

    def name(script):
        given = f"if(gender = 'female', {_one_of(GIVEN['female'][script], 'h', '1')}, {_one_of(GIVEN['male'][script], 'h', '1')})"
        family = "concat(" + ", ".join(_one_of(SYLLABLES[script], "h", str(i)) for i in range(2, 5 + attempt // 8 + extra)) + ")"
        return f"if(instr(entity, ' ') > 0, concat({given}, ' ', {family}), {family})"

    out = out.withColumn("made", F.expr(
        f"case when entity = '' then '' when kind = 'ip' then {octets} when kind = 'secret' and entity rlike '^[0-9a-f]+$' then {hexes} "
        f"when kind = 'person' then if(entity rlike '\\\\p{{IsCyrillic}}', {name('cyrillic')}, {name('latin')}) else {plain} end"))
    # a card number that was valid stays valid: its last digit is made to fit
    fits = (F.col("kind") == "card") & (F.expr(_check_digit("entity")) == 0)
    zeroed = "concat(substring(made, 1, length(made) - 1), '0')"
    fixed = F.expr(f"concat(substring(made, 1, length(made) - 1), string((10 - {_check_digit(zeroed)}) % 10))")
    return out.withColumn("made", F.when(fits, fixed).otherwise(F.col("made"))).drop("h")


def surrogates(entities: DataFrame, key: str, attempts: int = ATTEMPTS) -> DataFrame:
    """(kind, gender, entity, made) for distinct (kind, gender, entity): replacements all differ and none is an original.

    From attempt number ``attempts`` on they are longer than their entities.
    """
    originals = entities.select(F.col("entity").alias("made")).distinct().withColumn("original", F.lit(True))
    todo, done = entities, []
    for attempt in count():
        tried = with_replacement(todo, attempt, key, max(0, attempt + 1 - attempts)).join(originals, "made", "left")
        taken = F.col("original").isNotNull()
        if done:
            before = reduce(DataFrame.unionByName, done).select("made").distinct().withColumn("given", F.lit(True))
            tried = tried.join(before, "made", "left")
            taken = taken | F.col("given").isNotNull()
        first = F.row_number().over(Window.partitionBy("made").orderBy("kind", "gender", "entity")) == 1
        tried = stage(tried.select("kind", "gender", "entity", "made", ((F.col("entity") == "") | (~taken & first)).alias("ok")), "surrogates")
        done.append(tried.where("ok").drop("ok"))
        todo = tried.where("not ok").drop("ok", "made")
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, done)


def laid_over() -> Column:
    """The replacement with the mention's capitals and punctuation; what it has more stands at its end."""
    # the body as its letters and digits, each with the punctuation after it; every array is made once for a mention
    pieces = "regexp_extract_all(body, '[\\\\p{L}\\\\p{N}][^\\\\p{L}\\\\p{N}]*', 0)"
    one = "concat(if(p rlike '^\\\\p{Lu}', upper(m), coalesce(m, substring(p, 1, 1))), coalesce(substring(p, 2), ''))"
    letters = f"concat(regexp_extract(body, '^[^\\\\p{{L}}\\\\p{{N}}]*', 0), array_join(zip_with({pieces}, split(made, ''), (p, m) -> {one}), ''))"
    letters = f"if(body = upper(body), upper({letters}), {letters})"
    # a name may change its length: capitals follow its words
    name = "if(body = upper(body), upper(made), initcap(made))"
    return F.expr(f"concat(prefix, case when body = '' then '' when kind = 'ip' then made when kind = 'person' then {name} else {letters} end, suffix)")


def replace_pii(docs: DataFrame, key: str = KEY, attempts: int = ATTEMPTS) -> DataFrame:
    """``docs`` with every detected mention in ``text`` replaced; one more column, ``pii_replaced``, counts them."""
    columns = [c for c in docs.columns if c != "pii_replaced"]
    docs = docs.select(*columns)
    has = F.coalesce(F.col("text").rlike(MAYBE), F.lit(False))
    held = docs.where(has)
    doc_key = F.sha2(F.col("text"), 256)
    found = held.select(doc_key.alias("k"), F.inline(found_in()))
    found = stage(found.distinct(), "pii-mentions")
    mentions = stage(parts(found.select("kind", "mention").distinct()), "pii-parts")
    made = surrogates(stage(mentions.select("kind", "gender", "entity").distinct(), "pii-entities"), key, attempts)
    replaced = stage(mentions.join(made, ["kind", "gender", "entity"]).select("kind", "mention", laid_over().alias("new")), "pii-replacements")
    # every mention has a place in the list, so that a later one cannot get its replacement
    placed = found.join(replaced, ["kind", "mention"], "left").withColumn("new", F.coalesce("new", "mention"))
    per_text = placed.groupBy("k").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "new"))), lambda x: x["new"]).alias("new"))
    # work columns in one struct, so that no name of the table can clash with them
    packed = held.select(F.struct(*columns).alias("row"), doc_key.alias("k")).join(per_text, "k", "left")
    packed = packed.withColumn("pieces", F.split(F.col("row")["text"], ANY, -1))
    text = F.when(F.col("new").isNull(), F.col("row")["text"]).otherwise(F.expr(
        "array_join(transform(pieces, (p, i) -> if(i = 0, p, concat(new[i - 1], p))), '')"))
    changed = packed.select(*[(text if c == "text" else F.col("row")[c]).alias(c) for c in columns],
                            F.coalesce(F.size("new"), F.lit(0)).alias("pii_replaced"))
    return docs.where(~has).withColumn("pii_replaced", F.lit(0)).unionByName(changed)


def surrogate_documents(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``replace_pii`` for the pipeline: the columns of ``docs``, with n_chars (if there) counted anew."""
    out = replace_pii(docs, key).select(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out
