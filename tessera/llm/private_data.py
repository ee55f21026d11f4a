"""Operator 3, PII [native]: keyed surrogates of the same type, script and format.

Detected (one pattern, leftmost longest alternative first): secrets (``token = "..."``,
``password=...``, access keys), e-mail addresses, IPv4 addresses, international and
bracketed phone numbers, card numbers, and persons named after a title.

Each distinct entity, in a normal form without separators, gets a surrogate drawn from
a keyed SHA-256 of (type, class, normal form, attempt).  The key comes from a one-row table,
so that no plan or event log shows it.

* Letters and digits are replaced one by one by those of the same class and script, separators
  and country codes stay, so the surrogate fits every written format of the entity; a phone
  number has one surrogate with and without separators.
* Card numbers keep their first digit and their check digit stays valid or invalid.
* IP addresses keep their number of octets, each from 1 to 254.
* Each part of a person's name is an entity of its own: given names are drawn from lists of the
  title's gender and the name's script, family names (the last part) from lists of the script.
  So ``Mr John Smith`` and ``Mr Smith`` share the family name in all documents.
* Wherever a text names a person after a title, all capitalised mentions of the name's parts in the
  same text are replaced too, with or without a title, in capitals, or with ``'s``.
  A person whom no title introduces in the text isn't found.

Surrogates are checked: where several entities of a type draw the same, or one draws an
entity that occurs, all but the smallest draw again until none is left.  Names grow by
syllables with the number of entities that still draw, so every draw has room for them.  So
distinct entities stay distinct, and an entity has one surrogate in all documents.  Texts meet
the surrogates by their own key; texts without entities pass by.

Defined results
---------------
* null text stays null, empty and entity-less text stays as it is;
* repeated rows and copies get equal results; equal entities of different type are apart;
* a phone number without country code is another entity than one with it;
* names beyond the lists are made of a listed one and syllables;
* only the rest draws again; entities whose form leaves no room (a one-letter address) get
  more letters or digits at the end from the eighth draw on, so that the draws always end;
* extra columns are carried along by :func:`replace_private`; ``n_entities`` is reserved;
* an empty table gives no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discard, release, text_key, written

#: Name of the session setting that holds the key, and the key of tests and examples.
KEY_SETTING = "tessera.surrogates.key"
EXAMPLE_KEY = "an example's key, not a secret"
#: From this draw on an entity's surrogate also gets longer.
WIDENING = 7

_LETTER = r"\p{L}"
#: Titles by gender (fixed values), then one to three capitalised names.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "госпожа", "г-жа")
#: Names to draw from, by gender and script.
NAMES = {
    "m": {"latin": "Adrian Bruno Conrad Damian Edgar Felix Gustav Hector Ivan Jonas Karl Leon Marco Nils Oscar Paul Quentin Rafael Simon Tomas Ulrich Victor Walter Xavier Yann".split(), "cyrillic": "Антон Борис Виктор Григорий Денис Егор Захар Иван Кирилл Леонид Максим Никита Олег Павел Роман Степан Тимур Фёдор".split()},
    "f": {"latin": "Alma Beatrix Clara Daria Elena Frida Greta Helena Irma Julia Katja Lena Marta Nora Olga Paula Rosa Sofia Tilda Ursula Vera Wanda Xenia Yvonne Zoe".split(), "cyrillic": "Анна Варвара Галина Дарья Елена Жанна Зоя Ирина Ксения Лариса Марина Нина Ольга Полина Раиса Светлана Тамара Юлия".split()},
}
FAMILY = {
    "latin": "Abbot Becker Castel Dorn Ellis Fabre Gruber Hart Ibarra Jansen Keller Lorca Marsh Novak Ortega Perrin Quint Ruiz Sander Torres Unger Vidal Weber Yates Ziegler".split(),
    "cyrillic": "Авдеенко Белых Ващенко Гончаренко Дьячук Живаго Зинченко Иваненко Коваленко Лысенко Мельник Наливайко Остапенко Павленко Руденко Седых Ткаченко Черных".split(),
}

#: Syllables that make more names of the listed ones.
SYLLABLES = {
    "latin": "ba del fin gar hal ken lor mar nes pol rin sal tor ul ven wil dan ger lis mon".split(),
    "cyrillic": "бор вал гор дан жен зар кал лим мар нев пол рин сав тим фед ход чер шар юл ян".split(),
}
#: Letters that stand for others beyond ASCII.
ACCENTED, CYRILLIC = "àâäçèéêëîïñóôöúûü", "абвгдежзиклмнопрстуфхцчшэюя"
#: International country codes by their first digits (fixed values).
_COUNTRY = r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

_NAME = rf"(?:{_LETTER}[\p{{L}}'’-]+)"
PATTERNS = {
    "secret": r"(?i:\b(?:token|password|passwd|secret|api[_-]?key)\b\s*[=:]\s*[\"']?)[A-Za-z0-9+/_-]{8,}|\bAKIA[0-9A-Z]{12,20}\b",
    "email": r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[\p{L}\p{M}\p{N}-]+(?:\.[\p{L}\p{M}\p{N}-]+)*\.\p{L}{2,}",
    "ip": r"\b(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}\b(?!\.\d)",
    "phone": r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}\b|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}\b|\b\d{3}[.-]\d{3}[.-]\d{4}\b",
    "card": r"\b\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}\b",
    "person": rf"\b(?:{'|'.join((*MALE, *FEMALE))})\.? +(?=\p{{Lu}}){_NAME}(?: +(?=\p{{Lu}}){_NAME}){{0,2}}",
}
#: All types in one pattern; the group of the card's separator is numbered for it.
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _q(pattern: str) -> Column:
    return F.lit(pattern)


def _type(entity: Column) -> Column:
    """The first type whose pattern the whole entity fits."""
    out = F.lit("person")
    for kind, pattern in reversed(list(PATTERNS.items())[:-1]):
        out = F.when(entity.rlike(rf"\A(?:{pattern})\z"), kind).otherwise(out)
    return out


def _lead(kind: Column, entity: Column) -> Column:
    """What stays in front of the part that is replaced."""
    secret = F.regexp_extract(entity, r"\A(?:AKIA|(?i:token|password|passwd|secret|api[_-]?key)\s*[=:]\s*[\"']?)", 0)
    person = F.regexp_extract(entity, rf"\A(?:{'|'.join((*MALE, *FEMALE))})\.? +", 0)
    return F.when(kind == "secret", secret).when(kind == "person", person).otherwise(F.lit(""))


def _normal(kind: Column, part: Column) -> Column:
    digits = F.regexp_replace(part, r"[^0-9]", "")
    phone = F.concat(F.when(part.startswith("+"), "+").otherwise(""), digits)
    return F.when(kind == "phone", phone).when(kind == "card", digits).when(kind == "email", F.lower(part)).otherwise(part)


def _gender(lead: Column) -> Column:
    return F.when(F.regexp_extract(lead, r"\A[\p{L}-]+", 0).isin(list(FEMALE)), "f").otherwise("m")


def found_entities(text: Column) -> Column:
    """All entities of a text, in order."""
    return F.regexp_extract_all(text, _q(ANY), F.lit(0))


def has_entities(text: Column) -> Column:
    """Whether a text has an entity.  No entity lacks all of the marks looked for first."""
    hint = text.rlike("[0-9@=:]")
    for word in ("AKIA", *MALE, *FEMALE):
        hint = hint | text.contains(word)
    return F.coalesce(hint & text.rlike(ANY), F.lit(False))


def described(entities: DataFrame) -> DataFrame:
    """(entity, lead, gaps, units) of distinct entities: a surrogate is drawn for each unit
    (kind, class, normal, written), and ``gaps`` stand behind the units."""
    rows = entities.withColumn("kind", _type(F.col("entity")))
    rows = rows.withColumn("lead", _lead(F.col("kind"), F.col("entity")))
    rows = rows.withColumn("part", F.substring(F.col("entity"), F.length("lead") + 1, F.length("entity")))
    rows = rows.withColumn("normal", _normal(F.col("kind"), F.col("part"))).withColumn("gender", _gender(F.col("lead")))
    script = r"if(w rlike '\\p{IsCyrillic}', 'cyrillic', 'latin')"
    names = (
        "transform(split(part, ' +'), (w, i) -> named_struct('kind', if(i = size(split(part, ' +')) - 1, 'family', 'given'),"
        f" 'class', if(i = size(split(part, ' +')) - 1, {script}, concat(gender, '-', {script})), 'normal', lower(w), 'written', w))"
    )
    units = F.expr(f"if(kind = 'person', {names}, array(named_struct('kind', kind, 'class', '', 'normal', normal, 'written', part)))")
    return rows.select("entity", "lead", F.expr("if(kind = 'person', regexp_extract_all(part, ' +', 0), array())").alias("gaps"), units.alias("units"))


def _draw(at: str) -> str:
    """48 keyed bits for a unit, an attempt and a place ``at``."""
    message = f"concat_ws('|', kind, class, normal, cast(attempt as string), cast({at} as string))"
    return f"cast(conv(substr(sha2(concat(_key, sha2(concat(_key, '|', {message}), 256)), 256), 1, 12), 16, 10) as bigint)"


def _one_of(letters: str, at: str) -> str:
    return f"substr('{letters}', cast({_draw(at)} % {len(letters)} as int) + 1, 1)"


def _drawn() -> Column:
    """The surrogate of ``normal`` at ``attempt``, with names of ``syllables`` syllables behind a listed one."""
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def letter(x: str, at: str) -> str:
        return (
            f"case when {x} between '0' and '9' then {_one_of(digits, at)} when {x} between 'a' and 'z' then {_one_of(lower, at)}"
            f" when {x} between 'A' and 'Z' then {_one_of(upper, at)} when {x} rlike '\\\\p{{IsCyrillic}}' then {_one_of(CYRILLIC, at)}"
            f" when {x} rlike '\\\\p{{L}}' then {_one_of(ACCENTED, at)} when {x} rlike '\\\\p{{N}}' then {_one_of(digits, at)}"
            f" when {x} rlike '\\\\p{{M}}' then '' else {x} end"
        )

    chars = "filter(split(normal, ''), c -> c <> '')"
    # Nothing for most; more letters or digits where the form itself leaves no room.
    more = lambda what: f"if(attempt < {WIDENING}, '', array_join(transform(sequence(1, greatest(attempt - {WIDENING - 1}, 1)), k -> {what}), ''))"
    plain = f"concat(array_join(transform({chars}, (c, i) -> {letter('c', 'i')}), ''), {more(_one_of(lower, '1000 + k'))})"
    # Hexadecimal secrets stay hexadecimal.
    hexed = f"concat(array_join(transform({chars}, (c, i) -> if(c between '0' and '9' or c between 'a' and 'f', {_one_of('0123456789abcdef', 'i')}, c)), ''), {more(_one_of(digits, '1000 + k'))})"
    country = f"regexp_extract(normal, '^{_COUNTRY}', 0)".replace("\\", "\\\\")
    phone = f"concat(array_join(transform({chars}, (c, i) -> if(i < length({country}), c, {letter('c', 'i')})), ''), {more(_one_of(digits, '1000 + k'))})"
    last_label = "length(normal) - length(substring_index(normal, '.', -1))"
    email = f"concat({more(_one_of(lower, '1000 + k'))}, array_join(transform({chars}, (c, i) -> if(i >= {last_label}, c, {letter('c', 'i')})), ''))"
    octets = f"array_join(transform(split(normal, '[.]'), (o, i) -> cast({_draw('i')} % 254 + 1 as string)), '.')"
    body = f"concat(substr(normal, 1, 1), array_join(transform({chars}, (c, i) -> if(i = 0 or i = length(normal) - 1, '', {letter('c', 'i')})), ''))"

    def luhn(x: str) -> str:
        """Check sum over all digits of x with one more (0) to come."""
        return f"aggregate(transform(filter(split(reverse({x}), ''), c -> c <> ''), (c, i) -> if(i % 2 = 0, cast(c as int) * 2 - if(cast(c as int) > 4, 9, 0), cast(c as int))), 0, (a, v) -> a + v)"

    valid = f"({luhn('substr(normal, 1, length(normal) - 1)')} + cast(substr(normal, -1, 1) as int)) % 10 = 0"
    check = f"cast((10 - {luhn('body')} % 10) % 10 + if({valid}, 0, 1 + {_draw('99')} % 9) as int) % 10"
    card = f"element_at(transform(array({body}), body -> concat(body, cast({check} as string))), 1)"

    def of(names: list[str], at: str) -> str:
        listed = ", ".join(f"'{x}'" for x in names)
        return f"element_at(array({listed}), cast({_draw(at)} % {len(names)} as int) + 1)"

    lists = []
    for script, family in FAMILY.items():
        tail = f"array_join(transform(sequence(0, syllables), k -> if(k = 0, '', {of(SYLLABLES[script], '2000 + k')})), '')"
        lists.append(f"when kind = 'family' and class = '{script}' then concat({of(family, '0')}, {tail})")
        lists += [f"when kind = 'given' and class = '{g}-{script}' then concat({of(NAMES[g][script], '0')}, {tail})" for g in NAMES]
    return F.expr(
        f"case {' '.join(lists)} when kind = 'email' then {email} when kind = 'ip' then {octets} when kind = 'card' then {card} when kind = 'phone' then {phone}"
        f" when kind = 'secret' and normal rlike '^[0-9a-f]+$' then {hexed} else {plain} end"
    )


def syllables_for(left: int, attempt: int) -> int:
    """Syllables of a draw at which ``left`` names have room: none for few names, one more with each further draw."""
    out, room = max(0, attempt - 2), min(len(x) for x in FAMILY.values()) * len(SYLLABLES["latin"]) ** max(0, attempt - 2)
    while room < left:
        out, room = out + 1, room * len(SYLLABLES["latin"])
    return out


def assign_surrogates(units: DataFrame, key: str) -> DataFrame:
    """(kind, class, normal, surrogate) of distinct units; surrogates are distinct and never occur.

    A type's distinct surrogates need room; only IPv4 addresses and cards can't be widened, and a
    corpus that holds nearly all of them is refused."""
    spark = units.sparkSession
    names = ["kind", "class", "normal"]
    # A table of one row: its values stand in no plan.
    keys = F.broadcast(spark.createDataFrame([(1, key)], "_one int, _key string"))
    todo = written(units.select(*names).distinct(), "surrogate-todo")
    real = written(todo.select("kind", F.lower("normal").alias("folded")).distinct(), "surrogate-real")
    done: list[DataFrame] = []
    attempt, left = 0, todo.count()
    while left:
        drawn = todo.withColumn("attempt", F.lit(attempt)).withColumn("syllables", F.lit(syllables_for(left, attempt)))
        drawn = drawn.withColumn("_one", F.lit(1)).join(keys, "_one").withColumn("surrogate", _drawn()).select(*names, "surrogate", F.lower("surrogate").alias("folded"))
        drawn = written(drawn, "surrogate-drawn")
        # Drawn before by another, real, or drawn by several: the smallest unit keeps it.
        taken = real
        for some in done:
            taken = taken.unionByName(some.select("kind", F.lower("surrogate").alias("folded")))
        first = drawn.groupBy("kind", "folded").agg(F.min(F.struct("class", "normal")).alias("first"))
        kept = first.join(taken, ["kind", "folded"], "left_anti").select("kind", "first.class", "first.normal")
        kept = written(drawn.join(kept, names, "left_semi").select(*names, "surrogate"), "surrogate-done")
        rest = written(drawn.join(kept, names, "left_anti").select(*names), "surrogate-todo")
        for old in (todo, drawn):
            discard(old)
        done.append(kept)
        todo, attempt, before = rest, attempt + 1, left
        left = todo.count()
        if left == before and attempt > 60:
            raise ValueError(f"{left} addresses or cards leave no other of their form")
    discard(real)
    return functools.reduce(DataFrame.unionByName, done) if done else units.select(*names, F.lit("").alias("surrogate"))


def _written_like() -> Column:
    """The surrogate in the written form of the unit: its separators and capitals."""
    # Separators of numbers stay where they are; the k-th digit is the surrogate's k-th, what it has beyond them goes behind.
    only, n = "regexp_replace(surrogate, '[^0-9]', '')", "length(regexp_replace(written, '[^0-9]', ''))"
    digits = (
        f"concat(array_join(transform(filter(split(written, ''), c -> c <> ''), (c, i) -> if(c between '0' and '9',"
        f" substr({only}, length(regexp_replace(substr(written, 1, i + 1), '[^0-9]', '')), 1), c)), ''), substr({only}, {n} + 1))"
    )
    cased = "array_join(transform(filter(split(surrogate, ''), c -> c <> ''), (c, i) -> if(length(surrogate) = length(written) and substr(written, i + 1, 1) <> lower(substr(written, i + 1, 1)), upper(c), c)), '')"
    return F.expr(f"case when kind in ('phone', 'card') then {digits} when kind = 'email' then {cased} when kind in ('given', 'family') and written = upper(written) then upper(surrogate) else surrogate end")


#: A word that may be part of a name.
_WORD = r"\p{L}[\p{L}'’-]*"


def _mentions(gap: str) -> str:
    """SQL for a stretch of text whose capitalised mentions of the names in ``_names`` are replaced."""
    word = _WORD.replace("\\", "\\\\").replace("'", "\\'")
    words, seps = f"regexp_extract_all({gap}, '{word}', 0)", f"split({gap}, '{word}', -1)"
    known = "if(w = lower(w), null, element_at(_names, lower(w)))"
    short = "if(w = lower(w), null, element_at(_names, lower(substr(w, 1, length(w) - 2))))"
    cased = lambda w, x: f"if(length({w}) > 1 and {w} = upper({w}), upper({x}), {x})"
    possessive = r"w rlike '[\'’][sS]$'"
    one = f"coalesce({cased('w', known)}, if({possessive}, concat({cased('substr(w, 1, length(w) - 2)', short)}, substr(w, -2, 2)), null), w)"
    return f"if(size(_names) = 0, {gap}, array_join(zip_with({seps}, {words}, (s, x) -> concat(s, coalesce(element_at(transform(array(x), w -> {one}), 1), ''))), ''))"


def replace_private(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_entities``."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c != "n_entities"]
    own = [F.col(f"`{c}`") for c in names]
    matches = has_entities(F.col("text"))  # only matching texts are taken apart
    keyed = docs.select("text").where(matches).withColumns(text_key())
    # Copies of a text meet here, by their keys, before anything else is shuffled.
    lists = written(keyed.select("k1", "k2", F.explode(F.array_distinct(found_entities(F.col("text")))).alias("entity")).distinct(), "surrogate-lists")
    release(spark)
    known = written(described(lists.select("entity").distinct()), "surrogate-entities")
    units = known.select("entity", F.posexplode("units").alias("at", "u")).select("entity", "at", "u.*")
    drawn = assign_surrogates(units, key)
    parts = units.join(drawn, ["kind", "class", "normal"]).select("entity", "at", "kind", "normal", "surrogate", _written_like().alias("instead"))
    parts = parts.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("at", "kind", "normal", "surrogate", "instead"))).alias("parts"))  # three at most
    joined = F.expr("concat(lead, array_join(transform(parts, (p, i) -> concat(p.instead, coalesce(get(gaps, i), ''))), ''))")
    named = F.expr("transform(filter(parts, p -> p.kind in ('given', 'family')), p -> named_struct('normal', p.normal, 'kind', p.kind, 'surrogate', p.surrogate))")
    named = written(known.join(parts, "entity").select("entity", joined.alias("instead"), named.alias("names")), "surrogate-named")
    discard(known)
    # One row a text, as long as its list of distinct entities.
    pairs = lists.join(named, "entity").groupBy("k1", "k2").agg(
        F.map_from_entries(F.collect_list(F.struct("entity", "instead"))).alias("_instead"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("names")))).alias("_all")
    )
    # Of a part that is both, the family name comes first.
    each = F.expr("map_from_arrays(array_distinct(transform(_all, x -> x.normal)), transform(array_distinct(transform(_all, x -> x.normal)), n -> element_at(filter(_all, x -> x.normal = n), 1).surrogate))")
    pairs = written(pairs.select("k1", "k2", "_instead", each.alias("_names")), "surrogate-pairs")
    for old in (lists, named):
        discard(old)
    release(spark)

    plain = docs.where(~matches).select(*own, F.lit(0).cast("long").alias("n_entities"))
    some = docs.where(matches).select(F.struct(*own).alias("_own"), "text").withColumns(text_key())
    replaced = some.join(pairs.withColumnsRenamed({"k1": "r1", "k2": "r2"}), (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")))
    gaps, ents = F.split("text", ANY, -1), found_entities(F.col("text"))
    both = replaced.select("_own", "_instead", "_names", gaps.alias("_gaps"), ents.alias("_entities"))
    text = F.expr(f"array_join(transform(_gaps, (g, i) -> concat({_mentions('g')}, coalesce(element_at(_instead, get(_entities, i)), ''))), '')")
    both = both.select("_own", text.alias("_text"), F.size("_entities").cast("long").alias("n_entities"))
    out = both.select(*(F.col("_text").alias("text") if c == "text" else F.col(f"_own.`{c}`") for c in names), "n_entities")
    return plain.unionByName(out)


def private_report(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_entities) with the session's key."""
    key = docs.sparkSession.conf.get(KEY_SETTING, EXAMPLE_KEY)
    return replace_private(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key)
