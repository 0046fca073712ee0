"""Personal data replaced by keyed surrogates, with DataFrame functions only.

A text is cut by one pattern into mentions and the gaps between them; a text that names persons is cut once more, now also at
the bare surnames of its own persons. Every different mention is taken apart into parts: plain stretches that stay (titles,
country codes, labels), and entities (a number, an address, a secret, one word of a name). Each different entity gets a
surrogate drawn from a keyed hash, of the same kind, script, gender and format. Surrogates that two entities share, or that are
entities of the corpus themselves, are drawn again, so different entities stay different, and one entity is replaced alike
everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written


@dataclass(frozen=True)
class Names:
    """Titles and given names that tell a person and, but for neutral titles, the gender."""

    female_titles: tuple[str, ...] = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "Κυρία")
    male_titles: tuple[str, ...] = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Κύριος")
    neutral_titles: tuple[str, ...] = ("Dr", "Prof", "Professor")
    female_names: tuple[str, ...] = ("Anna", "Maria", "Emma", "Laura", "Julia", "Sofia", "Elena", "Alice", "Sarah", "Marie", "Анна", "Мария", "Ольга", "Ελένη")
    male_names: tuple[str, ...] = ("John", "James", "Peter", "Paul", "Thomas", "Michael", "Carlos", "Pierre", "Hans", "David", "Иван", "Пётр", "Николай", "Γιώργος")

    def extended(self, **more: list[str]) -> Names:
        """These lists and further entries, by field; entries are letters, hyphens and apostrophes."""
        return replace(self, **{field: getattr(self, field) + tuple(values) for field, values in more.items()})

    @property
    def titles(self) -> str:
        return r"(?:(?:" + "|".join(self.female_titles + self.male_titles + self.neutral_titles) + r")\.? ){1,2}"

    @property
    def given(self) -> str:
        return "(?:" + "|".join(self.female_names + self.male_names) + ")"


NAMES = Names()
#: Syllables of invented names by script, and endings for female, male and untold; surnames end as the syllables do.
SYLLABLES = {
    "latin": "ba bel bri ca cor da del do fa fen ga gor ha hel ja ka kel la lin lo ma mer mo na nel no pa per ra rin ro sa sel so ta tor va vin".split(),
    "cyrillic": "ба бел ва вер га гор да дор жа за зор ка кол ла лев ма мир на ник па пет ра рож са сол та тим".split(),
    "greek": "βα βελ γα γορ δα δελ κα κορ λα λιν μα μερ να νελ πα περ ρα ριν σα σελ τα τορ".split(),
}
ENDINGS = {"latin": ("a", "en", "i"), "cyrillic": ("а", "ей", "и"), "greek": ("α", "ος", "ι")}
ALPHABETS = {r"\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшщыэюя", r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω", r"\p{L}": "abcdefghijklmnopqrstuvwxyz"}

_NAME = r"\p{Lu}\p{Ll}{1,30}+"
_LABEL = r"(?:token|key|secret|password|passwd)[\"']? {0,3}[=:] {0,3}[\"']?"
#: Country calling codes: of one and two digits as assigned, all others have three.
_CALLING = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Numbers without a country code: three, three and four digits; a zero and pairs; a zero, an area and a line.
_NATIONAL = "|".join(
    [rf"[2-9]\d{{2}}{sep}[2-9]\d{{2}}{sep}\d{{4}}" for sep in (r"\.", "-")]
    + [rf"0[1-9](?:{sep}\d{{2}}){{4}}" for sep in (r"\.", "-", " ")]
    + [r"0\d{2,4}[ /-]\d{5,8}", r"0\d{2} \d{4} \d{4}", r"0\d{3,4} \d{3} \d{3,4}"]
)
_GROUP = "[0-9A-Fa-f]{1,4}"


def patterns(names: Names) -> dict[str, str]:
    """Kinds in the order in which they are tried, each behind a look at its first character where that is telling. All
    repetitions are bounded, so a long text costs no more per character."""
    return {
        "email": r"[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}",
        "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
        "phone": r"(?=[+(\d])(?:(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}|(?<!\d)(?:" + _NATIONAL + r")(?![\p{L}\p{N}]|[.-]\d))(?!\d)",
        "ip": r"(?=\d)(?<![.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
        "ipv6": rf"(?=[0-9A-Fa-f]{{1,4}}:)(?=[A-Fa-f:]{{0,38}}\d)(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}})(?![\p{{L}}\p{{N}}:])",
        "ssn": r"(?=\d)(?<!-)\d{3}-\d{2}-\d{4}(?![\p{N}-])",
        "card": r"(?=\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\p{N})",
        "secret": rf"(?=[tksp]){_LABEL}[A-Za-z0-9_+/-]{{12,200}}|[0-9a-f]{{32,64}}+(?![\p{{L}}\p{{N}}])",
        "name": rf"(?=\p{{Lu}})(?:{names.titles}{_NAME}(?: {_NAME})?|{names.given} {_NAME})",
    }


#: A mention starts behind neither a letter nor a digit.
START = r"(?<![\p{L}\p{N}])"
PATTERNS = patterns(NAMES)
PATTERN = START + "(?:" + "|".join(PATTERNS.values()) + ")"
#: Draws before a collision is an error; by then the space of a kind is full.
ATTEMPTS = 50


def _kind(mention: Column, names: Names) -> Column:
    kinds = {k: p for k, p in patterns(names).items() if k != "secret"} | {"surname": _NAME}
    found = F.lit("secret")
    for kind in reversed(kinds):
        found = F.when(mention.rlike(rf"^(?:{kinds[kind]})$"), kind).otherwise(found)
    return found


def _parts(mention: Column, kind: Column, names: Names) -> Column:
    """Array of (kind, text): what stays has a null kind."""
    part = lambda k, t: F.struct(k.cast("string").alias("part_kind"), t.alias("part"))
    keep = lambda t: part(F.lit(None), t)
    has = lambda titles: F.concat(F.lit(" "), title).rlike(" (?:" + "|".join(titles) + r")\.? ")
    title = F.regexp_extract(mention, rf"^({names.titles})", 1)
    words = F.split(F.substring(mention, F.length(title) + 1, F.length(mention)), " ")
    first = F.element_at(words, 1)
    given = (
        F.when(has(names.female_titles), "given_f").when(has(names.male_titles), "given_m")
        .when(first.isin(*names.female_names), "given_f").when(first.isin(*names.male_names), "given_m").otherwise("given")
    )
    name = F.when(
        F.size(words) > 1, F.array(keep(title), part(given, first), keep(F.lit(" ")), part(F.lit("surname"), F.element_at(words, 2)))
    ).otherwise(F.array(keep(title), part(F.lit("surname"), first)))
    code = F.regexp_extract(mention, rf"^({_CALLING}[ .-]?)", 1)
    phone = F.array(keep(code), part(F.lit("phone"), F.substring(mention, F.length(code) + 1, F.length(mention))))
    label = F.regexp_extract(mention, f"^({_LABEL})", 1)
    secret = F.array(keep(label), part(F.lit("secret"), F.substring(mention, F.length(label) + 1, F.length(mention))))
    return F.when(kind == "name", name).when(kind == "phone", phone).when(kind == "secret", secret).otherwise(F.array(part(kind, mention)))


def _surnames(mentions: Column, names: Names) -> Column:
    """Different surnames of the persons among a text's mentions."""
    persons = F.filter(mentions, lambda m: m.rlike(rf"^(?:{patterns(names)['name']})$"))
    return F.array_distinct(F.transform(persons, lambda m: F.regexp_extract(m, rf"({_NAME})$", 1)))


def _cut_at(surnames: Column, pattern: str) -> Column:
    """The pattern of a text with such persons: their bare surnames are mentions too. Surnames are letters only."""
    return F.concat(F.lit(pattern + f"|{START}(?:"), F.array_join(surnames, "|"), F.lit(r")(?![\p{L}\p{N}])"))


def _byte(digest: Column, place: Column) -> Column:
    """A number below 256 from the hexadecimal digest."""
    return F.conv(F.substring(digest, (place % 64) * 2 + F.lit(1), F.lit(2)), 16, 10).cast("int")


def _scrambled(entity: Column, digest: Column, until: Column, kind: Column) -> Column:
    """Digits become digits, letters become letters of the same script and case (hexadecimal stays so), all else stays."""
    hexadecimal = (kind == "secret") & entity.rlike("^(?=.*[a-f])[0-9a-f]+$")

    def one(char: Column, place: Column) -> Column:
        draw = _byte(digest, place)
        pick = lambda letters: F.substring(F.lit(letters), draw % len(letters) + 1, F.lit(1))
        letter = F.when(kind == "ipv6", pick("abcdef"))
        for script, letters in ALPHABETS.items():
            letter = letter.when(char.rlike(script), pick(letters))
        changed = (
            F.when(hexadecimal, pick("0123456789abcdef")).when(char.rlike("[0-9]"), (draw % 10).cast("string"))
            .when(char.rlike(r"\p{Lu}"), F.upper(letter)).when(char.rlike(r"\p{L}"), letter).otherwise(char)
        )
        return F.when(place < until, changed).otherwise(char)

    return F.array_join(F.transform(_characters(entity), one), "")


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _luhn(card: Column) -> Column:
    """The check sum of a card number, zero if it is right."""
    digits = F.reverse(_characters(F.regexp_replace(card, "[^0-9]", "")))
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    values = F.transform(digits, lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda total, v: total + v) % 10


def _card(drawn: Column, entity: Column) -> Column:
    """A right check digit where the entity has one."""
    zeroed = F.concat(F.substring(drawn, F.lit(1), F.length(drawn) - 1), F.lit("0"))
    right = F.concat(F.substring(drawn, F.lit(1), F.length(drawn) - 1), ((F.lit(10) - _luhn(zeroed)) % 10).cast("string"))
    return F.when(_luhn(entity) == 0, right).otherwise(drawn)


def _iban(drawn: Column, entity: Column) -> Column:
    """The entity's country and the check digits of the drawn account."""
    country, account = F.substring(entity, 1, 2), F.substring(drawn, F.lit(5), F.length(drawn))
    moved = F.concat(F.regexp_replace(account, " ", ""), country, F.lit("00"))
    left = F.aggregate(
        _characters(moved), F.lit(0),
        lambda rest, c: F.when(c.rlike("[0-9]"), rest * 10 + c.cast("int")).otherwise(rest * 100 + F.ascii(c) - 55) % 97,
    )
    return F.concat(country, F.lpad((F.lit(98) - left).cast("string"), 2, "0"), account)


def _pick(values: list[str], draw: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), draw % len(values) + 1)


def _invented(entity: Column, digest: Column, kind: Column, length: int) -> Column:
    """A name of so many syllables in the entity's script, with the ending of its gender."""
    def of(script: str) -> Column:
        syllables = F.concat(*[_pick(SYLLABLES[script], _byte(digest, F.lit(2 * i)) * 256 + _byte(digest, F.lit(2 * i + 1))) for i in range(length)])
        female, male, untold = ENDINGS[script]
        return F.initcap(F.concat(syllables, F.when(kind == "given_f", female).when(kind == "given_m", male).when(kind == "given", untold).otherwise("")))

    return F.when(entity.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(entity.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def _draw(entity: Column, kind: Column, attempt: int, key: str) -> Column:
    """Names grow by a syllable with every second attempt, so their space has no end that matters."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, entity, F.lit(str(attempt))), 512)
    octets = F.concat_ws(".", *[(_byte(digest, F.lit(i)) % 223 + 1).cast("string") for i in range(4)])
    whole = F.length(entity)
    domain = F.length(F.regexp_extract(entity, r"(\.[^.@]*)$", 1))
    drawn = _scrambled(entity, digest, F.when(kind == "email", whole - domain).otherwise(whole), kind)
    return (
        F.when(kind == "ip", octets)
        .when(kind.isin("given_f", "given_m", "given", "surname"), _invented(entity, digest, kind, min(4 + attempt // 2, 32)))
        .when(kind == "card", _card(drawn, entity)).when(kind == "iban", _iban(drawn, entity)).otherwise(drawn)
    )


def entity_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(part_kind, part, surrogate) for different entities; no two surrogates are equal, none is an entity.

    Of entities that draw the same surrogate the least keeps it, the others draw again against all that is settled. Each round
    works on the unsettled alone and is written to the shared folder; only their number reaches the driver.
    """
    entities = written(entities, "entities")
    settled, open_rows = None, entities
    known = entities.select(F.col("part").alias("surrogate"))
    for attempt in range(ATTEMPTS):
        drawn = open_rows.select("part_kind", "part", _draw(F.col("part"), F.col("part_kind"), attempt, key).alias("surrogate"))
        first = drawn.groupBy("surrogate").agg(F.min(F.struct("part_kind", "part")).alias("first"))
        free = first.join(known, "surrogate", "left_anti")
        if settled is not None:
            free = free.join(settled, "surrogate", "left_anti")
        won = free.select("first.part_kind", "first.part", "surrogate")
        settled = written(won if settled is None else settled.unionByName(won), "surrogates")
        open_rows = written(open_rows.join(settled, ["part_kind", "part"], "left_anti"), "unsettled")
        if open_rows.isEmpty():
            return settled
    raise ValueError(f"no free surrogates left after {ATTEMPTS} draws")


def _with_known_gender(parted: DataFrame) -> DataFrame:
    """Given names behind a neutral title are those that the corpus has with a gender, if any."""
    told = parted.where(F.col("part_kind").isin("given_f", "given_m")).groupBy("part").agg(F.min("part_kind").alias("known"))
    untold = parted.where("part_kind = 'given'").join(told, "part", "left")
    untold = untold.select("mention", "place", F.coalesce("known", "part_kind").alias("part_kind"), "part")
    return parted.where("part_kind is null or part_kind <> 'given'").unionByName(untold)


def with_surrogates(docs: DataFrame, key: str, names: Names = NAMES) -> DataFrame:
    """(row, n_found, clean_text): each row as a struct, the mentions found in its text, and the text with surrogates.

    Persons are found by the titles and given names of ``names``, and in the same text by their bare surname as well, before
    or after. Country codes of phones and accounts stay; accounts get right check digits, cards too where they had one. The
    same key gives the same surrogates for the same corpus. Null texts stay null with none found; texts without personal data
    stay as they are; repeated rows are replaced alike; an empty table gives an empty table.
    """
    pattern = START + "(?:" + "|".join(patterns(names).values()) + ")"
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = packed.withColumn("row_key", F.xxhash64("row.doc_id", "row.text"))
    first_look = keyed.select("row_key", F.col("row.text").alias("text"), F.regexp_extract_all("row.text", F.lit(pattern), F.lit(0)).alias("mentions"))
    persons = first_look.where(F.size("mentions") > 0).withColumn("surnames", _surnames(F.col("mentions"), names))
    second_look = F.when(F.size("surnames") > 0, F.regexp_extract_all("text", _cut_at(F.col("surnames"), pattern), F.lit(0)))
    found = written(persons.select("row_key", "surnames", F.coalesce(second_look, "mentions").alias("mentions")).dropDuplicates(["row_key"]), "mentions")
    different = found.select(F.explode("mentions").alias("mention")).distinct()
    parts = _parts(F.col("mention"), _kind(F.col("mention"), names), names)
    parted = written(_with_known_gender(written(different.select("mention", F.posexplode(parts).alias("place", "p")).select("mention", "place", "p.*"), "parts")), "told-parts")
    entities = parted.where("part_kind is not null").select("part_kind", "part").distinct()
    surrogates = entity_surrogates(entities, key)
    # parts that stay are few different texts: they do not take part in the join
    kept = parted.where("part_kind is null").select("mention", "place", F.col("part").alias("text"))
    put = parted.join(surrogates, ["part_kind", "part"]).select("mention", "place", F.col("surrogate").alias("text"))
    filled = kept.unionByName(put).groupBy("mention").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("parts"))
    replaced = written(filled.select("mention", F.array_join("parts.text", "").alias("replacement")), "replacements")
    per_row = (
        found.select("row_key", F.posexplode("mentions").alias("place", "mention")).join(replaced, "mention")
        .groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("place", "replacement"))).alias("list"))
    )
    ready = written(per_row.join(found.select("row_key", "surnames"), "row_key").select("row_key", "surnames", F.col("list.replacement").alias("replacements")), "row-replacements")
    gaps = F.when(F.size("surnames") > 0, F.split("row.text", _cut_at(F.col("surnames"), pattern), -1)).otherwise(F.split("row.text", pattern, -1))
    sewn = F.array_join(F.zip_with(gaps, F.concat("replacements", F.array(F.lit(""))), lambda gap, put: F.concat(gap, put)), "")
    # the list grows with the texts: one way of joining at every size
    return keyed.join(ready.hint("merge"), "row_key", "left").select(
        "row", F.when(F.col("replacements").isNull(), 0).otherwise(F.size("replacements")).cast("long").alias("n_found"),
        F.when(F.col("replacements").isNull(), F.col("row.text")).otherwise(sewn).alias("clean_text"),
    )
