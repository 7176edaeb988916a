"""Realistic surrogates as pure functions of (salt, entity type, original, attempt).

Values are indexed from small invented lists, or reshaped character by character, by SHA-256 of the
key, so the same original gets the same surrogate wherever it is evaluated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions import text as X

MAX_ATTEMPTS = 32

# Entity types whose shape is kept.
SHAPED_TYPES = ["ID_NUMBER", "US_SSN", "US_ITIN", "US_PASSPORT", "US_DRIVER_LICENSE", "US_BANK_NUMBER", "CREDIT_CARD", "IBAN_CODE", "UK_NHS", "MEDICAL_LICENSE"]

FIRST = "Ada Bruno Carla Dario Elif Femi Greta Hugo Ines Jonas Kira Luca Mona Nils Olga Paul Quinn Rosa Sven Tara Umar Vera Wim Xenia Yara Zeno Alba Boris Celia Dora Emil Frida".split()
LAST = "Abernet Brandvik Castellor Dunmarch Eskelin Farrowby Grunwald Hallmere Ivarsen Jorvick Kestrel Lindqvor Marchetti Norwell Ostrander Pellgrin Quillon Rostvik Selwick Thornbury Ulverton Vasquell Wexmoor Yarrowby Zellner Ashcombe Birkdale Corvane Delmarsh Everdine Falkner Glenmore".split()
CITY = "Arvenholm Brightmoor Calderwick Dunsfield Elmgrove Fairhaven Glenbrook Harrowgate Ironbridge Juniper Kestrelton Lakemere Millbrook Northvale Oakhurst Pinecrest Quarryville Ravenport Silverdale Thornfield Upperton Valebrook Westhaven Yewbarrow".split()
FIRM = "Bluecrest Copperline Driftwood Evergate Foxglove Granite Highmark Ironleaf Juniper Keystone Larkspur Meridian Northwind Oakline Paragon Quartz Redfern Silverthorn Tidewater Umberland Vantage Whitestone".split()
FIRM_TAIL = ["Ltd", "LLC", "Group", "Partners", "Holdings", "and Sons"]
MAIL = ["example.com", "example.org", "example.net"]

# The layouts a date is read in and written back in, in order of precedence.
#   (pattern to read, pattern to write, whether an unpadded day stays unpadded)
DATE_LAYOUTS = [
    ("MMMM d, yyyy", "MMMM dd, yyyy", True), ("MMM d, yyyy", "MMM dd, yyyy", True), ("d MMMM yyyy", "dd MMMM yyyy", True), ("d MMM yyyy", "dd MMM yyyy", True),
    ("MMMM d yyyy", "MMMM dd yyyy", True), ("d MMMM, yyyy", "dd MMMM, yyyy", True), ("yyyy-M-d", "yyyy-MM-dd", False), ("d/M/yyyy", "dd/MM/yyyy", False),
    ("M/d/yyyy", "MM/dd/yyyy", False), ("d.M.yyyy", "dd.MM.yyyy", False), ("d-M-yyyy", "dd-MM-yyyy", False), ("MMMM yyyy", "MMMM yyyy", False), ("MMM yyyy", "MMM yyyy", False),
]


def _pick(values: list[str], key: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), X.hash_int(key, len(values)))


def date_offset(salt: Column) -> Column:
    """Days by which all dates under a salt move: two to five years, either way."""
    h = F.sha2(F.concat(F.lit("date\0"), salt).cast("binary"), 256)
    days = 730 + F.pmod(F.conv(F.substring(h, 2, 15), 16, 10).cast("long"), F.lit(1096)).cast("int")
    return F.when(F.conv(F.substring(h, 1, 1), 16, 10).cast("int") >= 8, days).otherwise(-days)


def shift_date(original: Column, salt: Column, attempt: Column) -> Column:
    """original moved by the salt's offset, in its own layout; NULL if it has none of the layouts."""
    text = X.strip(original)
    move = date_offset(salt) + attempt
    found = []
    for read, write, unpadded in DATE_LAYOUTS:
        day = F.to_date(F.try_to_timestamp(text, F.lit(read)))
        out = F.date_format(F.date_add(day, move), write)
        if unpadded:
            single = F.regexp_extract(text, r"\b([0-9]{1,2})\b", 1)
            out = F.when((single != "") & ~single.startswith("0"), F.regexp_replace(out, r"^0([0-9])\b|(?<=\D)0([0-9])\b", "$1$2")).otherwise(out)
        found.append(out)
    return F.coalesce(*found)


def reshape(original: Column, key: Column) -> Column:
    """Same layout, other characters: digits for digits, ASCII letters for letters of the same case."""

    def one(c: Column, i: Column) -> Column:
        own = F.concat(key, F.lit("\0"), i.cast("string"))
        letter = F.char(X.hash_int(own, 26) + 97)
        return F.when(c.rlike(r"^\p{Nd}$"), X.hash_int(own, 10).cast("string")).when(c.rlike("^[a-z]$"), letter).when(c.rlike("^[A-Z]$"), F.upper(letter)).otherwise(c)

    return F.array_join(F.transform(F.split(original, ""), one), "")


def _generated(entity_type: Column, original: Column, key: Column) -> Column:
    part = lambda what: F.concat(key, F.lit(f"\0{what}"))
    first, last = _pick(FIRST, part("first")), _pick(LAST, part("last"))
    number = lambda what, n: F.lpad(X.hash_int(part(what), 10**n).cast("string"), n, "0")
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), X.hash_int(part("day"), 20000)), "yyyy-MM-dd")
    letters = F.concat(*[F.char(X.hash_int(part(f"l{i}"), 26) + 97) for i in range(4)])
    return (
        F.when(entity_type == "PERSON", F.concat_ws(" ", first, last))
        .when(entity_type == "LOCATION", _pick(CITY, part("city")))
        .when(entity_type == "PHONE_NUMBER", F.concat(F.lit("+1 ("), number("area", 3), F.lit(") 555-"), number("line", 4)))
        .when(entity_type == "EMAIL_ADDRESS", F.concat(F.lower(first), F.lit("."), F.lower(last), number("mail", 2), F.lit("@"), _pick(MAIL, part("host"))))
        .when(entity_type.isin("ORGANIZATION", "ORG"), F.concat_ws(" ", _pick(FIRM, part("firm")), _pick(FIRM_TAIL, part("tail"))))
        .when(entity_type == "DATE_TIME", date)
        .when(entity_type.isin(SHAPED_TYPES), reshape(original, key))
        .otherwise(F.concat(letters, F.lit("-"), number("n", 4)))
    )


def draw(entity_type: Column, original: Column, salt: Column, attempt: Column) -> Column:
    key = F.concat_ws("\0", salt, entity_type, original, attempt.cast("string"))
    moved = F.when(entity_type == "DATE_TIME", shift_date(original, salt, attempt))
    return F.coalesce(moved, _generated(entity_type, original, key))


def surrogate(entity_type: Column, original: Column, salt: Column, avoid: Column | None = None) -> Column:
    """The first of up to 32 draws that holds neither an original to avoid nor the text itself; else the last."""
    from cloakframe.operators.leak import matcher

    own = matcher(X.normalize_ws(original))

    def clean(value: Column) -> Column:
        flat = X.normalize_ws(value)
        hit = F.coalesce(F.regexp_count(flat, own) > 0, F.lit(False))
        return ~hit if avoid is None else ~hit & ~F.coalesce(F.regexp_count(flat, avoid) > 0, F.lit(False))

    def step(acc: Column, attempt: Column) -> Column:
        # the one-element array names the draw, so that it is made once and the expression stays small
        tried = F.transform(F.array(draw(entity_type, original, salt, attempt)), lambda v: F.struct(clean(v).alias("ok"), v.alias("value")))
        return F.when(acc["ok"], acc).otherwise(F.get(tried, F.lit(0)))

    begin = F.struct(F.lit(False).alias("ok"), F.lit(None).cast("string").alias("value"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(MAX_ATTEMPTS - 1)), begin, step, lambda acc: acc["value"])


# Pseudonyms must be many: names are made of syllables, so that 10**8 originals hardly ever draw the same one.
ONSETS = "b d f g h k l m n p r s t v br dr gr kr tr st".split()
VOWELS = "a e i o u".split()
_SYLLABLES = len(ONSETS) * len(VOWELS)
GIVEN = {
    "en": "Alice Arthur Clara Edwin Flora Harold Ivy Jasper Laura Martin Nora Oscar Ruth Simon Violet Walter".split(),
    "it": "Aldo Bianca Carlo Donata Enzo Fabia Gino Ilaria Livio Marta Nino Ornella Pietro Rita Silvio Teresa".split(),
    "fr": "Amélie Bastien Cécile Didier Élise Fabrice Gisèle Hervé Irène Jules Lucie Marcel Noémie Odile René Simone".split(),
    "de": "Anke Bernd Dörte Erwin Frieda Gerd Heike Ingo Jutta Kurt Liesel Manfred Nele Otto Renate Uwe".split(),
    "es": "Alba Andrés Carmen Diego Elena Felipe Gloria Hugo Inés Jaime Lucía Mateo Nuria Óscar Pilar Rubén".split(),
    "pt": "Afonso Beatriz Cátia Duarte Eva Filipe Graça Henrique Inês Joana Leonor Miguel Nuno Rita Sónia Tiago".split(),
    "nl": "Anouk Bram Daan Eline Femke Gijs Hanna Jeroen Kees Lotte Maarten Noor Pieter Roos Sanne Thijs".split(),
}
SURNAME = {
    "en": "ton ford well by field ley ham worth".split(), "it": "elli ini oni ardi etti ucci esi asso".split(), "fr": "eau ier ard ette in ot el ois".split(), "de": "mann berg stein feld er bach ing hoff".split(),
    "es": "ez ero ales ano ido ares ena osa".split(), "pt": "eira ares inho al osa edo ais ino".split(), "nl": "sma stra huis dijk veld man inga sen".split(),
}
TOWN = {"en": "ville bury mouth".split(), "it": "ano ello asco".split(), "fr": "ville ac y".split(), "de": "heim hausen stadt".split(), "es": "ar illa edo".split(), "pt": "eiro inha al".split(), "nl": "dam wijk drecht".split()}
COMPANY = {"en": "Ltd LLC Group".split(), "it": "SpA Srl Gruppo".split(), "fr": "SARL SA Groupe".split(), "de": "GmbH AG KG".split(), "es": "SL SA Grupo".split(), "pt": "Lda SA Grupo".split(), "nl": "BV NV Groep".split()}
DIAL = {"en": "1", "it": "39", "fr": "33", "de": "49", "es": "34", "pt": "351", "nl": "31"}


def language_of(language: str | None) -> str:
    """One of the languages that have names: of a language or a locale such as en_GB; en for others."""
    own = (language or "").split("_")[0].lower()
    return own if own in GIVEN else "en"


def _by_language(values: dict, language, use) -> Column:
    """use(the language's values); language: a name, or a column of names."""
    if not isinstance(language, Column):
        return use(values[language_of(language)])
    own = F.lower(F.substring_index(language, "_", 1))
    out = F.when(own == "it", use(values["it"]))
    for code in ("fr", "de", "es", "pt", "nl"):
        out = out.when(own == code, use(values[code]))
    return out.otherwise(use(values["en"]))


def coined(key: Column, syllables: int = 3) -> Column:
    """A made-up word of so many syllables."""
    drawn = X.hash_int(key, _SYLLABLES**syllables)
    parts = []
    for i in range(syllables):
        at = F.floor(drawn / _SYLLABLES**i).cast("int") % _SYLLABLES
        parts += [F.get(F.array(*[F.lit(o) for o in ONSETS]), F.floor(at / len(VOWELS)).cast("int")), F.get(F.array(*[F.lit(v) for v in VOWELS]), at % len(VOWELS))]
    return F.concat(*parts)


def pseudonym_candidate(entity_type: Column, original: Column, attempt: Column, language=None) -> Column:
    """The attempt-th pseudonym to try for an original; deterministic, without a salt; language: a name, a column of names, or none."""
    key = F.concat_ws("\0", F.lit("pseudonym"), entity_type, original, attempt.cast("string"))
    part = lambda what: F.concat(key, F.lit(f"\0{what}"))
    pick = lambda values, what: _by_language(values, language, lambda v: _pick(v, part(what)))
    surname = F.initcap(F.concat(coined(part("name")), pick(SURNAME, "end")))
    initial = F.char(X.hash_int(part("initial"), 26) + 65)
    digits = lambda what, n: F.lpad(X.hash_int(part(what), 10**n).cast("string"), n, "0")
    return (
        F.when(entity_type == "PERSON", F.concat(pick(GIVEN, "given"), F.lit(" "), initial, F.lit(". "), surname))
        .when(entity_type == "LOCATION", F.initcap(F.concat(coined(part("town")), pick(TOWN, "end"))))
        .when(entity_type == "PHONE_NUMBER", F.concat(F.lit("+"), _by_language(DIAL, language, F.lit), F.lit(" ("), digits("area", 3), F.lit(") "), digits("exchange", 3), F.lit("-"), digits("line", 4)))
        .when(entity_type == "EMAIL_ADDRESS", F.concat(F.lower(initial), F.lit("."), F.lower(surname), digits("mail", 3), F.lit("@"), _pick(MAIL, part("host"))))
        .when(entity_type.isin("ORGANIZATION", "ORG"), F.concat_ws(" ", _pick(FIRM, part("firm")), F.initcap(coined(part("firm2"))), pick(COMPANY, "tail")))
        .otherwise(_generated(entity_type, original, key))
    )
