"""Text normalisation as Column -> Column functions; all are built-in expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
SYMBOLS = ",:;'/-+&()!#$%*.|\\@`~^<>?[]{}_=\n\""
EXOTIC_SYMBOLS = "ª°⭐•®’—–™& ­âð"
WESTERN_LETTERS = "éáñóüäýöçãõúíàêôūâşè"
MARKS = "™®ⓘ©"
INNER_SYMBOLS = " ,:;'/-+&()!#$%*.|`~^<>?[]{}_=\n"
ORDINALS = ("1st", "2nd", "3rd", "4th", "5th", "6th", "7th", "8th", "9th", "0th", "1th", "2th", "3th", "4 th", "5 th", "6 th", "7 th", "8 th", "9 th", "0 th", "1 th", "2 th", "3 th", "1 st", "2 nd", "3 nd")
STOP_WORDS = ("the", "de", "of", "da", "la", "a", "an", "and", "at", "b", "el", "las", "los", "no", "di", "by", "le", "del", "in", "co", "inc", "llc", "llp", "ltd", "on", "der", " das", "die")
ADDRESS_WORDS = (
    ("str", "jalan", "jl", "st", "street", "ul", "ulitsa", "rue", "rua", "via"),
    ("rd", "road"),
    ("ave", "av", "avenue", "avenida"),
    ("hwy", "highway"),
    ("fl", "floor", "flr"),
    ("blvd", "boulevard", "blv"),
    ("center", "centre"),
    ("dr", "drive"),
    ("mah", "mahallesi"),
    ("ste", "suite"),
    ("prosp", "prospekt"),
)
SEVEN_ELEVEN = ("7/11", "7-11", "7-eleven")
MC_DONALD = ("mc donald", "mcd ", "macd ", "mcd", "mcdonald", "macdonald", "mc donalds", "mac donalds")
COMMON_SPELLINGS = (("kebap", "kebab"), ("kepab", "kebab"), ("kepap", "kebab"), ("aloonaloon", "alunalun"), ("restoram", "restaurant"), ("internationalairport", "airport"))
LENGTHS = {"name": 76, "city": 38, "address": 99, "state": 33, "url": 129, "categories": 68}
URL_PREFIXES = ("httpswww", "httpwww", "https", "http")
EMPTY_PHONES = ("000000000", "999999999")
# What names of terminals and stations leave out, in this order, each with and without an s.
TERMINAL_SPELLINGS = (("airpord", "airport"), ("internasional", "international"), ("internacional", "international"))
TERMINAL_WORDS = ("terminal", "airport", "arrival", "hall", "departure", "bus stop", "airways", "checkin")
STATION_WORDS = ("stasiun", "station", "metro", "北改札", "bei gai zha", "stasiun")
# What places are called otherwise.
STATE_SPELLINGS = (("calif", "ca"), ("jakartacapitalregion", "jakarta"), ("moscow", "moskva"), ("seoulteugbyeolsi", "seoul"))
CATEGORY_SPELLINGS = (("aiport", "airport"), ("terminal", "airport"))
# Letters without an accent to lose, and how they are written in Latin letters.
ONE_LETTER = dict(zip("øłđðħıабвгдезийклмнопрстуфыэіґъьαβγδεζηικλμνξοπρσςτυω", "olddhiabvgdeziiklmnoprstufyeig''abgdezeiklmnxoprsstuo"))
MORE_LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia", "ё": "io", "ї": "yi", "є": "ie", "θ": "th", "φ": "ph", "χ": "kh", "ψ": "ps"}


def _letters() -> tuple[str, str, list[tuple[str, str]]]:
    """Letters and their one plain letter, with accents on their own (no letter) last; and letters of two or more plain ones."""
    one = dict(ONE_LETTER) | {a.upper(): b.upper() for a, b in ONE_LETTER.items() if a not in "ıς"}
    more = dict(MORE_LETTERS) | {a.upper(): b.upper() if a in "æœ" else b.capitalize() for a, b in MORE_LETTERS.items() if a != "ß"}
    for code in [*range(0xC0, 0x250), *range(0x370, 0x460), *range(0x1E00, 0x2000)]:
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if letter not in one and letter not in more and base != letter and (base.isascii() or base in one):
            one[letter] = one.get(base, base)
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(one) + marks, "".join(one.values()), list(more.items())


ACCENTED, PLAIN, LONG_LETTERS = _letters()


def replaced(c: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Each pair's first replaced by its second, in order."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def without(c: Column, characters: str) -> Column:
    return F.translate(c, characters, "")


def plain(c: Column) -> Column:
    """Latin letters without accents, Greek and Cyrillic in Latin letters; other scripts stay as they are."""
    return replaced(F.translate(c, ACCENTED, PLAIN), LONG_LETTERS)


def normal(c: Column, spaces: bool = True) -> Column:
    """Plain lower-case text without symbols, and without spaces unless asked for."""
    return without(F.lower(plain(c)), SYMBOLS if spaces else " " + SYMBOLS)


def terminal_name(c: Column) -> Column:
    """An airport's name without numbers of terminals (0 to 29, spelt three ways) and without words that all airports have."""
    numbers = [(f"{word}{i}", "") for i in range(30) for word in ("terminal ", "terminal", "t")]
    words = [(w + s, "") for w in TERMINAL_WORDS for s in ("s", "")]
    return F.trim(replaced(c, [*numbers, *TERMINAL_SPELLINGS, *words]))


def station_name(c: Column) -> Column:
    return F.trim(replaced(c, [(w + s, "") for w in STATION_WORDS for s in ("s", "")]))


def city_letters(c: Column) -> Column:
    return without(c, " 0123456789")


def language_class(c: Column) -> Column:
    """1: ASCII but for common signs, 2: also western letters, 3: other scripts."""
    bare = without(F.lower(c), EXOTIC_SYMBOLS)
    ascii_only = lambda x: x.rlike(r"\A[\x00-\x7F]*\z")
    return F.when(ascii_only(bare), 1).when(ascii_only(without(bare, WESTERN_LETTERS)), 2).otherwise(3)


def without_marks(c: Column) -> Column:
    return without(c, MARKS)


def without_abbreviation(c: Column) -> Column:
    """Takes "( ... )" out if it holds 1 to 8 characters, all capitals or digits, and enough is left."""
    i, j = F.instr(c, "("), F.instr(c, ")")
    inside = without(F.substring(c, i + 1, j - i - 1), INNER_SYMBOLS)
    short = (i > 0) & (j > i + 1) & (j - i < 10) & (F.length(c) - (j - i) > 9)
    return F.when(short & (inside == F.upper(inside)), F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, j + 1, F.length(c)))).otherwise(c)


def without_ordinals(c: Column) -> Column:
    return replaced(c, [(w, w[0]) for w in ORDINALS])


def without_stop_words(c: Column) -> Column:
    """Stop words go, in order: in the middle, at the start, at the end."""
    for w in STOP_WORDS:
        c = F.regexp_replace(F.regexp_replace(F.replace(c, F.lit(f" {w} "), F.lit(" ")), f"\\A{w} ", ""), f" {w}\\z", "")
    return c


def initials(c: Column) -> Column:
    """Capitals, and the small letter that a word begins with, in lower case."""
    c = F.regexp_replace(plain(c), r"\A[tT][hH][eE]", "")
    words = F.filter(F.split(without_ordinals(without_stop_words(c)), " "), lambda w: F.length(w) >= 2)
    return F.lower(F.array_join(F.transform(words, lambda w: F.array_join(F.regexp_extract_all(w, F.lit(r"^[a-z]|[A-Z]"), F.lit(0)), "")), ""))


def address(c: Column) -> Column:
    """Street words by one spelling; where a text begins or ends with one, all of that form."""
    for first, *others in ADDRESS_WORDS:
        for w in others:
            c = F.replace(c, F.lit(f" {w} "), F.lit(f" {first} "))
            c = _held(c, _ending(F.startswith, f"{w} ", f"{first} "))
            c = _held(c, _ending(F.endswith, f" {w}", f" {first}"))
    return c


def _ending(test, old: str, new: str):
    return lambda x: F.when(test(x, F.lit(old)), F.replace(x, F.lit(old), F.lit(new))).otherwise(x)


def _held(c: Column, step) -> Column:
    """step(c) with c computed once: a step that names its input twice would double the expression each time."""
    return F.transform(F.array(c), step)[0]


def phone(c: Column) -> Column:
    """The last ten digits, filled up with zeros, without the first; empty if there are none of worth."""
    digits = F.substring(F.lpad(F.right(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", ""), F.lit(10)), 10, "0"), 2, 9)
    return F.when(digits.isin(*EMPTY_PHONES), "").otherwise(digits)


def mapped(c: Column, *passes: Mapping[str, str]) -> Column:
    """Whole texts replaced by each pass's entries in order; later entries and passes see the answers of earlier ones."""
    entries = [e for one in passes for e in one.items()]
    table = {}
    for i, (key, to) in enumerate(entries):
        for other, then in entries[i + 1 :]:
            to = then if to == other else to
        table.setdefault(key, to)
    if not table:
        return c
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[c], c)


def _named(c: Column) -> Column:
    return F.when(c == "nan", "").otherwise(c)


def city(c: Column, *passes: Mapping[str, str]) -> Column:
    """Mapped in passes, cut, without "gorod"; "nan" is empty."""
    return _named(F.replace(F.left(mapped(c, *passes), F.lit(LENGTHS["city"])), F.lit("gorod"), F.lit("")))


def state(c: Column) -> Column:
    return _named(mapped(F.left(c, F.lit(LENGTHS["state"])), dict(STATE_SPELLINGS)))


def short_street(c: Column) -> Column:
    """An address, cut, with "str" for "street"; "nan" is empty."""
    return F.replace(F.left(_named(c), F.lit(LENGTHS["address"])), F.lit("street"), F.lit("str"))


def categories(c: Column) -> Column:
    return replaced(_named(F.left(c, F.lit(LENGTHS["categories"]))), CATEGORY_SPELLINGS)


def url(c: Column) -> Column:
    """Normal text without spaces and protocol, cut."""
    c = normal(c, spaces=False)
    for prefix in URL_PREFIXES:
        c = F.regexp_replace(c, f"\\A{prefix}", "")
    return F.left(c, F.lit(LENGTHS["url"]))


def category_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(plain(c)), "[^a-zA-Z]+", " "))


def category_group(c: Column, groups: Sequence[Sequence[str]]) -> Column:
    """-1 without categories, else the number of the first group that one of them is in, 0 if none is."""
    number = F.create_map(*[F.lit(x) for i, group in reversed(list(enumerate(groups, 1))) for label in dict.fromkeys(group) if all(label not in g for g in groups[: i - 1]) for x in (label, i)])
    found = F.filter(F.transform(F.split(F.lower(c), ","), lambda x: number[category_text(x)]), lambda n: n.isNotNull())
    return F.when(F.coalesce(c, F.lit("")).isin("", "nan"), -1).otherwise(F.coalesce(F.get(found, F.lit(0)), F.lit(0)))


def keyword_class(columns: Sequence[Column], classes: Mapping[int, Sequence[str]]) -> Column:
    """The class of which a column holds a keyword; of several the last class of the last column."""
    rules = [(c, n, words) for c in columns for n, words in classes.items()]
    found = [F.when(reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words]), n) for c, n, words in reversed(rules)]
    return F.coalesce(*found, F.lit(0))


def tokens(c: Column) -> Column:
    """Words of two letters or more, other characters blanked."""
    return F.transform(F.filter(F.split(c, " "), lambda x: F.length(x) >= 2), lambda x: F.trim(F.regexp_replace(x, "[^a-zA-Z]+", " ")))


def first_category(c: Column, words: Mapping[str, Sequence[str]]) -> Column:
    """First category of which a keyword is among the text's words."""
    found = tokens(F.lower(plain(c)))
    return F.coalesce(*[F.when(F.arrays_overlap(found, F.array(*[F.lit(w) for w in ws])), name) for name, ws in words.items()], F.lit(""))


def seven_eleven(c: Column) -> Column:
    return replaced(c, [(s + tail, "seven eleven" + gap) for s in SEVEN_ELEVEN for tail, gap in (("#", " "), (" ", " "), ("", ""))])


def sea_world(c: Column) -> Column:
    return replaced(c, [("sea world", "seaworld")])


def mac_donald(c: Column) -> Column:
    return replaced(c, [(s, "mac donald") for s in MC_DONALD])


def common_spellings(c: Column) -> Column:
    return replaced(c, COMMON_SPELLINGS)


def collapsed_name(c: Column) -> Column:
    """Without "center"; chains by their name alone; without a leading "the"."""
    c = F.replace(c, F.lit("center"), F.lit(""))
    return F.when(F.contains(c, F.lit("walmart")), "walmart").when(F.contains(c, F.lit("carrefour")), "carrefour").otherwise(F.regexp_replace(c, r"\Athe", ""))


def ordered_translation(c: Column, words: Mapping[str, str], front: Sequence[str], back: Sequence[str]) -> Column:
    """Words replaced in order; some translations go to the front, some to the back."""
    for word, to in words.items():
        c = _held(c, _translated(word, to, to in front, to in back))
    return c


def _translated(word: str, to: str, front: bool, back: bool):
    def step(x: Column) -> Column:
        gone = F.replace(x, F.lit(word), F.lit(""))
        new = F.concat(F.lit(to), gone) if front else F.concat(gone, F.lit(to)) if back else F.replace(x, F.lit(word), F.lit(to))
        return F.when(F.contains(x, F.lit(word)), new).otherwise(x)

    return step


def word_translation(c: Column, words: Mapping[str, str]) -> Column:
    """Word by word, lower case, joined by spaces."""
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    found = F.regexp_extract_all(F.trim(F.lower(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_join(F.transform(found, lambda w: F.coalesce(table[w], w)), " ")


def address_key(address_: Column, city: Column) -> Column:
    """Address and city as one key; empty if the address is."""
    return F.when(F.coalesce(address_, F.lit("")) == "", "").otherwise(F.concat_ws("-", address_, F.coalesce(city, F.lit(""))))


def digits_number(c: Column) -> Column:
    """The first nine digits as a number; 0 without any."""
    return F.coalesce(F.left(F.regexp_replace(c, "[^0-9]", ""), F.lit(9)).try_cast("int"), F.lit(0))


def number_tokens(c: Column) -> Column:
    """Runs of digits that stand alone between spaces, sorted as texts."""
    return F.array_sort(F.filter(F.split(c, " "), lambda w: w.rlike(r"\A[0-9]+\z")))
