"""Text functions as Column expressions: folding to ASCII, cleaning, slugs, postal codes, Python's string forms."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Portuguese stop words, as given.
STOP_WORDS = ["de", "a", "mas", "por", "e", "do", "da", "os", "as", "em", "um", "uma", "para", "com", "sem", "no", "na", "nos", "nas", "o", "à", "ao", "se", "que"]

# Letters that fold to two, or that do not decompose.
MANY = {"ß": "ss", "æ": "ae", "œ": "oe", "Æ": "AE", "Œ": "OE", "þ": "th", "Þ": "Th", "ĳ": "ij", "Ĳ": "IJ"}
ONE = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ð": "d", "Ð": "D", "ħ": "h", "Ħ": "H", "ı": "i", "º": "o", "ª": "a", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "\xa0": " "}


@cache
def folding() -> tuple[str, str]:
    """Latin letters with marks and their bare letters, by canonical decomposition."""
    table = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(bare) == 1 and bare.isascii():
            table[chr(code)] = bare
    table |= ONE
    return "".join(table), "".join(table.values())


# How letters of other scripts are written in Latin, in the order of their alphabets.
CYRILLIC = "а a б b в v г g д d е e ё io ж zh з z и i й i к k л l м m н n о o п p р r с s т t у u ф f х kh ц ts ч ch ш sh щ shch ы y э e ю iu я ia є ie і i ї yi ў u ґ g"
GREEK = "α a β b γ g δ d ε e ζ z η e θ th ι i κ k λ l μ m ν n ξ x ο o π p ρ r ς s σ s τ t υ u φ ph χ kh ψ ps ω o"
SYLLABLES = {"": "あいうえお", "k": "かきくけこ", "g": "がぎぐげご", "s": "さしすせそ", "z": "ざじずぜぞ", "t": "たちつてと", "d": "だぢづでど", "n": "なにぬねの", "h": "はひふへほ", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ", "m": "まみむめも", "y": "や ゆ よ", "r": "らりるれろ", "w": "わゐ ゑを"}
ODD_SYLLABLES = {"し": "shi", "じ": "ji", "ち": "chi", "ぢ": "ji", "つ": "tsu", "づ": "zu", "ふ": "fu", "ん": "n"}
INITIALS, VOWELS = "g gg n d dd r m b bb s ss  j jj c k t p h".split(" "), "a ae ya yae eo e yeo ye o wa wae oe yo u weo we wi yu eu yi i".split(" ")
FINALS = " g gg gs n nj nh d l lg lm lb ls lt lp lh m b bs s ss ng j c k t p h".split(" ")


@cache
def romanised() -> dict[str, str]:
    """Letters of Cyrillic, Greek and the kana with what they become; capitals begin with one, marks of vowels fall away."""
    out = {}
    for text in (CYRILLIC, GREEK):
        words = text.split()
        for a, b in zip(words[::2], words[1::2], strict=True):
            out |= {a: b, a.upper(): b.capitalize()}
    for code in [*range(0x386, 0x3D0), *range(0x1F00, 0x2000)]:  # with marks, as the bare letter
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if bare in out:
            out.setdefault(chr(code), out[bare])
    out |= {"ъ": "", "Ъ": "", "ь": "'", "Ь": "'"}
    kana = {}
    for first, row in SYLLABLES.items():
        for letter, vowel in zip(row, "aiueo", strict=True):
            kana[letter] = first + vowel
    kana = {k: v for k, v in kana.items() if k != " "} | ODD_SYLLABLES
    small = {chr(ord(k) - 1): v for k, v in kana.items() if k in "あいうえおやゆよわ"}
    kana |= small | {"っ": "tsu"}
    return out | kana | {chr(ord(k) + 0x60): v for k, v in kana.items()} | {"ー": "-", "ヴ": "vu"}


#: First and last letter of the blocks that ``romanise`` reads letter by letter.
BLOCKS = [("\u0370", "\u052f"), ("\u1f00", "\u1fff"), ("\u3041", "\u30fc")]


def romanise(c: Column) -> Column:
    """Greek, Cyrillic, kana and Hangul letter by letter in Latin; Hangul by arithmetic on its syllables."""
    table = romanised()
    # A block's letters by their place in it: one literal each, looked up by number.
    listed = lambda a, z: F.split(F.lit("|".join(table.get(chr(k), chr(k)) for k in range(ord(a), ord(z) + 1))), "[|]")
    part = lambda names, at: F.get(F.split(F.lit("|".join(names)), "[|]"), at.cast("int"))
    code = lambda x: F.ascii(x) - 0xAC00
    hangul = lambda x: F.concat(part(INITIALS, F.floor(code(x) / 588)), part(VOWELS, F.floor(code(x) % 588 / 28)), part(FINALS, code(x) % 28))

    def letter(x: Column) -> Column:
        out = F.when(F.octet_length(x) == 1, x)
        for a, z in BLOCKS:
            out = out.when((x >= a) & (x <= z), F.get(listed(a, z), F.ascii(x) - ord(a)))
        return out.when((x >= "\uac00") & (x <= "\ud7a3"), hangul(x)).otherwise(x)

    # As an argument, so that the text is made once; one without such letters is not taken apart.
    known = "[" + "".join(f"{a}-{z}" for a, z in [*BLOCKS, ("\uac00", "\ud7a3")]) + "]"
    whole = lambda t: F.when((F.length(t) == F.octet_length(t)) | ~t.rlike(known), t).otherwise(F.array_join(F.transform(F.split(t, ""), letter), ""))
    return F.transform(F.array(c), whole)[0]


def unaccent(c: Column) -> Column:
    """Latin letters folded to ASCII, Greek, Cyrillic, kana and Hangul written in Latin; other scripts stay as they
    are. Null stays null."""
    for letter, pair in MANY.items():
        c = F.replace(c, F.lit(letter), F.lit(pair))
    return romanise(F.translate(c, *folding()))


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_generic(c: Column) -> Column:
    """Lower case, stripped, ASCII, then everything but word characters, white space and hyphens deleted."""
    return F.regexp_replace(unaccent(strip(F.lower(c))), r"[^\w\s-]", "")


def clean_text(c: Column) -> Column:
    return unaccent(strip(F.lower(c)))


def split_white(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def remove_stopwords(words: Column, custom: list[str] | None = None) -> Column:
    """Words of two letters or more that are neither stop words nor in ``custom``."""
    stop = F.array(*[F.lit(w) for w in dict.fromkeys([*STOP_WORDS, *(custom or [])])])
    return F.filter(words, lambda w: ~F.array_contains(stop, w) & (F.length(w) > 1))


def tokens(c: Column, custom: list[str] | None = None) -> Column:
    """Cleaned words of a text; a null text has none."""
    return F.coalesce(remove_stopwords(split_white(clean_text(c)), custom), F.array().cast("array<string>"))


def slugify(c: Column) -> Column:
    bare = F.regexp_replace(c, r"(?U)[^\w\s-]", "")
    slug = F.lower(F.regexp_replace(F.regexp_replace(bare, r"(?U)[-\s]+", "_"), "^_+|_+$", ""))
    return F.coalesce(F.when(slug != "", slug), F.lit("coluna"))


def count_text(c: Column, part: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("long")


def format_cep(c: Column) -> Column:
    """A postal code's text: every '.0' and ',' deleted, digits kept, padded with zeros to 8; longer ones stay."""
    digits = F.regexp_replace(F.replace(F.replace(c, F.lit(".0"), F.lit("")), F.lit(","), F.lit("")), r"\D", "")
    return F.when(F.length(digits) < 8, F.lpad(digits, 8, "0")).otherwise(digits)


def is_cep(c: Column) -> Column:
    return c.rlike(r"^\d{7,8}(\.0)?$")


def clean_cell(c: Column) -> Column:
    """Stripped, then control characters deleted."""
    return F.regexp_replace(strip(c), r"[\x00-\x1F]+", "")


def py_str(name: str, kind: T.DataType) -> Column:
    """The text that Python's str() gives a column's values: True, 1.0, 1e+16; null stays null."""
    return py_text(F.col(f"`{name}`"), kind)


def py_text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return F.initcap(c.cast("string"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        size = F.abs(d)
        plain = F.when(d == F.floor(d), F.concat(d.cast("decimal(38,0)").cast("string"), F.lit(".0")))
        plain = plain.otherwise(F.when((size >= 1e-3) & (size < 1e7), d.cast("string")).otherwise(F.regexp_replace(d.cast("decimal(38,18)").cast("string"), "0+$", "")))
        text = F.lower(d.cast("string"))
        big = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\.0e", "e"), r"e(\d)", "e+$1"), r"e([+-])(\d)$", "e$10$2")
        return F.when(F.isnan(d), "nan").when(size == float("inf"), F.when(d > 0, "inf").otherwise("-inf")).when((d == 0) | ((size >= 1e-4) & (size < 1e16)), plain).otherwise(big)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.regexp_replace(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.000000$", "")
    return c.cast("string")
