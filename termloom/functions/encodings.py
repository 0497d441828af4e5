"""Encodings from bytes: marks, then what only a multi-byte code can be, then pairs of characters under each single-byte code."""

from __future__ import annotations

import codecs
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Byte order marks, and encodings by the names that readers know, with Python's.
MARKS = [(b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe\x00\x00", "UTF-32LE"), (b"\x00\x00\xfe\xff", "UTF-32BE"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")]
SINGLE = {"windows-1252": "cp1252", "IBM850": "cp850", "windows-1250": "cp1250", "windows-1251": "cp1251", "KOI8-R": "koi8_r", "ISO-8859-5": "iso8859_5", "IBM866": "cp866", "windows-1253": "cp1253", "x-MacRoman": "mac_roman"}
MULTI = {"EUC-JP": "euc_jp", "EUC-KR": "euc_kr", "Shift_JIS": "cp932", "Big5": "big5", "GB18030": "gb18030"}
PYTHON = SINGLE | MULTI | {"US-ASCII": "ascii", "UTF-8": "utf-8", "UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be", "UTF-32LE": "utf-32-le", "UTF-32BE": "utf-32-be", "ISO-8859-1": "latin-1", "ISO-2022-JP": "iso2022_jp"}
# Letters that Western and Central European languages write, and signs that stand in prose.
WESTERN, CENTRAL = "àâäáãåæçèéêëìíîïñòóôöõøùúûüÿßœ", "ąćęłńóśźżčďěňřšťůžőűáéíúýöüôľĺŕäëţşăîâđ"
CYRILLIC, GREEK = "".join(map(chr, range(0x430, 0x450))) + "ё", "".join(map(chr, range(0x3B1, 0x3CA))) + "άέήίόύώ"
SIGNS = "“”‘’„‚–—…«»¿¡€£§°·©®™ºª\xa0"


def kind_of(c: str) -> str:
    """l lower and u upper case, d digit, s white space, p punctuation, q a sign of prose, x another sign, c control."""
    if c in "\t\n\r ":
        return "s"
    category = unicodedata.category(c)
    if category in ("Ll", "Lo") and c not in "ºª":
        return "l"
    if category in ("Lu", "Lt"):
        return "u"
    if category == "Nd":
        return "d"
    if c in SIGNS:
        return "q"
    return "c" if category in ("Cc", "Cf", "Cn", "Co") else "p" if c.isascii() else "x"


def script(c: str) -> str:
    return unicodedata.name(c, " ").partition(" ")[0]


#: What a pair of kinds tells where one of the two is beyond ASCII. Words are lower case, or begin upper, or are upper.
PAIRS = {"ll": 2, "ul": 2, "lu": -4, "uu": 1, "sl": 0.5, "pl": 0.5, "ls": 0.5, "lp": 0.5, "su": 0.5, "pu": 0.5, "us": 0, "up": 0, "dl": -2, "ld": -2, "du": -2, "ud": -2, "lx": -4, "xl": -4, "ux": -4, "xu": -4}


@cache
def pair_scores(name: str) -> np.ndarray:
    """256 x 256: how likely one byte follows another under a single-byte code."""
    letters = {"windows-1250": CENTRAL, "windows-1253": GREEK}.get(name, CYRILLIC if name in ("windows-1251", "KOI8-R", "ISO-8859-5", "IBM866") else WESTERN)
    chars = [bytes([b]).decode(SINGLE[name], "replace") for b in range(256)]
    kinds = ["c" if c == "�" else kind_of(c) for c in chars]
    scripts = [script(c) if k in "lu" else "" for c, k in zip(chars, kinds, strict=True)]
    rare = [b >= 128 and k in "lu" and c.lower() not in letters for b, (c, k) in enumerate(zip(chars, kinds, strict=True))]
    out = np.zeros((256, 256), np.float32)
    for a in range(256):
        for b in range(128 if a < 128 else 0, 256):
            pair = kinds[a] + kinds[b]
            score = -10 if "c" in pair else PAIRS.get(pair, -1 if "x" in pair else 0)
            if scripts[a] and scripts[b] and scripts[a] != scripts[b]:
                score = -5
            out[a, b] = score - 1.5 * (rare[a] + rare[b])
    for a in range(128):
        out[a, :128] = 0
    return out


@cache
def common_characters(name: str) -> tuple[frozenset, frozenset]:
    """(characters that texts under a multi-byte code are made of, those of these that they can hardly do without)."""
    rows = {"EUC-JP": (0xB0, 0xCF), "Shift_JIS": (0xB0, 0xCF), "EUC-KR": (0xB0, 0xC8), "GB18030": (0xB0, 0xD7), "Big5": (0xA4, 0xC6)}
    code = {"EUC-JP": "euc_jp", "Shift_JIS": "euc_jp", "EUC-KR": "euc_kr", "GB18030": "gb2312", "Big5": "big5"}[name]
    low, high = rows[name]
    found = {bytes([a, b]).decode(code, "ignore") for a in range(low, high + 1) for b in range(0x40, 0xFF)}
    kana = {chr(c) for c in [*range(0x3041, 0x3097), *range(0x30A1, 0x30FD)]} if code == "euc_jp" else set()
    signs = set("、。，．！？：；「」『』（）《》“”・ー～　…")
    return frozenset((found | kana | signs) - {""}), frozenset(kana)


def multi_byte(raw: bytes) -> tuple[float, str]:
    """(share of common characters less that of others, name) of the best multi-byte code that reads the bytes."""
    best = (-1.0, "")
    for name, code in MULTI.items():
        try:
            text = codecs.getincrementaldecoder(code)("strict").decode(raw)
        except UnicodeDecodeError:
            continue
        wide = [c for c in text if ord(c) > 127]
        if not wide:
            continue
        common, needed = common_characters(name)
        good = sum(c in common for c in wide)
        beside = sum(ord(a) > 127 and b.isascii() and b.isalpha() or ord(b) > 127 and a.isascii() and a.isalpha() for a, b in zip(text, text[1:], strict=False))
        score = (2 * good - len(wide) - beside) / len(wide) - (0.6 if needed and sum(c in needed for c in wide) < 0.1 * len(wide) else 0)
        best = max(best, (round(score, 6), name), key=lambda x: x[0])  # the first of equals
    return best


# Pairs of letters that tell a language where they stand close to a letter beyond ASCII, and the letters
# beyond ASCII that it writes often, and now and then.
LANGUAGES = {
    "de": ("ch sc ei ie un ng ke ic li zu tz ge be ve pf mi", "äöüß", "é"),
    "fr": ("ea eu ux qu ue oi ou ai le ur vi et", "éèçêà", "âîôûùëïœæ"),
    "es": ("ci os as el lo la ad do ro po co ra ac", "óñíáéú", "ü"),
}
MARKERS = np.zeros((len(LANGUAGES), 256, 256), np.int32)
for _k, (_pairs, _, _) in enumerate(LANGUAGES.values()):
    for _a, _b in [(_p[0], _p[1]) for _q in _pairs.split() for _p in (_q, _q.upper(), _q.capitalize())]:
        MARKERS[_k, ord(_a), ord(_b)] = 1
# Short words that a language's sentences can hardly do without, and what one tells beside a pair of letters.
WORDS = {
    "de": "der die und den von zu das mit sich des auf ist im nicht dem ein eine als",
    "fr": "de la le et les des en un du une que pour est par qui dans avec sur pas au",
    "es": "de la que el en y los se del las un por con no su una para es al lo",
}
WORD, LONGEST = 3, max(len(w) for words in WORDS.values() for w in words.split())


def coded(word: bytes) -> int:
    return int.from_bytes(word.ljust(LONGEST, b"\0"), "little")


CODES = np.array(sorted({coded(w.encode()) for words in WORDS.values() for w in words.split()}), np.int64)
SPOKEN = np.array([np.isin(CODES, [coded(w.encode()) for w in words.split()]) for words in WORDS.values()], np.int32)
#: Bytes to either side in which a language is looked for, and what the whole text's language tells there.
AROUND, WHOLE = 40, 0.6
#: What a letter counts less in a code that few files have.
RARE = 0.5


def spoken(padded: np.ndarray) -> np.ndarray:
    """By language and byte: what the pair of letters, or the short word, that begins there tells for it. A word that
    only says the one before again tells nothing."""
    out = np.array([marker[padded[:-1], padded[1:]] for marker in MARKERS])
    letter = np.r_[False, (padded | 32 >= 97) & (padded | 32 <= 122) | (padded >= 128), False]
    edges = np.flatnonzero(letter[1:] != letter[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    sums = np.r_[0, padded.cumsum(dtype=np.int64)], np.r_[0, (padded * np.arange(len(padded), dtype=np.int64)).cumsum()]
    plain, placed = (s[starts + sizes] - s[starts] for s in sums)
    word = np.array([sizes, plain, placed - starts * plain])
    again = np.r_[False, (word[:, 1:] == word[:, :-1]).all(axis=0)][: len(starts)]
    inside = np.zeros(len(padded) + 1, np.int8)
    inside[starts[again]] = 1
    inside[(starts + sizes)[again]] = -1
    out[:, inside[:-1].cumsum()[: out.shape[1]] > 0] = 0
    told = ~again & (sizes <= LONGEST)
    starts, sizes = starts[told], sizes[told]
    codes = np.zeros(len(starts), np.int64)
    for i in range(LONGEST):
        codes += np.where(i < sizes, padded[np.minimum(starts + i, len(padded) - 1)] | 32, 0).astype(np.int64) << 8 * i
    place = np.minimum(np.searchsorted(CODES, codes), len(CODES) - 1)
    known = CODES[place] == codes
    out[:, starts[known]] += WORD * SPOKEN[:, place[known]]
    return out


@cache
def letter_scores(name: str) -> tuple[np.ndarray, np.ndarray]:
    """(by language and byte: how foreign a letter is there, by byte: 1 upper, -1 lower case, 0 no letter) beyond ASCII."""
    chars = [bytes([b]).decode(SINGLE[name], "replace") for b in range(256)]
    kinds = [kind_of(c) if b >= 128 and c != "�" else "" for b, c in enumerate(chars)]
    case = np.array([{"u": 1, "l": -1}.get(k, 0) for k in kinds], np.float32)
    out = np.array([[0 if not x else 0 if c.lower() in often else -0.4 if c.lower() in some else -1 for c, x in zip(chars, case, strict=True)] for _, often, some in LANGUAGES.values()], np.float32)
    return out, case


@cache
def vowels(name: str) -> np.ndarray:
    """Which bytes beyond ASCII are vowels under a code of another script."""
    return np.array([b >= 128 and bytes([b]).decode(SINGLE[name], "replace").lower() in "аеёиоуыэюяієїαεηιουωάέήίόύώϊϋΐΰ" for b in range(256)])


def weights(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A letter in the same surroundings again tells less: n of them together count as the root of n."""
    near = np.zeros(len(at), np.uint64)
    for i in range(-4, 4):
        near = near << np.uint64(8) | padded[np.clip(at + i, 0, len(padded) - 1)].astype(np.uint64)
    _, which, many = np.unique(near, return_inverse=True, return_counts=True)
    return many[which] ** -0.5


def single_byte(raw: bytes) -> str:
    """The code under which pairs of characters look most like words, letters beyond ASCII belong to the language of the
    words around them, sentences begin with capitals, and words in other scripts have vowels and more than a few letters."""
    padded = np.frombuffer(b". " + raw + b"  ", np.uint8)
    at = np.flatnonzero(padded >= 128)
    found, weight = padded[at], weights(padded, at)
    last = padded[at + 1] < 128  # pairs within ASCII tell nothing
    scores = {}
    for name in SINGLE:
        pairs = pair_scores(name)
        scores[name] = float((weight * (pairs[padded[at - 1], found] + last * pairs[found, padded[at + 1]])).sum())
    low, high = np.maximum(0, at - AROUND), np.minimum(len(padded) - 1, at + AROUND)
    seen = np.c_[np.zeros(len(MARKERS)), spoken(padded).cumsum(axis=1)]
    whole = seen[:, -1:] + 0.2
    shares = WHOLE * whole / whole.sum() + seen[:, high] - seen[:, low]
    shares /= shares.sum(axis=0)
    begins = (padded[at - 1] == 10) | (padded[at - 1] == 32) & np.isin(padded[at - 2], np.frombuffer(b".!?\n", np.uint8))
    capital = (padded >= 65) & (padded <= 90)
    capitals = capital[at - 1] & capital[at - 2] | capital[at + 1]
    starts = np.flatnonzero(np.diff(at, prepend=-1) > 1)
    runs = np.diff(starts, append=len(at))
    plain = np.count_nonzero((padded | 32 >= 97) & (padded | 32 <= 122))
    short = runs[runs <= (3 if plain > len(at) else 2)].sum() > 0.5 * len(at)
    for name in SINGLE:
        foreign, case = letter_scores(name)
        if name in ("windows-1252", "IBM850", "x-MacRoman", "windows-1250"):
            scores[name] += float(((shares * foreign[:, found]).sum(axis=0) * weight).sum() + ((0.3 * begins + 1.5 * capitals) * case[found] * weight).sum())
            scores[name] -= RARE * weight.sum() if name == "x-MacRoman" else 0.0  # where a code reads as well, it is that one
        else:
            mute = (runs > 1) & (np.add.reduceat(vowels(name)[found].astype(np.int64), starts) == 0)
            scores[name] -= 2.0 * float((weight * np.repeat(short | mute, runs)).sum())
    return max(scores, key=scores.__getitem__)  # the first of equals


def detect_encoding(raw: bytes) -> str:
    """The encoding of a file by its head. A character cut at the end does not count; no bytes are UTF-8.

    A byte order mark decides, then zero bytes at every other place, then UTF-8 if the bytes are. Else a multi-byte
    code whose characters are mostly common ones, or the single-byte code under which words look most like words.
    """
    for mark, name in MARKS:
        if raw.startswith(mark):
            return name
    if not raw:
        return "UTF-8"
    zero = [raw[i::2].count(0) / max(1, len(raw[i::2])) for i in (0, 1)]
    if max(zero) > 0.4 and min(zero) < 0.1:
        return "UTF-16LE" if zero[1] > zero[0] else "UTF-16BE"
    if raw.isascii():
        return "ISO-2022-JP" if b"\x1b$" in raw else "US-ASCII"
    try:
        codecs.getincrementaldecoder("utf-8")("strict").decode(raw)
        return "UTF-8"
    except UnicodeDecodeError:
        pass
    score, name = multi_byte(raw)
    if score > 0.4:
        return name
    name = single_byte(raw)
    return "ISO-8859-1" if name == "windows-1252" and not any(0x80 <= b < 0xA0 for b in raw) else name


def detect_encodings(heads: DataFrame, column: str, name: str = "encoding") -> DataFrame:
    """``heads`` and the encoding of the bytes in ``column``; null for null. One job over any number of files' heads."""
    schema = T.StructType([*heads.schema.fields, T.StructField(name, T.StringType())])
    at = heads.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if b is None else detect_encoding(b) for b in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, name])

    return heads.mapInArrow(run, schema)
