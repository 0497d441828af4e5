import random

import pytest

from termloom.functions import encodings
from termloom.sources.readers import load

SAID = {
    "de": "Die Straße führt über die Brücke. Äpfel und Öl kosten dort weniger, meint Frau Müller; das Gebäude schließt früh.",
    "fr": "L’été dernier, nous avons dîné à la plage près du château. Ça coûtait déjà très cher, où est l’œuvre d’Hélène ?",
    "es": "¿Cuándo vendrá el niño? La señora García está en España; el avión llegó tarde y mañana volverá también.",
    "pl": "Zażółć gęślą jaźń. W Łodzi mieszka dużo ludzi, którzy często jeżdżą do Krakowa; są też później źródła.",
    "cs": "Příliš žluťoučký kůň úpěl ďábelské ódy. Čeština má háčky, dvě řeky a několik měst včetně Brna.",
    "ru": "Широка страна моя родная, много в ней лесов, полей и рек. Я другой такой страны не знаю.",
    "el": "Η Αθήνα είναι η πρωτεύουσα της Ελλάδας και η μεγαλύτερη πόλη της χώρας. Πολλοί άνθρωποι ζουν εκεί.",
    "ja": "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。何でも薄暗いじめじめした所でニャーニャー泣いていた。",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    "tw": "人人生而自由，在尊嚴和權利上一律平等。他們賦有理性和良心，並應以兄弟關係的精神相對待。",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았다.",
}
CASES = [("de", "ISO-8859-1"), ("fr", "windows-1252"), ("es", "ISO-8859-1"), ("de", "IBM850"), ("es", "IBM850"), ("fr", "x-MacRoman"), ("de", "x-MacRoman"), ("pl", "windows-1250"), ("cs", "windows-1250"), ("ru", "windows-1251"), ("ru", "KOI8-R"), ("ru", "ISO-8859-5"), ("ru", "IBM866"), ("el", "windows-1253"),
         ("ja", "Shift_JIS"), ("ja", "EUC-JP"), ("ja", "ISO-2022-JP"), ("zh", "GB18030"), ("tw", "Big5"), ("ko", "EUC-KR"), *[(x, e) for x in SAID for e in ("UTF-8", "UTF-16LE", "UTF-16BE", "UTF-32LE")]]
MARKED = {name: mark for mark, name in encodings.MARKS}


@pytest.mark.parametrize("said,name", CASES)
def test_sentences(said, name):
    text = SAID[said]
    raw = text.encode(encodings.PYTHON[name], "ignore" if name in encodings.SINGLE else "strict")
    mark = MARKED.get(name, b"") if name.startswith("UTF") else b""
    assert encodings.detect_encoding(mark + raw) == name
    if name.startswith("UTF") and "32" not in name and said not in ("ja", "zh", "tw", "ko", "ru", "el"):
        assert encodings.detect_encoding(raw) == name  # without a mark too
    for cut in range(1, 4):  # a head that ends inside a character
        assert encodings.detect_encoding(mark + raw[:-cut]) == name


def test_plain_and_empty():
    assert encodings.detect_encoding(b"") == "UTF-8" and encodings.detect_encoding(b"plain, text\n") == "US-ASCII"
    rng = random.Random(1)
    for _ in range(200):
        assert encodings.detect_encoding(bytes(rng.randrange(256) for _ in range(rng.randrange(60)))) in encodings.PYTHON


@pytest.mark.parametrize("said,name", [("ru", "windows-1251"), ("ru", "KOI8-R"), ("ja", "Shift_JIS"), ("zh", "GB18030"), ("ko", "EUC-KR"), ("pl", "windows-1250"), ("fr", "windows-1252"), ("de", "UTF-16LE"), ("ru", "UTF-16BE"), ("de", "UTF-8")])
def test_files(spark, tmp_path, said, name):
    text = SAID[said].replace(",", " ").replace(";", " ")
    words = text.encode(encodings.PYTHON[name], "ignore").decode(encodings.PYTHON[name])
    mark = MARKED.get(name, b"") if name.startswith("UTF-16") else b""
    (tmp_path / "t.csv").write_bytes(mark + f"n,{words.split()[0]}\n1,{words}\n2,x\n".encode(encodings.PYTHON[name]))
    rows = load(spark, str(tmp_path / "t.csv")).orderBy("n").collect()
    assert rows[0].asDict() == {"n": 1, words.split()[0]: words} and len(rows) == 2


def test_many_heads(spark):
    rows = [(i, None if i == 3 else SAID[s].encode(encodings.PYTHON[n], "ignore")) for i, (s, n) in enumerate(CASES[:20])]
    got = {r["i"]: r["encoding"] for r in encodings.detect_encodings(spark.createDataFrame(rows, "i int, head binary"), "head").collect()}
    assert got == {i: None if i == 3 else n for i, (_, n) in enumerate(CASES[:20])}


@pytest.mark.parametrize("code,name", [("cp850", "IBM850"), ("latin-1", "ISO-8859-1")])
@pytest.mark.parametrize("text", ["Étre de sur è.", "Le Le eux eux eux Ê Ê Ê", "Enß chungbe scheiner stte ist der tezu ist der die", "Équeeuxaux auxç eau çier de pour en qui reeux.", "Des le. Étre. Aiention è aitrement la.", "Keitte verßlich verßlich chß ch", "Erbekeit!! RUNGÜ!! DER KEITÄ!! IEENÖCHST", "Rétionle menttion. Éèlean ouieran."])
def test_capitals_and_letters_of_the_language(text, code, name):
    """Texts with few letters beyond ASCII: capitals, single letters, letters that only the words around them tell."""
    assert encodings.detect_encoding(text.encode(code)) == name


@pytest.mark.parametrize("code,name", [("cp850", "IBM850"), ("latin-1", "ISO-8859-1")])
@pytest.mark.parametrize("text", ["Äau " * 30 + "der " * 30, "Un aion ou de les de la. anpa " + "éenre. " * 20 + "Du le des", "An de de la eauque " + "étre. " * 30, "Euxai la la " + "ouaion, " * 9 + "de de de " + "ééê. " * 20, "Ouwhea the of rend.\nChsch der üöö enbekeit ö, den. Aukei", "The a and of the her.\nÓ y uecoez ra el", "Le Le de de de " + "ètion. " * 40 + "Aneau."])
def test_repeated_words_and_passages(text, code, name):
    """A word said again tells little more; the whole text's words count where the next ones tell no language; words of
    another script have vowels."""
    assert encodings.detect_encoding(text.encode(code)) == name


def test_a_word_said_again_tells_no_language():
    """The pairs of letters of a repeated word stand around each letter, the rest of the text is in another language."""
    text = "Mentèch " * 37 + "est est est la pour les " + "eaure dans une " * 3
    assert encodings.detect_encoding(text.encode("cp850")) == "IBM850"
    said = encodings.spoken(encodings.np.frombuffer(b". ch ch chch ch ", encodings.np.uint8))
    assert said[0].tolist() == [0, 0, 1, 0, 0, 0, 0, 0, 1, 0, 1, 0, 0, 1, 0]
