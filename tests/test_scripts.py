import pytest
from pyspark.sql import functions as F

from termloom.functions.text import normalize_generic, romanised, unaccent

CASES = [
    ("Αθήνα", "Athena"), ("Ελλάδα", "Ellada"), ("ψυχή", "psukhe"), ("ὄνομα", "onoma"), ("ΩΜΕΓΑ", "OMEGA"), ("Москва", "Moskva"), ("Жуков щи", "Zhukov shchi"), ("объект", "obekt"), ("Юрий ёж", "Iurii iozh"), ("Київ", "Kiyiv"),
    ("さくら", "sakura"), ("カタカナ", "katakana"), ("とうきょう", "toukiyou"), ("しんじ つづ", "shinji tsuzu"), ("ラーメン", "ra-men"), ("한국", "hangug"), ("서울", "seoul"), ("가힣", "gahih"), ("값", "gabs"),
    ("Sao Paulo", "Sao Paulo"), ("São Straße æ", "Sao Strasse ae"), ("中文 x", "中文 x"), ("", ""), (None, None), ("aБc 1", "aBc 1"), ("\U0001f600 я", "\U0001f600 ia"),
]


def test_scripts(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", unaccent(F.col("t")).alias("x")).collect()}
    assert got == {i: b for i, (_, b) in enumerate(CASES)}


@pytest.mark.parametrize("a,b", [("МОСКВА!", "moskva"), ("  Αθήνα ", "athena")])
def test_normalised(spark, a, b):
    assert spark.createDataFrame([(a,)], "t string").select(normalize_generic(F.col("t"))).first()[0] == b


def test_table_is_whole():
    table = romanised()
    assert all(chr(c) in table for c in [*range(0x410, 0x450), *range(0x3B1, 0x3CA), *range(0x3042, 0x308E), *range(0x30A2, 0x30EE)])
    assert all(v.isascii() for v in table.values())
