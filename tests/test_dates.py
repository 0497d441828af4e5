import datetime
import random
import re
import warnings

import pandas as pd
import pytest
from pyspark.sql import functions as F

from termloom.functions import dates
from termloom.sources.readers import clean_sheet

SPELLINGS = [
    "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%d.%m.%Y", "%m-%d-%Y", "%Y.%m.%d", "%Y %m %d", "%Y%m%d", "%Y%m%d%H%M%S", "%Y-%m", "%Y", "%d %b %Y", "%d %B %Y", "%b %d, %Y", "%B %d %Y", "%d-%b-%Y", "%d/%b/%Y", "%Y-%b-%d", "%d%b%Y",
    "%a, %d %b %Y", "%A %d %B %Y", "%m/%d/%y", "%d/%m/%y", "%b %Y", "%B %d, %Y %H:%M", "%m/%d/%Y %I:%M %p", "%d.%m.%Y %I:%M:%S %p", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S.%f", "%d/%m/%Y %H:%M:%S", "%H:%M %d/%m/%Y", "%Y%m%dT%H%M%S", "%b %d %Y %H:%M:%S", "%dth %b %Y", "%Y-%m-%dT%H",
]


def expected(values):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        sample = pd.Series(values, dtype=object)
        iso = sample.dropna().astype(str).head(50).str.match(r"\d{4}-\d{2}-\d{2}").all()
        found = pd.to_datetime(sample, format="%Y-%m-%d", errors="coerce") if iso else pd.to_datetime(sample, errors="coerce")
    return [None if pd.isna(x) else x.to_pydatetime() for x in found]


def read(spark, columns):
    """All columns in one table, each by its own first value."""
    rows = list(zip(*columns, strict=True))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(len(columns))))
    first = [next((v for v in c if v is not None), None) for c in columns]
    iso = [all(re.match(dates.ISO, v) for v in c[:50] if v is not None) for c in columns]
    got = df.select("i", *[dates.to_date(F.col(f"c{k}"), iso[k], first=first[k]).cast("timestamp_ntz").alias(f"c{k}") for k in range(len(columns))]).orderBy("i").collect()
    return [[r[f"c{k}"] for r in got] for k in range(len(columns))]


def spelled(rng, how):
    when = datetime.datetime(rng.randrange(1985, 2030), rng.randrange(1, 13), rng.randrange(1, 29), rng.randrange(24), rng.randrange(60), rng.randrange(60), rng.randrange(10**6))
    out = when.strftime(how)
    return out.replace("/0", "/").lstrip("0") if rng.random() < 0.2 and how in ("%m/%d/%Y", "%d/%m/%Y") else out


@pytest.mark.parametrize("seed", [5, 6])
def test_spellings_as_the_library_reads_them(spark, seed):
    """Columns of one spelling, and columns whose later values have another one."""
    rng = random.Random(seed)
    columns = []
    for how in SPELLINGS:
        for _ in range(3):
            columns.append([spelled(rng, how) for _ in range(6)] + [None, "no date", spelled(rng, rng.choice(SPELLINGS))])
    for _ in range(20):
        columns.append([spelled(rng, rng.choice(SPELLINGS[:7])) for _ in range(9)])
    got, want = read(spark, columns), [expected(c) for c in columns]
    assert len(columns) > 120
    wrong = [(c[k], c[0], g[k], w[k]) for c, g, w in zip(columns, got, want, strict=True) for k in range(len(c)) if g[k] != w[k]]
    assert not wrong, wrong[:12]


@pytest.mark.parametrize("values", [
    ["02/03/2024", "13/01/2024", "1/2/2024", "001/2/2024", "1/2/24", "1/2/2024 10:00"], ["13/01/2024", "02/03/2024", "01/13/2024", None, "", "x"], ["no", "02/03/2024", "13/01/2024", "5 Jan 2020", "jan 5 2020", "2020-1-5"],
    ["5 May 2020", "5 Jun 2020", "5 June 2020", "5 may 2020", "x", None], ["5 Jun 2020", "5 May 2020", "5 June 2020", "5 JUN 2020", "31 Jun 2020", None], ["02/03/24", "13/01/24", "99/01/02", "75/1/2", "1/2/75", "1/2/76"],
    ["JAN 5 2020", "Sept 5 2020", "september 5, 2020", "Mon, 6 Jan 2020", "5th Jan 2020", "1/5/2020 3 PM"], ["01/05/2020 03:04 AM", "13/05/2020 03:04 AM", "01/05/2020 03:04 PM", "1/5/2020 3:04 am", "1/5/2020 3:04", None], ["01/05/2020 12:04 AM", "13/05/2020 12:04 PM", "01.05.2020 11:04 pm", "03-20-1989", "2022-12-16T02", None],
    ["2020-01-05 10:11:12", "2020-01-05", "2020-01-05T10:11:12", "2020-01-05 10:11:12.5", "2020-1-5 1:2:3", None],
])
def test_mixed_columns(spark, values):
    assert read(spark, [values])[0] == expected(values)


def test_offsets(spark):
    """In the session's zone, which is UTC here."""
    values = ["2020-01-05T10:11:12Z", "2020-01-05T10:11:12+02:00", "2020-01-05T10:11:12"]
    assert dates.format_of(values[0]).pattern.endswith("XXX") and dates.format_of("2020-01-05 10:11:12 +0200").pattern.endswith("XX")
    df = spark.createDataFrame([(v,) for v in values], "d string")
    got = [r[0] for r in df.select(dates.to_date(F.col("d"), False, first=values[0]).cast("timestamp_ntz")).collect()]
    assert got == [datetime.datetime(2020, 1, 5, 10, 11, 12), datetime.datetime(2020, 1, 5, 8, 11, 12), None]


def test_sheet_columns_follow_their_first_value(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "02/03/2024", "b"), (3, "13/01/2024", "c")], "k int, `data compra` string, x string").coalesce(1)
    got = [r["data compra"] for r in clean_sheet(df).orderBy("k").collect()]
    assert got == [None, datetime.datetime(2024, 2, 3), None]
