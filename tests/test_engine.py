import os

import duckdb
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom import queries
from termloom.functions.dates import to_date
from termloom.functions.similarity import cosine, indel_ratio
from termloom.functions.text import count_text, format_cep, normalize_generic, py_str, slugify, tokens
from termloom.operators import aggregates, charts, cleaning, clustering, postings, predicates, terms
from termloom.operators.dictionary import detect_column_types, dictionary
from termloom.plans.profile import profile
from termloom.sources import readers, sinks


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("given_,wanted", [("1310100", "01310100"), ("1310100.0", "01310100"), ("abc", "00000000"), ("123456789", "123456789"), ("1,310,100", "01310100"), (None, None)])
def test_format_cep(spark, given_, wanted):
    assert value(spark, given_, format_cep) == wanted


@pytest.mark.parametrize("given_,wanted", [("Endereço Completo!", "endereço_completo"), ("!!!", "coluna"), ("a - b", "a_b"), ("_x_", "x")])
def test_slugify(spark, given_, wanted):
    assert value(spark, given_, slugify) == wanted


@pytest.mark.parametrize("given_,wanted", [("  São-Paulo (SP) ", "sao-paulo sp"), ("Straße", "strasse"), ("!!!", ""), (None, None)])
def test_normalize(spark, given_, wanted):
    assert value(spark, given_, normalize_generic) == wanted


def test_tokens(spark):
    assert value(spark, "de casa a loja x", tokens) == ["casa", "loja"]
    assert value(spark, None, tokens) == []
    assert value(spark, "casa loja", lambda c: tokens(c, ["loja"])) == ["casa"]


def test_count_text(spark):
    assert value(spark, "a,b,,c", lambda c: count_text(c, ",")) == 3


def test_py_str(spark):
    numbers = [1.0, 0.5, 12345678.0, 12345678.5, 1e16, 1.5e20, 0.0005, 0.00005, -3.25, 0.0, 1e-7, 123456789012345.0]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    assert [r["y"] for r in df.select(py_str("x", T.DoubleType()).alias("y")).collect()] == [str(x) for x in numbers]
    assert spark.createDataFrame([(True,)], "x boolean").select(py_str("x", T.BooleanType()).alias("y")).first()["y"] == "True"


@pytest.mark.parametrize("a,b,lcs,total", [("kitten", "sitting", 4, 13), ("apple inc", "apple inc.", 9, 19), ("Apple Inc", "APPLE INC", 3, 18), ("", "x", 0, 1)])
def test_indel(spark, a, b, lcs, total):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(indel_ratio("a", "b").alias("r")).first()["r"]
    assert got == pytest.approx(200 * lcs / total)


def test_indel_of_empty(spark):
    assert spark.createDataFrame([("", "")], "a string, b string").select(indel_ratio("a", "b").alias("r")).first()["r"] == 100


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r["c"] for r in df.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[0] == pytest.approx(0.5**0.5) and got[1] is None


def test_dates(spark):
    assert str(value(spark, "2024-03-02", lambda c: to_date(c, True))) == "2024-03-02 00:00:00"
    assert value(spark, "2024-03-02 10:00:00", lambda c: to_date(c, True)) is None
    assert str(value(spark, "13/01/2024", lambda c: to_date(c, False))) == "2024-01-13 00:00:00"


def test_names(spark):
    golden = {"Cidade": "cidade", "City": "urbano", "Nome": "numero", "Status": "rua", "Region": "rua", "Localidade": "regional", "CPF": "cnpj", "Código": "id", "Area": "bairro", "Standard": "basico", "Mesa": "mes", "Type": "categoria", "Quantidade": None, "Total": None, "Name": None}
    df = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in golden]))
    assert detect_column_types(df) == golden
    assert detect_column_types(df, dictionary(spark, {"soma": ["Total"]}))["Total"] == "soma"
    assert [predicates.is_date_name(c) for c in ("media", "update", "l_shipdate", "ts")] == [True, True, True, False]


def test_names_outside_the_tables(spark):
    golden = {"Diâmetro": "dia", "Store": "rua", "Região": "rua", "Rede": "rua", "Sales Rep": "venda", "Fornecedor": "fornecedor", "Empresa": "empresa", "Estoque": "estoque", "Pagamento": "pagamento", "Moeda": "moeda", "Invoice": "fatura", "Supplier": "fornecedor", "Currency": "moeda", "Department": "departamento", "Latitude": "coordenadas", "Receita": "receita", "Oferta": "oferta", "Lançamento": "lancamento", "Lote": "lote", "Setor": "setor", "Depósito": "deposito"}
    assert detect_column_types(spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in golden]))) == golden
    terms = dictionary(spark)
    assert terms.count() == 2722 and terms.select("tipo").distinct().count() == 866
    places = {r["tipo"]: r["prio"] for r in terms.select("tipo", "prio").distinct().collect()}
    assert sorted(places.values()) == list(range(866)) and places["red_lobster"] == 0 and places["webinar"] == 865
    assert [r["synonym"] for r in terms.where("tipo = 'receita'").orderBy("syn_prio").collect()] == ["Receita", "Revenue", "Income", "Faturamento", "Earnings"]
    assert [r["tipo"] for r in terms.where("tipo in ('receita', 'oferta', 'lancamento', 'lote', 'setor', 'rede', 'deposito')").groupBy("tipo").agg(F.min("prio").alias("prio")).orderBy("prio").collect()] == ["receita", "oferta", "lancamento", "lote", "setor", "rede", "deposito"]


def greedy(words, near):
    leaders, out = [], []
    for i, w in enumerate(words):
        hit = next((k for k in leaders if near(words[k], w)), i)
        if hit == i:
            leaders.append(i)
        out.append(hit)
    return out


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab ", max_size=9), min_size=1, max_size=25, unique=True))
def test_fuzzy_clusters(spark, words):
    df = spark.createDataFrame([("c", w, i) for i, w in enumerate(words)], "coluna string, norm string, pos long")
    got = {r["pos"]: r["leader"] for r in clustering.fuzzy_clusters(df).collect()}
    near = lambda a, b: not a + b or 200 * lcs_length(a, b) >= 88 * len(a + b)
    assert [got[i] for i in range(len(words))] == greedy(words, near)


def test_leader_order(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "pos long")
    edges = spark.createDataFrame([(1, 0), (2, 1), (4, 3), (4, 2)], "pos long, earlier long")
    got = {r["pos"]: r["leader"] for r in clustering.leaders_by_rounds(nodes, edges).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 2}


def test_embedding_clusters(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0])], "pos long, v array<float>")
    assert {r["pos"]: r["leader"] for r in terms.embedding_clusters(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}


def test_profile(spark):
    rows = [(i, "Sul" if i % 2 else "sul ", f"2024-01-{i:02d}", i * 1.5, None) for i in range(1, 13)]
    df = spark.createDataFrame(rows, "id long, zona string, data string, valor double, vazio string")
    seen = []
    found = profile(df, progress=lambda a, b: seen.append((a, b)))
    assert found.header() == {"id_coluna": "id", "total_linhas": 12, "total_colunas": 5}
    assert found.kinds == {"zona": "terms", "data": "date", "valor": "number", "vazio": "terms"}
    table = found.tables.collect()
    assert [(r["coluna"], r["termo_base"], r["variantes"], r["frequencia"]) for r in table] == [("zona", "SUL", "Sul; sul", 12)]
    assert clustering.with_ids(found.tables, found.ids).first()["ids"] == "1,10,11,12,2,3,4,5,6,7,8,9"
    assert found.dates.first()["max"] == "2024-01-12 00:00:00" and found.numbers.first()["media"] == pytest.approx(9.75)
    assert seen[-1] == (4, 4)


def test_numbered_rows(spark):
    df = spark.range(50).repartition(5)
    got = {r["id"]: r["_id"] for r in cleaning.number_rows(df, ["id"]).collect()}
    assert got == {i: str(i + 1) for i in range(50)}
    assert cleaning.number_rows(spark.range(0), ["id"]).count() == 0


def test_shaping(spark):
    df = spark.createDataFrame([(" a\x00b\t", None, 1), (None, None, None)], "` x ` string, y string, n int")
    out = readers.clean_sheet(df)
    assert out.columns == ["x", "n"] and [tuple(r) for r in out.collect()] == [("ab", 1)]
    keyed = cleaning.ensure_id(out)
    assert keyed.columns[0] == "id" and len(keyed.first()["id"]) == 36 and cleaning.ensure_id(keyed) is keyed


def test_cep_columns(spark):
    df = spark.createDataFrame([(i, 1310100 + i, f"x{i}") for i in range(10)], "k long, cep long, t string")
    assert cleaning.normalize_cep(df, order="k").select("cep").first()["cep"] == "01310100"


def test_top_values_cap(spark):
    df = spark.createDataFrame([(i, f"v{i % 250}" if i < 500 else "v7") for i in range(600)], "id long, c string")
    kept = aggregates.top_values(aggregates.long_values(df, ["c"], "id", "id"))
    counts = {r["v"]: r["n"] for r in aggregates.value_counts(kept).collect()}
    assert len(counts) == 100 and counts["v7"] == 102


def test_heads(spark, tmp_path):
    assert readers.detect_delimiter("a,b;c") == "," and readers.detect_delimiter("abc") == "," and readers.detect_delimiter("a;b;c,d") == ";"
    assert readers.detect_encoding("é".encode()) == "UTF-8" and readers.detect_encoding("é".encode()[:1]) == "UTF-8" and readers.detect_encoding("é à é ã ç".encode("latin-1")) == "ISO-8859-1"
    (tmp_path / "x.csv").write_bytes("nome;n\nJoão;1\nNA;2\n".encode("latin-1"))
    got = [tuple(r) for r in readers.load(spark, str(tmp_path / "x.csv")).collect()]
    assert got == [("João", 1), (None, 2)]
    assert readers.validate_file(spark, str(tmp_path / "x.csv"))
    with pytest.raises(ValueError):
        readers.validate_file(spark, str(tmp_path / "x.csv"), 0)
    with pytest.raises(ValueError, match="Formato"):
        readers.load(spark, "x.txt")


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame([("Zona Sul", "A", "a; A", 3, "1,2,3"), ("Zona Sul", "B", "b", 1, "4")], "coluna string, termo_base string, variantes string, frequencia long, ids string")
    sinks.write_tables(table, str(tmp_path / "t"))
    assert (tmp_path / "t" / "slug=zona_sul").is_dir()
    assert "A" in sinks.show(table)
    assert sinks.report_json(table).first()["tabela"].startswith('[{"termo_base":"A"')
    stats = spark.createDataFrame([("v", {"min": "1"})], "coluna string, estatisticas map<string, string>")
    sinks.write_stats(stats, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).first()["value"] == "min: 1"


def test_chart_errors(spark):
    with pytest.raises(ValueError):
        charts.scatter(spark.range(3), "id", ["id"])


def test_no_label_no_chart(spark):
    assert charts.bar(spark.createDataFrame([(1, 2)], "x int, frequencia int"), ["x"]) is None


def views():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    if name not in queries.oracle_sql():
        assert got
        return
    answer = views().execute(queries.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert got == sorted(str(tuple(r[names.index(c)] for c in columns)) for r in answer.fetchall())


def test_distinct_counts(spark):
    """Estimates decide nothing: keys, categories and small counts come out as exact counting has them."""
    df = spark.range(5000).selectExpr("id as a", "id % 29 as b", "id % 30 as c", "cast(nullif(id, 7) as string) as d", "id div 2 as e", "cast(null as int) as f", "id % 1000 as g")
    whole = {r["coluna"]: r for r in predicates.column_stats(df).collect()}
    quick = {r["coluna"]: r for r in predicates.column_stats(df, exact=False).collect()}
    assert [whole[c]["n_distinct"] for c in "abcdefg"] == [5000, 29, 30, 4999, 2500, 0, 1000]
    assert [(whole[c]["is_id"], whole[c]["is_categorical"]) for c in "abcdefg"] == [(quick[c]["is_id"], quick[c]["is_categorical"]) for c in "abcdefg"]
    assert [c for c in "abcdefg" if quick[c]["is_id"]] == ["a", "d"] and [c for c in "abcdefg" if quick[c]["is_categorical"]] == ["b", "f"]


def test_profile_without_ids(spark):
    """Frequencies are the same with and without the ids, for keys with and without repeats, and equal first places stay apart."""
    df = spark.range(600).selectExpr("id as k", "id div 3 as twice", "element_at(array('Apple Inc', 'apple inc.', 'Pear', null), cast(id % 4 + 1 as int)) as x", "id % 5 / 10 as y")
    for key in ("k", "twice"):
        a, b = (profile(df, order=key, key=key, ids=i).tables.where("coluna in ('x', 'y')") for i in (True, False))
        assert a.columns[:4] == b.columns
        assert [tuple(r)[:4] for r in a.collect()] == [tuple(r) for r in b.collect()]
    assert [r["frequencia"] for r in b.where("coluna = 'x'").collect()] == [200, 150]


def test_show_any_table(spark):
    assert sinks.show(spark.createDataFrame([(1, "b"), (0, "a")], "n int, v string").coalesce(1)).split() == ["n", "v", "1", "b", "0", "a"]
    assert sinks.show(spark.createDataFrame([("x", "y", 2)], "termo_base string, variantes string, n int")).split() == ["termo_base", "variantes", "x", "y"]
    assert "min" in sinks.show_stats({"min": 1}) and sinks.show_stats({}).startswith("Sem dados")


def test_dates_follow_the_first_value(spark):
    for values, want in ((["13/02/2020", "01/03/2020", "2020-01-05"], "2020-02-13 00:00:00"), (["02/13/2020", "01/03/2020"], "2020-01-03 00:00:00"), (["5 Jan 2020", "7 Feb 2019"], "2019-02-07 00:00:00"), (["no", "1.5.2020"], "2020-01-05 00:00:00")):
        df = spark.createDataFrame(list(enumerate(values)), "i int, d string")
        assert aggregates.date_stats(df, ["d"], "i").first()["min"] == want


def test_terms_frequency(spark):
    df = spark.createDataFrame([(1, "casa azul casa"), (2, "casas azul"), (3, None), (3, "verde")], "id int, t string")
    vectors = {"casa": [1.0, 0.0], "casas": [0.95, 0.1], "azul": [0.0, 1.0], "verde": [0.7, 0.7]}
    frequency, ids, bases = terms.terms_frequency(df, ["t"], "id", lambda words: [vectors[w] for w in words], 2)
    assert [tuple(r) for r in frequency.collect()] == [("azul", 2, 2), ("casa", 2, 1), ("casas", 1, 1), ("verde", 1, 1)]
    assert {r["termo"]: r["base"] for r in bases.collect()} == {"azul": "azul", "casa": "casa", "casas": "casa", "verde": "verde"}
    assert {r["termo"]: r["ids"] for r in ids.select("termo", postings.ids_of(ids).alias("ids")).collect()}["azul"] == [1, 2]
    unique = df.where("t is not null")
    assert [tuple(r) for r in terms.term_frequency(unique, ["t"], "id").collect()] == [tuple(r) for r in terms.term_frequency(unique, ["t"], "id", unique=False).collect()]


def test_exact_counts_of_many_columns(spark):
    """Keys, near keys, repeated values, nulls, numbers and texts; equal hashes of different values stay apart."""
    rows = [(i, f"k{i}" if i != 77 else "k3", i % 600, float(i) if i % 9 else None, "é" * (i % 3), bytes([i % 256]), i % 2 == 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "a long, `b c` string, d int, e double, f string, g binary, h boolean").repartition(5)
    want = {c: len({r[i] for r in rows} - {None}) for i, c in enumerate(df.columns)}
    assert predicates.exact_counts(df, df.columns) == want
    assert predicates.distinct_counts(df, df.columns, exact=True) == want
    assert predicates.exact_counts(spark.createDataFrame([(0.0,), (-0.0,), (1.5,), (1.5,)], "a double"), ["a"]) == {"a": 2}
    assert predicates.exact_counts(df, []) == {} and predicates.exact_counts(df.limit(0), ["a", "f"]) == {"a": 0, "f": 0}


def test_clashing_hashes(spark, monkeypatch):
    monkeypatch.setattr(predicates.F, "xxhash64", lambda c: F.lit(7).cast("long"))
    df = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "a string").coalesce(1)
    assert predicates.exact_counts(df, ["a"]) == {"a": 2} and predicates.exact_counts(df, ["a"], whole=False)["a"] < 3
    assert predicates.exact_counts(spark.createDataFrame([("x",), ("y",)], "a string"), ["a"], whole=False) == {"a": 2}
