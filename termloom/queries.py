"""The registered queries of the profiling engine, each beside the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dates import to_date
from .functions.encodings import detect_encodings
from .functions.similarity import indel_ratio
from .functions.text import CYRILLIC, FINALS, GREEK, INITIALS, VOWELS, format_cep, normalize_generic, slugify, tokens, unaccent
from .operators import aggregates, charts, cleaning, clustering, predicates, terms
from .operators.dictionary import VOCABULARY, column_types, dictionary
from .operators.postings import counted, ids_text, postings
from .operators.vectors import row_pairs
from .plans.checkpoints import shared_dir
from .plans.profile import clusters_of, long_report, profile
from .sources import readers, sinks
from .streaming.ingest import latest, publish, read_files, running_counts

# The columns of the tables.
COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal", "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props", "documents": "doc_id text lang source n_chars", "embeddings": "vec_id embedding label", "pages": "page_id url html",
    "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(spark: SparkSession) -> str:
    """A new folder where executors and driver can both write."""
    return f"{shared_dir(spark)}/termloom-{uuid.uuid4().hex[:12]}"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def sql_clean(x: str) -> str:
    return f"strip_accents(replace(lower(trim({x})), 'ß', 'ss'))"


def sql_norm(x: str) -> str:
    return f"regexp_replace({sql_clean(x)}, '[^\\w\\s-]', '', 'g')"


def sql_fold(x: str) -> str:
    return f"trim(lower(replace(replace(strip_accents({x}), 'º', 'o'), 'ß', 'ss')))"


def sql_tokens(x: str, custom: tuple[str, ...] = ()) -> str:
    from .functions.text import STOP_WORDS

    words = ", ".join(f"'{w}'" for w in [*STOP_WORDS, *custom])
    return f"list_filter(regexp_split_to_array({sql_clean(x)}, '\\s+'), lambda w: length(w) > 1 AND NOT list_contains([{words}], w))"


# ---- text


@query(f"SELECT p_partkey, {sql_norm('p_brand')} AS brand, {sql_norm('p_name')} AS name FROM part")
def norm_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", normalize_generic(F.col("p_brand")).alias("brand"), normalize_generic(F.col("p_name")).alias("name"))


@query(f"SELECT doc_id, array_to_string({sql_tokens('text')}, ' ') AS words FROM documents")
def clean_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tokens(F.col("text")), " ").alias("words"))


@query("SELECT page_id, coalesce(nullif(lower(regexp_replace(regexp_replace(regexp_replace(url, '[^\\w\\s-]', '', 'g'), '[-\\s]+', '_', 'g'), '^_+|_+$', '', 'g')), ''), 'coluna') AS slug FROM pages")
def slugify_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", slugify(F.col("url")).alias("slug"))


@query("SELECT o_orderkey, CASE WHEN length(d) < 8 THEN lpad(d, 8, '0') ELSE d END AS cep FROM (SELECT o_orderkey, regexp_replace(replace(replace((1000000 + o_orderkey)::varchar || '.0', '.0', ''), ',', ''), '\\D', '', 'g') AS d FROM orders)")
def cep_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat((F.col("o_orderkey") + 1000000).cast("string"), F.lit(".0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", format_cep(text).alias("cep"))


LATIN = "abcdefghijklmnopqrstuvwxyz"


def sql_letters(alphabet: str) -> str:
    """Each Latin letter as the letter of the other alphabet at its place is written in Latin, one by one."""
    words = alphabet.split()
    table = dict(zip(LATIN, words[1::2], strict=False))
    pairs = ", ".join(f"'{a}': '{b}'" for a, b in table.items())
    return f"array_to_string(list_transform(string_split(lower(strip_accents(replace(url, 'ß', 'ss'))), ''), lambda c: coalesce(MAP {{{pairs}}}[c], c)), '')"


def sql_syllable(n: str) -> str:
    """A Hangul syllable by its number."""
    names = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    return f"{names(INITIALS)}[1 + {n} // 588] || {names(VOWELS)}[1 + {n} % 588 // 28] || {names(FINALS)}[1 + {n} % 28]"


@query(f"SELECT page_id, {sql_letters(CYRILLIC)} AS cyrillic, {sql_letters(GREEK)} AS greek, {sql_syllable('(page_id % 11172)')} AS hangul FROM pages")
def fold_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses written in Cyrillic and in Greek letters, and their numbers as Hangul syllables, all folded to Latin."""
    pages = table(spark, sf_dir, "pages")
    plain = F.lower(unaccent(F.col("url")))
    other = lambda alphabet: F.translate(plain, LATIN[: len(alphabet.split()) // 2], "".join(alphabet.split()[::2])[:26])
    code = F.col("page_id") % 11172 + 0xAC00
    syllable = F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
    return pages.select("page_id", unaccent(other(CYRILLIC)).alias("cyrillic"), unaccent(other(GREEK)).alias("greek"), unaccent(syllable).alias("hangul"))


CEP_SQL = "SELECT '{c}' AS coluna, count(*) AS n, count(*) FILTER (regexp_full_match(v, '\\d{{7,8}}(\\.0)?')) AS hits, count(*) FILTER (regexp_full_match(v, '\\d{{7,8}}(\\.0)?')) >= 0.8 * count(*) AS is_cep FROM (SELECT {e}::varchar AS v FROM orders ORDER BY o_orderkey LIMIT 100)"


@query(union([CEP_SQL.format(c=c, e=e) for c, e in (("o_orderkey", "o_orderkey"), ("o_custkey", "o_custkey"), ("cep", "(1000000 + o_orderkey)"))]))
def cep_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") + 1000000).alias("cep"))
    return cleaning.cep_columns(df, "o_orderkey")


@query("""SELECT doc_id, CASE WHEN a >= greatest(b, c, d, e) THEN ',' WHEN b >= greatest(c, d, e) THEN ';' WHEN c >= greatest(d, e) THEN chr(9) WHEN d >= e THEN '|' ELSE ':' END AS delimiter
FROM (SELECT doc_id, length(s) - length(replace(s, ',', '')) AS a, length(s) - length(replace(s, ';', '')) AS b, length(s) - length(replace(s, chr(9), '')) AS c, length(s) - length(replace(s, '|', '')) AS d, length(s) - length(replace(s, ':', '')) AS e FROM (SELECT doc_id, substr(text, 1, 4096) AS s FROM documents))""")
def delimiter_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", readers.delimiter_of(F.col("text")).alias("delimiter"))


#: Encodings a text is written in: the bytes in front, Python's name, the name to be found.
WRITTEN = {"utf8": (b"", "utf-8", "UTF-8"), "utf8_mark": (b"\xef\xbb\xbf", "utf-8", "UTF-8"), "utf16le": (b"", "utf-16-le", "UTF-16LE"), "utf16be": (b"", "utf-16-be", "UTF-16BE"), "utf16le_mark": (b"\xff\xfe", "utf-16-le", "UTF-16LE"), "utf16be_mark": (b"\xfe\xff", "utf-16-be", "UTF-16BE"), "latin1": (b"", "latin-1", "ISO-8859-1"), "dos850": (b"", "cp850", "IBM850")}


@query(union([f"SELECT doc_id, '{w}' AS written, CASE WHEN false THEN '' {'' if mark else "WHEN text = '' THEN 'UTF-8' "}{'' if mark or 'utf16' in w else "WHEN NOT regexp_matches(text, '[^\x00-\x7F]') THEN 'US-ASCII' "}ELSE '{name}' END AS encoding FROM documents WHERE text IS NOT NULL" for w, (mark, _, name) in WRITTEN.items()]))
def encoding_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text written in eight encodings, and which one its bytes show."""

    def write(batches):
        for batch in batches:
            for row in batch.to_pylist():
                made = [(row["doc_id"], w, mark + row["text"].encode(code, "ignore")) for w, (mark, code, _) in WRITTEN.items()]
                yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate((pa.int64(), pa.string(), pa.binary()))], ["doc_id", "written", "head"])

    texts = table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null").mapInArrow(write, "doc_id long, written string, head binary")
    return detect_encodings(texts, "head").drop("head")


# ---- shaping


@query("SELECT a, b FROM (SELECT nullif(o_orderstatus, 'F') AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS b FROM orders) WHERE NOT (a IS NULL AND b IS NULL)")
def not_null_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.drop_null_rows(table(spark, sf_dir, "orders").select(F.expr("nullif(o_orderstatus, 'F')").alias("a"), F.expr("case when o_orderkey % 3 = 0 then o_totalprice end").alias("b")))


@query("SELECT 'empty' AS coluna WHERE (SELECT count(CASE WHEN n_nationkey < 0 THEN n_name END) FROM nation) = 0")
def all_null_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation").withColumn("empty", F.expr("case when n_nationkey < 0 then n_name end"))
    return spark.createDataFrame([(c,) for c in cleaning.null_columns(df)], "coluna string")


@query("SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey)::varchar AS _id FROM nation")
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.number_rows(table(spark, sf_dir, "nation"), ["n_nationkey"]).select("n_nationkey", "_id")


@query("SELECT c_custkey, 36 AS id_length FROM customer")
def ensure_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.ensure_id(table(spark, sf_dir, "customer")).select("c_custkey", F.length("id").alias("id_length"))


# ---- predicates and statistics


def sql_id(t: str, c: str) -> str:
    return f"SELECT '{t}' AS tabela, '{c}' AS coluna, count(*) - count({c}) <= 1 AND count(DISTINCT {c}) + count(*) - count({c}) = count(*) AS is_id FROM {t}"


@query(union([sql_id(t, c) for t in ("customer", "part", "nation") for c in COLUMNS[t].split()]))
def id_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [predicates.column_stats(table(spark, sf_dir, t)).select(F.lit(t).alias("tabela"), "coluna", "is_id") for t in ("customer", "part", "nation")]
    return parts[0].union(parts[1]).union(parts[2])


def sql_categorical(t: str, c: str) -> str:
    return f"SELECT '{t}' AS tabela, '{c}' AS coluna, count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) < least(30, count(*) // 5) AS is_categorical FROM {t}"


FLAGS = {"lineitem": ["l_linenumber", *NUMBERS], "labels": ["quality", "toxic"], "part": ["p_size", "p_retailprice"]}


@query(union([sql_categorical(t, c) for t, cs in FLAGS.items() for c in cs]))
def categorical_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [predicates.column_stats(table(spark, sf_dir, t).select(*cs)).select(F.lit(t).alias("tabela"), "coluna", "n_distinct", "is_categorical") for t, cs in FLAGS.items()]
    return parts[0].union(parts[1]).union(parts[2])


WORDS_OF = ["SELECT p_name FROM part", "SELECT event_type FROM events", "SELECT source FROM documents", "SELECT unnest(string_split(text, ' ')) FROM conversations"]
NAMES_SQL = "SELECT DISTINCT coluna FROM (" + " UNION ALL ".join([f"SELECT column_name AS coluna FROM (DESCRIBE {t})" for t in COLUMNS] + [f"SELECT * FROM ({w}) t(coluna)" for w in WORDS_OF]) + ") WHERE coluna IS NOT NULL"


def all_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(coluna): the columns of every table, and names that rows hold: products, events, sources, words of conversations."""
    schemas = spark.createDataFrame([(c,) for t in COLUMNS for c in table(spark, sf_dir, t).columns], "coluna string")
    held = [table(spark, sf_dir, t).select(F.col(c).alias("coluna")) for t, c in (("part", "p_name"), ("events", "event_type"), ("documents", "source"))]
    words = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", " ")).alias("coluna"))
    return reduce(DataFrame.union, [schemas, *held, words]).where("coluna is not null").distinct()


@query(f"SELECT coluna, contains(n, 'data') OR contains(n, 'date') OR contains(n, 'day') OR contains(n, 'dia') AS is_date FROM (SELECT coluna, {sql_fold('coluna')} AS n FROM ({NAMES_SQL}))")
def date_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_names(spark, sf_dir).withColumn("is_date", predicates.date_name(F.col("coluna")))


@query(union([f"SELECT '{c}' AS coluna, strftime(min({c}), '%Y-%m-%d %H:%M:%S') AS min, strftime(max({c}), '%Y-%m-%d %H:%M:%S') AS max FROM {t}" for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"))]))
def date_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.date_stats(table(spark, sf_dir, "orders"), ["o_orderdate"], "o_orderkey").union(aggregates.date_stats(table(spark, sf_dir, "lineitem"), ["l_shipdate"], "l_orderkey"))


@query("SELECT 'd' AS coluna, strftime(min(d), '%Y-%m-%d %H:%M:%S') AS min, strftime(max(d), '%Y-%m-%d %H:%M:%S') AS max FROM (SELECT o_orderdate::date AS d FROM orders)")
def date_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return aggregates.date_stats(df, ["d"], "o_orderkey")


#: A spelling in Spark's letters and in DuckDB's.
SPELLINGS = {"M/d/yyyy": "%-m/%-d/%Y", "dd/MM/yyyy": "%d/%m/%Y", "dd.MM.yyyy HH:mm": "%d.%m.%Y %H:%M", "yyyyMMdd": "%Y%m%d", "d MMM yyyy": "%-d %b %Y", "MMMM d, yyyy": "%B %-d, %Y", "yyyy-MMM-dd": "%Y-%b-%d", "MM/dd/yy": "%m/%d/%y"}


def sql_spelled(how: str, duck: str) -> str:
    """The first value decides: days up to 12 in front are months, May is a whole name, two-digit years tell nothing."""
    read, ok = "o_orderdate", "true"
    if how.startswith("dd"):
        read = f"CASE WHEN day(first) > 12 THEN o_orderdate ELSE try_strptime(strftime(o_orderdate, '{duck}'), '{duck.replace('%d', '#').replace('%m', '%d').replace('#', '%m')}') END"
    elif "MMM" in how and "MMMM" not in how:
        ok = "month(first) <> 5 OR month(o_orderdate) = 5"
    return f"SELECT '{how}' AS spelling, o_orderkey, CASE WHEN {ok} THEN ({read})::date END AS d FROM orders, (SELECT arg_min(o_orderdate, o_orderkey) AS first FROM orders)"


@query(union([sql_spelled(*x) for x in SPELLINGS.items()]))
def date_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in eight ways, each column read back by what its first value shows."""
    orders, parts = table(spark, sf_dir, "orders"), []
    for how in SPELLINGS:
        text = orders.select("o_orderkey", F.date_format("o_orderdate", how).alias("t"))
        read = to_date(F.col("t"), False, first=predicates.first_value(text, "t", "o_orderkey"))
        parts.append(text.select(F.lit(how).alias("spelling"), "o_orderkey", read.cast("date").alias("d")))
    return reduce(DataFrame.union, parts)


@query(union([f"SELECT '{c}' AS coluna, min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS media FROM lineitem" for c in NUMBERS]))
def numeric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.numeric_stats(table(spark, sf_dir, "lineitem"), NUMBERS).withColumn("media", F.round("media", 4))


@query(union([f"SELECT '{c}' AS coluna, {c} AS v, count(*) AS n FROM {t} GROUP BY {c}" for t, c in (("orders", "o_orderpriority"), ("events", "event_type"))]))
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = aggregates.long_values(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderkey", "o_orderkey")
    more = aggregates.long_values(table(spark, sf_dir, "events"), ["event_type"], "event_id", "event_id")
    return aggregates.value_counts(values.union(more)).select("coluna", "v", "n")


TOP_SQL = "SELECT '{c}' AS coluna, v, n FROM (SELECT {c} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min({k}), {c}) AS rn, count(*) OVER () AS m FROM {t} GROUP BY {c}) WHERE m <= 200 OR rn <= 100"


@query(union([TOP_SQL.format(c=c, k=k, t=t) for t, c, k in (("customer", "c_name", "c_custkey"), ("part", "p_name", "p_partkey"))]))
def topk_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = aggregates.long_values(table(spark, sf_dir, "customer"), ["c_name"], "c_custkey", "c_custkey")
    more = aggregates.long_values(table(spark, sf_dir, "part"), ["p_name"], "p_partkey", "p_partkey")
    return aggregates.value_counts(aggregates.top_values(values.union(more))).select("coluna", "v", "n")


@query(f"SELECT norm, array_to_string(list_sort(list_distinct(list(trim(p_brand)))), '; ') AS originais, count(DISTINCT p_partkey) AS n_ids FROM (SELECT *, {sql_norm('p_brand')} AS norm FROM part) GROUP BY norm")
def norm_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = aggregates.long_values(table(spark, sf_dir, "part"), ["p_brand"], "p_partkey", "p_partkey")
    ids = counted(postings(aggregates.normalised(values).select("norm", "id"), ["norm"]), ["norm"], "n_ids")
    return aggregates.norm_groups(values).join(ids, "norm").select("norm", F.array_join("originais", "; ").alias("originais"), "n_ids")


def sql_terms() -> str:
    """The vocabulary as SQL reads it: the data file itself, not what the query makes of it."""
    return f"""WITH d AS (SELECT prio::int AS prio, tipo, syn_prio::int AS syn_prio, {sql_fold('synonym')} AS syn FROM read_csv('{VOCABULARY}', header = true, all_varchar = true)),
n AS (SELECT coluna, {sql_fold('coluna')} AS name FROM ({NAMES_SQL}))
SELECT n.coluna, arg_min(d.tipo, d.prio * 1000 + d.syn_prio) AS tipo FROM n LEFT JOIN d ON starts_with(n.name, d.syn) GROUP BY n.coluna"""


@query(sql_terms())
def column_type_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_types(all_names(spark, sf_dir), dictionary(spark))


# ---- fuzzy clustering

def sql_lcs(a: str, b: str) -> str:
    return f"""list_last(list_reduce(string_split({a}, ''), lambda prev, ch: list_reduce(range(1, length({b}) + 1), lambda acc, j: list_append(acc, CASE WHEN ch = substr({b}, j::int, 1) THEN prev[j] + 1 ELSE greatest(prev[j + 1], acc[j]) END), [0::bigint]), list_transform(range(length({b}) + 1), lambda x: 0::bigint)))"""


SQL_LCS = sql_lcs("a.n", "b.n")


def sql_clusters(t: str, v: str, k: str) -> str:
    return f"""src AS (SELECT {v} AS v, {k} AS id FROM {t} WHERE {v} IS NOT NULL),
m AS (SELECT n, list_sort(list_distinct(list(o))) AS os, list_distinct(list(id::varchar)) AS ids, row_number() OVER (ORDER BY min(id), n) - 1 AS pos FROM (SELECT {sql_norm('v')} AS n, trim(v) AS o, id FROM src) GROUP BY n),
nb AS (SELECT a.pos, list(b.pos ORDER BY b.pos) AS nb FROM m a JOIN m b ON b.pos < a.pos AND 100 * levenshtein(a.n, b.n) <= 12 * (length(a.n) + length(b.n)) AND 200 * {SQL_LCS} >= 88 * (length(a.n) + length(b.n)) GROUP BY a.pos),
x AS (SELECT m.*, coalesce(nb.nb, []::bigint[]) AS nb FROM m LEFT JOIN nb USING (pos)),
rec(pos, ld) AS (SELECT -1::bigint, []::bigint[] UNION ALL SELECT rec.pos + 1, CASE WHEN list_has_any(ld, nb) THEN ld ELSE list_append(ld, x.pos) END FROM rec JOIN x ON x.pos = rec.pos + 1),
fin AS (SELECT ld FROM rec ORDER BY pos DESC LIMIT 1),
asg AS (SELECT x.*, coalesce(list_min(list_intersect(ld, nb)), pos) AS leader FROM x, fin),
tab AS (SELECT '{v}' AS coluna, upper(arg_max(n, length(n) * 100000 - pos)) AS termo_base, array_to_string(list_sort(list_distinct(flatten(list(os)))), '; ') AS variantes, len(list_distinct(flatten(list(ids)))) AS frequencia, array_to_string(list_sort(list_distinct(flatten(list(ids)))), ',') AS ids FROM asg GROUP BY leader)"""


P_NAME = f"WITH RECURSIVE {sql_clusters('part', 'p_name', 'p_partkey')}\n"


def part_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.with_ids(*clusters_of(table(spark, sf_dir, "part"), ["p_name"], "p_partkey", "p_partkey"))


@query(P_NAME + "SELECT * FROM tab")
def cluster_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_clusters(spark, sf_dir)


def clusters_sql(t: str, v: str, k: str) -> str:
    return f"WITH RECURSIVE {sql_clusters(t, v, k)}\nSELECT a.n AS norm, l.n AS leader_norm FROM asg a JOIN asg l ON a.leader = l.pos"


def named_clusters(df: DataFrame, column: str, key: str) -> DataFrame:
    groups = aggregates.norm_groups(aggregates.top_values(aggregates.long_values(df, [column], key, key)))
    found = clustering.fuzzy_clusters(groups)
    leaders = found.where("pos = leader").select("coluna", "leader", F.col("norm").alias("leader_norm"))
    return found.join(leaders, ["coluna", "leader"]).select("norm", "leader_norm")


@query(clusters_sql("nation", "n_name", "n_nationkey"))
def fuzzy_clusters_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_clusters(table(spark, sf_dir, "nation"), "n_name", "n_nationkey")


@query(clusters_sql("part", "p_brand", "p_partkey"))
def fuzzy_clusters_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_clusters(table(spark, sf_dir, "part"), "p_brand", "p_partkey")


@query(f"SELECT {sql_norm('c_name')} AS norm, true AS leads FROM customer GROUP BY 1, 2")
def fuzzy_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the cut to the commonest values a column has more terms than are clustered: each leads itself."""
    groups = aggregates.norm_groups(aggregates.long_values(table(spark, sf_dir, "customer"), ["c_name"], "c_custkey", "c_custkey"))
    return clustering.fuzzy_clusters(groups, max_terms=50).select("norm", (F.col("leader") == F.col("pos")).alias("leads"))


def sql_all_clusters(t: str, v: str, k: str) -> str:
    """Leader clustering of all of a column's terms, one after the other: each is held against the leaders so far."""
    fits = f"100 * levenshtein(l.n, x.n) <= 12 * (length(l.n) + length(x.n)) AND 200 * {sql_lcs('l.n', 'x.n')} >= 88 * (length(l.n) + length(x.n))"
    return f"""SELECT * FROM (WITH RECURSIVE x AS MATERIALIZED (SELECT n, row_number() OVER (ORDER BY min(id), n) - 1 AS pos FROM (SELECT {sql_norm(v)} AS n, {k} AS id FROM {t} WHERE {v} IS NOT NULL) GROUP BY n),
rec(pos, leader, ld) AS (SELECT -1::bigint, -1::bigint, []::STRUCT(pos bigint, n varchar)[] UNION ALL
  SELECT pos, coalesce(hit, pos), CASE WHEN hit IS NULL THEN list_append(ld, {{'pos': pos, 'n': n}}) ELSE ld END FROM (SELECT x.pos, x.n, ld, list_min(list_transform(list_filter(ld, lambda l: {fits}), lambda l: l.pos)) AS hit FROM rec JOIN x ON x.pos = rec.pos + 1))
SELECT '{v}' AS coluna, x.n AS norm, h.n AS leader_norm FROM rec JOIN x USING (pos) JOIN x h ON h.pos = rec.leader)"""


ALL_TERMS = [("customer", "c_name", "c_custkey"), ("part", "p_name", "p_partkey"), ("pages", "url", "page_id")]


@query(union([sql_all_clusters(*x) for x in ALL_TERMS]))
def fuzzy_clusters_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms of three columns, without the cut to the commonest values and without a limit on their number."""
    parts = [aggregates.normalised(aggregates.long_values(table(spark, sf_dir, t), [c], k, k)) for t, c, k in ALL_TERMS]
    found = clustering.fuzzy_clusters(reduce(DataFrame.union, parts).groupBy("coluna", "norm").agg(F.min("_pos").alias("pos")), max_terms=None)
    leaders = found.where("pos = leader").select("coluna", "leader", F.col("norm").alias("leader_norm"))
    return found.join(leaders, ["coluna", "leader"]).select("coluna", "norm", "leader_norm")


@query(f"WITH m AS (SELECT n_nationkey AS k, {sql_norm('n_name')} AS n FROM nation) SELECT a.k AS a_key, b.k AS b_key, round(200.0 * {SQL_LCS} / (length(a.n) + length(b.n)), 6) AS ratio FROM m a JOIN m b ON a.k < b.k")
def indel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.lit("n_name").alias("coluna"), "n_nationkey", normalize_generic(F.col("n_name")).alias("n"))
    a, b = n.select("coluna", F.col("n_nationkey").alias("a_key"), F.col("n").alias("a")), n.select("coluna", F.col("n_nationkey").alias("b_key"), F.col("n").alias("b"))
    return a.join(b, "coluna").where("a_key < b_key").select("a_key", "b_key", F.round(indel_ratio("a", "b"), 6).alias("ratio"))


# ---- profile

ORDERS_SQL = union(
    [f"SELECT '{c}' AS coluna, 'desconhecido' AS tipo, 'number' AS kind, item, printf('%.4f', x) AS value FROM (SELECT min({c})::double AS lo, max({c})::double AS hi, avg({c})::double AS m FROM orders), LATERAL (VALUES ('min', lo), ('max', hi), ('media', m)) t(item, x)" for c in ("o_custkey", "o_totalprice")]
    + ["SELECT 'o_orderdate' AS coluna, 'desconhecido' AS tipo, 'date' AS kind, item, strftime(x, '%Y-%m-%d %H:%M:%S') AS value FROM (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders), LATERAL (VALUES ('min', lo), ('max', hi)) t(item, x)"]
    + [f"SELECT '{c}' AS coluna, 'desconhecido' AS tipo, 'terms' AS kind, upper({c}) AS item, {c} || '|' || count(*) AS value FROM orders GROUP BY {c}" for c in ("o_orderstatus", "o_orderpriority")]
)


@query(ORDERS_SQL)
def profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_report(profile(table(spark, sf_dir, "orders"), ids=False), spark)


@query("SELECT 'p_partkey' AS id_coluna, count(*) AS total_linhas, 6 AS total_colunas FROM part")
def report_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([profile(table(spark, sf_dir, "part")).header()], "id_coluna string, total_linhas long, total_colunas int")


def sql_terms_profile(t: str, c: str, v: str, k: str) -> str:
    """A column's clusters in a profile: its values, or the 100 commonest of more than 200, then the clusters of these."""
    top = f"SELECT v FROM (SELECT v, row_number() OVER (ORDER BY count(*) DESC, min(id), v) AS rn, count(*) OVER () AS m FROM (SELECT {v} AS v, {k} AS id FROM {t}) WHERE v IS NOT NULL GROUP BY v) WHERE m <= 200 OR rn <= 100"
    inner = sql_clusters(f"(SELECT {v} AS v0, {k} AS id0 FROM {t} WHERE {v} IN ({top}))", "v0", "id0")
    return f"SELECT '{c}' AS coluna, 'terms' AS kind, item, value FROM (WITH RECURSIVE {inner}\nSELECT termo_base AS item, variantes || '|' || frequencia AS value FROM tab)"


def sql_profile(t: str, k: str, dates: list[str], numbers: list[str], words: dict[str, str], types: dict[str, str]) -> str:
    """A whole profile. A number with few distinct values is profiled by its terms, which ``words`` then has too."""
    few = lambda c: f"(SELECT count(DISTINCT {c}) < least(30, count(*) // 5) FROM {t})"
    span = [f"SELECT '{c}' AS coluna, 'date' AS kind, item, strftime(x, '%Y-%m-%d %H:%M:%S') AS value FROM (SELECT min({c}) AS lo, max({c}) AS hi FROM {t}), LATERAL (VALUES ('min', lo), ('max', hi)) t(item, x)" for c in dates]
    stats = [f"SELECT '{c}' AS coluna, 'number' AS kind, item, printf('%.4f', round(x, 4)) AS value FROM (SELECT min({c})::double AS lo, max({c})::double AS hi, avg({c})::double AS m FROM {t}), LATERAL (VALUES ('min', lo), ('max', hi), ('media', m)) t(item, x) WHERE NOT {few(c)}" for c in numbers]
    tipo = "CASE coluna " + " ".join(f"WHEN '{c}' THEN '{x}'" for c, x in types.items()) + " ELSE 'desconhecido' END"
    return f"SELECT coluna, {tipo} AS tipo, kind, item, value FROM ({union([*span, *stats, *(sql_terms_profile(t, c, v, k) + (f" WHERE {few(c)}" if c in numbers else "") for c, v in words.items())])})"


@query(sql_profile("events", "event_id", [], ["user_id", "value"], {"ts": "replace(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '.000000', '')", "event_type": "event_type", "props": "props", "user_id": "user_id::varchar"}, {"value": "preco", "user_id": "usuario"}))
def profile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_report(profile(table(spark, sf_dir, "events"), ids=False), spark)


WORDS = {"l_suppkey": "l_suppkey::varchar", "l_linenumber": "l_linenumber::varchar", "l_discount": "l_discount::varchar", "l_tax": "l_tax::varchar", "l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus"}


@query(sql_profile("lineitem", "(l_orderkey * 8 + l_linenumber)", ["l_shipdate"], ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"], WORDS, {"l_shipdate": "desconhecido"}))
def profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumn("_line", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return long_report(profile(df, order="_line", key="_line", ids=False), spark)


# ---- terms


def sql_frequency(t: str, key: str, custom: tuple[str, ...] = (), text: str = "text") -> str:
    return f"SELECT termo, count(*) AS frequencia, count(DISTINCT id) AS ids_unicos FROM (SELECT {key} AS id, unnest({sql_tokens(text, custom)}) AS termo FROM {t}) GROUP BY termo"


@query(sql_frequency("documents", "doc_id"))
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_frequency(table(spark, sf_dir, "documents"), ["text"], "doc_id")


@query(sql_frequency("conversations", "conv_id", ("the", "of", "and")))
def term_frequency_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_frequency(table(spark, sf_dir, "conversations"), ["text"], "conv_id", ["the", "of", "and"])


@query(f"SELECT termo, array_to_string(list_sort(list_distinct(list(id))), ',') AS ids FROM (SELECT conv_id AS id, unnest({sql_tokens('text')}) AS termo FROM conversations) GROUP BY termo")
def term_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids_text(terms.term_ids(table(spark, sf_dir, "conversations"), ["text"], "conv_id"), ["termo"])


def letters(words: list[str]) -> list[list[int]]:
    """A stand-in for a language model: how often a word has each letter."""
    return [[w.count(chr(97 + i)) for i in range(26)] for w in words]


def sql_bases(t: str, key: str, text: str) -> str:
    like = "list_cosine_similarity(a.v, b.v) >= 0.905"
    return f"""WITH RECURSIVE f AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY frequencia DESC, termo) - 1 AS pos, list_transform(range(26), lambda i: (length(termo) - length(replace(termo, chr((97 + i)::int), '')))::double) AS v FROM ({sql_frequency(t, key, text=text)})),
nb AS MATERIALIZED (SELECT a.pos, list(b.pos) AS nb FROM f a JOIN f b ON b.pos < a.pos AND list_sum(a.v) > 0 AND list_sum(b.v) > 0 WHERE {like} GROUP BY a.pos),
x AS MATERIALIZED (SELECT f.pos, coalesce(nb.nb, []::bigint[]) AS nb FROM f LEFT JOIN nb USING (pos)),
rec(pos, ld, lead) AS (SELECT -1::bigint, []::bigint[], -1::bigint UNION ALL SELECT pos, CASE WHEN hit IS NULL THEN list_append(ld, pos) ELSE ld END, coalesce(hit, pos) FROM (SELECT x.pos, ld, list_min(list_intersect(ld, nb)) AS hit FROM rec JOIN x ON x.pos = rec.pos + 1))
SELECT f.termo, f.frequencia, f.ids_unicos, b.termo AS base FROM rec JOIN f USING (pos) JOIN f b ON b.pos = rec.lead"""


@query(sql_bases("pages", "page_id", "url"))
def terms_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of addresses and the first one, in order of frequency, that each is like (no two counts of letters have just this cosine)."""
    frequency, _, bases = terms.terms_frequency(table(spark, sf_dir, "pages"), ["url"], "page_id", letters, 26, 0.905)
    return frequency.join(bases, "termo")


SQL_COSINE = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("v"))


@query(f"SELECT a.vec_id AS pos, b.vec_id AS earlier, round({SQL_COSINE}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id WHERE {SQL_COSINE} >= 0.3")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_pairs(vectors(spark, sf_dir), 0.3).withColumn("cosine", F.round("cosine", 6))


def sql_leaders(threshold: float) -> str:
    return f"""WITH RECURSIVE m AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, embedding FROM embeddings),
nb AS (SELECT a.pos, list(b.pos) AS nb FROM m a JOIN m b ON b.pos < a.pos AND {SQL_COSINE} >= {threshold} GROUP BY a.pos),
x AS (SELECT m.vec_id, m.pos, coalesce(nb.nb, []::bigint[]) AS nb FROM m LEFT JOIN nb USING (pos)),
rec(pos, ld) AS (SELECT -1::bigint, []::bigint[] UNION ALL SELECT rec.pos + 1, CASE WHEN list_has_any(ld, nb) THEN ld ELSE list_append(ld, x.pos) END FROM rec JOIN x ON x.pos = rec.pos + 1),
fin AS (SELECT ld FROM rec ORDER BY pos DESC LIMIT 1)
SELECT x.vec_id AS pos, l.vec_id AS leader FROM (SELECT x.*, coalesce(list_min(list_intersect(ld, nb)), pos) AS lead FROM x, fin) x JOIN m l ON x.lead = l.pos"""


@query(sql_leaders(0.8))
def embedding_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.embedding_clusters(vectors(spark, sf_dir), 0.8)


@query(sql_leaders(0.35))
def embedding_clusters_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.embedding_clusters(vectors(spark, sf_dir), 0.35)


# ---- charts

#: Where a row stands in its table.
PLACE = ["_metadata.file_path", "_metadata.row_index"]


@query(P_NAME + "SELECT termo_base AS label, frequencia FROM tab ORDER BY frequencia DESC, termo_base LIMIT 8")
def bar_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.bar(part_clusters(spark, sf_dir), [F.desc("frequencia"), F.asc("termo_base")])


@query(P_NAME + "SELECT termo_base AS label, sum(frequencia)::bigint AS value FROM tab GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def pie_sum_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.pie_sum(part_clusters(spark, sf_dir), "termo_base")


@query("SELECT label, round(value, 4) AS value FROM (SELECT p_brand AS label, avg(p_retailprice) AS value FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)")
def pie_mean_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.pie_mean(table(spark, sf_dir, "part"), "p_brand", "p_retailprice").withColumn("value", F.round("value", 4))


@query("SELECT l_returnflag AS label, l_extendedprice AS value FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 8")
def line_head8(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_returnflag", "l_orderkey", "l_linenumber", *PLACE)
    return charts.line(df, "l_returnflag", "l_extendedprice", ["l_orderkey", "l_linenumber"], ["file_path", "row_index"])


@query("SELECT l_returnflag AS label, l_quantity AS x, l_extendedprice AS y FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 30")
def scatter_head30(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag", "l_orderkey", "l_linenumber", *PLACE)
    return charts.scatter(df, "l_returnflag", ["l_orderkey", "l_linenumber"], ["file_path", "row_index"])


@query("SELECT l_returnflag AS label, min(l_quantity) AS lo, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS hi FROM lineitem GROUP BY 1")
def box_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.quartiles(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")


@query("SELECT lang AS label, min(n_chars)::double AS lo, quantile_cont(n_chars::double, 0.25) AS q1, quantile_cont(n_chars::double, 0.5) AS median, quantile_cont(n_chars::double, 0.75) AS q3, max(n_chars)::double AS hi FROM documents GROUP BY 1")
def length_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of texts by language: many different values in few groups."""
    return aggregates.quartiles(table(spark, sf_dir, "documents"), "lang", "n_chars")


@query(P_NAME + "SELECT greatest(count(*) - 8, 0) AS more FROM tab")
def remainder_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.remainder(part_clusters(spark, sf_dir))


# ---- input, output, streams


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS coluna, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id END AS frequencia FROM events")
def json_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posted groups, one in seven cut off in the middle: what cannot be decoded is null."""
    row = F.struct(F.col("event_type").alias("termo_base"), F.col("props").alias("variantes"), F.col("event_id").alias("frequencia"), F.lit("").alias("ids"))
    body = F.to_json(F.struct(F.col("event_type").alias("coluna"), F.array(row).alias("tabela")))
    sent = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit("{")).otherwise(body).alias("body"))
    return sent.select("event_id", readers.ingest(F.col("body")).alias("g")).select("event_id", F.col("g.coluna").alias("coluna"), F.get(F.col("g.tabela"), F.lit(0))["frequencia"].alias("frequencia"))


@query("SELECT event_id, event_id % 6 < 4 AS refused, CASE WHEN event_id % 6 >= 4 THEN event_type END AS coluna FROM events")
def json_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posted bodies, four in six empty in one way or another or cut off: these are marked refused."""
    body = F.to_json(F.struct(F.col("event_type").alias("coluna"), F.array().cast(readers.TABLE).alias("tabela")))
    bodies = F.array(F.lit(None).cast("string"), F.lit(" {\n} "), F.lit(""), F.lit('{"coluna": "x"'), body, body)
    sent = table(spark, sf_dir, "events").select("event_id", "event_type", readers.received(F.get(bodies, (F.col("event_id") % 6).cast("int"))).alias("r"))
    return sent.select("event_id", "r.refused", F.col("r.report.coluna").alias("coluna"))


@query(P_NAME + "SELECT coluna, to_json(list({'termo_base': termo_base, 'variantes': variantes, 'frequencia': frequencia, 'ids': ids} ORDER BY frequencia DESC, termo_base, variantes))::varchar AS tabela FROM tab GROUP BY coluna")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.report_json(part_clusters(spark, sf_dir))


@query(union([f"SELECT '{n}' AS sep, n_nationkey, n_name, n_regionkey FROM nation" for n in ("comma", "semicolon", "tab", "pipe", "colon")]))
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table written with each delimiter and read back by what its head shows."""
    root, df, parts = place(spark), table(spark, sf_dir, "nation"), []
    for name, sep in zip(("comma", "semicolon", "tab", "pipe", "colon"), readers.DELIMITERS, strict=True):
        df.write.option("header", True).option("sep", sep).csv(f"{root}/{name}.csv")
        parts.append(readers.load(spark, f"{root}/{name}.csv").select(F.lit(name).alias("sep"), "n_nationkey", "n_name", "n_regionkey"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return running_counts(read_files(spark, path, spark.read.parquet(path).schema), "event_type", place(spark))


@query("SELECT doc_id, lang, length(text) AS size FROM documents")
def latest_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one session has published last, as another session reads it."""
    shared, docs = place(spark), table(spark, sf_dir, "documents")
    publish(docs.groupBy("source").count(), shared)
    publish(docs.select("doc_id", "lang", F.length("text").cast("long").alias("size")), shared)
    return latest(spark.newSession(), shared)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
