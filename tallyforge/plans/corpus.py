"""Queries over documents, entities, graph and event payloads; with SQL oracles where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import columns as C
from tallyforge.operators import describe, entity, graph, search
from tallyforge.session import table
from tallyforge.streaming.incremental import windowed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


QUESTION = "storm drains and sidewalk ramps contract amendment"
_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(coalesce({c}, '')), '\\.', '', 'g'), '&', ' AND ', 'g'), '\\s*#\\s*\\d*\\s*$', ''), '[^A-Z0-9]+', ' ', 'g'))"
_KEY = "regexp_replace(regexp_replace(" + _KEY + ", '^THE (.)', '\\1'), '( (" + "|".join(C.SUFFIXES) + "))+$', '')"


@query(f"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')) AS term FROM documents WHERE text IS NOT NULL),
dl AS (SELECT doc_id, count(*) AS dl FROM w GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
q AS (SELECT DISTINCT unnest(string_split('{QUESTION}', ' ')) AS term), tf AS (SELECT doc_id, w.term, count(*) AS tf FROM w JOIN q USING (term) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) * 10000, 0) / 10000 AS score FROM tf JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY 1""")
def bm25_plain(spark, base):
    """All documents with a term of the question, scored without stemming and stop words."""
    s = search.Index(table(spark, base, "documents"), stem=False, stop=False).search(QUESTION, k=None)
    return s.select("doc_id", (F.round(F.col("score") * 10000, 0) / 10000).alias("score"))


@query()
def bm25_top(spark, base):
    """The best documents with stems and stop words."""
    docs = table(spark, base, "documents")
    top = search.Index(docs).search(QUESTION, k=10, min_score=1.0)
    return top.join(docs.select("doc_id", "file_no", "matter_type"), "doc_id")


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS cleaned, substr(intro_date, 1, 10) AS day FROM documents WHERE lang = 'es' AND text IS NOT NULL AND regexp_full_match(text, '[\\x{0009}\\x{000A}\\x{000D}\\x{0020}-\\x{007E}\\x{00A1}-\\x{024F}]*')")
def clean_texts(spark, base):
    """The texts of ``clean_texts_all`` that both engines' white-space classes cover: its check against SQL."""
    d = table(spark, base, "documents").where((F.col("lang") == "es") & F.col("text").isNotNull() & F.col("text").rlike(r"\A[\t\n\r\x20-\x7E\xA1-ɏ]*\z"))
    return _cleaned(d)


def _cleaned(docs):
    return docs.select("doc_id", C.clean_space(F.col("text")).alias("cleaned"), F.substring("intro_date", 1, 10).alias("day"))


@query()
def clean_texts_all(spark, base):
    """Every document with its text cleaned, whatever its language and characters; null texts stay null."""
    return _cleaned(table(spark, base, "documents"))


@query("SELECT matter_type, status, count(*) AS n, count(text) AS with_text, min(intro_date) AS first_day, max(intro_date) AS last_day FROM documents GROUP BY 1, 2")
def corpus_overview(spark, base):
    return table(spark, base, "documents").groupBy("matter_type", "status").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("with_text"), F.min("intro_date").alias("first_day"), F.max("intro_date").alias("last_day"))


def _raw(spark, base):
    return entity.weights(table(spark, base, "expenditures"), "payee", "extended_amount", "is_data_artifact")


_ASCII = "payee IS NOT NULL AND regexp_full_match(payee, '[\\x{0020}-\\x{007E}]*')"


@query(f"SELECT DISTINCT payee, {_KEY.format(c='payee')} AS key FROM expenditures WHERE {_ASCII}")
def name_keys(spark, base):
    """The keys of ``name_keys_all`` that SQL can check: both engines fold and match printable ASCII alike."""
    return _keys(table(spark, base, "expenditures").where(F.col("payee").rlike(r"\A[\x20-\x7E]*\z")))


def _keys(e):
    return e.select("payee").distinct().select("payee", C.name_key(F.col("payee")).alias("key"))


@query()
def name_keys_all(spark, base):
    """The key of every payee spelling."""
    return _keys(table(spark, base, "expenditures").where("payee IS NOT NULL"))


@query(f"""WITH r AS (SELECT payee AS raw, coalesce(sum(TRY_CAST(extended_amount AS DOUBLE)), 0) AS w FROM expenditures WHERE NOT is_data_artifact AND {_ASCII} GROUP BY 1), k AS (SELECT {_KEY.format(c='raw')} AS key, raw, w FROM r)
SELECT key, round(sum(w) * 100, 0) / 100 AS weight, count(*) AS members FROM k WHERE key <> '' GROUP BY 1""")
def name_clusters(spark, base):
    """Clusters of the spellings in printable ASCII alone, as its SQL states; ``name_clusters_all`` has the weights and members of all."""
    return _clusters(table(spark, base, "expenditures").where(F.col("payee").rlike(r"\A[\x20-\x7E]*\z")))


def _clusters(e):
    raw = entity.weights(e, "payee", "extended_amount", "is_data_artifact")
    c = raw.withColumn("key", C.name_key(F.col("raw"))).where("key <> ''")
    return c.groupBy("key").agg(C.round2(F.sum("weight")).alias("weight"), F.count(F.lit(1)).alias("members"))


@query()
def name_clusters_all(spark, base):
    """Weight and members of every cluster of payee spellings."""
    return _clusters(table(spark, base, "expenditures"))


@query()
def draft_map(spark, base):
    """Rows of a draft map with title-cased labels."""
    return entity.draft_map(_raw(spark, base))


@query()
def near_duplicates(spark, base):
    """Alike keys of one first-letters block."""
    return entity.near_duplicates(entity.clusters(_raw(spark, base)))


@query()
def initialisms(spark, base):
    """Keys that spell the initials of another key."""
    return entity.initialisms(entity.clusters(entity.weights(table(spark, base, "expenditures"), "agency", "extended_amount", "is_data_artifact")))


@query("SELECT regexp_extract(upper(payee), '^(.*#)\\s*\\d*\\s*$', 1) AS prefix, count(DISTINCT payee) AS members FROM expenditures WHERE payee IS NOT NULL AND NOT is_data_artifact AND regexp_extract(upper(payee), '^(.*#)\\s*\\d*\\s*$', 1) <> '' GROUP BY 1")
def prefix_candidates(spark, base):
    return entity.prefix_candidates(_raw(spark, base)).select("prefix", "members")


_M = "round(coalesce(sum(extended_amount), 0) * 100, 0) / 100 AS total, count(*) AS count"


@query(" UNION ALL ".join(f"SELECT '{k}' AS label, CAST({c} AS VARCHAR) AS id, {_M} FROM expenditures WHERE {c} IS NOT NULL GROUP BY 2" for k, c in graph.NODES.items()))
def graph_nodes(spark, base):
    e = table(spark, base, "expenditures")
    out = None
    for k in graph.NODES:
        n = graph.nodes(e, k)
        out = n if out is None else out.unionByName(n)
    return out


@query(" UNION ALL ".join(f"SELECT '{n}' AS edge, CAST({graph.NODES[a]} AS VARCHAR) AS src, CAST({graph.NODES[b]} AS VARCHAR) AS dst, round(coalesce(sum(extended_amount), 0) * 100, 0) / 100 AS total, {'count(*)' if counted else 'CAST(NULL AS BIGINT)'} AS count FROM expenditures WHERE {graph.NODES[a]} IS NOT NULL AND {graph.NODES[b]} IS NOT NULL GROUP BY 2, 3" for n, (a, b, counted) in graph.EDGES.items()))
def graph_edges(spark, base):
    e = table(spark, base, "expenditures")
    out = None
    for n in graph.EDGES:
        x = graph.edges(e, n)
        out = x if out is None else out.unionByName(x)
    return out


@query("SELECT DISTINCT 'LICENSED' AS edge, p.id AS src, c.LICENSENO AS dst FROM (SELECT DISTINCT payee AS id FROM expenditures WHERE payee IS NOT NULL) p JOIN active_contractors c ON lower(trim(p.id)) = lower(trim(c.FULLNAME)) WHERE c.LICENSENO IS NOT NULL")
def graph_licences(spark, base):
    return graph.licensed_edges(graph.nodes(table(spark, base, "expenditures"), "Payee"), table(spark, base, "active_contractors"))


_COLS = {"fund": "VARCHAR", "fiscal_year": "INTEGER", "extended_amount": "DOUBLE", "region": "VARCHAR"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct FROM expenditures" for c in _COLS))
def table_profile(spark, base):
    """The counts of four columns that its SQL states; ``table_profile_all`` profiles the table."""
    return describe.profile(table(spark, base, "expenditures").select(*_COLS)).select("column", "n_rows", "n_null", "n_distinct")


@query()
def table_profile_all(spark, base):
    """Every column of the ledger: type, rows, nulls, distinct values, lowest and highest value."""
    return describe.profile(table(spark, base, "expenditures"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value) * 100, 0) / 100 AS total FROM events GROUP BY 1, 2")
def event_payloads(spark, base):
    """JSON text read by its schema; the fields are columns from there on."""
    e = table(spark, base, "events").withColumn("p", F.from_json("props", "k bigint"))
    return e.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count(F.lit(1)).alias("n"), C.round2(F.sum("value")).alias("total"))


@query("""SELECT r_name AS region, year(o_orderdate) AS year, round(sum(l_extendedprice * (1 - l_discount)) * 100, 0) / 100 AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def star_join(spark, base):
    """A star join of the order tables; sizes decide which sides are broadcast."""
    li, o, c, n, r = (table(spark, base, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(F.col("r_name").alias("region"), F.year("o_orderdate").alias("year")).agg(C.round2(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value) * 100, 0) / 100 AS total FROM (SELECT DISTINCT ON (event_id, ts) * FROM events) GROUP BY 1, 2")
def event_windows(spark, base):
    w = windowed(table(spark, base, "events"))
    return w.select("start", "event_type", "n", C.round2(F.col("total")).alias("total"))
