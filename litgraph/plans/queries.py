"""Named queries over the driver tables and their DuckDB oracle SQL.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame; ``ORACLE[name]`` is the
same result written as DuckDB SQL over the pre-registered driver tables (the
fixture views are prepended as CTEs).  Every computed column carries the same
alias on both sides, doubles are rounded to 6 places and arrays are joined
into text with a stated order, so results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litgraph.operators import authors as au
from litgraph.operators import places as pl
from litgraph.plans import fixtures as fx
from litgraph.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ------------------------------------------------------------- SQL snippets

BLANK = (r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
         r"\x{3000}]")


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def sql_country(aff: str) -> str:
    last_field = sql_strip("string_split(" + aff + ", ',')[-1]")
    return sql_strip(f"split_part({last_field}, '.', 1)")


def sql_city(aff: str) -> str:
    return sql_strip(f"string_split({aff}, ',')[-2]")


def sql_plain_place(city: str, country: str) -> str:
    def plain(x):
        return f"nullif(trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '')"
    return f"{plain(city)} || ', ' || {plain(country)}"


PLACED_SQL = f"""SELECT a.*, coalesce(i.name, c.country0) AS country, c.city, g.latitude, g.longitude
FROM (SELECT *, {sql_country('affiliation')} AS country0, {sql_city('affiliation')} AS city FROM affiliated) c
JOIN affiliated a USING (pubmedid, author_pos, aff_pos)
LEFT JOIN iso i ON upper(c.country0) = i.alpha3
LEFT JOIN gazetteer g ON g.city IS NOT DISTINCT FROM c.city
                     AND g.country IS NOT DISTINCT FROM coalesce(i.name, c.country0)"""

SEQ_SQL = "CAST(pubmedid AS BIGINT) * 4294967296 + author_pos * 4096 + aff_pos"

MERGED_SQL = f"""SELECT f.forename, f.lastname, coalesce(a.affiliation, '') AS affiliation, p.pubmedid, p.links,
       f.country, f.city, f.latitude, f.longitude
FROM (SELECT forename, lastname, arg_min_null(country, {SEQ_SQL}) AS country,
             arg_min_null(city, {SEQ_SQL}) AS city, arg_min_null(latitude, {SEQ_SQL}) AS latitude,
             arg_min_null(longitude, {SEQ_SQL}) AS longitude
      FROM placed WHERE forename IS NOT NULL AND lastname IS NOT NULL GROUP BY ALL) f
LEFT JOIN (SELECT forename, lastname, string_agg(affiliation, '; ' ORDER BY s) AS affiliation
           FROM (SELECT forename, lastname, affiliation, min({SEQ_SQL}) AS s FROM placed
                 WHERE affiliation IS NOT NULL AND forename IS NOT NULL AND lastname IS NOT NULL GROUP BY ALL)
           GROUP BY ALL) a USING (forename, lastname)
JOIN (SELECT forename, lastname, string_agg(pubmedid, ', ' ORDER BY s) AS pubmedid,
             string_agg('https://pubmed.ncbi.nlm.nih.gov/' || pubmedid || '/', ', ' ORDER BY s) AS links
      FROM (SELECT forename, lastname, pubmedid, min({SEQ_SQL}) AS s FROM placed
            WHERE forename IS NOT NULL AND lastname IS NOT NULL GROUP BY ALL)
      GROUP BY ALL) p USING (forename, lastname)"""

AUTHOR_CTES = [("placed", PLACED_SQL), ("merged", MERGED_SQL)]


def author_sql(body: str, extra: list[tuple[str, str]] | None = None, recursive: bool = False) -> str:
    return fx.with_views(body, AUTHOR_CTES + list(extra or []), recursive=recursive)


# ------------------------------------------------------------- shared plans

def placed(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    return au.add_places(fx.affiliated(spark, sf, rows), fx.iso(spark), fx.gazetteer(spark))


def merged(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    return au.merge_authors(placed(spark, sf, rows), fx.paper_order(None))


def authorship_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Authorship written once, for the graph queries: its shuffles are released
    before the merge, and first authors read it too."""
    return materialize(fx.authorship(spark, sf), "authorship")


MERGED_COLS = ["forename", "lastname", "affiliation", "pubmedid", "country", "city"]


def merged_scalar(df: DataFrame) -> DataFrame:
    return df.select(*MERGED_COLS, r6("latitude").alias("latitude"), r6("longitude").alias("longitude"))


# ------------------------------------------------------------- step 1: who works where

@query("affiliation_country", fx.with_views(
    f"SELECT pubmedid, author_pos, affiliation, {sql_country('affiliation')} AS country FROM affiliated"))
def q_affiliation_country(spark, sf):
    from litgraph.functions.strings import affiliation_country
    return fx.affiliated(spark, sf).select(
        "pubmedid", F.col("author_pos").cast("bigint").alias("author_pos"), "affiliation",
        affiliation_country("affiliation").alias("country"))


@query("affiliation_city", fx.with_views(
    f"SELECT pubmedid, author_pos, affiliation, {sql_city('affiliation')} AS city FROM affiliated"))
def q_affiliation_city(spark, sf):
    from litgraph.functions.strings import affiliation_city
    return fx.affiliated(spark, sf).select(
        "pubmedid", F.col("author_pos").cast("bigint").alias("author_pos"), "affiliation",
        affiliation_city("affiliation").alias("city"))


@query("normalize_country", author_sql(
    "SELECT pubmedid, author_pos, affiliation, country FROM placed"))
def q_normalize_country(spark, sf):
    df = au.normalize_country(au.add_country_city(fx.affiliated(spark, sf)), fx.iso(spark))
    return df.select("pubmedid", F.col("author_pos").cast("bigint").alias("author_pos"),
                     "affiliation", "country")


@query("geocode_places", author_sql(
    "SELECT pubmedid, author_pos, city, country, round(latitude, 6) AS latitude, "
    "round(longitude, 6) AS longitude FROM placed"))
def q_geocode_places(spark, sf):
    return placed(spark, sf).select(
        "pubmedid", F.col("author_pos").cast("bigint").alias("author_pos"), "city", "country",
        r6("latitude").alias("latitude"), r6("longitude").alias("longitude"))


@query("merge_authors", author_sql(
    "SELECT forename, lastname, affiliation, pubmedid, country, city, round(latitude, 6) AS latitude, "
    "round(longitude, 6) AS longitude FROM merged"))
def q_merge_authors(spark, sf):
    return merged_scalar(merged(spark, sf))


@query("located_authors", author_sql(
    "SELECT forename, lastname, affiliation, pubmedid, country, city, round(latitude, 6) AS latitude, "
    "round(longitude, 6) AS longitude FROM merged WHERE latitude IS NOT NULL AND longitude IS NOT NULL"))
def q_located_authors(spark, sf):
    return merged_scalar(pl.located_authors(merged(spark, sf)))


AUTHORS_BY_LOCATION_SQL = author_sql(
    "SELECT round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, "
    "string_agg('<b>' || forename || ' ' || lastname || '</b>: ' || affiliation, '<br>' "
    "ORDER BY forename, lastname) AS popup, count(*) AS n_authors FROM merged "
    "WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY ALL")


@query("authors_by_location", AUTHORS_BY_LOCATION_SQL)
def q_authors_by_location(spark, sf):
    df = pl.authors_by_location(merged(spark, sf))
    return df.select(r6("latitude").alias("latitude"), r6("longitude").alias("longitude"),
                     "popup", "n_authors")


# ------------------------------------------------------------- step 2: nested records

def _bigint(*cols):
    return [F.col(c).cast("bigint").alias(c) for c in cols]


RECORD_ROWS_SQL = fx.with_views(
    "SELECT pubmedid, author_pos, aff_pos, forename, lastname, affiliation FROM affiliated")


@query("explode_authorship", RECORD_ROWS_SQL)
def q_explode_authorship(spark, sf):
    df = au.explode_authorship(fx.records(spark, sf))
    return df.select("pubmedid", *_bigint("author_pos", "aff_pos"), "forename", "lastname", "affiliation")


@query("scan_records_xml", RECORD_ROWS_SQL)
def q_scan_records_xml(spark, sf):
    """Records written as XML to the shared scratch folder and read back with
    the declared schema, then exploded (round trip of S1 + N1)."""
    from litgraph.session import scratch_path
    from litgraph.sources.records import read_records_xml, write_records_xml
    path = scratch_path(spark, "records-xml")
    write_records_xml(fx.records(spark, sf), path)
    df = au.explode_authorship(read_records_xml(spark, path))
    return df.select("pubmedid", *_bigint("author_pos", "aff_pos"), "forename", "lastname", "affiliation")


@query("explode_authorship_outer", fx.with_views(
    "SELECT pubmedid, author_pos, CASE WHEN affiliation IS NULL THEN NULL ELSE aff_pos END AS aff_pos, "
    "coalesce(forename, '') AS forename, coalesce(lastname, '') AS lastname, affiliation FROM authorship"))
def q_explode_authorship_outer(spark, sf):
    df = au.explode_authorship_outer(fx.records(spark, sf))
    return df.select("pubmedid", *_bigint("author_pos", "aff_pos"), "forename", "lastname", "affiliation")


@query("author_positions", fx.with_views(
    "SELECT pubmedid, author_pos, forename, lastname, count(*) OVER (PARTITION BY pubmedid) AS n_authors, "
    "author_pos = 1 AS is_first, author_pos = count(*) OVER (PARTITION BY pubmedid) AS is_last FROM authorship"))
def q_author_positions(spark, sf):
    df = au.author_positions(fx.records(spark, sf))
    return df.select("pubmedid", *_bigint("author_pos"), "forename", "lastname", "n_authors",
                     "is_first", "is_last")


def _sql_name(fore, last):
    return f"coalesce({fore}, '') || ' ' || coalesce({last}, '')"


@query("main_authors", fx.with_views(
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS uid,
       {sql_strip("split_part(fa, ':', 1)")} AS first_author,
       {sql_strip("split_part(la, ':', 1)")} AS last_author
FROM orders LEFT JOIN (
  SELECT pubmedid, arg_min({_sql_name('forename', 'lastname')}, author_pos) AS fa,
         arg_max({_sql_name('forename', 'lastname')}, author_pos) AS la
  FROM authorship GROUP BY pubmedid) a ON a.pubmedid = CAST(o_orderkey AS VARCHAR)"""))
def q_main_authors(spark, sf):
    return au.main_authors(fx.records(spark, sf))


SPLIT_AT_COLON = "split_part(author_string, ':', 1)"

AUTHOR_STRINGS_SQL = (
    f"SELECT pubmedid, author_pos, {_sql_name('forename', 'lastname')} || ': ' || "
    "coalesce(affiliation, '') AS author_string FROM authorship")


@query("author_strings", fx.with_views(AUTHOR_STRINGS_SQL))
def q_author_strings(spark, sf):
    df = au.author_strings(fx.records(spark, sf))
    return df.select("pubmedid", *_bigint("author_pos"), "author_string")


@query("clean_author_name", fx.with_views(
    f"SELECT pubmedid, author_pos, {sql_strip(SPLIT_AT_COLON)} "
    "AS author_name FROM s", [("s", AUTHOR_STRINGS_SQL)]))
def q_clean_author_name(spark, sf):
    from litgraph.functions.strings import clean_author_name
    df = au.author_strings(fx.records(spark, sf))
    return df.select("pubmedid", *_bigint("author_pos"),
                     clean_author_name("author_string").alias("author_name"))


@query("records_by_id", fx.with_views(
    """SELECT CAST(o_orderkey AS VARCHAR) AS pubmedid, p.Title AS title, count(a.author_pos) AS n_authors
FROM orders o
LEFT JOIN papers p ON p.uid = CAST(o.o_orderkey AS VARCHAR)
LEFT JOIN authorship a ON a.pubmedid = CAST(o.o_orderkey AS VARCHAR)
WHERE CAST(o.o_orderkey AS VARCHAR) IN (SELECT uid FROM papers)
GROUP BY ALL"""))
def q_records_by_id(spark, sf):
    return record_heads(au.records_by_id(fx.records(spark, sf), fx.papers(spark, sf), "uid"))


def record_heads(recs):
    return recs.select(
        F.col("MedlineCitation.PMID._VALUE").alias("pubmedid"),
        F.col("MedlineCitation.Article.ArticleTitle").alias("title"),
        F.size("MedlineCitation.Article.AuthorList.Author").cast("bigint").alias("n_authors"))


@query("records_of_store", ORACLE["records_by_id"])
def q_records_of_store(spark, sf):
    """The records written to a store, and those of the papers read from it."""
    from litgraph.session import scratch_path
    from litgraph.sources.recordstore import records_of, save_records
    path = scratch_path(spark, "records")
    save_records(fx.records(spark, sf), path)
    return record_heads(records_of(spark, path, fx.papers(spark, sf)))


@query("dedupe_authors_first", author_sql(
    f"""SELECT forename, lastname, arg_min(affiliation, {SEQ_SQL}) AS affiliation,
       arg_min(pubmedid, {SEQ_SQL}) AS pubmedid, arg_min(country, {SEQ_SQL}) AS country,
       arg_min(city, {SEQ_SQL}) AS city, round(arg_min(latitude, {SEQ_SQL}), 6) AS latitude,
       round(arg_min(longitude, {SEQ_SQL}), 6) AS longitude
FROM placed WHERE forename IS NOT NULL AND lastname IS NOT NULL GROUP BY ALL"""))
def q_dedupe_authors_first(spark, sf):
    df = au.dedupe_authors_first(placed(spark, sf), fx.paper_order(None),
                                 ["affiliation", "pubmedid", "country", "city", "latitude", "longitude"])
    return merged_scalar(df)


@query("flatten_documents", fx.with_views("SELECT page_content, uid, Title, Published FROM papers"))
def q_flatten_documents(spark, sf):
    from litgraph.sources.records import flatten_documents, to_documents
    return flatten_documents(to_documents(fx.papers(spark, sf)))


# ------------------------------------------------------------- step 3: display tables and filters

LINK = '"Link to Paper in Database"'


@query("paper_table", fx.with_views(
    f"SELECT Title, page_content AS Abstract, Published, "
    f"'https://pubmed.ncbi.nlm.nih.gov/' || uid || '/' AS {LINK} FROM papers"))
def q_paper_table(spark, sf):
    from litgraph.operators.tables import paper_table
    return paper_table(fx.papers(spark, sf))


@query("author_table", author_sql(
    f"SELECT forename AS Forename, lastname AS Lastname, affiliation AS Affiliation, country AS Country, "
    f"city AS City, links AS {LINK} FROM merged"))
def q_author_table(spark, sf):
    from litgraph.operators.tables import author_table
    return author_table(merged(spark, sf))


COUNTRY_SET = ["Canada", "Norway", "Kenya"]


@query("filter_country_set", author_sql(
    "SELECT forename, lastname, affiliation, pubmedid, country, city, round(latitude, 6) AS latitude, "
    "round(longitude, 6) AS longitude FROM merged WHERE country IN ('Canada', 'Norway', 'Kenya')"))
def q_filter_country_set(spark, sf):
    from litgraph.operators.tables import filter_in
    return merged_scalar(filter_in(merged(spark, sf), "country", COUNTRY_SET))


MULTI_FILTER = {
    "country": {"in": ["Canada", "Norway", "Kenya", "Germany", "France"]},
    "lastname": {"starts_with": "b"},
    "affiliation": {"contains": "dept a"},
    "forename": {"not_in": ["red"]},
}


@query("filter_table_multi", author_sql(
    "SELECT forename, lastname, affiliation, pubmedid, country, city, round(latitude, 6) AS latitude, "
    "round(longitude, 6) AS longitude FROM merged WHERE country IN ('Canada', 'Norway', 'Kenya', 'Germany', "
    "'France') AND starts_with(lower(lastname), 'b') AND contains(lower(affiliation), 'dept a') "
    "AND forename NOT IN ('red')"))
def q_filter_table_multi(spark, sf):
    from litgraph.operators.tables import filter_table
    return merged_scalar(filter_table(merged(spark, sf), MULTI_FILTER))


# ------------------------------------------------------------- step 4: search

TOKENS_SQL = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def sql_tokens(x: str) -> str:
    return TOKENS_SQL.format(x=x)


BLANK_SQL = "' '"
TEXT_ALL = "concat_ws(' ', Title, page_content, Published)"
EDGE = "[^\\p{L}\\p{N}]"
LETTER = "[\\p{L}\\p{N}]"


def sql_words(columns: str, alternatives: str) -> str:
    """One of the words (a regular expression) as a whole word of the columns."""
    return f"regexp_matches(lower(concat_ws(' ', {columns})), '(^|{EDGE})({alternatives})({EDGE}|$)')"


def _boolean_query(name, where, groups, exclude=()):
    @query(name, fx.with_views(f"SELECT uid, Title FROM papers WHERE {where}"))
    def run(spark, sf):
        from litgraph.operators.search import boolean_search
        return boolean_search(fx.papers(spark, sf), groups, exclude).select("uid", "Title")
    return run


BOOL_GROUPS = [["thtion", "thing"], ["erat", "ertion", "attion"]]
BOTH = "Title, page_content"
BOOL_SQL = f"{sql_words(BOTH, 'thtion|thing')} AND {sql_words(BOTH, 'erat|ertion|attion')}"
_boolean_query("boolean_search", BOOL_SQL, BOOL_GROUPS)
_boolean_query("boolean_search_not", f"{BOOL_SQL} AND NOT {sql_words(BOTH, 'de|que')}", BOOL_GROUPS, ["de", "que"])
_boolean_query("term_wildcard_search",
               f"({sql_words(BOTH, f'thth{LETTER}*')} OR {sql_words(BOTH, f'of{EDGE}+the')}) AND {sql_words(BOTH, f'er{LETTER}n')}",
               [["thth*", '"of the"'], ["er?n"]])
_boolean_query("field_search",
               f"{sql_words('Title', 'thon|erin')} AND {sql_words('Title, page_content, Published', f'thre{LETTER}*')} "
               f"AND NOT {sql_words('page_content', 'la')}",
               [["thon[Title]", "erin[Title]"], ["thre*[All Fields]"]], ["la[Abstract]"])

BM25_SQL = """docs AS (SELECT uid, {toks} AS toks FROM papers),
stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(toks)) AS avgdl FROM docs),
q AS (SELECT DISTINCT qid, term FROM (SELECT {qid} AS qid, unnest({qtoks}) AS term FROM {qsrc})),
tf AS (SELECT uid, dl, term, count(*) AS tf
       FROM (SELECT uid, len(toks) AS dl, unnest(toks) AS term FROM docs)
       WHERE term IN (SELECT term FROM q) GROUP BY ALL),
idf AS (SELECT term, ln(1 + ((SELECT n FROM stats) - count(*) + 0.5) / (count(*) + 0.5)) AS idf
        FROM tf GROUP BY term),
scores AS (SELECT q.qid, tf.uid,
                  sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / (SELECT avgdl FROM stats)))) AS score
           FROM tf JOIN idf USING (term) JOIN q USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, uid) AS rank
           FROM scores)"""

BM25_TOPIC = "thtion thing erat ertion attion"
BM25_K = 30


BM25_CTE_NAMES = ["docs", "stats", "q", "tf", "idf", "scores", "ranked"]


def _bm25_sql(qid, qtoks, qsrc, body):
    """BM25 oracle: the CTE block above, split into named parts for with_views."""
    text = BM25_SQL.format(toks=sql_tokens("concat_ws(' ', Title, page_content)"), qid=qid,
                           qtoks=qtoks, qsrc=qsrc)
    parts = []
    for i, name in enumerate(BM25_CTE_NAMES):
        start = text.index(f"{name} AS (") + len(name) + 5
        end = (text.index(f",\n{BM25_CTE_NAMES[i + 1]} AS (") if i + 1 < len(BM25_CTE_NAMES)
               else len(text))
        parts.append((name, text[start:end].rstrip()[:-1]))
    return fx.with_views(body, parts)


@query("search_topk_bm25", _bm25_sql(
    "0", sql_tokens(f"'{BM25_TOPIC}'"), "(SELECT 1)",
    f"SELECT uid, round(score, 6) AS score, rank FROM ranked WHERE rank <= {BM25_K}"))
def q_search_topk_bm25(spark, sf):
    from litgraph.operators.search import search_bm25
    df = search_bm25(fx.papers(spark, sf), BM25_TOPIC, BM25_K)
    return df.select("uid", r6("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


def indexed_papers(spark, sf):
    """The papers' inverted index, written into the shared folder."""
    from litgraph.operators.textindex import append_to_index
    from litgraph.session import scratch_path
    path = scratch_path(spark, "index")
    append_to_index(fx.papers(spark, sf), path)
    return path


@query("search_indexed", ORACLE["search_topk_bm25"])
def q_search_indexed(spark, sf):
    from litgraph.operators.textindex import search_index
    df = search_index(spark, indexed_papers(spark, sf), BM25_TOPIC, BM25_K)
    return df.select("uid", r6("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


COMPOSED_GROUPS = [["thtion[Title/Abstract]", "thing[All Fields]"], ["erat", "ertion", "thre*"]]


@query("search_composed", _bm25_sql(
    "0", "['thtion', 'thing', 'erat', 'ertion']", "(SELECT 1)",
    f"""SELECT uid, round(score, 6) AS score, rank FROM (
  SELECT uid, coalesce(score, 0) AS score,
         row_number() OVER (ORDER BY round(coalesce(score, 0), 9) DESC, uid) AS rank
  FROM papers LEFT JOIN scores USING (uid)
  WHERE regexp_matches(lower(concat_ws(' ', Title, page_content, Published)), '(^|{EDGE})(thtion|thing)({EDGE}|$)')
    AND regexp_matches(lower(concat_ws(' ', Title, page_content)),
                       '(^|{EDGE})(erat|ertion|thre[\\p{{L}}\\p{{N}}]*)({EDGE}|$)'))
WHERE rank <= {BM25_K}"""))
def q_search_composed(spark, sf):
    from litgraph.operators.search import search_composed
    df = search_composed(fx.papers(spark, sf), COMPOSED_GROUPS, k=BM25_K)
    return df.select("uid", r6("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


TOPIC_K = 5


@query("search_topk_per_topic", _bm25_sql(
    "item_id", sql_tokens("text"), "benchmark",
    f"SELECT qid AS topic_id, uid, round(score, 6) AS score, rank FROM ranked WHERE rank <= {TOPIC_K}"))
def q_search_topk_per_topic(spark, sf):
    from litgraph.operators.search import search_bm25_per_topic
    topics = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("topic_id"),
                                                     F.col("text").alias("topic"))
    df = search_bm25_per_topic(fx.papers(spark, sf), topics, TOPIC_K)
    return df.select("topic_id", "uid", r6("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("search_indexed_per_topic", ORACLE["search_topk_per_topic"])
def q_search_indexed_per_topic(spark, sf):
    from litgraph.operators.textindex import search_index_per_topic
    topics = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("topic_id"),
                                                     F.col("text").alias("topic"))
    df = search_index_per_topic(spark.read.parquet(indexed_papers(spark, sf)), topics, TOPIC_K)
    return df.select("topic_id", "uid", r6("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


def part_topics(spark, sf):
    return fx.table(spark, sf, "part").select(F.col("p_name").alias("topic")).distinct()


def part_thesaurus(spark, sf):
    return fx.table(spark, sf, "part").select(
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("term"), F.col("p_type").alias("synonym"))


EXPAND_SQL = [
    ("topics", "SELECT DISTINCT p_name AS topic FROM part"),
    ("thes", "SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS word, lower(p_type) AS term FROM part"),
    ("tw", f"""SELECT topic, w, min(i) AS fi FROM (
  SELECT topic, unnest(toks) AS w, unnest(range(1, len(toks) + 1)) AS i
  FROM (SELECT topic, {sql_tokens('topic')} AS toks FROM topics)) GROUP BY ALL"""),
    ("words", "SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY fi) AS concept_pos, w AS word FROM tw"),
    ("both_terms", """SELECT topic, concept_pos, word AS term, 'tiab' AS kind, 0 AS o FROM words
UNION ALL
SELECT w.topic, w.concept_pos, s.term, 'all' AS kind, 1 AS o FROM words w JOIN thes s ON s.word = w.word
WHERE s.term <> w.word"""),
    ("expanded", """SELECT topic, concept_pos, row_number() OVER (PARTITION BY topic, concept_pos ORDER BY o, term)
  AS term_pos, term, kind FROM both_terms"""),
]


@query("expand_synonyms", fx.with_views(
    "SELECT topic, concept_pos, term_pos, term, kind FROM expanded", EXPAND_SQL))
def q_expand_synonyms(spark, sf):
    from litgraph.operators.search import expand_synonyms
    df = expand_synonyms(part_topics(spark, sf), part_thesaurus(spark, sf))
    return df.select("topic", *_bigint("concept_pos", "term_pos"), "term", "kind")


@query("compose_query", fx.with_views(
    """SELECT topic, '(' || string_agg(c, ' AND ' ORDER BY concept_pos) || ')' AS query, count(*) AS n_concepts
FROM (SELECT topic, concept_pos, '(' || string_agg(fmt, ' OR ' ORDER BY term_pos) || ')' AS c
      FROM (SELECT *, CASE kind WHEN 'mesh' THEN '"' || lower(term) || '"[Mesh]'
                                WHEN 'all' THEN qt || '[All Fields]'
                                ELSE qt || '[Title/Abstract]' END AS fmt
            FROM (SELECT *, CASE WHEN contains(term, ' ') THEN '"' || term || '"' ELSE term END AS qt
                  FROM expanded))
      GROUP BY ALL)
GROUP BY topic""", EXPAND_SQL))
def q_compose_query(spark, sf):
    from litgraph.operators.search import compose_query, expand_synonyms
    return compose_query(expand_synonyms(part_topics(spark, sf), part_thesaurus(spark, sf)))


# ------------------------------------------------------------- step 5: graph base

MAINS_SQL = f"""SELECT pubmedid AS uid,
       {sql_strip("split_part(arg_min(" + _sql_name('forename', 'lastname') + ", author_pos), ':', 1)")}
       AS first_author
FROM authorship GROUP BY pubmedid"""

GRAPH_CTES = [
    ("author_pids", f"""SELECT forename, lastname, pubmedid,
       row_number() OVER (PARTITION BY forename, lastname ORDER BY s) AS paper_idx
FROM (SELECT forename, lastname, pubmedid, min({SEQ_SQL}) AS s FROM placed
      WHERE forename IS NOT NULL AND lastname IS NOT NULL GROUP BY ALL)"""),
    ("joined", """SELECT m.forename, m.lastname, m.affiliation, ap.pubmedid, ap.paper_idx,
       concat_ws(' ', p.Title, p.page_content) AS research, p.Title
FROM merged m JOIN author_pids ap USING (forename, lastname) JOIN papers p ON p.uid = ap.pubmedid"""),
    ("fused", """SELECT research,
       string_agg(forename, ', ' ORDER BY forename, lastname, paper_idx) AS forename,
       string_agg(lastname, ', ' ORDER BY forename, lastname, paper_idx) AS lastname,
       string_agg(affiliation, '; ' ORDER BY forename, lastname, paper_idx) AS affiliation,
       first(pubmedid ORDER BY forename, lastname, paper_idx) AS pubmedid,
       count(*) AS n_authors
FROM joined GROUP BY research"""),
    ("mains", MAINS_SQL),
    ("nodes", """SELECT f.*, row_number() OVER (ORDER BY f.pubmedid) - 1 AS node_id, m.first_author,
       coalesce(m.first_author, 'Unknown Author') || ' et al.' AS label,
       ln(f.n_authors) * 10 AS size
FROM fused f LEFT JOIN mains m ON m.uid = f.pubmedid"""),
]


def graph_sql(body: str, extra: list[tuple[str, str]] | None = None, recursive: bool = False) -> str:
    return author_sql(body, GRAPH_CTES + list(extra or []), recursive=recursive)


def main_authors_df(rows):
    """First authors for node labels, straight from the authorship rows
    (the records-based path is the ``main_authors`` query)."""
    return au.main_authors_from_rows(rows)


def fused_df(spark, sf, rows=None):
    from litgraph.operators.graph import fuse_by_research
    rows = authorship_rows(spark, sf) if rows is None else rows
    return fuse_by_research(merged(spark, sf, rows), fx.papers(spark, sf))


def nodes_df(spark, sf):
    from litgraph.operators.graph import node_table
    rows = authorship_rows(spark, sf)
    return node_table(fused_df(spark, sf, rows), main_authors_df(rows))


@query("authors_join_papers", graph_sql("SELECT forename, lastname, pubmedid, paper_idx, Title FROM joined"))
def q_authors_join_papers(spark, sf):
    from litgraph.operators.graph import authors_join_papers
    df = authors_join_papers(merged(spark, sf), fx.papers(spark, sf))
    return df.select("forename", "lastname", "pubmedid", *_bigint("paper_idx"), "Title")


@query("research_text", fx.with_views("SELECT uid, concat_ws(' ', Title, page_content) AS research FROM papers"))
def q_research_text(spark, sf):
    from litgraph.functions.strings import research_text
    return fx.papers(spark, sf).select("uid", research_text("Title", "page_content").alias("research"))


@query("fuse_by_research", graph_sql(
    "SELECT research, forename, lastname, affiliation, pubmedid, n_authors FROM fused"))
def q_fuse_by_research(spark, sf):
    return fused_df(spark, sf).select("research", "forename", "lastname", "affiliation", "pubmedid", "n_authors")


@query("table_to_documents", graph_sql(
    "SELECT research AS page_content, forename, lastname, affiliation, pubmedid, n_authors FROM fused"))
def q_table_to_documents(spark, sf):
    from litgraph.sources.records import flatten_documents, table_to_documents
    fused = fused_df(spark, sf).select("research", "forename", "lastname", "affiliation", "pubmedid", "n_authors")
    return flatten_documents(table_to_documents(fused, "research"))


@query("node_ids", graph_sql("SELECT node_id, pubmedid FROM nodes"))
def q_node_ids(spark, sf):
    from litgraph.operators.graph import dense_ids
    return dense_ids(fused_df(spark, sf).select("pubmedid"), "pubmedid").select("node_id", "pubmedid")


@query("node_labels", graph_sql("SELECT node_id, pubmedid, label FROM nodes"))
def q_node_labels(spark, sf):
    return nodes_df(spark, sf).select("node_id", "pubmedid", "label")


@query("node_size", graph_sql("SELECT node_id, n_authors, round(size, 6) AS size FROM nodes"))
def q_node_size(spark, sf):
    return nodes_df(spark, sf).select("node_id", "n_authors", r6("size").alias("size"))


HOVER_LINE = ("CASE WHEN j.forename || ' ' || j.lastname = coalesce(n.first_author, '') "
              "THEN '*' || upper(j.forename) || ' ' || upper(j.lastname) || '* (First Author): ' || aff "
              "ELSE upper(j.forename) || ' ' || upper(j.lastname) || ': ' || aff END")


@query("node_hover", graph_sql(
    f"""SELECT n.node_id, string_agg({HOVER_LINE}, chr(10) ORDER BY j.forename, j.lastname, j.paper_idx) AS title
FROM nodes n JOIN (SELECT *, CASE WHEN coalesce(affiliation, '') = '' THEN 'No affiliation'
                                  ELSE affiliation END AS aff FROM joined) j USING (research)
GROUP BY n.node_id"""))
def q_node_hover(spark, sf):
    return nodes_df(spark, sf).select("node_id", "title")


GRADIENT = ((0.85, 0.93, 0.80), (0.16, 0.20, 0.40))


def _sql_channel(a, b):
    t = "CAST(node_id AS DOUBLE) / (n - 1)"
    ch = f"(CAST({a} AS DOUBLE) + (CAST({b} AS DOUBLE) - CAST({a} AS DOUBLE)) * {t})"
    return f"lpad(lower(hex(CAST(trunc({ch} * 255) AS BIGINT))), 2, '0')"


@query("rgb_to_hex", graph_sql(
    "SELECT node_id, '#' || " + " || ".join(_sql_channel(a, b) for a, b in zip(*GRADIENT)) +
    " AS color FROM nodes, (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes) c"))
def q_rgb_to_hex(spark, sf):
    from litgraph.operators.graph import gradient_color
    nodes = nodes_df(spark, sf).select("node_id")
    n = nodes.select(F.count(F.lit(1)).cast("double")).scalar()
    return nodes.select("node_id", gradient_color(F.col("node_id"), n, *GRADIENT).alias("color"))


# ------------------------------------------------------------- step 6-8: similarity, clusters, neighbourhoods

SIM_T = 0.4
EPS = 0.6


def emb_vectors(spark, sf):
    return fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def sql_pairs(cond: str) -> str:
    sim = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
    return (f"SELECT a.vec_id AS src, b.vec_id AS dst, {sim} AS similarity FROM embeddings a "
            f"JOIN embeddings b ON a.vec_id < b.vec_id WHERE {cond.format(sim=sim)}")


PAIRS_04 = sql_pairs(f"{{sim}} >= {SIM_T}")
SIM_EDGES_SQL = fx.with_views(f"SELECT src, dst, round(similarity, 6) AS similarity FROM ({PAIRS_04})")


def sim_edges(spark, sf, t=SIM_T):
    from litgraph.operators.similarity import similarity_edges
    return similarity_edges(emb_vectors(spark, sf), t)


@query("similarity_edges", SIM_EDGES_SQL)
def q_similarity_edges(spark, sf):
    return sim_edges(spark, sf).select("src", "dst", r6("similarity").alias("similarity"))


@query("similarity_edges_lsh", SIM_EDGES_SQL)
def q_similarity_edges_lsh(spark, sf):
    from litgraph.operators.similarity import similarity_edges_lsh
    df = similarity_edges_lsh(emb_vectors(spark, sf), SIM_T)
    return df.select("src", "dst", r6("similarity").alias("similarity"))


HASHED_DIMS = 128
NEAR_T = 0.8
#: Wished recall; the pairs at sf0.01 that reach 0.8 lie above 0.84, so none is missed there.
NEAR_RECALL = 0.999
HASHED_SQL = [
    ("terms", f"SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest({sql_tokens('page_content')}) AS term FROM papers) "
              "GROUP BY ALL"),
    ("parts", f"""SELECT uid, CAST('0x' || substr(md5(term), 1, 4) AS INT) % {HASHED_DIMS} AS d,
       sum((CASE WHEN substr(md5(term), 5, 1) < '8' THEN 1 ELSE -1 END) * (1 + ln(tf))) AS v FROM terms GROUP BY ALL"""),
    ("hashed", f"""SELECT uid, list(v ORDER BY d) AS v FROM (
  SELECT i.uid, r.d, CAST(coalesce(p.v, 0) AS DOUBLE) AS v
  FROM (SELECT DISTINCT uid FROM parts) i CROSS JOIN (SELECT unnest(range({HASHED_DIMS})) AS d) r
  LEFT JOIN parts p ON p.uid = i.uid AND p.d = r.d) GROUP BY uid"""),
]


@query("similarity_edges_signs", fx.with_views(
    f"""SELECT src, dst, round(s, 6) AS similarity FROM (
  SELECT a.uid AS src, b.uid AS dst, list_cosine_similarity(a.v, b.v) AS s FROM hashed a JOIN hashed b ON a.uid < b.uid)
WHERE s >= {NEAR_T}""", HASHED_SQL))
def q_similarity_edges_signs(spark, sf):
    """Near documents by vectors of their words, through sign signatures."""
    from litgraph.operators.signs import similarity_edges_signs
    from litgraph.operators.vectors import hashed_vectors
    vectors = materialize(hashed_vectors(fx.papers(spark, sf), "uid", "page_content", HASHED_DIMS), "hashed")
    df = similarity_edges_signs(vectors, NEAR_T, "uid", recall=NEAR_RECALL)
    return df.select("src", "dst", r6("similarity").alias("similarity"))


@query("eps_neighbors", fx.with_views(
    f"SELECT src, dst, round(1 - similarity, 6) AS distance FROM ({sql_pairs(f'1 - {{sim}} <= {EPS}')})"))
def q_eps_neighbors(spark, sf):
    from litgraph.operators.similarity import eps_neighbors
    return eps_neighbors(emb_vectors(spark, sf), EPS).select("src", "dst", r6("distance").alias("distance"))


def vector_digest(col: str):
    """Sum of a vector's values times their places (from 1)."""
    from litgraph.functions.vectors import as_double
    return F.aggregate(F.transform(as_double(col), lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)


NODE_VEC_CTES = [("node_pairs", """SELECT a.node_id AS src, b.node_id AS dst,
       list_cosine_similarity(CAST(ea.embedding AS DOUBLE[]), CAST(eb.embedding AS DOUBLE[])) AS similarity
FROM nodes a JOIN embeddings ea ON CAST(ea.vec_id AS VARCHAR) = a.pubmedid
JOIN nodes b ON a.node_id < b.node_id JOIN embeddings eb ON CAST(eb.vec_id AS VARCHAR) = b.pubmedid""")]


def node_graph(spark, sf, t=SIM_T):
    from litgraph.operators.similarity import attach_vectors, similarity_edges
    nodes = nodes_df(spark, sf)
    vecs = attach_vectors(nodes.select("node_id", "pubmedid"), fx.vectors(spark, sf))
    return nodes, similarity_edges(vecs, t, id_col="node_id")


@query("attach_vectors", graph_sql(
    "SELECT n.node_id, n.pubmedid, len(e.embedding) AS dims, round(list_sum(list_transform("
    "CAST(e.embedding AS DOUBLE[]), lambda x, i: x * i)), 6) AS digest FROM nodes n "
    "JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = n.pubmedid"))
def q_attach_vectors(spark, sf):
    from litgraph.operators.similarity import attach_vectors
    df = attach_vectors(nodes_df(spark, sf).select("node_id", "pubmedid"), fx.vectors(spark, sf))
    return df.select("node_id", "pubmedid", F.size("embedding").cast("bigint").alias("dims"),
                     r6(vector_digest("embedding")).alias("digest"))


EDGE_TITLE_SQL = ("'Edge from ''' || a.label || ''' to ''' || b.label || '''. Similarity: ' || printf('%.2f', p.similarity)")


@query("edge_titles", graph_sql(
    f"""SELECT p.src, p.dst, round(p.similarity, 6) AS similarity, a.label AS src_label, b.label AS dst_label,
       {EDGE_TITLE_SQL} AS title, CAST(0.1 AS DOUBLE) AS value, '#a6a6a6' AS color
FROM node_pairs p JOIN nodes a ON a.node_id = p.src JOIN nodes b ON b.node_id = p.dst
WHERE p.similarity >= {SIM_T}""", NODE_VEC_CTES))
def q_edge_titles(spark, sf):
    from litgraph.operators.graph import edge_titles
    nodes, edges = node_graph(spark, sf)
    df = edge_titles(edges, nodes)
    return df.select("src", "dst", r6("similarity").alias("similarity"), "src_label", "dst_label",
                     "title", "value", "color")


COMPONENT_CTES = [
    ("pairs", PAIRS_04),
    ("sym", "SELECT src, dst FROM pairs UNION SELECT dst, src FROM pairs"),
    ("reach", """SELECT src AS id, src AS comp FROM sym
UNION
SELECT s.dst AS id, r.comp FROM reach r JOIN sym s ON s.src = r.id"""),
]


@query("connected_components", fx.with_views(
    "SELECT id, min(comp) AS component FROM reach GROUP BY id", COMPONENT_CTES, recursive=True))
def q_connected_components(spark, sf):
    from litgraph.operators.cluster import connected_components
    return connected_components(sim_edges(spark, sf))


def dbscan_ctes(min_samples: int, points_sql: str, pairs_sql: str, prefix: str = "") -> list[tuple[str, str]]:
    """DBSCAN over a neighbour-pair table, in SQL (recursive components)."""
    p = prefix
    return [
        (f"{p}pairs", pairs_sql),
        (f"{p}points", points_sql),
        (f"{p}sym", f"SELECT src, dst FROM {p}pairs UNION SELECT dst, src FROM {p}pairs"),
        (f"{p}deg", f"SELECT e.id, count(s.dst) AS deg FROM {p}points e LEFT JOIN {p}sym s ON s.src = e.id "
                    "GROUP BY e.id"),
        (f"{p}core", f"SELECT id FROM {p}deg WHERE deg + 1 >= {min_samples}"),
        (f"{p}ce", f"SELECT src, dst FROM {p}sym WHERE src IN (SELECT id FROM {p}core) "
                   f"AND dst IN (SELECT id FROM {p}core)"),
        (f"{p}reach", f"""SELECT id, id AS comp FROM {p}core
UNION
SELECT c.dst AS id, r.comp FROM {p}reach r JOIN {p}ce c ON c.src = r.id"""),
        (f"{p}comp", f"SELECT id, min(comp) AS comp FROM {p}reach GROUP BY id"),
        (f"{p}num", f"SELECT id, dense_rank() OVER (ORDER BY comp) - 1 AS cluster FROM {p}comp"),
        (f"{p}border", f"""SELECT s.src AS id, min(n.cluster) AS cluster FROM {p}sym s JOIN {p}num n ON n.id = s.dst
WHERE s.src NOT IN (SELECT id FROM {p}core) GROUP BY s.src"""),
        (f"{p}clusters", f"""SELECT e.id, coalesce(n.cluster, b.cluster, -1) AS cluster FROM {p}points e
LEFT JOIN {p}num n ON n.id = e.id LEFT JOIN {p}border b ON b.id = e.id"""),
    ]


def dbscan_sql(min_samples: int) -> str:
    ctes = dbscan_ctes(min_samples, "SELECT vec_id AS id FROM embeddings",
                       sql_pairs(f"1 - {{sim}} <= {EPS}"))
    return fx.with_views("SELECT id, cluster FROM clusters", ctes, recursive=True)


def _dbscan(spark, sf, m):
    from litgraph.operators.cluster import dbscan
    from litgraph.operators.similarity import eps_neighbors
    vecs = emb_vectors(spark, sf)
    return dbscan(vecs.select("id"), eps_neighbors(vecs, EPS), m)


@query("dbscan_clusters", dbscan_sql(2))
def q_dbscan_clusters(spark, sf):
    return _dbscan(spark, sf, 2)


@query("dbscan_general", dbscan_sql(3))
def q_dbscan_general(spark, sf):
    return _dbscan(spark, sf, 3)


KHOP = 2


@query("khop_neighbors", fx.with_views(
    f"SELECT seed, node_id, min(hop) AS hop FROM walk GROUP BY ALL",
    COMPONENT_CTES[:2] + [("walk", f"""SELECT src AS seed, src AS node_id, 0 AS hop FROM sym
UNION
SELECT w.seed, s.dst AS node_id, w.hop + 1 AS hop FROM walk w JOIN sym s ON s.src = w.node_id
WHERE w.hop < {KHOP}""")], recursive=True))
def q_khop_neighbors(spark, sf):
    from litgraph.operators.graph import khop_neighbors, undirected
    edges = materialize(sim_edges(spark, sf).select("src", "dst"), "edges")  # read by the seeds and by the rounds
    seeds = undirected(edges).select(F.col("src").alias("seed"), F.col("src").alias("node_id")).distinct()
    df = khop_neighbors(edges, seeds, KHOP)
    return df.select("seed", "node_id", F.col("hop").cast("bigint").alias("hop"))


@query("khop_bitmaps", ORACLE["khop_neighbors"])
def q_khop_bitmaps(spark, sf):
    from litgraph.operators.graph import khop_bitmaps, undirected
    edges = materialize(sim_edges(spark, sf).select("src", "dst"), "edges")  # read by the seeds and by the rounds
    seeds = undirected(edges).select(F.col("src").alias("seed"), F.col("src").alias("node_id")).distinct()
    return khop_bitmaps(edges, seeds, KHOP).select("seed", "node_id", F.col("hop").cast("bigint").alias("hop"))


BANDS = [4, 5]


@query("edge_filter_nodes", fx.with_views(
    "SELECT DISTINCT node_id FROM (SELECT unnest([src, dst]) AS node_id FROM ("
    + sql_pairs("{sim} >= 0.2") + ") WHERE CAST(floor(similarity * 10) AS INTEGER) IN (4, 5))"))
def q_edge_filter_nodes(spark, sf):
    from litgraph.operators.graph import edge_filter_nodes
    edges = sim_edges(spark, sf, 0.2).withColumn("band", F.floor(F.col("similarity") * 10).cast("int"))
    return edge_filter_nodes(edges, "band", BANDS)


@query("graph_node_filter", graph_sql("SELECT node_id, label, n_authors FROM nodes WHERE n_authors IN (3, 4)"))
def q_graph_node_filter(spark, sf):
    from litgraph.operators.graph import node_filter
    return node_filter(nodes_df(spark, sf), "n_authors", [3, 4]).select("node_id", "label", "n_authors")


# ------------------------------------------------------------- step 8-9: sinks, embeddings, network

@query("vectors_roundtrip", fx.with_views(
    "SELECT id, len(embedding) AS dims, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), "
    "lambda x: x * x))), 6) AS norm FROM vectors"))
def q_vectors_roundtrip(spark, sf):
    from litgraph.functions.vectors import norm
    from litgraph.session import scratch_path
    from litgraph.sources.sinks import load_vectors, save_vectors
    path = scratch_path(spark, "vectors")
    save_vectors(fx.vectors(spark, sf), path)
    v = load_vectors(spark, path)
    return v.select("id", F.size("embedding").cast("bigint").alias("dims"), r6(norm("embedding")).alias("norm"))


@query("graph_roundtrip", fx.with_views(
    "SELECT p.src, p.dst, round(p.similarity, 6) AS similarity, c.component "
    "FROM pairs p JOIN (SELECT id, min(comp) AS component FROM reach GROUP BY id) c ON c.id = p.src",
    COMPONENT_CTES, recursive=True))
def q_graph_roundtrip(spark, sf):
    from litgraph.operators.cluster import connected_components
    from litgraph.session import scratch_path
    from litgraph.sources.sinks import load_graph, save_graph
    from litgraph.session import checkpoint
    edges = checkpoint(sim_edges(spark, sf))
    nodes = connected_components(edges)
    path = scratch_path(spark, "graph")
    save_graph(nodes, edges, path)
    n, e = load_graph(spark, path)
    return e.join(n.withColumnRenamed("id", "src"), "src").select(
        "src", "dst", r6("similarity").alias("similarity"), "component")


@query("place_features", author_sql(
    "SELECT to_json({'type': 'Feature', 'geometry': {'type': 'Point', 'coordinates': [longitude, latitude]}, "
    "'properties': {'popup': popup, 'n_authors': n_authors}}) AS value FROM ("
    "SELECT latitude, longitude, string_agg('<b>' || forename || ' ' || lastname || '</b>: ' || affiliation, "
    "'<br>' ORDER BY forename, lastname) AS popup, count(*) AS n_authors FROM merged "
    "WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY ALL)"))
def q_place_features(spark, sf):
    from litgraph.session import scratch_path
    from litgraph.sources.sinks import save_place_features
    path = scratch_path(spark, "places")
    save_place_features(pl.authors_by_location(merged(spark, sf)), path)
    return spark.read.text(path)


@query("embed_tfidf", fx.with_views(
    "SELECT uid, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY uid)), 6) AS weight FROM raw", [
        ("tf", f"""SELECT uid, term, count(*) AS tf FROM (
  SELECT uid, unnest({sql_tokens("concat_ws(' ', Title, page_content)")}) AS term FROM papers) GROUP BY ALL"""),
        ("idf", """SELECT term, ln((CAST((SELECT count(*) FROM papers) AS DOUBLE) + 1) / (count(*) + 1)) AS idf
FROM tf GROUP BY term"""),
        ("raw", "SELECT uid, term, tf * idf AS w FROM tf JOIN idf USING (term) WHERE tf * idf > 0")]))
def q_embed_tfidf(spark, sf):
    from litgraph.operators.vectors import tfidf_rows
    docs = fx.papers(spark, sf)
    docs = docs.select("uid", F.concat_ws(" ", "Title", "page_content").alias("research"))
    return tfidf_rows(docs, "uid", "research").select("uid", "term", r6("weight").alias("weight"))


NETWORK_EPS = 0.6


@query("similarity_network", graph_sql(
    "SELECT n.node_id, n.label, n.n_authors, round(n.size, 6) AS size, c.cluster "
    "FROM nodes n JOIN net_clusters c ON c.id = n.node_id",
    NODE_VEC_CTES + dbscan_ctes(2, "SELECT node_id AS id FROM nodes",
                                f"SELECT src, dst FROM node_pairs WHERE 1 - similarity <= {NETWORK_EPS}",
                                prefix="net_"),
    recursive=True))
def q_similarity_network(spark, sf):
    from litgraph.plans.pipeline import similarity_network
    rows = authorship_rows(spark, sf)
    nodes, _ = similarity_network(merged(spark, sf, rows), fx.papers(spark, sf), main_authors_df(rows),
                                  threshold=SIM_T, vectors_df=fx.vectors(spark, sf), eps=NETWORK_EPS,
                                  missing="drop")
    return nodes.select("node_id", "label", "n_authors", r6("size").alias("size"), "cluster")


@query("similarity_network_edges", graph_sql(
    f"""SELECT p.src, p.dst, round(p.similarity, 6) AS similarity, {EDGE_TITLE_SQL} AS title
FROM node_pairs p JOIN nodes a ON a.node_id = p.src JOIN nodes b ON b.node_id = p.dst
WHERE p.similarity >= {SIM_T}""", NODE_VEC_CTES))
def q_similarity_network_edges(spark, sf):
    from litgraph.plans.pipeline import similarity_network
    rows = authorship_rows(spark, sf)
    _, edges = similarity_network(merged(spark, sf, rows), fx.papers(spark, sf), main_authors_df(rows),
                                  threshold=SIM_T, vectors_df=fx.vectors(spark, sf), eps=NETWORK_EPS,
                                  missing="drop")
    return edges.select("src", "dst", r6("similarity").alias("similarity"), "title")


@query("author_profiles", author_sql(
    "SELECT forename, lastname, affiliation, pubmedid, country, city, round(latitude, 6) AS latitude, "
    "round(longitude, 6) AS longitude FROM merged").replace(
        fx.ORACLE_VIEWS["affiliated"], fx.ORACLE_VIEWS["affiliated"] + " AND pubmedid IN (SELECT uid FROM papers)"))
def q_author_profiles(spark, sf):
    """M5 from records: those of the papers, exploded, placed and merged."""
    from litgraph.plans.pipeline import author_profiles
    return merged_scalar(author_profiles(fx.records(spark, sf), fx.papers(spark, sf), fx.iso(spark), fx.gazetteer(spark)))


@query("refreshed_authors", ORACLE["merge_authors"])
def q_refreshed_authors(spark, sf):
    """All records in two arrivals: those of finished orders are published, the
    others come in a refresh."""
    from litgraph.operators.authors import records_by_id
    from litgraph.plans.pipeline import publish_authors, refresh_authors
    from litgraph.session import materialize, scratch_path
    from litgraph.sources.versions import load_version
    path = scratch_path(spark, "profiles")
    finished = F.col("o_orderstatus") == "F"
    orders = fx.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("uid"), finished.alias("done"))
    records = materialize(fx.records(spark, sf), "records")  # read by both arrivals, twice by the second
    publish_authors(records_by_id(records, orders.where("done")), fx.iso(spark), fx.gazetteer(spark), path)
    refresh_authors(records_by_id(records, orders.where("not done")), fx.iso(spark), fx.gazetteer(spark), path)
    return merged_scalar(load_version(spark, path)["authors"])


def misspelled(df):
    """Authorship rows whose city and country are written in different ways."""
    way = F.col("author_pos") % 5
    return df.select("pubmedid", "author_pos", F.when(way == 1, F.upper("city")).when(way == 2, F.concat("city", F.lit("e")))
                     .when(way == 3, F.concat(F.substring("city", 1, 1), F.expr("substring(city, 3)"))).otherwise(F.col("city")).alias("city"),
                     F.when(way == 4, F.concat(F.lit("x"), "country")).when(way == 3, F.concat("country", F.lit("-")))
                     .otherwise(F.col("country")).alias("country"))


@query("geocode_similar", author_sql("""SELECT r.pubmedid, r.author_pos, r.city, r.country, m.latitude, m.longitude, m.distance
FROM rows_in r LEFT JOIN best m ON m.city IS NOT DISTINCT FROM r.city AND m.country IS NOT DISTINCT FROM r.country""", [
    ("rows_in", """SELECT pubmedid, author_pos, CASE author_pos % 5 WHEN 1 THEN upper(city) WHEN 2 THEN city || 'e'
            WHEN 3 THEN substr(city, 1, 1) || substr(city, 3) ELSE city END AS city,
       CASE author_pos % 5 WHEN 4 THEN 'x' || country WHEN 3 THEN country || '-' ELSE country END AS country FROM placed"""),
    ("texts", f"""SELECT DISTINCT city, country, {sql_plain_place('city', 'country')} AS name FROM rows_in"""),
    ("entries", f"SELECT *, {sql_plain_place('city', 'country')} AS name FROM gazetteer"),
    ("near", """SELECT t.city, t.country, g.latitude, g.longitude, g.name,
       CASE WHEN t.city = g.city AND t.country = g.country THEN 0 ELSE levenshtein(t.name, g.name) END AS distance,
       t.city = g.city AND t.country = g.country AS same
FROM texts t JOIN entries g ON (t.city = g.city AND t.country = g.country)
  OR levenshtein(t.name, g.name) <= least(2, least(len(t.name), len(g.name)) // 4)"""),
    ("best", """SELECT city, country, latitude, longitude, CAST(distance AS BIGINT) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY city, country ORDER BY same DESC, distance, name, latitude, longitude) AS r FROM near)
WHERE r = 1""")]))
def q_geocode_similar(spark, sf):
    from litgraph.operators.placenames import geocode_similar
    df = geocode_similar(misspelled(placed(spark, sf)), fx.gazetteer(spark))
    return df.select("pubmedid", "author_pos", "city", "country", "latitude", "longitude",
                     F.col("place_distance").cast("bigint").alias("distance"))


def benchmark_terms(spark, sf):
    """Composed queries of the benchmark texts: every word is a concept; the word
    after it, and that word with the next, stand in for it as synonyms."""
    from litgraph.operators.search import expand_synonyms, tokenize
    texts = fx.table(spark, sf, "benchmark").select(F.col("text").alias("topic"), tokenize("text").alias("t"))
    after = texts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 2), lambda i: F.struct(
        F.get("t", i - 1).alias("term"), F.get("t", i).alias("one"), F.concat_ws(" ", F.get("t", i), F.get("t", i + 1)).alias("two")))).alias("x"))
    thesaurus = after.select("x.term", F.explode(F.array("x.one", "x.two")).alias("synonym"))
    return expand_synonyms(texts.select("topic").distinct(), thesaurus)


@query("search_query_table", fx.with_views(
    """SELECT topic, uid FROM hits JOIN sizes USING (topic) GROUP BY topic, uid, n HAVING count(DISTINCT word) = n""", [
        ("bench", f"SELECT DISTINCT text AS topic, {sql_tokens('text')} AS t FROM benchmark"),
        ("words", "SELECT DISTINCT topic, unnest(t) AS word FROM bench"),
        ("sizes", "SELECT topic, count(*) AS n FROM words GROUP BY topic"),
        ("thes", """SELECT DISTINCT t[i] AS word, t[i + 1] AS one, t[i + 2] AS two
FROM (SELECT t, unnest(range(1, len(t) - 1)) AS i FROM bench)"""),
        ("near", f"SELECT DISTINCT uid, unnest({sql_tokens(f'concat_ws({BLANK_SQL}, {BOTH})')}) AS w FROM papers"),
        ("far", f"""SELECT DISTINCT uid, t[i] AS w, t[i + 1] AS after
FROM (SELECT uid, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT uid, {sql_tokens(TEXT_ALL)} AS t FROM papers))"""),
        ("hits", """SELECT DISTINCT topic, word, uid FROM words JOIN near ON w = word
UNION SELECT topic, word, uid FROM words JOIN thes USING (word) JOIN far ON w = one
UNION SELECT topic, word, uid FROM words JOIN thes USING (word) JOIN far ON w = one AND after = two""")]))
def q_search_query_table(spark, sf):
    from litgraph.operators.querytable import search_query_table
    return search_query_table(fx.papers(spark, sf), benchmark_terms(spark, sf))


def order_topics(spark, sf):
    """A topic per order: the names of its parts, one after the other."""
    li = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    named = li.join(fx.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    lists = named.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name"))).alias("p"))
    return lists.select(F.array_join("p.p_name", ", ").alias("topic")).distinct()


def phrase_thesaurus(spark, sf):
    """Entries of two words (names of parts, also turned round) and of one."""
    part = fx.table(spark, sf, "part")
    one, two = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    return (part.select(F.col("p_name").alias("term"), F.col("p_type").alias("synonym"))
            .union(part.where("p_size < 10").select(F.concat(two, F.lit("  "), F.upper(one)), "p_brand"))
            .union(part.where("p_size > 40").select(one, F.concat(F.lit("very "), one)))).distinct()


PHRASE_SQL = [
    ("topics", """SELECT DISTINCT topic FROM (
  SELECT string_agg(p_name, ', ' ORDER BY l_linenumber, l_partkey, p_name) AS topic
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"""),
    ("thes", """SELECT DISTINCT lower(p_name) AS phrase, lower(p_type) AS synonym FROM part
UNION SELECT lower(split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)), lower(p_brand) FROM part WHERE p_size < 10
UNION SELECT lower(split_part(p_name, ' ', 1)), 'very ' || lower(split_part(p_name, ' ', 1)) FROM part WHERE p_size > 40"""),
    ("toks", f"SELECT topic, {sql_tokens('topic')} AS t FROM topics"),
    ("hits", """SELECT topic, i, n, array_to_string(t[i:i + n - 1], ' ') AS phrase
FROM toks, unnest(range(1, len(t) + 1)) AS a(i), (SELECT unnest([1, 2]) AS n)
WHERE i + n - 1 <= len(t) AND (n = 1 OR array_to_string(t[i:i + n - 1], ' ') IN (SELECT phrase FROM thes))"""),
    ("longest", "SELECT topic, i, max(n) AS n, arg_max(phrase, n) AS phrase FROM hits GROUP BY ALL"),
    ("walk", """SELECT topic, i, n, phrase FROM longest WHERE i = 1
UNION ALL SELECT l.topic, l.i, l.n, l.phrase FROM walk w JOIN longest l ON l.topic = w.topic AND l.i = w.i + w.n"""),
    ("concepts", """SELECT topic, phrase, row_number() OVER (PARTITION BY topic ORDER BY begins) AS concept_pos
FROM (SELECT topic, phrase, min(i) AS begins FROM walk GROUP BY ALL)"""),
    ("terms", """SELECT topic, concept_pos, phrase AS term, 'tiab' AS kind, 0 AS o FROM concepts
UNION ALL SELECT topic, concept_pos, synonym, 'all', 1 FROM concepts JOIN (SELECT DISTINCT phrase, synonym FROM thes) USING (phrase)
WHERE synonym <> phrase"""),
]


@query("expand_phrases", fx.with_views(
    "SELECT topic, concept_pos, row_number() OVER (PARTITION BY topic, concept_pos ORDER BY o, term) AS term_pos, term, kind "
    "FROM terms", PHRASE_SQL, recursive=True))
def q_expand_phrases(spark, sf):
    from litgraph.operators.search import expand_phrases
    df = expand_phrases(order_topics(spark, sf), phrase_thesaurus(spark, sf))
    return df.select("topic", *_bigint("concept_pos", "term_pos"), "term", "kind")
