"""Queries over transcripts and documents: sources, filters, cleaning and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.catalog import inputs
from callweave.functions import dates, nulls, text, vectors
from callweave.operators import relational
from callweave.plans import sentences as sentence_plan
from callweave.plans import summaries
from callweave.sources import transcripts

# small fixed list, so that the SQL side needs no Spark session
STOPWORDS = ["a", "an", "and", "de", "der", "die", "la", "le", "of", "question", "thank", "the", "to", "und", "welcome"]


def _components(spark: SparkSession, folder: str) -> DataFrame:
    rows = relational.without_role(inputs.components(spark, folder), "speakertypename", "SYSTEM")
    return transcripts.as_components(rows)


def sentence_split(spark, folder):
    rows = sentence_plan.sentences(_components(spark, folder), STOPWORDS)
    return rows.select("sentence_id", "firm_id", "speaker_type", "position", "raw_text", "cleaned_text")


def token_clean(spark, folder):
    words = text.content_tokens(F.col("text"), STOPWORDS)
    docs = inputs.texts(spark, folder, "documents").select("doc_id", words.alias("w"))
    return docs.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("cleaned_md5"))


def firm_transcript_meta(spark, folder):
    return sentence_plan.firm_metadata(_components(spark, folder), "2023-01-01", "2023-03-31")


def operator_filter_null_safe(spark, folder):
    rows = inputs.table(spark, folder, "conversations").withColumn("speaker", F.nullif("role", F.lit("assistant")))
    kept = relational.without_role(rows, "speaker", "System")
    return kept.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_kept"), F.count("speaker").alias("n_named"))


def date_range_inclusive(spark, folder):
    rows = relational.between_dates(inputs.table(spark, folder, "orders"), F.col("o_orderdate"), "1997-01-01", "1997-12-31")
    return rows.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_orders"), F.min("o_orderdate").cast("date").alias("first_date"),
        F.max("o_orderdate").cast("date").alias("last_date"), F.round(F.sum("o_totalprice"), 2).alias("total"),
    )


def firm_in_list(spark, folder):
    rows = relational.in_list(inputs.components(spark, folder), "companyid", ["1", "4"])
    return rows.groupBy("companyid", "companyname").agg(F.count(F.lit(1)).alias("n_components"))


class _Tables:
    """Connector over the given conversations."""

    def __init__(self, rows: DataFrame):
        self._rows = rows

    def fetch(self, firm_ids=None, start=None, end=None):
        return self._rows

    def firm_ids(self):
        return self._rows.select("companyid").distinct().orderBy("companyid")

    def close(self):
        pass


def limited_connector(spark, folder):
    connector = transcripts.LimitedConnector(_Tables(inputs.components(spark, folder)), first=3)
    return connector.fetch().groupBy("companyid").agg(F.count_distinct("transcriptid").alias("n_transcripts"))


def sorted_firm_ids(spark, folder):
    return _Tables(inputs.components(spark, folder)).firm_ids()


def firm_id_by_name(spark, folder):
    rows = inputs.components(spark, folder)
    return relational.by_name(rows, "companyname", "fIRM 3", ["companyid", "transcriptid"]).select("companyid", "companyname")


def name_formats(spark, folder):
    c = inputs.table(spark, folder, "customer")
    return c.select(
        "c_custkey",
        text.safe_name(F.col("c_name")).alias("safe_name"),
        text.safe_name(F.concat("c_mktsegment", F.lit(" / "), "c_name"), 12).alias("short_safe_name"),
        text.shorten(F.concat_ws(" ", "c_name", "c_mktsegment", "c_name", "c_mktsegment")).alias("shortened"),
        text.quarter_key(F.concat(F.lit("2023-q"), F.col("c_nationkey").cast("string"))).alias("quarter"),
        text.sentence_id(F.col("c_mktsegment"), F.col("c_nationkey").cast("string"), F.col("c_custkey")).alias("sentence_id"),
        F.concat_ws("#", F.lit("TOPIC"), "c_mktsegment", "c_nationkey").alias("composite_key"),
    )


def date_formats(spark, folder):
    o = inputs.table(spark, folder, "orders").withColumn("d", F.to_date("o_orderdate"))
    written = F.when(F.col("o_orderstatus") == "F", F.date_format("d", "MM/dd/yyyy")).when(
        F.col("o_orderstatus") == "O", F.date_format("d", "yyyy-MM-dd HH:mm:ss")
    ).otherwise(F.lit("not a date"))
    return o.select(
        "o_orderkey", dates.parse_date(written).alias("parsed"), dates.us_date(F.col("d")).alias("us_date"),
        dates.event_id(F.col("d"), F.col("o_custkey")).alias("event_id"), F.date_add("d", 120).alias("plus_120"),
        dates.theme_id(F.col("d"), F.pmod("o_custkey", F.lit(50))).alias("theme_id"),
        dates.utc_stamp(F.col("o_orderdate")).alias("stamp"),
    )


def json_props(spark, folder):
    e = inputs.table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))


def prompt_texts(spark, folder):
    """Topic prompt body: at most fifty sentences of each transcript turn as bullets."""
    c = inputs.table(spark, folder, "conversations")
    body = text.bullets(text.split_sentences(F.col("text")), 50)
    return c.select("conv_id", "turn", F.md5(body).alias("bullets_md5"), F.length(body).cast("long").alias("n_chars"))


def ngram_counts(spark, folder):
    words = text.content_tokens(F.col("text"), STOPWORDS)
    docs = inputs.texts(spark, folder, "documents").select("lang", words.alias("words"))
    grams = docs.select("lang", F.explode(text.ngrams(F.col("words"), 1, 2)).alias("term"))
    return grams.groupBy("lang").agg(F.count(F.lit(1)).alias("n_grams"), F.count_distinct("term").alias("n_terms"))


def map_default(spark, folder):
    """Names by language where known, a numbered name otherwise."""
    known = F.create_map(F.lit("en"), F.lit("English"), F.lit("fr"), F.lit("French"))
    docs = inputs.table(spark, folder, "documents")
    return docs.select("doc_id", nulls.map_get(known, F.col("lang"), F.concat(F.lit("Topic "), F.col("source"))).alias("name"))


def float_ids(spark, folder):
    """Ids that a frame reader turned into floats."""
    k = F.col("o_orderkey")
    as_read = F.concat(k.cast("string"), F.when(k % 3 == 0, ".0").when(k % 3 == 1, ".5").otherwise(""))
    return inputs.table(spark, folder, "orders").select("o_orderkey", text.whole_id(as_read).alias("transcript_id"))


def summary_fallback(spark, folder):
    """Empty and missing summaries give way to the representation."""
    d = inputs.table(spark, folder, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "en", F.lit("")).when(F.col("lang") == "de", F.col("source")).alias("summary"),
        F.concat_ws(", ", "lang", "source").alias("representation"),
    )
    return summaries.with_fallback(d, "summary", "representation").select("doc_id", "summary")


def entity_explode(spark, folder):
    o = inputs.table(spark, folder, "orders")
    found = F.create_map(
        F.lit("PRIORITY"), F.array(F.struct(F.col("o_orderpriority").alias("name"), F.lit(0.9).alias("confidence"))),
        F.lit("STATUS"),
        F.array(
            F.struct(F.col("o_orderstatus").alias("name"), F.lit(0.5).alias("confidence")),
            F.struct(F.lower("o_orderstatus").alias("name"), F.lit(0.25).alias("confidence")),
        ),
    )
    return summaries.entity_rows(o.select(F.col("o_orderkey").alias("sentence_id"), found.alias("entities")))


def row_shares(spark, folder):
    e = inputs.table(spark, folder, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: F.greatest(x.cast("double"), F.lit(0.0))).alias("v")
    )
    shares = e.select("vec_id", F.posexplode(vectors.row_shares(F.col("v"))).alias("place", "share"))
    return shares.select("vec_id", F.col("place").cast("long").alias("place"), F.round("share", 6).alias("share"))


def complete_rows(spark, folder):
    """Rows without NULL, NaN or infinite values."""
    l = inputs.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity",
        F.try_divide("l_extendedprice", F.when(F.col("l_discount") > 0, F.col("l_discount"))).alias("ratio"),
        F.ln(F.col("l_quantity") - 10).alias("log_quantity"),
    )
    kept = nulls.finite_rows(l)
    return kept.groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("ratio"), 4).alias("avg_ratio"),
        F.round(F.avg("log_quantity"), 6).alias("avg_log"),
    )


def significance_stars(spark, folder):
    l = inputs.table(spark, folder, "lineitem").select(text.stars(F.col("l_discount") * F.col("l_tax")).alias("stars"))
    return l.groupBy("stars").agg(F.count(F.lit(1)).alias("n"))


def key_value_items(spark, folder):
    from callweave.sinks import writers

    c = inputs.table(spark, folder, "customer")
    items = writers.key_value_sentences(
        c.select(
            F.col("c_mktsegment").alias("firm_id"), F.col("c_nationkey").alias("topic_id"),
            F.col("c_custkey").alias("sentence_id"), F.col("c_name").alias("raw_text"),
        )
    )
    n = inputs.table(spark, folder, "nation")
    r = inputs.table(spark, folder, "region")
    themes = r.select(
        F.col("r_regionkey").alias("theme_id"), F.col("r_name").alias("name"), F.split("r_name", "").alias("keywords"),
        F.lit(1).alias("n_firms"), F.lit(1).alias("n_topics"),
    )
    topics = n.select(
        F.col("n_regionkey").alias("theme_id"), F.col("n_nationkey").alias("topic_id"), F.lit("x").alias("firm_id"),
        F.col("n_name").alias("representation"), F.lit(1).alias("size"),
    )
    meta = writers.key_value_themes(themes, topics)
    return items.select("pk", "sk", "firm_key", F.col("text").alias("body")).unionByName(
        meta.select("pk", "sk", F.lit(None).cast("string").alias("firm_key"), F.coalesce("name", "representation").alias("body"))
    )


def merged_frames(spark, folder):
    """Concatenation by column name; a column only one side has is NULL on the other."""
    c = inputs.table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.lit("c").alias("side"))
    s = inputs.table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("s").alias("side"))
    both = c.unionByName(s, allowMissingColumns=True)
    return both.groupBy("nation", "side").agg(F.count(F.lit(1)).alias("n"), F.count("balance").alias("n_balance"))


QUERIES = {
    f.__name__: f
    for f in (
        sentence_split, token_clean, firm_transcript_meta, operator_filter_null_safe, date_range_inclusive,
        firm_in_list, limited_connector, sorted_firm_ids, firm_id_by_name, name_formats, date_formats, json_props,
        prompt_texts, ngram_counts, float_ids, map_default, summary_fallback, entity_explode, row_shares, complete_rows,
        significance_stars, key_value_items, merged_frames,
    )
}

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _all_tokens(expression: str) -> str:
    """SQL for the tokens of a text."""
    return f"""list_filter(
        list_transform(regexp_split_to_array(lower({expression}), '\\s+'),
                       lambda w: regexp_replace(w, '{text.EDGE_PUNCTUATION}', '', 'g')),
        lambda w: w <> '')"""


def _tokens(expression: str) -> str:
    """SQL for the tokens that are neither stop words nor number-like."""
    return f"""list_filter({_all_tokens(expression)},
        lambda w: NOT regexp_matches(w, '{text.NUMERIC_TOKEN}') AND NOT list_contains({_STOP}, w))"""


def _sentences(expression: str) -> str:
    return f"""list_filter(
        list_transform(string_split(regexp_replace({expression}, '{text.SENTENCE_END}', '\\1' || chr(1), 'g'), chr(1)),
                       lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')),
        lambda s: s <> '')"""


_COMPONENTS = """comps AS (
    SELECT CAST(conv_id % 7 AS VARCHAR) AS companyid, 'Firm ' || (conv_id % 7) AS companyname,
           CAST(conv_id AS VARCHAR) AS transcriptid, CAST(turn AS INT) AS componentorder, role, text
    FROM conversations)"""

ORACLE = {
    "sentence_split": f"""
        WITH {_COMPONENTS}, pieces AS (
            SELECT companyid, transcriptid, componentorder, role, {_sentences("text")} AS s
            FROM comps WHERE lower(role) IS DISTINCT FROM 'system' AND trim(text) <> ''),
        each AS (
            SELECT companyid, transcriptid, componentorder, role, unnest(s) AS raw, generate_subscripts(s, 1) AS i FROM pieces),
        cleaned AS (SELECT *, {_tokens("raw")} AS w FROM each),
        kept AS (
            SELECT *, row_number() OVER (PARTITION BY companyid ORDER BY TRY_CAST(transcriptid AS BIGINT) NULLS LAST, transcriptid, componentorder, i) - 1 AS position
            FROM cleaned WHERE len(w) > 1)
        SELECT companyid || '_' || transcriptid || '_' || printf('%04d', position) AS sentence_id, companyid AS firm_id,
               role AS speaker_type, position, raw AS raw_text, array_to_string(w, ' ') AS cleaned_text
        FROM kept""",
    "token_clean": f"""
        SELECT doc_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS cleaned_md5
        FROM (SELECT doc_id, {_tokens("text")} AS w FROM documents)""",
    "firm_transcript_meta": f"""
        WITH {_COMPONENTS}
        SELECT companyid AS firm_id, min(companyname) AS firm_name, count(DISTINCT transcriptid) AS n_transcripts,
               count(*) AS n_components, '2023-01-01 to 2023-03-31' AS date_range
        FROM comps WHERE role <> 'system' AND trim(text) <> '' GROUP BY 1""",
    "operator_filter_null_safe": """
        SELECT conv_id, count(*) AS n_kept, count(speaker) AS n_named
        FROM (SELECT conv_id, nullif(role, 'assistant') AS speaker FROM conversations)
        WHERE speaker IS DISTINCT FROM 'system' GROUP BY 1""",
    "date_range_inclusive": """
        SELECT o_orderstatus, count(*) AS n_orders, CAST(min(o_orderdate) AS DATE) AS first_date,
               CAST(max(o_orderdate) AS DATE) AS last_date, round(sum(o_totalprice), 2) AS total
        FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31' GROUP BY 1""",
    "firm_in_list": f"""
        WITH {_COMPONENTS}
        SELECT companyid, companyname, count(*) AS n_components FROM comps WHERE companyid IN ('1', '4') GROUP BY 1, 2""",
    "limited_connector": f"""
        WITH {_COMPONENTS}, first AS (SELECT DISTINCT companyid FROM comps ORDER BY 1 LIMIT 3)
        SELECT companyid, count(DISTINCT transcriptid) AS n_transcripts FROM comps
        WHERE companyid IN (SELECT companyid FROM first) GROUP BY 1""",
    "sorted_firm_ids": f"WITH {_COMPONENTS} SELECT DISTINCT companyid FROM comps ORDER BY 1",
    "firm_id_by_name": f"""
        WITH {_COMPONENTS} SELECT companyid, companyname FROM comps WHERE lower(companyname) = 'firm 3'
        ORDER BY companyid, transcriptid LIMIT 1""",
    "name_formats": """
        SELECT c_custkey, regexp_replace(c_name, '[^\\p{L}\\p{N}]', '_', 'g') AS safe_name,
               regexp_replace(substring(c_mktsegment || ' / ' || c_name, 1, 12), '[^\\p{L}\\p{N}]', '_', 'g') AS short_safe_name,
               CASE WHEN length(n) > 50 THEN substring(n, 1, 47) || '...' ELSE n END AS shortened,
               upper(replace('2023-q' || c_nationkey, '-', '')) AS quarter,
               c_mktsegment || '_' || c_nationkey || '_' || printf('%04d', c_custkey) AS sentence_id,
               'TOPIC#' || c_mktsegment || '#' || c_nationkey AS composite_key
        FROM (SELECT *, c_name || ' ' || c_mktsegment || ' ' || c_name || ' ' || c_mktsegment AS n FROM customer)""",
    "date_formats": """
        SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN d END AS parsed, strftime(d, '%m/%d/%Y') AS us_date,
               upper(strftime(d, '%d%b%Y')) || o_custkey AS event_id, CAST(d + INTERVAL 120 DAY AS DATE) AS plus_120,
               'theme_' || strftime(d, '%Y%m%d') || '_' || printf('%03d', o_custkey % 50) AS theme_id,
               strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') AS stamp
        FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)""",
    "json_props": """
        SELECT CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n, round(avg(value), 6) AS avg_value
        FROM events GROUP BY 1""",
    "prompt_texts": f"""
        SELECT conv_id, turn, md5(b) AS bullets_md5, length(b) AS n_chars
        FROM (SELECT conv_id, turn,
                     array_to_string(list_transform(({_sentences("text")})[1:50], lambda s: '- ' || s), chr(10)) AS b
              FROM conversations)""",
    "ngram_counts": f"""
        WITH words AS (SELECT lang, {_tokens("text")} AS w FROM documents),
        grams AS (
            SELECT lang, unnest(w) AS term FROM words
            UNION ALL
            SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words)
        SELECT lang, count(*) AS n_grams, count(DISTINCT term) AS n_terms FROM grams GROUP BY 1""",
    "map_default": """
        SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE 'Topic ' || source END AS name FROM documents""",
    "float_ids": """
        SELECT o_orderkey, o_orderkey || CASE WHEN o_orderkey % 3 = 1 THEN '.5' ELSE '' END AS transcript_id FROM orders""",
    "summary_fallback": """
        SELECT doc_id, coalesce(CASE WHEN lang = 'de' THEN source END, lang || ', ' || source) AS summary FROM documents""",
    "entity_explode": """
        SELECT o_orderkey AS sentence_id, 'PRIORITY' AS entity_type, o_orderpriority AS "value", CAST(0.9 AS DOUBLE) AS confidence FROM orders
        UNION ALL SELECT o_orderkey, 'STATUS', o_orderstatus, CAST(0.5 AS DOUBLE) FROM orders
        UNION ALL SELECT o_orderkey, 'STATUS', lower(o_orderstatus), CAST(0.25 AS DOUBLE) FROM orders""",
    "row_shares": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: greatest(CAST(x AS DOUBLE), 0.0)) AS v FROM embeddings)
        SELECT vec_id, unnest(range(0, len(v)))::BIGINT AS place,
               round(unnest(list_transform(v, lambda x: CASE WHEN list_sum(v) = 0 THEN 1.0 / len(v) ELSE x / list_sum(v) END)), 6) AS share
        FROM v""",
    "complete_rows": """
        SELECT l_linenumber, count(*) AS n, round(avg(l_extendedprice / l_discount), 4) AS avg_ratio,
               round(avg(ln(l_quantity - 10)), 6) AS avg_log
        FROM (SELECT * FROM lineitem WHERE l_discount > 0 AND l_quantity > 10) GROUP BY 1""",
    "significance_stars": """
        SELECT CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars, count(*) AS n
        FROM (SELECT l_discount * l_tax AS p FROM lineitem) GROUP BY 1""",
    "key_value_items": """
        SELECT 'TOPIC#' || c_mktsegment || '#' || c_nationkey AS pk, 'SENTENCE#' || c_custkey AS sk,
               'FIRM#' || c_mktsegment AS firm_key, c_name AS body FROM customer
        UNION ALL SELECT 'THEME#' || r_regionkey, 'METADATA', NULL, r_name FROM region
        UNION ALL SELECT 'THEME#' || n_regionkey, 'TOPIC#x#' || n_nationkey, NULL, n_name FROM nation""",
    "merged_frames": """
        SELECT nation, side, count(*) AS n, count(balance) AS n_balance
        FROM (SELECT c_nationkey AS nation, c_acctbal AS balance, 'c' AS side FROM customer
              UNION ALL SELECT s_nationkey, NULL, 's' FROM supplier) GROUP BY 1, 2""",
}
