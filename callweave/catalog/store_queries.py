"""Queries over the stored hierarchy, its joins, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.catalog import inputs
from callweave.operators import relational, scan
from callweave.operators.asof import asof_join
from callweave.operators.intervals import interval_join
from callweave.plans import export, store
from callweave.streaming import resume


def _hierarchy(spark, folder):
    return store.hierarchy(*_tables(spark, folder))


def _tables(spark, folder):
    """Regions as themes, nations as topics and firms, customers as sentences."""
    nation = inputs.table(spark, folder, "nation")
    themes = inputs.table(spark, folder, "region").select(
        F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name")
    )
    topics = nation.select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("theme_id"),
        F.col("n_nationkey").cast("long").alias("firm_id"), F.col("n_name").alias("representation"),
        F.lit("").alias("summary"),
    )
    firms = nation.select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"),
        F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("company_id"),
        F.substring("n_name", 1, 3).alias("ticker"),
        F.date_add(F.lit("2023-01-01").cast("date"), F.col("n_nationkey")).alias("earnings_call_date"),
    )
    sentences = inputs.table(spark, folder, "customer").select(
        F.col("c_nationkey").cast("long").alias("topic_id"), F.col("c_custkey").alias("id"),
        F.col("c_name").alias("raw_text"), F.col("c_mktsegment").alias("speaker_type"),
        F.col("c_custkey").alias("position"),
    )
    return themes, topics, sentences, firms


def hierarchy_flat(spark, folder):
    return _hierarchy(spark, folder).select(
        "theme_id", "theme_name", "topic_id", "representation", "firm_name", "sentence_id", "raw_text", "position"
    )


def hierarchy_nested(spark, folder):
    """With a topic without sentences beside every topic, and a theme without topics beside every theme."""
    themes, topics, sentences, firms = _tables(spark, folder)
    themes = themes.unionByName(themes.withColumns({"id": F.col("id") + 100, "name": F.lower("name")}))
    topics = topics.unionByName(topics.withColumns({"id": F.col("id") + 100, "representation": F.lower("representation")}))
    nested = store.nested_topics(themes, topics, sentences, firms)
    ids = F.transform("sentences", lambda s: s["sentence_id"].cast("string"))
    return nested.select("theme_name", "representation", "part", F.array_join(ids, ",").alias("sentence_ids"))


def firm_topic_summary(spark, folder):
    """Nations as firms, their customers as topics, the customers' orders as sentences."""
    firms = inputs.table(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    topics = inputs.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("firm_id"), F.col("c_name").alias("representation")
    )
    sentences = inputs.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("topic_id"))
    found = store.firm_summary(firms, topics, sentences)
    lines = F.transform("topics", lambda t: F.concat_ws(":", t["id"].cast("string"), t["representation"], t["n_sentences"].cast("string")))
    return found.select("name", "part", "n_topics", "n_sentences", F.md5(F.array_join(lines, ",")).alias("topics_md5"))


def export_contributions(spark, folder):
    names = inputs.table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("long").alias("permno"), F.substring("n_name", 1, 3).alias("ticker"),
        F.lit("2022-06-30").cast("date").alias("namedt"),
        F.when(F.col("n_nationkey") < 10, F.lit("2023-01-05").cast("date")).alias("nameendt"),
    )
    parts = export.contributions(_hierarchy(spark, folder), names)
    lines = F.transform("sentences", lambda s: F.concat_ws(":", s["speaker"], s["text"]))
    return parts.select(
        "theme_id", "theme_name", "firm_id", "firm_name", "permno", "earnings_call_date", "part",
        F.md5(F.array_join(lines, "|")).alias("sentences_md5"),
    )


def firm_theme_distinct(spark, folder):
    orders = inputs.table(spark, folder, "orders")
    number = F.substring("o_orderpriority", 1, 1).cast("long")
    topics = orders.select(F.col("o_custkey").alias("firm_id"), number.alias("theme_id"))
    themes = orders.select(number.alias("id"), F.col("o_orderpriority").alias("name")).distinct()
    firms = inputs.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return store.firm_themes(firms, topics, themes)


def sentences_by_speaker(spark, folder):
    """Sentences of one speaker type by position."""
    flat = _hierarchy(spark, folder).withColumnRenamed("sentence_id", "id")
    return store.by_speaker(flat, "BUILDING").select(F.col("id").alias("sentence_id"), "position", "raw_text")


def processed_firms(spark, folder):
    """Parts by whether they were ever shipped late enough to carry a date."""
    part = inputs.table(spark, folder, "part").select("p_partkey", "p_type")
    late = F.when(F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp"), F.col("l_shipdate"))
    shipped = inputs.table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.max(late).alias("processed_at"))
    firms = part.join(shipped, F.col("p_partkey") == F.col("l_partkey"), "left")
    by_state = {s: store.in_state(firms, s == "processed").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")) for s in ("processed", "unprocessed")}
    rows = [found.select("p_type", F.lit(s).alias("state"), "n") for s, found in by_state.items()]
    return rows[0].unionByName(rows[1])


def left_count(spark, folder):
    customer = inputs.table(spark, folder, "customer").select("c_custkey", "c_name")
    return relational.count_children(customer, inputs.table(spark, folder, "orders"), "c_custkey", "o_custkey", "n_orders")


def coverage_pct(spark, folder):
    docs = inputs.table(spark, folder, "documents").select("doc_id")
    joined = docs.join(inputs.table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left")
    return store.coverage(joined, "quality")


def topic_coverage(spark, folder):
    topics = inputs.table(spark, folder, "part").select(F.col("p_partkey").alias("id"), "p_name")
    sentences = inputs.table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("topic_id"), F.col("l_discount").alias("probability")
    )
    return store.topic_coverage(topics, sentences)


def ilike_distinct_count(spark, folder):
    part = inputs.table(spark, folder, "part").filter(F.col("p_name").ilike("%RED%"))
    return part.groupBy("p_type").agg(F.count_distinct("p_brand").alias("n_brands"))


def orphan_anti_join(spark, folder):
    customer = inputs.table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    pending = F.when(F.col("o_orderstatus") == "P", F.col("o_custkey"))
    used = inputs.table(spark, folder, "orders").select(pending.alias("key"))
    return relational.missing_from(customer, used, ["key"])


def orphan_checks(spark, folder):
    """Children without parent and rows without link, counted."""
    lines = inputs.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("key"))
    orders = inputs.table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"))
    docs = inputs.table(spark, folder, "documents").join(inputs.table(spark, folder, "labels"), "doc_id", "left")
    lost = relational.missing_from(lines, orders, ["key"]).agg(F.count(F.lit(1)).alias("n"))
    unlabelled = docs.filter(F.col("quality").isNull()).agg(F.count(F.lit(1)).alias("n"))
    return lost.select(F.lit("lines without order").alias("check"), "n").unionByName(
        unlabelled.select(F.lit("documents without label").alias("check"), "n")
    )


def top_k_groups(spark, folder):
    totals = inputs.table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    return totals.orderBy(F.desc("n_orders"), "o_custkey").limit(10)


def top_k_per_group(spark, folder):
    orders = inputs.table(spark, folder, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return scan.top_k(orders, ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5)


def pivot_fill_zero(spark, folder):
    rows = inputs.table(spark, folder, "lineitem").select("l_linenumber", "l_returnflag", "l_quantity")
    return relational.pivot_sum(rows, "l_linenumber", "l_returnflag", ["A", "N", "R", "X"], "l_quantity")


def median_by_group(spark, folder):
    events = inputs.table(spark, folder, "events").select("event_type", "value")
    found = scan.quantiles(events, ["event_type"], "value", {"median": 0.5, "q33": 0.33, "q67": 0.67})
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in ("median", "q33", "q67")])


def table_counts(spark, folder):
    one = F.count(F.lit(1))
    docs = inputs.table(spark, folder, "documents")
    counts = docs.agg(
        one.alias("n_documents"), F.count_distinct("source").alias("n_sources"), F.min("n_chars").alias("min_chars"),
        F.max("n_chars").alias("max_chars"), F.round(F.avg("n_chars"), 4).alias("avg_chars"),
    )
    labels = inputs.table(spark, folder, "labels")
    return counts.withColumns(
        {"n_labels": labels.agg(one).scalar(), "n_events": inputs.table(spark, folder, "events").agg(one).scalar()}
    )


def upsert_new(spark, folder):
    docs = inputs.table(spark, folder, "documents").select("doc_id", "source")
    known = inputs.table(spark, folder, "labels").select("doc_id")
    return relational.upsert_new(known, docs, ["doc_id"], [F.col("source")])


def resume_point(spark, folder):
    customer = inputs.table(spark, folder, "customer").select(F.col("c_custkey").alias("key"))
    pending = F.when(F.col("o_orderstatus") == "P", F.col("o_custkey"))
    done = inputs.table(spark, folder, "orders").select(pending.alias("key"))
    return resume.resume_index(customer, done, "key", "key")


def pending_firms(spark, folder):
    docs = inputs.table(spark, folder, "documents").select("doc_id", "source")
    return resume.pending(docs, inputs.table(spark, folder, "labels"), "doc_id")


def duplicate_groups(spark, folder):
    rows = inputs.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    return relational.duplicates(rows, ["l_orderkey", "l_linenumber"]).withColumnRenamed("count", "n")


def latest_per_key(spark, folder):
    orders = inputs.table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    newest = relational.latest_per_key(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return newest.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("order_date"), "o_totalprice")


def _order_spans(spark, folder):
    orders = inputs.table(spark, folder, "orders")
    start = F.to_date("o_orderdate")
    return orders.select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", start.alias("valid_from"),
        F.when(F.col("o_orderstatus") != "O", F.date_add(start, 90)).alias("valid_to"),
    )


def _shipments(spark, folder):
    return inputs.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", F.to_date("l_shipdate").alias("ship_date")
    )


def interval_join_inner(spark, folder):
    met = interval_join(_shipments(spark, folder), _order_spans(spark, folder), ["l_orderkey"], "ship_date", "valid_from", "valid_to")
    return met.select("l_orderkey", "l_linenumber", "l_quantity", "ship_date", "o_custkey")


def interval_join_left(spark, folder):
    met = interval_join(
        _shipments(spark, folder), _order_spans(spark, folder), ["l_orderkey"], "ship_date", "valid_from", "valid_to", how="left"
    )
    return met.groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count("o_custkey").alias("n_matched"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


def _asof(spark, folder, **options):
    orders = inputs.table(spark, folder, "orders").withColumn("order_date", F.to_date("o_orderdate"))
    left = orders.select("o_orderkey", "o_custkey", "order_date")
    # rows without a date never match
    right = orders.select(
        "o_custkey", F.when(F.col("o_orderstatus") == "F", F.col("order_date")).alias("f_date"), F.col("o_orderkey").alias("f_key"), F.col("o_totalprice").alias("f_price")
    )
    take = {"f_date": "match_date", "f_price": "match_price"}
    return asof_join(left, right, ["o_custkey"], "order_date", "f_date", take, tie=["f_key"], **options)


def asof_tolerance(spark, folder):
    return _asof(spark, folder, within_days=365)


def asof_strict(spark, folder):
    return _asof(spark, folder, strict=True)


def asof_forward(spark, folder):
    return _asof(spark, folder, direction="forward")


def _name_records(spark, folder):
    """Per event type and user the days it is active, as name records."""
    day = F.to_date("ts")
    return inputs.table(spark, folder, "events").groupBy(F.col("event_type").alias("ticker"), F.col("user_id").alias("permno")).agg(
        F.min(day).alias("namedt"), F.date_sub(F.max(day), 3).alias("nameendt")
    )


def _lookups(spark, folder):
    return inputs.table(spark, folder, "events").select(F.initcap("event_type").alias("ticker"), F.to_date("ts").alias("date"))


def permno_lookup(spark, folder):
    return store.upper_ticker_permno(_lookups(spark, folder), _name_records(spark, folder))


def permno_batch_lookup(spark, folder):
    return store.ticker_permno(_lookups(spark, folder), _name_records(spark, folder))


def backfilled_dates(spark, folder):
    quarter = F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate"))
    orders = inputs.table(spark, folder, "orders")
    reports = orders.select(
        F.lower("o_orderpriority").alias("tic"), quarter.alias("datacqtr"),
        F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("rdq"),
    )
    firms = orders.select(
        "o_orderkey", F.col("o_orderpriority").alias("ticker"),
        F.concat(F.year("o_orderdate") - 1, F.lit("-q"), F.quarter("o_orderdate")).alias("quarter"),
        F.when(F.col("o_orderstatus") == "P", F.to_date("o_orderdate")).alias("earnings_call_date"),
    )
    return store.backfilled_dates(firms, reports).select("o_orderkey", "earnings_call_date")


QUERIES = {
    f.__name__: f
    for f in (
        hierarchy_flat, firm_topic_summary, sentences_by_speaker, processed_firms, hierarchy_nested, export_contributions, firm_theme_distinct, left_count, coverage_pct,
        topic_coverage, ilike_distinct_count, orphan_anti_join, orphan_checks, top_k_groups, top_k_per_group,
        pivot_fill_zero, median_by_group, table_counts, upsert_new, resume_point, pending_firms, duplicate_groups,
        latest_per_key, interval_join_inner, interval_join_left, asof_tolerance, asof_strict, asof_forward,
        permno_lookup, permno_batch_lookup, backfilled_dates,
    )
}


def _asof_sql(condition: str, order: str = "DESC") -> str:
    return f"""
        WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders),
        f AS (
            SELECT o_custkey, d, arg_max(o_totalprice, o_orderkey) AS price FROM o WHERE o_orderstatus = 'F' GROUP BY 1, 2),
        m AS (
            SELECT o.o_orderkey, f.d AS match_date, f.price AS match_price,
                   row_number() OVER (PARTITION BY o.o_orderkey ORDER BY f.d {order}) AS rn
            FROM o JOIN f ON o.o_custkey = f.o_custkey AND {condition})
        SELECT o.o_orderkey, o.o_custkey, o.d AS order_date, m.match_date, m.match_price
        FROM o LEFT JOIN m ON o.o_orderkey = m.o_orderkey AND m.rn = 1"""


_NAMES = """names AS (
    SELECT upper(event_type) AS ticker, user_id AS permno, min(CAST(ts AS DATE)) AS namedt,
           CAST(max(CAST(ts AS DATE)) - INTERVAL 3 DAY AS DATE) AS nameendt
    FROM events GROUP BY 1, 2),
    asked AS (SELECT DISTINCT upper(event_type) AS ticker, CAST(ts AS DATE) AS date FROM events)"""
_SPANS = """spans AS (
    SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS valid_from,
           CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate + INTERVAL 90 DAY AS DATE) ELSE DATE '9999-12-31' END AS valid_to
    FROM orders)"""

ORACLE = {
    "hierarchy_flat": """
        SELECT CAST(r_regionkey AS BIGINT) AS theme_id, r_name AS theme_name, CAST(n_nationkey AS BIGINT) AS topic_id,
               n_name AS representation, n_name AS firm_name, c_custkey AS sentence_id, c_name AS raw_text, c_custkey AS position
        FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey""",
    "sentences_by_speaker": """
        SELECT c_custkey AS sentence_id, c_custkey AS position, c_name AS raw_text FROM customer
        WHERE c_mktsegment = 'BUILDING'""",
    "processed_firms": """
        SELECT p_type, CASE WHEN s.l_partkey IS NULL THEN 'unprocessed' ELSE 'processed' END AS state, count(*) AS n
        FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01') s ON s.l_partkey = p_partkey
        GROUP BY 1, 2""",
    "hierarchy_nested": """
        SELECT r_name AS theme_name, n_name AS representation, (rn - 1) // 10000 AS part,
               coalesce(string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey), '') AS sentence_ids
        FROM (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS rn
              FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey)
        GROUP BY 1, 2, 3
        UNION ALL SELECT r_name, lower(n_name), 0, '' FROM region JOIN nation ON n_regionkey = r_regionkey
        UNION ALL SELECT lower(r_name), NULL, 0, '' FROM region
        UNION ALL SELECT r_name, NULL, 0, '' FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation)""",
    "firm_topic_summary": """
        WITH t AS (
            SELECT c_nationkey, c_custkey, c_name, count(o_orderkey) AS n,
                   row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn
            FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3),
        whole AS (SELECT c_nationkey, count(*) AS topics, CAST(sum(n) AS BIGINT) AS sentences FROM t GROUP BY 1)
        SELECT n_name AS name, coalesce((rn - 1) // 10000, 0) AS part, coalesce(any_value(topics), 0) AS n_topics,
               coalesce(any_value(sentences), 0) AS n_sentences,
               md5(coalesce(string_agg(c_custkey || ':' || c_name || ':' || n, ',' ORDER BY c_custkey), '')) AS topics_md5
        FROM nation LEFT JOIN t ON t.c_nationkey = n_nationkey LEFT JOIN whole ON whole.c_nationkey = n_nationkey GROUP BY 1, 2""",
    "export_contributions": """
        SELECT printf('theme_%03d', r_regionkey) AS theme_id, r_name AS theme_name, 'C' || n_nationkey AS firm_id, n_name AS firm_name,
               (SELECT CAST(x.n_nationkey AS BIGINT) FROM nation x
                WHERE upper(substring(x.n_name, 1, 3)) = upper(substring(n.n_name, 1, 3))
                  AND (x.n_nationkey >= 10 OR DATE '2023-01-01' + CAST(n.n_nationkey AS INT) <= DATE '2023-01-05')
                ORDER BY x.n_nationkey DESC LIMIT 1) AS permno,
               strftime(DATE '2023-01-01' + CAST(n_nationkey AS INT), '%Y-%m-%d') AS earnings_call_date, (rn - 1) // 10000 AS part,
               md5(string_agg(c_mktsegment || ':' || c_name, '|' ORDER BY c_custkey)) AS sentences_md5
        FROM (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS rn
              FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey) n
        GROUP BY r_regionkey, r_name, n_nationkey, n_name, (rn - 1) // 10000""",
    "firm_theme_distinct": """
        SELECT DISTINCT c_name AS firm_name, o_orderpriority AS theme_name FROM orders JOIN customer ON o_custkey = c_custkey""",
    "left_count": """
        SELECT c_custkey, c_name, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""",
    "coverage_pct": """
        SELECT count(*) AS total, count(quality) AS with_vector, round(100.0 * count(quality)::DOUBLE / count(*), 2) AS coverage_pct
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "topic_coverage": """
        SELECT p_partkey AS id, p_name, round(avg(l_discount), 3) AS avg_probability, count(l_orderkey) AS sentence_count
        FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2""",
    "ilike_distinct_count": "SELECT p_type, count(DISTINCT p_brand) AS n_brands FROM part WHERE p_name ILIKE '%RED%' GROUP BY 1",
    "orphan_anti_join": """
        SELECT c_custkey AS key, c_name FROM customer 
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""",
    "orphan_checks": """
        SELECT 'lines without order' AS "check", count(*) AS n FROM lineitem
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
        UNION ALL
        SELECT 'documents without label', count(*) FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL""",
    "top_k_groups": "SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "top_k_per_group": """
        SELECT * FROM (
            SELECT o_orderpriority, o_orderkey, o_totalprice,
                   row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
        WHERE rank <= 5""",
    "pivot_fill_zero": """
        SELECT l_linenumber,
               coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS "A", coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) AS "N",
               coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS "R", coalesce(sum(l_quantity) FILTER (l_returnflag = 'X'), 0) AS "X"
        FROM lineitem GROUP BY 1""",
    "median_by_group": """
        SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.33), 6) AS q33,
               round(quantile_cont(value, 0.67), 6) AS q67 FROM events GROUP BY 1""",
    "table_counts": """
        SELECT count(*) AS n_documents, count(DISTINCT source) AS n_sources, min(n_chars) AS min_chars, max(n_chars) AS max_chars,
               round(avg(n_chars), 4) AS avg_chars, (SELECT count(*) FROM labels) AS n_labels, (SELECT count(*) FROM events) AS n_events
        FROM documents""",
    "upsert_new": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "resume_point": """
        SELECT coalesce(min(i), (SELECT count(*) FROM customer)) AS resume_index
        FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer)
        WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
    "pending_firms": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "duplicate_groups": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "latest_per_key": """
        SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS order_date, o_totalprice FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "interval_join_inner": f"""
        WITH {_SPANS}
        SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_shipdate AS DATE) AS ship_date, o_custkey
        FROM lineitem JOIN spans ON l_orderkey = o_orderkey AND CAST(l_shipdate AS DATE) BETWEEN valid_from AND valid_to""",
    "interval_join_left": f"""
        WITH {_SPANS}
        SELECT l_linenumber, count(*) AS n_lines, count(o_custkey) AS n_matched, round(sum(l_quantity), 2) AS quantity
        FROM lineitem LEFT JOIN spans ON l_orderkey = o_orderkey AND CAST(l_shipdate AS DATE) BETWEEN valid_from AND valid_to
        GROUP BY 1""",
    "asof_tolerance": _asof_sql("f.d <= o.d AND f.d >= o.d - 365"),
    "asof_strict": _asof_sql("f.d < o.d"),
    "asof_forward": _asof_sql("f.d >= o.d", "ASC"),
    "permno_lookup": f"""
        WITH {_NAMES},
        best AS (
            SELECT ticker, date, arg_max(permno, (namedt, permno)) AS permno
            FROM asked JOIN names USING (ticker) WHERE date BETWEEN namedt AND nameendt GROUP BY 1, 2)
        SELECT ticker, date, permno FROM asked LEFT JOIN best USING (ticker, date)""",
    "permno_batch_lookup": f"""
        WITH {_NAMES}
        SELECT ticker, arg_max(permno, (namedt, permno)) AS permno
        FROM asked JOIN names USING (ticker) WHERE date BETWEEN namedt AND nameendt GROUP BY 1""",
    "backfilled_dates": """
        WITH reports AS (
            SELECT upper(o_orderpriority) AS tic, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS q, max(CAST(o_orderdate AS DATE)) AS rdq
            FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2)
        SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderdate AS DATE) END, rdq) AS earnings_call_date
        FROM orders LEFT JOIN reports ON tic = upper(o_orderpriority) AND q = (year(o_orderdate) - 1) || 'Q' || quarter(o_orderdate)""",
}
