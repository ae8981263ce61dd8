"""Sources, store, upstream run, export, sinks and the command line."""

from __future__ import annotations

import json
from datetime import date

import pytest
from market_fixture import DAYS, EVENT, build, frames
from pyspark.sql import functions as F

from callweave import cli
from callweave.functions import nulls, text
from callweave.operators import relational
from callweave.plans import charts, export, sentiment, store, summaries, upstream
from callweave.sinks import writers
from callweave.sources import documents, market, transcripts

CSV = '''companyid,companyname,transcriptid,componenttext,componentorder,mostimportantdateutc,speakertypename
1001,Apple Inc.,T001,"Revenue grew strongly, again.
Services set a record ""ever"".",1,2023-01-15,CEO
1001,Apple Inc.,T001,Next question please operator.,2,2023-01-15,OPERATOR
1001,Apple Inc.,T001,Margins improved across regions.,3,2023-01-15,
1002,Beta Corp,12.0,Supply chain costs declined slightly.,1,2023-01-15 14:00:00,CFO
1003,Gamma,,Lost transcript id here.,1,2023-01-15,CFO
1003,Gamma,T003,   ,2,2023-01-15,CFO
1004,Delta,T004,Outlook remains weak this year.,1,someday,CFO
'''


@pytest.fixture
def csv_path(tmp_path):
    path = tmp_path / "transcripts.csv"
    path.write_text(CSV)
    return str(path)


def test_csv_source(spark, csv_path):
    source = transcripts.TranscriptCsv(spark, csv_path)
    assert [r.companyid for r in source.firm_ids().collect()] == ["1001", "1002", "1003", "1004"]
    assert source.firm_id_by_name("bETA corp") == "1002" and source.firm_id_by_name("nobody") is None
    rows = source.fetch(["1001", 1002], "2023-01-01", "2023-01-15").collect()
    # the end is midnight, so the 14:00 row is out; the operator is out, the row without a role stays
    assert sorted((r.companyid, r.componentorder) for r in rows) == [("1001", 1), ("1001", 3)]
    assert 'record "ever"' in next(r.componenttext for r in rows if r.componentorder == 1)
    comps = transcripts.as_components(source.fetch()).collect()
    assert {(r.firm_id, r.transcript_id) for r in comps} == {("1001", "T001"), ("1002", "12"), ("1004", "T004")}
    with pytest.raises(FileNotFoundError):
        transcripts.TranscriptCsv(spark, "/nowhere.csv")


def test_limited_connectors(spark, csv_path):
    source = transcripts.TranscriptCsv(spark, csv_path)
    first = transcripts.LimitedConnector(source, first=2)
    assert [r.companyid for r in first.firm_ids().collect()] == ["1001", "1002"]
    chosen = transcripts.LimitedConnector(source, ids=["1004"])
    assert {r.companyid for r in chosen.fetch().collect()} == {"1004"}
    first.close()


def test_optional_columns(spark, tmp_path):
    path = tmp_path / "plain.csv"
    path.write_text("companyid,companyname,transcriptid,componenttext,componentorder\n1,A,T1,Some words here.,1\n")
    rows = transcripts.TranscriptCsv(spark, str(path)).fetch(None, "2023-01-01", "2023-02-01").collect()
    assert len(rows) == 1 and rows[0].speakertypename is None


def test_sentiment_file_needs_its_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("permno,edate\n1,01/05/2024\n")
    with pytest.raises(ValueError, match="sentiment"):
        documents.sentiment_scores(spark, str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_text("permno,edate,sentiment\n1,01/05/2024,0.5\n2,bad,x\n")
    rows = sentiment.with_themes(documents.sentiment_scores(spark, str(tmp_path / "b.csv"))).collect()
    assert {r.theme_id for r in rows} == {"all"} and rows[1].sentiment is None


def test_firm_topic_documents(spark, tmp_path):
    good = {"firm_id": "1", "firm_name": "A", "n_topics": 1, "topics": [{"topic_id": 0, "representation": "r", "keywords": ["k"], "size": 2, "sentence_ids": ["s"]}], "outlier_sentence_ids": []}
    (tmp_path / "1_topics.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "2_topics.json").write_text("{broken")
    (tmp_path / "3_topics.json").write_text(json.dumps({"firm_name": "no id"}))
    (tmp_path / "other.json").write_text("{}")
    loaded, skipped = documents.firm_topics(spark, str(tmp_path))
    assert [r.firm_id for r in loaded.collect()] == ["1"]
    assert sorted(r.file.rsplit("/", 1)[1] for r in skipped.collect()) == ["2_topics.json", "3_topics.json"]
    assert documents.list_json(spark, str(tmp_path)).count() == 4


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"min_firms": 3, "unknown": 1}))
    config = documents.Config.load(str(path), start="2022-01-01")
    assert config.min_firms == 3 and config.start == "2022-01-01" and config.max_dominance == 0.4
    for bad in ({"min_firms": 0}, {"max_dominance": 1.5}, {"start": "2024-01-01", "end": "2023-01-01"}):
        with pytest.raises(ValueError):
            documents.Config.load(None, **bad)


def test_theme_document_to_events(spark, tmp_path):
    def sentences(*labels):
        return [{"text": t, "speaker": "CEO"} for t in labels]

    doc = {"themes": [{"theme_id": "t1", "theme_name": "AI / Cloud", "firm_contributions": [
        {"firm_id": "1", "firm_name": "A", "permno": 11, "earnings_call_date": "2023-01-26 08:00:00", "sentences": sentences("strong growth", "weak demand", "record sales")},
        {"firm_id": "2", "firm_name": "B", "permno": None, "earnings_call_date": "2023-01-27", "sentences": sentences("strong")},
        {"firm_id": "3", "firm_name": "C", "permno": None, "earnings_call_date": "2023-01-27", "sentences": sentences("weak")},
        {"firm_id": "4", "firm_name": "D", "permno": 14, "earnings_call_date": "soon", "sentences": sentences("weak")},
        {"firm_id": "5", "firm_name": "E", "permno": 15, "earnings_call_date": "2023-01-27", "sentences": []}]}]}
    (tmp_path / "themes.json").write_text(json.dumps(doc, indent=1))
    rows = sentiment.theme_sentences(documents.themes(spark, str(tmp_path / "themes.json")))
    label, score = sentiment.lexicon_label(F.col("text"), ["strong", "growth", "record"], ["weak"])
    labelled = rows.withColumns({"label": label, "score": score})
    mapped = spark.createDataFrame([("2", 12)], "firm_id string, mapped long")
    got = {r.firm_id: r for r in sentiment.theme_events(labelled, mapped).collect()}
    assert set(got) == {"1", "2", "3", "4"}
    assert (got["1"].permno, got["1"].edate, got["1"].sentiment, got["1"].n_sentences) == (11, date(2023, 1, 26), 0.3333, 3)
    assert got["2"].permno == 12 and got["3"].rejected == "no permno" and got["4"].rejected == "no readable date"
    events = sentiment.accepted(sentiment.theme_events(labelled, mapped))
    writers.by_theme_csv(events, str(tmp_path / "out"), "sentiment")
    assert [p.name for p in (tmp_path / "out").iterdir() if p.is_dir()] == ["file=t1_AI _ Cloud_sentiment"]
    detail = {r.firm_id: r for r in sentiment.firm_details(labelled).collect()}
    assert detail["1"].positive_count == 2 and detail["1"].negative_ratio == pytest.approx(1 / 3)
    classified = sentiment.classified(rows, lambda: lambda ts: [("Positive", 0.9) for _ in ts])
    assert {(r.label, r.score) for r in classified.collect()} == {("positive", 0.9)}


def test_empty_distribution_is_zero(spark):
    empty = spark.createDataFrame([], "label string, score double")
    r = sentiment.distribution(empty, []).first()
    assert (r.total_count, r.sentiment_score, r.avg_confidence) == (0, 0.0, 0.0)


def test_null_rules(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (float("inf"), "c"), (None, "d")], "x double, s string")
    assert nulls.nan_to_null(df).filter("x IS NULL").count() == 2
    assert [r.s for r in nulls.finite_rows(df).collect()] == ["a"]
    spoken = spark.createDataFrame([("Operator",), ("ceo",), (None,)], "r string")
    assert relational.without_role(spoken, "r", "operator").count() == 2
    assert df.select(text.stars(F.lit(None).cast("double"))).first()[0] == ""


FIRMS = ["alpha", "beta", "gamma", "delta"]
SUBJECTS = {
    "cloud": "cloud platform revenue customers migration",
    "supply": "supply chain freight logistics inventory",
    "hiring": "hiring engineers talent retention salaries",
}


def _components(spark):
    rows = []
    for f in FIRMS:
        for s, words in SUBJECTS.items():
            for i in range(12):
                picked = words.split()
                body = " ".join(picked[j % 5] for j in range(i % 3, i % 3 + 4))
                rows.append((f, f.title(), "T1", len(rows), "CEO", f"{body.capitalize()}."))
    rows.append(("empty", "Empty", "T1", 0, "CEO", "Yes."))
    return spark.createDataFrame(rows, "firm_id string, firm_name string, transcript_id string, component_order int, speaker_type string, text string")


def test_upstream_run_and_resume(spark, tmp_path):
    held = store.Store(spark, str(tmp_path / "store"))
    config = documents.Config(
        firm_model={"hdbscan": {"min_cluster_size": 4}, "vectorizer": {"min_df": 1}},
        theme_model={"hdbscan": {"min_cluster_size": 2, "min_samples": 1}, "vectorizer": {"min_df": 1}},
        max_dominance=1.0,
    )
    upstream.run(_components(spark), held, "b1", config, F.lit("2024-03-01").cast("date"))
    sentences, topics = held.table("sentences"), held.table("topics")
    assert sentences.count() == 144 and topics.count() >= 4
    assert held.table("processed_firms").count() == 5 and held.table("firms").count() == 5
    orphans = sentences.filter("topic_id IS NOT NULL").join(topics.select(F.col("id").alias("topic_id")), "topic_id", "left_anti")
    assert orphans.count() == 0
    counted = sentences.groupBy("topic_id").count().join(topics, F.col("topic_id") == F.col("id"))
    assert counted.filter("count <> n_sentences").count() == 0
    assert topics.filter("representation IS NULL OR summary IS NULL OR size(keywords) = 0").count() == 0
    assert sentences.filter("probability < 0 OR probability > 1").count() == 0
    one = topics.first()
    assert [r.position for r in held.sentences_of(topic_id=one.id).collect()] == sorted(r.position for r in sentences.filter(F.col("topic_id") == one.id).collect())
    assert held.topics_of(firm_id=one.firm_id).count() >= 1 and held.firm("alpha").first().name == "Alpha"
    assert held.firms_by_state(True).count() == 5 and held.firms_by_state(False).count() == 0
    themes = held.table("themes")
    assert themes.count() >= 1 and themes.filter("n_firms < 2").count() == 0
    # nothing is left to do, and a repeated batch leaves no duplicates
    assert held.unprocessed(_components(spark).select(F.col("firm_id").alias("company_id")).distinct()).count() == 0
    more = _components(spark).withColumn("firm_id", F.concat("firm_id", F.lit("2")))
    for _ in range(2):
        upstream.process_firms(more.filter("firm_id IN ('alpha2', 'empty2')"), held, "b2", config)
    with pytest.raises(ValueError, match="complete"):
        upstream.process_firms(more, held, "b2", config)
    upstream.process_firms(_components(spark).withColumn("firm_id", F.lit("empty3")).filter("text = 'Yes.'"), held, "b3", config)
    assert held.table("firms").count() == 8 and held.table("sentences").count() == 180
    assert held.table("sentences").groupBy("id").count().filter("count > 1").count() == 0

    flat = store.hierarchy(themes, held.themed_topics(), held.table("sentences"), held.table("firms"))
    export.write_export(export.contributions(flat), str(tmp_path / "export"))
    back = sentiment.theme_sentences(documents.theme_rows(spark, str(tmp_path / "export")))
    assert back.count() == flat.count() and set(back.select("firm_id").distinct().toPandas().firm_id) <= {*FIRMS, "alpha2"}


def test_announced_models_are_not_available(spark):
    for name, error in (("lda", NotImplementedError), ("neural", NotImplementedError), ("other", ValueError)):
        with pytest.raises(error):
            upstream.model_topics(spark.range(1), {"model": name})


def test_chart_frames(spark):
    summary = spark.createDataFrame([("t", "n", "*", 0.5, 0.1)], "Theme_ID string, Theme_Name string, Significance string, Sentiment_Coef double, Std_Error double")
    r = charts.coefficient_forest(summary).first()
    assert (r.low, r.high) == pytest.approx((0.304, 0.696))
    topics = spark.createDataFrame([("f1", 1, "a", 5), ("f1", 2, "b", 2), ("f2", 1, "a", 1)], "firm_id string, topic_id int, theme_id string, n_sentences long")
    heat = {r.firm_id: (r.a, r.b) for r in charts.firm_theme_heatmap(topics, ["a", "b"]).collect()}
    assert heat == {"f1": (5, 2), "f2": (1, 0)}
    assert {r.firm_id: r.n_topics for r in charts.topics_per_firm(topics).collect()} == {"f1": 2, "f2": 1}


def test_store_rules(spark, tmp_path):
    held = store.Store(spark, str(tmp_path / "s"))
    held.create()
    assert all(held.table(n).count() == 0 for n in ("firms", "themes", "extracted_entities"))
    firm = "company_id string, name string, ticker string, quarter string, earnings_call_date date, processed_at timestamp"
    rows = spark.createDataFrame([("1", "A", "aa", "2023-Q1", None, None), ("2", "B", "bb", "2023 q2", date(2020, 1, 1), None)], firm)
    held.add_firms(rows, "b1")
    held.add_firms(rows.filter("company_id = '1'").unionByName(rows.withColumn("company_id", F.lit("3"))), "b2")
    assert sorted(r.company_id for r in held.table("firms").collect()) == ["1", "2", "3"]
    reports = spark.createDataFrame([("AA", "2023Q1", date(2023, 4, 1)), ("AA", "2023Q1", date(2023, 5, 1)), ("BB", "2023Q2", date(2023, 8, 1))], "tic string, datacqtr string, rdq date")
    filled = {r.company_id: r.earnings_call_date for r in store.backfilled_dates(rows, reports).collect()}
    assert filled == {"1": date(2023, 5, 1), "2": date(2020, 1, 1)}
    held.drop(["firms"])
    assert held.table("firms").count() == 0


def test_ticker_lookup(spark):
    names = spark.createDataFrame(
        [("ab", 1, date(2010, 1, 1), date(2015, 1, 1)), ("AB", 2, date(2014, 1, 1), None)],
        "ticker string, permno long, namedt date, nameendt date",
    )
    asked = spark.createDataFrame([("Ab", date(2012, 1, 1)), ("ab", date(2014, 6, 1)), ("ab", date(2001, 1, 1)), (None, date(2001, 1, 1))], "ticker string, date date")
    got = {r.date: r.permno for r in store.upper_ticker_permno(asked, names).collect()}
    assert got == {date(2012, 1, 1): 1, date(2014, 6, 1): 2, date(2001, 1, 1): None}
    assert [r.permno for r in store.ticker_permno(asked, names).collect()] == [2]


def test_study_outputs(spark, tmp_path, capsys):
    df = spark.createDataFrame([(1, 0.5)], "permno long, car double")
    assert writers.study({"event_date": df}, "df")["event_date"] is df
    writers.study({"event_date": df}, "print")
    assert "event_date" in capsys.readouterr().out
    for kind in ("csv", "json"):
        assert writers.study({"event_date": df}, kind, str(tmp_path / kind))
        assert (tmp_path / kind / "event_date" / "_SUCCESS").exists()
    assert writers.study({"event_date": df}, "tape") is None
    with pytest.raises(NotImplementedError):
        writers.study({"event_date": df}, "xls")


def test_inline_events(spark):
    got = market.event_rows(spark, [{"permno": 1, "edate": "05/29/2012"}, {"permno": 2, "edate": "2012-05-30", "sentiment": 0.2}]).collect()
    assert [(r.permno, r.edate, r.sentiment) for r in got] == [(1, date(2012, 5, 29), 0.0), (2, date(2012, 5, 30), 0.2)]


def test_command_line_downstream(spark, tmp_path, monkeypatch):
    tables = frames(spark, build())
    for name, df in tables.items():
        if name != "events":
            df.write.parquet(str(tmp_path / "market" / name))
    lines = ["permno,edate,sentiment,theme_id,theme_name"]
    for theme in ("t1", "t2"):
        lines += [f"{p},{DAYS[EVENT + o].strftime('%m/%d/%Y')},{0.1 * p - 0.05 * o},{theme},Theme {theme}" for p in (1, 2, 7) for o in (0, 7)]
    (tmp_path / "s.csv").write_text("\n".join(lines))
    monkeypatch.setattr(cli, "build_session", lambda **_: spark)
    common = ["--market", str(tmp_path / "market"), "--output", str(tmp_path / "out")]
    assert cli.main(["run", "--sentiment-file", str(tmp_path / "s.csv"), *common]) == 0
    out = tmp_path / "out"
    summary = spark.read.option("header", True).csv(str(out / "regression_significance_summary_csv"))
    assert {r.Theme_ID for r in summary.collect()} == {"t1", "t2"}
    sorts = spark.read.option("header", True).csv(str(out / "combined_portfolio_returns"))
    assert {r.bucket for r in sorts.collect()} == {"Low", "Medium", "High"}
    assert cli.main(["portfolio", "--sentiment-file", str(tmp_path / "s.csv"), "--weighting", "equal", *common]) == 0
    with pytest.raises(SystemExit):
        cli.main(["run", *common])
    with pytest.raises(SystemExit) as stop:
        cli.main(["--help"])
    assert stop.value.code == 0


FIRM_COLUMNS = "company_id string, name string, ticker string, quarter string, earnings_call_date date, processed_at timestamp"


def test_a_batch_without_rows_is_emptied(spark, tmp_path):
    held = store.Store(spark, str(tmp_path / "s"))
    row = spark.createDataFrame([("1", "A", "aa", "2023-Q1", None, None)], FIRM_COLUMNS).withColumn("id", F.lit(1))
    for batch in ("b1", "b2"):
        held.write("firms", row, batch)
    held.write("firms", row.limit(0), "b1")
    assert [r.batch for r in held.batched("firms").collect()] == ["b2"]
    held.write("firms", row.limit(0), "b9")
    assert held.table("firms").count() == 1


def test_backfill_keeps_the_batches(spark, tmp_path, monkeypatch):
    held = store.Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("1", "A", "aa", "2023-Q1", None, None)], FIRM_COLUMNS).withColumn("id", store.key("company_id"))
    held.write("firms", rows, "b1")
    reports = spark.createDataFrame([("AA", "2023Q1", date(2023, 5, 1))], "tic string, datacqtr string, rdq date")
    reports.write.parquet(str(tmp_path / "market" / "fundq"))
    monkeypatch.setattr(cli, "build_session", lambda **_: spark)
    monkeypatch.setattr(market.ParquetMarket, "table", lambda self, name: spark.read.parquet(str(tmp_path / "market" / name)))
    assert cli.main(["backfill", "--store", str(tmp_path / "s"), "--market", str(tmp_path / "market")]) == 0
    held.write("firms", rows, "b1")  # the batch was lost before its markers and runs again
    assert held.table("firms").count() == 1


def test_upsert_takes_the_first_in_order(spark):
    known = spark.createDataFrame([(1, "x")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (2, "b")], "k int, v string")
    assert [tuple(r) for r in relational.upsert_new(known, new, ["k"], [F.col("v")]).collect()] == [(2, "b")]


def test_dates_decide_where_the_column_exists(spark, tmp_path):
    head = "companyid,companyname,transcriptid,componenttext,componentorder,mostimportantdateutc\n"
    (tmp_path / "a.csv").write_text(head + "1,A,T1,Some words here.,1,\n2,B,T2,Some words here.,1,\n")
    assert transcripts.TranscriptCsv(spark, str(tmp_path / "a.csv")).fetch(None, "2023-01-01", "2023-02-01").count() == 0
    assert transcripts.TranscriptCsv(spark, f"file://{tmp_path}/a.csv").fetch().count() == 2


def test_first_firms_limit_the_run(spark, tmp_path, csv_path, monkeypatch):
    seen = {}
    monkeypatch.setattr(cli, "build_session", lambda **_: spark)
    monkeypatch.setattr(upstream, "run", lambda rows, *_: seen.update(firms={r.firm_id for r in rows.select("firm_id").collect()}))
    (tmp_path / "c.json").write_text(json.dumps({"first_firms": 1}))
    options = ["topics", "--source", csv_path, "--store", str(tmp_path / "s"), "--batch", "b", "--run-date", "2024-01-01"]
    assert cli.main([*options, "--config", str(tmp_path / "c.json")]) == 0
    assert seen["firms"] == {"1001"}


def test_any_client_fault_gives_null(spark):
    def factory():
        async def generate(prompt):
            if prompt == "bad":
                raise KeyError("choices")
            return prompt.upper()

        return generate

    rows = spark.createDataFrame([("good",), ("bad",)], "p string")
    got = {r.p: r.a for r in summaries.generated(rows, "p", factory, "a", wait=0.0).collect()}
    assert got == {"good": "GOOD", "bad": None}


def test_firm_summary_and_nested_form_keep_empty_ones(spark):
    themes = spark.createDataFrame([(1, "t"), (2, "none")], "id long, name string")
    topics = spark.createDataFrame([(10, 1, 5, "a"), (11, 1, 5, "b")], "id long, theme_id long, firm_id long, representation string")
    firms = spark.createDataFrame([(5, "F"), (6, "G")], "id long, name string")
    said = spark.createDataFrame([(10, 1, "x", "CEO", 0)], "topic_id long, id long, raw_text string, speaker_type string, position int")
    nested = {(r.theme_name, r.topic_id): [s.raw_text for s in r.sentences] for r in store.nested_topics(themes, topics, said, firms).collect()}
    assert nested == {("t", 10): ["x"], ("t", 11): [], ("none", None): []}
    found = {r.name: (r.n_topics, r.n_sentences, [(t.id, t.n_sentences) for t in r.topics]) for r in store.firm_summary(firms, topics, said).collect()}
    assert found == {"F": (2, 1, [(10, 1), (11, 0)]), "G": (0, 0, [])}


def test_factories_and_windows_come_from_the_command_line(spark, tmp_path):
    def shout():
        return lambda texts: [("POSITIVE" if "grew" in t else "NEGATIVE", 0.9) for t in texts]

    assert cli.factory(None) is None and cli.factory("json:loads") is json.loads
    theme = {
        "theme_id": "t", "theme_name": "T",
        "firm_contributions": [{
            "firm_id": "f", "firm_name": "F", "permno": 1, "cluster_id": 1, "earnings_call_date": "2024-01-02",
            "sentences": [{"text": "Sales grew again.", "speaker": "CEO"}, {"text": "Costs fell.", "speaker": "CEO"}],
        }],
    }
    (tmp_path / "t.json").write_text(json.dumps({"themes": [theme]}))
    scored = cli.score_themes(spark, str(tmp_path / "t.json"), [], [], shout).first()
    assert (scored.sentiment, scored.n_sentences) == (0.0, 2)
    given = ["event-study", "--sentiment-file", "s", "--market", "m", "--output", "o"]
    assert cli.windows_of(cli.parser().parse_args([*given, "--gap", "3", "--evtwins", "-4"]))["gap"] == 3
    for wrong in (["--estwin", "0"], ["--evtwins", "2"], ["--minval", "1000"]):
        with pytest.raises(ValueError):
            cli.windows_of(cli.parser().parse_args([*given, *wrong]))


def test_settings_from_the_environment(monkeypatch, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"min_firms": 3, "store": "a"}))
    monkeypatch.setenv("CALLWEAVE_STORE", "7")
    monkeypatch.setenv("CALLWEAVE_MIN_FIRMS", "5")
    monkeypatch.setenv("CALLWEAVE_FIRM_MODEL", '{"hdbscan": {"min_cluster_size": 9}}')
    config = documents.Config.load(str(tmp_path / "c.json"), max_dominance=0.5)
    assert (config.store, config.min_firms, config.max_dominance) == ("7", 5, 0.5)
    assert config.firm_model["hdbscan"]["min_cluster_size"] == 9


def test_a_theme_goes_by_its_id(spark):
    events = spark.createDataFrame([("t", "Beta", 1), ("t", "Alpha", 2), (None, "x", 3)], "theme_id string, theme_name string, permno long")
    got = {r.permno: (r.theme_id, r.theme_name) for r in sentiment.with_themes(events).collect()}
    assert got == {1: ("t", "Alpha"), 2: ("t", "Alpha"), 3: (None, "x")}
