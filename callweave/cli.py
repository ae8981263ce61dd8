"""Command line: topics, export, backfill, run, event-study and portfolio."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions import dates
from callweave.functions.fixed import MODEL_FACTORS, STUDY_WINDOW
from callweave.plans import charts, covariates, eventstudy, export, portfolio, regression, sentiment, store, upstream
from callweave.session import build_session, materialize
from callweave.sinks import writers
from callweave.sources import documents, market, transcripts

STAGES = ("sentiment", "event-study", "portfolio")


def factory(place: str | None) -> Callable | None:
    """The factory at `module:name`, which the executors must be able to import too."""
    if place is None:
        return None
    module, _, name = place.partition(":")
    return getattr(importlib.import_module(module), name)


def _load_events(spark: SparkSession, path: str) -> DataFrame:
    rows = sentiment.with_themes(documents.sentiment_scores(spark, path))
    return rows.withColumn("edate", dates.parse_date(F.col("edate"))).filter(F.col("edate").isNotNull())


def score_themes(
    spark: SparkSession, themes_path: str, positive: Sequence[str], negative: Sequence[str], classifier: Callable | None = None,
    training: str | None = None,
) -> DataFrame:
    """Sentences of a themes file (one document or exported lines) to events, rejected ones included."""
    single = themes_path.endswith(".json")
    read = documents.themes(spark, themes_path) if single else documents.theme_rows(spark, themes_path)
    rows = sentiment.theme_sentences(read)
    if classifier is not None:
        return sentiment.theme_events(sentiment.classified(rows, classifier))
    if training is not None:
        model = sentiment.word_model(spark.read.parquet(training))
        return sentiment.theme_events(sentiment.learned(rows, model))
    label, score = sentiment.lexicon_label(F.col("text"), positive, negative)
    return sentiment.theme_events(rows.withColumns({"label": label, "score": score}))


def study_themes(events: DataFrame, tables, output: str, model: str = "madj", windows: dict[str, int] | None = None) -> DataFrame:
    """Event study, covariates and theme regressions; returns the ranked summary."""
    study = eventstudy.event_study(
        sentiment.study_events(events), tables.table("dsf"), tables.table("dsi"), tables.table("factors_daily"),
        tables.table("dsedelist"), model=model, **(windows or {}),
    )
    pulled = covariates.fundamentals(
        events, *[tables.table(t) for t in ("fundq", "funda", "ccmxpf_linktable", "stocknames", "ibcrsphist", "statsum_epsus", "msf")]
    )
    unique = sentiment.study_events(events)
    results = covariates.event_covariates(study, covariates.covariates(pulled), unique)
    themed = materialize(sentiment.theme_results(results, events))
    writers.by_theme_csv(themed, f"{output}/event_study_results", "event_study_results")
    fits = materialize(regression.theme_regressions(themed))
    table = regression.coefficient_table(fits, ["theme_id", "theme_name"], ["sentiment", *regression.COVARIATES])
    writers.csv(table, f"{output}/regression_tables")
    summary = regression.significance_summary(fits)
    writers.significance(summary, output)
    writers.csv(regression.summary_stats(summary), f"{output}/regression_totals")
    writers.csv(study.rejected, f"{output}/rejected_events")
    writers.csv(charts.mean_with_interval(themed, ["theme_id", "theme_name"], "car"), f"{output}/car_by_theme")
    return summary


def sort_portfolios(events: DataFrame, tables, output: str, weighting: str) -> DataFrame:
    returns = materialize(portfolio.portfolio_returns(events, tables.table("dsf"), weighting))
    writers.by_theme_csv(returns, f"{output}/portfolio_returns", "portfolio_returns", 30)
    writers.csv(returns, f"{output}/combined_portfolio_returns")
    combined = portfolio.combined(returns)
    writers.csv(combined, f"{output}/combined_all_themes_portfolio_returns")
    writers.csv(portfolio.spread(combined), f"{output}/portfolio_spread")
    return returns


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="callweave", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=text)
        sub.add_argument("--master", help="Spark master; left to spark-submit when absent")
        return sub

    sub = command("topics", "transcripts to stored topics and themes")
    sub.add_argument("--source", required=True)
    sub.add_argument("--store", required=True)
    sub.add_argument("--batch", required=True)
    sub.add_argument("--run-date", required=True, help="yyyy-MM-dd, part of the theme ids")
    sub.add_argument("--config")
    sub.add_argument("--encoder", help="module:factory of a sentence encoder")
    sub.add_argument("--generator", help="module:factory of a text service for summaries")
    sub = command("export", "stored themes to the input of the sentiment stage")
    sub.add_argument("--store", required=True)
    sub.add_argument("--output", required=True)
    sub.add_argument("--market", help="folder with stocknames, for the PERMNO lookup")
    sub = command("backfill", "fill missing call dates of stored firms")
    sub.add_argument("--store", required=True)
    sub.add_argument("--market", required=True)
    sub.add_argument("--dry-run", action="store_true")
    sub = command("run", "sentiment, event study and portfolios")
    sub.add_argument("--themes")
    sub.add_argument("--sentiment-file")
    sub.add_argument("--market", required=True)
    sub.add_argument("--output", required=True)
    sub.add_argument("--stages", nargs="+", choices=STAGES, default=list(STAGES))
    sub.add_argument("--weighting", choices=("value", "equal"), default="value")
    sub.add_argument("--classifier", help="module:factory of a sentiment classifier")
    sub.add_argument("--training", help="Parquet of labelled sentences (text, label) to fit a classifier on; without either the word lists are used")
    window_options(sub)
    sub.add_argument("--positive", nargs="+", default=["growth", "improved", "increase", "record", "strong"])
    sub.add_argument("--negative", nargs="+", default=["challenge", "decline", "decrease", "loss", "weak"])
    for name in ("event-study", "portfolio"):
        sub = command(name, f"{name} from a sentiment file")
        sub.add_argument("--sentiment-file", required=True)
        sub.add_argument("--market", required=True)
        sub.add_argument("--output", required=True)
        if name == "portfolio":
            sub.add_argument("--weighting", choices=("value", "equal"), default="value")
        else:
            sub.add_argument("--model", choices=tuple(MODEL_FACTORS), default="madj")
            window_options(sub)
    return top


def window_options(sub: argparse.ArgumentParser) -> None:
    for name, default in STUDY_WINDOW.items():
        sub.add_argument(f"--{name}", type=int, default=default)


def windows_of(options: argparse.Namespace) -> dict[str, int]:
    """The study windows asked for, checked."""
    found = {name: getattr(options, name) for name in STUDY_WINDOW}
    if found["estwin"] < 1 or found["gap"] < 0 or found["minval"] < 1 or found["minval"] > found["estwin"]:
        raise ValueError("estwin and minval must be at least 1, gap at least 0, minval at most estwin")
    if found["evtwins"] > 0 or found["evtwine"] < 0:
        raise ValueError("the event window must hold day 0")
    return found


def main(arguments: Sequence[str] | None = None) -> int:
    options = parser().parse_args(arguments)
    if options.command == "run" and not (options.themes or options.sentiment_file):
        parser().error("run needs --themes or --sentiment-file")
    spark = build_session(master=options.master)
    if options.command == "topics":
        config = documents.Config.load(options.config, source=options.source, store=options.store)
        source = transcripts.TranscriptCsv(spark, config.source)
        if config.first_firms:
            source = transcripts.LimitedConnector(source, first=config.first_firms)
        rows = transcripts.as_components(source.fetch(config.firm_ids, config.start, config.end))
        upstream.run(rows, store.Store(spark, config.store), options.batch, config, F.lit(options.run_date).cast("date"), factory(options.encoder), factory(options.generator))
    elif options.command == "export":
        held = store.Store(spark, options.store)
        flat = store.hierarchy(held.table("themes"), held.themed_topics(), held.table("sentences"), held.table("firms"))
        names = market.ParquetMarket(spark, options.market).table("stocknames") if options.market else None
        export.write_export(export.contributions(flat, names), options.output)
    elif options.command == "backfill":
        held = store.Store(spark, options.store)
        filled = materialize(store.backfilled_dates(held.batched("firms"), market.ParquetMarket(spark, options.market).table("fundq")))
        print("firms with a date:", filled.filter(F.col("earnings_call_date").isNotNull()).count())
        if not options.dry_run:
            held.replace_batches("firms", filled)
    else:
        tables = market.ParquetMarket(spark, options.market)
        stages = getattr(options, "stages", [options.command])
        if options.sentiment_file:
            events = _load_events(spark, options.sentiment_file)
        else:
            scored = materialize(score_themes(spark, options.themes, options.positive, options.negative, factory(options.classifier), options.training))
            events = sentiment.accepted(scored)
            if "sentiment" in stages:
                writers.csv(scored, f"{options.output}/sentiment_scores")
                writers.by_theme_csv(events, f"{options.output}/sentiment_by_theme", "sentiment")
        if "event-study" in stages:
            study_themes(events, tables, options.output, getattr(options, "model", "madj"), windows_of(options))
        if "portfolio" in stages:
            sort_portfolios(events, tables, options.output, options.weighting)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
