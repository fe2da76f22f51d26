"""Command line: python -m ebbflow.cli <command> ... Tables go to Parquet folders under --out."""

from __future__ import annotations

import argparse

from .operators import harmonic
from .plans import workflows
from .session import build
from .sources import io


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ebbflow")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *needs: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for n in needs:
            c.add_argument(f"--{n}", required=True)
        c.add_argument("--out", required=True)
        return c

    command("train-predict", "data")
    for name in ("forecast", "events-forecast"):
        c = command(name, "model", "start")
        length = c.add_mutually_exclusive_group(required=True)
        length.add_argument("--hours", type=int)
        length.add_argument("--days", type=int)
        c.add_argument("--freq-minutes", type=int, default=60)
    c = command("hybrid-forecast", "data", "start")
    c.add_argument("--hours", type=int, default=72)
    c.add_argument("--allow-stale-context", action="store_true")
    c.add_argument("--fitted", help="folder of residual-train; else models are trained on what lies before the start")
    c.add_argument("--mode", choices=("forecast", "hindcast"), default="forecast")
    c.add_argument("--end", help="of a hindcast")
    c.add_argument("--window", type=int, default=168)
    c = command("residual-train", "data")
    c.add_argument("--window", type=int, default=168)
    c = command("events-validate", "model", "reference-events")
    c = command("extract-hourly", "words", "headers")
    c = command("extract-events", "chars", "headers")
    command("summary", "summaries")
    c = command("validate-forecast", "data", "start")
    c.add_argument("--days", type=int, default=7)
    c = command("tide-report", "forecast", "start")
    c.add_argument("--port", default="port")
    c.add_argument("--hours", type=int, default=24)
    c.add_argument("--height-column")
    c.add_argument("--observed-events")
    c = command("events-train", "data")
    c.add_argument("--trees", type=int, default=160)
    c.add_argument("--depth", type=int, default=12)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = build("ebbflow-cli")
    if a.command == "train-predict":
        tables = workflows.fit_and_score(io.read_hourly(spark, a.data).drop("t_hours"))
        workflows.save(tables | {f"chart_{k}": v for k, v in workflows.chart_tables(tables["validation"], tables["model"]).items()}, a.out)
        tables["summary"].show(truncate=False)
    elif a.command in ("forecast", "events-forecast"):
        hours = a.hours if a.hours is not None else 24 * a.days
        if a.command == "forecast":
            model = spark.read.parquet(a.model)
            df = workflows.forecast(spark, model, a.start, hours, a.freq_minutes)
            df.write.mode("overwrite").parquet(a.out)
            df.show(24)
        else:
            model, models = workflows.load_event_model(spark, a.model)
            tables = workflows.events_forecast(spark, model, a.start, hours, models)
            workflows.save(tables, a.out)
            tables["frequency"].show(truncate=False)
    elif a.command == "hybrid-forecast":
        obs = io.read_hourly(spark, a.data).drop("t_hours")
        fitted = workflows.load_residual(spark, a.fitted) if a.fitted else None
        if a.mode == "hindcast":
            if not fitted or not a.end:
                raise SystemExit("a hindcast needs --fitted and --end")
            df = workflows.hybrid_hindcast(obs, a.start, a.end, fitted, a.window)
        else:
            df = workflows.hybrid(obs, a.start, a.hours, a.allow_stale_context, fitted, a.window)
        df.write.mode("overwrite").parquet(a.out)
    elif a.command == "residual-train":
        tables = workflows.train_residual(io.read_hourly(spark, a.data).drop("t_hours"), a.window)
        workflows.save(tables, a.out)
        tables["skill"].show()
    elif a.command == "events-validate":
        references = io.read_events(spark, a.reference_events)
        tables = workflows.validate_events(*workflows.load_event_model(spark, a.model), references)
        workflows.save(tables, a.out)
        tables["metrics"].show(truncate=False)
    elif a.command == "extract-hourly":
        rows = workflows.extract_hourly(spark.read.parquet(a.words), spark.read.parquet(a.headers))
        io.write_csv(rows.select("port", "datetime_ist", "height_m"), a.out, ["port", "datetime_ist"])
    elif a.command == "extract-events":
        events, faults = workflows.extract_events(spark.read.parquet(a.chars), spark.read.parquet(a.headers))
        found = [f"{r.port} {r['at']}: {r.fault}" for r in faults.limit(20).collect()]
        if found:
            raise SystemExit("faulty tables: " + "; ".join(found))
        io.write_csv(events, a.out, ["port", "datetime_ist"])
    elif a.command == "summary":
        report = workflows.summary_report(spark.read.parquet(a.summaries))
        report.write.mode("overwrite").parquet(a.out)
        report.show(truncate=False)
    elif a.command == "validate-forecast":
        obs = io.read_hourly(spark, a.data).drop("t_hours")
        tables = workflows.validate_forecast(obs, workflows.hybrid(obs, a.start, 24 * a.days))
        workflows.save(tables, a.out)
        tables["horizons"].show()
    elif a.command == "tide-report":
        curve = io.read_forecast(spark, a.forecast, a.port, a.height_column)
        observed = io.read_events(spark, a.observed_events).selectExpr(f"'{a.port}' AS port", "state", "datetime_ist", "height_m") if a.observed_events else None
        tables = workflows.tide_report(curve, a.start, a.hours, observed)
        workflows.save(tables, a.out)
        tables["frequency"].show(truncate=False)
    elif a.command == "events-train":
        model, models, report = workflows.train_events(io.read_hourly(spark, a.data).drop("t_hours"), trees=a.trees, depth=a.depth)
        workflows.save_event_model(model, models, report, a.out)
        spark.read.parquet(f"{a.out}/report").show(truncate=False)


if __name__ == "__main__":
    main()
