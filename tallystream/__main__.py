"""Command line: features, split, preprocessing, profile, training, networks, blends, states and records over files of transactions.

    python -m tallystream features IN OUT [--windows 1h,6h,24h] [--csv] [--force]
    python -m tallystream split DEVELOPMENT HOLDOUT MANIFEST [--fraction 0.2] [--force]
    python -m tallystream fit FEATURES STATE --numeric a,b [--frequency c] [--nominal d] [--log1p a] [--force]
    python -m tallystream transform FEATURES STATE OUT --keep k1,k2 [--force]
    python -m tallystream profile IN OUT [--force]
    python -m tallystream train MATRIX REPORT MODEL --kind logistic --label y [--tries 4] [--force]
    python -m tallystream boost MATRIX REPORT TREES --label y --key k [--state STATE] [--rounds 800] [--force]
    python -m tallystream network MATRIX REPORT NETWORK --label y --key k [--state STATE] [--tries 4] [--force]
    python -m tallystream index FEATURES POINTERS [--force]
    python -m tallystream recurrent HISTORIES REPORT NETWORK --label y --key k --length 12 --state STATE [--tries 4] [--force]
    python -m tallystream blend SCORES BLEND --label y --scores a,b,c [--force]
    python -m tallystream hybrid SCORES REPORT BLEND --label y --scores boosted,feed_forward,recurrent --reports p,q,r [--force]
    python -m tallystream context PAST ENGINE --length 12 [--windows 1h,6h,24h] [--csv]
    python -m tallystream state IN STATE [--windows 1h,6h,24h] [--csv] [--force]
    python -m tallystream record TABLE RECORD [--force]

A matrix or table of scores has a column ``partition`` (train, validation, holdout). A history column is named ``history``. With
--state, the file of a fitted preprocessor, reports say which rows and features a model was made from; a hybrid asks that of all.
Tables are Parquet, or CSV files of the raw schema with --csv. Results are written once unless --force is given.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.operators import averaging, boosting, engine, fusion, neural, preprocess, profile, sequences, split, transactions, velocity
from tallystream.sources import artifacts, tables
from tallystream.streaming import activity

def _read(spark: SparkSession, path: str, csv: bool = False) -> DataFrame:
    return tables.read_csv(spark, path) if csv else spark.read.parquet(path)


def _names(text: str | None) -> tuple[str, ...]:
    return tuple(x for x in (text or "").split(",") if x)


def _features(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c.startswith(("num__", "freq__", "cat__"))]


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tallystream", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, args in {"features": ["source", "target"], "split": ["source", "holdout", "target"], "fit": ["source", "target"], "transform": ["source", "state", "target"], "profile": ["source", "target"], "train": ["source", "report", "target"], "boost": ["source", "report", "target"], "network": ["source", "report", "target"], "index": ["source", "target"], "recurrent": ["source", "report", "target"], "hybrid": ["source", "report", "target"], "context": ["source", "target"], "blend": ["source", "target"], "state": ["source", "target"], "record": ["source", "target"]}.items():
        p = commands.add_parser(name)
        for a in args:
            p.add_argument(a)
        p.add_argument("--force", action="store_true")
        p.add_argument("--csv", action="store_true")
        for option in ("windows", "numeric", "frequency", "nominal", "log1p", "keep", "kind", "label", "scores", "reports", "key", *([] if name == "transform" else ["state"])):
            p.add_argument(f"--{option}")
        p.add_argument("--fraction", type=float, default=0.2)
        p.add_argument("--tries", type=int, default=4)
        p.add_argument("--length", type=int, default=12)
        p.add_argument("--rounds", type=int, default=boosting.BoostConfig.rounds)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    mode = "overwrite" if a.force else "errorifexists"
    rows = _read(spark, a.source, a.csv)
    if a.command == "features":
        windows = tuple(velocity.parse_window(w) for w in _names(a.windows)) or (3600, 21600, 86400)
        transactions.engineer_features(rows, velocity.VelocityConfig(windows)).write.mode(mode).parquet(a.target)
    elif a.command == "split":
        config = split.SplitConfig(a.fraction)
        artifacts.write_json(a.target, split.split_manifest(rows, _read(spark, a.holdout, a.csv), config), overwrite=a.force)
    elif a.command == "fit":
        config = preprocess.PreprocessConfig(_names(a.numeric), _names(a.frequency), _names(a.nominal), _names(a.log1p))
        artifacts.write_json(a.target, preprocess.fit(rows, config).to_dict(), overwrite=a.force)
    elif a.command == "transform":
        fitted = preprocess.Preprocessor.from_dict(artifacts.read_json(a.state))
        fitted.transform(rows, list(_names(a.keep))).write.mode(mode).parquet(a.target)
    elif a.command == "profile":
        profile.missing(rows).write.mode(mode).parquet(f"{a.target}/missing")
        profile.summary(rows, "is_fraud", "amt", ["cc_num", "merchant", "category", "state"]).write.mode(mode).parquet(f"{a.target}/summary")
        for name, key in profile.calendar_keys(F.to_timestamp("trans_date_trans_time")).items():
            profile.label_counts(rows, "is_fraud", **{name: key}).write.mode(mode).parquet(f"{a.target}/{name}")
    elif a.command == "state":
        windows = tuple(velocity.parse_window(w) for w in _names(a.windows)) or (3600, 21600, 86400)
        config = velocity.VelocityConfig(windows)
        activity.save_snapshot(activity.state_snapshot(rows, config), config, a.target, overwrite=a.force)
    elif a.command == "record":
        artifacts.write_json(a.target, artifacts.table_record(rows), overwrite=a.force)
    elif a.command == "blend":
        chosen = fusion.choose(rows, a.label or "is_fraud", fusion.candidates(list(_names(a.scores))))
        artifacts.write_json(a.target, chosen.to_dict({}), overwrite=a.force)
    elif a.command == "index":
        pointers = sequences.add_pointer(rows).select("row_idx", "previous")
        pointers.write.mode(mode).parquet(a.target)
        artifacts.write_json(f"{a.target}.json", sequences.index_record(spark.read.parquet(a.target)), overwrite=a.force)
    elif a.command in ("boost", "network", "recurrent"):
        label, key = a.label or "is_fraud", a.key or "trans_num"
        fitted = preprocess.Preprocessor.from_dict(artifacts.read_json(a.state)) if a.state else None
        features = fitted.names() if fitted else _features(rows)
        parts = [rows.filter(F.col("partition") == p) for p in ("train", "validation")]
        if a.command == "boost":
            found = boosting.fit_boosted(*parts, features, label=label, key=key, config=boosting.BoostConfig(rounds=a.rounds))
            document, more = found.model.to_dict(), {"average_precision": found.history, "best_round": found.best_round}
        else:
            own = {"inputs": features} if a.command == "network" else {"inputs": ["history"], "features": features, "length": a.length}
            kind = "feed_forward" if a.command == "network" else "recurrent"
            best, tried = averaging.search(kind, *parts, **own, label=label, key=key, tries=a.tries)
            document, more = neural.to_dict(best.model, features), {"search": tried}
        lineage = {"split_sha256": fitted.context.get("split_sha256") or fitted.context.get("key_sha256"), "schema_sha256": fitted.schema_digest()} if fitted else None
        report = {"type": "model_report", "version": 1, "model": a.command, "model_sha256": document["sha256"], "lineage": lineage} | more
        artifacts.write_json(a.target, document, overwrite=a.force)
        artifacts.write_json(a.report, artifacts.sealed(report), overwrite=a.force)
    elif a.command == "hybrid":
        reports = dict(zip(_names(a.scores), (artifacts.read_json(p) for p in _names(a.reports)), strict=True))
        _, document, report = fusion.search_hybrid(*[rows.filter(F.col("partition") == p) for p in ("validation", "holdout")], a.label or "is_fraud", reports)
        artifacts.write_json(a.target, document, overwrite=a.force)
        artifacts.write_json(a.report, report, overwrite=a.force)
    elif a.command == "context":
        windows = tuple(velocity.parse_window(w) for w in _names(a.windows)) or (3600, 21600, 86400)
        engine.ScoringChain.build(spark, a.target, rows, length=a.length, config=velocity.VelocityConfig(windows))
    else:
        from pyspark.ml.feature import VectorAssembler

        from tallystream.operators import models

        label = a.label or "is_fraud"
        features = _features(rows)
        parts = VectorAssembler(inputCols=features, outputCol="features").transform(rows).withColumn("label", F.col(label))
        found = models.search(a.kind or "logistic", parts.filter("partition = 'train'"), parts.filter("partition = 'validation'"), tries=a.tries)
        seal = models.save(found.model, a.target, overwrite=a.force)
        artifacts.write_json(a.report, artifacts.sealed(found.report | {"model_sha256": seal}), overwrite=a.force)


if __name__ == "__main__":
    main()
