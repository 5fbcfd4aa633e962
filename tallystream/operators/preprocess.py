"""Preprocessing fitted on training rows only: numbers, frequencies and categories to a model matrix.

Numbers: impute the median, log where asked, clip to two exact quantiles, standardise. Frequencies: the share of a category
in the training rows, and a flag for unseen ones. Categories: one column per training level, missing and unknown.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.functions.ranges import between
from tallystream.functions.scalars import age_years, clip, cyclical
from tallystream.functions.selection import quantiles, sketched, totals_of, values_at_places
from tallystream.operators.checks import MISSING, UNKNOWN, enforce, fill_category, require_columns, uses_reserved
from tallystream.operators.split import SplitConfig, load_manifest
from tallystream.sources.artifacts import content_digest, digest, digest_of, digest_parts, opened, sealed
from tallystream.sources.observed import checked_table
from tallystream.sources.shared import drop_table, written

KIND, VERSION = "preprocessor", 2
#: Levels of a frequency column that the fitted state holds itself, levels of a category that become columns, at most; the mark of
#: shares that are a table.
SHARE_LIMIT, MOST_LEVELS, TABLE = 100_000, 10_000, "__table"


@dataclass(frozen=True)
class PreprocessConfig:
    numeric: tuple[str, ...]
    frequency: tuple[str, ...] = ()
    nominal: tuple[str, ...] = ()
    log1p: tuple[str, ...] = ()
    nonnegative: tuple[str, ...] = ()
    lower: float = 0.005
    upper: float = 0.995

    def __post_init__(self):
        if not {*self.log1p, *self.nonnegative} <= set(self.numeric):
            raise ValueError("logged and nonnegative columns must be numeric ones")
        if len({*self.numeric, *self.frequency, *self.nominal}) < len(self.numeric) + len(self.frequency) + len(self.nominal):
            raise ValueError("a column has one role")
        if not 0 <= self.lower < self.upper <= 1:
            raise ValueError("quantiles must be ordered and within 0 and 1")

    def inputs(self) -> list[str]:
        return [*self.numeric, *self.frequency, *self.nominal]


def derived_columns(display: Column, birth: Column) -> dict[str, Column]:
    """Age in years and the cyclical hour, weekday and month of a display time."""
    out = {"age_years": age_years(display.cast("date"), birth)}
    for name, value, period in (("hour", F.hour(display), 24), ("day", F.weekday(display), 7), ("month", F.month(display) - 1, 12)):
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclical(value, period)
    return out


@dataclass(frozen=True)
class Preprocessor:
    """The fitted state: per number its median, bounds, mean and scale; shares; levels; what identifies the training rows. Small,
    and kept on the driver; shares of very many levels are a table."""

    config: PreprocessConfig
    stats: dict[str, dict[str, float]]
    shares: dict[str, dict[str, float]]
    levels: dict[str, list[str]]
    rows: int
    context: dict = field(default_factory=dict)

    def __post_init__(self):
        for name, s in self.stats.items():
            if not (s["scale"] > 0 and s["low"] <= s["mean"] <= s["high"]):
                raise ValueError(f"broken statistics of {name}")
        for name, shares in self.shares.items():
            if TABLE not in shares and abs(sum(shares.values()) - 1) > 1e-9:
                raise ValueError(f"the shares of {name} do not add up to 1")

    def names(self) -> list[str]:
        """Output columns in order: numbers, frequencies, categories."""
        out = [f"num__{'log1p_' if c in self.config.log1p else ''}{c}" for c in self.config.numeric]
        for c in self.config.frequency:
            out += [f"freq__{c}", f"freq__{c}__unknown"]
        return out + [f"cat__{c}__{v}" for c in self.config.nominal for v in self.levels[c]]

    def number(self, name: str) -> Column:
        s = self.stats[name]
        value = logged(imputed(F.col(name), s["median"]), name in self.config.log1p)
        return (clip(value, s["low"], s["high"]) - s["mean"]) / s["scale"]

    def _level(self, name: str) -> Column:
        value = fill_category(F.col(name))
        return F.when(value.isin(self.levels[name]), value).otherwise(UNKNOWN)

    def transform(self, df: DataFrame, keep: list[str] = (), *, share_limit: int = 2000) -> DataFrame:
        """``keep`` and the output columns. Shares of up to ``share_limit`` levels are looked up in a literal map, whose size
        is known; larger tables are joined."""
        require_columns(df, self.config.inputs())
        out: list[Column] = [self.number(c).cast("float").alias(n) for c, n in zip(self.config.numeric, self.names(), strict=False)]
        spark, rows = df.sparkSession, df
        for c in self.config.frequency:
            shares = self.shares[c]
            if TABLE in shares:
                table = spark.read.parquet(shares[TABLE]).select(F.col("v").alias(f"__k_{c}"), F.col("share").alias(f"__s_{c}"))
                rows, share = rows.join(table, fill_category(F.col(c)) == F.col(f"__k_{c}"), "left"), F.col(f"__s_{c}")
            elif len(shares) <= share_limit:
                table = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]) if shares else F.lit(None).cast("map<string,double>")
                share = F.try_element_at(table, fill_category(F.col(c)))
            else:
                table = spark.createDataFrame(list(shares.items()), f"`__k_{c}` string, `__s_{c}` double")
                rows, share = rows.join(table, fill_category(F.col(c)) == F.col(f"__k_{c}"), "left"), F.col(f"__s_{c}")
            out += [F.coalesce(share, F.lit(0.0)).cast("float").alias(f"freq__{c}"), share.isNull().cast("float").alias(f"freq__{c}__unknown")]
        for c in self.config.nominal:
            level = self._level(c)
            out += [(level == v).cast("float").alias(f"cat__{c}__{v}") for v in self.levels[c]]
        return rows.select(*keep, *out)

    def sampler_frame(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """Standardised numbers and shares, with categories not yet encoded."""
        out = self.transform(df.select("*"), [*keep, *[self._level(c).alias(c) for c in self.config.nominal]])
        return out.drop(*[n for n in self.names() if n.startswith("cat__")])

    def from_sampler_frame(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """The matrix of a sampler frame (and of synthetic rows like it): numbers and shares must be finite, categories be known
        levels."""
        numbers = [n for n in self.names() if not n.startswith("cat__")]
        require_columns(df, [*numbers, *self.config.nominal])
        rules = {n: F.coalesce(~F.isnan(f"`{n}`") & (F.abs(F.col(f"`{n}`")) != float("inf")), F.lit(False)) for n in numbers}
        enforce(df, rules | {c: F.col(c).isin(self.levels[c]) for c in self.config.nominal})
        encoded = [(F.col(c) == v).cast("float").alias(f"cat__{c}__{v}") for c in self.config.nominal for v in self.levels[c]]
        return df.select(*keep, *[F.col(f"`{n}`").cast("float").alias(n) for n in numbers], *encoded)

    def to_dict(self) -> dict:
        c = self.config
        config = {"numeric": list(c.numeric), "frequency": list(c.frequency), "nominal": list(c.nominal), "log1p": list(c.log1p), "nonnegative": list(c.nonnegative), "lower": c.lower, "upper": c.upper}
        return sealed({"type": KIND, "version": VERSION, "config": config, "stats": self.stats, "shares": self.shares, "levels": self.levels, "rows": self.rows, "context": self.context})

    @classmethod
    def from_dict(cls, document: dict) -> Preprocessor:
        d = opened(document, kind=KIND, version=VERSION)
        config = PreprocessConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in d["config"].items()})
        return cls(config, d["stats"], d["shares"], d["levels"], d["rows"], d["context"])

    def schema_digest(self) -> str:
        """Of the output columns, in order."""
        return digest(self.names())

    def check_table(self, spark: SparkSession, name: str) -> None:
        """Raise unless the shares of a column that are a table are those that were fitted."""
        kept = self.shares[name]
        if TABLE in kept and content_digest(spark.read.parquet(kept[TABLE]), ["v", "share"]) != (kept["rows"], kept["sha256"]):
            raise ValueError(f"the shares of {name} were changed after they were fitted")


def imputed(value: Column, median: float) -> Column:
    plain = value.cast("double")
    return F.coalesce(F.when(~F.isnan(plain), plain), F.lit(median))


def logged(value: Column, do: bool) -> Column:
    return F.log1p(value) if do else value


def _finite(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def number_rules(df: DataFrame, names: list[str], nonnegative: list[str] = ()) -> dict[str, Column]:
    """Numbers are missing or finite (text that is no number is malformed), and not negative where that is asked."""
    rules = {}
    for c in names:
        value = F.col(c).try_cast("double")
        rules[f"{c}_malformed"] = F.col(c).isNull() | value.isNotNull()
        rules[f"{c}_finite"] = value.isNull() | (~F.isnan(value) & (F.abs(value) != float("inf")))
        if c in nonnegative:
            rules[f"{c}_negative"] = F.coalesce(value >= 0, F.lit(True))
    return rules


def context_parts(by: SplitConfig, columns: list[str]) -> dict[str, Column]:
    """Aggregates of training rows that ``bound_context`` is made of."""
    labels = [F.count_if(F.col(by.label) == v) for v in (0, 1)] if by.label in columns else [F.lit(None).cast("long")] * 2
    out = {"first_time": F.min(by.time), "last_time": F.max(by.time), "negatives": labels[0], "positives": labels[1]}
    return {k: v if k in ("first_time", "last_time") or by.label in columns else F.max(v) for k, v in out.items()} | digest_parts(["__t", "__k"])


def _bound(rows: int, found: dict, by: SplitConfig, manifest: dict | None) -> dict:
    out = {"rows": rows} | {k: found[k] for k in ("first_time", "last_time", "negatives", "positives")}
    # The digest of keys and times that ``ordered_digest`` gives.
    out["key_sha256"] = digest_of(rows, found)
    if manifest is not None:
        document = load_manifest(manifest)
        if document["roles"] != {"time": by.time, "label": by.label, "key": by.key}:
            raise ValueError("the manifest was made for other columns")
        train = document["partitions"]["train"]
        if wrong := [k for k in out if out[k] != train[k]]:
            raise ValueError(f"the training rows are not those of the manifest: {', '.join(wrong)}")
        out["split_sha256"] = document["sha256"]
    return out


def bound_context(df: DataFrame, by: SplitConfig, manifest: dict | None = None) -> dict:
    """Rows, first and last time, labels and key digest of training rows; with a sealed split manifest they must be those of its
    training partition, and the manifest's digest is kept."""
    require_columns(df, [by.time, by.key] + ([by.label] if manifest else []))
    rows = df.withColumns({"__t": F.col(by.time), "__k": F.col(by.key).cast("string")})
    found = rows.agg(F.count("*").alias("rows"), *[c.alias(name) for name, c in context_parts(by, df.columns).items()]).first().asDict()
    return _bound(found["rows"], found, by, manifest)


def fit(df: DataFrame, config: PreprocessConfig, *, partition: str = "train", by: SplitConfig | None = None, manifest: dict | None = None, share_path: str | None = None, share_limit: int = SHARE_LIMIT) -> Preprocessor:
    """Fit on training rows. These are read once: the columns that are needed are written, and all checks and what identifies the
    rows ride on that write. The rest reads the written columns, and no task holds one.

    Numbers must be missing or finite. With ``by`` the fitted state keeps what identifies the training rows, and with the sealed
    ``manifest`` of a split these must be its own. A frequency column of more than ``share_limit`` levels stays a table below
    ``share_path``, which is then required.
    """
    if partition != "train":
        raise ValueError("statistics come from training rows only")
    if manifest is not None and by is None:
        raise ValueError("a manifest names columns: give them, too")
    require_columns(df, config.inputs())
    rules = {f"{c}_reserved": ~uses_reserved(F.col(c)) for c in [*config.frequency, *config.nominal]}
    rules |= number_rules(df, list(config.numeric), [*config.log1p, *config.nonnegative])
    names, more = list(config.inputs()), {}
    rows = df
    if by is not None:
        require_columns(df, [by.time, by.key] + ([by.label] if manifest else []))
        rows = df.withColumns({"__t": F.col(by.time), "__k": F.col(by.key).cast("string")})
        names += [by.time, by.label, "__t", "__k"]
        more = context_parts(by, df.columns)
    df, n, found = checked_table(rows.select(*[c for c in dict.fromkeys(names) if c in rows.columns]), "training-columns", rules, more)
    if not n:
        drop_table(df)
        raise ValueError("no training rows")
    context = _bound(n, found, by, manifest) if by is not None else {}
    stats = _number_stats(df, config, n)

    categories = [*config.frequency, *config.nominal]
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), fill_category(F.col(c)).alias("v")) for c in categories]))) if categories else None
    counts = written(long.groupBy("feature", "v").agg(F.count("*").alias("n")), "category-counts") if categories else None
    sizes = {r["feature"]: r["count"] for r in counts.groupBy("feature").count().collect()} if categories else {}
    shares: dict = {}
    for c in config.frequency:
        mine = counts.filter(F.col("feature") == c).select("v", (F.col("n") / n).alias("share"))
        if sizes[c] <= share_limit:
            shares[c] = {r["v"]: r["share"] for r in mine.collect()}
        elif share_path is None:
            raise ValueError(f"{c} has {sizes[c]} levels: a share_path is needed")
        else:
            mine.write.parquet(f"{share_path}/{c}")
            rows, seal = content_digest(df.sparkSession.read.parquet(f"{share_path}/{c}"), ["v", "share"])
            shares[c] = {TABLE: f"{share_path}/{c}", "rows": rows, "sha256": seal}
    if wide := [c for c in config.nominal if sizes[c] > MOST_LEVELS]:
        raise ValueError(f"a column for each level would be too many: {', '.join(wide)}")
    levels = {c: sorted({r["v"] for r in counts.filter(F.col("feature") == c).collect()} - {MISSING}) + [MISSING, UNKNOWN] for c in config.nominal}
    for table in (df, counts):
        if table is not None:
            drop_table(table)
    return Preprocessor(config, stats, shares, levels, n, context)


def _number_stats(df: DataFrame, config: PreprocessConfig, n: int) -> dict[str, dict[str, float]]:
    """Median, bounds, mean and scale of each number, by passes over the rows that shuffle a few thousandths of the values.

    Imputation adds the missing rows at the median, and the logarithm keeps the order, so quantiles of the values to come are
    found at places of the order of the values as they are.
    """
    names = list(config.numeric)
    if not names:
        return {}
    columns = {c: _finite(c) for c in names}
    rows = df.select(*[columns[c].alias(f"c{i}") for i, c in enumerate(names)])
    columns = {c: F.col(f"c{i}") for i, c in enumerate(names)}
    held, sketches = totals_of(rows, columns), sketched(rows, columns)
    found = quantiles(rows, columns, [0.5], totals=held, sketches=sketches)
    medians = {c: float(found[c][0]) if c in found else 0.0 for c in names}
    order = rows.agg(*[F.count_if(columns[c] < medians[c]).alias(f"a{i}") for i, c in enumerate(names)], *[F.count_if(columns[c] == medians[c]).alias(f"e{i}") for i, c in enumerate(names)]).first()
    spots = [p * (n - 1) for p in (config.lower, config.upper)]
    places = {}
    for i, c in enumerate(names):
        missing, below, equal = n - held[c], order[f"a{i}"], order[f"e{i}"]
        # The place in the order of the values as they are; None stands for the median, with the missing rows.
        places[c] = {x: x if x < below else None if x < below + equal + missing else x - missing for p in spots for x in (math.floor(p), math.ceil(p))}
    raw = values_at_places(rows, columns, {c: {x for x in own.values() if x is not None} for c, own in places.items() if any(x is not None for x in own.values())}, held, sketches=sketches)
    final = lambda c, v: math.log1p(v) if c in config.log1p else v
    bounds = {c: [between(p, {x: final(c, medians[c] if at is None else raw[c][at]) for x, at in places[c].items()}) for p in spots] for c in names}

    # Moments about the clipped median, which lies near the mean; missing rows are at the centre and add nothing.
    centre = {c: min(max(final(c, medians[c]), bounds[c][0]), bounds[c][1]) for c in names}
    off = {c: F.when(columns[c].isNotNull(), clip(logged(columns[c], c in config.log1p), *bounds[c]) - centre[c]) for c in names}
    sums = rows.agg(*[F.sum(off[c]).alias(f"one{i}") for i, c in enumerate(names)], *[F.sum(off[c] * off[c]).alias(f"two{i}") for i, c in enumerate(names)]).first()
    out = {}
    for i, c in enumerate(names):
        (low, high), one, two = bounds[c], (sums[f"one{i}"] or 0.0) / n, (sums[f"two{i}"] or 0.0) / n
        spread = math.sqrt(max(0.0, two - one * one))
        out[c] = {"median": medians[c], "low": low, "high": high, "mean": min(max(centre[c] + one, low), high), "scale": spread if spread >= 1e-12 else 1.0}
    return out


def long_form(matrix: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, feature, value) for every column of a matrix."""
    return matrix.select(key, F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").cast("double").alias("value")) for n in names])))


def as_vector(matrix: DataFrame, names: list[str], name: str = "features") -> DataFrame:
    """Assemble the columns to one vector, sparse where that is smaller."""
    from pyspark.ml.feature import VectorAssembler

    safe = {n: f"__f{i}" for i, n in enumerate(names)}
    renamed = matrix.select("*", *[F.col(f"`{n}`").alias(s) for n, s in safe.items()])
    return VectorAssembler(inputCols=list(safe.values()), outputCol=name).transform(renamed).drop(*safe.values(), *names)
