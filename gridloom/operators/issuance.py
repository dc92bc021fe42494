"""Walk-forward forecasts with own, cross-stock and factor terms, and resampled inference.

Work is grouped by (target, slice): a group holds the target's history once, takes every so many-th tuning block
or checkpoint of it, and fits their samples, beginnings of that history, from sums of products along it.  A block is
tuned once and fits depend on their sample alone, so groups are independent, as many as cores ask for.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import lasso
from gridloom.operators.har import HORIZONS, by_symbol, features
from gridloom.operators.tasks import sliced, slices
from gridloom.sources import ledgers

TERMS = ("d", "w", "m")
LEAST = 60
# Tuning blocks whose origins are fitted as one stack.
BLOCKS_AT_ONCE = 16
# Edge bootstraps: the first checkpoint, which is also the least training rows, the step, and the coefficient that counts as selected.
FIRST_CHECKPOINT, CHECKPOINT_STEP, SELECTED = 252, 126, 1e-8


def wide_design(design: DataFrame, symbols: list[str]) -> DataFrame:
    """One row an origin with all symbols' terms (stock by stock, then d, w, m): session_no, terms."""
    cells = F.struct(*[F.col(t) for t in TERMS])
    rows = design.groupBy("session_no").pivot("symbol", symbols).agg(F.first(cells))
    terms = F.array(*(F.col(f"`{s}`.{t}") for s in symbols for t in TERMS))
    return rows.select("session_no", terms.alias("terms"))


def blocks(design: DataFrame, symbols: list[str], every: int, extra: DataFrame | None = None) -> DataFrame:
    """One row a (symbol, tuning block): its origins, and all finite rows before the block's last origin.

    A group's rows are origins of one target, days not ticks; training rows are those whose response
    is known by the close of the origin.
    """
    rows = design.select("symbol", "session_no", "target_no", "response").join(wide_design(design, symbols), "session_no")
    if extra is not None:
        rows = rows.join(extra, "session_no")
    whole = ~F.exists("terms", lambda x: x.isNull())
    rows = rows.filter(whole & F.col("target_no").isNotNull())
    order = F.row_number().over(by_symbol())
    numbered = rows.withColumn("row_no", order)
    return numbered.withColumn("block", F.floor((F.col("row_no") - 1) / every).cast("long"))


def factor_terms(series: DataFrame, days: DataFrame, names: list[str]) -> DataFrame:
    """The d, w and m terms of factor series (session_no, symbol, y), a column each: name_d, name_w, name_m."""
    full = days.select("session_no", "day", F.explode(F.array(*map(F.lit, names))).alias("symbol")).join(series, ["session_no", "symbol"], "left")
    wide = features(full).groupBy("session_no").pivot("symbol", names).agg(F.first(F.struct(*TERMS)))
    return wide.select("session_no", *(F.col(f"`{s}`.{t}").alias(f"{s}_{t}") for s in names for t in TERMS))


def forecasts(rows: DataFrame, symbols: list[str], every: int, aggregate: list[str] = (), local: list[str] = (), since: DataFrame | None = None) -> DataFrame:
    """Forecasts of every origin that has LEAST rows to train on.

    Models: persistence; own_har; network_1se and network_min (lasso on the other symbols' terms); and,
    where factor terms are given, aggregate_har and local_har (own and those terms) and hybrid_har
    (own and aggregate terms unpenalised, lasso on the others, tuned for itself).
    since (symbol, from_block): blocks before a symbol's are left out.
    """
    at, resuming = {s: i for i, s in enumerate(symbols)}, since is not None

    def run(key, part):
        part = part.sort_values("session_no")
        symbol, turn = key
        terms = np.stack(part["terms"].to_numpy()).astype(float)
        mine = np.arange(3 * at[symbol], 3 * at[symbol] + 3)
        y, sessions, targets, block = (part[c].to_numpy() for c in ("response", "session_no", "target_no", "block"))
        ok = np.isfinite(y.astype(float))
        x = np.column_stack([np.ones(len(part)), terms[:, mine], part[list(aggregate)].to_numpy(float), part[list(local)].to_numpy(float), np.delete(terms, mine, 1)])
        history = lasso.History(x[ok, 1:], np.zeros((ok.sum(), 0)), y[ok].astype(float))
        # Targets follow their origins' order, so what an origin knows is a beginning of the history.
        known = np.searchsorted(targets[ok], sessions, "right")
        own = np.arange(4)
        more, near, cross = np.split(np.arange(4, x.shape[1]), [len(aggregate), len(aggregate) + len(local)])
        last = np.array([x.shape[1]])
        # Columns that aren't penalised and that are, and the models fitted on them with the rule of their penalty.
        kinds = [(own, cross[:0], (("own_har", None),)), (own, cross, (("network_1se", "one_se"), ("network_min", "min")))]
        if aggregate:
            with_aggregate = np.concatenate([own, more])
            kinds += [(with_aggregate, cross[:0], (("aggregate_har", None),)), (with_aggregate, cross, (("hybrid_har", "one_se"),))]
        if local:
            kinds.append((np.concatenate([own, near]), cross[:0], (("local_har", None),)))
        first = part["from_block"].iloc[0] if resuming else np.nan
        issued = (known >= LEAST) & ((block >= first) | pd.isna(first)) & (block % part["slices"].iloc[0] == turn)
        mine_blocks, parts = np.unique(block[issued]), []
        for some in (mine_blocks[i : i + BLOCKS_AT_ONCE] for i in range(0, len(mine_blocks), BLOCKS_AT_ONCE)):
            origins = np.flatnonzero(issued & (block >= some[0]) & (block <= some[-1]))
            ns, of = known[origins], np.searchsorted(some, block[origins])
            heads = ns[np.searchsorted(of, np.arange(len(some)))]  # a block is tuned once, at its first origin
            grams, fits = history.grams(ns), []
            for free, penalised, models in kinds:
                pick = np.concatenate([free, penalised, last])
                tuned = lasso.tune_all(history, heads, pick, len(free)) if len(penalised) else []
                alphas = np.array([[tuned[i][rule] if rule else 0.0 for _, rule in models] for i in of])
                b = lasso.path_all(grams[:, pick[:, None], pick], ns, len(free), alphas)
                for k, (model, rule) in enumerate(models):
                    whole = np.zeros((len(origins), x.shape[1]))
                    whole[:, pick[:-1]] = b[:, k]
                    fits.append((model, whole, alphas[:, k], (np.abs(b[:, k, len(free) :]) > 0).sum(1), [tuned[i]["status"] if rule else "none" for i in of]))
            smears = lasso.smearing_all(history, ns, np.stack([f[1] for f in fits]), [np.flatnonzero(of == i) for i in range(len(some))])
            base = {"symbol": symbol, "origin_no": sessions[origins].astype(int), "target_no": targets[origins].astype(int), "n_train": ns, "tuning_block": block[origins].astype(int)}
            level = x[origins, 1]
            parts.append(pd.DataFrame(base | {"model": "persistence", "log_forecast": level, "forecast": lasso.levels(level, 1.0), "penalty": 0.0, "n_selected": 0, "tuning_status": "none"}))
            for (model, whole, alpha, selected, status), smear in zip(fits, smears):
                level = history.base[-1] + ((x[origins] - history.base[:-1]) * whole).sum(1)
                parts.append(pd.DataFrame(base | {"model": model, "log_forecast": level, "forecast": lasso.levels(level, smear), "penalty": alpha, "n_selected": selected, "tuning_status": status}))
        return pd.concat(parts) if parts else pd.DataFrame([])

    schema = "symbol string, origin_no int, target_no int, model string, n_train int, log_forecast double, forecast double, penalty double, n_selected int, tuning_block bigint, tuning_status string"
    spread = rows if since is None else rows.join(since, "symbol", "left")
    return sliced(spread, "symbol", groups=len(symbols)).groupBy("symbol", "slice").applyInPandas(run, schema)


def resumed(rows: DataFrame, symbols: list[str], every: int, path: str, aggregate: list[str] = (), local: list[str] = ()) -> DataFrame:
    """The ledger of `forecasts` below `path`, with what it lacked of these rows appended.

    A block is tuned at its first origin, from what was known then, so a ledger that stopped within a block goes
    on with the same penalty; blocks before a symbol's last one are not fitted again.  A write is whole or absent, and
    rows that are there are not written twice, so a call that failed is simply repeated.  A ledger of another
    configuration, or one whose rows have changed up to its last origin (beyond 6 digits), raises ValueError.
    """
    spark = rows.sparkSession
    config = {"symbols": list(symbols), "every": every, "aggregate": list(aggregate), "local": list(local), "least": LEAST, "terms": TERMS, "fractions": lasso.FRACTIONS, "folds": lasso.FOLDS}
    state, ledger = f"{path}/state", f"{path}/ledger"
    inputs = rows.select("symbol", "session_no", "target_no", F.round("response", 6).alias("response"), F.transform("terms", lambda x: F.round(x, 6)).alias("terms"), *(F.round(c, 6).alias(c) for c in (*aggregate, *local)))
    since = None
    if ledgers.exists(spark, state):
        old = ledgers.read_json(spark, state)
        if not ledgers.may_resume(old, config):
            raise ValueError("the ledger was written under another configuration")
        if ledgers.frame_hash(inputs.filter(F.col("session_no") <= old["through"])) != old["inputs"]:
            raise ValueError("rows that the ledger was made of have changed")
    if ledgers.exists(spark, f"{ledger}/_SUCCESS"):
        since = spark.read.parquet(ledger).groupBy("symbol").agg(F.max("tuning_block").alias("from_block"))
    new = forecasts(rows, symbols, every, aggregate, local, since)
    if since is not None:
        new = new.join(spark.read.parquet(ledger).select("symbol", "origin_no", "model"), ["symbol", "origin_no", "model"], "left_anti")
    new.write.option("compression", "zstd").mode("append").parquet(ledger)
    through = rows.agg(F.max("session_no")).first()[0]
    ledgers.write_json(spark, {"config_hash": ledgers.config_hash(config), "through": through or 0, "inputs": ledgers.frame_hash(inputs)}, state)
    return spark.read.parquet(ledger)


def loss_bootstrap(dates: DataFrame, replications: int, length: int, seed: int, per_task: int = 100) -> DataFrame:
    """Circular moving-block bootstrap of the mean daily difference; one row for every `per_task` replications' draws.

    The series is one number a date; it goes to every task whole, as blocks need their neighbours.
    """
    series = dates.agg(F.transform(F.array_sort(F.collect_list(F.struct("target_no", "x"))), lambda r: r["x"]).alias("x"))
    tasks = dates.sparkSession.range(-(-replications // per_task)).withColumnRenamed("id", "task").join(F.broadcast(series))

    def run(parts):
        for part in parts:
            rows = []
            for task, x in zip(part["task"], part["x"]):
                x = np.asarray(x, float)
                for rep in range(int(task) * per_task, min((int(task) + 1) * per_task, replications)):
                    rows.append((rep, float(x[lasso.block_draw(np.random.default_rng([seed, rep]), len(x), length, True)].mean()) if len(x) else None))
            yield pd.DataFrame(rows, columns=["rep", "mean"])

    return tasks.mapInPandas(run, "rep int, mean double")


def bootstrap_interval(draws: DataFrame, dates: DataFrame) -> DataFrame:
    """Percentile interval and the p-value of the centred draws."""
    seen = dates.agg(F.avg("x").alias("observed"))
    j = draws.join(F.broadcast(seen))
    q = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    g = j.groupBy("observed").agg(F.count(F.lit(1)).alias("n"), q.alias("q"), F.avg((F.abs(F.col("mean") - F.col("observed")) >= F.abs("observed")).cast("double")).alias("p_value"))
    return g.select("observed", "n", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "p_value")


def edge_bootstrap(rows: DataFrame, symbols: list[str], replications: int, lengths: int | tuple[int, ...], seed: int, circular: bool, fraction: float | None = 0.1, first: int = FIRST_CHECKPOINT, every: int = CHECKPOINT_STEP) -> DataFrame:
    """How often each cross term is selected, and with which sign, in block resamples of all training rows.

    Checkpoints are the `first` origin, each `every` after it and the last; a checkpoint trains on the finite rows
    of all origins before it.  A group is a target at a checkpoint: its penalty, of the observed rows, is kept over
    the draws.  It is tuned by the one-SE rule where `fraction` is None, else that part of the top penalty.  Circular draws are shared: each target takes those of the longest one, modulo its
    own rows.  Plain draws are each target's own.
    """
    lengths = (lengths,) if isinstance(lengths, int) else tuple(lengths)
    month, at = HORIZONS["m"], {s: i for i, s in enumerate(symbols)}
    # Origins are counted on the calendar: the first is the session that ends the first full month.
    last = rows.agg((F.max("session_no") - month).cast("int").alias("last"))
    steps = last.filter(F.col("last") >= first).select(F.explode(F.array_distinct(F.concat(F.sequence(F.lit(first), "last", F.lit(every)), F.array("last")))).alias("checkpoint"))
    known = rows.filter("response is not null")
    # Rows by the checkpoint that is the first to know them, added up: how many each target has at each checkpoint.
    before = F.greatest(F.ceil((F.col("session_no") - month + 1 - first) / every), F.lit(0)) * every + first
    met = known.join(F.broadcast(last), F.col("session_no") - month < F.col("last")).groupBy("symbol", F.least(before, "last").alias("met")).agg(F.count(F.lit(1)).alias("k"))
    counts = steps.join(met, F.col("met") <= F.col("checkpoint")).groupBy("checkpoint", "symbol").agg(F.sum("k").alias("n"))
    longest = counts.groupBy("checkpoint").agg(F.max("n").cast("int").alias("longest"))
    spread = sliced(known, "symbol", groups=len(symbols))

    def run(key, part, points):
        symbol, turn = key
        part = part.sort_values("session_no")
        if not len(part) or not len(points):
            return pd.DataFrame([])
        points = points.sort_values("checkpoint")
        terms, y, sessions = np.stack(part["terms"].to_numpy()).astype(float), part["response"].to_numpy(float), part["session_no"].to_numpy()
        mine = np.arange(3 * at[symbol], 3 * at[symbol] + 3)
        history = lasso.History(terms[:, mine], np.delete(terms, mine, 1), y)
        names, out = [(s, t) for s in symbols if s != symbol for t in TERMS], []
        for checkpoint, longest in zip(points["checkpoint"], points["longest"]):
            n = int(np.searchsorted(sessions, checkpoint + month, "left"))
            if n < first:
                continue
            size = np.array([n])
            penalty = lasso.tune_all(history, size)[0]["one_se"] if fraction is None else fraction * float(lasso.top_penalties(history.grams(size), size, history.own)[0])
            for length in lengths:
                if circular:
                    draws = (lasso.block_draw(np.random.default_rng([seed, int(checkpoint), rep]), int(longest), length, True) % n for rep in range(replications))
                else:
                    draws = (lasso.block_draw(np.random.default_rng([seed, int(checkpoint), length, at[symbol], rep]), n, length, False) for rep in range(replications))
                grams, drawn = lasso.resampled(history, draws, n)
                b = lasso.path_all(grams, drawn, history.own, np.full((replications, 1), penalty))[:, 0, history.own :]
                base = {"checkpoint": int(checkpoint), "training_end": int(checkpoint) + month - 1, "n_train": n, "block_length": length, "penalty": penalty, "target": symbol}
                chosen, middle = (np.abs(b) > SELECTED).mean(0), np.median(b, 0)
                out += [base | {"source": s, "horizon": t.upper(), "n": replications, "selection_probability": float(chosen[j]), "n_positive": int((b[:, j] > 0).sum()), "n_negative": int((b[:, j] < 0).sum()), "median_coefficient": float(middle[j])} for j, (s, t) in enumerate(names)]
        return pd.DataFrame(out)

    schema = "checkpoint int, training_end int, n_train int, block_length int, penalty double, target string, source string, horizon string, n bigint, selection_probability double, n_positive bigint, n_negative bigint, median_coefficient double"
    # A slice takes every so many-th checkpoint.
    turn = (F.row_number().over(Window.orderBy("checkpoint")) - 1) % slices(rows.sparkSession, len(symbols))
    turns = longest.withColumn("slice", turn.cast("int")).withColumn("symbol", F.explode(F.array(*map(F.lit, symbols))))
    return spread.groupBy("symbol", "slice").cogroup(turns.select("symbol", "slice", "checkpoint", "longest").groupBy("symbol", "slice")).applyInPandas(run, schema)


def sign_consistency(edges: DataFrame) -> DataFrame:
    """The share of an edge's nonzero draws that have its commoner sign; null where all draws are zero."""
    nonzero = F.col("n_positive") + F.col("n_negative")
    return edges.withColumn("sign_consistency", F.when(nonzero > 0, F.greatest("n_positive", "n_negative") / nonzero))
