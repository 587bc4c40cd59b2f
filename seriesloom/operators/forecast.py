"""Forecasts from neighbours: regression and Gaussian-process expert grids, mixing, metrics and the step-by-step driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns, gaussian
from ..functions.experts import Experts, mix


def knn_grid(train: DataFrame, ks: list[int], weight: str = "root") -> DataFrame:
    """query_id, len, k, mean, var of every expert, from rows (query_id, len, rank, dist, y): the first k neighbours, each
    by 1 / (w + 1e-4), where w is the root of the distance, the distance, or 1 (plain)."""
    w = {"root": F.sqrt("dist"), "dist": F.col("dist"), "plain": F.lit(1.0)}[weight]
    rows = train.select("*", F.explode(F.array(*(F.lit(k) for k in ks))).alias("k")).filter(F.col("rank") <= F.col("k")).withColumn("iw", 1 / (w + 1e-4))
    sums = rows.groupBy("query_id", "len", "k").agg(F.sum("iw").alias("s0"), F.sum(F.col("iw") * F.col("y")).alias("s1"), F.sum(F.col("iw") * F.col("y") * F.col("y")).alias("s2"))
    mean = F.col("s1") / F.col("s0")
    return sums.select("query_id", "len", "k", mean.alias("mean"), (F.greatest(F.col("s2") / F.col("s0") - mean * mean, F.lit(0.0)) + 1e-4).alias("var"))


def ensemble(grid: DataFrame) -> DataFrame:
    """query_id, mean, var: the experts (with weight) mixed."""
    w = F.col("weight")
    return grid.groupBy("query_id").agg((F.sum(w * F.col("mean")) / F.sum(w)).alias("mean"), (F.sum(w * F.col("var")) / F.sum(w)).alias("var"))


def errors(rows: DataFrame, compat: bool = False) -> DataFrame:
    """rows (y, mean, var) with ae, se, sse and nll."""
    y, m, v = F.col("y"), F.col("mean"), F.col("var")
    return rows.select("*", columns.absolute_error(y, m).alias("ae"), columns.square_error(y, m).alias("se"), columns.standard_square_error(y, m, v, compat).alias("sse"), columns.negative_log_likelihood(y, m, v, compat).alias("nll"))


def metrics(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("ae").alias("mae"), F.avg("se").alias("mse"), F.avg("sse").alias("msse"), F.avg("nll").alias("mnll"))


@dataclass(frozen=True)
class Settings:
    """lengths, ks: the expert grid. horizon: steps ahead minus one. band, window: of the search. steps: forecasts made
    one after another. model: knn or gp. self_correct: weights follow the experts' success. weighted: training rows count
    by distance. start: first length, sf and sn of the Gaussian process; sn starts from there at every step. exclude:
    starts within so many places of the query stay out."""

    lengths: tuple[int, ...] = (32, 64, 96)
    ks: tuple[int, ...] = (8, 16, 32)
    horizon: int = 20
    band: int = 8
    window: int = 16
    steps: int = 20
    model: str = "knn"
    self_correct: bool = True
    weighted: bool = False
    start: tuple[float, float, float] = (5.0, 1.0, 1.0)
    scg_steps: int = 5
    chunk: int = 1 << 12
    seed: int = 0


@dataclass
class GpGrid:
    """Gaussian-process experts with parameters that carry over from step to step."""

    s: Settings
    params: dict = field(default_factory=dict)

    def predict(self, train: dict[int, tuple], query: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means and variances of all (length, k); a sleeping expert gives 0 and 1."""
        s = self.s
        mean, var = np.zeros(len(active)), np.ones(len(active))
        for e, (length, k) in enumerate((a, b) for a in s.lengths for b in s.ks):
            x, y, dist = train[length]
            if not active[e] or len(y) < 2:
                continue
            x, y, w = x[:k], y[:k], gaussian.row_weights(dist[:k], s.weighted)
            shift, scale = y.mean(), max(float(np.concatenate([x.ravel(), y]).std()), 1e-9)
            xs, ys, qs = (x - shift) / scale, (y - shift) / scale, (query[len(query) - length :] - shift) / scale
            p = np.array([*self.params.get((length, k), s.start[:2]), s.start[2]])
            try:
                p, _ = gaussian.scg(lambda z: gaussian.loo_objective(z, xs, ys, w), p, s.scg_steps)
                m, v = gaussian.predict(p, xs, ys, qs[None])
                self.params[length, k] = p[:2]
                mean[e], var[e] = m[0] * scale + shift, max(v[0], 1e-9) * scale**2
            except np.linalg.LinAlgError:
                mean[e], var[e] = y.mean(), y.var() + 1e-4
        return mean, var


def knn_predict(s: Settings, train: dict[int, tuple]) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for length in s.lengths:
        _, y, dist = train[length]
        w = np.sqrt(dist) if s.weighted else np.ones(len(dist))
        out += [gaussian.knn_regression(y[:k], w[:k]) if len(y) else (np.nan, np.nan) for k in s.ks]
    m, v = np.array(out).T
    # an expert whose length has no neighbour says what the others say on average
    none = np.isnan(m)
    if none.any():
        m[none], v[none] = (0.0, 1.0) if none.all() else (m[~none].mean(), v[~none].mean())
    return m, v


def run_steps(s: Settings, neighbours, truth: np.ndarray, history: np.ndarray):
    """(step, mean, var, weights, means, vars) of each step. neighbours(step) gives length -> (x, y, dist); history holds
    the longest query and what follows; the prediction of a step is judged once its truth has come."""
    n = len(s.lengths) * len(s.ks)
    experts, grid, waiting = Experts(n, s.seed), GpGrid(s), []
    longest = max(s.lengths)
    for step in range(len(truth)):
        query = history[step : step + longest]
        train = neighbours(step)
        m, v = grid.predict(train, query, experts.active()) if s.model == "gp" else knn_predict(s, train)
        mean, var = mix(m, v, experts.weight)
        yield step, mean, var, experts.weight.copy(), m, v
        waiting.append((m, v))
        # the truth of step - horizon is the value that enters the next query
        if s.self_correct and step > s.horizon + 1:
            old = step - s.horizon
            experts.learn(float(history[step + longest]), *waiting[old])


FORECAST = "query_id string, sensor_id string, step int, mean double, var double, y double"


def continuous(series: DataFrame, s: Settings | None = None) -> DataFrame:
    """query_id, sensor_id, step, mean, var, y: forecasts of every sensor over its last `steps` known truths. A sensor whose
    history before them has no neighbour with a label gets its steps with null mean and var, and a null y too if it is
    shorter than the queries and truths themselves.

    The queries of all steps are known beforehand, so the search is one distributed index search over all steps; what is
    sequential, the weights, runs per sensor over its few neighbours only.
    """
    s = s or Settings()
    from .queries import cut_queries
    from .search import index_top_k
    from .series import lengths as sensor_lengths

    longest, k = max(s.lengths), max(s.ks)
    tail = longest + s.horizon + s.steps
    least = tail + min(s.lengths) + s.horizon + 1
    every = sensor_lengths(series)
    n = every.filter(F.col("n") >= least)
    starts = n.select("sensor_id", F.explode(F.sequence(F.lit(0), F.lit(s.steps - 1))).alias("step"), (F.col("n") - tail).alias("base")).select("sensor_id", "step", (F.col("base") + F.col("step")).alias("start"), "base")
    q = starts.join(cut_queries(series, starts, longest), ["sensor_id", "start"]).select(F.concat_ws("@", "sensor_id", "step").alias("query_id"), "sensor_id", "q", "start")
    # neighbours and their labels end before the queries begin, so nothing of the future is used
    past = series.join(n.select("sensor_id", (F.col("n") - tail).alias("base")), "sensor_id").filter(F.col("t") < F.col("base")).drop("base")
    found = index_top_k(past, q, list(s.lengths), k, s.band, s.window, reserve=s.horizon + 1, chunk=s.chunk)
    short = every.filter(F.col("n") < least).select("sensor_id", "n", F.explode(F.sequence(F.lit(0), F.lit(s.steps - 1))).alias("step"))
    truth = short.withColumn("t", F.when(F.col("n") >= tail, F.col("n") - s.steps + F.col("step"))).join(series, ["sensor_id", "t"], "left")
    none = F.lit(None).cast("double")
    missing = truth.select(F.concat_ws("@", "sensor_id", "step").alias("query_id"), "sensor_id", "step", none.alias("mean"), none.alias("var"), F.col("v").alias("y"))
    return replay(series, past, found, s, tail).unionByName(missing)


def replay(series: DataFrame, past: DataFrame, found: DataFrame, s: Settings, tail: int) -> DataFrame:
    from .gather import training_rows
    from .series import lengths as sensor_lengths

    rows = training_rows(past, found, s.horizon)
    if s.model == "gp":
        from .series import windows

        longest_rows = [rows.filter(F.col("len") == length).join(windows(past, length).withColumnRenamed("c", "x"), ["sensor_id", "start"]) for length in s.lengths]
        rows = longest_rows[0]
        for r in longest_rows[1:]:
            rows = rows.unionByName(r)
    else:
        rows = rows.withColumn("x", F.array().cast("array<double>"))
    packed = rows.groupBy("sensor_id").agg(F.collect_list(F.struct("query_id", "len", "rank", "dist", "y", "x")).alias("train"))
    n = sensor_lengths(series)
    ends = series.join(n, "sensor_id").filter(F.col("t") >= F.col("n") - tail).groupBy("sensor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda x: x.v).alias("history"))
    longest = max(s.lengths)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                by: dict = {}
                for r in sorted(row["train"], key=lambda r: r["rank"]):
                    by.setdefault((int(r["query_id"].rsplit("@", 1)[1]), r["len"]), []).append(r)
                history = np.array(row["history"])
                truth = history[longest + s.horizon :]

                def neighbours(step):
                    out = {}
                    for length in s.lengths:
                        rs = by.get((step, length), [])
                        out[length] = np.array([r["x"] for r in rs]).reshape(len(rs), -1), np.array([r["y"] for r in rs]), np.array([r["dist"] for r in rs])
                    return out

                out = [(f"{row['sensor_id']}@{step}", row["sensor_id"], step, m, v, float(truth[step])) for step, m, v, *_ in run_steps(s, neighbours, truth[: s.steps], history)]
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.int32()), *(pa.array(c, pa.float64()) for c in cols[3:])], names=["query_id", "sensor_id", "step", "mean", "var", "y"])

    return packed.join(ends, "sensor_id").mapInArrow(run, FORECAST)


def multi_step(series: DataFrame, found: DataFrame, ks: list[int], horizon: int) -> DataFrame:
    """query_id, h, len, k, mean, var: direct forecasts of the steps 0..horizon from the same neighbours, whose labels move
    one place each step."""
    from .gather import values_at

    each = found.select("*", F.explode(F.sequence(F.lit(0), F.lit(horizon))).alias("h"))
    rows = values_at(series, each, F.col("len") + F.col("h")).withColumn("query_id", F.concat_ws("|", "query_id", "h"))
    out = knn_grid(rows, ks)
    return out.select(F.substring_index("query_id", "|", 1).alias("query_id"), F.substring_index("query_id", "|", -1).cast("int").alias("h"), "len", "k", "mean", "var")


def iterative_grid(series: DataFrame, found: DataFrame, items: DataFrame, s: Settings, steps: int) -> DataFrame:
    """query_id, step, len, k, mean, var: every expert's forecasts of the next `steps` values, one after the other.

    An expert learns its parameters from its k neighbours and the values that followed them. Each prediction enters the
    expert's next input as an uncertain value, and its training rows move on: the oldest value leaves, the label enters and
    the value after it is the new label. found keeps `steps` places after each neighbour free; items: (query_id, q).
    """
    from .gather import subsequences

    parts = [subsequences(series, found.filter(F.col("len") == length), length + steps).withColumn("len", F.lit(length)) for length in s.lengths]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    packed = rows.groupBy("query_id").agg(F.collect_list(F.struct("len", "rank", "x")).alias("train")).join(items.select("query_id", "q"), "query_id")

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for length in s.lengths:
                    near = np.array([r["x"] for r in sorted(row["train"], key=lambda r: r["rank"]) if r["len"] == length])
                    for k in s.ks:
                        out += [(row["query_id"], step, length, k, m, v) for step, (m, v) in enumerate(_iterate(near[:k], np.array(row["q"])[-length:], s, steps))]
            if out:
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=["query_id", "step", "len", "k", "mean", "var"])

    return packed.mapInArrow(run, "query_id string, step int, len int, k int, mean double, var double")


def _iterate(near: np.ndarray, query: np.ndarray, s: Settings, steps: int):
    """(mean, var) of each step of one expert; near: its neighbours with the values after them."""
    n = len(query)
    if len(near) < 2:
        return
    first = near[:, : n + 1]
    shift, scale = first[:, n].mean(), max(float(first.std()), 1e-9)
    near, mean, cov = (near - shift) / scale, (query - shift) / scale, 1e-9 * np.eye(n)
    p, _ = gaussian.scg(lambda z: gaussian.loo_objective(z, near[:, :n], near[:, n]), np.array(s.start), s.scg_steps)
    for step in range(steps):
        m, v, cross = gaussian.predict_uncertain(p, near[:, step : step + n], near[:, step + n], mean, cov)
        v = max(v, 1e-9)
        yield m * scale + shift, v * scale**2
        mean, cov = gaussian.next_input(mean, cov, m, v, cross)


def gp_grid(train: DataFrame, items: DataFrame, s: Settings) -> DataFrame:
    """query_id, len, k, mean, var of Gaussian-process experts from rows (query_id, len, rank, dist, x, y) and items
    (query_id, q)."""
    packed = train.groupBy("query_id").agg(F.collect_list(F.struct("len", "rank", "dist", "y", "x")).alias("train")).join(items.select("query_id", "q"), "query_id")

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                rs = sorted(row["train"], key=lambda r: r["rank"])
                data = {length: (np.array([r["x"] for r in rs if r["len"] == length]), np.array([r["y"] for r in rs if r["len"] == length]), np.array([r["dist"] for r in rs if r["len"] == length])) for length in s.lengths}
                m, v = GpGrid(s).predict(data, np.array(row["q"]), np.ones(len(s.lengths) * len(s.ks), bool))
                out += [(row["query_id"], length, k, float(a), float(b)) for (length, k), a, b in zip(((x, y) for x in s.lengths for y in s.ks), m, v)]
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3]), pa.array(cols[4])], names=["query_id", "len", "k", "mean", "var"])

    return packed.mapInArrow(run, "query_id string, len int, k int, mean double, var double")

