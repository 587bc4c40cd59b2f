"""The engine's front: search sessions, forecasts, the inverted-list engine and Gaussian-process estimates."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame

from .functions.gaussian import SparseGp, loo_objective, predict, scg
from .operators import forecast, invlist, search
from .operators import queries as q
from .operators.forecast import Settings
from .sources.storage import stored


@dataclass
class KnnSearch:
    """A search session over series (sensor_id, t, v). mode: d2q, q2d or both bounds. reserve: last places kept out."""

    series: DataFrame
    lengths: tuple[int, ...] = (32, 64, 96)
    k: int = 32
    band: int = 8
    window: int = 16
    reserve: int = 0
    mode: str = "both"
    chunk: int = 1 << 12

    def __post_init__(self):
        if list(self.lengths) != sorted(set(self.lengths)) or min(self.lengths) < 1:
            raise ValueError("lengths have to ascend")
        if self.mode not in ("d2q", "q2d", "both"):
            raise ValueError("mode has to be d2q, q2d or both")
        if self.k < 1 or self.window < 1 or self.chunk < 1 or self.band < 0 or self.reserve < 0:
            raise ValueError("k, window and chunk have to be positive, band and reserve not negative")

    def top_k(self, queries: DataFrame, two_pass: bool = True) -> DataFrame:
        """The k nearest subsequences of every query (query_id, sensor_id, start, q) and length."""
        return search.index_top_k(self.series, queries, list(self.lengths), self.k, self.band, self.window, self.reserve, self.mode, chunk=self.chunk, two_pass=two_pass)

    def latest(self) -> DataFrame:
        """The same for each sensor's latest history."""
        found = q.latest(self.series, max(self.lengths))
        return self.top_k(found.selectExpr("sensor_id AS query_id", "sensor_id", "start", "q"))


@dataclass
class InvertedIndex:
    """The inverted-list engine over windows of bucket values (sensor_id, start, c): postings are written once; queries
    (query_id, sensor_id, dim, kw) can be set, and replaced one by one, between searches."""

    windows: DataFrame
    dims: int
    queries: DataFrame | None = None

    def __post_init__(self):
        if self.dims < 1:
            raise ValueError("dims has to be positive")
        self.postings = stored(invlist.postings(self.windows), "postings")

    def set_queries(self, queries: DataFrame) -> InvertedIndex:
        if missing := {"query_id", "sensor_id", "dim", "kw"} - set(queries.columns):
            raise ValueError(f"queries lack {sorted(missing)}")
        self.queries = queries.select("query_id", "sensor_id", "dim", "kw")
        return self

    def update_queries(self, changed: DataFrame) -> InvertedIndex:
        """Replaces the queries that share an id with the changed ones, adds the others, and leaves the rest alone."""
        before = self._ready()
        self.set_queries(changed)
        rest = before.join(self.queries.select("query_id").distinct(), "query_id", "left_anti")
        self.queries = stored(rest.unionByName(self.queries), "index-queries")
        return self

    def clear_queries(self) -> None:
        self.queries = None

    def _ready(self) -> DataFrame:
        if self.queries is None:
            raise ValueError("no queries have been set")
        return self.queries

    def nearest(self, k: int) -> DataFrame:
        """The exact k nearest windows of each query; every query needs a value in each of the dims dimensions."""
        if k < 1:
            raise ValueError("k has to be positive")
        return invlist.nearest(self.postings, self.windows, self._ready(), k, self.dims)

    def matches(self, threshold: int) -> DataFrame:
        """Entries that equal a query in more than `threshold` dimensions."""
        return invlist.point_query(self.postings, self._ready(), threshold)


def forecast_series(series: DataFrame, settings: Settings | None = None, **changes) -> DataFrame:
    """Step-by-step forecasts with metrics columns; settings may be given as keywords."""
    return forecast.errors(forecast.continuous(series, replace(settings or Settings(), **changes)))


def _experts(series: DataFrame, found: DataFrame, qs: DataFrame, settings: Settings) -> DataFrame:
    """The (length, k) grid of settings.model over found neighbours, with equal weights."""
    from pyspark.sql import functions as F

    from .operators import gather

    rows = gather.training_rows(series, found, settings.horizon)
    if settings.model == "gp":
        parts = [gather.subsequences(series, rows.filter(F.col("len") == n), n) for n in settings.lengths]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        grid = forecast.gp_grid(rows, qs, settings)
    else:
        grid = forecast.knn_grid(rows, list(settings.ks), "plain")
    return grid.withColumn("weight", F.lit(1.0))


def leave_out_experiment(series: DataFrame, number: int, settings: Settings) -> DataFrame:
    """Forecasts of `number` sampled queries per sensor, each from its sensor without the query's surroundings: the
    query's places are excluded as starts, so no subsequence crosses a seam. Returns rows with y, mean, var and errors."""
    from pyspark.sql import functions as F

    longest = max(settings.lengths)
    whole = longest + settings.horizon + 1
    starts = q.sample_starts(series, whole, number)
    cut = q.cut_queries(series, starts, whole)
    qs = cut.select(F.concat_ws("@", "sensor_id", "start").alias("query_id"), "sensor_id", "start", F.slice("q", 1, longest).alias("q"), F.element_at("q", whole).alias("truth"))
    found = search.index_top_k(series, qs, list(settings.lengths), max(settings.ks), settings.band, settings.window, reserve=settings.horizon + 1, exclude=whole, chunk=settings.chunk)
    grid = _experts(series, found, qs, settings)
    return forecast.errors(forecast.ensemble(grid).join(qs.select("query_id", F.col("truth").alias("y")), "query_id"))


def sequential_experiment(series: DataFrame, number: int, settings: Settings) -> DataFrame:
    """Forecasts of the last `number` overlapping queries of each sensor, all from the places before the first of them,
    with equal expert weights. Returns query_id, mean, var, y and errors."""
    from pyspark.sql import functions as F

    from .operators.series import lengths, trim_tail

    longest = max(settings.lengths)
    whole = longest + settings.horizon + 1
    starts = lengths(series).select("sensor_id", F.explode(F.sequence(F.col("n") - whole - number + 1, F.col("n") - whole)).alias("start"))
    cut = q.cut_queries(series, starts, whole)
    qs = cut.select(F.concat_ws("@", "sensor_id", "start").alias("query_id"), "sensor_id", "start", F.slice("q", 1, longest).alias("q"), F.element_at("q", whole).alias("truth"))
    past = trim_tail(series, whole + number - 1)
    found = search.index_top_k(past, qs, list(settings.lengths), max(settings.ks), settings.band, settings.window, reserve=settings.horizon + 1, chunk=settings.chunk)
    grid = _experts(past, found, qs, settings)
    return forecast.errors(forecast.ensemble(grid).join(qs.select("query_id", F.col("truth").alias("y")), "query_id"))


def estimate_parameters(x: np.ndarray, y: np.ndarray, start: tuple[float, float, float] = (5.0, 1.0, 1.0), steps: int = 30) -> np.ndarray:
    """Length, sf and sn of a Gaussian process by the leave-one-out objective."""
    return scg(lambda p: loo_objective(p, x, y), np.array(start), steps)[0]


def gp_predict(parameters: np.ndarray, x: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return predict(parameters, x, y, at)


def sparse_estimate(x: np.ndarray, y: np.ndarray, length: float, sill: float, noise: float, most: int = 400, rounds: int = 3) -> SparseGp:
    """A sparse Gaussian process with learned covariance parameters, ready to predict."""
    return SparseGp([("gaussian", np.array([length, sill]))], noise, most).learn(x, y, rounds)
