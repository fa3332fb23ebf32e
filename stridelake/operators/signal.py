"""Filters, spectra and resampling of keyed, ordered series.

Smoothing and resampling are DataFrame plans. Fourier transforms, recursive filters and greedy peak picking need a whole
series, so they run over one series at a time in a task; a series is one recording, and Spark deals the recordings.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridelake.operators.series import after, ordered, whole


def fill(df: DataFrame, key: str, order, value: str, out: str = "filled") -> DataFrame:
    """The last known value, and before the first one the first."""
    back = ordered(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.coalesce(F.last(value, True).over(back), F.last(value, True).over(after(key, order))))


def dominant(df: DataFrame, key: str, channel: str, value: str) -> DataFrame:
    """The channel with the largest mean magnitude; ties go to the channel that sorts first."""
    m = df.groupBy(key, channel).agg(F.round(F.avg(F.abs(value)), 9).alias("strength"))
    top = m.groupBy(key).agg(F.min(F.struct((-F.col("strength")).alias("s"), F.col(channel).alias("c"))).alias("m"))
    return top.select(key, F.col("m.c").alias(channel), (-F.col("m.s")).alias("strength"))


def gaussian_smooth(df: DataFrame, key: str, order, value: str, sigma: float = 3.0, out: str = "smooth") -> DataFrame:
    """df with the value smoothed by Gaussian weights out to four sigma, the series mirrored at its ends (the end sample
    repeats), in the task that holds the recording. A null makes the values within its reach null."""
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out}` double"
    d = by_table(df, key, order, schema, lambda t: t.append_column(out, known(gaussian(doubles(t, value), sigma))))
    return d.withColumn(out, F.nanvl(out, F.lit(None).cast("double")))


def resample(df: DataFrame, key: str, time: str, value: str, points: int = 101) -> DataFrame:
    """`points` evenly spaced values from first to last time, linear in between; needs two distinct times.

    Each segment makes the grid points that it covers, so that the grid is never joined to the series.
    """
    d = df.where(F.col(time).isNotNull() & F.col(value).isNotNull()).groupBy(key, time).agg(F.min(value).alias("v"))
    w, last = ordered(key, time), points - 1
    d = d.select(key, F.col(time).alias("t"), "v", F.lead(time).over(w).alias("t2"), F.lead("v").over(w).alias("v2"), F.min(time).over(whole(key)).alias("t0"), F.max(time).over(whole(key)).alias("t1"))
    span = F.col("t1") - F.col("t0")
    a = F.ceil((F.col("t") - F.col("t0")) / span * last)
    b = F.when(F.col("t2") < F.col("t1"), F.ceil((F.col("t2") - F.col("t0")) / span * last) - 1).otherwise(F.lit(last))
    d = d.where("t2 is not null").withColumn("_a", a).withColumn("_b", b).where("_a <= _b")
    d = d.withColumn("k", F.explode(F.sequence("_a", "_b")))
    grid = F.col("t0") + span * F.col("k") / last
    return d.select(key, "k", (F.col("v") + (F.col("v2") - F.col("v")) * (grid - F.col("t")) / (F.col("t2") - F.col("t"))).alias("value"))


def doubles(t: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, null as NaN."""
    return t[name].to_numpy().astype(float, copy=False)


def known(x) -> pa.Array:
    """Doubles as a column, NaN as null."""
    return pa.array(np.asarray(x, float), pa.float64(), from_pandas=True)


def by_table(df: DataFrame, key: str, order, kind: str, f) -> DataFrame:
    """f on the rows of each recording, as an Arrow table in order, in the task that holds it."""
    order = [(o, "ascending") for o in ([order] if isinstance(order, str) else order)]

    def one(t):
        return f(t.take(pc.sort_indices(t, order)).combine_chunks())

    return df.groupBy(key).applyInArrow(one, kind)


def by_recording(df: DataFrame, key: str, order, values: list[str], kind: str, f) -> DataFrame:
    """f on the arrays (in order) of each recording, in the task that holds it: rows of f (arrays by name) beside the key.

    For transforms that need a whole recording at once; a recording is what fits a task."""
    order = [order] if isinstance(order, str) else list(order)
    of = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    kinds = {n: of[t] for n, t in (c.split() for c in kind.split(","))}

    def one(t: pa.Table) -> pa.Table:
        out = f(*[doubles(t, v) for v in values])
        columns = {n: pa.array(np.asarray(out[n]), k, from_pandas=True) for n, k in kinds.items()}
        return pa.table({key: t[key].take(pa.array(np.zeros(len(out[next(iter(kinds))]), np.int64))), **columns})

    d = df.select(key, *order, *[F.col(v).cast("double").alias(v) for v in values if v not in order])
    return by_table(d, key, order, f"`{key}` {dict(d.dtypes)[key]}, {kind}", one)


def standardised(x: np.ndarray) -> np.ndarray:
    return (x - x.mean()) / x.std() if len(x) and x.std() > 0 else x[:0]


def cross_correlation(df: DataFrame, key: str, order, a: str, b: str) -> DataFrame:
    """Lag and value of the largest magnitude of the normalised cross-correlation, by Fourier transforms."""

    def top(x, y):
        x, y = standardised(x), standardised(y)
        if not len(x) or not len(y):
            return {"lag": [], "peak": []}
        n = len(x)
        size = 1 << (2 * n - 1).bit_length()
        c = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size) / n
        lags = np.arange(1 - n, n)
        c = c[lags].round(9)
        i = int(np.abs(c).argmax())
        return {"lag": [lags[i]], "peak": [c[i]]}

    return by_recording(df, key, order, [a, b], "lag long, peak double", top).select(key, "lag", "peak")


def autocorrelations(df: DataFrame, key: str, order, value: str) -> DataFrame:
    """key, lag, acf: the autocorrelation of the mean-removed known values at all lags, over that at 0, from the power
    spectrum. Series of fewer than three values, and constant ones, have none."""

    def lags(x):
        x = x[np.isfinite(x)]
        x = x - x.mean() if len(x) else x
        n = len(x)
        if n < 3 or np.allclose(x, 0):
            return {"lag": [], "acf": []}
        size = 1 << (2 * n - 1).bit_length()
        c = np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** 2, size)[:n]
        return {"lag": np.arange(n), "acf": c / c[0]}

    return by_recording(df, key, order, [value], "lag long, acf double", lags).select(key, "lag", "acf")


def sensor_peaks(df: DataFrame, key: str, sensor: str, order: str, value: str) -> DataFrame:
    """key, sensor_a, sensor_b (a before b), lag, peak: the largest normalised cross-correlation of each pair of a key's
    sensors over all lags, of the places (`order`) that both know.

    A key's sensors are transformed once each, and the pairs come from the spectra; only pairs in which one sensor lacks
    places of the other are transformed for themselves. Pairs with fewer than three common places, or with a constant
    signal, have no row; the smaller of two equal lags counts. Of rows of one sensor and place the first known counts."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        wide = p.dropna(subset=["_v"]).drop_duplicates(["_s", "_o"]).pivot(index="_o", columns="_s", values="_v").sort_index()
        names, x = list(wide.columns), wide.to_numpy(float).T
        spectra: dict = {}

        def unit(at, where):
            """Length and spectrum of a sensor's centred values at these places, or None for a constant."""
            mask = where.tobytes()
            if (at, mask) not in spectra:
                v = x[at][where]
                size = 1 << (2 * len(v) - 1).bit_length()
                c = v - v.mean()
                spectra[at, mask] = None if np.allclose(v, v[0]) else np.fft.rfft(c / np.linalg.norm(c), size)
            return spectra[at, mask]

        out = []
        for i in range(len(names)):
            for j in range(i + 1, len(names)):
                where = np.isfinite(x[i]) & np.isfinite(x[j])
                n = int(where.sum())
                if n < 3:
                    continue
                a, b = unit(i, where), unit(j, where)
                if a is None or b is None:
                    continue
                lags = np.arange(1 - n, n)
                c = np.fft.irfft(a * np.conj(b), 1 << (2 * n - 1).bit_length())[lags].round(9)
                out.append((p["_k"].iloc[0], names[i], names[j], int(lags[c.argmax()]), float(c.max())))
        return pd.DataFrame(out, columns=["_k", "sensor_a", "sensor_b", "lag", "peak"])

    d = df.select(F.col(key).alias("_k"), F.col(sensor).alias("_s"), F.col(order).alias("_o"), F.col(value).cast("double").alias("_v"))
    kinds = dict(d.dtypes)
    out = d.groupBy("_k").applyInPandas(one, f"_k {kinds['_k']}, sensor_a {kinds['_s']}, sensor_b {kinds['_s']}, lag long, peak double")
    return out.withColumnRenamed("_k", key)


def dominant_frequency(df: DataFrame, key: str, order, value: str, fs: float = 1.0) -> DataFrame:
    """Frequency of the largest Fourier power of the mean-removed, Hann-weighted series of eight samples or more."""

    def top(x):
        x = x[np.isfinite(x)]
        if len(x) < 8:
            return {"bin": [], "hz": []}
        power = (np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x)))) ** 2).round(6)[1:]
        i = int(power.argmax()) + 1
        return {"bin": [i], "hz": [i * fs / len(x)]}

    return by_recording(df, key, order, [value], "bin long, hz double", top).select(key, "bin", "hz")


def butter(order: int, cutoff: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Low-pass Butterworth coefficients by the bilinear transform."""
    warped = 2 * fs * np.tan(np.pi * cutoff / fs)
    poles = warped * np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    a = np.real(np.poly((2 * fs + poles) / (2 * fs - poles)))
    b = np.real(np.poly(-np.ones(order)))
    return b * a.sum() / b.sum(), a


def band(low: float, high: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Second-order Butterworth band-pass coefficients: the low-pass prototype moved to the band, then bilinear."""
    wl, wh = (2 * fs * np.tan(np.pi * f / fs) for f in (low, high))
    width, centre = wh - wl, np.sqrt(wl * wh)
    proto = np.exp(1j * np.pi * np.array([3, 5]) / 4) * width / 2
    poles = np.concatenate([proto + np.sqrt(proto**2 - centre**2), proto - np.sqrt(proto**2 - centre**2)])
    a = np.real(np.poly((2 * fs + poles) / (2 * fs - poles)))
    b = np.array([1.0, 0.0, -2.0, 0.0, 1.0])
    z = np.exp(1j * 2 * np.arctan(centre / (2 * fs)))
    return b * np.abs(np.polyval(a, z)) / np.abs(np.polyval(b, z)), a


BLOCK = 128


@lru_cache(64)
def _blocks(b: tuple, a: tuple) -> tuple:
    """The matrices of _recursive; recordings of one rate share them."""
    b, a, order = np.array(b), np.array(a), len(b) - 1
    shift = np.eye(order, k=1)
    shift[:, 0] -= a[1:]
    drive = b[1:] - a[1:] * b[0]
    powers = [np.eye(order)]
    for _ in range(BLOCK):
        powers.append(shift @ powers[-1])
    seen = np.stack([p[0] for p in powers[:BLOCK]])  # first state component after k steps
    impulse = np.append(b[0], seen[: BLOCK - 1] @ drive)
    lag = np.arange(BLOCK)[:, None] - np.arange(BLOCK)
    direct = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    feed = np.stack([powers[BLOCK - 1 - j] @ drive for j in range(BLOCK)])
    return powers, seen, direct, feed


def _recursive(b, a, x, state):
    """Direct-form filter by blocks: within a block the output is a matrix product of its inputs and the state before."""
    powers, seen, direct, feed = _blocks(tuple(b), tuple(a))
    y = np.empty_like(x)
    for i in range(0, len(x), BLOCK):
        u = x[i : i + BLOCK]
        y[i : i + BLOCK] = direct[: len(u), : len(u)] @ u + seen[: len(u)] @ state
        state = powers[len(u)] @ state + feed[BLOCK - len(u) :].T @ u
    return y


def both_ways(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filter forwards and backwards from steady states, over ends extended by point reflection."""
    pad, order = 3 * len(b), len(b) - 1
    if len(x) <= pad:
        return x
    shift = np.eye(order) - np.eye(order, k=1)
    shift[:, 0] += a[1:]
    steady = np.linalg.solve(shift, b[1:] - a[1:] * b[0])
    long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        long = _recursive(b, a, long, steady * long[0])[::-1]
    return long[pad:-pad]


def bridged(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x filtered both ways, missing values bridged for the filter; they stay missing."""
    there, i = np.isfinite(x), np.arange(len(x))
    return np.where(there, both_ways(b, a, np.interp(i, i[there], x[there])), np.nan) if there.any() else x


def low_pass(df: DataFrame, key: str, order: str, value: str, cutoff: float, fs: float, degree: int = 4) -> DataFrame:
    """Zero-phase low-pass; nulls are bridged for the filter and stay null. Series of at most 15 samples, and cutoffs
    of 0.95 of the Nyquist rate or more, are returned as they are."""
    usable = 0 < cutoff < 0.95 * fs / 2
    b, a = butter(degree, cutoff, fs) if usable else (None, None)

    def one(t: pa.Table) -> pa.Table:
        x = doubles(t, value)
        return pa.table({key: t[key], order: t[order], "filtered": known(bridged(b, a, x) if usable else x)})

    d = df.select(key, order, F.col(value).cast("double").alias(value))
    kinds = dict(d.dtypes)
    out = by_table(d, key, order, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, filtered double", one)
    return out.withColumn("filtered", F.nanvl("filtered", F.lit(None).cast("double")))


def band_pass(df: DataFrame, key: str, order: str, value: str, fs, low: float = 0.5, high: float = 3.0) -> DataFrame:
    """Zero-phase band-pass of the median-centred series; the upper edge is at most 0.9 of the Nyquist rate. Series of
    fewer than 8 samples, and empty bands, are only centred. fs is a rate for all, or the name of a column with each
    recording's own (null or not positive: only centred)."""
    column = fs if isinstance(fs, str) else None

    def one(t: pa.Table) -> pa.Table:
        x = doubles(t, value)
        x = x - np.nanmedian(x)
        rate = t["_fs"][0].as_py() if column else fs
        top = min(high, 0.9 * rate / 2) if rate is not None and rate > 0 else 0.0
        return pa.table({key: t[key], order: t[order], "filtered": known(both_ways(*band(low, top, float(rate)), x) if 0 < low < top and len(x) >= 8 else x)})

    d = df.where(F.col(value).isNotNull()).select(key, order, F.col(value).cast("double").alias(value), *([F.col(column).cast("double").alias("_fs")] if column else []))
    kinds = dict(d.dtypes)
    return by_table(d, key, order, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, filtered double", one)


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian weights out to four sigma, the ends mirrored with the end sample repeated."""
    if not sigma or not sigma > 0 or not len(x):
        return x
    reach = int(4 * sigma + 0.5)
    weights = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    at = np.arange(-reach, len(x) + reach) % (2 * len(x))
    return np.convolve(x[np.where(at < len(x), at, 2 * len(x) - 1 - at)], weights / weights.sum(), "valid")


def found_peaks(x: np.ndarray, distance: int = 1, height: float | None = None, prominence: float | None = None) -> np.ndarray:
    """Local maxima (a plateau counts at its middle) of at least `height`, of which the highest suppress others closer
    than `distance` samples (of equal ones the later goes first), then those of at least `prominence`."""
    edge = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, int)
    level, end = x[edge], np.r_[edge[1:], len(x)] - 1
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    at = (edge[top] + end[top]) // 2
    if height is not None:
        at = at[x[at] >= height]
    keep, order = np.ones(len(at), bool), np.lexsort((at, x[at]))[::-1]
    for i in order:
        if keep[i]:
            lo, hi = np.searchsorted(at, (at[i] - distance + 1, at[i] + distance))
            mine = keep[i]
            keep[lo:hi] = False
            keep[i] = mine
    at = at[keep]
    if prominence is not None:
        rise = []
        for i in at:
            left, right = np.flatnonzero(x[:i] > x[i]), np.flatnonzero(x[i + 1 :] > x[i])
            lo, hi = (left[-1] + 1 if len(left) else 0), (i + 1 + right[0] if len(right) else len(x))
            rise.append(x[i] - max(x[lo : i + 1].min(), x[i:hi].min()))
        at = at[np.array(rise, float) >= prominence] if len(at) else at
    return at


def peaks(df: DataFrame, key: str, order: str, value: str, distance=5, height=None, prominence=None, sigma=None, keep: tuple = ()) -> DataFrame:
    """key, order, height of the peaks of each series (see found_peaks), smoothed first where sigma is given; with the
    columns `keep` of their samples.

    Each parameter is a number for all series, or the name of a column that is constant within a series."""
    given = {"distance": distance, "height": height, "prominence": prominence, "sigma": sigma}
    columns = {k: v for k, v in given.items() if isinstance(v, str)}

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order)
        use = {k: p["_" + k].iloc[0] if k in columns else v for k, v in given.items()}
        use = {k: None if v is None or v != v else v for k, v in use.items()}
        x = gaussian(p[value].to_numpy(float), use.pop("sigma"))
        use["distance"] = max(1, int(use["distance"] or 1))
        at = found_peaks(x, **use)
        return pd.DataFrame({key: p[key].iloc[at], order: p[order].iloc[at], "height": x[at], **{c: p[c].iloc[at] for c in keep}})

    d = df.where(F.col(value).isNotNull()).select(key, order, F.col(value).cast("double").alias(value), *[F.col(c).cast("double").alias("_" + k) for k, c in columns.items()], *keep)
    kinds = dict(d.dtypes)
    return d.groupBy(key).applyInPandas(one, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, height double" + "".join(f", `{c}` {kinds[c]}" for c in keep))


def spectral_entropy(df: DataFrame, key: str, order: str, value: str, segment: int = 256) -> DataFrame:
    """Entropy of the Welch spectrum (periodic Hann, half overlap, each segment's mean removed) over its log2 bins."""

    def entropy_of(x):
        size, entropy = min(segment, len(x)), np.nan
        if size >= 4:
            s = np.lib.stride_tricks.sliding_window_view(x, size)[:: size - size // 2]
            s = (s - s.mean(1, keepdims=True)) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size))
            power = (np.abs(np.fft.rfft(s)) ** 2).mean(0)
            power[1 : (size + 1) // 2] *= 2
            if power.sum() > 0:
                q = power[power > 0] / power.sum()
                entropy = float(-(q * np.log2(q)).sum() / np.log2(len(power)))
        return {"spectral_entropy": [entropy]}

    return by_recording(df.where(F.col(value).isNotNull()), key, order, [value], "spectral_entropy double", entropy_of)


def smoothed(df: DataFrame, key: str, order: str, value: str, sigma, keep: tuple = ()) -> DataFrame:
    """key, order, smooth: Gaussian smoothing of whole recordings; sigma is a number or the name of a column. With the
    columns `keep` of the samples."""
    column = sigma if isinstance(sigma, str) else None

    def one(t: pa.Table) -> pa.Table:
        smooth = gaussian(doubles(t, value), t["_sigma"][0].as_py() if column else sigma)
        return t.select([key, order, *keep]).add_column(2, "smooth", known(smooth))

    d = df.where(F.col(value).isNotNull()).select(key, order, F.col(value).cast("double").alias(value), *([F.col(column).cast("double").alias("_sigma")] if column else []), *keep)
    kinds = dict(d.dtypes)
    return by_table(d, key, order, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, smooth double" + "".join(f", `{c}` {kinds[c]}" for c in keep), one)


def low_pass_columns(df: DataFrame, key: str, order: str, values: list[str], cutoff: float, rate: str, degree: int = 4) -> DataFrame:
    """All columns of df, with the given ones low-passed as in low_pass at each recording's own rate (a column)."""

    def one(t: pa.Table) -> pa.Table:
        fs = t[rate][0].as_py()
        if fs is not None and fs > 0 and 0 < cutoff < 0.95 * fs / 2:
            b, a = butter(degree, cutoff, float(fs))
            for v in values:
                t = t.set_column(t.column_names.index(v), v, known(bridged(b, a, doubles(t, v))))
        return t

    d = df.withColumns({v: F.col(v).cast("double") for v in values})
    out = by_table(d, key, order, d.schema, one)
    return out.withColumns({v: F.nanvl(v, F.lit(None).cast("double")) for v in values})
