"""Steps from wavelet power: an even bout of whole seconds, Morse-wavelet power, one ridge a second, lasting ridges.

The power needs a whole recording and comes from a task that holds it, as a few rows for each second; all else is window
plans. A bout has the rate `fs` (an integer); its samples are numbered from 0, and second s has the samples s * fs and on.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridelake.operators import segments
from stridelake.operators.features import same
from stridelake.operators.series import ordered, whole
from stridelake.operators.signal import by_recording

# The wavelet's shape, the taper's share, the seconds of silence on both sides and the frequencies in Hz.
BETA, GAMMA, TAPER, SILENCE = 90.0, 3.0, 0.02, 5
FREQUENCIES = np.arange(80) * 0.05 + 0.5


def even_bout(df: DataFrame, key: str, time: str, value: str, fs: int = 10, pad: float = 0.7) -> DataFrame:
    """key, k, t, value: linear values at first time + k / fs before the last time, made up to whole seconds.

    A last second of at least `pad` of its samples is filled with the last value, a shorter one is cut. Bouts of less than a
    second or two samples give no rows; of equal times the smallest value counts."""
    d = df.where(F.col(time).isNotNull() & F.col(value).isNotNull()).groupBy(key, time).agg(F.min(value).alias("v"))
    w = ordered(key, time)
    d = d.select(key, F.col(time).alias("a"), "v", F.lead(time).over(w).alias("b"), F.lead("v").over(w).alias("v2"), F.min(time).over(whole(key)).alias("t0"), F.max(time).over(whole(key)).alias("t1"))
    # Rounded to 9 places, so that a step that is whole but for rounding is whole.
    step = lambda t: F.ceil(F.round((t - F.col("t0")) * fs, 9))
    d = d.where("b is not null").withColumn("_n", step(F.col("t1"))).withColumn("_rest", F.col("_n") % fs)
    d = d.withColumn("_whole", F.when(F.col("_rest") >= F.ceil(F.lit(pad * fs)), F.col("_n") - F.col("_rest") + fs).otherwise(F.col("_n") - F.col("_rest")))
    # Each segment makes its grid points; that of the last one repeats it up to the whole second.
    stop = F.when(F.col("b") < F.col("t1"), step(F.col("b")) - 1).otherwise(F.col("_n") - 1)
    d = d.withColumn("_from", step(F.col("a"))).withColumn("_to", stop).where("_from <= _to")
    d = d.withColumn("_to", F.least(F.when(F.col("_to") == F.col("_n") - 1, F.greatest("_to", F.col("_whole") - 1)).otherwise(F.col("_to")), F.col("_whole") - 1)).where("_from <= _to")
    d = d.withColumn("k", F.explode(F.sequence("_from", "_to")))
    at = F.col("t0") + F.least(F.col("k"), F.col("_n") - 1) / fs
    return d.select(key, "k", (F.col("t0") + F.col("k") / fs).alias("t"), (F.col("v") + (F.col("v2") - F.col("v")) * (at - F.col("a")) / (F.col("b") - F.col("a"))).alias("value"))


def tapered(n: int, share: float = TAPER) -> np.ndarray:
    """Cosine slopes over `share` of n samples, half at each end."""
    edge = share * (n - 1) / 2
    near = np.minimum(np.arange(n), np.arange(n)[::-1])
    return np.where(near < edge, 0.5 - 0.5 * np.cos(np.pi * near / edge), 1.0) if edge > 0 else np.ones(n)


def gains(size: int, fs: float, hz: tuple) -> np.ndarray:
    """The wavelets' spectra, of peak gain 2: a row for each frequency."""
    omega = 2 * np.pi * np.fft.fftfreq(size)
    peak = (BETA / GAMMA) ** (1 / GAMMA)
    scaled = np.maximum(omega, 0) * (peak * fs / (2 * np.pi * np.array(hz)))[:, None]
    with np.errstate(divide="ignore"):
        return np.where(scaled > 0, 2 * np.exp(BETA * (np.log(scaled) - np.log(peak)) - scaled**GAMMA + peak**GAMMA), 0.0)


# Recordings of about one length share them; those of long ones (over 10 MB) are not held.
held_gains = lru_cache(4)(gains)


def morse(x: np.ndarray, fs: float, hz: np.ndarray, slope: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Morse-wavelet transform of x at the frequencies hz (a row each), of peak gain 2, and its derivative in time where
    `slope` asks for it.

    The ends are mirrored out to a power of two of at least twice the length."""
    n = len(x)
    size = 2 << int(np.ceil(np.log2(max(n, 2))))
    before = (size - n) // 2
    spectrum = np.fft.fft(np.pad(x, (before, size - n - before), "reflect") if n > 1 else np.resize(x, size))
    moved = spectrum * (held_gains if size <= 1 << 14 else gains)(size, fs, tuple(hz))
    part = slice(before, before + n)
    turned = np.fft.ifft(moved * 1j * (2 * np.pi * np.fft.fftfreq(size)) * fs)[:, part] if slope else None
    return np.fft.ifft(moved)[:, part], turned


def reassigned(w: np.ndarray, slope: np.ndarray, hz: np.ndarray, floor: float = 1e-8) -> np.ndarray:
    """Power moved to the frequency nearest to the transform's own (its derivative over itself); weak values are dropped."""
    strong = np.abs(w) > floor * max(np.abs(w).max(initial=0.0), 1e-300)
    own = np.imag(slope / np.where(strong, w, 1)) / (2 * np.pi)
    row = np.rint((own - hz[0]) / (hz[1] - hz[0])).astype(np.int64)
    strong &= (row >= 0) & (row < len(hz))
    out = np.zeros(w.shape)
    np.add.at(out, (row[strong], np.nonzero(strong)[1]), (np.abs(w) ** 2)[strong])
    return out


def bout_power(x: np.ndarray, fs: int, squeeze: bool = False) -> np.ndarray:
    """Power of a bout (frequency, sample), tapered and with silence on both sides."""
    quiet = np.zeros(SILENCE * fs)
    w, slope = morse(np.concatenate([quiet, x * tapered(len(x)), quiet]), fs, FREQUENCIES, squeeze)
    power = reassigned(w, slope, FREQUENCIES) if squeeze else np.abs(w) ** 2
    return power[:, SILENCE * fs : len(x) + SILENCE * fs]


def wavelet_power(bout: DataFrame, key: str, order: str, value: str, fs: int = 10, squeeze: bool = False) -> DataFrame:
    """key, second (of the given samples, in order), bin, hz, power: the power summed over each whole second. With `squeeze`
    the power is reassigned to the frequency at which the transform turns."""

    def one(x):
        n = len(x) // fs
        if not n:
            return {"second": [], "bin": [], "hz": [], "power": []}
        power = bout_power(x[: n * fs], fs, squeeze).reshape(len(FREQUENCIES), n, fs).sum(2)
        second, row = (a.reshape(-1) for a in np.meshgrid(np.arange(n), np.arange(len(FREQUENCIES)), indexing="ij"))
        return {"second": second, "bin": row, "hz": FREQUENCIES[row].round(9), "power": power.T.reshape(-1)}

    return by_recording(bout, key, order, [value], "second long, bin int, hz double, power double", one).select(key, "second", "bin", "hz", "power")


def ridges(power: DataFrame, key: str, low: int, high: int, below: float = 0.6, above: float = 2.5) -> DataFrame:
    """key, second, bin: the highest local maximum over bins within low..high, where no other one is too much higher.

    A second whose highest maximum of all lies beyond `high` counts if that is less than `above` times the one within;
    one that lies under `low`, if it is less than `below` times. A plateau counts at its middle; of equal maxima the lower bin."""
    w = Window.partitionBy(key, "second").orderBy("bin")
    d = power.withColumn("_new", F.coalesce((F.col("power") != F.lag("power").over(w)).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w))
    d = d.groupBy(key, "second", "_run").agg(F.first("power").alias("p"), F.expr("(min(bin) + max(bin)) div 2").cast("int").alias("bin"))
    w = Window.partitionBy(key, "second").orderBy("_run")
    d = d.withColumn("_a", F.lag("p").over(w)).withColumn("_b", F.lead("p").over(w)).where("p > _a and p > _b")
    top = lambda on: F.min(F.when(on, F.struct((-F.col("p")).alias("p"), "bin")))
    d = d.groupBy(key, "second").agg(top(F.lit(True)).alias("any"), top(F.col("bin").between(low, high)).alias("in"))
    ratio = F.try_divide(F.col("any.p"), F.col("in.p"))
    fine = F.when(F.col("any.bin") > high, ratio < above).when(F.col("any.bin") < low, ratio < below).otherwise(True)
    return d.where(F.col("in").isNotNull() & fine).select(key, "second", F.col("in.bin").alias("bin"))


def lasting(ridge: DataFrame, key: str, least: int = 3, delta: int = 20) -> DataFrame:
    """The seconds that lie in a run of `least` seconds or more, each with a ridge within `delta` bins of the one before."""
    w = ordered(key, "second")
    near = (F.col("second") - F.lag("second").over(w) == 1) & (F.abs(F.col("bin") - F.lag("bin").over(w)) <= delta)
    d = ridge.withColumn("_run", F.sum(F.when(near, 0).otherwise(1)).over(w))
    return d.withColumn("_n", F.count("*").over(Window.partitionBy(key, "_run"))).where(F.col("_n") >= least).drop("_run", "_n")


def wavelet_steps(df: DataFrame, key: str, time: str, value: str, fs: int = 10, low: float = 1.4, high: float = 2.3, k: float = 1.0, fallback: float = 0.3, least: int = 3, delta: int = 20, below: float = 0.6, above: float = 2.5, cut=same) -> DataFrame:
    """key, start, end, duration, step_count, cadence of each recording with a bout; without lasting ridges 0 steps.

    Seconds whose range reaches median + k * MAD of the ranges (at most 0.3 of the largest) are active, and the power is
    that of the active seconds joined. A second with a lasting ridge has its frequency in steps. For `cut` see
    features. No join may be broadcast: the seconds grow with the input, though few bytes of files hold many."""
    bout = cut(even_bout(df, key, time, value, fs).withColumn("second", F.expr(f"k div {fs}")))
    ranges = bout.groupBy(key, "second").agg((F.max("value") - F.min("value")).alias("p2p"), F.min("t").alias("begins"), F.max("t").alias("ends"))
    limit = segments.spread_threshold(ranges, key, "p2p", k, 0.3, fallback)
    active = ranges.join(limit.hint("merge"), key).where("p2p >= threshold").withColumn("place", F.row_number().over(ordered(key, "second")).cast("long") - 1)
    active = active.withColumn("_n", F.count("*").over(whole(key))).where(F.col("_n") >= least).select(key, "second", "place", "begins", "ends", "p2p")
    active = cut(active)
    # Their samples: all whose second reaches the smallest range of an active one, so that the bout is joined by its key.
    w = Window.partitionBy(key, "second")
    moving = bout.withColumn("_range", F.max("value").over(w) - F.min("value").over(w)).join(active.groupBy(key).agg(F.min("p2p").alias("_least")).hint("merge"), key)
    power = wavelet_power(moving.where("_range >= _least"), key, "k", "value", fs)
    bins = [int(np.abs(FREQUENCIES - f).argmin()) for f in (low, high)]
    ridge = ridges(power, key, *bins, below, above).withColumnRenamed("second", "place")
    found = lasting(ridge.join(active.hint("merge"), [key, "place"]), key, least, delta).withColumn("hz", F.round(FREQUENCIES[0] + F.col("bin") * 0.05, 9))
    got = found.groupBy(key).agg(F.min("begins").alias("start"), F.max("ends").alias("end"), F.sum("hz").alias("_s"), F.avg("hz").alias("_m"))
    out = bout.select(key).distinct().join(got.hint("merge"), key, "left")
    return out.select(key, "start", "end", (F.col("end") - F.col("start")).alias("duration"), F.coalesce("_s", F.lit(0.0)).alias("step_count"), (F.col("_m") * 60).alias("cadence"))
