"""Measures of decoded audio: arrays of samples in, numbers out, in numpy over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How strongly each pitch belongs to a major and a minor key (Krumhansl and Kessler).
MAJOR = np.array([6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88])
MINOR = np.array([6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17])

#: Seconds from which on the upper end of a spectrum is measured twice.
LONG = 150


def spectrogram(samples: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Magnitudes, frequency x frames, under a Hann window; shorter signals are padded."""
    y = np.pad(samples, (0, max(0, size - len(samples))))
    frames = np.lib.stride_tricks.sliding_window_view(y, size)[::hop]
    return np.abs(np.fft.rfft(frames * np.hanning(size), axis=1)).T


def onsets(samples: np.ndarray, rate: int, size: int = 2048, hop: int = 256, bands: int = 40) -> np.ndarray:
    """How much louder each frame is than the last, over bands of equal width in pitch, 0 to 1."""
    spec = spectrogram(samples, size, hop)
    edges = np.geomspace(30.0, rate / 2, bands + 1)
    place = np.searchsorted(edges, np.fft.rfftfreq(size, 1 / rate))
    level = np.log1p(1000 * np.stack([spec[place == b].sum(axis=0) for b in range(1, bands + 1)]))
    rise = np.maximum(np.diff(level, axis=1), 0).sum(axis=0)
    rise = rise - rise.min() if len(rise) else rise
    return rise / rise.max() if len(rise) and rise.max() > 0 else rise


def tempo_of(samples: np.ndarray, rate: int, low: float = 70.0, high: float = 210.0, middle: float = 152.0, window: tuple[float, float] | None = None) -> tuple[float | None, float]:
    """(beats a minute, confidence): the lag whose first four multiples correlate best, with a slight liking
    for the genre's tempo, doubled or halved into ``window`` where that fits nearly as well."""
    hop = 256
    rise = onsets(samples, rate, hop=hop)
    if len(rise) < 128 or rise.max(initial=0) <= 0:
        return None, 0.0

    def fit(bpm: float) -> float:
        out = 0.0
        for k, weight in enumerate((1.0, 0.5, 0.33, 0.25), 1):
            lag = int(round(k * 60 * rate / hop / bpm))
            if 2 <= lag < len(rise) - 2:
                a, b = rise[:-lag], rise[lag:]
                out += weight * float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-12))
        return out

    grid = np.arange(low, high + 1e-9, 0.25)
    score = np.array([fit(b) for b in grid])
    if not (score > 0).any():
        return None, 0.0
    liked = 0.94 * score + 0.06 * score.max() * np.exp(-0.5 * ((grid - middle) / 22) ** 2)
    k = int(np.argmax(liked))
    best, peak = float(grid[k]), float(liked[k])
    if 0 < k < len(grid) - 1 and abs(bend := liked[k - 1] - 2 * liked[k] + liked[k + 1]) > 1e-12:
        best += float(np.clip(0.5 * (liked[k - 1] - liked[k + 1]) / bend, -1, 1)) * 0.25
    sure = float(np.clip((peak - np.median(liked[liked > 0])) / (peak + 1e-9), 0, 1))
    for factor in (2.0, 0.5) if window and not window[0] <= best <= window[1] else ():
        if window[0] <= best * factor <= window[1] and fit(best * factor) >= 0.75 * peak:
            best *= factor
            break
    return round(best, 1), sure


def key_of(samples: np.ndarray, rate: int) -> tuple[str | None, float]:
    """(key on the wheel, margin over the next one) by correlating pitch classes, averaged over octaves, with
    the profiles of all keys."""
    size = 8192
    spec = spectrogram(samples, size, 2048)
    freq = np.fft.rfftfreq(size, 1 / rate)
    notes = np.arange(40, 95)
    at = np.searchsorted(freq, 440.0 * 2 ** ((notes - 69) / 12)).clip(1, len(freq) - 2)
    near = np.stack([spec[i - 8 : i + 9].mean(axis=0) if i > 8 else spec[: i + 9].mean(axis=0) for i in at])
    tone = np.maximum(spec[at], np.maximum(spec[at - 1], spec[at + 1])) / (near + 1e-6)
    chroma = np.stack([tone[notes % 12 == p].mean(axis=0) for p in range(12)])
    loud = spec.sum(axis=0)
    if not loud.sum() > 0:
        return None, 0.0
    mean = (chroma / (np.linalg.norm(chroma, axis=0) + 1e-9)) @ (loud / loud.sum())
    found = sorted(((float(np.corrcoef(np.roll(mean, -p), profile)[0, 1]), p, letter) for p in range(12) for profile, letter in ((MAJOR, "B"), (MINOR, "A"))), reverse=True)
    best, p, letter = found[0]
    # Fifths are neighbours on the wheel: C major is 8B, A minor 8A.
    number = (7 * p + (7 if letter == "B" else 4)) % 12 + 1
    return f"{number}{letter}", round(best - found[1][0], 3)


def centroid_of(samples: np.ndarray, rate: int) -> tuple[float | None, float | None]:
    """(mean frequency weighted by magnitude, root mean square)."""
    if not len(samples):
        return None, None
    spec = spectrogram(samples, 2048, 512)
    total = spec.sum(axis=0)
    freq = np.fft.rfftfreq(2048, 1 / rate)
    loud = total > 0
    centre = float(((freq @ spec)[loud] / total[loud]).mean()) if loud.any() else 0.0
    return centre, float(np.sqrt(np.mean(samples.astype(float) ** 2)))


def cutoff_of(samples: np.ndarray, rate: int, silence: float = 1e-4) -> float:
    """The highest frequency within 60 dB of the level between 1 and 8 kHz; 0 for silence."""
    if not len(samples) or not np.abs(samples).max() >= silence:
        return 0.0
    level = 20 * np.log10(spectrogram(samples, 4096, 2048).mean(axis=1) + 1e-12)
    freq = np.fft.rfftfreq(4096, 1 / rate)
    active = np.flatnonzero(level > np.median(level[(freq > 1000) & (freq < 8000)]) - 60)
    return float(freq[active[-1]]) if len(active) else 0.0


def cutoff_windows(seconds_long: float, seconds: int = 30) -> tuple[int, ...]:
    """Where the upper end of a spectrum is measured: at one minute, in tracks of ``LONG`` seconds and more
    also at three fifths, behind the first window and inside the track."""
    if seconds_long < LONG:
        return (60,)
    return 60, max(60 + seconds, min(int(0.6 * seconds_long), int(seconds_long) - seconds))


def widest_cutoff(samples: np.ndarray, rate: int, starts: tuple[int, ...] | None = None, seconds: int = 30) -> float:
    """The highest ``cutoff_of`` over windows of ``seconds`` from ``starts`` on, by default ``cutoff_windows``: a quiet
    beginning hides what a loud part shows. A window needs five seconds (nine tenths of a shorter one); where
    none has them, the beginning is measured if it has three. 0 where nothing can be."""
    starts = cutoff_windows(len(samples) / rate, seconds) if starts is None else starts
    parts = [samples[s * rate : (s + seconds) * rate] for s in {max(0, int(s)) for s in starts}]
    whole = [p for p in parts if len(p) >= int(min(5.0, 0.9 * seconds) * rate)]
    if not whole and len(samples) >= int(min(3.0, 0.9 * seconds) * rate):
        whole = [samples[: seconds * rate]]
    return max((cutoff_of(p, rate) for p in whole), default=0.0)


def cutoff(samples: Column | str, rate: int = 44_100, starts: tuple[int, ...] | None = None, seconds: int = 30) -> Column:
    """``widest_cutoff`` of arrays of samples; 0 for null."""
    return F.pandas_udf(lambda rows: pd.Series([widest_cutoff(np.asarray(r if r is not None else [], dtype=np.float32), rate, starts, seconds) for r in rows], dtype=float), "double")(samples)


def analysis(samples: Column | str, rate: int = 44_100, window: tuple[float, float] | None = None, seconds: int = 90) -> Column:
    """struct(bpm, bpm_confidence, key_camelot, key_margin, centroid, rms, cutoff) of the first ``seconds`` of
    samples; all null for null or less than three seconds."""

    def work(rows: pd.Series) -> pd.DataFrame:
        out = []
        for r in rows:
            y = np.asarray(r if r is not None else [], dtype=np.float32)[: seconds * rate]
            if len(y) < 3 * rate:
                out.append((None,) * 7)
                continue
            out.append((*tempo_of(y, rate, window=window), *key_of(y, rate), *centroid_of(y, rate), cutoff_of(y, rate)))
        return pd.DataFrame(out, columns=["bpm", "bpm_confidence", "key_camelot", "key_margin", "centroid", "rms", "cutoff"], dtype=object)

    return F.pandas_udf(work, "bpm double, bpm_confidence double, key_camelot string, key_margin double, centroid double, rms double, cutoff double")(samples)
