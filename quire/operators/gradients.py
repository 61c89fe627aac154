"""Gradients: stops that are needed, and no others."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from .folds import folded


def simplify(stops: list[tuple[float, tuple[float, ...]]], tolerance: float = 1.0) -> list[tuple[float, tuple[float, ...]]]:
    """Gradient stops without those that a line between kept ones gives within the tolerance per channel, greedily."""
    if len(stops) < 3:
        return list(stops)
    out, begin = [stops[0]], 0
    while begin < len(stops) - 1:
        end = begin + 1
        while end + 1 < len(stops):
            (x0, a), (x1, b) = stops[begin], stops[end + 1]
            span = x1 - x0
            inside = all(
                abs(a[k] + (b[k] - a[k]) * ((x - x0) / span if span else 0) - c[k]) <= tolerance for x, c in stops[begin + 1 : end + 1] for k in range(len(c))
            )
            if not inside:
                break
            end += 1
        out.append(stops[end])
        begin = end
    return out


def needed(samples: Iterator[tuple[int, ...]], tolerance: int = 1) -> Iterator[tuple[int, ...]]:
    """simplify over a stream of (offset, channels) in integers, exactly, with a state of fixed size: of the samples behind the
    last kept one it remembers, per channel, the slopes that a line from there may have, as fractions."""
    begin = next(samples, None)
    if begin is None:
        return
    yield begin
    end, bounds, level = None, [], True
    for sample in samples:
        if end is not None and not _fits(begin, sample, bounds, level):
            yield end
            begin, bounds, level = end, [], True
        end = sample
        run = sample[0] - begin[0]
        if run:
            bounds = _narrowed(bounds, [((c - tolerance - a, run), (c + tolerance - a, run)) for a, c in zip(begin[1:], sample[1:], strict=True)])
        else:
            level = level and all(abs(a - c) <= tolerance for a, c in zip(begin[1:], sample[1:], strict=True))
    if end is not None:
        yield end


def _fits(begin: tuple, sample: tuple, bounds: list, level: bool) -> bool:
    run = sample[0] - begin[0]
    slopes = [(c - a, run) if run else (0, 1) for a, c in zip(begin[1:], sample[1:], strict=True)]
    return level and all(not _less(s, low) and not _less(high, s) for s, (low, high) in zip(slopes, bounds or [(s, s) for s in slopes], strict=True))


def _less(a: tuple[int, int], b: tuple[int, int]) -> bool:
    return a[0] * b[1] < b[0] * a[1]


def _narrowed(old: list, new: list) -> list:
    if not old:
        return new
    return [(m if _less(low, m) else low, n if _less(n, high) else high) for (low, high), (m, n) in zip(old, new, strict=True)]


def stops(samples: DataFrame, key: str, offset: str, channels: list[str], tolerance: int = 1) -> DataFrame:
    """(key, offset, channels): the samples of each key that a gradient needs, so that straight lines between them give all
    others within the tolerance per channel, greedily from the first. Offsets and channels are integers; samples with a null
    among them are left out; equal offsets are taken in the order of their channels. The first and the last sample stay; a key
    of one sample has it alone."""
    whole = samples.dropna(subset=[offset, *channels])
    schema = ", ".join(f"{c} {whole.schema[c].dataType.simpleString()}" for c in (offset, *channels))
    return folded(whole, key, [offset, *channels], [offset, *channels], lambda rows: needed(rows, tolerance), schema)
