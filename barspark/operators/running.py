"""The recursive indicators bar by bar, with a state that can be kept: what a stream adds to."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from . import indicators as ind

N, SIGNAL = 14, 9
SPANS = {"ema_short": 5, "ema_mid": 25, "ema_long": 75} | {f"gmma_short_{n}": n for n in ind.GMMA_SHORT} | {f"gmma_long_{n}": n for n in ind.GMMA_LONG}
_FAST, _SLOW = 12, 26


def _over(a: float | None, b: float | None) -> float | None:
    return None if a is None or not b else a / b


@dataclass
class Wilder:
    """Begun with the mean of the first N values in a row; a missing value later changes nothing."""

    value: float | None = None
    run: list[float] = field(default_factory=list)

    def add(self, x: float | None) -> float | None:
        if self.value is not None:
            self.value += 0 if x is None else (x - self.value) / N
        elif x is None:
            self.run = []
        else:
            self.run.append(x)
            if len(self.run) == N:
                self.value, self.run = sum(self.run) / N, []
        return self.value


@dataclass
class Running:
    """The state of a symbol after its last bar."""

    n: int = 0
    last: list[list[float]] = field(default_factory=list)  # high, low, close of the last two bars
    means: dict[str, float] = field(default_factory=dict)
    signal: float | None = None
    moves: dict[str, Wilder] = field(default_factory=lambda: {k: Wilder() for k in ("rise", "fall", "range", "plus", "minus", "adx")})
    stop: list | None = None  # rising, stop, extreme, pace

    def kept(self) -> dict:
        return asdict(self)

    @classmethod
    def of(cls, kept: dict) -> Running:
        return cls(**(kept | {"moves": {k: Wilder(**w) for k, w in kept["moves"].items()}}))

    def _mean(self, span: int, x: float) -> float | None:
        key = str(span)
        self.means[key] = x if key not in self.means else self.means[key] + (x - self.means[key]) * 2 / (span + 1)
        return self.means[key] if self.n >= span else None

    def add(self, high: float, low: float, close: float) -> dict[str, float | None]:
        """The recursive columns of the next bar."""
        self.n += 1
        by_span = {s: self._mean(s, close) for s in {*SPANS.values(), _FAST, _SLOW}}
        out: dict[str, float | None] = {k: by_span[s] for k, s in SPANS.items()}
        fast, slow = by_span[_FAST], by_span[_SLOW]
        macd = out["macd"] = None if slow is None else fast - slow
        if macd is not None:
            self.signal = macd if self.signal is None else self.signal + (macd - self.signal) * 2 / (SIGNAL + 1)
        out["macd_signal"] = self.signal if self.n >= _SLOW + SIGNAL - 1 else None

        now = dict.fromkeys(self.moves)
        if self.last:
            h, lo, c = self.last[-1]
            up, down = high - h, lo - low
            now |= {"rise": max(close - c, 0.0), "fall": max(c - close, 0.0), "range": max(high, c) - min(low, c)}
            now |= {"plus": up if up > down and up > 0 else 0.0, "minus": down if down > up and down > 0 else 0.0}
        gain, loss, width, plus, minus = (self.moves[k].add(now[k]) for k in ("rise", "fall", "range", "plus", "minus"))
        out["rsi"] = None if gain is None else 50.0 if gain == loss == 0 else _over(100 * gain, gain + loss)
        out["plus_di"], out["minus_di"] = (None if x is None else _over(100 * x, width) for x in (plus, minus))
        apart, both = (None, None) if plus is None else (_over(abs(plus - minus), width), _over(plus + minus, width))
        out["adx"] = self.moves["adx"].add(None if apart is None else _over(100 * apart, both))
        out["parabolic"] = self._stop(high, low)
        self.last = [*self.last[-1:], [high, low, close]]
        return out

    def _stop(self, high: float, low: float, step: float = 0.02, most: float = 0.2) -> float | None:
        if not self.last:
            return None
        h, lo, _ = self.last[-1]
        if self.stop is None:
            self.stop = [True, lo, h, step] if high + low >= h + lo else [False, h, lo, step]
        rising, stop, extreme, pace = self.stop
        stop += pace * (extreme - stop)
        stop = min(stop, *(b[1] for b in self.last)) if rising else max(stop, *(b[0] for b in self.last))
        if low < stop if rising else high > stop:
            rising, stop, pace = not rising, extreme, step
            extreme = high if rising else low
        elif (high > extreme) if rising else (low < extreme):
            extreme, pace = (high if rising else low), min(pace + step, most)
        self.stop = [rising, stop, extreme, pace]
        return stop
