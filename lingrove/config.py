"""Options of training, identification and sampling, with their checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from .functions import scaling

SMALL_DATA = 1e11  # bytes x k of the text of one training


@dataclass(frozen=True)
class TrainOptions:
    """k: n-grams per model; lengths; affix ratio (over 1: no pruning, under 0.4: 0.4); power of the smoothing (negative: logarithmic); limit_bytes: train on the first bytes, or on lines spread over all the text (sampled); boost: of n-grams no related model has; small: the passes for small data (None: as the bytes say)."""

    k: int = 5000
    min_length: int = 3
    max_length: int = 8
    affix_ratio: float = 0.90
    power: float = scaling.POWER
    alignment: int = 1
    bigrams: bool = True
    skip_newlines: bool = False
    skip_numbers: bool = False
    discount: float = 1.0
    oversample: float = 2.5
    limit_bytes: int | None = None
    sampled: bool = False
    boost: float = 1.0
    small: bool | None = None

    def __post_init__(self) -> None:
        if not 3 <= self.min_length <= self.max_length <= 8:
            raise ValueError("lengths: 3 <= min_length <= max_length <= 8")
        if self.alignment not in (1, 2, 4) or self.k < 1:
            raise ValueError("alignment: 1, 2 or 4; k: 1 at least")
        ratio = 2.0 if self.affix_ratio > 1 else max(0.4, self.affix_ratio)
        object.__setattr__(self, "affix_ratio", ratio)
        object.__setattr__(self, "power", min(self.power, 5.0) if self.power >= 0 else -(10.0 ** abs(self.power)) if self.power > -10 else self.power)

    def passes(self, n_bytes: int) -> list[tuple[int, int]]:
        """(shortest, longest) of each counting pass; fewer and wider passes for small data."""
        x, small, out = self.alignment, n_bytes * self.k < SMALL_DATA if self.small is None else self.small, []
        m, top = 4, min(self.max_length, 4 + x * (2 if small else 1))
        while m <= self.max_length:
            out.append((m, top))
            step = min(10 * x, x + x * (top - 2) // 2) * (2 if small else 1)
            m, top = top + 1, min(self.max_length, top + step)
        return out

    def pass_k(self, shortest: int) -> int:
        """More n-grams are kept while a pass is below the smallest length wanted."""
        if shortest >= self.min_length:
            return self.k
        base = 2.0 if self.alignment > 1 else 1.0
        return int(self.k * min(2.0 ** (base + (self.min_length - shortest) / 5), self.oversample))


@dataclass(frozen=True)
class IdentifyOptions:
    """block: bytes of a block (0: the first 256 KiB as one; 1 or 2: lines); ratio and top_n bound the report.

    adjust_coverage: scores times the models' adjustment; separate_sources: models that differ in their source alone are shown apart; friendly: names for
    codes; smooth: each string's scores are mixed with those before it; ignore_blanks: blanks aren't scored; terse: languages alone; verbose: strings
    without a language are reported too.
    """

    block: int = 4096
    top_n: int = scaling.TOP_N
    ratio: float = scaling.RATIO
    sure: float = scaling.SURE
    bigram_weight: float = scaling.BIGRAM_WEIGHT
    stop_penalty: float = scaling.STOP_PENALTY
    stop_grams: bool = True
    adjust_coverage: bool = False
    separate_sources: bool = False
    friendly: bool = False
    smooth: bool = False
    ignore_blanks: bool = False
    terse: bool = False
    show_script: bool = False
    verbose: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "ratio", min(1.0, max(0.0001, self.ratio)))
        object.__setattr__(self, "top_n", max(1, self.top_n))
        if self.block > 2:
            object.__setattr__(self, "block", min(262144, max(80, self.block)))

    def lengths(self, longest: int = 8) -> range:
        return range(2 if self.bigram_weight > 0 else 3, longest + 1)


@dataclass(frozen=True)
class Language:
    """A model's descriptor; out-of-range coverages fall back or are clamped."""

    language: str
    friendly: str | None = None
    region: str | None = None
    encoding: str | None = "utf-8"
    source: str | None = None
    script: str | None = None
    alignment: int = 1
    coverage: float = 1.0
    counted_cover: float = 0.0
    freq_cover: float = 0.0
    match_factor: float = 0.0
    train_bytes: int = 0
    extra: dict = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        code, _, name = self.language.partition("=")
        fix = {
            "language": code,
            "friendly": self.friendly or name or code,
            "coverage": self.coverage if 0 < self.coverage <= 1 else 1.0,
            "counted_cover": min(32.0, max(0.0, self.counted_cover)),
            "freq_cover": min(100.0, max(0.0, self.freq_cover)),
            "match_factor": min(16.0, max(0.0, self.match_factor)),
            "alignment": parse_alignment(self.alignment),
        }
        for k, v in fix.items():
            object.__setattr__(self, k, v)

    def describe(self) -> str:
        return self.language + (f"_{self.region}" if self.region else "") + (f"-{self.encoding}" if self.encoding else "")


def parse_alignment(text: str | int | None) -> int:
    """1, 2 or 4: below 1 is 1, 3 is 2, above 4 is 4."""
    try:
        n = int(text)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return 1
    return 1 if n < 1 else 2 if n == 3 else 4 if n > 4 else n
