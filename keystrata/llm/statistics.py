"""What one pass over a text counts; shared by the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np
import zstandard

WINDOW = 5
CHUNK = 4096
_BLANKS = bytes(range(9, 14)) + b" "


def repeat_words(words: list) -> int:
    """Words in ``WINDOW``-word windows that occur twice or more, every occurrence included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    place: dict = {}
    ids = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, n)
    bits = max(1, len(place).bit_length())
    key = ids[: n - WINDOW + 1].copy()
    for k in range(1, WINDOW):
        if bits + int(key.max()).bit_length() > 63:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = (key << bits) + ids[k : n - WINDOW + 1 + k]
    _, at, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[at] > 1)
    if not len(twice):
        return 0
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, twice, 1)
    np.add.at(inside, twice + WINDOW, -1)
    return int((np.cumsum(inside)[:n] > 0).sum())


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.encode("utf-8", "surrogatepass").strip(_BLANKS)]
    return len(lines) - len(set(lines))


class Meter:
    """Measures texts; holds a compressor, so one is made in each worker."""

    def __init__(self, level: int = 3):
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=False)

    def base(self, text: str | None) -> tuple[int, int, int, int, int]:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
        if not text:
            return 0, 0, 0, 0, 0
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        chars = len(text) - (len(raw) - len(raw.translate(None, _BLANKS)))
        symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
        return len(words), chars, symbols, dup_lines(text), repeat_words(words)

    def ratio(self, raw: bytes) -> float:
        """Bytes for each compressed byte."""
        return len(raw) / max(1, len(self.packer.compress(raw)))

    def bands(self, text: str | None) -> tuple[float, list[tuple[int, float]]]:
        """Ratio of the whole text, then size and ratio of each fixed chunk; a short last chunk joins the one before."""
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if not raw:
            return 0.0, []
        if len(raw) < 2 * CHUNK:
            whole = self.ratio(raw)
            return whole, [(len(raw), whole)]
        cuts = [*range(0, len(raw) - CHUNK + 1, CHUNK)]
        ends = [*cuts[1:], len(raw)]
        return self.ratio(raw), [(b - a, self.ratio(raw[a:b])) for a, b in zip(cuts, ends, strict=True)]

    def features(self, text: str | None) -> list[float]:
        """Statistics for the classifier, each of bounded range."""
        n, chars, symbols, dups, repeats = self.base(text)
        if not n:
            return [0.0] * FEATURES
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        lengths = np.fromiter(map(len, words), float, n)
        size = len(raw)
        upper = size - len(raw.translate(None, bytes(range(65, 91))))
        digits = size - len(raw.translate(None, bytes(range(48, 58))))
        marks = size - len(raw.translate(None, b".,;:!?"))
        lines = raw.count(b"\n") + 1
        return [
            np.log1p(n), float(lengths.mean()) / 10, min(float(lengths.std()), 50) / 10, len(set(words)) / n, symbols / chars, dups / lines, repeats / n,
            min(upper / chars, 1), min(digits / chars, 1), min(marks / n, 3), np.log1p(n / lines), min(self.ratio(raw), 30) / 10, raw.count(b"!") / n, min(float(lengths.max()), 200) / 50, raw.count(b"http") / n, 1.0 - size / max(len(text) * 2, size),
        ]


FEATURES = 16
