"""Quality rules as a short-circuit cascade: what a rule costs and rejects is estimated on a sample, and rules that reject
most for their cost run first; a text that one rule rejects is not looked at by the later ones."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from time import thread_time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.llm.batches import chunks, filled, flat, narrow, released, spans

#: Rows of the sample that costs and rejections are estimated on (about; they only order the rules).
SAMPLE_ROWS = 4000
#: Words of a window whose repetition counts.
WINDOW = 3
_BLANK = [0x20, *range(0x09, 0x0E)]
_WORD = np.ones(256, bool)
_WORD[_BLANK] = False
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_LETTER = np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


@dataclass(frozen=True)
class Rule:
    """Rejects a text if the sum of its features times *weights* is over *above* (all integers)."""

    name: str
    weights: tuple[tuple[str, int], ...]
    above: int = 0

    def rejects(self, value: Callable[[str], np.ndarray]) -> np.ndarray:
        return sum(w * value(f) for f, w in self.weights) > self.above


#: The rules that every text must pass whatever else is asked for.
BASE = (
    Rule("short", (("n_words", -1),), above=-50),
    Rule("repetition", (("n_repeat_words", 100), ("n_words", -50))),
)
#: Usual further rules: symbols in a tenth of the words, half of the lines copies, mean word length outside 3 to 10, a word
#: of over 1,000 characters, a fifth of the words without a letter, nine tenths of the lines with bullets, three tenths with
#: an ellipsis, one word three tenths of all.
RULES = BASE + (
    Rule("symbols", (("n_symbols", 10), ("n_words", -1))),
    Rule("copied_lines", (("n_dup_lines", 2), ("n_lines", -1))),
    Rule("short_words", (("n_words", 3), ("word_chars", -1))),
    Rule("long_words", (("word_chars", 1), ("n_words", -10))),
    Rule("longest_word", (("longest_word", 1),), above=1000),
    Rule("no_letters", (("n_words", 8), ("n_letter_words", -10))),
    Rule("bullets", (("n_bullet_lines", 10), ("n_lines", -9))),
    Rule("ellipses", (("n_ellipsis_lines", 10), ("n_lines", -3))),
    Rule("one_word", (("n_top_word", 10), ("n_words", -3))),
)


class Texts:
    """Some texts as one byte array. What several features are made of is worked out once, when it is first needed."""

    def __init__(self, body: np.ndarray, begin: np.ndarray, end: np.ndarray, clock: dict[str, float] | None = None):
        self.body, self.begin, self.end, self.clock, self.done = body, begin, end, clock, {}

    @classmethod
    def of(cls, texts: pa.Array, clock: dict[str, float] | None = None) -> Texts:
        body, offsets = flat(texts)
        return cls(body, offsets[:-1], offsets[1:], clock)

    def __len__(self) -> int:
        return len(self.begin)

    def get(self, name: str):
        """The feature or part of that name; *clock* gets the seconds that it took without those it is made of."""
        if name not in self.done:
            for other in NEEDS[name]:
                self.get(other)
            began = thread_time()
            self.done[name] = STEPS[name](self)
            if self.clock is not None:
                self.clock[name] = self.clock.get(name, 0.0) + thread_time() - began
        return self.done[name]

    def take(self, rows: np.ndarray) -> Texts:
        """Those of the boolean *rows*, with all that is known of them."""
        out, place = Texts(self.body, self.begin[rows], self.end[rows], self.clock), np.cumsum(rows) - 1
        for name, known in self.done.items():
            if name in ("words", "lines"):
                kept = rows[known[0]]
                out.done[name] = (place[known[0][kept]], *(x[kept] for x in known[1:]))
            elif name == "codes":
                out.done[name] = (known[0][rows[self.done["words"][0]]], known[1])
            else:
                out.done[name] = known if name == "sums" else known[rows]
        return out

    def per_row(self, row: np.ndarray) -> np.ndarray:
        """How many entries each row has."""
        return np.bincount(row, minlength=len(self)).astype(np.int64)


def _codes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal numbers for equal spans (ordered, disjoint), and how many there are."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    joined = body[np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)]
    offsets = pa.py_buffer(np.r_[before, sizes.sum()].astype(np.int64).tobytes())
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(joined.tobytes())]).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(found.dictionary)


def _rows(t: Texts, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which places lie in a row, and the rows of these."""
    full = np.flatnonzero(t.end > t.begin)
    if not len(full) or not len(places):
        return np.zeros(len(places), bool), np.zeros(0, np.int64)
    row = full[np.searchsorted(t.begin[full], places, "right") - 1]
    inside = (places >= t.begin[row]) & (places < t.end[row])
    return inside, row[inside]


def _words(t: Texts) -> tuple[np.ndarray, ...]:
    """(row, start, end) of the words."""
    starts, ends = spans(t.body, np.unique(np.r_[0, t.begin, t.end, len(t.body)]), _WORD)
    inside, row = _rows(t, starts)
    return row, starts[inside], ends[inside]


def _lines(t: Texts) -> tuple[np.ndarray, ...]:
    """(row, start, end) of the lines that have a word."""
    breaks = np.flatnonzero(t.body == 0x0A)
    inside, which = _rows(t, breaks)
    row, start, end = np.r_[np.arange(len(t)), which], np.r_[t.begin, breaks[inside] + 1], np.r_[t.end, breaks[inside]]
    by, last = np.lexsort((start, row)), np.lexsort((end, row))
    row, start, end = row[by], start[by], end[last]
    begins = t.get("words")[1]
    worded = np.searchsorted(begins, end) > np.searchsorted(begins, start)
    return row[worded], start[worded], end[worded]


def _sums(t: Texts) -> np.ndarray:
    """Characters (bytes that start one) before each byte."""
    return np.r_[0, np.cumsum((t.body & 0xC0) != 0x80)]


def _word_lengths(t: Texts) -> np.ndarray:
    sums, (_, start, end) = t.get("sums"), t.get("words")
    return sums[end] - sums[start]


def _count_bytes(t: Texts, table: np.ndarray) -> np.ndarray:
    before = np.r_[0, np.cumsum(table[t.body])]
    return before[t.end] - before[t.begin]


def _repeat_words(t: Texts) -> np.ndarray:
    """Words in windows that the text has twice or more."""
    row, (code, n) = t.get("words")[0], t.get("codes")
    key = code[: max(0, len(code) - WINDOW + 1)]
    for k in range(1, WINDOW):
        if n and int(key.max(initial=0)) > (1 << 62) // n:
            key = np.unique(key, return_inverse=True)[1]
        key = key * n + code[k:len(code) - WINDOW + 1 + k]
    at = np.flatnonzero(row[:len(key)] == row[WINDOW - 1:]) if len(key) else np.zeros(0, np.int64)
    by = at[np.argsort(key[at], kind="stable")]
    same = (key[by][1:] == key[by][:-1]) & (row[by][1:] == row[by][:-1])
    twice = by[np.r_[same, False] | np.r_[False, same]] if len(by) else by
    covered = np.zeros(len(row), bool)
    for k in range(WINDOW):
        covered[twice + k] = True
    return t.per_row(row[covered])


def _copied_lines(t: Texts) -> np.ndarray:
    row, start, end = t.get("lines")
    code, n = _codes(t.body, start, end)
    return t.per_row(row) - t.per_row(np.unique(row * max(n, 1) + code) // max(n, 1))


def _top_word(t: Texts) -> np.ndarray:
    row, (code, n) = t.get("words")[0], t.get("codes")
    pairs, times = np.unique(row * max(n, 1) + code, return_counts=True)
    out = np.zeros(len(t), np.int64)
    np.maximum.at(out, pairs // max(n, 1), times)
    return out


def _longest(t: Texts) -> np.ndarray:
    out = np.zeros(len(t), np.int64)
    np.maximum.at(out, t.get("words")[0], _word_lengths(t))
    return out


def _letter_words(t: Texts) -> np.ndarray:
    row, start, end = t.get("words")
    before = np.r_[0, np.cumsum(_LETTER[t.body])]
    return t.per_row(row[before[end] > before[start]])


def _shown(body: np.ndarray, at: np.ndarray, mark: bytes) -> np.ndarray:
    """Where the bytes of *mark* stand at places *at*."""
    out = (at >= 0) & (at + len(mark) <= len(body))
    for k, b in enumerate(mark):
        out[out] = body[at[out] + k] == b
    return out


def _marked_lines(t: Texts, marks: Sequence[bytes], first: bool) -> np.ndarray:
    """Lines whose first word begins, or whose last word ends, with one of *marks*."""
    (row, start, end), (_, begins, stops) = t.get("lines"), t.get("words")
    words = np.searchsorted(begins, start) if first else np.searchsorted(begins, end) - 1
    found = np.zeros(len(row), bool)
    for m in marks:
        at = begins[words] if first else stops[words] - len(m)
        found |= _shown(t.body, at, m) & (at >= begins[words])
    return t.per_row(row[found])


#: How a feature, or a part of several, is made, and of which others.
STEPS: dict[str, Callable] = {
    "words": _words, "lines": _lines, "sums": _sums,
    "codes": lambda t: _codes(t.body, *t.get("words")[1:]),
    "n_words": lambda t: t.per_row(t.get("words")[0]),
    "word_chars": lambda t: np.bincount(t.get("words")[0], _word_lengths(t), len(t)).astype(np.int64),
    "n_symbols": lambda t: _count_bytes(t, _SYMBOL),
    "n_dup_lines": _copied_lines,
    "n_repeat_words": _repeat_words,
    "n_lines": lambda t: t.per_row(t.get("lines")[0]),
    "longest_word": _longest,
    "n_letter_words": _letter_words,
    "n_bullet_lines": lambda t: _marked_lines(t, (b"-", b"*", "•".encode()), True),
    "n_ellipsis_lines": lambda t: _marked_lines(t, (b"...", "…".encode()), False),
    "n_top_word": _top_word,
}
_MADE_OF = {"lines": ["words"], "codes": ["words"], "word_chars": ["words", "sums"], "longest_word": ["words", "sums"], "n_symbols": [],
            "n_repeat_words": ["words", "codes"], "n_top_word": ["words", "codes"], "n_dup_lines": ["lines"], "n_lines": ["lines"],
            "n_bullet_lines": ["words", "lines"], "n_ellipsis_lines": ["words", "lines"], "words": [], "sums": []}
NEEDS = {name: _MADE_OF.get(name, ["words"]) for name in STEPS}


def _closure(names: Iterable[str]) -> set[str]:
    out: set[str] = set()
    todo = list(names)
    while todo:
        name = todo.pop()
        if name not in out:
            out.add(name)
            todo += NEEDS[name]
    return out


def order(rules: Sequence[Rule], patterns: dict[int, int], seconds: dict[str, float], report: Iterable[str] = ()) -> list[Rule]:
    """*rules* by rejections per cost, the best first, ties as given.

    patterns: how many texts the rules of a bit set reject (bit i: rules[i]); seconds: what each step costs for all of them.
    Each turn looks only at texts that no earlier rule rejects, and only at steps that no earlier rule, nor *report*, needed.
    """
    left, out, done = dict(patterns), [], _closure(report)
    total = max(1, sum(patterns.values()))
    while len(out) < len(rules):
        alive = sum(left.values()) / total

        def gain(i: int) -> float:
            cost = 1e-9 + alive * sum(seconds.get(s, 0.0) for s in _closure(f for f, _ in rules[i].weights) - done)
            return sum(n for bits, n in left.items() if bits >> i & 1) / cost

        best = max((i for i in range(len(rules)) if rules[i] not in out), key=lambda i: (gain(i), -i))
        out.append(rules[best])
        done |= _closure(f for f, _ in rules[best].weights)
        left = {bits: n for bits, n in left.items() if not bits >> best & 1}
    return out


def plan(docs: DataFrame, rules: Sequence[Rule] = RULES, report: Iterable[str] = (), id_column: str = "doc_id",
         text_column: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """*rules* in the order of :func:`order`, by a sample of about *sample_rows* texts (drawn at random; only
    the order depends on it). Tasks time the steps and count which rules reject together; only these sums reach the driver. An empty
    table leaves the order as it is."""
    texts = narrow(docs, id_column, text_column)
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = texts.select("text").sample(share, seed=13) if share < 1 else texts.select("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clock, counts = {}, {}
        for batch in batches:
            whole = filled(batch.column("text"), "")
            for low, high in chunks(whole):
                part = Texts.of(whole.slice(low, high - low), clock)
                bits = sum(r.rejects(part.get).astype(np.int64) << i for i, r in enumerate(rules))
                for b, n in zip(*np.unique(bits, return_counts=True)):
                    counts[int(b)] = counts.get(int(b), 0) + int(n)
        names = [*clock, *[""] * len(counts)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([*[0] * len(clock), *counts], pa.int64()),
                                          pa.array([*clock.values(), *map(float, counts.values())], pa.float64())], names=["step", "bits", "amount"])

    sums = sample.mapInArrow(run, "step string, bits long, amount double").groupBy("step", "bits").agg(F.sum("amount").alias("amount")).collect()
    return order(rules, {r.bits: int(r.amount) for r in sums if not r.step}, {r.step: r.amount for r in sums if r.step}, report)


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, report: Sequence[str] = (), always: Sequence[Rule] = (), id_column: str = "doc_id",
          text_column: str = "text", keep_text: bool = False) -> DataFrame:
    """Each row of *docs* with ``kept`` (no rule rejects it) and ``rejected_by`` (the first of *rules*, in the given order,
    that does; null if kept), the features of *report*, and a boolean column named as each rule of *always*.

    What *report* and *always* need is computed for all rows, the rest only for rows that the rules before have let
    through. Null texts are empty: no words, so ``short`` rejects them. Texts are read whole; repeated rows and null ids
    stay; columns of *docs* other than id and text are not returned. An empty table gives an empty table. Which rows are
    kept doesn't depend on the order of *rules*.
    """
    texts = narrow(docs, id_column, text_column)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = filled(batch.column("text"), "")
            for low, high in chunks(whole):
                part = Texts.of(whole.slice(low, high - low))
                told = {f: part.get(f) for f in report} | {r.name: r.rejects(part.get) for r in always}
                alive, by = np.arange(len(part)), np.full(len(part), -1)
                for i, rule in enumerate(rules):
                    if not len(alive):
                        break
                    bad = rule.rejects(part.get)
                    by[alive[bad]] = i
                    if bad.any():
                        alive, part = alive[~bad], part.take(~bad)
                names = pa.array([r.name for r in rules], pa.string()).take(pa.array(by, mask=by < 0))
                kept = {"doc_id": batch.column("doc_id").slice(low, high - low)} | ({"text": batch.column("text").slice(low, high - low)} if keep_text else {})
                columns = kept | {k: pa.array(v) for k, v in told.items()} | {"kept": pa.array(by < 0), "rejected_by": names}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    fields = [f"doc_id {kind}", *["text string"] * keep_text, *[f"{f} long" for f in report], *[f"{r.name} boolean" for r in always], "kept boolean", "rejected_by string"]
    return texts.mapInArrow(released(run), ", ".join(fields))
