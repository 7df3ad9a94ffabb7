"""Secret scans: fixed patterns, and a character convolutional network that judges every other candidate in its context."""

from __future__ import annotations

import copy
import hashlib
import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.llm.batches import chunks, filled, flat, map_texts, mix, released, rows_of, spans
from spectrafold.llm.toxicity import platt
from spectrafold.session import materialize

#: Kinds of the fixed patterns, in the order of results, and the kind of what the network adds.
BASE, ADDED = ("assign", "access", "hex"), "model"
_ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")  # runs are maximal, so this drops those that are too short
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST = {"assign": 6, "access": 20, "hex": 24}

TOKEN = np.zeros(256, bool)
TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
#: A candidate: a run of TOKEN of this length with letters and digits, or of LONG_TOKEN with anything; of LED_TOKEN with
#: anything, if it follows an assignment sign, a quote or a lead word.
LED_TOKEN, SHORT_TOKEN, LONG_TOKEN = 6, 16, 32
#: Blanks, quotes and signs between a lead or a sign and the value, at most.
_GAP = 4
_LEAD = re.compile(rb"""(?i:password|passwd|passphrase|passcode|pwd|secret|token|credentials?|bearer|api[_-]?key|private[_-]?key|access[_-]?key|auth)["']?(?:\x20+is)?(?=[\x20\t:=])""")
_SIGN, _BLANK, _LETTER = (np.zeros(256, bool) for _ in range(3))
_SIGN[list(b":=\"'`")] = _BLANK[list(b":=\"'` \t")] = True
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")] = _LETTER[128:] = True

#: The network sees BEFORE, INSIDE and AFTER bytes; a longer candidate is seen in steps of STRIDE, and the highest counts.
BEFORE, INSIDE, AFTER, STRIDE = 24, 48, 16, 32
_SIZE = BEFORE + INSIDE + AFTER
SYMBOLS, WIDTH, FILTERS, REACH = 74, 8, 24, 5
EPOCHS, BATCH, RATE = 8, 128, 3e-3
#: Generated findings that the network learns from beside those of all texts, words drawn from all texts to surround them, and
#: the recall that the threshold keeps of either source.
GENERATED, WORDS, RECALL = 4000, 8192, 0.97
#: Views of the texts' findings that one task learns from in an epoch; there are as many tasks as that takes.
SHARD = 4096
#: Logits of findings left out are counted in steps of a GRID-th; networks are averaged in whole multiples of 1 / FIXED, so
#: that sums don't depend on their order.
GRID, FIXED = 1024, 2.0**80


def _symbols() -> np.ndarray:
    """Classes of bytes: each letter, digit and token sign its own; other signs, blanks and bytes beyond ASCII by kind."""
    table = np.full(256, 1, np.int64)
    for i, byte in enumerate(np.flatnonzero(TOKEN)):
        table[byte] = 5 + i
    table[[9, 10, 13, 32]], table[128:], table[list(b"\"':<>")] = 2, 3, 4
    return table


_CLASS, _IN_LEAD = _symbols(), SYMBOLS - 1


def base_findings(body: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, by start and then kind: leftmost matches of each kind, those that fail dropped."""
    lower, out = body.lower(), []
    if any(k in lower for k in _KEYWORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(body) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in body:
        out += [("access", *m.span()) for m in _ACCESS.finditer(body) if len(m[0]) >= LEAST["access"]]
    out += [("hex", *m.span()) for m in _HEX.finditer(body)]
    return sorted(out, key=lambda x: (x[1], BASE.index(x[0])))


def _led(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions, sorted, right after an assignment sign, a quote (not an apostrophe in a word) or a lead word, and after up
    to _GAP blanks, quotes and signs that follow it; within its text."""
    sign = np.flatnonzero(_SIGN[data])
    within = np.ones(len(data), bool)
    within[offsets[:-1][offsets[1:] > offsets[:-1]]] = False  # first bytes of texts
    apostrophe = (data[sign] == 0x27) & within[sign] & _LETTER[data[sign - 1]]
    lead = np.array([m.span() for m in _LEAD.finditer(data.tobytes())], np.int64).reshape(-1, 2)
    lead = lead[rows_of(lead[:, 0], offsets) == rows_of(lead[:, 1] - 1, offsets)]
    at = np.r_[sign[~apostrophe], lead[:, 1] - 1]
    room = offsets[np.searchsorted(offsets, at, "right")]
    at = at + 1
    for step in range(_GAP + 1):
        inside = at < room
        at, room = at[inside], room[inside]
        if step < _GAP:
            at = at + _BLANK[data[at]]
    return np.unique(at)


def candidate_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all candidates, in bytes of the batch."""
    starts, ends = spans(data, offsets, TOKEN)
    some = ends - starts >= LED_TOKEN
    starts, ends = starts[some], ends[some]
    kept = ends - starts >= LONG_TOKEN
    for i in np.flatnonzero((ends - starts >= SHORT_TOKEN) & ~kept).tolist():
        run = data[starts[i]:ends[i]]
        kept[i] = ((run >= 0x30) & (run <= 0x39)).any() and (((run | 32) >= 0x61) & ((run | 32) <= 0x7A)).any()
    if len(starts):
        led = _led(data, offsets)
        run = np.searchsorted(starts, led, "right") - 1
        good = (run >= 0) & (ends[run] - led >= LED_TOKEN) & ~kept[run]
        led, run = led[good], run[good]
        run, first = np.unique(run, return_index=True)  # the longest value of a run
        starts = starts.copy()
        starts[run], kept[run] = led[first], True
    return starts[kept], ends[kept]


def windows(body: bytes, start: int, end: int) -> Iterator[np.ndarray]:
    """The network's views of a candidate: classes of its bytes and of those around it, 0 where there is none; letters of a
    lead word before or in it are a class of their own."""
    raw = np.frombuffer(body, np.uint8)
    leads = [m.span() for m in _LEAD.finditer(body, max(0, start - BEFORE), end)]
    for at in range(start, max(start + 1, end - INSIDE + STRIDE), STRIDE):
        out = np.zeros(_SIZE, np.int64)
        low, stop = max(0, start - BEFORE), min(end, at + INSIDE)
        before, after = raw[low:start], raw[end:end + AFTER]
        out[BEFORE - len(before):BEFORE] = _CLASS[before]
        out[BEFORE:BEFORE + stop - at] = _CLASS[raw[at:stop]]
        for a, b in leads:
            out[BEFORE + max(a, low) - start:max(0, BEFORE + min(b, start) - start)] = _IN_LEAD
            out[BEFORE + max(0, a - at):BEFORE + max(0, min(b, stop) - at)] = _IN_LEAD
        out[BEFORE + INSIDE:BEFORE + INSIDE + len(after)] = _CLASS[after]
        yield out


@dataclass
class Network:
    """Embedding, one convolution, the highest response of each filter within the candidate and around it, a logit."""

    embed: np.ndarray
    kernel: np.ndarray
    kernel_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 2.0  # above any probability: nothing is added

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        return cls(rng.normal(0, 0.5, (SYMBOLS, WIDTH)), rng.normal(0, (2 / (REACH * WIDTH)) ** 0.5, (REACH * WIDTH, FILTERS)),
                   np.zeros(FILTERS), rng.normal(0, 0.2, 2 * FILTERS), 0.0)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        n, steps = len(x), _SIZE - REACH + 1
        patches = np.lib.stride_tricks.sliding_window_view(x, REACH, axis=1)
        inputs = self.embed[patches].reshape(n, steps, REACH * WIDTH) * (patches > 0).repeat(WIDTH, axis=2)
        response = np.maximum(inputs @ self.kernel + self.kernel_bias, 0)
        within = np.zeros(steps, bool)
        within[BEFORE - REACH // 2:BEFORE + INSIDE - REACH // 2] = True
        tops, pooled = [], []
        for mask in (within, ~within):
            places = np.flatnonzero(mask)
            top = places[response[:, places].argmax(axis=1)]
            tops.append(top)
            pooled.append(np.take_along_axis(response, top[:, None, :], axis=1)[:, 0])
        hidden = np.concatenate(pooled, axis=1)
        return hidden @ self.out + self.out_bias, (patches, inputs, hidden, tops)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[low:low + 256])[0] for low in range(0, len(x), 256)] or [np.zeros(0)])

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.offset, -40, 40)))

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weighted log loss: embed, kernel, kernel_bias, out, out_bias."""
        logit, (patches, inputs, hidden, tops) = self.forward(x)
        error = weight * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) / len(y)
        back = error[:, None] * self.out * (hidden > 0)
        d_kernel, d_bias, d_embed = np.zeros_like(self.kernel), np.zeros(FILTERS), np.zeros_like(self.embed)
        for half, top in enumerate(tops):
            part = back[:, half * FILTERS:(half + 1) * FILTERS]
            chosen = np.take_along_axis(inputs, top[:, :, None], axis=1)  # rows, filters, REACH * WIDTH
            d_kernel += np.einsum("nf,nfd->df", part, chosen)
            d_bias += part.sum(axis=0)
            ids = np.take_along_axis(patches, top[:, :, None], axis=1)
            flow = (part[:, :, None] * self.kernel.T[None]).reshape(*part.shape, REACH, WIDTH)
            np.add.at(d_embed, ids.ravel(), (flow * (ids > 0)[..., None]).reshape(-1, WIDTH))
        return [d_embed, d_kernel, d_bias, hidden.T @ error, error.sum()]


def generated_findings(rng: np.random.Generator, n: int, words: list[str] | None = None) -> tuple[list[tuple[bytes, int, int]], list[int]]:
    """Labelled findings: (text, start, end) and whether it is a secret; keys of many makes against names, paths, numbers.

    Half of them, of either label, lie between *words* of a corpus, if there are any, so that surroundings alone tell nothing.
    """
    def pick(chars: str, low: int, high: int) -> str:
        return "".join(rng.choice(list(chars), int(rng.integers(low, high))))

    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    names = ["password", "passwd", "pwd", "passphrase", "secret", "client_secret", "token", "auth_token", "access_token", "api_key", "apikey", "credential", "private_key", "bearer"]
    plain = ["path", "file", "version", "url", "name", "id", "module", "import", "see", "class", "commit", "date", "at", "from", "host"]

    def word() -> str:
        return pick(lower, 2, 9)

    def short_secret() -> tuple[str, str]:
        kind = int(rng.integers(5))
        value = [lambda: pick(lower + digits, 6, 16), lambda: pick(upper + lower + digits, 6, 16), lambda: word() + word()[:4] + pick(digits, 2, 5),
                 lambda: pick(digits, 6, 24), lambda: word() + word() + word()][kind]()
        signs = ["=", ": ", " = ", '="', ': "', "='"] + [" ", " is "] * (kind < 2)
        return str(rng.choice(names)) + str(rng.choice(signs)), value

    def short_harmless() -> tuple[str, str]:
        kind = int(rng.integers(5))
        long = [w for w in (words or [])[:2000] if w.isascii() and len(w) >= LED_TOKEN]
        plainly = str(rng.choice(long)) if long and rng.random() < 0.5 else word() + word()[:3]
        value = [lambda: plainly, lambda: plainly, lambda: plainly, lambda: pick(digits, 4, 5) + "." + pick(digits, 2, 4), lambda: word() + "-" + word()][kind]()
        if kind == 0:
            return str(rng.choice(names)) + " ", value
        if kind == 1:
            return word() + str(rng.choice([' "', " '", ": ", ':\n"'])), value
        return str(rng.choice(plain)) + str(rng.choice(["=", ": ", " = ", '="', ': "'])), value

    def secret() -> tuple[str, str]:
        if rng.random() < 0.3:
            return short_secret()
        value = [lambda: pick(upper + lower + digits, 20, 64), lambda: pick(digits + "abcdef", 24, 65), lambda: "AKIA" + pick(upper + digits, 16, 17),
                 lambda: pick(upper + lower + digits + "+/", 24, 80) + "=", lambda: f"{word()[:3]}_{pick(upper + lower + digits, 20, 41)}",
                 lambda: ".".join(pick(upper + lower + digits + "_-", 16, 40) for _ in range(3))][int(rng.integers(6))]()
        return str(rng.choice(names)) + str(rng.choice(["=", ": ", " = ", '="', " "])) if rng.random() < 0.7 else word() + " ", value

    def harmless() -> tuple[str, str]:
        if rng.random() < 0.3:
            return short_harmless()
        if rng.random() < 0.1:
            return f"{word()}.{pick(digits, 1, 4)}@", f"{word()}{pick(digits, 1, 3)}.{word()}{word()}.{rng.choice(['com', 'org', 'net', 'de'])}"
        value = [lambda: "/".join(word() for _ in range(int(rng.integers(3, 7)))) + pick(digits, 1, 4), lambda: ".".join(word() for _ in range(int(rng.integers(3, 6)))) + pick(digits, 1, 3),
                 lambda: "-".join([word(), word(), pick(digits, 1, 5), word()]) + ".txt", lambda: f"{pick(digits, 4, 5)}-{pick(digits, 2, 3)}-{pick(digits, 2, 3)}T{pick(digits, 6, 7)}.{pick(digits, 3, 7)}",
                 lambda: "_".join(word() for _ in range(int(rng.integers(3, 6)))) + pick(digits, 1, 3), lambda: "".join(word().capitalize() for _ in range(4)) + pick(digits, 1, 3),
                 lambda: "=" * int(rng.integers(32, 60)), lambda: "".join([word()] * int(rng.integers(8, 12)))][int(rng.integers(8))]()
        return str(rng.choice(plain)) + str(rng.choice(["=", ": ", " ", " = "])) if rng.random() < 0.5 else word() + " ", value

    def around(k: int, real: bool) -> str:
        return " ".join(words[int(rng.integers(len(words)))] if real else word() for _ in range(k))

    found, labels = [], []
    while len(found) < n:
        label = int(rng.integers(2))
        lead, value = secret() if label else harmless()
        real = bool(words) and rng.random() < 0.5
        before = around(4, real) + " " + lead
        start = len(before.encode())
        body = (before + value + str(rng.choice(['"', " ", ".", "\n"])) + around(2, real)).encode()
        spotted = zip(*(x.tolist() for x in candidate_spans(np.frombuffer(body, np.uint8), np.array([0, len(body)]))))
        for a, b in [(a, b) for a, b in spotted if a < start + len(value) and start < b][:1]:
            found.append((body, a, b))
            labels.append(label)
    return found, labels


def _labelled(body: bytes) -> Iterator[list[np.ndarray]]:
    """Views of each candidate of a text that a fixed pattern finds. The others have no label: they may well be secrets."""
    base = base_findings(body)
    if not base:
        return
    starts, reach = [s for _, s, _ in base], np.maximum.accumulate([e for _, _, e in base])
    for a, b in zip(*(x.tolist() for x in candidate_spans(np.frombuffer(body, np.uint8), np.array([0, len(body)])))):
        i = int(np.searchsorted(starts, b))  # base findings that start before the candidate's end
        if i and reach[i - 1] > a:
            yield list(windows(body, a, b))


def _examples(texts: list[str]) -> list[list[np.ndarray]]:
    """The labelled candidates of texts."""
    return [views for text in texts for views in _labelled(text.encode())]


def _words(text: str) -> list[str]:
    """Words that may surround a generated finding."""
    return [w for w in text.split() if w.isalpha() and len(w) < 20]


def _packed(views: list[np.ndarray]) -> tuple[bytes, bool, list[bytes]]:
    """A finding's key, whether it is left out of the descent (a quarter, by key: copies go together), and its views as bytes."""
    rows = [view.astype(np.uint8).tobytes() for view in views]
    key = hashlib.sha256(b"".join(rows)).digest()[:16]
    return key, key[0] % 4 == 3, rows


def _unpacked(views: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(views), np.uint8).reshape(-1, _SIZE)


_PARTS = ("embed", "kernel", "kernel_bias", "out", "out_bias")


class Course:
    """A network, the moments of its descent (Adam), and the views that each epoch learns from: label, source (0: generated,
    1: texts) and the order of those that are not left out."""

    def __init__(self, net: Network, x: np.ndarray, y: np.ndarray, source: np.ndarray, order: np.ndarray):
        self.net, self.x, self.y, self.source, self.order, self.step = net, x, y, source, order, 0.0
        self.moment = {name: [np.zeros_like(getattr(net, name)), np.zeros_like(getattr(net, name))] for name in _PARTS}

    def state(self) -> np.ndarray:
        """All that an epoch changes, as one vector of fixed length."""
        return np.concatenate([np.ravel(p) for name in _PARTS for p in (getattr(self.net, name), *self.moment[name])] + [[self.step]])

    def take(self, state: np.ndarray) -> None:
        at = 0
        for name in _PARTS:
            shape, parts = np.shape(getattr(self.net, name)), []
            for _ in range(3):
                size = math.prod(shape)
                parts.append(state[at:at + size].reshape(shape)[()])
                at += size
            setattr(self.net, name, parts[0])
            self.moment[name] = parts[1:]
        self.step = float(state[at])

    def epoch(self, own: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """The state after an epoch over the course's views and *own* ones of texts' findings, strewn among them at random.

        Both labels weigh alike, and both sources of secrets.
        """
        x, n = np.concatenate([self.x, own]), len(own)
        y, source = np.r_[self.y, np.ones(n, int)], np.r_[self.source, np.ones(n, int)]
        more = n * len(self.y) / len(self.order) - n  # left out of the shard's views
        weight = np.ones(len(y))
        for s, label, share in ((0, 0, 2), (0, 1, 4), (1, 1, 4)):
            same = (source == s) & (y == label)
            weight[same] = (len(y) + more) / (share * max(1, same.sum() + s * more))
        weight = np.minimum(weight, 20.0)
        places = np.sort(rng.integers(0, len(self.order) + 1, n))
        used = np.insert(self.order, places, len(self.y) + rng.permutation(n))
        for low in range(0, len(used), BATCH):
            rows, self.step = used[low:low + BATCH], self.step + 1
            for name, g in zip(_PARTS, self.net.gradients(x[rows], y[rows], weight[rows])):
                m = self.moment[name]
                m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
                change = RATE * (m[0] / (1 - 0.9**self.step)) / (np.sqrt(m[1] / (1 - 0.999**self.step)) + 1e-8)
                setattr(self.net, name, getattr(self.net, name) - change)
        return self.state()


def _reached(logits: np.ndarray, count: np.ndarray) -> float:
    """The highest of *logits* that RECALL of the findings reach, of which *count* have each."""
    order = np.argsort(logits)
    upto = np.cumsum(count[order])
    return float(logits[order][np.searchsorted(upto, np.floor((upto[-1] - 1) * (1 - RECALL)), "right")])


def _learn(words: list[str], examples: list[list[np.ndarray]], epoch: Callable[[Course, int], np.ndarray],
           judge: Callable[[Network], tuple[np.ndarray, np.ndarray]], seed: int, generated: int) -> Network:
    """Trains on generated labelled findings, on *examples* of secrets, and on findings that only *epoch* and *judge* see.

    *epoch* gives the state after one more epoch; *judge* the logits of its findings that are left out of the descent, and how
    many have each. These and a quarter of the others calibrate the probability and set the threshold: the highest one that
    keeps RECALL of the secrets of either source, however many the texts have. A finding has the highest of its views'
    logits, as in a scan.
    """
    rng = np.random.default_rng(seed)
    found, marks = generated_findings(rng, generated, words)
    items = [(list(windows(*f)), y, 0) for f, y in zip(found, marks)] + [(views, 1, 1) for views in examples]
    items = [items[i] for i in rng.permutation(len(items))]
    sizes = np.array([len(views) for views, _, _ in items])
    x = np.array([view for views, _, _ in items for view in views], np.uint8)
    y, source = (np.repeat([item[k] for item in items], sizes) for k in (1, 2))
    held = np.arange(len(items)) % 4 == 3
    check = np.repeat(held, sizes)
    course = Course(Network.fresh(rng), x, y, source, np.flatnonzero(~check))
    for number in range(EPOCHS):
        rng.shuffle(course.order)
        course.take(epoch(course, number))
    net = course.net
    own, count = judge(net)
    first = np.cumsum(sizes[held]) - sizes[held]
    logits = np.r_[np.maximum.reduceat(net.logits(x[check]), first), own]
    secret, source = (np.r_[v[check][first], np.ones(len(own), int)] for v in (y, source))
    count = np.r_[np.ones(len(first)), count]
    net.slope, net.offset = platt(logits, secret, count)
    kept = [(secret == 1) & (source == s) for s in (0, 1)]
    net.threshold = float(net.probability(np.array(min(_reached(logits[k], count[k]) for k in kept if k.any()))))
    return net


def fit(texts: list[str], seed: int = 5, generated: int = GENERATED) -> Network:
    """A network that has learned from texts at hand, in this process; :func:`train` is for a table."""
    none, words = np.zeros((0, _SIZE), np.uint8), [w for text in texts for w in _words(text)]
    return _learn(words, _examples(texts), lambda course, number: course.epoch(none, np.random.default_rng()),
                  lambda net: (np.zeros(0), np.zeros(0)), seed, generated)


def _noted(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """What learning takes from the texts, in one pass: a row for each view of each finding of the fixed patterns, in whole
    texts, and rows of words with a draw each, a hash of id, text and place. Of a partition's words the WORDS least draws are
    kept, among which are those of the WORDS least of all."""
    schema = pa.schema([("finding", pa.binary()), ("part", pa.int32()), ("held", pa.bool_()), ("view", pa.binary()),
                        ("draw", pa.int64()), ("word", pa.string())])

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws, drawn = np.zeros(0, np.uint64), np.zeros(0, object)
        for batch in batches:
            texts, seeds = filled(batch.column("text"), ""), batch.column("seed").to_numpy().view(np.uint64)
            for low, high in chunks(texts):
                data, offsets = flat(texts.slice(low, high - low))
                raw = data.tobytes()
                found, words, counts = [], [], []
                for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
                    body = raw[a:b]
                    for views in _labelled(body):
                        key, held, packed = _packed(views)
                        found += [(key, i, held, view) for i, view in enumerate(packed)]
                    some = _words(body.decode("utf-8", "replace"))
                    words += some
                    counts.append(len(some))
                if found:
                    yield rows(**dict(zip(schema.names, zip(*found))))
                before = np.cumsum(counts) - counts
                draw = mix(np.repeat(mix(seeds[low:high]) - before.astype(np.uint64), counts) + np.arange(len(words), dtype=np.uint64)) >> np.uint64(1)
                few = np.flatnonzero(draw < draws[-1]) if len(draws) == WORDS else np.arange(len(draw))
                drawn = np.r_[drawn, np.array([words[i] for i in few], object)]
                draws, least = np.unique(np.r_[draws, draw[few]], return_index=True)
                draws, drawn = draws[:WORDS], drawn[least[:WORDS]]
        yield rows(draw=draws.astype(np.int64), word=drawn)

    text = F.col(f"`{text_column}`").cast("string")
    return docs.select(F.xxhash64(F.col(f"`{id_column}`"), text).alias("seed"), text.alias("text")).mapInArrow(
        released(run), "finding binary, part int, held boolean, view binary, draw long, word string")


def _drawn(noted: DataFrame) -> list[str]:
    """The words of the WORDS least draws, by draw. Counts of steps tell how far these reach, so no others are fetched."""
    words = noted.filter("word is not null").groupBy("draw").agg(F.min("word").alias("word"))
    words = words.withColumn("step", F.floor(F.log2(F.col("draw").cast("double") + 1) * 64))
    reach, seen = 0, 0
    for r in words.groupBy("step").count().orderBy("step").collect():
        if seen < WORDS:
            reach, seen = r["step"], seen + r["count"]
    return [r.word for r in words.filter(F.col("step") <= reach).orderBy("draw").limit(WORDS).collect()]


def _dealt(noted: DataFrame, shards: int) -> DataFrame:
    """Views of findings dealt to *shards* by hash, with their copies, which are dealt out one by one; and a row without a view
    for each shard, so that none is missing. A shard is a partition. Any run and any partitioning of the texts deal alike."""
    views = noted.filter("view is not null").groupBy("finding", "part", "held", "view").count()
    spread = views.withColumn("k", F.explode(F.expr(f"sequence(0L, least(count, {shards}L) - 1)")))
    dealt = spread.selectExpr(f"pmod(pmod(xxhash64(finding, part), {shards}L) + k, {shards}L) as shard", "finding", "part", "held", "view",
                              f"count div {shards}L + cast(k < count % {shards}L as bigint) as copies")
    empty = noted.sparkSession.range(shards).selectExpr("id as shard", "cast(null as binary) as finding", "0 as part", "false as held",
                                                        "cast(null as binary) as view", "0L as copies")
    return dealt.unionAll(empty).repartitionById(shards, F.col("shard").cast("int"))


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 5, generated: int = GENERATED) -> Network:
    """A network that has learned from the findings of the fixed patterns in all whole texts, and from generated findings.

    Each epoch, each shard of SHARD views goes on from the same network, over its own views and the generated findings, in a
    task; the next epoch starts from the average. Left-out findings of all texts set the threshold, by their counted logits.
    The driver holds networks, counts and the WORDS drawn, whose size is fixed; any word of any text is as likely drawn.
    Null and empty texts have nothing to learn from. Any run gives the same network, up to rounding.
    """
    noted = materialize(_noted(docs, id_column, text_column))
    words = _drawn(noted)
    dealt = materialize(_dealt(noted, max(1, -(-noted.filter("view is not null").count() // SHARD))))
    context = docs.sparkSession.sparkContext

    def epoch(course: Course, number: int) -> np.ndarray:
        shared = context.broadcast(course)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batches = list(batches)
            if not batches:
                return
            table = pa.Table.from_batches(batches).sort_by([("shard", "ascending"), ("finding", "ascending"), ("part", "ascending")])
            shard = table["shard"].to_numpy()
            for k in np.unique(shard).tolist():
                low, high = np.searchsorted(shard, [k, k + 1]).tolist()
                mine = table.slice(low, high - low)
                mine = mine.filter(mine["view"].is_valid())
                own = _unpacked(mine["view"].to_pylist()).repeat(mine["copies"].to_numpy(), axis=0)
                state = copy.deepcopy(shared.value).epoch(own, np.random.default_rng([seed, number, k]))  # a worker keeps what is broadcast
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(state)), pa.int32()), pa.array(state)], names=["place", "value"])

        states = dealt.filter("not held").mapInArrow(run, "place int, value double")
        total = states.groupBy("place").agg(F.sum((F.col("value") * FIXED).cast("decimal(38,0)")).alias("total"), F.count("*").alias("n"))
        mean = [int(r.total) / FIXED / r.n for r in sorted(total.collect(), key=lambda r: r.place)]
        shared.unpersist()
        return np.array(mean)

    def judge(net: Network) -> tuple[np.ndarray, np.ndarray]:
        shared = context.broadcast(net)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                logits = shared.value.logits(_unpacked(batch.column("view").to_pylist()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("finding", "part", "copies")), pa.array(logits)],
                                                 names=["finding", "part", "copies", "logit"])

        views = dealt.filter("held and view is not null").mapInArrow(run, "finding binary, part int, copies long, logit double")
        whole = views.groupBy("finding", "part").agg(F.max("logit").alias("logit"), F.sum("copies").alias("copies"))
        whole = whole.groupBy("finding").agg(F.max("logit").alias("logit"), F.max("copies").alias("copies"))
        step = F.floor(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), "logit")) * GRID)
        counted = whole.groupBy(step.alias("step")).agg(F.sum("copies").alias("n")).orderBy("step").collect()
        shared.unpersist()
        return np.array([r.step / GRID for r in counted]), np.array([r.n for r in counted], float)

    return _learn(words, [], epoch, judge, seed, generated)


def findings(body: bytes, candidates: list[tuple[int, int]], scores: list[float], threshold: float) -> list[tuple[str, int, int, float]]:
    """Base findings, and candidates that score enough and overlap none of them; by start, then kind."""
    base = base_findings(body)
    out, i = [(k, a, b, 1.0) for k, a, b in base], 0
    reach = np.maximum.accumulate([e for _, _, e in base]) if base else np.zeros(0)
    starts = [s for _, s, _ in base]
    for (a, b), score in zip(candidates, scores):
        if score < threshold:
            continue
        i = int(np.searchsorted(starts, b))  # base findings that start before the candidate's end
        if not i or reach[i - 1] <= a:
            out.append((ADDED, a, b, score))
    order = (*BASE, ADDED)
    return sorted(out, key=lambda x: (x[1], order.index(x[0])))


def scan(docs: DataFrame, network: Network, text_column: str = "text", into: str = "secrets") -> DataFrame:
    """The columns of *docs* but the text, and *into*: array of (kind, start, end, text, score), by start, then kind.

    Positions count code points, end exclusive. Base findings always stay, with score 1; the network judges every candidate
    of the whole text and adds those that no base finding overlaps, as kind "model". Null and empty texts have none;
    repeated rows stay; a column named *into* is replaced. Only the network goes to the tasks, which has a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("score", pa.float64())]))

    def run(texts: pa.Array) -> dict:
        net = shared.value
        data, offsets = flat(texts)
        starts, ends = candidate_spans(data, offsets)
        row, out, raw = np.searchsorted(offsets, starts, "right") - 1, [], data.tobytes()
        views, owner = [], []
        for i, (a, b, r) in enumerate(zip(starts.tolist(), ends.tolist(), row.tolist())):
            low, high = max(int(offsets[r]), a - BEFORE), min(int(offsets[r + 1]), b + AFTER)
            for view in windows(raw[low:high], a - low, b - low):
                views.append(view)
                owner.append(i)
        scores = np.zeros(len(starts))
        if views:
            np.maximum.at(scores, owner, net.probability(net.logits(np.array(views))))
        first = np.searchsorted(row, np.arange(len(texts) + 1))
        for r in range(len(texts)):
            base, stop = int(offsets[r]), int(offsets[r + 1])
            body, mine = raw[base:stop], slice(first[r], first[r + 1])
            found = findings(body, list(zip((starts[mine] - base).tolist(), (ends[mine] - base).tolist())), scores[mine].tolist(), net.threshold)
            if found and not body.isascii():
                points = np.append(0, np.cumsum((data[base:stop] & 0xC0) != 0x80))
            else:
                points = None
            out.append([{"kind": k, "start": a if points is None else int(points[a]), "end": b if points is None else int(points[b]),
                         "text": body[a:b].decode("utf-8", "replace"), "score": s} for k, a, b, s in found])
        return {into: pa.array(out, kind)}

    return map_texts(docs.drop(into), run, f"`{into}` array<struct<kind:string,start:bigint,end:bigint,text:string,score:double>>", text_column)
