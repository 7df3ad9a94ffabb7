"""Byte-level BPE: merges compiled into a lazily determinised transducer, and a streaming decoder."""

from __future__ import annotations

import base64
import re
import sys
from collections.abc import Iterable, Iterator
from pathlib import Path
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from spectrafold.llm.batches import chunks, filled, map_texts, released

#: Pairs, merge histories and pieces that a worker remembers, some 60 MB; beyond, pairs and histories are forgotten, and
#: pieces but those seen lately.
MAX_PAIRS, MAX_HISTORIES, MAX_WORDS = 200_000, 10_000, 50_000
#: Places of a piece after which what is settled is emitted.
WINDOW = 4096
#: Pieces up to this length are remembered; texts beyond this length are cut piece by piece; ids of a chunk of decoding.
LONG_WORD, LONG_TEXT, DECODE_CHUNK = 64, 1 << 20, 1 << 14


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file (a line: base64 of the bytes, id)."""
    lines = Path(path).read_bytes().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}


class Transducer:
    """Encodes byte strings as merging by rank does, reading each byte once.

    A token sequence is what merging yields exactly if each two neighbours stay apart when merged alone. So exactly one
    token can be last in the encoding of what has been read up to a place, and it is the one token ending there that may
    follow the last token of the place where it starts. The machine's states are the sets of tree nodes (beginnings of
    tokens) that end at a place; they are worked out when a text first leads to them and stored, with the tokens that end
    there. A token is settled, and emitted, once no open beginning reaches back before its end: at most the longest
    token's length later.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes = ranks, [b""] * (max(ranks.values()) + 1)
        self.children: dict[int, int] = {}  # node * 256 + byte -> node; the root is 0
        self.token, self.depth = [-1], [0]
        for token, rank in ranks.items():
            self.bytes[rank], node = token, 0
            for byte in token:
                edge = node << 8 | byte
                node = self.children.get(edge, 0)
                if not node:
                    node = self.children[edge] = len(self.token)
                    self.token.append(-1)
                    self.depth.append(self.depth[edge >> 8] + 1)
            self.token[node] = rank
        self.pairs: dict[int, bool] = {}
        self.histories: dict[int, tuple] = {}
        # a state: nodes open at a place, longest first; ends: (token, length) of those that are tokens; steps: byte -> state
        self.states: list[tuple[int, ...]] = [()]
        self.ids: dict[tuple[int, ...], int] = {(): 0}
        self.steps: list[dict[int, int]] = [{}]
        self.ends: list[tuple[tuple[int, int], ...]] = [()]

    def _step(self, state: int, byte: int) -> int:
        """The next state; stored, so each step is worked out once. There are no more states than nodes."""
        after = tuple(n for n in (self.children.get(node << 8 | byte) for node in (*self.states[state], 0)) if n)
        found = self.ids.get(after)
        if found is None:
            found = self.ids[after] = len(self.states)
            self.states.append(after)
            self.steps.append({})
            self.ends.append(tuple((self.token[n], self.depth[n]) for n in after if self.token[n] >= 0 and self._history(self.token[n])))
        self.steps[state][byte] = found
        return found

    def _history(self, token: int) -> tuple | None:
        """How merging builds a token alone: (ranks of the merges, first part and last part before, between and after
        them); None if merging ends in other tokens."""
        if token in self.histories:
            return self.histories[token]
        ranks, word = self.ranks, self.bytes[token]
        parts, order, firsts, lasts = [word[i:i + 1] for i in range(len(word))], [], [word[:1]], [word[-1:]]
        while len(parts) > 1:
            rank, at = min((ranks.get(a + b, sys.maxsize), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == sys.maxsize:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            order.append(rank)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        if len(self.histories) >= MAX_HISTORIES:
            self.histories.clear()
        found = self.histories[token] = (order, firsts, lasts) if len(parts) == 1 else None
        return found

    def _apart(self, a: int, b: int) -> bool:
        """Whether tokens *a* and *b* stay apart when merged: the merges of both run side by side, lowest rank first and
        leftmost first among equals, until one across the border comes first or none is left."""
        ranks, none = self.ranks, sys.maxsize
        (left, _, lasts), (right, firsts, _) = self._history(a), self._history(b)
        i = j = 0
        while True:
            across = ranks.get(lasts[i] + firsts[j], none)
            x, y = left[i] if i < len(left) else none, right[j] if j < len(right) else none
            if across < x and across <= y and across != none:
                return False
            if x == none and y == none:
                return True
            if x <= y:
                i += 1
            else:
                j += 1

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one pre-token."""
        steps, ends, pairs, size = self.steps, self.ends, self.pairs, len(self.bytes)
        state, last, length, out, settled = 0, [-1], [0], [], 0
        for at, byte in enumerate(word, 1):
            following = steps[state].get(byte)
            state = self._step(state, byte) if following is None else following
            for token, n in ends[state]:
                before = last[at - n - settled]
                if before < 0:
                    if at == n:
                        break
                    continue
                key = before * size + token
                apart = pairs.get(key)
                if apart is None:
                    if len(pairs) >= MAX_PAIRS:
                        pairs.clear()
                    apart = pairs[key] = self._apart(before, token)
                if apart:
                    break
            last.append(token)
            length.append(n)
            if len(last) > WINDOW:
                cut = self._settled(length, self.depth[self.states[state][0]] if self.states[state] else 0)
                out += self._back(last, length, cut)
                last, length, settled = last[cut:], length[cut:], settled + cut
        return out + self._back(last, length, len(last) - 1)

    @staticmethod
    def _back(last: list[int], length: list[int], at: int) -> list[int]:
        """The tokens up to place *at*, from the last one back."""
        out = []
        while at > 0:
            out.append(last[at])
            at -= length[at]
        return out[::-1]

    @staticmethod
    def _settled(length: list[int], reach: int) -> int:
        """The farthest place that is a border of tokens whatever follows: on the way back from every place at which an
        open beginning, of at most *reach* bytes, may start."""
        open_, at = {*range(max(0, len(length) - 1 - reach), len(length))}, len(length) - 1
        while len(open_) > 1:
            open_.discard(at)
            open_.add(at - length[at])
            at = max(open_)
        return at


def plain_pattern(pattern: str) -> re.Pattern | None:
    """*pattern* for texts of the first 256 characters alone, with letters, numbers and white space as explicit ranges, for
    a faster matcher; None for patterns with other properties."""
    if re.search(r"\\[pP](?!\{[LN]\})", pattern):
        return None
    few, ranges = "".join(map(chr, range(256))), {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        ranges[name] = "".join(rf"\x{m.start():02x}-\x{m.end() - 1:02x}" for m in regex.finditer(f"{name}+", few))
    out, inside, at = "", False, 0
    while at < len(pattern):
        name = next((n for n in ranges if pattern.startswith(n, at)), None)
        if name:
            out += ranges[name] if inside else f"[{ranges[name]}]"
        elif pattern.startswith(r"\S", at) and not inside:
            name = r"\S"
            out += f"[^{ranges[chr(92) + 's']}]"
        else:
            name = pattern[at:at + 2] if pattern[at] == "\\" else pattern[at]
            inside = (inside or name == "[") and name != "]"
            out += name
        at += len(name)
    return re.compile(out)


class Encoder:
    """Texts to token ids (little-endian unsigned 32-bit integers): the pattern cuts a text, the transducer encodes each
    piece; frequent pieces are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine, self.words, self.older = Transducer(ranks), {}, {}
        self.cut, self.plain = regex.compile(pattern), plain_pattern(pattern)

    def _pieces(self, text: str) -> Iterable[str]:
        cut = self.cut
        if self.plain:
            try:
                text.encode("latin-1")
                cut = self.plain
            except UnicodeEncodeError:
                pass
        return cut.findall(text) if len(text) <= LONG_TEXT else (m[0] for m in cut.finditer(text))

    def __call__(self, text: str) -> bytes:
        words, out = self.words, []
        for piece in self._pieces(text):
            ids = words.get(piece)
            if ids is None:
                ids = self.older.get(piece)
                if ids is None:
                    ids = self.machine.encode(piece.encode())
                    ids = pack(f"<{len(ids)}I", *ids)
                if len(piece) <= LONG_WORD:
                    if len(words) >= MAX_WORDS:
                        self.older, words = words, {}
                        self.words = words
                    words[piece] = ids
            out.append(ids)
        return b"".join(out)


# UTF-8 as a state machine. States: 0 between characters; 1, 2, 3 continuation bytes to come; 4 to 7 the second byte of a
# character is restricted (after E0, ED, F0, F4); 8 broken.
BROKEN = 8


def _utf8_table() -> list[list[int]]:
    table = np.full((9, 256), BROKEN)
    table[0, :0x80], table[0, 0xC2:0xE0], table[0, 0xE0:0xF0], table[0, 0xF0:0xF5] = 0, 1, 2, 3
    table[0, [0xE0, 0xED, 0xF0, 0xF4]] = 4, 5, 6, 7
    for state, low, high, to in ((1, 0x80, 0xC0, 0), (2, 0x80, 0xC0, 1), (3, 0x80, 0xC0, 2), (4, 0xA0, 0xC0, 1),
                                 (5, 0x80, 0xA0, 1), (6, 0x90, 0xC0, 2), (7, 0x80, 0x90, 2)):
        table[state, low:high] = to
    return table.tolist()


class Decoder:
    """Token ids to text, chunk by chunk: whole characters are handed on, one that a token border cuts waits.

    Tokens that lead the machine from between characters back there are known beforehand, so a chunk of such tokens needs
    no walk. What isn't UTF-8 becomes U+FFFD, as a decoder of the whole would replace it.
    """

    def __init__(self, tokens: list[bytes]):
        self.table = _utf8_table()
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.closed = np.array([(w := self._walk(t, 0))[0] == 0 and w[1] == len(t) and w[2] for t in tokens])

    def _walk(self, body: bytes, state: int) -> tuple[int, int, bool]:
        """(state after *body*, bytes up to the last end of a character, whether all is UTF-8)."""
        table, whole, clean = self.table, 0, True
        for i, byte in enumerate(body):
            state = table[state][byte]
            if state == BROKEN:
                clean, state, whole = False, table[0][byte], i
                if state == BROKEN:
                    state, whole = 0, i + 1
            if state == 0:
                whole = i + 1
        return state, whole, clean

    def _bytes(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        shift = self.first[ids] - (np.cumsum(size) - size)
        return self.flat[np.arange(int(size.sum())) + np.repeat(shift, size)].tobytes()

    def stream(self, chunks: Iterable[np.ndarray]) -> Iterator[str]:
        """The text of each chunk of ids as far as it is complete, and at last what is left."""
        waiting = b""
        for ids in chunks:
            body = waiting + self._bytes(ids)
            whole = len(body) if not waiting and self.closed[ids].all() else self._walk(body, 0)[1]
            yield body[:whole].decode("utf-8", "replace")
            waiting = body[whole:]
        if waiting:
            yield waiting.decode("utf-8", "replace")

    def __call__(self, ids: np.ndarray) -> str:
        return "".join(self.stream(ids[low:low + DECODE_CHUNK] for low in range(0, len(ids), DECODE_CHUNK)))


class Vocabulary:
    """Ranks and pattern as they are broadcast; a worker builds its machines once, on first use."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.built = ranks, pattern, {}

    def encoder(self) -> Encoder:
        if "encoder" not in self.built:
            self.built["encoder"] = Encoder(self.ranks, self.pattern)
        return self.built["encoder"]

    def decoder(self) -> Decoder:
        if "decoder" not in self.built:
            tokens = [b""] * (max(self.ranks.values()) + 1)
            for token, rank in self.ranks.items():
                tokens[rank] = token
            self.built["decoder"] = Decoder(tokens)
        return self.built["decoder"]


def encode(docs: DataFrame, vocabulary: str, pattern: str, text_column: str = "text", into: str = "ids") -> DataFrame:
    """The columns of *docs* but the text, with *into* (binary: ids as little-endian unsigned 32-bit integers) and n_tokens.

    Each match of *pattern* is encoded alone by the ranks in the file *vocabulary*, which the driver reads and broadcasts
    (its size doesn't depend on the data). Null and empty texts have no tokens; repeated rows stay; columns named like the
    new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(vocabulary), pattern))

    def run(texts: pa.Array) -> dict:
        encoder = shared.value.encoder()
        found = [encoder(t) for t in texts.to_pylist()]
        return {into: pa.array(found, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in found], pa.int64())}

    return map_texts(docs.drop(into, "n_tokens"), run, f"`{into}` binary, n_tokens long", text_column)


def decode(encoded: DataFrame, vocabulary: str, ids_column: str = "ids", into: str = "decoded") -> DataFrame:
    """The columns of *encoded* and *into*, the text that the ids stand for (null: empty)."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(vocabulary), ""))
    encoded = encoded.drop(into)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            decoder = shared.value.decoder()
            for low, high in chunks(filled(batch.column(ids_column), b"")):
                part = batch.slice(low, high - low)
                texts = [decoder(np.frombuffer(x or b"", "<u4")) for x in part.column(ids_column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, into])

    return encoded.mapInArrow(released(run), f"{fields}, `{into}` string")
