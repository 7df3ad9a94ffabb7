"""Suffix-array dedup: removes every byte of a text that an earlier equal string of LENGTH bytes covers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.llm import suffixes
from spectrafold.llm.batches import BYTE_VALUES, chunks, filled, flat, mix, powers, released, rows_of, window_min

#: Bytes of a repeated string, and of the grams of which a window of that length has one as its anchor.
LENGTH, GRAM = 100, 32
#: Bytes of the strings that are sorted together, at least; more only where strings of one anchor have more.
SHARD_BYTES = 1 << 21
#: Rows of one anchor that a task holds; beyond, each window of its strings is dealt out by itself.
HOT_ROWS = 20_000
#: Such windows that are looked at together: only the earliest of equal ones among them is dealt out.
HOT_WINDOWS = 1 << 18

_OWNER = ("ord", "key")
_COPIES, _STRINGS = 0, 1


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM (a power of two) bytes from each place on, by doubling."""
    out, size, base = BYTE_VALUES[data], 1, powers(GRAM + 1)
    while size < GRAM:
        out = out[:len(out) - size] * base[size] + out[size:]
        size *= 2
    return mix(out)


def anchored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, place, start, end) of each anchor: the first gram of least hash in some window of LENGTH bytes.

    start to end are the bytes of the windows that have this anchor; a window's content alone says which anchor it has and
    where, so equal windows meet at equal anchors. Windows lie within a row.
    """
    n, none = len(data), np.zeros(0, np.int64)
    if n < LENGTH:
        return np.zeros(0, np.uint64), none, none, none
    hashes = _gram_hashes(data)
    bits = np.uint64(max(1, int(len(hashes) - 1).bit_length()))
    least = window_min((hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64), LENGTH - GRAM + 1)
    owner = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    room = np.repeat(offsets[1:], np.diff(offsets))[:len(owner)] - np.arange(len(owner))
    window = np.flatnonzero(room >= LENGTH)
    if not len(window):
        return np.zeros(0, np.uint64), none, none, none
    own = owner[window]
    fresh = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (window[1:] != window[:-1] + 1)])
    last = np.r_[fresh[1:], len(own)] - 1
    place = own[fresh]
    return hashes[place], place, window[fresh], window[last] + LENGTH


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (sorted by row and start) with those that touch or overlap put together."""
    if not len(row):
        return row, start, end
    shift = row * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    first = np.flatnonzero(np.r_[True, (start + shift)[1:] > reach[:-1]])
    last = np.r_[first[1:], len(row)] - 1
    return row[first], start[first], reach[last] - shift[last]


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def _anchor_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, c, ord, key, place, start, end, kind) of texts: an anchor's strings, once in a batch, and ranges of copies.

    c is a hash of the string and of the anchor's place in it. Of equal strings in a batch the earliest stays; the others
    are copies of it, whatever comes from elsewhere.
    """
    for batch in batches:
        texts, found = filled(batch.column("text"), ""), []
        order, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in _OWNER)
        for low, high in chunks(texts):
            data, offsets = flat(texts.slice(low, high - low))
            hashes, place, start, end = anchored(data, offsets)
            raw = data.tobytes()
            content = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b], seed=p) for a, b, p in
                                   zip(start.tolist(), end.tolist(), (place - start).tolist())), np.uint64, len(start))
            row = rows_of(start, offsets)
            base = offsets[row]
            found.append((hashes, content, row + low, place - base, start - base, end - base))
        h, c, row, place, start, end = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 6
        by = np.argsort(c, kind="stable")
        again = np.r_[False, c[by][1:] == c[by][:-1]] if len(by) else np.zeros(0, bool)
        some = np.flatnonzero(again | np.r_[again[1:], False])
        picked = by[some]
        picked = picked[np.lexsort((start[picked], key[row[picked]], order[row[picked]], c[picked]))]
        lead = np.flatnonzero(np.r_[True, c[picked][1:] != c[picked][:-1]]) if len(picked) else np.zeros(0, np.int64)
        head = np.repeat(picked[lead], np.diff(np.r_[lead, len(picked)]))
        copy = (order[row[picked]] != order[row[head]]) | (key[row[picked]] != key[row[head]]) | (start[picked] != start[head])
        copies = np.sort(picked[copy])
        stays = np.ones(len(h), bool)
        stays[copies] = False
        m_row, m_start, m_end = merged(row[copies], start[copies], end[copies])
        k = len(m_row)
        yield _batch({
            "h": np.r_[h[stays], mix(np.arange(k, dtype=np.uint64) + key[m_row].view(np.uint64))].view(np.int64),
            "c": np.r_[c[stays], np.zeros(k, np.uint64)].view(np.int64),
            "ord": order[np.r_[row[stays], m_row]], "key": key[np.r_[row[stays], m_row]],
            "place": np.r_[place[stays], m_start].astype(np.int32), "start": np.r_[start[stays], m_start].astype(np.int32),
            "end": np.r_[end[stays], m_end].astype(np.int32),
            "kind": np.r_[np.full(int(stays.sum()), _STRINGS), np.full(k, _COPIES)].astype(np.int8)})


_ANCHOR_SCHEMA = "h long, c long, ord long, key long, place int, start int, end int, kind byte"


def _first_strings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by h, c, ord, key, start: the earliest of equal strings, where an anchor has different ones, and the
    ranges of all the other copies. Rows with an anchor of which there are over HOT_ROWS are marked as hot."""
    names = ("h", "c", "ord", "key", "place", "start", "end")
    held: dict[str, np.ndarray] = {}
    carried = None  # of a hot anchor whose rows go on: (h, c, ord, key, start) of its last string's first occurrence

    def out(x: dict[str, np.ndarray], hot: bool) -> pa.RecordBatch:
        nonlocal carried
        new_h = np.r_[True, x["h"][1:] != x["h"][:-1]]
        new_c = new_h | np.r_[True, x["c"][1:] != x["c"][:-1]]
        head = np.maximum.accumulate(np.where(new_c, np.arange(len(new_c)), 0))
        first = {n: x[n][head] for n in ("ord", "key", "start")}
        if carried is not None and carried[0] == x["h"][0] and carried[1] == x["c"][0]:
            block = head == 0
            new_c[0] = False
            for n, value in zip(("ord", "key", "start"), carried[2:]):
                first[n][block] = value
        copy = ~new_c & ((x["ord"] != first["ord"]) | (x["key"] != first["key"]) | (x["start"] != first["start"]))
        group = np.cumsum(new_h) - 1
        several = hot | (np.bincount(group, weights=new_c)[group] > 1)
        keep = copy | (new_c & several)
        carried = tuple(int(v) for v in (x["h"][-1], x["c"][-1], first["ord"][-1], first["key"][-1], first["start"][-1])) if hot else None
        return _batch({n: x[n][keep] for n in ("h", "ord", "key", "place", "start", "end")} | {
            "hot": np.full(int(keep.sum()), hot), "kind": np.where(copy, _COPIES, _STRINGS)[keep].astype(np.int8)})

    for batch in batches:
        kind = batch.column("kind").to_numpy()
        x = {n: batch.column(n).to_numpy() for n in names}
        done = kind == _COPIES
        if done.any():
            yield _batch({n: x[n][done] for n in ("h", "ord", "key", "place", "start", "end")} | {
                "hot": np.zeros(int(done.sum()), bool), "kind": np.full(int(done.sum()), _COPIES, np.int8)})
            x = {n: v[~done] for n, v in x.items()}
        if not len(x["h"]):
            continue
        x = {n: np.r_[held[n], v] for n, v in x.items()} if held else x
        cut = int(np.flatnonzero(np.r_[True, x["h"][1:] != x["h"][:-1]])[-1])
        if cut:
            whole = {n: v[:cut] for n, v in x.items()}
            goes_on = carried is not None and carried[0] == whole["h"][0]
            if goes_on:  # the end of a hot anchor
                until = int(np.searchsorted(whole["h"] != whole["h"][0], True))
                yield out({n: v[:until] for n, v in whole.items()}, True)
                whole = {n: v[until:] for n, v in whole.items()}
            carried = None
            if len(whole["h"]):
                yield out(whole, False)
        held = {n: v[cut:] for n, v in x.items()}
        if len(held["h"]) > HOT_ROWS:
            yield out(held, True)
            held = {}
    if held:
        yield out(held, carried is not None and carried[0] == held["h"][0])


_FIRST_SCHEMA = "h long, ord long, key long, place int, start int, end int, hot boolean, kind byte"
_STRING_SCHEMA = "h long, c long, ord long, key long, start int, end int, string binary"


def _later(h: np.ndarray, c: np.ndarray, order: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows sorted by all of these: which are the first with their hash (h, c), and which start later than it."""
    new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return new, (order != order[head]) | (key != key[head]) | (start != start[head])


def _hot_windows(digests: list[bytes], row: np.ndarray, start: np.ndarray, order: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """The earliest of equal windows, by their *digests* of 16 bytes, and the ranges of the later ones, put together."""
    h, c = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T
    by = np.lexsort((start, key[row], order[row], c, h))
    h, c, row, start = h[by], c[by], row[by], start[by]
    new, later = _later(h, c, order[row], key[row], start)
    picked = np.flatnonzero(later)
    picked = picked[np.lexsort((start[picked], row[picked]))]
    m_row, m_start, m_end = merged(row[picked], start[picked], start[picked] + LENGTH)
    k, n = len(m_row), int(new.sum())
    owner, low = np.r_[row[new], m_row], np.r_[start[new], m_start]
    return _batch({
        "h": np.r_[h[new], mix(np.arange(k, dtype=np.uint64) + key[m_row].view(np.uint64)).view(np.int64)],
        "c": pa.array(np.r_[c[new], np.zeros(k, np.int64)], mask=np.arange(n + k) >= n), "ord": order[owner], "key": key[owner],
        "start": low.astype(np.int32), "end": np.r_[start[new] + LENGTH, m_end].astype(np.int32), "string": pa.nulls(n + k, pa.binary())})


def _cut_strings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings themselves, from texts with their *spots*; the ranges of copies are put together and handed on.

    Of a hot anchor's strings, each window by itself: its hash (h, c) and place, once in HOT_WINDOWS of a batch."""
    for batch in batches:
        spots = batch.column("spots")
        have = np.flatnonzero(~np.asarray(spots.is_null()))
        out: dict[str, list] = {n: [] for n in ("h", "ord", "key", "start", "end", "string")}
        digests: list[bytes] = []
        hot: list[tuple[int, int, int]] = []  # row, first window, number of windows

        def add(h: int, row: int, start: int, end: int, string: bytes | None) -> None:
            for name, value in zip(out, (h, order[row], key[row], start, end, string)):
                out[name].append(value)

        def dealt() -> pa.RecordBatch:
            row, first, n = np.array(hot, np.int64).T
            start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - first, n)
            whole = _hot_windows(digests, np.repeat(row, n), start, *owners)
            digests.clear()
            hot.clear()
            return whole

        owners = [batch.column(c).to_numpy(zero_copy_only=False) for c in _OWNER]
        order, key = (x.tolist() for x in owners)
        texts = batch.column("text")
        for row in have.tolist():
            part = spots[row].values
            f = {n: part.field(n).to_numpy(zero_copy_only=False) for n in ("h", "place", "start", "end", "hot", "kind")}
            copies = np.flatnonzero(f["kind"] == _COPIES)
            copies = copies[np.argsort(f["start"][copies], kind="stable")]
            _, starts, ends = merged(np.zeros(len(copies), np.int64), f["start"][copies].astype(np.int64), f["end"][copies].astype(np.int64))
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                add(int(mix(np.array([key[row] % 2**64 ^ i], np.uint64)).view(np.int64)[0]), row, a, b, None)
            strings = np.flatnonzero(f["kind"] == _STRINGS)
            body = texts[row].as_py().encode() if len(strings) else b""
            for i in strings.tolist():
                a, b = int(f["start"][i]), int(f["end"][i])
                if not f["hot"][i]:
                    add(int(f["h"][i]), row, a, b, body[a:b])
                    continue
                digests += [xxhash.xxh3_128_digest(body[w:w + LENGTH]) for w in range(a, b - LENGTH + 1)]
                hot.append((row, a, b - LENGTH + 1 - a))
                if len(digests) >= HOT_WINDOWS:
                    yield dealt()
        if hot:
            yield dealt()
        cut = {n: pa.array(v, pa.binary() if n == "string" else pa.int32() if n in ("start", "end") else pa.int64()) for n, v in out.items()}
        yield _batch({"h": cut.pop("h"), "c": pa.nulls(len(out["h"]), pa.int64())} | cut)


def repeated_windows(strings: list[bytes], order: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, place in it) of each window of LENGTH bytes that an earlier equal one precedes, by a shard's suffix array.

    string i begins at byte start[i] of the text (order[i], key[i]); texts are in the order of these pairs.
    """
    text, starts = suffixes.join(strings)
    array = suffixes.suffix_array(text, LENGTH + 1)
    sizes = np.array([len(x) for x in strings], np.int64)
    windows = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(strings)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    places = starts[owner] + inside
    before, common = suffixes.permuted_prefixes(text, array, places, LENGTH)
    # in suffix order, a window whose common prefix with the one before is long enough goes on a group
    slot = np.full(len(text), -1, np.int64)
    slot[places] = np.arange(len(places))
    in_order = slot[array]
    in_order = in_order[in_order >= 0]
    goes_on = common[in_order] >= LENGTH
    first = np.flatnonzero(~goes_on)
    size = np.diff(np.r_[first, len(in_order)])
    _, rank = np.unique(np.stack([order, key]), axis=1, return_inverse=True)
    when = rank.ravel()[owner].astype(np.int64) << 32 | (start[owner] + inside)
    earliest = np.repeat(np.minimum.reduceat(when[in_order], first), size) if len(first) else when[:0]
    later = np.sort(in_order[when[in_order] > earliest])
    return owner[later], inside[later]


def _shard_ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges (ord, key, start, end) to remove, from rows sorted by h, c, ord, key, start: whole anchors are sorted in shards.

    Of equal windows of hot anchors all but the earliest go; they pass by without being held."""
    held: list[pa.RecordBatch] = []
    first = None  # the earliest of the last hot window's equals: (h, c, ord, key, start)

    def ranges(rows: pa.Table) -> pa.RecordBatch:
        order, key, start = (rows.column(n).to_numpy() for n in ("ord", "key", "start"))
        string, inside = repeated_windows(rows.column("string").to_pylist(), order, key, start)
        own, low, high = merged(string, inside, inside + LENGTH)
        return _batch({"ord": order[own], "key": key[own], "start": (start[own] + low).astype(np.int32), "end": (start[own] + high).astype(np.int32)})

    def ready(rows: pa.Table, final: bool) -> Iterator[pa.RecordBatch]:
        """Shards of whole anchors; the last anchor's rows stay in *held* unless it is *final*."""
        h = rows.column("h").to_numpy()
        cuts = np.r_[np.flatnonzero(np.r_[True, h[1:] != h[:-1]]), len(h)]
        sizes = np.cumsum(pc.binary_length(rows.column("string")).to_numpy())
        usable = cuts if final else cuts[:-1]
        low = 0
        while low < usable[-1]:
            base = sizes[low - 1] if low else 0
            high = usable[min(len(usable) - 1, np.searchsorted(sizes[np.maximum(usable - 1, 0)], base + SHARD_BYTES))]
            if not final and sizes[high - 1] - base < SHARD_BYTES:
                break
            high = max(high, usable[np.searchsorted(usable, low, "right")])
            yield ranges(rows.slice(low, high - low))
            low = int(high)
        held[:] = rows.slice(low).to_batches()

    waiting = 0
    for batch in batches:
        single = np.asarray(batch.column("c").is_valid())
        if single.any():
            windows = batch.filter(pa.array(single))
            x = [windows.column(n).to_numpy().astype(np.int64) for n in ("h", "c", *_OWNER, "start")]
            x = [np.r_[a, b] for a, b in zip(first, x)] if first is not None else x
            new, later = _later(*x)
            head = int(np.flatnonzero(new)[-1])
            first = [a[head:head + 1] for a in x]
            yield windows.filter(pa.array(later[-windows.num_rows:])).select(["ord", "key", "start", "end"])
            batch = batch.filter(pa.array(~single))
        whole = np.asarray(batch.column("string").is_null())
        if whole.any():
            yield batch.filter(pa.array(whole)).select(["ord", "key", "start", "end"])
            batch = batch.filter(pa.array(~whole))
        if batch.num_rows:
            held.append(batch)
            waiting += batch.column("string").nbytes
            if waiting >= SHARD_BYTES:
                yield from ready(pa.Table.from_batches(held), False)
                waiting = sum(b.column("string").nbytes for b in held) if held and sum(b.num_rows for b in held) > 1 else 0
    if held:
        yield from ready(pa.Table.from_batches(held), True)


def _keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their removed ranges."""
    for batch in batches:
        texts = filled(batch.column("text"), "")
        kept, size, gone, spans = [], [], [], []
        for text, ranges in zip(texts, batch.column("ranges")):
            body = text.as_py().encode()
            low = high = np.zeros(0, np.int64)
            if ranges.is_valid:
                a, b = (ranges.values.field(n).to_numpy().astype(np.int64) for n in ("start", "end"))
                by = np.argsort(a, kind="stable")
                _, low, high = merged(np.zeros(len(a), np.int64), a[by], b[by])
            pairs = list(zip(low.tolist(), high.tolist()))
            kept.append(b"".join(body[x:y] for x, y in zip([0, *high.tolist()], [*low.tolist(), len(body)])))
            size.append(len(body))
            gone.append(int((high - low).sum()))
            spans.append([{"start": x, "end": y} for x, y in pairs])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield _batch({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(gone, pa.int64()),
                      "removed": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed, kept): texts as UTF-8 bytes without what repeats.

    A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a row of a smaller id, or earlier in the
    same row. removed lists the maximal runs (byte positions, end exclusive), kept holds the other bytes. Strings don't go
    over rows and are judged on the input. Rows with a null id come last; rows with one id and different texts are in the
    order of a hash of the text; equal rows count as one and give equal results. Null and empty texts have no bytes.

    Each window of LENGTH bytes belongs to the gram of least hash in it, so that equal windows, wherever they are, get the
    same hash and are judged in the same place. An anchor's string (its windows' bytes) is dealt out by that hash; equal
    strings are counted out first, in their batch and then by hash, so copies are never gathered. The different strings of
    an anchor are put into shards; a shard's suffix array and permuted common prefixes find the equal windows. Of an
    anchor with very many rows each window is dealt out by its own hash, once in HOT_WINDOWS of them.
    """
    texts = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    texts = texts.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("ord"), F.xxhash64("text").alias("key"))
    anchors = texts.mapInArrow(released(_anchor_rows), _ANCHOR_SCHEMA)
    by_hash = anchors.repartition("h").sortWithinPartitions("h", "c", "ord", "key", "start")
    first = by_hash.mapInArrow(_first_strings, _FIRST_SCHEMA)
    spots = first.groupBy(*_OWNER).agg(F.collect_list(F.struct("h", "place", "start", "end", "hot", "kind")).alias("spots"))
    strings = texts.join(spots, list(_OWNER), "left").mapInArrow(released(_cut_strings), _STRING_SCHEMA)
    ranges = strings.repartition("h").sortWithinPartitions("h", "c", "ord", "key", "start").mapInArrow(_shard_ranges, "ord long, key long, start int, end int")
    listed = ranges.groupBy(*_OWNER).agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    kind = docs.schema[id_column].dataType.simpleString()
    return texts.join(listed, list(_OWNER), "left").mapInArrow(
        released(_keep), f"doc_id {kind}, n_bytes long, n_removed long, removed array<struct<start:bigint,end:bigint>>, kept binary")
