"""Exact removal of repeated byte strings: interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the
table. Strings are judged on the input and never cross rows.

Suffixes are first dealt to buckets so that no bucket needs the corpus:

1. Every ``length``-byte window picks the least hash among its ``gram``-byte substrings, its
   anchor (winnowing). Equal windows pick equal anchors at equal offsets, and each window
   start belongs to one anchor occurrence, so a segment (the windows of one anchor
   occurrence) can only repeat in segments with the same anchor hash.
2. Anchor hashes that occur once are dropped after a partial count; equal segments collapse
   to one with a multiplicity. A segment that occurs more than once repeats in whole.
3. Segments that share an anchor but differ are cut from their texts (one co-located join by
   row key, on a bucketed table) and concatenated by anchor into texts of about ``CHUNK``
   bytes. Each gets a suffix order and its Burrows-Wheeler transform; a breadth-first
   backward extension then derives the common prefixes in increasing value. It stops at
   ``length``: boundaries still open there are exactly the pairs that share a repeat.
4. The transform is built in memory, so a bucket of more than ``most`` different segments is
   dealt again by a longer key (:func:`_dealt_again`): windows are split by how far they begin
   before their anchor, and all windows of one such range share a longer core around it, whose
   hash is the new bucket. Equal windows begin equally far before equal anchors and so stay
   together. Equal pieces collapse, lone ones go; the ranges narrow until every bucket fits,
   at the last to one window, of which a bucket holds one kind.
5. Covered ranges are gathered per row (bounded by the row itself) and applied.

Joins by anchor send keys that hold over a ``HOT``-th of the rows, of which there are fewer than
``HOT``, to all tasks and leave their rows in place; only the rest is shuffled.

Null texts are empty; very long ones are judged whole; texts shorter than ``length`` keep everything; repeated rows count as different places, so their strings go in all of them. Rows
are told apart by an internal key, so null or repeated ids do no harm. An empty table gives no
rows; extra columns are carried through untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, batch_of, bucketed, buckets_for, byte_hashes, materialize, mix, prefix_hashes, signed, slices, span_hashes, text_buffer

LENGTH, GRAM, MOST, CHUNK = 200, 64, 6000, 1 << 20
PIECE = 2 << 20
HOT = 1000
NARROWER = 4
_POS = 26

# ---------------------------------------------------------------- anchors


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor occurrences of concatenated rows: row, hash, first window, window count, anchor offset, segment hash."""
    out = []
    windows = length - gram + 1
    n = len(data)
    for c in range(0, max(0, n - length + 1), PIECE):
        part = data[c : c + PIECE + length - 1]
        sums = prefix_hashes(part, BYTE_VALUES)
        grams = len(part) - gram + 1
        at = np.arange(grams)
        h = span_hashes(sums, at, at + gram)
        key = (h & ~np.uint64((1 << _POS) - 1)) | at.astype(np.uint64)
        pad = np.full(-(-grams // windows) * windows, np.iinfo(np.uint64).max, np.uint64)
        pad[:grams] = key
        blocks = pad.reshape(-1, windows)
        left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        starts = len(part) - length + 1
        least = np.minimum(right[:starts], left[windows - 1 : windows - 1 + starts])
        pick = (least & np.uint64((1 << _POS) - 1)).astype(np.int64)
        p = np.arange(starts)
        row = np.searchsorted(offsets, p + c, "right") - 1
        inside = p + c + length <= offsets[row + 1]
        new = inside.copy()
        new[1:] &= (pick[1:] != pick[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
        first = np.flatnonzero(new)
        if not len(first):
            continue
        stop = np.empty(starts, bool)
        stop[-1] = inside[-1]
        stop[:-1] = inside[:-1] & (new[1:] | ~inside[1:])
        last = np.flatnonzero(stop)
        seg = byte_hashes(part, first, last + length) + mix((pick[first] - first).astype(np.uint64))
        out.append((row[first], h[pick[first]], first + c - offsets[row[first]], last - first + 1, pick[first] - first, seg))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z, z, z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchor_rows(rows: DataFrame, length: int, gram: int) -> DataFrame:
    schema = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("uid", pa.int64()), ("lo", pa.int64()), ("w", pa.int32())])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                row, h, lo, w, _, g = anchors(*text_buffer(part.column("text")), length, gram)
                yield batch_of(schema, h=signed(h), g=signed(g), uid=part.column("uid").to_numpy()[row], lo=lo, w=w.astype(np.int32))

    return rows.select("uid", "text").mapInArrow(run, "h long, g long, uid long, lo long, w int")


# ---------------------------------------------------------------- the transform


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols at least (prefix doubling)."""
    n = len(text)
    key = np.zeros(n, np.int64)
    wide = np.concatenate([text.astype(np.int64), np.zeros(7, np.int64)])
    for j in range(7):
        key = (key << 9) | wide[j : j + n]
    order = np.argsort(key, kind="stable")
    known = 7
    while True:
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if known >= depth or new.all():
            return order
        after = np.zeros(n, np.int64)
        if known < n:
            after[: n - known] = rank[known:]
        key = (rank << 32) | after
        # only suffixes that still tie change places
        tied = np.flatnonzero(~new | np.append(~new[1:], False))
        order[tied] = order[tied][np.argsort(key[order[tied]], kind="stable")]
        known *= 2


def open_boundaries(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Where neighbours in suffix order share ``length`` symbols or more.

    Breadth-first backward extension: level l holds disjoint intervals of suffixes that
    share l symbols. Extending them to the left by the transform's symbols gives intervals
    of l + 1 symbols; where one ends at a boundary not met before, the common prefix there
    is l. Boundaries not met below ``length`` stay open.
    """
    n = len(text)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    back = place[order - 1]  # the transform's step to the left, for every suffix in order
    head = text[order]  # head[back[i]] is the symbol of the transform at i
    open_ = np.ones(n + 1, bool)
    open_[[0, n]] = False
    rows, owner = np.arange(n), np.zeros(n, np.int64)
    for _ in range(length):
        if not len(rows) or not open_.any():
            break
        to = back[rows]
        sort = np.argsort(to, kind="stable")
        to, owner = to[sort], owner[sort]
        new = np.ones(len(to), bool)
        new[1:] = (to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1]) | (head[to[1:]] != head[to[:-1]])
        first = np.flatnonzero(new)
        end = to[np.append(first[1:], len(to)) - 1] + 1
        fresh = open_[end]
        open_[end] = False
        run = np.cumsum(new) - 1
        keep = fresh[run]
        rows, owner = to[keep], run[keep]
    return open_


def repeated_windows(segments: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and window start of every window that occurs twice or more among ``segments``."""
    lens = np.array([len(s) for s in segments], np.int64)
    text = np.zeros(int(lens.sum()) + len(segments) + 1, np.uint16)
    at = np.concatenate([[1], 1 + np.cumsum(lens + 1)])[:-1]
    for a, s in zip(at.tolist(), segments, strict=True):
        text[a : a + len(s)] = s
        text[a : a + len(s)] += 1
    order = suffix_order(text, length)
    open_ = open_boundaries(text, order, length)
    hit = order[open_[:-1] | open_[1:]]
    hit.sort()
    seg = np.searchsorted(at, hit, "right") - 1
    start = hit - at[seg]
    fine = (seg >= 0) & (start + length <= lens[seg])
    return seg[fine], start[fine]


def _runs(seg: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of adjacent window starts: segment, first, last."""
    if not len(seg):
        return seg, start, start
    new = np.ones(len(seg), bool)
    new[1:] = (seg[1:] != seg[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return seg[first], start[first], start[np.append(first[1:], len(seg)) - 1]


def _expand(cut: DataFrame, length: int) -> DataFrame:
    """Covered ranges ``(uid, lo, hi)`` of segments that occur once, found on the transforms of their anchors' texts."""
    schema = pa.schema([("uid", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

    def solve(held):
        seg, start = repeated_windows([x[0] for x in held], length)
        seg, first, last = _runs(seg, start)
        once = np.array([x[3] == 1 for x in held])[seg]
        seg, first, last = seg[once], first[once], last[once]
        uid, lo = np.array([x[1] for x in held], np.int64)[seg], np.array([x[2] for x in held], np.int64)[seg]
        return batch_of(schema, uid=uid, lo=lo + first, hi=lo + last + length)

    def run(batches):
        held, size, group, members = [], 0, None, []

        def flush():
            nonlocal size
            if len(members) > 1:  # an anchor with one segment left has nothing to meet
                held.extend(members)
                size += sum(len(x[0]) for x in members)
            members.clear()

        for batch in batches:
            data, off = text_buffer(batch.column("bytes"))
            for i, (h, uid, lo, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("h", "uid", "lo", "n")), strict=True)):
                if h != group:
                    flush()
                    group = h
                    if size >= CHUNK:
                        yield solve(held)
                        held, size = [], 0
                members.append((data[off[i] : off[i + 1]].copy(), uid, lo, n))
        flush()
        if held:
            yield solve(held)

    dealt = cut.select("h", "uid", "lo", "n", "bytes").repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "uid long, lo long, hi long")


# ---------------------------------------------------------------- large buckets


def _meet(rows: DataFrame, keys: DataFrame, on: list[str], count: str) -> DataFrame:
    """Written ``rows`` joined with distinct written ``keys``, of which ``count`` says how many rows have them."""
    most = rows.count() // HOT
    hot = F.broadcast(keys.where(F.col(count) > most))  # fewer than HOT keys
    rest = rows.join(F.broadcast(keys.where(F.col(count) > most).select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(keys.where(F.col(count) <= most), on))


def _with_offsets(pieces: DataFrame, length: int, gram: int) -> DataFrame:
    """Segments with the distance ``o`` from their first window to their anchor."""
    schema = pa.schema([("n", pa.int64()), ("uid", pa.int64()), ("lo", pa.int64()), ("o", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "bytes", PIECE // 2):
                row, _, _, _, o, _ = anchors(*text_buffer(part.column("bytes")), length, gram)
                part = part.take(pa.array(row))  # a segment has one anchor
                yield batch_of(schema, n=part.column("n"), uid=part.column("uid"), lo=part.column("lo"), o=o, bytes=part.column("bytes"))

    return pieces.select("n", "uid", "lo", "bytes").mapInArrow(run, "n long, uid long, lo long, o long, bytes binary")


def cores(data: np.ndarray, off: np.ndarray, o: np.ndarray, length: int, gram: int, width: int) -> tuple[np.ndarray, ...]:
    """Segments cut where the distance from a window to its anchor passes a multiple of ``width``.

    For each part: row, hash of the core that all windows in that range share, first window,
    windows, distance of the first window, hash of the part.
    """
    last = o - (np.diff(off) - length)  # distance of the last window
    cells = o // width - last // width + 1
    row = np.repeat(np.arange(len(o)), cells)
    cell = (o // width)[row] - (np.arange(len(row)) - np.repeat(np.cumsum(cells) - cells, cells))
    near, far = cell * width, np.minimum(cell * width + width - 1, length - gram)
    begin, end = np.minimum(o[row], far), np.maximum(last[row], near)
    first, w = o[row] - begin, begin - end + 1
    anchor = off[:-1][row] + o[row]
    key = byte_hashes(data, anchor - near, anchor + length - far) + mix(cell.astype(np.uint64))
    start = off[:-1][row] + first
    return row, key, first, w, begin, byte_hashes(data, start, start + w + length - 1) + mix(begin.astype(np.uint64))


def _dealt_again(large: DataFrame, length: int, gram: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Ranges that repeat as whole parts, and the different parts of cores that hold two kinds or more, with their bytes."""
    schema = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("n", pa.int64()), ("uid", pa.int64()), ("piece", pa.int64()), ("at", pa.int32()), ("w", pa.int32()), ("o", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "bytes", PIECE // 2):
                row, h, at, w, o, g = cores(*text_buffer(part.column("bytes")), part.column("o").to_numpy(), length, gram, width)
                n, uid, lo = (part.column(c).to_numpy()[row] for c in ("n", "uid", "lo"))
                yield batch_of(schema, h=signed(h), g=signed(g), n=n, uid=uid, piece=lo, at=at.astype(np.int32), w=w.astype(np.int32), o=o)

    dealt = materialize(large.mapInArrow(run, "h long, g long, n long, uid long, piece long, at int, w int, o long"), "dealt")
    kinds = materialize(dealt.groupBy("h", "g").agg(F.sum("n").alias("k"), F.count_if(F.col("n") == 1).alias("parts"), F.min(F.struct("uid", "piece", "at", "w", "o")).alias("m")).select("h", "g", "k", "parts", "m.*"), "kinds")
    lo = F.col("piece") + F.col("at")
    whole = _meet(dealt.where("n = 1"), kinds.where("k > 1 AND parts > 0").select("h", "g", "parts"), ["h", "g"], "parts").select("uid", lo.alias("lo"), (lo + F.col("w") + length - 1).alias("hi"))
    mixed = materialize(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "mixed")
    wanted = _meet(kinds, mixed, ["h"], "kinds").select("h", F.col("k").alias("n"), "uid", "piece", "at", "w", "o", "kinds")
    cut = F.expr(f"substring(bytes, at + 1, w + {length - 1})")
    parts = large.select("uid", F.col("lo").alias("piece"), "bytes").join(wanted, ["uid", "piece"])
    return whole, materialize(parts.select("h", "n", "uid", lo.alias("lo"), "o", "kinds", cut.alias("bytes")), "parts")


# ---------------------------------------------------------------- the operator


def _keyed(df: DataFrame) -> DataFrame:
    """The table with a row key, bucketed by it, so that joins by key leave the texts in place."""
    return bucketed(df.withColumn("uid", F.monotonically_increasing_id()), buckets_for(df, "text"), "uid", "keyed")


def covered_ranges(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """Ranges ``(uid, lo, hi)`` of ``keyed`` texts whose bytes repeat; ranges may overlap."""
    found = materialize(_anchor_rows(keyed, length, gram), "anchors")
    often = materialize(found.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "often")
    shared = materialize(_meet(found, often, ["h"], "k").drop("k"), "shared")
    segments = materialize(shared.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("uid", "lo", "w")).alias("m")).select("h", "g", "n", "m.*"), "segments")
    whole = _meet(shared, segments.where("n > 1").select("h", "g", "n"), ["h", "g"], "n").select("uid", "lo", (F.col("lo") + F.col("w") + length - 1).alias("hi"))
    mixed = materialize(segments.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "mixed")
    wanted = _meet(segments, mixed, ["h"], "kinds").groupBy("uid").agg(F.collect_list(F.struct("h", "n", "lo", "w", "kinds")).alias("want"))
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("uid", pa.int64()), ("lo", pa.int64()), ("kinds", pa.int64()), ("bytes", pa.binary())])

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                data, off = text_buffer(part.column("text"))
                want = part.column("want")
                per = np.diff(np.asarray(want.offsets))
                flat = want.flatten()
                owner = np.repeat(np.arange(part.num_rows), per)
                h, n, lo, w, kinds = (flat.field(k).to_numpy() for k in ("h", "n", "lo", "w", "kinds"))
                raw = data.tobytes()
                begin = off[owner] + lo
                pieces = [raw[a:b] for a, b in zip(begin.tolist(), (begin + w + length - 1).tolist(), strict=True)]
                yield batch_of(schema, h=h, n=n, uid=part.column("uid").to_numpy()[owner], lo=lo, kinds=kinds, bytes=pieces)

    pieces = materialize(keyed.select("uid", "text").join(wanted, "uid").mapInArrow(cut, "h long, n long, uid long, lo long, kinds long, bytes binary"), "pieces")
    fit, large = pieces.where(F.col("kinds") <= most).drop("kinds"), pieces.where(F.col("kinds") > most)
    width = length - gram + 1
    while not large.isEmpty():
        width = -(-width // NARROWER)
        again, pieces = _dealt_again(large if "o" in large.columns else _with_offsets(large, length, gram), length, gram, width)
        whole = whole.unionByName(again)
        fits = (F.col("kinds") <= most) | F.lit(width == 1)  # buckets of one window hold one kind, unless hashes are equal
        fit, large = fit.unionByName(pieces.where(fits).select(*fit.columns)), pieces.where(~fits)
    return whole.unionByName(_expand(fit, length))


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _applied(df: DataFrame, text: str, length: int, carry: list[str], digest: bool, **options) -> DataFrame:
    # carried columns get names of ours on the way, so that none can clash
    held = [f"_c{i}" for i in range(len(carry))]
    keyed = _keyed(df.select(*(F.col(f"`{c}`").alias(h) for c, h in zip(carry, held, strict=True)), F.col(f"`{text}`").alias("text")))
    ranges = covered_ranges(keyed, length, **options).groupBy("uid").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    extra = "_n_bytes long, _n_removed long, _n_spans long, " + ("_sha string" if digest else "_kept string, _spans array<struct<lo:bigint,hi:bigint>>")
    joined = keyed.join(ranges, "uid", "left").select(*held, "text", "ranges")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name in held]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                data, off = text_buffer(part.column("text"))
                raw = data.tobytes()
                size, gone, spans, kept, where = [], [], [], [], []
                for a, b, want in zip(off[:-1].tolist(), off[1:].tolist(), part.column("ranges").to_pylist(), strict=True):
                    merged = _merge([(x["lo"], x["hi"]) for x in want]) if want else []
                    edges = [0, *(y for x in merged for y in x), b - a]
                    rest = b"".join(raw[a + i : a + j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                    size.append(b - a)
                    gone.append(b - a - len(rest))
                    spans.append(len(merged))
                    where.append([{"lo": i, "hi": j} for i, j in merged])
                    kept.append(hashlib.sha256(rest).hexdigest() if digest else rest.decode("utf-8", "ignore"))
                arrays = [part.column(c) for c in held] + [pa.array(x, pa.int64()) for x in (size, gone, spans)] + [pa.array(kept, pa.string())]
                names = [*held, "_n_bytes", "_n_removed", "_n_spans", "_sha" if digest else "_kept"]
                if not digest:
                    arrays.append(pa.array(where, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))))
                    names.append("_spans")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return joined.mapInArrow(run, ", ".join([*fields, extra]))


def remove_repeats(df: DataFrame, *, text: str = "text", length: int = LENGTH, spans: str | None = "_spans", **options) -> DataFrame:
    """``df`` with the repeated bytes taken out of ``text``, and the removed byte ranges in a column named ``spans``, if any.

    Where a removed range splits a UTF-8 character, the rest of that character goes too.
    """
    carry = [c for c in df.columns if c != text]
    done = _applied(df, text, length, carry, False, **options)
    held = {c: f"_c{i}" for i, c in enumerate(carry)}
    return done.select(*(F.col(held.get(c, "_kept")).alias(c) for c in df.columns), *([F.col("_spans").alias(spans)] if spans else []))


def repeat_digests(df: DataFrame, *, id: str = "doc_id", text: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row."""
    done = _applied(df, text, length, [id], True, **options)
    return done.select(F.col("_c0").alias(id), F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.col("_sha").alias("kept_sha256"))
