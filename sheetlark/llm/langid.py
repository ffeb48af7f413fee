"""Language ID of mixed-language text: script candidates, word scores, Viterbi spans.

* Training counts hashed byte trigrams of lower-cased words per language, on at most about
  ``docs_per_language`` different labelled texts of each language (the documented bound; texts
  are taken by their hash, so the sample is the same on every run; copies come with their text). It also learns which
  scripts each language writes.
* A word's script (Unicode ranges) narrows the languages it may belong to; its score in each
  is the summed log-probability of its trigrams.
* Viterbi over the words of a whole text, with a fixed penalty for switching, labels every
  word; runs of equal labels are the spans.

A text that is null or has no letter is ``und`` with score 0 and no spans. A script that no
language was seen in leaves all languages open. An empty or unlabelled training table makes
every text ``und``, and an empty table of texts gives no rows. Very long texts are labelled whole, slice by slice of a batch
(one text is at least a slice). Repeated rows repeat their result, with a null id too; ties go to the language first in
alphabetical order; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, batch_of, slices, text_buffer, word_spans

#: Unicode ranges of the scripts told apart.
SCRIPT_RANGES = (
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("ethiopic", 0x1200, 0x137F),
    ("latin", 0x1E00, 0x1EFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)
SCRIPTS = ("none", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES), "other")
BUCKET_BITS = 18
SMOOTHING = 0.5
LABEL = np.int16
SLICE = 1 << 20  # some sixty bytes are held for each byte of a slice
SWITCH_PENALTY = 12.0
BARRED = -60.0  # a word in a script that the language does not write
VITERBI_SCORES = 6_000_000  # words times languages held at once


@lru_cache(maxsize=1)
def _script_tables() -> tuple[np.ndarray, np.ndarray]:
    """Script by ASCII byte, and by the first two bytes of longer UTF-8 sequences."""
    pairs = np.zeros(65536, np.uint8)
    ascii_ = np.zeros(256, np.uint8)
    other = SCRIPTS.index("other")
    for cp in range(0x10000):
        if 0xD800 <= cp < 0xE000 or not unicodedata.category(chr(cp)).startswith("L"):
            continue
        script = next((SCRIPTS.index(name) for name, lo, hi in SCRIPT_RANGES if lo <= cp <= hi), other)
        raw = chr(cp).encode()
        if len(raw) == 1:
            ascii_[cp] = script
        elif not pairs[key := raw[0] << 8 | raw[1]] or script != other:
            pairs[key] = script
    for lead in range(0xF0, 0xF5):
        pairs[lead << 8 : (lead << 8) + 256] = other
    return ascii_, pairs


def script_of_bytes(data: np.ndarray) -> np.ndarray:
    """The script of the letter that starts at each byte, 0 for none."""
    ascii_, pairs = _script_tables()
    out = ascii_[data]
    wide = np.flatnonzero(data[:-1] >= 0xC2) if len(data) else np.zeros(0, np.int64)
    out[wide] = pairs[(data[wide].astype(np.int64) << 8) | data[wide + 1]]
    return out


def _buckets(data: np.ndarray) -> np.ndarray:
    """Hash bucket of the byte trigram around each position; separators read as one space."""
    folded = np.arange(256, dtype=np.uint32)
    folded[SEPARATORS] = 32
    folded[65:91] += 32
    x = folded[data]
    left, right = np.full(len(x), 32, np.uint32), np.full(len(x), 32, np.uint32)
    left[1:], right[:-1] = x[:-1], x[1:]
    return (((left << 16) | (x << 8) | right) * np.uint32(2654435769)) >> np.uint32(32 - BUCKET_BITS)


@dataclass(frozen=True)
class Model:
    """Log-probabilities by language and bucket, and the scripts each language writes."""

    languages: tuple[str, ...]
    scores: np.ndarray
    allowed: np.ndarray
    prior: int


def fit(df: DataFrame, *, text: str = "text", lang: str = "lang", docs_per_language: int = 2000) -> Model:
    """Learn from the rows of ``df`` with text and label; what reaches the driver is bounded by languages x buckets."""
    labelled = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    found = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("text")).alias("texts")).collect()
    counts = {r.lang: r.n for r in found}
    languages = tuple(sorted(counts))
    if len(languages) > np.iinfo(LABEL).max:
        raise ValueError(f"{len(languages)} languages are more than labels can tell apart")
    if not languages:
        return Model((), np.zeros((0, 1 << BUCKET_BITS), np.float32), np.zeros((len(SCRIPTS), 0), bool), -1)
    share = F.create_map(*[F.lit(x) for r in found for x in (r.lang, min(1.0, docs_per_language / max(1, r.texts)))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    place = {k: i for i, k in enumerate(languages)}
    schema = pa.schema([("l", pa.int32()), ("k", pa.int32()), ("n", pa.int64())])

    def tally(batches):
        total = np.zeros((len(languages), (1 << BUCKET_BITS) + len(SCRIPTS)), np.int64)
        for batch in batches:
            for part in slices(batch, most=SLICE):
                data, off = text_buffer(part.column("text"))
                label = np.array([place[x] for x in part.column("lang").to_pylist()])
                owner = np.repeat(label, np.diff(off))
                inside = ~SEPARATORS[data]
                for i in np.unique(label):
                    mine = owner == i
                    total[i, : 1 << BUCKET_BITS] += np.bincount(_buckets(data)[mine & inside], minlength=1 << BUCKET_BITS)
                    total[i, 1 << BUCKET_BITS :] += np.bincount(script_of_bytes(data)[mine], minlength=len(SCRIPTS))
        l, k = np.nonzero(total)
        yield batch_of(schema, l=l.astype(np.int32), k=k.astype(np.int32), n=total[l, k])

    rows = labelled.where(draw < share[F.col("lang")]).mapInArrow(tally, "l int, k int, n long").groupBy("l", "k").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((len(languages), (1 << BUCKET_BITS) + len(SCRIPTS)))
    total[rows.l.to_numpy(np.int64), rows.k.to_numpy(np.int64)] = rows.n
    grams, scripts = total[:, : 1 << BUCKET_BITS], total[:, 1 << BUCKET_BITS :]
    scores = np.log((grams + SMOOTHING) / (grams.sum(1, keepdims=True) + SMOOTHING * (1 << BUCKET_BITS))).astype(np.float32)
    letters = scripts[:, 1:].sum(1, keepdims=True)
    allowed = (scripts >= 0.01 * np.maximum(letters, 1)).T
    allowed[~allowed.any(1)] = True
    allowed[0] = True
    return Model(languages, scores, allowed, int(np.argmax([counts[k] for k in languages])))


def word_scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, row offsets, words x languages scores, and letters per word."""
    starts, ends, rows = word_spans(data, offsets)
    if not len(starts):
        return starts, ends, rows, np.zeros((0, len(model.languages)), np.float32), np.zeros(0, np.int64)
    buckets = _buckets(data)
    script = script_of_bytes(data)
    letter = np.concatenate([[0], np.cumsum(script > 0)])
    letters = letter[ends] - letter[starts]
    out = np.empty((len(starts), len(model.languages)), np.float32)
    sums = np.zeros(len(data) + 1)
    for i in range(len(model.languages)):
        np.cumsum(model.scores[i][buckets], out=sums[1:])
        out[:, i] = sums[ends] - sums[starts]
    out[letters == 0] = 0  # carries no language
    most, kind = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    for s in np.unique(script[script > 0]):
        c = np.concatenate([[0], np.cumsum(script == s)])
        c = c[ends] - c[starts]
        kind[c > most] = s
        most = np.maximum(most, c)
    barred = ~model.allowed[kind]
    if barred.any():
        out += np.where(barred, np.float32(BARRED), np.float32(0))
    return starts, ends, rows, out, letters


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best language of every word; rows of ``counts`` words each advance in lockstep."""
    first = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    counts, first = counts[order], first[order]
    steps = int(counts[0]) if len(counts) else 0
    active = np.searchsorted(-counts, -np.arange(steps), "left")  # rows with more words than the step
    labels = np.zeros(len(scores), LABEL)
    come = np.zeros(scores.shape, LABEL)
    here = np.arange(scores.shape[1], dtype=LABEL)
    v = np.zeros((len(counts), scores.shape[1]), np.float64)
    for t in range(steps):
        n = active[t]
        at = first[:n] + t
        if t:
            best = v[:n].argmax(1)
            jump = v[np.arange(n), best] - penalty
            stay = v[:n] >= jump[:, None]
            come[at] = np.where(stay, here, best[:, None].astype(LABEL))
            v[:n] = np.where(stay, v[:n], jump[:, None])
        v[:n] += scores[at]
    now = v.argmax(1).astype(LABEL)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        labels[at] = now[:n]
        now[:n] = come[at, now[:n]]
        if t == 0:
            break
    return labels


def _flush(model: Model, parts: list) -> tuple[list, list, list, list]:
    """Labels of the gathered slices: predictions, scores and spans of their rows."""
    names = model.languages
    scores = np.concatenate([p[4] for p in parts])
    counts = np.concatenate([np.diff(p[3]) for p in parts])
    labels = viterbi(scores, counts) if len(names) and len(scores) else np.zeros(len(scores), LABEL)
    starts, ends = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
    letters = np.concatenate([p[5] for p in parts])
    rows = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(counts)), counts)
    covered = np.zeros((len(counts), max(1, len(names))), np.int64)
    np.add.at(covered, (owner, labels), letters)
    fine = np.concatenate([p[6] for p in parts])
    some = covered.sum(1)
    winner = covered.argmax(1)
    known = fine & bool(names)
    pred = [names[w if s else model.prior] if k else "und" for w, s, k in zip(winner.tolist(), some.tolist(), known.tolist(), strict=True)]
    share = np.where(known & (some > 0), covered.max(1) / np.maximum(some, 1), 0.0)
    new = np.ones(len(labels), bool)
    if len(labels):
        new[1:] = (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])
        new &= known[owner]
    head = np.flatnonzero(new)
    change = np.flatnonzero(np.concatenate([(labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1]), [True]])) if len(labels) else head
    tail = change[np.searchsorted(change, head)]
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(head, rows), pa.int32()),
        pa.StructArray.from_arrays([pa.array([names[x] for x in labels[head].tolist()], pa.string()), pa.array(starts[head], pa.int64()), pa.array(ends[tail], pa.int64())], ["lang", "start", "end"]),
    )
    return pred, share, spans


def predict(df: DataFrame, model: Model, *, id: str = "doc_id", text: str = "text", carry: tuple[Column, ...] = (), spans: bool = True, keep_text: bool = False) -> DataFrame:
    """``(id, *carry[, text], lang_pred, score[, spans])`` of every whole text.

    ``score`` is the share of the text's letters in words of the predicted language;
    spans are byte ranges of the UTF-8 text.
    """
    small = df.select(F.col(id), *carry, F.col(text).alias("text"))
    kept = [c for c in small.columns if c != "text" or keep_text]
    shared = df.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        m = shared.value

        def out(held):
            pred, share, found = _flush(m, [h[:7] for h in held])
            arrays = [pa.concat_arrays([h[7].column(c) for h in held]) for c in kept]
            arrays += [pa.array(pred, pa.string()), pa.array(share, pa.float64())] + [found.cast(span_type)] * spans
            return pa.RecordBatch.from_arrays(arrays, [*kept, "lang_pred", "score"] + ["spans"] * spans)

        held, words = [], 0
        for batch in batches:
            for part in slices(batch, most=SLICE):
                data, off = text_buffer(part.column("text"))
                starts, ends, rows, scores, letters = word_scores(m, data, off)
                has = np.zeros(part.num_rows, bool)
                upper = (data | 32) - 97 < 26
                plain = np.concatenate([[0], np.cumsum(upper & (data < 128))])
                has = plain[off[1:]] > plain[off[:-1]]
                for r in np.flatnonzero(~has & (np.diff(off) > 0)):
                    has[r] = any(map(str.isalpha, data[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace")))
                base = np.repeat(off[:-1], np.diff(rows))
                held.append((None, starts - base, ends - base, rows, scores, letters, has, part))
                words += len(starts)
                if words * max(1, len(m.languages)) >= VITERBI_SCORES:
                    yield out(held)
                    held, words = [], 0
        if held:
            yield out(held)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in small.schema if f.name in kept]
    return small.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"] + ["spans array<struct<lang:string,start:bigint,end:bigint>>"] * spans))
