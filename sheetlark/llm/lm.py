"""Scores of a backoff n-gram model, run as a weighted automaton with failure arcs.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of whole texts with A-Z lower-cased, then one end.

* Unigrams and bigrams cover the whole corpus: every word is a context state, and every bigram
  seen ``least`` times or more is an arc, discounted by ``discount``. ``context_share`` narrows
  the contexts to words of at least that share of the training tokens; by default it is 0.
* Counting happens per chunk of documents first, so a frequent word or bigram is one entry per
  chunk in the shuffle. A chunk sends its sorted distinct keys in ranges of the hash, all
  ranges of one number meet, and each chunk gets the totals of just its own keys back in the
  same order (:func:`_exchange`). Of a key's chunks the first owns it; owners send what a
  context's arcs add up to for the backoff weights, the same way. Vocabulary, arcs and weights
  grow with the corpus and are never whole in one place.
* Each chunk compiles the automaton of its own words and bigrams. Any other word leaves a
  state by its failure arc, which carries the backoff weight, to the root, whose arcs are the
  smoothed unigrams. One left-to-right traversal carries the state over a text and adds up
  log-probabilities; texts of a chunk advance in lockstep. A text starts in the state of the
  end token.

The unigrams are (c + 0.1) / (N + 0.1 (V + 1)), and arcs with backoff sum to one in every
state. Null text is an empty one, whose only token is the end. Very
long texts are scored whole. Rows with a null id are scored
and never learned from. Repeated rows repeat their result; an empty table gives no rows; with
nothing to learn from every score is 0. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, MOST_BUCKETS, batch_of, bucketed, constants, materialize, mix, partitions, signed, slices, text_buffer, text_bytes, word_hashes

ADD = 0.1
CHUNK_BYTES = 8 << 20
CHUNKS_A_PART = 4
CONTEXT_SHARE, LEAST, DISCOUNT = 0.0, 2, 0.5
END = int(signed(constants(71, 1))[0])


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, each row's words then the end, and the rows' offsets."""
    words, rows = word_hashes(*text_buffer(column))
    ends = rows[1:] + np.arange(len(rows) - 1)
    out = np.empty(len(words) + len(ends), np.int64)
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end] = END
    out[~is_end] = signed(words)
    return out, rows + np.arange(len(rows))


@dataclass(frozen=True)
class Automaton:
    """States: 0 is the root, 1 + i the context of ``words[i]``; arcs are sorted by state and word."""

    words: np.ndarray  # hashes, ascending
    arc_key: np.ndarray  # state * len(words) + word
    arc_score: np.ndarray
    arc_to: np.ndarray
    fail_to: np.ndarray
    fail_score: np.ndarray
    n_tokens: int
    n_words: int
    start: int

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + ADD) / (self.n_tokens + ADD * (self.n_words + 1)))

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each token among the context words, -1 for others."""
        if not len(self.words):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def traverse(self, symbols: np.ndarray, root_score: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Log-probability of each row: the rows' tokens pass through the automaton in lockstep."""
        counts = np.diff(rows)
        order = np.argsort(-counts, kind="stable")
        first, counts = rows[:-1][order], counts[order]
        total, state = np.zeros(len(counts)), np.full(len(counts), self.start, np.int64)
        steps = int(counts[0]) if len(counts) else 0
        active = np.searchsorted(-counts, -np.arange(steps), "left")
        width, arcs = max(1, len(self.words)), len(self.arc_key)
        for t in range(steps):
            n = active[t]
            at = first[:n] + t
            sym, s = symbols[at], state[:n]
            score, to = np.zeros(n), np.where(sym >= 0, sym + 1, 0)
            live = np.flatnonzero(s > 0)
            while len(live):
                here, now = s[live], sym[live]
                if arcs:
                    key = here * width + now
                    k = np.minimum(np.searchsorted(self.arc_key, key), arcs - 1)
                    hit = (now >= 0) & (self.arc_key[k] == key)
                    score[live[hit]] += self.arc_score[k[hit]]
                    to[live[hit]] = self.arc_to[k[hit]]
                    s[live[hit]] = -1
                    live = live[~hit]
                score[live] += self.fail_score[s[live]]
                s[live] = self.fail_to[s[live]]
                live = live[s[live] > 0]
            total[:n] += score + np.where(s == 0, root_score[at], 0.0)
            state[:n] = to
        out = np.empty(len(counts))
        out[order] = total
        return out


def automaton(words: np.ndarray, counts: np.ndarray, pairs: np.ndarray, seen: np.ndarray, n_tokens: int, n_words: int, discount: float = DISCOUNT, sums: np.ndarray | None = None) -> Automaton:
    """Compile counted bigrams (``pairs`` is context * len(words) + word, ascending) with discounts and backoff weights.

    ``sums`` holds what the arcs of each context add up to (arcs, times seen, counts of their
    words) where ``pairs`` are not all arcs of the model.
    """
    k = max(1, len(words))
    u, v = pairs // k, pairs % k
    p = (seen - discount) / np.maximum(counts[u], 1) if len(pairs) else np.zeros(0)
    if sums is None:
        sums = np.array([np.bincount(u, w, minlength=len(words)) for w in (np.ones(len(u)), seen, counts[v] if len(v) else np.zeros(0))])
    held, below = (sums[1] - discount * sums[0]) / np.maximum(counts, 1), (sums[2] + ADD * sums[0]) / (n_tokens + ADD * (n_words + 1))
    back = np.log10(np.maximum(1 - held, 1e-12) / np.maximum(1 - below, 1e-12)) if len(words) else np.zeros(0)
    end = np.flatnonzero(words == END)
    return Automaton(words, (u + 1) * k + v, np.log10(p), v + 1, np.zeros(len(words) + 1, np.int64), np.concatenate([[0.0], back]), n_tokens, n_words, int(end[0]) + 1 if len(end) else 0)


def _chunked(df: DataFrame, text: str, keep: list[Column]) -> tuple[DataFrame, int]:
    """The rows with a chunk number, bucketed so that groups and co-groups by chunk leave the texts in place.

    Also the number of chunks. There are no more than MOST_BUCKETS buckets, so a bucket of a
    large corpus holds several chunks. Rows are dealt one by one, whatever their ids.
    """
    spark = df.sparkSession
    n = max(partitions(spark), text_bytes(df, text) // CHUNK_BYTES + 1)
    rows = df.select(*keep, F.col(text).alias("text")).withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int"))
    return bucketed(rows, min(MOST_BUCKETS, n), "chunk", "chunked"), n


# ---------------------------------------------------------------- totals by key, back to the chunks

WORDS, BIGRAMS, CONTEXTS = range(3)
_SENT = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("chunk", pa.int32()), ("size", pa.int64()), ("keys", pa.binary()), ("numbers", pa.binary())])
_REPLY = pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("size", pa.int64()), ("numbers", pa.binary()), ("n_keys", pa.int64()), ("total", pa.int64())])
SENT = "kind int, part int, chunk int, size long, keys binary, numbers binary"
REPLY = "chunk int, kind int, part int, size long, numbers binary, n_keys long, total long"


def _pack(numbers: np.ndarray) -> bytes:
    """Rows of numbers by byte planes, compressed: high bytes are mostly zero."""
    planes = np.ascontiguousarray(numbers, np.int64).reshape(-1).view(np.uint8).reshape(-1, 8).T
    return pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _unpack(data: bytes, rows: int, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, rows * size * 8, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).reshape(rows, size)


def _sent(chunk: int, kind: int, keys: np.ndarray, numbers: np.ndarray, parts: int) -> list[pa.RecordBatch]:
    """One row for each range of the ascending ``keys``, with the keys as differences, and ``numbers`` (rows by keys)."""
    part = ((((keys.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    edges = np.searchsorted(part, np.arange(parts + 1))
    some = np.flatnonzero(np.diff(edges))
    cuts = [(edges[i], edges[i + 1]) for i in some]
    fields = {"kind": np.full(len(some), kind, np.int32), "part": some.astype(np.int32), "chunk": np.full(len(some), chunk, np.int32), "size": np.diff(edges)[some]}
    return [batch_of(_SENT, **fields, keys=pa.array([_pack(np.diff(keys[a:b], prepend=np.int64(0))) for a, b in cuts], pa.binary()), numbers=pa.array([_pack(numbers[:, a:b]) for a, b in cuts], pa.binary()))]


def _totals(sent: pa.Table) -> pa.Table:
    """The sums of every key's numbers, in the order sent; one more row marks the keys that a chunk owns."""
    rows = sorted(sent.to_pylist(), key=lambda r: r["chunk"])
    sizes = np.array([r["size"] for r in rows])
    keys = np.concatenate([np.cumsum(_unpack(r["keys"], 1, r["size"])[0]) for r in rows])
    kinds = 3 if rows[0]["kind"] == CONTEXTS else 1
    numbers = np.concatenate([_unpack(r["numbers"], kinds, r["size"]) for r in rows], axis=1)
    distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
    out = np.zeros((kinds + 1, len(keys)), np.int64)
    for i in range(kinds):
        out[i] = np.bincount(which, numbers[i], minlength=len(distinct)).astype(np.int64)[which]
    out[kinds, first] = out[0, first] > 0
    edges = np.concatenate([[0], np.cumsum(sizes)])
    each = [out[:, a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    reply = batch_of(
        _REPLY, chunk=np.array([r["chunk"] for r in rows], np.int32), kind=np.array([r["kind"] for r in rows], np.int32), part=np.array([r["part"] for r in rows], np.int32), size=sizes,
        numbers=pa.array([_pack(x) for x in each], pa.binary()), n_keys=np.array([x[kinds].sum() for x in each]), total=np.array([(x[0] * x[kinds]).sum() for x in each]),
    )
    return pa.Table.from_batches([reply])


def _exchange(sent: DataFrame) -> DataFrame:
    """Each chunk's keys with the totals over all chunks."""
    return sent.groupBy("kind", "part").applyInArrow(_totals, REPLY)


def _replies(replies: pa.Table, kind: int) -> np.ndarray:
    """The numbers of all keys of one kind that a chunk sent, in ascending order of the keys."""
    rows = sorted((r for r in replies.to_pylist() if r["kind"] == kind), key=lambda r: r["part"])
    width = 4 if kind == CONTEXTS else 2
    return np.concatenate([np.zeros((width, 0), np.int64), *(_unpack(r["numbers"], width, r["size"]) for r in rows)], axis=1)


# ---------------------------------------------------------------- one chunk


@dataclass(frozen=True)
class Chunk:
    """The tokens of a chunk as indices of its distinct words and bigrams, both by ascending hash."""

    rows: np.ndarray
    words: np.ndarray
    word: np.ndarray
    bigrams: np.ndarray
    bigram: np.ndarray
    left: np.ndarray  # words of each bigram
    right: np.ndarray


def _chunk(texts: pa.Table) -> Chunk:
    found, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in texts.select(["text"]).combine_chunks().to_batches():
        for part in slices(batch):
            h, off = tokens(part.column("text"))
            found.append(h)
            lengths.append(np.diff(off))
    rows = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
    words, word = np.unique(np.concatenate(found), return_inverse=True)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[rows[:-1]] = np.searchsorted(words, END)
    pair = signed(mix(words[before].view(np.uint64) * np.uint64(BASE) + words[word].view(np.uint64)))
    bigrams, first, bigram = np.unique(pair, return_index=True, return_inverse=True)
    return Chunk(rows, words, word, bigrams, bigram, before[first], word[first])


def score(df: DataFrame, learn: Column, *, id: str = "doc_id", text: str = "text", context_share: float = CONTEXT_SHARE, least: int = LEAST, discount: float = DISCOUNT) -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score)`` of every row; ``learn`` marks the training rows."""
    learn = F.coalesce(learn, F.lit(False))
    chunked, n = _chunked(df, text, [F.col(id).cast("long").alias("row_id"), learn.alias("learn")])
    parts = max(partitions(df.sparkSession), n // CHUNKS_A_PART)

    def count(texts: pa.Table) -> pa.Table:
        c, chunk = _chunk(texts), texts.column("chunk")[0].as_py()
        learned = np.repeat(texts.column("learn").to_numpy().astype(bool), np.diff(c.rows))
        seen = ((WORDS, c.words, c.word), (BIGRAMS, c.bigrams, c.bigram))
        return pa.Table.from_batches([b for kind, keys, which in seen for b in _sent(chunk, kind, keys, np.bincount(which[learned], minlength=len(keys))[None], parts)], _SENT)

    texts = chunked.select("chunk", "learn", "text").groupBy("chunk")
    counts = materialize(_exchange(texts.applyInArrow(count, SENT)), "counts")
    n_words, n_tokens = counts.where(F.col("kind") == WORDS).agg(F.coalesce(F.sum("n_keys"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()

    def arcs(c: Chunk, replies: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Counts of the words, which are contexts, counts of the bigrams, which are arcs and which of these the chunk owns."""
        (of_word, _), (of_bigram, own) = _replies(replies, WORDS), _replies(replies, BIGRAMS)
        context = (of_word > 0) & (of_word >= context_share * n_tokens)
        arc = (of_bigram > 0) & (of_bigram >= least) & context[c.left] & context[c.right]
        return of_word, context, of_bigram, arc, arc & (own > 0)

    def add_up(texts: pa.Table, replies: pa.Table) -> pa.Table:
        c, chunk = _chunk(texts), texts.column("chunk")[0].as_py()
        of_word, context, of_bigram, _, own = arcs(c, replies)
        left, size = c.left[own], len(c.words)
        sums = np.array([np.bincount(left, w, minlength=size) for w in (np.ones(len(left)), of_bigram[own], of_word[c.right[own]])]).astype(np.int64)
        return pa.Table.from_batches(_sent(chunk, CONTEXTS, c.words[context], sums[:, context], parts), _SENT)

    texts = chunked.select("chunk", "text").groupBy("chunk")
    sums = _exchange(texts.cogroup(counts.groupBy("chunk")).applyInArrow(add_up, SENT))
    schema = pa.schema([("row_id", pa.int64()), *((k, pa.int64()) for k in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        c = _chunk(texts)
        of_word, context, of_bigram, arc, _ = arcs(c, replies)
        symbol = np.where(context, np.cumsum(context) - 1, -1)
        pairs = symbol[c.left[arc]] * max(1, int(context.sum())) + symbol[c.right[arc]]
        order = np.argsort(pairs)
        m = automaton(c.words[context], of_word[context], pairs[order], of_bigram[arc][order], n_tokens, n_words, discount, _replies(replies, CONTEXTS)[:3])
        root = m.unigram(of_word[c.word])
        some = np.concatenate([[0], np.cumsum(of_word[c.word] > 0)])
        scored = batch_of(
            schema, row_id=texts.column("row_id").combine_chunks(), n_tokens=np.diff(c.rows), n_known=np.diff(some[c.rows]), train_tokens=np.full(texts.num_rows, n_tokens),
            base_score=np.add.reduceat(root, c.rows[:-1]), score=m.traverse(symbol[c.word], root, c.rows),
        )
        return pa.Table.from_batches([scored], schema)

    texts = chunked.select("chunk", "row_id", "text").groupBy("chunk")
    scored = texts.cogroup(counts.unionByName(sums).groupBy("chunk")).applyInArrow(run, "row_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("row_id", id)
