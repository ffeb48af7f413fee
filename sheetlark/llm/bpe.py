"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

1. Spark counts the space-separated words of all documents; those that make up at least
   ``lexicon_share`` of all (so at most 1 / ``lexicon_share`` words, at any size) are cut
   into pieces and merged once.
2. Their pieces become a minimal acyclic automaton with shared suffixes. Every state
   carries the number of words below it, so a walk yields the word's index, and the index
   its ids. The automaton is one flat file, shipped with the job and memory-mapped.
3. Tasks cut whole texts into units where pieces surely begin, look each distinct unit up in the
   transducer and merge unseen pieces exactly, by rank.

Nulls count as empty texts, empty texts have no tokens, very long texts are encoded whole, a
repeated row repeats its result (with a null id too), an empty table gives no rows; other columns are not read. The special token's
string is recognised in texts as the tokenizers library does by default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, byte_hashes, materialize, scratch_path, slices, text_buffer

#: The piece pattern of the vocabulary files.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LEXICON_SHARE = 2e-6
CACHE_UNITS = 250_000
SLICE = 2 << 20
LONG_PIECE = 200


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A byte-level BPE vocabulary: exact merging by rank, and the bytes of every id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = _byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        token = [b""] * size
        for text, i in vocab.items():
            token[i] = bytes(alphabet[c] for c in text) if all(c in alphabet for c in text) else text.encode()
        for text, i in self.special.items():
            token[i] = text.encode()
        self.token_pool = np.frombuffer(b"".join(token), np.uint8)
        self.token_len = np.array([len(t) for t in token], np.int64)
        self.byte_ids = np.array([vocab.get(c, -1) for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], np.int64)
        keys, merged = [], []
        for pair in spec["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            keys.append((vocab[a] << 32) | vocab[b])
            merged.append(vocab[a + b])
        keys = np.array(keys, np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.merged = np.array(merged, np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], len(self.keys))

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece: always the adjacent pair of least rank, leftmost first."""
        out: list[np.ndarray | None] = [self._merge_long(p) if len(p) > LONG_PIECE else None for p in pieces]
        todo = [i for i, x in enumerate(out) if x is None]
        if not todo:
            return out
        lens = np.array([len(pieces[i]) for i in todo], np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(pieces[i] for i in todo), np.uint8)]
        who = np.repeat(np.arange(len(todo)), lens)
        while len(sym):
            rank = np.full(len(sym), len(self.keys), np.int64)
            if len(sym) > 1:
                inside = np.flatnonzero(who[1:] == who[:-1])
                rank[inside] = self.ranks(sym[inside], sym[inside + 1])
            first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.concatenate([first, [len(sym)]]))
            done = least == len(self.keys)
            for f, n in zip(first[done].tolist(), size[done].tolist(), strict=True):
                out[todo[who[f]]] = sym[f : f + n].copy()
            hit = np.flatnonzero((rank == np.repeat(least, size)) & (rank < len(self.keys)))
            if len(hit):
                hit = hit[np.concatenate([[True], who[hit[1:]] != who[hit[:-1]]])]
                sym[hit] = self.merged[rank[hit]]
            keep = ~np.repeat(done, size)
            keep[hit + 1] = False
            sym, who = sym[keep], who[keep]
        return [np.zeros(0, np.int64) if x is None else x for x in out]

    def _merge_long(self, piece: bytes) -> np.ndarray:
        sym = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(sym)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rank = self.ranks(np.array(sym[:-1]), np.array(sym[1:])).tolist()
        heap = [(r, i, sym[i], sym[i + 1]) for i, r in enumerate(rank) if r < len(self.keys)]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0:
                    r = int(self.ranks(np.array([sym[x]]), np.array([sym[after[x]]]))[0])
                    if r < len(self.keys):
                        heapq.heappush(heap, (r, x, sym[x], sym[after[x]]))
        return np.array([s for s in sym if s >= 0], np.int64)


# ---------------------------------------------------------------- the transducer


def compile_lexicon(words: list[bytes], ids: list[np.ndarray]) -> dict[str, np.ndarray]:
    """A minimal acyclic automaton over sorted distinct words; arcs carry how many words they skip."""
    order = sorted(range(len(words)), key=words.__getitem__)
    register: dict[tuple, int] = {}
    below: list[int] = []  # words accepted from a finished state
    finals: list[bool] = []
    arcs: list[tuple[tuple[int, int], ...]] = []

    def finish(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(arcs)
            arcs.append(key[1])
            finals.append(node[0])
            below.append(int(node[0]) + sum(below[t] for _, t in key[1]))
        return register[key]

    stack: list[list] = [[False, []]]
    last = b""

    def close(depth: int) -> None:
        while len(stack) > depth + 1:
            node = stack.pop()
            stack[-1][1].append((last[len(stack) - 1], finish(node)))

    for i in order:
        word = words[i]
        common = len(os.path.commonprefix([last, word]))
        close(common)
        stack.extend([False, []] for _ in word[common:])
        stack[-1][0] = True
        last = word
    close(0)
    root = finish(stack[0])
    keys, target, skip = [], [], []
    for s, out in enumerate(arcs):
        passed = int(finals[s])
        for label, t in out:
            keys.append((s << 8) | label)
            target.append(t)
            skip.append(passed)
            passed += below[t]
    flat = [ids[i] for i in order]
    return {
        "keys": np.array(keys, np.int64), "target": np.array(target, np.int64), "skip": np.array(skip, np.int64), "final": np.array(finals, bool),
        "root": np.array([root], np.int64), "ids": np.concatenate([*flat, np.zeros(0, np.int64)]).astype(np.int64), "at": np.cumsum([0, *map(len, flat)]).astype(np.int64),
    }


def walk(lexicon: dict[str, np.ndarray], pieces: list[bytes]) -> np.ndarray:
    """Index of each piece in the lexicon, or -1; all pieces step through the automaton together."""
    n = len(pieces)
    index = np.full(n, -1, np.int64)
    if not n or not len(lexicon["keys"]):
        return index
    lens = np.array([len(p) for p in pieces], np.int64)
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
    live, state, passed, depth = np.arange(n), np.full(n, lexicon["root"][0]), np.zeros(n, np.int64), 0
    while len(live):
        ended = lens[live] == depth
        hit = ended & lexicon["final"][state]
        index[live[hit]] = passed[hit]
        live, state, passed = live[~ended], state[~ended], passed[~ended]
        if not len(live):
            break
        key = (state << 8) | data[starts[live] + depth]
        at = np.minimum(np.searchsorted(lexicon["keys"], key), len(lexicon["keys"]) - 1)
        ok = lexicon["keys"][at] == key
        at = at[ok]
        live, state, passed = live[ok], lexicon["target"][at], passed[ok] + lexicon["skip"][at]
        depth += 1
    return index


def save_lexicon(lexicon: dict[str, np.ndarray], path: str) -> None:
    """Write a lexicon to a path or URI, aligned for memory mapping."""
    head = json.dumps({k: [str(v.dtype), len(v)] for k, v in lexicon.items()}).encode()
    fs, name = pafs.FileSystem.from_uri(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(name, compression=None) as file:
        file.write(len(head).to_bytes(8, "little") + head + b"\0" * (-(8 + len(head)) % 8))
        for v in lexicon.values():
            file.write(v.tobytes() + b"\0" * (-v.nbytes % 8))


def map_lexicon(path: str) -> dict[str, np.ndarray]:
    raw = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(raw[:8].tobytes(), "little")
    at, out = 8 + size + (-(8 + size) % 8), {}
    for k, (kind, n) in json.loads(raw[8 : 8 + size].tobytes()).items():
        width = np.dtype(kind).itemsize * n
        out[k] = raw[at : at + width].view(kind).view(np.ndarray)  # still the mapped pages
        at += width + (-width % 8)
    return out


# ---------------------------------------------------------------- texts


def gather(pool: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated spans of ``pool``."""
    total = np.cumsum(lens)
    if not len(total):
        return pool[:0]
    kind = np.int32 if max(total[-1], len(pool)) < 2**31 else np.int64
    at = np.repeat((starts - (total - lens)).astype(kind), lens)
    at += np.arange(total[-1], dtype=kind)
    return pool[at]


def cut_tables(special: dict[str, int]) -> tuple[np.ndarray, bool, bool]:
    """Punctuation before which texts may be cut after a letter or digit, and whether spaces and newlines may be cut at.

    The apostrophe opens contractions; what stands so inside a special token would tear it.
    """
    fine = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) != "'" for b in range(256)])
    for token in special:
        for x, y in zip(token, token[1:], strict=False):
            if x.isalnum() and ord(y) < 256:
                fine[ord(y)] = False
    return fine, not any(" " in t for t in special), not any("\n" in t for t in special)


def unit_spans(data: np.ndarray, offsets: np.ndarray, tables: tuple[np.ndarray, bool, bool]) -> tuple[np.ndarray, np.ndarray]:
    """Cut rows where a new piece surely begins, so that units can be cut into pieces alone.

    That is at a single space or newline between characters that are surely no white space,
    and between a letter or digit and punctuation.
    """
    n = len(data)
    fine, spaces, newlines = tables
    cut = np.zeros(n + 1, bool)
    if n > 2:
        solid = (data > 32) & (data < 127)
        wide = (data >= 0xC3) & (data <= 0xDF)
        opens = solid | wide
        closes = solid.copy()
        closes[1:] |= wide[:-1] & (data[1:] >= 0x80)
        if spaces:
            cut[1 : n - 1] = (data[1:-1] == 32) & closes[:-2] & opens[2:]
        lower = data | 32
        word = ((data >= 48) & (data <= 57)) | ((lower >= 97) & (lower <= 122))
        word[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut[1:n] |= word[:-1] & fine[data[1:]]
        if newlines:
            alone = (data[1:-1] == 10) & closes[:-2] & opens[2:]
            cut[1 : n - 1] |= alone
            cut[2:n] |= alone
    cut[offsets] = True
    cut[n] = False
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n)
    return starts, ends


class Encoder:
    """One per Python worker: the mapped transducer, the merges and a bounded cache of units."""

    def __init__(self, lexicon: str, merges: Merges):
        self.lexicon, self.merges = map_lexicon(lexicon), merges
        self.tables = cut_tables(merges.special)
        self.cut = regex.compile("|".join(f"({regex.escape(s)})" for s in merges.special)) if merges.special else None
        self.units: dict[bytes, np.ndarray] = {}
        decimal = [f"{i},".encode() for i in range(len(merges.token_len))]
        self.decimal_pool, self.decimal_len = np.frombuffer(b"".join(decimal), np.uint8), np.array([len(x) for x in decimal], np.int64)
        self.decimal_at = np.cumsum(self.decimal_len) - self.decimal_len
        self.token_at = np.cumsum(merges.token_len) - merges.token_len

    def _learn(self, units: list[bytes]) -> None:
        known: dict[bytes, int] = {}
        parts: list[list[int]] = []
        for unit in units:
            text = unit.decode("utf-8", "surrogateescape")
            part: list[int] = []
            for i, run in enumerate(self.cut.split(text) if self.cut and "<" in text else [text]):
                if run is None or not run:
                    continue
                if i % 2 and run in self.merges.special:
                    part.append(-1 - self.merges.special[run])
                else:
                    part.extend(known.setdefault(p.encode("utf-8", "surrogateescape"), len(known)) for p in PIECES.findall(run))
            parts.append(part)
        pieces = list(known)
        index = walk(self.lexicon, pieces)
        at = self.lexicon["at"]
        ids: list[np.ndarray] = [self.lexicon["ids"][at[i] : at[i + 1]] if i >= 0 else None for i in index.tolist()]
        unseen = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(unseen, self.merges.merge([pieces[i] for i in unseen]), strict=True):
            ids[i] = x
        for unit, part in zip(units, parts, strict=True):
            self.units[unit] = np.concatenate([ids[p] if p >= 0 else np.array([-1 - p]) for p in part]) if len(part) != 1 or part[0] < 0 else ids[part[0]]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and the rows' offsets in them."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        starts, ends = unit_spans(data, offsets, self.tables)
        _, first, which = np.unique(byte_hashes(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        keys = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if len(self.units) > CACHE_UNITS:
            self.units = {k: self.units[k] for k in keys if k in self.units}
        new = [k for k in keys if k not in self.units]
        for a in range(0, len(new), 20_000):
            self._learn(new[a : a + 20_000])
        got = [self.units[k] for k in keys]
        lens = np.array([len(x) for x in got], np.int64)
        ids = gather(np.concatenate(got), (np.cumsum(lens) - lens)[which], lens[which])
        sums = np.concatenate([[0], np.cumsum(lens[which])])
        return ids, sums[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows' ids and the rows' offsets in them."""
        lens = self.merges.token_len[ids]
        return gather(self.merges.token_pool, self.token_at[ids], lens), np.concatenate([[0], np.cumsum(lens)])[rows]

    def decimal(self, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each id in decimal with a comma after it, and the rows' offsets."""
        lens = self.decimal_len[ids]
        return gather(self.decimal_pool, self.decimal_at[ids], lens), np.concatenate([[0], np.cumsum(lens)])[rows]


@lru_cache(maxsize=2)
def _encoder(name: str, merges) -> Encoder:
    return Encoder(SparkFiles.get(name), merges.value)


def build(df: DataFrame, tokenizer: str, lexicon_share: float = LEXICON_SHARE, text: str = "text") -> tuple[str, object]:
    """Count, compile and ship: the lexicon's file name in the job and the broadcast merges.

    Both are bounded: a lexicon has at most 1 / ``lexicon_share`` words, and the merges are the vocabulary file's.
    """
    spark = df.sparkSession
    merges = Merges(tokenizer)
    counts = materialize(df.select(F.explode(F.split(F.col(text), " ")).alias("w")).groupBy("w").count().where("count > 1"), "words")
    total = counts.agg(F.sum("count")).first()[0] or 0
    words = counts.where(F.col("count") >= lexicon_share * total).select("w").collect()
    pieces = sorted({p.encode() for r in words for unit in (r.w, f" {r.w}") for p in PIECES.findall(unit)})
    path = scratch_path(spark, "lexicon")
    save_lexicon(compile_lexicon(pieces, merges.merge(pieces)), path)
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1], spark.sparkContext.broadcast(merges)


def encode(df: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", lexicon_share: float = LEXICON_SHARE) -> DataFrame:
    """``(id, ids array<int>, decoded string)``: every whole text encoded, and its ids decoded again."""
    name, merges = build(df, tokenizer, lexicon_share, text)
    schema = pa.schema([(id, pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        encoder = _encoder(name, merges)
        for batch in batches:
            for part in slices(batch, text, SLICE):
                ids, rows = encoder.encode(*text_buffer(part.column(text)))
                out, at = encoder.decode(ids, rows)
                raw = out.tobytes()
                decoded = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
                yield batch_of(schema, **{id: part.column(id), "ids": pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids, pa.int32())), "decoded": decoded})

    return df.select(F.col(id).cast("long").alias(id), text).mapInArrow(run, f"{id} long, ids array<int>, decoded string")


def encode_digests(df: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", lexicon_share: float = LEXICON_SHARE) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` of every row, by the same encoder."""
    name, merges = build(df, tokenizer, lexicon_share, text)
    schema = pa.schema([(id, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        encoder = _encoder(name, merges)
        for batch in batches:
            for part in slices(batch, text, SLICE):
                ids, rows = encoder.encode(*text_buffer(part.column(text)))
                listed, la = encoder.decimal(ids, rows)
                out, oa = encoder.decode(ids, rows)
                listed, out = listed.tobytes(), out.tobytes()
                yield batch_of(
                    schema,
                    **{
                        id: part.column(id),
                        "n_tokens": np.diff(rows),
                        "ids_sha256": [hashlib.sha256(listed[a : max(a, b - 1)]).hexdigest() for a, b in zip(la[:-1].tolist(), la[1:].tolist(), strict=True)],
                        "decoded_sha256": [hashlib.sha256(out[a:b].decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(oa[:-1].tolist(), oa[1:].tolist(), strict=True)],
                    },
                )

    return df.select(F.col(id).cast("long").alias(id), text).mapInArrow(run, f"{id} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
