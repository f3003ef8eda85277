"""SentencePiece (BPE with byte fallback) encoding with seeded merge-dropout, and decoding.

A text is cut into units that no piece of the vocabulary crosses: a run of word marks and
the characters of one class after it, where characters that stand side by side in some
piece are of one class. In each unit the agenda holds every adjacent pair of symbols whose union is a piece; the best
(highest score, leftmost on ties) is taken next. A keyed hash of the seed, the document's
key, the unit's place and the ends of the pair decides whether a candidate is skipped for
good, so every occurrence of a word is segmented by itself, and yet always alike for one
seed. Without dropout the result is the usual segmentation.

A unit's usual segmentation and the pairs it takes are remembered under a 64-bit key, up to a
fixed number of units. A skipped candidate that would not be taken changes nothing, so the
agenda is worked off anew only for occurrences in which one of these pairs is skipped. All
such units of a batch are processed together: in every round each of them takes the best
entry of its agenda, in numpy; a unit of over 200 characters has a heap of its own and, with
dropout, is not remembered. Nothing is shuffled.

Characters outside the vocabulary, and the word mark itself where it stands in a text, are
spelled in byte pieces; decoding therefore gives every text back.

Defined results: a null text has null ids and decodes to null, an empty text has none and
decodes to the empty text; repeated rows are encoded alike (same id, same text); a null
key is a key of its own; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.llm.common import byte_values, per_batch, schema, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 5
MARK = "▁"
_REMEMBERED = 1_000_000
_TOGETHER, _LONG = 50_000, 200
_NONE = np.iinfo(np.int32).max
_ALL = 2**64 - 1
_OWN_MARK = 0xDC81  # stands for a word mark that is in the text itself; no valid text holds this surrogate


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pair(start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Candidates by the places of their ends in the unit, spread over 64 bits."""
    with np.errstate(over="ignore"):
        return _mix((start.astype(np.uint64) << np.uint64(42)) + (middle.astype(np.uint64) << np.uint64(21)) + end.astype(np.uint64))


def _mix_int(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL
    return x ^ (x >> 31)


class Vocabulary:
    """Pieces, single characters, bytes and merges of a model, as lookup tables."""

    def __init__(self, model: bytes):
        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = p.get_piece_size()
        special = [p.is_control(k) or p.is_unknown(k) or p.is_unused(k) for k in range(n)]
        self.pieces = [p.id_to_piece(k) for k in range(n)]
        self.byte_ids = np.full(256, -1)
        for k in range(n):
            if p.is_byte(k):
                self.byte_ids[int(self.pieces[k][1:-1], 16)] = k
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte fallback; decoding would lose characters")
        normal = {self.pieces[k]: k for k in range(n) if not special[k] and not p.is_byte(k)}
        if any(MARK in x.lstrip(MARK) for x in normal):
            raise ValueError("a piece of the model crosses the start of a word")
        # rank: 0 for the best score; pieces of one score share a rank
        scores = np.array([p.get_score(k) for k in range(n)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self.chars = np.full(0x110000, -1, np.int32)
        for x, k in normal.items():
            if len(x) == 1:
                self.chars[ord(x)] = k
        parts = {c for x in normal if len(x) > 1 for c in x}
        unknown = sorted(c for c in parts if self.chars[ord(c)] < 0)
        if unknown:
            raise ValueError(f"characters without a piece of their own: {unknown[:5]}")
        # characters that stand side by side in some piece are of one class; a merge never leaves it
        parent: dict[str, str] = {c: c for c in parts}

        def root(c):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        for x in normal:
            for c, d in zip(x, x[1:], strict=False):
                if c != MARK:
                    parent[root(c)] = root(d)
        self.kind = np.zeros(0x110000, np.int32)  # 0: in no longer piece
        names = {r: k + 2 for k, r in enumerate(sorted({root(c) for c in parts}))}
        for c in parts:
            self.kind[ord(c)] = names[root(c)]
        self.kind[ord(MARK)] = 1
        merges = {}
        for x, k in normal.items():
            for cut in range(1, len(x)):
                a, b = normal.get(x[:cut]), normal.get(x[cut:])
                if a is not None and b is not None:
                    merges[a * n + b] = k
        self.n, self.merges = n, merges
        self._slots(np.array(list(merges), np.int64), np.array(list(merges.values()), np.int32))
        spelled = [bytes([int(np.flatnonzero(self.byte_ids == k)[0])]) if p.is_byte(k) else b"" if special[k]
                   else x.replace(MARK, " ").encode() for k, x in enumerate(self.pieces)]
        self.size_of = np.array([len(x) for x in spelled])
        self.start_of = np.concatenate(([0], np.cumsum(self.size_of)[:-1]))
        self.blob = np.frombuffer(b"".join(spelled), np.uint8)

    def _slots(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table of the merges."""
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.value = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys))
        at = self._home(keys)
        while len(left):
            free = self.key[at[left]] < 0
            first = np.unique(at[left[free]], return_index=True)[1]
            placed = left[free][first]
            self.key[at[placed]], self.value[at[placed]] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            at[left] = np.where(self.key[at[left]] >= 0, (at[left] + 1) & ((1 << self.bits) - 1), at[left])

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that joins pieces a and b, or -1."""
        keys = a.astype(np.int64) * self.n + b
        keys[(a < 0) | (b < 0)] = -2
        out = np.full(len(keys), -1, np.int32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            there = self.key[at[left]]
            found = there == keys[left]
            out[left[found]] = self.value[at[left[found]]]
            go = ~found & (there >= 0)
            left = left[go]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        return out

    def segment(self, points: np.ndarray, sizes: np.ndarray, unit_key: np.ndarray, dropout: float,
                taken: list[tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of many units, processed together, and their number per unit. ``points``
        are the characters of all units, ``unit_key`` their keys; a negative symbol is a character without a piece.
        ``taken`` receives the units and pairs of all merges."""
        first = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(points)) - first[owner]  # of a symbol's first character in its unit
        limit = np.uint64(min(int(dropout * 2.0**64), _ALL))
        symbol = self.chars[points].astype(np.int64)
        symbol[symbol < 0] = -2 - points[symbol < 0].astype(np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def candidates(left, right, k, start, middle, end):
            """Merged piece (or -1) of pairs; skipped ones are none."""
            piece = self.merged(left, right)
            if dropout > 0:
                live = np.flatnonzero(piece >= 0)
                with np.errstate(over="ignore"):
                    drawn = _mix(unit_key[k[live]] ^ _pair(start[live], middle[live], end[live]))
                piece[live[drawn < limit]] = -1
            return piece

        # pair t joins the symbols t and t + 1; the last symbol of a unit has none
        tail = np.append(owner[1:] != owner[:-1], True)
        end = place + 1  # of a symbol's last character
        pair = np.full(len(symbol), -1, np.int64)
        at = np.flatnonzero(~tail)
        pair[at] = candidates(symbol[at], symbol[at + 1], owner[at], place[at], place[at + 1], end[at + 1])
        while len(symbol):
            rank = np.where(pair >= 0, self.rank[np.maximum(pair, 0)], _NONE)
            begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(rank, begin)
            busy = best < _NONE
            if not busy.all():  # units with an empty agenda are finished
                per = np.diff(np.append(begin, len(symbol)))
                over = np.repeat(~busy, per)
                done.append((owner[over], symbol[over]))
                keep = ~over
                symbol, owner, place, end, pair, rank = (v[keep] for v in (symbol, owner, place, end, pair, rank))
                if not len(symbol):
                    break
                begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                best = best[busy]
            per = np.diff(np.append(begin, len(symbol)))
            hit = np.flatnonzero(rank == np.repeat(best, per))
            hit = hit[np.concatenate(([True], owner[hit[1:]] != owner[hit[:-1]]))]  # the leftmost of each unit
            if taken is not None:
                taken.append((owner[hit], _pair(place[hit], place[hit + 1], end[hit + 1])))
            symbol[hit] = pair[hit]
            end[hit] = end[hit + 1]
            pair[hit] = -1
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            moved = hit - np.arange(len(hit))  # positions after removal
            symbol, owner, place, end, pair = (v[keep] for v in (symbol, owner, place, end, pair))
            for t in (moved, moved - 1):  # the pairs on both sides of the new symbol
                t = t[(t >= 0) & (t + 1 < len(symbol))]
                same = owner[t] == owner[t + 1]
                t = t[same]
                pair[t] = candidates(symbol[t], symbol[t + 1], owner[t], place[t], place[t + 1], end[t + 1])
        out_owner = np.concatenate([d[0] for d in done]) if done else np.empty(0, np.int64)
        out_symbol = np.concatenate([d[1] for d in done]) if done else np.empty(0, np.int64)
        order = np.argsort(out_owner, kind="stable")
        return out_symbol[order], np.bincount(out_owner, minlength=len(sizes))

    def segment_one(self, points: list[int], key: int, dropout: float) -> list[int]:
        """The symbols of one unit by a heap: for long units, where rounds over all symbols would be quadratic."""
        n, limit = len(points), min(int(dropout * 2.0**64), _ALL)
        symbol = [int(self.chars[c]) if self.chars[c] >= 0 else -2 - c for c in points]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        end, alive, agenda = list(range(1, n + 1)), [True] * n, []

        def offer(a: int, b: int) -> None:
            if a < 0 or b < 0 or symbol[a] < 0 or symbol[b] < 0:
                return
            piece = self.merges.get(symbol[a] * self.n + symbol[b])
            if piece is None:
                return
            if dropout > 0 and _mix_int(key ^ _mix_int(((a << 42) + (b << 21) + end[b]) & _ALL)) < limit:
                return  # this candidate is skipped for good
            heapq.heappush(agenda, (int(self.rank[piece]), a, b, end[a], end[b], piece))

        for k in range(n - 1):
            offer(k, k + 1)
        while agenda:
            _, a, b, end_a, end_b, piece = heapq.heappop(agenda)
            if not (alive[a] and alive[b] and end[a] == end_a and end[b] == end_b):
                continue  # one side has changed since
            symbol[a], end[a], alive[b], right[a] = piece, end[b], False, right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [s for s, x in zip(symbol, alive, strict=True) if x]

    def spell(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids for symbols: characters without a piece become byte pieces."""
        odd = np.flatnonzero(symbols < 0)
        if not len(odd):
            return symbols.astype(np.int32), counts
        points, which = np.unique(-2 - symbols[odd], return_inverse=True)
        spelled = [(MARK if c == _OWN_MARK else chr(c)).encode() for c in points.tolist()]
        width = np.ones(len(symbols), np.int64)
        width[odd] = np.array([len(x) for x in spelled])[which]
        out = np.repeat(symbols, width)
        start = np.cumsum(width) - width
        for k in range(4):
            more = odd[width[odd] > k]
            codes = np.array([x[k] if len(x) > k else 0 for x in spelled])[which[width[odd] > k]]
            out[start[more] + k] = self.byte_ids[codes]
        owner = np.repeat(np.arange(len(counts)), counts)
        return out.astype(np.int32), np.bincount(owner, width, len(counts)).astype(np.int64)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of texts and their offsets; ids[offsets[k]:offsets[k + 1]] is text k."""
        size = self.size_of[ids]
        ends = np.cumsum(size)
        out = self.blob[np.repeat(self.start_of[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        stops = np.concatenate(([0], ends))[offsets]
        # the word mark before a text is not a part of it
        begin = stops[:-1][(stops[1:] > stops[:-1])]
        begin = begin[out[begin] == 0x20]
        gone = np.zeros(len(out) + 1, np.int64)
        gone[begin + 1] = 1
        return np.delete(out, begin), stops - np.cumsum(gone)[stops]


class Encoder:
    """Encodes texts, remembering the ids of units that it has met under their 64-bit keys."""

    def __init__(self, vocabulary: Vocabulary, dropout: float = DROPOUT, seed: int = SEED):
        self.v, self.dropout, self.seed = vocabulary, dropout, seed
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.count = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.store, self.used = np.empty(1 << 16, np.int32), 0
        # the pairs that a unit's usual segmentation takes
        self.pair_at, self.pair_count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pairs, self.pairs_used = np.empty(1 << 16, np.uint64), 0

    def __call__(self, texts: list[str | None], names: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and the offsets of each; ``names`` are keys of the texts."""
        if len(self.keys) > _REMEMBERED:
            self._forget()
        lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        points = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le"), np.uint32).copy()
        if not len(points):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        own = points == ord(MARK)
        points[points == 0x20] = ord(MARK)
        points[own] = _OWN_MARK
        kind = self.v.kind[points]
        mark = kind == 1
        start = np.ones(len(points), bool)
        start[1:] = np.where(mark[1:], ~mark[:-1], ~mark[:-1] & (kind[1:] != kind[:-1]))
        begins = np.cumsum(lengths) - lengths
        start[begins[lengths > 0]] = True
        first = np.flatnonzero(start)
        sizes = np.diff(np.append(first, len(points)))
        per_text = np.zeros(len(texts), np.int64)
        per_text[lengths > 0] = np.add.reduceat(start, begins[lengths > 0], dtype=np.int64)
        key = self._unit_keys(points, first, sizes)
        alone = sizes > _LONG if self.dropout > 0 else np.zeros(len(sizes), bool)  # not remembered
        unique, sample, which = np.unique(key[~alone], return_index=True, return_inverse=True)
        sample = np.flatnonzero(~alone)[sample]
        where = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = where < len(self.keys)
        known[inside] = self.keys[where[inside]] == unique[inside]
        self._learn(points, first[sample[~known]], sizes[sample[~known]], unique[~known])
        where = np.searchsorted(self.keys, unique)[which]
        usual = np.flatnonzero(~alone)
        anew, counts = alone, np.zeros(len(first), np.int64)
        if self.dropout > 0:
            occurrence = self._occurrence_keys(key, per_text, names)
            anew = alone.copy()
            anew[usual] = self._skips(where, occurrence[usual])
            rest = ~anew[usual]
            usual, where = usual[rest], where[rest]
        again = np.flatnonzero(anew)
        counts[usual] = self.count[where]
        if len(again):
            order, fresh, counts[again] = self._segment(points, first[again], sizes[again], occurrence[again], self.dropout)
        ends = np.cumsum(counts)
        ids = np.empty(int(ends[-1]), np.int32)
        ids[_spans(ends[usual] - counts[usual], counts[usual])] = self.store[_spans(self.at[where], counts[usual])]
        if len(again):
            again = again[order]
            ids[_spans(ends[again] - counts[again], counts[again])] = fresh
        return ids, np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(per_text)))]

    def _unit_keys(self, points, first, sizes) -> np.ndarray:
        """A key from a unit's characters."""
        place = np.arange(len(points)) - np.repeat(first, sizes)
        spread = _mix(points.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(24)))
        return _mix(np.add.reduceat(spread, first))

    def _occurrence_keys(self, key, per_text, names) -> np.ndarray:
        """A key from the unit, the text's name, the unit's number in the text and the seed."""
        base = np.array([xxhash.xxh3_64_intdigest(str(x), self.seed) for x in names], np.uint64)
        number = np.arange(len(key)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        return _mix(key + _mix(np.repeat(base, per_text) + _mix(number.astype(np.uint64) + np.uint64(self.seed))))

    def _skips(self, where, occurrence) -> np.ndarray:
        """Whether an occurrence of a remembered unit skips a pair that its usual segmentation takes."""
        limit = np.uint64(min(int(self.dropout * 2.0**64), _ALL))
        out = np.zeros(len(where), bool)
        for a in range(0, len(where), _TOGETHER):
            w = where[a:a + _TOGETHER]
            n = self.pair_count[w]
            drawn = _mix(np.repeat(occurrence[a:a + _TOGETHER], n) ^ self.pairs[_spans(self.pair_at[w], n)])
            out[a + np.repeat(np.arange(len(w)), n)[drawn < limit]] = True
        return out

    def _segment(self, points, first, sizes, keys, dropout, taken=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the units (long ones last), the ids of all units in that order, and the number per unit."""
        order = np.argsort(sizes > _LONG, kind="stable")
        first, sizes, keys = first[order], sizes[order], keys[order]
        short = int((sizes <= _LONG).sum())
        found, counts = [], []
        for a in range(0, short, _TOGETHER):
            f, n, k = first[a:min(a + _TOGETHER, short)], sizes[a:min(a + _TOGETHER, short)], keys[a:min(a + _TOGETHER, short)]
            merges = None if taken is None else []
            symbols, c = self.v.segment(points[_spans(f, n)], n, k, dropout, merges)
            found.append(symbols), counts.append(c)
            if taken is not None:
                taken += [(order[a + unit], pair) for unit, pair in merges]
        for f, n, k in zip(first[short:], sizes[short:], keys[short:], strict=True):
            symbols = self.v.segment_one(points[f:f + n].tolist(), int(k), dropout)
            found.append(np.array(symbols)), counts.append(np.array([len(symbols)]))
        ids, count = self.v.spell(np.concatenate(found), np.concatenate(counts))
        back = np.empty_like(count)
        back[order] = count
        return order, ids, back

    def _learn(self, points, first, sizes, keys) -> None:
        """Segment units without dropout and remember their ids and, for dropout, the pairs taken."""
        if not len(keys):
            return
        taken: list[tuple[np.ndarray, np.ndarray]] | None = [] if self.dropout > 0 else None
        order, ids, count = self._segment(points, first, sizes, keys, 0.0, taken)
        at = np.empty_like(count)
        at[order] = self.used + np.cumsum(count[order]) - count[order]
        self.store, self.used = _append(self.store, self.used, ids)
        unit = np.concatenate([t[0] for t in taken]) if taken else np.empty(0, np.int64)
        pair = np.concatenate([t[1] for t in taken]) if taken else np.empty(0, np.uint64)
        pair_count = np.bincount(unit, minlength=len(keys))
        pair_at = self.pairs_used + np.cumsum(pair_count) - pair_count
        self.pairs, self.pairs_used = _append(self.pairs, self.pairs_used, pair[np.argsort(unit, kind="stable")])
        keys, at, count, pair_at, pair_count = (np.concatenate(x) for x in (
            (self.keys, keys), (self.at, at), (self.count, count), (self.pair_at, pair_at), (self.pair_count, pair_count)))
        order = np.argsort(keys)
        self.keys, self.at, self.count = keys[order], at[order], count[order]
        self.pair_at, self.pair_count = pair_at[order], pair_count[order]


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all spans, on end."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _append(store: np.ndarray, used: int, values: np.ndarray) -> tuple[np.ndarray, int]:
    """``values`` behind the used part of a store that doubles when it is full."""
    while used + len(values) > len(store):
        store = np.concatenate([store, np.empty_like(store)])
    store[used:used + len(values)] = values
    return store, used + len(values)


def load(model: str) -> bytes:
    """The model file, read on the driver and sent to the tasks: a vocabulary of fixed size."""
    with open(model, "rb") as f:
        return f.read()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, dropout: float = DROPOUT,
           seed: int = SEED) -> DataFrame:
    """One row per document: (id, text, ids)."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def make():
        encoder = Encoder(Vocabulary(shared.value), dropout, seed)

        def fn(batch):
            texts = batch.column(1).to_pylist()
            ids, offsets = encoder(texts, batch.column(0).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids),
                                           mask=pa.array([t is None for t in texts], pa.bool_()))
            return [batch.column(0), batch.column(1), ids]
        return fn

    return per_batch(docs.select(id_col, F.col(text_col).alias("text")), make, schema(docs, id_col, "text string, ids array<int>"), 1 << 20)


def decode(rows: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """``rows`` with the text of ``ids_col`` in ``out_col``."""
    shared = rows.sparkSession.sparkContext.broadcast(load(model))
    kept = [c for c in rows.columns if c != out_col]

    def make():
        v = Vocabulary(shared.value)

        def fn(batch):
            column = batch.column(ids_col)
            ids, offsets = np.asarray(column.flatten()), np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0))))
            data, ends = v.decode(ids, offsets)
            data = data.tobytes()
            texts = [None if gone else data[a:b].decode("utf-8", "replace") for gone, a, b in
                     zip(column.is_null().to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            return [*batch.columns, texts]
        return fn

    return per_batch(rows.select(*kept), make, T.StructType([*[rows.schema[c] for c in kept], T.StructField(out_col, T.StringType())]), 2 << 20)


def encode_and_check(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL,
                     dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """One row per document: (id, ids, decoded_sha256, lossless), encoded and decoded in one task, so that
    neither texts nor ids travel twice and one worker holds one vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def make():
        v = Vocabulary(shared.value)
        encoder = Encoder(v, dropout, seed)

        def fn(batch):
            texts = batch.column(1).to_pylist()
            ids, offsets = encoder(texts, batch.column(0).to_pylist())
            data, ends = v.decode(ids, offsets)
            data, ends = data.tobytes(), ends.tolist()
            back = [None if t is None else data[a:b] for t, a, b in zip(texts, ends, ends[1:], strict=False)]
            return [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids),
                                                              mask=pa.array([t is None for t in texts], pa.bool_())),
                    [None if b is None else hashlib.sha256(b).hexdigest() for b in back],
                    [b == t for b, t in zip(back, byte_values(batch.column(1)), strict=True)]]
        return fn

    return per_batch(docs.select(id_col, F.col(text_col).cast("string")), make,
                     schema(docs, id_col, "ids array<int>, decoded_sha256 string, lossless boolean"), 1 << 20)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode_and_check(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"),
                       "decoded_sha256", "lossless")
