"""SentencePiece encoding by sampling, and decoding: forward filtering, backward sampling over the piece lattice.

Every segmentation of a text into the model's pieces is drawn with its probability under a unigram model of the pieces,
by numbers that depend on the row's key, the place in the text and nothing else: the same row is cut alike in any task,
batch or attempt. Decoding any of these segmentations gives back the text.

* A text is written with ``\\u2581`` for each blank and one in front, as the model expects. No piece that takes part
  holds that mark but at its start, nor a line feed, so the lattice falls apart before each blank and line feed; these
  units are filtered once and kept by each worker.
* Characters without a piece of their own go as UTF-8 bytes, and so does a literal ``\\u2581`` in a text.
* Piece probabilities: the model's scores where they are log probabilities; a merge model's scores are ranks, and a
  piece of rank r gets a probability in proportion to 1 / (r + 2). ``alpha`` flattens (below 1) or sharpens them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigscope.llm.tables import small_batches

MARK = "▁"
_LITERAL = 0x110001           # stands for a literal mark in a unit's code points
_KEPT_UNITS = 120_000         # filtered units that a worker keeps
_KEPT_STATES = 3_000_000      # their states beyond which they are dropped
_CHUNK_UNITS = 40_000         # units that are sampled together
_CHUNK_CHARS = 400_000        # characters of units that are sampled or filtered together (a longer unit alone)
_LONG_UNIT = 512              # characters from which a unit is filtered and sampled by plain numbers, not with others
_SLOTS = 1 << 20
_SEED, _UNIT, _STEP = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7))


class Vocabulary:
    """The pieces of a model: their log probabilities, a hash table from code points to piece, and their bytes."""

    def __init__(self, path: str, alpha: float = 1.0):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * size
        self.byte_ids = np.full(256, -1, np.int32)
        taken = []
        for k in range(size):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes[k] = k, bytes([value])
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                self.bytes[k] = piece.replace(MARK, " ").encode()
                if MARK not in piece[1:] and "\n" not in piece:
                    taken.append((piece, k, model.get_score(k)))
        if (self.byte_ids < 0).any():
            raise ValueError(f"{path} has no byte pieces, so it can't write every text without loss")
        # runs of marks are in the model for decoding only; a single mark is the rarest piece
        taken = [x for x in taken if x[2] > -1e8 or x[0] == MARK]
        scores = np.array([x[2] for x in taken])
        if scores.min() < -100:                              # ranks of merges, not log probabilities
            rank = np.empty(len(scores))
            rank[np.argsort(-scores, kind="stable")] = np.arange(len(scores))
            scores = -np.log(rank + 2)
        scores = alpha * scores
        self.log = scores - np.log(np.exp(scores - scores.max()).sum()) - scores.max()
        self.byte_log = float(self.log.min())
        self.ids = np.array([x[1] for x in taken], np.int32)
        self.longest = max(len(x[0]) for x in taken)
        self.slot_key, self.slot_at = np.zeros(_SLOTS, np.uint64), np.full(_SLOTS, -1, np.int32)
        for at, (piece, _, _) in enumerate(taken):
            key = np.uint64(0)
            for c in np.frombuffer(piece.encode("utf-32-le"), np.uint32).astype(np.uint64):
                key = self.extend(np.array([key]), np.array([c]))[0]
            slot = int(key) & _SLOTS - 1
            while self.slot_at[slot] >= 0:
                slot = slot + 1 & _SLOTS - 1
            self.slot_key[slot], self.slot_at[slot] = key, at

    @staticmethod
    def extend(key: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Key of a string with one more character."""
        key = (key + char + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return key ^ key >> np.uint64(29)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Number of the piece with each key, or -1."""
        slot = (key & np.uint64(_SLOTS - 1)).astype(np.int64)
        at = self.slot_at[slot]
        wrong = np.flatnonzero((at >= 0) & (self.slot_key[slot] != key))
        while len(wrong):
            slot[wrong] = slot[wrong] + 1 & _SLOTS - 1
            at[wrong] = self.slot_at[slot[wrong]]
            wrong = wrong[(at[wrong] >= 0) & (self.slot_key[slot[wrong]] != key[wrong])]
        return at


class _Growing:
    """A numpy array that is appended to."""

    def __init__(self, dtype):
        self.data, self.n = np.empty(1 << 12, dtype), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.resize(self.data, 2 * (self.n + len(values)))
        self.data[self.n:self.n + len(values)] = values
        self.n += len(values)


class Sampler:
    """Filtered units. A state is a place in a unit; its arcs are the pieces that may end there, each with the state it
    came from. Sampling walks from the unit's end to its start (state -1)."""

    def __init__(self, vocabulary: Vocabulary, kept_units: int = _KEPT_UNITS):
        self.vocabulary, self.kept_units = vocabulary, kept_units
        self.forget()

    def forget(self) -> None:
        self.units: dict[str, int] = {}                       # a unit's last state
        self.first = _Growing(np.int32)                       # a state's first arc
        self.cumulative, self.source, self.piece = _Growing(np.float32), _Growing(np.int32), _Growing(np.int32)

    def filter(self, units: list[str]) -> None:
        """Forward filtering of new units, all at once, place by place."""
        v = self.vocabulary
        written = [u if u[:1] == "\n" else MARK + u for u in units]
        size = np.fromiter(map(len, written), np.int64, len(written))
        chars = np.frombuffer("".join(written).encode("utf-32-le"), np.uint32).astype(np.uint64)
        begin = np.cumsum(size) - size                        # of each unit in chars
        unit = np.repeat(np.arange(len(units)), size)
        inside = np.arange(len(chars)) - begin[unit]          # place of each character in its unit
        literal = (chars == ord(MARK)) & (inside > 0)
        chars = np.where(literal, np.uint64(_LITERAL), chars)
        node = np.arange(len(chars)) + unit                   # the state before each character; each unit has one more
        ends, starts, pieces, logs = [], [], [], []
        at, key = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        single = np.zeros(len(chars), bool)
        for n in range(1, v.longest + 1):
            fits = inside[at] + n <= size[unit[at]]
            at, key = at[fits], key[fits]
            if not len(at):
                break
            key = v.extend(key, chars[at + n - 1])
            found = v.find(key)
            hit = found >= 0
            if n == 1:
                single[at[hit]] = True
            starts.append(node[at[hit]])
            ends.append(node[at[hit]] + n)
            pieces.append(v.ids[found[hit]])
            logs.append(v.log[found[hit]])
        states = len(chars) + len(units)
        # characters without a piece: a chain of bytes, filtered as one arc
        chain_state, chain_source, chain_piece = [], [], []
        byte_end, byte_start, byte_source, byte_piece, byte_log = [], [], [], [], []
        for c in np.flatnonzero(~single).tolist():
            raw = (MARK if chars[c] == _LITERAL else chr(int(chars[c]))).encode()
            back = int(node[c])
            for value in raw[:-1]:
                chain_state.append(states)
                chain_source.append(back)
                chain_piece.append(v.byte_ids[value])
                back, states = states, states + 1
            for column, value in zip((byte_end, byte_start, byte_source, byte_piece, byte_log),
                                     (node[c] + 1, node[c], back, v.byte_ids[raw[-1]], v.byte_log * len(raw))):
                column.append(value)
        end, start, source, piece = (np.concatenate([*x, np.array(y, np.int64)]) for x, y in (
            (ends, byte_end), (starts, byte_start), (starts, byte_source), (pieces, byte_piece)))
        log = np.concatenate([*logs, byte_log])
        nodes = len(chars) + len(units)
        place = np.zeros(nodes, np.int64)
        place[node + 1] = inside + 1
        order = np.argsort(place[end] * nodes + end, kind="stable")   # arcs of a state stay in order of length
        end, start, source, piece, log = (x[order] for x in (end, start, source, piece, log))
        total = np.zeros(nodes)
        chance = np.empty(len(end))
        cuts = np.flatnonzero(np.diff(place[end], prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(end)]):
            if place[end[a]] > _LONG_UNIT:                    # far places of long units, in whatever batch
                self._filter_place(end[a:b].tolist(), start[a:b].tolist(), log[a:b].tolist(), total, chance, a)
                continue
            weight = total[start[a:b]] + log[a:b]
            heads = np.flatnonzero(np.diff(end[a:b], prepend=-1))
            most = np.maximum.reduceat(weight, heads)
            length = np.diff(heads, append=b - a)
            share = np.exp(weight - np.repeat(most, length))
            whole = np.add.reduceat(share, heads)
            total[end[a:b][heads]] = most + np.log(whole)
            chance[a:b] = share / np.repeat(whole, length)
        if chain_state:
            end = np.concatenate([end, chain_state])
            source = np.concatenate([source, chain_source])
            piece = np.concatenate([piece, np.array(chain_piece, np.int32)])
            chance = np.concatenate([chance, np.ones(len(chain_state))])
        heads = np.flatnonzero(np.diff(end, prepend=-1))
        length = np.diff(heads, append=len(end))
        cumulative = chance                                   # summed arc by arc: the same bits in any batch
        for k in range(1, length.max()):
            more = heads[length > k] + k
            cumulative[more] += cumulative[more - 1]
        cumulative[heads + length - 1] = 2                    # the last arc takes what rounding leaves
        first = np.full(states, -1, np.int64)
        first[end[heads]] = heads + self.cumulative.n
        origin = np.zeros(states, bool)
        origin[begin + np.arange(len(units))] = True          # a unit's start
        base = self.first.n
        self.source.add(np.where(origin[source], -1, source + base))
        self.first.add(first)
        self.cumulative.add(cumulative)
        self.piece.add(piece)
        self.units.update(zip(units, (base + begin + size + np.arange(len(units))).tolist()))

    @staticmethod
    def _filter_place(end: list, start: list, log: list, total: np.ndarray, chance: np.ndarray, at: int) -> None:
        """The arcs of one place, state by state: totals of the states, chances from place ``at`` of ``chance`` on."""
        k = 0
        while k < len(end):
            j = k + 1
            while j < len(end) and end[j] == end[k]:
                j += 1
            weight = [total.item(start[m]) + log[m] for m in range(k, j)]
            most = max(weight)
            share = [math.exp(w - most) for w in weight]
            whole = sum(share)
            total[end[k]] = most + math.log(whole)
            for m, x in enumerate(share, at + k):
                chance[m] = x / whole
            k = j

    def _walk(self, state: int, stream: int) -> list[int]:
        """Pieces of one unit from its end to its start; the same draws as those of ``sample``."""
        first, cumulative, source, piece = (x.data for x in (self.first, self.cumulative, self.source, self.piece))
        mask, step, pieces = (1 << 64) - 1, 0, []
        while state >= 0:
            step += 1
            x = stream + step * int(_STEP) & mask
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
            x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
            draw = ((x ^ x >> 31) >> 40) / (1 << 24)
            arc = first.item(state)
            while draw >= cumulative.item(arc):
                arc += 1
            pieces.append(piece.item(arc))
            state = source.item(arc)
        return pieces

    def states(self, units: list[str]) -> np.ndarray:
        """The last state of each unit; unknown ones are filtered."""
        found = list(map(self.units.get, units))
        if None in found:
            at = [k for k, state in enumerate(found) if state is None]
            missing = {units[k] for k in at}
            if len(self.units) + len(missing) > self.kept_units or self.first.n > _KEPT_STATES:
                self.forget()
                missing, at = set(units), range(len(units))
            self.filter(list(missing))
            for k in at:
                found[k] = self.units[units[k]]
        return np.array(found, np.int64)

    def sample(self, units: list[str], seeds: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all units in order, pieces in each unit); a draw depends on seed, place and step alone."""
        state = self.states(units)
        first, cumulative, source, piece = (x.data for x in (self.first, self.cumulative, self.source, self.piece))
        stream = (seeds + _SEED) * _SEED ^ (places + np.uint64(1)) * _UNIT
        active, drawn, step, long = np.arange(len(units)), [], 0, {}
        counts = np.zeros(len(units), np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        for k in np.flatnonzero(sizes > _LONG_UNIT).tolist():            # one by one: they would walk on alone anyway
            long[k] = self._walk(int(state[k]), int(stream[k]))
            counts[k] = len(long[k])
        short = sizes <= _LONG_UNIT
        active, state, stream = active[short], state[short], stream[short]
        while len(active):
            step += 1
            x = stream + np.uint64(step * int(_STEP) & (1 << 64) - 1)
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            draw = ((x ^ x >> np.uint64(31)) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)
            arc = first[state]
            beyond = np.flatnonzero(draw >= cumulative[arc])
            while len(beyond):
                arc[beyond] += 1
                beyond = beyond[draw[beyond] >= cumulative[arc[beyond]]]
            drawn.append((active, piece[arc]))
            counts[active] = step
            state = source[arc]
            going = state >= 0
            active, state, stream = active[going], state[going], stream[going]
        out = np.empty(counts.sum(), np.int32)
        after = np.cumsum(counts)
        for k, (who, what) in enumerate(drawn):               # drawn from the end backwards
            out[after[who] - 1 - k] = what
        for k, pieces in long.items():
            out[after[k] - counts[k]:after[k]] = pieces[::-1]
        return out, counts


def units_of(text: str) -> list[str]:
    """Units of a text: one for each blank-led word (without its blank) and for each line feed with what follows it."""
    return text.replace("\n", " \n").split(" ") if text else []


@lru_cache(2)
def _sampler(path: str, alpha: float) -> Sampler:
    return Sampler(Vocabulary(path, alpha))


def _parts(units: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of units that together have at most ``_CHUNK_UNITS`` units and ``_CHUNK_CHARS`` characters, or are one unit."""
    begin = size = 0
    for k, unit in enumerate(units):
        if k > begin and (k - begin == _CHUNK_UNITS or size + len(unit) > _CHUNK_CHARS):
            yield begin, k
            begin, size = k, 0
        size += len(unit)
    if units:
        yield begin, len(units)


def sample_texts(sampler: Sampler, texts: list[str | None], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of all texts, pieces in each text). Long texts are sampled part by part, whole texts all the same."""
    counts = np.zeros(len(texts), np.int64)
    found, units, owner, places, chars = [], [], [], [], 0

    def flush() -> None:
        if units:
            own = np.repeat(*map(np.array, zip(*owner)))
            out, n = sampler.sample(units, seeds[own], np.concatenate(places).astype(np.uint64))
            found.append(out)
            np.add.at(counts, own, n)
            for x in (units, owner, places):
                x.clear()

    for k, text in enumerate(texts):
        all_units = units_of(text) if text else []
        for i, j in _parts(all_units):
            part = all_units[i:j]
            size = sum(map(len, part))
            if len(units) + len(part) > _CHUNK_UNITS or chars + size > _CHUNK_CHARS:
                flush()
                chars = 0
            chars += size
            units += part
            owner.append((k, len(part)))
            places.append(np.arange(i, j))
    flush()
    return np.concatenate([np.empty(0, np.int32), *found]), counts


def encode(text: Column, key: Column, path: str, alpha: float = 1.0, seed: int = 0) -> Column:
    """Column of sampled piece ids (array of int). Null texts give null, empty ones an empty array."""

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array, keys: pa.Array) -> pa.Array:
        seeds = keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        out, counts = sample_texts(_sampler(path, alpha), texts.to_pylist(), seeds)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out), mask=pa.compute.is_null(texts))

    # not that it were random: so marked, Spark computes it once where several columns are made from it
    return of.asNondeterministic()(text, F.xxhash64(F.lit(seed), key))


def join_pieces(table: list[bytes], ids) -> str:
    return b"".join(map(table.__getitem__, ids)).decode()[1:]     # the first blank was put in front


def decode(ids: Column, path: str) -> Column:
    """Column of texts from arrays of piece ids. Null gives null."""

    @F.arrow_udf("string")
    def of(lists: pa.Array) -> pa.Array:
        table = _sampler(path, 1.0).vocabulary.bytes
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        valid = lists.is_valid().to_pylist()
        return pa.array((join_pieces(table, values[a:b].tolist()) if ok else None
                         for a, b, ok in zip(ends, ends[1:], valid)), pa.string())

    return of(ids)


def segmentations(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", alpha: float = 1.0,
                  seed: int = 0) -> DataFrame:
    """(doc_id, text, piece_ids, decoded) for every row, in the order of nothing: repeated rows are cut alike, because
    the id seeds them; rows without an id share a seed. An empty table gives no rows."""
    small_batches(docs.sparkSession)
    cut = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                      encode(F.col(text_col), F.col(id_col), path, alpha, seed).alias("piece_ids"))
    return cut.withColumn("decoded", decode(F.col("piece_ids"), path))
