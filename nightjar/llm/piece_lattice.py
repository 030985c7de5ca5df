"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

Forward Viterbi scores of all positions are exact heuristics for a backward A-star search, which then pops the N best
segmentations in order without a wasted expansion. Since no piece crosses from a letter into the next space, a text is
a chain of independent units (a word with the spaces before it); the lattice of a text is the chain of the lattices of
its units. Each distinct unit of a batch is solved once, all units of one length together. Per text, the N best follow
from the N - 1 occurrences with the smallest loss to their second segmentation; only those units are searched by A-star,
and their lists are merged by loss.

Scores are integers (millionths of a nat), so sums and ties are exact. Models without segmentation scores (BPE, whose
scores are merge ranks) get Zipf's law over the rank. Equal scores prefer the longer piece, from the end of the text.
A character without a piece becomes byte tokens, also the space mark where a text holds it literally, so decoding
gives back every text exactly.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from nightjar.llm.common import without
from nightjar.llm.words import expand, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, LITERAL = "▁", "\udcff"  # a lone surrogate occurs in no text
NEVER = -(1 << 60)
LONG_UNIT = 64  # longer units are solved one by one
PART_CHARS = 100_000  # of units solved together, so that the arrays of a position stay in the cache
MIX, FILTER_SHIFT = np.uint64(0xD6E8FEB86659FD93), np.uint64(47)  # fingerprint to slot
NBEST = T.ArrayType(T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("edits", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])))]))


def read_model(path: str) -> bytes:
    """The model file, read on the driver and broadcast."""
    with open(path, "rb") as f:
        model = f.read()
    if len(model) > 64_000_000:
        raise ValueError("a model of more than 64 MB is not broadcast")
    return model


class Hypothesis:
    """A suffix of the unit that is already cut: from ``at`` to the end. Ordered by score, then by longer pieces."""

    __slots__ = ("at", "cost", "depth", "done", "length", "rest")

    def __init__(self, at: int, done: int, cost: int, length: int, rest: Hypothesis | None) -> None:
        self.at, self.done, self.cost, self.length, self.rest = at, done, cost, length, rest
        self.depth = rest.depth + 1 if rest else 0

    def __lt__(self, other: Hypothesis) -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        a, b = self, other
        while a.depth > b.depth:
            a = a.rest
        while b.depth > a.depth:
            b = b.rest
        if a is b:
            return self.depth < other.depth
        while a.rest is not b.rest:
            a, b = a.rest, b.rest
        return a.length > b.length


class Lattice:
    """Pieces of one model, and the segmentation of units."""

    def __init__(self, model: bytes, scores: str = "auto") -> None:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = p.get_piece_size()
        names = [p.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.size, self.unknown = size, p.unk_id()
        self.bytes = {int(names[i][1:-1], 16): i for i in range(size) if p.is_byte(i)}
        raw = {i: p.get_score(i) for i in normal}
        ranked = scores == "rank" or scores == "auto" and all(s <= 0 and s == int(s) for s in raw.values())
        if ranked:
            order = {i: n for n, i in enumerate(sorted(normal, key=lambda i: (-raw[i], i)))}
            weight = math.log(sum(1 / (n + 2.7) for n in range(len(normal))))
            nats = {i: -math.log(order[i] + 2.7) - weight for i in normal}
        else:
            nats = raw
        self.pieces = {names[i]: (i, round(nats[i] * 1e6)) for i in normal}
        self.missing = min(s for _, s in self.pieces.values()) - 10_000_000  # for a character without a piece
        self.longest = max(map(len, self.pieces))
        self.text = [b""] * size
        for i in normal:
            self.text[i] = names[i].replace(SPACE, " ").encode()
        for value, i in self.bytes.items():
            self.text[i] = bytes([value])
        crossing = any(SPACE in name.lstrip(SPACE) or "\n" in name for name in self.pieces)
        self.unit = re.compile(r" *[^ \n]+| +|\n") if not crossing else re.compile(r".+", re.S)
        self._index()

    def _index(self) -> None:
        """Per length: sorted fingerprints of pieces, their codes, ids and scores."""
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.by_length = {}
        for length, group in itertools.groupby(sorted(self.pieces, key=lambda x: (len(x), x)), key=len):
            names = list(group)
            codes = np.array([[ord(c) for c in n] for n in names], dtype=np.uint64)
            prints = codes[:, 0].copy()
            for j in range(1, length):
                prints = prints * self.base + codes[:, j]
            order = np.argsort(prints)
            held = [self.pieces[n] for n in names]
            filled = np.zeros(1 << 64 - int(FILTER_SHIFT), bool)  # slots of known fingerprints: most others need no search
            filled[prints * MIX >> FILTER_SHIFT] = True
            self.by_length[length] = (prints[order], codes[order], np.array([h[0] for h in held])[order], np.array([h[1] for h in held])[order], filled)

    def units(self, text: str) -> list[str]:
        """The chain of units of a text, with the mark that SentencePiece puts before it."""
        return self.unit.findall(f" {text}".replace(SPACE, LITERAL)) if text else []

    def edges(self, unit: str, start: int) -> Iterator[tuple[int, int, int]]:
        """(length, id, score) of all pieces that begin at ``start``; a missing character has id -1."""
        single = False
        for length in range(1, min(self.longest, len(unit) - start) + 1):
            found = self.pieces.get(unit[start:start + length])
            if found:
                single |= length == 1
                yield length, *found
        if not single:
            yield 1, -1, self.missing

    def search(self, unit: str, n: int) -> list[tuple[int, list[int]]]:
        """The ``n`` best segmentations (score, lengths) of a unit with marked spaces, best first."""
        best = [NEVER] * (len(unit) + 1)  # score of every prefix
        best[0] = 0
        into: list[list[tuple[int, int]]] = [[] for _ in range(len(unit) + 1)]
        for start in range(len(unit)):
            for length, _, score in self.edges(unit, start):
                into[start + length].append((length, score))
                best[start + length] = max(best[start + length], best[start] + score)
        agenda = [Hypothesis(len(unit), 0, -best[-1], 0, None)]
        out = []
        while agenda and len(out) < n:
            top = heapq.heappop(agenda)
            if top.at == 0:
                lengths, walk = [], top
                while walk.rest:
                    lengths.append(walk.length)
                    walk = walk.rest
                out.append((top.done, lengths))
                continue
            for length, score in into[top.at]:
                done = top.done + score
                heapq.heappush(agenda, Hypothesis(top.at - length, done, -(done + best[top.at - length]), length, top))
        return out

    def ids(self, unit: str, lengths: list[int]) -> list[int]:
        out, at = [], 0
        for length in lengths:
            piece = unit[at:at + length]
            found = self.pieces.get(piece)
            out += [found[0]] if found else self.spelled(piece)
            at += length
        return out

    def spelled(self, char: str) -> list[int]:
        """Byte tokens of one character; the unknown token if the model has no bytes."""
        real = (SPACE if char == LITERAL else char).encode()
        return [self.bytes[b] for b in real] if self.bytes else [self.unknown]

    def solve(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For many marked units at once: starts and ids of their best tokens, best score, and loss of the second best."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        score, loss, counts = np.zeros(len(units), np.int64), np.full(len(units), -NEVER, np.int64), np.zeros(len(units), np.int64)
        single: dict[int, list[int]] = {}
        tables = []
        for i in np.flatnonzero(lengths > LONG_UNIT).tolist():
            found = self.search(units[i], 2)
            score[i], single[i] = found[0][0], self.ids(units[i], found[0][1])
            if len(found) > 1:
                loss[i] = found[0][0] - found[1][0]
        for m in np.unique(lengths[lengths <= LONG_UNIT]).tolist():
            group = np.flatnonzero(lengths == m)
            for part in np.array_split(group, -(-len(group) * m // PART_CHARS)):
                table, score[part], loss[part] = self._solve_equal(units, part, m)
                lacks = (table == -1).any(axis=0)
                for row in np.flatnonzero(lacks).tolist():
                    i = int(part[row])
                    single[i] = self._with_bytes(units[i], table[:, row])
                table, part = table[:, ~lacks], part[~lacks]
                held = table > -2
                counts[part] = held.sum(axis=0)
                tables.append((part, table.T[held.T]))
        for i, own in single.items():
            counts[i] = len(own)
        starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        ids = np.zeros(int(starts[-1]), np.int64)
        for part, flat in tables:
            n = counts[part]
            ids[np.arange(len(flat)) + np.repeat(starts[part] - np.cumsum(n) + n, n)] = flat
        for i, own in single.items():
            ids[starts[i]:starts[i + 1]] = own
        return starts, ids, score, loss

    def _with_bytes(self, unit: str, path: np.ndarray) -> list[int]:
        """The tokens of a unit's path with byte tokens in place of -1; -2 is no token."""
        spell, place = [], 0
        for k in path[path > -2].tolist():
            spell += [k] if k >= 0 else self.spelled(unit[place])
            place += len(self._name(k)) if k >= 0 else 1
        return spell

    def _solve_equal(self, units: list[str], group: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units of one length: Viterbi forwards and backwards over all of them, position by position.

        Returns the tokens of the best paths (one column per unit, -1 for a missing character, -2 for none), best scores, losses.
        """
        n = len(group)
        codes = np.frombuffer("".join(units[i] for i in group.tolist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = codes.reshape(n, m).T.astype(np.uint64, order="C")
        spelled, edge_score, edge_id, live = codes.ravel(), {}, {}, {}
        prints = codes
        for length in range(1, min(m, self.longest) + 1):
            width = m - length + 1
            if length > 1:
                prints = prints[:width] * self.base + codes[length - 1:]
            if length not in self.by_length and length > 1:
                continue
            s, p = np.full(width * n, NEVER, np.int64), np.full(width * n, -1, np.int64)
            if length in self.by_length:
                known, spelling, ids, scores, filled = self.by_length[length]
                mine = prints.ravel()
                place = np.flatnonzero(filled[mine * MIX >> FILTER_SHIFT])
                mine = mine[place]
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                hit = known[at] == mine
                place, at = place[hit], at[hit]
                hit = np.ones(len(place), bool)
                for j in range(length):
                    hit &= spelling[at, j] == spelled[place + j * n]
                place, at = place[hit], at[hit]
                s[place], p[place] = scores[at], ids[at]
            if length == 1:
                s[p < 0] = self.missing
            s = s.reshape(width, n)
            starts = np.flatnonzero((s > NEVER // 2).any(axis=1))
            if len(starts):
                edge_score[length], edge_id[length], live[length] = s, p.reshape(width, n), set(starts.tolist())
        ahead, cut = np.full((m + 1, n), NEVER, np.int64), np.zeros((m + 1, n), np.int64)
        ahead[0] = 0
        for end in range(1, m + 1):
            for length, starts in live.items():
                if end - length in starts:
                    offer = ahead[end - length] + edge_score[length][end - length]
                    better = (offer >= ahead[end]) & (offer > NEVER // 2)
                    np.copyto(ahead[end], offer, where=better)
                    np.copyto(cut[end], length, where=better)
        behind = np.full((m + 1, n), NEVER, np.int64)
        behind[m] = 0
        for start in range(m - 1, -1, -1):
            for length, starts in live.items():
                if start in starts:
                    np.maximum(behind[start], edge_score[length][start] + behind[start + length], out=behind[start])
        best = ahead[m]
        used = {length: np.zeros(s.shape, bool) for length, s in edge_score.items()}
        at, path = np.full(n, m), []
        while (at > 0).any():
            length = np.where(at > 0, cut[at, np.arange(n)], 0)
            token = np.full(n, -2, np.int64)
            for k in np.unique(length[length > 0]).tolist():
                rows = np.flatnonzero(length == k)
                used[k][at[rows] - k, rows] = True
                token[rows] = edge_id[k][at[rows] - k, rows]
            path.append(token)
            at = at - length
        second = np.full(n, NEVER, np.int64)
        for length, s in edge_score.items():
            for start in live[length]:
                through = ahead[start] + s[start] + behind[start + length]
                np.maximum(second, through, out=second, where=~used[length][start] & (s[start] > NEVER // 2))
        return np.stack(path[::-1]), best, np.where(second > NEVER // 2, best - second, -NEVER)

    def _name(self, token: int) -> str:
        return self.text[token].decode()

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of token ids, without the leading mark."""
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


class Places(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def merge_lists(lists: list[list[int]], n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The ``n`` smallest sums (sum, choice) of one loss per list; each list ascends from 0. Ties prefer earlier choices."""
    first = (0,) * len(lists)
    agenda, seen, out = [(0, first)], {first}, []
    while agenda and len(out) < n:
        loss, choice = heapq.heappop(agenda)
        out.append((loss, choice))
        for k, c in enumerate(choice):
            if c + 1 < len(lists[k]):
                nxt = (*choice[:k], c + 1, *choice[k + 1:])
                if nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(agenda, (loss - lists[k][c] + lists[k][c + 1], nxt))
    return out


def encode_texts(lattice: Lattice, texts: list[str | None], n: int) -> Iterator[tuple[np.ndarray | None, list]]:
    """Best ids and the n-best list (score, edits against the best ids) of each text; null gives nulls."""
    place = Places()
    chains = [np.fromiter(map(place.__getitem__, lattice.units(t)), np.int64) if t is not None else None for t in texts]
    marked = [u.replace(" ", SPACE) for u in place]
    starts, ids, score, loss = lattice.solve(marked)
    lists: dict[int, list[tuple[int, list[int]]]] = {}
    for chain in chains:
        if chain is None:
            yield None, None
            continue
        tokens, counts = expand(chain, starts, ids)
        total, own = int(score[chain].sum()), loss[chain]
        open_ = np.flatnonzero(own < -NEVER)
        if n > 1 and len(open_):
            if len(open_) > n - 1:
                edge = np.partition(own[open_], n - 2)[n - 2]
                less, equal = open_[own[open_] < edge], open_[own[open_] == edge]
                open_ = np.sort(np.concatenate([less, equal[:n - 1 - len(less)]]))
            ends = np.cumsum(counts)
            options = []
            for k in open_.tolist():
                code = int(chain[k])
                if code not in lists:
                    lists[code] = lattice.search(marked[code], n)
                options.append(lists[code])
            found = []
            for lost, choice in merge_lists([[o[0][0] - s for s, _ in o] for o in options], n):
                edits = [
                    {"start": int(ends[k] - counts[k]), "length": int(counts[k]), "ids": lattice.ids(marked[int(chain[k])], o[c][1])}
                    for k, o, c in zip(open_.tolist(), options, choice, strict=True) if c]
                found.append({"score": (total - lost) / 1e6, "edits": edits})
        else:
            found = [{"score": total / 1e6, "edits": []}]
        yield tokens, found


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, n: int = 4, scores: str = "auto", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (best segmentation), ``nbest`` (up to ``n``, best first, as edits of the best ids) and ``decoded``
    (whether decoding the ids gives back the text).

    An edit replaces ``length`` ids from ``start`` by its own. A null text has null results, an empty one no ids and a
    single segmentation of score 0. A text with fewer segmentations gives all of them. Rows are independent; repeated
    rows get equal results. Input columns named like a result column are replaced. An empty table gives an empty result.
    """
    docs = without(docs, "ids", "nbest", "decoded")
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model))
    kept = [c for c in docs.columns if keep_text or c != text]
    schema = T.StructType([docs.schema[c] for c in kept] + [
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("nbest", NBEST), T.StructField("decoded", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value, scores)
        edit = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ids", pa.list_(pa.int32()))])
        best = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(edit))]))
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(text).to_pylist()
                ids, found, decoded = [], [], []
                for t, (tokens, nbest) in zip(texts, encode_texts(lattice, texts, n), strict=True):
                    ids.append(None if tokens is None else tokens.astype(np.int32))
                    found.append(nbest)
                    decoded.append(None if tokens is None else lattice.decode(tokens.tolist()) == t)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept] + [pa.array(ids, pa.list_(pa.int32())), pa.array(found, best), pa.array(decoded, pa.bool_())],
                    names=[*kept, "ids", "nbest", "decoded"])

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``tokens`` with ``text``, decoded from ``ids``; null ids give a null text. A column named ``text`` is replaced."""
    tokens = without(tokens, "text")
    shared = tokens.sparkSession.sparkContext.broadcast(read_model(model))
    schema = T.StructType([*tokens.schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        for batch in batches:
            texts = [None if x is None else lattice.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return tokens.mapInArrow(run, schema)
