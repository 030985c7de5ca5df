"""Language-model scores of texts by deleted interpolation.

The model mixes maximum-likelihood estimates of all orders: ``P(w | context) = sum of weight(bucket, k) * c(k-gram) /
c(its context)``, down to the share of ``w`` in all tokens and one over the vocabulary. Weights depend on the bucket of
the context: the longest suffix that was seen, and the power of two of its frequency. They are learned by
expectation-maximisation on a fold of the training texts whose own counts are deleted from the estimates.

How counts reach texts: texts are cut into slices of bounded size, each with its own word list. A slice asks for the
counts of its distinct n-grams, as sorted keys dealt by range; every range adds up what all slices report for it and
answers each slice in its order. So an n-gram travels once per slice, however frequent it is, no key is hot, and no model
is ever gathered in one place. Words have keys of 64 bits (two of 10^9 words share one with a probability of 0.03),
longer n-grams of 56 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from nightjar.llm.common import written
from nightjar.llm.packed import END, STEP, mixed, pack, pack_sorted, unpack, unpack_sorted
from nightjar.llm.words import word_codes

ORDER = 2
FOLD = 16  # one text in so many (by its content, so that exact copies stay together) is held out to learn the weights
SLICE_BYTES = 8_000_000  # of text per slice; a longer text is a slice of its own
PART_ENTRIES = 1_000_000  # keys of all slices that one task adds up
RUN_TOKENS = 200_000  # of whole texts scored at once
ROUNDS, CHANGE = 40, 1e-3  # expectation-maximisation ends when no weight moves by more
BUCKETS = 64  # powers of two per context length
HELD_OUT, TRAIN, DELETED = 0, 1, 2


# ------------------------------------------------------------------------------------------------ n-grams of a slice
def gram_keys(tokens: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, k: int) -> np.ndarray:
    """Key of the k-gram (k above 1) that ends at each token; before a text stands its end token. The low byte is 0."""
    place = np.arange(len(tokens), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
    key = np.full(len(tokens), np.uint64(k))
    for lag in reversed(range(k)):
        back = np.full(len(tokens), hashes[-1])
        back[lag:] = hashes[tokens[:len(tokens) - lag]]
        back[place < lag] = hashes[-1]
        key = mixed(key * STEP + back)
    return key & ~np.uint64(0xFF)


def distinct_grams(tokens: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For k = 1 to ``order``: the sorted keys of a slice, and the place of each token's k-gram among them."""
    words = mixed(hashes) | np.uint64(1)
    by_key = np.argsort(words, kind="stable")
    rank = np.empty(len(words), dtype=np.int32)
    rank[by_key] = np.arange(len(words), dtype=np.int32)
    yield words[by_key], rank[tokens]
    for k in range(2, order + 1):
        distinct, place = np.unique(gram_keys(tokens, lengths, hashes, k), return_inverse=True)
        yield distinct, place.astype(np.int32)


def word_hashes(words: bytes) -> np.ndarray:
    """One per word of a list, and that of the end token."""
    text = pa.Codec("zstd", 1).decompress(words[8:], int.from_bytes(words[:8], "little"), asbytes=True)
    own = [xxhash.xxh64_intdigest(w) for w in text.split(b"\n")] if text else []
    return np.array([*own, int(END)], dtype=np.uint64)


def contexts(counts: list[np.ndarray], lengths: np.ndarray) -> list[np.ndarray]:
    """How often the context of each k-gram (k = 2 on) occurs: the (k-1)-gram before; at a text's start, the number of texts."""
    starts, out = np.cumsum(lengths) - lengths, []
    for shorter in counts[:-1]:
        before = np.concatenate([shorter[:1], shorter[:-1]])
        before[starts] = counts[0][lengths[:1] - 1]  # the first text's end token, whose count is that of all texts
        out.append(before)
    return out


def slice_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``SLICES``: token numbers, word list, lengths and roles of the texts of each slice."""
    n, task = 0, TaskContext.get().partitionId()
    for batch in batches:
        sizes = np.cumsum(np.asarray(pc.binary_length(batch.column("text")), dtype=np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(sizes // SLICE_BYTES)) + 1).tolist(), batch.num_rows]
        for part in (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if a < b):
            codes, offsets, words = word_codes(pc.ascii_lower(pc.fill_null(part.column("text"), "")))
            lengths = np.diff(offsets) + 1
            tokens = np.full(int(lengths.sum()), len(words), dtype=np.int32)
            is_word = np.ones(len(tokens), dtype=bool)
            is_word[np.cumsum(lengths) - 1] = False
            tokens[is_word] = codes
            roles = np.asarray(part.column("role"), dtype=np.int32)
            text = b"\n".join(w.encode() for w in words.to_pylist())
            yield pa.RecordBatch.from_pydict({
                "slice": pa.array([(task << 24) + n], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id")), "roles": pa.array([roles]),
                "lengths": pa.array([lengths]), "codes": pa.array([pack(tokens)]),
                "words": pa.array([len(text).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(text, asbytes=True)]),
                "tokens": pa.array([len(tokens)], pa.int64()), "train": pa.array([int(lengths[roles >= TRAIN].sum())], pa.int64()),
                "deleted": pa.array([int(lengths[roles == DELETED].sum())], pa.int64()),
            })
            n += 1


def unpacked(row: dict, order: int) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Lengths of the texts, role of each token, and the k-grams of a slice, order by order."""
    lengths = np.array(row["lengths"], dtype=np.int64)
    roles = np.repeat(np.array(row["roles"], dtype=np.int8), lengths)
    return lengths, roles, distinct_grams(unpack(row["codes"]).astype(np.int32), lengths, word_hashes(row["words"]), order)


def ask(order: int, parts: int) -> Callable:
    """Rows (part, slice, keys, train, deleted): the distinct k-grams of a slice with its own counts, order by order, by key range."""
    width = (1 << 64) // parts + 1
    borders = np.array([p * width for p in range(1, parts)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, roles, grams = unpacked(row, order)
                told: list[list[tuple[bytes, bytes, bytes]]] = [[] for _ in range(parts)]
                for distinct, place in grams:
                    train, deleted = (np.bincount(place[mask], minlength=len(distinct)) for mask in (roles >= TRAIN, roles == DELETED))
                    cuts = np.searchsorted(distinct, borders).tolist()
                    for p, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(distinct)], strict=True)):
                        told[p].append((pack_sorted(distinct[a:b]), pack(train[a:b]), pack(deleted[a:b])))
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(range(parts), pa.int32()), "slice": pa.array([row["slice"]] * parts, pa.int64()),
                    **{name: pa.array([[t[i] for t in own] for own in told]) for i, name in enumerate(("keys", "train", "deleted"))}})

    return run


def answer(asked: pa.Table) -> pa.Table:
    """Counts over all slices for every slice of one key range, and the number of distinct training words in it."""
    keys = [unpack_sorted(k) for row in asked["keys"].to_pylist() for k in row]
    ends, times = np.cumsum([len(k) for k in keys]), len(keys) // asked.num_rows
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    place = place.astype(np.int32)
    own, vocabulary = [], 0
    for name in ("train", "deleted"):
        total, start = np.zeros(len(distinct), dtype=np.int64), 0
        for told in (unpack(v.as_py()).astype(np.int64) for row in asked[name] for v in row):
            np.add.at(total, place[start:start + len(told)], told)
            start += len(told)
        if name == "train":
            vocabulary = int(((distinct & np.uint64(1) == 1) & (total > 0)).sum())
        packed = [pack(total[place[a:b]]) for a, b in zip([0, *ends], ends, strict=False)]
        own.append([*[packed[i:i + times] for i in range(0, len(packed), times)], None])
    part = asked["part"][0].as_py()
    return pa.table({
        "slice": pa.array([*asked["slice"].to_pylist(), -1 - part], pa.int64()), "part": pa.array([part] * len(own[0]), pa.int32()),
        "train": pa.array(own[0], pa.list_(pa.binary())), "deleted": pa.array(own[1], pa.list_(pa.binary())),
        "vocabulary": pa.array([0] * asked.num_rows + [vocabulary], pa.int64())})


def take_home(order: int) -> Callable:
    """One row per slice with the counts of all its k-grams, token by token; rows of ``answer`` about words pass through."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            n = answers.num_rows
            return pa.table({"ids": pa.nulls(n, texts.schema.field("ids").type), "roles": pa.nulls(n, pa.list_(pa.int32())), "lengths": pa.nulls(n, pa.list_(pa.int64())),
                             "counts": pa.nulls(n, pa.list_(pa.binary())), "kept": pa.nulls(n, pa.list_(pa.binary())), "vocabulary": answers["vocabulary"]})
        lengths, roles, grams = unpacked(texts.to_pylist()[0], order)
        answers = answers.sort_by("part")
        told = {c: answers[c].to_pylist() for c in ("train", "deleted")}
        fold, counts, kept = roles == DELETED, [], []
        for k, (distinct, place) in enumerate(grams):
            total, deleted = (np.concatenate([unpack(row[k]) for row in told[c]]).astype(np.int64) for c in ("train", "deleted"))
            if len(total) != len(distinct):
                raise ValueError("a slice has not got all its counts")
            counts.append(pack(total[place]))
            kept.append((total - deleted)[place[fold]])
        own = lengths[np.array(texts["roles"][0].as_py()) == DELETED]
        context = contexts(kept, own)
        return pa.table({
            "ids": texts["ids"], "roles": texts["roles"], "lengths": texts["lengths"], "counts": pa.array([counts]),
            "kept": pa.array([[pack(v) for v in [*kept, *context]]]), "vocabulary": pa.array([0], pa.int64())})

    return run


# ------------------------------------------------------------------------------------------------ the mixture
def buckets(context: list[np.ndarray], total: int, n: int) -> np.ndarray:
    """Number of the bucket of each token: length of the longest seen context and the power of two of its frequency."""
    out = np.full(n, 0 if total == 0 else BUCKETS, dtype=np.int64)
    for k, c in enumerate(context):
        out = np.where(c > 0, (k + 2) * BUCKETS + np.log2(np.maximum(c, 1)).astype(np.int64), out)
    return out


def estimates(counts: list[np.ndarray], context: list[np.ndarray], total: int, vocabulary: int) -> list[np.ndarray]:
    """Maximum-likelihood estimates of each token: one over the vocabulary, its share of all tokens, then by longer contexts."""
    n = len(counts[0])
    out = [np.full(n, 1 / (vocabulary + 1)), counts[0] / max(total, 1)]
    out += [np.where(c > 0, own / np.maximum(c, 1), 0.0) for own, c in zip(counts[1:], context, strict=True)]
    return out


def first_weights(order: int) -> np.ndarray:
    """Equal weights for the orders that a bucket's context can have."""
    out = np.zeros(((order + 1) * BUCKETS, order + 1))
    for k in range(order + 1):
        out[k * BUCKETS:(k + 1) * BUCKETS, :k + 1] = 1 / (k + 1)
    return out


def held_rows(order: int, total: int, vocabulary: int) -> Callable:
    """Rows (bucket, p0, p1, ...) of the tokens of the deleted fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("kept").to_pylist():
                numbers = [unpack(v).astype(np.int64) for v in data]
                counts, context = numbers[:order], numbers[order:]
                p = estimates(counts, context, total, vocabulary)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(buckets(context, total, len(counts[0])), pa.int32()), **{f"p{k}": v for k, v in enumerate(p)}})

    return run


def learn(held: DataFrame, order: int) -> np.ndarray:
    """Mixture weights per bucket that make the held-out tokens most probable; buckets without any take their neighbour's.

    One aggregate per round; only sums per bucket reach the driver.
    """
    weights, spark = first_weights(order), held.sparkSession
    names = [f"w{k}" for k in range(order + 1)]
    seen: dict[int, np.ndarray] = {}
    for _ in range(ROUNDS):
        table = spark.createDataFrame([(b, *map(float, w)) for b, w in enumerate(weights)], "bucket int, " + ", ".join(f"{w} double" for w in names))
        joint = [F.col(f"w{k}") * F.col(f"p{k}") for k in range(order + 1)]
        whole = sum(joint[1:], joint[0])
        sums = held.join(F.broadcast(table), "bucket").groupBy("bucket").agg(*[F.sum(j / whole).alias(w) for j, w in zip(joint, names, strict=True)]).collect()
        seen = {r["bucket"]: np.array([r[w] for w in names]) for r in sums}
        moved = 0.0
        for b, s in seen.items():
            new = s / s.sum()
            moved, weights[b] = max(moved, float(np.abs(new - weights[b]).max())), new
        if moved < CHANGE:
            break
    for level in range(1, order + 1):
        own = [b for b in seen if b // BUCKETS == level]
        for b in range(level * BUCKETS, (level + 1) * BUCKETS):
            if own and b not in seen:
                weights[b] = weights[min(own, key=lambda o, b=b: (abs(o - b), o))]
    return weights


def score_slices(order: int, weights: np.ndarray, total: int, vocabulary: int, key: str) -> Callable:
    def scored(ids: pa.Array, roles: np.ndarray, lengths: np.ndarray, counts: list[np.ndarray]) -> pa.RecordBatch:
        context = contexts(counts, lengths)
        bucket = buckets(context, total, len(counts[0]))
        p = sum(weights[bucket, k] * v for k, v in enumerate(estimates(counts, context, total, vocabulary)))
        starts = np.cumsum(lengths) - lengths
        add = lambda v: np.add.reduceat(v, starts)
        return pa.RecordBatch.from_pydict({
            key: ids, "held_out": pa.array(roles == HELD_OUT), "n_tokens": pa.array(lengths, pa.int64()),
            "n_known": pa.array(add((counts[0] > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(lengths), total, dtype=np.int64)),
            "base_score": add(np.log10((counts[0] + 1) / (total + vocabulary + 1))), "score": add(np.log10(p))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, roles = (np.asarray(batch.column(c)[i].values) for c in ("lengths", "roles"))
                counts = [unpack(v.as_py()).astype(np.int64) for v in batch.column("counts")[i]]
                ends = np.cumsum(lengths)
                a = start = 0
                while a < len(lengths):
                    b = max(a + 1, int(np.searchsorted(ends, start + RUN_TOKENS, side="right")))
                    yield scored(batch.column("ids")[i].values[a:b], roles[a:b], lengths[a:b], [v[start:ends[b - 1]] for v in counts])
                    a, start = b, int(ends[b - 1])

    return run


def score_texts(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """``(key, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every text; ``training`` tells whose texts teach.

    Tokens are words in ASCII lower case, then one end token. Null texts are empty: one end token. A null in ``training``
    counts as true; null keys and repeated rows are rows like any other. Very long texts are slices of their own. Without
    training texts every token has probability one. If no text falls into the deleted fold, all orders weigh the same.
    Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    if order < 1:
        raise ValueError("an n-gram has one word at least")
    told = F.coalesce(F.col(text), F.lit(""))
    role = F.when(~F.coalesce(training, F.lit(True)), HELD_OUT).when(F.crc32(F.encode(told, "UTF-8")) % FOLD == 0, DELETED).otherwise(TRAIN)
    kind = docs.schema[key].dataType.simpleString()
    sliced = written(docs.select(F.col(key).alias("id"), told.alias("text"), role.cast("int").alias("role")).mapInArrow(
        slice_texts, f"slice long, ids array<{kind}>, roles array<int>, lengths array<long>, codes binary, words binary, tokens long, train long, deleted long"), "slices")
    sizes = sliced.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "train", "deleted")]).first()
    parts = max(1, -(-sizes["tokens"] * order // PART_ENTRIES))
    answers = sliced.mapInArrow(ask(order, parts), "part int, slice long, keys array<binary>, train array<binary>, deleted array<binary>").groupBy("part").applyInArrow(
        answer, "slice long, part int, train array<binary>, deleted array<binary>, vocabulary long")
    counted = written(sliced.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(
        take_home(order), f"ids array<{kind}>, roles array<int>, lengths array<long>, counts array<binary>, kept array<binary>, vocabulary long"), "counted")
    vocabulary = counted.agg(F.coalesce(F.sum("vocabulary"), F.lit(0)).alias("v")).first()["v"]
    slices_only = counted.where("counts IS NOT NULL")
    weights = first_weights(order)
    if sizes["deleted"]:
        schema = "bucket int, " + ", ".join(f"p{k} double" for k in range(order + 1))
        weights = learn(written(slices_only.select("kept").mapInArrow(held_rows(order, sizes["train"] - sizes["deleted"], vocabulary), schema), "held"), order)
    return slices_only.select("ids", "roles", "lengths", "counts").mapInArrow(
        score_slices(order, weights, sizes["train"], vocabulary, key),
        f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
