import re
import tracemalloc
import zlib
from collections import Counter
from math import isclose, log2, log10

import edge
import numpy as np
import pytest
from nightjar.llm import lm_scoring, queries
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Brute:
    """The model with dictionaries, text by text."""

    def __init__(self, rows, order, train):
        self.order = order
        self.texts = [(i, [*WORD.findall((t or "").translate(UPPER)), None], train(i), zlib.crc32((t or "").encode()) % lm_scoring.FOLD == 0) for i, t in rows]
        self.all = self.count([w for _, w, t, _ in self.texts if t])
        kept = self.count([w for _, w, t, f in self.texts if t and not f])
        self.vocabulary = len({g for g in self.all[0] if len(g) == 1})
        self.weights = self.learn([w for _, w, t, f in self.texts if t and f], kept)

    def grams(self, words, i):
        padded = [None] * self.order + words
        at = i + self.order
        return [tuple(padded[at - k:at + 1]) for k in range(self.order)]

    def count(self, texts):
        grams, context, total = Counter(), Counter(), 0
        for words in texts:
            for i in range(len(words)):
                total += 1
                for g in self.grams(words, i):
                    grams[g] += 1
                    context[g[:-1]] += len(g) > 1
        return grams, context, total

    def parts(self, words, i, counts):
        grams, context, total = counts
        p, bucket = [1 / (self.vocabulary + 1), grams[(words[i],)] / max(total, 1)], (0 if total == 0 else 1, 0)
        for g in self.grams(words, i)[1:]:
            c = context[g[:-1]]
            p.append(grams[g] / c if c else 0.0)
            bucket = (len(g), int(log2(c))) if c else bucket
        return bucket, p

    def learn(self, held, kept):
        rows = Counter((b, tuple(p)) for words in held for i in range(len(words)) for b, p in [self.parts(words, i, kept)])
        weights = {}
        start = lambda b: [1 / (b[0] + 1) if k <= b[0] else 0.0 for k in range(self.order + 1)]
        for _ in range(lm_scoring.ROUNDS):
            sums, moved = {}, 0
            for (b, p), n in rows.items():
                joint = [w * v for w, v in zip(weights.get(b, start(b)), p, strict=True)]
                sums[b] = [s + n * j / sum(joint) for s, j in zip(sums.get(b, [0] * len(p)), joint, strict=True)]
            for b, s in sums.items():
                new = [v / sum(s) for v in s]
                moved = max(moved, max(abs(x - y) for x, y in zip(new, weights.get(b, start(b)), strict=True)))
                weights[b] = new
            if moved < lm_scoring.CHANGE:
                break

        def pick(b):
            own = [o for o in weights if o[0] == b[0]] if b[0] else []
            return weights[min(own, key=lambda o: (abs(o[1] - b[1]), o[1]))] if own else start(b)
        return pick

    def score(self, words):
        base = score = known = 0
        for i in range(len(words)):
            c = self.all[0][(words[i],)]
            bucket, p = self.parts(words, i, self.all)
            known += c > 0
            base += log10((c + 1) / (self.all[2] + self.vocabulary + 1))
            score += log10(sum(w * v for w, v in zip(self.weights(bucket), p, strict=True)))
        return len(words), known, self.all[2], base, score


def taught(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 != 2


def same(got, rows, order, train=taught):
    model = Brute(rows, order, train)
    want = sorted(((i is None, i or 0), not t, *model.score(w)) for i, w, t, _ in model.texts)
    have = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
    assert len(have) == len(want)
    for a, b in zip(have, want, strict=True):
        assert a[:5] == b[:5] and isclose(a[5], b[5], rel_tol=1e-9) and isclose(a[6], b[6], rel_tol=1e-6), (a, b)
    return have


def training(key="doc_id"):
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 7 != 2


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_against_the_definition(spark, monkeypatch, order):
    monkeypatch.setattr(lm_scoring, "PART_ENTRIES", 500)
    monkeypatch.setattr(lm_scoring, "SLICE_BYTES", 900)
    rng = np.random.default_rng(13)
    words = [f"W{i}" for i in range(40)]
    rows = []
    for i in range(200):
        at, text = int(rng.integers(40)), []
        for _ in range(int(rng.integers(0, 60))):
            at = (at * 3 + int(rng.integers(3))) % 40 if rng.random() < 0.9 else int(rng.integers(40))
            text.append(words[at].lower() if rng.random() < 0.5 else words[at])
        rows.append((i, " ".join(text)))
    rows += [(300 + i, rows[5][1]) for i in range(60)] + [(400, None), (401, "wholly new words"), (402, "É W1")]
    have = same(lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), training(), order=order).collect(), rows, order)
    if order > 1:  # context helps on texts the model has not seen
        assert sum(r[6] for r in have if r[1]) > 1.05 * sum(r[5] for r in have if r[1])


def test_query_on_the_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    same(queries.op13_lm_scoring(spark, "/root/testdata/sf0.001").collect(), rows, lm_scoring.ORDER)


def test_probabilities_add_up_to_one():
    rows = [(i, " ".join("abcd"[(i * k) % 4] for k in range(i % 9))) for i in range(80)]
    model = Brute(rows, 2, taught)
    for context in ("a", "b", None, "unseen"):
        total = 0
        for w in ["a", "b", "c", "d", None, "unknown"]:
            words = [context, w] if context else [w]
            bucket, p = model.parts(words, len(words) - 1, model.all)
            total += sum(x * y for x, y in zip(model.weights(bucket), p, strict=True))
        assert isclose(total, 1, rel_tol=1e-12)


def test_edge_rows(spark):
    rows = [(r[0], r[1]) for r in edge.rows()]
    same(lm_scoring.score_texts(edge.table(spark), training()).collect(), rows, 2)
    assert lm_scoring.score_texts(edge.table(spark, []), training()).count() == 0
    none = lm_scoring.score_texts(edge.table(spark), F.lit(False)).collect()
    assert len(none) == len(rows) and all(r["held_out"] and r["n_known"] == r["train_tokens"] == r["score"] == r["base_score"] == 0 for r in none)


def test_packing_gives_back_the_numbers():
    values = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert (lm_scoring.unpack_sorted(lm_scoring.pack_sorted(values)) == values).all() and len(lm_scoring.unpack(lm_scoring.pack(values[:0]))) == 0


def test_scoring_a_slice_takes_memory_by_the_run():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 400, 6_000)
    n = int(lengths.sum())
    counts = [rng.integers(0, 500, n), rng.integers(0, 30, n)]
    batch = lm_scoring.pa.RecordBatch.from_pydict({
        "ids": [list(range(len(lengths)))], "roles": [[1] * len(lengths)], "lengths": [lengths.tolist()], "counts": [[lm_scoring.pack(c) for c in counts]]})
    score = lm_scoring.score_slices(2, lm_scoring.first_weights(2), 10**6, 1_000, "doc_id")
    tracemalloc.start()
    rows = sum(out.num_rows for out in score(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(lengths) and peak < 6 * 8 * n
