import zlib
from hashlib import sha256

import edge
import pytest
from nightjar.llm import merkle
from pyspark.sql import functions as F


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves):
    """Root of a list of digests, and for each of them the siblings (left, right) of every level."""
    paths, owners, level = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(level) > 1:
        runs = [range(s, min(s + 16, len(level))) for s in range(0, len(level), 16)]
        for run in runs:
            for at in run:
                step = ("".join(level[j] for j in run if j < at), "".join(level[j] for j in run if j > at))
                for leaf in owners[at]:
                    paths[leaf].append(step)
        owners = [[leaf for at in run for leaf in owners[at]] for run in runs]
        level = [digest(*[level[j] for j in run]) for run in runs]
    return level[0], paths


def brute(rows, tampered):
    """Per row: id, leaf, subroot, root, digest of the proof, folded root."""
    sources = {}
    for i, text, lang, source, n in rows:
        leaf = lambda t, r=(i, source, lang, n): digest(*map(framed, (*r, t)))
        low = None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        sources.setdefault(source, []).append(((i is not None, i or 0), leaf(text), i, leaf(low) if tampered(i) else leaf(text)))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    roots, paths = [], {}
    for s in order:
        sources[s].sort()
        root, paths[s] = tree([leaf for _, leaf, *_ in sources[s]])
        roots.append(root)
    top, upper = tree(roots)
    out = []
    for s, subroot, above in zip(order, roots, upper, strict=True):
        for (_, leaf, i, own), path in zip(sources[s], paths[s], strict=True):
            path = path + above
            for left, right in path:
                own = digest(left, own, right)
            out.append((i, leaf, subroot, top, digest(*[a + b for a, b in path]), own))
    return sorted(out, key=str)


def fifth(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def run(frame):
    made = merkle.manifest(frame, F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0)
    folded = merkle.fold(F.coalesce("tampered_leaf", "leaf"), F.col("path"))
    got = made.leaves.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), folded).collect()
    return sorted(map(tuple, got), key=str), made


@pytest.mark.parametrize("sizes", [(1,), (15, 16, 17), (255, 256, 257, 1), (600, 4100), (2,) * 40])
def test_trees_of_all_sizes(spark, sizes):
    rows, i = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            i += 1
            rows.append(((i * 7919) % 100_003, f"Text {i % 90}" if i % 11 else "small", "en", f"s{s}" if s else None, i))
    got, made = run(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3))
    assert got == brute(rows, fifth)
    assert made.root.collect()[0]["root"] == got[0][3] and made.subroots.count() == len(sizes)
    if len(rows) > 50:
        assert {r[5] == r[3] for r in got} == {True, False}


def test_edge_rows(spark):
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in edge.rows()]
    got, _ = run(edge.table(spark))
    assert got == brute(rows, fifth)
    nothing = merkle.manifest(edge.table(spark, []))
    assert nothing.leaves.count() == 0 and nothing.root.count() == 0
    assert merkle.manifest(edge.table(spark)).leaves.where("tampered_leaf IS NOT NULL").count() == 0
