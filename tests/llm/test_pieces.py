import heapq
import random
import struct

import pytest
from edge import SCHEMA, table
from nightjar.llm import piece_lattice as pl


@pytest.fixture(scope="module")
def lattice():
    return pl.Lattice(pl.read_model(pl.MODEL))


def all_cuts(lattice, unit):
    out = []

    def go(at, score, lengths):
        if at == len(unit):
            out.append((score, lengths))
        else:
            for length, _, s in lattice.edges(unit, at):
                go(at + length, score + s, [*lengths, length])

    go(0, 0, [])
    return sorted(out, key=lambda x: (-x[0], [-n for n in reversed(x[1])]))


def test_units_against_all_segmentations(lattice):
    draw = random.Random(1)
    units = list({"".join(draw.choice(["a", "e", "th", "in", "▁", "on", "\udcff", "é", "😀", "ing"]) for _ in range(draw.randint(1, 5)))[:9] for _ in range(200)})
    starts, ids, score, loss = lattice.solve(units)
    for i, unit in enumerate(units):
        best = all_cuts(lattice, unit)
        assert lattice.search(unit, 5) == best[:5]
        assert score[i] == best[0][0] and ids[starts[i]:starts[i + 1]].tolist() == lattice.ids(unit, best[0][1])
        assert loss[i] == (best[0][0] - best[1][0] if len(best) > 1 else -pl.NEVER)


def test_texts_against_merged_units(lattice):
    for text in ["in the on", " a  b\n\nc ▁ d ", "the the", "😀é▁\t", "bb aa"]:
        ids, found = next(iter(pl.encode_texts(lattice, [text], 6)))
        merged = [0]
        for unit in lattice.units(text):
            scores = [s for s, _ in all_cuts(lattice, unit.replace(" ", pl.SPACE))]
            merged = heapq.nlargest(100, [a + b for a in merged for b in scores])
        assert [round(f["score"] * 1e6) for f in found] == merged[:6]
        for f in found:
            own = ids.tolist()
            for e in reversed(f["edits"]):
                own[e["start"]:e["start"] + e["length"]] = e["ids"]
            assert lattice.decode(own) == text


def test_few_fingerprints_are_searched(lattice, monkeypatch):
    draw = random.Random(3)
    units = list({"▁" + "".join(draw.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(draw.randint(4, 12))) for _ in range(500)})
    substrings = sum(max(0, len(u) - n + 1) for u in units for n in lattice.by_length)
    asked, search = [], pl.np.searchsorted
    monkeypatch.setattr(pl.np, "searchsorted", lambda known, values: asked.append(len(values.ravel())) or search(known, values))
    starts, ids, score, _ = lattice.solve(units)
    assert sum(asked) < substrings / 2
    for i, unit in enumerate(units):
        found = lattice.search(unit, 1)[0]
        assert (score[i], ids[starts[i]:starts[i + 1]].tolist()) == (found[0], lattice.ids(unit, found[1]))


def unigram_model(pieces):
    """A unigram model file with given scores: an independent implementation to compare with."""
    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(field, body):
        return number(field << 3 | 2) + number(len(body)) + body

    out = b""
    for name, score, kind in [("<unk>", 0.0, 2), *[(n, s, 1) for n, s in pieces]]:
        out += message(1, message(1, name.encode()) + number(2 << 3 | 5) + struct.pack("<f", score) + number(3 << 3) + number(kind))
    out += message(2, number(3 << 3) + number(1))
    return out + message(3, message(1, b"identity") + number(3 << 3) + number(1) + number(4 << 3) + number(0) + number(5 << 3) + number(1))


def test_against_the_library_on_a_unigram_model():
    import sentencepiece

    draw = random.Random(3)
    names = ["▁", "a", "b", "c", "▁a", "ab", "bc", "▁ab", "abc", "ca", "cab", "▁c", "bb"]
    model = unigram_model([(n, -round(draw.uniform(2, 9), 3)) for n in names])
    theirs, ours = sentencepiece.SentencePieceProcessor(model_proto=model), pl.Lattice(model, scores="model")
    for text in ["abcab", "a bc cab", "cabbage".replace("g", "c").replace("e", "a"), "ab bca"]:
        ids, found = next(iter(pl.encode_texts(ours, [text], 4)))
        lists = []
        for f in found:
            own = ids.tolist()
            for e in reversed(f["edits"]):
                own[e["start"]:e["start"] + e["length"]] = e["ids"]
            lists.append(own)
        assert ids.tolist() == theirs.encode(text) and lists == theirs.nbest_encode_as_ids(text, 4)


def test_encode_edge_rows_and_decode(spark):
    coded = pl.encode(table(spark))
    back = pl.decode(coded.drop("text"))
    rows = {(r["doc_id"], r["text"]): r for r in coded.collect()}
    assert len(rows) == 14 and coded.count() == 16
    for (_, text), r in rows.items():
        assert (r["ids"] is None) == (text is None) and r["decoded"] is (None if text is None else True)
        assert text != "" or (r["ids"] == [] and r["nbest"][0]["score"] == 0)
    assert sorted(map(str, [t["text"] for t in back.collect()])) == sorted(str(t) for t in [r["text"] for r in coded.collect()])
    assert pl.encode(spark.createDataFrame([], SCHEMA)).count() == 0
