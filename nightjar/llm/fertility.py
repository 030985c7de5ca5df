"""Quality rules from tokeniser fertility, map-only.

Public vocabularies measure every whole text: characters per token, share of byte-fallback tokens and entropy of the
token distribution. A document is kept if it passes the base rules and its measures lie in the bands of its script
(or of its language, where a band is given). Few characters per token alone don't reject a document, as diacritics,
figures and code show them too: down to ``FLOOR`` times the least rate it goes only if symbols or long strings of letters
that no vocabulary holds explain the rate. A batch is coded by its distinct words, and each distinct word is
tokenised once, which is exact because pieces of the vocabularies never span white space.
"""

from __future__ import annotations

import base64
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from nightjar.llm.common import without
from nightjar.llm.words import expand, row_sums, slices, word_codes

VOCABULARY = "/opt/tokenizers"
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
SLACK = 0.5  # a text of n words may undercut a least rate by SLACK / sqrt(n), as short texts scatter more
FLOOR = 0.5  # part of a least rate below which no clean text lies
SYMBOL_SHARE = 0.3  # symbols per character of words from which they explain a low rate
TOKENS_A_WORD = 4.6  # piece tokens per word from which random strings or broken case explain it
ACCENTS = 0.15  # bytes beyond one per character from which an alphabet explains many tokens per word instead
BLANKS = " \t\n\v\f\r"


@dataclass(frozen=True)
class Band:
    """What clean text of a script shows. Characters per token of the piece and the byte vocabulary: least and most."""

    piece: tuple[float, float]
    byte: tuple[float, float]
    fallback: float  # most byte-fallback tokens per token
    entropy: float  # least bits per token; shorter texts need this part of what their token count allows


# By language code, else by script. The least rates are what running prose shows; clean text below them is judged by what
# explains its rate (``explained``). Latin letters with two marks fall back to bytes in the piece vocabulary.
BANDS = {
    "en": Band((1.6, 8.0), (1.9, 9.0), 0.35, 3.0),
    "de": Band((1.6, 8.0), (2.0, 9.0), 0.35, 3.0),
    "es": Band((1.5, 8.0), (1.75, 9.0), 0.35, 3.0),
    "fr": Band((1.5, 8.0), (1.72, 9.0), 0.35, 3.0),
    "latin": Band((1.4, 8.0), (1.6, 9.0), 0.35, 3.0),
    "cyrillic": Band((1.2, 6.0), (1.2, 8.0), 0.10, 3.0),
    "greek": Band((0.8, 4.0), (0.8, 6.0), 0.10, 3.0),
    "han": Band((0.3, 2.5), (0.3, 4.0), 0.75, 3.0),
    "kana": Band((0.4, 2.5), (0.4, 4.0), 0.50, 3.0),
    "hangul": Band((0.3, 2.5), (0.3, 4.0), 0.75, 3.0),
    "other": Band((0.2, 8.0), (0.2, 9.0), 1.0, 3.0),
}
# First and last code points; everything alphabetic below the first range counts as Latin.
SCRIPTS = (
    ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7A3),
    ("hangul", 0x1100, 0x11FF), ("han", 0x20000, 0x3134F),
)
NAMES = ("none", "latin", "greek", "cyrillic", "kana", "han", "hangul", "other")
MEASURES = pa.schema([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("piece_chars_per_token", pa.float64()), ("byte_chars_per_token", pa.float64()), ("fallback_share", pa.float64()), ("token_entropy", pa.float64()),
    ("script", pa.string()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
])


def word_scripts(words: list[str], ascii_only: np.ndarray) -> np.ndarray:
    """For each word the place in ``NAMES`` of the script of its first letter; 0 without letters."""
    out = np.empty(len(words), dtype=np.int64)
    letter = re.compile("[A-Za-z]")
    for i, word in enumerate(words):
        if ascii_only[i]:
            out[i] = 1 if letter.search(word) else 0
            continue
        code = next((ord(c) for c in word if c.isalpha()), None)
        if code is None:
            out[i] = 0
        elif code < 0x300 or 0x1E00 <= code < 0x1F00:
            out[i] = 1
        else:
            out[i] = NAMES.index(next((name for name, a, b in SCRIPTS if a <= code <= b), "other"))
    return out


def repeated_words(codes: np.ndarray, offsets: np.ndarray, distinct: int) -> np.ndarray:
    """Per row, words inside windows of ``WINDOW`` words that the row holds at least twice.

    Windows are compared by a 64-bit fingerprint first; those that agree are compared word by word.
    """
    n = len(codes)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    covered = np.zeros(n + 1, dtype=np.int64)
    if n >= WINDOW:
        rng = np.random.default_rng(8)
        prints = rng.integers(0, 2**64, size=distinct, dtype=np.uint64)[codes]
        factors = rng.integers(0, 2**63, size=WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        keys = np.zeros(n - WINDOW + 1, dtype=np.uint64)
        for j in range(WINDOW):
            keys += prints[j:n - WINDOW + 1 + j] * factors[j]
        keys += (rows[:len(keys)].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        whole = np.flatnonzero(rows[:len(keys)] == rows[WINDOW - 1:])
        keys = keys[whole]
        ordered = np.sort(keys)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            near = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
            at, keys = whole[twice[near] == keys], keys[twice[near] == keys]
            order = np.argsort(keys, kind="stable")
            at, keys = at[order], keys[order]
            same = keys[1:] == keys[:-1]
            equal = rows[at[1:]] == rows[at[:-1]]
            for j in range(WINDOW):
                equal &= codes[at[1:] + j] == codes[at[:-1] + j]
            if not equal[same].all():  # two unlike windows share a fingerprint: group by the words themselves
                windows = np.column_stack([rows[at], *[codes[at + j] for j in range(WINDOW)]])
                _, group, held = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
                at = at[held[group.ravel()] > 1]
            covered += np.bincount(at, minlength=n + 1)
            covered -= np.bincount(at + WINDOW, minlength=n + 1)[:n + 1]
    inside = (np.cumsum(covered[:n]) > 0).astype(np.int64)
    return row_sums(inside, offsets)


def repeated_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in (text or "").split("\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


def explained(n_words: int, word_chars: int, symbols: int, extra_bytes: int, pieces: int) -> bool:
    """Whether symbols, or words of many pieces without an alphabet that needs them, explain few characters per token."""
    return symbols > SYMBOL_SHARE * word_chars or (pieces > TOKENS_A_WORD * n_words and extra_bytes <= ACCENTS * word_chars)


def read_vocabularies(folder: str) -> tuple[bytes, bytes, str]:
    """The piece model, the byte ranks and the pattern that goes with them; read on the driver and broadcast (1.5 MB)."""
    with open(f"{folder}/piece_bpe_32k.model", "rb") as f:
        pieces = f.read()
    with open(f"{folder}/byte_bpe_multi_50k.tiktoken", "rb") as f:
        ranks = f.read()
    if len(pieces) + len(ranks) > 64_000_000:
        raise ValueError("vocabulary files of more than 64 MB are not broadcast")
    with open(f"{folder}/__init__.py", encoding="utf-8") as f:  # the pattern is a constant beside the files
        pattern = re.search(r"""^PATTERN\s*=\s*r?(?:'''|\"\"\"|'|")(.*?)(?:'''|\"\"\"|'|")\s*$""", f.read(), re.M | re.S)
    if pattern is None:
        raise ValueError("no splitting pattern beside the vocabularies")
    return pieces, ranks, pattern[1]


class Fertility:
    """Both tokenisers, and the token lists of distinct words."""

    def __init__(self, pieces: bytes, ranks: bytes, pattern: str) -> None:
        import sentencepiece
        import tiktoken

        self.piece = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.byte = tiktoken.Encoding("multi", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.fallback = np.array([self.piece.is_byte(i) for i in range(self.piece.get_piece_size())])

    def measure(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ids of the piece tokens of each word, and its number of byte tokens (with the space before it)."""
        lists = self.piece.encode(words, num_threads=1) if words else []
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))]).astype(np.int64)
        ids = np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(starts[-1]))
        spaced = (len(self.byte.encode_ordinary(f" {w}")) for w in words)  # one by one: the batch call starts a thread per word
        return starts, ids, np.fromiter(spaced, np.int64, len(words))


def measure_batch(batch: pa.RecordBatch, column: str, tools: Fertility, bands: dict[str, Band], languages: list[str | None] | None) -> list[pa.Array]:
    """All columns of ``MEASURES`` for one slice."""
    texts = batch.column(column)
    codes, offsets, dictionary = word_codes(texts)
    words = dictionary.to_pylist()
    n_words = np.diff(offsets)
    lengths = pc.utf8_length(dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    scripts = word_scripts(words, pc.string_is_ascii(dictionary).to_numpy(zero_copy_only=False))
    starts, ids, byte_tokens = tools.measure(words)
    word_chars = row_sums(lengths[codes], offsets)
    pieces = row_sums((starts[1:] - starts[:-1])[codes], offsets)
    fallback = np.concatenate([[0], np.cumsum(tools.fallback[ids])])
    fallbacks = row_sums((fallback[starts[1:]] - fallback[starts[:-1]])[codes], offsets)
    repeats = repeated_words(codes, offsets, len(words))
    share = lambda a, b: np.divide(a, b, out=np.zeros(len(a)), where=b > 0)
    entropies, named = [], []
    for i in range(len(n_words)):
        own = codes[offsets[i]:offsets[i + 1]]
        tokens, _ = expand(own, starts, ids)
        counts = np.bincount(tokens) if len(tokens) else np.zeros(1)
        counts = counts[counts > 0]
        entropies.append(max(0.0, math.log2(len(tokens)) - float((counts * np.log2(counts)).sum()) / len(tokens)) if len(tokens) else 0.0)
        spread = np.bincount(scripts[own], weights=lengths[own], minlength=len(NAMES)) if len(own) else np.zeros(len(NAMES))
        named.append(NAMES[1 + int(np.argmax(spread[1:]))] if spread[1:].any() else "none")
    piece_rate, byte_rate = share(word_chars, pieces), share(word_chars, row_sums(byte_tokens[codes], offsets))
    fallback_share = share(fallbacks, pieces)
    base_failed = (n_words < 20) | (100 * repeats > 30 * n_words)
    symbols = pc.cast(pc.count_substring_regex(pc.fill_null(texts, ""), SYMBOLS), pa.int64())
    n_symbols = symbols.to_numpy(zero_copy_only=False)
    extra_bytes = row_sums((pc.binary_length(dictionary).to_numpy(zero_copy_only=False).astype(np.int64) - lengths)[codes], offsets)
    kept = []
    for i, name in enumerate(named):
        band = bands.get(languages[i]) if languages and languages[i] in bands else bands.get(name)
        if base_failed[i] or band is None:  # no letters at all: no script explains it
            kept.append(False)
            continue
        least = band.entropy * min(1.0, math.log2(max(2, pieces[i])) / 8)
        slack = 1 - SLACK / math.sqrt(n_words[i])
        part = slack * (FLOOR if not explained(n_words[i], word_chars[i], n_symbols[i], extra_bytes[i], pieces[i]) else 1.0)
        kept.append(bool(
            part * band.piece[0] <= piece_rate[i] <= band.piece[1] and part * band.byte[0] <= byte_rate[i] <= band.byte[1]
            and fallback_share[i] <= band.fallback and entropies[i] >= least))
    return [
        pa.array(n_words), pa.array(word_chars), symbols,
        pa.array([repeated_lines(t) for t in texts.to_pylist()], pa.int64()), pa.array(repeats), pa.array(piece_rate), pa.array(byte_rate),
        pa.array(fallback_share), pa.array(entropies, pa.float64()), pa.array(named), pa.array(base_failed), pa.array(kept),
    ]


def fertility_rules(docs: DataFrame, text: str = "text", language: str | None = "lang", vocabulary: str = VOCABULARY, bands: dict[str, Band] | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` with the measures, ``script``, ``base_failed`` and ``kept``; without the text unless ``keep_text``.

    Bands are looked up by the value of ``language``, if a band has that name, else by script. A null or empty text has
    no words and fails; a text without any letter has script ``none``, which has no band, and is not kept. Rows are
    independent, so repeated rows get equal results. Input columns named like a result column are replaced. An empty
    table gives an empty result.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import from_arrow_type

    bands = bands or BANDS
    docs = without(docs, *MEASURES.names)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabularies(vocabulary))
    kept_columns = [c for c in docs.columns if keep_text or c != text]
    fields = [docs.schema[c] for c in kept_columns] + [T.StructField(f.name, from_arrow_type(f.type)) for f in MEASURES]
    column_of_language = language if language in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Fertility(*shared.value)
        for batch in batches:
            for part in slices(batch, text):
                languages = part.column(column_of_language).to_pylist() if column_of_language else None
                found = measure_batch(part, text, tools, bands, languages)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept_columns] + found, names=[*kept_columns, *MEASURES.names])

    return docs.mapInArrow(run, T.StructType(fields))
