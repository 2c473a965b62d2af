"""Language identification by segmentation-marginalised unigram models.

A language gives every piece of a fixed public vocabulary a probability; the
probability of a word is the sum over all its segmentations into pieces, found
by the forward algorithm, and that of a text the product over its words.

Training is one pass: under a flat start every segmentation of a word is
weighted by its number of pieces, and the expected counts of pieces by language
(forward-backward) are added up over all training texts.  Only those counts,
pieces x languages, reach the driver.  Words are found and hashed for
many texts at once.

Words are runs of letters and combining marks (vowel signs among them) that
begin with a letter, in lower case, of any length, with the vocabulary's word
mark in front.  A distinct word is scored once in a stretch of up to ``STRETCH_CHARS``
characters.  The sums are rescaled as a word goes on, so long words neither
vanish nor are cut; to score one, only its last few places are held.

Defined results: a text that is null or without a letter is ``und`` with score
0, and is ``und`` for every text if no language could be learned; the score is
the posterior of the predicted language under equal priors; equal posteriors go
to the language that sorts first; rows with a null language are not learned
from; rows that repeat a doc_id, or have none, are texts of their own; an empty
table gives an empty table; other columns are not read.  More than
``MAX_LANGUAGES`` languages stop the training with a message.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.llm.shingles import FACTORS, mixed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK = "▁"
UNKNOWN = "und"
PIECE_CHARS = 1_000_000
STRETCH_CHARS = 32_000_000  # of texts whose distinct words are scored once, with few languages
FEW_LANGUAGES = 8
GRID_CELLS = 400_000  # places of words looked up at a time
GRID_PLACES = 4_096  # places of one word looked up at a time
FORWARD_CELLS = 8_000_000  # numbers held by the forward sums at a time
RESCALED = 16  # places of a word between changes of the unit of its sums
SMOOTHING = 0.5
UNSEEN = 1e-9  # probability of a letter that no piece holds
SCALE = 1e6  # expected counts are added up as integers, so their order does not matter
MAX_LANGUAGES = 1_000  # bound of the broadcast model
_BASE = FACTORS[0]
_CODES = max(c for c in range(sys.maxunicode + 1) if chr(c).isalpha()) + 2  # the last one stands for all behind it
_LETTERS = np.array([chr(c).isalpha() for c in range(_CODES)])
_INSIDE = _LETTERS | np.array([unicodedata.category(chr(c)) in ("Mn", "Mc", "Me") for c in range(_CODES)])
_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(_CODES)], np.uint32)


def load_pieces(model_file: str) -> list[str]:
    """The ordinary pieces of a public SentencePiece model that are made of letters and combining marks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = lambda i: not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if plain(i)}
    lettered = lambda p: p and all(ord(c) < _CODES and _INSIDE[ord(c)] for c in p)
    return sorted(p for p in found if p == MARK or lettered(p.removeprefix(MARK)))


def _hash(codes: np.ndarray) -> int:
    out = 0
    for c in codes.tolist():
        out = (out * int(_BASE) + c) % (1 << 64)
    return out


@dataclass
class Pieces:
    """Hash table of the vocabulary: open slots by the low bits, 4 probes at most."""

    slots: np.ndarray
    ids: np.ndarray
    longest: int
    count: int

    @staticmethod
    def of(pieces: list[str]) -> Pieces:
        hashes = mixed(np.array([_hash(np.array([ord(c) for c in p])) for p in pieces], np.uint64))
        bits = 17
        while True:
            size = 1 << bits
            slots, ids = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
            free = True
            for i, h in enumerate(hashes.tolist()):
                at = next((j for j in range(4) if ids[(h + j) % size] < 0), None)
                if at is None:
                    free = False
                    break
                slots[(h + at) % size], ids[(h + at) % size] = h, i
            if free:
                return Pieces(slots, ids, max(map(len, pieces)), len(pieces))
            bits += 1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece of each hash, or -1."""
        hashes = mixed(hashes)
        mask = np.uint64(len(self.slots) - 1)
        out = np.full(len(hashes), -1, np.int32)
        maybe = np.flatnonzero(self.ids[(hashes & mask).astype(np.int64)] >= 0)  # a piece leaves its first slot only if that is taken
        hashes = hashes[maybe]
        for j in range(4):
            at = ((hashes + np.uint64(j)) & mask).astype(np.int64)
            hit = np.flatnonzero((self.slots[at] == hashes) & (self.ids[at] >= 0))
            out[maybe[hit]] = self.ids[at[hit]]
        return out


def letter_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters of all words as (codes, starts of words, text of each word); the end is the next start."""
    joined = "\n".join(t or "" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    lengths = np.array([len(t or "") for t in texts], np.int64)
    begins = np.cumsum(np.r_[0, lengths[:-1] + 1])
    small = np.minimum(codes, np.uint32(_CODES - 1))
    inside = _INSIDE[small]
    places = np.arange(len(codes))
    outside = np.maximum.accumulate(np.where(inside, -1, places)) if len(codes) else places
    letter = np.maximum.accumulate(np.where(_LETTERS[small], places, -1)) if len(codes) else places
    place = np.flatnonzero(inside & (letter > outside))  # marks in front of a run's first letter stay out
    starts = np.flatnonzero(np.r_[True, np.diff(place) > 1][: len(place)])
    return _LOWER[small[place]], starts, np.searchsorted(begins, place[starts], "right") - 1


def distinct_words(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, length) of each distinct word, by rising hash, and the index of every word among them."""
    lengths = np.diff(np.r_[starts, len(codes)])
    within = np.arange(len(codes)) - np.repeat(starts, lengths)
    terms = mixed(codes.astype(np.uint64) + FACTORS[within % 64] * (within + 1).astype(np.uint64))
    hashes = np.add.reduceat(terms, starts)
    found, first, index = np.unique(hashes, return_index=True, return_inverse=True)
    return found, starts[first], lengths[first], index


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
    """All distinct words of some texts as (codes, starts, lengths), and by group of texts the index and the text of every word."""
    seen, numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    parts, sizes, groups = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], []
    for at, group in _groups(texts, PIECE_CHARS):
        codes, starts, text = letter_words(group)
        if not len(starts):
            continue
        found, first, lengths, index = distinct_words(codes, starts)
        place = np.searchsorted(seen, found)
        new = np.r_[seen, np.zeros(1, np.uint64)][place] != found
        new |= place == len(seen)
        spans = lengths[new]
        ends = np.cumsum(spans)
        parts.append(codes[np.repeat(first[new] - ends + spans, spans) + np.arange(spans.sum())])
        sizes.append(spans)
        numbers = np.insert(numbers, place[new], np.arange(len(seen), len(seen) + len(spans)))
        seen = np.insert(seen, place[new], found[new])
        groups.append((numbers[np.searchsorted(seen, found)][index], (at + text).astype(np.int32)))
    lengths = np.concatenate(sizes)
    return np.concatenate(parts), np.cumsum(lengths) - lengths, lengths, groups


def blocks(lengths: np.ndarray, most: int, held: int) -> Iterator[np.ndarray]:
    """Words by falling length in blocks of at most ``most`` words and about GRID_CELLS places, ``held`` of a word at a time."""
    order = np.argsort(-lengths, kind="stable")
    low = 0
    while low < len(order):
        fits = GRID_CELLS // min(int(lengths[order[low]]) + 1, held)
        high = low + max(1, min(fits, most))
        yield order[low:high]
        low = high


def found_pieces(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, low: int, high: int, pieces: Pieces) -> np.ndarray:
    """(places, words, piece lengths) the piece that ends at each of the places ``low`` to ``high``; -1 is none.

    Place 1 is behind the word mark, place n + 1 behind the nth letter.
    """
    reach = pieces.longest - 1
    place = np.arange(low - reach, high)[:, None]
    real = (place >= 1) & (place <= lengths + 1)
    grid = np.where(place == 1, ord(MARK), codes[np.where(real & (place > 1), starts + place - 2, 0)]).astype(np.uint64)
    out = np.full((high - low, len(starts), pieces.longest), -1, np.int32)
    value, power = np.zeros((high - low, len(starts)), np.uint64), np.ones(1, np.uint64)
    ends = real[reach:]
    for size in range(1, pieces.longest + 1):
        begins = slice(reach - size + 1, reach - size + 1 + high - low)
        value = value + grid[begins] * power
        power = power * _BASE
        spans = ends & real[begins]
        out[spans, size - 1] = pieces.find(value[spans])
    return out


def steps(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pieces: Pieces, back: bool = False) -> Iterator[tuple]:
    """Per place of the words (sorted by falling length): place, word, piece length and piece of each edge that ends there.

    A letter that is no piece is an edge of length 1 with the piece -1.
    """
    width = min(int(lengths[0]) + 1, GRID_PLACES)
    chunks = range(1, int(lengths[0]) + 2, width)
    for low in reversed(chunks) if back else chunks:
        high = min(low + width, int(lengths[0]) + 2)
        alive = np.searchsorted(-lengths, -(low - 1), "right")
        found = found_pieces(codes, starts[:alive], lengths[:alive], low, high, pieces)
        for place in range(high - 1, low - 1, -1) if back else range(low, high):
            here = found[place - low, : np.searchsorted(-lengths, -(place - 1), "right")]
            known = here >= 0
            known[:, 0] = True
            word, size = np.nonzero(known)
            yield place, word, size + 1, here[word, size]


def forward(edges: Iterable[tuple], words: int, longest: int, model: np.ndarray) -> Iterator[tuple]:
    """Per place of ``steps``: place, (words, languages) sums over the segmentations up to it, and the logarithm of their unit.

    The last row of ``model`` is for unknown letters.  The unit of a word follows its
    sums every RESCALED places, so neither they nor those of the places before leave
    the range of doubles while probabilities of single letters stay above 1e-18.
    """
    ring = longest + 1
    sums, unit = np.ones((ring, words, model.shape[1])), np.zeros((words, model.shape[1]))
    for place, word, size, found in edges:
        begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        now = np.add.reduceat(sums[(place - size) % ring, word] * model[found], begins, axis=0)
        alive = len(now)
        yield place, now, unit[:alive]
        if place % RESCALED == 0:
            sums[:, :alive] /= now
            unit[:alive] += np.log(now)
            now = 1.0
        sums[place % ring, :alive] = now


def expected_counts(texts: list[str | None], languages: np.ndarray, many: int, pieces: Pieces) -> np.ndarray:
    """(pieces, languages) expected counts under a flat model."""
    out = np.zeros((pieces.count + 1, many))
    codes, first, lengths, groups = words_of(texts)
    if not len(first):
        return out
    weight = np.zeros(len(first) * many)
    for index, text in groups:
        weight += np.bincount(index * np.int64(many) + languages[text], minlength=len(weight))
    weight = weight.reshape(-1, many)
    flat = np.full((pieces.count + 1, 1), 1e-4)
    flat[-1] = UNSEEN
    for block in blocks(lengths, len(lengths), len(codes) + 1):
        words = (codes, first[block], lengths[block], pieces)
        places = int(lengths[block[0]]) + 2
        log, share = np.zeros((places, len(block))), np.zeros((places, len(block)))
        edges = steps(*words)
        if places <= GRID_PLACES:  # one lookup serves both ways
            edges = list(edges)
        for place, now, unit in forward(edges, len(block), pieces.longest, flat):
            log[place, : len(now)] = (np.log(now) + unit)[:, 0]
        share[lengths[block] + 1, np.arange(len(block))] = 1.0
        parts = []
        for place, word, size, found in reversed(edges) if places <= GRID_PLACES else steps(*words, back=True):
            part = share[place, word] * flat[found, 0] * np.exp(log[place - size, word] - log[place, word])
            share[place - size, word] += part
            parts.append((word, found, part))
        word, found, part = (np.concatenate(e) for e in zip(*parts))
        for l in range(many):
            out[:, l] += np.bincount(found % (pieces.count + 1), part * weight[block[word], l], pieces.count + 1)
    return out


def word_scores(codes: np.ndarray, first: np.ndarray, lengths: np.ndarray, pieces: Pieces, model: np.ndarray) -> np.ndarray:
    """(words, languages) log probabilities."""
    out = np.empty((len(first), model.shape[1]))
    most = max(1, FORWARD_CELLS // ((pieces.longest + 1) * model.shape[1]))
    for block in blocks(lengths, most, GRID_PLACES):
        edges = steps(codes, first[block], lengths[block], pieces)
        for place, now, unit in forward(edges, len(block), pieces.longest, model):
            ended = np.flatnonzero(lengths[block[: len(now)]] == place - 1)
            out[block[ended]] = np.log(now[ended]) + unit[ended]
    return out


def stretch_chars(many: int) -> int:
    """Characters of a stretch: numbers by word and language stay within bounds."""
    return max(PIECE_CHARS, STRETCH_CHARS * FEW_LANGUAGES // max(many, FEW_LANGUAGES))


def _groups(texts: Iterable[str | None], chars: int) -> Iterator[tuple[int, list[str | None]]]:
    """Neighbouring texts of some ``chars`` characters together."""
    at, size, group = 0, 0, []
    for i, t in enumerate(texts):
        group.append(t)
        size += len(t or "") + 1
        if size >= chars:
            yield at, group
            at, size, group = i + 1, 0, []
    if group:
        yield at, group


def _count(pieces: Pieces, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((pieces.count + 1, len(names)))
        for batch in batches:
            which = pa.compute.index_in(batch.column(0), pa.array(names)).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, group in _groups(batch.column(1).to_pylist(), stretch_chars(len(names))):
                total += expected_counts(group, which[at : at + len(group)], len(names), pieces)
        piece, language = np.nonzero(total)
        counts = np.round(total[piece, language] * SCALE).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(language.astype(np.int32)), pa.array(counts)], names=["piece", "language", "n"])

    return run


def train(docs: DataFrame, vocabulary: list[str]) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities by piece and language) from all rows with text and lang."""
    known = docs.filter("text is not null and lang is not null")
    names = [r[0] for r in known.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    pieces = Pieces.of(vocabulary)
    model = np.zeros((pieces.count + 1, len(names)))
    if names:
        counted = known.select("lang", "text").mapInArrow(_count(pieces, names), "piece int, language int, n long")
        for r in counted.groupBy("piece", "language").agg(F.sum("n")).collect():  # pieces x languages at most
            model[r[0], r[1]] = r[2] / SCALE
    model[:-1] += SMOOTHING
    model[:-1] /= model[:-1].sum(0, keepdims=True)
    model[-1] = UNSEEN
    return names, model


def _predict(pieces: Pieces, names: list[str], model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = np.full(batch.num_rows, -1)
            score = np.zeros(batch.num_rows)
            for at, stretch in _groups(batch.column(0).to_pylist() if names else [], stretch_chars(len(names))):
                codes, first, lengths, groups = words_of(stretch)
                logs = word_scores(codes, first, lengths, pieces, model)
                for index, text in groups:
                    begins = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
                    sums = np.add.reduceat(logs[index], begins, axis=0)
                    chosen = sums.argmax(1)
                    best[at + text[begins]] = chosen
                    score[at + text[begins]] = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
            labels = pa.array(np.array([*names, UNKNOWN], object)[best], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], labels, pa.array(score)], names=[*batch.schema.names[1:], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, vocabulary: list[str], names: list[str], model: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score for every row; reads the text only."""
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"
    return docs.select("text", "doc_id").mapInArrow(_predict(Pieces.of(vocabulary), names, model), ddl)
