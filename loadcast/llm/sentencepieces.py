"""SentencePiece encoding and decoding with a relational lattice.

Texts are cut into cells at every place that no piece of the vocabulary crosses,
so the best segmentation of a text is that of its cells, one by one.  All
distinct cells are encoded once, as a lattice in Spark: substrings of bounded
length are exploded, joined to the piece table, grouped by cell, and folded by
a higher-order aggregate that keeps the best path to each position (Viterbi).

The texts themselves are read once.  A unit of texts becomes its cells' numbers
(compressed) and its distinct cells, which are dealt by hash to parts that meet
the encoded cells; the answers go back to the unit.  Units and parts are as large
as a task holds, so that a cell of many texts is asked for once in each unit, and
the units' numbers are written in buckets by unit, so that they need no shuffle to
meet their answers.  The bucketed table is one of the session's catalog, over
files in the scratch folder.

Encoding is the segmentation with the largest sum of scores; among equal sums
the one whose last piece starts first.  Scores of a unigram model are its log
probabilities; a model that only has merge ranks gets the logarithm of the rank.  A character that no piece holds becomes
its UTF-8 bytes.  A run without a cut that is longer than ``LONGEST`` is divided
where pieces of its own best segmentation meet, so its parts give the same ids.

Defined results: a null text gives null ids; an empty text gives none; texts
decode to themselves, but for unpaired surrogates and the word mark, which reads
as a blank, as in the library; repeated rows are encoded
each; an empty table gives an empty table; columns besides id and text are not
read.  The model file is read by the driver, its pieces are the broadcast table,
bounded by the vocabulary.
"""

from __future__ import annotations

import hashlib
import io
import math
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcast.llm.batches import release, returning, slices
from loadcast.sources.scratch import materialize, scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK = "▁"
LONGEST = 64
PLACE_BITS, ID_BITS, COST_BITS = 7, 20, 27  # of a lattice edge; a cost is in millionths
PLACES = 1 << PLACE_BITS
UNKNOWN_ID = (1 << ID_BITS) - 1
BATCH_CHARS = 1_000_000  # cut into cells at once
UNIT_CHARS = 16_000_000  # that ask for each cell once
PART_CHARS = 32_000_000  # per part of the distinct cells
TASK_CELLS = 40_000  # of a lattice task, whose sorted edges stay in memory
NUMBER_BITS = 40  # of a cell's number within its part
COMMON = 255  # cells of a unit with numbers of one byte
MAX_BUCKETS = 50_000  # of files; a bucket may hold several units
UNKNOWN_PENALTY = 10.0

TEXTS, ASKED = 0, 1
PARCEL_DDL = "unit long, part int, parcel binary, kind int"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces of a model: (piece, id, score), the id of byte 0, and the id at each place for decoding."""

    pieces: list[tuple[str, int, float]]
    first_byte: int
    size: int

    @staticmethod
    def load(model_file: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        plain = lambda i: not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        pieces = [(model.id_to_piece(i), i, model.get_score(i)) for i in range(size) if plain(i)]
        if all(s <= 0 and s == int(s) for *_, s in pieces):  # merge ranks: by Zipf's law the rank gives the probability
            pieces = [(p, i, -math.log(2 - s)) for p, i, s in pieces]
        return Vocabulary(pieces, model.piece_to_id("<0x00>"), size)

    @property
    def longest(self) -> int:
        return max(len(p) for p, *_ in self.pieces)

    @property
    def lowest(self) -> float:
        return min(s for *_, s in self.pieces) - UNKNOWN_PENALTY

    def cost(self, score: float) -> int:
        return max(0, min(round(-score * 1e6), (1 << COST_BITS) - 1))

    def costs(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for p, _, s in self.pieces:
            out[p] = min(self.cost(s), out.get(p, self.cost(s)))
        return out

    def joints(self) -> tuple[np.ndarray, np.ndarray]:
        """Class of each code point, and whether some piece holds two classes side by side."""
        chars = sorted({c for p, *_ in self.pieces for c in p})
        classes = np.zeros(0x110000, np.uint16)
        classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p, *_ in self.pieces:
            codes = classes[[ord(c) for c in p]]
            joined[codes[:-1], codes[1:]] = True
        return classes, joined

    def bytes_of(self) -> list[bytes]:
        out = [b""] * self.size
        for p, i, _ in self.pieces:
            out[i] = p.replace(MARK, " ").encode()
        for b in range(256):
            out[self.first_byte + b] = bytes([b])
        return out


def decode_ids(ids: list[int], parts: list[bytes]) -> str:
    """The text of some ids; the word mark in front of a text is not part of it."""
    data = b"".join([parts[i] for i in ids])
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def _pack(table: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue()


def _unpack(parcel: bytes) -> pa.Table:
    return pa.ipc.open_stream(parcel).read_all()


def _planes(values: np.ndarray) -> bytes:
    """Unsigned numbers of four bytes, all first bytes in front: high bytes are mostly equal and compress well."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pack_lists(lengths: np.ndarray, blob: bytes) -> bytes:
    return zstandard.compress(len(lengths).to_bytes(4, "little") + _planes(lengths) + blob)


def _unpack_lists(parcel: bytes) -> tuple[np.ndarray, bytes]:
    data = zstandard.decompress(parcel)
    border = 4 + 4 * int.from_bytes(data[:4], "little")
    return _numbers(data[4:border]).astype(np.int64), data[border:]


def _pack_cells(cells: pa.StringArray) -> bytes:
    offsets = np.asarray(pa.compute.binary_length(cells))
    return _pack_lists(offsets, b"".join(cells.cast(pa.binary()).to_pylist()))


def _unpack_cells(parcels: list[bytes]) -> tuple[pa.Array, list[int]]:
    """Cells of several parcels in one array, and how many each holds."""
    lengths, blobs = zip(*map(_unpack_lists, parcels))
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate(lengths))])
    cells = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(b"".join(blobs)))
    return cells.cast(pa.string()), [len(x) for x in lengths]


def _pack_texts(ids: list[int | None], counts: pa.Array, codes: np.ndarray) -> list[bytes]:
    """Ids and numbers of cells of some texts, and all cells' numbers: a byte each, more bytes for the rare ones."""
    rare = codes[codes >= COMMON] - COMMON
    return [
        _pack(pa.table({"doc_id": pa.array(ids, pa.int64()), "cells": counts})),
        zstandard.compress(np.minimum(codes, COMMON).astype(np.uint8).tobytes()),
        *(zstandard.compress((rare >> (8 * k) & 255).astype(np.uint8).tobytes()) for k in range(4)),
    ]


def _unpack_texts(frames: list[bytes]) -> tuple[pa.Table, np.ndarray]:
    codes = np.frombuffer(zstandard.decompress(frames[1]), np.uint8).astype(np.int64)
    rare = np.zeros(int((codes == COMMON).sum()), np.int64)
    for k, frame in enumerate(frames[2:]):
        rare += np.frombuffer(zstandard.decompress(frame), np.uint8).astype(np.int64) << (8 * k)
    codes[codes == COMMON] += rare
    return _unpack(frames[0]), codes


def _framed(frames: list[bytes]) -> bytes:
    return b"".join(len(f).to_bytes(4, "little") + f for f in frames)


def _frames(parcel: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(parcel):
        end = at + 4 + int.from_bytes(parcel[at : at + 4], "little")
        out.append(parcel[at + 4 : end])
        at = end
    return out


def borders(run: str, costs: dict[str, int], longest: int, unknown: int) -> list[int]:
    """Places that divide a long run into parts of ``LONGEST`` characters at most, each on its best path.

    The path is the one of the lattice: smallest cost, and of equal ones the last
    piece that starts first.  Only the last costs are held, and a byte per place.
    """
    back = bytearray(len(run) + 1)
    recent = [0]  # costs of the last places, the nearest at the end
    for end in range(1, len(run) + 1):
        low = end - len(recent)
        best, length = -1, 0
        for at, before in enumerate(recent, low):
            cost = costs.get(run[at:end])
            if cost is None:
                if at < end - 1:
                    continue
                cost = unknown
            if best < 0 or before + cost < best:
                best, length = before + cost, end - at
        back[end] = length
        recent.append(best)
        if len(recent) > longest:
            del recent[0]
    out, at, border = [], len(run), len(run)
    while at > 0:
        low = at - back[at]
        if border - low > LONGEST:
            out.append(at)
            border = at
        at = low
    return out[::-1]


def _divided(whole: str, starts: np.ndarray, end: int, costs: dict[str, int], longest: int, unknown: int) -> np.ndarray:
    """Starts of cells, and of the parts of those too long for the lattice; equal runs are searched once."""
    lengths = np.diff(np.r_[starts, end])
    long = np.flatnonzero(lengths > LONGEST)
    known: dict[str, list[int]] = {}
    more = []
    for start, n in zip(starts[long].tolist(), lengths[long].tolist()):
        run = whole[start : start + n]
        if run not in known:
            known[run] = borders(run, costs, longest, unknown)
        more += [start + b for b in known[run]]
    return np.sort(np.r_[starts, np.asarray(more, np.int64)]) if more else starts


def cells_of(texts: list[str], classes: np.ndarray, joined: np.ndarray, costs: dict[str, int], longest: int, unknown: int) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All cells of some texts in order, and the number of cells per text."""
    marked = [(MARK + t.replace(" ", MARK)) if t else "" for t in texts]
    whole = "".join(marked)
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    cut = np.ones(len(codes), bool)
    if len(codes):
        kinds = classes[codes]
        cut[1:] = ~joined[kinds[:-1], kinds[1:]]
    begins = np.cumsum(np.r_[0, [len(m) for m in marked]]).astype(np.int64)
    cut[begins[:-1][begins[:-1] < len(codes)]] = True
    starts = _divided(whole, np.flatnonzero(cut), len(codes), costs, longest, unknown)
    sizes = np.ones(len(codes), np.int64)  # in UTF-8
    for low in (0x80, 0x800, 0x10000):
        sizes += codes >= low
    offsets = np.r_[(np.cumsum(sizes) - sizes)[starts], sizes.sum()].astype(np.int64)
    cells = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(whole.encode()))
    return cells.dictionary_encode(), np.diff(np.searchsorted(starts, begins, "left"))


def _parcels(vocabulary: Vocabulary, parts: int):
    """Per unit: parcels of texts as numbers of cells, the places of the numbers among the cells asked, and the cells asked, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = (*vocabulary.joints(), vocabulary.costs(), vocabulary.longest, vocabulary.cost(vocabulary.lowest))
        first_unit, done = TaskContext.get().partitionId() << 32, 0
        unit: list[tuple[list[int | None], pa.Array, pa.DictionaryArray]] = []
        ids: list[int | None] = []
        texts: list[str | None] = []
        size = total = 0

        def cut() -> None:
            cells, counts = cells_of([t or "" for t in texts], *known)
            unit.append((list(ids), pa.array(counts.astype(np.int64), mask=np.array([t is None for t in texts], bool)), cells))
            ids.clear()
            texts.clear()

        for batch in slices(batches):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t or "") + 1
                if size >= BATCH_CHARS:
                    cut()
                    total, size = total + size, 0
                    if total >= UNIT_CHARS:
                        yield from emit(first_unit + done, unit)
                        done, total = done + 1, 0
                        unit.clear()
        if ids:
            cut()
        if unit:
            yield from emit(first_unit + done, unit)

    def emit(name: int, unit) -> Iterator[pa.RecordBatch]:
        merged = pa.concat_arrays([cells.dictionary for *_, cells in unit]).dictionary_encode()
        cells, to_merged = merged.dictionary.cast(pa.string()), merged.indices.to_numpy()
        borders_ = np.cumsum([0] + [len(d.dictionary) for *_, d in unit])
        often = np.zeros(len(cells), np.int64)
        for low, high, (*_, d) in zip(borders_[:-1], borders_[1:], unit):
            np.add.at(often, to_merged[low:high], np.bincount(d.indices.to_numpy(), minlength=high - low))
        number = np.empty(len(cells), np.int64)
        number[np.argsort(-often, kind="stable")] = np.arange(len(cells))
        numbers = number[to_merged]
        for at, (low, high, (ids, counts, d)) in enumerate(zip(borders_[:-1], borders_[1:], unit)):
            yield rows(name, [(at, _framed(_pack_texts(ids, counts, numbers[low:high][d.indices.to_numpy()])))], TEXTS)
        part = np.fromiter((xxhash.xxh3_64_intdigest(c) % parts for c in cells.cast(pa.binary()).to_pylist()), np.int32, len(cells))
        order = pa.compute.sort_indices(pa.table({"part": part, "cell": cells}), [("part", "ascending"), ("cell", "ascending")]).to_numpy()
        yield rows(name, [(-1, zstandard.compress(_planes(number[order])))], TEXTS)
        part, cells = part[order], cells.take(pa.array(order))
        borders_ = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)] if len(part) else [0]
        asked = [(int(part[low]), _pack_cells(cells[low:high])) for low, high in zip(borders_[:-1], borders_[1:])]
        for low in range(0, len(asked), 64):
            yield rows(name, asked[low : low + 64], ASKED)

    def rows(name: int, some: list[tuple[int, bytes]], kind: int) -> pa.RecordBatch:
        n = len(some)
        columns = [pa.array([name] * n, pa.int64()), pa.array([p for p, _ in some], pa.int32()), pa.array([b for _, b in some], pa.binary()), pa.array([kind] * n, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["unit", "part", "parcel", "kind"])

    return run


def _distinct(table: pa.Table) -> pa.Table:
    unique = _unpack_cells(table.column("parcel").to_pylist())[0].unique()
    release()
    return pa.table({"number": pa.array(np.arange(len(unique)) + (table.column("part")[0].as_py() << NUMBER_BITS)), "cell": unique})


def lattice(cells: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The columns of ``cells`` (number, unique; cell) and ids, the best segmentation of each cell.

    An edge is one number: its end, its start, the piece and the cost (negative
    score in millionths), in this order of bits, so that sorted edges come by
    their end.  A place of the fold is cost, start and piece of the best edge
    that ends there: the smallest number is the best path, and among equal costs
    the one whose last piece starts first.
    """
    spark = cells.sparkSession
    priced = [(p, (i << COST_BITS) + vocabulary.cost(s)) for p, i, s in vocabulary.pieces]
    table = F.broadcast(spark.createDataFrame(priced, "piece string, priced long"))
    unknown = (UNKNOWN_ID << COST_BITS) + vocabulary.cost(vocabulary.lowest)
    tasks = spark.sparkContext.defaultParallelism + cells.count() // TASK_CELLS
    dealt = cells.repartition(tasks, "number")
    starts = dealt.withColumn("low", F.explode(F.sequence(F.lit(0), F.length("cell") - 1)))
    longest = F.least(F.lit(vocabulary.longest), F.length("cell") - F.col("low"))
    spans = starts.withColumn("n", F.explode(F.sequence(F.lit(1), longest))).withColumn("piece", F.substr("cell", F.col("low") + 1, F.col("n")))
    # a row per span; a single character stays even where no piece holds it
    edges = spans.join(table, "piece", "left").filter("priced is not null or n = 1")
    place = ((F.col("low") + F.col("n")) * PLACES + F.col("low")).cast("long")
    edge = F.call_function("shiftleft", place, F.lit(ID_BITS + COST_BITS)) + F.coalesce("priced", F.lit(unknown))
    grouped = edges.groupBy("number").agg(F.sort_array(F.collect_list(edge)).alias("edges")).join(dealt, "number")

    shift = lambda x, n: F.shiftright(x, n)
    low_bits = lambda x, n: x.bitwiseAND((1 << n) - 1)
    back_bits = ID_BITS + PLACE_BITS

    def step(best: Column, e: Column) -> Column:
        places = shift(e, ID_BITS + COST_BITS)
        low, high = low_bits(places, PLACE_BITS), shift(places, PLACE_BITS).cast("int")
        cost = shift(F.get(best, low.cast("int")), back_bits) + low_bits(e, COST_BITS)
        back = low * (1 << ID_BITS) + low_bits(shift(e, COST_BITS), ID_BITS)
        path = F.call_function("shiftleft", cost, F.lit(back_bits)) + back
        longer = F.size(best) == high
        return F.when(longer, F.concat(best, F.array(path))).otherwise(
            F.concat(F.slice(best, F.lit(1), high), F.array(F.least(F.get(best, high), path)))
        )

    best = grouped.select("number", "cell", F.aggregate("edges", F.array(F.lit(0).cast("long")), step).alias("best"))

    hexed = lambda at: F.hex(F.encode(F.substr("cell", at + 1, F.lit(1)), "UTF-8"))

    def spelled(at: Column) -> Column:
        value = lambda k: F.conv(F.substr(hexed(at), 2 * k - 1, F.lit(2)), 16, 10).cast("int") + vocabulary.first_byte
        return F.transform(F.sequence(F.lit(1), (F.length(hexed(at)) / 2).cast("int")), value)

    def walk(acc: Column, at: Column) -> Column:
        """From the end to the start: takes the piece that ends at ``at`` if the path goes through there."""
        entry = F.get("best", at)
        low, piece = low_bits(shift(entry, ID_BITS), PLACE_BITS).cast("int"), low_bits(entry, ID_BITS).cast("int")
        ids = F.when(piece == UNKNOWN_ID, spelled(low)).otherwise(F.array(piece))
        return F.when(acc["at"] == at, F.struct(low.alias("at"), F.concat(ids, acc["ids"]).alias("ids"))).otherwise(acc)

    end = F.length("cell")
    path = F.aggregate(
        F.sequence(end, F.lit(1), F.lit(-1)), F.struct(end.alias("at"), F.array().cast("array<int>").alias("ids")), walk, lambda acc: acc["ids"]
    )
    return best.select("number", "cell", path.alias("ids"))


def _answers(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Encoded cells for every unit that asked, in the order asked; both tables are of one part."""
    cells, counts = _unpack_cells(asked.column("parcel").to_pylist())
    at = pa.compute.index_in(cells, known.column("cell").combine_chunks())
    if at.null_count:
        raise ValueError("a cell has no encoding")
    ids = known.column("ids").combine_chunks()
    parcels, low = [], 0
    for n in counts:
        some = ids.take(at[low : low + n])
        parcels.append(_pack_lists(np.asarray(pa.compute.list_value_length(some)), _planes(some.flatten().to_numpy())))
        low += n
    release()
    return pa.table({"unit": asked.column("unit"), "part": asked.column("part"), "parcel": pa.array(parcels, pa.binary())})


def _assemble(vocabulary: Vocabulary):
    fields = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded_sha256", pa.string())])

    def run(unit: pa.Table, answers: pa.Table) -> pa.Table:
        parts = vocabulary.bytes_of()
        parcels = dict(zip(unit.column("part").to_pylist(), unit.column("parcel").to_pylist()))
        number = _numbers(zstandard.decompress(parcels.pop(-1)))
        answers = answers.sort_by("part")
        lists = [_unpack_lists(p) for p in answers.column("parcel").to_pylist()]
        sizes = np.concatenate([n for n, _ in lists] or [np.zeros(0, np.int64)])
        values = np.concatenate([_numbers(b).astype(np.int32) for _, b in lists] or [np.zeros(0, np.int32)])
        if len(sizes) != len(number):
            raise ValueError("a unit lacks answers")
        place = np.argsort(number)
        offsets, sizes = (np.cumsum(sizes) - sizes)[place], sizes[place]
        out = [texts_of(*_unpack_texts(_frames(parcels[k])), values, offsets, sizes, parts) for k in sorted(parcels)]
        release()
        return pa.Table.from_batches(out, fields)

    def texts_of(table: pa.Table, codes: np.ndarray, values: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, parts: list[bytes]) -> pa.RecordBatch:
        spans = sizes[codes]
        ends = np.cumsum(spans)
        encoded = values[np.repeat(offsets[codes] - ends + spans, spans) + np.arange(spans.sum())]
        cells = table.column("cells").combine_chunks()
        borders_ = np.r_[0, ends][np.cumsum(np.r_[0, cells.fill_null(0).to_numpy()])]
        null = cells.is_null()
        digests = [
            None if n else hashlib.sha256(decode_ids(encoded[low:high].tolist(), parts).encode("utf-8", "replace")).hexdigest()
            for n, low, high in zip(null.to_pylist(), borders_[:-1].tolist(), borders_[1:].tolist())
        ]
        ids = pa.ListArray.from_arrays(pa.array(borders_.astype(np.int32)), pa.array(encoded, pa.int32()), mask=null)
        return pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), ids, pa.array(digests, pa.string())], schema=fields)

    return run


def _written(parcels: DataFrame, buckets: int) -> DataFrame:
    """The parcels as a table in buckets by unit, so that the texts of a unit are not shuffled again."""
    spark, name = parcels.sparkSession, f"loadcast_parcels_{uuid.uuid4().hex}"
    writer = parcels.write.partitionBy("kind").bucketBy(buckets, "unit").sortBy("unit").option("path", scratch_path(spark, "parcels"))
    writer.saveAsTable(name)
    return spark.table(name)


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per row: doc_id, ids, n_pieces, decoded_sha256 (of the text decoded from the ids)."""
    if vocabulary.longest > LONGEST:
        raise ValueError(f"pieces of more than {LONGEST} characters do not fit the lattice")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    tasks = texts.sparkSession.sparkContext.defaultParallelism
    parts, buckets = tasks + chars // PART_CHARS, min(2 * tasks + chars // UNIT_CHARS, MAX_BUCKETS)
    parcels = _written(texts.mapInArrow(returning(_parcels(vocabulary, parts)), PARCEL_DDL), buckets)
    asked = parcels.filter(F.col("kind") == ASKED).select("unit", "part", "parcel")
    cells = materialize(asked.groupBy("part").applyInArrow(_distinct, "number long, cell string"), "cells")
    known = materialize(lattice(cells, vocabulary).select(F.shiftright("number", NUMBER_BITS).cast("int").alias("part"), "cell", "ids"), "encoded")
    answers = asked.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(_answers, "unit long, part int, parcel binary")
    units = parcels.filter(F.col("kind") == TEXTS).select("unit", "part", "parcel")
    out = units.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(_assemble(vocabulary), "doc_id long, ids array<int>, decoded_sha256 string")
    return out.select("doc_id", "ids", F.when(F.col("ids").isNotNull(), F.size("ids").cast("long")).alias("n_pieces"), "decoded_sha256")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded`` (with a column ids) and the column text; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = vocabulary.bytes_of()
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            texts = pa.array([None if i is None else decode_ids(i, parts) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, text string")
