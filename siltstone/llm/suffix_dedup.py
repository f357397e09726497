"""Exact substring deduplication by sorted suffixes.

Every byte covered by a string of ``length`` bytes that also starts elsewhere is found, without
shuffling a suffix for each byte: a window of ``length`` bytes chooses one suffix inside it, by its
content alone (the anchor: the least gram hash), so equal windows choose equal suffixes at equal
distances. The consecutive windows that share an anchor make a segment, and there is about one for
seventy bytes.

1. Anchors are counted by a hash of their leading bytes, combined map-side; those whose leading bytes
   stand nowhere else can't match. Copies of a whole segment repeat throughout, which needs no
   comparison (two 64-bit hashes agree).
2. Of the leading bytes that different segments share, one segment of each kind goes on, with its
   bytes. Sampled splitters range-partition these suffixes by their leading bytes; a splitter never
   falls between equal leads. Each bucket is sorted by multikey quicksort, and in each run of equal
   leads the windows are compared, by hash and then by their bytes.
3. Leads that very many kinds of segments share (an often quoted passage in ever new surroundings) are
   not gathered in a bucket: their windows are counted one by one, combined map-side.
4. The covered spans return to their texts.

Texts are shuffled once, by row; both joins use that exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import pieces, stored, utf8_buffer
from siltstone.llm.suffix_core import RollingHash, anchors, multikey_order, repeated_windows

LENGTH = 200
GRAM = 40
#: Kinds of segments that may share a lead in a bucket (some 5 MB); leads of more are counted by window.
BUCKET_KINDS = 20_000
#: Bytes of segments that a bucket takes, about.
BUCKET_BYTES = 32 << 20


def _segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, s, row, first, last, place): a row for each segment; positions are bytes of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = utf8_buffer(batch.column("text"))
            rolling = RollingHash(data)
            found = anchors(data, offsets, length, gram, rolling)
            if not len(found.place):
                continue
            lead = rolling.of(found.place, found.place + gram)
            whole = RollingHash(data, 1).of(found.first, found.last + length) ^ ((found.place - found.first).astype(np.uint64) << np.uint64(32))
            rows, begin = batch.column("row").to_numpy()[found.owner], offsets[found.owner]
            arrays = [pa.array(lead.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(rows)]
            arrays += [pa.array((x - begin).astype(np.int32)) for x in (found.first, found.last, found.place)]
            yield pa.RecordBatch.from_arrays(arrays, ["h", "s", "row", "first", "last", "place"])

    return docs.mapInArrow(run, "h long, s long, row long, first int, last int, place int")


def _with_bytes(texts: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """(lead, row, first, ahead, many, bytes): wanted segments with their bytes; ahead: bytes before the anchor."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("first", "last", "place", "many")).alias("list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = utf8_buffer(batch.column("text"))
            whole = data.tobytes()
            rows, lists = batch.column("row").to_pylist(), batch.column("list").to_pylist()
            out = []
            for row, begin, entries in zip(rows, offsets.tolist(), lists, strict=False):
                for e in entries:
                    at = begin + e["place"]
                    out.append((whole[at : at + gram], row, e["first"], e["place"] - e["first"], e["many"], whole[begin + e["first"] : begin + e["last"] + length]))
            for at in range(0, len(out), 20_000):
                lead, row, first, ahead, many, cut = zip(*out[at : at + 20_000], strict=True)
                arrays = [pa.array(lead, pa.binary()), pa.array(row, pa.int64()), pa.array(first, pa.int32()), pa.array(ahead, pa.int32()), pa.array(many), pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["lead", "row", "first", "ahead", "many", "bytes"])

    return texts.join(lists, "row").mapInArrow(run, "lead binary, row long, first int, ahead int, many boolean, bytes binary")


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Windows at sorted starts as maximal spans of windows at consecutive starts."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    begin = np.concatenate([starts[:1], starts[cut + 1]])
    end = np.concatenate([starts[cut], starts[-1:]]) + length
    return list(zip(begin.tolist(), end.tolist(), strict=True))


def _compared(kinds: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """(row, start, end): spans of the segments' windows that another segment of the bucket repeats.

    A task holds one bucket; there are as many as keep it at about BUCKET_BYTES.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        table = table.combine_chunks()
        leads = np.frombuffer(b"".join(table.column("lead").to_pylist()), np.uint8).reshape(-1, gram)
        order, lead_run = multikey_order(leads)
        cuts = table.column("bytes").to_pylist()
        row, first, ahead = (table.column(n).to_numpy() for n in ("row", "first", "ahead"))
        many = table.column("many").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.concatenate([[True], lead_run[1:] != lead_run[:-1], [True]]))
        sizes = np.diff(edges)
        chunk, total, groups = [], 0, []
        for a, b in zip(edges[:-1][sizes > 1].tolist(), edges[1:][sizes > 1].tolist(), strict=True):
            chunk.append((a, b))
            total += sum(len(cuts[i]) for i in order[a:b])
            if total >= 1 << 21:
                groups.append(chunk)
                chunk, total = [], 0
        groups.append(chunk)
        for chunk in groups:
            if not chunk:
                continue
            members = np.concatenate([order[a:b] for a, b in chunk])
            run_of = np.repeat(np.arange(len(chunk)), [b - a for a, b in chunk])
            data = np.frombuffer(b"".join(cuts[i] for i in members), np.uint8)
            size = np.array([len(cuts[i]) for i in members])
            begin = np.cumsum(size) - size
            count = size - length + 1
            which = np.repeat(np.arange(len(members)), count)
            inner = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            distance = ahead[members][which] - inner  # of the anchor from the window's start
            key = run_of[which] * (1 << 20) + distance + (1 << 19)
            again = repeated_windows(data, begin[which] + inner, key, length, RollingHash(data))
            again &= ~many[members][which]
            hit = np.flatnonzero(again)
            if not len(hit):
                continue
            out = []
            for part in np.split(hit, np.flatnonzero(np.diff(which[hit])) + 1):
                m = members[which[part[0]]]
                out += [(int(row[m]), a, b) for a, b in _runs(int(first[m]) + inner[part], length)]
            rows, starts, ends = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["row", "start", "end"])

    return kinds.repartitionByRange(buckets, "lead").mapInArrow(run, "row long, start int, end int")


def _counted(kinds: DataFrame, length: int) -> DataFrame:
    """The same for hot leads: windows are counted by two hashes, and those of one segment alone stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, first, many, cut in zip(*(batch.column(n).to_pylist() for n in ("row", "first", "many", "bytes")), strict=True):
                data = np.frombuffer(cut, np.uint8)
                at = np.arange(len(data) - length + 1)
                a, b = (RollingHash(data, w).of(at, at + length).view(np.int64) for w in range(2))
                fixed = [pa.array(np.full(len(at), row)), pa.array((first + at).astype(np.int32)), pa.array(np.full(len(at), many))]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *fixed], ["w1", "w2", "row", "start", "many"])

    windows = kinds.mapInArrow(run, "w1 long, w2 long, row long, start int, many boolean")
    often = windows.groupBy("w1", "w2").count().where(F.col("count") > 1).drop("count")
    spans = windows.where(~F.col("many")).join(often, ["w1", "w2"], "left_semi")
    return spans.select("row", "start", (F.col("start") + length).cast("int").alias("end"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_kinds: int = BUCKET_KINDS) -> DataFrame:
    """(row, start, end) of spans whose bytes all lie in repeated strings; docs: (row, text), rows unique."""
    segments = _segments(docs, length, gram)
    classes = segments.groupBy("h").agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))
    classes = stored(classes.where(F.col("n") > 1).select("h", (F.col("low") < F.col("high")).alias("mixed")), "leads")
    found = stored(segments.join(classes, "h"), "segments")
    mixed = found.where("mixed")
    kinds = stored(mixed.groupBy("h", "s").agg(F.count("*").alias("n"), F.min(F.struct("row", "first", "last", "place")).alias("one")), "kinds")
    whole = ["row", F.col("first").alias("start"), (F.col("last") + length).cast("int").alias("end")]
    copies = mixed.join(kinds.where(F.col("n") > 1).select("h", "s"), ["h", "s"], "left_semi").select(*whole)
    shared = kinds.groupBy("h").agg(F.count("*").alias("kinds"))
    wanted = kinds.join(shared, "h").select("kinds", "one.*", (F.col("n") > 1).alias("many"))
    few = F.col("kinds") <= bucket_kinds
    held = wanted.where(few).agg(F.sum(F.col("last") - F.col("first") + (length + gram))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // BUCKET_BYTES))
    cool = _with_bytes(docs, wanted.where(F.col("kinds") <= bucket_kinds), length, gram)
    hot = _with_bytes(docs, wanted.where(F.col("kinds") > bucket_kinds), length, gram)
    return found.where("not mixed").select(*whole).union(copies).union(_compared(cool, length, gram, buckets)).union(_counted(hot, length))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted maximal runs; spans that touch are one run."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def deduplicated(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", bucket_kinds: int = BUCKET_KINDS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row; spans: the removed runs.

    All on UTF-8 bytes; null is empty. Ids may repeat or be null: rows are told apart by their place in
    the input, and equal texts of two rows remove each other if they have ``length`` bytes. ``docs`` must be
    a table or a checkpoint, one that every scan reads in the same order.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    lists = repeated_spans(rows.select("row", "text"), length, bucket_kinds=bucket_kinds).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, entries in zip(batch.column("text").to_pylist(), batch.column("list").to_pylist(), strict=True):
                data, found, at, kept = text.encode(), merged([(e["start"], e["end"]) for e in entries or []]), 0, sha256()
                for a, b in found:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append((len(data), sum(b - a for a, b in found), len(found), kept.hexdigest(), [{"start": a, "end": b} for a, b in found]))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    return rows.join(lists, "row", "left").select("id", "text", "list").mapInArrow(run, schema)
