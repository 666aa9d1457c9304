"""Repeated passages, byte for byte, over all documents: refinement of buckets of fingerprints at content-chosen positions.

Not bucket-pointer refinement as dealt: each level groups fingerprints of its own bytes; bucket identifiers of later offsets
are not looked up (see the README).

Wanted is every 200-byte string (window) that starts at two or more places. Sorting all suffixes would ship every
position; buckets of equal strings are enough, and most positions can follow one that was chosen by content:

1. Initial q-gram buckets (q = 64): a position's bucket identifier is its q-gram's fingerprint. Each window is dealt to
   its leftmost position of least identifier, so equal windows are dealt to equal q-grams at equal offsets; about every
   69th byte is chosen. Windows dealt to one position form a run.
2. A q-gram that occurs once ends here: its runs can hold no repeat (buckets of one are final).
3. A bucket whose runs all have the same whole string is final too: all their windows repeat.
4. What is open is refined: of each different string one copy is kept and cut, by the distance to its chosen position,
   into stretches of 35 windows, whose buckets are the 166 bytes that all windows of a stretch share; the same two rules
   close most. What is open then goes down to single windows. There a window's identifier is made from those of
   shorter strings at its start and at later offsets, 64 to 128 to 200 bytes, each round reusing the last.

Counting is by grouped aggregates with partial sums; what has to meet its count again meets it in joins that Spark can
split, so a passage in a third of all documents is no hot spot. Texts only travel if a bitmap
of fixed size says that they are needed. Identifiers are 128 bits wide where they decide.
Null texts are empty; texts under 200 bytes lose nothing; identical rows are copies of each other; very long texts are
cut into pieces whose windows overlap, so memory stays bounded by a piece. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordspine.llm.bytehash import BYTE_TABLE, BYTE_TABLE_2, U, chunks, mix, powers, prefix_sums
from recordspine.llm.common import materialize, table

LENGTH = 200
Q = 64
PIECE = 1 << 18
STRETCH = 35
BITMAP_BITS = 25
_INDEX_BITS = U(22)
_LEFT, _RIGHT = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def fingerprints(sums: np.ndarray, n: int) -> np.ndarray:
    """Of all n-grams, from prefix sums."""
    _, down = powers(len(sums) - 1)
    return mix((sums[n:] - sums[:-n]) * down[: len(sums) - n])


def refine(buckets: np.ndarray, offset: int) -> np.ndarray:
    """Identifiers of longer strings from those at each position and at a later offset."""
    return mix(buckets[:-offset] * _LEFT + buckets[offset:] * _RIGHT)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def pieces(texts: list[bytes]) -> tuple[list[int], list[int], list[bytes]]:
    """Text number, offset and bytes of each piece; pieces of a long text overlap so that each window lies in one only."""
    of, at, out = [], [], []
    for i, t in enumerate(texts):
        if len(t) >= LENGTH:
            for start in range(0, len(t) - LENGTH + 1, PIECE):
                of.append(i)
                at.append(start)
                out.append(t[start : start + PIECE + LENGTH - 1])
    return of, at, out


def window_starts(parts: list[bytes]) -> np.ndarray:
    sizes = np.array([len(x) for x in parts])
    starts = np.cumsum([0, *sizes[:-1]])
    n = sizes - LENGTH + 1
    first = np.repeat(starts - np.cumsum([0, *n[:-1]]), n)
    return first + np.arange(n.sum())


def runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, first and last window, chosen position, q-gram bucket, identifier of the whole string) of all runs."""
    of, at, parts = pieces(texts)
    for lo, hi in chunks(parts, PIECE):
        data = np.frombuffer(b"".join(parts[lo:hi]), dtype=np.uint8)
        sums, sums2 = prefix_sums(data), prefix_sums(data, BYTE_TABLE_2)
        buckets = fingerprints(sums, Q)
        key = ((buckets >> _INDEX_BITS) << _INDEX_BITS) | np.arange(len(buckets), dtype=U)
        least = (sliding_min(key, LENGTH - Q + 1) & ((U(1) << _INDEX_BITS) - U(1))).astype(np.int64)
        p = window_starts(parts[lo:hi])
        a = least[p]
        cut = np.flatnonzero((np.diff(a) != 0) | (np.diff(p) != 1)) + 1
        p0, p1, anchor = p[np.concatenate(([0], cut))], p[np.concatenate((cut, [len(p)])) - 1], a[np.concatenate(([0], cut))]
        _, down = powers(len(data))
        whole = (sums2[p1 + LENGTH] - sums2[p0]) * down[p0] + (anchor - p0).astype(U) * _LEFT + (p1 - p0).astype(U) * _RIGHT
        starts = np.cumsum([0, *(len(x) for x in parts[lo:hi])])
        piece = np.searchsorted(starts, p0, side="right") - 1
        shift = np.array(at[lo:hi]) - starts[:-1]
        yield np.array(of[lo:hi])[piece], p0 + shift[piece], p1 + shift[piece], anchor + shift[piece], buckets[anchor], mix(whole)


def stretches(text: bytes, p0: int, more: int, lead: int) -> tuple[np.ndarray, ...]:
    """(first window, more, lead, bucket, whole) of a run's stretches; windows go by their distance to the chosen position."""
    p1, anchor = p0 + more, p0 + lead
    k = np.arange((anchor - p1) // STRETCH, (anchor - p0) // STRETCH + 1)
    core = anchor - k * STRETCH  # the last start in a full stretch; all its windows hold the bytes from there to the first one's end
    first, last = np.maximum(core - STRETCH + 1, p0), np.minimum(core, p1)
    data = np.frombuffer(text[p0 : p1 + LENGTH], dtype=np.uint8)
    sums, sums2 = prefix_sums(data), prefix_sums(data, BYTE_TABLE_2)
    _, down = powers(len(data))
    at, end = core - p0, core - p0 - STRETCH + 1 + LENGTH
    bucket = mix((sums[end] - sums[at]) * down[at] + k.astype(U))
    whole = (sums2[last + LENGTH - p0] - sums2[first - p0]) * down[first - p0] + (core - first).astype(U) * _LEFT + (core - last).astype(U) * _RIGHT
    return first, last - first, anchor - first, bucket, mix(whole)


def single_windows(text: bytes, p0: int, more: int, lead: int) -> tuple[np.ndarray, ...]:
    """The same of a stretch's windows, by doubling the buckets of shorter strings."""
    data = np.frombuffer(text[p0 : p0 + more + LENGTH], dtype=np.uint8)
    ids = [refine(refine(fingerprints(prefix_sums(data, x), Q), Q), LENGTH - 2 * Q) for x in (BYTE_TABLE, BYTE_TABLE_2)]
    at = np.arange(p0, p0 + more + 1)
    return at, np.zeros_like(at), np.zeros_like(at), *ids


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


ROWS = "key long, p int, more int, lead int, alone boolean, bucket long, whole long"


def _all_runs(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                keys = part.column(0).to_numpy()
                for of, p0, p1, anchor, bucket, whole in runs(part.column(1).to_pylist()):
                    yield _rows(keys[of], p0, p1 - p0, anchor - p0, np.ones(len(of), dtype=bool), bucket, whole)

    return docs.mapInArrow(run, ROWS)


def _rows(key, p, more, lead, alone, bucket, whole) -> pa.RecordBatch:
    numbers = [pa.array(x.astype(np.int32)) for x in (p, more, lead)]
    return pa.RecordBatch.from_arrays([pa.array(key), *numbers, pa.array(alone), _signed(bucket), _signed(whole)], names=["key", "p", "more", "lead", "alone", "bucket", "whole"])


def bitmap(keys: DataFrame) -> np.ndarray:
    """One bit for each key's hash in a bitmap of fixed size: what isn't in it is not among the keys."""
    h = f"shiftrightunsigned(key, {64 - BITMAP_BITS})"
    words = keys.groupBy(F.expr(f"cast(shiftright({h}, 6) AS int)").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast({h} & 63 AS int)))").alias("b"))
    got = words.toPandas()  # 2**19 rows at most
    out = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out


def _inside(keys: pa.Array, bits: np.ndarray) -> np.ndarray:
    h = keys.to_numpy().view(U) >> U(64 - BITMAP_BITS)
    return (bits.view(U)[(h >> U(6)).astype(np.int64)] >> (h & U(63))) & U(1) == 1


def packed(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(key, doc_id, packed text) of the rows whose key is in the bitmap."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            chosen = batch.filter(pa.array(_inside(batch.column(0), sent.value)))
            for lo in range(0, chosen.num_rows, 256):
                part = chosen.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([pack.compress(t) for t in part.column(2).to_pylist()], type=pa.binary())], names=["key", "doc_id", "packed"])

    return docs.mapInArrow(run, f"key long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, packed binary")


def _cut(docs: DataFrame, chosen: DataFrame, how) -> DataFrame:
    """The chosen strings cut by `how`, from their texts."""
    todo = chosen.groupBy("key").agg(F.collect_list(F.struct("p", "more", "lead", "alone")).alias("todo"))
    texts = packed(docs, bitmap(chosen)).join(todo, "key").dropDuplicates(["key"]).select("key", "packed", "todo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            made: list[tuple] = []
            for key, text, todo in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text = unpack.decompress(text.as_py())
                for r in todo.as_py():
                    first, more, lead, bucket, whole = how(text, r["p"], r["more"], r["lead"])
                    made.append((np.full(len(first), key), first, more, lead, np.full(len(first), r["alone"]), bucket, whole))
                    if len(made) >= 2000:
                        yield _rows(*map(np.concatenate, zip(*made, strict=True)))
                        made = []
            if made:
                yield _rows(*map(np.concatenate, zip(*made, strict=True)))

    return texts.mapInArrow(run, ROWS)


def _level(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Window ranges (key, p, more) that repeat for certain, and one copy of each string that is still open."""
    rows = materialize(rows, f"suffix-{name}-rows")
    buckets = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("lo"), F.max("whole").alias("hi")).where("n > 1")
    buckets = materialize(buckets.select("bucket", (F.col("lo") == F.col("hi")).alias("final")), f"suffix-{name}-buckets")
    left = materialize(rows.join(buckets, "bucket"), f"suffix-{name}")
    final = left.where("final AND alone").select("key", "p", "more")
    open_rows = left.where("NOT final")
    strings = open_rows.groupBy("bucket", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "p", "more", "lead", "alone")).alias("one"))
    strings = materialize(strings, f"suffix-{name}-strings")
    copied = open_rows.where("alone").join(strings.where("n > 1").select("bucket", "whole"), ["bucket", "whole"]).select("key", "p", "more")
    # Strings with copies have their result; they only serve others that hold a part of them.
    return final.unionByName(copied), strings.select("one.key", "one.p", "one.more", "one.lead", (F.col("one.alone") & (F.col("n") == 1)).alias("alone"))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(key, p, more): window starts p to p+more of rows (key, doc_id, text as binary) whose strings start elsewhere too."""
    by_run, chosen = _level(_all_runs(docs.select("key", "text")), "runs")
    by_stretch, chosen = _level(_cut(docs, chosen, stretches), "stretches")
    by_window, _ = _level(_cut(docs, chosen, single_windows), "windows")
    return by_run.unionByName(by_stretch).unionByName(by_window)


SPANS = "array<struct<start:int,end:int>>"


def _joined_sorted(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of intervals that are sorted by start."""
    reach = np.maximum.accumulate(ends)
    first = np.flatnonzero(np.concatenate(([True], starts[1:] > reach[:-1])))
    last = np.concatenate((first[1:] - 1, [len(starts) - 1]))
    return list(zip(starts[first].tolist(), reach[last].tolist(), strict=True))


def _joined(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(intervals):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _outside(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """The rows whose key isn't in the bitmap, as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~_inside(batch.column(0), sent.value)))

    return docs.mapInArrow(run, docs.schema)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: spans are the removed byte ranges, kept the remaining bytes."""
    body = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    found = materialize(repeated_runs(rows), "suffix-found")
    bits = bitmap(found)
    spans = found.groupBy("key").agg(F.collect_list(F.struct("p", "more")).alias("found"))
    hit = packed(rows, bits).join(spans, "key", "left").select("doc_id", "packed", "found")
    whole = _outside(rows, bits).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast(SPANS).alias("spans"), F.col("text").alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                sizes, all_spans, rest = [], [], []
                for text, hits in zip(part.column(1), part.column(2), strict=True):
                    data = unpack.decompress(text.as_py())
                    cut = []
                    if hits.is_valid:
                        p, more = (np.asarray(hits.values.field(k)) for k in ("p", "more"))
                        order = np.argsort(p, kind="stable")
                        cut = _joined_sorted(p[order], (p + more)[order] + LENGTH)
                    edges = [0, *(x for span in cut for x in span), len(data)]
                    sizes.append(len(data))
                    all_spans.append([{"start": a, "end": b} for a, b in cut])
                    rest.append(b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(all_spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(rest, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return hit.mapInArrow(run, f"doc_id {kind}, n_bytes long, spans {SPANS}, kept binary").unionByName(whole)


def query(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes]) -> list[tuple[int, int, str]]:
    """(removed, spans, sha256 of the rest) by a table of all windows: the measure for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for p in range(len(t) - LENGTH + 1):
            seen[t[p : p + LENGTH]] = seen.get(t[p : p + LENGTH], 0) + 1
    out = []
    for t in texts:
        spans = _joined([(p, p + LENGTH) for p in range(len(t) - LENGTH + 1) if seen[t[p : p + LENGTH]] > 1])
        edges = [0, *(x for s in spans for x in s), len(t)]
        kept = b"".join(t[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
        out.append((sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    return out
