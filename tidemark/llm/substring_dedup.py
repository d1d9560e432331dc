"""Removal of byte strings that an earlier document has: suffix order over content-dealt segments.

Each byte is removed that lies in a 50-byte window which also starts in a
document with a smaller doc_id; windows are judged on the input.

Windows are dealt by content: a window's anchor is the 28-byte string inside it
that the least of its hashed 5-byte strings selects (counted modulo 23), so equal
windows have equal anchors wherever they stand, and neighbouring windows mostly
share one. A run of windows with one anchor is a segment of at most 72 bytes.

0. Of documents with equal texts (at least 50 bytes) the first alone is drawn on;
   the others go whole.
1. Segments (anchor, content hash, document, place) are dealt by anchor, a text's
   equal ones as one row. Anchors
   in one document only fall out. A segment whose content an earlier document
   has is removed whole. What is left of a shared anchor, the first holders of
   each content, may share some windows with contents of another kind.
2. The holders' bytes are cut from the texts and dealt by anchor. Batches of
   segments, trimmed to what others may share and with the anchor as one symbol,
   are put in suffix order (:mod:`suffix_order`); neighbours that agree on all of
   a window's symbols are one window, whose least document decides.
3. Anchors with more than ``HOT_HOLDERS`` holders are not gathered in one task:
   their windows are dealt one by one, by a 128-bit hash of their bytes.

Contents are told apart by 64-bit hashes among the segments of one 64-bit anchor
hash; whole texts and windows of hot anchors by 128 bits.

Null texts count as empty. A null doc_id counts as greater than all ids. Rows
with equal doc_ids never remove each other's bytes, as neither id is smaller.
Texts below 50 bytes stay whole. Empty tables give no rows. Extra columns of the
input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, discard, staged
from .suffix_order import suffix_order

WINDOW = 50
ANCHOR = 28
STEP = 23  # windows of STEP anchors; ANCHOR + STEP - 1 = WINDOW
GRAM = 5  # ANCHOR mod STEP, so that the selected anchors move forward with the window
HOT_HOLDERS = 500
BATCH_BYTES = 1 << 20
SORT_BYTES = 1 << 19
BROADCAST_COPIES = 1_000_000
LAST_ID = (1 << 63) - 1
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * A
    x = (x ^ (x >> np.uint64(29))) * B
    return x ^ (x >> np.uint64(32))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
RADIX = 0x5851F42D4C957F2D


def powers(n: int) -> list[np.ndarray]:
    """RADIX ** i and its inverse modulo 2 ** 64, for i < n."""
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]), BATCH_BYTES)
        for k, radix in enumerate((RADIX, pow(RADIX, -1, 1 << 64))):
            steps = np.full(n, radix, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def words_at(raw: bytes) -> np.ndarray:
    """The little-endian 8-byte number at every place of ``raw`` (which is padded)."""
    return np.ndarray((len(raw),), "<u8", raw + b"\0" * 8, strides=(1,)).copy()


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    done, have = x, 1
    while 2 * have <= width:
        done, have = np.minimum(done[:-have], done[have:]), 2 * have
    rest = width - have
    return np.minimum(done[: len(done) - rest], done[rest:]) if rest else done


def segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """text number, start, anchor's offset, windows, anchor hash and content hash of every segment."""
    raw = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    offset = np.concatenate([[0], np.cumsum(sizes)])
    counts = np.maximum(sizes - WINDOW + 1, 0)
    total = int(counts.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 6
    v = words_at(raw)
    grams = mix(v & np.uint64((1 << 8 * GRAM) - 1))
    ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(raw), dtype=np.uint64)
    best = least_of(ranked, WINDOW - GRAM + 1)
    owner = np.repeat(np.arange(len(texts)), counts)
    begin = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + offset[owner]
    place = (best[begin] & np.uint64(0xFFFFFFFF)).astype(np.int64) - begin
    anchor = begin + place % STEP
    cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (begin[1:] != begin[:-1] + 1)])
    windows = np.diff(np.r_[cut, total])
    at = anchor[cut]
    key = mix(v[at]) + A
    for j in (8, 16, ANCHOR - 8):
        key = mix(key ^ v[at + j]) + B
    start = begin[cut]
    content = content_hashes(v, start, windows + WINDOW - 1)
    return owner[cut], start - offset[owner[cut]], at - start, windows, key.view(np.int64), content.view(np.int64)


def content_hashes(v: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the substrings, from running sums of weighted 8-byte numbers."""
    up, down = powers(len(v) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(v + np.uint64(seed)) * up[: len(v)], dtype=np.uint64)])
    return mix((sums[start + length - 7] - sums[start]) * down[start] + length.astype(np.uint64))


def batches_of(ids: list, texts: list[bytes]) -> Iterator[tuple[list, list[bytes]]]:
    """Runs of rows of about ``BATCH_BYTES``; a longer text stands alone."""
    held, run_ids, run = 0, [], []
    for i, t in zip(ids, texts):
        run_ids.append(i)
        run.append(t)
        held += len(t)
        if held >= BATCH_BYTES:
            yield run_ids, run
            held, run_ids, run = 0, [], []
    if run:
        yield run_ids, run


SEGMENT = "key long, content long, doc long, row long, spot long, more array<long>"


def first_of(owner: np.ndarray, key: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, list]:
    """The segments that are the first of their kind in their text, and the numbers of the others of each (None where there are none)."""
    with np.errstate(over="ignore"):
        kind = mix(key.view(np.uint64) ^ mix(content.view(np.uint64) + owner.astype(np.uint64) * A))
    order = np.argsort(kind, kind="stable")
    same = kind[order][1:] == kind[order][:-1]
    if not same.any():
        return np.arange(len(kind)), [None] * len(kind)
    head = np.flatnonzero(np.r_[True, ~same])
    sizes = np.diff(np.r_[head, len(kind)])
    others: dict[int, np.ndarray] = {}
    for a, n in zip(head[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        others[int(order[a])] = order[a + 1 : a + n]
    first = np.sort(order[head])
    return first, [others.get(i) for i in first.tolist()]


def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, row, text) to segments; ``spot`` packs start, anchor's offset and windows; a text's equal segments are one row, ``more`` has the others' spots."""
    names = ["key", "content", "doc", "row", "spot", "more"]
    for batch in batches:
        texts = [t.as_buffer().to_pybytes() for t in batch.column(2)]
        marks = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for ids, run in batches_of(marks, texts):
            owner, start, ahead, windows, key, content = segments(run)
            spot = start << 16 | ahead << 8 | windows
            first, others = first_of(owner, key, content)
            mark = np.array(ids, np.int64).reshape(-1, 2)[owner[first]]
            more = pa.array([None if x is None else spot[x] for x in others], pa.list_(pa.int64()))
            columns = [key[first], content[first], mark[:, 0], mark[:, 1], spot[first]]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x)) for x in columns), more], names)


def classify(found: DataFrame) -> DataFrame:
    """doc, row, spot, key, kind of the segments that matter: 0 removed whole, 1 a holder to compare, 2 a holder of a hot anchor."""
    same = Window.partitionBy("key", "content")
    anchor = Window.partitionBy("key")
    dealt = found.repartition("key").withColumn("first", F.min("doc").over(same))
    dealt = dealt.withColumns(
        {
            "least": F.min("doc").over(anchor),
            "most": F.max("doc").over(anchor),
            "one": F.min("content").over(anchor) == F.max("content").over(anchor),
            "holders": F.sum((F.col("doc") == F.col("first")).cast("long")).over(anchor),
        }
    ).filter("least < most AND (doc > first OR NOT one)")
    kind = F.when(F.col("doc") > F.col("first"), 0).when(F.col("holders") <= HOT_HOLDERS, 1).otherwise(2)
    spots = F.explode(F.concat(F.array("spot"), F.coalesce("more", F.array().cast("array<long>")))).alias("spot")
    return dealt.select("doc", "row", spots, "key", "content", kind.cast("int").alias("kind"))


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, row, text, wanted) to the holders' bytes (kind 1) and to hashes of single windows (kind 2)."""
    names = ["kind", "key", "second", "doc", "row", "spot", "bytes"]
    for batch in batches:
        docs, marks, texts, wanted = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()
        for doc, mark, text, asked in zip(docs, marks, texts, wanted):
            raw = text.as_buffer().to_pybytes()
            v, rows, hot = words_at(raw), [], []
            for a in asked:
                s, n = a["spot"] >> 16, a["spot"] & 255
                if a["kind"] < 2:
                    rows.append((a["kind"], a["key"], 0, doc, mark, a["spot"], raw[s : s + n + WINDOW - 1]))
                else:
                    hot.extend(range(s, s + n))
            if hot:
                at = np.array(hot, np.int64)
                length = np.full(len(at), WINDOW, np.int64)
                h0, h1 = (content_hashes(v, at, length, seed).view(np.int64).tolist() for seed in (1, 2))
                rows.extend((2, a, b, doc, mark, s << 16 | 1, None) for a, b, s in zip(h0, h1, hot))
            if rows:
                columns = list(zip(*rows))
                kinds = [pa.int32(), *[pa.int64()] * 5, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


SIDE = WINDOW - ANCHOR  # bytes of a window beside its anchor, on both sides together


def sides(parts: list[bytes], ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes before (backwards) and after the anchors, as padded rows, and the anchors."""
    m = len(parts)
    sizes = np.array([len(p) for p in parts], np.int64)
    raw = np.frombuffer(b"".join(parts) + bytes(ANCHOR + SIDE), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    j = np.arange(24)[None, :]
    at = (begin + ahead)[:, None]
    left = np.where(j < ahead[:, None], raw[np.maximum(at - 1 - j, 0)], 255)
    after = np.minimum(sizes - ahead - ANCHOR, SIDE)
    right = np.where(j < after[:, None], raw[np.minimum(at + ANCHOR + j, len(raw) - 1)], 255)
    anchors = raw[at + np.arange(ANCHOR)[None, :]]
    return left.astype(np.uint8), right.astype(np.uint8), anchors.reshape(m, ANCHOR)


def reach(group: np.ndarray, side: np.ndarray) -> np.ndarray:
    """How far each row agrees with some other row of its group: the neighbours in sorted order agree the furthest."""
    order = np.lexsort((*side.view(">u8").T[::-1], group))
    rows, same = side[order], group[order][1:] == group[order][:-1]
    differ = rows[1:] != rows[:-1]
    agreed = np.where(differ.any(1), differ.argmax(1), side.shape[1]) * same
    out = np.zeros(len(group), np.int64)
    out[order] = np.maximum(np.r_[0, agreed], np.r_[agreed, 0])
    return out


def repeated(docs: np.ndarray, parts: list[bytes], ahead: np.ndarray) -> list[np.ndarray]:
    """For each segment the windows (offsets) that a segment of a smaller document has too.

    Segments are trimmed to what another one with their anchor may share, and
    the anchor is one symbol; a window is then ``SIDE + 1`` symbols that hold it.
    """
    left, right, anchors = sides(parts, ahead)
    _, group = np.unique(np.ascontiguousarray(anchors).view(f"V{ANCHOR}").ravel(), return_inverse=True)
    sizes = np.array([len(p) for p in parts], np.int64)
    before = np.minimum(reach(group, left), np.minimum(ahead, SIDE))
    after = np.minimum(reach(group, right), np.minimum(sizes - ahead - ANCHOR, SIDE))
    out = [np.zeros(0, np.int64)] * len(parts)
    kept = np.flatnonzero(before + after >= SIDE)
    if not len(kept):
        return out
    before, after, group = before[kept], after[kept], group[kept]
    length = before + after + 2  # with the anchor and a mark that ends the segment
    begin = np.concatenate([[0], np.cumsum(length)])
    owner = np.repeat(np.arange(len(kept)), length)
    inside = np.arange(begin[-1]) - begin[owner]
    symbols = np.zeros(begin[-1], np.int64)
    k = inside < before[owner]
    symbols[k] = left[kept[owner[k]], before[owner[k]] - 1 - inside[k]].astype(np.int64) + 1
    k = inside == before[owner]
    symbols[k] = 257 + group[owner[k]]
    k = (inside > before[owner]) & (inside <= before[owner] + after[owner])
    symbols[k] = right[kept[owner[k]], inside[k] - before[owner[k]] - 1].astype(np.int64) + 1
    order = suffix_order(symbols)
    place = inside[order]
    full = (place <= before[owner[order]]) & (place + SIDE < length[owner[order]] - 1)
    order, place = order[full], place[full]
    rows = np.lib.stride_tricks.sliding_window_view(np.r_[symbols, np.zeros(SIDE, np.int64)], SIDE + 1)[order]
    new = np.r_[True, (rows[1:] != rows[:-1]).any(1)]
    doc = docs[kept[owner[order]]]
    least = np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1]
    later = doc > least
    who, spot = owner[order][later], place[later]
    spot = spot + ahead[kept[who]] - before[who]  # from the trimmed segment's start to the segment's
    ranked = np.lexsort((spot, who))
    who, spot = who[ranked], spot[ranked]
    cuts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(who)]):
        out[kept[who[a]]] = spot[a:b]
    return out


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, doc, row, spot, bytes) sorted by key to removed spots (doc, row, spot)."""

    def flush(rows):
        # a document that has a segment twice lends it once
        first: dict[tuple, int] = {}
        which = [first.setdefault((r[0], r[1], r[4]), len(first)) for r in rows]
        docs = np.array([d for _, d, _ in first], np.int64)
        ahead = np.zeros(len(first), np.int64)
        for i, r in zip(which, rows):
            ahead[i] = r[3] >> 8 & 255
        found = repeated(docs, [p for _, _, p in first], ahead)
        doc, mark, spot = [], [], []
        for i, (_, d, m, s, _) in zip(which, rows):
            windows = found[i]
            if len(windows):
                cut = np.flatnonzero(np.r_[True, windows[1:] != windows[:-1] + 1])
                for a, n in zip(windows[cut].tolist(), np.diff(np.r_[cut, len(windows)]).tolist()):
                    doc.append(d)
                    mark.append(m)
                    spot.append(((s >> 16) + a) << 16 | n)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, mark, spot)], ["doc", "row", "spot"])

    rows, held = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held >= SORT_BYTES and row[0] != rows[-1][0]:  # an anchor's segments stay together
                yield flush(rows)
                rows, held = [], 0
            rows.append(row)
            held += len(row[4])
    if rows:
        yield flush(rows)


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[] for _ in range(5)]
        for doc, text, spots in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            raw = text.as_buffer().to_pybytes()
            packed = np.array(spots.as_py() or [], np.int64)
            row = cover(raw, packed >> 16, packed & 255)
            for column, x in zip(out, (doc, *row)):
                column.append(x)
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def cover(raw: bytes, start: np.ndarray, windows: np.ndarray) -> tuple[int, int, int, str]:
    """Bytes, removed bytes, maximal removed runs and the digest of the rest."""
    if not len(start):
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest()
    change = np.zeros(len(raw) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + windows + WINDOW - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return len(raw), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()


def copies_of(rows: DataFrame) -> DataFrame:
    """doc, row of the texts of at least a window that a smaller doc has word for word (by a 128-bit hash)."""
    marked = rows.filter(F.octet_length("text") >= WINDOW).select("doc", "row", F.xxhash64("text").alias("h0"), F.xxhash64("text", F.lit(1)).alias("h1"))
    least = marked.groupBy("h0", "h1").agg(F.min("doc").alias("least"), F.count("*").alias("n")).filter("n > 1")
    return staged(marked.join(least, ["h0", "h1"]).filter("doc > least").select("doc", "row").distinct(), "copies")


def shift_of(docs: DataFrame) -> int:
    """What to take from all ids so that ``LAST_ID`` is free for rows without one."""
    least, most = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    if most != LAST_ID:
        return 0
    if least == -LAST_ID - 1:
        raise ValueError("ids from the least to the greatest long leave no place for rows without an id")
    return 1


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    spark = docs.sparkSession
    arrow_rows(spark, 500)
    shift = shift_of(docs)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long") - F.lit(shift), F.lit(LAST_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    repeats = not rows.groupBy("doc").count().filter("count > 1").isEmpty()
    rows = rows.select("doc", (F.xxhash64("text") if repeats else F.lit(0).cast("long")).alias("row"), "text")
    copies = copies_of(rows)
    small = copies.count() <= BROADCAST_COPIES  # two longs each; beyond that the table is shuffled
    side = F.broadcast(copies) if small else copies
    whole_rows = rows.join(side, ["doc", "row"], "left_semi")
    rows = rows.join(side, ["doc", "row"], "left_anti")
    # rows that repeat id and text are drawn on once
    once = rows.groupBy("doc", "row").agg(F.first("text").alias("text")) if repeats else rows
    known = staged(classify(once.filter(F.octet_length("text") >= WINDOW).select("doc", "row", "text").mapInArrow(draw, SEGMENT)), "shared-segments")
    wanted = known.filter("kind > 0").groupBy("doc", "row").agg(F.collect_list(F.struct("spot", "key", "kind")).alias("wanted"))
    schema = "kind int, key long, second long, doc long, row long, spot long, bytes binary"
    held = staged(once.join(wanted, ["doc", "row"]).select("doc", "row", "text", "wanted").mapInArrow(cut_out, schema), "holders")
    sorted_ = held.filter("kind = 1").select("key", "doc", "row", "spot", "bytes").repartition("key").sortWithinPartitions("key", "doc", "spot")
    by_order = sorted_.mapInArrow(compare, "doc long, row long, spot long")
    hot = held.filter("kind = 2")
    least = hot.groupBy("key", "second").agg(F.min("doc").alias("least"))
    by_hash = hot.join(least, ["key", "second"]).filter("doc > least").select("doc", "row", "spot")
    whole = known.filter("kind = 0").select("doc", "row", "spot")
    removed = staged(whole.unionByName(by_order).unionByName(by_hash), "removed")
    spots = removed.groupBy("doc", "row").agg(F.collect_list("spot").alias("spots"))
    done = rows.join(spots, ["doc", "row"], "left").select("doc", "text", "spots").mapInArrow(
        finish, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
    size = F.octet_length("text").cast("long")
    gone = whole_rows.select("doc", size.alias("n_bytes"), size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    done = done.unionByName(gone)
    return done.select(F.when(F.col("doc") != LAST_ID, F.col("doc") + F.lit(shift)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
