"""Removing repeated passages by sorting suffixes.

A byte goes if it lies in a string of `length` bytes that also starts in a
document with a smaller id. The suffixes that matter are windows of `length`
bytes, and sorting all of them would move each text fifty times, so they travel
together: every window has an anchor, its `gram`-byte substring of least hash.
Equal windows have equal anchors, neighbouring windows mostly share one, and all
windows of an anchor are one piece of text (a run).

1. Documents are dealt into packs by a hash of their id. Each pack lists the
   distinct hashes of its anchors; a list met in one place tells which anchors
   occur in more than one document. Only those go on.
2. Splitters sampled from the anchors' leading bytes divide them into ranges; a
   range that the bounded number of splitters leaves too large is dealt further by
   a hash of the anchor. Each pack sends every distinct run once, with its smallest
   document id, to the range of its anchor. The windows of an anchor of very many
   packs travel singly, are dealt by their own bytes too, and are combined by
   groups of packs before their range sees them.
3. A range sorts its windows by multikey quicksort, eight bytes at a time, and
   neighbours in that order that are equal share their smallest document id. The
   sort goes by pieces of whole anchor groups, or, where one group is larger than
   a piece, by pieces of it in the order of its windows; the last window of a
   piece is compared with the first of the next, so equal windows on both sides
   of a border are one. Ranges hold whole anchors, or whole windows, and need no
   comparison between them.
4. Each pack marks what its documents have to give up.

Texts are shuffled once, by pack; what the later steps send are hashes, bits and
the runs that repeat.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.llm.common import cut

LENGTH, GRAM = 50, 20
# packs times buckets and packs times ranges are rows of the shuffles, so these are as large as a worker's memory allows; they only place rows
PACK_BYTES = 8 << 20
FILTER_BYTES = 24 << 20
RANGE_BYTES = 8 << 20
HOT_PACKS = 2048  # an anchor of more packs travels by window
FAN = 256  # packs whose windows of such anchors are combined together
SAMPLE_BYTES, SAMPLE_KEYS = 16 << 20, 50_000
PIECE = 200_000  # windows sorted at once
CHUNK = 1 << 16  # bytes hashed at once
MEET = 400_000  # runs of a range made distinct at once
_U = np.uint64
_MULT = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A hash for the k bytes from each position, put together from spans of 1, 2, 4 ... bytes."""
    n, h, out, done, span, rest = len(b) - k + 1, b.astype(_U) + _U(1), None, 0, 1, k
    while True:
        if rest & 1:
            part = h[done : done + n]
            out = part.copy() if out is None else out * _U(_MULT) + part
            done += span
        rest >>= 1
        if not rest:
            return mix64(out)
        h = h[:-span] * _U(_MULT + 2 * span) + h[span:]
        h ^= h >> _U(29)
        span *= 2


def least_in_window(h: np.ndarray, w: int) -> np.ndarray:
    """For each position the place of the least of the w values from there on by their leading 32 bits, the leftmost of equals."""
    key, span = (h & _U(0xFFFFFFFF << 32)) | np.arange(len(h), dtype=_U), 1
    while span * 2 <= w:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < w:
        d = w - span
        key = np.minimum(key[:-d], key[d:])
    return (key & _U(0xFFFFFFFF)).astype(np.int64)


class Runs:
    """The runs of some documents laid end to end: first and last window start, anchor and its hash, document number.

    Hashes are made for a few documents at a time, so that the arrays stay small.
    """

    def __init__(self, texts: list[bytes], length: int, gram: int, chunk: int = CHUNK):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.data = b"".join(texts)
        self.bytes = np.frombuffer(self.data, np.uint8)
        parts, lo = [], 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(self.end, self.start[lo] + chunk, side="right")))
            parts.append(self._chunk(lo, hi, length, gram))
            lo = hi
        kinds = (np.int64, np.int64, np.int64, np.int64, _U)
        self.first, self.last, self.anchor, self.doc, self.hash = (np.concatenate([p[k] for p in parts] or [np.zeros(0, t)]) for k, t in enumerate(kinds))

    def _chunk(self, lo: int, hi: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
        base, size = self.start[lo], self.size[lo:hi]
        b = self.bytes[base : self.end[hi - 1]]
        n = len(b) - length + 1
        if n <= 0:
            none = np.zeros(0, np.int64)
            return none, none, none, none, np.zeros(0, _U)
        h = gram_hashes(b, gram)
        at = least_in_window(h, length - gram + 1)
        inside = np.zeros(len(b) + 1, np.int8)
        long = size >= length
        np.add.at(inside, self.start[lo:hi][long] - base, 1)
        np.add.at(inside, self.end[lo:hi][long] - base - length + 1, -1)
        s = np.nonzero(np.cumsum(inside, dtype=np.int8)[:n])[0]
        p = at[s]
        doc = np.repeat(np.arange(lo, hi), np.maximum(0, size - length + 1))
        new = np.ones(len(s), bool)
        new[1:] = (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])
        i = np.nonzero(new)[0]
        anchor = p[i]
        last = s[np.append(i[1:], len(s)) - 1] if len(i) else s[i]
        # anchors have the least hashes of their windows, which would crowd the first buckets: mixed again they spread evenly
        return s[i] + base, last + base, anchor + base, doc[i], mix64(h[anchor] ^ _U(_MULT))


def texts_of(table: pa.Table) -> list[bytes]:
    return [x if x is not None else b"" for x in table.column("data").to_pylist()]


def in_order(table: pa.Table) -> pa.Table:
    """A pack's rows by id, then text: shuffled rows come in any order, and what one step numbers another must number alike."""
    ids, texts = table.column("doc_id").to_pylist(), texts_of(table)
    return table.take(pa.array(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i])), pa.int64()))


def anchor_lists(runs: Runs, ids: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of a pack, ascending, whether each is in several documents, and their buckets (ascending too)."""
    order = np.argsort(runs.hash, kind="stable")
    h, d = runs.hash[order], ids[runs.doc[order]]
    if not len(h):
        return h, np.zeros(0, bool), np.zeros(0, np.int64)
    at = np.nonzero(np.append(True, h[1:] != h[:-1]))[0]
    several = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)
    h = h[at]
    return h, several, (((h >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)


def six_bytes(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def multikey_order(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by their words, first word first, and which rows equal the one before in that order.

    Multikey quicksort: rows are split by one word, and only those that tie go on to the next.
    """
    order = np.argsort(words[0], kind="stable")
    x = words[0][order]
    same = np.append(False, x[1:] == x[:-1])
    for word in words[1:]:
        tied = same.copy()
        tied[:-1] |= same[1:]
        where = np.nonzero(tied)[0]
        if not len(where):
            break
        part, group = order[where], np.cumsum(~same[where])
        turn = np.lexsort((word[part], group))
        part = part[turn]
        order[where] = part
        x = word[part]
        equal = np.append(False, (x[1:] == x[:-1]) & (group[1:] == group[:-1]))
        same[where] = equal
    return order, same


def window_words(data: bytes, at: np.ndarray, length: int) -> list[np.ndarray]:
    """The windows from each place as eight-byte words; the last one ends with the window."""
    every = np.ndarray((max(0, len(data) - 7),), ">u8", data, strides=(1,))
    places = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])
    return [every[at + p].astype(_U) for p in places]


def pieces_in_order(data: bytes, at: np.ndarray, length: int, piece: int) -> Iterator[np.ndarray]:
    """Numbers of the windows from each place in pieces of at most `piece`, one after the other in the order of their text; within a piece in any order."""

    def split(part: np.ndarray, place: int) -> Iterator[np.ndarray]:
        if len(part) <= piece:
            yield part
        elif place >= length:  # equal throughout
            for k in range(0, len(part), piece):
                yield part[k : k + piece]
        else:
            word = every[at[part] + min(place, length - 8)]
            order = np.argsort(word, kind="stable")
            part, word = part[order], word[order]
            ends = np.append(np.nonzero(word[1:] != word[:-1])[0] + 1, len(part))
            lo = 0
            while lo < len(part):
                # as many whole groups of one leading word as fit, or a single one to be split by its next word
                k = int(np.searchsorted(ends, lo + piece, side="right")) - 1
                hi = int(ends[k]) if k >= 0 and ends[k] > lo else int(ends[k + 1])
                yield from split(part[lo:hi], place + 8 if hi - lo > piece else place)
                lo = hi

    every = np.ndarray((max(0, len(data) - 7),), ">u8", data, strides=(1,))
    yield from split(np.arange(len(at)), 0)


def width_of(longest: int) -> int:
    """Bytes of a run's record: the anchor's place, the number of windows, the text of at most `longest` bytes and zeros, in whole words."""
    return -(-(2 + longest) // 8) * 8


def records(data: np.ndarray, lo: np.ndarray, n: np.ndarray, place: np.ndarray, length: int, width: int) -> np.ndarray:
    """The records of runs of n windows from each position lo."""
    longest = width - 2
    data = np.append(data, np.zeros(longest, np.uint8))
    every = np.lib.stride_tricks.sliding_window_view(data, longest)
    out, column = np.empty((len(lo), width), np.uint8), np.arange(longest)
    for a in range(0, len(lo), 1 << 16):
        part = slice(a, a + (1 << 16))
        text = every[lo[part]]
        text[column >= (n[part] + length - 1)[:, None]] = 0
        out[part, 2:] = text
    out[:, 0], out[:, 1] = place, n
    return out


def distinct(recs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the records by a hash, where in it each distinct record starts, and the number of each record's distinct one.

    Hashes only bring equal records together; neighbours are compared in full. Should two
    records share a hash, one of them may count as several, which the later steps allow.
    """
    words = recs.view(np.uint64)
    h = np.zeros(len(recs), _U)
    for k in range(words.shape[1]):
        h = (h + words[:, k]) * _U(_MULT)
        h ^= h >> _U(29)
    order = np.argsort(h, kind="stable")
    new, h = np.ones(len(recs), bool), h[order]
    for a in range(1, len(recs), 1 << 16):
        part = slice(a, a + (1 << 16))
        tied = a + np.nonzero(h[part] == h[a - 1 : a - 1 + len(h[part])])[0]
        new[tied] = (words[order[tied]] != words[order[tied - 1]]).any(axis=1)
    number = np.empty(len(recs), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.nonzero(new)[0], number


def least_spans(recs: np.ndarray, docs: np.ndarray, length: int, gram: int, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The smallest document id of equal windows in all runs, by run, as spans of neighbouring windows with one id.

    Gives each run's number of spans and first span, and the spans' windows and ids.
    """
    if not len(recs):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    width, data = recs.shape[1], recs.tobytes()
    base = np.arange(len(recs), dtype=np.int64) * width + 2
    anchor = np.zeros((len(recs), -(-gram // 8) * 8), np.uint8)
    anchor[:, :gram] = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), gram)[base + recs[:, 0]]
    anchor = anchor.view(">u8").astype(_U)
    order, same = multikey_order([anchor[:, k] for k in range(anchor.shape[1])])
    counts = recs[order, 1].astype(np.int64)
    # whole anchor groups, several together or one that is larger than a piece
    ends = np.append(np.nonzero(~same)[0][1:], len(recs))
    total = np.cumsum(counts)[ends - 1]
    cuts, at_group = [0], 0
    while at_group < len(ends):
        at_group = max(at_group + 1, int(np.searchsorted(total, (total[at_group - 1] if at_group else 0) + piece, side="right")))
        cuts.append(int(ends[at_group - 1]))
    spans_of, spans, ids = [], [], []
    for lo, hi in zip(cuts, cuts[1:]):
        part, n = order[lo:hi], counts[lo:hi]
        stop = np.cumsum(n)
        at = np.arange(stop[-1]) + np.repeat(base[part] - (stop - n), n)
        whose = np.repeat(docs[part], n)
        group_of, lows, border, groups = np.empty(len(at), np.int64), [np.zeros(0, np.int64)], None, 0
        for some in pieces_in_order(data, at, length, piece):
            turn, same = multikey_order(window_words(data, at[some], length))
            some = some[turn]
            same[0] = data[at[some[0]] : at[some[0]] + length] == border  # the last window before this piece
            border = data[at[some[-1]] : at[some[-1]] + length]
            heads = np.nonzero(~same)[0]
            group_of[some] = groups - 1 + np.cumsum(~same)
            groups += len(heads)
            if same[0]:
                lows[-1][-1] = min(lows[-1][-1], int(whose[some[: heads[0] if len(heads) else None]].min()))
            if len(heads):
                lows.append(np.minimum.reduceat(whose[some], heads))
        found = np.concatenate(lows)[group_of]
        new = np.append(True, found[1:] != found[:-1])
        new[stop[:-1]] = True
        first = np.nonzero(new)[0]
        spans_of.append(np.add.reduceat(new.astype(np.int64), stop - n))
        spans.append(np.diff(np.append(first, len(found))))
        ids.append(found[first])
    k = np.empty(len(recs), np.int64)
    k[order] = np.concatenate(spans_of)
    start = np.empty(len(recs), np.int64)
    start[order] = np.cumsum(k[order]) - k[order]
    return k, start, np.concatenate(spans), np.concatenate(ids)


def least_documents(runs: list[bytes], docs: np.ndarray, length: int, gram: int, piece: int = PIECE) -> list[np.ndarray]:
    """For each run (a byte with the anchor's place, then the text) and each of its windows the smallest document id of equal windows in all runs."""
    size = np.array([len(r) - 1 for r in runs], np.int64)
    lo = np.cumsum(size + 1) - size
    data = np.frombuffer(b"".join(runs), np.uint8)
    recs = records(data, lo, size - length + 1, data[lo - 1], length, width_of(int(size.max(initial=0))))
    k, start, spans, ids = least_spans(recs, docs, length, gram, piece)
    return [np.repeat(ids[a : a + n], spans[a : a + n]) for a, n in zip(start, k)]


def splits_of(keys: np.ndarray, splitters: list[bytes], gram: int) -> np.ndarray:
    """The number of splitters up to each key (rows of gram bytes); keys are told apart by eight bytes, and in full where a splitter begins alike."""
    if not splitters:
        return np.zeros(len(keys), np.int64)

    def lead(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), 8), np.uint8)
        out[:, : min(8, gram)] = rows[:, :8]
        return out.view(">u8").ravel().astype(_U)

    border = np.frombuffer(b"".join(splitters), np.uint8).reshape(-1, gram)
    leads, own = lead(border), lead(keys)
    out, most = np.searchsorted(leads, own), np.searchsorted(leads, own, side="right")
    close = np.nonzero(out != most)[0]
    whole = f"S{gram}"  # zeros at the end don't count there, which matters to nothing, as all are of one size
    out[close] = np.searchsorted(border.copy().view(whole).ravel(), keys[close].view(whole).ravel(), side="right")
    return out


def pack_runs(runs: Runs, ids: np.ndarray, flags: dict[int, tuple[np.ndarray, np.ndarray]], buckets: int, splitters: list[bytes], shares: tuple[int, int], length: int, gram: int):
    """The repeated runs of a pack, each distinct one once, by range.

    Gives the range of each distinct run (ascending), its record, its smallest document id, and
    for each occurrence the run, the document number and the first window's start. A range is one
    of an anchor by its leading bytes and a share of it by a hash: of the anchor, or of a window
    that travels alone; the latter are odd.
    """
    h, _, bucket = anchor_lists(runs, ids, buckets)
    dup, hot = np.zeros(len(h), bool), np.zeros(len(h), bool)
    for k, (bits, hots) in flags.items():
        lo, hi = np.searchsorted(bucket, k), np.searchsorted(bucket, k, side="right")
        dup[lo:hi], hot[lo:hi] = bits[: hi - lo], hots[: hi - lo]
    spot = np.searchsorted(h, runs.hash)
    taken = np.nonzero(dup[spot])[0] if len(h) else np.zeros(0, np.int64)
    burst, n = hot[spot[taken]] if len(h) else np.zeros(0, bool), runs.last[taken] - runs.first[taken] + 1
    times = np.where(burst, n, 1)
    n = np.repeat(np.where(burst, 1, n), times)
    occ_at = np.repeat(runs.first[taken] - (np.cumsum(times) - times), times) + np.arange(len(n))
    taken, burst = np.repeat(taken, times), np.repeat(burst, times)
    anchor, occ_doc = runs.anchor[taken], runs.doc[taken]
    recs = records(runs.bytes, occ_at, n, anchor - occ_at, length, width_of(2 * length - gram))
    order, heads, occ = distinct(recs)
    head = order[heads]
    least = np.minimum.reduceat(ids[occ_doc[order]], heads) if len(heads) else np.zeros(0, np.int64)
    recs, burst = recs[head], burst[head]
    split = np.zeros(0, np.int64)
    if len(head):
        split = splits_of(np.lib.stride_tricks.sliding_window_view(runs.bytes, gram)[anchor[head]], splitters, gram)
    share = (runs.hash[taken[head]] % _U(shares[0])).astype(np.int64)
    if shares[1] > 1 and burst.any():
        one = gram_hashes(recs[burst, 2 : 2 + length].ravel(), length)[::length]
        share[burst] = (one % _U(shares[1])).astype(np.int64)
    else:
        share[burst] = 0
    where = (split * max(shares) + share) * 2 + burst
    by = np.argsort(where, kind="stable")
    turned = np.empty(len(by), np.int64)
    turned[by] = np.arange(len(by))
    return where[by], recs[by], least[by], turned[occ], occ_doc, occ_at


def to_blob(recs: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(recs.tobytes())


def from_blob(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(-1, width)


def ranges_in(where: np.ndarray) -> list[tuple[int, int, int]]:
    """Each range of an ascending list, and from where to where it goes."""
    cuts = np.nonzero(np.append(True, where[1:] != where[:-1]))[0] if len(where) else np.zeros(0, np.int64)
    return list(zip(where[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(where)]))


def flags_of(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out = {}
    for k, dup, hot in zip(table.column("bucket").to_pylist(), table.column("dup").to_pylist(), table.column("hot").to_pylist()):
        if dup is not None:
            out[k] = tuple(np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for x in (dup, hot))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot_packs: int = HOT_PACKS, pack_bytes: int = PACK_BYTES, with_text: bool = False, fan: int = FAN) -> DataFrame:
    """One row per input row: (doc_id, n_bytes, n_removed, n_spans, kept_sha256), with `with_text` also kept (binary).

    * null texts are empty; texts shorter than `length` keep all.
    * a repeat inside one document, or between rows that share an id, isn't removed.
    * rows with a null id are neither compared nor changed.
    * other columns are ignored; an empty table gives an empty result.
    """
    spark, width = docs.sparkSession, width_of(2 * length - gram)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.encode(F.col(text_col).cast("string"), "UTF-8"), F.lit(b"")).alias("data"))
    total = own.agg(F.sum(F.octet_length("data"))).collect()[0][0] or 0
    packs, buckets, ranges = (max(4, math.ceil(total / x)) for x in (pack_bytes, FILTER_BYTES, RANGE_BYTES))
    tasks = min(packs, 20_000)
    splitters = sampled_splitters(own, total, min(ranges, SAMPLE_KEYS), length, gram)
    shares = (-(-ranges // SAMPLE_KEYS), -(-packs // hot_packs))  # of a range, for runs and for single windows
    shared = spark.sparkContext.broadcast(splitters)  # at most SAMPLE_KEYS keys
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")

    text = own.withColumn("pack", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("data"))), F.lit(packs))).repartition(tasks, "pack")

    def ids_of(table: pa.Table) -> np.ndarray:
        return np.asarray(table.column("doc_id").combine_chunks().fill_null(-1 << 63)).astype(np.int64)

    def comparable(table: pa.Table) -> tuple[Runs, np.ndarray, list[bytes]]:
        texts, named = texts_of(table), table.column("doc_id").is_valid().to_pylist()
        runs = Runs([t if ok else b"" for t, ok in zip(texts, named)], length, gram)
        return runs, ids_of(table), texts

    def list_anchors(table: pa.Table) -> pa.Table:
        runs, ids, _ = comparable(in_order(table))
        h, several, bucket = anchor_lists(runs, ids, buckets)
        cuts = np.nonzero(np.append(True, bucket[1:] != bucket[:-1]))[0] if len(h) else []
        rows = [(int(bucket[a]), table.column("pack")[0].as_py(), six_bytes(h[a:b]), np.packbits(several[a:b]).tobytes()) for a, b in zip(cuts, [*cuts[1:], len(h)])]
        names = ["bucket", "pack", "hashes", "several"]
        return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, (pa.int64(), pa.int64(), pa.binary(), pa.binary())))})

    lists = text.groupBy("pack").applyInArrow(list_anchors, "bucket long, pack long, hashes binary, several binary")

    def meet(table: pa.Table) -> pa.Table:
        parts = [from_six(x) for x in table.column("hashes").to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(p)].astype(bool) for x, p in zip(table.column("several").to_pylist(), parts)]
        h, multi = np.concatenate(parts), np.concatenate(several)
        order = np.argsort(h, kind="stable")
        x = h[order]
        at = np.nonzero(np.append(True, x[1:] != x[:-1]))[0]
        n = np.diff(np.append(at, len(x)))
        dup, hot = np.zeros(len(h), bool), np.zeros(len(h), bool)
        dup[order] = np.repeat((n > 1) | np.logical_or.reduceat(multi[order], at), n)
        hot[order] = np.repeat(n > hot_packs, n)
        ends = np.cumsum([len(p) for p in parts])
        bits = [[np.packbits(f[e - len(p) : e]).tobytes() for e, p in zip(ends, parts)] for f in (dup, hot)]
        return pa.table({"pack": table.column("pack"), "bucket": table.column("bucket"), "dup": pa.array(bits[0], pa.binary()), "hot": pa.array(bits[1], pa.binary())})

    flags = lists.groupBy("bucket").applyInArrow(meet, "pack long, bucket long, dup binary, hot binary")

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"range": [], "pack": [], "blob": [], "docs": []}
        if left.num_rows:
            runs, ids, _ = comparable(in_order(left))
            where, recs, least, *_ = pack_runs(runs, ids, flags_of(right), buckets, shared.value, shares, length, gram)
            pack = left.column("pack")[0].as_py()
            for r, a, b in ranges_in(where):
                for k, v in zip(out, (r, pack, to_blob(recs[a:b]), least[a:b].tobytes())):
                    out[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    sent = text.groupBy("pack").cogroup(flags.groupBy("pack")).applyInArrow(send, "range long, pack long, blob binary, docs binary")

    group = F.floor(F.col("pack") / fan).alias("group")  # of packs
    combine_too = packs > hot_packs  # else no anchor is in so many packs
    if combine_too:
        sent = cut(sent, "sent")
        single = sent.where("range % 2 = 1").withColumn("group", group)

    def distinct_runs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct runs and their smallest document ids; for the runs of all rows their own ids and the numbers of their distinct ones; where rows end."""
        docs_ = [np.frombuffer(x, np.int64) for x in table.column("docs").to_pylist()]
        ends, own = np.cumsum([len(x) for x in docs_]), np.concatenate(docs_)
        recs, least, numbers, waiting, size, known = [], [], [], [], 0, 0

        def settle_some() -> None:
            nonlocal size, known
            some = np.concatenate(waiting)
            done = sum(map(len, numbers))
            order, heads, number = distinct(some)
            recs.append(some[order[heads]])
            least.append(np.minimum.reduceat(own[done : done + len(some)][order], heads))
            numbers.append(number + known)
            known, size = known + len(heads), 0
            waiting.clear()

        blobs = table.column("blob")
        for i in range(table.num_rows):
            waiting.append(from_blob(blobs[i].as_py(), width))
            size += len(waiting[-1])
            if size >= MEET or i == table.num_rows - 1:
                settle_some()
        if len(recs) == 1:
            return recs[0], least[0], own, numbers[0], ends
        some, low = np.concatenate(recs), np.concatenate(least)
        recs.clear()
        order, heads, number = distinct(some)
        return some[order[heads]], np.minimum.reduceat(low[order], heads), own, number[np.concatenate(numbers)], ends

    def answer_rows(table: pa.Table, n: np.ndarray, spans: np.ndarray, lows: np.ndarray, ends: np.ndarray) -> pa.Table:
        """What each row is told: spans of each of its runs (none if nothing is new), their windows and ids."""
        upto, rows, press = np.append(0, np.cumsum(n)), ([], [], []), zstandard.ZstdCompressor(1)
        n, spans = n.astype(np.uint8), spans.astype(np.uint8)
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            rows[0].append(n[a:b].tobytes())
            rows[1].append(spans[upto[a] : upto[b]].tobytes())
            rows[2].append(press.compress(lows[upto[a] : upto[b]].tobytes()))
        return pa.table({"pack": table.column("pack"), "range": table.column("range")} | {k: pa.array(v, pa.binary()) for k, v in zip(("n", "spans", "lows"), rows)})

    def combine(table: pa.Table) -> pa.Table:
        """The single windows of a group of packs as one row; its pack is below zero."""
        recs, least, *_ = distinct_runs(table.sort_by("pack"))
        row = {"range": table.column("range")[0].as_py(), "pack": -1 - table.column("group")[0].as_py(), "blob": to_blob(recs), "docs": least.tobytes()}
        return pa.table({k: pa.array([v], t) for (k, v), t in zip(row.items(), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))})

    def hand_out(members: pa.Table, answer: pa.Table) -> pa.Table:
        """What a group of packs was told, for each of its packs."""
        if not members.num_rows or not answer.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(("pack", "range", "n", "spans", "lows"), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))})
        members = members.sort_by("pack")
        _, least, own_docs, number, ends = distinct_runs(members)
        low = least.copy()
        told = np.frombuffer(answer.column("n")[0].as_py(), np.uint8).astype(bool)
        low[told] = np.frombuffer(zstandard.ZstdDecompressor().decompress(answer.column("lows")[0].as_py()), np.int64)
        found = low[number]
        news = found != own_docs
        return answer_rows(members, news.astype(np.int64), np.ones(int(news.sum()), np.int64), found[news], ends)

    def sort_range(table: pa.Table) -> pa.Table:
        recs, least, own_docs, number, ends = distinct_runs(table)
        k, start, spans, lows = least_spans(recs, least, length, gram)
        n, first = k[number], start[number]
        n[(n == 1) & (lows[first] == own_docs)] = 0
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return answer_rows(table, n, spans[at], lows[at], ends)

    told = "pack long, range long, n binary, spans binary, lows binary"
    if combine_too:
        fewer = single.groupBy("range", "group").applyInArrow(combine, "range long, pack long, blob binary, docs binary")
        answers = sent.where("range % 2 = 0").unionByName(fewer).groupBy("range").applyInArrow(sort_range, told)
        answers = cut(answers, "answers")
        for_groups = answers.where("pack < 0").withColumn("group", -1 - F.col("pack"))
        for_packs = single.groupBy("range", "group").cogroup(for_groups.groupBy("range", "group")).applyInArrow(hand_out, told)
        answers = answers.where("pack >= 0").unionByName(for_packs)
    else:
        answers = sent.groupBy("range").applyInArrow(sort_range, told)
    none = F.lit(None)
    side = flags.select("pack", "bucket", "dup", "hot", none.cast("long").alias("range"), none.cast("binary").alias("n"), none.cast("binary").alias("spans"), none.cast("binary").alias("lows")).unionByName(
        answers.select("pack", none.cast("long").alias("bucket"), none.cast("binary").alias("dup"), none.cast("binary").alias("hot"), "range", "n", "spans", "lows")
    )

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        left = in_order(left)
        runs, ids, texts = comparable(left)
        where, recs, least, occ, occ_doc, occ_at = pack_runs(runs, ids, flags_of(right), buckets, shared.value, shares, length, gram)
        # by default a run's own smallest document is the smallest of all its windows
        base_spans, base_lows, size = recs[:, 1].astype(np.int64), least, len(recs)
        del recs
        n_of, first_of, spans, lows = np.ones(size, np.int64), np.arange(size), [], []
        place = {r: (a, b) for r, a, b in ranges_in(where)}
        for r, n, s, w in zip(*(right.column(c).to_pylist() for c in ("range", "n", "spans", "lows"))):
            if r is None:
                continue
            a, b = place[r]
            n = np.frombuffer(n, np.uint8).astype(np.int64)
            told = n > 0
            n_of[a:b][told] = n[told]
            first_of[a:b][told] = size + np.cumsum(n)[told] - n[told]
            spans.append(np.frombuffer(s, np.uint8).astype(np.int64))
            lows.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(w), np.int64))
            size += len(spans[-1])
        spans, lows = np.concatenate([base_spans, *spans]), np.concatenate([base_lows, *lows])
        # every occurrence and every span of its run
        k = n_of[occ]
        ends = np.cumsum(k)
        step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - k, k)
        at = np.repeat(first_of[occ], k) + step
        before = np.cumsum(spans[at]) - spans[at]
        before -= np.repeat(before[ends - k], k) if len(ends) else 0
        lo = np.repeat(occ_at, k) + before
        gone = lows[at] < ids[np.repeat(occ_doc, k)]
        edge = np.zeros(len(runs.data) + 1, np.int32)
        np.add.at(edge, lo[gone], 1)
        np.add.at(edge, lo[gone] + spans[at][gone] - 1 + length, -1)
        mask = np.cumsum(edge, dtype=np.int32)[:-1] > 0
        out = {"doc_id": left.column("doc_id").to_pylist(), "n_bytes": [len(t) for t in texts], "n_removed": [], "n_spans": [], "kept_sha256": []}
        if with_text:
            out["kept"] = []
        for a, b, t, has in zip(runs.start.tolist(), runs.end.tolist(), texts, runs.size.tolist()):
            m = mask[a:b]
            removed = int(m.sum()) if has else 0
            kept = runs.bytes[a:b][~m].tobytes() if removed else t
            out["n_removed"].append(removed)
            out["n_spans"].append(int(m[0]) + int((m[1:] & ~m[:-1]).sum()) if removed else 0)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if with_text:
                out["kept"].append(kept)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    return text.groupBy("pack").cogroup(side.groupBy("pack")).applyInArrow(settle, schema)


def sampled_splitters(own: DataFrame, total: int, ranges: int, length: int, gram: int) -> list[bytes]:
    """Range borders for anchors' leading bytes, from a sample of about SAMPLE_BYTES of text and SAMPLE_KEYS anchors; they only place rows."""
    one_in = max(1, total // SAMPLE_BYTES)
    rare = max(1, min(total, SAMPLE_BYTES) // 16 // SAMPLE_KEYS)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                runs = Runs(texts_of(pa.Table.from_batches([batch.slice(at, 1000)])), length, gram)
                got = runs.anchor[runs.hash % _U(rare) == 0].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([runs.data[p : p + gram] for p in got], pa.binary())], ["key"])

    sample = own.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(one_in)) == 0).select("data")
    found = sorted(r["key"] for r in sample.mapInArrow(keys, "key binary").limit(4 * SAMPLE_KEYS).collect())
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that repeat across `documents`."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
