"""Near-duplicate documents by ProbMinHash.

A text is the weighted set of its five-word shingles, the weight being how often
a shingle occurs. Each shingle sends arrivals of a Poisson process whose rate is
its weight to random slots of the signature; the first arrival in a slot names
its shingle there, and a shingle stops as soon as its next arrival would come
after the last slot's first. Two signatures agree in a slot with the probability
Jaccard similarity of the texts.

Texts with the same words are one class before anything is compared. Bands of
the signature place similar texts in common buckets. In each bucket every member
is compared with one leader, so copies cost a row each and not a pair each. A
bucket that still holds several groups gets a second leader, the member most
like the others by signature: edited copies are like the text they come from and
less like each other. Members of groups that are apart even then are compared
across groups by a longer signature, in blocks, each pair in the first bucket
they share, and only what may reach the threshold is verified. Verification is
exact, on the shingles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.llm.common import components, cut, drop_cut, hot_keys, salted

WORDS = 5
SIMILAR = 0.8
SLOTS = 128
BAND = 4  # slots in a band: 32 bands miss a pair at 0.8 with probability 5e-8
FINE_SLOTS = 1024  # of the longer signature, four bits each
SLACK = 0.06  # it estimates within this (4.6 standard deviations at 0.8)
BLOCK = 2048
PIECE_BYTES = 4 << 20  # of text sketched at once
CACHED = 4096  # texts whose shingles a verifying task remembers
_WORD = re.compile(r"\w+")
_U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection that scatters 64-bit values."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list[str], k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles in ascending order and their counts; a shorter text is one shingle, an empty one none."""
    if not words:
        return np.zeros(0, _U64), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), _U64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, 0x9E3779B97F4A7C15, _U64)
    for i in range(min(k, len(h))):
        out = mix64(out * _U64(3) + h[i : i + n])
    return np.unique(out, return_counts=True)


def probminhash(sets: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """Signatures (rows of uint64) of weighted sets, all at once; the row of an empty set is zero."""
    sizes = np.array([len(h) for h, _ in sets], np.int64)
    first = np.full(len(sets) * slots, np.inf)
    name = np.zeros(len(sets) * slots, _U64)
    if not sizes.sum():
        return name.reshape(len(sets), slots)
    doc = np.repeat(np.arange(len(sets)), sizes)
    item = np.concatenate([h for h, _ in sets])
    rate = np.concatenate([w for _, w in sets]).astype(float)
    time, step = np.zeros(len(item)), 0
    latest = np.full(len(sets), np.inf)
    while len(item):
        r = mix64(item + _U64((step * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((r >> _U64(11)).astype(float) + 1) / (1 << 53)) / rate
        live = time < latest[doc]  # early termination: what comes later can't be first anywhere
        doc, item, rate, time, r = doc[live], item[live], rate[live], time[live], r[live]
        if not len(item):
            break
        at = doc * slots + (mix64(r) >> _U64(32)).astype(np.int64) % slots
        early = time < first[at]
        at, t, who = at[early], time[early], item[early]
        np.minimum.at(first, at, t)
        won = first[at] == t
        name[at[won]] = who[won]
        latest = first.reshape(len(sets), slots).max(1)
        step += 1
    return name.reshape(len(sets), slots)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets (for equal weights the plain Jaccard): the sum over common items of
    1 / sum over all items j of max(a_j/a_i, b_j/b_i)."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    if wa.max() == 1 and wb.max() == 1:
        return len(ia) / (len(ha) + len(hb) - len(ia))
    # items in order of their ratio b/a: for item i those with a larger ratio contribute b_j/b_i, the others a_j/a_i
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    below = np.cumsum(x[order])  # a-weight of ratios up to this one
    above = y.sum() - np.cumsum(y[order])
    return float(np.sum(1 / ((only_a + below) / x[order] + (only_b + above) / y[order])))


def text_hash(text: Column) -> Column:
    """What tells the texts of a repeated id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def pieces(batch: pa.RecordBatch, text: int, rows: int, nbytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most so many rows, and so many bytes of text unless one text has more."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
    at = 0
    while at < batch.num_rows:
        fit = int(np.searchsorted(np.cumsum(size[at : at + rows]), nbytes, side="right"))
        n = max(1, fit)
        yield batch.slice(at, n)
        at += n


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, class_key, signature): a 128-bit digest of the words, null for a text without any; of copies that come together one has the signature."""
    for batch in batches:
        for part in pieces(batch, 2, 512):
            keys, sets, place = [], [], {}
            for t in part.column(2):
                w = words_of(t.as_py())
                k = xxhash.xxh3_128_digest(" ".join(w)) if w else None
                if k is not None and k not in place:
                    place[k] = len(sets)
                    sets.append(shingles(w))
                keys.append(k)
            rows = probminhash(sets).astype(np.uint32)
            signatures = [rows[place.pop(k)].tobytes() if k in place else None for k in keys]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "text_hash", "class_key", "signature"])


def _low_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(low, class_key, text) of (low, text)."""
    for batch in batches:
        keys = [xxhash.xxh3_128_digest(" ".join(words_of(t))) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(1)], ["low", "class_key", "text"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [bands_of(np.frombuffer(x, np.uint32)) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["doc", "bands"])


def bands_of(row: np.ndarray) -> list[int]:
    """One key for each band; the band's number is part of it."""
    parts = row.astype(_U64).reshape(-1, BAND)
    out = np.arange(1, len(parts) + 1, dtype=_U64)
    for i in range(BAND):
        out = mix64(out + parts[:, i])
    return out.astype(np.int64).tolist()


def _verify(limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def weighted(doc: int, text: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
            got = known.get(doc)
            if got is None:
                if len(known) >= CACHED:
                    known.clear()
                got = known[doc] = shingles(words_of(text.as_py()))
            return got

        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            keep, found = [], []
            for i, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist())):
                s = similarity(weighted(x, ta[i]), weighted(y, tb[i]))
                if s >= limit:
                    keep.append(i)
                    found.append(s)
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([a.take(at), b.take(at), pa.array(found, pa.float64())], ["src", "dst", "similarity"])

    return run


def verify(pairs: DataFrame, texts: DataFrame, limit: float) -> DataFrame:
    """Pairs (src, dst) whose texts reach the limit; texts (doc, text) are fetched by two joins, hot leaders by Spark's skew handling."""
    a = texts.select(F.col("doc").alias("src"), F.col("text").alias("src_text"))
    b = texts.select(F.col("doc").alias("dst"), F.col("text").alias("dst_text"))
    both = pairs.join(b, "dst").join(a, "src").select("src", "dst", "src_text", "dst_text")
    return both.mapInArrow(_verify(limit), "src long, dst long, similarity double")


def _medoids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, doc, score): of each block the member whose signature agrees most with those of the others."""
    for batch in batches:
        rows = []
        for row in (batch.slice(r, 1).to_pylist()[0] for r in range(batch.num_rows)):
            sig = np.frombuffer(b"".join(row["signatures"]), np.uint32).reshape(len(row["docs"]), -1)
            agree = np.concatenate([(sig[i : i + 16, None] == sig[None]).sum((1, 2)) for i in range(0, len(sig), 16)])
            best = int(np.lexsort((np.array(row["docs"]), -agree))[0])
            rows.append((row["band"], row["docs"][best], float(agree[best]) / len(sig)))
        kinds = (pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["band", "doc", "score"])


#: how many of the two slots in a byte agree, by the exclusive or of two bytes
_AGREE = np.array([(x < 16) + (x % 16 == 0) for x in range(256)], np.uint8)


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, fine): the longer signature, four bits for each slot."""
    for batch in batches:
        for part in pieces(batch, 1, 64):
            sig = (probminhash([shingles(words_of(t.as_py())) for t in part.column(1)], FINE_SLOTS) & _U64(15)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([row.tobytes() for row in sig[:, ::2] | sig[:, 1::2] << 4], pa.binary())], ["doc", "fine"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, places): 32 bits of each band key, by which the first bucket that two documents share is known."""
    for batch in batches:
        rows = [np.array(bands_of(np.frombuffer(x, np.uint32)), np.int64).astype(np.uint32).tobytes() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["doc", "places"])


def _cross_groups(limit: float):
    """Pairs of different groups between two blocks of a bucket that may reach the limit, each in the first bucket the pair shares.

    Four bits agree by chance once in sixteen; the limit is raised by that.
    """
    least = (1 + 15 * (limit - SLACK)) / 16 * FINE_SLOTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for row in (batch.slice(r, 1).to_pylist()[0] for r in range(batch.num_rows)):
                da, db, ga, gb = (np.array(row[k]) for k in ("docs", "docs2", "groups", "groups2"))
                pa_, pb = (np.frombuffer(b"".join(row[k]), np.uint32).reshape(len(d), -1) for k, d in (("places", da), ("places2", db)))
                fa, fb = (np.frombuffer(b"".join(row[k]), np.uint8).reshape(len(d), -1) for k, d in (("fine", da), ("fine2", db)))
                here = int(np.nonzero(pa_[0] == np.uint32(row["band"] & 0xFFFFFFFF))[0][0])
                for i in range(len(da)):
                    j = np.nonzero((gb != ga[i]) & ((db > da[i]) if row["same"] else True))[0]
                    j = j[~(pb[j, :here] == pa_[i, :here]).any(1)]
                    j = j[_AGREE[fb[j] ^ fa[i]].sum(1, dtype=np.int64) >= least]
                    src.append(np.minimum(da[i], db[j]))
                    dst.append(np.maximum(da[i], db[j]))
            empty = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src or [empty])), pa.array(np.concatenate(dst or [empty]))], ["src", "dst"])

    return run


def mixed_members(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(band, doc, grp, block, blocks) of the buckets that hold several groups; of two members, one was compared with the other as its leader."""
    placed = members.select("band", "doc").join(groups.select(F.col("id").alias("doc"), "component"), "doc", "left").select(
        "band", "doc", F.coalesce("component", "doc").alias("grp")
    )
    mixed = placed.groupBy("band").agg(F.min("grp").alias("a"), F.max("grp").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b AND n > 2")
    out = placed.join(mixed.select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "band")
    return out.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: float = SIMILAR) -> DataFrame:
    """One row per input row: (doc_id, class_id, group_id, kept, text_hash).

    class_id is the smallest id among texts with the same words, group_id the
    smallest id of the classes linked, directly or not, by a similarity of
    `limit` or more; kept marks the row that stands for its group.
    * texts without words (null, empty, signs only) link with nothing: each is its own group.
    * texts of fewer than five words have one shingle, their words together.
    * rows with a null id are left as they are: their own group, kept.
    * rows that repeat an id are documents of their own if their texts differ; two
      groups may then show the same smallest id. Of several texts of that id in a
      group one is kept; rows that are equal altogether are kept or not together.
    * other columns are ignored; an empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    keyed = cut(own.mapInArrow(_sketch, "doc_id long, text_hash long, class_key binary, signature binary"), "keys")
    ids = keyed.where(F.col("doc_id").isNotNull() & F.col("class_key").isNotNull())
    ids = salted(ids, hot_keys(ids.select("class_key"), "class_key"), "class_key", F.col("doc_id"), 64)
    parts = ids.groupBy("class_key", "_salt").agg(F.min("doc_id").alias("low"), F.max("signature").alias("signature"))
    tops = parts.groupBy("class_key").agg(F.min("low").alias("doc"), F.max("signature").alias("signature"))
    signed = cut(tops.withColumn("low", F.col("doc")), "signatures")
    # a class is known by its smallest id, or, where that id comes with several texts, by a hash of its words
    several = ids.groupBy("doc_id").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi")).where("lo < hi")
    shared = cut(several.select(F.col("doc_id").alias("doc")), "shared")
    repeats = not shared.isEmpty()
    if repeats:
        signed = cut(signed.join(shared.withColumn("several", F.lit(True)), "doc", "left").select(
            "class_key", F.when(F.col("several"), F.xxhash64("class_key")).otherwise(F.col("doc")).alias("doc"), "signature", "low"
        ), "signatures")
    banded = signed.select("doc", "signature").mapInArrow(_bands, "doc long, bands array<long>").select("doc", F.explode("bands").alias("band"))
    leaders = banded.groupBy("band").agg(F.min("doc").alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = cut(banded.join(leaders, "band").select("band", "doc", "src"), "members")
    stars = members.where("doc > src").select("src", F.col("doc").alias("dst")).distinct()
    paired = members.select("doc").distinct()
    if repeats:
        texts = texts_of_repeats(own, signed, shared, paired)
    else:
        texts = own.select(F.col("doc_id").alias("doc"), "text").join(paired, "doc").groupBy("doc").agg(F.min("text").alias("text"))
    texts = cut(texts, "texts")
    links = cut(verify(stars, texts, limit).select("src", "dst"), "links")
    groups = cut(components(links), "groups")
    spent = [members, texts, links]

    # a second leader for buckets that still hold several groups
    mixed = cut(mixed_members(members, groups), "mixed")
    spent.append(mixed)
    if not mixed.isEmpty():
        sigs = signed.select("doc", "signature")
        blocks = mixed.join(sigs, "doc").groupBy("band", "block").agg(F.collect_list("doc").alias("docs"), F.collect_list("signature").alias("signatures"))
        second = blocks.select("band", "docs", "signatures").mapInArrow(_medoids, "band long, doc long, score double").groupBy("band").agg(F.max_by("doc", F.struct("score", -F.col("doc"))).alias("lead"))
        # each block of a bucket gets the leader, so that a large bucket isn't joined in one place
        second = second.join(mixed.groupBy("band").agg(F.max("blocks").alias("blocks")), "band").select(
            "band", "lead", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        )
        pairs = mixed.join(second, ["band", "block"]).where("doc <> lead").select(F.least("doc", "lead").alias("src"), F.greatest("doc", "lead").alias("dst")).distinct().join(stars, ["src", "dst"], "left_anti")
        links = cut(links.union(verify(pairs, texts, limit).select("src", "dst")), "links")
        drop_cut(groups)
        groups = cut(components(links), "groups")

        # members of groups that are still apart
        mixed = cut(mixed_members(members, groups), "mixed")
        fine = cut(texts.join(mixed.select("doc").distinct(), "doc").select("doc", "text").mapInArrow(_fine, "doc long, fine binary"), "fine")
        places = sigs.join(mixed.select("doc").distinct(), "doc").select("doc", "signature").mapInArrow(_places, "doc long, places binary")
        kinds = ("docs", "groups", "places", "fine")
        blocks = cut(mixed.join(places, "doc").join(fine, "doc").groupBy("band", "block", "blocks").agg(*(F.collect_list(c).alias(n) for c, n in zip(("doc", "grp", "places", "fine"), kinds))), "blocks")
        alone = blocks.select("band", F.lit(True).alias("same"), *kinds, *(F.col(c).alias(f"{c}2") for c in kinds))  # a block with itself needs no join
        large = blocks.where("blocks > 1")
        # the blocks of one bucket are dealt by bucket and second block, so that a large bucket isn't met in one place
        faced = large.withColumn("block2", F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b > F.col("block"))))
        faced = faced.join(large.select("band", F.col("block").alias("block2"), *(F.col(c).alias(f"{c}2") for c in kinds)), ["band", "block2"])
        faced = alone.unionByName(faced.select("band", F.lit(False).alias("same"), *kinds, *(f"{c}2" for c in kinds)))
        pairs = cut(faced.mapInArrow(_cross_groups(limit), "src long, dst long"), "pairs")
        more = cut(verify(pairs, texts, limit).select("src", "dst"), "more")
        spent += [links, mixed, fine, blocks, pairs, more]
        if not more.isEmpty():
            drop_cut(groups)
            groups = cut(components(links.union(more)), "groups")
    drop_cut(*spent)

    classes = parts.select("class_key", "_salt").join(signed.select("class_key", "doc", "low"), "class_key")  # a row for each key and salt
    grouped = groups.withColumnRenamed("id", "doc")
    if repeats:
        grouped = grouped.join(signed.select("doc", "low"), "doc")
        grouped = grouped.join(grouped.groupBy("component").agg(F.min("low").alias("least")), "component").select("doc", "component", "least")
    else:
        grouped = grouped.withColumn("least", F.col("component"))
    found = classes.join(grouped, "doc", "left").select(
        "class_key", "_salt", F.col("low").alias("class_id"), F.coalesce("least", "low").alias("group_id"), F.coalesce("component", "doc").alias("root")
    )
    inside = ids.join(found, ["class_key", "_salt"]).select("doc_id", "text_hash", "class_id", "group_id", "root").withColumn("kept", F.col("doc_id") == F.col("group_id"))
    if repeats:  # an id that comes with several texts may lead its group with more than one of them
        first = inside.where("kept").groupBy("root").agg(F.min("text_hash").alias("lo"))
        inside = inside.join(first, "root", "left").withColumn("kept", F.col("kept") & (F.col("text_hash") == F.col("lo")))
    alone = keyed.where(F.col("doc_id").isNull() | F.col("class_key").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("group_id"), F.lit(True).alias("kept"), "text_hash")
    return inside.select("doc_id", "class_id", "group_id", "kept", "text_hash").union(alone)


def texts_of_repeats(own: DataFrame, signed: DataFrame, shared: DataFrame, paired: DataFrame) -> DataFrame:
    """(doc, text) of the paired classes, where some ids come with several texts: those are told apart by their words."""
    named = signed.select("doc", "low", "class_key").join(paired, "doc")
    plain = own.select(F.col("doc_id").alias("doc"), "text").join(named.where("doc = low").select("doc"), "doc").groupBy("doc").agg(F.min("text").alias("text"))
    doubtful = own.join(shared.withColumnRenamed("doc", "doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("low"), "text")
    known = doubtful.mapInArrow(_low_key, "low long, class_key binary, text string")
    return plain.union(named.where("doc <> low").join(known, ["low", "class_key"]).groupBy("doc").agg(F.min("text").alias("text")))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate `documents`."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
