"""Operator 4, SimHash near-dedup by anchor-point covering.

Fingerprints are cut into blocks of 32 bits.  The anchors of a block are the words of a
covering code: a Hamming code of length 31 beside one free bit, so every block value has a
home anchor within the covering radius 1.  A fingerprint goes to its home anchor and, as a
replica, to every anchor within covering radius plus the block's threshold ``within``, so
two fingerprints that differ in at most ``within`` bits of a block meet at the home anchor
of either.  Two that differ in fewer than ``blocks * (within + 1)`` bits have such a block.
Farther pairs meet by chance only, so wide fingerprints are cut into blocks several times
over (``arrangements``), with their bits in another order each time.

Equal fingerprints are one class before any of this.  Groups of many near copies are found
first, by one comparison of each class.  Where classes of different groups meet at an
anchor, one of them, the pivot, is held against those of other groups; those that stay in
another group are then held against all classes of the anchor, in tiles if it is hot.  So
work grows with the number of classes, and what links have joined isn't compared again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.components import connected_components
from chainloom.llm.shared import SPACED, Scratch, Words, as_binary, bits_set, local_components, mix, slices, texts_of

#: Classes of one tile at a hot anchor.
TILE = 1024
#: Rows that a task deals to anchors (about), and classes that it deals at once.
DEALT, CHUNK = 1 << 19, 2048

#: Parity-check columns 1..31 of the Hamming code: the syndrome of bit k (from 0) is k + 1.
_SYNDROME = np.arange(1, 32, dtype=np.uint32)
#: The lowest bit of each byte of a 64-bit number.
_LOW_BITS = np.uint64(0x0101010101010101)
#: Hashes whose bits are summed at once: bytes hold sums up to 255.
_SUMMED = 255


def bit_counts(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """(groups, 64): how many hashes of each group have each bit; groups start at ``begin`` and none is empty."""
    sizes = np.diff(np.append(begin, len(hashes)))
    parts = -(-sizes // _SUMMED)
    first = np.cumsum(parts) - parts
    cuts = np.repeat(begin - _SUMMED * first, parts) + _SUMMED * np.arange(parts.sum())
    sums = np.empty((len(cuts), 8), dtype="<u8")
    for k in range(8):  # bit k of all eight bytes
        sums[:, k] = np.add.reduceat(hashes >> np.uint64(k) & _LOW_BITS, cuts)
    by_bit = sums.view(np.uint8).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 64)
    return np.add.reduceat(by_bit, first, axis=0, dtype=np.int32)


def fingerprints(texts: list[bytes | None], size: int, lanes: int, distinct: bool = False) -> np.ndarray:
    """(texts, lanes) 64-bit SimHash fingerprints of word shingles; the first lane is of the plain XXH64.

    ``distinct``: a text's repeated shingles count once.
    """
    out = np.zeros((len(texts), lanes), dtype=np.uint64)
    for a, b in slices(texts):
        words = Words(texts[a:b], SPACED, lower=True)
        data, at = words.compact()
        n = words.counts()
        short = (n > 0) & (n < size)
        grams = np.where(n >= size, n - size + 1, short.astype(np.int64))
        whose = np.repeat(np.arange(b - a), grams)
        first = words.first[:-1][whose] + (np.arange(len(whose)) - np.repeat(np.cumsum(grams) - grams, grams))
        last = np.where(short[whose], words.first[1:][whose], first + size)
        hashes = np.fromiter((xxhash.xxh64_intdigest(data[x:y], 42) for x, y in zip(at[first].tolist(), (at[last] - 1).tolist())), dtype=np.uint64, count=len(whose))
        if distinct:
            order = np.lexsort((hashes, whose))
            hashes, whose = hashes[order], whose[order]
            new = np.ones(len(whose), dtype=bool)
            new[1:] = (whose[1:] != whose[:-1]) | (hashes[1:] != hashes[:-1])
            hashes, grams = hashes[new], np.bincount(whose[new], minlength=b - a)
        has = np.flatnonzero(grams)
        if not len(has):
            continue
        begin = (np.cumsum(grams) - grams)[has]
        for lane in range(lanes):
            h = hashes if lane == 0 else mix(hashes + np.uint64(lane * 0x9E3779B97F4A7C15 % (1 << 64)))
            top = 2 * bit_counts(h, begin) > grams[has][:, None]
            out[a + has, lane] = np.packbits(top, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _syndromes(x: np.ndarray) -> np.ndarray:
    """Hamming syndrome of the lower 31 bits of each value."""
    s = np.zeros(len(x), dtype=np.uint32)
    for k in range(31):
        s ^= np.where(x >> np.uint32(k) & np.uint32(1), _SYNDROME[k], np.uint32(0))
    return s


def homes(x: np.ndarray) -> np.ndarray:
    """The home anchor of 32-bit values: its nearest code word, with the free top bit as it is."""
    s = _syndromes(x)
    return np.where(s > 0, x ^ (np.uint32(1) << (np.maximum(s, 1) - 1).astype(np.uint32)), x)


def replicas(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of x, anchor) for every anchor within distance 2 (covering radius and threshold, 1 each) of a value."""
    s = _syndromes(x)
    home = homes(x)
    near = [(np.arange(len(x)), home), (np.arange(len(x)), home ^ np.uint32(1 << 31))]
    for i in range(31):  # two flipped bits i < j whose syndromes sum to s give another code word
        j = (_SYNDROME[i] ^ s).astype(np.int64) - 1
        ok = np.flatnonzero((s > 0) & (j > i))
        near.append((ok, x[ok] ^ np.uint32(1 << i) ^ (np.uint32(1) << j[ok].astype(np.uint32))))
    return np.concatenate([a for a, _ in near]), np.concatenate([b for _, b in near])


def _unpacked(prints: list[bytes], lanes: int) -> np.ndarray:
    """(n, lanes) of big-endian fingerprints."""
    return np.frombuffer(b"".join(prints), dtype=">u8").reshape(-1, lanes).astype(np.uint64)


def blocks_of(fp: np.ndarray, arrangements: int):
    """The 32-bit blocks, one after another, of (n, lanes) fingerprints; each arrangement has all bits, in an order of its own."""
    plain = np.ascontiguousarray(fp.astype("<u8"))
    yield from plain.view("<u4").T
    bits = np.unpackbits(plain.view(np.uint8), axis=1, bitorder="little") if arrangements > 1 else None
    for r in range(1, arrangements):
        order = np.random.default_rng(r).permutation(bits.shape[1])
        yield from np.ascontiguousarray(np.packbits(bits[:, order], axis=1, bitorder="little")).view("<u4").T


def _deal(classes: DataFrame, lanes: int, within: int, arrangements: int, carried: list[str], count: int) -> DataFrame:
    """(anchor, home, and the carried bigint columns) of every one of ``count`` classes at its anchors; a task deals DEALT rows, about."""
    rows = count * 2 * lanes * arrangements * (18 if within else 1)

    def deal(batches):
        for batch in (whole.slice(s, CHUNK) for whole in batches for s in range(0, whole.num_rows, CHUNK)):
            fp = _unpacked(batch["fp"].to_pylist(), lanes)
            columns = [batch[c].to_numpy() for c in carried]
            for k, block in enumerate(blocks_of(fp, arrangements)):
                anchor = home = homes(block)
                who = np.arange(len(home))
                if within:
                    other, near = replicas(block)
                    away = near != home[other]
                    anchor, who = np.concatenate([home, near[away]]), np.concatenate([who, other[away]])
                made = [pa.array(anchor.astype(np.int64) | (k << 32)), *(pa.array(c[who]) for c in columns)]
                if within:
                    made.append(pa.array(np.arange(len(who)) < len(home)))
                yield pa.RecordBatch.from_arrays(made, ["anchor", *carried, "home"][: len(made)])

    schema = ", ".join(f"{c} bigint" for c in ("anchor", *carried))
    return classes.select(*carried, "fp").repartition(max(1, -(-rows // DEALT)), "cls").mapInArrow(deal, schema + ", home boolean" * bool(within))


def _near(pairs: DataFrame, classes: DataFrame, lanes: int, distance: int) -> DataFrame:
    """Those of the pairs (a, b) of classes within ``distance`` bits."""

    @F.arrow_udf("int")
    def bits_apart(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint64) for c in (a, b))
        return pa.array(bits_set(x ^ y).reshape(-1, lanes).sum(axis=1), pa.int32())

    of = lambda c: classes.select(F.col("cls").alias(c), F.col("fp").alias(f"fp_{c}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").where(bits_apart("fp_a", "fp_b") <= distance).select("a", "b")


def _links(classes: DataFrame, lanes: int, distance: int, within: int, arrangements: int) -> DataFrame:
    """Links (a, b) between class ids that join all classes within ``distance`` bits found at the anchors."""
    scratch, count = Scratch(classes.sparkSession, "anchors"), classes.count()
    pair = lambda low, high: [F.col(low).alias("a"), F.col(high).alias("b")]

    # Groups of many near copies first: of the pivots at the home anchors of one arrangement, each class is held against
    # the one that it meets most often.
    dealt = _deal(classes, lanes, 0, 1, ["cls"], count)
    pivots = scratch.write(dealt.groupBy("anchor").agg(F.count("*").alias("n"), F.min("cls").alias("pivot")).where("n > 1").select("anchor", "pivot"))
    often = dealt.join(pivots, "anchor").where("cls != pivot").groupBy("cls", "pivot").agg(F.count("*").alias("n"))
    best = scratch.write(often.groupBy("cls").agg(F.max(F.struct("n", "pivot")).alias("best")).select(*pair("best.pivot", "cls")))
    first = scratch.write(_near(best, classes, lanes, distance))
    groups = scratch.write(connected_components(first, "a", "b"))
    grouped = scratch.write(classes.join(groups, classes.cls == groups.node, "left").select("cls", "fp", F.coalesce("component", "cls").alias("grp")))

    # Then all anchors where groups meet: their pivot, one of those at home, against the classes of other groups.
    dealt = _deal(grouped, lanes, within, arrangements, ["cls", "grp"], count)
    home = F.col("home") if within else F.lit(True)
    counted = dealt.groupBy("anchor").agg(
        F.count("*").alias("n"), F.min(F.when(home, F.col("cls"))).alias("pivot"), F.min_by("grp", F.when(home, F.col("cls"))).alias("pivot_grp"), F.min("grp").alias("least"), F.max("grp").alias("most")
    )
    anchors = scratch.write(counted.where("least != most and pivot is not null").select("anchor", "n", "pivot", "pivot_grp"))
    met = scratch.write(dealt.join(anchors, "anchor").select("anchor", "cls", home.alias("home"), "pivot", "n", (F.col("grp") != F.col("pivot_grp")).alias("apart")))
    away = met.where("apart")
    pairs = scratch.write(away.select(*pair("pivot", "cls")).distinct())
    stars = scratch.write(_near(pairs, classes, lanes, distance).unionByName(first))

    # Classes that aren't in their pivot's group by now are open: they are held against all classes of the anchor.
    groups = scratch.write(connected_components(stars, "a", "b"))
    group = lambda c, name: groups.select(F.col("node").alias(c), F.col("component").alias(name))
    away_ = away.where("n > 2").join(group("cls", "grp"), "cls", "left").join(group("pivot", "pivot_grp"), "pivot", "left")
    is_open = scratch.write(away_.where(F.coalesce("grp", "cls") != F.coalesce("pivot_grp", "pivot")).select("anchor", "cls"))
    sizes = is_open.groupBy("anchor").agg(F.count("*").alias("n_open")).join(anchors, "anchor")
    parts = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    sizes = scratch.write(sizes.select("anchor", parts("n_open").alias("rows"), parts("n").alias("cols")))
    members = met.join(sizes, "anchor").select("anchor", "cls", "home", "rows", "cols")
    flags = is_open.select("anchor", "cls", F.lit(True).alias("open"))
    left = scratch.write(members.join(group("cls", "grp"), "cls", "left").join(flags, ["anchor", "cls"], "left").select("anchor", "cls", "home", F.coalesce("grp", "cls").alias("grp"), F.coalesce("open", F.lit(False)).alias("open"), "rows", "cols"))
    scratch.remove(pivots, best, met, pairs)

    # open classes in rows of tiles, all classes in columns; where one column holds all, its open classes are the row
    tile = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    in_cols = left.withColumn("j", tile("cols")).select("anchor", "cls", "grp", "home", "open", F.lit(False).alias("row"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), "j")
    in_rows = left.where("open and cols > 1").withColumn("i", tile("rows")).select("anchor", "cls", "grp", "home", "open", F.lit(True).alias("row"), "i", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"))
    entry = F.struct("cls", "grp", "home", "open", "row", "fp")
    tiles = in_cols.unionByName(in_rows).join(classes, "cls").groupBy("anchor", "i", "j").agg(F.collect_list(entry).alias("entries"))

    def compare(batches):
        for batch in batches:
            a_out, b_out = [], []
            for every in batch["entries"].to_pylist():
                held = [x for x in every if not x["row"]]
                rows = [x for x in every if x["row"]] or [x for x in held if x["open"]]
                if not rows or not held:
                    continue
                ids, at, back = np.unique(np.array([x["cls"] for x in held + rows], dtype=np.int64), return_index=True, return_inverse=True)
                both = held + rows
                fp = _unpacked([both[k]["fp"] for k in at], lanes)
                at_home = np.array([both[k]["home"] for k in at])
                _, least, own = np.unique(np.array([both[k]["grp"] for k in at], dtype=np.int64), return_index=True, return_inverse=True)
                label = before = least[own]
                c, r = back[: len(held)], back[len(held) :]
                for begin in range(0, len(r), 256):
                    part = r[begin : begin + 256]
                    x, y = np.nonzero((label[part][:, None] != label[c][None, :]) & (at_home[part][:, None] | at_home[c][None, :]))
                    x, y = part[x], c[y]
                    apart = np.zeros(len(x), dtype=np.int32)
                    for lane in range(lanes):
                        apart += bits_set(fp[x, lane] ^ fp[y, lane])
                        if lane % 4 == 3:
                            near = apart <= distance
                            x, y, apart = x[near], y[near], apart[near]
                    near = apart <= distance
                    label = local_components(len(ids), np.concatenate([x[near], np.arange(len(ids))]), np.concatenate([y[near], label]))
                moved = np.flatnonzero(label != before)
                a_out.append(ids[moved])
                b_out.append(ids[label[moved]])
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], ["a", "b"])

    return stars.unionByName(tiles.select("entries").mapInArrow(compare, "a bigint, b bigint"))


def with_fingerprints(docs: DataFrame, text: str, size: int, lanes: int, name: str, distinct: bool = False) -> DataFrame:
    @F.arrow_udf("binary")
    def fingerprint(column: pa.Array) -> pa.Array:
        return pa.array([x.tobytes() for x in fingerprints(texts_of(column), size, lanes, distinct).astype(">u8")], pa.binary())

    return docs.withColumn(name, fingerprint(as_binary(text)))


def _grouped(docs: DataFrame, doc_id: str, text: str, size: int, bits: int, distance: int, within: int, arrangements: int, distinct: bool) -> tuple[DataFrame, DataFrame]:
    """Prints (doc_id, sig, fp, cls) of all rows, and the group of each class; ``sig`` is a hash of the whole text."""
    lanes = bits // 64
    scratch = Scratch(docs.sparkSession, "prints")
    body = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("body"))
    prints = with_fingerprints(body.withColumn("sig", F.xxhash64("body")), "body", size, lanes, "fp", distinct).drop("body")
    # a class is the documents of one fingerprint; its number is the fingerprint, or a hash of a longer one
    number = F.conv(F.hex("fp"), 16, -10).cast("bigint") if lanes == 1 else F.xxhash64("fp")
    prints = scratch.write(prints.withColumn("cls", number))
    classes = scratch.write(prints.select("cls", "fp").distinct())
    found = connected_components(_links(classes, lanes, distance, within, arrangements), "a", "b")
    named = classes.join(found, classes.cls == found.node, "left").select("cls", F.coalesce("component", "cls").alias("group"))
    return prints, scratch.write(named)


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, bits: int = 2048, distance: int = 330, within: int = 0, arrangements: int = 3, distinct: bool = True
) -> DataFrame:
    """(doc_id, fp, component_id) for every document; fp is its fingerprint (binary, big-endian words).

    Documents link at ``distance`` or fewer differing bits; component_id is the smallest
    doc_id that links reach.  Pairs of fewer than ``blocks * (within + 1)`` bits (blocks =
    bits / 32) are found with certainty (3 of 64 with ``within`` 1).  Farther pairs are
    found if they meet at an anchor of one of ``arrangements`` cuts into blocks.  With words
    of ``size`` 5, each shingle of a text counted once, 310 of 2048 bits stand for a
    similarity of 0.8, with a standard deviation of 16 bits; 330 lets 9 of 10 pairs of just
    that similarity pass, and half of those of 0.77.  With three cuts such pairs meet with a
    probability of 0.9, those of 0.85 nearly always.
    Texts of no words (null too) share fingerprint zero and link like any other; a null
    doc_id links no one but takes its class's component.  Repeated rows give repeated
    rows; an empty table an empty one.
    """
    prints, named = _grouped(docs, doc_id, text, size, bits, distance, within, arrangements, distinct)
    scratch = Scratch(docs.sparkSession, "least")
    lows = scratch.write(prints.groupBy("cls").agg(F.min("doc_id").alias("low")))
    lows = scratch.write(lows.join(named, "cls"))
    least = scratch.write(lows.groupBy("group").agg(F.min("low").alias("component_id")))
    return prints.join(scratch.write(lows.join(least, "group").select("cls", "component_id")), "cls").select("doc_id", "fp", "component_id")


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, bits: int = 2048, distance: int = 330, within: int = 0, arrangements: int = 3, distinct: bool = True
) -> DataFrame:
    """The documents without near copies: of each group one row stays, that of the smallest doc_id.

    Null doc_ids come last; among rows of one doc_id that of the smallest hash of its text
    stays.  Of rows that agree in both, one stays.
    """
    prints, named = _grouped(docs, doc_id, text, size, bits, distance, within, arrangements, distinct)
    scratch = Scratch(docs.sparkSession, "kept")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")
    # the least key of each class, then of each group: both with partial results before their shuffle
    own = scratch.write(prints.groupBy("cls").agg(F.min(key).alias("key"), F.count("*").alias("rows")))
    own = scratch.write(own.join(named, "cls"))
    best = scratch.write(own.groupBy("group").agg(F.min("key").alias("best"), F.sum("rows").alias("rows")).where("rows > 1").drop("rows"))
    many = scratch.write(own.join(best, "group").select("cls", "best"))
    copies = prints.join(many, "cls").select("best", key.alias("key"))
    gone = scratch.write(copies.where("key != best").select("key.doc_id", "key.sig").distinct())
    twice = scratch.write(copies.where("key = best").groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key.doc_id", "key.sig"))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = dict(zip(docs.columns, plain.columns))
    plain = plain.withColumn("sig", F.xxhash64(at[text]))
    same = lambda t: F.col(at[doc_id]).cast("bigint").eqNullSafe(t["doc_id"]) & (plain["sig"] == t["sig"])
    kept = plain.join(gone, same(gone), "left_anti")
    if not twice.isEmpty():  # rows repeated whole: one of each, picked with partial results before the shuffle
        one = kept.join(twice, same(twice), "left_semi").groupBy(at[doc_id], "sig").agg(F.first(F.struct(*at.values())).alias("row"))
        kept = kept.join(twice, same(twice), "left_anti").select(*at.values()).unionByName(one.select("row.*"))
    return kept.select(*at.values()).toDF(*docs.columns)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs, size=3, bits=64, distance=3, within=1, arrangements=1, distinct=False)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
