"""Operator 1, token-ID output: frequency-ranked ids in byte-aligned variable-length coding.

Format: a table of Parquet files, sorted by (part, block).  A row is a block of documents:
their ids (``doc_ids``) and numbers of tokens (``lengths``), ``start`` (tokens of the same
part before the block), and two byte strings.  ``control`` has two bits a token, four
tokens a byte, lowest bits first: the number of bytes of the token's rank, less one; each
document begins with a new byte.
``data`` has the ranks' bytes, little-endian.  Rank 0 is the most frequent token of the
whole corpus, so common tokens take one byte.  ``ranks`` (id by rank, little-endian
32-bit) and the tokens of each part are in a table beside it.  Decoding is by numpy table
lookup: each control byte gives the four lengths at once.
"""

from __future__ import annotations

import os
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.shared import ranges, shared_path, slices

#: Bytes of a part of the output, and tokens in a block (a longer document is a block by itself).
PART_BYTES = 32 << 20
BLOCK_TOKENS = 1 << 16
#: Words whose tokens a Python worker remembers, about, and pieces of words at most: 150 bytes each, in every worker.
REMEMBERED, PIECES = 400_000, 50_000
#: Bytes of text whose words are looked up in one pass.
LOOKED_UP = 1 << 20
#: Ids of a vocabulary at most; the rank table is broadcast.
VOCABULARY = 1 << 20


#: The pre-tokenizer's own pattern, and its visible sign for each byte: fixed values of byte-level BPE files.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGNS = {b: b if b in _VISIBLE else 256 + i for b, i in zip(range(256), np.cumsum([0] + [b not in _VISIBLE for b in range(255)]).tolist())}
_SPACE, _PUNCTUATION = chr(_SIGNS[32]), string.punctuation


class _Words(dict):
    """Ids by word; ``learn`` tells those of a new one, so that all words of many texts are looked up in one pass."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word):
        return self.learn(word)


class Encoder:
    """Encodes texts with a tokenizers file.

    For byte-level BPE a text's ids are those of its space-led words in turn wherever no
    space stands beside other white space.  So each distinct word is split and given to
    the file's model once, and then remembered; of words not seen lately the older half
    is forgotten.  Other texts, those with added tokens in them, and those with a sign that
    the file's pre-tokenizer takes for another kind (letter, number, space) than ``regex``
    or Python do are encoded whole; signs are judged when first seen.
    """

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype(kind)
        self.words: dict[str, bytes] = _Words(self._learn)
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.ids = [i.to_bytes(self.dtype.itemsize, "little") for i in range(1 + max(self.tokenizer.get_vocab().values(), default=0))]
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(SPLIT)
        self.by_word = self._splits()
        self.judged: set[str] = set()
        self.odd: set[str] = set()
        if self.by_word:
            self.judge(set(map(chr, range(128))))

    def judge(self, signs: set[str]) -> None:
        """Keep those of ``signs`` that are of one kind here and of another to the file's pre-tokenizer."""
        new = sorted(signs - self.judged)
        self.judged.update(new)
        for begin in range(0, len(new), 1 << 14):
            some = new[begin : begin + (1 << 14)]
            probe = "".join([f"a{c}1{c}!{c}!" for c in some])  # a sign joins what is of its kind before it
            kinds = []
            for starts in ([m.start() for m in self.split.finditer(probe)], [at for _, (at, _) in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]):
                cut = np.zeros(len(probe), dtype=bool)
                cut[starts] = True
                joins = ~cut.reshape(-1, 7)[:, [1, 3, 5]]
                kinds.append(np.where(joins.any(axis=1), joins.argmax(axis=1), 3))  # letter, number, other; 3: space
            for c, here, there in zip(some, *(k.tolist() for k in kinds)):
                if here != there or (c.isalpha() and there != 0) or (there == 3 and not c.isspace()):
                    self.odd.add(c)

    def _splits(self) -> bool:
        import json

        made = json.loads(self.tokenizer.to_str())
        pre = made.get("pre_tokenizer") or {}
        model = made["model"]
        return (
            made.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex") is True
            and pre.get("add_prefix_space") is False
            and model["type"] == "BPE"
            and not model.get("dropout")
        )

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in found]

    def _part(self, part: str) -> bytes:
        signs = part.replace(" ", _SPACE) if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(_SIGNS)
        ids = self.ids
        return b"".join([ids[t.id] for t in self.model.tokenize(signs)])

    def _letters(self, letters: str) -> bytes:
        """Ids of letters and the space before them, remembered, as words that differ in punctuation share them."""
        ids = self.words.get(letters)
        if ids is None:
            ids = self.words[letters] = self.older.get(letters) or self._part(" " + letters)
        return ids

    def _piece(self, part: str) -> bytes:
        ids = self.pieces.get(part)
        if ids is None:
            ids = self._part(part)
            if len(self.pieces) < PIECES:
                self.pieces[part] = ids
        return ids

    def _learn(self, word: str) -> bytes | None:
        """Ids of a word not met lately; none for words that touch other white space."""
        found = self.older.get(word)
        if found is None:
            if not word or word != word.strip():
                return None
            found = self._word(word)
        self.words[word] = found
        return found

    def _word(self, word: str) -> bytes:
        """Ids of a word and the space before it."""
        if word.isalpha():
            return self._part(" " + word)
        stem = word.rstrip(_PUNCTUATION)
        if stem.isalpha():  # what follows letters, up to the end, is one piece
            return self._letters(stem) + self._piece(word[len(stem) :])
        return b"".join([self._letters(p[1:]) if p[0] == " " and p[1:].isalpha() else self._piece(p) for p in self.split.findall(" " + word)])

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self.whole(texts)
        signs = np.frombuffer("".join([t for t in texts if not t.isascii()]).encode("utf-32-le"), dtype="<u4")
        seen = set(map(chr, np.unique(signs[signs > 127]).tolist()))
        if not seen <= self.judged:
            self.judge(seen)
        odd = seen & self.odd | {c for c in self.odd if c.isascii()}
        split = [[] if any(a in t for a in self.added) or (odd and not odd.isdisjoint(t)) else t.split(" ") for t in texts]
        every: list[str] = []
        for parts in split:
            every += parts[1:]
        if len(self.words) > REMEMBERED // 2:
            self.older, self.words = self.words, _Words(self._learn)
        found = list(map(self.words.__getitem__, every))
        out: list[bytes | None] = []
        firsts: list[str] = []
        at = 0
        for parts in split:
            rest = found[at : at + max(0, len(parts) - 1)]
            at += len(rest)
            first = parts[0] if parts else None
            if first is None or None in rest or (first and first != first.strip()):
                out.append(None)
                continue
            firsts.append(first)
            out.append(b"".join(rest))
        heads = iter(self.whole(firsts))
        whole = iter(self.whole([t for t, x in zip(texts, out) if x is None]))
        return [next(whole) if x is None else next(heads) + x for x in out]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]


def token_ids(text: str, tokenizer: str, kind: str, end: int):
    """Column of a text's ids (little-endian, of numpy ``kind``) with the end id; null: no text."""
    last = np.array([end], dtype=kind).tobytes()

    @F.arrow_udf("binary")
    def encode(column: pa.Array) -> pa.Array:
        texts = [t or "" for t in column.to_pylist()]
        enc, out = encoder(tokenizer, kind), []
        for a, b in slices(texts, LOOKED_UP):
            out += [x + last for x in enc.encode(texts[a:b])]
        return pa.array(out, pa.binary())

    return encode(F.col(text).cast("string"))


# --------------------------------------------------------------------- coding

_CONTROL = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
#: Bytes of each of the four tokens of a control byte.
_LENGTHS = (_CONTROL + 1).astype(np.int64)


def pack(ranks: np.ndarray, counts=None) -> tuple[bytes, bytes]:
    """(control, data) of some ranks below 2**32: those of texts of ``counts`` tokens, one after another (all are one text)."""
    control, data, _ = _packed(ranks, np.array([len(ranks)]) if counts is None else np.asarray(counts, dtype=np.int64))
    return control.tobytes(), data.tobytes()


def _packed(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data of texts in turn, and bytes of data before each rank (one entry more than ranks)."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF).astype(np.int64) + (ranks > 0xFFFFFF)
    filled = -(-counts // 4) * 4
    code = np.zeros(int(filled.sum()), dtype=np.uint8)
    code[ranges(np.cumsum(filled) - filled, counts)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    before = np.concatenate([[0], np.cumsum(size)])
    return control, ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]], before


def pack_each(ranks: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control bytes of each text, and data of each."""
    control, data, before = _packed(ranks, counts)
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for whole, at in ((control.tobytes(), np.concatenate([[0], np.cumsum(-(-counts // 4))]).tolist()), (data.tobytes(), before[ends].tolist())):
        out.append([whole[a:b] for a, b in zip(at, at[1:])])
    return out[0], out[1]


def unpack(control: bytes, data: bytes, counts) -> np.ndarray:
    """The ranks of texts packed one after another, of ``counts`` tokens each, by table lookup."""
    counts = np.atleast_1d(np.asarray(counts, dtype=np.int64))
    size = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)
    filled = -(-counts // 4) * 4
    size = size[ranges(np.cumsum(filled) - filled, counts)]  # without the last byte's unused places of each text
    wide = np.zeros((len(size), 4), dtype=np.uint8)
    wide[np.arange(4) < size[:, None]] = np.frombuffer(data, dtype=np.uint8)
    return wide.view("<u4").reshape(-1)


# -------------------------------------------------------------- write and read


def write_tokens(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = 0, part_bytes: int = PART_BYTES) -> None:
    """Encode every whole text and write the format described above to ``path``, in ascending doc_id order.

    Files and their blocks follow the order of doc_ids.  Null texts count as empty: they
    hold the end id only.  Null doc_ids come first; rows of one doc_id stand together, in
    as many parts as they fill.  An empty table writes no blocks.
    """
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    if size > VOCABULARY:
        raise ValueError(f"the vocabulary has {size} ids; {VOCABULARY} at most")
    kind = "<u2" if size <= 1 << 16 else "<u4"
    id_bytes = np.dtype(kind).itemsize

    first = f"{path}/ids"
    docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).select("doc_id", token_ids("text", tokenizer, kind, end).alias("ids")).write.option("compression", "zstd").parquet(first)
    ids = spark.read.parquet(first)

    def tally(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(np.frombuffer(b"".join(batch["ids"].to_pylist()), dtype=kind), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    counts = ids.select("ids").mapInArrow(tally, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row per id of the vocabulary at most
    order = sorted(counts, key=lambda r: (-r["n"], r["id"]))
    by_rank = np.array([r["id"] for r in order], dtype="<u4")
    rank = np.zeros(size, dtype=np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank)

    total = sum(r["n"] for r in order)
    parts = max(32, -(-total * 3 // (2 * part_bytes)))
    found = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts).alias("cuts"), F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    cuts = np.array(found["cuts"] or [], dtype=np.int64)
    nulls = -(-found["none"] * parts // max(found["n"], 1))  # parts of rows without a doc_id

    def code(batches):
        at = 0
        for batch in batches:
            doc = batch["doc_id"]
            each, n, control, data = batch["ids"].to_pylist(), [], [], []
            for a, b in slices(each):
                counts = np.array([len(x) // id_bytes for x in each[a:b]])
                c, d = pack_each(ranks.value[np.frombuffer(b"".join(each[a:b]), dtype=kind)], counts)
                n += counts.tolist()
                control += c
                data += d
            # a doc_id of many rows is several cuts, and its rows are dealt to the parts between them in turn
            value = doc.fill_null(0).to_numpy()
            first, last = nulls + np.searchsorted(cuts, value, side="left"), nulls + np.searchsorted(cuts, value, side="right")
            none = doc.is_null().to_numpy(zero_copy_only=False)
            first, last = np.where(none, 0, first), np.where(none, max(nulls - 1, 0), np.maximum(last - 1, first))
            part = first + (at + np.arange(len(value))) % (last - first + 1)
            at += len(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), doc, pa.array(n, pa.int64()), pa.array(control, pa.binary()), pa.array(data, pa.binary())], ["part", "doc_id", "n", "control", "data"]
            )

    coded = ids.mapInArrow(code, "part int, doc_id bigint, n bigint, control binary, data binary")
    sorted_ = coded.repartitionById(parts + nulls, F.col("part")).sortWithinPartitions(F.asc("part"), F.asc_nulls_first("doc_id"), "n", "data")

    def blocks(batches):
        part, at, number, rows, tokens = None, 0, 0, [], 0

        def flush():
            nonlocal rows, tokens, at, number
            control, data = b"".join([x[2] for x in rows]), b"".join([x[3] for x in rows])
            made = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([number], pa.int64()),
                    pa.array([at], pa.int64()),
                    pa.array([[x[0] for x in rows]], pa.list_(pa.int64())),
                    pa.array([[x[1] for x in rows]], pa.list_(pa.int64())),
                    pa.array([control], pa.binary()),
                    pa.array([data], pa.binary()),
                ],
                ["part", "block", "start", "doc_ids", "lengths", "control", "data"],
            )
            at, number, rows, tokens = at + tokens, number + 1, [], 0
            return made

        for batch in batches:
            for p, doc, n, c, d in zip(*(batch[k].to_pylist() for k in ("part", "doc_id", "n", "control", "data"))):
                if rows and (p != part or tokens + n > BLOCK_TOKENS):
                    yield flush()
                if p != part:
                    part, at, number = p, 0, 0
                rows.append((doc, n, c, d))
                tokens += n
        if rows:
            yield flush()

    schema = "part int, block bigint, start bigint, doc_ids array<bigint>, lengths array<bigint>, control binary, data binary"
    sorted_.mapInArrow(blocks, schema).write.option("compression", "none").parquet(f"{path}/blocks")
    sums = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("tokens"))
    sums.coalesce(1).write.parquet(f"{path}/parts")
    spark.createDataFrame([(bytearray(by_rank.tobytes()),)], "ranks binary").coalesce(1).write.parquet(f"{path}/ranks")


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the files; ids are little-endian unsigned 32-bit."""
    by_rank = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{path}/ranks").first()["ranks"]))
    before, at = {}, 0
    for r in sorted(spark.read.parquet(f"{path}/parts").collect()):  # one row per part of PART_BYTES
        before[r["part"]] = at
        at += r["tokens"]

    def decode(batches):
        ids_of = np.frombuffer(by_rank.value, dtype="<u4")
        for batch in batches:
            for part, start, docs, lengths, control, data in zip(*(batch[k].to_pylist() for k in ("part", "start", "doc_ids", "lengths", "control", "data"))):
                ends = np.cumsum(lengths)
                ids = ids_of[unpack(control, data, lengths)]
                begins = ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(begins + start + before[part]), pa.array(lengths, pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return spark.read.parquet(f"{path}/blocks").mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def op1_token_output(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
