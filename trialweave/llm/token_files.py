"""Token ids as Arrow files of fixed-size-list batches.

Documents are dealt out by ranges of doc_id and sorted, or stay in their stored order, so that a mix that was written
shard by shard keeps its places; each range or scan task becomes one shard file in the Arrow IPC file format.
A shard is its documents' ids in order (each followed by the end id), cut into sequences of ``seq_len`` ids; a row has
``input_ids: fixed_size_list<uint16 or uint32>[seq_len]`` and ``mask: fixed_size_list<bool>[seq_len]``, where only the
padding of the last sequence is False. Buffers are not compressed, so a mapped file gives any sequence without a copy.
A retried task writes a file of another name, and the index names the files of the tasks that counted.

Texts are encoded word by word: the tokenizer's pretokens never hold white space and its normaliser works on either
side of it alone, so a text's ids are its words' ids in a row (test_token_files compares with whole texts).

Defined cases: a null or empty text is its end id alone; a null doc_id comes first; rows of one doc_id follow each
other by the hash of their text; an empty table gives no shard. Only the columns named are used.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm._common import groups_for, one_array, released, split_words, written
from trialweave.session import shared_dir

END_ID = 2
SEQ_LEN = 2048
BATCH_ROWS = 256
SLICE_BYTES = 8 << 20
#: Text that is encoded at once: its words and ids take some twenty times as much memory.
ENCODE_BYTES = 3 << 20
CACHE_WORDS = 400_000
INDEX = "doc_id long, part int, file string, first long, n_tokens long"


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return tok, {}, _is_byte_level(tok)


_SIGNS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: A word that ends in a letter or digit and then ASCII punctuation (no apostrophe, no sign of a special token): two pretokens at least.
_TAIL = re.compile(rb"(.*[0-9A-Za-z])([" + re.escape(_SIGNS) + rb"]+)", re.S)
_ENDS = frozenset(_SIGNS)

#: Words that normalising leaves as they are and that are one pretoken each, beside a-z: their byte-level form goes straight to the model.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}


def _is_byte_level(tok) -> bool:
    """Whether ASCII may be lower-cased beforehand and _PLAIN is right: NFC, white space, lower case; letters and signs apart; byte level."""
    spec = json.loads(tok.to_str())
    order = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    steps = [str(x) for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
    return order == ["NFC", "Replace", "Lowercase"] and len(steps) == 2 and "\\p{L}" in steps[0] and "ByteLevel" in steps[1] and spec["model"]["type"] == "BPE"


def _encoded(tok, plain: bool, words: list[bytes]) -> dict[bytes, list[int]]:
    out, rest, tokenize = {}, [], tok.model.tokenize
    for w in words:
        if plain and w.isalpha():  # a-z alone: encode() lower-cases these
            out[w] = [t.id for t in tokenize(w.decode())]
        elif plain and _PLAIN.fullmatch(w.decode()):
            out[w] = [t.id for t in tokenize(w.decode("latin-1").translate(_BYTES))]
        else:
            rest.append(w)
    for i in range(0, len(rest), 20_000):
        some = rest[i : i + 20_000]
        out.update(zip(some, (e.ids for e in tok.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)), strict=True))
    return out


def encode(texts, tokenizer_path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in a row, and how many each text has.

    Only distinct words are encoded, without the punctuation at their ends, which is encoded by itself; what comes
    twice is kept for later. Words of ASCII alone that hold no part of a special token are lower-cased first. No other
    word is: the tokenizer composes letters with the marks that follow them before it lower-cases them.
    """
    tok, cache, plain = _tokenizer(tokenizer_path)
    if len(cache) > CACHE_WORDS:
        cache.clear()
    texts, lowered = pc.fill_null(one_array(texts).cast(pa.string()), ""), False
    if plain:  # whole texts first
        may = pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring(texts, "<|")))
        texts, lowered = pc.if_else(may, pc.ascii_lower(texts), texts), bool(pc.all(may).as_py())
    words, at, off = split_words(texts)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    if plain and not lowered:
        words = [w.lower() if w.isascii() and b"<|" not in w else w for w in words]
    cut = {w: m.groups() for w in words if w[-1] in _ENDS and (m := _TAIL.fullmatch(w))}
    need = dict.fromkeys(w for w in words if w not in cut)
    need.update(dict.fromkeys(p for pair in cut.values() for p in pair))
    small = tok.get_vocab_size() < 1 << 16
    made = {w: array("H" if small else "I", x).tobytes() for w, x in _encoded(tok, plain, [w for w in need if w not in cache]).items()}
    width = "<u2" if small else "<u4"
    ids_of = lambda p: made[p] if p in made else cache[p]
    made_ids = [ids_of(cut[w][0]) + ids_of(cut[w][1]) if w in cut else made[w] if w in made else cache[w] for w in words]
    twice = np.flatnonzero(np.bincount(at, minlength=len(words)) > 1).tolist()
    cache.update((p, ids_of(p)) for i in twice for p in cut.get(words[i], words[i : i + 1]))
    n = np.fromiter(map(len, made_ids), np.int64, len(made_ids)) // int(width[2])
    flat = np.frombuffer(b"".join(made_ids), width)
    first, each = np.concatenate([[0], np.cumsum(n)])[:-1], n[at]
    ends = np.cumsum(each)
    kind = np.int32 if max(len(flat), int(ends[-1])) < 1 << 31 else np.int64
    out = flat[np.repeat((first[at] - (ends - each)).astype(kind), each) + np.arange(int(ends[-1]), dtype=kind)].astype(np.int64)
    return out, np.diff(np.concatenate([[0], ends])[off])


def with_ends(ids: np.ndarray, n: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(n), end_id), n + 1


def slices(batch: pa.RecordBatch, column: str, rows: int = 1 << 30, most: int = SLICE_BYTES):
    """Parts of a batch of at most ``most`` bytes of text and ``rows`` rows, one row at least."""
    size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        before = size[i - 1] if i else 0
        j = max(i + 1, min(i + rows, int(np.searchsorted(size, before + most, "right"))))
        yield batch.slice(i, j - i)
        i = j
    released()


class ShardWriter:
    """Cuts a stream of ids into rows of seq_len and writes them in batches of BATCH_ROWS."""

    def __init__(self, sink, dtype: pa.DataType, seq_len: int, meta: dict):
        self.kind, self.n, self.rest = dtype, seq_len, np.zeros(0, np.int64)
        self.schema = pa.schema([("input_ids", pa.list_(dtype, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))], metadata=meta)
        self.out = pa.ipc.new_file(sink, self.schema)

    def _put(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        cells = [pa.FixedSizeListArray.from_arrays(pa.array(ids.astype(self.kind.to_pandas_dtype())), self.n), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.n)]
        self.out.write_batch(pa.record_batch(cells, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        ids, step = np.concatenate([self.rest, ids]), self.n * BATCH_ROWS
        full = len(ids) // step * step
        for i in range(0, full, step):
            self._put(ids[i : i + step], step)
        self.rest = ids[full:]

    def close(self) -> None:
        if len(self.rest):
            self._put(np.concatenate([self.rest, np.zeros(-len(self.rest) % self.n, np.int64)]), len(self.rest))
        self.out.close()


class ShardReader:
    """Random access to a shard: one sequence, or any range of its ids."""

    def __init__(self, uri: str):
        files, path = fs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.seq_len = self.file.schema.field("input_ids").type.list_size
        self.kept: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        b = self.file.get_batch(i // BATCH_ROWS)
        row = i % BATCH_ROWS
        return (b["input_ids"][row].values.to_numpy(), b["mask"][row].values.to_numpy(zero_copy_only=False))

    def _ids(self, k: int) -> np.ndarray:
        if self.kept[0] != k:
            self.kept = (k, self.file.get_batch(k)["input_ids"].flatten().to_numpy())
        return self.kept[1]

    def ids(self, first: int, n: int) -> np.ndarray:
        step, out = self.seq_len * BATCH_ROWS, []
        while n:
            part = self._ids(first // step)[first % step :][:n]
            if not len(part):
                raise ValueError("the shard ends before the range does")
            out.append(part)
            first, n = first + len(part), n - len(part)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def close(self) -> None:
        self.source.close()


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = END_ID, seq_len: int = SEQ_LEN, mb: int = 8, stored_order: bool = False) -> DataFrame:
    """Write the shard files under ``path``; return the index: doc_id, part, file, first (id in the shard), n_tokens.

    With ``stored_order``, rows are not moved: each task writes what it reads, in that order.
    """
    dealt = docs.select("doc_id", "text")
    if not stored_order:
        tied = dealt.withColumn("tie", F.xxhash64("text"))
        dealt = tied.repartitionByRange(groups_for(tied, mb, 12), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        part, writer, at = TaskContext.get().partitionId(), None, 0
        tok = _tokenizer(tokenizer_path)[0]
        dtype = pa.uint16() if max(tok.get_vocab_size(), end_id) < 1 << 16 else pa.uint32()
        uri = f"{path}/shard-{part:06d}-{uuid.uuid4().hex}.arrow"
        for batch in batches:
            for piece in slices(batch, "text", most=ENCODE_BYTES):
                if not piece.num_rows:
                    continue
                if writer is None:
                    files, where = fs.FileSystem.from_uri(uri)
                    files.create_dir(where.rpartition("/")[0], recursive=True)
                    sink = files.open_output_stream(where)
                    writer = ShardWriter(sink, dtype, seq_len, {"end_id": str(end_id)})
                ids, n = with_ends(*encode(piece["text"], tokenizer_path), end_id)
                writer.add(ids)
                first = at + np.cumsum(n) - n
                at += len(ids)
                yield pa.record_batch([piece["doc_id"].cast(pa.int64()), pa.array(np.full(len(n), part, np.int32)), pa.array([uri] * len(n)), pa.array(first), pa.array(n)], names=["doc_id", "part", "file", "first", "n_tokens"])
        if writer is not None:
            writer.close()
            sink.close()

    return written(dealt.mapInArrow(run, INDEX))


def read_shards(index: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Where a shard's ids start comes from a window over one row a shard; the driver sees the number of shards alone.
    """
    sizes = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select("file", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rows = index.repartition(max(12, sizes.count()), "file").join(before.hint("merge"), "file")

    def run(key, table):
        reader, base = ShardReader(key[0].as_py()), table["base"][0].as_py()
        order = np.argsort(table["first"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        crc = [zlib.crc32(reader.ids(a, n).astype("<u4").tobytes()) for a, n in zip(table["first"].to_pylist(), table["n_tokens"].to_pylist(), strict=True)]
        reader.close()
        return pa.table({"doc_id": table["doc_id"], "start": pa.array(table["first"].to_numpy() + base), "n_tokens": table["n_tokens"], "ids_crc32": pa.array(crc, pa.int64())})

    return rows.groupBy("file").applyInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenized(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    return read_shards(write_shards(docs, shared_dir(docs.sparkSession), tokenizer_path, **options))
