"""BPE encoding and decoding by tree concatenation.

A text of more than ``TEXT_LEAF`` characters is halved, wherever that cuts, until the parts
are short; those of a text above ``CHUNK`` are rows of their own, which Spark deals to its
tasks. The parts are encoded in parallel and joined pairwise up the tree. At a join the
tokens around it are encoded again, in a window that grows on either side until it ends at
a place where both sides agree with the whole: between a printable ASCII character and a
space the vocabulary's split pattern always cuts and looks neither back nor ahead, so what
lies beyond is the same in the part as in the whole text.

A run that is never cut so, of more than ``LEAF`` characters, is a tree by itself, in a part
as in a window that has grown over it: it has one pre-token, or few, and at a join of its
halves the window grows until its first and its last token are those that the sides have
there. A sequence is a pre-token's encoding if each pair of
neighbours is one, and all pairs were then seen by the encoder, so the result is exact.

Defined cases: null texts count as empty and have no tokens; a text of any length is
encoded whole; a special token's string in a text is that token, as the library has it,
even where a text was halved inside it; there are no ties; repeated rows give repeated
rows; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emrecon.llm.common import documents
from emrecon.llm.vocab import SPACE, byte_alphabet, byte_ranks, load

#: Characters of a text's part, and of a run's, that is encoded at once.
TEXT_LEAF, LEAF = 4096, 1024
#: Characters of the parts that are dealt to tasks.
CHUNK = 1 << 16
#: Tokens on either side of a join that are encoded again at first.
WINDOW = 4
#: A space belongs to the word that follows it; of more white space all but the last stands alone.
CHUNKS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Fixed value: the vocabulary's split pattern.
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


@lru_cache(maxsize=4)
def byte_table(path: str) -> list[bytes]:
    """The bytes of each id; those of a special token are its text."""
    back, t = byte_alphabet(), load(path)
    special = t.get_added_tokens_decoder()
    return [special[i].content.encode() if i in special else bytes(back[c] for c in t.id_to_token(i)) for i in range(t.get_vocab_size())]


def decode(ids: np.ndarray, path: str) -> bytes:
    """UTF-8 of the decoded text; bytes that are no UTF-8 become U+FFFD."""
    table = byte_table(path)
    return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace").encode()


class TreeEncoder:
    """Encodes whole texts. ``joins`` counts the joins of texts' parts."""

    def __init__(self, path: str, ranks: str, leaf: int = LEAF, window: int = WINDOW, threads: int = 2, text_leaf: int = TEXT_LEAF):
        self.path, self.ranks, self.leaf, self.window, self.threads, self.text_leaf = path, byte_ranks(ranks), leaf, window, threads, text_leaf
        self.special = {t.content: i for i, t in load(path).get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.long = re.compile(f"[^{SPACE}]{{{leaf},}}|[{SPACE}]{{{leaf},}}")
        table = byte_table(path)
        self.opens = np.array([b[:1] == b" " for b in table])
        self.closes = np.array([b[-1:].isascii() and b[-1:].decode("latin-1").isprintable() and b[-1:] not in (b"", b" ") for b in table])
        self.joins = 0

    def __call__(self, text: str) -> np.ndarray:
        if len(text) <= self.text_leaf:
            return self.part(text)
        parts = [text]
        while len(parts[0]) > self.text_leaf:
            parts = [h for p in parts for h in (p[: len(p) // 2], p[len(p) // 2 :])]
        if "<" in text or self.long.search(text):
            return self.joined([self.part(p) for p in parts])
        return self.joined([np.array(ids, np.uint32) for ids in self.ranks.encode_ordinary_batch(parts, num_threads=self.threads)])

    def joined(self, done: list[np.ndarray]) -> np.ndarray:
        """Ids of the whole from those of its parts in order, level by level."""
        while len(done) > 1:
            done = [self.concatenated(*done[i : i + 2]) for i in range(0, len(done) - 1, 2)] + done[len(done) & ~1 :]
        return done[0]

    def concatenated(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of two texts as one."""
        self.joins += 1
        table, w = byte_table(self.path), self.window
        while True:
            a, b = left[-w - 1 :], right[: w + 1]
            before, after = (np.flatnonzero(self.opens[x[1:]] & self.closes[x[:-1]]) + 1 for x in (a, b))
            i = len(left) - len(a) + int(before[-1]) if len(before) else 0 if len(a) == len(left) else None
            j = int(after[0]) if len(after) else len(right) if len(b) == len(right) else None
            if i is not None and j is not None:
                break
            w *= 2
        between = b"".join(table[t] for t in [*left[i:].tolist(), *right[:j].tolist()]).decode()
        return np.concatenate([left[:i], self.part(between), right[j:]])

    def part(self, text: str) -> np.ndarray:
        """Ids of a text that is not halved, but for long runs in it."""
        parts = []
        for part in self.cut.split(text) if "<" in text else [text]:
            if part in self.special:
                parts.append(np.array([self.special[part]], np.uint32))
            elif len(part) <= self.leaf or not self.long.search(part):
                parts.append(self.plain(part))
            else:
                parts += self.unsplit(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def plain(self, text: str) -> np.ndarray:
        return self.ranks.encode_to_numpy(text, disallowed_special=())

    def unsplit(self, text: str) -> Iterator[np.ndarray]:
        """Parts of a text with a long run in it: runs as trees, what lies between as it is."""
        between: list[str] = []
        for chunk in CHUNKS.findall(text):
            if len(chunk) <= self.leaf:
                between.append(chunk)
                continue
            yield self.plain("".join(between))
            between = []
            for piece in SPLIT.findall(chunk):
                yield np.array(self.tree(piece), np.uint32)
        yield self.plain("".join(between))

    def tree(self, piece: str) -> list[int]:
        """The piece's ids: leaves in parallel, then joins, level by level."""
        parts = [piece]
        while len(parts[0]) > self.leaf:
            parts = [h for p in parts for h in (p[: len(p) // 2], p[len(p) // 2 :])]
        done = self.ranks.encode_ordinary_batch(parts, num_threads=self.threads)
        while len(done) > 1:
            done = [self.join(*done[i : i + 2]) for i in range(0, len(done), 2)]
        return done[0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of both texts as one."""
        table, w = byte_table(self.path), self.window
        while True:
            a, b = left[-w:], right[:w]
            try:
                middle = self.ranks.encode_ordinary(b"".join(table[i] for i in a + b).decode())
            except UnicodeDecodeError:  # the window cuts a character: look further
                middle = []
            if middle and (len(a) == len(left) or middle[0] == a[0]) and (len(b) == len(right) or middle[-1] == b[-1]):
                return left[: len(left) - len(a)] + middle + right[len(b) :]
            w *= 2


@lru_cache(maxsize=4)
def encoder(path: str, ranks: str) -> TreeEncoder:
    return TreeEncoder(path, ranks)


def encoded(docs: DataFrame, path: str, ranks: str, columns: Callable[[list, list[np.ndarray]], pa.RecordBatch], schema: str, chunk: int = CHUNK) -> DataFrame:
    """What ``columns`` makes of doc_ids and the ids of whole texts. Texts above ``chunk``
    characters are dealt to tasks in parts, and joined where the parts meet again."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks)
        for batch in batches:
            yield columns(batch.column("doc_id"), [encode(t.as_py()) for t in batch.column("text")])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks)
        for batch in batches:
            ids = [encode(t.as_py()).astype("<u4").tobytes() for t in batch.column("part")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "rid", "at")), pa.array(ids, pa.binary())], ["doc_id", "rid", "at", "ids"])

    def joined(table: pa.Table) -> pa.Table:
        rows = table.sort_by("at")
        ids = encoder(path, ranks).joined([np.frombuffer(b, "<u4") for b in rows.column("ids").to_pylist()])
        return pa.Table.from_batches([columns(rows.column("doc_id").slice(0, 1).combine_chunks(), [ids])])

    rows = documents(docs)
    size = F.char_length("text")
    short = rows.where(size <= chunk).mapInArrow(whole, schema)
    spread = rows.where(size > chunk).withColumn("rid", F.monotonically_increasing_id()).select("doc_id", "rid", "text", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / F.lit(chunk)).cast("int"))).alias("at"))
    spread = spread.select("doc_id", "rid", "at", F.substring("text", F.col("at") * chunk + 1, F.lit(chunk)).alias("part")).repartition("rid", "at")
    long = spread.mapInArrow(parts, "doc_id long, rid long, at int, ids binary").groupBy("rid").applyInArrow(joined, schema)
    return short.unionByName(long)


def encode_table(docs: DataFrame, path: str, ranks: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, ids, decoded text, of every whole text."""

    def columns(docs: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([docs, pa.array([i.tolist() for i in ids], pa.list_(pa.int64())), pa.array([decode(i, path).decode() for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return encoded(docs, path, ranks, columns, "doc_id long, ids array<long>, decoded string", chunk)


def digests(docs: DataFrame, path: str, ranks: str, chunk: int = CHUNK) -> DataFrame:
    """As ``encode_table``, with digests in place of ids and texts, made where they are."""

    def columns(docs: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
        a = [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]
        b = [hashlib.sha256(decode(i, path)).hexdigest() for i in ids]
        return pa.RecordBatch.from_arrays([docs, pa.array([len(i) for i in ids], pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded(docs, path, ranks, columns, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", chunk)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
