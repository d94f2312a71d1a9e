"""Cross-tokenizer alignment over distinct texts.

Documents are shuffled by their full texts, so each distinct text is tokenised and aligned
once, whatever its number of copies. Both tokenizers cover the same bytes, a space and the
text; where tokens of both end, the text is cut to groups, and a token of one is linked with
each token of the other whose bytes it shares. As both cover the text without gaps, each
stretch between two neighbouring ends of either kind is one link.

How many documents hold a pair of ids linked is summed over distinct texts, weighted by
their copies: tasks sum up what they hold before the shuffle. Pairs with at least one in
``HOT`` of the corpus's sum, of which there can be ``HOT`` at most, are broadcast to weigh
the texts' links; what is left of each text, its rare pairs, meets its counts in a
sort-merge join. Measures are joined back to doc_ids by the texts' digests.

Neither tokenizer looks across a space that follows a visible character: the one always
cuts there, and the other has no piece in which a space follows anything but a space. So
words, with the spaces before them, are encoded once by either, and a worker keeps those
that it saw last.

Defined cases: a text that is null or empty, or that a tokenizer does not give back byte by
byte (U+2581, say, which stands for a space), has no tokens, and all its measures are 0;
strings of special tokens are plain text; a text of any length is aligned whole, by one
task; of equal counts all are the best; repeated rows, and rows without a doc_id, count as
documents; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emrecon.llm.bpe import TreeEncoder, byte_table
from emrecon.llm.common import attach, cut, documents, held

#: Pairs that are broadcast at most (24 bytes each).
HOT = 1 << 18
#: Words whose ids a worker keeps at most; then it starts anew.
CACHE = 300_000
#: Pairs that a task sums up at once.
AT_ONCE = 1 << 21
#: What stands for a space in pieces, and bits of a piece's id in a pair's key.
SPACE, BITS = "▁", 15

BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")
#: Spaces and what follows, up to the next space after anything but white space.
WORD = re.compile(r" +(?:[^ ]*[^\S ] +)*[^ ]*")


class Aligner:
    """Both tokenizers, the ids that they give words, and the alignment of their tokens."""

    def __init__(self, a_path: str, a_ranks: str, b_path: str):
        self.first, self.library = TreeEncoder(a_path, a_ranks), sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.library.id_to_piece(i) for i in range(len(self.library))]
        self.a = byte_table(a_path)
        self.b = [bytes.fromhex(m[1]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace(SPACE, " ").encode() for p in pieces]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces) or len(self.b) > 1 << BITS or len(self.a) > 1 << 16:
            raise ValueError(f"{b_path} has pieces that go on after a word, or a vocabulary is too large")
        self.in_a, self.in_b = (np.array([len(t) for t in table]) for table in (self.a, self.b))
        self.space = self.library.piece_to_id(SPACE)
        # an id as it stands before a comma, at the end of a group's first ids, and of its second
        self.ids = max(len(self.a), len(self.b))
        self.names = [f"{i}{end}" for end in ",|;" for i in range(self.ids)]
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def learn(self, words: set[str]) -> None:
        """Ids of both for each word; None where the bytes of either are not the word's."""
        most = self.first.leaf
        # of words in a row, the first tokenizer cuts each as by itself, unless it ends with white space
        plain = [w for w in words if len(w) < most and not w[-1].isspace()]
        odd = [*words.difference(plain)]
        rows = self.first.plain("".join(plain))
        ends = np.cumsum([0, *(len(w) if w.isascii() else len(w.encode()) for w in plain)])
        a = self._parts(rows, np.searchsorted(np.cumsum(np.r_[0, self.in_a[rows]]), ends))
        for w in odd:
            ids = np.concatenate([*self.first.unsplit(w)]) if self.first.long.search(w) else self.first.plain(w)
            a.append(ids.astype("<u2").tobytes())
        words = plain + odd
        # the library puts a space before what it encodes
        lists = [ids or [self.space] for ids in self.library.encode([w[1:] for w in words], num_threads=1)]
        b = self._parts(np.fromiter(chain.from_iterable(lists), np.int64), np.cumsum([0, *map(len, lists)]))
        self.known.update(zip(words, zip(a, b, strict=True), strict=True))
        whole = "".join(words).encode()
        if any(self._bytes(np.frombuffer(b"".join(raw), "<u2"), table) != whole for raw, table in ((a, self.a), (b, self.b))):
            for w, x, y in zip(words, a, b, strict=True):
                if any(self._bytes(np.frombuffer(raw, "<u2"), table) != w.encode() for raw, table in ((x, self.a), (y, self.b))):
                    self.known[w] = None

    @staticmethod
    def _parts(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        raw, at = ids.astype("<u2").tobytes(), (2 * ends).tolist()
        return [raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]

    @staticmethod
    def _bytes(ids: np.ndarray, table: list[bytes]) -> bytes:
        return b"".join([table[i] for i in ids.tolist()])

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both tokenizers; None where there are none."""
        if not text or SPACE in text:
            return None
        words = WORD.findall(f" {text}")
        if new := set(words).difference(self.known):
            if len(self.known) + len(new) > CACHE:
                self.known.clear()
                new = set(words)
            self.learn(new)
        found = [*map(self.known.__getitem__, words)]
        if None in found:
            return None
        a, b = zip(*found, strict=True)
        return tuple(np.frombuffer(b"".join(ids), "<u2").astype(np.int64) for ids in (a, b))

    def links(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in a and in b of the tokens of each link, in order, and whether a group
        ends with it."""
        end_a, end_b = np.cumsum(self.in_a[a]), np.cumsum(self.in_b[b])
        ends = np.concatenate([end_a, end_b])
        ends.sort(kind="stable")  # two runs
        ends = ends[np.r_[True, ends[1:] != ends[:-1]]]
        i, j = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        return i, j, (end_a[i] == ends) & (end_b[j] == ends)

    def groups(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3`` for groups that end with the tokens at i and j."""
        in_a, in_b = np.diff(i, prepend=-1), np.diff(j, prepend=-1)
        # a token follows those of its own kind, and the other kind's of the groups before
        before_a, before_b = np.repeat(j + 1 - in_b, in_a), np.repeat(i + 1, in_b)
        a, b = a.copy(), b.copy()
        a[i] += self.ids
        b[j] += 2 * self.ids
        row = np.empty(len(a) + len(b), np.int64)
        row[np.arange(len(a)) + before_a] = a
        row[np.arange(len(b)) + before_b] = b
        return "".join([self.names[t] for t in row.tolist()])[:-1]


def aligner(a_path: str, a_ranks: str, b_path: str) -> Aligner:
    return held(("aligner", a_path, a_ranks, b_path), lambda: Aligner(a_path, a_ranks, b_path))


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 by bytes of like weight, which compress well."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


FACTS = ["n_a", "n_b", "n_groups", "n_links"]


def distinct_texts(docs: DataFrame) -> DataFrame:
    """text, copies, digest: one row for each distinct text that is not empty. Rows are
    shuffled by the full text, with copies counted before."""
    texts = documents(docs).where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return texts.select("text", "copies", digest().alias("digest"))


def digest():
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def aligned(texts: DataFrame, a_path: str, a_ranks: str, b_path: str, full: bool = False) -> DataFrame:
    """Per row of ``distinct_texts``: digest, copies, the measures of FACTS, groups_sha256,
    and the distinct pairs of linked ids with their occurrences, packed. With ``full`` also
    the ids of both tokenizers and the groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a_path, a_ranks, b_path)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                found = align.tokens(text.as_py())
                if found is None:
                    rows.append((0, 0, 0, 0, "", b"", b"", *([[], [], ""] if full else ())))
                    continue
                a, b = found
                i, j, end = align.links(a, b)
                groups = align.groups(a, b, i[end], j[end])
                keys, times = np.unique(a[i] << BITS | b[j], return_counts=True)
                rows.append((len(a), len(b), int(end.sum()), len(i), hashlib.sha256(groups.encode()).hexdigest(), packed(np.diff(keys, prepend=0)), packed(times), *((a.tolist(), b.tolist(), groups) if full else ())))
            columns = [pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("copies"), *columns], ["digest", "copies", *(n for n, _ in kinds)])

    kinds = [*((n, pa.int64()) for n in FACTS), ("groups_sha256", pa.string()), ("keys", pa.binary()), ("times", pa.binary())]
    schema = "digest binary, copies long, " + ", ".join(f"{n} long" for n in FACTS) + ", groups_sha256 string, keys binary, times binary"
    if full:
        kinds += [("a_ids", pa.list_(pa.int64())), ("b_ids", pa.list_(pa.int64())), ("groups", pa.string())]
        schema += ", a_ids array<long>, b_ids array<long>, groups string"
    return texts.select("text", "digest", "copies").mapInArrow(run, schema)


def summed(keys: list[np.ndarray], weights: list[np.ndarray]) -> pa.RecordBatch:
    k, w = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(k, kind="stable")
    k, w = k[order], w[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return pa.RecordBatch.from_arrays([pa.array(k[first]), pa.array(np.add.reduceat(w, first))], ["key", "n"])


def pair_counts(found: DataFrame) -> DataFrame:
    """key, n, best: in how many documents each pair of ids is linked, and whether that is
    the most of its first id. There are as many first ids as the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, size = [], [], 0
        for batch in batches:
            for raw, copies in zip(batch.column("keys").to_pylist(), batch.column("copies").to_pylist(), strict=True):
                if raw:
                    keys.append(np.cumsum(unpacked(raw)))
                    weights.append(np.full(len(keys[-1]), copies))
                    size += len(keys[-1])
            if size > AT_ONCE:
                yield summed(keys, weights)
                keys, weights, size = [], [], 0
        if size:
            yield summed(keys, weights)

    counts = cut(found.select("keys", "copies").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "pairs")
    first = F.shiftright("key", BITS)
    most = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), first == F.col("a")).select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def weighed(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """``found`` with count_sum and n_best in place of its pairs."""
    pairs = cut(pairs, "weights")
    total = pairs.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT >= F.lit(total)
    hot = pairs.where(is_hot).orderBy("key").toArrow()  # HOT rows at most
    shared = found.sparkSession.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("key", "n", "best")))
    kept = ["digest", "copies", *FACTS, "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            sums, bests, rare, often = [], [], [], []
            for raw, times in zip(batch.column("keys").to_pylist(), batch.column("times").to_pylist(), strict=True):
                keys, times = (np.cumsum(unpacked(raw)), unpacked(times)) if raw else (np.zeros(0, np.int64),) * 2
                at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
                met = known[at] == keys if len(known) else np.zeros(len(keys), bool)
                sums.append(int((n[at[met]] * times[met]).sum()))
                bests.append(int(times[met][best[at[met]]].sum()))
                rare.append(keys[~met].tolist())
                often.append(times[~met].tolist())
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), pa.array(rare, lists), pa.array(often, lists)], [*kept, "n_best", "count_sum", "rare", "often"])

    schema = "digest binary, copies long, " + ", ".join(f"{n} long" for n in FACTS) + ", groups_sha256 string, n_best long, count_sum long, rare array<long>, often array<long>"
    rows = cut(found.select(*kept, "keys", "times").mapInArrow(run, schema), "weighed")
    left = rows.select("digest", F.explode(F.arrays_zip("rare", "often")).alias("p")).select("digest", F.col("p.rare").alias("key"), F.col("p.often").alias("times"))
    left = left.join(pairs.where(~is_hot), "key").groupBy("digest").agg(F.sum(F.col("n") * F.col("times")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("bests"))
    rows = rows.drop("rare", "often").join(left, "digest", "left")
    return rows.withColumns({"count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("bests", F.lit(0))}).drop("more", "bests")


def measures(docs: DataFrame, a_path: str, a_ranks: str, b_path: str) -> DataFrame:
    """doc_id, FACTS, n_best, count_sum, groups_sha256 of every row of ``docs``."""
    found = cut(aligned(distinct_texts(docs), a_path, a_ranks, b_path), "aligned")
    facts = cut(weighed(found, pair_counts(found)), "measures")
    out = [*FACTS, "n_best", "count_sum", "groups_sha256"]
    rows = documents(docs)
    total = facts.agg(F.sum("copies")).first()[0] or 0
    full = attach(rows.where("text <> ''").select("doc_id", digest().alias("digest")), facts, "digest", "copies", total).select("doc_id", *out)
    empty = rows.where("text = ''").select("doc_id", *(F.lit(0).cast("long").alias(c) for c in out[:-1]), F.lit("").alias("groups_sha256"))
    return full.unionByName(empty)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return measures(spark.read.parquet(f"{sf_dir}/documents.parquet"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), path("piece_bpe_32k.model"))
