"""Fill-in-middle transformation over an indexable skip list.

A text's units are runs of ASCII letters and single other characters. Its skip list has a
node for each unit of a height of 1 or more, which a hash of its rank decides, so that a
task that runs again builds the same list. Each express lane carries the widths to its next
node, in units and in code points. To cut at a rank, the search descends from the top lane:
it goes on while the units passed do not exceed the rank, adding up code points on the way,
and drops a lane where they would. Units of height 0 are not stored: below the last lane
they are counted in the text itself, between two neighbouring nodes. Lists are built from
blocks of a text, so what a list takes is a small share of the text.

Two ranks, from digests of the doc_id, part a text to prefix, middle and suffix. The output
holds them in one of two orders behind markers; a text that has a marker in it, or whose
turn it is, stays plain. As no marker begins as one ends, none arises where parts meet, and
the first of each kind is the real one: the text can be read back exactly.

Defined cases: null and empty texts are plain and empty; a text of any length is taken
whole; of equal ranks the middle is empty; repeated rows give the same output each; a null
doc_id counts as the empty string in the digests; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from emrecon.llm.common import documents

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points that are cut to units at once.
BLOCK = 1 << 16
#: One node in so many reaches the next lane, as a power of two.
FEWER = 4
#: Shares, in hundredths, of texts that are transformed and, of these, that have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20


class SkipList:
    """Units of a text with express lanes; ``self.lanes`` from the top, each of node ranks'
    widths in units and in code points. The head node, before the first unit, is in all."""

    def __init__(self, text: str, block: int = BLOCK):
        self.text, self.block = text, block
        self.units, self.steps = 0, 0
        ranks, places = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        for at in range(0, len(text), block):
            starts = self._starts(at, min(len(text), at + block))
            rank = self.units + np.arange(len(starts))
            tall = (self._height(rank) > 0) & (rank > 0)
            ranks.append(rank[tall])
            places.append(starts[tall])
            self.units += len(starts)
        rank, place = np.concatenate(ranks), np.concatenate(places)
        height = self._height(rank)
        height[0] = max(1, int(height[1:].max(initial=0)))
        self.lanes = []
        for level in range(int(height[0]), 0, -1):
            own = np.flatnonzero(height >= level)
            self.lanes.append((np.diff(rank[own], append=self.units), np.diff(place[own], append=len(text))))
        # where each node of a lane stands in the lane below
        self.down = [np.flatnonzero(height[height >= level - 1] >= level) for level in range(int(height[0]), 1, -1)]

    @staticmethod
    def _height(rank: np.ndarray) -> np.ndarray:
        """Geometric, from a mix of the rank's bits."""
        h = rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        out = np.zeros(len(rank), np.int64)
        for level in range(1, 1 + 64 // FEWER):
            out += h < (1 << (64 - FEWER * level))
        return out

    def _starts(self, lo: int, hi: int) -> np.ndarray:
        """Places in [lo, hi) where a unit starts."""
        points = np.frombuffer(self.text[max(0, lo - 1) : hi].encode("utf-32-le"), "<u4")
        letter = (points | 32) - 97 < 26  # unsigned: smaller code points wrap around
        inside = letter[1:] & letter[:-1]
        return lo + np.flatnonzero(~(inside if lo else np.r_[False, inside]))

    def place(self, rank: int) -> int:
        """The code points before the unit of this rank; all for the number of units."""
        if rank >= self.units:
            return len(self.text)
        node, units, points = 0, 0, 0
        for k, (unit_width, point_width) in enumerate(self.lanes):
            while units + unit_width[node] <= rank:
                units += int(unit_width[node])
                points += int(point_width[node])
                node += 1
                self.steps += 1
            if k < len(self.down):
                node = int(self.down[k][node])
        # between this node and the next of the last lane, units are counted in the text
        end, at, left = points + int(self.lanes[-1][1][node]), points, rank - units
        while left:
            to = min(end, at + self.block)
            starts = self._starts(at, to)
            starts = starts[starts > points]
            if left <= len(starts):
                return int(starts[left - 1])
            left, at = left - len(starts), to
        return points


def draws(doc_id: int | None) -> list[int]:
    """Four 32-bit numbers from the digest of a doc_id."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def transform(doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle, output."""
    cuts = SkipList(text)
    n, (h1, h2, h3, h4) = cuts.units, draws(doc_id)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= TRANSFORMED:
        return n, "plain", None, None, text
    a, b = (cuts.place(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that an output was made from."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


KINDS = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]


def _mapped(docs: DataFrame, more: list[str], of: Callable[[str, str], tuple]) -> DataFrame:
    """KINDS and the strings ``more`` that ``of`` makes of an output and its form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                *facts, output = transform(doc, text.as_py())
                rows.append((doc, *facts, *of(output, facts[1])))
            columns = zip(*rows, strict=True) if rows else [[] for _ in range(len(KINDS) + len(more))]
            kinds = [*KINDS, *((name, pa.string()) for name in more)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [name for name, _ in kinds])

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, " + ", ".join(f"{m} string" for m in more)
    return documents(docs).mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of each row."""
    return _mapped(docs, ["output"], lambda output, form: (output,))


def read_back(transformed: DataFrame) -> DataFrame:
    """``transformed`` (with output and form) with the texts that the outputs were made
    from as ``restored``. Column expressions alone."""
    two = "CASE WHEN form = 'psm' THEN '<S>' ELSE '<P>' END"
    at, mid = f"locate({two}, output)", f"locate('<M>', output, locate({two}, output) + 3)"
    one = f"substring(output, 4, {at} - 4)"
    other = f"substring(output, {at} + 3, {mid} - {at} - 3)"
    middle = f"substring(output, {mid} + 3)"
    return transformed.selectExpr("*", f"CASE form WHEN 'plain' THEN output WHEN 'psm' THEN concat({one}, {middle}, {other}) ELSE concat({other}, {middle}, {one}) END AS restored")


def digests(docs: DataFrame) -> DataFrame:
    """As ``fill_in_middle``, with digests of the output and of the text read back from it."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return _mapped(docs, ["output_sha256", "restored_sha256"], lambda output, form: (sha(output), sha(restore(output, form))))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
  ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM u),
p AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
