"""Fill-in-middle: texts cut at two unit borders and written in another order.

The code points of a slice of texts are one sequence of symbols: the character
class of the code point before (the start of a text counts as a space) and its
own class. A wavelet matrix over the four bits of these symbols answers how
often a symbol occurs before a place. A unit's border is a pair of classes, and
several pairs can be borders, so the number of borders before a place is a sum of
ranks; the difference over a text is its number of borders. The two cuts of every
text are found by bisection on these ranks, for all texts of the slice at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import read_table, row_slices, text_or_empty

KEY = "op11_fill_in_middle"

#: Character classes: ASCII white space other than a line feed, line feed, anything else.
SPACE, LINE, OTHER = 0, 1, 2
CLASS_OF = np.full(0x21, OTHER, np.uint8)
CLASS_OF[[0x20, 9, 11, 12, 13]] = SPACE
CLASS_OF[10] = LINE

#: (class before, class) of the code point behind a border, by unit.
BORDERS = {"word": ((OTHER, SPACE), (OTHER, LINE)),
           "line": ((LINE, SPACE), (LINE, LINE), (LINE, OTHER))}

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SLICE_BYTES = 2_000_000


class WaveletMatrix:
    """Ranks of small symbols in a sequence, a bit plane per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.planes, self.zeros = bits, [], []
        for level in reversed(range(bits)):
            plane = ((symbols >> level) & 1).astype(bool)
            packed = np.packbits(plane, bitorder="little")
            words = np.zeros(len(plane) // 64 + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.planes.append((words, before))
            self.zeros.append(len(plane) - int(np.count_nonzero(plane)))
            symbols = np.concatenate([symbols[~plane], symbols[plane]])

    @staticmethod
    def _ones(plane: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
        words, before = plane
        w = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[w] + np.bitwise_count(words[w] & below)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before each place of ``at``."""
        lo, hi = np.zeros_like(at), at
        for level, plane, zeros in zip(reversed(range(self.bits)), self.planes, self.zeros, strict=True):
            ones_lo, ones_hi = self._ones(plane, lo), self._ones(plane, hi)
            lo, hi = (zeros + ones_lo, zeros + ones_hi) if symbol >> level & 1 else (lo - ones_lo, hi - ones_hi)
        return hi - lo


def class_pairs(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The symbol of each code point: class before and own class, two bits each."""
    own = CLASS_OF[np.minimum(points, 0x20)]
    own[points > 0x20] = OTHER
    before = np.zeros_like(own)
    before[1:] = own[:-1]
    before[starts[starts < len(own)]] = SPACE
    return before << 2 | own


class Borders:
    """The unit borders of the texts of a slice, which begin and end at ``starts`` and ``ends``."""

    def __init__(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, unit: str):
        self.starts, self.ends = starts, ends
        self.matrix = WaveletMatrix(class_pairs(points, starts), 4)
        self.symbols = [a << 2 | b for a, b in BORDERS[unit]]
        self.first = self._before(starts)
        self.count = self._before(ends) - self.first

    def _before(self, at: np.ndarray) -> np.ndarray:
        return sum(self.matrix.rank(s, at) for s in self.symbols)

    def units(self) -> np.ndarray:
        """Each text's number of units: its borders, and the end of a text that is not empty."""
        return self.count + (self.ends > self.starts)

    def cut(self, k: np.ndarray) -> np.ndarray:
        """The length of each text's first ``k`` units, by bisection on the number of borders before a place."""
        lo, hi = self.starts.copy(), self.ends.copy()
        for _ in range(int((hi - lo).max(initial=0)).bit_length()):
            # the least place with k borders at or before it
            mid = (lo + hi) >> 1
            enough = self._before(np.minimum(mid + 1, self.ends)) - self.first >= k
            hi = np.where((lo < hi) & enough, mid, hi)
            lo = np.where((lo < hi) & ~enough, mid + 1, lo)
        at = np.where(k > self.count, self.ends, np.where(k == 0, self.starts, lo))
        return at - self.starts


def arrange(prefix: str, middle: str, suffix: str, form: str) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that ``output`` was made of. No part holds a marker, and a marker starts with its only ``<``."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    one, rest = output[len(PREFIX):].split(second, 1)
    other, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (one, other) if form == "psm" else (other, one)
    return prefix + middle + suffix


def transform_batches(batches: Iterator[pa.RecordBatch], unit: str, rate: int, spm_rate: int) -> Iterator[pa.RecordBatch]:
    """Columns text, h1 to h4 and the rest; the text gives way to what came of it."""
    for batch in batches:
        for part in row_slices(batch, 0, SLICE_BYTES):
            texts = part.column(0).to_pylist()
            sizes = np.array([len(t) for t in texts], np.int64)
            ends = np.cumsum(sizes)
            points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
            borders = Borders(points, ends - sizes, ends, unit)
            n = borders.units()
            h1, h2, h3, h4 = (part.column(i).to_numpy() for i in range(1, 5))
            a, b = h1 % (n + 1), h2 % (n + 1)
            first, second = borders.cut(np.minimum(a, b)), borders.cut(np.maximum(a, b))
            forms, outputs, restored = [], [], []
            for t, x, y, u, v in zip(texts, first.tolist(), second.tolist(), h3.tolist(), h4.tolist(), strict=True):
                plain = not t or u % 100 >= rate or PREFIX in t or SUFFIX in t or MIDDLE in t
                forms.append("plain" if plain else "spm" if v % 100 < spm_rate else "psm")
                outputs.append(t if plain else arrange(t[:x], t[x:y], t[y:], forms[-1]))
                restored.append(restore(outputs[-1], forms[-1]))
            plain = np.array([f == "plain" for f in forms], bool)
            made = {"output": pa.array(outputs, pa.string()), "restored": pa.array(restored, pa.string()), "n": pa.array(n, pa.int64()),
                    "form": pa.array(forms, pa.string()), "prefix_chars": pa.array(first, pa.int64(), mask=plain),
                    "middle_chars": pa.array(second - first, pa.int64(), mask=plain)}
            yield pa.RecordBatch.from_pydict(made | {c: part.column(c) for c in part.schema.names[5:]})


def draws(id_col: str, seed: int) -> list[Column]:
    """h1 to h4: the first 32-bit groups of the sha256 of seed and id; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "word",
                   percent: int = 50, spm_percent: int = 80, seed: int = 42) -> DataFrame:
    """``(doc_id, output, restored, n, form, prefix_chars, middle_chars)``, a row per input row.

    A text of ``n`` units is cut behind the smaller and the larger of two keyed
    draws of 0 to n units. ``unit`` is "word" (a run of other characters with the
    ASCII white space before it; white space at the end is a unit) or "line" (up
    to and with its line feed). ``percent`` of the texts change, and of these
    ``spm_percent`` begin with the suffix. ``restored`` is rebuilt from ``output``
    and ``form`` alone and equals the text.

    Defined cases: a null text is an empty one; empty texts and texts that hold a
    marker stay as they are (form plain, null lengths). A null id draws as empty
    text; rows that repeat an id draw alike and each stay a row. Two equal draws
    give an empty middle. Other columns are ignored, an empty table gives no rows.
    """
    if unit not in BORDERS:
        raise ValueError(f"unknown unit {unit!r}")
    rows = docs.select(text_or_empty(text_col).alias("text"), *draws(id_col, seed), F.col(id_col).alias("doc_id"))
    schema = f"output string, restored string, n long, form string, prefix_chars long, middle_chars long, doc_id {rows.schema['doc_id'].dataType.simpleString()}"
    out = rows.mapInArrow(lambda it: transform_batches(it, unit, percent, spm_percent), schema)
    return out.select("doc_id", "output", "restored", "n", "form", "prefix_chars", "middle_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS s,
                  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2,
             ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS x FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m
                        ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
