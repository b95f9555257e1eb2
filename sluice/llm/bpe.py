"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

1. Fit: one scan counts white-space separated words, map-side first; the
   ``lexicon_size`` most frequent are encoded once and compiled into a minimal
   acyclic automaton over their bytes. Equal suffixes share states; each arc
   carries the number of words that sort before it, so the sum along a path is
   the word's place in a flat table of token ids. The lexicon only saves time:
   it has no influence on any result, and its size is a parameter.
2. Encode: every task memory-maps the broadcast automaton. The distinct words of
   a slice of documents walk it together, byte by byte, as numpy arrays; words
   that it does not hold are merged exactly by the tokenizer's own merges, many
   at a time. A bounded cache keeps where each word's ids are in one array; a
   slice's ids are gathered from it, and made text by token, not by word.

Encoding word by word is exact for this kind of tokenizer: its split pattern
never crosses white space, and a special token holds none.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import giving_back, read_table, row_slices, text_or_empty

KEY = "op9_bpe"

SLICE_BYTES = 2_000_000
#: Bytes that a task's words may take (with what a Python object costs) before it forgets them.
CACHE_BYTES, OBJECT_BYTES = 60_000_000, 180
#: Words that the tokenizer gets in one text.
MERGED_WORDS = 200
#: Distinct words a counting task holds before it gives them out.
HELD_WORDS = 600_000
#: White space to str.split() but not to the tokenizer.
ODD_SPACE = re.compile("[\x1c-\x1f]")


def words_of(text: str) -> list[str]:
    return text.split() if ODD_SPACE.search(text) is None else [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]


def load_tokenizer(source: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(source)
    tok.no_truncation()
    tok.no_padding()
    return tok


class Lexicon:
    """Minimal acyclic automaton from words to rows of a table of token ids."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)
        self.arrays = arrays

    @classmethod
    def compile(cls, words: Sequence[bytes], ids: Sequence[Sequence[int]]) -> Lexicon:
        """``words`` distinct and sorted. States are made minimal as soon as no later word can change them."""
        register: dict[tuple, int] = {}
        done: list[tuple] = []  # (final, ((label, state), ...)) of minimal states

        def frozen(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(done)
                done.append(key)
            return register[key]

        open_nodes: list[list] = [[False, []]]  # along the last word; each [final, arcs]
        last = b""
        for w in words:
            same = len(os.path.commonprefix([last, w]))
            while len(open_nodes) > same + 1:
                child = frozen(open_nodes.pop())
                open_nodes[-1][1].append((last[len(open_nodes) - 1], child))
            open_nodes += [[False, []] for _ in w[same:]]
            open_nodes[-1][0] = True
            last = w
        while len(open_nodes) > 1:
            child = frozen(open_nodes.pop())
            open_nodes[-1][1].append((last[len(open_nodes) - 1], child))
        root = frozen(open_nodes[0])
        below = np.zeros(len(done), np.int64)  # words below a state; children come before parents
        keys, targets, skips = [], [], []
        for s, (final, arcs) in enumerate(done):
            n = int(final)
            for label, t in arcs:
                keys.append(s * 256 + label)
                targets.append(t)
                skips.append(n)
                n += below[t]
            below[s] = n
        return cls({"root": np.array([root], np.int64), "final": np.array([f for f, _ in done], bool),
                    "keys": np.array(keys, np.int64), "targets": np.array(targets, np.int64), "skips": np.array(skips, np.int64),
                    "starts": np.cumsum([0, *map(len, ids)]).astype(np.int64), "ids": np.array([i for x in ids for i in x], np.int32)})

    def places(self, words: Sequence[bytes]) -> np.ndarray:
        """The row of each word in the table, -1 for words that the lexicon does not hold."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        sizes = np.fromiter(map(len, words), np.int64, n)
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        flat = np.frombuffer(b"".join(words), np.uint8)
        live, state, place = np.arange(n), np.full(n, self.root[0]), np.zeros(n, np.int64)
        for p in range(int(sizes.max())):
            ended = sizes[live] == p
            hit = ended & self.final[state]
            out[live[hit]] = place[hit]
            live, state, place = live[~ended], state[~ended], place[~ended]
            key = state * 256 + flat[at[live] + p]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            live, state, place = live[ok], self.targets[arc[ok]], place[ok] + self.skips[arc[ok]]
            if not len(live):
                return out
        hit = self.final[state]
        out[live[hit]] = place[hit]
        return out

    def tokens(self, place: int) -> list[int]:
        return self.ids[self.starts[place]:self.starts[place + 1]].tolist()

    def dump(self) -> bytes:
        """The arrays one after the other, after a line that names them."""
        head = ";".join(f"{k},{a.dtype.str},{len(a)}" for k, a in self.arrays.items())
        return head.encode().ljust(512) + b"".join(a.tobytes().ljust(-(-a.nbytes // 8) * 8, b"\0") for a in self.arrays.values())

    @classmethod
    def mapped(cls, dumped: bytes) -> Lexicon:
        """The lexicon over a memory-mapped file, which is unlinked and goes with the process."""
        with tempfile.NamedTemporaryFile() as f:
            f.write(dumped)
            f.flush()
            data = np.asarray(np.memmap(f.name, np.uint8, "r"))  # plain views of the mapped bytes are quicker to slice
        arrays, at = {}, 512
        for part in bytes(data[:512]).decode().strip().split(";"):
            name, kind, n = part.split(",")
            size = np.dtype(kind).itemsize * int(n)
            arrays[name] = data[at:at + size].view(kind)
            at += -(-size // 8) * 8
        return cls(arrays)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All words of a task and their counts, summed over as many rows as memory allows."""
    n: Counter = Counter()

    def given() -> Iterator[pa.RecordBatch]:
        words, counts = pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())
        for i in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([words[i:i + 50_000], counts[i:i + 50_000]], ["word", "n"])
        n.clear()

    for batch in batches:
        for part in row_slices(batch, 0, SLICE_BYTES):
            for text in part.column(0).to_pylist():
                n.update(words_of(text))
            if len(n) >= HELD_WORDS:
                yield from given()
    yield from given()


def fit_lexicon(docs: DataFrame, source: str, text_col: str = "text", lexicon_size: int = 65536) -> Lexicon:
    """Lexicon of the most frequent words of ``docs``; at most ``lexicon_size`` rows reach the driver."""
    counted = docs.select(text_or_empty(text_col)).mapInArrow(giving_back(count_words), "word string, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(lexicon_size).collect()
    words = sorted(r.word.encode() for r in top)
    encoded = load_tokenizer(source).encode_batch([w.decode() for w in words], add_special_tokens=False)
    return Lexicon.compile(words, [e.ids for e in encoded])


class Encoder:
    """Texts to token ids; words are numbered as they come, and a word's ids are a part of one array."""

    def __init__(self, source: str, dumped: bytes):
        self.tok, self.lexicon = load_tokenizer(source), Lexicon.mapped(dumped)
        token = {i: t for t, i in self.tok.get_vocab(with_added_tokens=True).items()}
        size = max(token, default=-1) + 1
        self.id_text = pa.array([str(i) for i in range(size)], pa.string())
        self.decoded = pa.array([token.get(i) for i in range(size)], pa.string())
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.first, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.asarray(self.lexicon.ids)
        self.held = 0

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and each word's number of ids."""
        parts = [words[i:i + MERGED_WORDS] for i in range(0, len(words), MERGED_WORDS)]
        ids, n = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for part, e in zip(parts, self.tok.encode_batch([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            starts = np.cumsum([0, *[len(w) + 1 for w in part[:-1]]])
            own = np.searchsorted(starts, np.fromiter((a for a, _ in e.offsets), np.int64, len(e)), "right") - 1
            ids.append(np.array(e.ids, np.int32))
            n.append(np.bincount(own, minlength=len(part)))
        return np.concatenate(ids), np.concatenate(n)

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word; words that are new are looked up in the lexicon, or merged."""
        if self.held > CACHE_BYTES:
            self.forget()
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        new = list(islice(self.number, len(self.n), None))
        places = self.lexicon.places([w.encode() for w in new])
        known = places >= 0
        ids, sizes = self.merged([w for w, k in zip(new, known.tolist(), strict=True) if not k])
        first, n = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        first[known] = self.lexicon.starts[places[known]]
        n[known] = self.lexicon.starts[places[known] + 1] - first[known]
        first[~known] = len(self.ids) + np.cumsum(sizes) - sizes
        n[~known] = sizes
        self.first, self.n, self.ids = np.append(self.first, first), np.append(self.n, n), np.append(self.ids, ids)
        self.held += sum(map(len, new)) + ids.nbytes + OBJECT_BYTES * len(new)
        return at

    def rows(self, texts: list[str]) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Each text's ids as text, its number of ids and its decoded text."""
        words = [words_of(t) for t in texts]
        at = self.numbers(list(chain.from_iterable(words)))
        n = self.n[at]
        ends = np.append(0, np.cumsum(n))
        ids = pa.array(self.ids[np.repeat(self.first[at] - ends[:-1], n) + np.arange(ends[-1])])
        ends = ends[np.cumsum([0, *map(len, words)])]
        # a tokenizer without a decoder joins the tokens by spaces; special tokens stay
        joined = [pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), known.take(ids)), " ") for known in (self.id_text, self.decoded)]
        return joined[0], pa.array(np.diff(ends)), joined[1]


def encode_batches(batches: Iterator[pa.RecordBatch], source, dumped) -> Iterator[pa.RecordBatch]:
    enc = Encoder(source.value, dumped.value)
    for batch in batches:
        for part in row_slices(batch, 1, SLICE_BYTES):
            ids, n, decoded = enc.rows(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), ids, n, decoded], ["doc_id", "id_text", "n_tokens", "decoded"])


def bpe(docs: DataFrame, source: str, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, id_text, n_tokens, decoded)``, a row per input row.

    ``source`` is the tokenizer's JSON. ``id_text`` has the ids in decimal, joined
    by one space (``ids_of`` makes an array of it); ``decoded`` is what decoding
    them gives, special tokens included.

    Defined cases: a null text counts as empty and has no tokens, an empty
    ``id_text`` and an empty ``decoded``. Null ids and repeated rows are kept as
    they are. Long texts are encoded whole. Other columns are ignored, an empty
    table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    src, dumped = sc.broadcast(source), sc.broadcast(lexicon.dump())
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(
        giving_back(lambda it: encode_batches(it, src, dumped)), "doc_id long, id_text string, n_tokens long, decoded string")


def ids_of(id_text):
    """The array<int> of a column of ids as text."""
    return F.when(id_text == "", F.array().cast("array<int>")).otherwise(F.split(id_text, " ").cast("array<int>"))


def word_bpe_source(path: str | None = None) -> str:
    """The public tokenizer's JSON, read on the driver; ``path`` names another file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def digests(docs: DataFrame, source: str) -> DataFrame:
    out = bpe(docs, source, fit_lexicon(docs, source))
    return out.select("doc_id", "n_tokens", F.sha2("id_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"), word_bpe_source())


ORACLE = None
