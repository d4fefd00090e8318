"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

Documents are tokenised once. A document longer than a sequence is cut into full pieces and one rest; the
pieces are dealt at random (seeded, by id and place in the input, so that rows of one id spread too) into groups of
about `group_bytes` of text, and each group is packed by itself. A sequence that would be padded by more than 1/32 is cut into sequences whose lengths are powers of
two, which need no padding: this is the last bin of a group as a rule.

Null and empty texts are one piece with the end token alone. Rows that repeat are packed as often as they
come. Any further column of the input is ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_group, groups, held, slices, table

TOKENIZER = "word_bpe_49k.json"
END = 2
CAPACITY = 4096
#: White space on which a text is cut into chunks that are tokenised apart. The tokenizer never joins what stands on both sides of it.
SPACE = re.compile(r"[ \t\n\x0b\x0c\r]")


class Ids:
    """Token ids of texts. Each distinct chunk between white space is tokenised once and kept, up to `keep` chunks."""

    def __init__(self, path: str, keep: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        words = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(words.values()) + 1, bool)
        self.ends_word[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    def _lines(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and their number for words of letters only, many to a line: each such word ends with the one id that ends words."""
        found = self.tokenizer.encode_batch_fast([" ".join(words[a : a + 512]) for a in range(0, len(words), 512)], add_special_tokens=False)
        flat = np.array([i for x in found for i in x.ids], np.uint32)
        ends = np.flatnonzero(self.ends_word[flat]) + 1
        return (flat, np.diff(ends, prepend=0)) if len(ends) == len(words) and ends[-1] == len(flat) else None

    def _add(self, chunks: list[str]) -> None:
        """Tokenise and keep new chunks."""
        words = [c for c in chunks if c.isalpha()]
        if words and (found := self._lines(words)):
            self._keep(words, *found)
            chunks = [c for c in chunks if not c.isalpha()]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(chunks))
        self._keep(chunks, np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum())), lengths)

    def _keep(self, chunks: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        n, m = len(self.at), len(chunks)
        if n + m > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros(max(m, len(x)), np.int64)]) for x in (self.starts, self.lengths))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(flat), len(self.pool)), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.lengths[n : n + m], self.starts[n : n + m] = lengths, self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)
        self.at.update(zip(chunks, range(n, n + m)))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each begins."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are lower case; all else the tokenizer lower-cases itself
            texts = pc.ascii_lower(texts)
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, r"([a-z])([.,!?;:])", r"\1 \2"))  # it cuts there too
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.at) + len(words) > self.keep:
            self.clear()
        self._add([w for w in words if w not in self.at])
        which = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.lengths[which]
        ends = np.cumsum(lengths)
        ids = self.pool[np.repeat(self.starts[which] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        chunk_ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], chunk_ends])]


def shared_ids(path: str) -> Ids:
    """One for each Python worker, which keeps its chunks from task to task."""
    return held(f"ids {path}", lambda: Ids(path))


def long_parts(text: str, size: int = 4 << 20) -> list[str]:
    """A very long text, cut at white space."""
    parts, a = [], 0
    while len(text) - a > size and (m := SPACE.search(text, a + size)):
        parts.append(text[a : m.start()])
        a = m.end()
    return [*parts, text[a:]]


def document_ids(batch: pa.RecordBatch, ids: Ids, end: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and ids of each document of the batch."""
    texts = pc.fill_null(batch.column("text"), "")
    if batch.num_rows == 1 and len(text := texts[0].as_py()) > 4 << 20:
        yield 0, np.concatenate([*(ids(pa.array([x]))[0] for x in long_parts(text)), [end]]).astype(np.uint32)
        return
    flat, bounds = ids(texts)
    for k in range(batch.num_rows):
        yield k, np.append(flat[bounds[k] : bounds[k + 1]], np.uint32(end))


def pieces(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared_ids(path)
        small = ids.tokenizer.get_vocab_size() <= 1 << 16 and end < 1 << 16
        for whole in batches:
            for batch in slices(whole, "text"):
                doc, start, length, tokens, data = [], [], [], [], []
                keys = batch.column("doc_id").to_pylist()
                for k, x in document_ids(batch, ids, end):
                    raw = x.astype("<u2" if small else "<u4")
                    for a in range(0, len(x), capacity):
                        doc.append(keys[k])
                        start.append(a)
                        length.append(min(capacity, len(x) - a))
                        tokens.append(len(x))
                        data.append(raw[a : a + capacity].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(tokens, pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "raw"])

    return run


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, in the order given. Node k of the tree has the largest free capacity below it."""
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    out = []
    for size in sizes:
        k = 1
        while k < leaves:
            k *= 2
            if tree[k] < size:
                k += 1
        tree[k] -= size
        out.append(k - leaves)
        while k > 1:
            k //= 2
            best = max(tree[2 * k], tree[2 * k + 1])
            if tree[k] == best:
                break
            tree[k] = best
    return out


def place(sizes: list[int], capacity: int, slack: int) -> list[tuple[int, int, int, int, int]]:
    """(item, first token, tokens, sequence, offset) of each piece of the items, which come in falling order of size."""
    bins: dict[int, list[int]] = {}
    for item, b in enumerate(first_fit(sizes, capacity)):
        bins.setdefault(b, []).append(item)
    out, sequence = [], 0
    for b in sorted(bins):
        fill = sum(sizes[i] for i in bins[b])
        room = [fill] if capacity - fill <= slack else [1 << k for k in range(fill.bit_length() - 1, -1, -1) if fill >> k & 1]
        offset = 0
        for item in bins[b]:
            done = 0
            while done < sizes[item]:
                if offset == room[0]:
                    room.pop(0)
                    sequence, offset = sequence + 1, 0
                n = min(sizes[item] - done, room[0] - offset)
                out.append((item, done, n, sequence, offset))
                done, offset = done + n, offset + n
        sequence += 1
    return out


def packer(capacity: int, slack: int):
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "gid"):
            t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
            gid = t["gid"][0].as_py()
            doc, start, length, tokens, raw = (t[c].to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "raw"))
            rows = place(length, capacity, slack)
            ids = []
            for i, a, n, _, _ in rows:
                width = len(raw[i]) // length[i]
                ids.append(np.frombuffer(raw[i], f"<u{width}", n, a * width).astype("<u4").tobytes())
            columns = ([doc[r[0]] for r in rows], [start[r[0]] + r[1] for r in rows], [r[2] for r in rows], [tokens[r[0]] for r in rows], [(gid << 24) + r[3] for r in rows], [r[4] for r in rows])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(ids, pa.binary())], names=names)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, group_bytes: int = 4 << 20, seed: int = 11) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids); ids: little-endian unsigned 32-bit."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    n = max(1, -(-size // group_bytes))
    cut = docs.mapInArrow(pieces(tokenizer, capacity, end), "doc_id long, start long, length long, doc_tokens long, raw binary")
    dealt = by_group(cut.withColumn("gid", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id(), F.lit(seed)), F.lit(n))), "gid")
    return dealt.mapInArrow(packer(capacity, capacity // 32), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))
