"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids (closed by an end id) are cut into full windows; the rest of each
document is one item shorter than a window. Items are packed in blocks. Every item starts
as a partial partition over the k windows (itself in one, the others empty); the two
partitions with the largest imbalance are merged again and again, largest load against
smallest, until one partition is left whose windows are nearly equal. If a window then
exceeds the capacity, the block is packed again with more windows.

A task packs the rows of its own input split in blocks of at most ``BLOCK`` items, so
there is no shuffle, memory is bounded by one Arrow batch plus one block, and a task run
again after a lost executor gives the same rows with the same sequence ids.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cosignal.llm.common import column

CAPACITY = 4096
END_ID = 2
BLOCK = 512             # items packed together
CACHE_WORDS = 1_000_000  # words whose ids a task remembers
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, doc_row long"


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window (0..k-1) of every item, by largest-differencing over ``k`` windows.

    A partial partition keeps only its non-empty windows, as loads in falling order and
    the node each window has in a merge tree; the rest of the k windows are empty.
    """
    n = len(sizes)
    child = np.full((2 * n, 2), -1, np.int64)      # merge tree over windows
    nodes = n
    order = np.argsort(-sizes, kind="stable")
    heap = [(-int(sizes[i]), j, sizes[i:i + 1], np.array([i])) for j, i in enumerate(order)]
    heapq.heapify(heap)
    ticket = n
    while len(heap) > 1:
        _, _, load_a, node_a = heapq.heappop(heap)
        _, _, load_b, node_b = heapq.heappop(heap)
        both = max(0, len(load_a) + len(load_b) - k)   # windows filled by both sides
        load, node = np.concatenate([load_a, load_b]), np.concatenate([node_a, node_b])
        if both:
            # The smallest loads of a meet the largest that remain of b, in reverse.
            at, to = len(load_a) - both, len(load_b) - both
            if to >= both:
                pairs_a = np.arange(len(load_a) - 1, at - 1, -1)
                pairs_b = len(load_a) + np.arange(to, len(load_b))
            else:
                pairs_a = np.arange(at, len(load_a))
                pairs_b = len(load_a) + np.arange(len(load_b) - 1, to - 1, -1)
            merged = np.arange(nodes, nodes + both)
            child[merged, 0], child[merged, 1] = node[pairs_a], node[pairs_b]
            nodes += both
            load[pairs_a] += load[pairs_b]
            node[pairs_a] = merged
            left = np.ones(len(load), bool)
            left[pairs_b] = False
            load, node = load[left], node[left]
        order = np.argsort(-load, kind="stable")
        load, node = load[order], node[order]
        gap = int(load[0]) - (int(load[-1]) if len(load) == k else 0)
        heapq.heappush(heap, (-gap, ticket, load, node))
        ticket += 1
    window = np.empty(nodes, np.int64)
    final = heap[0][3]
    window[final] = np.arange(len(final))
    for parent in range(nodes - 1, n - 1, -1):
        window[child[parent]] = window[parent]
    return window[:n]


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Window of every item so that no window holds more than ``capacity``; starts at the
    smallest count that could do and raises it while a window is too full."""
    if not len(sizes):
        return np.empty(0, np.int64)
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = differencing(sizes, k)
        over = np.bincount(found, sizes, minlength=k).max() - capacity
        if over <= 0:
            return found
        k = max(k + 1, int(k * (1 + 0.5 * over / capacity)))


# Text handling under which a word of letters, alone or before one mark, is known to reach
# the merges as it is: NFC, lower case, letters split from marks, byte symbols.
PLAIN_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
MARKS = frozenset(".,;:!?")
ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")  # the same on printable ASCII
CLOSE = "\x01"      # stands for the end of a word in the merge ranks


def has_plain_words(rules: dict) -> bool:
    steps = ((rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])
    return ([n.get("type") for n in (rules.get("normalizer") or {}).get("normalizers", [])]
            == PLAIN_NORMALIZERS
            and steps[0].get("pattern") == {"Regex": PLAIN_SPLIT}
            and [p.get("type") for p in steps] == ["Split", "ByteLevel"]
            and rules["model"].get("end_of_word_suffix") == WORD_END)


def byte_symbols() -> dict[str, int]:
    """Printable symbol of every byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others for the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_ranks(rules: dict) -> dict[bytes, int]:
    """The vocabulary as ranks for ``tiktoken``; a word's end becomes the byte ``CLOSE``.
    Ids rise in merge order after the single symbols, so an id is its own rank."""
    symbol = byte_symbols()
    special = {t["content"] for t in rules.get("added_tokens", [])}
    ranks = {}
    for token, i in rules["model"]["vocab"].items():
        if token not in special:
            end = token.endswith(WORD_END)
            raw = bytes(symbol[c] for c in (token[:-len(WORD_END)] if end else token))
            ranks[raw + CLOSE.encode() if end else raw] = i
    return ranks


class Words:
    """Ids of whole texts by a tokenizer that drops blanks and never joins words across
    them: every distinct word is encoded once, then texts are put together by word number.

    Where the vocabulary file has the plain text handling above, printable ASCII words, and
    words of letters alone or before one mark, are split and go, many at a time, through the
    same merges held as ranks; any other word is encoded by the library's full pipeline. Both give the ids of
    ``Tokenizer.encode`` (tests compare them). Calling it takes control strings as plain text;
    ``whole_texts`` gives them their own ids, as the library does by default.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        rules = json.loads(spec)
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        self.added = [t["content"].encode() for t in rules.get("added_tokens", [])]
        self.ranks = None
        if has_plain_words(rules):
            import tiktoken
            ranks = merge_ranks(rules)
            self.ranks = tiktoken.Encoding("words", pat_str=f"[^{CLOSE}]+{CLOSE}",
                                           mergeable_ranks=ranks, special_tokens={})
            self.closes = np.zeros(max(ranks.values()) + 1, bool)
            self.closes[[i for t, i in ranks.items() if t.endswith(CLOSE.encode())]] = True
        self.reset()

    def reset(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.flat = np.empty(0, np.uint32)      # ids of all known words, end to end
        self.start = np.zeros(1, np.int64)      # where each word's ids begin; then the end

    def encode(self, new: list[bytes]) -> None:
        """Append the ids of words that have no ids yet."""
        pieces: list[str] = []
        counts = np.zeros(len(new), np.int64)   # pieces of each word; 0: encode it whole
        for i, raw in enumerate(new):
            if self.ranks is None:
                continue
            w = raw.decode("utf-8", "replace")
            if not w.isascii() and ("\u03a3" in w or not unicodedata.is_normalized("NFC", w)):
                continue
            w = w.lower()
            if w.isalpha():
                pieces.append(w)
                counts[i] = 1
            elif w[-1] in MARKS and w[:-1].isalpha():
                pieces += w[:-1], w[-1]
                counts[i] = 2
            elif w.isascii() and w.isprintable():
                parts = ASCII_SPLIT.findall(w)
                pieces += parts
                counts[i] = len(parts)
        sizes = np.zeros(len(new), np.int64)
        plain = counts > 0
        ids = np.empty(0, np.uint32)
        if pieces:
            ids = np.array(self.ranks.encode_ordinary(CLOSE.join(pieces) + CLOSE), np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            assert len(ends) == len(pieces)
            last = ends[np.cumsum(counts[plain]) - 1]
            sizes[plain] = np.diff(last, prepend=0)
        whole = [i for i in np.flatnonzero(~plain)]
        others = self.tokenizer.encode_batch([new[i].decode("utf-8", "replace") for i in whole],
                                             add_special_tokens=False) if whole else []
        sizes[whole] = [len(e.ids) for e in others]
        stop = np.cumsum(sizes)
        flat = np.empty(int(stop[-1]) if len(stop) else 0, np.uint32)
        from_ranks = np.repeat(plain, sizes)
        flat[from_ranks] = ids
        flat[~from_ranks] = np.array([t for e in others for t in e.ids], np.uint32)
        base = self.start[-1]
        self.flat = np.concatenate([self.flat, flat])
        self.start = np.concatenate([self.start, base + stop])

    def __call__(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """The ids (uint32) of each text."""
        for at in range(0, len(texts), 512):
            if len(self.number) > CACHE_WORDS:
                self.reset()
            known = len(self.number)
            numbers = []
            for text in texts[at:at + 512]:
                words = (text or b"").split() if self.ranks is None else (text or b"").lower().split()
                numbers.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
            if len(self.number) > known:
                self.encode(list(islice(self.number, known, None)))
            for n in numbers:
                size = self.start[n + 1] - self.start[n]
                ends = np.cumsum(size)
                total = int(ends[-1]) if len(ends) else 0
                yield self.flat[np.repeat(self.start[n] - (ends - size), size) + np.arange(total)]

    def whole_texts(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """The ids (uint32) of each text by the library's defaults: a text that holds an
        added token is encoded as it stands, where the token is a single id."""
        held = [t is not None and any(a in t for a in self.added) for t in texts]
        for text, whole, ids in zip(texts, held, self([None if h else t for t, h in zip(texts, held)])):
            if whole:
                self.tokenizer.encode_special_tokens = False
                ids = np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
                self.tokenizer.encode_special_tokens = True
            yield ids


def pack(docs: DataFrame, tokenizer_path: str, carry: list[str] = ("doc_id",), text: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """One row per piece: struct ``doc`` with the ``carry`` columns, then ``PIECES``.

    ``tokenizer_path`` names a vocabulary file that is read on the driver and travels with
    the job; its tokenizer must treat blank-separated words independently. Null, empty and
    blank texts are one piece holding only the end id; repeated rows are packed each on
    their own; an empty table gives no rows; ``doc`` keeps carried columns apart from the
    piece's columns whatever their names. ``sequence_id`` is unique over the result
    (input split number in the high bits) and not dense. ``doc_row``, unique in the same way,
    numbers the input rows, so pieces of rows with equal ids (copies) can be told apart; the
    input's order is kept: full pieces as they come, the others by blocks.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    given = docs.select(F.struct(*[docs[c] for c in carry]).alias("doc"),
                        column(docs, text, "string").cast("binary").alias("_text"))
    schema = T.StructType([given.schema["doc"]])
    for field in PIECES.split(", "):
        schema.add(*field.split())
    tail = np.array([end_id], "<u4").tobytes()
    names = [f.split()[0] for f in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Words(spec)
        next_id = TaskContext.get().partitionId() << 40
        first_row = next_id          # of the batch
        docs_held: list[pa.Array] = []
        items: list[tuple] = []      # (row in the block's docs, start, length, crc, tokens, doc_row)
        rows_held = 0

        def out(doc, rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [doc, *(pa.array(c, pa.int64()) for c in cols)], names=["doc", *names])

        def close():
            nonlocal next_id, rows_held
            doc = pa.concat_arrays(docs_held)
            sizes = np.array([i[2] for i in items], np.int64)
            window = windows(sizes, capacity)
            order = np.argsort(window, kind="stable")
            before = np.cumsum(sizes[order]) - sizes[order]
            first = np.ones(len(order), bool)
            first[1:] = window[order][1:] != window[order][:-1]
            offset = before - np.maximum.accumulate(np.where(first, before, 0))
            rows = [(*items[i][1:5], next_id + int(window[i]), int(o), items[i][5]) for i, o in zip(order, offset)]
            batch = out(doc.take(pa.array([items[i][0] for i in order])), rows)
            next_id += int(window.max()) + 1
            docs_held.clear()
            items.clear()
            rows_held = 0
            return batch

        for batch in batches:
            full, at, before = [], [], len(items)
            for row, ids in enumerate(ids_of.whole_texts(batch.column("_text").to_pylist())):
                total = len(ids) + 1
                for start in range(0, total, capacity):
                    part = ids[start:start + capacity]
                    crc, length = zlib.crc32(part.astype("<u4").tobytes()), len(part)
                    if start + capacity >= total:
                        crc, length = zlib.crc32(tail, crc), length + 1
                    piece = (start, length, crc, total)
                    if piece[1] == capacity:
                        full.append((*piece, next_id, 0, first_row + row))
                        at.append(row)
                        next_id += 1
                    else:
                        items.append((rows_held + row, *piece, first_row + row))
            first_row += batch.num_rows
            if len(items) > before:          # a batch of full pieces only need not wait
                docs_held.append(batch.column("doc"))
                rows_held += batch.num_rows
            if full:
                yield out(batch.column("doc").take(pa.array(at)), full)
            if len(items) >= block:
                yield close()
        if items:
            yield close()

    return given.mapInArrow(run, schema)
