"""Packing documents into sequences whose attention cost is balanced.

A document is its token ids and a closing id 0.  Whole stretches of one sequence length are
sequences by themselves; what remains of a document is a piece.  Pieces go in descending order
of their cost (linear plus quadratic in their length) to the sequence of the lowest cost that
has room for them; a piece that fits nowhere is cut.  One sequence of a block is dissolved to
fill the gaps of the others, and what is left of it waits for the next block of the task.  At
the end of a task the rest is cut into sequences of powers of two, which need no padding.

A task tokenizes and packs its own rows in blocks of bounded size, so there is no shuffle.
Sequence ids are unique: the task's number and a counter.

Defined results: a null or empty text is the id 0 alone; repeated rows are packed each; an
empty table gives no piece; only the id and text columns are read.
"""
from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlake.llm.common import per_process, release

CAPACITY = 1024
BLOCK_TOKENS = 1 << 18
CACHED = 300_000
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

#: Fixed value: how byte-level BPE splits a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space other than blanks and line feeds, and runs of any white space.
_EXOTIC = re.compile(r"[^\S \n]|[\x01\x85]")
_RUN = re.compile(r"\s\s")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Ids(dict):
    """The ids, as little-endian 32-bit bytes, of stretches of text that never join their
    neighbours; stretches not seen yet are encoded when they are asked for."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        super().__init__()
        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items()
                 if t not in self.special and all(c in byte for c in t)}
        self.fast = tiktoken.Encoding("stretches", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, stretch: str) -> bytes:
        ids = np.array(self.fast.encode_ordinary(stretch), dtype="<u4").tobytes()
        if len(stretch) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[stretch] = ids
        return ids

    def of(self, text: str) -> bytes:
        """All ids of a text, without the closing one."""
        if _EXOTIC.search(text) or any(s in text for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if _RUN.search(text):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()
        # No two white-space characters meet, so every blank opens a word and every line feed stands alone.
        parts = text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")
        return b"".join(map(self.__getitem__, parts))


def cost(length):
    return LINEAR * length + QUADRATIC * length * length


def pack_block(rests: list[tuple[int, int, int]], capacity: int = CAPACITY, last: bool = True):
    """Pack pieces (document, start, length), each shorter than ``capacity``.

    Returns the sequences, lists of pieces, and the pieces that wait for the next block.
    """
    total = sum(r[2] for r in rests)
    n = -(-total // capacity)
    seqs: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    room, load = np.full(n, capacity, np.int64), np.zeros(n)

    def put(i: int, doc: int, start: int, length: int) -> None:
        seqs[i].append((doc, start, length))
        room[i] -= length
        load[i] += cost(length)

    for doc, start, length in sorted(rests, key=lambda r: (-r[2], r[0], r[1])):
        fits = np.where(room >= length, load, np.inf)
        i = int(fits.argmin()) if n else -1
        if fits[i] < np.inf:
            put(i, doc, start, length)
            continue
        while length:
            i = int(room.argmax())
            part = min(length, int(room[i]))
            put(i, doc, start, part)
            start, length = start + part, length - part
    # Fill the gaps from the emptiest sequence; all gaps together are under one sequence.
    waiting: list[tuple[int, int, int]] = []
    if total % capacity:
        out = int(room.argmax())
        waiting, seqs[out], room[out] = seqs[out], [], 0
        for i in np.flatnonzero(room):
            while room[i]:
                doc, start, length = waiting.pop()
                part = min(length, int(room[i]))
                put(int(i), doc, start, part)
                if part < length:
                    waiting.append((doc, start + part, length - part))
    seqs = [s for s in seqs if s]
    if not last:
        return seqs, waiting
    left = sum(w[2] for w in waiting)
    while left:
        size, seq = 1 << (left.bit_length() - 1), []
        left -= size
        while size:
            doc, start, length = waiting.pop()
            part = min(length, size)
            seq.append((doc, start, part))
            size -= part
            if part < length:
                waiting.append((doc, start + part, length - part))
        seqs.append(seq)
    return seqs, []


_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
           "sequence_cost double")


def _packer(path: str | None, capacity: int, block_tokens: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = path or default_tokenizer()
        ids = per_process(("packing", at), lambda: Ids(at))
        task, made = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36, 0
        held: dict[int, tuple] = {}
        rests: list[tuple[int, int, int]] = []
        tokens = serial = 0

        def emit(seqs) -> pa.RecordBatch:
            nonlocal made
            rows: list[tuple] = []
            for seq in seqs:
                at, total = 0, sum(cost(p[2]) for p in seq)
                for doc, start, length in seq:
                    doc_id, buf = held[doc]
                    cut = buf[4 * start:4 * (start + length)]
                    rows.append((doc_id, start, length, zlib.crc32(cut), len(buf) // 4, task + made, at, total)
                                + ((cut,) if with_ids else ()))
                    at += length
                made += 1
            cols = list(zip(*rows, strict=True)) or [()] * (8 + with_ids)
            kinds = [pa.int64()] * 7 + [pa.float64()] + [pa.binary()] * with_ids
            names = [c.split()[0] for c in _SCHEMA.split(", ")] + ["ids"] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        full: list[list[tuple[int, int, int]]] = []

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal rests, tokens, full, held
            seqs, rests = pack_block(rests, capacity, last)
            out = emit(full + seqs)
            full, tokens = [], 0
            held = {d: held[d] for d in {r[0] for r in rests}}
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                buf = ids.of(text or "") + b"\0\0\0\0"
                n = len(buf) // 4
                held[serial] = (doc_id, buf)
                full += [[(serial, s, capacity)] for s in range(0, n - capacity + 1, capacity)]
                if n % capacity:
                    rests.append((serial, n - n % capacity, n % capacity))
                serial += 1
                tokens += n
                if tokens >= block_tokens:
                    yield flush(False)
        yield flush(True)
        release()
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids themselves as little-endian 32-bit bytes."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_packer(tokenizer, capacity, block_tokens, with_ids),
                           _SCHEMA + (", ids binary" if with_ids else ""))
