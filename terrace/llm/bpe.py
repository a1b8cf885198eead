"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The split pattern cuts a text into pieces, each piece is encoded on its own, and a piece's ids never depend on
its neighbours; so a worker keeps the ids of pieces it has seen (bounded) and hands only new ones to the
library, as one batch. Byte-level vocabularies write each byte as one printable character; the byte table maps
those back, and an id decodes to bytes. A character may be split over ids, so bytes are joined before they are
read as UTF-8. Character offsets of a token follow from its bytes: the number of characters that begin before it.

Defined cases: null text is empty and has no ids; special-token strings are ordinary text under a rank file, as in the
encoding that it belongs to, and their own ids under a tokenizers file, as the library has it; null and repeated doc_ids
stay as they are; an empty table gives an empty one; long texts are split like others; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, worker_state

#: The pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same for texts where \p{L}, \p{N} and \s mean what Python's re makes of [^\W\d_], \d and \s.
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_ODD = re.compile("[^\t-\r -~¡-±´-¸º»¿-ʯ‐-⁞€]")
#: Pieces whose ids a worker keeps.
KEEP = 600_000
#: Characters of the longest piece that is kept, so that the cache is bounded in bytes as well.
LONGEST = 200


def byte_characters() -> dict[str, int]:
    """The printable character of each byte: itself where printable, else one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes to ids from a rank file or a tokenizers file."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    table = byte_characters()
    with open(path, encoding="utf-8") as f:
        return {bytes(table[c] for c in token): i for token, i in json.load(f)["model"]["vocab"].items()}


class Encoder:
    """One vocabulary in one worker."""

    @staticmethod
    def of_worker(path: str) -> Encoder:
        state = worker_state("bpe")
        if path not in state:
            state[path] = Encoder(path)
        return state[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.vocabulary = _vocabulary(path)
        if path.endswith(".tiktoken"):
            char = {b: c for c, b in byte_characters().items()}
            spell = lambda token: "".join(char[b] for b in token)
            self.tokenizer = Tokenizer(models.BPE({spell(t): i for t, i in self.vocabulary.items()}, [(spell(a), spell(b)) for a, b in self._merges()], ignore_merges=False))
            self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        else:
            self.tokenizer = Tokenizer.from_file(path)
        # a tokenizers file names strings that are one token wherever they stand; a rank file has none
        self.special = {t.content: np.array([i], "<u4").tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.bytes_of = {i: t for t, i in self.vocabulary.items()}
        self.seen: dict[str, bytes] = {**self.special}
        self.exact = regex.compile(PATTERN)

    def _merges(self) -> list[tuple[bytes, bytes]]:
        """The merge that makes each token: the last one when lower ranks alone are applied to its bytes."""
        made = []
        for token, rank in sorted(self.vocabulary.items(), key=lambda x: x[1]):
            if len(token) == 1:
                continue
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                ranks = [self.vocabulary.get(a + b, rank) for a, b in zip(parts, parts[1:], strict=False)]
                low = min(ranks)
                if low >= rank:
                    break
                i = ranks.index(low)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 2:
                made.append((parts[0], parts[1]))
        return made

    def split(self, text: str) -> list[str]:
        if self.cut and self.cut.search(text):
            out, at = [], 0
            for m in self.cut.finditer(text):
                out += [*self.pieces(text[at : m.start()]), m[0]]
                at = m.end()
            return out + self.pieces(text[at:])
        return self.pieces(text)

    def pieces(self, text: str) -> list[str]:
        return (self.exact if _ODD.search(text) else _PLAIN).findall(text)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        for at in range(0, len(texts), 1000):
            split = [self.split(x) if x else [] for x in texts[at : at + 1000]]
            new = list(set().union(*split).difference(self.seen))
            if len(self.seen) + len(new) > KEEP:
                self.seen = {**self.special}
                new = list(set().union(*split).difference(self.seen))
            for lo in range(0, len(new), 20_000):
                part = new[lo : lo + 20_000]
                for piece, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    self.seen[piece] = np.array(e.ids, "<u4").tobytes()
            for pieces in split:
                yield b"".join(map(self.seen.__getitem__, pieces))
            for piece in new:
                if len(piece) > LONGEST:
                    del self.seen[piece]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> list[tuple[int, int]]:
        """(start, end) of each token in characters; a token inside a character spans that character."""
        out, at = [], 0
        for i in np.frombuffer(ids, "<u4").tolist():
            token = self.bytes_of[i]
            begins = sum(b & 0xC0 != 0x80 for b in token)
            inside = token[0] & 0xC0 == 0x80
            out.append((at - 1 if inside else at, at + begins))
            at += begins
        return out


def _encode(path: str, with_ids: bool, with_offsets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_worker(path)
        for b in batches:
            n, digest, back, ids_out, spans = [], [], [], [], []
            for ids in encoder.encode(b.column("text").to_pylist()):
                n.append(len(ids) // 4)
                digest.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                if with_ids:
                    ids_out.append(np.frombuffer(ids, "<u4").astype(np.int32))
                if with_offsets:
                    spans.append([{"start": s, "end": e} for s, e in encoder.offsets(ids)])
            out = {"doc_id": (b.column("doc_id"), pa.int64()), "n_tokens": (n, pa.int64()), "ids_sha256": (digest, pa.string()), "decoded_sha256": (back, pa.string())}
            if with_ids:
                out["ids"] = (ids_out, pa.list_(pa.int32()))
            if with_offsets:
                out["offsets"] = (spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield batch(out)

    return run


def encode(docs: DataFrame, path: str, with_ids: bool = False, with_offsets: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, offsets]) of ``docs(doc_id, text)``."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", offsets array<struct<start int, end int>>" * with_offsets
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encode(path, with_ids, with_offsets), schema)


def decode(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of ``ids(doc_id, ids array<int>)``; bytes that are no UTF-8 become U+FFFD, null ids null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_worker(path)
        for b in batches:
            texts = [None if x is None else encoder.decode(np.array(x, "<u4").tobytes()).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield batch({"doc_id": (b.column("doc_id"), pa.int64()), "text": (texts, pa.string())})

    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
