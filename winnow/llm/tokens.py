"""Token ids of whole texts by public tokenizer files.

The file is a parameter: `.json` files belong to `tokenizers`, `.model` files to
`sentencepiece`, `.tiktoken` files to `tiktoken`. Nothing here trains or copies
a vocabulary. A byte-level `.json` file whose merges are numbered in order is
run by `tiktoken`, which gives the same ids several times faster; an encoder
that would differ on a set of probe texts is never used.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from winnow.sources.packages import ship

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed value: the pre-tokenizer's pattern of byte-level files.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PROBES = ["", " ", "a  b\n\n c \t", "don't it's 5½ x_y 12ab", "\xa0 a　 b́ 你好 \U0001f600", "<|endoftext|> <|endoftext|>\n", "ZÄÖ!!! ###$   q"]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabulary file of that name is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def file_digest(path: str) -> str:
    """SHA-256 of a tokenizer file: the version under which counts are stored."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _printable_bytes() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + n): b for n, b in enumerate(rest)}


def _as_tiktoken(path: str):
    """The same encoder run by tiktoken, or None if the file isn't of that kind."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if not plain or spec.get("normalizer") or model.get("ignore_merges") or model.get("byte_fallback"):
        return None
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    of = _printable_bytes()
    try:
        ranks = {bytes(of[c] for c in token): n for token, n in model["vocab"].items() if token not in added}
    except KeyError:
        return None
    return tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=added)


class Encoder:
    """Ids of texts as arrays of unsigned 32-bit numbers, no special tokens added."""

    def __init__(self, path: str):
        self._fast = self._plain = None
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self._plain = lambda texts: [np.array(x, dtype=np.uint32) for x in pieces.encode(texts, num_threads=1)]
        elif path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            self._plain = lambda texts: [np.array(e.ids, dtype=np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            if (fast := _as_tiktoken(path)) and all(np.array_equal(a, fast.encode_to_numpy(t, allowed_special="all")) for t, a in zip(_PROBES, self._plain(_PROBES), strict=True)):
                self._fast, self._plain = fast, None

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; None counts as empty."""
        texts = [t or "" for t in texts]
        if self._fast:
            return [self._fast.encode_to_numpy(t, allowed_special="all") for t in texts]
        return self._plain(texts)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker process's encoder for a file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def counted(df: DataFrame, text: str, name: str, path: str) -> DataFrame:
    """df with the number of tokens of each text (null: none) as `name` in place of the text."""
    ship(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[int] = []
            for i in range(0, batch.num_rows, 256):
                found += map(len, encoder(path).encode(batch.column(at).slice(i, 256).to_pylist()))
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array(found, dtype=np.int64))], names=[*(n for n in batch.schema.names if n != text), name])

    return df.mapInArrow(run, StructType([*(f for f in df.schema.fields if f.name != text), StructField(name, LongType())]))
