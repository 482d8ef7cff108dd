"""Token counts of whole texts by a public tokenizer, from Arrow batches."""

from __future__ import annotations

import hashlib
import base64
import json
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: A vocabulary file is sent to the executors; a larger one is refused.
MAX_FILE = 64 << 20
#: Bytes of new text handed to the tokenizer at a time.
BATCH_BYTES = 256 << 10
#: Texts of more bytes are cut at safe boundaries.
LONG_TEXT = 64 << 10
#: Counts of pieces remembered by a worker; when full, it starts anew.
MEMORY = 400_000
#: Pieces of more bytes are not remembered.
MEMORY_PIECE = 64

#: Splits text before the merges of rank files: a fixed value of those vocabularies.
RANK_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _drops_space(config: dict) -> bool:
    """Whether the pre-tokenizer keeps runs without white space only, so that no token spans any."""
    steps = config.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    first = steps[0] if steps else {}
    pattern = (first.get("pattern") or {}).get("Regex", "")
    inner = all(not (t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"])) for t in config.get("added_tokens", []))
    return inner and first.get("type") == "Split" and bool(first.get("invert")) and first.get("behavior") == "Removed" and r"[^\s" in pattern and " ?" not in pattern and r"|\s" not in pattern


class Counter:
    """Counts tokens by the library that a vocabulary file belongs to, told by the file's name.

    Safe boundaries. Where the tokenizer drops white space, ASCII white space ends every
    token, and a text's count is the sum over its words. For rank files and byte-level
    files, a boundary is a space between two ASCII letters: their pattern always
    breaks there. Elsewhere a text stays whole.
    """

    def __init__(self, name: str, data: bytes):
        self.known: dict[bytes, int] = {}
        self.by_word, self.cut = False, None
        if name.endswith(".json"):
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            t = Tokenizer.from_str(data.decode())
            t.no_truncation()
            t.no_padding()
            config = json.loads(data)
            self.by_word = _drops_space(config)
            if not self.by_word and (config.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not config.get("normalizer"):
                self.cut = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
            encode = getattr(t, "encode_batch_fast", t.encode_batch)
            self.lengths: Callable[[list[str]], list[int]] = lambda texts: [len(e) for e in encode(texts, add_special_tokens=False)]
        elif name.endswith(".tiktoken"):
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
            t = tiktoken.Encoding("ranks", pat_str=RANK_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.cut = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
            self.lengths = lambda texts: [len(t.encode_ordinary(x)) for x in texts]
        elif name.endswith(".model"):
            import sentencepiece

            t = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.lengths = lambda texts: [len(x) for x in t.encode(texts, num_threads=1)]
        else:
            raise ValueError(f"no library for {name}")

    def pieces(self, text: bytes) -> list[bytes]:
        if self.by_word:
            return text.split()
        if self.cut is None or len(text) <= LONG_TEXT:
            return [text]
        whole = text.decode()
        out, start = [], 0
        for m in self.cut.finditer(whole):
            if m.start() - start >= LONG_TEXT // 4:
                out.append(whole[start : m.start()].encode())
                start = m.start()
        return [*out, whole[start:].encode()]

    def _learn(self, new: list[bytes], counts: dict[bytes, int]) -> None:
        """Encodes the pieces in batches of about equal bytes."""
        new = sorted(new, key=len)
        at = 0
        while at < len(new):
            end, size = at, 0
            while end < len(new) and (size < BATCH_BYTES or end == at):
                size += len(new[end]) + 16
                end += 1
            counts.update(zip(new[at:end], self.lengths([x.decode() for x in new[at:end]])))
            at = end

    def __call__(self, texts: list[bytes]) -> list[int]:
        """Counts of the texts, taken in groups of about equal bytes."""
        out: list[int] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size < BATCH_BYTES or end == at):
                size += len(texts[end])
                end += 1
            split = [self.pieces(t) for t in texts[at:end]]
            if len(self.known) > MEMORY:
                self.known = {}
            known = self.known
            new = {p for ps in split for p in ps if p not in known}
            if new:
                self._learn(list(new), known)
            get = known.__getitem__
            out += [sum(map(get, ps)) for ps in split]
            for p in new:
                if len(p) > MEMORY_PIECE:
                    del known[p]
            at = end
        return out


_made: dict[tuple[str, bytes], Counter] = {}


def token_count(spark: SparkSession, text: Column, path: str) -> Column:
    """Tokens of each whole text as a long, without begin, end or added special tokens.

    path is a vocabulary file that the driver can read; its bytes are broadcast, their
    size being checked. A null text counts as empty; an empty text has 0 tokens. Special
    strings inside a text are treated as the library does by default.
    """
    with open(path, "rb") as f:
        data = f.read(MAX_FILE + 1)
    if len(data) > MAX_FILE:
        raise ValueError(f"{path} has more than {MAX_FILE} bytes")
    name, held = os.path.basename(path), spark.sparkContext.broadcast(data)

    @F.pandas_udf("long")
    def count_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = (name, hashlib.sha256(held.value).digest())
        if key not in _made:
            _made[key] = Counter(name, held.value)
        for texts in batches:
            yield pd.Series(_made[key]([(t or "").encode() for t in texts]), dtype="int64")

    return count_tokens(text)
