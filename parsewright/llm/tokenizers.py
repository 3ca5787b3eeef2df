"""Public tokenizers by file, and problem 6: encoding by prefix dynamic programming."""

from __future__ import annotations

import base64
import os
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from parsewright.session import spread

#: Where the vocabulary files lie; every function takes another place as a parameter.
TOKENIZERS_DIR = "/opt/tokenizers"
# The pattern that parts a text for byte-level BPE, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A match depends on at most this many characters after its end (the longest contraction).
LOOK_AHEAD = 2
#: Entries after which a worker's cache of parts or pairs is emptied; it only saves time.
CACHE_ENTRIES = 400_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A vocabulary file of lines ``base64 rank``."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class PrefixBPE:
    """Byte-level BPE by dynamic programming over prefixes.

    An encoding is valid exactly if each two neighbouring tokens are what their joined bytes encode to.
    So every prefix of a byte string has one valid last token: the one that ends there, follows a
    shorter prefix and forms a valid pair with that prefix's last token. ``last_tokens`` stores it for
    every prefix; appended bytes extend the table without touching what is there.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.parts = ranks, regex.compile(pattern)
        self.suffixes = {t[i:] for t in ranks for i in range(len(t))}
        self.by_rank = {r: t for t, r in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache = _Cache(self._encode_part)

    def merged(self, data: bytes) -> list[int]:
        """The encoding of a few bytes by the merges themselves: the lowest rank first, the first of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def pair_ok(self, a: int, b: int) -> bool:
        """Whether token b can follow token a; with a = -1, whether b can stand alone."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > CACHE_ENTRIES:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.by_rank[b]) == [b] if a < 0 else self.merged(self.by_rank[a] + self.by_rank[b]) == [a, b]
        return known

    def last_tokens(self, data: bytes, table: list[int] | None = None) -> list[int]:
        """Entry i - 1: the last token of the first i bytes' encoding. ``table`` holds those of a shorter prefix and is extended."""
        table = [] if table is None else table
        for i in range(len(table) + 1, len(data) + 1):
            j, found = i - 1, None
            while j >= 0 and (piece := data[j:i]) in self.suffixes:
                token = self.ranks.get(piece)
                if token is not None and self.pair_ok(table[j - 1] if j else -1, token):
                    found = token
                    break  # there is only one
                j -= 1
            if found is None:
                raise ValueError("the vocabulary lacks a byte")
            table.append(found)
        return table

    def read_back(self, table: list[int]) -> list[int]:
        ids, i = [], len(table)
        while i:
            ids.append(table[i - 1])
            i -= len(self.by_rank[ids[-1]])
        return ids[::-1]

    def _encode_part(self, part: str) -> list[int]:
        data = part.encode()
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.read_back(self.last_tokens(data))

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``; none for an empty or null one. Strings that look like special tokens are ordinary text."""
        return list(chain.from_iterable(map(self.cache.__getitem__, self.parts.findall(text)))) if text else []


class _Cache(dict):
    def __init__(self, make: Callable[[str], list[int]]):
        super().__init__()
        self.make = make

    def __missing__(self, part: str) -> list[int]:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        ids = self.make(part)
        if len(part) <= 64:
            self[part] = ids
        return ids


class EncodedText:
    """A text kept with its encoding, for appends and edits that redo only what they touch.

    Each part (what the pattern matches) has its text, its table of last tokens and its place.
    """

    def __init__(self, bpe: PrefixBPE, text: str = ""):
        self.bpe, self.text = bpe, ""
        self.starts: list[int] = []
        self.tables: list[list[int]] = []
        self.append(text)

    @property
    def ids(self) -> list[int]:
        return [i for t in self.tables for i in self.bpe.read_back(t)]

    def append(self, more: str) -> None:
        """Put ``more`` at the end. Only parts that the old end could have shaped are matched again;
        a part that merely grows keeps its table, which is extended."""
        old_n = len(self.text)
        self.text += more
        k = len(self.starts)
        while k and (self.starts[k] if k < len(self.starts) else old_n) > old_n - LOOK_AHEAD - 1:
            k -= 1
        redo, tables = self.starts[k:], self.tables[k:]
        at = redo[0] if redo else 0
        old = {s: (e, t) for s, e, t in zip(redo, [*redo[1:], old_n], tables)}
        del self.starts[k:], self.tables[k:]
        for m in self.bpe.parts.finditer(self.text, at):
            data = m.group().encode()
            known = old.get(m.start())
            table = known[1] if known and known[0] <= m.end() else []
            self.starts.append(m.start())
            self.tables.append(self.bpe.last_tokens(data, table))

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace ``text[start:end]``; returns how many parts were matched again. Matching goes on from
        before the edit until it meets an old part's start behind the edit."""
        tail_shift = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        k = max(0, bisect_left(self.starts, start - LOOK_AHEAD) - 1)
        starts, tables, redone, at = self.starts[:k], self.tables[:k], 0, self.starts[k] if k < len(self.starts) else 0
        while at < len(text):
            i = bisect_left(self.starts, max(end, at - tail_shift))
            if at >= start + len(new) and i < len(self.starts) and self.starts[i] == at - tail_shift:
                starts += [s + tail_shift for s in self.starts[i:]]
                tables += self.tables[i:]
                break
            m = self.bpe.parts.match(text, at)
            starts.append(at)
            tables.append(self.bpe.last_tokens(m.group().encode()))
            redone, at = redone + 1, m.end()
        self.text, self.starts, self.tables = text, starts, tables
        return redone


def tokenizer_file(name: str, folder: str = TOKENIZERS_DIR) -> tuple[str, bytes]:
    """File name and content of a public tokenizer, by its name with or without an ending."""
    for ending in ("", ".tiktoken", ".model", ".json"):
        path = os.path.join(folder, os.path.basename(name) + ending)
        if os.path.isfile(path):
            with open(path, "rb") as f:
                return os.path.basename(path), f.read()
    raise FileNotFoundError(f"no tokenizer {name} in {folder}")


@lru_cache(maxsize=4)
def _prefix_bpe(data: bytes) -> PrefixBPE:
    return PrefixBPE(read_ranks(data))


def counter(name: str, data: bytes) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens, without special tokens."""
    if name.endswith(".tiktoken"):
        import tiktoken

        own = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=read_ranks(data), special_tokens={})
        return lambda texts: [len(own.encode_ordinary(t)) for t in texts]
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)] if texts else []
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    model = Tokenizer.from_str(data.decode())
    model.encode_special_tokens = True
    return lambda texts: [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS_DIR) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of each row, by a byte-level BPE vocabulary.

    Null and empty texts give an empty list, blank ones are encoded like any other. Rows come out as
    often as they come in, null ids too; other columns play no part. A map over rows: no shuffle. The
    vocabulary file (under 2 MB) is read by the driver and broadcast, so workers need no path to it.
    """
    name, data = tokenizer_file(tokenizer, folder)
    if not name.endswith(".tiktoken"):
        raise ValueError("prefix encoding needs a byte-level vocabulary with ranks")
    shared = df.sparkSession.sparkContext.broadcast(data)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _prefix_bpe(shared.value)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
