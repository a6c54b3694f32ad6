"""Token counts by a whole-token shortcut.

Offline proof: a vocabulary string that the library itself encodes, alone, as one token is a whole token. A byte-level
BPE never merges across pre-tokens, so a pre-token that is such a string counts 1 without any merging; only the other
pre-tokens are merged, by the same vocabulary in the order of its ids (which is its merge order) and each distinct one
once per task while the memo lasts.

The pre-token pattern is the public one of the vocabulary. Its classes are the same in every Unicode version for code
points below U+0250; texts with others, or with a special token's string, are given to the library whole.

Null or empty text has 0 bytes and 0 tokens; repeated rows give one result row each.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import id_and_text, mapped, slices, table

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
MEMO = 300_000
WORD = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch
OTHER = re.compile("[^\x00-ɏ]")


def plain_pattern(below: int = 0x250) -> re.Pattern[str]:
    """The vocabulary's pre-token pattern for code points under ``below``, with its classes spelled out.

    Alternatives that cannot begin at the same place are put in the order of their frequency.
    """
    chars = [chr(c) for c in range(below)]
    letters, numbers = ("".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == k) for k in "LN")
    space = r"\t-\r \x85\xa0"
    return re.compile(f" ?[{letters}]+| ?[{numbers}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


class Counter:
    """Counts of whole texts, equal to ``len(tokenizer.encode(text, add_special_tokens=False))``."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.split = plain_pattern().findall
        vocab = {t: i for t, i in self.library.get_vocab(with_added_tokens=False).items() if i not in self.library.get_added_tokens_decoder()}
        letters = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        self.merges = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.token_bytes[list(ranks.values())] = [len(t) for t in ranks]
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.whole = dict.fromkeys(self.prove(), 1)
        self.memo = dict(self.whole)

    def prove(self) -> list[str]:
        """Vocabulary strings that are one pre-token and that the library encodes alone as one token."""
        texts = {self.library.decode([i], skip_special_tokens=False) for i in range(self.library.get_vocab_size())}
        texts = [t for t in texts if t and not OTHER.search(t) and t not in self.special and self.split(t) == [t]]
        return [t for t, e in zip(texts, self.library.encode_batch(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1]

    def merge(self, pieces: list[str]) -> None:
        """Counts of pre-tokens that are no whole token, into the memo.

        Words are merged many to a call: laid end to end (behind a space) or line by line (bare) they split into the
        same pre-tokens again. Tokens are told apart by where the words' bytes end.
        """
        words = [p for p in pieces if WORD(p)]
        for group, end in (([p for p in words if p[0] == " "], ""), ([p for p in words if p[0] != " "], "\n")):
            if group:
                ids = self.merges.encode_to_numpy(end.join(group), disallowed_special=())
                ends = np.cumsum([len(p.encode()) + len(end) for p in group])
                at = np.searchsorted(np.cumsum(self.token_bytes[ids]), ends - len(end), side="right")
                self.memo.update(zip(group, (np.diff(at, prepend=-len(end)) - len(end)).tolist(), strict=True))
        rest = [p for p in pieces if not WORD(p)]
        self.memo.update((p, len(self.merges.encode_ordinary(p))) for p in rest)

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.memo) > len(self.whole) + MEMO:
            self.memo = dict(self.whole)
        out: list[int] = [0] * len(texts)
        pieces: dict[int, list[str]] = {}
        for i, t in enumerate(texts):
            if OTHER.search(t) or any(s in t for s in self.special):
                out[i] = len(self.library.encode(t, add_special_tokens=False).ids)
            elif t:
                pieces[i] = self.split(t)
        if new := set().union(*pieces.values()).difference(self.memo):
            self.merge(list(new))
        for i, p in pieces.items():
            out[i] = sum(map(self.memo.__getitem__, p))
        return out


def count(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of every whole text. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in slices(batches, limit=1 << 20):
            counter = counter or Counter(path)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counter.counts(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return mapped(id_and_text(docs, id_col, text_col), run, "doc_id long, n_bytes long, n_tokens long")


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)).selectExpr("*", f"n_tokens > {LIMIT} AS over_limit")
