"""Token counts of the sections of documents, from one encoding of the whole document.

A document is encoded whole, since a section encoded by itself gives other tokens at its
borders.  The vocabulary is byte-level: the ids' byte lengths, added up, give the bytes each
token covers, and with them its characters.  The tokens' spans are joined with the
sections' spans (both sorted, so by binary search).  A token that reaches over a
border is allocated by one rule: to the section that holds most of its
characters, the earlier one on ties.  The counts of a document's sections therefore add up to
the document's tokens.

Sections are lines, each with the line feed that ends it, so they cover the text.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import link_map, require, text_or_empty


class ByteEncoder:
    """Ids and byte lengths of a byte-level vocabulary of ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def byte_ends(self, text: str) -> np.ndarray:
        """Where each token of the text ends, in bytes."""
        return np.cumsum(self.lengths[self.encoding.encode_ordinary(text)])


def character_spans(octets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of tokens, given the text's bytes and the tokens' byte ends.

    A token that holds part of a character's bytes covers that character.
    """
    begins = np.concatenate(([0], ends[:-1]))
    number = np.cumsum((octets & 0xC0) != 0x80) - 1  # of the character each byte belongs to
    return number[begins], number[ends - 1] + 1


def allocate(first: np.ndarray, end: np.ndarray, starts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """For each section its tokens, and how many tokens reach over one of its borders.

    Tokens are spans ``first:end``; section i reaches from ``starts[i]`` to the next start, the last to ``total``.
    """
    low = np.searchsorted(starts, first, side="right") - 1
    high = np.searchsorted(starts, end - 1, side="right") - 1
    owner = low.copy()
    shared = np.zeros(len(starts), np.int64)
    ends = np.append(starts[1:], total)
    for token in np.flatnonzero(low != high).tolist():
        sections = np.arange(low[token], high[token] + 1)
        inside = np.minimum(ends[sections], end[token]) - np.maximum(starts[sections], first[token])
        owner[token] = sections[int(np.argmax(inside))]  # the first of equals
        shared[sections] += 1
    return np.bincount(owner, minlength=len(starts)), shared


def section_token_counts(
    docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, section, start, end, n_tokens, n_shared`` for every line of every text.

    ``start`` and ``end`` count characters, ``n_shared`` the tokens that also reach into another
    section.  Null and empty texts have one empty section without tokens.  Null and
    repeated keys come out as they are; each row is counted by itself.  Other columns are not looked at; an
    empty table gives an empty result.  ``ranks`` is a path all executors can open, ``pattern`` the vocabulary's own.
    """
    require(docs, key, text)
    encoder: list[ByteEncoder] = []
    names = ("key", "section", "start", "end", "n_tokens", "n_shared")

    def run(batch):
        if not encoder:
            encoder.append(ByteEncoder(ranks, pattern))
        out: dict[str, list] = {name: [] for name in names}
        for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            octets = np.frombuffer(t.encode(), np.uint8)
            breaks = np.flatnonzero(octets == 10)
            if len(octets):
                first, end = character_spans(octets, encoder[0].byte_ends(t))
                number = np.cumsum((octets & 0xC0) != 0x80)
                starts = np.concatenate(([0], number[breaks]))
                starts = starts[: len(starts) - (len(starts) > 1 and starts[-1] == len(t))]
            else:
                first = end = np.zeros(0, np.int64)
                starts = np.zeros(1, np.int64)
            own, shared = allocate(first, end, starts, len(t))
            out["key"] += [k] * len(starts)
            out["section"] += range(len(starts))
            out["start"] += starts.tolist()
            out["end"] += [*starts[1:].tolist(), len(t)]
            out["n_tokens"] += own.tolist()
            out["n_shared"] += shared.tolist()
        return out

    kind = docs.schema[key].dataType.simpleString()
    counted = link_map(
        docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")),
        run,
        f"key {kind}, section int, start bigint, end bigint, n_tokens bigint, n_shared bigint",
    )
    return counted.withColumnRenamed("key", key)
