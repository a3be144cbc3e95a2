"""SentencePiece encoding and decoding with a streaming Viterbi search.

The search goes through the positions of a text once.  For every position it keeps
the backpointers of the paths (segmentations into pieces) that survive there;
it needs the positions of a window no longer than the longest piece.  As soon as all
surviving paths converge on one boundary, the ids before it are committed and
the window starts anew at the boundary, so the memory does not grow with the text.

Which paths survive depends on the model.  The scores of a BPE model are merge
priorities, not probabilities: the path with the largest sum of scores is in general not
what the model encodes.  A segmentation is the model's own just when every piece of it
encodes to itself and every two neighbours, joined, encode to these two.  A path
survives if it keeps this rule; exactly one path to a position does, the encoding of the
text up to there, so ids equal the library's.  Whether two pieces may stand side
by side is remembered.

No piece holds a gap mark behind anything but gap marks, so all paths converge before every
word.  Words that repeat are looked up; the search runs on new words, and on runs without
gaps however long they are.

Text is taken as it is, with one gap mark put in front, as the model's own settings have it;
characters outside the vocabulary become bytes.  Decoding gives back every text
that holds no gap mark (U+2581) of its own; that mark comes back as a space.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import link_map, per_worker, require, text_or_empty

GAP = "▁"
# Words and neighbours remembered by a worker; beyond that it forgets all and starts again.
WORDS = 1_000_000
NEIGHBOURS = 2_000_000
# Words longer than this are searched each time instead of being remembered.
LONG_WORD = 64
_WORD = re.compile(f"{GAP}*[^{GAP}]+|{GAP}+")


@dataclass
class Vocabulary:
    """Pieces by id and by text, their merge order (small: early), and the ids of the bytes."""

    ids: dict[str, int]
    order: dict[str, float]
    octets: list[bytes]
    byte_ids: list[int]
    longest: int
    lengths: dict[str, tuple[int, ...]]  # of the pieces with these last characters (three, or the whole piece)
    inner: frozenset[str]  # pairs of characters that stand side by side in some piece
    standing: frozenset[str]  # pieces that encode to themselves

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, order, octets, byte_ids = {}, {}, [], [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                byte_ids[value] = i
                octets.append(bytes([value]))
            elif model.is_control(i) or model.is_unused(i) or model.is_unknown(i):
                octets.append(b"")
            else:
                ids[piece] = i
                order[piece] = -model.get_score(i)
                octets.append(piece.replace(GAP, " ").encode())
        lengths: dict[str, set[int]] = {}
        for piece in ids:
            lengths.setdefault(piece[-3:], set()).add(len(piece))
        standing = frozenset(piece for piece in ids if merged(piece, order) == [piece])
        inner = frozenset(piece[i : i + 2] for piece in ids for i in range(len(piece) - 1))
        return cls(
            ids, order, octets, byte_ids, max(map(len, ids)), {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}, inner, standing
        )


def merged(text: str, order: dict[str, float]) -> list[str]:
    """Pieces of a short text by merging: the neighbours with the earliest merge first, the left ones on ties."""
    parts = list(text)
    rank = order.get
    while len(parts) > 1:
        best, at = None, 0
        for i in range(len(parts) - 1):
            found = rank(parts[i] + parts[i + 1])
            if found is not None and (best is None or found < best):
                best, at = found, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Codec:
    """Encodes and decodes texts; what it remembers does not change results."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.neighbours: dict[tuple[str, str], bool] = {}
        self.beginnings: dict[str, list[str | None]] = {}
        self.words: dict[str, list[int]] = {}
        self.parts: dict[str, list[int]] = {}

    def _side_by_side(self, left: str, right: str) -> bool:
        """Whether two neighbours, joined, encode to these two; remembered."""
        if len(self.neighbours) > NEIGHBOURS:
            self.neighbours.clear()
        # A character outside the vocabulary merges with nothing.
        order = self.vocabulary.order
        found = left not in order or merged(left + right, order) == [left, right]
        self.neighbours[left, right] = found
        return found

    def search(self, text: str):
        """Pieces of a text in order, committed as soon as all surviving paths converge.

        Characters outside the vocabulary come as they are; nothing merges across them.
        """
        longest = self.vocabulary.longest
        base = 0
        # last[i]: the last piece of the surviving path to position base + i; "" where the window begins.
        last: list[str | None] = [""]
        for start in range(0, len(text), longest):
            # The pieces of the window's next positions, then what has become certain.
            upto = min(len(text), start + longest)
            for i in range(start + 1, upto + 1):
                last.append(self._survivor(text, i, base, last))
            boundary = len(last) - 1 if upto == len(text) else self._converged(last, len(last) - 1)
            if boundary:
                yield from self._back(last, boundary)
                last = last[boundary:]
                base += boundary

    def _survivor(self, text: str, i: int, base: int, last: list[str | None]) -> str | None:
        """The last piece of the one path to position ``i``, None if no path ends there."""
        vocabulary, beside = self.vocabulary, self.neighbours
        if text[i - 1] not in vocabulary.order:
            return text[i - 1]
        width = i - base
        # Longer pieces are more often right: those listed by their last three characters come first.
        for tail in range(3 if width > 2 else width, 0, -1):
            for length in vocabulary.lengths.get(text[i - tail : i], ()):
                if length > width:
                    continue
                before = last[width - length]
                if before is None:
                    continue
                piece = text[i - length : i]
                if piece in vocabulary.standing:
                    if not before:
                        return piece
                    fit = beside.get((before, piece))
                    if fit or fit is None and self._side_by_side(before, piece):
                        return piece
        return None

    def _short(self, text: str) -> list[str]:
        """The pieces of a word no longer than ``LONG_WORD``: the same search in one window.

        The survivors up to a place depend on what is before it alone, so words that begin alike share them.
        """
        known = self.beginnings
        last: list[str | None] = [""]
        first = 0
        for first in (12, 8, 5, 0):
            if first < len(text):
                found = known.get(text[:first]) if first else last
                if found is not None:
                    last = found[:]
                    break
        if len(known) > WORDS // 2:
            known.clear()
        for i in range(first + 1, len(text) + 1):
            last.append(self._survivor(text, i, 0, last))
            if i == 5 or i == 8 or i == 12:
                known[text[:i]] = last[:]
        return self._back(last, len(text))

    def _converged(self, last: list[str | None], end: int) -> int:
        """The largest boundary that all paths to the last ``longest`` positions share; 0 if there is none."""
        fronts = {p for p in range(max(1, end - self.vocabulary.longest + 1), end + 1) if last[p] is not None}
        while len(fronts) > 1:
            far = max(fronts)
            fronts.remove(far)
            fronts.add(far - len(last[far]))
        return fronts.pop() if fronts else 0

    def _back(self, last: list[str | None], end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def _ids(self, pieces) -> list[int]:
        out = []
        for piece in pieces:
            found = self.vocabulary.ids.get(piece)
            if found is None:
                out += [self.vocabulary.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
            else:
                out.append(found)
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text; none for an empty one."""
        if not text:
            return []
        words = _WORD.findall(GAP + text.replace(" ", GAP))
        known = self.words
        out: list[int] = []
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = self._word(word)
                if len(word) <= LONG_WORD:
                    if len(known) >= WORDS:
                        known.clear()
                    known[word] = ids
            out += ids
        return out

    def _pieces(self, text: str):
        return self._short(text) if len(text) <= LONG_WORD else self.search(text)

    def _word(self, word: str) -> list[int]:
        """A word's ids.  Where two characters stand side by side in no piece, all paths converge between them."""
        inner = self.vocabulary.inner
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in inner]
        if not cuts:
            return self._ids(self._pieces(word))
        out: list[int] = []
        for start, end in zip([0, *cuts], [*cuts, len(word)]):
            part = word[start:end]
            ids = self.parts.get(part)
            if ids is None:
                ids = self._ids(self._pieces(part))
                if len(part) <= LONG_WORD:
                    if len(self.parts) >= WORDS:
                        self.parts.clear()
                    self.parts[part] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the gap put in front."""
        octets = self.vocabulary.octets
        text = b"".join([octets[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _codec(model: str) -> Codec:
    return per_worker(("pieces", model), lambda: Codec(Vocabulary.load(model)))


def encode_texts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids`` for every row.  A null or empty text has no ids; repeated rows are encoded each."""
    require(docs, key, text)

    def run(batch):
        codec = _codec(model)
        return {
            "key": batch.column("key"),
            "ids": pa.array([codec.encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32())),
        }

    return _mapped(docs, key, text, run, "ids array<int>")


def decode_ids(docs: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text`` for every row of ``key, ids``; null ids give an empty text."""
    require(docs, key, ids)

    def run(batch):
        codec = _codec(model)
        return {
            "key": batch.column("key"),
            "text": [codec.decode(x or []) for x in batch.column("ids").to_pylist()],
        }

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    return link_map(rows, run, f"key {kind}, text string").withColumnRenamed("key", key)


def coded(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_ids, ids_crc32, n_chars, round_trip``: both ways in one pass, for checking a corpus.

    ``ids_crc32`` is that of the ids as little-endian unsigned 32-bit numbers, ``n_chars`` the length
    of the decoded text, ``round_trip`` whether it equals the text.  Null and empty texts have no ids,
    and null counts as empty.  Repeated rows and null keys come out as they are.  Other columns are not
    looked at; an empty table gives an empty result.  ``model`` is a path all executors can open.
    """
    require(docs, key, text)

    def run(batch):
        codec = _codec(model)
        out = {"key": batch.column("key"), "n_ids": [], "ids_crc32": [], "n_chars": [], "round_trip": []}
        for t in batch.column("text").to_pylist():
            ids = codec.encode(t)
            back = codec.decode(ids)
            out["n_ids"].append(len(ids))
            out["ids_crc32"].append(zlib.crc32(np.array(ids, "<u4").tobytes()))
            out["n_chars"].append(len(back))
            out["round_trip"].append(back == t)
        return out

    return _mapped(docs, key, text, run, "n_ids bigint, ids_crc32 bigint, n_chars bigint, round_trip boolean")


def _mapped(docs: DataFrame, key: str, text: str, run, schema: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    return link_map(rows, run, f"key {kind}, {schema}").withColumnRenamed("key", key)
