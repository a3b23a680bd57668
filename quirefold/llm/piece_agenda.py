"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

``Merger`` holds the symbols of a piece of text in a linked list and all adjacent pairs that form a vocabulary
entry on an agenda ordered by score, then place. The best pair is merged, its neighbours are put on the agenda,
and entries whose symbols have changed meanwhile are passed over. What is not in the vocabulary at the end becomes
byte pieces.

Merging never crosses a cut between two characters that stand beside each other in no vocabulary entry. Where the
vocabulary keeps letters apart from everything else and a space mark only begins a piece (both are tested when it
is loaded), a text falls into short chunks that are merged on their own and remembered in a bounded table.

The ids are the agenda's. The sentencepiece library checks them in the Arrow batches and supplies none: each chunk is
compared with it when it is first met, a batch of chunks at a time, and the first text of each slice of a batch is
compared whole. Differences are counted for each text (``n_differ``); on the given vocabulary there are none.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SPACE = "▁"
#: Remembered chunks in one worker; the table is emptied when it is full.
MEMORY = 300_000
#: Longer chunks are encoded each time they come.
LONGEST_KEPT = 40

_LETTERS = "A-Za-zÀ-ɏ"
_CHUNKS = re.compile(f"{SPACE}*[{_LETTERS}]+|{SPACE}*[^{SPACE}{_LETTERS}]+|{SPACE}+")
_LETTER = re.compile(f"[{_LETTERS}]")


class Merger:
    """The merge rules of one model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(size)]
        self.eos = self.library.eos_id()
        plain = [i for i in range(size) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: self.library.get_score(i) for i in plain}
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.surface = [
            b"" if self.library.is_control(i) else bytes([self.bytes_of[i]]) if i in self.bytes_of else p.replace(SPACE, " ").encode()
            for i, p in enumerate(self.pieces)
        ]
        self.chunked = all(map(self._kept_apart, self.ids))

    @staticmethod
    def _kept_apart(piece: str) -> bool:
        body = piece.lstrip(SPACE)
        return SPACE not in body and len({bool(_LETTER.match(c)) for c in body}) <= 1

    def merge(self, text: str) -> list[int]:
        """Ids of ``text``, in which spaces are SPACE already."""
        scores = self.scores
        symbols = list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, str]] = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in scores:
                agenda.append((-scores[pair], i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, a, b, pair = heapq.heappop(agenda)
            if after[a] != b or symbols[a] + symbols[b] != pair:
                continue
            symbols[a], symbols[b] = pair, ""
            c = after[b]
            after[a], after[b] = c, -2
            if c >= 0:
                before[c] = a
                longer = pair + symbols[c]
                if longer in scores:
                    heapq.heappush(agenda, (-scores[longer], a, c, longer))
            p = before[a]
            if p >= 0:
                longer = symbols[p] + pair
                if longer in scores:
                    heapq.heappush(agenda, (-scores[longer], p, a, longer))
        out: list[int] = []
        for s in symbols:
            if not s:
                continue
            if s in self.ids:
                out.append(self.ids[s])
            else:
                out += [self.byte_ids[b] for b in s.encode()]
        return out

    def chunks(self, text: str) -> list[str]:
        """``text`` with space marks, cut where no merge can cross; all of it if the vocabulary allows no cuts."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        return _CHUNKS.findall(marked) if self.chunked else [marked]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: byte pieces are joined before decoding, and the space put before the text is taken off."""
        text = self.decode_part(ids)
        return text[1:] if text.startswith(" ") else text

    def decode_part(self, ids: list[int]) -> str:
        return b"".join([self.surface[i] for i in ids]).decode("utf-8", "replace")


@dataclass
class Encoder:
    """Encoded texts of one worker process, with the remembered chunks."""

    merger: Merger
    #: chunk: its ids as decimals joined by a space
    ids: dict[str, str] = field(default_factory=dict)
    #: chunk: its decoded text
    texts: dict[str, str] = field(default_factory=dict)
    #: chunks of which the library has other ids
    differing: set[str] = field(default_factory=set)

    def _learn(self, new: list[str]) -> None:
        """Merge chunks, and compare them with the library, which puts a space before each text it gets.

        A chunk that begins with a space mark gives that one up; any other follows a line feed, which is a byte
        piece and joins nothing. A lone space mark would be an empty text, so that one is not compared.
        """
        merger = self.merger
        asked = [c[1:].replace(SPACE, " ") if c.startswith(SPACE) else "\n" + c for c in new]
        for chunk, theirs in zip(new, merger.library.encode(asked, num_threads=1)):
            ids = merger.merge(chunk)
            self.ids[chunk] = " ".join(map(str, ids))
            self.texts[chunk] = merger.decode_part(ids)
            if chunk != SPACE and ids != (theirs if chunk.startswith(SPACE) else theirs[2:]):
                self.differing.add(chunk)

    def encode(self, texts: list[str]) -> list[tuple[int, str, str, int]]:
        """For each text: number of ids, the ids as decimals, the decoded text, and the differences from the library."""
        if len(self.ids) > MEMORY:
            self.ids.clear()
            self.texts.clear()
            self.differing.clear()
        cut = [self.merger.chunks(t) for t in texts]
        new = list(set().union(*cut).difference(self.ids))
        self._learn(new)
        out, end = [], str(self.merger.eos)
        for i, chunks in enumerate(cut):
            ids = " ".join([*map(self.ids.__getitem__, chunks), end])
            text = "".join(map(self.texts.__getitem__, chunks))
            differ = sum(c in self.differing for c in chunks) if self.differing else 0
            if i == 0:
                theirs = self.merger.library.encode(texts[0], add_eos=True)
                differ += ids != " ".join(map(str, theirs))
            out.append((ids.count(" ") + 1, ids, text[1:] if text.startswith(" ") else text, differ))
        for chunk in new:
            if len(chunk) > LONGEST_KEPT:
                del self.ids[chunk], self.texts[chunk]
                self.differing.discard(chunk)
        return out


_ENCODERS: dict[str, Encoder] = {}


def _encoder(model_file: str) -> Encoder:
    """One for each model file in a worker process."""
    if model_file not in _ENCODERS:
        _ENCODERS[model_file] = Encoder(Merger(model_file))
    return _ENCODERS[model_file]


_RESULT = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("n_differ", T.LongType()),
    ]
)
#: Characters of text that are encoded at a time inside an Arrow batch.
SLICE_CHARS = 1_000_000


def _parts(texts: list[str]):
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= SLICE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def digests(model_file: str):
    """An Arrow function: text to (n_tokens, ids_sha256, decoded_sha256, n_differ)."""

    def run(texts: pa.Array) -> pa.Array:
        encoder = _encoder(model_file)
        rows = []
        for part in _parts([t or "" for t in texts.to_pylist()]):
            for n, ids, text, differ in encoder.encode(part):
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), differ))
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _RESULT.fieldNames())

    return F.arrow_udf(run, _RESULT)


def encoded(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, n_differ) of each row of ``docs``, with the end id and no begin id.

    Null texts count as empty and have the end id alone. Repeated rows give repeated results, an empty table an
    empty one. Texts of any length are encoded whole, in chunks. All other columns of ``docs`` are left out, so names
    that clash with the result's do no harm. Pairs of equal score merge from the left, as in the library. n_differ
    counts the chunks on which the library disagrees; 0 wherever the vocabulary is merge-type. model_file must be
    readable under that path on every executor.
    """
    common.small_batches(docs.sparkSession)
    return docs.select(F.col(key), digests(model_file)(F.coalesce(F.col(text), F.lit(""))).alias("_e")).select(
        key, "_e.n_tokens", "_e.ids_sha256", "_e.decoded_sha256", "_e.n_differ"
    )
