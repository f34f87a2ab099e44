"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here and rebuilt: normaliser (dummy prefix, extra
white space, character map), the metaspace marker, unigram scores or the merges
that BPE scores amount to, and byte fallback.

Where no piece has a marker after another character, no merge crosses the start
of a run of markers, and none crosses a character that is in no longer piece
(a line end, say). A text is then a chain of chunks whose ids do not depend on
each other. Each task encodes a distinct chunk once, checks it against the
sentencepiece library and decodes it, and keeps at most ``CACHE`` of them. Where a
line end is one piece that no other holds, ``GROUP`` chunks go through both
libraries and back as one text of a line each; a group that is not equal
throughout is gone through again chunk by chunk. A chunk on which the two differ
keeps the rebuilt backend's ids and is counted.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Chunks that a task remembers; past it the memory is emptied and filled anew.
CACHE = 400_000
#: Longer chunks are not remembered.
LONG = 200
#: Chunks that are encoded as one text.
GROUP = 200
UNKNOWN, CONTROL, USER, BYTE = 2, 3, 4, 6
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) pairs of a protobuf message; fixed fields stay bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 2, 5):
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


@dataclass
class Model:
    """What of a model file encoding and decoding need."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim: bool = True
    escape: bool = True
    unk_id: int = 0


def parse(data: bytes) -> Model:
    """Read a serialised model: field 1 pieces, 2 trainer, 3 normaliser."""
    model = Model()
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            score = float(np.frombuffer(piece.get(2, b"\0\0\0\0"), dtype="<f4")[0])
            model.pieces.append((piece[1].decode(), score, piece.get(3, 1)))
        elif number == 2:
            trainer = dict(fields(value))
            model.kind = trainer.get(3, UNIGRAM)
            model.byte_fallback = bool(trainer.get(35, 0))
            model.unk_id = trainer.get(40, 0)
        elif number == 3:
            rules = dict(fields(value))
            model.charsmap = rules.get(2, b"")
            model.dummy_prefix, model.trim, model.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
    return model


def tokenizer(model: Model):
    """The tokenizers-library twin of the model, without its normaliser."""
    from tokenizers import Tokenizer, decoders, models

    vocab = {piece: k for k, (piece, _, _) in enumerate(model.pieces)}
    if model.kind == UNIGRAM:
        twin = Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk_id, model.byte_fallback))
    elif model.kind == BPE:
        plain = {p: s for p, s, kind in model.pieces if kind not in (UNKNOWN, CONTROL, BYTE)}
        merges = []
        for piece, score in plain.items():
            for k in range(1, len(piece)):
                if piece[:k] in plain and piece[k:] in plain:
                    merges.append((-score, vocab[piece], vocab[piece[:k]], vocab[piece[k:]], piece[:k], piece[k:]))
        merges.sort()
        twin = Tokenizer(models.BPE(vocab, [(m[4], m[5]) for m in merges], unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback))
    else:
        raise ValueError(f"model type {model.kind} is not supported")
    twin.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return twin


def _normaliser(model: Model):
    from tokenizers import normalizers

    charsmap = normalizers.Precompiled(model.charsmap) if model.charsmap else None

    def run(text: str) -> str:
        if charsmap is not None:
            text = charsmap.normalize_str(text)
        if model.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        if model.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if model.escape else text

    return run


class Codec:
    """Encodes and decodes whole texts; one for each task."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = parse(data)
        self.twin = tokenizer(self.model)
        self.own = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.normalise = _normaliser(self.model)
        self.memory: dict[str, bytes] = {}
        self.differs: set[str] = set()
        self.bent: set[str] = set()
        plain = [p for p, _, kind in self.model.pieces if kind not in (UNKNOWN, CONTROL, BYTE)]
        inner = {c for p in plain if len(p) > 1 for c in p}
        self.splits = self.model.kind == BPE and not any(MARK in p.lstrip(MARK) for p in plain)
        lone = "" if "\n" in inner else "\n"
        self.chunk = re.compile(f"{MARK}+[^{MARK}{lone}]*|{lone + '|' if lone else ''}[^{MARK}{lone}]+")
        self.byte_ids = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(self.model.pieces) if kind == BYTE}
        table: list[bytes] = []
        for piece, _, kind in self.model.pieces:
            table.append(bytes([int(piece[3:5], 16)]) if kind == BYTE else b" \xe2\x81\x87 " if kind == UNKNOWN else b"" if kind == CONTROL else piece.replace(MARK, " ").encode())
        self.table = table
        self.line = self._line_end() if self.splits and lone else None

    def _line_end(self) -> int | None:
        """The id of a line end that both libraries keep and give to no other text."""
        if self.model.charsmap or self.model.trim:
            return None
        ids, right = self.twin.encode("\n", add_special_tokens=False).ids, self.own.encode("\n")
        holds = [k for k, piece in enumerate(self.table) if b"\n" in piece]
        return ids[0] if ids == right[-1:] == holds and self.table[ids[0]] == b"\n" else None

    def _reference(self, chunks: list[str]) -> list[list[int]]:
        """sentencepiece's ids of chunks that are normalised already."""
        texts = [c.replace(MARK, " ") for c in chunks]
        if not self.model.dummy_prefix:
            return self.own.encode(texts, num_threads=1)
        # a chunk with a leading space gives it to the dummy prefix; another follows a line end, whose ids go
        lead = len(self.own.encode("\n"))
        inner = [t[1:] if t[0] == " " and t != " " else "\n" + t for t in texts]
        found = self.own.encode(inner, num_threads=1)
        return [ids if t[0] == " " and t != " " else ids[lead:] for t, ids in zip(texts, found, strict=True)]

    def _together(self, chunks: list[str]) -> dict[str, bytes] | None:
        """Ids of chunks that pass both checks, by one text with a line for each; None where the text fails one."""
        if self.line is None:
            return None
        text = "\n" + "\n".join(chunks)
        plain = text.replace(MARK, " ")
        ids = self.twin.encode_batch_fast([text], add_special_tokens=False)[0].ids
        # the dummy prefix stands before the first line end
        if ids != self.own.encode(plain)[int(self.model.dummy_prefix) :] or b"".join(map(self.table.__getitem__, ids)) != plain.encode():
            return None
        found = np.array(ids, dtype="<i4")
        ends = 4 * np.append(np.flatnonzero(found == self.line), len(found))
        if len(ends) != len(chunks) + 1:
            return None
        whole, ends = found.tobytes(), ends.tolist()
        return {c: whole[a + 4 : b] for c, a, b in zip(chunks, ends[:-1], ends[1:], strict=True)}

    def _singly(self, chunks: list[str]) -> dict[str, bytes]:
        out = {}
        for chunk, found, right in zip(chunks, self.twin.encode_batch_fast(chunks, add_special_tokens=False), self._reference(chunks), strict=True):
            if found.ids != right:
                self.differs.add(chunk)
            if b"".join(map(self.table.__getitem__, found.ids)) != chunk.replace(MARK, " ").encode():
                self.bent.add(chunk)
            out[chunk] = np.array(found.ids, dtype="<i4").tobytes()
        return out

    def _learn(self, chunks: list[str]) -> None:
        for at in range(0, len(chunks), GROUP):
            some = chunks[at : at + GROUP]
            found = self._together(some)
            self.memory.update(self._singly(some) if found is None else found)

    def _chunks(self, text: str) -> list[str]:
        """The chunks of a normalised text, in order; empty strings may stand between them."""
        if self.line is None or "\0" in text or MARK + MARK in text:
            return self.chunk.findall(text)
        return text.replace(MARK, "\0" + MARK).replace("\n", "\0\n\0").split("\0")

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[int]]:
        """Ids of each text as little-endian int32 bytes, and its chunks whose parity failed."""
        return self.checked(texts)[:2]

    def checked(self, texts: list[str]) -> tuple[list[bytes], list[int], list[bool]]:
        """What ``encode`` gives, and whether decoding gives the normalised text back."""
        if not self.splits:
            found = [e.ids for e in self.twin.encode_batch([self.normalise(t) for t in texts], add_special_tokens=False)]
            right = self.own.encode(texts, num_threads=1)
            wrong = [int(a != b) for a, b in zip(found, right, strict=True)]
            same = [self.decode(np.array(a, dtype=np.int64)) == self.expected(t) for t, a in zip(texts, found, strict=True)]
            return [np.array(a, dtype="<i4").tobytes() for a in found], wrong, same
        chains = [self._chunks(self.normalise(t)) for t in texts]
        every = set().union(*chains) - {""}
        new = every.difference(self.memory)
        if len(self.memory) + len(new) > CACHE:
            self.memory, self.differs, self.bent = {}, set(), set()
            new = every
        self._learn(list(new))
        self.memory[""] = b""
        ids = [b"".join(map(self.memory.__getitem__, chain)) for chain in chains]
        wrong = [sum(c in self.differs for c in chain) if self.differs else 0 for chain in chains]
        # where every chunk comes back, so does the text
        same = [self.bent.isdisjoint(chain) or self.decode(np.frombuffer(b, dtype="<i4")) == self.expected(t) for t, b, chain in zip(texts, ids, chains, strict=True)]
        for c in new:
            if len(c) > LONG:
                del self.memory[c]
        return ids, wrong, same

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space of the dummy prefix goes, bad bytes become U+FFFD."""
        text = b"".join(map(self.table.__getitem__, ids.tolist()))
        if self.model.dummy_prefix and text[:1] == b" ":
            text = text[1:]
        return text.decode("utf-8", errors="replace")

    def expected(self, text: str) -> str:
        """What decoding an encoded text has to give: the normalised text."""
        text = self.normalise(text).replace(MARK, " ")
        return text[1:] if self.model.dummy_prefix else text


_KEPT: dict[bytes, Codec] = {}


def codec_of(model: bytes) -> Codec:
    """The worker's codec of a model; its memory serves the worker's later tasks too."""
    key = hashlib.sha256(model).digest()
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Codec(model)
    return _KEPT[key]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids, n_tokens, parity_errors, round_trip) for every row, and the columns to ``keep``.

    ``parity_errors`` counts the chunks of the text on which the two libraries
    differ; ``round_trip`` says that decoding gives the normalised text back
    (a text that holds a literal marker does not). A null text is the empty text
    and has no ids; ids may be null or repeat; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in slices(batches, 1_000_000):
            texts = batch.column(1).to_pylist()
            found, wrong, same = codec.checked(texts)
            sizes = np.array([len(b) // 4 for b in found], dtype=np.int32)
            flat = np.frombuffer(b"".join(found), dtype="<i4")
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(sizes.astype(np.int64)), pa.array(wrong, pa.int64()), pa.array(same), *batch.columns[2:]], names=["doc_id", "ids", "n_tokens", "parity_errors", "round_trip", *keep])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *keep)
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"doc_id long, ids array<int>, n_tokens long, parity_errors long, round_trip boolean{kept}")


def decode(rows: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids; null ids are an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in batches:
            texts = [codec.decode(np.array(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def op5_sentencepiece(spark, sf_dir: str, model_path: str = MODEL) -> DataFrame:
    """Ids of every whole document, with parity and round-trip checks."""
    return encode(table(spark, sf_dir, "documents"), read_model(model_path))
