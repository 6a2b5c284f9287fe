"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here (pieces with scores and types, model type, byte fallback, normaliser settings), and a
tokenizer is rebuilt from it: normaliser (character map, extra white space, the leading metaspace, metaspaces for spaces),
a unigram model from the scores or a BPE model whose merges follow from them, byte fallback, and the inverse decoder.

User-defined pieces of a BPE model are taken out before all others. Where no piece runs from another letter into a metaspace (this is checked; other models are encoded text by text), a text
is the sequence of its chunks, cut before metaspaces and before marks that no piece has behind a letter. Each distinct chunk is encoded once: those of a BPE
model's own letters are merged many at once, all others go through the library in batches. Ids whose pieces give valid UTF-8 are decoded by joining bytes, others by the library's decoder.
``verified`` compares every text's ids with those of the sentencepiece library.

Defined results: a null text is an empty one and has no ids; an empty list of ids decodes to an empty text; ids outside
the model raise ValueError. Repeated rows give repeated rows; columns other than doc_id and the content are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from starlode.llm import common
from starlode.llm.merging import LONGEST, Merges

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Marks before which a text may be cut behind a letter, if no piece has the mark there.
MARKS = "\n\t.,;:!?|*#%&$()[]{}<>=+-_/\\\"'@~^`"
CACHE_CHUNKS = 400_000
#: New chunks that are merged, and ids that are decoded, at once.
BLOCK = 1 << 17


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of one protobuf message; nested messages and strings come as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind}")
            size = varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    """What the rebuilt tokenizer needs of a model file."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = 1  # 1 unigram, 2 BPE
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True  # remove extra white space
    escape: bool = True

    @property
    def unknown(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def parse(data: bytes) -> Model:
    model = Model()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    model.kind = v
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.squeeze = bool(v)
                elif n == 5:
                    model.escape = bool(v)
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """All splits of each piece into two others, the pieces of the best scores first."""
    rank = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
    found = []
    for piece, score, kind in model.pieces:
        if kind == NORMAL and len(piece) > 1:
            parts = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in rank and piece[i:] in rank]
            found += [(-score, rank[piece], rank[a], rank[b], a, b) for a, b in parts]
    return [(a, b) for *_, a, b in sorted(found)]


def cuts(model: Model) -> re.Pattern | None:
    """A pattern whose matches are the chunks of a normalised text, or None if the pieces allow no cuts."""
    texts = [p for p, _, kind in model.pieces if kind in (NORMAL, USER)]
    if model.charsmap or model.squeeze or not model.escape or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in texts):
        return None
    letter = re.compile(f"[{LETTERS}]")
    marks = set(MARKS) - {y for p in texts for x, y in zip(p, p[1:], strict=False) if letter.match(x)}
    m = re.escape("".join(sorted(marks)))
    other, plain = f"[^{SPACE}{LETTERS}]", f"[^{SPACE}{LETTERS}{m}]"
    # Metaspaces, then all up to the next metaspace, or up to a mark behind a letter.
    return re.compile(f"(?s)(?=.){SPACE}*{other}*(?:[{LETTERS}]+(?:{plain}{other}*[{LETTERS}]*)*)?")


def rebuild(model: Model, joins: list[tuple[str, str]] | None = None):
    """A tokenizers.Tokenizer with the model's normaliser, pieces and decoder; ``joins`` are a BPE model's merges, if known."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if model.kind == 1:
        # A user-defined piece is rated by its bytes, each as good as the best piece of the model, or 0 where that is less.
        best = max([0.0, *(s for _, s, kind in model.pieces if kind == NORMAL)])
        scored = [(p, len(p.encode()) * best - 0.1 if kind == USER else s) for p, s, kind in model.pieces]
        core = models.Unigram(scored, unk_id=model.unknown, byte_fallback=model.byte_fallback)
    elif model.kind == 2:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, merges(model) if joins is None else joins, unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind}")
    steps: list = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex(r"\A +| +\z"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", SPACE))
    tokenizer = Tokenizer(core)
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    back: list = [decoders.Replace(SPACE, " ")] if model.escape else []
    back += [decoders.ByteFallback(), decoders.Fuse()] if model.byte_fallback else [decoders.Fuse()]
    if model.dummy_prefix:
        back.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(back)
    return tokenizer


class Codec:
    """Encodes and decodes batches; one per process."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.data = f.read()
        self.model = parse(self.data)
        joins = merges(self.model) if self.model.kind == 2 else None
        self.tokenizer = rebuild(self.model, joins)
        self.cut = cuts(self.model)
        spelled = [bytes([int(p[3:5], 16)]) if k == BYTE else (p.replace(SPACE, " ") if self.model.escape else p).encode() for p, _, k in self.model.pieces]
        self.spelled, self.sizes = np.frombuffer(b"".join(spelled), np.uint8), np.array([len(b) for b in spelled], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.chunks: dict[str, bytes] = {}
        self.merges = None
        if joins is not None and self.cut is not None:
            vocab = {p: i for i, (p, _, _) in enumerate(self.model.pieces)}
            self.merges = Merges(((vocab[a], vocab[b], vocab[a + b]) for a, b in joins), len(self.model.pieces))
            # ASCII characters that are no pieces become their bytes' pieces, which no merge has.
            letters = {b: vocab[f"<0x{b:02X}>"] for b in range(128) if self.model.byte_fallback and self.model.pieces[vocab.get(f"<0x{b:02X}>", 0)][2] == BYTE}
            letters |= {ord(p): i for p, i in vocab.items() if len(p) == 1}
            self.letters = np.full(max(letters, default=0) + 2, -1, np.int32)  # the last one stands for all beyond
            self.letters[list(letters)] = list(letters.values())
        from tokenizers import Tokenizer

        self.bare = Tokenizer.from_str(self.tokenizer.to_str())
        self.bare.normalizer = None
        self._reference = None
        self.user_ids = {p: i for i, (p, _, kind) in enumerate(self.model.pieces) if kind == USER and self.model.kind == 2}
        self.user = re.compile("|".join(map(re.escape, sorted(self.user_ids, key=len, reverse=True)))) if self.user_ids else None

    def apart(self, text: str) -> bytes:
        """Ids of a text whose user-defined pieces are taken out first, the longest one at each place."""
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        out, at = [], 0
        for m in [*self.user.finditer(text), None]:
            part = text[at : m.start() if m else len(text)]
            out += self.bare.encode(part, add_special_tokens=False).ids if part else []
            if m:
                out.append(self.user_ids[m[0]])
                at = m.end()
        return b"".join(i.to_bytes(4, "little") for i in out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.user:
            return [self.apart(t) for t in texts]
        if self.cut is None:
            return [b"".join(i.to_bytes(4, "little") for i in e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lead = SPACE if self.model.dummy_prefix else ""
        cut = [self.cut.findall(lead + t.replace(" ", SPACE)) if t else [] for t in texts]
        known = self.chunks
        fresh = set().union(*cut).difference(known)
        if len(known) + len(fresh) > CACHE_CHUNKS:
            known.clear()
            fresh = set().union(*cut)
        self.learn(list(fresh))
        return [b"".join(map(known.__getitem__, row)) for row in cut]

    def by_library(self, chunks: list[str]) -> None:
        for c, e in zip(chunks, self.bare.encode_batch_fast(chunks, add_special_tokens=False), strict=True):
            self.chunks[c] = b"".join(i.to_bytes(4, "little") for i in e.ids)

    def learn(self, chunks: list[str]) -> None:
        """Puts the ids of new chunks in."""
        most = LONGEST if self.merges else 0
        self.by_library([c for c in chunks if len(c) > most])
        chunks = [c for c in chunks if len(c) <= most]
        for k in range(0, len(chunks), BLOCK):
            block = chunks[k : k + BLOCK]
            points = np.frombuffer("".join(block).encode("utf-32-le"), np.uint32)
            symbols = self.letters[np.minimum(points, len(self.letters) - 1)]
            lengths = np.array([len(c) for c in block])
            starts = np.cumsum(lengths) - lengths
            spelled = np.minimum.reduceat(symbols, starts) >= 0
            own = np.flatnonzero(spelled)
            ids, counts = self.merges.merged(symbols, starts[own], lengths[own])
            data, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(counts)
            for i, start, end in zip(own.tolist(), (ends - 4 * counts).tolist(), ends.tolist(), strict=True):
                self.chunks[block[i]] = data[start:end]
            self.by_library([block[i] for i in np.flatnonzero(~spelled).tolist()])

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.decoded(np.fromiter((i for row in ids for i in row), np.int64), [len(row) for row in ids])

    def decoded(self, ids: np.ndarray, counts: list[int]) -> list[str]:
        """The text of each row of so many ids."""
        if ids.size and not 0 <= ids.min() <= ids.max() < len(self.sizes):
            raise ValueError("an id outside the model")
        raw, stops = [], [np.zeros(1, np.int64)]
        for k in range(0, len(ids), BLOCK):
            some = ids[k : k + BLOCK]
            ends = np.cumsum(sizes := self.sizes[some])
            raw.append(self.spelled[np.repeat(self.places[some] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
            stops.append(ends + stops[-1][-1])
        data, stop = b"".join(raw), np.concatenate(stops)
        out, at = [], 0
        for count in counts:
            try:
                text = data[stop[at] : stop[at + count]].decode()
            except UnicodeDecodeError:
                out.append(self.tokenizer.decode(ids[at : at + count].tolist(), skip_special_tokens=False))
            else:
                out.append(text[1:] if self.model.dummy_prefix and text[:1] == " " else text)
            at += count
        return out

    def reference(self, texts: list[str]) -> list[list[int]]:
        """Ids by the sentencepiece library."""
        if self._reference is None:
            import sentencepiece

            self._reference = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        return self._reference.encode(texts, num_threads=1)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def lists(data: list[bytes]) -> pa.Array:
    """An Arrow list column of 32-bit ids."""
    values = pa.array(memoryview(b"".join(data)).cast("i") if any(data) else [], pa.int32())
    offsets = [0]
    for d in data:
        offsets.append(offsets[-1] + len(d) // 4)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return common.batch_of(doc_id=batch.column("doc_id"), ids=lists(codec(path).encode([t or "" for t in batch.column("text").to_pylist()])))

    return common.map_slices(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids give a null text."""
    common.prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("ids").to_pylist()
            texts = codec(path).decode([r or [] for r in rows])
            yield common.batch_of(doc_id=batch.column("doc_id"), text=pa.array([None if r is None else t for r, t in zip(rows, texts, strict=True)], pa.string()))

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


VERIFIED = "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, roundtrip boolean, parity boolean"


def verified(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every whole text, whether it is the text again, and whether the
    sentencepiece library gives the same ids."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, texts = codec(path), [t or "" for t in batch.column("text").to_pylist()]
        data = own.encode(texts)
        ids = [memoryview(d).cast("I").tolist() for d in data]
        again = own.decoded(np.frombuffer(b"".join(data), "<u4"), [len(i) for i in ids])
        return common.batch_of(
            doc_id=batch.column("doc_id"), n_ids=pa.array([len(i) for i in ids], pa.int64()), ids_crc32=pa.array([zlib.crc32(d) for d in data], pa.int64()),
            decoded_sha256=pa.array([hashlib.sha256(a.encode()).hexdigest() for a in again], pa.string()),
            roundtrip=pa.array([a == t for a, t in zip(again, texts, strict=True)]), parity=pa.array([a == b for a, b in zip(ids, own.reference(texts), strict=True)]),
        )

    return common.map_slices(docs.select("doc_id", "text"), run, VERIFIED)
