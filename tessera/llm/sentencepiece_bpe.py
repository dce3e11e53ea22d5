"""Exact merge-type encoding of a SentencePiece BPE model by backtracking.

A text is a sequence of pieces in which every adjacent pair is what merging
the pair's characters anew would give; for merge-type models that sequence is
unique. The encoder walks left to right over the longest pieces that an
Aho-Corasick automaton finds at each place, falls back to shorter ones when a
pair is incompatible, and keeps a bitfield of places from which no valid
continuation exists. Pieces never span the start of a word here, so words are
encoded apart and remembered in a table of bounded size.

Cases: null and empty texts give the end id alone; characters that the model
lacks become byte pieces; extra columns are ignored; repeated rows are encoded
each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import batches, doc_texts, sha256_hex

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protobuf message."""
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
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces, scores and flags of a model file; only BPE with the identity normaliser is taken."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            message = file.read()
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.dummy_prefix, squeeze, escape, charsmap, kind, number = True, True, True, b"", 1, 0
        self.end = 2
        for field, value in _fields(message):
            if field == 1:
                piece = dict(_fields(value))
                text, score = piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                is_a = piece.get(3, NORMAL)
                if is_a == BYTE:
                    self.bytes[int(text[3:5], 16)] = number
                elif is_a in (USER_DEFINED, UNUSED):
                    raise ValueError("models with user-defined or unused pieces aren't taken")
                elif is_a == NORMAL:
                    self.scores[text], self.ids[text] = score, number
                elif is_a == CONTROL and text == "</s>":
                    self.end = number
                elif is_a == UNKNOWN:
                    self.unknown = number
                number += 1
            elif field == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif field == 3:
                normalizer = dict(_fields(value))
                charsmap, self.dummy_prefix = normalizer.get(2, b""), bool(normalizer.get(3, 1))
                squeeze, escape = bool(normalizer.get(4, 1)), bool(normalizer.get(5, 1))
        if kind != 2 or charsmap or squeeze or not escape:
            raise ValueError("only BPE models with the identity normaliser that keep white space are taken")
        if any(SPACE in piece.lstrip(SPACE) or (piece[:2] == SPACE * 2 and piece.strip(SPACE)) for piece in self.scores):
            raise ValueError("a piece spans the start of a word")

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by merging, best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, where = score, i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts


class Encoder:
    """Encodes words by backtracking; ``remembered`` bounds the words and pairs kept in memory."""

    def __init__(self, path: str, remembered: int = 500_000) -> None:
        self.model, self.remembered = Model(path), remembered
        self.automaton = ahocorasick.Automaton()
        for piece in self.model.scores:
            if len(piece) > 1 and self.model.merge(piece) == [piece]:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.after_space, self.plain = _Known(self, SPACE), _Known(self, "")

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging both pieces' characters anew gives these two pieces."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= 4 * self.remembered:
                self.pairs.clear()
            known = self.pairs[left, right] = self.model.merge(left + right) == [left, right]
        return known

    def pieces(self, word: str) -> list[str]:
        size = len(word)
        found: list[list[str]] = [[] for _ in range(size)]
        for end, piece in self.automaton.iter(word):
            found[end - len(piece) + 1].append(piece)
        failed = bytearray(size // 8 + 1)
        out: list[tuple[str, int]] = []
        at, turn = 0, 0
        while at < size:
            choices = found[at]  # shortest first: an end farther right is found later
            last = out[-1][0] if out else None
            while turn <= len(choices):
                piece = choices[len(choices) - 1 - turn] if turn < len(choices) else word[at]
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and (last is None or self.compatible(last, piece)):
                    break
                turn += 1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece, turn = out.pop()
                at, turn = at - len(piece), turn + 1
                continue
            out.append((piece, turn))
            at, turn = at + len(piece), 0
        return [piece for piece, _ in out]

    def piece_ids(self, word: str) -> tuple[int, ...]:
        ids: list[int] = []
        for piece in self.pieces(word):
            if (number := self.model.ids.get(piece)) is not None:
                ids.append(number)
            elif self.model.bytes:
                ids.extend(self.model.bytes[b] for b in piece.encode())
            else:
                ids.append(self.model.unknown)
        return tuple(ids)

    def words(self, text: str) -> list[tuple[str, tuple[int, ...]]]:
        """Text of the ids and ids of each word."""
        out: list[tuple[str, tuple[int, ...]]] = []
        if not text:
            return out
        text = (" " if self.model.dummy_prefix else "") + text.replace(SPACE, " ")
        newline = self.plain["\n"]
        for number, line in enumerate(text.split("\n")):
            if number:
                out.append(newline)
            if "  " in line or line[-1:] == " ":
                out.extend(self.plain[x.replace(" ", SPACE)] for x in re.findall(" *[^ ]+| +", line))
            elif line:
                first, *rest = line.split(" ")
                if first:
                    out.append(self.plain[first])
                out.extend(map(self.after_space.__getitem__, rest))
        return out


class _Known(dict):
    def __init__(self, encoder: Encoder, before: str) -> None:
        self.encoder, self.before = encoder, before

    def __missing__(self, word: str) -> tuple[str, tuple[int, ...]]:
        ids = self.encoder.piece_ids(self.before + word)
        value = " ".join(map(str, ids)), ids
        if len(word) <= 64:  # long words are rare and would make the table large
            if len(self) >= self.encoder.remembered:
                self.clear()
            self[word] = value
        return value


_loaded: dict[str, tuple[Encoder, object]] = {}


def _load(path: str) -> tuple[Encoder, object]:
    if path not in _loaded:
        import sentencepiece

        _loaded[path] = Encoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document the number of ids, a digest of them and of what they decode to."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, library = _load(model_path)
        end = encoder.model.end
        for keys, texts in batches(items):
            counts, ids_sha, text_sha = [], [], []
            for text in texts:
                words = encoder.words(text)
                ids = list(chain.from_iterable(x[1] for x in words))
                ids.append(end)
                counts.append(len(ids))
                ids_sha.append(sha256_hex(" ".join([*(x[0] for x in words), str(end)]).encode()))
                text_sha.append(sha256_hex(library.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=SCHEMA.names)

    return doc_texts(docs).mapInArrow(run, SCHEMA)
