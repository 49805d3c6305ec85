"""SentencePiece encoding and decoding with byte offsets.

*Normalising.*  At each place the longest prefix found in the model's compiled
character map (a double-array trie followed by its replacement strings) is
replaced; where none matches, one character is copied.  Every normalised byte
remembers the source bytes it came from, so each piece is projected to a byte
span of the original text.  A model without a character map copies characters
as they are.

*Segmenting.*  Byte-pair merges by falling piece score, leftmost first, with
byte fallback for characters that no piece covers.  No piece holds a space
mark behind another character, so merges never cross from one run of
"space marks, then other characters" into the next; each distinct run is
merged once and remembered in a bounded cache.

*Decoding.*  Pieces are joined, space marks become spaces, the mark added in
front is removed, byte pieces become characters (U+FFFD for each byte that
starts no valid character).

Cases: a null or empty text has only the begin and end ids and decodes to the
empty string; a text of any length is one row; repeated rows each get their
row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import TextBlock, map_text

MARK = "▁"
CACHE_RUNS = 250_000
CACHE_RUN_CHARS = 48
SHORT_RUN = 64
NO_PIECE = 1 << 24
PAIR = 1 << 26


class CharMap:
    """Longest-prefix lookups in a compiled character map: a little-endian
    size, that many bytes of 32-bit double-array units, and the replacement
    strings, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.strings = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        units, found = self.units, None
        node = self._child(0)
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(units) or units[node] & 0x800000FF != text[k]:
                break
            unit = units[node]
            node ^= self._child_offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = k + 1 - at, self.strings[start:self.strings.index(0, start)]
        return found

    def _child(self, node: int) -> int:
        return node ^ self._child_offset(self.units[node])

    @staticmethod
    def _child_offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Letters(dict):
    """The number of each character: its piece, or ``NO_PIECE`` and its code."""

    def __init__(self, ids: dict[str, int]):
        super().__init__()
        self.ids = ids

    def __missing__(self, c: str) -> int:
        got = self.ids.get(c, NO_PIECE + ord(c))
        self[c] = got
        return got


class Codec:
    """Encoder and decoder of one model file's bytes (byte-pair models)."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only byte-pair models with leading space marks are supported")
        self.map = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.escape = spec.escape_whitespaces
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.rank = {p.piece: p.score for p in proto.pieces if p.type in (1, 4, 5)}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (1, 4)}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a space mark behind another character")
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unk = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        control = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 3}
        trainer = proto.trainer_spec
        self.begin = control.get(trainer.bos_piece or "<s>", trainer.bos_id)
        self.end = control.get(trainer.eos_piece or "</s>", trainer.eos_id)
        self.runs: dict[str, tuple[bytes, bytes, str]] = {}  # newer half of the cache
        self.older: dict[str, tuple[bytes, bytes, str]] = {}
        self.letters = Letters(self.ids)
        self.pair_rank, self.pair_id = {}, {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                a, b = self.letter(piece[0]) if k == 1 else a, self.letter(piece[-1]) if k == len(piece) - 1 else b
                if a is not None and b is not None:
                    self.pair_rank[a * PAIR + b], self.pair_id[a * PAIR + b] = -self.rank[piece], i
        self.sizes = [len(p.replace(MARK, " ").encode("utf-8", "replace")) for p in self.pieces]
        self.spaced = [p.replace(MARK, " ") for p in self.pieces]

    # -- normalising --------------------------------------------------------
    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text with space marks as spaces, and for each of its
        UTF-8 bytes the source offset of the character it came from (one more
        entry for the end); None where bytes were copied one to one behind the
        prefix."""
        if not text:
            return "", None
        if self.map is None and not self.squeeze:
            return (" " if self.prefix else "") + text.replace(MARK, " "), None
        raw = text.encode("utf-8", "replace")
        out, source, at = bytearray(), [], 0
        while at < len(raw):
            hit = self.map.longest(raw, at) if self.map else None
            if hit:
                size, new = hit
            else:
                lead = raw[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = raw[at:at + size]
            new = new.replace(MARK.encode(), b" ")
            out += new
            source += [at] * len(new)
            at += size
        if self.squeeze:
            kept = [k for k, b in enumerate(out) if b != 32 or k + 1 < len(out) and out[k + 1] != 32]
            while kept and out[kept[0]] == 32:
                kept.pop(0)
            out, source = bytearray(out[k] for k in kept), [source[k] for k in kept]
        if not out:
            return "", None
        if self.prefix:
            out, source = bytearray(b" ") + out, [source[0], *source]
        return out.decode("utf-8", "replace"), np.array([*source, len(raw)], np.int64)

    # -- segmenting ---------------------------------------------------------
    def merge(self, run: str) -> list[int]:
        """Ids of the pieces of one run (space marks first), by the best pair
        each time; a character without piece is ``NO_PIECE`` and its code."""
        if len(run) > SHORT_RUN:
            return [self.letter(x) if len(x) == 1 else self.ids[x] for x in self._merge_long(run)]
        rank, none = self.pair_rank.get, math.inf
        letters = self.letters
        parts = [letters[c] for c in run]
        ranks = [rank(a * PAIR + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != none:
            k = ranks.index(best)
            both = parts[k] = self.pair_id[parts[k] * PAIR + parts[k + 1]]
            del parts[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank(parts[k - 1] * PAIR + both, none)
            if k < len(ranks):
                ranks[k] = rank(both * PAIR + parts[k + 1], none)
        return parts

    def letter(self, c: str) -> int:
        return self.letters[c]

    def _merge_long(self, run: str) -> list[str]:
        """The same with a heap, for runs of any length."""
        parts: list[str | None] = list(run)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, heap = self.rank, []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n and (score := rank.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-score, i, j, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def run(self, text: str) -> tuple[bytes, bytes, str]:
        """Of one run of a normalised text: its ids and the number of
        normalised bytes of each (little-endian 32-bit), and its decoding."""
        parts = self.merge(text.replace(" ", MARK))
        if max(parts) < NO_PIECE:
            return (array("I", parts).tobytes(), array("I", [self.sizes[i] for i in parts]).tobytes(),
                    "".join([self.spaced[i] for i in parts]))
        ids, sizes = [], []
        for i in parts:
            if i < NO_PIECE:
                ids.append(i)
                sizes.append(self.sizes[i])
            else:
                raw = chr(i - NO_PIECE).encode("utf-8", "replace")
                ids += [self.bytes[b] for b in raw] if self.bytes else [self.unk]
                sizes += [1] * len(raw) if self.bytes else [len(raw)]
        return array("I", ids).tobytes(), array("I", sizes).tobytes(), self._decode(ids)

    def _new(self, text: str) -> tuple[bytes, bytes, str]:
        """A run that the newer half of the cache lacks."""
        got = self.older.get(text) or self.run(text)
        if len(text) <= CACHE_RUN_CHARS:
            if len(self.runs) >= CACHE_RUNS:
                self.older, self.runs = self.runs, {}
            self.runs[text] = got
        return got

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, str]:
        """Ids with begin and end, a (start, end) byte span of the original
        text for each, and the decoding of the ids.  The begin and end ids
        have empty spans; the pieces of one replaced character share its span."""
        text = text or ""
        plain, source = self.normalise(text)
        found, new = self.runs.get, self._new
        known = []
        for x in RUNS(plain):
            if (got := found(x)) is None:
                got, found = new(x), self.runs.get  # the cache may have been turned over
            known.append(got)
        ids = np.frombuffer(b"".join([x[0] for x in known]), "<u4")
        ends = np.cumsum(np.frombuffer(b"".join([x[1] for x in known]), "<u4").astype(np.int64))
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        if source is None:
            added = 1 if self.prefix and text else 0
            starts, ends = np.maximum(starts - added, 0), np.maximum(ends - added, 0)
            if MARK in text:
                starts, ends = self._wide_marks(text, starts, ends)
        else:
            last = int(source[-1])
            nxt = np.concatenate([source[1:][np.searchsorted(source, source[:-1], "right") - 1], [last]])
            starts, ends = source[starts], np.where(ends > starts, nxt[np.maximum(ends - 1, 0)], source[starts])
        size = int(ends[-1]) if len(ends) else 0
        spans = np.stack([np.concatenate([[0], starts, [size]]), np.concatenate([[0], ends, [size]])], 1)
        joined = "".join([x[2] for x in known])
        if joined.startswith(" ") and (self.prefix or self.squeeze):
            joined = joined[1:]
        return np.concatenate([[self.begin], ids, [self.end]]).astype(np.uint32), spans, joined

    @staticmethod
    def _wide_marks(text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets where the text itself held space marks of three bytes."""
        size = [3 if c == MARK else 0 for c in text]
        plain = np.cumsum([0, *[1 if s else len(c.encode("utf-8", "replace")) for s, c in zip(size, text)]])
        real = np.cumsum([0, *[s or len(c.encode("utf-8", "replace")) for s, c in zip(size, text)]])
        shift = lambda at: real[k := np.searchsorted(plain, at, "right") - 1] + at - plain[k]
        return shift(starts), shift(ends)

    # -- decoding -----------------------------------------------------------
    def _decode(self, ids) -> str:
        out, held = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == 6:
                held.append(int(self.pieces[i][3:5], 16))
                continue
            if held:
                out.append(decode_bytes(bytes(held)))
                held.clear()
            if i is not None and self.kinds[i] == 2:
                out.append(" ⁇ ")
            elif i is not None and self.kinds[i] != 3:
                out.append(self.pieces[i].replace(MARK, " "))
        return "".join(out)

    def decode(self, ids) -> str:
        """The text of a list of ids."""
        text = self._decode(ids)
        return text[1:] if text.startswith(" ") and (self.prefix or self.squeeze) else text


RUNS = re.compile(r" *[^ ]+| +").findall


def decode_bytes(raw: bytes) -> str:
    """UTF-8, with U+FFFD for every byte that belongs to no valid character."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at:at + size].decode("utf-8"))
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def model_bytes(path: str) -> bytes:
    """The model file (half a megabyte), read once on the driver and sent with
    the tasks, so executors need no file of their own."""
    with open(path, "rb") as f:
        return f.read()


_codecs: dict[bytes, Codec] = {}


def worker_codec(model: bytes) -> Codec:
    """The codec of this model, made once in a Python worker, so that tasks
    share its cache of runs."""
    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def encode_documents(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ids (array<long>), span_starts and span_ends (byte offsets in
    the original text), and the decoded text."""
    model = model_bytes(model_path)

    def make():
        codec = worker_codec(model)

        def work(block: TextBlock) -> list[pa.Array]:
            got = [codec.encode(t) for t in block.texts()]
            return [pa.array([g[0].astype(np.int64) for g in got], pa.list_(pa.int64())),
                    pa.array([g[1][:, 0] for g in got], pa.list_(pa.int64())),
                    pa.array([g[1][:, 1] for g in got], pa.list_(pa.int64())),
                    pa.array([g[2] for g in got], pa.string())]
        return work

    return map_text(df, text_col, [id_col], [("ids", "array<bigint>"), ("span_starts", "array<bigint>"),
                                             ("span_ends", "array<bigint>"), ("decoded", "string")], make)


def digest_documents(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same encoding, as digests taken in the task that encodes:
    n_tokens, ids_sha256, decoded_sha256 and spans_crc32 (of the end offsets
    as little-endian 64-bit integers)."""
    model = model_bytes(model_path)

    def make():
        codec = worker_codec(model)

        def work(block: TextBlock) -> list[pa.Array]:
            n, ids_hash, text_hash, spans_hash = [], [], [], []
            for text in block.texts():
                ids, spans, decoded = codec.encode(text)
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_hash.append(hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest())
                spans_hash.append(zlib.crc32(np.ascontiguousarray(spans[:, 1], "<i8").tobytes()))
            return [pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string()),
                    pa.array(spans_hash, pa.int64())]
        return work

    return map_text(df, text_col, [id_col], [("n_tokens", "bigint"), ("ids_sha256", "string"),
                                             ("decoded_sha256", "string"), ("spans_crc32", "bigint")], make)
