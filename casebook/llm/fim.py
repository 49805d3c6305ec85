"""Fill-in-middle transformation: a text is cut into prefix, middle and suffix
at two unit ends and written in one of three forms.

A unit is ``[white space]* [other]+``, or the white space at the end of a text,
where white space is U+0020 and U+0009 to U+000D.  So a byte ends a unit if it
is no white space and white space follows, or if it is the last of its text;
bytes of longer UTF-8 characters are never white space.

The bytes of a block of texts are viewed as 64-bit words.  Additions that do
not carry over byte edges leave a flag in the high bit of every white-space
byte, one shift by a byte (with the first byte of the next word) leaves the
unit ends; ``bitwise_count`` and a running sum give the ends before each word.
The end of a text's a-th unit is found by binary search for its word and then
inside the word, by clearing the lowest flags.  Continuation bytes are flagged
the same way, so lengths in code points come from the same ranks.

Cases: a null or empty text has no units and stays plain; a text that holds a
sentinel stays plain, since it could not be read back; white space alone is one
unit; a null id counts as the empty string in the hash; repeated rows each get
their row, with equal cuts where the ids are equal; a text of any length is
transformed whole; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, text_blocks

SEED = 42
SENTINELS = ("<P>", "<S>", "<M>")
FIM_PERCENT = 50
SPM_PERCENT = 80

ONES = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x80) * ONES
LOW = np.uint64(0x7F) * ONES
BYTE, WORD_BITS = np.uint64(8), np.uint64(56)


def words_of(data: np.ndarray) -> np.ndarray:
    """The bytes as little-endian 64-bit words, with zeros behind them."""
    padded = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
    padded[:len(data)] = data
    return padded.view("<u8")


def space_flags(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is 0x20 or 0x09 to 0x0D."""
    low = words & LOW
    tabs = (low + np.uint64(0x80 - 9) * ONES) & ~(low + np.uint64(0x80 - 14) * ONES) & ~words
    other = words ^ (np.uint64(0x20) * ONES)
    return (tabs | ~(((other & LOW) + LOW) | other)) & HIGH


class Flags:
    """Rank and select over flagged bytes (high bits of 64-bit words)."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.upto = np.cumsum(np.bitwise_count(words), dtype=np.int64)

    def before(self, at: np.ndarray) -> np.ndarray:
        """Flagged bytes before each byte position."""
        word = at >> 3
        inside = (np.uint64(1) << ((at & 7).astype(np.uint64) * BYTE)) - np.uint64(1)
        first = self.upto[word] - np.bitwise_count(self.words[word])
        return first + np.bitwise_count(self.words[word] & inside)

    def place(self, number: np.ndarray) -> np.ndarray:
        """The byte position of each flag, by its number from 1."""
        word = np.searchsorted(self.upto, number, "left")
        flags = self.words[word]
        nth = number - (self.upto[word] - np.bitwise_count(flags))
        for step in range(1, 8):
            flags = np.where(nth > step, flags & (flags - np.uint64(1)), flags)
        lowest = flags & (~flags + np.uint64(1))
        return word * 8 + (np.bitwise_count(lowest - np.uint64(1)) >> 3)


def unit_ends(words: np.ndarray, offsets: np.ndarray) -> Flags:
    space = space_flags(words)
    following = space >> BYTE
    following[:-1] |= space[1:] << WORD_BITS
    ends = following & ~space & HIGH
    last = offsets[1:][np.diff(offsets) > 0] - 1
    np.bitwise_or.at(ends, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) * BYTE))
    return Flags(ends)


def continuations(words: np.ndarray) -> Flags:
    """Bytes 10xxxxxx, which begin no character."""
    return Flags(words & ~(words << np.uint64(1)) & HIGH)


def holding(data: bytes, offsets: np.ndarray, needles: list[bytes]) -> np.ndarray:
    """Which texts hold one of the strings."""
    out = np.zeros(len(offsets) - 1, bool)
    for needle in needles:
        at = data.find(needle)
        while at >= 0:
            text = int(np.searchsorted(offsets, at, "right")) - 1
            if at + len(needle) <= offsets[text + 1]:
                out[text] = True
            at = data.find(needle, at + 1)
    return out


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Three strings none of which can begin inside another or across an edge
    of one, so that an output splits in one way only."""
    for a in sentinels:
        for b in sentinels:
            if not a or (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b) + (a != b)))):
                raise ValueError(f"sentinels overlap: {sentinels}")
    if len(set(sentinels)) != 3:
        raise ValueError(f"sentinels are not distinct: {sentinels}")


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
                   fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
                   sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Per row: the id, n (units), form (plain, psm or spm), prefix_chars and
    middle_chars (code points; null if plain) and the transformed ``output``.

    The cuts and the form come from the first four 32-bit groups of the SHA-256
    of ``seed:id``: two cuts modulo n + 1, ``fim_percent`` of the texts are
    transformed, ``spm_percent`` of these with the suffix first."""
    check_sentinels(sentinels)
    marks = [s.encode("utf-8") for s in sentinels]
    names = []
    for name in ("n", "form", "prefix_chars", "middle_chars", "output"):
        names.append(fresh(name, [id_col, *names]))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(col(id_col).cast("string"), F.lit(""))), 256)
    source = df.select(col(id_col), F.unhex(F.substring(key, 1, 32)).alias(fresh("_hash", [id_col])),
                       col(text_col).cast("string").alias(fresh("_text", [id_col])))
    kinds = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType())
    schema = T.StructType([source.schema.fields[0], *(T.StructField(n, k) for n, k in zip(names, kinds))])

    def work(block, hashes: np.ndarray) -> list[pa.Array]:
        offsets, data = block.offsets, block.data.tobytes()
        words = words_of(block.data)
        ends, inner = unit_ends(words, offsets), continuations(words)
        first = ends.before(offsets[:-1])
        n = ends.before(offsets[1:]) - first
        cuts = np.sort(hashes[:, :2] % (n + 1)[:, None], axis=1)
        plain = (n == 0) | holding(data, offsets, marks) | (hashes[:, 2] % 100 >= fim_percent)
        spm = hashes[:, 3] % 100 < spm_percent
        at = [np.where(c > 0, ends.place(np.maximum(first + c, 1)) + 1, offsets[:-1]) for c in cuts.T]
        inside = [inner.before(x) for x in (offsets[:-1], *at)]
        chars = [b - a - (y - x) for a, b, x, y in ((offsets[:-1], at[0], *inside[:2]), (*at, *inside[1:]))]
        p, s, m = marks
        output = []
        for lo, a, b, hi, whole, back in zip(offsets.tolist(), at[0].tolist(), at[1].tolist(), offsets[1:].tolist(),
                                             plain.tolist(), spm.tolist()):
            if whole:
                output.append(data[lo:hi])
            elif back:
                output.append(b"".join((s, data[b:hi], p, data[lo:a], m, data[a:b])))
            else:
                output.append(b"".join((p, data[lo:a], s, data[b:hi], m, data[a:b])))
        form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
        return [pa.array(n, pa.int64()), pa.array(form, pa.string()),
                *(pa.array(c, pa.int64(), mask=plain) for c in chars), pa.array(output, pa.string())]

    def run(batches):
        for batch in batches:
            raw = b"".join(batch.column(1).to_pylist())
            hashes = np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)
            for lo, hi, block in text_blocks(batch.column(2)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *work(block, hashes[lo:hi])],
                                                 names=schema.names)

    return source.mapInArrow(run, schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text, from an output and its form."""
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)
    return F.when(form == "plain", output).when(
        form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def fim_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The transformation with its output, and the text read back from it, as
    SHA-256 digests."""
    done = fill_in_middle(df, id_col, text_col)
    n, form, prefix, middle, output = done.columns[1:]
    return done.select(col(id_col), n, form, prefix, middle, F.sha2(output, 256).alias("output_sha256"),
                       F.sha2(restored(F.col(output), F.col(form)), 256).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM t),
c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
    greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
         WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
    array_to_string(units[b + 1:], '') AS suffix
  FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
