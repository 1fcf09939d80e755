"""Fill-in-middle texts: a document is cut at two of its tokens and its parts change places behind sentinels.

Tokens are runs of A-Z and a-z, and every other code point by itself. Where tokens start, and where code points start, is
a vector of packed bits over the bytes of the text, with a directory of popcounts, one for each block of bits. The
popcount of all is the number of tokens n; two ranks from a hash of the id, drawn from 0 to n, are selected for byte cuts;
the rank of a cut among code points is its place in characters. The vectors live for one text of an Arrow batch, and only
the hashes and the cuts go with the text; Spark's functions cut, join, digest and rebuild. No row moves: there is no shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table
from .words import texts_of

#: Bits of a block of the directory.
BLOCK = 512
#: What stands before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
_NONE = np.zeros(1, np.int64)


class Bits:
    """Packed bits with the number of ones before every block."""

    def __init__(self, flags: np.ndarray):
        packed = np.packbits(flags, bitorder="little")
        whole = np.zeros(-(-len(packed) * 8 // BLOCK) * BLOCK // 8, np.uint8)
        whole[: len(packed)] = packed
        self.words = whole.view(np.uint64)
        self.size = len(flags)
        per = np.bitwise_count(self.words).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([_NONE, np.cumsum(per)])

    def _block(self, k: int) -> np.ndarray:
        return self.words[k * BLOCK // 64 : (k + 1) * BLOCK // 64]

    def total(self) -> int:
        return int(self.before[-1])

    def rank(self, place: int) -> int:
        """Ones before a place, of 0 to the number of bits."""
        k, rest = divmod(place, BLOCK)
        if not rest:
            return int(self.before[k])
        block = self._block(k)
        last = block[rest // 64] & np.uint64((1 << rest % 64) - 1)
        return int(self.before[k]) + int(np.bitwise_count(block[: rest // 64]).sum()) + int(np.bitwise_count(last))

    def select(self, rank: int) -> int:
        """The place of the one that has `rank` ones before it; the number of bits where there is none."""
        if rank >= self.total():
            return self.size
        k = int(np.searchsorted(self.before, rank, side="right")) - 1
        ones = np.flatnonzero(np.unpackbits(self._block(k).view(np.uint8), bitorder="little"))
        return k * BLOCK + int(ones[rank - int(self.before[k])])


def boundaries(text: bytes) -> tuple[Bits, Bits]:
    """Where tokens start, and where code points start, in UTF-8 bytes."""
    data = np.frombuffer(text, np.uint8)
    starts = (data & 0xC0) != 0x80
    letters = ((data | 0x20) - np.uint8(97)) < 26
    tokens = starts.copy()
    tokens[1:] &= ~(letters[1:] & letters[:-1])
    return Bits(tokens), Bits(starts)


def cut(text: bytes | None, h1: int, h2: int) -> tuple[int, int, int, int, int]:
    """Number of tokens, byte ends of prefix and middle, code points of prefix and of middle."""
    if not text:
        return 0, 0, 0, 0, 0
    tokens, points = boundaries(text)
    n = tokens.total()
    first, second = (tokens.select(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix = points.rank(first)
    return n, first, second, prefix, points.rank(second) - prefix


_CUTS = ("n", "first", "second", "prefix_chars", "middle_chars")


def cuts(text: Column, h1: Column, h2: Column) -> Column:
    """cut() of a text column, as a struct."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf(", ".join(f"{c} long" for c in _CUTS))
    def found(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        rows = [cut(t, a, b) for t, a, b in zip(texts_of(texts), one.to_pylist(), two.to_pylist(), strict=True)]
        columns = np.array(rows, np.int64).reshape(-1, len(_CUTS)).T
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], list(_CUTS))

    return found(text, h1, h2)


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Sentinels must not be part of each other, nor end as another (or the same) begins: else a text could make one at a seam."""
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            if not a or i != j and a in b or any(b.startswith(a[k:]) for k in range(1, len(a))):
                raise ValueError(f"sentinels {a!r} and {b!r} overlap")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of a form was made from; no text has sentinels in it unless its form is plain."""
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs with n (tokens), form, prefix_chars, middle_chars and output added.

    h1 to h4 are the first four groups of eight digits of the hex SHA-256 of seed:id. Prefix ends after the smaller of h1
    % (n + 1) and h2 % (n + 1) tokens, middle after the larger, suffix is the rest. Form is plain for an empty text, for one
    that holds a sentinel, and where h3 % 100 >= 100 - plain_percent; else spm where h4 % 100 < spm_percent, else psm. The output of
    plain is the text itself, and its two lengths are null.

    A null text is the empty text; a null id is the empty id, so all such rows draw the same hashes. Rows that repeat are
    transformed each, alike. Texts of any length are cut whole. Columns of docs named as one of the five new ones give way,
    but for id and text, which the operator needs (it raises ValueError there). An empty table gives an empty result.
    """
    check_sentinels(sentinels)
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    if {id_col.lower(), text_col.lower()} & set(made):
        raise ValueError("id and text must not be named as a new column is")
    kept = [c for c in docs.columns if c.lower() not in made]
    text_at, digest_at, cut_at = fresh(docs, "of_text", "of_digest", "of_cuts")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = lambda i: F.conv(F.substring(digest_at, 1 + 8 * i, 8), 16, 10).cast("long")
    rows = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias(text_at), digest.alias(digest_at))
    rows = rows.withColumn(cut_at, cuts(F.col(text_at), h(0), h(1)))
    text, at = F.col(text_at), lambda name: F.col(f"{cut_at}.{name}")
    plain = (text == "") | (h(2) % 100 >= 100 - plain_percent)
    for s in sentinels:
        plain = plain | F.contains(text, F.lit(s))
    form = F.when(plain, "plain").when(h(3) % 100 < spm_percent, "spm").otherwise("psm")
    data = F.encode(text, "UTF-8")
    piece = lambda start, size: F.decode(F.substring(data, start, size), "UTF-8")
    prefix, middle = piece(F.lit(1), at("first").cast("int")), piece(at("first").cast("int") + 1, (at("second") - at("first")).cast("int"))
    suffix = piece(at("second").cast("int") + 1, (F.octet_length(text) - at("second")).cast("int"))
    p, s, m = map(F.lit, sentinels)
    form_at, *_ = fresh(rows, "of_form")
    rows = rows.withColumn(form_at, form)
    output = F.when(F.col(form_at) == "plain", text).when(F.col(form_at) == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    unless_plain = lambda name: F.when(F.col(form_at) != "plain", at(name)).alias(name)
    return rows.select(*kept, at("n").alias("n"), F.col(form_at).alias("form"), unless_plain("prefix_chars"), unless_plain("middle_chars"), output.alias("output"))


def op11_fill_in_middle(spark, sf_dir):
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS k, sha256('1:' || doc_id) AS s FROM documents),
h AS (
  SELECT doc_id, t, k, len(k) AS n,
         ('0x' || s[1:8])::BIGINT % (len(k) + 1) AS h1, ('0x' || s[9:16])::BIGINT % (len(k) + 1) AS h2,
         ('0x' || s[17:24])::BIGINT % 100 AS h3, ('0x' || s[25:32])::BIGINT % 100 AS h4
  FROM d),
c AS (
  SELECT doc_id, t, n, array_to_string(k[1:least(h1, h2)], '') AS p, array_to_string(k[least(h1, h2) + 1:greatest(h1, h2)], '') AS m,
         array_to_string(k[greatest(h1, h2) + 1:], '') AS x,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""
