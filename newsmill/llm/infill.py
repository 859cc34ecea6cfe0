"""Fill-in-the-middle transformation over a compressed set of token boundaries.

A text's token boundaries are kept as a set in the manner of Roaring bitmaps:
containers of 65,536 places each, an array, a bitmap or runs, whichever is
smallest, with cumulative cardinalities.  The k-th boundary is found by a search
for its container and a select inside it, so both cuts of a document cost two
lookups however many tokens it has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsmill.llm.common import id_and_text, ship, table

PLACES = 1 << 16
#: An array of more 16-bit places than this is larger than a bitmap.
ARRAY_MOST = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of 100 documents so many are transformed, and of 100 of these so many with the suffix first.
RATE, SPM_RATE = 50, 80
_CUTS = "n long, first long, second long"


def _bits(places: np.ndarray) -> np.ndarray:
    flags = np.zeros(PLACES, dtype=np.uint8)
    flags[places] = 1
    return np.packbits(flags, bitorder="little")


class BoundarySet:
    """Growing offsets from 0 to a text's length, with select."""

    def __init__(self) -> None:
        self._containers: list[tuple] = []
        self._cardinality: list[int] = []

    def append(self, high: int, places: np.ndarray) -> None:
        """The sorted 16-bit ``places`` of the container ``high``; containers come in rising order."""
        if not len(places):
            return
        breaks = np.flatnonzero(np.diff(places) != 1) + 1
        starts = np.concatenate(([0], breaks))
        if 4 * len(starts) < min(2 * len(places), PLACES // 8):
            container = ("runs", places[starts].astype(np.uint16), starts.astype(np.uint16))
        elif len(places) <= ARRAY_MOST:
            container = ("array", places.astype(np.uint16))
        else:
            bits = _bits(places)
            container = ("bitmap", bits, np.cumsum(np.bitwise_count(bits), dtype=np.int64))
        self._containers.append((high, *container))
        self._cardinality.append(len(places))

    def close(self) -> None:
        self._cumulative = np.cumsum(self._cardinality, dtype=np.int64)

    def __len__(self) -> int:
        return int(self._cumulative[-1]) if len(self._cumulative) else 0

    def select(self, k: int) -> int:
        """The k-th offset, counted from 0."""
        at = int(np.searchsorted(self._cumulative, k, side="right"))
        high, kind, *data = self._containers[at]
        k -= int(self._cumulative[at - 1]) if at else 0
        if kind == "array":
            low = int(data[0][k])
        elif kind == "runs":
            run = int(np.searchsorted(data[1], k, side="right")) - 1
            low = int(data[0][run]) + k - int(data[1][run])
        else:
            byte = int(np.searchsorted(data[1], k, side="right"))
            ones = np.flatnonzero(np.unpackbits(data[0][byte : byte + 1], bitorder="little"))
            low = 8 * byte + int(ones[k - (int(data[1][byte - 1]) if byte else 0)])
        return high * PLACES + low


def token_boundaries(text: str) -> BoundarySet:
    """0 and each token's end; a token is a word with the blanks before it, or the blanks at the end."""
    found, size = BoundarySet(), len(text)
    for start in range(0, size + 1, PLACES):
        part = np.frombuffer(text[max(0, start - 1) : start + PLACES].encode("utf-32-le"), dtype=np.uint32)
        blank = (part == 0x20) | ((part >= 0x09) & (part <= 0x0D))
        if start == 0:
            blank = np.concatenate(([True], blank))
        before, here = blank[:-1], blank[1:]
        ends = ~before & here
        if size < start + PLACES:  # the text's end is a boundary whatever stands before it
            ends = np.concatenate((ends, [True]))
        if start == 0:
            ends[0] = True
        found.append(start // PLACES, np.flatnonzero(ends))
    found.close()
    return found


def _cut_places(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    n, a, b = [], [], []
    for text, x, y in zip(texts, first, second):
        ends = token_boundaries(text.as_py() or "")
        n.append(len(ends) - 1)
        low, high = sorted(draw.as_py() % len(ends) for draw in (x, y))
        a.append(ends.select(low))
        b.append(ends.select(high))
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (n, a, b)], ["n", "first", "second"])


def _draws(doc_id: Column, seed: int) -> Column:
    """Four keyed numbers below 2^32; a null id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.transform(F.array(*[F.substring(digest, 8 * k + 1, 8) for k in range(4)]), lambda h: F.conv(h, 16, 10).cast("long"))


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): one row per row of ``docs``, without a shuffle.

    The text's n tokens are cut at two places drawn from the id.  Form is plain,
    and output the text itself, for texts that are empty or hold a marker and
    for those the ``rate`` passes over; else spm or psm, with the parts in that
    order behind their markers.  prefix_chars and middle_chars are code points,
    null for plain ones.

    A null text is an empty one, a null id draws like an empty id; repeated rows
    are transformed alike.  Whole texts are cut, however long: a container of
    places is built from 65,536 characters at a time.  Other columns are not
    read, so their names may be any; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    cuts = F.arrow_udf(_cut_places, _CUTS)
    d = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    d = d.withColumn("h", _draws(F.col("doc_id"), seed))
    d = d.withColumn("cut", cuts("text", F.col("h")[0], F.col("h")[1]))
    marked = [F.contains("text", F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)]
    plain = (F.col("text") == "") | marked[0] | marked[1] | marked[2] | (F.col("h")[2] % 100 >= rate)
    d = d.withColumn("form", F.when(plain, "plain").when(F.col("h")[3] % 100 < spm_rate, "spm").otherwise("psm"))
    first, second = F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    prefix = F.substr("text", F.lit(1), first)
    middle = F.substr("text", first + 1, second - first)
    suffix = F.substr("text", second + 1)
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text"))
    )
    moved = F.col("form") != "plain"
    return d.select(
        "doc_id", F.col("cut.n").alias("n"), "form", F.when(moved, F.col("cut.first")).alias("prefix_chars"),
        F.when(moved, F.col("cut.second") - F.col("cut.first")).alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle made ``output`` of; a text with a marker is never moved, so each marker is there once."""
    after = lambda marker: F.position(F.lit(marker), output) + len(marker)
    between = lambda a, b: F.substr(output, after(a), F.position(F.lit(b), output) - after(a))
    psm = F.concat(between(PREFIX, SUFFIX), F.substr(output, after(MIDDLE)), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), F.substr(output, after(MIDDLE)), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fill_in_middle(table(spark, sf_dir, "documents"))
    return d.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h,
  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as t from documents),
k as (select *, len(t) as n, ('0x' || h[1:8])::bigint % (len(t) + 1) as a, ('0x' || h[9:16])::bigint % (len(t) + 1) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || h[17:24])::bigint % 100 >= 50 then 'plain'
   when ('0x' || h[25:32])::bigint % 100 < 80 then 'spm' else 'psm' end as form from d),
c as (select doc_id, n, form, text, array_to_string(t[1:least(a, b)], '') as p, array_to_string(t[least(a, b) + 1:greatest(a, b)], '') as m,
  array_to_string(t[greatest(a, b) + 1:], '') as s from k)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars, case when form <> 'plain' then length(m) end::bigint as middle_chars,
 sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else text end) as output_sha256,
 sha256(text) as restored_sha256
from c"""
