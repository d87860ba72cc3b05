"""Line dedup: keep bitmaps from a range-partitioned stream of line hashes.

1. Every line whose key (stripped, A-Z lower-cased) is long enough gives one
   narrow record (128-bit hash of the key, document, position); no text moves.
   The records are written once, as the range exchange reads its input twice.
2. Records are range-partitioned by (hash, document) and sorted by hash, then
   document from the largest down, then position.  As the document is part of
   the range key, a line that a third of all documents hold is spread over
   many partitions.
3. One pass per partition streams the runs of equal hashes: the first document
   of a run is the one that keeps its lines; once enough further documents
   have come by, the others' lines are dropped.  Only a partition's first run,
   and its last one if still undecided, may be part of a longer run; their
   rows stay open and are settled with a table of run totals, which has at
   most two rows per partition.
4. Dropped positions are gathered per document into a compressed bitmap
   (1 = keep) and applied to the texts.

Defined results: a null or empty text is one empty line, which is kept.  Rows
with one doc_id count as one document; a null doc_id counts as a document
below all others.  Repeated rows get equal results.  Very long texts are split
whole.  An empty table gives an empty result.  Only ``id_col`` and ``text_col``
are read; columns named as the appended ones are replaced by ``apply_bitmaps``
and ``dedup_lines`` and kept by ``cut``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rollbook.llm.common import small_batches, spread, stored, text_of

# The characters stripped at both ends of a line's key.
STRIPPED = " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DROP, OPEN, TOTAL = 0, 1, 2


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def _line_records(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc, tk, pos) of every line with a key of ``min_chars`` or
    more; tk tells texts of rows with one id apart."""
    text = text_of(text_col)
    lines = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("tk"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keys = lines.select("doc", "tk", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc", "tk", "pos")


def _stream(batches, min_docs: int):
    """The rows of one partition, sorted, to DROP, OPEN and TOTAL rows."""
    run, first, is_first, docs, last, pending = None, None, True, 0, None, []

    def close(at_end: bool):
        # A run that lies within the partition and is too short is kept.
        if run is None:
            return []
        out = [(OPEN, *r, 0) for r in pending] if at_end and not is_first else []
        if is_first or at_end:
            out.append((TOTAL, *run, first, 0, 0, docs))
        return out

    names = ["kind", "h1", "h2", "doc", "tk", "pos", "n"]
    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            h1, h2, doc, tk, pos = row
            if run != (h1, h2):
                out += close(at_end=False)
                is_first = run is None
                run, first, docs, last, pending = (h1, h2), doc, 1, doc, []
            elif doc != last:
                docs, last = docs + 1, doc
            if is_first:
                out.append((OPEN, *row, 0))
            elif docs >= min_docs:
                if pending:
                    out += [(DROP, *r, 0) for r in pending if r[2] != first]
                    pending = []
                if doc != first:
                    out.append((DROP, *row, 0))
            else:
                pending.append(row)
        if out:
            yield _batch(out, names)
    if out := close(at_end=True):
        yield _batch(out, names)


def _batch(rows, names):
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, tk, pos) of every line to drop."""
    small_batches(docs.sparkSession)
    records = stored(_line_records(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col, min_chars), "line-records")
    order = [F.asc("h1"), F.asc("h2"), F.desc_nulls_last("doc")]
    dealt = records.repartitionByRange(spread(docs.sparkSession), *order).sortWithinPartitions(*order, "tk", "pos")
    schema = "kind int, h1 long, h2 long, doc long, tk long, pos int, n long"
    streamed = stored(dealt.mapInArrow(lambda batches: _stream(batches, min_docs), schema), "line-runs")
    # At most two rows per range partition; written, so that Spark knows their size: small ones are broadcast
    # and the open rows stay where they are, large ones take a sort-merge join.
    totals = stored(streamed.where(F.col("kind") == TOTAL).groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("doc").alias("top"))
                    .where(F.col("docs") >= min_docs), "line-totals")
    settled = (streamed.where(F.col("kind") == OPEN).join(totals, ["h1", "h2"])
               .where(~F.col("doc").eqNullSafe(F.col("top"))))
    return streamed.where(F.col("kind") == DROP).select("doc", "tk", "pos").unionByName(settled.select("doc", "tk", "pos"))


@F.udf(T.BinaryType(), useArrow=True)
def _packed(positions):
    keep = np.ones((max(positions) // 8 + 1) * 8, dtype=np.uint8)  # whole bytes
    keep[positions] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def keep_bitmaps(docs: DataFrame, **options) -> DataFrame:
    """``doc``, ``tk``, ``n_dropped`` and ``keep`` (zlib-compressed bits, 1 =
    keep, first line first; lines beyond the last bit are kept) of each
    document that loses lines."""
    gathered = dropped_lines(docs, **options).groupBy("doc", "tk").agg(F.collect_set("pos").alias("gone"))
    return gathered.select("doc", "tk", F.size("gone").alias("n_dropped"), _packed("gone").alias("keep"))


def _apply(batches, at: int):
    """Column ``at`` is the text, the last one the bitmap; gives the columns
    before the bitmap with the text cut, then n_lines and n_dropped."""
    for batch in batches:
        texts, n_lines, n_dropped = [], [], []
        for text, bits in zip(batch.column(at), batch.column(batch.num_columns - 1)):
            text, bits = text.as_py() or "", bits.as_py()
            n_lines.append(text.count("\n") + 1)
            if bits is None:
                texts.append(text)
                n_dropped.append(0)
                continue
            lines = text.split("\n")
            keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), dtype=np.uint8)).tolist()
            kept = [x for x, bit in zip(lines, keep) if bit] + lines[len(keep):]
            n_dropped.append(len(lines) - len(kept))
            texts.append("\n".join(kept))
        columns = list(batch.columns[:-1])
        columns[at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                                         names=[*batch.schema.names[:-1], "n_lines", "n_dropped"])


def _applied(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns of ``docs`` as c0, c1, ... with dropped lines cut from the
    text, then n_lines and n_dropped."""
    small_batches(docs.sparkSession)
    names = docs.columns
    kinds = docs.schema.fields
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at, key = names.index(text_col), f"c{names.index(id_col)}"
    joined = (plain.withColumn("tk_", F.xxhash64(text_of(f"c{at}")))
              .join(bitmaps.select("doc", "tk", "keep"), F.col(key).eqNullSafe(F.col("doc")) & (F.col("tk_") == F.col("tk")), "left")
              .select(*plain.columns, "keep"))
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kinds)),
                           T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(lambda batches: _apply(batches, at), schema)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with dropped lines cut from the text, and ``__n_lines`` (before
    the cut) and ``__n_dropped`` appended."""
    added = ["__n_lines", "__n_dropped"]
    own = [c for c in docs.columns if c not in added]
    return _applied(docs.select(*own), bitmaps, id_col, text_col).toDF(*own, *added)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Bitmaps made and applied."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col=id_col, text_col=text_col, **options), id_col, text_col)


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The columns of ``docs``, whatever their names, with the texts cut."""
    done = _applied(docs, keep_bitmaps(docs, id_col=id_col, text_col=text_col, **options), id_col, text_col)
    return done.select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)
