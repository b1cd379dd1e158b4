"""Removing lines that repeat across documents.

Lines are normalised (A to Z in lower case, runs of white space as one space) and hashed; digests are
grouped over the whole corpus.  Of each the earliest occurrence, by document and then by line, stays
and all others go.  Shorter lines than `words` words stay, and with 0 only lines without any character: words
are told apart by spaces, so a bound also keeps all lines of scripts that have none.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def repeated_lines(docs: DataFrame, words: int = 8) -> DataFrame:
    """doc_id and line (from 0) of every line that goes.

    The groups are counted before they are shuffled, and only digests that occur twice are joined
    back; that join is on written tables, so a digest of a third of all lines is split among tasks."""
    line = F.trim(F.regexp_replace(F.translate("line", UPPER, LOWER), SPACE, " "))
    lines = common.documents(docs).where("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    hashed = lines.select("doc_id", "at", line.alias("line")).where(F.size(F.split("line", " ", -1)) >= words if words else F.length("line") > 0).select("doc_id", "at", F.unhex(F.md5("line")).alias("digest"))
    hashed = common.staged(hashed, "lines")
    first = hashed.groupBy("digest").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    first = common.staged(first, "repeats")
    return hashed.join(first, "digest").where("doc_id <> first.doc_id or at <> first.at").select("doc_id", F.col("at").alias("line")).distinct()


def without_repeats(docs: DataFrame, words: int = 8) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (spans of code points in the original text, start and end
    exclusive, without line feeds) and text (what remains, joined by line feeds).

    A null text stays null and has no lines.  Rows without an id keep all their lines and don't count
    for others.  Rows that repeat an id are the same document: they lose the same lines.  Empty tables
    give no row; other columns are ignored."""
    gone = repeated_lines(docs, words).groupBy("doc_id").agg(F.collect_list("line").alias("gone"))

    def cut(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                texts, removed, total = [], [], []
                for text, gone in zip(part.column("text").to_pylist(), part.column("gone").to_pylist()):
                    lines = text.split("\n") if text is not None else []
                    total.append(len(lines))
                    if not gone:
                        texts.append(text)
                        removed.append([])
                        continue
                    out, kept, spans, at = set(gone), [], [], 0
                    for i, line in enumerate(lines):
                        if i in out:
                            spans.append({"start": at, "end": at + len(line)})
                        else:
                            kept.append(line)
                        at += len(line) + 1
                    texts.append("\n".join(kept))
                    removed.append(spans)
                cols = [part.column("doc_id"), pa.array(total, pa.int64()), pa.array([len(s) for s in removed], pa.int64()), pa.array(removed, span), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_lines", "n_removed", "removed", "text"])

    joined = common.documents(docs).join(gone, "doc_id", "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(cut, "doc_id long, n_lines long, n_removed long, removed array<struct<start:long,end:long>>, text string")
