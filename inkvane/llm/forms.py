"""Problem 3: one consistent form for every text, and records that read the same."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import codepoints as cp
from . import textform


def consistent_form(df: DataFrame, text: str = "text", out: str = "form") -> DataFrame:
    """df with a column `out`: the consistent form of column `text` (see textform).

    Null stays null and an empty text stays empty; a text of unseen signs only
    becomes empty. A column already named `out` is replaced. Only the text goes
    through Python; all other columns stay in the JVM.
    """

    @F.pandas_udf("string")
    def form(s):  # an Arrow batch in, whole-batch numpy inside
        return textform.form_column(pa.array(s, pa.large_string(), from_pandas=True)).to_pandas()

    return df.withColumn(out, form(F.col(text)))


def _hashes(batches, shortest=0):
    kinds = textform.tables().cls
    for batch in batches:
        texts = batch.column(1)
        for a, b in cp.slices(texts):
            cps, off, valid = cp.decode(texts.slice(a, b - a))
            fc, fo = textform.form(cps, off)
            seen = textform._has(fc > 0x20, fo) & valid  # has a sign that is seen
            if shortest:  # signs of the compared form; U+0130 becomes two there
                signs = np.concatenate(([0], np.cumsum((kinds[fc] > 0) + (fc == 0x130), dtype=np.int64)))
                seen &= signs[fo[1:]] - signs[fo[:-1]] >= shortest
            ids = batch.column(0).slice(a, b - a)
            arrays = [ids] + [pa.array(x.view(np.int64)) for x in (cp.row_hash(fc, fo, 1), cp.row_hash(fc, fo, 2), cp.row_hash(cps, off, 3))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "f1", "f2", "raw"]).filter(pa.array(seen))


def form_hashes(df: DataFrame, key: str = "id", text: str = "text", shortest: int = 0) -> DataFrame:
    """(id, f1, f2, raw): a 128-bit hash of each text's form and a 64-bit hash of the text as stored.

    Rows with a null id, and texts that are null, have nothing to be seen or
    whose compared form has fewer than `shortest` signs, give no row.
    """
    src = df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    return src.mapInArrow(lambda batches: _hashes(batches, shortest), "id string, f1 long, f2 long, raw long")


def same_form_pairs(df: DataFrame, key: str = "id", text: str = "text", shortest: int = 0) -> DataFrame:
    """(id_a, id_b): pairs of distinct ids, id_a < id_b, whose texts differ as stored but have one form.

    An id delivered several times counts once. Equal strings are no pair, and
    texts of fewer than `shortest` signs in compared form take no part. The
    ways in which a form is stored are paired first, each once, whatever the
    number of its copies; only then come the ids of either, so that a group of
    exact copies gives rows only for its partners stored in other characters.
    Forms stored in one way only are dropped before any join. All texts are
    hashed once, and the hashes are written to the checkpoint folder.
    """
    h = cut(form_hashes(df, key, text, shortest).groupBy("f1", "f2", "raw", "id").agg(F.lit(1).alias("one")).drop("one"))
    ways = h.groupBy("f1", "f2", "raw").agg(F.lit(1).alias("one")).drop("one")
    kinds = ways.groupBy("f1", "f2").agg(F.count("*").alias("n")).where("n > 1").select("f1", "f2")
    ways = ways.join(kinds, ["f1", "f2"], "left_semi")
    pairs = ways.withColumnRenamed("raw", "raw_a").join(ways.withColumnRenamed("raw", "raw_b"), ["f1", "f2"]).where("raw_a <> raw_b")
    a = h.select("f1", "f2", F.col("raw").alias("raw_a"), F.col("id").alias("id_a"))
    b = h.select("f1", "f2", F.col("raw").alias("raw_b"), F.col("id").alias("id_b"))
    both = pairs.join(a, ["f1", "f2", "raw_a"]).join(b, ["f1", "f2", "raw_b"])
    return both.where("id_a < id_b").select("id_a", "id_b").distinct()
