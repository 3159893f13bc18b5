"""Token scorers: (key, sid, pos, word, start, end) -> the same with logprob and entropy."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.lineage import cut


def lexicon(tokens: DataFrame, table: DataFrame, default: float = -2.0) -> DataFrame:
    """Scores from a table (token, logprob, entropy), looked up in lower case; the default for words it doesn't hold.

    A token given several times in other letter case counts with its greatest
    logprob. Whether the table is broadcast is left to its size.
    """
    t = table.where("token is not null").groupBy(F.lower("token").alias("_w")).agg(F.max_by(F.struct("logprob", "entropy"), "logprob").alias("_s"))
    t = t.select("_w", "_s.logprob", "_s.entropy")
    out = tokens.withColumn("_w", F.lower("word")).join(t, "_w", "left").drop("_w")
    return out.withColumn("logprob", F.coalesce("logprob", F.lit(float(default))))


#: Words that make up at least this share of all words are looked up by broadcast: at most 1 / HEAD of them.
HEAD = 1e-5


def unigram(tokens: DataFrame) -> DataFrame:
    """Our own scorer: the natural log of a word's share of all words of the corpus; no entropy.

    A few words make up most tokens and would be hot keys of a join: the head
    of the vocabulary, bounded by share, is broadcast, only the tail is joined.
    """
    counts = cut(tokens.groupBy(F.lower("word").alias("_w")).agg(F.count("*").alias("_n")))
    total = (counts.agg(F.sum("_n")).first()[0] or 0) or 1
    share = counts.select("_w", F.log(F.col("_n") / F.lit(total)).alias("logprob"), (F.col("_n") >= F.lit(HEAD * total)).alias("_head"))
    out = tokens.withColumn("_w", F.lower("word")).join(F.broadcast(share.where("_head").select("_w", F.col("logprob").alias("_often"))), "_w", "left")
    tail = out.where("_often is null").join(share.where("not _head").select("_w", "logprob"), "_w")
    rows = out.where("_often is not null").withColumn("logprob", F.col("_often")).unionByName(tail)
    return rows.drop("_w", "_often").withColumn("entropy", F.lit(None).cast("double"))


def blake2_unit(text: str, person: bytes = b"") -> float:
    """The 8-byte BLAKE2b hash of a string as a number in [0, 1)."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8"), digest_size=8, person=person).digest(), "big") / float(2**64)


def stub(tokens: DataFrame, seed: int = 0, bias: float = 1.0, spread: float = 4.0) -> DataFrame:
    """Pseudo-scores from hashes of the words in lower case. Row-local: each batch hashes its distinct words once."""
    if spread < 0:
        raise ValueError("spread must not be negative")

    @F.pandas_udf("logprob double, entropy double")
    def score(w: pd.Series) -> pd.DataFrame:
        code, words = pd.factorize(w)
        lp = np.array([-(bias + spread * blake2_unit(f"{seed}:{x}", b"logprob\0")) for x in words])
        en = np.array([0.5 + 4.0 * blake2_unit(f"{seed}:{x}", b"entropy\0") for x in words])
        return pd.DataFrame({"logprob": lp[code], "entropy": en[code]})

    return tokens.withColumn("_s", score(F.lower("word"))).select("*", "_s.logprob", "_s.entropy").drop("_s")


def make(spec: str, **options):
    """'none', 'stub', 'unigram' or 'lexicon' as a function of tokens; anything else is an error."""
    if spec == "none":
        return None
    if spec in ("stub", "unigram", "lexicon"):
        return lambda tokens: globals()[spec](tokens, **options)
    if spec.startswith("hf:"):
        raise RuntimeError("language-model scorers need the optional transformers package")
    raise ValueError(f"unknown scorer: {spec}")


def attribute(tokens: DataFrame, sents: DataFrame, key: str) -> DataFrame:
    """Tokens of any scorer (key, start, end, ...) with `sid`: the sentence whose span holds the token's midpoint; tokens that no sentence holds are left out.

    sents: (key, sid, start, end) without overlaps. No join of tokens with
    sentences: both are put in order of place once per text, and each token
    takes the last sentence that starts at or before its midpoint.
    """
    mid = (F.col("start") + F.col("end")) / 2.0
    names = [c for c in tokens.columns if c not in (key, "sid")]
    t = tokens.select(key, mid.alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_sid"), F.lit(None).cast("double").alias("_end"), F.struct(*names).alias("_t"))
    s = sents.select(key, F.col("start").cast("double").alias("_at"), F.lit(0).alias("_kind"), F.col("sid").cast("int").alias("_sid"), F.col("end").cast("double").alias("_end"), F.lit(None).cast(t.schema["_t"].dataType).alias("_t"))
    w = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_kind") == 0, F.struct("_sid", "_end")), ignorenulls=True).over(w)
    return t.unionByName(s).withColumn("_s", last).where("_kind = 1 and _at < _s._end").select(key, F.col("_s._sid").alias("sid"), "_t.*")


def external(predict, tokens_type: str = "array<struct<text:string,start:int,end:int,logprob:double,entropy:double>>"):
    """A scorer from a function of a list of texts that gives each text's tokens (text, start, end, logprob, entropy), as dicts.

    Gives a function of (df, key, text) that returns (key, sid, pos, word,
    start, end, logprob, entropy); tokens, which may be parts of words, are
    attributed to sentences by their midpoints. This is where a language model
    is plugged in: predict gets a whole Arrow batch of texts.
    """
    @F.pandas_udf(tokens_type)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(predict(["" if t is None else t for t in texts]), dtype=object)

    def score(df: DataFrame, key: str, text: str = "text") -> DataFrame:
        toks = df.select(F.col(key), F.posexplode(run(F.col(text))).alias("pos", "t")).select(key, "pos", F.col("t.text").alias("word"), "t.start", "t.end", "t.logprob", "t.entropy")
        return attribute(toks, tx.explode_sentences(df, key, text).drop("sentence"), key)

    return score


def sentence_statistics(tokens: DataFrame, key: str) -> DataFrame:
    """(key, sid, n_tokens, mean_logprob, mean_surprisal_bits, perplexity) of each sentence that has tokens."""
    return tokens.groupBy(key, "sid").agg(F.count("*").alias("n_tokens"), F.avg("logprob").alias("mean_logprob"), F.avg(-F.col("logprob") / F.log(F.lit(2.0))).alias("mean_surprisal_bits")).withColumn("perplexity", F.exp(-F.col("mean_logprob")))


def surprisal_series(tokens: DataFrame, key: str) -> DataFrame:
    """(key, series): each text's tokens in order with their surprisal in bits."""
    item = F.struct("start", "end", F.col("word").alias("text"), (-F.col("logprob") / F.log(F.lit(2.0))).alias("surprisal_bits"))
    return tokens.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("series"))
