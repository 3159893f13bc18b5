"""Queries of the engine's own operators over the test tables, each over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import analyze, builders, decision, detector, evaluate, experiment, features, metrics, scorers, splits
from ..operators.ranges import ranked
from ..sources import files, schema
from ..sources.tables import read_table
from .lineage import cut

#: A detector of given coefficients, so that scoring can be held against SQL.
LITERAL = detector.Detector(["sent_mean_len_words", "lex_ttr", "rep_distinct_2", "style_avg_word_length"], [13.0, 0.8, 0.95, 4.0], [5.0, 0.15, 0.05, 0.7], [0.6, -0.4, 0.25, 0.8], -0.1, (1.2, 0.05))

SECOND = detector.Detector(["sent_mean_len_chars", "style_punct_char_ratio"], [70.0, 0.03], [40.0, 0.03], [0.5, 0.7], 0.2)

MOST_COMMON = 10_000


def r9(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 9) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def plain(c: str | Column) -> Column:
    return F.lower(tx.strip(F.col(c) if isinstance(c, str) else c))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents")


def _words(spark, d, offsets=False):
    return tx.explode_words(_docs(spark, d), "doc_id", offsets=offsets)


def _records(spark, d):
    """The last delivery of each id."""
    w = Window.partitionBy("id").orderBy(F.desc("loaded_at"), F.desc("row_no"))
    return read_table(spark, d, "records").where("id is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _scores(spark, d):
    """The last scoring of each sentence."""
    w = Window.partitionBy("score_id").orderBy(F.desc("scored_at"), F.desc_nulls_last("p_ai"))
    return read_table(spark, d, "sentence_scores").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _common(spark, d):
    """The lexicon's words. They become literals, so a table of more than MOST_COMMON is an error."""
    rows = read_table(spark, d, "lexicon").select(F.lower("token")).where("token is not null").distinct().limit(MOST_COMMON + 1).collect()
    if len(rows) > MOST_COMMON:
        raise ValueError(f"over {MOST_COMMON} common words")
    return [r[0] for r in rows]


def sentences(spark, d):
    return tx.explode_sentences(_docs(spark, d), "doc_id").select("doc_id", "sid", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "sentence")


def sentence_counts(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(tx.sentences(F.col("text"))).cast("long").alias("n_sentences"))


def paragraph_counts(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(tx.paragraphs(F.col("text"))).cast("long").alias("n_paragraphs"))


def words(spark, d):
    return _words(spark, d, True).select("doc_id", "sid", "pos", "word", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


def word_sentence_join(spark, d):
    return _words(spark, d).groupBy("doc_id", "sid").agg(F.count("*").alias("n_words"), F.min_by("word", "pos").alias("first_word"))


def span_round_trip(spark, d):
    """How many sentences aren't the text between their offsets: none."""
    s = tx.explode_sentences(_docs(spark, d), "doc_id").join(_docs(spark, d).select("doc_id", "text"), "doc_id")
    return s.agg(F.count("*").alias("n"), F.sum((F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")) != F.col("sentence")).cast("long")).alias("broken"))


def _features(spark, d, *groups):
    return rounded(features.statistical(_docs(spark, d).where("text is not null").select("doc_id", "text"), "text", _common(spark, d) if "style" in groups else None, groups).drop("text"))


def feat_sentence(spark, d):
    return _features(spark, d, "sentence")


def feat_lexical(spark, d):
    return _features(spark, d, "lexical")


def feat_repetition(spark, d):
    return _features(spark, d, "repetition")


def feat_style(spark, d):
    return _features(spark, d, "style")


def feat_all_statistical(spark, d):
    return _features(spark, d, "sentence", "lexical", "repetition", "style")


def feature_rollup_by_lang(spark, d):
    f = features.statistical(_docs(spark, d).where("text is not null").select("doc_id", "lang", "text"), groups=("sentence", "lexical"))
    return f.groupBy("lang").agg(F.count("*").alias("n"), *[r9(F.avg(c)).alias(f"avg_{c}") for c in ("sent_count", "sent_mean_len_words", "sent_len_words_burstiness", "lex_ttr", "lex_mattr_w50")])


def _fixed(spark, d, offsets=False):
    return scorers.lexicon(_words(spark, d, offsets), read_table(spark, d, "lexicon"))


def fixed_scores(spark, d):
    return rounded(_fixed(spark, d).select("doc_id", "sid", "pos", "word", "logprob", "entropy"))


def unigram_scores(spark, d):
    return rounded(scorers.unigram(_words(spark, d)).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"), F.max("logprob").alias("logprob")))


def stub_scores(spark, d):
    return scorers.stub(_words(spark, d)).select("doc_id", "sid", "pos", "word", "logprob", "entropy")


def feat_perplexity_fixed(spark, d):
    return rounded(features.perplexity(_fixed(spark, d), "doc_id"))


def sentence_statistics(spark, d):
    return rounded(scorers.sentence_statistics(_fixed(spark, d), "doc_id"))


def token_surprisal_series(spark, d):
    s = scorers.surprisal_series(_fixed(spark, d, True), "doc_id").select("doc_id", F.posexplode("series").alias("k", "t"))
    return s.select("doc_id", "k", F.col("t.start").alias("start_pos"), F.col("t.text").alias("token"), r9("t.surprisal_bits").alias("surprisal_bits"))


def group_hash_splits(spark, d):
    r = _records(spark, d).select("id", "group_id", "split")
    return splits.assign_splits(r, train=0.8, val=0.1, test=0.1).select("id", "group_id", "split")


def split_counts(spark, d):
    return group_hash_splits(spark, d).groupBy("split").agg(F.count("*").alias("n"))


def leakage_check(spark, d):
    return splits.leaks(_records(spark, d).withColumn("split", plain("split")))


def family_holdout(spark, d):
    r = _records(spark, d).select("id", "group_id", plain("label").alias("label"), plain("generation.model_family").alias("model_family"), "split")
    return splits.family_holdout(r, ["corvid", "onyx"]).groupBy("label", "split").agg(F.count("*").alias("n"))


def usable_docs(spark, d):
    return _docs(spark, d).where(files.usable(F.col("text"))).select("doc_id", F.length(tx.strip(F.col("text"))).cast("long").alias("n_chars"))


def round_robin_sample(spark, d):
    return builders.round_robin(_docs(spark, d).where("text is not null").select("doc_id", plain(F.coalesce("source", F.lit("?"))).alias("source")), "source", "doc_id", 100)


def balanced_boost(spark, d):
    docs = _docs(spark, d).where("text is not null and label is not null").select("doc_id", "text", plain("label").alias("label"))
    return builders.boost(docs, _records(spark, d).select("text").where("text is not null"), "doc_id", "text", "label", 60).select("doc_id", "label")


def anti_join_taken(spark, d):
    taken = _docs(spark, d).where("length(text) < 40").select("text").distinct()
    return _docs(spark, d).where("text is not null").join(taken, "text", "left_anti").select("doc_id")


def _labelled(spark, d, *groups):
    docs = _docs(spark, d).where("text is not null").select("doc_id", "text", plain("label").alias("label")).where("label in ('human', 'ai')")
    return features.statistical(docs, "text", [], groups or ("sentence", "lexical", "repetition", "style")).drop("text")


_FOUR = ["sent_mean_len_words", "lex_ttr", "rep_distinct_2", "style_avg_word_length"]


def class_distributions(spark, d):
    return rounded(detector.distributions(_labelled(spark, d).select("label", *_FOUR), _FOUR))


def scaler_stats(spark, d):
    f = _labelled(spark, d)
    long = f.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in _FOUR])).alias("v"))
    return rounded(long.groupBy("v.feature").agg(F.avg("v.x").alias("mean"), F.stddev_pop("v.x").alias("scale")))


def feature_zscores(spark, d):
    f = _labelled(spark, d)
    c = detector.compare(f, _FOUR, detector.distributions(f, _FOUR), "doc_id")
    return rounded(c.select("doc_id", "feature", "z_vs_human", "z_vs_ai", "closer_to"))


def linear_score_literals(spark, d):
    f = features.statistical(_docs(spark, d).where("text is not null").select("doc_id", "text")).drop("text")
    return f.select("doc_id", r9(LITERAL.score()).alias("score"), r9(LITERAL.probability()).alias("p_ai"))


def fold_assignment(spark, d):
    docs = _docs(spark, d).select("doc_id", plain("label").alias("label")).where("label in ('human', 'ai')")
    return detector.folds(docs, 3, "label", "doc_id").select("doc_id", "label", F.col("fold").cast("int").alias("fold"))


def _decided(spark, d):
    return decision.aggregate(_scores(spark, d).select(F.col("record_id").alias("id"), "p_ai"), "id")


def decision_rule(spark, d):
    return rounded(_decided(spark, d).drop("doc_p"), 11)


def decision_counts(spark, d):
    return _decided(spark, d).groupBy("label").agg(F.count("*").alias("n"))


def mixed_rate(spark, d):
    t = _records(spark, d).select("id", plain("label").alias("truth"))
    return rounded(evaluate.mixed_rate(_decided(spark, d).join(t, "id"), "truth", "label"))


def _judged(spark, d):
    """A probability for each pure record: the mean of its sentences' scores."""
    r = _records(spark, d).select("id", plain("label").alias("label"), plain("generation.model_family").alias("model_family"))
    return r.join(_decided(spark, d).select("id", F.round("mean_p_ai", 9).alias("p")), "id").where("label in ('human', 'ai')").withColumn("y", (F.col("label") == "ai").cast("int"))


def confusion_metrics(spark, d):
    return rounded(metrics.confusion(_judged(spark, d)))


def auroc_exact(spark, d):
    return rounded(metrics.auroc(_judged(spark, d)))


def classification_by_source(spark, d):
    j = _judged(spark, d).join(_records(spark, d).select("id", plain("source").alias("source")), "id").where("source is not null")
    return rounded(metrics.classification(j, by=["source"]).drop("threshold"))


def calibration_bins(spark, d):
    return rounded(metrics.calibration(_judged(spark, d)))


def per_family_metrics(spark, d):
    return rounded(evaluate.by_family(_judged(spark, d)))


def _sentence_truth(spark, d):
    s = _scores(spark, d).where("start_pos is not null and end_pos > start_pos")
    j = s.join(_records(spark, d).select(F.col("id").alias("record_id"), plain("label").alias("label"), "spans"), "record_id")
    return j.withColumn("y", evaluate.truth(F.col("label"), F.col("spans"), F.col("start_pos"), F.col("end_pos")))


def sentence_truth(spark, d):
    return _sentence_truth(spark, d).select("score_id", "label", "y")


def localization_metrics(spark, d):
    s = _sentence_truth(spark, d).withColumnRenamed("p_ai", "p").withColumnRenamed("start_pos", "start").withColumnRenamed("end_pos", "end")
    return rounded(evaluate.localization_metrics(s.drop("y")))


def metric_input_check(spark, d):
    return metrics.bad_inputs(_sentence_truth(spark, d), "y", "p_ai")


def rq6_corr(spark, d):
    """Two literal detectors' probabilities of every sentence, against each other and against features of the sentences."""
    sents = tx.explode_sentences(_docs(spark, d), "doc_id")
    f = cut(features.statistical(sents, "sentence", groups=("sentence", "lexical", "repetition", "style")).drop("sentence"))
    key = ["doc_id", "sid"]
    second, literal = (m.predict(f, "p").select(*key, "p") for m in (SECOND, LITERAL))
    bits = scorers.sentence_statistics(_fixed(spark, d), "doc_id").select(*key, F.col("perplexity").alias("ppl_doc_perplexity"), F.col("mean_surprisal_bits").alias("ppl_mean_surprisal_bits"))
    signals = f.join(bits, key, "left").na.fill({"ppl_doc_perplexity": 1.0, "ppl_mean_surprisal_bits": 0.0})
    return experiment.overlap(second, literal, signals, key).select("signal", "n", r9("r").alias("r"))


def record_violations(spark, d):
    return schema.violations(read_table(spark, d, "records")).groupBy("reason").agg(F.count("*").alias("n"))


def duplicate_ids(spark, d):
    return schema.duplicate_ids(read_table(spark, d, "records"))


def merge_spans(spark, d):
    s = _records(spark, d).select("id", F.explode("spans").alias("s")).select("id", "s.start", "s.end", "s.label")
    return builders.merge_spans(s, "id").select("id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "label")


def paraphrase_native(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", builders.paraphrase(F.col("text"), F.col("doc_id")).alias("text"))


def mixed_native(spark, d):
    docs = _docs(spark, d).where("text is not null").select("doc_id", plain("label").alias("label"), "text")
    h = ranked(docs.where("label = 'human'").select("doc_id", F.col("text").alias("h")), ["doc_id"], "k")
    a = ranked(docs.where("label = 'ai'").select(F.col("doc_id").alias("ai_id"), F.col("text").alias("a")), ["ai_id"], "k")
    m = builders.mix(h.join(a, "k").select("doc_id", "h", "a"), "doc_id", "h", "a")
    return m.select("doc_id", "text", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["label"])), ",").alias("spans"))


def model_family_case(spark, d):
    raw = F.col("generation.model_name")
    return read_table(spark, d, "records").where("generation is not null").groupBy(files.model_family(raw).alias("family")).agg(F.count("*").alias("n"))


def parse_src(spark, d):
    made = F.when(plain("label") == "human", F.concat(F.col("source"), F.lit("_human"))).otherwise(F.concat(F.regexp_replace(plain("source"), "-", "_"), F.lit("_machine_topical_"), F.coalesce("model_family", F.lit("x"))))
    s = files.parse_src(F.col("src"))
    return _docs(spark, d).select(made.alias("src")).where("src is not null").select(s["domain"].alias("domain"), s["model"].alias("model")).groupBy("domain", "model").agg(F.count("*").alias("n"))


def label_source_counts(spark, d):
    return _records(spark, d).groupBy(plain("label").alias("label"), plain("source").alias("source")).agg(F.count("*").alias("n"))


def lineage(spark, d):
    r = _records(spark, d)
    child = r.where("transform.parent_id is not null").select("id", F.col("transform.parent_id").alias("parent_id"), "transform.kind", "group_id")
    return child.join(r.select(F.col("id").alias("parent_id"), F.col("group_id").alias("parent_group")), "parent_id").select("id", "parent_id", "kind", F.col("group_id").eqNullSafe(F.col("parent_group")).alias("same_group"))


def run_score_means(spark, d):
    runs, s = read_table(spark, d, "experiment_runs"), _scores(spark, d)
    per = s.groupBy("run_id").agg(F.count("*").alias("n"), r9(F.avg("p_ai")).alias("mean_p_ai"))
    return runs.select("run_id", F.explode("ablations").alias("ablation")).join(per, "run_id").select("run_id", "ablation", "n", "mean_p_ai")


def baseline_importances(spark, d):
    f = _labelled(spark, d).withColumn("y", (F.col("label") == "ai").cast("int"))
    m = detector.train(f, features.STATISTICAL, "y", "doc_id")
    return spark.createDataFrame([(i, n, float(w)) for i, (n, w) in enumerate(m.importances())], "k int, feature string, coefficient double")


def analyze_bundle(spark, d):
    f = _labelled(spark, d)
    dist: dict = {}
    for r in detector.distributions(f, _FOUR).collect():  # two classes, a row per feature
        dist.setdefault(r["label"], {})[r["feature"]] = {"mean": r["mean"], "std": r["std"]}
    model = detector.Detector(LITERAL.features, LITERAL.center, LITERAL.scale, LITERAL.coef, LITERAL.intercept, LITERAL.calibration, "lexicon", {}, dist)
    s = analyze.System("demo", model, scorer="lexicon", scorer_options={"table": read_table(spark, d, "lexicon")})
    return analyze.analyze(_docs(spark, d), s, "doc_id", most_chars=None)


def queries() -> dict:
    skip = {"queries", "r9", "rounded", "plain"}
    return {k: v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_") and k not in skip}
