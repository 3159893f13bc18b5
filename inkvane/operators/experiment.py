"""Experiments: ablation systems, slices, unseen families, signal overlap, results as JSON."""

from __future__ import annotations

import json
import subprocess
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.lineage import cut
from . import analyze, decision, detector, evaluate, features, splits, standin

#: The feature sets of the ablation systems. `neural` has none; `combined` is the mean of `neural` and `classical_full`.
ABLATIONS = {"perplexity_only": features.PERPLEXITY, "style_only": features.STYLE + features.LEXICAL + features.REPETITION, "classical_full": features.STATISTICAL + features.PERPLEXITY, "neural": None, "combined": features.STATISTICAL + features.PERPLEXITY}


@dataclass
class Config:
    name: str
    dataset: str
    output_dir: str | None = None
    seed: int = 0
    train_ratio: float = 0.8
    scorer: str | None = "stub"
    neural_checkpoint: str | None = None
    neural_epochs: int = 2
    ablations: list[str] = field(default_factory=lambda: ["classical_full"])
    holdout_families: list[str] = field(default_factory=list)

    @classmethod
    def from_file(cls, path: str) -> "Config":
        return cls(**json.loads(Path(path).read_text(encoding="utf-8")))


def names_of(ablation: str, scorer: str) -> list[str]:
    if ablation not in ABLATIONS:
        raise ValueError(f"unknown ablation: {ablation}")
    if ablation == "perplexity_only" and scorer == "none":
        raise ValueError("perplexity_only needs a scorer")
    return [f for f in ABLATIONS[ablation] or [] if scorer != "none" or f not in features.PERPLEXITY]


class Run:
    """Features of all documents and sentences, computed once and shared by all systems and families."""

    def __init__(self, records: DataFrame, config: Config, common: list[str] | None = None, scorer_options: dict | None = None):
        self.config = config
        scorer = config.scorer or "none"
        flat = records.select("id", "text", "label", "spans", "group_id", F.col("generation.model_family").alias("model_family"), F.coalesce(F.col("transform.kind") == "paraphrase", F.lit(False)).alias("is_paraphrase"))
        probe = analyze.System("probe", detector.Detector([], [], [], [], 0.0), scorer=scorer, scorer_options=scorer_options or {}, common=common or [])
        self.docs = flat.drop("text").join(analyze.featurize(flat.select("id", "text"), "id", "text", probe).drop("text"), "id").persist()
        sents = tx.explode_sentences(flat, "id").withColumn("sk", F.concat_ws("#", "id", F.col("sid").cast("string")))
        self.sents = sents.join(analyze.featurize(sents.select("sk", "sentence"), "sk", "sentence", probe).drop("sentence"), "sk").join(flat.select("id", "label", "spans", "group_id", "model_family"), "id").withColumn("y", evaluate.truth(F.col("label"), F.col("spans"), F.col("start"), F.col("end"))).persist()

        self.marks: dict[str, DataFrame] = {}

    def close(self) -> None:
        self.docs.unpersist()
        self.sents.unpersist()

    def evaluate(self, ablation: str, assigned: DataFrame, keep: bool = False) -> dict:
        """Trains one system on the train split and gives its slices on the test split; keep: its sentence scores stay in self.marks."""
        names = names_of(ablation, self.config.scorer or "none")
        tags = assigned.select("id", "split")
        docs, sents = self.docs.join(tags, "id"), self.sents.join(tags, "id")
        pure = docs.where("label in ('human', 'ai')").withColumn("y", (F.col("label") == "ai").cast("int"))
        settings = detector.Config(seed=self.config.seed)
        known = sents.where("split = 'train' and y is not null")
        test, marks, importances = docs.where("split = 'test'"), sents.where("split = 'test'"), []
        if ablation in ("neural", "combined"):
            marks = standin.predict(standin.fit(known), marks, out="p_n")
            test = test.join(marks.groupBy("id").agg(F.avg("p_n").alias("p_n")), "id")
        if ablation != "neural":
            model = detector.train(pure.where("split = 'train'"), names, "y", "id", settings, self.config.scorer)
            test, importances = model.predict(test, "p_c"), model.importances(10)
            marks = detector.train(known, names, "y", "sk", settings, self.config.scorer).predict(marks, "p_c")
        p = {"neural": F.col("p_n"), "combined": (F.col("p_n") + F.col("p_c")) / 2 if ablation == "combined" else None}.get(ablation, F.col("p_c"))
        test, marks = test.withColumn("p", p).persist(), marks.withColumn("p", p).persist()
        decided = decision.aggregate(marks, "id", "p", test.select("id", F.col("p").alias("doc_p"))).join(test.select("id", F.col("label").alias("truth")), "id")
        out = {k: [r.asDict() for r in d.collect()] for k, d in evaluate.slices(test, marks, decided).items()}  # a row each
        out["importances"] = importances
        if keep:
            self.marks[ablation] = cut(marks.select("id", "sid", "p"))
        test.unpersist()
        marks.unpersist()
        return out


def run(records: DataFrame, config: Config, common: list[str] | None = None, scorer_options: dict | None = None) -> dict:
    """The whole experiment; with an output folder the result is also written to results.json."""
    c, r = config, Run(records, config, common, scorer_options)
    try:
        assigned = splits.assign_splits(records.select("id", "group_id"), train=c.train_ratio, val=0.0, test=round(1 - c.train_ratio, 12), seed=c.seed)
        result: dict = {"name": c.name, "created_at": datetime.now(timezone.utc).isoformat(), "config": asdict(c), "git_commit": _commit(), "ablations": {}}
        for a in c.ablations:
            result["ablations"][a] = r.evaluate(a, assigned, keep=True)
            flat = records.select("id", "label", "group_id", F.col("generation.model_family").alias("model_family"))
            result["ablations"][a]["unseen_family"] = {f: r.evaluate(a, splits.family_holdout(flat, [f], seed=c.seed))["seen"] for f in c.holdout_families}
        classical = next((a for a in ("classical_full", "style_only", "perplexity_only") if a in c.ablations), None)
        result["signal_overlap"] = []
        if "neural" in c.ablations and classical:
            names = tuple(n for n in SIGNALS if n in r.sents.columns)
            result["signal_overlap"] = [x.asDict() for x in overlap(r.marks["neural"], r.marks[classical], r.sents, ["id", "sid"], names, 40).collect()]  # a row per signal
    finally:
        r.close()
    if c.output_dir:
        out = Path(c.output_dir)
        out.mkdir(parents=True, exist_ok=True)
        (out / "results.json").write_text(json.dumps(result, indent=1, default=str), encoding="utf-8")
    return result


#: The features of a sentence that the signal overlap looks at.
SIGNALS = ("ppl_doc_perplexity", "ppl_mean_surprisal_bits", "lex_ttr", "sent_mean_len_words")


def paired(a: DataFrame, b: DataFrame, key: list[str], p: str = "p") -> DataFrame:
    """(key, p_a, p_b): two systems' scores of the same sentences. A sentence that only one of them scored is an error."""
    both = a.select(*key, F.col(p).alias("p_a"), F.lit(True).alias("_a")).join(b.select(*key, F.col(p).alias("p_b"), F.lit(True).alias("_b")), key, "full")
    one = F.col("_a").isNull() | F.col("_b").isNull()
    return both.where(F.when(one, F.raise_error(F.concat(F.lit("scored by one system only: "), F.concat_ws("#", *key))).cast("boolean")).otherwise(True)).drop("_a", "_b")


def overlap(neural: DataFrame, classical: DataFrame, signals: DataFrame, key: list[str], names: tuple[str, ...] = SIGNALS, first: int | None = None) -> DataFrame:
    """(signal, n, r): correlation of a neural system's sentence probabilities with a classical system's and with features of the sentences.

    neural, classical: (key, p); signals: (key, features). The first key column
    names the document; first=n takes the first n documents in its order. A
    side that is constant has correlation 0. One aggregation for all signals.
    """
    if first is not None:
        docs = neural.select(key[0]).distinct().orderBy(key[0]).limit(first)
        neural, classical = neural.join(F.broadcast(docs), key[0], "left_semi"), classical.join(F.broadcast(docs), key[0], "left_semi")  # n rows
    rows = paired(neural, classical, key).join(signals.select(*key, *names), key)
    columns = {"neural_vs_classical_prob": "p_b"} | {f"neural_vs_{n}": n for n in names}
    sums = rows.agg(F.count("*").alias("n"), F.var_pop("p_a").alias("v"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(columns.values()) for k, f in (("v", F.var_pop), ("c", lambda c: F.covar_pop("p_a", c)))])
    ok = lambda i: (F.col("v") > 0) & (F.col(f"v{i}") > 0)
    each = [F.struct(F.lit(name).alias("signal"), "n", F.when(ok(i), F.col(f"c{i}") / F.sqrt(F.when(ok(i), F.col("v") * F.col(f"v{i}")))).otherwise(0.0).alias("r")) for i, name in enumerate(columns)]
    return sums.select(F.explode(F.array(*each)).alias("x")).select("x.signal", "x.n", "x.r")


def plot_data(result: dict) -> list[tuple[str, float, float, float]]:
    """(system, seen AUROC, localization AUROC, mean F1 over unseen families) for the figures; missing values are 0."""
    rows = []
    for name, a in result["ablations"].items():
        first = lambda k: (a.get(k) or [{}])[0].get("auroc") or 0.0
        f1 = [(v or [{}])[0].get("f1") or 0.0 for v in a.get("unseen_family", {}).values()]
        rows.append((name, first("seen"), first("localization"), sum(f1) / len(f1) if f1 else 0.0))
    return rows


def _commit() -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        return None
