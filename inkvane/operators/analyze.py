"""Analysis of texts: one row per text with label, scores and evidence, for whole tables at once."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.lineage import cut
from . import decision, evaluate, features, scorers, splits
from .detector import Config as Settings
from .detector import Detector, compare, train

MOST_CHARS = 50_000  # the limit of a single request; batch tables pass None


@dataclass
class System:
    """A named detector: document and, optionally, sentence model, token scorer and rule."""

    name: str
    document: Detector
    sentence: Detector | None = None
    scorer: str = "none"
    scorer_options: dict = field(default_factory=dict)
    rule: decision.Rule = decision.Rule()
    common: list[str] = field(default_factory=list)


class Registry:
    """Detectors by name; a detector whose features differ from what its scorer setting gives is refused."""

    def __init__(self):
        self.systems: dict[str, System] = {}

    def add(self, s: System) -> None:
        want = features.STATISTICAL + (features.PERPLEXITY if s.scorer != "none" else [])
        unknown = [f for d in (s.document, s.sentence) if d for f in d.features if f not in want]
        if unknown:
            raise ValueError(f"{s.name}: features {unknown} are not given by scorer {s.scorer!r}")
        self.systems[s.name] = s

    @classmethod
    def from_folder(cls, folder: str, scorer: str = "none", **options) -> "Registry":
        """A registry of the artifacts in a folder: document.json, and sentence.json beside it where there is one."""
        at = Path(folder)
        if not (at / "document.json").is_file():
            raise FileNotFoundError(f"no document.json in {folder}")
        sentence = Detector.load(str(at / "sentence.json")) if (at / "sentence.json").is_file() else None
        out = cls()
        out.add(System("classical", Detector.load(str(at / "document.json")), sentence, scorer, options))
        return out

    @classmethod
    def trained(cls, records: DataFrame, scorer: str = "none", seed: int = 0, **options) -> "Registry":
        """A registry of document and sentence models trained on the train split of records, such as the synthetic corpus."""
        flat = splits.assign_splits(records.select("id", "group_id", "text", "label", "spans"), train=0.8, val=0.1, test=0.1, seed=seed).where("split = 'train'")
        want = features.STATISTICAL + (features.PERPLEXITY if scorer != "none" else [])
        probe = System("probe", Detector([], [], [], [], 0.0), None, scorer, options)
        pure = flat.where("label in ('human', 'ai')").select("id", "text", (F.col("label") == "ai").cast("int").alias("y"))
        document = train(cut(featurize(pure.select("id", "text"), "id", "text", probe).drop("text").join(pure.select("id", "y"), "id")), want, "y", "id", Settings(seed=seed), scorer)
        sents = tx.explode_sentences(flat, "id").join(flat.select("id", "label", "spans"), "id")
        sents = sents.select(F.concat_ws("#", "id", F.col("sid").cast("string")).alias("sk"), "sentence", evaluate.truth(F.col("label"), F.col("spans"), F.col("start"), F.col("end")).alias("y")).where("y is not null")
        sentence = train(cut(featurize(sents.select("sk", "sentence"), "sk", "sentence", probe).drop("sentence").join(sents.select("sk", "y"), "sk")), want, "y", "sk", Settings(seed=seed), scorer)
        out = cls()
        out.add(System("classical", document, sentence, scorer, options))
        return out

    @classmethod
    def from_environment(cls, environ: dict, demo: DataFrame) -> "Registry":
        """From INKVANE_ARTIFACTS (a folder) if that is set, else trained on the demo corpus; INKVANE_SCORER names the scorer ('stub' if unset)."""
        scorer = environ.get("INKVANE_SCORER", "stub")
        folder = environ.get("INKVANE_ARTIFACTS")
        return cls.from_folder(folder, scorer) if folder else cls.trained(demo, scorer)

    def get(self, name: str | None = None) -> System:
        if not self.systems or (name is not None and name not in self.systems):
            raise KeyError(f"unknown detector: {name}")
        return self.systems[name if name is not None else next(iter(self.systems))]

    def detectors(self) -> list[dict]:
        return [{"name": s.name, "scorer": s.scorer, "has_sentence_model": s.sentence is not None, "features": len(s.document.features)} for s in self.systems.values()]

    def health(self) -> dict:
        return {"status": "ok", "detectors": len(self.systems)}


def rejected(text: Column, most_chars: int | None = MOST_CHARS) -> Column:
    """Why a text can't be analyzed, or null: missing, blank, too long (never with no limit)."""
    why = F.when(text.isNull(), "missing").when(~F.regexp_like(text, F.lit(rf"[^{tx.SPACE}]")), "blank")
    return why if most_chars is None else why.when(F.length(text) > most_chars, "too long")


def featurize(df: DataFrame, key: str, text: str, s: System) -> DataFrame:
    """(key, text, features) of each text; a key must not be repeated where a scorer is used."""
    base = features.statistical(df.select(key, text), text, s.common)
    score = scorers.make(s.scorer, **s.scorer_options)
    return features.with_perplexity(base, score(tx.explode_words(df, key, text, offsets=False)), key) if score else base


def sentence_scores(df: DataFrame, key: str, s: System, text: str = "text") -> DataFrame:
    """(key, sid, start, end, sentence, p_ai): each sentence scored as a text of its own, without context."""
    sents = tx.explode_sentences(df, key, text)
    one = sents.withColumn("_sk", F.concat_ws("#", F.col(key).cast("string"), F.col("sid").cast("string")))
    feats = featurize(one, "_sk", "sentence", s).drop("sentence")
    model = s.sentence or s.document
    return one.join(model.predict(feats).select("_sk", "p_ai"), "_sk").drop("_sk")


def analyze(df: DataFrame, s: System, key: str = "id", text: str = "text", most_chars: int | None = MOST_CHARS) -> DataFrame:
    """One row per text: label, confidence, scores, sentence heat and evidence; rejected texts have only a reason.

    Evidence carries its kind: 'model' for what the classifier gives,
    'heuristic' for statistics of the text. Keys must be unique.
    """
    src = df.select(F.col(key), F.col(text).alias("text")).withColumn("reason", rejected(F.col("text"), most_chars))
    ok = src.where("reason is null").select(key, "text")
    feats = s.document.predict(featurize(ok, key, "text", s), "doc_p")
    sents = sentence_scores(ok, key, s)
    decided = decision.aggregate(sents, key, "p_ai", feats.select(key, "doc_p"), s.rule)
    heat = sents.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("sid", "start", "end", "p_ai"))).alias("heat"))
    names = [f for f in s.document.features]
    values = feats.select(key, F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names])).alias("features"))
    out = decided.join(heat, key).join(values, key)
    if s.document.distributions.get("human") and s.document.distributions.get("ai"):
        rows = [(c, f, d["mean"], d["std"]) for c, fs in s.document.distributions.items() for f, d in fs.items()]
        table = df.sparkSession.createDataFrame(rows, "label string, feature string, mean double, std double")
        c = compare(feats, names, table, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("feature", "observed", "z_vs_human", "z_vs_ai", "closer_to"))).alias("comparisons"))
        out = out.join(c, key, "left")
    else:
        out = out.withColumn("comparisons", F.lit(None).cast("array<struct<feature:string,observed:double,z_vs_human:double,z_vs_ai:double,closer_to:string>>"))
    score = scorers.make(s.scorer, **s.scorer_options)
    if score:
        out = out.join(scorers.surprisal_series(score(tx.explode_words(ok, key)), key), key, "left")
    else:
        out = out.withColumn("series", F.lit(None).cast("array<struct<start:int,end:int,text:string,surprisal_bits:double>>"))
    evidence = F.struct(
        F.struct(F.lit("model").alias("kind"), F.col("heat").alias("sentences")).alias("sentence_heat"),
        F.struct(F.lit("heuristic").alias("kind"), F.col("features").alias("values")).alias("features"),
        F.struct(F.lit("heuristic").alias("kind"), F.col("comparisons").alias("items")).alias("distributions"),
        F.struct(F.lit("heuristic").alias("kind"), F.col("series").alias("tokens")).alias("surprisal"))
    out = out.select(key, "label", "confidence", "p_human", "p_ai", "p_mixed", "doc_p", "n_sentences", "mean_p_ai", evidence.alias("evidence"))
    return src.select(key, "reason").join(out, key, "left")
