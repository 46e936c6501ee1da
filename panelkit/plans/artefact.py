"""Trained artefacts that score raw rows (S4, S6, ML12–ML14, E9): every fitted
step of a model, from the panel's columns to the flag, is a stage of one saved
pipeline.

``RawFeatures`` → ``FirstSeenCodes`` → ``MedianFill`` → assembler → learner →
``ScoreThreshold``. The three steps that MLlib lacks are estimator and model
pairs of their own with readers and writers, so ``PipelineModel.save`` and
``load`` carry the codes (a Parquet table, as categories are not bounded), the
medians and the threshold (parameters) next to MLlib's own stages. A table that
was never seen in training is scored by ``load_artefact(path).transform(rows)``.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.functions.bands import attrition_band, lag_band
from panelkit.operators.clean import median_struct
from panelkit.operators.joins import code_lookup
from panelkit.operators.windows import first_seen_code

__all__ = ["RawFeatures", "FirstSeenCodes", "FirstSeenCodesModel", "MedianFill", "MedianFillModel", "ScoreThreshold",
           "artefact", "save_artefact", "load_artefact", "smoke_rows", "artefact_files"]


class RawFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Panel rows → the named model's feature columns, with gaps and uncoded
    categories. No label is needed; columns that only labels are made from may
    be absent. Rows that the model cannot score (a required indicator is
    missing) go, as in training."""

    model = Param(Params._dummy(), "model", "name of the model whose features are made", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, model: str = "lag_risk"):
        super().__init__()
        self._set(model=model)

    def _transform(self, rows: DataFrame) -> DataFrame:
        from panelkit.plans import features as FT
        absent = {"lag": "int", "pv": "string", "tier": "string", "tier_ord": "int", "ipv": "double", "ian": "double", "ipp": "double"}
        rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in absent.items() if c not in rows.columns})
        return {"lag_risk": lambda: FT.lag_features(rows),
                "tier": lambda: FT.tier_features(rows, coded=False, labelled=False),
                "turning_point": lambda: FT.turning_point_features(rows, fill=False, coded=False),
                "attrition": lambda: FT.attrition_features(rows, None, None, fill=False, labelled=False)}[self.getOrDefault("model")]()


class _CodesWriter(MLWriter):
    def __init__(self, stage: "FirstSeenCodesModel"):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sc)
        self.stage.codes.write.parquet(f"{path}/codes")


class _CodesReader(MLReader):
    def load(self, path: str) -> "FirstSeenCodesModel":
        meta = DefaultParamsReader.loadMetadata(path, self.sc)
        out = FirstSeenCodesModel(codes=self.sparkSession.read.parquet(f"{path}/codes"))
        out._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(out, meta)
        return out


class FirstSeenCodes(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Category → number by first appearance in the training rows, in the
    order of ``orderCol``."""

    orderCol = Param(Params._dummy(), "orderCol", "column whose order counts", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol: str = "institution", outputCol: str = "INSTITUICAO_COD", orderCol: str = "row_id"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, orderCol=orderCol)

    def _fit(self, rows: DataFrame) -> "FirstSeenCodesModel":
        from panelkit.session import cut_lineage
        codes = cut_lineage(first_seen_code(rows, self.getInputCol(), self.getOrDefault("orderCol")))
        return FirstSeenCodesModel(codes=codes, inputCol=self.getInputCol(), outputCol=self.getOutputCol())


class FirstSeenCodesModel(Model, HasInputCol, HasOutputCol, MLReadable, MLWritable):
    """Replaces the category by its code; an unseen or missing one is −1."""

    def __init__(self, codes: DataFrame | None = None, inputCol: str = "institution", outputCol: str = "INSTITUICAO_COD"):
        super().__init__()
        self.codes = codes
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, rows: DataFrame) -> DataFrame:
        c, out = self.getInputCol(), self.getOutputCol()
        return code_lookup(rows, self.codes, c).withColumn(out, F.col("code").cast("double")).drop("code", c)

    def write(self) -> MLWriter:
        return _CodesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _CodesReader()


class MedianFill(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """P20: the medians of the training rows; a column without any value gets 0."""

    @keyword_only
    def __init__(self, *, inputCols: list[str]):
        super().__init__()
        self._set(inputCols=inputCols)

    def _fit(self, rows: DataFrame) -> "MedianFillModel":
        cols = self.getInputCols()
        got = rows.select(median_struct(rows, cols).alias("m")).select("m").first() if cols and not rows.isEmpty() else None
        return MedianFillModel(inputCols=cols, medians=[(got[0][c] if got and got[0][c] is not None else 0.0) for c in cols])


class MedianFillModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Gaps filled with the fitted medians."""

    medians = Param(Params._dummy(), "medians", "one value for each input column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, medians: list[float] | None = None):
        super().__init__()
        self._set(inputCols=inputCols or [], medians=medians or [])

    def _transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in zip(self.getInputCols(), self.getOrDefault("medians"))})


class ScoreThreshold(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """ML11/ML12/ML14: probability of class 1 as ``score``, ``pred`` at the
    calibrated threshold, and the risk band."""

    threshold = Param(Params._dummy(), "threshold", "flag from this score on", TypeConverters.toFloat)
    band = Param(Params._dummy(), "band", "attrition, lag or empty", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, threshold: float = 0.5, band: str = ""):
        super().__init__()
        self._set(threshold=threshold, band=band)

    def _transform(self, rows: DataFrame) -> DataFrame:
        t, band = self.getOrDefault("threshold"), self.getOrDefault("band")
        out = rows.withColumn("score", vector_to_array("probability")[1])
        out = out.withColumns({"pred": (F.col("score") >= F.lit(t)).cast("int"), "threshold": F.lit(t)})
        if band:
            out = out.withColumn("band", attrition_band("score") if band == "attrition" else lag_band("score"))
        return out.drop("features", "raw_features", "rawPrediction", "probability", "prediction")


def artefact(model: str, fitted: list, learner: PipelineModel, threshold: float | None = None, band: str | None = None) -> PipelineModel:
    """One pipeline of the raw feature step, the fitted preparation steps, the
    learner's stages and, for a binary model, threshold and band."""
    stages = [RawFeatures(model=model), *fitted]
    skip = "StringIndexerModel" if threshold is None else ""  # a label index needs the label, which raw rows lack
    stages += [s for s in learner.stages if type(s).__name__ != skip]
    if threshold is not None:
        stages.append(ScoreThreshold(threshold=float(threshold), band=band or ""))
    else:
        labels = [s for s in learner.stages if type(s).__name__ == "StringIndexerModel"][0].labels
        stages.append(ClassScores(labels=list(labels)))
    return PipelineModel(stages)


class ClassScores(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """ML13: likeliest label, probability by label and its confidence."""

    labels = Param(Params._dummy(), "labels", "label texts by class number", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, labels: list[str] | None = None):
        super().__init__()
        self._set(labels=labels or [])

    def _transform(self, rows: DataFrame) -> DataFrame:
        labels = self.getOrDefault("labels")
        p = F.slice(vector_to_array("probability"), 1, len(labels))  # a place for unseen labels may follow
        names = F.array(*[F.lit(x) for x in labels])
        out = rows.withColumns({"pred_label": F.element_at(names, (F.col("prediction") + 1).cast("int")),
                                "probs": F.map_from_arrays(names, p), "confidence": F.array_max(p)})
        return out.drop("features", "raw_features", "rawPrediction", "probability", "prediction")


def save_artefact(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_artefact(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def artefact_files(spark: SparkSession, root: str, expected: list[str]) -> DataFrame:
    """One row per expected model: does its saved pipeline lie under ``root``,
    with how many stages, and does it score raw rows?"""
    rows = []
    for name in expected:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/metadata")
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        stages = load_artefact(f"{root}/{name}").stages if there else []
        rows.append((name, there, len(stages), bool(stages) and isinstance(stages[0], RawFeatures)))
    return spark.createDataFrame(rows, "model string, present boolean, stages int, scores_raw boolean")


def smoke_rows(spark: SparkSession, value: float = 5.0) -> DataFrame:
    """A raw panel row with every indicator at ``value`` and one whose
    optional indicators and category are missing."""
    cols = ["iaa", "ieg", "ips", "ida", "ipv", "ian", "ipp"]
    full = (1, 2000, *[value] * 7, 3, 1, 2, "Ágata", "Menina", "nowhere", "Sim", 0)
    gaps = (2, 2000, *[value] * 5, None, None, 3, 1, None, None, "Menino", None, None, 0)
    return spark.createDataFrame([full, gaps], "entity_id long, yr int, " + ", ".join(f"{c} double" for c in cols)
                                 + ", phase int, tenure int, tier_ord int, tier string, gender string, institution string, pv string, lag int")
