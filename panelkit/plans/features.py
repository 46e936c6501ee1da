"""Model matrices (ML1–ML4) as DataFrame expressions over the panel.

Column names follow the model features of the source application; the
stand-in panel supplies them as: IAA=iaa, IEG=ieg, IPS=ips, IDA=ida,
IPV=ipv, IAN=ian, IPP=ipp, FASE=phase, ANOS_PM=tenure, PEDRA=tier,
NOTA_MAT=ida, NOTA_PORT=ips, NOTA_ING=ipp (nullable), DEFASAGEM=lag,
GENERO=gender, INSTITUICAO=institution, PONTO_VIRADA=pv.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions.core import flag, ratio_by_phase, row_mean_skipna, row_mean_strict
from panelkit.operators.clean import median_fill
from panelkit.operators.joins import code_lookup
from panelkit.operators.windows import first_seen_code, transitions

__all__ = ["with_row_id", "LAG_FEATURES", "TIER_FEATURES", "TP_FEATURES", "ATTRITION_FEATURES",
           "lag_features", "tier_features", "turning_point_features", "attrition_features", "institution_codes",
           "add_institution_codes", "TP_FILL", "excluded_inputs"]

LAG_FEATURES = ["IAA", "IEG", "IPS", "IDA", "IPV", "FASE", "ANOS_PM", "GENERO_NUM", "PV_NUM",
                "SCORE_COMPORTAMENTAL", "GAP_IAA_IDA", "IEG_POR_FASE", "IEG_X_IPV", "IDA_X_ANOS"]
TIER_FEATURES = ["FASE", "ANOS_PM", "IAA", "IEG", "IPS", "IDA", "IPV", "NOTA_MAT", "NOTA_PORT",
                 "MEDIA_NOTAS", "MEDIA_INDICADORES", "GENERO_FEMININO", "INSTITUICAO_COD"]
TP_FEATURES = ["IAA", "IEG", "IPS", "IPP", "IDA", "IAN", "FASE", "ANOS_PM", "PEDRA_NUM", "NOTA_MAT",
               "NOTA_PORT", "NOTA_ING", "MEDIA_NOTAS", "MEDIA_INDICADORES", "GENERO_FEMININO", "INSTITUICAO_COD"]
ATTRITION_FEATURES = ["IAA", "IEG", "IPS", "IDA", "IPV", "IAN", "FASE", "ANOS_PM", "PEDRA_NUM", "MEDIA_INDICADORES"]


def with_row_id(p: DataFrame) -> DataFrame:
    """Stored, deterministic row id (never ``monotonically_increasing_id``)."""
    return p.withColumn("row_id", F.col("entity_id") * 10000 + F.col("yr"))


def _base(p: DataFrame, extra=()) -> DataFrame:
    return p.select(*extra,
        "entity_id", "yr", F.col("iaa").alias("IAA"), F.col("ieg").alias("IEG"), F.col("ips").alias("IPS"),
        F.col("ida").alias("IDA"), F.col("ipv").alias("IPV"), F.col("ian").alias("IAN"), F.col("ipp").alias("IPP"),
        F.col("phase").cast("double").alias("FASE"), F.col("tenure").cast("double").alias("ANOS_PM"),
        F.col("tier_ord").cast("double").alias("PEDRA_NUM"), F.col("tier").alias("PEDRA"),
        F.col("ida").alias("NOTA_MAT"), F.col("ips").alias("NOTA_PORT"), F.col("ipp").alias("NOTA_ING"),
        "gender", "pv", "lag", "institution")


def lag_features(p: DataFrame) -> DataFrame:
    """ML1: 14 features + RISCO = (lag < 0); complete cases on the raw ones."""
    b = _base(p)
    out = b.select(
        "entity_id", "yr", "IAA", "IEG", "IPS", "IDA", "IPV", "FASE", "ANOS_PM",
        flag(F.col("gender") == "Menino").alias("GENERO_NUM"), flag(F.col("pv") == "Sim").alias("PV_NUM"),
        row_mean_strict(["IAA", "IEG", "IPS"]).alias("SCORE_COMPORTAMENTAL"),
        (F.col("IAA") - F.col("IDA")).alias("GAP_IAA_IDA"),
        ratio_by_phase("IEG", "FASE").alias("IEG_POR_FASE"),
        (F.col("IEG") * F.col("IPV")).alias("IEG_X_IPV"),
        (F.col("IDA") * F.col("ANOS_PM")).alias("IDA_X_ANOS"),
        flag(F.col("lag") < 0).alias("label"))
    return out.dropna(subset=["IAA", "IEG", "IPS", "IDA", "IPV", "FASE", "ANOS_PM"])


def institution_codes(p: DataFrame) -> DataFrame:
    """Institution → code by first appearance (row id order)."""
    return first_seen_code(with_row_id(p), "institution", "row_id")


def add_institution_codes(df: DataFrame, codes: DataFrame) -> DataFrame:
    """INSTITUICAO_COD from a fitted code table; unseen institutions get −1."""
    return (code_lookup(df, codes, "institution").withColumn("INSTITUICAO_COD", F.col("code").cast("double"))
            .drop("code", "institution"))


def _common(b: DataFrame) -> DataFrame:
    return b.withColumns({
        "MEDIA_NOTAS": row_mean_skipna(["NOTA_MAT", "NOTA_PORT", "NOTA_ING"]),
        "GENERO_FEMININO": flag(F.col("gender") == "Menina").cast("double")})


def _without_code(features: list[str]) -> list[str]:
    return [f for f in features if f != "INSTITUICAO_COD"]


def tier_features(p: DataFrame, codes: DataFrame | None = None, coded: bool = True, labelled: bool = True) -> DataFrame:
    """ML2: 13 features (no index, no IAN) + tier label text. ``coded=False``
    leaves ``institution`` for a caller that fits the codes on its training
    part (D23); ``labelled=False`` keeps rows without a tier, to be scored."""
    b = _common(_base(p)).withColumn("MEDIA_INDICADORES", row_mean_skipna(["IAA", "IEG", "IPS", "IDA", "IPV"]))
    raw = _without_code(TIER_FEATURES)
    b = b.select("entity_id", "yr", "institution", *raw, F.col("PEDRA").alias("tier")).dropna(subset=raw + ["tier"] * labelled)
    if not coded:
        return b
    b = add_institution_codes(b, codes if codes is not None else institution_codes(p))
    return b.select("entity_id", "yr", *TIER_FEATURES, "tier")


#: columns whose gaps are filled with medians, and those that must be present
TP_FILL = ["IAN", "IPP", "NOTA_MAT", "NOTA_PORT", "NOTA_ING", "PEDRA_NUM", "MEDIA_NOTAS"]
TP_REQUIRED = ["IAA", "IEG", "IPS", "IDA", "FASE", "ANOS_PM"]


def turning_point_features(p: DataFrame, codes: DataFrame | None = None, fit_on: DataFrame | None = None,
                           fill: bool = True, coded: bool = True) -> DataFrame:
    """ML3: 16 features, label = pv == Sim. Neither IPV (the label is made from
    it) nor anything computed from it is among them: the mean is over IAA, IEG,
    IPS and IDA. Rows missing a required column go; a missing tier is ordinal 0;
    seven columns are median-filled. Medians are fitted on ``fit_on`` when
    given; ``fill=False`` and ``coded=False`` leave gaps and ``institution``
    for a caller that fits medians and codes on its training part (D23)."""
    b = _common(_base(p)).withColumn("PEDRA_NUM", F.coalesce("PEDRA_NUM", F.lit(0.0))).dropna(subset=TP_REQUIRED)
    b = b.withColumn("MEDIA_INDICADORES", row_mean_strict(["IAA", "IEG", "IPS", "IDA"]))
    b = b.select("entity_id", "yr", "institution", *_without_code(TP_FEATURES), flag(F.col("pv") == "Sim").alias("label"))
    if fill:
        b = median_fill(b, TP_FILL, fit_on=fit_on)
    if not coded:
        return b
    b = add_institution_codes(b, codes if codes is not None else institution_codes(p))
    return b.select("entity_id", "yr", *TP_FEATURES, "label")


ATTRITION_FILL = ["IPV", "IAN", "FASE", "ANOS_PM", "PEDRA_NUM", "MEDIA_INDICADORES"]


def attrition_features(p: DataFrame, first_year, last_year, fill: bool = True, labelled: bool = True) -> DataFrame:
    """ML4: transitions year → year+1 (J3), 10 features, label = left;
    complete on the four core indicators, the rest median-filled.
    ``labelled=False`` takes every row as it is, with a NULL label, to be scored."""
    t = transitions(p, "entity_id", "yr", first_year, last_year) if labelled else p.withColumn("left", F.lit(None).cast("int"))
    b = _base(t, extra=["left"])
    b = b.withColumn("MEDIA_INDICADORES", row_mean_skipna(["IAA", "IEG", "IPS", "IDA", "IPV", "IAN"]))
    b = b.select("entity_id", "yr", *ATTRITION_FEATURES, F.col("left").alias("label"))
    b = b.dropna(subset=["IAA", "IEG", "IPS", "IDA"] + ["label"] * labelled)
    return median_fill(b, ATTRITION_FILL) if fill else b


#: panel columns each feature is computed from (its own column where not listed)
FEATURE_INPUTS = {
    "IAA": ["iaa"], "IEG": ["ieg"], "IPS": ["ips"], "IDA": ["ida"], "IPV": ["ipv"], "IAN": ["ian"], "IPP": ["ipp"],
    "FASE": ["phase"], "ANOS_PM": ["tenure"], "PEDRA_NUM": ["tier_ord"], "GENERO_NUM": ["gender"], "PV_NUM": ["pv"],
    "GENERO_FEMININO": ["gender"], "INSTITUICAO_COD": ["institution"], "NOTA_MAT": ["ida"], "NOTA_PORT": ["ips"],
    "NOTA_ING": ["ipp"], "MEDIA_NOTAS": ["ida", "ips", "ipp"], "SCORE_COMPORTAMENTAL": ["iaa", "ieg", "ips"],
    "GAP_IAA_IDA": ["iaa", "ida"], "IEG_POR_FASE": ["ieg", "phase"], "IEG_X_IPV": ["ieg", "ipv"], "IDA_X_ANOS": ["ida", "tenure"],
}
#: means over indicators differ by model
MEAN_INPUTS = {"tier": ["iaa", "ieg", "ips", "ida", "ipv"], "turning_point": ["iaa", "ieg", "ips", "ida"],
               "attrition": ["iaa", "ieg", "ips", "ida", "ipv", "ian"]}
MODEL_FEATURES = {"lag_risk": LAG_FEATURES, "tier": TIER_FEATURES, "turning_point": TP_FEATURES, "attrition": ATTRITION_FEATURES}
#: columns that hold or decide a model's target and must not reach its features
EXCLUDED_INPUTS = {"lag_risk": {"lag", "ian", "inde"}, "tier": {"tier", "tier_ord", "inde", "ian"},
                   "turning_point": {"pv", "ipv", "ipv_n", "inde"}, "attrition": {"left", "inde"}}


def excluded_inputs() -> list[tuple[str, str, str]]:
    """(model, feature, input) for every feature computed from an excluded column."""
    out = []
    for model, feats in MODEL_FEATURES.items():
        for f in feats:
            inputs = MEAN_INPUTS[model] if f == "MEDIA_INDICADORES" else FEATURE_INPUTS[f]
            out += [(model, f, i) for i in inputs if i in EXCLUDED_INPUTS[model]]
    return out
