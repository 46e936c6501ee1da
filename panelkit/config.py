"""Domain constants.

FIXED VALUES — these must equal the source application's values for results
to agree; they are stated here plainly, in natural order, in one place.
"""

# --- fixed values: tier (stone) cut points on the composite index ----------
TIER_CUTS = [(5.506, "Quartzo"), (6.868, "Ágata"), (8.230, "Ametista")]
TIER_TOP = "Topázio"
TIER_MISSING = "Sem classificação"

# --- fixed values: tier ordinal (student page adds Diamante = 5) -----------
TIER_ORDINAL = {"Quartzo": 1, "Ágata": 2, "Ametista": 3, "Topázio": 4, "Diamante": 5}
TIER_ORDER = ["Quartzo", "Ágata", "Ametista", "Topázio"]
TIER_NEXT = {"Quartzo": "Ágata", "Ágata": "Ametista", "Ametista": "Topázio", "Topázio": "Diamante"}

# --- fixed values: spelling repairs (mojibake and unaccented forms) --------
TIER_SPELLING = {"Agata": "Ágata", "Topazio": "Topázio",
                 "Ã\x81gata": "Ágata", "TopÃ¡zio": "Topázio"}
YES_NO_REPAIR = {"NÃ£o": "Não"}
NULL_TOKENS = ["#NULO!", "D9891/2A", "D9600"]

# --- fixed values: level-adequacy bands on IAN ------------------------------
IAN_BANDS = [(8.0, "Adequado"), (5.0, "Moderadamente defasado"), (2.5, "Severamente defasado")]
IAN_LOWEST = "Criticamente defasado"
IAN_MISSING = "Sem dados"

# --- fixed values: attrition monitoring signals S1..S5 ----------------------
ALERT_IEG_LT = 5.5
ALERT_IPS_LT = 5.0
ALERT_IDA_LT = 5.5
ALERT_YEARS_GT = 4
ALERT_FLAG_AT = 2
MONITOR_LEVELS = [(3, "Crítico"), (2, "Atenção"), (1, "Observação")]
MONITOR_NONE = "Nenhum"
INDIVIDUAL_LEVELS = [(3, "Alto"), (2, "Moderado")]
INDIVIDUAL_LOW = "Baixo"
ALERT_REASONS = [
    "Engajamento crítico (IEG < 5.5)",
    "Aspecto psicossocial crítico (IPS < 5.0)",
    "Desempenho acadêmico baixo (IDA < 5.5)",
    "Regrediu de nível de classificação",
    "Estagnado há mais de 4 anos",
]

# --- fixed values: attention score (five flags) -----------------------------
ATTENTION_RULES = [("ieg", 5.5), ("ips", 5.0), ("ida", 5.5), ("inde", 5.0)]
ATTENTION_LEVELS = [(4, "Crítico"), (3, "Alto"), (2, "Moderado")]
ATTENTION_LOW = "Baixo"
ATTENTION_CRITICAL_AT = 3

# --- fixed values: probability bands ----------------------------------------
ATTRITION_BANDS = [(0.30, "Estável"), (0.60, "Acompanhar")]  # <0.30, <=0.60, else
ATTRITION_TOP = "Atenção"
LAG_BANDS = [(0.20, "Baixo"), (0.50, "Médio")]  # <=0.20, <=0.50, else
LAG_TOP = "Alto"

# --- fixed values: verdict thresholds --------------------------------------
TREND_EPS = 0.1
PARITY_EPS = 0.3
SELF_ASSESS_GAP = 0.5
NULL_SHARE_OK = 5.0
NULL_SHARE_WARN = 20.0
MIN_POSITIVES = 50
RECOMMEND_GAP = 2.0
RECOMMENDATIONS = [
    "Engajamento: Propor atividades mais interativas e acompanhamento próximo.",
    "Psicossocial: Encaminhar para suporte psicopedagógico.",
    "Desempenho: Reforço escolar em matemática e português.",
    "Autoavaliação: Trabalhar percepção realista do próprio desempenho.",
]
RECOMMEND_DEFAULT = "Indicadores adequados. Manter acompanhamento regular."
INDE_MESSAGES = [(4.0, "Requer atenção imediata"),
                 (6.0, "Em desenvolvimento — acompanhamento necessário"),
                 (8.0, "Progredindo bem")]
INDE_MESSAGE_TOP = "Excelente desenvolvimento"
INDE_MESSAGE_MISSING_AS = 5.0
STATUS_BANDS = [(8.0, "Excelente"), (6.0, "Bom")]
STATUS_LOW = "Em desenvolvimento"

# --- fixed values: student page gamification --------------------------------
XP_PER_INDE = 100
XP_PER_BADGE = 50
XP_PER_LEVEL = 1000
QUIZ_RIGHT = 10
QUIZ_WRONG = 2
QUIZ_FINISH = 20
QUIZ_LENGTH = 10
MISSIONS = [  # (mission id, measured column, target, reward xp)
    ("inde_7", "inde", 7.0, 200),
    ("nota_mat_8", "nota_mat", 8.0, 150),
    ("nota_port_8", "nota_port", 8.0, 150),
    ("nota_ing_6", "nota_ing", 6.0, 100),
]

# --- fixed values: model settings -------------------------------------------
SEED = 42
TEST_FRACTION = 0.2
N_FOLDS = 5
